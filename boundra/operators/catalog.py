"""Reference dimensions of the register: layers, archives, packages, profiles. All values here are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boundra.functions.ids import VOIVODESHIPS

# fixed values: id, title, category; geometry is polygon and channel wfs unless noted below
LAYERS = [
    ("A00", "Granice państwa", "administrative"), ("A01", "Granice województw", "administrative"), ("A02", "Granice powiatów", "administrative"), ("A03", "Granice gmin", "administrative"),
    ("A04", "Granice miast", "administrative"), ("A05", "Granice jednostek ewidencyjnych", "administrative"), ("A06", "Granice obrębów ewidencyjnych", "administrative"),
    ("A07", "Punkty adresowe", "address"), ("A08", "Ulice", "address"),
    ("R01", "Granice rejonów statystycznych", "statistical"), ("R02", "Granice obwodów spisowych", "statistical"),
    ("S01", "Sąd apelacyjny", "court"), ("S02", "Sąd okręgowy", "court"), ("S03", "Sąd rejonowy", "court"), ("S04", "Wojewódzki sąd administracyjny", "court"),
    ("P01", "Prokuratura regionalna", "prosecution"), ("P02", "Prokuratura okręgowa", "prosecution"), ("P03", "Prokuratura rejonowa", "prosecution"),
    ("K01", "Komenda wojewódzka policji", "service"), ("K02", "Komenda powiatowa policji", "service"), ("K03", "Komenda stołeczna policji", "service"), ("K04", "Komenda rejonowa policji", "service"),
    ("K05", "Komisariat policji", "service"), ("K06", "Komenda wojewódzka straży pożarnej", "service"), ("K07", "Komenda powiatowa straży pożarnej", "service"), ("K08", "Oddział straży granicznej", "service"),
    ("K09", "Placówka straży granicznej", "service"), ("K10", "Dywizjon straży granicznej", "service"), ("K11", "Obszar działania szefa obrony cywilnej województwa", "service"),
    ("K12", "Obszar działania szefa obrony cywilnej powiatu", "service"), ("K13", "Obszar działania szefa obrony cywilnej gminy", "service"),
    ("U01", "Archiwum państwowe", "office"), ("U02", "Urząd skarbowy", "office"), ("U03", "Wyspecjalizowany urząd skarbowy", "office"), ("U04", "Urząd celno-skarbowy", "office"), ("U05", "Izba administracji skarbowej", "office"),
    ("U06", "Nadleśnictwo", "office"), ("U07", "Regionalna dyrekcja lasów państwowych", "office"), ("U08", "Zarząd zlewni PGW WP", "office"), ("U09", "Regionalny zarząd gospodarki wodnej PGW WP", "office"),
    ("U10", "Urząd morski", "office"), ("U11", "Urząd żeglugi śródlądowej", "office"),
    ("W01", "Linia podstawowa morza terytorialnego", "maritime"), ("W02", "Morze terytorialne RP", "maritime"), ("W03", "Morskie wody wewnętrzne", "maritime"), ("W04", "Wyłączna strefa ekonomiczna", "maritime"),
    ("W05", "Strefa przyległa", "maritime"), ("W06", "Morskie linie brzegowe", "maritime"), ("W07", "Pas nadbrzeżny", "maritime"), ("W08", "Pas ochronny", "maritime"), ("W09", "Pas techniczny", "maritime"),
    ("W10", "Reda", "maritime"), ("W11", "Port morski", "maritime"), ("W12", "Przystań morska", "maritime"),
]
GEOMETRY = {"A07": "point", "A08": "line", "W01": "line", "W06": "line"}
ARCHIVE_YEARS = [2005, 2006, 2007, 2008, 2009, 2010, 2011, 2012, 2015, 2016, 2017, 2018, 2019, 2020, 2021, 2022, 2023, 2024, 2025]
PACKAGES = [
    ("granice_administracyjne", "Granice administracyjne wg województw", "voivodeship", "boundaries"), ("adresy", "Adresy i ulice wg gmin", "municipality", "addresses"),
    ("adresy_pow", "Adresy i ulice wg powiatów", "county", "addresses"), ("adresy_woj", "Adresy i ulice wg województw", "voivodeship", "addresses"),
    ("adresy_zbiorcze", "Adresy i ulice - dane zbiorcze", "country", "addresses"), ("granice_specjalne", "Granice administracyjne i specjalne", "country", "boundaries"),
]
#: First letters, and numbers where not all, of each profile's layers.
PROFILES = {
    "administrative": lambda i: i[0] == "A" and i <= "A06", "administrative-history": lambda i: i[0] == "A" and i <= "A04", "cadastre-boundaries": lambda i: i in ("A05", "A06"),
    "jurisdictions": lambda i: i[0] in "RSPKU", "maritime": lambda i: i[0] == "W", "addresses": lambda i: i in ("A07", "A08"), "boundaries-full": lambda i: i not in ("A07", "A08"), "poland-full": lambda i: True,
}


def layers_table(spark: SparkSession) -> DataFrame:
    rows = [(i, t, c, GEOMETRY.get(i, "polygon"), "address-package" if c == "address" else "wfs") for i, t, c in LAYERS]
    return spark.createDataFrame(rows, "layer_id string, title string, category string, geometry string, channel string")


def archives_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(y, f"{y}-01-01", f"A0{k}") for y in ARCHIVE_YEARS for k in range(5)], "archive_year int, state_date string, layer_id string")


def packages_table(spark: SparkSession) -> DataFrame:
    holds = lambda kind, name: ["A07", "A08"] if kind == "addresses" else [i for i, _, _ in LAYERS if (i[0] == "A" and i <= "A06") == (name == "granice_administracyjne") and i not in ("A07", "A08")]
    return spark.createDataFrame([(n, t, s, k, holds(k, n)) for n, t, s, k in PACKAGES], "package string, title string, scope_type string, kind string, layer_ids array<string>")


def profiles_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, i) for p, has in PROFILES.items() for i, _, _ in LAYERS if has(i)], "profile string, layer_id string")


def voivodeships_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v,) for v in VOIVODESHIPS], "code string")
