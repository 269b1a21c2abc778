"""Opaque ids, property maps and scope codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the 16 voivodeships
VOIVODESHIPS = ["02", "04", "06", "08", "10", "12", "14", "16", "18", "20", "22", "24", "26", "28", "30", "32"]


def encode_id(**fields: Column) -> Column:
    """URL-safe base64 of a JSON object with the fields in the given order, without the line breaks that Spark puts in."""
    return F.rtrim(F.translate(F.base64(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).cast("binary")), "+/\r\n", "-_"), F.lit("="))


def decode_id(col: Column, schema: str) -> Column:
    """The fields of an opaque id; null where it isn't one."""
    plain = F.translate(col, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    good = col.rlike("^[A-Za-z0-9_-]+$") & (F.length(plain) % 4 != 1)
    return F.from_json(F.when(good, F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")), schema)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is used; else each use of an id works its text out again."""
    return df.withColumn(name, F.explode(F.array(value)))


def parse_properties(col: Column) -> Column:
    """A JSON object as a map; anything else as an empty one."""
    return F.coalesce(F.from_json(F.when(col.rlike(r"^\s*\{"), col), "map<string,string>"), F.create_map().cast("map<string,string>"))


def parse_scope(code: Column) -> Column:
    """struct<type, code> of a register code: voivodeship, county or municipality; null if it is none."""
    good = code.rlike("^[0-9]{2}([0-9]{2}([0-9]{2}[1-5])?)?$") & F.substring(code, 1, 2).isin(VOIVODESHIPS)
    kind = F.when(F.length(code) == 2, "voivodeship").when(F.length(code) == 4, "county").otherwise("municipality")
    return F.when(good, F.struct(kind.alias("type"), code.alias("code")))
