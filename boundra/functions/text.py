"""Text as column expressions: normalisation, match classes, addresses. No Python on the rows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
POLISH = ("ąćęłńóśźż", "acelnoszz")
KINDS = [("ul|ulica", "ulica"), ("al|aleja", "aleja"), ("pl|plac", "plac")]
STREET_KINDS = ["ulica", "aleja", "plac", "rondo", "osiedle"]
CONTAINS_LENGTH, PREFIX_LENGTH, FUZZY_DISTANCE, FUZZY_SIMILARITY = 3, 2, 2, 0.78
MODES = ["exact", "prefix", "contains", "fuzzy", "none"]

#: An ASCII word boundary: Java's \b isn't ASCII-only.
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: The same before and after a letter or digit.
_START, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def lower_ascii(col: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalize_polish(col: Column) -> Column:
    """Search form of Polish text: plain letters, whole street kinds, glued number suffixes."""
    c = F.lower(col)
    c = F.regexp_replace(c, f"{_START}([0-9]{{2}})-([0-9]{{3}}){_END}", "$1$2")
    c = F.translate(c, *POLISH)
    for short, whole in KINDS:
        c = F.regexp_replace(c, rf"{_START}(?:{short})\.?{_EDGE}", f" {whole} ")
    c = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}/]+", " "))
    c = F.regexp_replace(c, " */ *", "/")
    return F.regexp_replace(c, "(^| )([0-9/]*[0-9][0-9/]*) ([a-z])(?= |$)", "$1$2$3")


def _latin() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, from Unicode's own decompositions."""
    marked, plain = "łŁ", "lL"
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            marked, plain = marked + chr(code), plain + base[0]
    return marked, plain


def normalize_area(col: Column) -> Column:
    """Search form of area names: Latin letters without marks, lower case, single blanks."""
    c = F.regexp_replace(F.translate(col, *_latin()), r"[̀-ͯ^`¨¯´·¸]", "")
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def match_tokens(col: Column) -> Column:
    """Tokens for match classes keep the slash."""
    return F.regexp_extract_all(col, F.lit(r"[\p{L}\p{N}/]+"), F.lit(0))


def classify_match(query: Column, candidate: Column) -> Column:
    """struct<mode, confidence, distance> of two texts in search form."""
    q, c = query, candidate
    qt, ct = match_tokens(q), match_tokens(c)
    ordered = F.aggregate(ct, F.lit(0), lambda i, t: i + F.when(F.get(qt, i) == t, 1).otherwise(0)) == F.size(qt)
    covered = F.forall(qt, lambda a: F.exists(ct, lambda b: b.startswith(a)))
    some = (F.size(qt) > 0) & (F.size(ct) > 0)
    far = F.levenshtein(q, c)
    alike = 1 - far / F.greatest(F.length(q), F.length(c))
    none = F.lit(None).cast("int")
    m = lambda mode, conf, dist=none: F.struct(F.lit(mode).alias("mode"), (conf if isinstance(conf, Column) else F.lit(float(conf))).alias("confidence"), dist.alias("distance"))
    return (
        F.when((F.coalesce(F.length(q), F.lit(0)) == 0) | (F.coalesce(F.length(c), F.lit(0)) == 0), m("none", 0))
        .when(q == c, m("exact", 1))
        .when((F.length(q) >= PREFIX_LENGTH) & c.startswith(q), m("prefix", 0.9))
        .when((F.length(q) >= CONTAINS_LENGTH) & c.contains(q), m("contains", 0.75))
        .when(some & ordered, m("contains", 0.72))
        .when(some & covered, m("contains", 0.68))
        .when((far <= FUZZY_DISTANCE) & (alike >= FUZZY_SIMILARITY), m("fuzzy", alike, far))
        .otherwise(m("none", 0, far))
    )


def mode_weight(mode: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in MODES]), mode).cast("int") - 1


def best_match(query: Column, candidates: list[Column]) -> Column:
    """The best of several matches: by mode, then confidence."""
    ranked = [F.struct(mode_weight(m["mode"]).alias("w"), (-m["confidence"]).alias("c"), m.alias("m")) for m in (classify_match(query, c) for c in candidates)]
    return F.array_min(F.array(*ranked))["m"] if len(ranked) > 1 else ranked[0]["m"]


def remove_street_kind(col: Column) -> Column:
    """A text in search form without its street kinds."""
    return F.array_join(F.filter(match_tokens(col), lambda t: ~t.isin(STREET_KINDS)), " ")


def format_address(locality: Column, street: Column, number: Column, postal: Column) -> Column:
    """Locality, street with a kind, number, postal code; missing parts left out."""
    known = normalize_polish(street).rlike("^(aleja|plac|rondo|osiedle|ulica) ")
    named = F.when(F.coalesce(street, F.lit("")) == "", None).when(known, street).otherwise(F.concat(F.lit("ulica "), street))
    empty = lambda c: F.when(c == "", None).otherwise(c)
    return F.concat_ws(" ", empty(locality), named, empty(number), empty(postal))
