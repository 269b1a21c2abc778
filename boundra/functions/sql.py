"""The scalar functions as SQL functions that inline into a query's plan; no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

from boundra.functions import crs, ids, text


def _projections() -> dict[str, str]:
    """to_2180 and to_4326; each step is a function of its own, whose arguments are what the step before gave."""
    radius, alpha, beta, e = crs.series()
    d = lambda v: f"{v!r}D"
    terms = lambda series, f, g: " ".join(f"{{sign}} {d(c)} * {f}({2 * k}D * a) * {g}({2 * k}D * b)" for k, c in enumerate(series, 1))
    plus, minus = (lambda t: t.format(sign="+")), (lambda t: t.format(sign="-"))
    pair = "STRUCT<a: DOUBLE, b: DOUBLE>"
    out = {
        # a: the conformal latitude's tangent, b: the longitude from the middle
        f"_to_2180_1(lon DOUBLE, lat DOUBLE) RETURNS {pair}": f"named_struct('a', sinh(atanh(sin(radians(lat))) - {d(e)} * atanh({d(e)} * sin(radians(lat)))), 'b', radians(lon - {d(crs.CENTRAL)}))",
        f"_to_2180_2(s {pair}) RETURNS {pair}": "named_struct('a', atan2(s.a, cos(s.b)), 'b', asinh(sin(s.b) / sqrt(s.a * s.a + cos(s.b) * cos(s.b))))",
        "_to_2180_3(a DOUBLE, b DOUBLE) RETURNS STRUCT<x: DOUBLE, y: DOUBLE>": (
            f"named_struct('x', {d(crs.EAST)} + {d(crs.SCALE * radius)} * (b {plus(terms(alpha, 'cos', 'sinh'))}), 'y', {d(crs.NORTH)} + {d(crs.SCALE * radius)} * (a {plus(terms(alpha, 'sin', 'cosh'))}))"
        ),
        "to_2180(lon DOUBLE, lat DOUBLE) RETURNS STRUCT<x: DOUBLE, y: DOUBLE>": (
            "CASE WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT isnan(lon) AND NOT isnan(lat) THEN _to_2180_3(_to_2180_2(_to_2180_1(lon, lat)).a, _to_2180_2(_to_2180_1(lon, lat)).b) END"
        ),
        f"_to_4326_1(a DOUBLE, b DOUBLE) RETURNS {pair}": f"named_struct('a', a {minus(terms(beta, 'sin', 'cosh'))}, 'b', b {minus(terms(beta, 'cos', 'sinh'))})",
        # the isometric latitude is undone in fixed steps
        "_to_4326_2(s DOUBLE) RETURNS DOUBLE": f"aggregate(sequence(1, 7), s, (v, i) -> tanh(atanh(s) + {d(e)} * atanh({d(e)} * v)))",
        f"_to_4326_3(s {pair}) RETURNS STRUCT<lon: DOUBLE, lat: DOUBLE>": f"named_struct('lon', {d(crs.CENTRAL)} + degrees(atan2(sinh(s.b), cos(s.a))), 'lat', degrees(asin(_to_4326_2(sin(asin(sin(s.a) / cosh(s.b)))))))",
        "to_4326(x DOUBLE, y DOUBLE) RETURNS STRUCT<lon: DOUBLE, lat: DOUBLE>": (
            f"CASE WHEN NOT isnan(x) AND NOT isnan(y) AND abs(x) < 1e9 AND abs(y) < 1e9 THEN _to_4326_3(_to_4326_1((y - {d(crs.NORTH)}) / {d(crs.SCALE * radius)}, (x - {d(crs.EAST)}) / {d(crs.SCALE * radius)})) END"
        ),
    }
    return out


def register_functions(spark: SparkSession) -> list[str]:
    """CREATE TEMPORARY FUNCTION for each expression; returns the names."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    c = "lower(t)"
    c = f"regexp_replace({c}, {quote(f'{text._START}([0-9]{{2}})-([0-9]{{3}}){text._END}')}, '$1$2')"
    c = f"translate({c}, '{text.POLISH[0]}', '{text.POLISH[1]}')"
    for short, whole in text.KINDS:
        c = f"regexp_replace({c}, {quote(rf'{text._START}(?:{short})\.?{text._EDGE}')}, ' {whole} ')"
    c = f"trim(regexp_replace({c}, {quote(r'[^\p{L}\p{N}/]+')}, ' '))"
    c = f"regexp_replace({c}, ' */ *', '/')"
    c = f"regexp_replace({c}, {quote('(^| )([0-9/]*[0-9][0-9/]*) ([a-z])(?= |$)')}, '$1$2$3')"
    area = f"trim(regexp_replace(lower(regexp_replace(translate(t, '{text._latin()[0]}', '{text._latin()[1]}'), {quote('[̀-ͯ^`¨¯´·¸]')}, '')), {quote(r'[^\p{L}\p{N}]+')}, ' '))"
    scopes = ", ".join(f"'{x}'" for x in ids.VOIVODESHIPS)
    made = {
        "normalize_polish(t STRING) RETURNS STRING": c,
        "normalize_area(t STRING) RETURNS STRING": area,
        "remove_street_kind(t STRING) RETURNS STRING": f"array_join(filter(regexp_extract_all(t, {quote(r'[\p{L}\p{N}/]+')}, 0), x -> x NOT IN ({', '.join(repr(k) for k in text.STREET_KINDS)})), ' ')",
        "distance(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE": "hypot(x2 - x1, y2 - y1)",
        "parse_properties(t STRING) RETURNS MAP<STRING, STRING>": r"coalesce(from_json(CASE WHEN t RLIKE '^\\s*\\{' THEN t END, 'map<string,string>'), CAST(map() AS MAP<STRING, STRING>))",
        "parse_scope(t STRING) RETURNS STRUCT<type: STRING, code: STRING>": f"CASE WHEN t RLIKE '^[0-9]{{2}}([0-9]{{2}}([0-9]{{2}}[1-5])?)?$' AND substring(t, 1, 2) IN ({scopes}) THEN named_struct('type', CASE length(t) WHEN 2 THEN 'voivodeship' WHEN 4 THEN 'county' ELSE 'municipality' END, 'code', t) END",
    }
    geometry = "STRUCT<kind: STRING, parts: ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>>"
    turn = lambda e, x, y: f"(({e}.bx - {e}.ax) * ({y} - {e}.ay) - ({e}.`by` - {e}.ay) * ({x} - {e}.ax))"
    # no SQL function takes a lambda's variable, so these are put in as text
    some = "slice(r, {}, greatest(size(r) - 1, 0))"
    segments = lambda g: f"flatten(transform(flatten({g}.parts), r -> zip_with({some.format(1)}, {some.format(2)}, (p, q) -> named_struct('ax', p.x, 'ay', p.y, 'bx', q.x, 'by', q.y))))"
    covered = lambda x, y, g: (
        f"(size(filter({segments(g)}, e -> ((e.ay > {y}) <> (e.`by` > {y})) AND CASE WHEN e.`by` > e.ay THEN {turn('e', x, y)} > 0 ELSE {turn('e', x, y)} < 0 END)) % 2 = 1"
        f" OR exists({segments(g)}, e -> {turn('e', x, y)} = 0 AND {x} BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND {y} BETWEEN least(e.ay, e.`by`) AND greatest(e.ay, e.`by`)))"
    )
    meet = (
        "least(e.ax, e.bx) <= greatest(f.ax, f.bx) AND least(f.ax, f.bx) <= greatest(e.ax, e.bx) AND least(e.ay, e.`by`) <= greatest(f.ay, f.`by`) AND least(f.ay, f.`by`) <= greatest(e.ay, e.`by`)"
        f" AND signum({turn('f', 'e.ax', 'e.ay')}) * signum({turn('f', 'e.bx', 'e.`by`')}) <= 0 AND signum({turn('e', 'f.ax', 'f.ay')}) * signum({turn('e', 'f.bx', 'f.`by`')}) <= 0"
    )
    first = "get(get(part, 0), 0)"
    inside = lambda inner, outer: f"({outer}.kind IN ('Polygon', 'MultiPolygon') AND exists({inner}.parts, part -> {covered(f'{first}.x', f'{first}.y', outer)}))"
    tokens = lambda c: f"regexp_extract_all({c}, {quote(r'[\p{L}\p{N}/]+')}, 0)"
    alike = "(1 - levenshtein(q, c) / greatest(length(q), length(c)))"
    match = lambda mode, confidence, far="CAST(NULL AS INT)": f"named_struct('mode', '{mode}', 'confidence', CAST({confidence} AS DOUBLE), 'distance', {far})"
    known = "'^(aleja|plac|rondo|osiedle|ulica) '"
    made |= {
        f"point_covered(x DOUBLE, y DOUBLE, g {geometry}) RETURNS BOOLEAN": covered("x", "y", "g"),
        f"geometries_intersect(a {geometry}, b {geometry}) RETURNS BOOLEAN": f"exists({segments('a')}, e -> exists({segments('b')}, f -> {meet})) OR {inside('a', 'b')} OR {inside('b', 'a')}",
        "format_address(locality STRING, street STRING, number STRING, postal STRING) RETURNS STRING": (
            f"concat_ws(' ', nullif(locality, ''), CASE WHEN coalesce(street, '') = '' THEN NULL WHEN normalize_polish(street) RLIKE {known} THEN street ELSE concat('ulica ', street) END, nullif(number, ''), nullif(postal, ''))"
        ),
        "classify_match(q STRING, c STRING) RETURNS STRUCT<mode: STRING, confidence: DOUBLE, distance: INT>": (
            f"CASE WHEN coalesce(length(q), 0) = 0 OR coalesce(length(c), 0) = 0 THEN {match('none', 0)} WHEN q = c THEN {match('exact', 1)}"
            f" WHEN length(q) >= {text.PREFIX_LENGTH} AND startswith(c, q) THEN {match('prefix', 0.9)} WHEN length(q) >= {text.CONTAINS_LENGTH} AND contains(c, q) THEN {match('contains', 0.75)}"
            f" WHEN size({tokens('q')}) > 0 AND size({tokens('c')}) > 0 AND aggregate({tokens('c')}, 0, (i, t) -> i + CASE WHEN get({tokens('q')}, i) = t THEN 1 ELSE 0 END) = size({tokens('q')}) THEN {match('contains', 0.72)}"
            f" WHEN size({tokens('q')}) > 0 AND size({tokens('c')}) > 0 AND forall({tokens('q')}, a -> exists({tokens('c')}, b -> startswith(b, a))) THEN {match('contains', 0.68)}"
            f" WHEN levenshtein(q, c) <= {text.FUZZY_DISTANCE} AND {alike} >= {text.FUZZY_SIMILARITY} THEN {match('fuzzy', alike, 'levenshtein(q, c)')} ELSE {match('none', 0, 'levenshtein(q, c)')} END"
        ),
        "encode_address_id(shard STRING, object STRING) RETURNS STRING": "rtrim('=', translate(base64(encode(to_json(named_struct('voivodeshipCode', shard, 'objectId', object)), 'UTF-8')), '+/\\r\\n', '-_'))",
        "decode_address_id(id STRING) RETURNS STRUCT<voivodeshipCode: STRING, objectId: STRING>": (
            "from_json(CASE WHEN id RLIKE '^[A-Za-z0-9_-]+$' AND length(id) % 4 <> 1 THEN decode(try_to_binary(rpad(translate(id, '-_', '+/'), CAST(ceil(length(id) / 4D) * 4 AS INT), '='), 'base64'), 'UTF-8') END, 'voivodeshipCode string, objectId string')"
        ),
    }
    made |= _projections()
    area_fields = "layerId STRING, objectId STRING, snapshotId BIGINT"
    plain = made["encode_address_id(shard STRING, object STRING) RETURNS STRING"]
    made["encode_area_id(layer STRING, object STRING, snapshot BIGINT) RETURNS STRING"] = plain.replace("named_struct('voivodeshipCode', shard, 'objectId', object)", "named_struct('layerId', layer, 'objectId', object, 'snapshotId', snapshot)")
    undo = made["decode_address_id(id STRING) RETURNS STRUCT<voivodeshipCode: STRING, objectId: STRING>"]
    made["decode_area_id(id STRING) RETURNS STRUCT<layerId: STRING, objectId: STRING, snapshotId: BIGINT>"] = undo.replace("voivodeshipCode string, objectId string", area_fields)
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
