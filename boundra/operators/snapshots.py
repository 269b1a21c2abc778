"""Which rows count: validity dates, current snapshots, layers, codes; upserts of the catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundra.functions.text import lower_ascii


def valid_on(date: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Null-open closed interval; dates are compared as text."""
    return (F.col(valid_from).isNull() | (F.col(valid_from) <= date)) & (F.col(valid_to).isNull() | (date <= F.col(valid_to)))


#: Bits of the days that bins tell apart, counted from 1800-01-01; days before and after are in the first and last bin.
DAY_BITS = 18


def _day(date: Column) -> Column:
    parsed = F.try_to_date(date, "yyyy-MM-dd")
    return F.when(parsed.isNotNull(), F.greatest(F.least(F.datediff(parsed, F.lit("1800-01-01").cast("date")), F.lit((1 << DAY_BITS) - 1)), F.lit(0)))


def _bins(first: Column, last: Column) -> Column:
    """The fewest bins whose days are those from first to last: a bin of level k has 2**k days, and there are two a level at most."""
    start = F.struct(first.cast("bigint").alias("a"), (last + 1).cast("bigint").alias("b"), F.array().cast("array<struct<level:int,bin:bigint>>").alias("bins"))

    def step(s: Column, k: Column) -> Column:
        bin_ = lambda v: F.array(F.struct(k.cast("int").alias("level"), v.alias("bin")))
        none = F.array().cast("array<struct<level:int,bin:bigint>>")
        open_ = s["a"] < s["b"]
        left = F.when(open_ & (s["a"] % 2 == 1), bin_(s["a"])).otherwise(none)
        right = F.when(open_ & (s["b"] % 2 == 1), bin_(s["b"] - 1)).otherwise(none)
        return F.struct(F.floor((s["a"] + 1) / 2).cast("bigint").alias("a"), F.floor(s["b"] / 2).cast("bigint").alias("b"), F.concat(s["bins"], left, right).alias("bins"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(DAY_BITS)), start, step)["bins"]


def as_of_join(requests: DataFrame, versions: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Pairs of requests and versions of the same ``keys`` that are valid on the request's date: all columns of both.

    ``versions`` has valid_from and valid_to, closed and open where null. Validity is laid on bins of days of doubling
    lengths and a date on the one bin of each length, so that a pair meets once, by equality: a key of many versions and requests is many
    keys, and no pair is made that isn't valid. A date or version that isn't in days of the calendar has no pairs.
    """
    spread, held = _on_bins(requests, date), _in_bins(versions)
    exact = valid_on(F.col(date))  # days beyond the bins' ends
    # by shuffling: rows are multiplied by their bins after they were counted, so none of the sides is known to be small
    return spread.join(held.hint("merge"), [*keys, "_level", "_bin"]).drop("_level", "_bin").filter(exact)


def _on_bins(requests: DataFrame, date: str) -> DataFrame:
    """Requests on the bin of each length that holds their day: _level, _bin."""
    day = _day(F.col(date))
    bins = F.transform(F.sequence(F.lit(0), F.lit(DAY_BITS)), lambda k: F.struct(k.cast("int").alias("level"), F.floor(day / F.pow(F.lit(2.0), k)).cast("bigint").alias("bin")))
    spread = requests.filter(day.isNotNull()).withColumn("_b", F.explode(bins))
    return spread.select("*", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin")).drop("_b")


def _in_bins(versions: DataFrame) -> DataFrame:
    """Versions on the bins whose days are theirs: _level, _bin."""
    first = F.when(F.col("valid_from").isNull(), F.lit(0)).otherwise(_day(F.col("valid_from")))
    last = F.when(F.col("valid_to").isNull(), F.lit((1 << DAY_BITS) - 1)).otherwise(_day(F.col("valid_to")))
    held = versions.filter(first <= last).withColumn("_b", F.explode(_bins(first, last)))
    return held.select("*", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin")).drop("_b")


def as_of_summary(requests: DataFrame, versions: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """As ``as_of_join``, but only how many versions each request has, and the oldest and newest valid_from: columns of ``requests``, versions, oldest, newest.

    No pair is made: versions are summed up by key and bin, each is in one of the bins that hold a day, and the requests of a key and
    date are answered once. So work grows with rows, not with the pairs of a hot key. Days at the bins' ends, which may stand for others
    beyond, take pairs.
    """
    day = _day(F.col(date))
    end = (day <= 0) | (day >= (1 << DAY_BITS) - 1)
    asked = requests.select(*keys, date).distinct()
    whole = lambda rows, n: rows.groupBy(*keys, date).agg(n.alias("versions"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
    sums = _in_bins(versions).groupBy(*keys, "_level", "_bin").agg(F.count(F.lit(1)).alias("n"), F.min("valid_from").alias("oldest"), F.max("valid_from").alias("newest"))
    inner = whole(_on_bins(asked.filter(~end), date).join(sums.hint("merge"), [*keys, "_level", "_bin"]), F.sum("n"))
    outer = whole(as_of_join(asked.filter(end), versions, keys, date).withColumns({"oldest": F.col("valid_from"), "newest": F.col("valid_from")}), F.count(F.lit(1)))
    return requests.join(inner.unionByName(outer), [*keys, date])


def current_snapshots(coverage: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """(layer_id, snapshot_id) of complete current country-wide coverage."""
    c = coverage.filter((F.col("dataset_key") == F.concat(F.lit("current:"), F.col("layer_id"))) & (F.col("archive_year") == 0) & (F.col("scope_type") == "country") & (F.col("scope_code") == "PL") & (F.col("completeness") == "complete"))
    if layers is not None:
        c = c.join(layers, "layer_id", "left_semi")
    return c.select("layer_id", "snapshot_id").distinct()


def select_snapshot(areas: DataFrame, mode: str, snapshot_id: int | None = None, current: DataFrame | None = None) -> DataFrame:
    """explicit: of one id; current: of the current snapshots (none of them: no rows); latest: of the largest id of each layer."""
    if mode == "explicit":
        return areas.filter(F.col("snapshot_id") == snapshot_id)
    if mode == "current":
        return areas.join(current, ["layer_id", "snapshot_id"], "left_semi")
    if mode == "latest":
        last = areas.groupBy("layer_id").agg(F.max("snapshot_id").alias("snapshot_id"))
        return areas.join(last, ["layer_id", "snapshot_id"], "left_semi")
    raise ValueError(f"unknown snapshot mode {mode}")


def filter_layers(areas: DataFrame, layer_ids: list[str] | None = None, category: str | None = None, layers: DataFrame | None = None, polygon_only: bool = False) -> DataFrame:
    """Rows of the layers asked for. Category ``address`` holds no boundaries and is refused."""
    if category == "address":
        raise ValueError("INVALID_INPUT: the category address has no areas")
    if layer_ids is not None:
        areas = areas.filter(F.col("layer_id").isin(layer_ids))
    if category is not None:
        areas = areas.join(F.broadcast(layers.filter(F.col("category") == category).select("layer_id")), "layer_id", "left_semi")
    if polygon_only:
        areas = areas.filter(F.col("geom.kind").isin("Polygon", "MultiPolygon"))
    return areas


def filter_code(code: Column, asked: Column) -> Column:
    return F.lower(F.coalesce(code, F.lit(""))) == F.lower(asked)


def filter_areas(areas: DataFrame, requests: DataFrame, limit: int = 20) -> DataFrame:
    """Areas for requests without text (request_id, code, layer_id): the first ``limit`` by order.

    A null asks nothing; a request that asks nothing at all has no rows. Requests that ask the same are answered once, so
    their areas are ranked once and not for each of them.
    """
    from boundra.operators.spatial import order_keys, top_k

    requests = requests.select("request_id", F.lower("code").alias("q_code"), F.col("layer_id").alias("q_layer")).filter("q_code IS NOT NULL OR q_layer IS NOT NULL")
    asked = requests.select("q_code", "q_layer").distinct()
    held = areas.withColumn("_code", F.lower(F.coalesce("code", F.lit(""))))
    by_code = asked.filter("q_code IS NOT NULL").join(held, (F.col("q_code") == F.col("_code")) & (F.col("q_layer").isNull() | (F.col("q_layer") == F.col("layer_id"))))
    by_layer = asked.filter("q_code IS NULL").join(held, F.col("q_layer") == F.col("layer_id"))
    best = top_k(by_code.unionByName(by_layer), ["q_code", "q_layer"], order_keys(), limit)
    listed = best.groupBy("q_code", "q_layer").agg(F.collect_list(F.struct("rank", "layer_id", "object_id", "name")).alias("_best"))
    same = requests["q_code"].eqNullSafe(listed["q_code"]) & requests["q_layer"].eqNullSafe(listed["q_layer"])
    return requests.join(listed, same).select("request_id", F.explode("_best").alias("_a")).select("request_id", "_a.rank", "_a.layer_id", "_a.object_id", "_a.name")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def upsert(table: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``updates`` replace the rows of ``table`` with the same keys; a null key counts as empty text."""
    both = table.withColumn("_turn", F.lit(0)).unionByName(updates.withColumn("_turn", F.lit(1)))
    made = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    ranked = both.withColumn("_n", F.row_number().over(Window.partitionBy(*made).orderBy(F.col("_turn").desc())))
    return ranked.filter("_n = 1").drop("_n", "_turn")


def dedupe_snapshots(snapshots: DataFrame, coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the largest id of each (dataset_key, scope, state date); coverage points to what is kept."""
    keys = ["dataset_key", "scope", F.coalesce("state_date", F.lit(""))]
    marked = snapshots.withColumn("_keep", F.max("id").over(Window.partitionBy(*keys)))
    remap = marked.select(F.col("id").alias("snapshot_id"), "_keep")
    return marked.filter("id = _keep").drop("_keep"), coverage.join(remap, "snapshot_id", "left").withColumn("snapshot_id", F.coalesce("_keep", "snapshot_id")).drop("_keep")
