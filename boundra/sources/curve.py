"""Tables stored along a space-filling curve, so that requests in one region read few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of the curve: 2**16 a side of 32 m, from the corner of this origin; what lies outside is in the outermost ones.
ORIGIN, SIDE, BITS = -524_288.0, 32.0, 16
#: Requests are gathered in at most 4**REGIONS regions, each with the box of its own.
REGIONS = 3
BOX = ("min_x", "min_y", "max_x", "max_y")


def _place(v: Column) -> Column:
    return F.greatest(F.least(F.floor((v - ORIGIN) / SIDE), F.lit((1 << BITS) - 1)), F.lit(0)).cast("bigint")


def curve(x: Column, y: Column) -> Column:
    """A position's place along the curve: the bits of its cell's column and row in turn. Null positions come first."""

    def apart(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return v

    return apart(_place(x)).bitwiseOR(F.shiftleft(apart(_place(y)), 1))


def write_along_curve(df: DataFrame, path: str, files: int) -> None:
    """Write rows with a box (areas) or with x and y (addresses) in ``files`` ranges of the curve, each sorted along it.

    Points get a box too, so that both are read alike. A row's own place on the curve is that of its box's middle.
    """
    boxed = df if "min_x" in df.columns else df.withColumns({"min_x": F.col("x").cast("double"), "min_y": F.col("y").cast("double"), "max_x": F.col("x").cast("double"), "max_y": F.col("y").cast("double")})
    middle = curve((F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2)
    boxed.withColumn("curve", middle).repartitionByRange(files, "curve").sortWithinPartitions("curve").write.parquet(path)


def read_near(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """Rows whose box overlaps that of a region of requests (x1, y1, x2, y2): all rows that a request's own box can meet.

    The regions' boxes, 64 at most, are part of the filter that the scan gets, so files and row groups whose bounds lie apart from all
    of them aren't read.
    """
    middle = curve((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    boxes = requests.groupBy(F.shiftright(middle, 2 * (BITS - REGIONS)).alias("region")).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).collect()
    near = F.lit(False)
    for b in boxes:
        if None not in b:
            near = near | ((F.col("min_x") <= b.x2) & (F.col("max_x") >= b.x1) & (F.col("min_y") <= b.y2) & (F.col("max_y") >= b.y1))
    return spark.read.parquet(path).filter(near)
