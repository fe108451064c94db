"""Range join by interval bins: points meet the intervals that hold them through an equality, however many there are.

Values are whole numbers. An interval belongs to the level whose bins are as long as itself or longer (bins double from level
to level), where it touches two bins at most. A point lies in one bin of each level that occurs; the levels are few, as
many as the logarithm of the longest interval. Joining on (level, bin) leaves a point with the intervals near it, and the
bounds decide. Neither side is broadcast unless Spark finds it small, and a bin with many points is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, level: Column) -> Column:
    """Bins of level n are 2^n long; shifting rounds down for negative values too."""
    return F.call_function("shiftright", value, level)


def range_join(points: DataFrame, value: Column, intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """Every row of ``points`` with every interval that holds its ``value``: low <= value <= high, whole numbers.

    An interval without ``high`` has no end, one without ``low`` no beginning. Rows with a null value and
    intervals that hold nothing match nothing.
    """
    bounded = intervals.withColumns({"_low": low.cast("bigint"), "_high": high.cast("bigint")})
    reach = points.select(value.cast("bigint").alias("v")).agg(F.min("v"), F.max("v")).first()
    least, most = (reach[0] or 0), (reach[1] or 0)
    # What lies beyond all points is cut off, so that open intervals have a length.
    cut = bounded.withColumns(
        {
            "_low": F.greatest(F.coalesce("_low", F.lit(least)), F.lit(least)),
            "_high": F.least(F.coalesce("_high", F.lit(most)), F.lit(most)),
        }
    ).where("_low <= _high")
    length = F.col("_high") - F.col("_low") + 1
    placed = cut.withColumn("_level", F.ceil(F.log2(length.cast("double"))).cast("int"))
    placed = placed.withColumn(
        "_bin",
        F.explode(
            F.array_distinct(F.array(_bin(F.col("_low"), F.col("_level")), _bin(F.col("_high"), F.col("_level"))))
        ),
    )
    # At most 64 small numbers.
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())
    spread = points.withColumn("_value", value.cast("bigint")).where("_value is not null")
    spread = spread.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    spread = spread.withColumn("_bin", _bin(F.col("_value"), F.col("_level")))
    joined = spread.join(placed, ["_level", "_bin"]).where("_value between _low and _high")
    return joined.drop("_level", "_bin", "_value", "_low", "_high")
