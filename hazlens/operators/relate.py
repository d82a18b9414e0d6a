"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, NumericType, TimestampNTZType

from hazlens.staging import staged


def asof(left: DataFrame, right: DataFrame, by: str, at: str, take: list[str]) -> DataFrame:
    """Each row of ``left`` with ``take`` of the newest row of ``right`` of its group up to its time; null if there is none.

    ``right`` has one row a group and time. Both sides go through one window as one
    table, so a group costs a sort and no pairs are made. A group is cut into days, and what the days
    before a day left behind is carried to it, so a group with a third of all rows is worked on a day a task. Where
    ``at`` is a number, 86,400 of its units are a day; where it is neither a time nor a number, a group isn't cut.
    """
    kind = left.schema[at].dataType
    if isinstance(kind, NumericType):
        day = F.floor(F.col(at) / 86_400)
    else:
        day = F.to_date(at) if isinstance(kind, DatetimeType | TimestampNTZType) else F.lit(0)
    rows = left.select(by, at, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*take).alias("r")).schema["r"].dataType).alias("__r"))
    marks = right.select(by, at, F.lit(0).alias("__side"), F.lit(None).cast(rows.schema["__l"].dataType).alias("__l"), F.struct(*take).alias("__r"))
    before = Window.partitionBy(by, "__day").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("__day", day).withColumn("__last", F.last("__r", ignorenulls=True).over(before))
    # what a day leaves, and what those before it left: a row a group and day
    own = F.max_by("__r", F.when(F.col("__side") == 0, F.struct(F.col(at).isNotNull(), F.col(at))))
    days = both.groupBy(F.col(by).alias("__by"), F.col("__day").alias("__on")).agg(own.alias("__left"))
    earlier = Window.partitionBy("__by").orderBy("__on").rowsBetween(Window.unboundedPreceding, -1)
    days = staged(days.withColumn("__carried", F.last("__left", ignorenulls=True).over(earlier)).select("__by", "__on", "__carried"), "days")
    met = both.where("__side = 1").join(days, F.col(by).eqNullSafe(F.col("__by")) & F.col("__day").eqNullSafe(F.col("__on")))
    found = F.coalesce("__last", "__carried")
    return met.select("__l", found.alias("__found")).select("__l.*", *(F.col(f"__found.{c}").alias(c) for c in take))
