"""Dense ids and exact order statistics without one task seeing every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.session import materialize


def number_rows(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """start, start+1, ... in a total order.

    Range partitions are numbered on their own and shifted by the row counts of
    the partitions before them: only one count per partition is put in order."""
    # Written first: finding the range bounds would otherwise run the input twice.
    parts = materialize(
        materialize(df).repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").count()
    # One row per range partition, so this single ordered window stays small.
    before = counts.withColumn(
        "_shift", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_part", "_shift")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.withColumn("_n", inside).join(F.broadcast(before), "_part")
        .withColumn(name, (F.col("_n") + F.col("_shift") + (start - 1)).cast("long")).drop("_n", "_shift", "_part")
    )


def cell_ids(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "Cell_ID") -> DataFrame:
    """1..n per output cell, over the layer or per source polygon."""
    if not by:
        return number_rows(df, order, name)
    # Numbered over the layer, then shifted per polygon, so that a polygon with
    # very many cells is not sorted by one task.
    numbered = number_rows(df, by + order, "_all")
    first = numbered.groupBy(*by).agg(F.min("_all").alias("_first"))
    return numbered.join(first, by).withColumn(name, F.col("_all") - F.col("_first") + 1).drop("_all", "_first")


def medians(df: DataFrame, **values: Column) -> DataFrame:
    """One row with the exact median of each value; null where there is none.

    An even count averages the middle two; nulls don't count. Equal values are one
    row with a count, so a value shared by a third of the rows is no burden. These
    rows are dealt by range, each partition knows how many values lie before it, and
    only the middle ones are left in the end: nothing but the answer leaves Spark."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in enumerate(values.values())]))
    counted = materialize(df.select(each.alias("_e")).select("_e.*").filter("v is not null").groupBy("k", "v").count())
    parts = materialize(counted.repartitionByRange("k", "v").withColumn("_part", F.spark_partition_id()))
    # One row for each value and range partition.
    sums = parts.groupBy("k", "_part").agg(F.sum("count").alias("_sum"))
    over = Window.partitionBy("k")
    before = sums.withColumn("_n", F.sum("_sum").over(over)).withColumn(
        "_before", F.sum("_sum").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum"))
    inside = Window.partitionBy("k", "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("count").over(inside)
    ranked = parts.join(F.broadcast(before.select("k", "_part", "_n", "_before")), ["k", "_part"]).withColumn("_upto", upto)
    holds = lambda rank: (F.col("_upto") - F.col("count") <= rank) & (rank < F.col("_upto"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = ranked.select("k", F.when(holds(low), F.col("v")).alias("lo"), F.when(holds(high), F.col("v")).alias("hi")).filter("lo is not null or hi is not null")
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return middle.agg(*[((of(k, "lo") + of(k, "hi")) / 2.0).alias(name) for k, name in enumerate(values)])


def median_frame(df: DataFrame, value: Column, name: str = "median") -> DataFrame:
    """One row with the median; null for no rows."""
    return medians(df, **{name: value})


def median(df: DataFrame, value: Column) -> float | None:
    """The median as a number."""
    return medians(df, median=value).first()["median"]
