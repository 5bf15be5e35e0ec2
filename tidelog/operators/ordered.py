"""Orders: decisions that depend on the one before, and positions and running sums in orders of any length."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

State = Any


def walk(
    rows: DataFrame, key: str, order: list[str], schema: str,
    start: Callable[[], State], step: Callable[[State, Any], Iterable[tuple]], finish: Callable[[State], Iterable[tuple]] = lambda _: (),
) -> DataFrame:
    """Rows hashed by `key` and sorted by `order` pass through `step`, which changes the key's state and
    gives the rows that are final; `finish` gives the rest when the key ends.

    Only Arrow batches and one state are held, however many rows a key has.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, any_key = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                at = getattr(row, key)
                if not any_key or at != current:
                    if any_key:
                        out.extend(finish(state))
                    current, state, any_key = at, start(), True
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)
        if any_key:
            yield pd.DataFrame(list(finish(state)), columns=names)

    return rows.filter(f"`{key}` IS NOT NULL").repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` dealt by ranges of `order` and stored, with the range's number, `_part`, and the place in it, `_place`, from 0."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.monotonically_increasing_id())
    return stored(dealt, "ranges").withColumns({"_place": F.col("_part") % (1 << 33), "_part": F.floor(F.col("_part") / (1 << 33))})


def positions(rows: DataFrame, order: list[str], name: str = "position", by: str | None = None) -> DataFrame:
    """`rows` with their places, from 1, in the order of `order`, or of `by` and `order` within each `by`.

    Rows are dealt by ranges, so that neither the whole nor one key is one task's work: a row's
    position is its place in the range and what the ranges before have. What is broadcast has at
    most two rows for a range: its own total, and that of a key that goes on from the range before.
    """
    if by is None:
        ranges = _ranges(rows, order)
        per = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
        before = per.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
        return ranges.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
    ranges = _ranges(rows, [by, *order])
    per = ranges.groupBy(F.col(by).alias("_by"), "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    whole = per.withColumn("_before", F.sum("_n").over(Window.partitionBy("_by").orderBy("_part")) - F.col("_n"))
    # A key's first row in a range stands at place 0 if it goes on from the range before; else keys are numbered within the range.
    later = whole.filter("_before > 0").select("_by", "_part", "_before")
    within = F.row_number().over(Window.partitionBy("_part", by).orderBy(*order))
    joined = ranges.withColumn("_within", within).join(F.broadcast(later), (F.col(by).eqNullSafe(F.col("_by"))) & (ranges["_part"] == later["_part"]), "left").drop(later["_part"])
    return joined.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_within")).drop("_part", "_place", "_before", "_within", "_by")


def running_sums(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """`rows` with each of the columns summed up to and with the row, in the order of `order`: within ranges, and over their totals."""
    ranges = _ranges(rows, order)
    per = ranges.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_part", *[F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in columns])
    so_far = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranges.withColumns({c: F.sum(c).over(so_far) for c in columns}).join(F.broadcast(before), "_part").withColumns({c: F.col(c) + F.col(f"_{c}") for c in columns}).drop("_part", "_place", *[f"_{c}" for c in columns])


def medians(rows: DataFrame, by: str, value: Column, name: str = "median") -> DataFrame:
    """(by, name): the exact median of each group's values, nulls left out.

    Values are counted, and the counts summed up by ranges of (group, value): the value at a place is the one whose
    running count reaches it. No task holds a group or sorts one, whatever its share of the rows.
    """
    counted = rows.select(by, value.cast("double").alias("_value")).dropna(subset=["_value"]).groupBy(by, "_value").agg(F.count("*").alias("_n")).withColumn("_upto", F.col("_n"))
    summed = stored(running_sums(counted, [by, "_value"], ["_upto"]), "counts")
    groups = summed.groupBy(F.col(by).alias("_by")).agg(F.min(F.col("_upto") - F.col("_n")).alias("_first"), F.sum("_n").alias("_all"))
    places = groups.select("_by", "_first", F.explode(F.array(F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1)).alias("_place"))
    here = summed[by].eqNullSafe(places["_by"]) & (F.col("_place") <= F.col("_upto") - F.col("_first")) & (F.col("_place") > F.col("_upto") - F.col("_n") - F.col("_first"))
    return summed.join(places, here).groupBy(by).agg((F.sum("_value") / 2.0).alias(name))
