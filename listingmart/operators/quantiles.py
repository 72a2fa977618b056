"""Exact quantiles, of a table or of its groups, without a reducer that holds every distinct value.

A first pass counts the values of each step, OCTAVE to a doubling of the absolute value, which names the steps that hold
the wanted ranks. A second pass takes those steps' distinct values alone; they are cut again into BINS equal parts from a
step's least to its greatest value, and a running sum in each part finds the order statistics. So no task holds a large
part of a hot group, unless its values crowd together on both scales. A row gives one place a column in each pass,
whatever the number of quantiles. The input is read twice: give a table, not a costly plan.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OCTAVE, BINS = 1024, 1024


def _step(x: Column) -> Column:
    """Grows with the value: negative below zero, 0 at zero, the greatest step for infinity and then NaN."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1025.0)) * OCTAVE).cast("int") + 1100 * OCTAVE  # log2 is -1074 at least
    return F.when(F.isnan(x), 2200 * OCTAVE).when(x == 0, 0).when(x < 0, -size).otherwise(size)


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """The columns of `by`, one row a group (one row in all without them), and for each wanted column an array of its
    interpolated quantiles; null values are left out, a group without values has nulls. Null keys are a group."""
    wants = [(c, p) for c, ps in wanted.items() for p in ps]
    keys = [f"_b{k}" for k in range(len(by))]
    rows = df.select(
        *(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), *(F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(wanted))
    )
    number = {c: k for k, c in enumerate(wanted)}
    groups = rows.select(*keys).distinct() if by else None
    each = [F.struct(F.lit(k).alias("_c"), F.col(f"_v{k}").alias("_x")) for k in number.values()]
    told = rows.select(*keys, F.explode(F.array(*each)).alias("s")).select(*keys, "s.*").filter("_x is not null")
    told = told.select(*keys, "_c", _step(F.col("_x")).alias("_step"), "_x")
    column = Window.partitionBy(*keys, "_c")
    counts = told.groupBy(*keys, "_c", "_step").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_upto": F.sum("_n").over(column.orderBy("_step")), "_all": F.sum("_n").over(column)})

    def rank(p: float) -> Column:
        """From 0."""
        return F.lit(float(p)) * (F.col("_all") - 1)

    # the steps that hold the two order statistics of a quantile
    hits = [
        (F.col("_c") == number[c]) & (F.col("_upto") > F.floor(rank(p))) & (F.col("_upto") - F.col("_n") <= F.ceil(rank(p))) for c, p in wants
    ]
    steps = counts.filter(functools.reduce(Column.__or__, hits, F.lit(False))).select(
        *(F.col(k).alias(f"{k}_") for k in keys), F.col("_c").alias("_c_"), F.col("_step").alias("_step_"),
        (F.col("_upto") - F.col("_n")).alias("_before"), "_all"
    )
    def same(*names: str) -> list[Column]:
        return [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in (*keys, *names)]

    near = same("_c", "_step")
    inside = told.join(F.broadcast(steps) if not by else steps, near).groupBy(*keys, "_c", "_step", "_before", "_all", "_x").agg(
        F.count(F.lit(1)).alias("_n")
    )
    other = lambda df, *names: df.withColumnsRenamed({k: f"{k}_" for k in (*keys, *names)})
    span = other(inside.groupBy(*keys, "_c", "_step").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high")), "_c", "_step")
    part = F.coalesce(F.try_divide(F.col("_x") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    part = F.least(F.floor(part * BINS), F.lit(BINS - 1)).cast("int")
    cut = inside.join(span, near).select(*keys, "_c", "_step", "_before", "_all", "_x", "_n", part.alias("_part"))
    parts = cut.groupBy(*keys, "_c", "_step", "_part").agg(F.sum("_n").alias("_m"))  # BINS a step at most
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_c", "_step").orderBy("_part")) - F.col("_m")
    parts = other(parts.withColumn("_less", upto), "_c", "_step", "_part")
    order = Window.partitionBy(*keys, "_c", "_step", "_part").orderBy("_x")
    ranked = cut.join(parts, same("_c", "_step", "_part")).select(
        *keys, "_c", "_all", "_x", (F.col("_before") + F.col("_less") + F.sum("_n").over(order)).alias("_upto")
    )
    cells = []
    for k, (c, p) in enumerate(wants):
        at = lambda f, c=c, p=p: F.min(F.when((F.col("_c") == number[c]) & (F.col("_upto") > f(rank(p))), F.col("_x")))
        cells += [at(F.floor).alias(f"_l{k}"), at(F.ceil).alias(f"_h{k}"), F.max(F.when(F.col("_c") == number[c], rank(p))).alias(f"_r{k}")]
    out = ranked.groupBy(*keys).agg(*cells) if by else ranked.agg(*cells)

    def quantile(k: int) -> Column:
        low, high, part = F.col(f"_l{k}"), F.col(f"_h{k}"), F.col(f"_r{k}") - F.floor(f"_r{k}")
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(f"_q{k}")

    out = out.select(*keys, *map(quantile, range(len(wants))))
    if by:  # groups without any value
        named = out.withColumnsRenamed({k: f"{k}_" for k in keys})
        out = groups.join(named, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left")
    at = {c: [k for k, (name, _) in enumerate(wants) if name == c] for c in wanted}
    arrays = [F.array(*(F.col(f"_q{k}") for k in ks)).alias(c) for c, ks in at.items()]
    return out.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), *arrays)


def exact_medians(df: DataFrame, by: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """The columns of `by` and the medians of the named columns, by their new names."""
    found = exact_quantiles(df, {c: (0.5,) for c in names}, by)
    return found.select(*by, *(F.get(c, F.lit(0)).alias(out) for c, out in names.items()))
