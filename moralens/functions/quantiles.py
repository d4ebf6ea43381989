"""Exact quantiles with linear interpolation, without gathering a column in one task.

Every quantile is a pair of ranks. A sketch proposes a bracket of values around them; one scan counts the
rows below and the frequencies inside, so each bracket is verified: one that misses its ranks is widened
to the column's ends. Then rounds of counts narrow the brackets: cut points are taken from the values
inside, rows are counted between them, and the interval that holds the ranks is the next bracket. Once
at most ``ROWS_AT_ONCE`` different values are left, a window over them reads off the result. The sketch and the
cut points only say where to look; they never decide the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moralens.operators.columns import long_values, small_table
from moralens.staging import release, stage

ACCURACY = 10_000
#: Different values of one quantile's bracket that a task may sort.
ROWS_AT_ONCE = 100_000
CUTS = 256
KEYS = ["g", "column", "prob"]
PLACE = "g {group}, k string, p double, size bigint, lo double, hi double"


def sketch_brackets(values: DataFrame, probs: list[float]) -> list[tuple]:
    """(group, column, prob, n, lo, hi, least, greatest): where the quantile probably lies, and where it must."""
    margin = 3.0 / ACCURACY
    shares = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    summary = values.groupBy("grp", "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.percentile_approx("value", F.lit(shares), ACCURACY).alias("near"),
    )
    return [
        (s["grp"], s["column"], float(p), s["n"], s["near"][i], s["near"][i + len(probs)], s["lo"], s["hi"])
        for s in summary.collect()
        for i, p in enumerate(probs)
    ]


def ranks(prob: float, n: int) -> tuple[int, int]:
    """The 0-based ranks that a quantile lies between."""
    place = prob * (n - 1)
    return math.floor(place), math.ceil(place)


def _counted(values: DataFrame, brackets: list[tuple], group: str) -> DataFrame:
    """Staged ``g, column, prob, value, n``: frequencies inside each bracket, and one row with a NULL value for all below."""
    places = small_table(values.sparkSession, [b[:6] for b in brackets], PLACE.format(group=group))
    met = values.join(places, (F.col("grp") == F.col("g")) & (F.col("column") == F.col("k")) & (F.col("value") <= F.col("hi")))
    inside = F.when(F.col("value") >= F.col("lo"), F.col("value"))
    return stage(met.groupBy("g", "column", F.col("p").alias("prob"), inside.alias("value")).agg(F.count(F.lit(1)).alias("n")), "quantile-values")


def _totals(counted: DataFrame) -> dict[tuple, tuple[int, int, int]]:
    """Per target: rows below the bracket, rows and different values inside it."""
    value = F.col("value")
    found = counted.groupBy(*KEYS).agg(
        F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(value.isNotNull(), F.col("n"))), F.lit(0)).alias("inside"),
        F.count(value).alias("different"),
    )
    return {tuple(r[k] for k in KEYS): (r["below"], r["inside"], r["different"]) for r in found.collect()}


def _narrowed(counted: DataFrame, large: dict[tuple, tuple[int, int, int]], sizes: dict[tuple, int], cuts: int) -> DataFrame:
    """The frequencies with the brackets of ``large`` (below, inside, different) cut down to the interval of their ranks.

    Cut points are values inside, the last one always among them, so the intervals partition the bracket. Ranks
    of one interval leave the others behind; ranks of two neighbouring intervals are the values beside the cut.
    """
    value = F.col("value")
    shares = [(k + 1) / cuts for k in range(cuts)]
    group = dict(counted.dtypes)["g"]
    wanted = small_table(counted.sparkSession, list(large), f"g {group}, column string, prob double")
    rows = counted.where(value.isNotNull()).join(wanted, KEYS)
    points = rows.groupBy(*KEYS).agg(F.array_sort(F.array_distinct(F.concat(F.percentile_approx("value", F.lit(shares), ACCURACY), F.array(F.max("value"))))).alias("cuts"))
    # at most columns x probabilities x classes rows of ``cuts`` numbers
    points = F.broadcast(points)
    interval = F.size(F.filter("cuts", lambda c: c < value))
    counts = rows.join(points, KEYS).groupBy(*KEYS, interval.alias("i")).agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    per_target: dict[tuple, list] = {}
    for r in counts.collect():
        per_target.setdefault(tuple(r[k] for k in KEYS), []).append((r["i"], r["n"], r["lo"], r["hi"]))
    kept = []
    for key, intervals in per_target.items():
        low, high = ranks(key[2], sizes[key])
        upto = large[key][0]
        lo = hi = None
        for _, n, first, last in sorted(intervals):
            if upto <= low < upto + n:
                # the upper rank may open the next interval: then the two values are known
                lo = first if high < upto + n else last
            if upto <= high < upto + n:
                hi = last if low >= upto else first
            upto += n
        kept.append((*key, lo, hi))
    bounds = small_table(counted.sparkSession, kept, f"g {group}, column string, prob double, lo double, hi double")
    met = counted.join(bounds, KEYS, "left")
    # what lies below joins the row without a value; what lies beyond is of no use any more
    below = value.isNull() | (value < F.col("lo"))
    cut = met.where(F.col("hi").isNull() | value.isNull() | (value <= F.col("hi")))
    moved = cut.select(*KEYS, F.when(~F.coalesce(below, F.lit(False)), value).alias("value"), "n")
    return stage(moved.groupBy(*KEYS, "value").agg(F.sum("n").alias("n")), "quantile-values")


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    by: str | None = None,
    rows_at_once: int | None = None,
    cuts: int = CUTS,
) -> DataFrame:
    """``[by], column, prob, quantile`` for every non-empty column (and class of ``by``)."""
    limit = ROWS_AT_ONCE if rows_at_once is None else rows_at_once
    spark = df.sparkSession
    source = df.where(F.col(by).isNotNull()) if by else df
    group = dict(df.dtypes)[by] if by else "int"
    values = long_values(
        source.withColumn("grp", F.col(by) if by else F.lit(0)), columns, ["grp"], "double"
    ).where(F.col("value").isNotNull())
    brackets = sketch_brackets(values, probs)
    sizes = {(b[0], b[1], b[2]): b[3] for b in brackets}
    counted = _counted(values, brackets, group)
    totals = _totals(counted)
    missed = []
    for b in brackets:
        below, inside, _ = totals.get(b[:3], (0, 0, 0))
        low, high = ranks(b[2], b[3])
        if below > low or below + inside <= high:
            missed.append((*b[:4], *b[6:]))
    if missed:
        wanted = small_table(spark, [m[:3] for m in missed], f"g {group}, column string, prob double")
        held = counted.join(wanted, KEYS, "left_anti")
        joined = stage(held.unionByName(_counted(values, missed, group)), "quantile-values")
        release(counted)
        counted, totals = joined, _totals(joined)
    while large := {k: t for k, t in totals.items() if t[2] > limit}:
        narrowed = _narrowed(counted, large, sizes, max(cuts, 2))
        release(counted)
        before, counted, totals = totals, narrowed, _totals(narrowed)
        if any(totals[k][2] >= before[k][2] for k in large):
            raise RuntimeError("the brackets of the quantiles do not get smaller")
    if not sizes:
        return spark.createDataFrame([], f"{f'{by} {group}, ' if by else ''}column string, prob double, quantile double")
    upward = Window.partitionBy(*KEYS).orderBy(F.asc_nulls_first("value"))
    running = counted.withColumn("upto", F.sum("n").over(upward))
    sized = small_table(spark, [(*k, n) for k, n in sizes.items()], f"g {group}, column string, prob double, size bigint")
    place = F.col("prob") * (F.col("size") - 1)
    first_beyond = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    ends = running.join(sized, KEYS).groupBy(*KEYS, "size").agg(
        first_beyond(F.floor(place)).alias("low"), first_beyond(F.ceil(place)).alias("high")
    )
    return ends.select(
        *([F.col("g").alias(by)] if by else []),
        "column",
        "prob",
        # infinite ends have no distance, equal ends need none
        F.when(F.col("low") == F.col("high"), F.col("low"))
        .otherwise(F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place)))
        .alias("quantile"),
    )


def quantile_values(
    df: DataFrame, columns: list[str], probs: list[float], by: str | None = None
) -> dict[tuple, float]:
    """The same as a dictionary keyed by (column, prob) or (class, column, prob); one scalar each."""
    found = {}
    for row in exact_quantiles(df, columns, probs, by).collect():
        key = (row["column"], row["prob"])
        found[(row[by], *key) if by else key] = row["quantile"]
    return found


def is_finite(value: float | None) -> bool:
    return value is not None and math.isfinite(value)
