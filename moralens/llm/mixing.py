"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1. Its integral, scaled to the source's
target, is the demand for the source's words up to a time; inverting the demand at a word count
gives the time at which that word is due. Documents of a source queue in a repeatable random order,
so the words ahead of a document give its training position. The result is range-sorted by position.

Running sums cross a hot source without one task holding it: (source, bucket) totals give offsets,
windows run inside a bucket, and bucket numbers grow with the square root of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moralens.functions.hashing import HASH_SPAN, digest, hash_number
from moralens.functions.ranking import bucketed_prefix
from moralens.llm.text import free_name
from moralens.staging import row_count, stage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)  # repeating over the sources in code point order
SHARE = 1.5  # of all words
MAX_REPEATS = 2
#: (time, weight) knots per weight; between knots the weight is linear, its scale does not matter.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 1.5)),
    ((0.0, 1.5), (0.5, 0.5), (1.0, 0.5)),
)
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """Per source: its number in code point order (NULL last), weight, words and target words.

    The target of a source is its weight's part of ``share`` times all words. Targets stop at
    ``max_repeats`` times the source's words; what is over goes to the others by weight. Sources by
    cap per weight fill up in that order, so the water level after each is a running sum.
    """
    everything = Window.partitionBy()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = totals.withColumn("_nr", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    filling = Window.orderBy("_ratio", "_nr")
    return (
        numbered.withColumn("_weight", F.element_at(cycle, F.pmod(F.col("_nr") - 1, F.lit(len(weights))) + 1))
        .withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("_full")) / F.col("_open"))
        .withColumn("_capped", F.col("_ratio") <= F.col("_level"))
        .withColumn("_water", F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything))
        .withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_water")))
        .select("source", "_nr", "_weight", "source_size", "target")
    )


def due_time(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` (0..1) of the schedule's integral has passed."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    whole = sum(areas)
    if whole <= 0 or any(w < 0 for _, w in schedule):
        raise ValueError("a schedule needs weights of zero or more and a positive integral")
    area = share * F.lit(whole)
    out = None
    before = 0.0
    for part, ((t0, w0), (t1, w1)) in zip(areas, zip(schedule, schedule[1:], strict=False), strict=True):
        if part <= 0:
            continue
        inside = F.greatest(area - F.lit(before), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # the root of w0 x + slope x^2 / 2 = inside, in the form without cancellation
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * inside, F.lit(0.0)))
        time = F.least(F.lit(t0) + F.when(root > 0, F.lit(2.0) * inside / root).otherwise(F.lit(0.0)), F.lit(t1))
        before += part
        out = F.when(area <= F.lit(before), time) if out is None else out.when(area <= F.lit(before), time)
        last = time
    return out.otherwise(last)


def mixture(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: size, source_size, target, taken and its training positions.

    A document is taken as often as its source's target reaches past its middle: between 0 and
    ``max_repeats`` times, whole, so a source's taken words differ from its target by at most half
    a document. ``positions`` lists the times of its draws (empty if none). NULL text has no words,
    NULL sources are one source that sorts last, rows without an id queue by their text; repeated rows are
    drawn each on their own. Reruns give the same rows. Sorted by first position, undrawn documents last.
    """
    return _queued(documents, weights, share, max_repeats, schedules, seed).drop("_print")


def _print(documents: DataFrame) -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def _queued(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: str = SEED,
) -> DataFrame:
    """``mixture`` with a digest of the text, which tells rows of one id apart."""
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), _print(documents).alias("_print"))
    sized = stage(sized, "sizes")
    targets = stage(source_targets(sized, weights, share, max_repeats), "targets")
    n_buckets = max(1, math.ceil(math.sqrt(row_count(sized))))
    # rows without an id queue by their text, else they would all be in one bucket
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("_print"))
    known = sized.withColumnRenamed("source", "_source").join(targets, F.col("_source").eqNullSafe(F.col("source")))
    queued = known.select(
        "doc_id",
        F.col("_source").alias("source"),
        "size",
        "source_size",
        "target",
        "_nr",
        "_print",
        digest(seed, key).alias("_order"),
        F.floor(hash_number(seed, key).cast("double") / F.lit(HASH_SPAN) * n_buckets).alias("_bucket"),
    )
    # in full order, so that equal ids always queue alike; rows alike in all of these are interchangeable
    order = F.struct("_order", "size", "_print", F.monotonically_increasing_id())
    queued = stage(queued.withColumn("_at", order), "queue")
    summed = bucketed_prefix(queued, ["_nr"], "_bucket", "_at", ["size"])
    ahead = F.col("cum_size") - F.col("size")
    middle = ahead + F.col("size") / 2
    draws = [F.lit(k) * F.col("source_size") + middle <= F.col("target") for k in range(max_repeats)]
    timed = []
    for k, drawn in enumerate(draws):
        reached = (F.lit(k) * F.col("source_size") + ahead) / F.col("target")
        time = None
        for i, schedule in enumerate(schedules):
            mine = F.pmod(F.col("_nr") - 1, F.lit(len(schedules))) == i
            time = F.when(mine, due_time(reached, schedule)) if time is None else time.when(mine, due_time(reached, schedule))
        timed.append(F.when(drawn & (F.col("size") > 0), time))
    positions = F.filter(F.array(*timed), lambda x: x.isNotNull())
    return (
        summed.withColumn("positions", positions)
        .withColumn("taken", F.col("size") * F.size("positions"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "positions", "_print")
        .orderBy(F.asc_nulls_last(F.try_element_at("positions", F.lit(1))), "doc_id")
    )


def training_order(documents: DataFrame, **settings) -> DataFrame:
    """The documents as training reads them: one row per draw, range-sorted by position.

    Adds ``position`` (0..1) to the documents' columns (``mix_position`` if they have one already).
    Rows that share a doc_id are told apart by their texts, then by source; rows alike in all three are
    interchangeable, so reruns give the same rows.
    """
    name = "position"
    while name.lower() in {c.lower() for c in documents.columns}:
        name = f"mix_{name}"
    row, text, nth, at, source = (free_name(f"_mix_{n}", documents) for n in ("id", "print", "nth", "at", "source"))
    number = Window.partitionBy(row, text).orderBy(source)
    placed = _queued(documents, **settings).select(
        F.col("doc_id").cast("string").alias(row), F.col("_print").alias(text), F.col("source").alias(source), F.col("positions").alias(at)
    )
    placed = placed.withColumn(nth, F.row_number().over(number)).where(F.size(at) > 0).drop(source)
    tagged = documents.withColumn(row, F.col("doc_id").cast("string")).withColumn(text, _print(documents)).withColumn(source, F.col("source"))
    tagged = tagged.withColumn(nth, F.row_number().over(number)).drop(source)
    left, right = tagged.alias("l"), placed.alias("r")
    same = F.col(f"l.{text}").eqNullSafe(F.col(f"r.{text}")) & F.col(f"l.{row}").eqNullSafe(F.col(f"r.{row}")) & (F.col(f"l.{nth}") == F.col(f"r.{nth}"))
    own = [F.col(f"l.`{c}`") for c in documents.columns]
    drawn = left.join(right, same).select(*own, F.explode(F.col(f"r.{at}")).alias(name))
    return drawn.orderBy(name, "doc_id")
