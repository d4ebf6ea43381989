"""Correlation matrices over pairwise-complete rows, as tall lower triangles ``var_1, var_2, r``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moralens.functions.joins import lookup
from moralens.functions.ranking import ROWS_PER_BUCKET, bucketed_prefix, prefix_counts
from moralens.operators.columns import long_values, quoted, small_table
from moralens.staging import stage

#: Different values of a column that may go by broadcast.
BROADCAST_VALUES = 50_000
#: Cells of a pair of columns, about, that are put in order at once.
CELLS_AT_ONCE = 250_000
MOMENTS = ["pair", "n", "mean_x", "mean_y", "xx", "yy", "xy"]
ORDERS = "pair int, bucket bigint, y bigint, n bigint, concordant double, discordant double, ties_x double"


def column_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[:i]]


def correlation_matrix(
    df: DataFrame, columns: list[str], method: str = "pearson", row_id: str = "row_id"
) -> DataFrame:
    """Pearson, Spearman or Kendall (tau-b) correlation of every pair of columns."""
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    if method == "pearson":
        return pearson(df, columns)
    if method == "spearman":
        return spearman(df, columns, row_id)
    if method == "kendall":
        return kendall(df, columns, row_id)
    raise ValueError(f"unknown correlation method '{method}': use 'pearson', 'spearman' or 'kendall'")


def merged_moments(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Rows, means and summed products about the means of two sets of rows taken together, for each pair of columns."""
    share = other[0] / np.maximum(one[0] + other[0], 1)
    apart = [np.where((one[0] > 0) & (other[0] > 0), other[k] - one[k], 0.0) for k in (1, 2)]
    means = [np.where(one[0] > 0, one[k] + d * share, other[k]) for k, d in zip((1, 2), apart, strict=True)]
    products = [(apart[i] * apart[j]) * one[0] * share for i, j in ((0, 0), (1, 1), (0, 1))]
    return np.array([one[0] + other[0], *means, *(one[k] + other[k] + p for k, p in zip((3, 4, 5), products, strict=True))])


def _pair_correlations(df: DataFrame, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """Tall correlations of (label, label, column, column); the columns are doubles.

    One scan: a task sums up each pair over its complete rows, centred, and sends one row per pair. Fanned out,
    each row would be copied for every pair.
    """
    names = list(dict.fromkeys(c for _, _, *both in pairs for c in both))
    place = {c: k for k, c in enumerate(names)}
    sides = [(place[x], place[y]) for _, _, x, y in pairs]

    def centred(values: np.ndarray) -> tuple[float, np.ndarray]:
        # apart from one of them, so that values all alike have no spread at all
        away = values - values[0]
        mean = away.mean()
        return values[0] + mean, away - mean

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        there = [c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]
        values = [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns]
        full = [t.all() for t in there]
        whole = [centred(v) if f else None for v, f in zip(values, full, strict=True)]
        out = np.zeros((6, len(sides)))
        for k, (i, j) in enumerate(sides):
            if full[i] and full[j]:
                (mean_x, x), (mean_y, y) = whole[i], whole[j]
            else:
                both = there[i] & there[j]
                if not both.any():
                    continue
                (mean_x, x), (mean_y, y) = centred(values[i][both]), centred(values[j][both])
            out[:, k] = len(x), mean_x, mean_y, x @ x, y @ y, x @ y
        return out

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(sides)))
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                if batch.num_rows:
                    total = merged_moments(total, moments(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sides), dtype=np.int32)), *map(pa.array, total)], names=MOMENTS)

    def merged(parts: pa.Table) -> pa.Table:
        total = np.zeros((6, 1))
        with np.errstate(invalid="ignore", over="ignore"):
            for row in np.array([parts.column(c).to_numpy() for c in MOMENTS[1:]]).T:
                total = merged_moments(total, row[:, None])
        return pa.table([parts.column("pair")[:1], *map(pa.array, total)], names=MOMENTS)

    schema = ", ".join(["pair int", *(f"{c} double" for c in MOMENTS[1:])])
    sums = df.select(*names).mapInArrow(summed, schema).groupBy("pair").applyInArrow(merged, schema)
    spread = F.sqrt(F.col("xx") / F.col("n")) * F.sqrt(F.col("yy") / F.col("n"))
    found = sums.where("n > 0").select("pair", F.when(spread > 0, F.col("xy") / F.col("n") / spread).alias("r"))
    labels = small_table(
        df.sparkSession, [(i, a, b) for i, (a, b, _, _) in enumerate(pairs)], "pair int, var_1 string, var_2 string"
    )
    return labels.join(found, "pair", "left").select("var_1", "var_2", "r")


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs in one scan."""
    number = {c: f"c{i}" for i, c in enumerate(columns)}
    numbers = df.select(*[F.col(quoted(c)).cast("double").alias(number[c]) for c in columns])
    return _pair_correlations(numbers, [(a, b, number[a], number[b]) for a, b in column_pairs(columns)])


def _nullable(df: DataFrame, columns: list[str]) -> set[str]:
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return {c for c in columns if gaps[c] > 0}


def _met(df: DataFrame, columns: list[str], row_id: str, dictionary: DataFrame, found: list[str]) -> DataFrame:
    """One row per ``row_id`` with ``<name>_<i>`` for each name in ``found``: what the dictionary says of the i-th column.

    ``dictionary`` has ``column, value, n`` and the numbers ``found``, none of which may fall as the value grows:
    rows that share an id count as one with their greatest values. Columns of few values are grouped as they are and
    meet the dictionary by broadcast afterwards; only cells of columns with many values are shuffled by value.
    """
    sizes = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}
    few = [i for i, c in enumerate(columns) if sizes.get(c, 0) <= BROADCAST_VALUES]
    many = [i for i in range(len(columns)) if i not in few]
    kinds = dict(dictionary.dtypes)
    nothing = [F.lit(None).cast(kinds[name]).alias(f"{name}_{i}") for i in many for name in found]
    rows = df.select(row_id, *[F.col(quoted(columns[i])).cast("double").alias(f"_v_{i}") for i in few], *nothing)
    if many:
        names = [columns[i] for i in many]
        cells = long_values(df, names, [row_id], "double").where(F.col("value").isNotNull())
        met = lookup(cells, dictionary.where(F.col("column").isin(names)), ["column", "value"], "n")
        own = [F.when(F.col("column") == columns[i], F.col(name)).alias(f"{name}_{i}") for i in many for name in found]
        rows = rows.unionByName(met.select(row_id, *[F.lit(None).cast("double").alias(f"_v_{i}") for i in few], *own))
    wide = rows.groupBy(row_id).agg(*[F.max(c).alias(c) for c in rows.columns if c != row_id])
    small = stage(dictionary.where(F.col("column").isin([columns[i] for i in few])), "small-values") if few else None
    for i in few:
        numbers = [F.col(name).alias(f"{name}_{i}") for name in found]
        part = small.where(F.col("column") == columns[i]).select(F.col("value").alias(f"_v_{i}"), *numbers)
        wide = wide.join(F.broadcast(part), f"_v_{i}", "left")
    return wide


def spearman(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Pearson correlation of average ranks over the pair-complete rows.

    A column's ranks differ from partner to partner only by which partners with gaps are there. So each
    value is counted once, together with how many of its rows have each such partner, and one running sum per
    partner gives the value's ranks among all partners at once, which rows meet by their values.
    """
    gaps = sorted(_nullable(df, columns))
    place = {b: i + 1 for i, b in enumerate(gaps)}
    names = [f"n_{i}" for i in range(len(gaps) + 1)]
    there = [F.lit(1), *[F.col(quoted(b)).isNotNull().cast("int") for b in gaps]]
    shown = df.select(*[F.col(quoted(c)) for c in columns], *[t.alias(f"_{n}") for t, n in zip(there, names, strict=True)])
    values = long_values(shown, columns, [f"_{n}" for n in names], "double").where(F.col("value").isNotNull())
    counts = values.groupBy("column", "value").agg(*[F.sum(f"_{n}").alias(n) for n in names])
    ranked = prefix_counts(counts, ["column"], "value", names)
    rank = lambda n: F.col(f"cum_{n}") - F.col(n) + (F.col(n) + 1) / 2
    found = [f"rank_{i}" for i in range(len(names))]
    ranks = [rank(n).alias(r) for n, r in zip(names, found, strict=True)]
    ranks = stage(ranked.select("column", "value", F.col("n_0").alias("n"), *ranks), "ranks")
    wide = _met(df, columns, row_id, ranks, found)
    number = {c: i for i, c in enumerate(columns)}
    of = lambda a, b: f"rank_{place.get(b, 0)}_{number[a]}"
    # a rank counts the rows with the partner; a row without it drops out of the pair
    return _pair_correlations(wide, [(a, b, of(a, b), of(b, a)) for a, b in column_pairs(columns)])


def dense_codes(values: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, n, code``: 0-based position of each distinct value inside its key."""
    counts = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    return prefix_counts(counts, [key], value, ["one"]).select(key, value, "n", (F.col("cum_one") - 1).alias("code"))


def ordered_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Concordant and discordant pairs of rows, and those tied in x, of cells (x, y) that hold n rows each.

    Two codes of y differ first at exactly one binary digit, so pairs are counted digit by digit: inside the cells
    that share the higher digits, running counts along x say how many rows before have the other digit.
    """
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    levels, code = np.unique(y[order], return_inverse=True)
    if len(levels) <= 1 << 16:
        code = code.astype(np.uint16)  # sorts in linear time
    rows = np.add.reduceat(n, np.flatnonzero(np.append(True, x[1:] != x[:-1]))).astype(float)
    concordant = discordant = 0.0
    for digit in range(max(1, (len(levels) - 1).bit_length())):
        prefix = code >> (digit + 1)
        by_prefix = np.argsort(prefix, kind="stable")  # x stays in order
        prefix, along, own = prefix[by_prefix], x[by_prefix], n[by_prefix]
        ones = np.where((code[by_prefix] >> digit) & 1, own, 0)
        zeros = own - ones
        first = np.append(True, prefix[1:] != prefix[:-1])
        fresh = first | np.append(True, along[1:] != along[:-1])
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        before = lambda w: (lambda upto: (upto[run] - upto[start]).astype(float))(np.cumsum(w) - w)
        concordant += float((ones * before(zeros)).sum())
        discordant += float((zeros * before(ones)).sum())
    return concordant, discordant, float((rows * (rows - 1) / 2).sum())


def _bucket_orders(cells: pa.Table) -> pa.Table:
    """The frequencies of y in one bucket of one pair; the bucket's own orders stand in its first row."""
    x, y, n = (cells.column(c).to_numpy() for c in ("x", "y", "n"))
    levels, code = np.unique(y, return_inverse=True)
    found = np.zeros((3, len(levels)))
    found[:, 0] = ordered_pairs(x, y, n)
    counts = np.zeros(len(levels), dtype=np.int64)
    np.add.at(counts, code, n)
    size = len(levels)
    pair, bucket = (cells.column(c)[0].as_py() for c in ("pair", "bucket"))
    columns = [pa.array(np.full(size, pair, np.int32)), pa.array(np.full(size, bucket, np.int64)), pa.array(levels), pa.array(counts)]
    return pa.table([*columns, *map(pa.array, found)], names=["pair", "bucket", "y", "n", "concordant", "discordant", "ties_x"])


def _orders_across(cells: DataFrame, codes_per_bucket: int) -> DataFrame:
    """``pair, concordant_across, discordant_across`` of cells ``pair, digits, x, y, n``: the same count by windows."""
    by_digit = cells.select(
        "pair", "x", "y", "n", F.explode(F.sequence(F.lit(0), F.col("digits") - 1)).alias("digit")
    ).withColumn("bit", F.expr("shiftright(y, digit) & 1"))
    steps = by_digit.groupBy("pair", "digit", F.expr("shiftright(y, digit + 1)").alias("prefix"), "x").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"),
    )
    bucketed = stage(steps.withColumn("bucket", F.floor(F.col("x") / codes_per_bucket)), "steps")
    running = bucketed_prefix(bucketed, ["pair", "digit", "prefix"], "bucket", "x", ["zeros", "ones"])
    real = lambda c: F.col(c).cast("double")
    return running.groupBy("pair").agg(
        F.sum(real("ones") * (real("cum_zeros") - real("zeros"))).alias("concordant_across"),
        F.sum(real("zeros") * (real("cum_ones") - real("ones"))).alias("discordant_across"),
    )


def kendall(
    df: DataFrame, columns: list[str], row_id: str, codes_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Exact tau-b in O(cells x log(distinct)) work, never comparing rows pairwise.

    Values become dense integer codes. Cells (x, y) of a pair of columns are cut into buckets along x. Inside a
    bucket one task puts them in order; pairs of rows from different buckets are ordered by the frequencies of
    the buckets' y alone, with the bucket in place of x. Both count digit by digit, see ``ordered_pairs``.
    """
    long = long_values(df, columns, [row_id], "double").where(F.col("value").isNotNull())
    codes = stage(dense_codes(long, "column", "value"), "codes")
    sized = codes.groupBy("column").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).collect()
    distinct, present = ({r["column"]: r[name] for r in sized} for name in ("size", "n"))
    coded = _met(df, columns, row_id, codes, ["code"])
    number = {c: i for i, c in enumerate(columns)}
    pairs = []
    several = []
    for i, (a, b) in enumerate(column_pairs(columns)):
        x, y = (a, b) if distinct.get(a, 0) >= distinct.get(b, 0) else (b, a)
        n_x, n_y = max(1, distinct.get(x, 0)), max(1, distinct.get(y, 0))
        most = max(1, min(present.get(x, 0), present.get(y, 0), n_x * n_y))
        width = max(1, min(codes_per_bucket, CELLS_AT_ONCE * n_x // most))
        pairs.append((i, a, b, x, y, width))
        if width < n_x:
            several.append((i, max(1, (n_y - 1).bit_length())))
    code = lambda c: F.col(f"code_{number[c]}")
    row_pairs = F.array(
        *[
            F.when(
                code(x).isNotNull() & code(y).isNotNull(),
                F.struct(F.lit(i).alias("pair"), F.lit(w).cast("bigint").alias("width"), code(x).alias("x"), code(y).alias("y")),
            )
            for i, _, _, x, y, w in pairs
        ]
    )
    complete = coded.select(F.explode(row_pairs).alias("p")).where(F.col("p").isNotNull())
    cells = complete.groupBy("p.pair", "p.width", "p.x", "p.y").agg(F.count(F.lit(1)).alias("n"))
    bucketed = cells.select("pair", F.expr("x div width").alias("bucket"), "x", "y", "n")
    inside = stage(bucketed.groupBy("pair", "bucket").applyInArrow(_bucket_orders, ORDERS), "orders")
    sums = ["concordant", "discordant"]
    order = inside.groupBy("pair").agg(*[F.sum(c).alias(c) for c in (*sums, "ties_x")], F.sum("n").alias("size"))
    if several:
        digits = small_table(df.sparkSession, several, "pair int, digits int")
        between = inside.join(digits, "pair").select("pair", "digits", F.col("bucket").alias("x"), "y", "n")
        across = _orders_across(between, codes_per_bucket)
        added = order.join(across, "pair", "left")
        order = added.select("pair", *[(F.col(c) + F.coalesce(f"{c}_across", F.lit(0.0))).alias(c) for c in sums], "ties_x", "size")
    real = lambda c: F.col(c).cast("double")
    per_value = inside.groupBy("pair", "y").agg(F.sum("n").alias("t"))
    ties_y = per_value.groupBy("pair").agg(F.sum(real("t") * (real("t") - 1) / 2).alias("ties_y"))
    labels = small_table(df.sparkSession, [(i, a, b) for i, a, b, *_ in pairs], "pair int, var_1 string, var_2 string")
    joined = labels.join(order, "pair", "left").join(ties_y, "pair", "left")
    all_pairs = real("size") * (real("size") - 1) / 2
    free = (all_pairs - F.col("ties_x")) * (all_pairs - F.col("ties_y"))
    return joined.select(
        "var_1",
        "var_2",
        F.when(free > 0, (F.col("concordant") - F.col("discordant")) / F.sqrt(free)).alias("r"),
    )
