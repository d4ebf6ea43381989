"""Univariate distributions, crosstabs against the target and monthly series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moralens.functions.quantiles import is_finite, quantile_values
from moralens.operators.columns import (
    binary_columns,
    classes_of,
    classify,
    frequencies,
    long_values,
    numeric_summary,
    quoted,
    require_columns,
    small_table,
)
from moralens.operators.quality import top_values

# Month names in calendar order.
MONTH_NAMES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]

#: Up to so many bins a column's empty ones are listed too.
DENSE_BINS = 1 << 16
#: A double tells no more places of a range apart.
MAX_BINS = 1 << 53
DENSITY_POINTS = 200
DENSITY_CUT = 3.0
# Beyond this many bandwidths exp(-z*z/2) is exactly 0 in double precision.
KERNEL_REACH = 38.7
VALUES_AT_ONCE = 1024


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percentage of each class."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # one row per class reaches this window
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(target, "n", (F.col("n") / total * 100).alias("pct"))


def binary_counts(df: DataFrame, target: str | None = None, exempt: list[str] | None = None) -> DataFrame:
    """Value counts of the numeric columns that hold exactly two values, per class if a target is given."""
    numeric = [c for c in classify(df.schema, exempt).numeric if c != target]
    columns = binary_columns(df, numeric)
    freq = frequencies(df, columns, [target] if target else [], "double")
    return freq.where(F.col("value").isNotNull())


def category_top(df: DataFrame, exempt: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values of every categorical column."""
    columns = classify(df.schema, exempt).categorical
    return top_values(frequencies(df, columns), k).select("column", "pos", "value", "n")


def histogram_bins(
    df: DataFrame, columns: list[str], rule: int | str, quartiles: dict[tuple, float] | None = None
) -> dict[str, tuple[float, float, int]]:
    """Per column (low, high, number of bins); ``rule`` is a number, ``sturges``, ``fd`` or ``auto``.

    ``quartiles`` by (column, probability) are found here unless they are known.
    """
    summary = {r["column"]: r for r in numeric_summary(df, columns).collect()}
    if quartiles is None:
        quartiles = {} if isinstance(rule, int) or rule == "sturges" else quantile_values(df, columns, [0.25, 0.75])
    plans = {}
    for c in columns:
        low, high, n = summary[c]["min"], summary[c]["max"], summary[c]["n"]
        if not (is_finite(low) and is_finite(high)):
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        if isinstance(rule, int):
            bins = rule
        elif rule in ("sturges", "fd", "auto"):
            sturges_width = (high - low) / (math.log2(n) + 1)
            spread = 0.0 if rule == "sturges" else quartiles[c, 0.75] - quartiles[c, 0.25]
            fd_width = 2.0 * spread / n ** (1 / 3)
            if rule == "sturges" or fd_width == 0:
                width = sturges_width
            else:
                width = fd_width if rule == "fd" else min(sturges_width, fd_width)
            bins = max(1, min(MAX_BINS, math.ceil((high - low) / width)))
        else:
            raise ValueError(f"unknown bin rule '{rule}': use a number, 'sturges', 'fd' or 'auto'")
        plans[c] = (low, high, bins)
    return plans


def histogram(
    df: DataFrame, columns: list[str], rule: int | str = "auto", by: str | None = None, quartiles: dict[tuple, float] | None = None
) -> DataFrame:
    """Counts per equal-width bin; the last bin is closed on the right.

    Bins are numbers of 64 bits and their edges follow from them, so a rule may ask for any number of bins.
    A column of at most ``DENSE_BINS`` has its empty bins too, a wider one those with rows only. The counting is
    one scan with map-side combine. Columns without finite ends have no bins.
    """
    plans = histogram_bins(df, columns, rule, quartiles)
    keys = [by] if by else []
    source = df.where(F.col(by).isNotNull()) if by else df
    if not plans:
        kinds = "".join(f"{k} {dict(df.dtypes)[k]}, " for k in keys)
        return df.sparkSession.createDataFrame([], f"{kinds}column string, bin bigint, from_value double, to_value double, n bigint")

    def place(c: str) -> Column:
        low, high, bins = plans[c]
        at = F.floor((F.col(c).cast("double") - low) / (high - low) * float(bins))
        inside = F.when(F.col(c).isNotNull(), F.least(at, F.lit(bins - 1).cast("bigint")))
        return F.struct(F.lit(c).alias("column"), inside.alias("bin"))

    placed = source.select(*keys, F.explode(F.array(*[place(c) for c in plans])).alias("p")).select(*keys, "p.*")
    counts = placed.where(F.col("bin").isNotNull()).groupBy(*keys, "column", "bin").agg(F.count(F.lit(1)).alias("n"))
    edges = small_table(
        df.sparkSession, [(c, low, high, bins) for c, (low, high, bins) in plans.items()], "column string, low double, high double, bins bigint"
    )
    frame = edges.where(F.col("bins") <= DENSE_BINS).select("column", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"))
    if by:
        classes = [F.lit(c) for c in classes_of(df, by)]
        frame = frame.select("*", F.explode(F.array(*classes)).alias(by))
    # empty bins count zero; they add up with the counted ones, so no join is needed
    every = counts.unionByName(frame.select(*keys, "column", "bin", F.lit(0).cast("bigint").alias("n")))
    summed = every.groupBy(*keys, "column", "bin").agg(F.sum("n").alias("n"))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    return summed.join(edges, "column").select(
        *keys,
        "column",
        "bin",
        (F.col("low") + F.col("bin") * width).alias("from_value"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("to_value"),
        "n",
    )


def _kernel_sums(grids: list[tuple[float, float, float]]):
    """Adds up what rows (grid, value, w) bring to the points of the grids (width, low, step), a row per point and task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses = np.zeros((len(grids), DENSITY_POINTS))
        for batch in batches:
            grid, value, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grid", "value", "w"))
            order = np.lexsort((value, grid))
            grid, value, weight = grid[order], value[order], weight[order]
            for g in np.unique(grid):
                width, low, step = grids[g]
                since, upto = np.searchsorted(grid, [g, g + 1])
                for at in range(since, upto, VALUES_AT_ONCE):
                    some = value[at : min(at + VALUES_AT_ONCE, upto)]
                    # neighbours in order reach about the same points
                    first = max(0, math.ceil((some[0] - KERNEL_REACH * width - low) / step))
                    last = min(DENSITY_POINTS - 1, math.floor((some[-1] + KERNEL_REACH * width - low) / step))
                    z = (low + np.arange(first, last + 1) * step - some[:, None]) / width
                    masses[g, first : last + 1] += weight[at : at + len(some)] @ np.exp(-0.5 * z * z)
        g, p = np.nonzero(masses)
        columns = [pa.array(g.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(masses[g, p])]
        yield pa.RecordBatch.from_arrays(columns, names=["grid", "p", "mass"])

    return summed


def density(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Gaussian kernel density per column (and class of ``by``) on a grid of 200 points (Scott bandwidth).

    Rows are first reduced to one per distinct value, so a repeated value costs once. A value only reaches
    the grid points where its kernel is not exactly zero. A task adds its values up to one row per grid
    point. Columns without spread or with infinite ends have no density.
    """
    spark = df.sparkSession
    keys = [by] if by else []
    source = df.where(F.col(by).isNotNull()) if by else df
    group = F.col(by) if by else F.lit(0)
    grids = []
    for row in numeric_summary(df, columns, by).collect():
        if row["n"] < 2 or not is_finite(row["std"]) or row["std"] == 0:
            continue
        width = row["std"] * row["n"] ** -0.2
        low = row["min"] - DENSITY_CUT * width
        step = (row["max"] + DENSITY_CUT * width - low) / (DENSITY_POINTS - 1)
        grids.append((len(grids), row[by] if by else 0, row["column"], row["n"], width, low, step))
    kind = dict(df.dtypes)[by] if by else "int"
    plan = small_table(spark, grids, f"grid int, g {kind}, k string, n bigint, h double, low double, step double")
    counts = frequencies(source, columns, keys, "double").where(F.col("value").isNotNull()).withColumnRenamed("n", "w")
    placed = counts.join(plan, (group == F.col("g")) & (F.col("column") == F.col("k")))
    masses = placed.select("grid", "value", "w").mapInArrow(_kernel_sums([g[-3:] for g in grids]), "grid int, p int, mass double")
    sums = masses.groupBy("grid", "p").agg(F.sum("mass").alias("mass"))
    points = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(DENSITY_POINTS - 1))).alias("p"))
    filled = points.join(sums, ["grid", "p"], "left")
    norm = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    return filled.select(
        F.col("k").alias("column"),
        *([F.col("g").alias(by)] if by else []),
        F.col("p").alias("point"),
        (F.col("low") + F.col("p") * F.col("step")).alias("at_value"),
        (F.coalesce("mass", F.lit(0.0)) / norm).alias("density"),
    )


def crosstab(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Per (column, value): count and row percentage of each target class, over complete pairs."""
    classes = classes_of(df, target)
    pairs = df.where(F.col(target).isNotNull())
    freq = frequencies(pairs, columns, [target]).where(F.col("value").isNotNull())
    of_class = lambda c: F.sum(F.when(F.col(target) == c, F.col("n")).otherwise(0))
    table = freq.groupBy("column", "value").agg(
        *[of_class(c).alias(f"n_{c}") for c in classes], F.sum("n").alias("total")
    )
    return table.select(
        "column",
        "value",
        *[quoted(f"n_{c}") for c in classes],
        *[(F.col(quoted(f"n_{c}")) / F.col("total") * 100).alias(f"pct_{c}") for c in classes],
    )


def crosstab_binary(df: DataFrame, target: str, exempt: list[str] | None = None) -> DataFrame:
    """Row-normalised crosstab of every two-valued numeric column with the target."""
    numeric = [c for c in classify(df.schema, exempt).numeric if c != target]
    return crosstab(df, binary_columns(df, numeric), target)


def crosstab_topk(
    df: DataFrame, columns: list[str], target: str, k: int = 10
) -> DataFrame:
    """Crosstab of categorical columns limited to each column's k most frequent values."""
    top = top_values(frequencies(df, columns), k).select("column", "value")
    return crosstab(df, columns, target).join(top, ["column", "value"], "left_semi")


def month_position(month: Column) -> Column:
    """Sortable number for ``yyyy-MM``, 1..12 or a month name; NULL for anything else."""
    text = F.trim(month.cast("string"))
    by_name = F.create_map(*[x for i, name in enumerate(MONTH_NAMES) for x in (F.lit(name.lower()), F.lit(i + 1))])
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}$"), F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int"))
        .when(text.rlike(r"^(0?[1-9]|1[0-2])$"), text.cast("int"))
        .otherwise(F.try_element_at(by_name, F.lower(text)))
    )


def month_label(month: Column) -> Column:
    """Month name for 1..12; any other text stays as it is."""
    text = F.trim(month.cast("string"))
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.when(text.rlike(r"^(0?[1-9]|1[0-2])$"), F.get(names, text.cast("int") - 1)).otherwise(text)


def month_crosstab(df: DataFrame, target: str = "pago", month: str = "mes") -> DataFrame:
    """Counts and row percentages of each target class per month, in calendar order."""
    require_columns(df, [target, month])
    classes = classes_of(df, target)
    pairs = df.where(F.col(target).isNotNull() & F.col(month).isNotNull())
    counts = pairs.groupBy(month).agg(*[F.count_if(F.col(target) == c).alias(f"n_{c}") for c in classes])
    total = sum(F.col(quoted(f"n_{c}")) for c in classes)
    return counts.select(
        month_label(F.col(month)).alias(month),
        month_position(F.col(month)).alias("pos"),
        *[quoted(f"n_{c}") for c in classes],
        *[(F.col(quoted(f"n_{c}")) / total * 100).alias(f"pct_{c}") for c in classes],
    ).orderBy("pos", month)


def month_rate(df: DataFrame, target: str = "pago", month: str = "mes") -> DataFrame:
    """Payment rate in percent per month, in calendar order."""
    require_columns(df, [target, month])
    rates = df.where(F.col(month).isNotNull()).groupBy(month).agg((F.avg(target) * 100).alias("tasa_pago"))
    return rates.select(
        month_label(F.col(month)).alias(month), month_position(F.col(month)).alias("pos"), "tasa_pago"
    ).orderBy("pos", month)


def class_balance(stages: dict[str, DataFrame], target: str) -> DataFrame:
    """Counts and percentages per class for each named table, e.g. before and after rebalancing."""
    parts = [
        target_distribution(df, target).select(F.lit(name).alias("stage"), F.col(target).alias("class"), "n", "pct")
        for name, df in stages.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def flag_counts(df: DataFrame, flags: list[str] | None = None, suffix: str = "_imputed") -> DataFrame:
    """Original and imputed rows per imputation flag, in one aggregation."""
    columns = flags if flags is not None else [c for c in df.columns if c.endswith(suffix)]
    stats = [
        F.struct(
            F.lit(c).alias("flag"),
            F.count_if(F.col(c).cast("int") == 0).alias("original"),
            F.count_if(F.col(c).cast("int") == 1).alias("imputed"),
        ).alias(c)
        for c in columns
    ]
    tall = df.agg(*stats).select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    total = F.col("original") + F.col("imputed")
    return tall.select(
        "flag",
        "original",
        "imputed",
        F.when(total > 0, F.col("imputed") / total * 100).otherwise(0.0).alias("pct_imputed"),
    )
