"""Relation of every feature to the target: AUC, correlation, ANOVA, chi-square, mutual information."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moralens.functions.quantiles import quantile_values
from moralens.functions.ranking import prefix_counts
from moralens.functions.tails import chi2_tail, f_tail, t_two_sided
from moralens.operators.columns import (
    binary_columns,
    classes_of,
    classify,
    correlation,
    frequencies,
    long_values,
    numeric_summary,
    require_columns,
    small_table,
)
from moralens.staging import stage

MIN_COMPLETE_ROWS = 10
DECILES = [i / 10 for i in range(1, 10)]


def target_type(df: DataFrame, target: str) -> DataFrame:
    """Type, number of distinct values and kind (binary, numeric or categorical) of the target."""
    require_columns(df, [target])
    kind = "numeric" if target in classify(df.schema).numeric else "categorical"
    distinct = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return distinct.agg(F.count(F.lit(1)).alias("unique_values")).select(
        F.lit(target).alias("target_column"),
        F.lit(dict(df.dtypes)[target]).alias("dtype"),
        "unique_values",
        F.when(F.col("unique_values") == 2, "binary").otherwise(kind).alias("kind"),
    )


def target_kind(df: DataFrame, target: str) -> str:
    """The kind alone; at most three distinct values are fetched to decide it."""
    require_columns(df, [target])
    few = df.select(target).where(F.col(target).isNotNull()).distinct().limit(3).collect()
    if len(few) == 2:
        return "binary"
    return "numeric" if target in classify(df.schema).numeric else "categorical"


def numeric_features(df: DataFrame, target: str, exempt: list[str] | None = None) -> list[str]:
    return [c for c in classify(df.schema, exempt).numeric if c != target]


def categorical_features(df: DataFrame, target: str, exempt: list[str] | None = None) -> list[str]:
    return [c for c in classify(df.schema, exempt).categorical if c != target]


def _pair_summary(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``column, n, missing_rate, correlation`` with the target over complete pairs, in one scan."""
    shown = df.withColumn("_y", F.col(target).cast("double"))
    value, y = F.col("value"), F.col("_y")
    return (
        long_values(shown, columns, ["_y"], "double")
        .groupBy("column")
        .agg(
            F.count(F.when(y.isNotNull(), value)).alias("n"),
            F.avg(value.isNull().cast("double")).alias("missing_rate"),
            correlation(value, y).alias("correlation"),
        )
    )


def auc_of_counts(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Tie-exact ROC AUC per key from ``value, n, positives`` counts (rank-sum form)."""
    ranked = prefix_counts(counts, keys, value, ["n"])
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("positives") * rank).alias("rank_sum"),
        F.sum("positives").cast("double").alias("n1"),
        F.sum(F.col("n") - F.col("positives")).cast("double").alias("n0"),
        F.count(F.lit(1)).alias("distinct"),
    )
    usable = (F.col("distinct") > 1) & (F.col("n1") > 0) & (F.col("n0") > 0)
    area = (F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return sums.select(*keys, F.when(usable, area).alias("auc"))


def feature_auc(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """AUC of each numeric column as a score for the larger target class."""
    classes = classes_of(df, target)
    pairs = df.where(F.col(target).isNotNull())
    counts = (
        long_values(pairs, columns, [target], "double")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == classes[-1]).alias("positives"))
    )
    return auc_of_counts(counts, ["column"], "value")


def class_frequencies(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Staged ``column, _y, value, n``, NULLs included: all that the statistics against classes need.

    Hot values and classes combine before the one shuffle; everything else works on this reduced table.
    """
    return stage(frequencies(df.withColumn("_y", F.col(target)), columns, ["_y"], "double"), "class-frequencies")


def _class_summary(counted: DataFrame, classes: list) -> dict[str, dict]:
    """Per column: rows, gaps, complete pairs, different values, and the mean per class (index) and over the pairs."""
    value, n, y = F.col("value"), F.col("n"), F.col("_y")
    there = value.isNotNull() & y.isNotNull()
    mean = lambda which: F.sum(F.when(which, n * value)) / F.sum(F.when(which, n))
    found = counted.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(value.isNull(), n).otherwise(0)).alias("gaps"),
        F.sum(F.when(there, n).otherwise(0)).alias("pairs"),
        F.sum(F.when(there & (y == classes[-1]), n).otherwise(0)).alias("positives"),
        F.count_distinct(value).alias("different"),
        mean(there).alias("mean"),
        *[mean(there & (y == c)).alias(f"mean_{i}") for i, c in enumerate(classes)],
    )
    return {r["column"]: r.asDict() for r in found.collect()}


def _class_correlations(counted: DataFrame, summary: dict[str, dict], last) -> dict[str, float | None]:
    """Pearson r of each column with the indicator of the largest class, from sums around the means."""
    spark = counted.sparkSession
    centres = [(c, float(s["mean"]), s["positives"] / s["pairs"]) for c, s in summary.items() if s["pairs"]]
    means = small_table(spark, centres, "column string, mx double, my double")
    met = counted.where(F.col("value").isNotNull() & F.col("_y").isNotNull()).join(means, "column")
    x, y, n = F.col("value") - F.col("mx"), (F.col("_y") == last).cast("double") - F.col("my"), F.col("n")
    sums = met.groupBy("column").agg(F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    out: dict[str, float | None] = {}
    for r in sums.collect():
        spread = math.sqrt(r["xx"]) * math.sqrt(r["yy"])
        out[r["column"]] = r["xy"] / spread if spread > 0 else None
    return out


def _areas_and_deciles(counted: DataFrame, summary: dict[str, dict], last) -> dict[str, tuple[float | None, list[float]]]:
    """Per column the tie-exact AUC and the different deciles, both from one running count of the distinct values."""
    pairs = counted.where(F.col("value").isNotNull() & F.col("_y").isNotNull())
    values = pairs.groupBy("column", "value").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("_y") == last, F.col("n")).otherwise(0)).alias("positives")
    )
    sizes = small_table(counted.sparkSession, [(c, s["pairs"]) for c, s in summary.items()], "column string, pairs bigint")
    ranked = prefix_counts(values, ["column"], "value", ["n"]).join(sizes, "column")
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    place = lambda p: F.lit(p) * (F.col("pairs") - 1)
    at = lambda r: F.min(F.when(F.col("cum_n") > r, F.col("value")))
    ends = [e for i, p in enumerate(DECILES) for e in (at(F.floor(place(p))).alias(f"low_{i}"), at(F.ceil(place(p))).alias(f"high_{i}"))]
    found = ranked.groupBy("column").agg(
        F.sum(F.col("positives") * rank).alias("rank_sum"), F.sum("positives").cast("double").alias("n1"), F.count("*").alias("distinct"), *ends
    )
    out = {}
    for r in found.collect():
        n1, pairs_ = r["n1"], summary[r["column"]]["pairs"]
        n0 = pairs_ - n1
        area = (r["rank_sum"] - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 and r["distinct"] > 1 else None
        cuts = set()
        for i, p in enumerate(DECILES):
            low, high, share = r[f"low_{i}"], r[f"high_{i}"], p * (pairs_ - 1) % 1
            cuts.add(low if low == high else low + (high - low) * share)
        out[r["column"]] = (area, sorted(cuts))
    return out


def _class_information(counted: DataFrame, cuts: dict[str, list[float]]) -> dict[str, float]:
    """Plug-in mutual information (nats) of each column, cut at ``cuts``, with the classes."""
    bounds = small_table(counted.sparkSession, list(cuts.items()), "column string, cuts array<double>")
    pairs = counted.where(F.col("value").isNotNull() & F.col("_y").isNotNull()).join(bounds, "column")
    bin_of = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    # ten bins of each class and column
    cells = pairs.groupBy("column", bin_of.alias("bin"), "_y").agg(F.sum("n").alias("n")).collect()
    of: dict[str, list] = {}
    for r in cells:
        of.setdefault(r["column"], []).append((r["bin"], r["_y"], r["n"]))
    out = {}
    for column, own in of.items():
        rows, classes = Counter(), Counter()
        for b, y, n in own:
            rows[b] += n
            classes[y] += n
        total = sum(rows.values())
        out[column] = math.fsum(n / total * math.log(n * total / (rows[b] * classes[y])) for b, y, n in own)
    return out


def numeric_vs_binary(df: DataFrame, target: str, exempt: list[str] | None = None) -> DataFrame:
    """Missing rate, two-valuedness, AUC, Pearson r, class means and mutual information per column.

    The larger class counts as 1, whatever the target's type. All figures come from one table of
    frequencies per (column, class, value).
    """
    columns = numeric_features(df, target, exempt)
    classes = classes_of(df, target)
    names = ["auc", "correlation", "mutual_information", *[f"mean_{c}" for c in classes]]
    schema = ", ".join(["column string, missing_rate double, is_binary boolean", *[f"`{n}` double" for n in names]])
    if not columns or not classes:
        empty = [(c, None, None, *[None] * len(names)) for c in columns]
        return df.sparkSession.createDataFrame(empty, schema)
    counted = class_frequencies(df, columns, target)
    summary = _class_summary(counted, classes)
    correlations = _class_correlations(counted, summary, classes[-1])
    ranked = _areas_and_deciles(counted, summary, classes[-1])
    information = _class_information(counted, {c: cuts for c, (_, cuts) in ranked.items()})
    rows = []
    for c, s in summary.items():
        found = [None] * len(names)
        if s["pairs"] > MIN_COMPLETE_ROWS:
            found = [ranked[c][0], correlations.get(c), information.get(c), *[s[f"mean_{i}"] for i in range(len(classes))]]
        rows.append((c, s["gaps"] / s["rows"], s["different"] == 2, *found))
    return df.sparkSession.createDataFrame(rows, schema)


def numeric_vs_continuous(df: DataFrame, target: str, exempt: list[str] | None = None) -> DataFrame:
    """Pearson r with its two-sided p-value, and mutual information, per numeric column."""
    columns = numeric_features(df, target, exempt)
    two_valued = set(binary_columns(df, columns))
    summary = _pair_summary(df, columns, target).join(
        mutual_information(df, target, columns, []), "column", "left"
    )
    rows = []
    for r in summary.collect():
        n, corr, p = r["n"], r["correlation"], None
        if n <= MIN_COMPLETE_ROWS:
            rows.append((r["column"], r["missing_rate"], r["column"] in two_valued, n, None, None, None))
            continue
        if corr is not None:
            left = 1 - corr * corr
            p = 0.0 if left <= 0 else t_two_sided(corr * math.sqrt((n - 2) / left), n - 2)
        rows.append((r["column"], r["missing_rate"], r["column"] in two_valued, n, corr, p, r["mutual_information"]))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, missing_rate double, is_binary boolean, n bigint, correlation double, "
        "correlation_pvalue double, mutual_information double",
    )


def group_means(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Mean of each numeric column per target class."""
    return numeric_summary(df, columns, target).where(F.col("n") > 0).select("column", target, "n", "mean")


def anova(df: DataFrame, target: str, exempt: list[str] | None = None) -> DataFrame:
    """One-way ANOVA of each numeric column over the target classes."""
    columns = numeric_features(df, target, exempt)
    groups = numeric_summary(df, columns, target).where(F.col("n") > 0)
    size = F.col("n").cast("double")
    within = F.when(F.col("n") > 1, (size - 1) * F.col("std") * F.col("std")).otherwise(0.0)
    sums = groups.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        (F.sum(size * F.col("mean")) / F.sum(size)).alias("grand"),
        F.sum(within).alias("ssw"),
        F.collect_list(F.struct(size.alias("n"), F.col("mean").alias("mean"))).alias("parts"),
    )
    between = F.aggregate(
        F.col("parts"),
        F.lit(0.0),
        lambda acc, g: acc + g["n"] * (g["mean"] - F.col("grand")) * (g["mean"] - F.col("grand")),
    )
    rows = []
    for r in sums.withColumn("ssb", between).drop("parts").collect():
        n, g = r["n"], r["groups"]
        f = p = None
        if n > MIN_COMPLETE_ROWS and g > 1 and n > g and r["ssw"] > 0:
            f = (r["ssb"] / (g - 1)) / (r["ssw"] / (n - g))
            p = f_tail(f, g - 1, n - g)
        rows.append((r["column"], n, g, f, p))
    return df.sparkSession.createDataFrame(
        rows, "column string, n bigint, groups bigint, anova_f_stat double, anova_p_value double"
    )


def contingency(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``column, value, <target>, n`` over complete pairs: the contingency tables in long form."""
    return frequencies(df.where(F.col(target).isNotNull()), columns, [target]).where(F.col("value").isNotNull())


def _with_margins(cells: DataFrame, target: str) -> DataFrame:
    """Add row totals, column totals and the grand total to every cell."""
    per_value = Window.partitionBy("column", "value")  # one row per class inside
    columns = cells.groupBy("column", target).agg(F.sum("n").alias("class_total"))
    whole = cells.groupBy("column").agg(F.sum("n").alias("total"))
    return (
        cells.withColumn("value_total", F.sum("n").over(per_value))
        .join(columns, ["column", target])
        .join(whole, "column")
    )


def chi_square(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Chi-square test of independence; a 2 x 2 table gets the Yates correction."""
    cells = stage(contingency(df, columns, target), "contingency")
    o, e = F.col("n"), F.col("value_total") * F.col("class_total") / F.col("total")
    # empty cells enter through the identity sum((O-E)^2/E) = sum(O^2/E) - N
    sums = (
        _with_margins(cells, target)
        .groupBy("column")
        .agg(
            F.max("total").alias("n"),
            F.sum(o * o / e).alias("ratio"),
            F.count(F.lit(1)).alias("cells"),
            F.min_by(o, F.struct("value", target)).alias("one_cell"),
            F.min_by(e, F.struct("value", target)).alias("one_expected"),
        )
    )
    values = cells.groupBy("column", "value").agg(F.sum("n").alias("t")).groupBy("column")
    shape = values.agg(F.count(F.lit(1)).alias("r")).join(
        cells.groupBy("column", target).agg(F.sum("n").alias("t")).groupBy("column").agg(F.count(F.lit(1)).alias("k")),
        "column",
    )
    rows = []
    for s in sums.join(shape, "column").collect():
        dof = (s["r"] - 1) * (s["k"] - 1)
        statistic = s["ratio"] - s["n"] if dof > 0 else 0.0
        if dof == 1:
            # all four cells of a 2 x 2 table miss their expectation by the same amount
            miss = abs(s["one_cell"] - s["one_expected"])
            kept = miss - min(0.5, miss)
            statistic = statistic * (kept / miss) ** 2 if miss > 0 else 0.0
        rows.append((s["column"], s["n"], float(statistic), dof, chi2_tail(statistic, dof)))
    return df.sparkSession.createDataFrame(
        rows, "column string, n bigint, chi2_statistic double, chi2_dof bigint, chi2_p_value double"
    )


def _decile_bins(df: DataFrame, columns: list[str]) -> dict:
    """Column -> bin expression: how many distinct deciles lie below the value."""
    deciles = quantile_values(df, columns, DECILES)
    bins = {}
    for c in columns:
        cuts = sorted({deciles[c, p] for p in DECILES if (c, p) in deciles})
        above = [(F.col(c).cast("double") > cut).cast("int") for cut in cuts]
        bins[c] = sum(above[1:], above[0]) if above else F.when(F.col(c).isNotNull(), 0)
    return bins


def mutual_information(
    df: DataFrame, target: str, numeric: list[str], categorical: list[str], continuous_target: bool | None = None
) -> DataFrame:
    """Plug-in mutual information (nats) of each column with the target; numeric values are cut at deciles."""
    if continuous_target is None:
        continuous_target = target_kind(df, target) == "numeric"
    pairs = df.where(F.col(target).isNotNull())
    y = _decile_bins(pairs, [target])[target] if continuous_target else F.col(target)
    bins = _decile_bins(pairs, numeric) if numeric else {}
    shown = pairs.select(
        y.alias("_y"), *[bins[c].alias(c) for c in numeric], *[F.col(c) for c in categorical]
    )
    cells = stage(contingency(shown, [*numeric, *categorical], "_y"), "contingency")
    n, total = F.col("n"), F.col("total").cast("double")
    information = n / total * F.log(n * total / (F.col("value_total") * F.col("class_total")))
    return _with_margins(cells, "_y").groupBy("column").agg(F.sum(information).alias("mutual_information"))


def bivariate_report(df: DataFrame, target: str, exempt: list[str] | None = None) -> DataFrame:
    """All statistics of all features against the target as tall rows ``kind, column, statistic, value``."""
    require_columns(df, [target])
    numeric = numeric_features(df, target, exempt)
    categorical = categorical_features(df, target, exempt)
    kind = target_kind(df, target)
    parts = []

    def add(table: DataFrame, label: str) -> None:
        names = [c for c in table.columns if c != "column"]
        typed = table.select("column", *[F.col(c).cast("double").alias(c) for c in names])
        tall = typed.unpivot(["column"], names, "statistic", "value")
        parts.append(tall.select(F.lit(label).alias("kind"), "column", "statistic", "value"))

    if numeric:
        if kind == "binary":
            add(numeric_vs_binary(df, target, exempt), "numeric")
        elif kind == "numeric":
            add(numeric_vs_continuous(df, target, exempt), "numeric")
        else:
            add(anova(df, target, exempt), "numeric")
            means = group_means(df, numeric, target)
            parts.append(
                means.select(
                    F.lit("numeric").alias("kind"),
                    "column",
                    F.concat(F.lit("mean_"), F.col(target).cast("string")).alias("statistic"),
                    F.col("mean").alias("value"),
                )
            )
    if categorical:
        base = frequencies(df, categorical).groupBy("column").agg(
            (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_rate"),
            F.count("value").alias("unique_categories"),
            (F.count("value") == 2).alias("is_binary"),
        )
        add(base, "categorical")
        add(chi_square(df, target, categorical).drop("n"), "categorical")
        add(mutual_information(df, target, [], categorical, kind == "numeric"), "categorical")
        if kind != "numeric":
            # the contingency tables themselves, a row per cell
            cell = F.concat_ws("|", F.lit("n"), "value", F.col(target).cast("string"))
            cells = contingency(df, categorical, target).select("column", cell.alias("statistic"), F.col("n").cast("double").alias("value"))
            parts.append(cells.select(F.lit("categorical").alias("kind"), "column", "statistic", "value"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.where(F.col("value").isNotNull())
