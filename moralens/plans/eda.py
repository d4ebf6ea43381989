"""The exploratory report: every univariate table of a panel, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from moralens.functions.quantiles import quantile_values
from moralens.operators import correlation, distributions, outliers, quality
from moralens.operators.columns import binary_columns, classify, frequencies
from moralens.staging import stage


def eda_report(df: DataFrame, target: str = "pago", exempt: list[str] | None = None) -> dict[str, DataFrame]:
    """Named result tables; the frequency table behind five of them and the quartiles behind three are computed once."""
    classes = classify(df.schema, exempt)
    content = df.drop("row_id")
    freq = stage(frequencies(content, content.columns), "frequencies")
    columns = quality.column_quality_of(freq)
    report = {"profile": quality.table_profile(content), "missing": quality.missing_top(columns, 15)}
    if target in df.columns:
        report["target"] = distributions.target_distribution(df, target)
    quartiles = quantile_values(df, classes.numeric, outliers.QUARTILES) if classes.numeric else {}
    two_valued = set(binary_columns(df, classes.numeric))
    continuous = [c for c in classes.numeric if c not in two_valued]
    if two_valued:
        report["binary"] = distributions.binary_counts(df, target if target in df.columns else None, exempt)
    if continuous:
        report["histograms"] = distributions.histogram(df, continuous, quartiles=quartiles)
        report["densities"] = distributions.density(df, continuous, target if target in df.columns else None)
    if classes.categorical:
        named = freq.where(freq["column"].isin(classes.categorical))
        report["categories"] = quality.top_values(named, 10)
    if len(classes.numeric) >= 2:
        report["correlation"] = correlation.pearson(df, classes.numeric)
    if classes.numeric:
        report["boxes"] = outliers.box_statistics(df, classes.numeric, quartiles=quartiles)
        report["outliers"] = outliers.outlier_counts(df, exempt, quartiles=quartiles)
    return report
