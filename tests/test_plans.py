"""Physical plans: nothing unreduced in one partition, no row-at-a-time Python, filters at the scan."""

import pytest
from pyspark.sql import functions as F

from moralens.functions.quantiles import exact_quantiles
from moralens.functions.ranking import prefix_counts
from moralens.operators import correlation, distributions, outliers, quality
from moralens.operators.columns import frequencies
from moralens.operators.neighbours import distinct_points
from moralens.plans import reports
from moralens.sources.panel import EXEMPT
from moralens.staging import stage, staging_root


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_push_filters_and_columns(panel):
    text = plan(reports.average_payers(panel))
    assert "PushedFilters: [IsNotNull(pago), EqualTo(pago,1)]" in text
    assert "saldo_capital" not in text
    assert "TakeOrderedAndProject" in plan(reports.top_clients(panel))


@pytest.mark.parametrize(
    "build",
    [
        lambda p: quality.column_quality(p),
        lambda p: quality.numeric_profile(p, EXEMPT),
        lambda p: distributions.density(p, ["saldo_capital"], "pago"),
        lambda p: distributions.histogram(p, ["saldo_capital"], 10),
        lambda p: correlation.pearson(p, ["saldo_capital", "dias_mora"]),
        lambda p: outliers.outlier_rows(p, "row_id", EXEMPT),
    ],
)
def test_no_python_rows_and_no_single_task(panel, build):
    text = plan(build(panel))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text


def test_rank_window_runs_inside_buckets(spark):
    df = spark.range(5000).select(F.lit("all").alias("g"), F.col("id").alias("v"), F.lit(1).alias("n"))
    text = plan(prefix_counts(df, ["g"], "v", ["n"], rows_per_bucket=100))
    assert "SinglePartition" not in text
    assert "_bucket" in text


def test_top_k_is_cut_before_the_shuffle(panel):
    freq = frequencies(panel, ["genero", "departamento"])
    assert "WindowGroupLimit" in plan(quality.top_values(freq, 5))
    assert "WindowGroupLimit" in plan(distinct_points(panel, "row_id", ["contacto_mes_actual", "pago"], 6))
    assert "TakeOrderedAndProject" in plan(quality.exempt_profile(panel, ["mes"], "row_id"))


def test_quantile_search_broadcasts_only_its_brackets(panel):
    text = plan(exact_quantiles(panel, ["saldo_capital", "dias_mora"], [0.25, 0.75]))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "SinglePartition" not in text


def test_staging_uses_the_named_folder(spark, checkpoint_dir):
    assert staging_root(spark) == checkpoint_dir
    staged = stage(spark.range(3).toDF("id"), "three")
    assert staged.count() == 3
    assert all(checkpoint_dir in name for name in staged.inputFiles())
