"""Distributed ranks, exact quantiles, hot-key joins and tail probabilities."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moralens.functions import quantiles, tails
from moralens.functions.joins import lookup
from moralens.functions.quantiles import exact_quantiles
from moralens.functions.ranking import prefix_counts


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("rows_per_bucket", [10_000, 40])
def test_prefix_counts_equal_a_global_window(spark, descending, rows_per_bucket):
    rng = random.Random(1)
    rows = [(g, v * 0.5, rng.randint(1, 9)) for g in ("a", "b") for v in rng.sample(range(2000), 300)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = prefix_counts(df, ["g"], "v", ["n"], descending, rows_per_bucket).toPandas()
    want = pd.DataFrame(rows, columns=["g", "v", "n"]).sort_values("v", ascending=not descending)
    want["cum"] = want.groupby("g")["n"].cumsum()
    merged = got.merge(want, on=["g", "v"])
    assert len(merged) == len(rows)
    assert (merged["cum_n"] == merged["cum"]).all()


def quantile_table(rng):
    values = np.concatenate([np.zeros(4000), rng.lognormal(3, 2, 8000), [1e300, -1e300, 1e-300]])
    rows = [(i, float(v), i % 3, None if i % 5 else float(i)) for i, v in enumerate(rng.permutation(values))]
    return rows, pd.DataFrame(rows, columns=["row_id", "x", "c", "y"])


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize(("rows_at_once", "cuts"), [(100_000, 256), (40, 8), (1, 2)])
def test_quantiles_are_exact_with_a_hot_value(spark, rows_at_once, cuts):
    rows, table = quantile_table(np.random.default_rng(3))
    df = spark.createDataFrame(rows, "row_id bigint, x double, c int, y double")
    limits = {"rows_at_once": max(rows_at_once, 2), "cuts": cuts}
    got = {(r["column"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["x", "y"], PROBS, **limits).collect()}
    for c in ("x", "y"):
        for p in PROBS:
            assert got[c, p] == pytest.approx(table[c].quantile(p), rel=1e-12)
    by = exact_quantiles(df, ["x"], [0.5], by="c", **limits).collect()
    medians = table.groupby("c")["x"].median()
    assert {r["c"]: pytest.approx(r["quantile"]) for r in by} == medians.to_dict()


@pytest.mark.parametrize("lie", ["above", "point"])
def test_a_wrong_sketch_changes_nothing(spark, monkeypatch, lie):
    def brackets(values, probs, honest=quantiles.sketch_brackets):
        wrong = {"above": (1e200, 1e250), "below": (-1e250, -1e200), "point": (7.25, 7.25)}
        return [(*b[:4], *wrong.get(lie, b[6:]), *b[6:]) for b in honest(values, probs)]

    monkeypatch.setattr(quantiles, "sketch_brackets", brackets)
    rows, table = quantile_table(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "row_id bigint, x double, c int, y double")
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["x"], PROBS, rows_at_once=100, cuts=16).collect()}
    assert got == {p: pytest.approx(table["x"].quantile(p), rel=1e-12) for p in PROBS}


def test_no_task_sorts_more_values_than_allowed(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quantiles, "_totals", lambda counted, real=quantiles._totals: seen.append(real(counted)) or seen[-1])
    df = spark.range(50_000).select((F.col("id") * F.col("id") % 49_999).cast("double").alias("x"))
    monkeypatch.setattr(quantiles, "sketch_brackets", lambda v, p, real=quantiles.sketch_brackets: [(*b[:4], *b[6:], *b[6:]) for b in real(v, p)])
    exact_quantiles(df, ["x"], [0.25, 0.5], rows_at_once=300, cuts=16)
    assert len(seen) >= 3 and max(t[2] for t in seen[0].values()) > 10_000
    assert all(different <= 300 for _, _, different in seen[-1].values())


def test_infinite_and_equal_values_are_quantiles_too(spark):
    df = spark.createDataFrame([(float("inf"),), (float("inf"),), (1.0,), (float("-inf"),)], "x double")
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["x"], [0.0, 1.0, 0.9]).collect()}
    assert got == {0.0: float("-inf"), 1.0: float("inf"), 0.9: float("inf")}


def test_quantiles_skip_empty_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    assert [(r["column"], r["quantile"]) for r in exact_quantiles(df, ["a", "b"], [0.5]).collect()] == [("b", 2.0)]


def test_lookup_splits_hot_keys(spark):
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    dictionary = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    joined = lookup(rows, dictionary, ["k"], "n")
    assert joined.count() == 30_000
    assert joined.where(F.col("v") != F.col("k") * 2).count() == 0


def test_tail_probabilities():
    # textbook critical values
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(0.0, 3) == 1.0
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert 0 < tails.chi2_tail(400.0, 2) < 1e-80
