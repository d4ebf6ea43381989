"""Statistics on small tables with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moralens.operators import bivariate, cleaning, correlation, distributions, outliers, quality
from moralens.plans import eda


def by_column(df, value):
    return {r["column"]: r[value] for r in df.collect()}


def test_sample_profile(sample):
    content = sample.drop("row_id")
    row = quality.table_profile(content).first()
    assert (row["total_rows"], row["total_missing"], row["total_duplicates"]) == (20, 0, 10)
    stats = {r["column"]: r for r in quality.numeric_profile(sample, ["row_id"]).collect()}
    assert stats["edad"]["mean"] == 47.5
    assert stats["ingresos"]["max"] == 100000
    assert {r["pago"]: r["n"] for r in distributions.target_distribution(sample, "pago").collect()} == {0: 10, 1: 10}


def test_sample_dependence(sample):
    test = bivariate.chi_square(sample, "pago", ["genero", "categoria"]).collect()
    for r in test:
        assert r["chi2_statistic"] == pytest.approx(16.2)
        assert r["chi2_dof"] == 1
    information = by_column(
        bivariate.mutual_information(sample, "pago", [], ["genero", "categoria"]), "mutual_information"
    )
    assert information["genero"] == pytest.approx(math.log(2))


def test_published_warnings_appear(spark):
    df = spark.createDataFrame(
        [(1, None, "x", 0), (1, None, "x", 1), (1, None, "x", 1), (1, 5, "x", None)],
        "same int, gaps int, text string, pago int",
    )
    found = {(r["severity"], r["rule"], r["column"]) for r in quality.quality_rules(df).collect()}
    assert ("warning", "constant_column", "same") in found
    assert ("warning", "high_missing", "gaps") in found
    assert ("warning", "duplicate_rows", None) in found
    assert ("warning", "target_missing_values", "pago") in found
    constant = spark.createDataFrame([(1, 0), (2, 0)], "a int, pago int")
    assert ("error", "target_constant", "pago") in {
        (r["severity"], r["rule"], r["column"]) for r in quality.quality_rules(constant).collect()
    }
    without = spark.createDataFrame([(1, 0), (2, 0)], "a int, b int")
    assert "target_absent" in {r["rule"] for r in quality.quality_rules(without).collect()}


def test_empty_column_is_reported(spark):
    df = spark.createDataFrame([(None, 0), (None, 1)], "a int, pago int")
    rules = {r["rule"] for r in quality.quality_rules(df).collect()}
    assert {"empty_column", "high_missing", "constant_column"} <= rules


def test_nan_becomes_null_and_infinity_stays(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    clean = cleaning.nan_to_null(df)
    assert [r["x"] for r in clean.collect()] == [None, float("inf"), 1.0]
    assert quality.numeric_profile(clean).first()["has_inf"]


def test_drop_duplicates_keeps_the_smallest_id(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1)], "row_id bigint, x string, y int")
    assert sorted(r["row_id"] for r in cleaning.drop_duplicates(df, "row_id").collect()) == [1, 2]


@pytest.mark.parametrize("codes_per_bucket", [3, 1000])
def test_kendall_equals_pairwise_counting(spark, codes_per_bucket):
    rows = [(i, (i * 7) % 13, (i * i) % 11, None if i % 4 == 0 else (i * 5) % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, a int, b int, c int")
    got = {
        (r["var_1"], r["var_2"]): r["r"]
        for r in correlation.kendall(df, ["a", "b", "c"], "row_id", codes_per_bucket).collect()
    }

    def tau(x, y):
        both = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
        score = ties_x = ties_y = n0 = 0
        for i in range(len(both)):
            for j in range(i):
                dx, dy = both[i][0] - both[j][0], both[i][1] - both[j][1]
                n0 += 1
                ties_x += dx == 0
                ties_y += dy == 0
                score += (dx * dy > 0) - (dx * dy < 0)
        return score / math.sqrt((n0 - ties_x) * (n0 - ties_y))

    columns = {c: [r[i + 1] for r in rows] for i, c in enumerate("abc")}
    for a, b in (("b", "a"), ("c", "a"), ("c", "b")):
        assert got[a, b] == pytest.approx(tau(columns[a], columns[b]), abs=1e-12)


def test_spearman_and_pearson_equal_pandas(spark):
    rows = [(i, float((i * 7) % 13), float(i % 5) if i % 3 else None, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, k double")
    table = pd.DataFrame(rows, columns=["row_id", "a", "b", "k"])
    for method in ("pearson", "spearman"):
        got = {
            (r["var_1"], r["var_2"]): r["r"] for r in correlation.correlation_matrix(df, ["a", "b", "k"], method).collect()
        }
        want = table[["a", "b"]].dropna()
        want = want.rank() if method == "spearman" else want
        assert got["b", "a"] == pytest.approx(want["a"].corr(want["b"]))
        assert got["k", "a"] is None


def test_unknown_options_raise(sample):
    with pytest.raises(ValueError):
        correlation.correlation_matrix(sample, ["edad", "ingresos"], "cosine")
    with pytest.raises(ValueError):
        correlation.correlation_matrix(sample, ["edad"])
    with pytest.raises(ValueError):
        outliers.outlier_rows(sample, "row_id", method="mad")
    with pytest.raises(ValueError):
        distributions.histogram(sample, ["edad"], "square-root")
    with pytest.raises(ValueError):
        distributions.month_rate(sample)


def test_zero_spread_has_no_z_outliers(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(10)], "row_id bigint, x double")
    assert outliers.outlier_rows(df, "row_id", method="zscore").count() == 0
    assert outliers.outlier_counts(df, ["row_id"]).first()["outliers"] == 0


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    bins = {r["bin"]: r["n"] for r in distributions.histogram(df, ["x"], 5).collect()}
    assert bins == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    constant = spark.createDataFrame([(2.0,)] * 4, "x double")
    assert sum(r["n"] for r in distributions.histogram(constant, ["x"], 4).collect()) == 4


def test_density_integrates_to_one(panel):
    points = distributions.density(panel, ["saldo_capital"], "pago").toPandas()
    for _, curve in points.groupby("pago"):
        curve = curve.sort_values("point")
        step = curve["at_value"].iloc[1] - curve["at_value"].iloc[0]
        assert curve["density"].sum() * step == pytest.approx(1.0, abs=0.01)


@pytest.mark.parametrize(
    "months, labels",
    [
        (["3", "12", "1"], ["Enero", "Marzo", "Diciembre"]),
        (["Marzo", "Enero", "Diciembre"], ["Enero", "Marzo", "Diciembre"]),
        (["2025-04", "2024-12", "2025-01"], ["2024-12", "2025-01", "2025-04"]),
    ],
)
def test_months_come_in_calendar_order(spark, months, labels):
    df = spark.createDataFrame([(m, i % 2) for m in months for i in range(4)], "mes string, pago int")
    assert [r["mes"] for r in distributions.month_rate(df).collect()] == labels
    counts = distributions.month_crosstab(df).collect()
    assert [r["mes"] for r in counts] == labels
    assert all(r["pct_1"] == 50.0 for r in counts)


def test_target_kinds(sample):
    assert bivariate.target_kind(sample, "pago") == "binary"
    assert bivariate.target_kind(sample, "edad") == "numeric"
    three = sample.withColumn("banco", F.concat(F.lit("b"), F.col("row_id") % 3))
    assert bivariate.target_kind(three, "banco") == "categorical"
    report = bivariate.bivariate_report(three, "banco", ["row_id"])
    assert {"anova_f_stat", "chi2_statistic", "mean_b0"} <= {r["statistic"] for r in report.collect()}
    numeric = bivariate.bivariate_report(sample, "ingresos", ["row_id"])
    assert "correlation_pvalue" in {r["statistic"] for r in numeric.collect()}


def test_p_values(sample):
    row = bivariate.numeric_vs_continuous(sample, "ingresos", ["row_id", "pago"]).first()
    assert row["correlation"] > 0.99 and row["correlation_pvalue"] < 1e-15
    same = {r["column"]: r for r in bivariate.anova(sample, "genero", ["row_id"]).collect()}
    assert 0 <= same["edad"]["anova_p_value"] <= 1


def test_too_few_complete_rows(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(8)], "row_id bigint, x double, pago int")
    row = bivariate.numeric_vs_binary(df, "pago", ["row_id"]).first()
    assert row["auc"] is None and row["correlation"] is None and row["missing_rate"] == 0


def test_crosstab_of_names_with_dots(spark):
    rows = [("x", "D.C.", "1"), ("x", "D.C.", "2"), ("x", "Cali", "1"), ("y", "Cali", "1")]
    df = spark.createDataFrame(rows, "`a.b` string, clase string, mes string")
    table = {r["value"]: r.asDict() for r in distributions.crosstab(df, ["a.b"], "clase").collect()}
    assert (table["x"]["column"], table["x"]["n_D.C."], table["x"]["n_Cali"]) == ("a.b", 2, 1)
    assert table["y"]["pct_D.C."] == 0
    months = distributions.month_crosstab(df, "clase").collect()
    assert [r["n_D.C."] for r in months] == [1, 1]


def test_one_far_value_makes_no_dense_histogram(spark):
    near = spark.range(100_000).select((F.col("id") % 1000).cast("double").alias("x"))
    table = near.unionByName(spark.createDataFrame([(1e12,), (None,)], "x double"))
    rows = distributions.histogram(table, ["x"], "fd").collect()
    assert sum(r["n"] for r in rows) == 100_001 and all(r["n"] > 0 for r in rows)
    last = max(rows, key=lambda r: r["bin"])
    assert last["bin"] > 1 << 31 and last["n"] == 1 and last["to_value"] == pytest.approx(1e12)
    assert all(r["from_value"] <= r["to_value"] for r in rows)
    infinite = spark.createDataFrame([(float("inf"),), (1.0,)], "x double")
    assert distributions.histogram(infinite, ["x"]).count() == 0


def test_density_without_classes_weighs_repeats(spark):
    values = [1.0] * 500 + [2.0] * 300 + [5.0]
    points = distributions.density(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).toPandas().sort_values("point")
    data = np.array(values)
    width = data.std(ddof=1) * len(data) ** -0.2
    at = points["at_value"].to_numpy()
    expected = np.exp(-0.5 * ((at[:, None] - data[None, :]) / width) ** 2).sum(axis=1) / (len(data) * width * np.sqrt(2 * np.pi))
    assert points.columns.tolist() == ["column", "point", "at_value", "density"]
    assert np.allclose(points["density"], expected, rtol=1e-9)


def test_report_without_a_target_has_densities(panel):
    report = eda.eda_report(panel.drop("pago"), "pago", ["identificacion", "mes", "row_id"])
    assert "densities" in report and "target" not in report and report["densities"].count() > 0


def test_text_targets_are_binary_too(spark):
    rows = [(float(k % 7), None if k % 5 == 0 else float(k), "yes" if k % 7 > 3 else "no", "ab"[k % 2]) for k in range(60)]
    table = spark.createDataFrame(rows, "x double, z double, y string, c string")
    found = {r["column"]: r for r in bivariate.numeric_vs_binary(table, "y").collect()}
    assert found["x"]["auc"] == 1.0 and found["x"]["mean_yes"] > found["x"]["mean_no"] and found["z"]["missing_rate"] == 0.2
    data = pd.DataFrame(rows, columns=["x", "z", "y", "c"])
    assert found["z"]["correlation"] == pytest.approx(data["z"].corr((data["y"] == "yes").astype(float)))
    numbers = table.withColumn("y", (F.col("y") == "yes").cast("int"))
    same = {r["column"]: r for r in bivariate.numeric_vs_binary(numbers, "y").collect()}
    assert [found[c][1:8] for c in "xz"] == [same[c][1:8] for c in "xz"]
    report = {(r["column"], r["statistic"]): r["value"] for r in bivariate.bivariate_report(table, "y").collect()}
    assert report["c", "n|a|yes"] + report["c", "n|b|yes"] == sum(r[2] == "yes" for r in rows)


def test_relation_to_classes_takes_few_jobs(spark, panel):
    bivariate.numeric_vs_binary(panel, "pago", ["identificacion", "mes", "row_id"]).collect()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "numeric_vs_binary")
    bivariate.numeric_vs_binary(panel, "pago", ["identificacion", "mes", "row_id"]).collect()
    jobs = len(tracker.getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("", "")
    # adaptive plans run a job per shuffle, so their number varies a little; it does not grow with the columns
    assert jobs <= 24


def test_spearman_ranks_every_pair_on_its_complete_rows(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({c: rng.integers(0, 30, 400).astype(float) for c in "abcd"})
    for c, every in (("b", 3), ("c", 4), ("d", 7)):
        data.loc[data.index % every == 0, c] = np.nan
    table = spark.createDataFrame(data.reset_index(names="row_id")).replace(float("nan"), None)
    found = {(r["var_1"], r["var_2"]): r["r"] for r in correlation.spearman(table, list("abcd"), "row_id").collect()}
    assert len(found) == 6
    for (a, b), r in found.items():
        assert r == pytest.approx(data[[a, b]].dropna().rank().corr().iloc[0, 1])


def test_rank_correlations_shuffle_only_columns_of_many_values(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = pd.DataFrame({c: rng.integers(0, k, 300).astype(float) for c, k in zip("abcd", (200, 4, 9, 120), strict=True)})
    data["c"] += data["a"] // 30
    data.loc[data.index % 5 == 0, "b"] = np.nan
    data.loc[data.index % 7 == 0, "d"] = np.nan
    table = spark.createDataFrame(data.reset_index(names="row_id")).replace(float("nan"), None)
    monkeypatch.setattr(correlation, "BROADCAST_VALUES", 50)
    monkeypatch.setattr(correlation, "CELLS_AT_ONCE", 40)
    looked, met = [], correlation.lookup
    watched = lambda rows, dictionary, *a: looked.append({r[0] for r in rows.select("column").distinct().collect()}) or met(rows, dictionary, *a)
    monkeypatch.setattr(correlation, "lookup", watched)
    staged, write = {}, correlation.stage
    monkeypatch.setattr(correlation, "stage", lambda df, label: staged.update({label: write(df, label)}) or staged[label])
    for method in ("spearman", "kendall"):
        found = {(r["var_1"], r["var_2"]): r["r"] for r in correlation.correlation_matrix(table, list("abcd"), method).collect()}
        assert len(found) == 6
        for (x, y), r in found.items():
            if method == "kendall":
                both = data[[x, y]].dropna().to_numpy()
                signs = [np.sign(both[:, None, k] - both[None, :, k]) for k in (0, 1)]
                want = (signs[0] * signs[1]).sum() / np.sqrt((signs[0] ** 2).sum() * (signs[1] ** 2).sum())
            else:
                want = data[[x, y]].dropna().rank().corr().iloc[0, 1]
            assert r == pytest.approx(want, abs=1e-12)
    assert looked == [{"a", "d"}] * 2
    # what goes through the windows is the frequencies of buckets, not the cells
    assert "values" not in staged and staged["orders"].groupBy("pair", "bucket").count().count() > 6


def test_pairs_in_order_equal_pairwise_counting():
    rng = np.random.default_rng(2)
    for n_x, n_y in ((1, 1), (5, 1), (1, 5), (6, 9), (40, 3), (40, 50)):
        x, y, n = rng.integers(0, n_x, 60), rng.integers(0, n_y, 60), rng.integers(1, 4, 60)
        both = np.sign(x[:, None] - x) * np.sign(y[:, None] - y) * 1.0
        pairs = n[:, None] * n
        rows = np.bincount(x, n)
        want = (pairs[both > 0].sum() / 2, pairs[both < 0].sum() / 2, (rows * (rows - 1) / 2).sum())
        assert correlation.ordered_pairs(x, y, n) == pytest.approx(want)


def test_the_report_finds_its_quartiles_once(panel, monkeypatch):
    asked, find = [], eda.quantile_values
    watched = lambda *a: asked.append(a[1:]) or find(*a)
    for module in (eda, distributions, outliers):
        monkeypatch.setattr(module, "quantile_values", watched)
    exempt = ["identificacion", "mes", "row_id"]
    few = panel.select("row_id", "saldo_capital", "dias_mora", "contacto_mes_actual", "pago")
    report = eda.eda_report(few, "pago", exempt)
    assert len(asked) == 1
    alone = {"histograms": distributions.histogram(few, ["saldo_capital", "dias_mora"]), "outliers": outliers.outlier_counts(few, exempt)}
    alone["boxes"] = outliers.box_statistics(few, report["boxes"].toPandas()["column"].tolist())
    for name, table in alone.items():
        assert sorted(report[name].collect()) == sorted(table.collect())


def test_density_of_several_classes_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"x": rng.normal(size=500), "z": rng.integers(0, 4, 500) * 1.5, "y": [f"c{k % 2}" for k in range(500)]})
    monkeypatch.setattr(distributions, "VALUES_AT_ONCE", 16)
    points = distributions.density(spark.createDataFrame(data).repartition(3), ["x", "z"], "y").toPandas()
    assert len(points) == 4 * distributions.DENSITY_POINTS
    for (column, label), own in points.groupby(["column", "y"]):
        values = data.loc[data["y"] == label, column].to_numpy()
        width = values.std(ddof=1) * len(values) ** -0.2
        z = (own["at_value"].to_numpy()[:, None] - values) / width
        assert np.allclose(own["density"], np.exp(-0.5 * z * z).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi)), rtol=1e-9)


def test_correlations_of_odd_columns_over_many_tasks(spark):
    rows = [(i, 0.1, 1e6 + i % 7, None if i % 3 else float(i), float("nan") if i == 5 else 1.0 * i, None) for i in range(90)]
    table = spark.createDataFrame(rows, "row_id bigint, k double, a double, b double, c double, e double")
    for parts in (1, 7):
        found = {(r[0], r[1]): r[2] for r in correlation.pearson(table.repartition(parts), list("kabce")).collect()}
        # values all alike have no correlation, in one task or several; NaN is a value, NULL is none
        assert [found[p] for p in (("a", "k"), ("b", "k"), ("e", "a"))] == [None] * 3 and math.isnan(found["c", "a"])
        some = pd.DataFrame(rows, columns=["row_id", *"kabce"])[["a", "b"]].dropna().astype(float)
        assert found["b", "a"] == pytest.approx(some.corr().iloc[0, 1], abs=1e-9)
