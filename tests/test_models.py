"""Metrics, fits, selection and training plans."""

import math

import pytest
from pyspark.sql import functions as F

from moralens.operators import metrics, models, selection
from moralens.plans import training
from moralens.sources import sinks

FLAGS = ["pago_mes_anterior", "sin_pago_previo", "contacto_mes_actual", "contacto_mes_anterior", "contacto_ultimos_6meses"]
TINY = models.ModelSettings(logistic_iterations=200, trees=3, forest_depth=3, rounds=2, bins=32)


@pytest.fixture(scope="module")
def ready(panel):
    return training.prepare(panel.drop("departamento", "banco"), FLAGS)


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def test_metrics_by_hand(spark):
    row = metrics.binary_metrics(scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.5, 1), (0.2, 0)]), []).first()
    assert row["accuracy"] == pytest.approx(0.6)
    assert row["precision"] == pytest.approx(2 / 3)  # 0.5 is not above the threshold
    assert row["recall"] == pytest.approx(2 / 3)
    assert row["roc_auc"] == pytest.approx(4 / 6)
    assert row["pr_auc"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)


def test_tied_scores_and_one_class(spark):
    tied = metrics.binary_metrics(scored(spark, [(0.4, 1), (0.4, 0), (0.4, 0)]), []).first()
    assert tied["roc_auc"] == 0.5 and tied["pr_auc"] == pytest.approx(1 / 3)
    assert (tied["precision"], tied["recall"], tied["f1"]) == (0, 0, 0)
    one = metrics.binary_metrics(scored(spark, [(0.4, 0), (0.6, 0)]), []).first()
    assert (one["roc_auc"], one["pr_auc"], one["recall"]) == (0.5, 0.5, 0)


def test_published_differences(spark):
    """Difference, relative difference and risk of published train and test values."""
    rows = [
        # fixed values: train, test, difference, relative difference in percent
        (1, 0.9002828555747878, 0.8922661263086795, 0.008016729266108302, 0.8984684086656579, "Low"),
        (2, 0.11244019138755981, 0.10866372980910426, 0.003776461578455556, 3.4753654673170583, "Low"),
        (3, 0.6746411483253588, 0.7047619047619048, -0.030120756436545992, -4.273891115996391, "Low"),
        (4, 0.53, 0.5, 0.03, 6.0, "Medium"),
        (5, 0.56, 0.5, 0.06, 12.0, "High"),
        (6, 0.56, 0.0, 0.56, 0.0, "Low"),
    ]
    table = spark.createDataFrame(rows, "i int, train double, test double, want double, want_pct double, want_risk string")
    for r in metrics.overfitting(table).collect():
        assert r["diff"] == pytest.approx(r["want"], abs=1e-12)
        assert r["pct_diff"] == pytest.approx(r["want_pct"], abs=1e-6)
        assert r["risk"] == r["want_risk"]


def test_scores_at_the_threshold_are_negative(spark):
    rows = metrics.classify_scores(scored(spark, [(0.5, 1), (0.51, 1)]), "score").orderBy("score").collect()
    assert [r["prediction"] for r in rows] == [0, 1]


def test_evaluation_of_one_model(ready):
    fitted = models.fit_model(models.LOGISTIC, ready.train, "pago", ready.features, TINY)
    found = training.evaluate_model(fitted, ready.train, ready.test, "pago")
    assert found.overfitting.count() == 6
    assert found.metrics.count() == 2
    assert found.confusion.agg(F.sum("n")).first()[0] == ready.test.count()
    last = found.roc.orderBy(F.desc("fpr"), F.desc("tpr")).first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_leaderboard_breaks_ties_by_name(spark):
    table = spark.createDataFrame([("b", 0.8), ("a", 0.8), ("c", 0.9)], "model string, roc_auc double")
    assert [r["model"] for r in metrics.leaderboard(table).collect()] == ["c", "a", "b"]
    assert metrics.best_result(table).first()["model"] == "c"


def test_logistic_gradient_vanishes(ready):
    names = [f for f in ready.features if f.startswith(("contacto", "duracion", "saldo"))]
    fitted = models.fit_model(models.LOGISTIC, ready.train, "pago", names, models.FULL)
    beta, bias = fitted.stages[-1].coefficients.toArray(), fitted.stages[-1].intercept
    rows = ready.train.select("pago", *names).collect()
    positives = sum(r["pago"] for r in rows)
    weight = {1: len(rows) / (2 * positives), 0: len(rows) / (2 * (len(rows) - positives))}
    gradient = [0.0] * (len(names) + 1)
    for r in rows:
        z = bias + sum(b * r[n] for b, n in zip(beta, names))
        miss = weight[r["pago"]] * (1 / (1 + math.exp(-z)) - r["pago"])
        gradient[-1] += miss
        for i, n in enumerate(names):
            gradient[i] += miss * r[n]
    for i, b in enumerate(beta):
        assert abs(gradient[i] + b) < 0.01 * len(rows) / 100
    assert abs(gradient[-1]) < 0.01 * len(rows) / 100


def test_refit_gives_the_same_model(ready):
    fits = [models.fit_model(models.FOREST, t, "pago", ready.features, TINY) for t in (ready.train, ready.train)]
    scores = [
        sorted(r["score"] for r in models.score(f, ready.test, "pago").collect()) for f in fits
    ]
    assert scores[0] == scores[1]
    with pytest.raises(ValueError):
        models.fit_model("svm", ready.train, "pago", ready.features, TINY)


def test_elimination_keeps_half(ready):
    names = ready.features[:9]
    ranking = selection.recursive_elimination(ready.train, "pago", names, TINY).collect()
    assert sorted(r["feature"] for r in ranking) == sorted(names)
    assert sum(r["selected"] for r in ranking) == 4
    assert [r["ranking"] for r in ranking] == [1, 1, 1, 1, 2, 3, 4, 5, 6]


def test_selection_and_folds(ready):
    chosen, ranking, scores = selection.select_features(
        ready.train, "row_id", "pago", ready.features, "importance", 3, TINY, 3
    )
    assert len(chosen) == 3 and ranking.count() == len(ready.features)
    mean, std = selection.cv_summary(scores)
    assert scores.count() == 3 and 0 <= mean <= 1 and std >= 0
    with pytest.raises(ValueError):
        selection.select_features(ready.train, "row_id", "pago", ready.features, "lasso")


def test_combined_features():
    assert selection.combine_features(list("abcdefg"), list("cxayz"), 5) == list("abcdexyz")
    assert selection.in_schema_order(["z", "a"], ["a", "b", "z"]) == ["a", "z"]


def test_training_plans(ready, spark, tmp_path):
    names = [f for f in ready.features if f.startswith(("contacto", "duracion", "rango"))]
    result = training.train_and_evaluate_models(
        ready.train, ready.test, "pago", ready.features, names[:6], names[-6:], TINY,
        models=[models.LOGISTIC, models.BOOSTING], output=str(tmp_path / "base"),
    )
    assert result.metrics.count() == 3 * 2 * 2
    assert result.best[0] == "combinado"
    best = max(
        (r["roc_auc"], r["model"]) for r in result.metrics.where("split = 'test' and method = 'combinado'").collect()
    )
    assert result.best[1] == best[1]
    loaded = sinks.load_model(str(tmp_path / "base" / "best_model_selected_features"))
    assert models.score(loaded, ready.test, "pago").collect() == models.score(result.best_model, ready.test, "pago").collect()
    table = spark.read.option("header", True).csv(str(tmp_path / "base" / "train_test_comparison"))
    assert table.columns == ["Model", "Metric", "Train", "Test", "Difference", "pct_diff", "Method", "Process"]

    balanced = training.train_balanced_models(
        ready.train, ready.test, "row_id", "pago", names, TINY, models=[models.LOGISTIC], output=str(tmp_path / "balanced")
    )
    assert balanced.metrics.count() == 3 * 2
    for r in balanced.balance.where(F.col("stage") != "original").collect():
        assert r["pct"] == 50.0


def test_whole_run(spark, panel, tmp_path):
    source = str(tmp_path / "clientes.parquet")
    panel.drop("departamento").write.parquet(source)
    results = training.run(spark, source, str(tmp_path / "out"), FLAGS, TINY)
    assert set(results) == {"base", "balanced"}
    saved = spark.read.json(str(tmp_path / "out" / "metrics"))
    assert saved.count() == (3 + 3) * 4 * 2
    for name in ("preprocessor", "eda_report/outliers", "data_quality_report/findings", "base/selected_features"):
        assert (tmp_path / "out" / name).exists()
