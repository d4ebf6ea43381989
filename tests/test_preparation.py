"""Imputation, scaling, encoding, the load gate and the sinks."""

import pytest
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from moralens.operators import preparation, sparse_encoding
from moralens.operators import preparation as prep
from moralens.sources import readers, sinks


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(
        [(1, 1.0, 1, "a", 7.0), (2, None, 0, "b", 7.0), (3, 3.0, None, None, 7.0), (4, 5.0, 1, "a", 7.0)],
        "row_id bigint, x double, f int, c string, flat double",
    )


@pytest.fixture(scope="module")
def test_rows(spark):
    return spark.createDataFrame(
        [(5, None, None, "z", None), (6, 3.0, 1, "b", 9.0)], "row_id bigint, x double, f int, c string, flat double"
    )


def test_manual_preprocessing(train, test_rows):
    a, b, names = prep.manual_preprocessing(train, test_rows, ["x", "flat"], ["f"], ["c"], ("row_id",))
    assert names == [
        "x_scaled", "x_flag", "flat_scaled", "flat_flag", "f_imputed", "f_flag", "c_a", "c_b", "c_missing", "c_flag",
    ]
    first, second = b.orderBy("row_id").collect()
    assert first["x_scaled"] == 0.0 and first["x_flag"] == 1  # median 3 equals the mean of the filled column
    assert (first["c_a"], first["c_b"], first["c_missing"]) == (0, 0, 0)  # unseen category
    assert second["flat_scaled"] == 2.0  # zero variance divides by one
    assert [r["f_imputed"] for r in a.orderBy("row_id").collect()] == [1, 0, 0, 1]
    values = [r["x_scaled"] for r in a.collect()]
    assert sum(v * v for v in values) / len(values) == pytest.approx(1.0)


def test_preprocessor_survives_saving(train, test_rows, tmp_path):
    fitted = prep.create_preprocessor(["x"], "f", ["c"]).fit(train)
    path = sinks.save_model(fitted, str(tmp_path / "model"))
    loaded = sinks.load_model(path)
    assert prep.feature_names(loaded) == prep.feature_names(fitted)
    assert loaded.transform(test_rows).collect() == fitted.transform(test_rows).collect()


def test_flags_can_be_transformed_too(train, test_rows):
    fitted = prep.create_preprocessor(["x"], ["f"], ["c"], transform_flags=True).fit(train)
    assert prep.feature_names(fitted) == [
        "x_scaled", "x_flag", "f_imputed", "f_flag", "c_a", "c_b", "c_missing", "c_flag_0", "c_flag_1",
    ]
    first, second = fitted.transform(test_rows).orderBy("row_id").collect()
    spread = (0.25 * 0.75) ** 0.5  # one gap in four rows
    assert first["x_flag"] == pytest.approx(0.75 / spread) and second["x_flag"] == pytest.approx(-0.25 / spread)
    assert (first["c_flag_0"], first["c_flag_1"]) == (1, 0)


def test_preprocessor_errors(train):
    with pytest.raises(ValueError):
        prep.create_preprocessor(None, [], [])
    with pytest.raises(ValueError):
        prep.create_preprocessor(["absent"], [], []).fit(train)


def test_imputation_strategies(spark):
    df = spark.createDataFrame([(1, 4, "b"), (2, 4, "a"), (3, 2, "b"), (4, 2, "a"), (5, None, None)], "row_id int, x int, c string")
    last = lambda out: out[0].where("row_id = 5").first()
    assert last(prep.impute_with_flags(df, numeric_strategy="mean"))["x"] == 3.0
    assert last(prep.impute_with_flags(df, numeric_strategy="median"))["x"] == 3.0
    row = last(prep.impute_with_flags(df, numeric_strategy="mode"))
    assert (row["x"], row["c"], row["x_imputed"]) == (2.0, "a", 1)  # ties: the smallest value
    row = last(prep.impute_with_flags(df, numeric_strategy="constant", categorical_strategy="constant"))
    assert (row["x"], row["c"]) == (0.0, "Unknown")
    flagged, info = prep.imputation_flags(df, ["x", "absent", "row_id"], "missing_mask", "_gap")
    assert flagged.columns[-1] == "x_gap" and [r["missing_count"] for r in info.collect()] == [1]
    for options in ({"numeric_strategy": "zero"}, {"categorical_strategy": "first"}):
        with pytest.raises(ValueError):
            prep.impute_with_flags(df, **options)
    with pytest.raises(ValueError):
        prep.imputation_flags(df, strategy="other")


def test_all_null_column_gets_defaults(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "row_id int, x double, c string")
    row = prep.impute_with_flags(df, numeric_strategy="median")[0].first()
    assert (row["x"], row["c"]) == (0.0, "Unknown")


def write(df, path, kind="parquet"):
    getattr(df.write.option("header", True), kind)(str(path))
    return str(path)


def test_load_gate(spark, panel, tmp_path):
    path = write(panel, tmp_path / "clientes.parquet")
    loaded = readers.load_data(spark, path, ["identificacion"], report_path=str(tmp_path / "report"))
    assert loaded.data.count() == panel.count()
    assert loaded.profile.first()["total_columns"] == 18
    saved = spark.read.json(str(tmp_path / "report" / "columns"))
    assert saved.count() == 18
    as_csv = write(panel.select("row_id", "mes", "saldo_capital", "pago"), tmp_path / "part.csv", "csv")
    schema = "row_id bigint, mes string, saldo_capital double, pago int"
    from pyspark.sql.types import _parse_datatype_string

    assert readers.load_data(spark, as_csv, schema=_parse_datatype_string(schema)).data.count() == panel.count()
    as_json = write(panel.select("row_id", "mes", "pago"), tmp_path / "part.json", "json")
    assert readers.load_data(spark, as_json).data.count() == panel.count()


def test_load_gate_refuses(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    with pytest.raises(FileNotFoundError):
        readers.load_data(spark, str(tmp_path / "absent.parquet"))
    with pytest.raises(ValueError, match="extension"):
        readers.load_data(spark, write(frame([(1,)], "pago int"), tmp_path / "table.orc", "parquet"))
    with pytest.raises(ValueError, match="no rows"):
        readers.load_data(spark, write(frame([], "pago int"), tmp_path / "none.parquet"))
    with pytest.raises(ValueError, match="more than the limit"):
        readers.load_data(spark, write(frame([(1,)], "pago int"), tmp_path / "big.parquet"), max_bytes=1)
    with pytest.raises(ValueError, match="similar: pago_"):
        readers.load_data(spark, write(frame([(1,)], "Pago_ int"), tmp_path / "near.parquet"))
    with pytest.raises(ValueError, match="target_constant"):
        readers.load_data(spark, write(frame([(1, 0), (2, 0)], "a int, pago int"), tmp_path / "const.parquet"))
    with pytest.raises(ValueError, match="collide"):
        readers.check_names(["A", " a", "pago"])
    with pytest.raises(TypeError):
        readers.validate_dataframe([1, 2])


def test_text_sink_keeps_the_order(spark, tmp_path):
    path = sinks.write_lines(spark, ["b", "a"], str(tmp_path / "names"))
    assert [r["value"] for r in spark.read.text(path).collect()] == ["1. b", "2. a"]


def test_panel_sink_prunes_months(spark, panel, tmp_path):
    path = sinks.write_panel(panel, str(tmp_path / "clientes"))
    plan = spark.read.parquet(path).where(F.col("mes") == "1996-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes" in plan
    assert spark.read.parquet(path).count() == panel.count()


def test_a_column_of_many_categories_encodes(spark):
    n = 300_000
    table = spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("many"),
        F.when(F.col("id") % 2 == 0, "x").alias("few"),
    )
    encoder = sparse_encoding.fit_categories(table, ["many", "few"])
    assert encoder.size == 200_001 + 2
    vectors = encoder.transform(table, "row_id")
    assert isinstance(vectors.schema["categories"].dataType, VectorUDT) and vectors.count() == n
    places = {r["name"]: r["pos"] for r in encoder.names().where(F.col("name").isin("many_hot", "few_x", "few_missing", "many_v1")).collect()}
    assert places["few_missing"] == encoder.size - 2 and places["few_x"] == encoder.size - 1 and places["many_hot"] == 0
    for r in vectors.where(F.col("row_id").isin(0, 1, 3)).collect():
        own = {0: ("many_hot", "few_x"), 1: ("many_v1", "few_missing"), 3: ("many_hot", "few_missing")}[r["row_id"]]
        assert sorted(r["categories"].indices) == sorted(places[k] for k in own) and r["categories"].size == encoder.size
    new = spark.createDataFrame([(7, "never seen", None), (8, None, "nor this")], "row_id bigint, many string, few string")
    found = {r["row_id"]: list(r["categories"].indices) for r in encoder.transform(new, "row_id").collect()}
    assert found == {7: [places["few_missing"]], 8: []}
    assert encoder.transform(new.where("row_id > 9"), "row_id").count() == 0


def test_names_of_categories_are_unique(spark):
    table = spark.createDataFrame([("b_c", "x"), ("d", "c")], "a string, a_b string")
    with pytest.raises(ValueError, match="share the column names"):
        preparation.OneHotColumns(inputCols=["a", "a_b"]).fit(table)
    assert sparse_encoding.fit_categories(table, ["a", "a_b"]).size == 4


def test_wide_columns_are_sent_to_the_sparse_encoder(spark, monkeypatch):
    monkeypatch.setattr(preparation, "MAX_CATEGORIES", 3)
    table = spark.range(6).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    assert preparation.OneHotColumns(inputCols=["b"]).fit(table).output_columns()[:3] == ["b_0", "b_1", "b_2"]
    with pytest.raises(ValueError, match="sparse_encoding"):
        preparation.OneHotColumns(inputCols=["a", "b"]).fit(table)
