"""The debtor-by-month panel ``clientes``, derived from order tables.

One row per order stands for one report row of a client. History columns need the client's
previous row; a client may own a large share of all rows, so history is computed in two levels:
inside (client, day), plus one carried row per client and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moralens.staging import stage

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("mes", T.StringType()),
        T.StructField("tipo_documento", T.StringType()),
        T.StructField("identificacion", T.LongType()),
        T.StructField("genero", T.StringType()),
        T.StructField("rango_edad_probable", T.StringType()),
        T.StructField("departamento", T.StringType()),
        T.StructField("saldo_capital", T.DoubleType()),
        T.StructField("dias_mora", T.LongType()),
        T.StructField("banco", T.StringType()),
        T.StructField("antiguedad_deuda", T.TimestampNTZType()),
        T.StructField("pago_mes_anterior", T.IntegerType()),
        T.StructField("meses_desde_ultimo_pago", T.IntegerType()),
        T.StructField("sin_pago_previo", T.IntegerType()),
        T.StructField("contacto_mes_actual", T.IntegerType()),
        T.StructField("contacto_mes_anterior", T.IntegerType()),
        T.StructField("contacto_ultimos_6meses", T.IntegerType()),
        T.StructField("duracion_llamadas_ultimos_6meses", T.LongType()),
        T.StructField("pago", T.IntegerType()),
    ]
)

TARGET = "pago"
ROW_ID = "row_id"
EXEMPT = ["row_id", "identificacion", "mes"]
BUSINESS_COLUMNS = [f.name for f in PANEL_SCHEMA.fields if f.name != ROW_ID]

COPY_EVERY = 500
COPY_OFFSET = 1_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy panel over the order tables in ``sf_dir``."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    places = (
        _table(spark, sf_dir, "nation")
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    orders = _table(spark, sf_dir, "orders").withColumn("dia", F.to_date("o_orderdate"))
    paid = (
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("c_acctbal") > 5000)
    ).cast("int")
    month_number = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    client_orders = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("pago", paid)
        .withColumn("mes_n", month_number)
        .withColumn("mes_pago", F.when(F.col("pago") == 1, F.col("mes_n")))
    )

    position = F.struct("o_orderdate", "o_orderkey")
    earlier_days = Window.partitionBy("o_custkey").orderBy("dia")
    carried = (
        client_orders.groupBy("o_custkey", "dia")
        .agg(F.max_by("pago", position).alias("ultimo_pago"), F.max("mes_pago").alias("mes_pago_dia"))
        .select(
            F.col("o_custkey").alias("k_cust"),
            F.col("dia").alias("k_dia"),
            F.lag("ultimo_pago").over(earlier_days).alias("pago_antes"),
            F.max("mes_pago_dia")
            .over(earlier_days.rowsBetween(Window.unboundedPreceding, -1))
            .alias("mes_pago_antes"),
        )
    )
    lines = (
        _table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lineas"),
            F.sum("l_quantity").alias("qty"),
            F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
            F.min("l_shipdate").alias("first_ship"),
        )
    )
    same_day = Window.partitionBy("o_custkey", "dia").orderBy("o_orderdate", "o_orderkey")
    history = (
        client_orders.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("pago_dia", F.lag("pago").over(same_day))
        .withColumn(
            "mes_pago_dia", F.max("mes_pago").over(same_day.rowsBetween(Window.unboundedPreceding, -1))
        )
        .join(carried, (F.col("o_custkey") == F.col("k_cust")) & (F.col("dia") == F.col("k_dia")))
        .withColumn("pago_prev", F.coalesce("pago_dia", "pago_antes"))
        .withColumn("mes_prev_pago", F.coalesce("mes_pago_dia", "mes_pago_antes"))
    )

    urgent = F.col("o_orderpriority") == "1-URGENT"
    balance = F.col("c_acctbal")
    copies = F.when(
        F.col("o_orderkey") % COPY_EVERY == 0, F.array(F.lit(0), F.lit(COPY_OFFSET))
    ).otherwise(F.array(F.lit(0)))
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    panel = history.select(
        F.col("o_orderkey").alias("row_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("mes"),
        F.when(F.col("o_custkey") % 50 == 0, "E").otherwise("C").alias("tipo_documento"),
        F.col("o_custkey").alias("identificacion"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(None).cast("string"))
        .when(F.col("c_mktsegment") == "BUILDING", " ")
        .when(F.col("c_mktsegment") == "FURNITURE", "HOMBRE")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "F")
        .otherwise("M")
        .alias("genero"),
        F.when(balance < 0, F.lit(None).cast("string"))
        .when(balance < 2500, "25-30")
        .when(balance < 5000, "31-35")
        .when(balance < 7500, "36-40")
        .otherwise("66+")
        .alias("rango_edad_probable"),
        F.when(F.col("o_custkey") % 4 != 3, F.col("n_name")).alias("departamento"),
        F.col("o_totalprice").alias("saldo_capital"),
        F.col("qty").cast("bigint").alias("dias_mora"),
        F.col("r_name").alias("banco"),
        F.when(F.col("o_orderkey") % 10 >= 7, F.col("first_ship")).alias("antiguedad_deuda"),
        F.coalesce("pago_prev", F.lit(0)).alias("pago_mes_anterior"),
        (F.col("mes_n") - F.col("mes_prev_pago")).alias("meses_desde_ultimo_pago"),
        flag(F.col("mes_prev_pago").isNull()).alias("sin_pago_previo"),
        flag(urgent & (F.col("n_a") > 1)).alias("contacto_mes_actual"),
        flag(F.col("n_r") > 1).alias("contacto_mes_anterior"),
        F.when(F.col("n_lineas").isNotNull(), flag(F.col("n_a") + F.col("n_r") > 2)).alias(
            "contacto_ultimos_6meses"
        ),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("n_lineas") * 60)
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("duracion_llamadas_ultimos_6meses"),
        "pago",
        F.explode(copies).alias("_copy"),
    )
    return panel.select((F.col("row_id") + F.col("_copy")).alias("row_id"), *panel.columns[1:-1])


_panels: dict[tuple[str, str], DataFrame] = {}


def staged_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written once per application and folder, so every report reads columns from Parquet."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _panels:
        _panels[key] = stage(build_panel(spark, sf_dir), "clientes")
    return _panels[key]
