"""The two portfolio reports over the panel ``clientes``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_clients(panel: DataFrame, n: int = 10) -> DataFrame:
    """Clients with the largest outstanding principal; one row per distinct description of a client."""
    keys = ["identificacion", "tipo_documento", "genero", "departamento", "banco"]
    return (
        panel.groupBy(*keys)
        .agg(F.max("saldo_capital").alias("max_saldo_capital"), F.max("dias_mora").alias("max_dias_mora"))
        .orderBy(F.desc("max_saldo_capital"), "identificacion", *keys[1:])
        .limit(n)
    )


def average_payers(panel: DataFrame) -> DataFrame:
    """Average number of distinct paying clients per month, by department."""
    monthly = (
        panel.where(F.col("pago") == 1)
        .groupBy("mes", "departamento")
        .agg(F.count_distinct("identificacion").alias("clientes_con_pago"))
    )
    return (
        monthly.groupBy("departamento")
        .agg(
            F.round(F.avg("clientes_con_pago"), 2).alias("promedio_clientes_con_pago"),
            F.count("mes").alias("meses_evaluados"),
        )
        .orderBy(F.desc("promedio_clientes_con_pago"), "departamento")
    )
