WITH li AS (
  SELECT l_orderkey, COUNT(*) AS n_lineas, SUM(l_quantity) AS qty,
         SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS n_a,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r,
         MIN(l_shipdate) AS first_ship
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_totalprice, o.o_orderpriority,
         substring(CAST(o.o_orderdate AS STRING), 1, 7) AS mes,
         CAST(year(o.o_orderdate) * 12 + month(o.o_orderdate) AS INT) AS mes_n,
         c.c_mktsegment, c.c_acctbal, n.n_name, r.r_name,
         li.n_lineas, li.qty, li.n_a, li.n_r, li.first_ship,
         CASE WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT'
               AND c.c_acctbal > 5000 THEN 1 ELSE 0 END AS pago
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
hist AS (
  SELECT base.*,
         LAG(pago) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pago_prev,
         MAX(CASE WHEN pago = 1 THEN mes_n END) OVER (PARTITION BY o_custkey
             ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mes_n_prev_pago
  FROM base),
panel AS (
  SELECT o_orderkey AS row_id, mes,
    CASE WHEN o_custkey % 50 = 0 THEN 'E' ELSE 'C' END AS tipo_documento,
    o_custkey AS identificacion,
    CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'BUILDING' THEN ' '
         WHEN 'FURNITURE' THEN 'HOMBRE' WHEN 'HOUSEHOLD' THEN 'F' ELSE 'M' END AS genero,
    CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 2500 THEN '25-30' WHEN c_acctbal < 5000 THEN '31-35'
         WHEN c_acctbal < 7500 THEN '36-40' ELSE '66+' END AS rango_edad_probable,
    CASE WHEN o_custkey % 4 = 3 THEN NULL ELSE n_name END AS departamento,
    o_totalprice AS saldo_capital,
    CAST(qty AS BIGINT) AS dias_mora,
    r_name AS banco,
    CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE first_ship END AS antiguedad_deuda,
    COALESCE(pago_prev, 0) AS pago_mes_anterior,
    mes_n - mes_n_prev_pago AS meses_desde_ultimo_pago,
    CASE WHEN mes_n_prev_pago IS NULL THEN 1 ELSE 0 END AS sin_pago_previo,
    CASE WHEN o_orderpriority = '1-URGENT' AND n_a > 1 THEN 1 ELSE 0 END AS contacto_mes_actual,
    CASE WHEN n_r > 1 THEN 1 ELSE 0 END AS contacto_mes_anterior,
    CASE WHEN n_lineas IS NULL THEN NULL WHEN n_a + n_r > 2 THEN 1 ELSE 0 END AS contacto_ultimos_6meses,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(n_lineas * 60 AS BIGINT) ELSE 0 END
      AS duracion_llamadas_ultimos_6meses,
    pago
  FROM hist)
SELECT * FROM panel
UNION ALL
SELECT row_id + 1000000000 AS row_id, mes, tipo_documento, identificacion, genero, rango_edad_probable,
  departamento, saldo_capital, dias_mora, banco, antiguedad_deuda, pago_mes_anterior,
  meses_desde_ultimo_pago, sin_pago_previo, contacto_mes_actual, contacto_mes_anterior,
  contacto_ultimos_6meses, duracion_llamadas_ultimos_6meses, pago
FROM panel WHERE row_id % 500 = 0
