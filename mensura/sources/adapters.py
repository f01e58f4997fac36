"""Logical tables of the takeoff domain, derived from the warehouse tables.

Each adapter is one projection in SQL that both Spark and the oracle run, so a query and its oracle start from the same rows.
Rows of lineitem are ordered by ORDINAL, which is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDINAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

#: Layer and description words, chosen so that every branch of the matchers is reached.
LAYERS = ["fa_tabique", "a-arq-muro", "i-ele-alumbrado", "fa-cielo", "0", "dimen", "i-san-bano", "est-viga", "ventana", "puerta", "piso ceramico", "a-txt"]
ITEMS = ["Tabique divisorio", "Muro hormigon", "Piso cerámico", "Cielo raso", "Pintura muro", "Puerta acceso", "Ventana vitrina", "Enchufe doble", "Luminaria embutida", "Lavamanos con griferia", "Viga de acero", "Instalacion de faenas"]
UNITS = ["m2", "ml", "un", "gl", "m3", "kg", ""]


def _pick(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_BRAND = "CAST(substr(p_brand, 7) AS INT)"
LAYER = f"CASE WHEN {_BRAND} % 12 = 4 THEN '0' ELSE {_pick(f'{_BRAND} % 12', LAYERS)} || '-' || lower(p_type) END"

VIEWS = {
    "takeoff_rows": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {LAYER} AS layer,
  CASE l_linenumber WHEN 1 THEN 'Hatch' WHEN 2 THEN 'Polyline' WHEN 3 THEN 'Line' WHEN 4 THEN 'Arc' WHEN 5 THEN 'Circle' WHEN 6 THEN 'LwPolyline' ELSE 'Region' END AS name,
  l_quantity AS cnt, CASE WHEN l_linenumber IN (1, 2, 5, 6, 7) THEN l_extendedprice / 50 END AS area,
  CASE WHEN l_linenumber BETWEEN 2 AND 6 THEN l_extendedprice / 1000 END AS length, l_linestatus = 'F' AS closed,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS color
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "cad_items": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 4 WHEN 0 THEN 'area' WHEN 1 THEN 'length' WHEN 2 THEN 'block' ELSE 'text' END AS type,
  {LAYER} AS layer, p_name AS name_raw, n_name AS zone,
  CASE WHEN l_linenumber % 4 = 2 THEN l_quantity ELSE l_extendedprice / 1000 END AS value_si,
  CASE WHEN l_returnflag = 'A' THEN 'HATCH' WHEN l_returnflag = 'R' THEN 'polyline closed' ELSE NULL END AS evidence,
  CAST((l_partkey * 7919 + l_linenumber * 104729) % 1000 AS DOUBLE) / 10 AS x,
  CAST((l_orderkey * 6101 + l_suppkey * 3571) % 1000 AS DOUBLE) / 10 AS y
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "bill_items": f"""SELECT p_partkey AS row_index, {_pick("p_partkey % 12", ITEMS)} || ' ' || p_name AS description,
  {_pick("p_size % 7", UNITS)} AS unit, CAST(p_size AS DOUBLE) AS qty, p_retailprice AS price,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 1.05 END AS expected_qty
FROM part""",
    "staging_rows": """SELECT l_partkey AS id, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE sum(l_quantity) END AS qty_final,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE max(l_extendedprice) / 100 END AS unit_price_ref, 0.2 + (l_partkey % 9) * 0.1 AS match_confidence,
  CASE l_partkey % 6 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' WHEN 2 THEN 'pending_no_match' WHEN 3 THEN 'ignored' WHEN 4 THEN 'rejected' ELSE 'pending_semantics' END AS status,
  CASE WHEN l_partkey % 3 = 0 THEN 2.4 END AS height_factor, count(*) AS n_sources
FROM lineitem GROUP BY l_partkey""",
    "golden_predicted": """SELECT l_partkey AS row_index, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE sum(l_quantity) END AS qty FROM lineitem GROUP BY l_partkey""",
    "golden_expected": """SELECT l_partkey AS row_index, sum(l_quantity) * (0.8 + (l_partkey % 9) * 0.05) AS qty FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY l_partkey""",
    "snapshot_a": """SELECT o_orderkey AS id, CAST(o_custkey % 50 AS DOUBLE) AS qty_final, o_totalprice AS unit_price_ref, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN 2.4 END AS height_factor
FROM orders WHERE o_orderkey % 10 <> 0""",
    "snapshot_b": """SELECT o_orderkey AS id, CAST(o_custkey % 50 + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS qty_final,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS unit_price_ref, CASE WHEN o_orderkey % 5 = 0 THEN 'approved' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 8 = 0 THEN 2.4 END AS height_factor
FROM orders WHERE o_orderkey % 9 <> 0""",
    "matching_feedback": """SELECT event_id AS id, user_id, event_type AS item_text, CAST(user_id % 20 AS STRING) AS target,
  CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'modify' WHEN 'view' THEN 'manual' WHEN 'error' THEN 'reject' ELSE 'accept' END AS correction, value / 500 AS confidence, ts AS created_at
FROM events""",
    "batch_metrics": """SELECT user_id AS batch_id, sum(value) * 100 AS time_ms, 100 * avg(CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE)) AS accuracy, avg(value) AS cost, max(ts) AS created_at
FROM events GROUP BY user_id""",
    "learned_mappings": """SELECT c_mktsegment AS user_id, o_orderpriority AS layer, 'item ' || CAST(c_nationkey AS STRING) AS item_text, count(*) AS times_used, max(o_totalprice) / 500000 AS confidence, max(o_orderdate) AS last_used
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority, c_nationkey""",
    "price_sources": """SELECT l_partkey AS item, s_name AS vendor, l_extendedprice / l_quantity AS price, CASE WHEN l_suppkey % 2 = 0 THEN 'http://' || s_name WHEN l_suppkey % 3 = 0 THEN 'null' END AS url
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "points": """SELECT vec_id AS id, CAST(embedding[{one}] AS DOUBLE) * 50 AS x, CAST(embedding[{two}] AS DOUBLE) * 50 AS y, 'zone ' || CAST(label AS STRING) AS label FROM embeddings""",
    "segments": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 40 AS DOUBLE) AS x1, CAST(l_suppkey % 40 AS DOUBLE) AS y1,
  CAST(l_partkey % 40 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) AS x2, CAST(l_suppkey % 40 AS DOUBLE) + CAST(l_orderkey % 3 AS DOUBLE) AS y2, l_returnflag AS layer
FROM lineitem""",
    "grid_marks": """SELECT DISTINCT CAST(c_nationkey AS STRING) || '-' || c_mktsegment AS layer, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 89 AS DOUBLE) AS y, c_custkey % 7 = 0 AS square
FROM customer""",
    "drawing_rows": """SELECT l_orderkey AS file, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber AS INT) AS kind, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y,
  1.0 + l_linenumber + l_suppkey % 3 AS w, 1.0 + l_partkey % 5 AS h, CASE l_returnflag WHEN 'A' THEN 'Muro' WHEN 'R' THEN 'A-PISO' ELSE '0' END AS layer, CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS space
FROM lineitem""",
    "jobs": """SELECT event_id AS id, user_id AS batch_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'queued' END AS status, ts AS created_at FROM events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a DataFrame; Spark prunes and pushes down into the tables it reads."""
    import re

    sql = VIEWS[name].format(one=0, two=1) if name == "points" else VIEWS[name]
    tables = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings") if re.search(rf"\b{t}\b", sql)]
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL: the views as common table expressions, then the query (which may start with more of them)."""
    if not names:
        return sql.strip()
    own = [f"{n} AS ({(VIEWS[n].format(one=1, two=2) if n == 'points' else VIEWS[n]).replace('AS STRING', 'AS VARCHAR')})" for n in names]
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {', '.join(own)}, {sql[5:]}"
    return f"WITH {', '.join(own)} {sql}"


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A warehouse table as a stream of its files: those in its folder, or the one file that it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    source = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return source.parquet(f"{sf_dir}/{table}.parquet")
    return source.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
