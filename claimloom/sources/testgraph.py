"""A graph of facts and claims over the star-schema test tables, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 10**12


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fact(df: DataFrame, kind: int, key: str, subject, relation: str, obj) -> DataFrame:
    return df.select((F.lit(kind * STEP) + F.col(key).cast("long")).alias("ord"), subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, subject, relation, object: orders placed by customers, customers and suppliers in nations, nations in regions, parts made by brands."""
    t = lambda name: _table(spark, sf_dir, name)
    orders, customer, supplier, nation, region, part = (t(n) for n in ("orders", "customer", "supplier", "nation", "region", "part"))
    return (
        _fact(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), 1, "o_orderkey", F.concat(F.lit("Order#"), "o_orderkey"), "placed_by", F.col("c_name"))
        .unionAll(_fact(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), 2, "c_custkey", F.col("c_name"), "located_in", F.col("n_name")))
        .unionAll(_fact(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), 3, "s_suppkey", F.col("s_name"), "located_in", F.col("n_name")))
        .unionAll(_fact(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), 4, "n_nationkey", F.col("n_name"), "part_of", F.col("r_name")))
        .unionAll(_fact(part, 5, "p_partkey", F.concat(F.lit("Part#"), "p_partkey"), "made_by", F.col("p_brand")))
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim for each order: ord, year, subject, relation, object. By the order's key: every 11th denies, every 7th is about nobody, every 5th names another customer, the rest are right, some in other words."""
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    n, low = customer.agg(F.count(F.lit(1)), F.min("c_custkey")).first()
    names = customer.select("c_custkey", "c_name")
    key = F.col("o_orderkey")
    rows = orders.withColumn("other", F.lit(low) + F.pmod(F.col("o_custkey") - low + 1, F.lit(max(n, 1))))
    rows = rows.join(names, F.col("o_custkey") == F.col("c_custkey")).join(names.toDF("k2", "other_name"), F.col("other") == F.col("k2"))
    relation = F.when(key % 11 == 0, "not_placed_by").when((key % 7 == 0) | (key % 5 == 0), "placed_by").when(key % 2 == 0, "was_placed_by").otherwise("placed_by")
    subject = F.when((key % 11 != 0) & (key % 7 == 0), F.concat(F.lit("Ghost#"), key)).otherwise(F.concat(F.lit("Order#"), key))
    obj = F.when((key % 11 == 0) | (key % 7 == 0), F.col("c_name")).when(key % 5 == 0, F.col("other_name")).when(key % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
    return rows.select(key.cast("long").alias("ord"), F.year("o_orderdate").alias("year"), subject.alias("subject"), relation.alias("relation"), obj.alias("object"))


def norm(x: str) -> str:
    """SQL for normalize()."""
    return rf"trim(regexp_replace(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'))"


def norm_relation(x: str) -> str:
    """SQL for normalize_relation()."""
    snake = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({x})), '[\s-]+', '_', 'g'), '[^\p{{L}}\p{{N}}_]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({snake}, '^(is|was|were|be|being|been)_', ''), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


FACTS_SQL = f"""
SELECT 1 * {STEP} + o_orderkey AS ord, 'Order#' || o_orderkey AS subject, 'placed_by' AS relation, c_name AS object FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 2 * {STEP} + c_custkey, c_name, 'located_in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 3 * {STEP} + s_suppkey, s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 4 * {STEP} + n_nationkey, n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 5 * {STEP} + p_partkey, 'Part#' || p_partkey, 'made_by', p_brand FROM part
"""
CLAIMS_SQL = """
SELECT o_orderkey AS ord, year(o_orderdate)::INT AS year,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 THEN 'Ghost#' ELSE 'Order#' END || o_orderkey AS subject,
  CASE WHEN o_orderkey % 11 = 0 THEN 'not_placed_by' WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'placed_by' WHEN o_orderkey % 2 = 0 THEN 'was_placed_by' ELSE 'placed_by' END AS relation,
  CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN a.c_name WHEN o_orderkey % 5 = 0 THEN b.c_name WHEN o_orderkey % 3 = 0 THEN upper(a.c_name) ELSE a.c_name END AS object
FROM orders, (SELECT count(*) AS n, min(c_custkey) AS low FROM customer) s
JOIN customer a ON o_custkey = a.c_custkey
JOIN customer b ON b.c_custkey = low + (o_custkey - low + 1) % n
"""
GRAPH_SQL = f"""
WITH facts AS ({FACTS_SQL}), claims AS ({CLAIMS_SQL}),
f AS (SELECT *, {norm("subject")} AS s, {norm_relation("relation")} AS r, {norm("object")} AS o FROM facts),
c AS (SELECT *, {norm("subject")} AS s, {norm_relation("relation")} AS r, {norm("object")} AS o FROM claims)
"""
