"""Queries: labels."""

from pyspark.sql import functions as F

from flowloom.operators import labels as L
from flowloom.sources.parquet import rows_by_file
from flowloom.workload.inputs import MERGE, flows, table, with_
from flowloom.workload.registry import query

MERGED_SQL = "CASE WHEN o_orderpriority = '5-LOW' THEN '4-NOT SPECIFIED' ELSE o_orderpriority END"


@query("strip_labels", """SELECT label, count(*) AS n FROM (SELECT trim(o_orderstatus) AS label FROM orders) GROUP BY 1""")
def strip_labels(spark, sf):
    nbsp = " "
    dirty = table(spark, sf, "orders").select(
        F.concat(F.lit(f" {nbsp}"), "o_orderstatus", F.lit("\t")).alias("label")
    )
    return L.class_counts(L.strip_labels(dirty, "label"), "label")


@query("merge_labels", f"SELECT o_orderkey AS row_key, {MERGED_SQL} AS label FROM orders")
def merge_labels(spark, sf):
    return L.merge_labels(flows(spark, sf).select("row_key", "label"), "label", MERGE)


@query("encode_labels", """SELECT p_partkey AS row_key, p_brand AS label, code::SMALLINT AS code FROM part
 JOIN (SELECT p_brand AS b, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)) ON b = p_brand""")
def encode_labels(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("row_key"), F.col("p_brand").alias("label"))
    return L.encode_labels(part, "label").select("row_key", "label", "code")


@query("class_counts", """SELECT a.p_brand AS label, count(b.p_brand) AS n FROM (SELECT DISTINCT p_brand FROM part) a
 LEFT JOIN (SELECT p_brand FROM part WHERE p_size > 45 AND p_retailprice > 1500) b USING (p_brand) GROUP BY 1""")
def class_counts(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_brand", "label")
    large = part.filter((F.col("p_size") > 45) & (F.col("p_retailprice") > 1500))
    return L.class_counts(large, "label", L.class_table(part, "label"))


@query("label_merge_audit", f"""SELECT {MERGED_SQL} AS class, count(*) AS n,
 count(*) FILTER (o_orderpriority = '5-LOW') AS n_merged,
 coalesce(string_agg(DISTINCT CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority END, ','), '') AS merged_from FROM orders GROUP BY 1""")
def label_merge_audit(spark, sf):
    return L.label_merge_audit(flows(spark, sf), "label", MERGE)


@query("benign_class", """SELECT min(o_orderpriority) AS label FROM orders WHERE upper(o_orderpriority) = '1-URGENT'""")
def benign_class(spark, sf):
    classes = L.class_table(flows(spark, sf), "label")
    return L.benign_class(classes, "label", "1-urgent")


@query("label_count_reconcile", """SELECT 'orders.parquet' AS file, count(*) AS n_rows, count(o_orderstatus) AS n_labels,
 count(*) = count(o_orderstatus) AS ok FROM orders""")
def label_count_reconcile(spark, sf):
    orders = table(spark, sf, "orders")
    return L.label_count_reconcile(orders, "o_orderstatus", rows_by_file(orders))


@query("label_profile", with_("flows", more="c AS (SELECT label, count(*) AS n FROM flows GROUP BY 1)") + """SELECT label, n,
 round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS percent, first_value(label) OVER (ORDER BY n, label) AS rarest,
 (sum(n) OVER () // min(n) OVER ())::BIGINT AS imbalance FROM c""")
def label_profile(spark, sf):
    return L.label_profile(flows(spark, sf), "label")
