"""Queries: scans, profiles, schema discovery, sinks."""

from pyspark.sql import functions as F

from flowloom.functions.numeric import benign_vs_attack, finite_or_null
from flowloom.plans.prepare import data_profile as profile_row
from flowloom.session import shared_dir
from flowloom.sources import parquet as P
from flowloom.sources import rebuild as B
from flowloom.sources import sinks as W
from flowloom.sources import zones as Z
from flowloom.workload.inputs import FEATURES, flows, history, preds, table, vectors, with_
from flowloom.workload.registry import query, r
from flowloom.workload.stats import KEPT, _scaled, prep_ctes, prepared

LABELS = ("class", " L_ReturnFlag ")
IDS = ("L_OrderKey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_shipdate")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("scan_flows", "SELECT l_returnflag, count(*) AS n, " + r("sum(l_quantity)") + " AS qty FROM lineitem GROUP BY 1")
def scan_flows(spark, sf):
    rows = P.scan_flows(spark, sf, "lineitem.parquet")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("qty"))


_REQUIRED = ("l_orderkey", "l_quantity", "l_returnflag")


@query("schema_consistency", "SELECT t.f || '.parquet' AS file, count(q.c)::INT AS n_missing, coalesce(string_agg(q.c, ',' ORDER BY q.c), '') AS missing "
       f"FROM (SELECT unnest({TABLES}) AS f) t LEFT JOIN (SELECT unnest({list(_REQUIRED)}) AS c) q ON NOT EXISTS "
       "(SELECT 1 FROM information_schema.columns i WHERE i.table_name = t.f AND i.column_name = q.c) GROUP BY 1")
def schema_consistency(spark, sf):
    return P.schema_consistency(spark, sf, _REQUIRED)


@query("file_profile")
def file_profile(spark, sf):
    return P.file_profile(spark, sf)


_ROWS = " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS n_rows, 1::BIGINT AS n_files FROM {t}" for t in TABLES)


@query("file_row_counts", f"WITH f AS ({_ROWS}) SELECT * FROM f UNION ALL SELECT NULL, sum(n_rows)::BIGINT, count(*) FROM f")
def file_row_counts(spark, sf):
    return P.file_profile(spark, sf).select("file", "n_rows", "n_files")


@query("distinct_schemas", "SELECT string_agg(column_name, ',' ORDER BY ordinal_position) AS column_list, 1::BIGINT AS n_files, any_value(n)::BIGINT AS n_rows "
       "FROM information_schema.columns JOIN (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TABLES)
       + ") ON t = table_name GROUP BY table_name")
def distinct_schemas(spark, sf):
    return P.distinct_schemas(spark, sf)


@query("projected_scan", with_("flows") + "SELECT " + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in FEATURES) + " FROM flows")
def projected_scan(spark, sf):
    return P.projected_scan(flows(spark, sf), FEATURES)


_ZONED = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
_RANGES = {"l_orderkey": (100, None), "l_quantity": (10, 20)}


@query("zone_maps", " UNION ALL ".join(f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows FROM lineitem""" for c in _ZONED))
def zone_maps(spark, sf):
    zones = Z.zone_maps(spark, sf, "lineitem.parquet").filter(F.col("column").isin(*_ZONED))
    return zones.groupBy("column").agg(*[f(c).alias(c) for f, c in ((F.min, "low"), (F.max, "high"), (F.sum, "n_null"), (F.sum, "n_rows"))])


@query("zoned_scan", f"SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _ZONED)} FROM lineitem WHERE l_orderkey >= 100 AND l_quantity BETWEEN 10 AND 20")
def zoned_scan(spark, sf):
    return Z.zoned_scan(Z.zone_maps(spark, sf, "lineitem.parquet"), _ZONED, _RANGES)


_MEASURES = ("f_price", "f_sparse", "f_cust")


@query("feature_table_rebuild", with_("flows") + f"""SELECT row_key, {', '.join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in _MEASURES)},
 CASE WHEN label = '1-URGENT' THEN 2 ELSE 1 END::BIGINT AS built_at FROM flows""")
def feature_table_rebuild(spark, sf):
    """The rows of one label arrive in new files after the first version; the parts of the other files stay."""
    source, root = shared_dir(spark, "source"), shared_dir(spark, "rebuilt")
    rows = flows(spark, sf)
    late = F.col("label") == "1-URGENT"
    for arrived in (~late, late):
        rows.filter(arrived).write.mode("append").parquet(source)
        B.rebuild(spark, source, root, lambda df: df.select("row_key", B.PART, *[finite_or_null(c).alias(c) for c in _MEASURES]))
    return B.read_features(spark, root)


@query("feature_table_sink", prep_ctes() + "SELECT row_key, split, " + ", ".join(f"{_scaled(c)} AS {c}" for c in KEPT) + " FROM split WHERE split <> 'test'")
def feature_table_sink(spark, sf):
    prep = prepared(spark, sf)
    chosen = prep.scaled.filter(F.col("split") != "test")  # a split is a column of the rows, no join is needed
    back = W.write_feature_table(
        chosen.select("row_key", "split", *prep.scaler.columns), shared_dir(spark, "features"), partition_by=["split"],
    )
    return back.select("row_key", "split", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in KEPT])


def _fingerprint(where: str) -> str:
    return f"""SELECT count(*)::INT AS n_features,
 sha256(string_agg("column", chr(10) ORDER BY ordinal) || chr(10) || 'label=label') AS schema_hash,
 sha256(string_agg("column" || ':' || printf('%.9f', lo) || ':' || printf('%.9f', hi) || ':' || printf('%.8e', mean), chr(10) ORDER BY ordinal)) AS scaler_hash
 FROM scaler WHERE {where}"""


_KEPT_LIST = ", ".join(f"'{c}'" for c in KEPT)


@query("cache_manifest", prep_ctes() + f""", fp AS ({_fingerprint(f'"column" IN ({_KEPT_LIST})')})
 SELECT fp.*, (SELECT count(*) FROM orders) AS n_rows_in_dataset, 1::BIGINT AS n_files, (SELECT count(*) FROM split) AS n_rows_cached FROM fp""")
def cache_manifest(spark, sf):
    prep = prepared(spark, sf)
    kept = prep.stats.join(prep.drops.select("column"), "column", "left_anti")
    n = prep.rows.agg(F.count(F.lit(1)).alias("n_rows"))
    manifest = W.cache_manifest(W.schema_fingerprint(kept, "label"), P.file_profile(spark, sf, "orders.parquet"), n)
    return manifest.drop("bytes")  # SQL cannot see file sizes


@query("schema_fingerprint", prep_ctes() + _fingerprint("true"))
def schema_fingerprint(spark, sf):
    prep = prepared(spark, sf)
    return W.schema_fingerprint(prep.stats, "label")


@query("data_profile", prep_ctes() + """, per AS (SELECT label, count(*) AS n FROM split GROUP BY 1)
 SELECT count(*) AS total_rows, 3 AS n_features, (SELECT count(*) FROM per)::INT AS num_class,
 (SELECT string_agg(label || '=' || n, ';' ORDER BY label) FROM per) AS class_counts,
 count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
 count(*) * 12 AS cache_bytes, (SELECT count(*) FROM orders) AS total_rows_in_dataset FROM split""")
def data_profile(spark, sf):
    n = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n_rows"))
    return profile_row(prepared(spark, sf), n, "label")


@query("prediction_sink", with_("hard") + f"SELECT row_key, y_true, y_pred, {r('y_prob[y_true + 1]')} AS p_true FROM hard")
def prediction_sink(spark, sf):
    from flowloom.functions.vectors import argmax_class, prob_of

    back = W.write_table(preds(spark, sf), shared_dir(spark, "predictions"))
    return back.select("row_key", "y_true", argmax_class("y_prob").alias("y_pred"), F.round(prob_of("y_prob", "y_true"), 6).alias("p_true"))


@query("csv_sink_r6", with_("flows") + f"SELECT row_key, label, {r('CASE WHEN isfinite(f_price / 7) THEN f_price / 7 END')} AS v, f_sparse FROM flows")
def csv_sink_r6(spark, sf):
    path = shared_dir(spark, "csv")
    W.write_csv(flows(spark, sf).select("row_key", "label", (F.col("f_price") / 7).alias("v"), "f_sparse"), path)
    return spark.read.schema("row_key long, label string, v double, f_sparse double").option("header", True).csv(path)


_LATE = "epoch > 15"


@query("union_fields_csv", with_("history") + f"""SELECT epoch::VARCHAR AS epoch, session_id, CASE WHEN {_LATE} THEN is_partial::VARCHAR ELSE '' END AS is_partial FROM history""")
def union_fields_csv(spark, sf):
    h = history(spark, sf)
    early = h.filter(F.col("epoch") <= 15).select("epoch", "session_id")
    late = h.filter(F.col("epoch") > 15).select("epoch", "session_id", "is_partial")
    return W.union_fields([early, late])


# ------------------------------------------------------------------ schema discovery
def _lineitem(spark, sf):
    return table(spark, sf, "lineitem")


@query("resolve_label_column", "SELECT 'l_returnflag' AS label_column, 'column_candidate: L_ReturnFlag ' AS how, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 3")
def resolve_label_column(spark, sf):
    df = _lineitem(spark, sf)
    column, how = P.resolve_label(df.columns, LABELS)
    return df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(column).alias("label_column"), F.lit(how).alias("how"), "label", "n"
    )


@query("normalise_names", "SELECT l_returnflag, " + r("sum(l_tax)") + " AS tax FROM lineitem GROUP BY 1")
def normalise_names(spark, sf):
    df = _lineitem(spark, sf)
    blank = df.toDF(*[f" {c.upper()} " for c in df.columns])
    return P.normalised(blank).groupBy("l_returnflag").agg(F.round(F.sum("l_tax"), 6).alias("tax"))


@query("drop_identifiers", "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem")
def drop_identifiers(spark, sf):
    return P.drop_identifiers(_lineitem(spark, sf), IDS)


def _schema(spark, sf):
    return P.discover_schema(_lineitem(spark, sf), LABELS, IDS)


@query("numeric_features", "SELECT l_returnflag, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem GROUP BY 1")
def numeric_features(spark, sf):
    s = _schema(spark, sf)
    return _lineitem(spark, sf).groupBy(s.label).agg(*[F.round(F.avg(c), 6).alias(c) for c in s.features])


@query("prune_schema", "SELECT l_quantity, l_extendedprice, l_tax, l_returnflag FROM lineitem")
def prune_schema(spark, sf):
    s = _schema(spark, sf).pruned([("l_discount", "double", "constant_on_train")])
    return P.prune_schema(_lineitem(spark, sf), s)


@query("binary_label", "SELECT vec_id AS row_key, CASE WHEN label <> 0 THEN 1 ELSE 0 END AS is_attack FROM embeddings")
def binary_label(spark, sf):
    return vectors(spark, sf).select("row_key", benign_vs_attack("y_true", 0).alias("is_attack"))
