"""Input tables derived from the given ones, as DataFrames and as SQL common tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.vectors import softmax
from flowloom.functions.wavelet import DB4_HIGH, DB4_LOW, geometry
from flowloom.operators import anomaly
from flowloom.operators import sampling as S
from flowloom.operators.stats import column_stats, scaler_stats

K = 10  # classes of the prediction table
WIDTH = 64
GEOM = geometry(WIDTH)
SEED = 42
MERGE = {"5-LOW": "4-NOT SPECIFIED"}
FEATURES = ("f_price", "f_const", "f_copy", "f_sparse", "f_cust", "f_day")
NORMAL_BEFORE = "2024-01-16"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ flow table
def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a flow table with missing, infinite, constant, copied and sparse columns."""
    k = F.col("o_orderkey")
    price = (
        F.when(k % 17 == 0, F.lit(float("nan")))
        .when(k % 29 == 0, F.lit(float("inf")))
        .otherwise(F.col("o_totalprice"))
    )
    return table(spark, sf, "orders").select(
        k.alias("row_key"),
        F.col("o_orderpriority").alias("label"),
        price.alias("f_price"),
        F.lit(7.0).alias("f_const"),
        price.alias("f_copy"),
        F.when(k % 10 == 0, F.col("o_totalprice")).alias("f_sparse"),
        F.col("o_custkey").cast("double").alias("f_cust"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double").alias("f_day"),
    )


def flow_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.stratified_split(flows(spark, sf), "row_key", "label", seed=SEED)


def flow_scaler(spark: SparkSession, sf: str, key: str | None = None) -> DataFrame:
    return scaler_stats(column_stats(flow_split(spark, sf), FEATURES, key=key))


# ------------------------------------------------------------------ vectors and predictions
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_key"),
        F.col("label").cast("int").alias("y_true"),
        F.col("embedding").alias("features"),
    )


def vector_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.stratified_split(vectors(spark, sf), "row_key", "y_true", seed=SEED)


def logits(features: str = "features"):
    """K sums over all components: component i counts for class i modulo K."""
    parts = [[F.get(features, i).cast("double") for i in range(c, WIDTH, K)] for c in range(K)]
    return F.array(*[reduce(lambda a, b: a + b, p) for p in parts])


LOGITS_SQL = "[" + ", ".join(" + ".join(f"features[{i + 1}]::DOUBLE" for i in range(c, WIDTH, K)) for c in range(K)) + "]"


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax of the vectors folded into K logits as class probabilities."""
    p = softmax(logits())
    return vectors(spark, sf).select("row_key", "y_true", F.transform(p, lambda x: x.cast("float")).alias("y_prob"))


LABELLED_WIDTH = WIDTH + 1  # a width that needs padding


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with the label as one more component."""
    x = F.concat(F.transform("features", lambda v: v.cast("double")), F.array(F.col("y_true").cast("double")))
    return vectors(spark, sf).select("row_key", x.alias("x"))


# ------------------------------------------------------------------ events
def history(spark: SparkSession, sf: str) -> DataFrame:
    """Events per day as a training history."""
    from pyspark.sql import Window

    kind = F.col("event_type")
    days = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.avg("value").alias("train_mse_loss"),
        F.avg(F.when(kind == "purchase", F.col("value"))).alias("val_mse_loss"),
        (F.count_if(kind == "view") / F.count(F.lit(1))).alias("train_accuracy"),
        F.sum("value").alias("epoch_seconds"),
        (F.count(F.lit(1)) / F.sum("value")).alias("samples_per_second"),
        (F.max("value") * 10).alias("peak_rss_mb"),
        F.count_if(kind == "error").alias("_errors"),
    )
    epoch = F.dense_rank().over(Window.orderBy("day")).cast("int")
    return days.withColumn("epoch", epoch).select(
        "epoch",
        F.concat(F.lit("w"), F.floor((F.col("epoch") - 1) / 7).cast("string")).alias("session_id"),
        (F.lit(0.01) / F.col("epoch")).alias("learning_rate"),
        "train_mse_loss", "val_mse_loss", "train_accuracy", "epoch_seconds", "samples_per_second", "peak_rss_mb",
        (F.col("epoch") % 5 == 0).alias("is_partial"),
        F.when(F.col("epoch") % 10 == 0, F.col("_errors")).alias("resumed_after"),
        F.floor(F.col("epoch") / 4).cast("int").alias("progress"),
    )


def counters(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.windowed_counters(table(spark, sf, "events"), "user_id", "ts", "event_type", "value")


def features(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.counter_features(counters(spark, sf))


def normal(feats: DataFrame) -> DataFrame:
    return feats.filter(F.col("window_start") < F.lit(NORMAL_BEFORE).cast("timestamp_ntz"))


# ------------------------------------------------------------------ the same in SQL
def _finite(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


def _stats_rows() -> str:
    rows = []
    for i, c in enumerate(FEATURES):
        x = _finite(c)
        rows.append(
            f"SELECT {i} AS ordinal, '{c}' AS \"column\", count(*) AS n_rows, count({x}) AS n_finite, "
            f"count(*) - count({x}) AS n_missing, coalesce(sum(({x})::DECIMAL(18, 2))::DOUBLE, 0) AS total, min({x}) AS lo, max({x}) AS hi "
            "FROM train"
        )
    return " UNION ALL ".join(rows)


def split_cte(source: str, label: str, key: str = "row_key", seed: int = SEED) -> str:
    """SQL of an exact stratified split of ``source``."""
    return f"""SELECT * EXCLUDE (_rn, _n, _t, _v), CASE WHEN _rn <= _t THEN 'test' WHEN _rn <= _t + _v THEN 'val' ELSE 'train' END AS split
 FROM (SELECT *, round_even((_n - _t) * 0.15::DOUBLE, 0) AS _v
  FROM (SELECT *, round_even(_n * 0.3::DOUBLE, 0) AS _t
   FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}|' || {key}), {key}) AS _rn,
     count(*) OVER (PARTITION BY {label})::DOUBLE AS _n FROM {source})))"""


def _filter_sql(prev: str, taps: tuple[float, ...], step: int, n: int) -> str:
    terms = " + ".join(
        f"({h!r}::DOUBLE) * {prev}[((o + {step * (4 - m)} + {n}) % {n}) + 1]" for m, h in enumerate(taps)
    )
    return f"list_transform(range(0, {n}), lambda o: {terms})"


def swt_ctes(source: str, features_col: str, prefix: str = "", n: int = WIDTH) -> str:
    """Common tables w1, w2, w3 -> bands with columns d1, d2, d3, a3 next to those of ``source``."""
    out = [f"{prefix}w0 AS (SELECT *, list_transform({features_col}, lambda v: v::DOUBLE) AS a0 FROM {source})"]
    for lev in (1, 2, 3):
        s = 2 ** (lev - 1)
        out.append(
            f"{prefix}w{lev} AS (SELECT *, {_filter_sql(f'a{lev - 1}', DB4_HIGH, s, n)} AS d{lev}, "
            f"{_filter_sql(f'a{lev - 1}', DB4_LOW, s, n)} AS a{lev} FROM {prefix}w{lev - 1})"
        )
    return ", ".join(out)


CTES = {
    "flows": """SELECT o_orderkey AS row_key, o_orderpriority AS label,
 CASE WHEN o_orderkey % 17 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 29 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS f_price,
 7.0::DOUBLE AS f_const,
 CASE WHEN o_orderkey % 17 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 29 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS f_copy,
 CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice END AS f_sparse,
 o_custkey::DOUBLE AS f_cust, (o_orderdate::DATE - DATE '1990-01-01')::DOUBLE AS f_day FROM orders""",
    "split": split_cte("flows", "label"),
    "train": "SELECT * FROM split WHERE split = 'train'",
    "stats": _stats_rows(),
    "scaler": """SELECT ordinal, "column", n_rows, n_finite, n_missing, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi,
 CASE WHEN n_finite > 0 THEN total / n_finite ELSE 0 END AS mean, 1 - n_finite::DOUBLE / n_rows AS missing_ratio,
 coalesce(hi, 0) - coalesce(lo, 0) <= 0 AS is_constant FROM stats""",
    "vectors": "SELECT vec_id AS row_key, label::INT AS y_true, embedding AS features FROM embeddings",
    "vsplit": split_cte("vectors", "y_true"),
    "logits": f"SELECT row_key, y_true, {LOGITS_SQL} AS z FROM vectors",
    "expo": "SELECT row_key, y_true, list_transform(z, lambda v: exp(v - list_max(z))) AS ex FROM logits",
    "preds": "SELECT row_key, y_true, list_transform(ex, lambda v: (v / list_sum(ex))::FLOAT) AS y_prob FROM expo",
    "hard": "SELECT *, (list_position(y_prob, list_max(y_prob)) - 1)::INT AS y_pred FROM preds",
    "codes": f"SELECT unnest(range(0, {K}))::INT AS c",
    "cm": """SELECT a.c AS y_true, b.c AS y_pred, count(h.row_key) AS n FROM codes a CROSS JOIN codes b
 LEFT JOIN hard h ON h.y_true = a.c AND h.y_pred = b.c GROUP BY 1, 2""",
    "pc0": """SELECT c AS class, (SELECT sum(n) FROM cm WHERE y_true = c)::BIGINT AS support,
 (SELECT sum(n) FROM cm WHERE y_pred = c)::BIGINT AS predicted, (SELECT sum(n) FROM cm WHERE y_true = c AND y_pred = c)::BIGINT AS tp,
 (SELECT sum(n) FROM cm)::BIGINT AS total FROM codes""",
    "pc": """SELECT class, support, predicted, tp, predicted - tp AS fp, support - tp AS fn, total - support - predicted + tp AS tn,
 CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision,
 CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall,
 CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0 END AS f1,
 CASE WHEN total > support THEN (predicted - tp)::DOUBLE / (total - support) ELSE 0 END AS fpr FROM pc0""",
    "long": f"""SELECT p.row_key, p.y_true, c.c AS class, p.y_prob[c.c + 1] AS score, (p.y_true = c.c) AS hit
 FROM preds p CROSS JOIN codes c""",
    "counts": """SELECT class, score, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM long GROUP BY 1, 2""",
    "counts_micro": """SELECT class, score, pos, neg FROM counts UNION ALL
 SELECT -1, score, count(*) FILTER (hit), count(*) FILTER (NOT hit) FROM long GROUP BY 2""",
    "history": """SELECT epoch, 'w' || ((epoch - 1) // 7)::VARCHAR AS session_id, 0.01::DOUBLE / epoch AS learning_rate, train_mse_loss, val_mse_loss,
 train_accuracy, epoch_seconds, samples_per_second, peak_rss_mb, epoch % 5 = 0 AS is_partial,
 CASE WHEN epoch % 10 = 0 THEN errors END AS resumed_after, (epoch // 4)::INT AS progress
 FROM (SELECT dense_rank() OVER (ORDER BY ts::DATE)::INT AS epoch, avg(value) AS train_mse_loss,
  avg(value) FILTER (event_type = 'purchase') AS val_mse_loss,
  count(*) FILTER (event_type = 'view')::DOUBLE / count(*) AS train_accuracy, sum(value) AS epoch_seconds,
  count(*)::DOUBLE / sum(value) AS samples_per_second, max(value) * 10 AS peak_rss_mb,
  count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ts::DATE)""",
    "counters": """SELECT user_id AS switch, date_trunc('day', ts) AS window_start,
 count(*) FILTER (event_type = 'view') AS n_fi, count(*) FILTER (event_type = 'click') AS n_fo,
 count(*) FILTER (event_type = 'error') AS n_packet_in_flows,
 coalesce(sum(value) FILTER (event_type = 'view'), 0) AS n_packets_in,
 coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS n_packets_out FROM events GROUP BY 1, 2""",
    "feats": """SELECT *, CASE WHEN n_packet_in_flows > 0 THEN n_fi::DOUBLE / n_packet_in_flows ELSE 'Infinity'::DOUBLE END AS r_pi,
 CASE WHEN n_fi > 0 THEN n_fo::DOUBLE / n_fi ELSE 'Infinity'::DOUBLE END AS r_fi,
 abs(n_packets_in - n_packets_out) AS d_np FROM counters""",
}

_NEEDS = {
    "split": ["flows"], "train": ["split"], "stats": ["train"], "scaler": ["stats"],
    "vsplit": ["vectors"], "logits": ["vectors"], "expo": ["logits"], "preds": ["expo"], "hard": ["preds"],
    "cm": ["codes", "hard"], "pc0": ["cm"], "pc": ["pc0"], "long": ["preds", "codes"], "counts": ["long"],
    "counts_micro": ["counts"], "feats": ["counters"],
}


def with_(*names: str, more: str = "") -> str:
    """WITH clause of the named common tables and everything they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    if more:
        parts.append(more)
    return "WITH " + ", ".join(parts) + " "
