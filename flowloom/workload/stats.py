"""Queries: column statistics, selection, scaling, preparation."""

from pyspark.sql import functions as F

from flowloom.operators import stats as E
from flowloom.operators.anomaly import all_finite
from flowloom.plans.prepare import prepare_dataset
from flowloom.workload.inputs import CTES, FEATURES, MERGE, SEED, flow_scaler, flow_split, flows, split_cte, with_
from flowloom.workload.registry import query, r

FIN = {c: f"CASE WHEN isfinite({c}) THEN {c} END" for c in FEATURES}


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("column_stats", with_("stats") + f"""SELECT ordinal, "column", n_rows, n_finite, n_missing, {r('total', 2)} AS total,
 {r('lo')} AS "min", {r('hi')} AS "max" FROM stats""")
def column_stats(spark, sf):
    stats = E.column_stats(flow_split(spark, sf), FEATURES)
    return _rounded(stats.withColumn("total", F.round("total", 2)), "min", "max")


_SCALER_COLS = f"""ordinal, "column", n_rows, n_finite, n_missing, {r('lo')} AS "min", {r('hi')} AS "max", {r('mean')} AS mean,
 {r('missing_ratio')} AS missing_ratio, is_constant"""


@query("scaler_stats", with_("scaler") + f"SELECT {_SCALER_COLS} FROM scaler")
def scaler_stats(spark, sf):
    return _rounded(flow_scaler(spark, sf), "min", "max", "mean", "missing_ratio")


@query("drop_high_missing", with_("scaler") + f"""SELECT "column", 'missing_ratio_above_threshold' AS reason FROM scaler WHERE missing_ratio > 0.8""")
def drop_high_missing(spark, sf):
    return E.drop_high_missing(flow_scaler(spark, sf)).select("column", "reason")


@query("drop_constant", with_("scaler") + """SELECT "column", 'constant_on_train' AS reason FROM scaler WHERE missing_ratio <= 0.8 AND is_constant""")
def drop_constant(spark, sf):
    return E.drop_constant(flow_scaler(spark, sf)).select("column", "reason")


_CAND = """cand AS (SELECT a.ordinal, a."column", min_by(b."column", b.ordinal) AS keeper FROM scaler a JOIN scaler b
 ON round(a.lo, 9) = round(b.lo, 9) AND round(a.hi, 9) = round(b.hi, 9) AND round(a.mean, 9) = round(b.mean, 9)
 AND a.n_missing = b.n_missing AND b.ordinal < a.ordinal
 WHERE a.missing_ratio <= 0.8 AND NOT a.is_constant AND b.missing_ratio <= 0.8 AND NOT b.is_constant GROUP BY 1, 2)"""


@query("duplicate_candidates", with_("scaler", more=_CAND) + """SELECT ordinal, "column", keeper FROM cand""")
def duplicate_candidates(spark, sf):
    return E.duplicate_candidates(flow_scaler(spark, sf))


_DUP = f"""dup AS (SELECT 4 - 2 AS ordinal, 'f_copy' AS "column", 'duplicate_of' AS reason, 'f_price' AS evidence
 FROM train HAVING count(*) FILTER (({FIN['f_price']}) IS DISTINCT FROM ({FIN['f_copy']})) = 0
 AND EXISTS (SELECT 1 FROM cand WHERE "column" = 'f_copy' AND keeper = 'f_price'))"""


@query("drop_duplicates_cols", with_("scaler", more=f"{_CAND}, {_DUP}") + """SELECT "column", reason, evidence FROM dup""")
def drop_duplicates_cols(spark, sf):
    train = flow_split(spark, sf).filter(F.col("split") == "train")
    found = E.drop_duplicate_columns(train, E.duplicate_candidates(flow_scaler(spark, sf, "row_key")))
    return found.select("column", "reason", "evidence")


VERIFIED = 200  # rows of the comparison on a draw
_DRAWN = f"drawn AS (SELECT * FROM train ORDER BY md5('{SEED}|' || row_key), row_key LIMIT {VERIFIED})"


@query("drop_duplicates_drawn", with_("scaler", more=f"{_CAND}, {_DRAWN}, {_DUP.replace('FROM train', 'FROM drawn')}") + """SELECT "column", reason, evidence FROM dup""")
def drop_duplicates_drawn(spark, sf):
    train = flow_split(spark, sf).filter(F.col("split") == "train")
    candidates = E.duplicate_candidates(flow_scaler(spark, sf, "row_key"))
    return E.drop_duplicate_columns(train, candidates, VERIFIED, "row_key", SEED).select("column", "reason", "evidence")


_DROPS = """drops AS (SELECT 1 AS step, ordinal, "column", 'missing_ratio_above_threshold' AS reason FROM scaler WHERE missing_ratio > 0.8
 UNION ALL SELECT 2, ordinal, "column", 'constant_on_train' FROM scaler WHERE missing_ratio <= 0.8 AND is_constant
 UNION ALL SELECT 3, ordinal, "column", reason FROM dup)"""


def _drop_report(spark, sf):
    rows = flow_split(spark, sf)
    return E.column_drop_report(flow_scaler(spark, sf, "row_key"), rows.filter(F.col("split") == "train"))


@query("column_drop_report", with_("scaler", more=f"{_CAND}, {_DUP}, {_DROPS}") + """SELECT step, ordinal, "column", reason FROM drops""")
def column_drop_report(spark, sf):
    return _drop_report(spark, sf).select("step", "ordinal", "column", "reason")


@query("subset_stats", with_("scaler", more=f"{_CAND}, {_DUP}, {_DROPS}")
       + f"""SELECT {_SCALER_COLS} FROM scaler WHERE "column" NOT IN (SELECT "column" FROM drops)""")
def subset_stats(spark, sf):
    kept = E.subset_stats(flow_scaler(spark, sf), _drop_report(spark, sf))
    return _rounded(kept, "min", "max", "mean", "missing_ratio")


def _stat(col: str, what: str) -> str:
    return f"(SELECT {what} FROM scaler WHERE \"column\" = '{col}')"


def _imputed(c: str) -> str:
    return f"coalesce({FIN[c]}, {_stat(c, 'mean')})"


def _scaled(c: str) -> str:
    span = f"(SELECT CASE WHEN hi - lo > 0 THEN hi - lo ELSE 1 END FROM scaler WHERE \"column\" = '{c}')"
    return r(f"least(greatest(({_imputed(c)} - {_stat(c, 'lo')}) / {span}, 0), 1)::FLOAT", 5)


@query("impute_mean", with_("scaler") + "SELECT row_key, " + ", ".join(f"{r(_imputed(c))} AS {c}" for c in FEATURES) + " FROM split")
def impute_mean(spark, sf):
    scaler = E.Scaler.collect(flow_scaler(spark, sf))
    out = E.impute_mean(flows(spark, sf).select("row_key", *FEATURES), scaler)
    return _rounded(out, *FEATURES)


@query("minmax_scale", with_("scaler") + "SELECT row_key, " + ", ".join(f"{_scaled(c)} AS {c}" for c in FEATURES) + " FROM split")
def minmax_scale(spark, sf):
    scaler = E.Scaler.collect(flow_scaler(spark, sf))
    out = E.minmax_scale(flows(spark, sf).select("row_key", *FEATURES), scaler)
    return out.withColumns({c: F.round(F.col(c).cast("double"), 5) for c in FEATURES})


@query("assemble_vector", "SELECT p_partkey AS row_key, 2 AS width, p_size::DOUBLE AS v1, p_retailprice AS v2 FROM part")
def assemble_vector(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("row_key"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice"
    )
    v = E.assemble_vector(part, ["p_size", "p_retailprice"])
    return v.select("row_key", F.size("features").alias("width"), F.get("features", 0).alias("v1"), F.get("features", 1).alias("v2"))


@query("finite_filter", with_("flows") + "SELECT row_key, f_price, f_sparse FROM flows WHERE isfinite(f_price) AND isfinite(f_sparse)")
def finite_filter(spark, sf):
    return flows(spark, sf).filter(all_finite("f_price", "f_sparse")).select("row_key", "f_price", "f_sparse")


# ------------------------------------------------------------------ the whole preparation
_MERGED = "merged AS (SELECT * REPLACE (CASE WHEN label = '5-LOW' THEN '4-NOT SPECIFIED' ELSE label END AS label) FROM flows)"
KEPT = ("f_price", "f_cust", "f_day")


def prepared(spark, sf):
    return prepare_dataset(flows(spark, sf), "row_key", "label", FEATURES, merge=MERGE, seed=SEED)


def prep_ctes() -> str:
    """The preparation of merged labels as common tables ending in split and scaler."""
    tail = ", ".join(f"{n} AS ({CTES[n]})" for n in ("train", "stats", "scaler"))
    return f"WITH flows AS ({CTES['flows']}), {_MERGED}, split AS ({split_cte('merged', 'label')}), {tail} "


@query("prepare_dataset", prep_ctes()
       + "SELECT row_key, label, (dense_rank() OVER (ORDER BY label) - 1)::SMALLINT AS code, split, "
       + ", ".join(f"{_scaled(c)} AS {c}" for c in KEPT) + " FROM split")
def prepare(spark, sf):
    out = prepared(spark, sf).scaled
    return out.withColumns({c: F.round(F.col(c).cast("double"), 5) for c in out.columns if c.startswith("f_")})
