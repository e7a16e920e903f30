"""Queries: ranking metrics and curves."""

from pyspark.sql import functions as F

from flowloom.operators import areas
from flowloom.operators import curves as R
from flowloom.workload.inputs import K, SEED, preds, with_
from flowloom.workload.registry import query, r

# Pairwise definition of the area, independent of running totals: for every negative score, the
# positives above it plus half of those equal to it.
def _area(name: str, source: str) -> str:
    return f"""{name} AS (SELECT class, np, nn, CASE WHEN np > 0 AND nn > 0 THEN won / (np::DOUBLE * nn) END AS auc FROM (
 SELECT class, sum(pos)::BIGINT AS np, sum(neg)::BIGINT AS nn, sum(neg * (above + pos / 2.0::DOUBLE)) AS won FROM (
  SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY score DESC) - pos AS above FROM {source}) GROUP BY class))"""


def _ap(name: str, source: str) -> str:
    return f"""{name} AS (SELECT class, CASE WHEN np > 0 AND nn > 0 THEN s / np END AS ap FROM (
 SELECT class, sum(pos)::BIGINT AS np, sum(neg)::BIGINT AS nn, sum(pos * (tp::DOUBLE / (tp + fp))) AS s FROM (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {source} WINDOW w AS (PARTITION BY class ORDER BY score DESC)) GROUP BY class))"""


AREA_CTE = _area("area", "counts")
AP_CTE = _ap("ap", "counts")
RENORM_CTE = f"""present AS (SELECT DISTINCT y_true AS c FROM preds),
 rlong AS (SELECT l.row_key, l.class, l.hit, (l.score::DOUBLE / t.s)::FLOAT AS score FROM long l JOIN present ON c = l.class
  JOIN (SELECT row_key, greatest(sum(score::DOUBLE ORDER BY class), 1e-12::DOUBLE) AS s FROM long JOIN present ON c = class GROUP BY 1) t USING (row_key)),
 rcounts AS (SELECT class, score, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM rlong GROUP BY 1, 2
  UNION ALL SELECT -1, score, count(*) FILTER (hit), count(*) FILTER (NOT hit) FROM rlong GROUP BY 2),
 {_area('renorm_area', 'rcounts')}"""


@query("ovr_roc_auc", with_("counts", more=AREA_CTE) + f"SELECT class, np AS n_pos, nn AS n_neg, {r('auc')} AS roc_auc FROM area")
def ovr_roc_auc(spark, sf):
    return R.ovr_areas(preds(spark, sf)).select("class", "n_pos", "n_neg", F.round("roc_auc", 6).alias("roc_auc"))


@query("auc_macro_weighted", with_("counts", more=RENORM_CTE) + f"""SELECT {r('avg(auc)')} AS auc_macro, {r('sum(auc * np) / sum(np)')} AS auc_weighted,
 (SELECT count(*) FROM present)::INT AS classes_used, ({K} - (SELECT count(*) FROM present))::INT AS classes_skipped FROM renorm_area WHERE class >= 0""")
def auc_macro_weighted(spark, sf):
    return R.auc_macro_weighted(preds(spark, sf), K).withColumns(
        {c: F.round(c, 6) for c in ("auc_macro", "auc_weighted")}
    )


@query("auc_micro", with_("counts", more=RENORM_CTE) + f"SELECT {r('auc')} AS auc_micro FROM renorm_area WHERE class = -1")
def auc_micro(spark, sf):
    return R.auc_micro(preds(spark, sf)).select(F.round("auc_micro", 6).alias("auc_micro"))


@query("average_precision", with_("counts_micro", more=_ap("ap", "counts_micro"))
       + f"SELECT class, {r('ap')} AS ap, {r('avg(ap) FILTER (class >= 0) OVER ()')} AS ap_macro FROM ap")
def average_precision(spark, sf):
    return R.average_precision(preds(spark, sf)).withColumns({c: F.round(c, 6) for c in ("ap", "ap_macro")})


_CUM = """cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS np, sum(neg) OVER (PARTITION BY class) AS nn,
 row_number() OVER w AS i, count(*) OVER (PARTITION BY class) AS m, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg
 FROM counts_micro WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
 cum1 AS (SELECT * FROM cum WHERE np > 0 AND nn > 0)"""
_ROC = """roc AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY score DESC) AS idx, count(*) OVER (PARTITION BY class) + 1 AS m,
 fp::DOUBLE / nn AS fpr, tp::DOUBLE / np AS tpr, score::DOUBLE AS threshold FROM cum1
 WHERE i = 1 OR i = m OR NOT (pos = npos AND neg = nneg)
 UNION ALL SELECT class, 0, (SELECT count(*) FROM cum1 c WHERE c.class = d.class AND (i = 1 OR i = m OR NOT (pos = npos AND neg = nneg))) + 1, 0, 0, NULL
 FROM (SELECT DISTINCT class FROM cum1) d)"""
_PR = """pr AS (SELECT class, m - i AS idx, m + 1 AS m, tp::DOUBLE / np AS recall, tp::DOUBLE / (tp + fp) AS precision, score::DOUBLE AS threshold FROM cum1
 UNION ALL SELECT class, max(m), max(m) + 1, 0, 1, 1 FROM cum1 GROUP BY class)"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_ROC_COLS = f"class, idx, {r('fpr')} AS fpr, {r('tpr')} AS tpr, {r('threshold')} AS threshold"
_PR_COLS = f"class, idx, {r('recall')} AS recall, {r('precision')} AS precision, {r('threshold')} AS threshold"


@query("roc_curve", with_("counts_micro", more=f"{_CUM}, {_ROC}") + f"SELECT {_ROC_COLS} FROM roc")
def roc_curve(spark, sf):
    return _rounded(R.roc_points(preds(spark, sf)), "fpr", "tpr", "threshold")


@query("pr_curve", with_("counts_micro", more=f"{_CUM}, {_PR}") + f"SELECT {_PR_COLS} FROM pr")
def pr_curve(spark, sf):
    return _rounded(R.pr_points(preds(spark, sf)), "recall", "precision", "threshold")


def _thin(source: str, k: int) -> str:
    return f"""(SELECT * FROM {source} t WHERE m <= {k} OR idx IN (SELECT (i * (m - 1)) // {k - 1} FROM range(0, {k}) g(i)))"""


THIN = 40


@query("thin_curve", with_("counts_micro", more=f"{_CUM}, {_ROC}") + f"SELECT {_ROC_COLS} FROM {_thin('roc', THIN)}")
def thin_curve(spark, sf):
    return _rounded(R.roc_points(preds(spark, sf), max_points=THIN), "fpr", "tpr", "threshold")


# Interpolation by looking up both neighbours of every grid point.
MACRO_CTES = f"""{_CUM}, pts AS (SELECT class, fp, tp, np, nn FROM cum1 WHERE class >= 0 UNION ALL SELECT DISTINCT class, 0, 0, np, nn FROM cum1 WHERE class >= 0),
 grid AS (SELECT class, np, nn, g FROM (SELECT DISTINCT class, np, nn FROM pts), range(0, {R.GRID}) t(g)),
 lf AS (SELECT grid.class, grid.g, max(pts.fp) AS fp, max(pts.tp) AS tp FROM grid JOIN pts ON pts.class = grid.class AND pts.fp * {R.GRID - 1} <= grid.g * grid.nn GROUP BY 1, 2),
 rt AS (SELECT grid.class, grid.g, min(pts.fp) AS fp, min(pts.tp) AS tp FROM grid JOIN pts ON pts.class = grid.class AND pts.fp * {R.GRID - 1} > grid.g * grid.nn GROUP BY 1, 2),
 interp AS (SELECT grid.class, grid.g, CASE WHEN rt.fp IS NULL OR lf.fp * {R.GRID - 1} = grid.g * nn THEN lf.tp::DOUBLE
  ELSE lf.tp + (rt.tp - lf.tp) * (grid.g * nn / {R.GRID - 1}.0::DOUBLE - lf.fp) / (rt.fp - lf.fp) END / np AS y
  FROM grid JOIN lf USING (class, g) LEFT JOIN rt ON rt.class = grid.class AND rt.g = grid.g),
 macro AS (SELECT g, avg(y) AS tpr FROM interp GROUP BY g),
 strips AS (SELECT *, (tpr + lag(tpr) OVER (ORDER BY g)) / (2.0::DOUBLE * {R.GRID - 1}) AS a FROM macro)"""
_MACRO_COLS = f"{r(f'g::DOUBLE / {R.GRID - 1}')} AS fpr, {r('tpr')} AS tpr"


@query("macro_roc", with_("counts_micro", more=MACRO_CTES) + f"SELECT g::INT AS idx, {_MACRO_COLS}, {r('sum(a) OVER ()')} AS auc FROM strips")
def macro_roc(spark, sf):
    return _rounded(R.macro_roc(preds(spark, sf)), "fpr", "tpr", "auc")


CAP = 300


@query("curve_sample_cap", with_("preds", more=f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5('{SEED}|' || row_key), row_key) AS rn,
 count(*) OVER (PARTITION BY y_true) AS n, count(*) OVER () AS total FROM preds)""") + f"""SELECT row_key, y_true FROM ranked
 WHERE total <= {CAP} OR rn <= least(n, greatest(1, round_even(n * ({CAP}::DOUBLE / total), 0)))""")
def curve_sample_cap(spark, sf):
    return R.curve_sample(preds(spark, sf), cap=CAP, seed=SEED).select("row_key", "y_true")


_BINS = """binned AS (SELECT class, floor(score::DOUBLE * 4096)::BIGINT AS score, sum(pos) AS pos, sum(neg) AS neg FROM counts GROUP BY 1, 2)"""


@query("approx_auc", with_("counts", more=f"{_BINS}, {_area('area', 'binned')}") + f"SELECT class, {r('auc')} AS roc_auc FROM area")
def approx_auc(spark, sf):
    return _rounded(R.approx_auc(preds(spark, sf)), "roc_auc")


_TOLERANCE = 1e-3


def _cell_sql(per_unit: int) -> str:
    s = "score::DOUBLE"
    return f"(CASE WHEN {s} <= 0 THEN {-1000 * per_unit} WHEN {s} >= 1 THEN {1000 * per_unit} ELSE floor(ln({s} / (1 - {s})) * {per_unit}) END)::INT"


_HEAVY = f"sum(pos) OVER {{w}} * sum(neg) OVER {{w}}::DOUBLE > {(2 * _TOLERANCE) ** 2!r} * n_pos * n_neg"
_LEAVES = f"""celled AS (SELECT *, {_cell_sql(areas.CELLS)} AS c0, {_cell_sql(areas.CELLS * areas.SPLIT)} AS c1,
  sum(pos) OVER (PARTITION BY class)::DOUBLE AS n_pos, sum(neg) OVER (PARTITION BY class)::DOUBLE AS n_neg FROM counts),
 weighed AS (SELECT *, {_HEAVY.format(w="(PARTITION BY class, c0)")} AS h0, {_HEAVY.format(w="(PARTITION BY class, c1)")} AS h1 FROM celled),
 leaves AS (SELECT class, n_pos, n_neg, h0, h0 AND h1 AS single, CASE WHEN NOT h0 THEN c0 WHEN NOT h1 THEN c1 END AS cell, CASE WHEN h0 AND h1 THEN score END AS one,
  sum(pos)::DOUBLE AS pos, sum(neg)::DOUBLE AS neg, min(score) AS low, max(score) AS high FROM weighed GROUP BY ALL),
 ran AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY low DESC) AS tp FROM leaves)"""


@query("bounded_auc", with_("counts", more=_LEAVES) + f"""SELECT class, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg,
 {r('sum(neg * (tp - pos / 2)) / nullif(n_pos * n_neg, 0)')} AS roc_auc, {r('sum(CASE WHEN low < high THEN pos * neg ELSE 0 END) / 2 / nullif(n_pos * n_neg, 0)')} AS error_bound
 FROM ran GROUP BY class, n_pos, n_neg""")
def bounded_auc(spark, sf):
    out = areas.bounded_auc(preds(spark, sf), _TOLERANCE)
    return out.select("class", "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in ("roc_auc", "error_bound")])
