"""Queries: scorers, attribution and ablation."""

import numpy as np
from pyspark.sql import functions as F

from flowloom.functions import wavelet as V
from flowloom.functions.vectors import argmax_class, prob_of
from flowloom.operators import attribution as I
from flowloom.operators import logistic as L
from flowloom.operators import scoring as S
from flowloom.operators import shapley as H
from flowloom.workload.inputs import GEOM, K, LABELLED_WIDTH, SEED, WIDTH, labelled_vectors, swt_ctes, vector_split, vectors, with_
from flowloom.workload.registry import query, r
from flowloom.workload.wavelet import GEOM_LABELLED, PADDED_SWT


def _train(df):
    return df.filter(F.col("split") == "train")


def _test(df):
    return df.filter(F.col("split") == "test")


def raw_centroids(spark, sf):
    train = _train(vector_split(spark, sf))
    return S.collect_centroids(S.centroid_table(train, "y_true", "features", WIDTH), K, WIDTH)


def subband_scorer(spark, sf):
    """The transform is linear, so subband centroids are transformed feature centroids."""
    return raw_centroids(spark, sf) @ V.transform_matrix(GEOM)


_CENT = f"""pos AS (SELECT row_key, y_true, split, i::INT AS i, features[i + 1]::DOUBLE AS v FROM vsplit, range(0, {WIDTH}) t(i)),
 cent AS (SELECT y_true AS c, i, avg(v) AS m FROM pos WHERE split = 'train' GROUP BY ALL)"""
_CENT_SCORE = f"""{_CENT}, dist AS (SELECT row_key, y_true, split, c, -sum((v - m) * (v - m)) AS z FROM pos JOIN cent USING (i) GROUP BY ALL),
 sc AS (SELECT *, exp(z - max(z) OVER (PARTITION BY row_key)) AS e FROM dist),
 sp AS (SELECT *, (e / sum(e) OVER (PARTITION BY row_key))::FLOAT AS p FROM sc)"""


@query("centroid_scorer", with_("vsplit", more=_CENT_SCORE)
       + f"SELECT row_key, y_true, arg_max(c, z) AS y_pred, {r('max(p) FILTER (c = y_true)', 5)} AS p_true FROM sp GROUP BY 1, 2")
def centroid_scorer(spark, sf):
    rows = vector_split(spark, sf).select("row_key", "y_true", "features")
    scored = S.score_in_batches(rows, S.centroid_scorer(raw_centroids(spark, sf)), WIDTH, pred="y_pred")
    return scored.select("row_key", "y_true", "y_pred", F.round(prob_of("y_prob", "y_true"), 5).alias("p_true"))


def folded_logits(x: np.ndarray) -> np.ndarray:
    """Softmax of the components added up by class, as ``inputs.logits`` does it."""
    z = np.zeros((len(x), K))
    for i in range(x.shape[1]):
        z[:, i % K] += x[:, i]
    return S.row_softmax(z)


@query("score_in_batches", with_("hard") + f"SELECT row_key, y_true, y_pred, {r('y_prob[y_true + 1]', 5)} AS p_true FROM hard")
def score_in_batches(spark, sf):
    scored = S.score_in_batches(vectors(spark, sf), folded_logits, WIDTH)
    return scored.select("row_key", "y_true", argmax_class("y_prob").alias("y_pred"), F.round(prob_of("y_prob", "y_true"), 5).alias("p_true"))


@query("fit_score_classifier")
def fit_score_classifier(spark, sf):
    """Fitted on the train rows to the optimum; the transform is linear, so raw features give the model class of the subbands."""
    rows = vector_split(spark, sf).select("row_key", "y_true", "split", "features")
    scored = S.fit_score_classifier(_train(rows), _test(rows), K, WIDTH)
    return scored.select("row_key", "y_true", argmax_class("y_prob").alias("y_pred"))


STEPS, REG = 4, 0.01


def _newton_sql() -> str:
    """STEPS steps of two unknowns from zero, each by the inverse of a 2 x 2 matrix."""
    steps = "".join(
        f""", s{t + 1} AS (SELECT b - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b, w - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS w FROM (
  SELECT any_value(b) AS b, any_value(w) AS w, avg(p - y) AS g0, avg((p - y) * x) + {REG}::DOUBLE * any_value(w) AS g1, avg(p * (1 - p)) AS h00,
  avg(p * (1 - p) * x) AS h01, avg(p * (1 - p) * x * x) + {REG}::DOUBLE AS h11 FROM (SELECT *, 1 / (1 + exp(-(b + w * x))) AS p FROM v2, s{t})))"""
        for t in range(STEPS)
    )
    more = "v2 AS (SELECT (y_true = 0)::INT AS y, features[1]::DOUBLE AS x FROM vectors), s0 AS (SELECT 0::DOUBLE AS b, 0::DOUBLE AS w)" + steps
    return with_("vectors", more=more) + f"""SELECT {STEPS}::INT AS steps, {r('any_value(b)')} AS intercept, {r('any_value(w)')} AS weight,
 {r(f'avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) + {REG / 2} * any_value(w) * any_value(w)')} AS loss
 FROM (SELECT *, 1 / (1 + exp(-(b + w * x))) AS p FROM v2, s{STEPS})"""


@query("fit_newton_steps", _newton_sql())
def fit_newton_steps(spark, sf):
    """A fixed number of steps of the distributed fit: first class against the rest, on one feature."""
    rows = vectors(spark, sf).select((F.col("y_true") == 0).cast("int").alias("y_true"), F.array(F.get("features", 0).cast("double")).alias("features"))
    m = L.fit_logistic(rows, 2, 1, reg=REG, max_steps=STEPS, tol=0.0)
    row = (m.steps, *(round(float(v), 6) + 0.0 for v in (*m.weights[1], m.loss)))
    return spark.createDataFrame([row], "steps int, intercept double, weight double, loss double")


def _permuted(orders: int) -> str:
    """A value that moves changes one term of the distance; repeat r moves along order r modulo ``orders``."""
    return f"""{_CENT}, od AS (SELECT unnest(range(0, {orders})) AS o),
 tt AS (SELECT row_key, o, row_number() OVER (PARTITION BY o ORDER BY md5('{SEED}' || CASE WHEN o = 0 THEN '' ELSE '/' || o END || '|' || row_key)) - 1 AS a,
  count(*) OVER (PARTITION BY o) AS n FROM vsplit, od WHERE split = 'test'),
 pv AS (SELECT tt.o, tt.a, tt.n, pos.y_true, pos.i, pos.v FROM tt JOIN pos USING (row_key)),
 bz AS (SELECT o, a, y_true, c, sum((v - m) * (v - m)) AS d FROM pv JOIN cent USING (i) GROUP BY ALL),
 sw AS (SELECT p.o, p.a, p.i AS j, r, p.v AS was, q.v AS now FROM pv p JOIN range(0, 5) t(r) ON r % {orders} = p.o
  JOIN pv q ON q.o = p.o AND q.i = p.i AND q.a = (p.a + 1 + (p.i * 5 + r) % greatest(1, p.n - 1)) % p.n),
 vz AS (SELECT bz.a, bz.y_true, sw.j, sw.r, bz.c, d - (was - m) * (was - m) + (now - m) * (now - m) AS d
   FROM sw JOIN bz ON bz.o = sw.o AND bz.a = sw.a JOIN cent ON cent.c = bz.c AND cent.i = sw.j
  UNION ALL SELECT a, y_true, -1, 0, c, d FROM bz WHERE o = 0),
 guess AS (SELECT j, r, a, y_true, arg_min(c, d) AS p FROM vz GROUP BY ALL),
 cls AS (SELECT g.j, g.r, codes.c, count(*) FILTER (g.y_true = codes.c) AS t, count(*) FILTER (g.p = codes.c) AS q,
  count(*) FILTER (g.p = codes.c AND g.y_true = codes.c) AS tp FROM guess g, codes GROUP BY ALL),
 pf AS (SELECT j, r, coalesce(avg(2.0::DOUBLE * tp / (t + q)) FILTER (t > 0), 0) AS f1 FROM cls GROUP BY ALL),
 pi AS (SELECT j, avg(b.f1 - pf.f1) AS mean_decrease, stddev_pop(b.f1 - pf.f1) AS std_decrease, count(*)::INT AS n_repeats, max(b.f1) AS baseline_macro_f1
  FROM pf, (SELECT f1 FROM pf WHERE j = -1) b WHERE j >= 0 GROUP BY j)"""


def _permutation_sql(orders: int) -> str:
    return with_("vsplit", "codes", more=_permuted(orders)) + f"""SELECT 'f' || j AS feature, {r('mean_decrease')} AS mean_decrease, {r('std_decrease')} AS std_decrease, n_repeats,
 {r('baseline_macro_f1')} AS baseline_macro_f1, row_number() OVER (ORDER BY round(mean_decrease, 9) DESC, j)::INT AS rank FROM pi"""


PERMUTATION_SQL = _permutation_sql(1)


def _permutation(spark, sf, orders):
    rows = _test(vector_split(spark, sf)).select("row_key", "y_true", "features")
    out = I.permutation_importance(rows, S.centroid_scorer(raw_centroids(spark, sf)), WIDTH, 5, SEED, orders=orders)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_decrease", "std_decrease", "baseline_macro_f1")})


@query("permutation_importance", PERMUTATION_SQL)
def permutation_importance(spark, sf):
    return _permutation(spark, sf, 1)


@query("permutation_fresh_orders", _permutation_sql(5))
def permutation_fresh_orders(spark, sf):
    """Each repeat has a random order of its own."""
    return _permutation(spark, sf, 5)


def ablation(spark, sf):
    scorer = S.centroid_scorer(subband_scorer(spark, sf))
    bands = V.with_subbands(_test(vector_split(spark, sf)), "features", GEOM)
    return I.group_ablation(bands, scorer)


_ABL = f"""{swt_ctes('vsplit', 'features')},
 lb AS (SELECT row_key, y_true, split, b, i, v FROM (""" + " UNION ALL ".join(
    f"SELECT row_key, y_true, split, {n} AS b, i::INT AS i, {c}[i + 1] AS v FROM w3, range(0, {WIDTH}) t(i)" for n, c in enumerate(("d1", "d2", "d3", "a3"))
) + f""")),
 bc AS (SELECT y_true AS c, b, i, avg(v) AS m FROM lb WHERE split = 'train' GROUP BY ALL),
 bd AS (SELECT row_key, y_true, c, b, sum((v - m) * (v - m)) AS d, sum(m * m) AS z FROM lb JOIN bc USING (b, i) WHERE split = 'test' GROUP BY ALL),
 ms AS (SELECT unnest([-1, 0, 1, 2, 3]) AS mask),
 total AS (SELECT mask, row_key, y_true, c, sum(CASE WHEN b = mask THEN z ELSE d END) AS s FROM bd, ms GROUP BY ALL),
 guess AS (SELECT mask, row_key, y_true, arg_min(c, s) AS p FROM total GROUP BY ALL),
 cls AS (SELECT mask, c, (SELECT count(*) FROM guess g WHERE g.mask = ms.mask AND g.y_true = c) AS t, (SELECT count(*) FROM guess g WHERE g.mask = ms.mask AND g.p = c) AS q,
  (SELECT count(*) FROM guess g WHERE g.mask = ms.mask AND g.p = c AND g.y_true = c) AS tp FROM ms, codes),
 f AS (SELECT mask, avg(2.0::DOUBLE * tp / (t + q)) AS f1 FROM cls WHERE t > 0 GROUP BY 1),
 abl AS (SELECT ['cD1', 'cD2', 'cD3', 'cA3'][mask + 1] AS branch, (SELECT f1 FROM f WHERE mask = -1) AS full_f1, f1 FROM f WHERE mask >= 0)"""
ABLATION_SQL = with_("vsplit", "codes", more=_ABL) + f"""SELECT branch, {r('full_f1')} AS macro_f1_full, {r('f1')} AS macro_f1_ablated, {r('full_f1 - f1')} AS macro_f1_drop,
 {r('CASE WHEN full_f1 > 0 THEN 100 * (full_f1 - f1) / full_f1 ELSE 0 END', 4)} AS drop_percent FROM abl"""


@query("group_ablation", ABLATION_SQL)
def group_ablation(spark, sf):
    cols = {c: F.round(c, 6) for c in ("macro_f1_full", "macro_f1_ablated", "macro_f1_drop")}
    return ablation(spark, sf).withColumns({**cols, "drop_percent": F.round("drop_percent", 4)})


def folded(spark, sf):
    return I.fold_attribution(V.with_subbands(labelled_vectors(spark, sf), "x", GEOM_LABELLED), "subbands", LABELLED_WIDTH)


def linear(spark, sf):
    return I.linear_attribution(vectors(spark, sf), raw_centroids(spark, sf).tolist())


_FOLD = f"""{PADDED_SWT},
 fm AS (SELECT i AS pos, avg(abs(d1[i + 1]) + abs(d2[i + 1]) + abs(d3[i + 1]) + abs(a3[i + 1])) AS s FROM w3, range(0, {LABELLED_WIDTH}) t(i) GROUP BY 1),
 fold AS (SELECT 'f' || pos AS feature, s AS mean_abs, 100 * s / sum(s) OVER () AS percent, row_number() OVER (ORDER BY s DESC, pos)::INT AS rank FROM fm)"""
_LIN = f"""{_CENT}, mu AS (SELECT i, avg(v) AS mu FROM pos GROUP BY 1), sd AS (SELECT i, avg(abs(v - mu)) AS s FROM pos JOIN mu USING (i) GROUP BY 1),
 st AS (SELECT i, sum(abs(m)) AS w FROM cent GROUP BY 1), lm AS (SELECT i AS pos, s * w AS s FROM sd JOIN st USING (i)),
 lin AS (SELECT 'f' || pos AS feature, s AS mean_abs, 100 * s / sum(s) OVER () AS percent, row_number() OVER (ORDER BY s DESC, pos)::INT AS rank FROM lm)"""
_ATTR = f"feature, {r('mean_abs')} AS mean_abs, {r('percent')} AS percent, rank"
FOLD_SQL = with_("vectors", more=_FOLD) + f"SELECT {_ATTR} FROM fold"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean_abs", "percent")})


@query("fold_attribution", FOLD_SQL)
def fold_attribution(spark, sf):
    return _rounded(folded(spark, sf))


@query("linear_attribution", with_("vsplit", more=_LIN) + f"SELECT {_ATTR} FROM lin")
def linear_attribution(spark, sf):
    return _rounded(linear(spark, sf))


BACKGROUND, ORDERS = 20, 2


def distance_scorer(centroids: np.ndarray):
    """Minus the squared distances to the centroids, not turned into probabilities."""
    norms = (centroids**2).sum(axis=1)
    return lambda x: 2 * x @ centroids.T - norms - (x**2).sum(axis=1, keepdims=True)


# Distances add up over features, so a feature's value is its own term less that term's mean over the background.
_SHAP = f"""{_CENT}, bg AS (SELECT row_key FROM vsplit ORDER BY md5('{SEED}|' || row_key), row_key LIMIT {BACKGROUND}),
 bm AS (SELECT c, i, avg((v - m) * (v - m)) AS q FROM pos JOIN bg USING (row_key) JOIN cent USING (i) GROUP BY ALL),
 sm AS (SELECT i AS pos, sum(abs(q - (v - m) * (v - m))) / count(DISTINCT row_key) AS s FROM pos JOIN cent USING (i) JOIN bm USING (c, i) GROUP BY 1),
 shap AS (SELECT 'f' || pos AS feature, s AS mean_abs, 100 * s / sum(s) OVER () AS percent, row_number() OVER (ORDER BY s DESC, pos)::INT AS rank FROM sm)"""


@query("shapley_attribution", with_("vsplit", more=_SHAP) + f"SELECT {_ATTR} FROM shap")
def shapley_attribution(spark, sf):
    rows = vectors(spark, sf)
    background = H.background_rows(rows, BACKGROUND, SEED)
    return _rounded(H.shapley_attribution(rows, distance_scorer(raw_centroids(spark, sf)), background, ORDERS, SEED))


@query("importance_comparison", with_("vsplit", more=f"{_LIN}, {_FOLD}") + f"""SELECT l.feature, {r('l.mean_abs')} AS mean_decrease, l.rank AS rank_permutation,
 {r('f.mean_abs')} AS mean_abs, f.rank AS rank_attribution, l.rank <= 10 AND coalesce(f.rank <= 10, false) AS top_consensus FROM lin l LEFT JOIN fold f USING (feature)""")
def importance_comparison(spark, sf):
    first = linear(spark, sf).withColumnRenamed("mean_abs", "mean_decrease")
    both = I.importance_comparison(first, folded(spark, sf))
    return both.withColumns({c: F.round(c, 6) for c in ("mean_decrease", "mean_abs")})


@query("top_k_features", with_("vsplit", more=_LIN) + f"SELECT {_ATTR} FROM lin ORDER BY mean_abs DESC, feature LIMIT 30")
def top_k_features(spark, sf):
    return _rounded(I.top_features(linear(spark, sf), "mean_abs", 30))
