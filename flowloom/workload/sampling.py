"""Queries: samples, splits and batches."""

from pyspark.sql import functions as F

from flowloom.operators import labels as L
from flowloom.operators import epochs as E
from flowloom.operators import sampling as S
from flowloom.workload.inputs import SEED, flow_split, flows, table, with_
from flowloom.workload.registry import query, r

# Targets below the table sizes at every scale, so that sampling takes place.
CAP_TARGET = 1_000
PLAIN_N = 500


def _ranked(source: str, label: str, key: str = "row_key") -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{SEED}|' || {key}), {key}) AS rn,
 count(*) OVER (PARTITION BY {label}) AS n, count(*) OVER () AS total FROM {source})"""


_LABELLED = "labelled AS (SELECT o_orderkey AS row_key, o_orderpriority AS label FROM orders)"
_COUNTS = "cc AS (SELECT label, count(*) AS n FROM labelled GROUP BY 1)"
# smallest candidate cap that reaches the target, by definition
_CAP = f"""cap AS (SELECT min(c) AS cap FROM (SELECT unnest(range(1, (SELECT max(n) + 1 FROM cc))) AS c)
 WHERE (SELECT sum(least(n, c)) FROM cc) >= least({CAP_TARGET}, (SELECT sum(n) FROM cc)))"""


def labelled(spark, sf):
    return flows(spark, sf).select("row_key", "label")


@query("class_cap", f"WITH {_LABELLED}, {_COUNTS}, {_CAP} SELECT cap::BIGINT AS cap FROM cap")
def class_cap(spark, sf):
    return S.class_cap(L.class_counts(labelled(spark, sf), "label"), CAP_TARGET)


@query("subsample_capped", f"WITH {_LABELLED}, {_COUNTS}, {_CAP}, {_ranked('labelled', 'label')} "
       f"SELECT row_key, label FROM ranked WHERE rn <= (SELECT cap FROM cap) OR total <= {CAP_TARGET}")
def subsample_capped(spark, sf):
    return S.subsample(labelled(spark, sf), "row_key", "label", CAP_TARGET, "capped", SEED)


def _prop(target: int) -> str:
    return f"least(n, greatest(1, round_even(n * ({target}::DOUBLE / total), 0)))"


@query("subsample_proportional", f"WITH {_LABELLED}, {_ranked('labelled', 'label')} "
       f"SELECT row_key, label FROM ranked WHERE rn <= {_prop(CAP_TARGET)} OR total <= {CAP_TARGET}")
def subsample_proportional(spark, sf):
    return S.subsample(labelled(spark, sf), "row_key", "label", CAP_TARGET, "proportional", SEED)


@query("subsample_report", f"WITH {_LABELLED}, {_COUNTS}, {_CAP}, t AS (SELECT sum(n) AS total FROM cc), "
       f"""x AS (SELECT label AS class, n AS n_before, CASE WHEN total <= {CAP_TARGET} THEN n ELSE least(n, cap) END AS n_after
 FROM cc, cap, t) SELECT class, n_before, n_after, n_before = n_after AS kept_whole,
 (sum(n_before) OVER ())::BIGINT AS total_before, (sum(n_after) OVER ())::BIGINT AS total_after FROM x""")
def subsample_report(spark, sf):
    return S.subsample_report(labelled(spark, sf), "label", CAP_TARGET, "capped")


@query("stratified_split", with_("split") + "SELECT row_key, label, split FROM split")
def stratified_split(spark, sf):
    return flow_split(spark, sf).select("row_key", "label", "split")


_GROUPS = f"""g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('{SEED}|' || o_custkey)) AS rn, count(*) OVER ()::DOUBLE AS n
 FROM (SELECT DISTINCT o_custkey FROM orders)),
 g2 AS (SELECT *, round_even(n * 0.3::DOUBLE, 0) AS t FROM g), g3 AS (SELECT *, round_even((n - t) * 0.15::DOUBLE, 0) AS v FROM g2)"""


@query("group_split", f"""WITH {_GROUPS} SELECT o_orderkey AS row_key, o_custkey AS grp,
 CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'val' ELSE 'train' END AS split FROM orders JOIN g3 USING (o_custkey)""")
def group_split(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_key"), F.col("o_custkey").alias("grp"))
    return S.group_split(rows, "grp", seed=SEED).select("row_key", "grp", "split")


@query("split_leakage", with_("split") + """SELECT count(*) AS n_total, count(DISTINCT row_key) AS n_keys,
 count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
 (SELECT count(*) FROM (SELECT row_key FROM split WHERE split = 'train' INTERSECT SELECT row_key FROM split WHERE split = 'val')) AS overlap_train_val,
 (SELECT count(*) FROM (SELECT row_key FROM split WHERE split = 'train' INTERSECT SELECT row_key FROM split WHERE split = 'test')) AS overlap_train_test,
 (SELECT count(*) FROM (SELECT row_key FROM split WHERE split = 'val' INTERSECT SELECT row_key FROM split WHERE split = 'test')) AS overlap_val_test,
 """ + ", ".join(f"{r(f'''(count(*) FILTER (split = '{s}'))::DOUBLE / count(*)''')} AS frac_{s}" for s in ("train", "val", "test"))
       + ", true AS is_disjoint, true AS covers_all FROM split")
def split_leakage(spark, sf):
    return S.assert_no_leakage(flow_split(spark, sf), "row_key")


@query("split_class_counts", with_("split") + """SELECT label, count(*) FILTER (split = 'train') AS train,
 count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM split GROUP BY 1""")
def split_class_counts(spark, sf):
    return S.split_class_counts(flow_split(spark, sf), "label")


@query("train_sample_first_n", with_("train") + "SELECT row_key, label FROM train ORDER BY row_key LIMIT 1000")
def train_sample_first_n(spark, sf):
    train = flow_split(spark, sf).filter(F.col("split") == "train").select("row_key", "label")
    return S.first_rows(train, "row_key", 1000)


@query("stratified_sample", with_("flows", more=_ranked("flows", "label"))
       + f"SELECT row_key, label FROM ranked WHERE rn <= {_prop(1000)} OR total <= 1000")
def stratified_sample(spark, sf):
    rows = flows(spark, sf).select("row_key", "label")
    return S.stratified_sample(rows, "row_key", "label", 1000, SEED)


@query("plain_sample", f"SELECT o_orderkey AS row_key FROM orders ORDER BY md5('{SEED}|' || o_orderkey) LIMIT {PLAIN_N}")
def plain_sample(spark, sf):
    return S.plain_sample(flows(spark, sf).select("row_key"), "row_key", PLAIN_N, SEED)


_BATCH = f"""b AS (SELECT o_orderkey AS row_key, row_number() OVER (ORDER BY md5('{SEED}|3|' || o_orderkey), o_orderkey) - 1 AS p FROM orders)"""


@query("epoch_batches", f"WITH {_BATCH} SELECT row_key, (p // 128)::BIGINT AS batch_id, (p % 128)::BIGINT AS position FROM b")
def epoch_batches(spark, sf):
    return S.epoch_batches(flows(spark, sf).select("row_key"), "row_key", 128, epoch=3, seed=SEED)


@query("resume_batches", f"WITH {_BATCH} SELECT row_key, (p // 128)::BIGINT AS batch_id, (p % 128)::BIGINT AS position FROM b WHERE p // 128 >= 3")
def resume_batches(spark, sf):
    return S.resume_batches(epoch_batches(spark, sf), 3)


def _in_place_sql(epoch: int) -> str:
    """The network on row numbers in file order; what lands beyond the rows goes through again."""
    p = E.PRIME

    def once(source: str) -> str:
        s = f"SELECT row_key, n, a, b, x // b AS l, x % b AS r FROM ({source})"
        for i, (f, c) in enumerate(E.round_keys(SEED, epoch)):
            v, (m, o) = ("r", ("l", "r")) if i % 2 == 0 else ("l", ("r", "l"))
            z = f"((({v} + {c}) % {p}) * (({v} + {c}) % {p}) % {p} * {f} % {p})"
            s = f"SELECT row_key, n, a, b, ({m} + {z}) % {'a' if m == 'l' else 'b'} AS {m}, {o} FROM ({s})"
        return f"SELECT row_key, n, a, b, l * b + r AS x FROM ({s})"

    first = "SELECT row_key, n, a, (n + a - 1) // a AS b, x FROM (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM (SELECT o_orderkey AS row_key, row_number() OVER () - 1 AS x, count(*) OVER () AS n FROM orders))"
    return f"""WITH RECURSIVE w AS ({once(first)} UNION ALL {once('SELECT row_key, n, a, b, x FROM w WHERE x >= n')})
 SELECT row_key, (x // 128)::BIGINT AS batch_id, (x % 128)::BIGINT AS position FROM w WHERE x < n"""


@query("epoch_batches_in_place", _in_place_sql(3))
def epoch_batches_in_place(spark, sf):
    """Full batches of a random order without a shuffle of the rows."""
    rows, n = E.dense_numbers(spark, f"{sf}/orders.parquet")
    return E.batches_in_place(rows.select(F.col("o_orderkey").alias("row_key"), "number"), n, 128, epoch=3, seed=SEED).drop("number")


@query("row_subset", with_("split") + "SELECT o_orderkey AS row_key, o_totalprice FROM orders WHERE o_orderkey IN (SELECT row_key FROM split WHERE split = 'val')")
def row_subset(spark, sf):
    keys = flow_split(spark, sf).filter(F.col("split") == "val")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_key"), "o_totalprice")
    return S.row_subset(rows, keys, "row_key")
