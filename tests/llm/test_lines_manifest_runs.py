"""Line dedup, Merkle manifest and periodic runs against plain versions."""

import hashlib
import random
import string
import zlib

import duckdb
import numpy as np
import pytest
from llm_helpers import DOCS, SF, prose, table
from pyspark.sql import functions as F

from flowloom.llm import lines, merkle, runs
from flowloom.llm.queries import LEAF, QUERIES, SQL, planted_words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same_as_sql(spark, name, sf=SF):
    got = QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want.fetchall())


def counted(rows):
    return sorted(map(repr, rows))


# Lines

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_lines(rows, min_chars=10):
    """rows: (id, text); the lowest id keeps a key, a null id comes last."""
    big = lambda i: (i is None, i if i is not None else 0)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= min_chars and (k not in first or big(i) < big(first[k])):
                first[k] = i
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < min_chars or first[key(x)] == i]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return counted(out)


def check_lines(df, **more):
    got = lines.dedup_lines(df, **more)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert counted(tuple(r) for r in got.collect()) == plain_lines(rows, more.get("min_chars", 10))


def test_lines_query(spark):
    same_as_sql(spark, "op11_line_dedup")


def test_lines_of_odd_tables(odd_docs, no_docs):
    check_lines(odd_docs)
    assert lines.dedup_lines(no_docs).collect() == []


@pytest.mark.parametrize("batches, fan", [(1, 2), (5, 2)])
def test_lines_of_any_number_of_batches(spark, batches, fan):
    rng = random.Random(batches)
    pool = [prose(rng, rng.randrange(1, 6)) for _ in range(40)] + ["", "  Ärger MIT Umlauten ", "\tärger mit umlauten", "short", "x" * 10, "X" * 10 + "\x0b"]
    rows = [(i // 2 * 3, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12))), None, None, None) for i in range(120)]
    rows += [(None, "\n".join(pool), None, None, None), (7, "a line that all of them share\nown " * 3, None, None, None)]
    rows += [(i, "A line that all of them share\r\n" * 2, None, None, None) for i in range(1000, 1100)]
    check_lines(spark.createDataFrame(rows, DOCS).repartition(5), batches=batches, fan=fan)


def test_runs_are_compacted_and_disjoint(spark):
    held = lines.LineRuns(spark, fan=2, buckets=3)
    hashed = lines.line_hashes(spark.createDataFrame([(i, f"line number {i % 7}\nother line {i}", None, None, None) for i in range(50)], DOCS))
    added = [held.add(hashed.where(F.col("_fl_id").between(lo, lo + 9))).count() for lo in range(0, 50, 10)]
    assert added == [17, 10, 10, 10, 10]
    assert [len(level) for level in held.levels] == [1, 0, 1]
    assert held.all().count() == held.all().select(*lines.HASH).distinct().count() == 57
    merged = held.unseen(hashed.groupBy(*lines.HASH).agg(F.min("_fl_id").alias("_fl_id")))
    assert merged.count() == 0
    held.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fl_run_")]


def test_runs_are_read_without_a_shuffle(spark):
    held = lines.LineRuns(spark)
    hashed = lines.line_hashes(table(spark, "documents"))
    held.add(hashed)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = held.unseen(hashed.groupBy(*lines.HASH).agg(F.min("_fl_id").alias("_fl_id")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        held.close()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_ids_of_text(spark):
    rows = [("b", "the same long line\nz"), ("a", "y\nThe same long line "), ("c", "the same long line")]
    out = {r.doc_id: r.kept for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out == {"a": "y\nThe same long line ", "b": "z", "c": ""}


# Manifest


def plain_tree(nodes):
    """Root, and for each leaf its proof as (place, siblings)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            proofs[leaf].append((i % 3, "".join(run[: i % 3] + run[i % 3 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], proofs


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows, claimed=lambda row: row):
    """rows: tuples of LEAF; gives (id, leaf, subroot, root, proof digest, folded root, verified)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], sha("".join(map(field, row))), sha("".join(map(field, claimed(row))))))
    trees = {}
    for name, leaves in groups.items():
        leaves.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = (leaves, *plain_tree([leaf for _, leaf, _ in leaves]))
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    root, above = plain_tree([trees[g][1] for g in names])
    out = []
    for name, rest in zip(names, above, strict=True):
        leaves, sub, proofs = trees[name]
        for (key, leaf, claim), own in zip(leaves, proofs, strict=True):
            fold = claim
            for place, siblings in own + rest:
                fold = sha(siblings[: 64 * place] + fold + siblings[64 * place :])
            out.append((key, leaf, sub, root, sha("".join(s for _, s in own + rest)), fold, fold == root))
    return counted(out)


def without_breaks(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 2 or row[4] is None:
        return row
    return (*row[:4], row[4].replace("\n", ""))


def claimed_text():
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def test_manifest_query(spark):
    same_as_sql(spark, "op12_merkle_manifest")


def test_manifest_of_odd_tables(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select(*LEAF).collect()]
    for levels in (1, 7):
        got = merkle.manifest(odd_docs, "doc_id", "source", LEAF, claimed_text(), levels=levels, with_proof=False)
        assert counted(tuple(r) for r in got.collect()) == plain_manifest(rows, without_breaks)
    assert merkle.manifest(no_docs, "doc_id", "source", LEAF).collect() == []
    one = merkle.manifest(odd_docs.where("doc_id = 8"), "doc_id", "source", LEAF).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof == [] and one[0].verified


@pytest.mark.parametrize("seed, levels", [(0, 1), (1, 1), (2, 2)])
def test_butterfly_gives_every_block_its_upper_proof(spark, seed, levels):
    rng = random.Random(seed)
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 29, 100, 244] + [1] * rng.randrange(5, 12)
    rows = [(i, None if s == 0 else f"s{s}", None, i, f"t\n{i}") for s, n in enumerate(sizes) for i in rng.sample(range(10_000), n)]
    rng.shuffle(rows)
    rows += rows[:5]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS)
    got = merkle.manifest(df, "doc_id", "source", LEAF, claimed_text(), levels=levels)
    found = got.collect()
    assert counted(tuple(r) for r in got.drop("proof").collect()) == plain_manifest(rows, without_breaks)
    assert all(merkle.folded(r.leaf, [(p.place, p.siblings) for p in r.proof]) == r.root for r in found)
    assert {r.verified for r in found} == {True, False}


# Periodic runs


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def with_periods(rng, n, kinds):
    words = [str(rng.randrange(kinds)).encode() for _ in range(n)]
    for _ in range(rng.randrange(5)):
        a, p = rng.randrange(n), rng.randrange(1, 10)
        for i in range(a + p, min(n, a + p * rng.randrange(3, 9) + rng.randrange(p))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_small_texts(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [with_periods(rng, rng.randrange(1, 130), rng.choice([1, 2, 3, 6, 30])) for _ in range(rng.randrange(1, 10))] + [[]]
        got = [[tuple(r) for r in g.tolist()] for g in runs.runs_of(texts)]
        assert got == [plain_runs(w) for w in texts]
        assert all(runs.collapsed(w, np.array(g, np.int64).reshape(-1, 3)).encode() == plain_collapse(w, g) for w, g in zip(texts, got, strict=True))


def test_grammar_tells_exact_extensions():
    rng = np.random.default_rng(4)
    for kinds in (1, 2, 4):
        parts = [np.r_[100 + 2 * k, rng.integers(0, kinds, n), 101 + 2 * k] for k, n in enumerate((50, 1, 300))]
        s = np.concatenate(parts)
        g = runs.Grammar(s, 3)
        a, b = rng.integers(0, len(s), 400), rng.integers(0, len(s), 400)
        a, b = a[a != b], b[a != b]
        for forward, step in ((True, 1), (False, -1)):
            want = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                n = 0
                while s[x + step * n] == s[y + step * n]:
                    n += 1
                want.append(n)
            assert g.extension(a, b, forward).tolist() == want
        assert len(g.levels[-1].symbols) <= 3


def test_grid_in_pieces(monkeypatch):
    rng = random.Random(9)
    texts = [with_periods(rng, 200, 3) for _ in range(12)]
    want = [r.tolist() for r in runs.runs_of(texts)]
    monkeypatch.setattr(runs, "GRID_ROWS", 500)
    assert [r.tolist() for r in runs.runs_of(texts)] == want


@pytest.mark.parametrize("words", [[b"a"] * 200_000, [b"a", b"b", b"c"] * 70_000, [b"a"] * 99_999 + [b"b"] + [b"a"] * 100_000], ids=["one", "three", "broken"])
def test_long_runs_take_seconds(words):
    found = runs.runs_of([words])[0]
    assert found[:, 1].sum() >= len(words) - 1 and len(found) <= 2


def check_runs(got, rows):
    want = []
    for i, text in rows:
        words = planted_words(text or "", i)
        found = plain_runs(words)
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        want.append((
            i, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)),
            hashlib.sha256(plain_collapse(words, found)).hexdigest(),
        ))
    assert counted(tuple(r) for r in got.collect()) == counted(want)


def test_runs_query(spark):
    got = QUERIES["op13_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect() if len((r.text or "").split()) < 3_000]
    short = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    check_runs(got.join(short, "doc_id"), rows)


def test_runs_of_odd_tables(odd_docs, no_docs):
    got = {r.doc_id: r for r in runs.find_runs(odd_docs, keep=["doc_id", "text"]).collect()}
    assert got[7].n_words == 0 and got[7].runs == [] and got[7].collapsed == "" and got[7].text is None
    assert got[2**60 + 1].n_words == 30_000 and got[11].collapsed == b" ".join(got[11].text.encode().split()).decode()
    assert runs.find_runs(odd_docs).count() == odd_docs.count()
    assert runs.find_runs(no_docs).collect() == []
