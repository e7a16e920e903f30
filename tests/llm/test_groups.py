"""Near-duplicates, decontamination, packing, quality, pipeline."""

import collections
import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import xxhash
from flowloom.llm import decontam, packing, quality, simhash
from flowloom.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F

from llm_helpers import DOCS, SF, prose, table, texts_of


# ------------------------------------------------------------------ simhash
def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, names):
    values = np.array(values, np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, n in enumerate(names):
        if n is not None:
            least[find(i)] = min(n, least.get(find(i), n))
    return [least.get(find(i)) for i in range(len(values))]


def check_classes(df):
    rows = df.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = collections.Counter(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], plain_components(prints, [r.doc_id for r in rows]), strict=True))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_near_duplicates_query(spark):
    rows = table(spark, "documents").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components(prints, [r.doc_id for r in rows]), strict=True)}
    assert {tuple(r) for r in QUERIES["op9_simhash_near_dedup"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_near_duplicates_of_odd_tables(odd_docs, no_docs):
    check_classes(odd_docs)
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.one_of_each(no_docs).collect() == []
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    names = [plain_fingerprint(r.text) for r in kept.collect()]
    assert len(plain_components(names, range(len(names)))) == len(set(plain_components(names, range(len(names)))))
    every = [plain_fingerprint(t) for _, t in texts_of(odd_docs)]
    assert len(names) == len(set(plain_components(every, range(len(every)))))


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 2**64, 700, dtype=np.uint64)
    v = np.unique(np.concatenate([v, v[:300] ^ np.uint64(5), v[:200] ^ simhash.BITS[rng.integers(0, 64, 200)]]))
    q, hit = simhash.GrayIndex(v).search(v, 4)
    assert set(zip(q.tolist(), hit.tolist())) == set(map(tuple, np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4).tolist()))


def test_gray_ranks_put_neighbours_one_bit_apart():
    v = np.arange(256, dtype=np.uint64)
    walk = v[np.argsort(simhash.gray_rank(v))]
    assert (np.bitwise_count(walk[1:] ^ walk[:-1]) == 1).all()


@pytest.mark.parametrize("group", [4, 4096])
def test_groups_cut_into_sections_keep_their_links(spark, monkeypatch, group):
    """A chain and a ball of fingerprints that share blocks, with groups small enough to be cut."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(2)
    centre = 0x0F0F_1234_5678_9ABC
    values = {centre ^ (1 << a) ^ (1 << b) for a in range(40, 50) for b in range(50, 60)}
    chain = 0x7777_0000_1111_2222
    for _ in range(30):
        values.add(chain)
        for b in rng.sample(range(64), 4):
            chain ^= 1 << b
    values |= {rng.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "_fl_fp long")
    root = {r[0]: r[1] for r in simhash.components(simhash.links(fps)).select("_fl_fp", "_fl_root").collect()}
    got = collections.defaultdict(set)
    for v in values:
        got[root.get(simhash.signed(v), simhash.signed(v))].add(v)
    want = collections.defaultdict(set)
    for v, c in zip(values, plain_components(values, values), strict=True):
        want[c].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# ------------------------------------------------------------------ decontamination
def plain_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = decontam.words(t or "")
        for i, x in items:
            v = decontam.words(x or "")
            if not v:
                continue
            if len(v) < 5:
                hit = any(w[k : k + len(v)] == v for k in range(len(w)))
            else:
                s = decontam.shingles(v)
                hit = len(s & decontam.shingles(w)) >= 0.8 * len(s)
            if hit:
                out.add((d, i))
    return out


def test_decontamination_query(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_benchmark_decontamination"](spark, SF).collect()}
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    assert got and got == plain_leaks(texts_of(table(spark, "documents")), items)


def test_decontamination_of_planted_items(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(8)
    items = [(i, f"{prose(rng, 20)}. {prose(rng, 8)}.") for i in range(40)] + [(40, "one two"), (41, None), (42, ""), (43, prose(rng, 400)), (44, prose(rng, 300))]
    text = dict(items)
    docs = [(i, f"{prose(rng, 300)} {text[i].upper()} {prose(rng, 90)}") for i in range(20)]
    docs += [(50, text[43]), (51, "x one, TWO y"), (52, "two one"), (53, None), (54, ""), (55, " ".join(text[3].split()[:14])), (56, prose(rng, 20_000) + " " + text[44] + " " + prose(rng, 5_000))]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_leaks(docs, items)
    assert {(i, i) for i in range(20)} | {(50, 43), (51, 40), (56, 44)} == want

    def leaks(docs):
        return {(r.doc_id, x.item_id) for r in decontam.leaks_of(docs, b).collect() for x in r.leaks}

    assert leaks(d) == want
    monkeypatch.setattr(decontam, "GROUP_ITEMS", 7)  # several passes
    assert leaks(d) == want
    assert decontam.leaks_of(odd_docs, b).count() == odd_docs.count()
    assert decontam.leaks_of(no_docs, b).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.leaks == [] for r in decontam.leaks_of(d, none).collect())


def test_decontamination_of_near_copies(spark):
    """Items with a short last sentence, in documents without it, with a word of it changed, or with a word changed elsewhere."""
    rng = random.Random(10)
    items = [(i, f"{prose(rng, 40)}. {prose(rng, 1 + i % 4)}.") for i in range(30)]
    docs = []
    for i, t in items:
        body, last = t.split(". ")
        words = body.split()
        for k, part in enumerate((body, f"{body}. changed {' '.join(last.split()[1:])}", " ".join([*words[:20], "changed", *words[21:]]) + ". " + last)):
            docs.append((100 * k + i, f"{prose(rng, 60)} {part} {prose(rng, 60)}"))
    want = plain_leaks(docs, items)
    assert len(want) >= 80
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontam.leaks_of(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, x.item_id) for r in got for x in r.leaks} == want


def passage_leaks(docs, items):
    """(document, item, share) by the docstring: every passage of every document against every item."""
    out = collections.Counter()
    for d, t in docs:
        w = decontam.words(t or "")
        for i, x in items:
            parts = decontam.parts_of(x or "")
            n = sum(map(len, parts))
            if not n:
                continue
            cell, best = 2 ** max(6, n.bit_length()), 0.0
            for at in range(0, len(w), cell):
                here, k = w[at : at + 2 * cell], min(5, n)
                held = {tuple(here[j : j + k]) for j in range(len(here) - k + 1)}
                wanted = [{tuple(p[j : j + k]) for j in range(len(p) - k + 1)} for p in parts]
                best = max(best, min(len(v & held) / len(v) for v in wanted))
            if best >= 0.8:
                out[d, i, round(best, 6)] += 1
    return out


def test_decontamination_of_templates_answers_and_any_ids(spark, tmp_path):
    """Templated items, marked answers, marks inside words, text ids, null ids: query, SQL and brute force agree."""
    rng = random.Random(12)
    ask = "what is the name of the city that is the capital of"
    names = [prose(rng, 1) + str(i) for i in range(30)]
    items = [(f"t{i}", f"{ask} {x}") for i, x in enumerate(names)]
    qa = [(prose(rng, 12), prose(rng, n)) for n in (1, 4, 5, 9, 9)]
    items += [(f"q{i}", f"Question: {q}? Answer: {a}.") for i, (q, a) in enumerate(qa)]
    items += [(None, prose(rng, 25)), (None, prose(rng, 18)), (None, None), ("same", prose(rng, 20)), ("hi", "\u0915\u094d\u092f\u093e \u0939\u093f\u0928\u094d\u0926\u0940 \u092e\u0947\u0902 \u0932\u093f\u0916\u0928\u093e \u0906\u0938\u093e\u0928 \u0939\u0948")]
    items += [items[-2], ("short", "two words"), ("long", prose(rng, 300))]
    text = [t or "" for _, t in items]
    docs = [f"{prose(rng, 40)} {ask} {prose(rng, 30)}", f"{ask} {names[3]}", f"x {prose(rng, 100)} {ask} elsewhere", "what is the name of the city"]
    docs += [f"{prose(rng, 60)} {q} {prose(rng, 10)} {a} {prose(rng, 5)}" for q, a in qa] + [f"{prose(rng, 9)} {q} {prose(rng, 30)}" for q, _ in qa]
    docs += [f"{prose(rng, k)} {t} {prose(rng, 70)}" for k, t in zip((0, 50, 100, 120, 180) * 9, text) if t]
    docs += [f"{prose(rng, 500)} {text[-1]} {prose(rng, 700)}", text[-1], None, "", "two words", "two other words", f"{qa[4][0]} " + prose(rng, 200) + f" {qa[4][1]}"]
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = passage_leaks(list(enumerate(docs)), items)
    assert {(0, f"t{i}") for i in range(30)} <= {k[:2] for k in want} and any(i is None for _, i, _ in want)
    got = QUERIES["op2_benchmark_decontamination"](spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.item_id, r.share) for r in got) == want
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path / name}.parquet/*.parquet')")
    assert collections.Counter(con.execute(SQL["op2_benchmark_decontamination"]).fetchall()) == want


def test_no_accepted_passage_stays_under_the_threshold():
    rng = random.Random(13)
    few = [prose(rng, 1) for _ in range(12)]
    items = [(i, " ".join(rng.choices(few, k=rng.randrange(5, 40)))) for i in range(60)]
    idf, mean = decontam.statistics([items])
    for ix in decontam.build(items, idf, mean):
        for at, item in enumerate(ix.items):
            for _ in range(40):
                w = [x if rng.random() > 0.08 else "changed" for x in item.words]
                if item.confirmed(w):
                    score = sum(x for k in {ix.terms[x] for x in w if x in ix.terms} for i, x in ix.lists[k] if i == at)
                    assert score >= decontam.THRESHOLD - 1e-9


def test_block_maxima_and_wand_retrieve_all_above_the_threshold():
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(6, 30))) for i in range(60)]
    idf, mean = decontam.statistics([items])
    (ix,) = decontam.build(items, idf, mean)
    for _ in range(30):
        parts = rng.sample(items, 2)
        query = {k for w in decontam.words(f"{parts[0][1]} {prose(rng, 20)} {parts[1][1][:40]}") if (k := ix.terms.get(w)) is not None}
        scores = collections.Counter()
        for k in query:
            for at, x in ix.lists[k]:
                scores[at] += x
        want = {at for at, s in scores.items() if s >= decontam.THRESHOLD}
        assert {at for block in range(ix.blocks) for at in ix.wand(query, block)} == want


# ------------------------------------------------------------------ packing
def check_bins(rows, capacity, per_source):
    """rows: (doc, size, source, cluster, [(bin, offset, size)])."""
    bins = collections.defaultdict(list)
    for doc, size, source, cluster, pieces in rows:
        assert sum(n for *_, n in pieces) == size
        for b, o, n in pieces:
            bins[b].append((o, n, source, cluster))
    for held in bins.values():
        at = 0
        for o, n, *_ in sorted(held, key=lambda x: x[:2]):
            assert o == at
            at += n
        assert at <= capacity
        clusters = [c for *_, c in held if c is not None]
        assert len(clusters) == len(set(clusters))
        assert max(collections.Counter(s for _, _, s, _ in held if s is not None).values(), default=0) <= per_source
    return len(bins)


def plain_best_fit(rows, capacity, per_source):
    """The same order of placement, every bin tried each time."""
    bins = []
    for i in sorted(range(len(rows)), key=lambda i: (-(rows[i][0] % capacity), i)):
        size, source, cluster = rows[i]
        bins += [[0, [], []] for _ in range(size // capacity)]
        size %= capacity
        fits = [b for b in bins if b[0] >= size and cluster not in b[1] and b[2].count(source) < per_source] if size else []
        if size:
            best = min(fits, key=lambda b: b[0], default=None)
            if best is None:
                best = [capacity, [], []]
                bins.append(best)
            best[0] -= size
            best[1].append(cluster)
            best[2].append(source)
    return sorted(b[0] for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(0, 250), "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}", rng.randrange(40) if rng.random() < 0.5 else 1000 + i) for i in range(200)]
    placed = packing.pack(rows, 100, 2)
    assert check_bins([(i, *r, p) for i, (r, p) in enumerate(zip(rows, placed, strict=True))], 100, 2) > 0
    filled = collections.Counter()
    for p in placed:
        for b, _, n in p:
            filled[b] += n
    assert sorted(100 - n for n in filled.values()) == plain_best_fit(rows, 100, 2)


def check_packed(df, out, capacity=packing.CAPACITY, per_source=packing.PER_SOURCE):
    docs = {}
    for r in df.select("doc_id", "text", "source").collect():
        docs.setdefault(r.doc_id, []).append(((r.text or "").lower().encode().split(), r.source))
    pieces = collections.defaultdict(list)
    for r in out.collect():
        pieces[r.doc_id].append(r)
    assert set(docs) == set(pieces)
    rows = []
    for i, held in docs.items():
        assert sum(r.n_tokens for r in pieces[i]) == sum(len(w) for w, _ in held), (i, held, pieces[i])
        if len(held) == 1:
            (w, s), = held
            placed = [((r.shard, r.bin), r.bin_offset, r.n_tokens) for r in pieces[i] if r.bin is not None]
            rows.append((i, len(w), s, b" ".join(w), placed))
    assert len({d for d, *_ in rows}) == len(rows)
    return rows


def test_packing_query(spark):
    rows = check_packed(table(spark, "documents"), QUERIES["op1_best_fit_packing"](spark, SF))
    assert check_bins(rows, packing.CAPACITY, packing.PER_SOURCE) > 0


def test_packing_of_odd_tables(spark, odd_docs, no_docs):
    check_packed(odd_docs, packing.pack_documents(odd_docs))
    assert packing.pack_documents(no_docs).collect() == []
    empty = [r for r in packing.pack_documents(odd_docs).collect() if r.doc_id in (7, 8, 9)]
    assert len(empty) == 3 and all((r.n_tokens, r.bin) == (0, None) for r in empty)
    with pytest.raises(ValueError):
        packing.pack_documents(no_docs, capacity=0)


# ------------------------------------------------------------------ quality
def test_quality_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op4_quality_classifier"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.where("quality = 1"), labels.where("false")):
        model = quality.train(odd_docs, marks)
        rows = quality.score(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(no_docs, quality.train(no_docs, labels)).collect() == []


def test_descent_reaches_the_optimum_of_a_small_problem(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1000)
    monkeypatch.setattr(quality, "MIX", 1.0)
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(20) < 0.4).astype(np.int32) for _ in range(60)]
    values = [np.ones(len(r)) for r in rows]
    y = np.array([1.0 if 3 in r or 5 in r else -1.0 for r in rows])
    w = quality.descend(rows, values, y)
    hinge = lambda w: 0.5 * w @ w + sum(max(0, 1 - t * (w[r].sum() + w[-1])) for r, t in zip(rows, y, strict=True))
    best = hinge(w)
    for _ in range(200):
        step = np.zeros_like(w)
        step[rng.integers(0, 20)] = rng.normal() * 0.1
        assert hinge(w + step) > best - 5e-3 * best


@pytest.mark.parametrize("kind", ["long", "string"])
def test_one_of_each_on_repeated_rows_and_odd_ids(spark, kind):
    """Rows that repeat stay once, a null id comes before others, texts of one id are told apart, columns stay."""
    rows = [("1", "a b c d e"), ("1", "a b c d e"), ("2", "a b c d e"), (None, "q r s t u v"), ("3", "q r s t u v"), ("4", None), ("5", "zz yy xx ww"), ("5", "k l m n o p q")]
    df = spark.createDataFrame(rows, "doc_id string, text string").select(F.col("doc_id").cast(kind), F.lit(7).alias("_key"), "text")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    want = [("1", "a b c d e"), (None, "q r s t u v"), ("4", None), ("5", "zz yy xx ww"), ("5", "k l m n o p q")]
    assert sorted(((None if r.doc_id is None else str(r.doc_id), r.text) for r in got.collect()), key=str) == sorted(want, key=str)


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark):
    docs = table(spark, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, SF)
    assert good.dtypes == docs.dtypes
    kept = {r.doc_id for r in good.collect()}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    one = stage["near duplicates"](spark, docs, SF)
    assert one.dtypes == docs.dtypes
    prints = {i: plain_fingerprint(r.text) for i, r in rows.items()}
    names = dict(zip(rows, plain_components(list(prints.values()), list(rows)), strict=True))
    assert {r.doc_id for r in one.collect()} == set(names.values())
    clean = stage["decontamination"](spark, docs, SF)
    assert clean.dtypes == docs.dtypes
    leaks = {d for d, _ in plain_leaks([(i, r.text) for i, r in rows.items()], items)}
    assert {r.doc_id for r in clean.collect()} == set(rows) - leaks
    hidden = stage["secret scans"](spark, docs, SF)
    assert hidden.dtypes == docs.dtypes
    for r in hidden.collect():
        assert r.n_chars == len(r.text) and (r.text == rows[r.doc_id].text or "[assign]" in r.text or "[hex]" in r.text or "[access]" in r.text or "[random]" in r.text)


def test_pipeline_run_is_its_stages(spark):
    docs = table(spark, "documents")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    got, want = (collections.Counter(map(tuple, x.collect())) for x in (corpus_pipeline.run(spark, SF), docs))
    assert got and got == want


def test_pipeline_stages_of_odd_tables(spark, odd_docs, no_docs):
    plain = odd_docs.select([f.name for f in DOCS.fields])
    for name, f in corpus_pipeline.STAGES:
        for docs in (odd_docs, plain, no_docs):
            out = f(spark, docs, SF)
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            if docs is no_docs:
                assert rows == []
