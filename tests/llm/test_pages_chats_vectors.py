"""Page extraction, chat formatting, nearest neighbours."""

import collections
import hashlib
import html as references
import random
import re
import time

import numpy as np
import pytest
from flowloom.llm import chat, hnsw
from flowloom.llm import html as pages
from flowloom.llm.queries import HOSTILE, QUERIES

from llm_helpers import SF, table


# ------------------------------------------------------------------ pages
def article(source):
    a = re.search(r"(?s)<article>(.*)</article>", source)[1]
    return " ".join(references.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", a))).split())


def test_pages_query(spark):
    got = {r.page_id: r for r in QUERIES["op3_html_extraction"](spark, SF).collect()}
    given = table(spark, "pages").collect()
    assert len(got) == len(given)
    for r in given:
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_main_text_leaves_the_rest_out():
    source = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id=menu><a href=x>m</a></div>
    <div class="content with-sidebar"><div class="post"><h2>T &amp;amp; x</h2><p>One<br>two <i>th</i>ree &nbsp; four<p>Five<ul><li>a<li>b</ul>
    <div class="ad-box">buy</div><script>var a="</p>"</script><table><tr><td>c1<td>c2</table></div></div>
    <div class=comments><p>a long comment of a reader, longer than anything else on this page, again and again and again and again</p></div>
    <div class="cookie-notice">We use</div><form><p>f</p></form><aside>x</aside><footer>f</footer></body>"""
    text = pages.main_text(source, None)[0]
    assert text.split()[:3] == ["T", "&amp;", "x"] and text.endswith("four Five a b c1 c2")
    assert not any(w in text for w in ("Site", "buy", "reader", "We use", "var"))


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), ("plain <b>te</b>xt", "plain text"), ("<p>a <!-- x", "a"), ("a < b <p class=\"x>y", "a < b y"), ("<p>a<script>b", "a"),
    ("<p title=\"a > b\">ok &lt;b&gt; &#x41;&copy</p>z", "ok <b> A© z"), ("<div>" * 2000 + "deep", "deep"), ("<p>  a \n\t b　</p><p> </p><p>c", "a b c"),
    ("<textarea>no</textarea><ul><li>x</li></ul><p>y", "x y"),
])
def test_main_text_of_odd_markup(source, text):
    assert pages.main_text(source, None)[0] == text


def test_hosts_agree_on_a_path(spark, no_docs):
    """The page whose largest container is an advert follows the other pages of its host."""
    body = lambda a, b: f"<body><div class='story{a}'><p>{'word ' * 30}{a}</p></div><div class='extra'><p>{b}</p></div></body>"
    rows = [(i, "http://h.example/a", body(i, "short")) for i in range(6)] + [(6, "http://H.example:80/b", body(6, "long " * 90))]
    rows += [(7, None, body(7, "long " * 90)), (8, "http://h.example/", None), (9, "http://h.example/", ""), (10, "nonsense", "<p>x"), (None, None, None), (0, "http://h.example/a", body(0, "short"))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, path string")
    got = {(r.page_id, r.text) for r in pages.extract_pages(df).collect()}
    assert (6, ("word " * 30 + "6").strip()) in got
    assert (7, ("long " * 90).strip()) in got  # without a host it is alone
    assert {(8, ""), (9, ""), (10, "x"), (None, "")} <= got
    assert pages.extract_pages(df).count() == len(rows)
    assert pages.extract_pages(df.limit(0)).collect() == []


def test_host_votes_out_what_stands_around_its_articles(spark):
    """Fifty pages of each layout: footers, side columns and notices without a known class go, headings and leads stay."""
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    side = say(40)
    layouts = {
        "foot": "<div class=wrap><div class=content><p>{0}</p><p>{1}</p></div><div class=bottomLine>Copyright Example Press</div></div>",
        "side": "<div id=page><div class=leftcol><p>" + side + "</p></div><div class=post><h1>{0}</h1><p>{1}</p></div></div>",
        "note": "<div class=app><div class=hint>We store small files</div><div class=story><p>{0}</p><p>{1}</p></div></div>",
        "lead": "<div class=all><div class=lead><p>{0}</p></div><div class=text><p>{1}</p></div><div class=end>Printed on paper</div></div>",
    }
    rows, want = [], {}
    for k, (host, layout) in enumerate(layouts.items()):
        for i in range(50):
            a, b = say(rng.randrange(5, 9)), say(rng.randrange(20, 200))
            want[100 * k + i] = f"{a} {b}"
            rows.append((100 * k + i, f"https://{host}.example/{i}", f"<body>{layout.format(a, b)}</body>"))
    rows += [(1000 + i, "https://copies.example/", f"<body>{layouts['lead'].format('same lead here', 'one text ' * 30)}</body>") for i in range(30)]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == want
    assert got[1000].startswith("same lead here one text")  # copies of one article say nothing about their host


@pytest.mark.parametrize("name", ["readerComments", "commentlist", "siteFooter", "cookieBanner", "adsbygoogle", "user-comments", "topNavbar", "advertBox"])
def test_names_in_one_word(name):
    source = f"<div class=wrap><div class=story><p>{'word ' * 40}</p><div class={name}>gone gone</div></div><div id={name}>gone</div></div>"
    assert pages.main_text(source, None)[0] == ("word " * 40).strip()


@pytest.mark.parametrize("name", ["address", "adsorption", "commentary", "radsport", "headline"])
def test_names_that_only_look_alike(name):
    assert pages.main_text(f"<div class={name}><p>kept text</p></div>", None)[0] == "kept text"


@pytest.mark.parametrize("source", [
    "<!--><article><p>ok</p></article>", "<!---><article><p>ok</p></article>", "<!-- x --!><article><p>ok</p></article>",
    "<svg><title>t<path></svg><article><p>ok</p></article>", "<svg><title>t<article><p>ok</p></article>", "<p><svg><title/></svg></p><article>ok</article>",
])
def test_comments_and_drawings_end(source):
    assert pages.main_text(source, None)[0] == "ok"


def test_deep_nesting_takes_linear_time():
    n = 12_000
    sources = ["".join(f"<div class='ad-{i}'>x" for i in range(n)), "<span>" * n + "</b>" * n + "<hr>x" * n, "<p>" + "<i>" * n + "<hr>y" * n, "<div>x" * n]
    for source in sources:
        start = time.process_time()
        pages.main_text(source, ["a", "b"])
        assert time.process_time() - start < 4


def test_long_paths_stay_apart():
    page = pages.Page("<div class=a>" * 400 + "<div class=left><p>one</div><div class=right><p>two two two</div>")
    assert page.best()[0] and len(set(page.paths)) == len([t for t in page.tags if t in pages.VOTING]) + 1
    assert max(map(len, page.paths)) < pages.LONGEST_PATH + 50


def test_each_template_of_a_host_has_its_path(spark):
    """A smaller template, and a single page of a third one, have a short element on the first one's path."""
    first = lambda i: f"<body><div class=content><p>{'word ' * 60}{i}</p></div></body>"
    other = lambda name, n, i: f"<body><div class=content><p>teaser</p></div><section class={name}><p>{'text ' * n}{i}</p></section></body>"
    rows = [(i, "http://h.example/a", first(i)) for i in range(8)] + [(i, "http://h.example/b", other("story", 6, i)) for i in range(8, 12)]
    rows += [(12, "http://h.example/c", other("single", 40, 12))]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"{'word ' * 60}{i}" for i in range(8)} | {i: f"{'text ' * 6}{i}" for i in range(8, 12)} | {12: f"{'text ' * 40}12"}
    assert got == want


def test_winners_too_large_to_broadcast(spark, monkeypatch):
    want = {r.page_id: r.text for r in QUERIES["op3_html_extraction"](spark, SF).collect()}
    monkeypatch.setattr(pages, "WINNERS_BYTES", 0)
    assert {r.page_id: r.text for r in QUERIES["op3_html_extraction"](spark, SF).collect()} == want


P = "word " * 200


@pytest.mark.parametrize(("source", "text"), [
    (f"<body><article><h1>title</h1><div class=body><p>{P}</p></div></article><div>x</div></body>", f"title {P}"),
    (f"<article><p>{'lead ' * 20}</p><ul><li>{P}</ul></article>", f"{'lead ' * 20}{P}"),
    (f"<table><tr><td>{'lead ' * 20}<td>{P}</table>", f"{'lead ' * 20}{P}"),
    (f"<body><div class=post><h2>t</h2><div class=lead>a</div><div class=body><p>{P}</p></div><section>{'more ' * 50}</section></div><div>x</div></body>", f"t a {P}{'more ' * 50}"),
    (f"<main><h1>t</h1><article>{P}</article></main><div>x</div>", f"t {P}"),
    (f"<main><article>{P}</article><article class=teaser>other</article></main>", P),
    (f"<div id=page><div class=body>{P}</div><div><a href=x>{'link ' * 30}</a></div></div>", P),
    (f"<body><h1>t</h1><div>{P}</div></body>", f"t {P}"),
    (f"<body><div class=a>{P}</div>Copyright<div class=b>x</div></body>", P),
])
def test_page_climbs_to_the_whole_article(source, text):
    assert pages.main_text(source, None)[0] == text.strip()


@pytest.mark.parametrize(("source", "text"), [
    (f"<body><div class=content-sidebar-wrap><main><p>{P}</p></main><div class=sidebar>x</div></div></body>", P),
    (f"<body><div class=entry><h1>t</h1>{f'<div class=elementor-widget><p>{P}</p></div>' * 3}</div></body>", f"t {P}{P}{P}"),
    (f"<body><div class=article-with-comments><p>{P}</p></div></body>", P),
    (f"<body><div class=post-share-wrap><article><p>{P}</p></article></div></body>", P),
    (f"<body><article id=search-results-article><p>{P}</p></article></body>", P),
    (f"<body><div class=post><p>{P}</p></div><div class=related-posts><article>{'teaser ' * 9}</article></div></body>", P),
    (f"<main><div class=post><p>{P}</p></div><div id=comments><article class=comment-body>{P}{P}</article></div></main>", P),
    (f"<body><article>{P}</article><div class=comment-list>{P}{P}{P}</div></body>", P),
    (f"<body><p class=comment>{P}</p></body>", P),
])
def test_marked_names_alone_do_not_drop_the_article(source, text):
    assert pages.main_text(source, None)[0] == text.strip()


@pytest.mark.parametrize(("source", "text"), [
    ("<p>a<div class=ad data-content=\"<b>x</b>\">buy</div><p>b", "a b"), ("<p title='a<b'>ok</p>", "ok"), ("<p data-v2=\"class='ad'\" title=\"1 < 2 > 0\">ok", "ok"),
    ("<p>it's <b don't>ok</b> it's", "it's ok it's"), ("<a href=x?y=\"z>t</a> \"u\"", "t \"u\""), ("<p title=\"x <b>y</b>", "<p title=\"x y"), ("<p a='<i' <b>y", "<p a='<i' y"),
])
def test_quoted_attributes_hold_anything(source, text):
    assert pages.main_text(source, None)[0] == text


@pytest.mark.parametrize("part", ['<a b="<a " ', "<a b='", '<a b="<a>" ', '<a b="<a>"<', '<a b=', "<a b=\"'<'", "< <a", '<a b="c'])
def test_broken_markup_is_read_in_linear_time(part):
    began = time.process_time()
    pages.main_text(part * (400_000 // len(part)), None)
    assert time.process_time() - began < 20


# ------------------------------------------------------------------ chats
def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check_chats(rows, got):
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[c].append((r or "", x or ""))
    assert {r[0] for r in got} == set(want)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(want[r[0]])
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in want[r[0]])


def test_chat_query(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)]
    check_chats(rows, QUERIES["op5_chat_formatting"](spark, SF).collect())


CHATS = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "d"), (3, 0, "user", "a"),
    (4, 0, "assistant", "a"), (5, 0, None, None), (5, 1, "assistant", None), (6, None, "user", "x"), (6, 3, "a: b\\", "\\\\### </turn>\n#### \\### x"),
    (7, 0, "system", "é\U0001f600" * 2000), (None, 0, "user", "a"), (8, 0, "user", "a"), (8, 1, "assistant", "</turn>\n### user: a</turn>\n"),
]


def test_tree_of_small_conversations(spark):
    df = spark.createDataFrame([(*c, 1, 2) for c in CHATS], "conv_id long, turn long, role string, text string, node string, depth int")
    nodes, examples = chat.tree(df)
    check_chats(CHATS, chat.read_back(nodes, examples).collect())
    at = {r.node: r for r in nodes.collect()}
    stream = sorted(at.values(), key=lambda r: r.start)
    # One place for each token, no gaps; a node comes after its parent and before what is not below it.
    assert stream[0].start == 0 and all(a.end == b.start for a, b in zip(stream, stream[1:]))
    assert all(r.end - r.start == len(r.tokens) for r in stream)
    stack = []
    for r in stream:
        while stack and stack[-1] != r.parent:
            stack.pop()
        assert (r.parent is None) == (r.depth == 0) and (r.parent is None or stack[-1] == r.parent)
        assert r.position == sum(len(at[n].tokens) for n in stack)
        stack.append(r.node)
    firsts = [r for r in stream if bytes(r.tokens).startswith(b"### user: a</turn>") and r.depth == 0]
    assert len(firsts) == 1  # five conversations begin with it
    for e in examples.collect():
        want = 0
        for depth, i in enumerate(e.intervals):
            assert (i.depth, i.start, i.end, i.position) == (depth, at[i.node].start, at[i.node].end, want)
            assert at[i.node].position == want
            want += i.end - i.start


def test_no_conversations(spark):
    nodes, examples = chat.tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.collect() == [] and examples.collect() == [] and chat.read_back(nodes, examples).collect() == []


# ------------------------------------------------------------------ vectors
def plain_nearest(rows, q, top):
    x = {i: np.array(v, float) for i, v in rows}
    order = sorted((-(x[q] @ v), i) for i, v in x.items() if i != q)[:top]
    return [(i, -s) for s, i in order]


def test_vectors_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "embeddings").collect()]
    got = collections.defaultdict(list)
    for r in QUERIES["op8_nearest_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = {i: np.array(v, float) for i, v in rows}
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert [k for k, *_ in found] == list(range(1, 21)) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(x[q] @ x[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in plain_nearest(rows, q, 20)})
    assert hits >= 0.95 * 20 * len(got)


@pytest.mark.parametrize("shard", [40, 10_000])
def test_vectors_with_copies_and_lengths(spark, shard):
    """A third of the vectors are one vector, lengths differ, shards are few or many."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.integers(1, 4)).astype(np.float32).tolist()) for i in range(300)]
    rows = [(i, rows[3][1] if i % 3 == 0 else v) for i, v in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0"), shard=shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        want = plain_nearest(rows, q, 20)
        if q % 3 == 0:
            assert [i for i, _ in found][:1] == [want[0][0]]
        hits += len({i for i, _ in found} & {i for i, _ in want})
    assert len(got) == 15 and hits >= 0.95 * 20 * 15


def test_vectors_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (20, [1.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in hnsw.nearest(df, df.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 7, 0.5)]
    assert hnsw.nearest(df.limit(0), df.limit(0)).collect() == []
    assert hnsw.nearest(df.where("vec_id = 2"), df).collect() == []
    assert hnsw.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).collect() == []


def test_copies_of_a_hot_vector_keep_the_smallest_ids(spark):
    rng = random.Random(1)
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(1000 + i, [rng.random(), rng.random()]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in hnsw.nearest(df, df.where("vec_id = 100")).orderBy("rank").collect()]
    assert got == list(range(20))


def drawn(kind, n, d=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d))
    if kind == "raw":
        return x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * np.exp(rng.normal(0, 0.5, (n, 1))) if kind == "log-normal" else x


def recall_of(x, found, queries, top=20):
    """Mean share of the ``top`` largest inner products that were found; ``found`` maps a query to ids."""
    hits = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:top].tolist()) & set(found[q]))
    return hits / (top * len(queries))


@pytest.mark.parametrize("kind", ["raw", "log-normal", "unit"])
def test_recall_on_a_full_shard(kind):
    x, names = drawn(kind, hnsw.SHARD), np.arange(0, 16_000, 400)
    graph = hnsw.Graph.build(hnsw.unit(x))
    ids = np.arange(len(x))
    found = collections.defaultdict(list)
    for q, i, _ in hnsw.best_of(ids, ids, x, graph, x[names], names, 20, hnsw.BEAM, 21):
        found[q].append(i)
    assert recall_of(x, found, names.tolist()) >= 0.95


@pytest.mark.parametrize("kind", ["raw", "log-normal"])
def test_recall_over_several_shards(spark, kind):
    x = drawn(kind, 3_000, 32, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0"), shard=1_000).collect():
        found[r.query_id].append(r.vec_id)
    assert recall_of(x, found, range(0, 3_000, 50)) >= 0.95


def test_each_length_is_searched_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0"), shard=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert len(got) == 10
    for q, found in got.items():
        same = [(i, v) for i, v in rows if len(v) == len(rows[q][1])]
        assert len(found) == 20 and len({i for i, _ in plain_nearest(same, q, 20)} & set(found)) >= 19
