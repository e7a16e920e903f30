"""Queries of the numbered operators over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import chat, quality
from flowloom.llm.common import table
from flowloom.llm.decontam import leaks_of
from flowloom.llm.hnsw import nearest
from flowloom.llm.html import extract_pages
from flowloom.llm.licenses import scan_licenses
from flowloom.llm.lines import dedup_lines
from flowloom.llm.merkle import manifest
from flowloom.llm.packing import pack_documents
from flowloom.llm.runs import find_runs, words_of
from flowloom.llm.secrets import find_secrets
from flowloom.llm.simhash import near_duplicates
from flowloom.llm.tokens import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it contains."""
    found = leaks_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    leak = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leak.select("doc_id", F.col("leak.item_id").alias("item_id"), F.round("leak.share", 6).alias("share"))


#: Lesser share of the word five-shingles of an item's parts in a passage; the parts are question and answer, where they are marked.
SQL["op2_benchmark_decontamination"] = """WITH d AS (SELECT row_number() OVER () AS dn, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM documents),
 q AS (SELECT row_number() OVER () AS bn, item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w,
   regexp_extract_all(regexp_extract(lower(text), '(?s)^(.*?)\\banswer\\s*:(.*)$', 1), '[\\p{L}\\p{M}\\p{N}_]+') AS qw,
   regexp_extract_all(regexp_extract(lower(text), '(?s)^(.*?)\\banswer\\s*:(.*)$', 2), '[\\p{L}\\p{M}\\p{N}_]+') AS aw FROM benchmark),
 parts AS (SELECT bn, item_id, len(w) AS n, w, 1 AS part FROM q WHERE len(qw) < 5 OR len(aw) < 5
   UNION ALL SELECT bn, item_id, len(qw) + len(aw), qw, 1 FROM q WHERE len(qw) >= 5 AND len(aw) >= 5
   UNION ALL SELECT bn, item_id, len(qw) + len(aw), aw, 2 FROM q WHERE len(qw) >= 5 AND len(aw) >= 5),
 b AS (SELECT *, 1 << greatest(6, len(bin(n))) AS cell, least(5, len(w)) AS k FROM parts WHERE n > 0),
 bs AS (SELECT DISTINCT bn, part, cell, w[i:i + k - 1] AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
 size AS (SELECT bn, part, count(*) AS n FROM bs GROUP BY 1, 2),
 total AS (SELECT bn, count(*) AS parts FROM size GROUP BY 1),
 ks AS (SELECT DISTINCT k FROM b),
 ds AS (SELECT dn, k, i - 1 AS pos, w[i:i + k - 1] AS s FROM (SELECT dn, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks)),
 met AS (SELECT dn, bn, part, s, pos, k, cell, pos // cell AS c FROM ds JOIN bs USING (s)),
 placed AS (SELECT dn, bn, part, s, c FROM met UNION ALL SELECT dn, bn, part, s, c - 1 FROM met WHERE c > 0 AND pos + k <= (c + 1) * cell),
 held AS (SELECT dn, bn, c, part, count(DISTINCT s) AS hits FROM placed GROUP BY ALL),
 good AS (SELECT dn, bn, c, hits::DOUBLE / n AS share FROM held JOIN size USING (bn, part) WHERE 5 * hits >= 4 * n),
 whole AS (SELECT dn, bn, c, min(share) AS share, count(*) AS parts FROM good GROUP BY 1, 2, 3)
SELECT doc_id, item_id, round(max(share), 6) AS share FROM whole JOIN total USING (bn, parts) JOIN d USING (dn) JOIN q USING (bn)
GROUP BY dn, bn, doc_id, item_id"""


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model).withColumn("held_out", quality.held_out("doc_id"))
    return out.withColumn("predicted", (F.col("score") >= quality.KEEP_FROM).cast("int"))


#: A conversation whose texts hold the template's own control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def escaped_sql(column: str, more: str = "") -> str:
    return f"regexp_replace({column}, '(\\\\|###|</turn>{more})', '\\\\\\1', 'g')"


SQL["op5_chat_formatting"] = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum({len(chat.OPEN)} + length({escaped_sql('role', '|:')}) + 2 + length({escaped_sql('text')}) + {len(chat.CLOSE)})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    nodes, examples = chat.tree(given.unionByName(own))
    return chat.read_back(nodes, examples).withColumnRenamed("conv", "conv_id")


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_BLANK = " || ".join(f"chr({ord(c)})" for c in " \t\n\x0b\x0c\r")
SQL["op11_line_dedup"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
 k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 f AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY 1),
 m AS (SELECT k.*, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id"""


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), "doc_id", "source", LEAF, {"text": text}, with_proof=False)


#: CRC-32 (reflected polynomial 3988292384) of a decimal number, byte by byte and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f}::VARCHAR END" for f in [*LEAF[:-1], text]) + ")"


def _levels_sql(name: str, source: str) -> str:
    """All levels of each tree of ``source`` (tree, nodes), the lowest first."""
    return f"""{name} AS (SELECT tree, 0 AS level, nodes FROM {source}
  UNION ALL SELECT tree, level + 1, [sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')) FOR i IN range((len(nodes) + 2) // 3)] FROM {name} WHERE len(nodes) > 1)"""


def _proof_sql(name: str, levels: str, leaves: str) -> str:
    """For each leaf (tree, pos): places and siblings of its levels, and the root."""
    return f"""{name}_up AS (SELECT l.tree, l.pos, v.level, l.pos // (3 ** v.level)::BIGINT AS i, v.nodes FROM {leaves} l JOIN {levels} v USING (tree)),
 {name} AS (SELECT tree, pos, list({{'p': i % 3, 's': array_to_string(list_concat(nodes[i - i % 3 + 1:i], nodes[i + 2:i - i % 3 + 3]), '')}} ORDER BY level)
   FILTER (len(nodes) > 1) AS proof, max(nodes[1]) FILTER (len(nodes) = 1) AS root FROM {name}_up GROUP BY ALL)"""


SQL["op12_merkle_manifest"] = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf_sql('text')} AS leaf,
  CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS claim FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos FROM d),
 g AS (SELECT tree, list(leaf ORDER BY pos) AS nodes FROM r GROUP BY 1), {_levels_sql('v', 'g')}, {_proof_sql('low', 'v', 'r')},
 s AS (SELECT tree AS name, '' AS tree, root AS leaf, row_number() OVER (ORDER BY tree) - 1 AS pos FROM (SELECT DISTINCT tree, root FROM low)),
 sg AS (SELECT tree, list(leaf ORDER BY pos) AS nodes FROM s GROUP BY 1), {_levels_sql('sv', 'sg')}, {_proof_sql('high', 'sv', 's')},
 f AS (SELECT doc_id, r.leaf, r.claim, low.root AS subroot, high.root AS root, list_concat(coalesce(low.proof, []), coalesce(high.proof, [])) AS proof
  FROM r JOIN low USING (tree, pos) JOIN s ON s.name = r.tree JOIN high ON high.pos = s.pos),
 e AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x.s FOR x IN proof], '')) AS proof_sha256,
  list_reduce(list_concat([claim], [x.p || x.s FOR x IN proof]), lambda h, x: sha256(substr(x, 2, 64 * x[1]::INT) || h || substr(x, 2 + 64 * x[1]::INT))) AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM e"""


def planted_words(text: str, doc_id: int | None) -> list[bytes]:
    """Words of a text; by its id, every tenth text repeats a stretch of its words to its end."""
    words = words_of(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), words=planted_words, others=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("n"), (-r.start).alias("s"), (-r.period).alias("p"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    out = found.withColumn("_fl_top", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_fl_top.start").alias("start"), F.col("_fl_top.n").alias("length"),
        F.col("_fl_top.period").alias("period"), F.floor(1000 * F.col("_fl_top.n") / F.col("_fl_top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
