"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleepsignal.llm import ann, decontaminate, jaccard, langid, license, online_packing, packing, prefix_trie, quality, rans, spelling, toxicity, warc
from sleepsignal.llm.common import fold, read_table, shared_folder
from sleepsignal.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as range-coded ids and read back: doc_id, start, n_tokens, ids_crc32."""
    return rans.encode_corpus(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


ORACLE["op2_warc_archive"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::BIGINT, 5))::INTEGER >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""


@query
def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back by ranges: one row per page."""
    folder = shared_folder(spark, "warc")
    written = warc.write_warc(read_table(spark, sf_dir, "pages"), folder, min_revisit_bytes=0)
    records = warc.read_warc(spark, warc.list_warc(spark, folder))
    records = cut(records.select("file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    warc.check_counts(written, records)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids: one row per piece."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=2048, end_id=0)


def classified(scored: DataFrame, held_out: int, folds: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op5_positive_unlabelled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity: doc_id, held_out, score, predicted."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, labels, "_score")
    return classified(scored, toxicity.HELD_OUT, toxicity.FOLDS, toxicity.THRESHOLD)


@query
def op8_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality: doc_id, held_out, score, predicted."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, labels, "_score")
    return classified(scored, quality.HELD_OUT, quality.FOLDS, quality.THRESHOLD)


@query
def op10_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language: doc_id, held_out, lang_pred, score."""
    docs = langid.identify(read_table(spark, sf_dir, "documents"), "_language")
    return docs.select("doc_id", (fold("doc_id", langid.FOLDS) == langid.HELD_OUT).alias("held_out"), "_language.lang_pred", "_language.score")


ORACLE["op7_minhash_forest_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
roots AS (SELECT x, min(y) AS root FROM r GROUP BY x),
ends AS (SELECT x, count(*) AS n_links, min(y) FILTER (WHERE same) AS copy FROM l GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(root, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, least(doc_id, coalesce(copy, doc_id)) AS copy_id
FROM documents LEFT JOIN roots ON roots.x = doc_id LEFT JOIN ends ON ends.x = doc_id
"""


@query
def op7_minhash_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and its number of links."""
    return jaccard.similarity_join(read_table(spark, sf_dir, "documents"))


@query
def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its verified overlap with the benchmark."""
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op6_nn_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all others."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op4_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licence families of its paragraphs."""
    docs = license.scan_licences(read_table(spark, sf_dir, "documents"), "_licences")
    return docs.select("doc_id", F.array_join("_licences.families", ",").alias("families"), "_licences.n_paragraphs", "_licences.score")


@query
def op13_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed online into sequences of 4096 ids: one row per piece."""
    return online_packing.pack_online(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=4096, end_id=2)


#: crc32 of a list of bytes ``b`` in SQL, over a table made from the polynomial.
CRC_TABLE = """SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)"""
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295::BIGINT)"

ORACLE["op12_spelling_variants"] = f"""
WITH RECURSIVE tab AS ({CRC_TABLE}),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
d AS (SELECT doc_id, r, count(*) AS n FROM r WHERE length(r) >= 6 GROUP BY ALL),
b AS (SELECT r, n, regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)), '..') AS hx FROM d),
h AS (SELECT r, n, {CRC.format(b="list_transform(hx, lambda x: ('0x' || x)::BIGINT)")} AS h FROM b, tab),
c AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, n FROM h),
v AS (SELECT w, sum(n)::BIGINT AS n FROM c WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
p AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
q AS (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS less FROM p),
near AS (SELECT a.w AS x, b.w AS y, b.n FROM q a JOIN q b ON a.less = b.less AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, v.w, v.n FROM q a JOIN v ON a.less = v.w UNION SELECT v.w, a.w, a.n FROM q a JOIN v ON a.less = v.w),
m AS (SELECT x, count(*) AS n_near, min_by(y, (-n, y)) AS y, max(n) AS n FROM near GROUP BY x),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m.n >= 5 * v.n THEN y END AS form, CASE WHEN m.n >= 5 * v.n THEN m.n END AS form_n FROM v LEFT JOIN m ON m.x = v.w),
t AS (SELECT w, w AS far, form AS next FROM f UNION ALL SELECT t.w, f.w, f.form FROM t JOIN f ON f.w = t.next)
SELECT f.w AS word, form, far AS root, n, n_near, form_n FROM f JOIN t ON t.w = f.w AND t.next IS NULL
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with their near words, form and root."""
    return spelling.spelling_variants(spelling.word_counts(read_table(spark, sf_dir, "documents")))


ORACLE["op11_conversation_prefix_trie"] = f"""
WITH tab AS ({CRC_TABLE}),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM o),
h AS (SELECT conv_id, {CRC.format(b="b")} % 4 AS h FROM c, tab),
r AS (SELECT h.conv_id, 0 AS own, k, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND k <= h
  UNION ALL SELECT h.conv_id, 1, k, role, text FROM h JOIN o USING (conv_id) WHERE k > h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS depth, sha256(length(role) || ':' || role || text) AS s, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
p AS (SELECT conv_id, depth, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node, w FROM t UNION ALL SELECT conv_id, 0, '', 0 FROM h),
n AS (SELECT node, min(conv_id) AS conv_id, max(depth) AS depth, count(*) AS n_convs, max(w) AS w FROM p GROUP BY node),
l AS (SELECT conv_id, max(depth) AS m FROM p GROUP BY conv_id),
e AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s FROM p JOIN l USING (conv_id) WHERE depth = m GROUP BY node),
k AS (SELECT u.node, min(u.conv_id) AS up, count(*) AS c FROM n JOIN n u ON u.depth = n.depth - 1 AND u.node = substr(n.node, 1, u.depth * 64) GROUP BY u.node),
f AS (SELECT n.*, coalesce(c, 0) AS c FROM n LEFT JOIN k USING (node)),
s AS (SELECT p.node, sum((f.n_convs - 1) * f.w)::BIGINT AS saved, count(*) FILTER (WHERE f.c = 0) AS leaves FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node)
SELECT f.conv_id, f.depth, k.up AS parent_conv_id, n_convs, f.c AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN e USING (node) LEFT JOIN k ON f.depth > 0 AND k.node = substr(f.node, 1, (f.depth - 1) * 64)
"""


@query
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations: one row per node."""
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))
