"""One registered query for each operator, and the SQL text of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import (
    bpe,
    exact_dedup,
    html_extract,
    langid,
    mixing,
    ngram_join,
    phrase_dedup,
    prefix_trie,
    quality,
    secrets,
    suffix_dedup,
    token_files,
    whitening,
)
from skyledger.llm.common import documents
from skyledger.session import scratch_path

QUERIES = {}
SQL = {}


def tokenizer() -> str:
    """The public vocabulary file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return run

    return register


def ids_digest(ids: Column) -> Column:
    """Lowercase hex of the SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


@query("op1_bpe_encode_decode")
def bpe_encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return bpe.encode(docs, tokenizer(), decoded="decoded", keep=["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_ngram_jaccard", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (
  SELECT doc_id, array_to_string(w, ' ') AS s FROM d WHERE len(w) BETWEEN 1 AND 4
  UNION SELECT doc_id, array_to_string(w[i:i + 4], ' ')
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
sizes AS (SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM each a JOIN each b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(y) AS component_id
FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach ON x = d.doc_id GROUP BY d.doc_id, n
""")
def ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf)).select("doc_id", "n_shingles", "component_id")


@query("op3_html_extract")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet"))


@query("op4_token_files")
def token_files_query(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(documents(spark, sf), tokenizer(), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op5_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    learned = docs.filter(F.col("lang").isNotNull() & ~langid.held_out(F.col("doc_id")))
    filters = langid.fit(learned.select("lang", "text"))
    return langid.predict(docs, filters).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op6_suffix_dedup", r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS w
  FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS s FROM d WHERE length(h) >= 100)),
late AS (SELECT doc_id, s FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY w)),
runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run
        FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM late))
  GROUP BY doc_id, run),
gaps AS (
  SELECT r.doc_id, a, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS piece
  FROM runs r JOIN d ON d.doc_id = r.doc_id WINDOW w AS (PARTITION BY r.doc_id ORDER BY a)),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS front FROM gaps GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS upto FROM runs GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN cut c ON c.doc_id = d.doc_id
""")
def suffix_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op7_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t ORDER BY n DESC, doc_id)
""")
def exact_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf))


@query("op8_quality_rules")
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.with_quality(documents(spark, sf).select("doc_id", "text"))
    return judged.select("doc_id", *[
        f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                 "n_repeat_words", "base_failed", "kept", "lost_chars")
    ])


@query("op9_secret_scan")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf))
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("spans"), no).alias(f"n_{k}") for no, k in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


@query("op10_mix_sources")
def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(documents(spark, sf))


@query("op11_whitening")
def whitening_query(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op12_phrase_dedup", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - 18)) AS s FROM d WHERE len(words) >= 20)),
late AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM late)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, string_agg(e.word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS rest
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
""")
def phrase_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_dedup.remove_phrases(documents(spark, sf)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op13_prefix_trie", r"""
WITH RECURSIVE bits AS (
  -- CRC-32 of decimal ids, one bit a row: 8 for each character.
  SELECT c, c::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS r FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(r, ascii(s[k // 8 + 1])::BIGINT) ELSE r END AS x
        FROM bits WHERE k < 8 * length(s))),
ids AS (SELECT c, c - c % 20 AS base, xor(r, 4294967295::BIGINT) % 4 AS h FROM bits WHERE k = 8 * length(s)),
own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT i.c, 0 AS late, o.pos, role, text FROM ids i JOIN own o ON o.c = i.base AND o.pos < i.h
  UNION ALL SELECT i.c, 1, o.pos, role, text FROM ids i JOIN own o ON o.c = i.c AND o.pos >= i.h),
seq AS (
  SELECT c, row_number() OVER w AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         sha256(string_agg(length(role)::VARCHAR || ':' || length(text)::VARCHAR || ':' || role || text, '') OVER w) AS node
  FROM placed WINDOW w AS (PARTITION BY c ORDER BY late, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS (SELECT node, min(d) AS d, min(words) AS words, min(c) AS c, count(*) AS n FROM seq GROUP BY node),
kids AS (
  SELECT p.node, count(*) AS kids FROM nodes k JOIN seq p ON p.c = k.c AND p.d = k.d - 1 GROUP BY p.node),
above AS (
  SELECT k.node, r.c AS parent FROM nodes k JOIN seq p ON p.c = k.c AND p.d = k.d - 1 JOIN nodes r ON r.node = p.node),
sums AS (
  SELECT a.node, count(*) FILTER (g.kids IS NULL) AS leaves, sum((u.n - 1) * u.words) AS saved
  FROM nodes u LEFT JOIN kids g ON g.node = u.node JOIN seq a ON a.c = u.c AND a.d <= u.d GROUP BY a.node),
ends AS (
  SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS list
  FROM seq s JOIN (SELECT c, max(d) AS d FROM seq GROUP BY c) USING (c, d) GROUP BY node)
-- Client libraries disagree on the type of integers among NULLs.
SELECT n.c AS conv_id, n.d AS depth, parent::DOUBLE AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children,
       leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(list, '')) AS ends_sha256
FROM nodes n LEFT JOIN kids USING (node) LEFT JOIN above USING (node) JOIN sums USING (node) LEFT JOIN ends USING (node)
""")
def prefix_trie_query(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf}/conversations.parquet"))
