"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, fuzzy, lines, minhash, mixing, pieces, quality, resampling, token_counts, toxicity, vptree, warc
from .labelled import fold_of
from .tables import table, whole_text


def op1_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row of `embeddings` whose id is divisible by 100, by exact search."""
    return vptree.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text, and what is left without later copies of runs of lines with 50 words or more."""
    return lines.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents),
w AS (
  SELECT doc_id, line, trim(x, E' 	
') AS x, len(regexp_extract_all(x, '[^ 	-
]+')) AS w FROM l),
s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS at, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM w WHERE w > 0),
spans AS (
  SELECT a.doc_id, a.at AS a, min(b.at) AS b FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.at BETWEEN a.at AND a.at + 49 AND b.c - a.c + a.w >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.at), b.at FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.at BETWEEN a.at AND a.at + 49 AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.at),
runs AS (
  SELECT p.doc_id, p.a, p.b, string_agg(s.x, chr(10) ORDER BY s.at) AS run FROM spans p JOIN s ON s.doc_id = p.doc_id AND s.at BETWEEN p.a AND p.b GROUP BY 1, 2, 3),
firsts AS (SELECT run, min((doc_id, a)) AS f FROM runs GROUP BY run HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT r.doc_id, s.line FROM runs r JOIN firsts USING (run)
  JOIN s ON s.doc_id = r.doc_id AND s.at BETWEEN CASE WHEN f[1] = r.doc_id THEN greatest(r.a, f[2] + r.b - r.a + 1) ELSE r.a END AND r.b
  WHERE (r.doc_id, r.a) <> f)
SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Ids of every text under the rank file, and the bytes they decode to, as digests."""
    ranks = bpe.read_ranks(path)
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json"), limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed a context of `limit`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, token_counts.read_vocabulary(path))
    return counted.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of one and a half times all words takes from every document, sources weighing 5, 2 and 1 in turn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def _scored(docs: DataFrame, score: str, held_out: F.Column) -> DataFrame:
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; learned from labelled rows whose id's crc32 is no multiple of five."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = fold_of("doc_id", 5) == 0
    return _scored(toxicity.fit_and_score(docs, labels, ~held_out), "toxicity", held_out)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; learned from labelled rows whose id's crc32 is not one modulo three."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = fold_of("doc_id", 3) == 1
    return _scored(quality.fit_and_score(docs, labels, ~held_out), "quality_score", held_out)


def op7_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness to each other and to the next document's."""
    return fuzzy.edited_and_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `pages` written to ZIP packages of WARC records and read back by ranges."""
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM k
"""


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles at a similarity of 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Params(shingle=4))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the texts of `benchmark`, and the tenth of them that is drawn."""
    return resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


#: crc32 byte by byte, from a table of its 256 steps.
OP11_SQL = r"""
WITH step AS (
  SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
w AS (
  SELECT 'd' AS kind, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
k AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(word)), lambda i: ('0x' || substring(hex(encode(word)), 2 * i::INTEGER + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM w), step),
c AS (SELECT kind, doc_id, bucket, count(*) AS n FROM w JOIN k USING (word) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM c GROUP BY bucket),
z AS (SELECT sum(s) AS whole_s, sum(t) AS whole_t FROM b),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (whole_s + 10000) / ((s + 1) * (whole_t + 10000))))::BIGINT AS gain FROM b, z),
d AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM c JOIN g USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
x AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and lose in each of their 120 orders, by source."""
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails FROM t),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INTEGER) AS good, max((toxic IS NOT DISTINCT FROM 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, i::INTEGER AS step, substring(filter_order, 1, i::INTEGER - 1) AS before, substring(filter_order, i::INTEGER, 1) AS own FROM o, range(1, 6) r(i) WHERE length(filter_order) = 5),
m AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails = own AS alone, contains(fails, own) AS hit, fails <> '' AND before <> '' AND regexp_matches(fails, '[' || CASE before WHEN '' THEN '-' ELSE before END || ']') AS gone FROM h, s),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM m GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""


def op13_sentencepiece(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    """Ids of every text under the piece model, the end id last, and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, pieces.read_model(path), decoded="decoded", keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vantage_point_neighbours": op1_vantage_point_neighbours,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_sainte_lague_mix": op5_sainte_lague_mix,
    "op6_toxicity": op6_toxicity,
    "op7_piecewise_fingerprints": op7_piecewise_fingerprints,
    "op8_warc_packages": op8_warc_packages,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality": op10_quality,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_filter_audit": op12_filter_audit,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op1_vantage_point_neighbours": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op8_warc_packages": OP8_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
