"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import collocations, decontaminate, html_text, importance, langid, line_dedup, minmax, quality, sentencepiece_scan, simhash, suffix_tree_lm, token_files, wordpiece_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), into="leaks")
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def _ids_digest(kind: str):
    def run(ids: pa.Array) -> pa.Array:
        found = [(len(held), zlib.crc32(held.astype("<u4"))) for held in (np.frombuffer(x.as_py(), kind) for x in ids)]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], ["n_ids", "ids_crc32"])

    run.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<n_ids:bigint,ids_crc32:bigint>")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: how many ids, their crc32 as u32, and the hash of what they
    decode to again. The segmentation is the best-scoring one (unigram), under the Zipf
    prior where the file, as this BPE one, has merge order instead of scores."""
    model = tokenizer("piece_bpe_32k.model")
    coded = sentencepiece_scan.encode(table(spark, sf_dir, "documents"), model)
    digest = _ids_digest(sentencepiece_scan.ids_kind(model))
    back = sentencepiece_scan.decode(coded, model).select("doc_id", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
    return back.withColumn("d", digest("ids")).select("doc_id", "d.*", "decoded_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = wordpiece_counts.count_tokens(docs, wordpiece_counts.pieces_of(tokenizer("word_bpe_49k.json")))
    return counted.select("doc_id", "tokens.*")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, into="lines")
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, o.key IS NOT NULL AND o.last <> k.doc_id AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    learned = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), learned, into="found").select("doc_id", "held_out", "found.*")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages).select("page_id", "url", "rendered.text", "rendered.n_chars")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = quality.verdicts(quality.ledger(docs))
    return held.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("kept_base")).alias("base_failed"), F.col("kept_v1").alias("kept"), "fail_bits")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM d),
token AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words),
win AS (
  SELECT doc_id, pos, w,
         lead(w, 1) OVER p AS a, lead(w, 2) OVER p AS b, lead(w, 3) OVER p AS c, lead(w, 4) OVER p AS e,
         lead(w, 5) OVER p AS f, lead(w, 6) OVER p AS g, lead(w, 7) OVER p AS h
  FROM token WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (
  SELECT doc_id, pos, h IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, a, b, c, e, f, g, h) > 1 AS again FROM win),
covered AS (
  SELECT doc_id, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM twice),
rep AS (SELECT doc_id, sum(hit) AS n FROM covered GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup FROM line
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low,
         length(regexp_replace(text, '[^!]', '', 'g')) AS shout,
         length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters
  FROM words w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
bits AS (
  SELECT *, CAST(
      CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN up > low THEN 8 ELSE 0 END
    + CASE WHEN 4 * shout > n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 24 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 2 * letters < word_chars THEN 128 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM bits
"""


def op11_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS MATERIALIZED (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, CAST(count(*) AS HUGEINT) AS f
  FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
parts AS MATERIALIZED (
  SELECT lang, phrase, ws, f AS a, j, array_to_string(ws[1 : j], ' ') AS p, array_to_string(ws[j + 1 :], ' ') AS q
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f)),
cut AS (
  SELECT c.lang, c.ws, c.phrase, c.a, c.j, l.f AS l, r.f AS r, 2000000 * c.a // (l.f + r.f) AS score
  FROM parts c JOIN f l ON l.lang = c.lang AND l.phrase = c.p JOIN f r ON r.lang = c.lang AND r.phrase = c.q),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cut),
inner_ AS (
  SELECT lang, array_to_string(p.ws[s.s : s.s + m.m - 1], ' ') AS phrase, max(p.f) AS longer
  FROM f p, (SELECT unnest([2, 3]) AS m) m, (SELECT unnest([1, 2, 3]) AS s) s
  WHERE m.m < p.k AND s.s + m.m - 1 <= p.k GROUP BY ALL),
left_ AS (
  SELECT o.lang, o.phrase, o.a, o.l, o.r, o.score FROM lowest o LEFT JOIN inner_ i ON i.lang = o.lang AND i.phrase = o.phrase
  WHERE o.nth = 1 AND (i.longer IS NULL OR 100 * i.longer < 80 * o.a)),
total AS (SELECT lang, sum(len(ws)) AS n FROM lists GROUP BY lang),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_)
SELECT p.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM placed p JOIN total t ON t.lang = p.lang WHERE rank <= 2000
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))),
split_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
per_word AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM split_words) GROUP BY doc_id, w),
kinds AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM per_word UNION SELECT w FROM target_words)),
hashed AS (
  SELECT w, CAST(xor(list_reduce(
      list_transform(range(0, len(x), 2), lambda i: CAST('0x' || substr(x, i + 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS INT) AS bucket
  FROM kinds, crc),
s AS (SELECT bucket, sum(n) AS s FROM per_word JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln((CAST(coalesce(t.t, 0) AS DOUBLE) + 1) * ((SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) + 10000)
         / ((CAST(coalesce(s.s, 0) AS DOUBLE) + 1) * ((SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(n * gain) AS weight FROM per_word JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM split_words LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_token_files": op2_token_files,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_tree_lm": op7_suffix_tree_lm,
    "op8_language_id": op8_language_id,
    "op9_html_text": op9_html_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_minmax_neardup": op11_minmax_neardup,
    "op12_collocations": op12_collocations,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": OP6_SQL,
    "op10_quality_rules": OP10_SQL,
    "op12_collocations": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
