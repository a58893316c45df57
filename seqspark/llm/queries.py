"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm import language

    docs = _table(spark, sf_dir, "documents")
    return language.predict_language(docs, language.fit(docs, language.HELD_OUT))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.repeated_text import repeat_digests

    return repeat_digests(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.quality_rules import judge

    judged = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.importance import resample

    out = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", "n_ngrams", "log_weight", "score", "kept")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.token_output import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.pieces import piece_digests

    return piece_digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.whitening import whiten

    out = whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", out["deviation"].cast("long"))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.stream_dedup import exact_copies

    return exact_copies(spark, f"{sf_dir}/documents.parquet")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language, op2_neighbours, op3_simhash, op4_mixture_packing, op5_repeated_text, op6_quality_rules,
        op7_importance, op8_token_output, op9_pieces, op10_main_text, op11_whitening, op12_exact_copies,
        op13_spelling_variants, pipeline,
    )
    return {f.__name__: f for f in found}


_COPIES_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents),
k AS (
  SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY size DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY plain) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM k
"""

# The crc32 is a fold over bytes with the usual table; letters are one byte, or C3 and another one. One edit in words
# of six code points or more leaves the first three or the last three. levenshtein() counts bytes, so it gets words in
# which the letters from C3 on are one byte each.
_SPELLING_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range::BIGINT AS i, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split(doc_id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM lowered, crc),
edited AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM hashed),
alphabet AS (
  SELECT array_to_string(list_transform(range(192, 256), lambda c: chr(c::INT)), '') AS wide,
    array_to_string(list_transform(range(32, 96), lambda c: chr(c::INT)), '') AS narrow),
words AS (
  SELECT word, translate(word, any_value(wide), any_value(narrow)) AS flat, sum(n)::BIGINT AS n
  FROM edited, alphabet WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM words a JOIN words b ON left(a.word, 3) = left(b.word, 3)
    AND abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word WHERE levenshtein(a.flat, b.flat) = 1
  UNION SELECT a.word, b.word, b.n FROM words a JOIN words b ON right(a.word, 3) = right(b.word, 3)
    AND abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word WHERE levenshtein(a.flat, b.flat) = 1),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
  FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
    CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
paths AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN paths p USING (word) JOIN forms last ON last.word = p.at AND last.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_exact_copies": _COPIES_SQL, "op13_spelling_variants": _SPELLING_SQL}
