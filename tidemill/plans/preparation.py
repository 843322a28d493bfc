"""Queries of normalisation, validation, quality and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import python as P
from tidemill.functions import text as T
from tidemill.functions.text import CONTRACTIONS, SPACE, STOPWORDS, TOKEN
from tidemill.operators import quality as Q
from tidemill.operators import stats
from tidemill.plans.base import query, table, texts
from tidemill.plans.corpus import MERGED, s_sentences, s_strip, s_text, s_words

S_PUNCT = T.ASCII_PUNCTUATION.replace("'", "''")
S_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


def s_normal(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')")


def s_controls(x: str) -> str:
    # RE2 has no intersection of classes: line feeds and tabs are kept by going through two private marks.
    return rf"translate(regexp_replace(translate({x}, chr(10) || chr(9), '⟨⟩'), '[\p{{C}}]', '', 'g'), '⟨⟩', chr(10) || chr(9))"


def s_lines(x: str) -> str:
    lines = f"str_split(regexp_replace({x}, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10))"
    return s_strip(f"array_to_string(list_transform({lines}, lambda x: {s_strip('regexp_replace(x, ' + chr(39) + '[ ' + chr(92) + 't]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), chr(10))")


def s_contract(x: str) -> str:
    # \b of RE2 is ASCII only: letters and digits beyond ASCII are taken for a letter while the words are matched.
    for k, v in CONTRACTIONS.items():
        key = k.replace("'", "''")
        lead = r"(^|[^\p{L}\p{N}\p{M}_])" if k[0] != "'" else r"([\p{L}\p{N}\p{M}_])"
        x = rf"regexp_replace({x}, '{lead}{key}($|[^\p{{L}}\p{{N}}\p{{M}}_])', '\1{v}\2', 'g')"
    return x


@query(f"SELECT doc_id, {s_normal(s_text('text'))} AS clean_text FROM documents")
def normalize_ws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_whitespace(T.text("text")).alias("clean_text"))


@query(rf"SELECT doc_id, {s_normal('regexp_replace(' + s_text('text') + ', ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS cleaned_text FROM documents")
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_whitespace(T.strip_tags(T.text("text"))).alias("cleaned_text"))


@query(f"SELECT doc_id, {s_lines(s_text('text'))} AS lines FROM documents")
def clean_line_ends(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.clean_lines(T.text("text")).alias("lines"))


@query("SELECT doc_id, nfc_normalize(text) AS nfc_text FROM documents")
def unicode_nfc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", P.nfc(F.col("text")).alias("nfc_text"))


@query()
def pipeline_b(spark: SparkSession, sf: str) -> DataFrame:
    """The traditional pipeline, with lemmas by the hook; documents that it empties are dropped."""
    kept, _ = Q.validate(texts(spark, sf, MERGED, "record_id", "model_label", "generated_text"), "generated_text")
    out = P.hook("lemma", T.pipeline_b(T.text(P.decoded(F.col("generated_text")))))
    rows = kept.select("record_id", "model_label", out.alias("processed_text")).where(F.length("processed_text") > 0)
    return rows.withColumns({"char_length": T.char_count(F.col("processed_text")), "word_count": T.word_count(F.col("processed_text"))})


S_B_TOKENS = f"list_filter(regexp_extract_all(translate({s_contract('lower(' + s_text('generated_text') + ')')}, '{S_PUNCT}', ''), '{TOKEN}'), lambda w: w NOT IN ({S_STOP}))"


@query(f"SELECT item, count(*) AS n FROM (SELECT unnest({S_B_TOKENS}) AS item FROM merged_records) GROUP BY 1")
def pipeline_b_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = T.content_tokens(T.drop_punctuation(T.expand_contractions(F.lower(T.text("generated_text")))))
    return texts(spark, sf, MERGED, "generated_text").select(F.explode(words).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def corpus_stats(df: DataFrame, c: str, name: str) -> DataFrame:
    """One pass: tokens are counted per token, and what belongs to a document rides with its first token."""
    t = T.text(c)
    docs = df.select(T.tokens(t).alias("tokens"), T.sentence_count(t).alias("sentences"), T.char_count(t).alias("chars"))
    rows = docs.select(F.posexplode_outer("tokens").alias("at", "token"), "sentences", "chars")
    first = F.coalesce("at", F.lit(0)) == 0
    by = rows.groupBy("token").agg(F.count("token").alias("n"), F.count_if(first).alias("docs"), F.sum(F.when(first, F.col("sentences"))).alias("sentences"), F.sum(F.when(first, F.col("chars"))).alias("chars"))
    both = by.agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("total_samples"), F.sum("n").alias("total_tokens"), F.sum("sentences").alias("total_sentences"), F.sum("chars").alias("total_chars"),
        F.count("token").alias("vocabulary_size"), F.coalesce(F.sum(F.length("token") * F.col("n")), F.lit(0)).alias("token_chars"),
    )
    r = lambda a, b, k: F.round(T.per(F.col(a), F.col(b)), k)
    return both.select(F.lit(name).alias("pipeline_name"), "total_samples", "total_tokens", "total_sentences", "total_chars", "vocabulary_size", r("vocabulary_size", "total_tokens", 6).alias("type_token_ratio"), r("total_chars", "total_samples", 2).alias("avg_document_chars"), r("token_chars", "total_tokens", 2).alias("avg_token_chars"), r("total_tokens", "total_sentences", 2).alias("avg_sentence_tokens"))


def s_corpus_stats(x: str, name: str) -> str:
    return f"""SELECT '{name}' AS pipeline_name, count(*) AS total_samples, CAST(sum(nw) AS BIGINT) AS total_tokens, CAST(sum(ns) AS BIGINT) AS total_sentences, CAST(sum(length(t)) AS BIGINT) AS total_chars, any_value(v) AS vocabulary_size,
round(any_value(v) / sum(nw), 6) AS type_token_ratio, round(sum(length(t)) / count(*), 2) AS avg_document_chars, round(any_value(wc) / sum(nw), 2) AS avg_token_chars, round(sum(nw) / sum(ns), 2) AS avg_sentence_tokens
FROM (SELECT t, {s_words('t')} AS nw, {s_sentences('t')} AS ns FROM (SELECT {x} AS t FROM merged_records)), (SELECT count(DISTINCT w) AS v, sum(length(w)) AS wc FROM (SELECT unnest(regexp_extract_all({x}, '{TOKEN}')) AS w FROM merged_records))"""


S_A, S_B = s_lines(s_text("generated_text")), f"array_to_string({S_B_TOKENS}, ' ')"


def _a(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_stats(texts(spark, sf, MERGED, "generated_text").select(T.clean_lines(T.text("generated_text")).alias("t")), "t", "fingerprint")


def _b(spark: SparkSession, sf: str) -> DataFrame:
    words = T.content_tokens(T.drop_punctuation(T.expand_contractions(F.lower(T.text("generated_text")))))
    return corpus_stats(texts(spark, sf, MERGED, "generated_text").select(F.array_join(words, " ").alias("t")), "t", "traditional")


@query(s_corpus_stats(S_A, "fingerprint"))
def corpus_stats_a(spark: SparkSession, sf: str) -> DataFrame:
    return _a(spark, sf)


@query(s_corpus_stats(S_B, "traditional"))
def corpus_stats_b(spark: SparkSession, sf: str) -> DataFrame:
    return _b(spark, sf)


@query(f"""WITH a AS ({s_corpus_stats(S_A, 'a')}), b AS ({s_corpus_stats(S_B, 'b')}) SELECT 'characters' AS metric, a.total_chars AS fingerprint, b.total_chars AS traditional, a.total_chars - b.total_chars AS removed FROM a, b
UNION ALL SELECT 'tokens', a.total_tokens, b.total_tokens, a.total_tokens - b.total_tokens FROM a, b UNION ALL SELECT 'vocabulary', a.vocabulary_size, b.vocabulary_size, a.vocabulary_size - b.vocabulary_size FROM a, b""")
def pipeline_comparison(spark: SparkSession, sf: str) -> DataFrame:
    names = {"characters": "total_chars", "tokens": "total_tokens", "vocabulary": "vocabulary_size"}
    one = lambda df, side: df.select(*[F.col(c).cast("bigint").alias(f"{side}_{n}") for n, c in names.items()])
    both = one(_a(spark, sf), "a").crossJoin(one(_b(spark, sf), "b"))
    rows = [F.struct(F.lit(n).alias("metric"), F.col(f"a_{n}").alias("fingerprint"), F.col(f"b_{n}").alias("traditional"), (F.col(f"a_{n}") - F.col(f"b_{n}")).alias("removed")) for n in names]
    return both.select(F.inline(F.array(*rows)))


S_REASON = f"""CASE WHEN length({s_strip(s_text('generated_text'))}) = 0 THEN 'Missing/empty text content' WHEN length(generated_text) < 5 THEN 'Length below min threshold (' || length(generated_text) || ' < 5)'
WHEN length(generated_text) > 10000 THEN 'Length exceeds max threshold (' || length(generated_text) || ' > 10000)' END"""


# The records hold no entities (what looks like one is junk that no decoder touches), so that NFC is all of the first step.
S_NFC = f"nfc_normalize({s_text('generated_text')})"
S_DROPPED = rf"regexp_replace({S_NFC}, '[\x00-\x08\x0b-\x1f\x7f-\x9f\p{{Cf}}\p{{Co}}]', '', 'g')"


def s_processed(x: str) -> str:
    return f"SELECT record_id, model_label, t AS processed_text, CAST(length(t) AS BIGINT) AS char_length, CAST({s_words('t')} AS BIGINT) AS word_count FROM (SELECT record_id, model_label, {x} AS t FROM merged_records WHERE {S_REASON} IS NULL)"


@query(s_processed(s_lines(S_DROPPED)))
def pipeline_a(spark: SparkSession, sf: str) -> DataFrame:
    """The style-preserving pipeline, with lengths."""
    kept, _ = Q.validate(texts(spark, sf, MERGED, "record_id", "model_label", "generated_text"), "generated_text")
    out = T.pipeline_a(T.text(P.decoded(F.col("generated_text"))))
    rows = kept.select("record_id", "model_label", out.alias("processed_text"))
    return rows.withColumns({"char_length": T.char_count(F.col("processed_text")), "word_count": T.word_count(F.col("processed_text"))})


@query(s_processed("array_to_string(" + S_B_TOKENS.replace(s_text("generated_text"), S_NFC) + ", ' ')") + " WHERE length(t) > 0")
def pipeline_b_plain(spark: SparkSession, sf: str) -> DataFrame:
    """The traditional pipeline before the lemmas, which are a hook."""
    kept, _ = Q.validate(texts(spark, sf, MERGED, "record_id", "model_label", "generated_text"), "generated_text")
    rows = kept.select("record_id", "model_label", T.pipeline_b(T.text(P.decoded(F.col("generated_text")))).alias("processed_text")).where(F.length("processed_text") > 0)
    return rows.withColumns({"char_length": T.char_count(F.col("processed_text")), "word_count": T.word_count(F.col("processed_text"))})


@query(f"SELECT record_id, prefix_id, model_label, {S_REASON} AS reason, CAST(length({s_text('generated_text')}) AS BIGINT) AS original_length FROM merged_records WHERE {S_REASON} IS NOT NULL")
def validate_removed(spark: SparkSession, sf: str) -> DataFrame:
    _, removed = Q.validate(table(spark, sf, MERGED).select("record_id", "prefix_id", "model_label", "generated_text"), "generated_text")
    return removed.drop("generated_text")


@query(f"SELECT record_id, model_label FROM merged_records WHERE {S_REASON} IS NULL")
def validate_kept(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = Q.validate(table(spark, sf, MERGED).select("record_id", "model_label", "generated_text"), "generated_text")
    return kept.drop("generated_text")


S_S = s_strip(s_text("prefix_text"))
S_QUALITY = f"""WITH r AS (SELECT prefix_id, extraction_timestamp, {s_normal('lower(' + s_text('prefix_text') + ')')} AS norm,
CASE WHEN length({S_S}) = 0 THEN 'empty' WHEN length({S_S}) < 150 THEN 'too_short' WHEN length({S_S}) > 6000 THEN 'too_long' WHEN contains({S_S}, chr(65533)) THEN 'invalid_unicode' WHEN coalesce(prefix_lang, '') <> 'en' THEN 'language_mismatch' END AS reason FROM prefix_records),
q AS (SELECT r.*, CASE WHEN reason IS NULL AND (prefix_id, coalesce(extraction_timestamp, '')) <> first_value((prefix_id, coalesce(extraction_timestamp, ''))) OVER (PARTITION BY reason, norm ORDER BY coalesce(extraction_timestamp, ''), prefix_id) THEN 'duplicate' ELSE reason END AS reject_reason FROM r)"""


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "prefix_records").select("prefix_id", F.coalesce("extraction_timestamp", F.lit("")).alias("extraction_timestamp"), "prefix_text", "prefix_lang")
    return Q.checked(p, Q.quality_reason(F.col("prefix_text"), F.col("prefix_lang"), F.lit(1.0)), T.fingerprint_key(T.text("prefix_text")), ["extraction_timestamp", "prefix_id"])


@query(S_QUALITY + " SELECT reject_reason, count(*) AS n FROM q GROUP BY 1")
def quality_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(S_QUALITY + " SELECT count(*) AS total_checked, count(*) FILTER (WHERE reject_reason IS NULL) AS total_passed, count(*) FILTER (WHERE reject_reason = 'duplicate') AS duplicates, count(*) FILTER (WHERE reject_reason = 'language_mismatch') AS language_rejects, count(*) FILTER (WHERE reject_reason NOT IN ('duplicate', 'language_mismatch')) AS quality_rejects, round(count(*) FILTER (WHERE reject_reason IS NULL) / count(*), 4) AS pass_rate FROM q")
def quality_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    r, n = F.col("reject_reason"), F.count("*")
    return _quality(spark, sf).agg(n.alias("total_checked"), F.count_if(r.isNull()).alias("total_passed"), F.count_if(r == "duplicate").alias("duplicates"), F.count_if(r == "language_mismatch").alias("language_rejects"), F.count_if(r.isNotNull() & ~r.isin("duplicate", "language_mismatch")).alias("quality_rejects"), F.round(F.count_if(r.isNull()) / n, 4).alias("pass_rate"))


@query(f"SELECT doc_id FROM documents WHERE length({s_strip(s_text('text'))}) > 0 QUALIFY row_number() OVER (PARTITION BY {s_normal('lower(' + s_text('text') + ')')} ORDER BY doc_id) = 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(~T.is_blank(T.text("text"))).select("doc_id", "text")
    return Q.first_of_equal(d, T.fingerprint_key(T.text("text")), ["doc_id"]).where("is_first").select("doc_id")


@query(f"""SELECT doc_id FROM documents d WHERE source_split = 'train' AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.source_split IS DISTINCT FROM 'train' AND {s_normal('lower(' + s_text('e.text') + ')')} = {s_normal('lower(' + s_text('d.text') + ')')})""")
def dedup_anti_existing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of train whose normalised text is in no other split."""
    d = table(spark, sf, "documents").select("doc_id", "source_split", F.md5(T.fingerprint_key(T.text("text"))).alias("key"))
    other = d.where(~F.col("source_split").eqNullSafe("train")).select("key").distinct()
    return d.where("source_split = 'train'").join(other, "key", "left_anti").select("doc_id")


@query(f"SELECT doc_id, coalesce(nullif({s_strip(s_text('text'))}, ''), source) AS text_or_source, CASE WHEN length({s_strip(s_text('text'))}) > 0 THEN 'text' ELSE 'fallback' END AS taken_from FROM documents")
def text_field_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several fields of a record, written as JSON, that holds any text."""
    from tidemill.sources.io import first_text

    d = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.col("text"), F.col("source").alias("body"))).alias("record"))
    t = first_text(F.col("record"), ("text", "body"))
    first = first_text(F.col("record"), ("text",))
    return d.select("doc_id", t.alias("text_or_source"), F.when(first.isNotNull(), "text").otherwise("fallback").alias("taken_from"))
