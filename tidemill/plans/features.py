"""Queries of n-gram weights, style features and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.functions.text import SPACE
from tidemill.operators import grams as C
from tidemill.operators import stylometry as S
from tidemill.operators import tfidf as X
from tidemill.plans.base import query, table, texts
from tidemill.plans.corpus import MERGED, s_strip, s_text, s_words

G = "generated_text"
S_TERMS = f"regexp_extract_all(lower({s_text(G)}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def s_tfidf(items: str, key: str, n_docs: str, cap: int) -> str:
    return f"""c AS (SELECT {key}, term, count(*) AS tf FROM ({items}) GROUP BY ALL), n AS ({n_docs}),
v AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1), n WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT {cap}),
r AS (SELECT {key}, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term)), w AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS tfidf FROM r)"""


S_PAIRS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


def s_word(terms: str, cap: int = X.WORD_TERMS) -> str:
    return "WITH " + s_tfidf(f"SELECT record_id, unnest({S_PAIRS}) AS term FROM (SELECT record_id, {terms} AS w FROM merged_records)", "record_id", "SELECT count(*) AS n FROM merged_records", cap)


S_WORD = s_word(S_TERMS)


def _word(spark: SparkSession, sf: str) -> DataFrame:
    """Words and pairs of words, at the usual limits."""
    return X.tfidf(texts(spark, sf, MERGED, "record_id", G), "record_id", X.word_ngrams(T.text(G), X.WORD_SIZES), X.WORD_TERMS)


@query(S_WORD + " SELECT record_id, term, round(tfidf, 6) AS tfidf FROM w")
def tfidf_word(spark: SparkSession, sf: str) -> DataFrame:
    return _word(spark, sf).withColumn("tfidf", F.round("tfidf", 6))


@query(S_WORD + " SELECT (SELECT count(*) FROM w) AS nnz, (SELECT count(*) FROM v) AS vocabulary_size, (SELECT n FROM n) AS n_documents, round(1 - (SELECT count(*) FROM w) / ((SELECT n FROM n) * (SELECT count(*) FROM v)), 6) AS sparsity")
def tfidf_sparsity(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, MERGED).agg(F.count("*").alias("n_documents"))
    terms = _word(spark, sf).groupBy("term").agg(F.count("*").alias("k")).agg(F.sum("k").alias("nnz"), F.count("*").alias("vocabulary_size"))
    return terms.crossJoin(n).withColumn("sparsity", F.round(1 - F.col("nnz") / (F.col("n_documents") * F.col("vocabulary_size")), 6))


@query(S_WORD + " SELECT round(avg(k), 4) AS avg_active, quantile_cont(k, 0.5) AS median_active, max(k) AS max_active FROM (SELECT count(w.term) AS k FROM merged_records LEFT JOIN w USING (record_id) GROUP BY record_id)")
def active_features(spark: SparkSession, sf: str) -> DataFrame:
    k = _word(spark, sf).groupBy("record_id").agg(F.count("*").alias("k"))
    every = table(spark, sf, MERGED).select("record_id").join(k, "record_id", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    return every.agg(F.round(F.avg("k"), 4).alias("avg_active"), F.percentile("k", F.lit(0.5)).alias("median_active"), F.max("k").alias("max_active"))


@query(S_WORD + " SELECT term, round(sum(tfidf), 4) AS weight FROM w GROUP BY 1 ORDER BY weight DESC, term LIMIT 25")
def top_term_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _word(spark, sf).groupBy("term").agg(F.round(F.sum("tfidf"), 4).alias("weight")).orderBy(F.desc("weight"), "term").limit(25)


S_TOK = "regexp_extract_all(lower(" + s_text("text") + f"), '[^{SPACE}]+')"


def s_char(sizes: tuple[int, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, CASE WHEN length(p) <= {n} THEN p ELSE substr(p, i, {n}) END AS term FROM (SELECT doc_id, p, unnest(range(1, greatest(1, length(p) - {n - 1}) + 1)) AS i FROM (SELECT doc_id, ' ' || unnest({S_TOK}) || ' ' AS p FROM documents))" for n in sizes
    )


@query("WITH " + s_tfidf(s_char((3, 4, 5)), "doc_id", "SELECT count(*) AS n FROM documents", X.CHAR_TERMS) + " SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM w")
def tfidf_char_wb(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents", "doc_id", "text").select("doc_id", T.tokens(F.lower(T.text("text"))).alias("tokens"))
    return X.tfidf(d, "doc_id", X.char_wb(F.col("tokens"), X.CHAR_SIZES), X.CHAR_TERMS).withColumn("tfidf", F.round("tfidf", 6))


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {s_tfidf(s_char(r), 'doc_id', 'SELECT count(*) AS n FROM documents', X.CHAR_TERMS)} SELECT '{name}' AS ngram_range, term, count(*) AS n_documents, round(sum(tfidf), 4) AS weight FROM w GROUP BY 2)" for name, r in X.CHAR_RANGES.items()))
def char_ngram_ranges(spark: SparkSession, sf: str) -> DataFrame:
    x = C.term_weights(texts(spark, sf, "documents", "doc_id", "text"), "doc_id", F.lower(T.text("text")), X.CHAR_RANGES, X.CHAR_TERMS, in_words=True)
    return x.withColumn("weight", F.round("weight", 4))


S_CASED = f"regexp_extract_all({s_text(G)}, '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@query(s_word(S_CASED, 20_000) + " SELECT term, count(*) AS n_documents, round(sum(tfidf), 4) AS weight FROM w GROUP BY 1")
def tfidf_cased(spark: SparkSession, sf: str) -> DataFrame:
    """Words and pairs of words in their own case."""
    x = X.tfidf(texts(spark, sf, MERGED, "record_id", G), "record_id", X.word_ngrams(T.text(G), (1, 2), lower=False), 20_000)
    return x.groupBy("term").agg(F.count("*").alias("n_documents"), F.round(F.sum("tfidf"), 4).alias("weight"))


S_ACROSS = " UNION ALL ".join(f"SELECT doc_id, substr(p, i, {n}) AS term FROM (SELECT doc_id, p, unnest(range(1, greatest(0, length(p) - {n - 1}) + 1)) AS i FROM (SELECT doc_id, regexp_replace(lower({s_text('text')}), '[{SPACE}][{SPACE}]+', ' ', 'g') AS p FROM documents))" for n in (3, 4, 5))


@query("WITH " + s_tfidf(S_ACROSS, "doc_id", "SELECT count(*) AS n FROM documents", 20_000) + " SELECT term, count(*) AS n_documents, round(sum(tfidf), 4) AS weight FROM w GROUP BY 1")
def tfidf_char(spark: SparkSession, sf: str) -> DataFrame:
    """Character n-grams that may cross the borders of words."""
    x = C.term_weights(texts(spark, sf, "documents", "doc_id", "text"), "doc_id", X.one_blank(T.text("text")), {"3-5": (3, 4, 5)}, 20_000, in_words=False)
    return x.select("term", "n_documents", F.round("weight", 4).alias("weight"))


@query(f"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower({s_text('text')}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents WHERE source_split = 'train')
SELECT term, count(*) AS n FROM (SELECT unnest({S_TERMS}) AS term FROM merged_records) SEMI JOIN a USING (term) GROUP BY 1""")
def vocab_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of one corpus counted over the vocabulary of another."""
    vocab = table(spark, sf, "documents").where("source_split = 'train'").select(F.explode(X.word_terms(T.text("text"))).alias("term")).distinct()
    counts = texts(spark, sf, MERGED, G).select(F.explode(X.word_terms(T.text(G))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.join(vocab, "term", "left_semi")


def s_occ(mark: str) -> str:
    return "(length(t) - length(replace(t, '" + mark.replace("'", "''") + "', '')))"


def s_count(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


def s_any(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


S_DIV = "CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"


def s_per(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END)"


S_HAPAX = "len(list_filter(map_values(list_aggregate({w}, 'histogram')), lambda x: x = 1))"


def s_style27(source: str, key: str, c: str) -> str:
    words = r"regexp_extract_all(regexp_replace(regexp_replace(t, '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '0', 'g'), '\b[a-zA-Z'']+\b')"
    full = f"lambda x: length({s_strip('x')}) > 0"
    a = f"SELECT {key}, {s_text(c)} AS t FROM {source}"
    b = f"SELECT *, {words} AS w FROM ({a})"
    d = rf"""SELECT *, list_transform(w, lambda x: lower(x)) AS low, len(w) AS nw, length(t) AS nc, greatest(1, len(list_filter(str_split(regexp_replace(t, '([.!?])[{SPACE}]+', '\1' || chr(1), 'g'), chr(1)), {full}))) AS ns,
greatest(1, len(list_filter(str_split(regexp_replace(t, '\n\n+', chr(1), 'g'), chr(1)), {full}))) AS np, coalesce(list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(regexp_replace(lower(x), 'e+$', ''), '[aeiou]+')), 1))), 0) AS syl, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS letters FROM ({b})"""
    f = {
        "avg_word_length": s_per("letters", "nw"), "avg_sentence_length": "nw / ns", "type_token_ratio": s_per("len(list_distinct(low))", "nw"), "hapax_legomena_ratio": s_per(S_HAPAX.format(w="low"), "nw"), "word_count": "nw",
        **{f"punct_ratio_{n}": s_per(s_occ(m), "nc") for m, n in T.STYLE_MARKS.items()},
        "digit_ratio": s_per(s_count(r"\p{Nd}"), "nc"), "uppercase_ratio": s_per(s_count(r"\p{Lu}"), "nc"), "sentence_count": "ns", "paragraph_count": "np", "avg_paragraph_length": "nw / np", "whitespace_ratio": s_per(s_count(f"[{SPACE}]"), "nc"), "char_count": "nc",
        "question_density": s_occ("?") + " / ns", "exclamation_density": s_occ("!") + " / ns", "conjunction_ratio": s_per(s_count(s_any(T.CONJUNCTIONS)), "nw"), "pronoun_ratio": s_per(s_count(s_any(T.PRONOUNS)), "nw"),
        "flesch_reading_ease": "greatest(-100.0, least(121.0, CASE WHEN nw > 0 THEN 206.835 - 1.015 * (nw / ns) - 84.6 * (syl / nw) ELSE 0.0 END))", "flesch_kincaid_grade": "greatest(0.0, least(18.0, CASE WHEN nw > 0 THEN 0.39 * (nw / ns) + 11.8 * (syl / nw) - 15.59 ELSE 0.0 END))",
    }
    return f"SELECT {key}, " + ", ".join(f"round(CASE WHEN length({s_strip('t')}) = 0 THEN 0.0 ELSE CAST({v} AS DOUBLE) END, 6) AS {k}" for k, v in f.items()) + f" FROM ({d})"


def s_style23(source: str, key: str, c: str) -> str:
    d = rf"SELECT *, len(w) AS n, length(t) AS nc, greatest(length(t), 1) AS one, greatest(1, len(list_filter(str_split(regexp_replace(t, '[.!?]+', chr(1), 'g'), chr(1)), lambda x: length({s_strip('x')}) > 0))) AS ns FROM (SELECT {key}, {s_text(c)} AS t, regexp_extract_all(lower({s_text(c)}), '[\p{{L}}\p{{N}}_]+') AS w FROM {source})"
    f = {
        "char_count": "nc", "word_count": "n", "sentence_count": "ns", "unique_words": "len(list_distinct(w))", "avg_word_length": s_per("coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)", "n"), "avg_sentence_length": "n / ns", "type_token_ratio": s_per("len(list_distinct(w))", "n"), "hapax_ratio": s_per(S_HAPAX.format(w="w"), "n"),
        "uppercase_ratio": s_count(r"\p{Lu}") + " / one", "digit_ratio": s_count(r"\p{Nd}") + " / one", "whitespace_ratio": s_count(f"[{SPACE}]") + " / one", "punctuation_ratio": s_count(S.PUNCTUATION) + " / one",
        **{n: s_occ(m) for n, m in (("comma", ","), ("period", "."), ("semicolon", ";"), ("colon", ":"), ("question", "?"), ("exclamation", "!"), ("quotes", '"'), ("dash", "-"))}, "parenthesis": s_occ("(") + " + " + s_occ(")"),
        "lexical_density": s_per("len(list_filter(w, lambda x: length(x) >= 7))", "n"), "short_word_ratio": s_per("len(list_filter(w, lambda x: length(x) <= 3))", "n"),
    }
    return f"SELECT {key}, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in f.items()) + f" FROM ({d})"


@query(s_style27("merged_records", "record_id", G))
def stylometry27(spark: SparkSession, sf: str) -> DataFrame:
    return S.style27(texts(spark, sf, MERGED, "record_id", G), "record_id", G)


@query(s_style23("merged_records", "record_id", G))
def stylometry23(spark: SparkSession, sf: str) -> DataFrame:
    return S.style23(texts(spark, sf, MERGED, "record_id", G), "record_id", G)


def s_style14() -> str:
    f = {
        "word_count": "n", "char_count": "length(t)", "avg_word_length": s_per("coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)", "n"), "lexical_diversity": s_per("len(list_distinct(w))", "n"), "uppercase": s_count(r"\p{Lu}"), "digits": s_count(r"\p{Nd}"), "punctuation": s_count(S.PUNCTUATION),
        "comma": s_occ(","), "period": s_occ("."), "question": s_occ("?"), "exclamation": s_occ("!"), "newline": "(length(t) - length(replace(t, chr(10), '')))", "quotes": s_occ('"'), "whitespace": s_count(f"[{SPACE}]"),
    }
    return "SELECT doc_id, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in f.items()) + f" FROM (SELECT *, len(w) AS n FROM (SELECT doc_id, {s_text('text')} AS t, regexp_extract_all({s_text('text')}, '{T.TOKEN}') AS w FROM documents))"


@query(s_style14())
def stylometry14(spark: SparkSession, sf: str) -> DataFrame:
    return S.style14(texts(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


STYLE = ["avg_word_length", "avg_sentence_length", "type_token_ratio", "uppercase_ratio", "whitespace_ratio", "flesch_reading_ease"]


@query("WITH s AS (" + s_style27("merged_records", "record_id", G) + ") " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM s" for c in STYLE))
def style_feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = S.style27(texts(spark, sf, MERGED, "record_id", G), "record_id", G)
    return s.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_pop(c), 4).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")) for c in STYLE]).alias("r")).select(F.inline("r"))


MEANS = ["char_count", "word_count", "avg_word_length", "punctuation_ratio"]


@query(f"WITH a AS ({s_style23('merged_records', 'record_id', G)}), b AS ({s_style23('(SELECT record_id, lower(' + s_text(G) + ') AS low FROM merged_records)', 'record_id', 'low')}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS pipeline, '{c}' AS feature, round(avg({c}), 4) AS mean FROM {t}" for p, t in (("kept", "a"), ("lowered", "b")) for c in MEANS) + ")")
def style_mean_by_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    m = texts(spark, sf, MERGED, "record_id", G)
    a, b = S.style23(m, "record_id", G), S.style23(m.withColumn("low", F.lower(T.text(G))), "record_id", "low")
    both = a.withColumn("pipeline", F.lit("kept")).unionByName(b.withColumn("pipeline", F.lit("lowered")))
    means = both.groupBy("pipeline").agg(*[F.round(F.avg(c), 4).alias(c) for c in MEANS])
    return means.unpivot("pipeline", MEANS, "feature", "mean")


@query(f"""WITH s AS ({s_style14()}), m AS (SELECT avg(word_count) AS mw, stddev_pop(word_count) AS sw, avg(char_count) AS mc, stddev_pop(char_count) AS sc FROM s)
SELECT doc_id, round((word_count - mw) / sw, 4) AS word_count, round((char_count - mc) / sc, 4) AS char_count FROM s, m""")
def style_standardize(spark: SparkSession, sf: str) -> DataFrame:
    s = S.standardized(S.style14(texts(spark, sf, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id", ["word_count", "char_count"])
    return s.select("doc_id", F.round("word_count", 4).alias("word_count"), F.round("char_count", 4).alias("char_count"))


S_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"


@query(f"""WITH n AS (SELECT {S_NORM} AS norm FROM embeddings), e AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT round(avg(norm), 5) AS norm_mean, round(stddev_pop(norm), 5) AS norm_std, round(min(norm), 5) AS norm_min, round(max(norm), 5) AS norm_max, (SELECT round(avg(x), 5) FROM e) AS global_mean, (SELECT round(stddev_pop(x), 5) FROM e) AS global_std FROM n""")
def embedding_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("q"), F.size("embedding").alias("k"))
    n, s, q = F.sum("k"), F.sum("s"), F.sum("q")
    r = lambda c: F.round(c, 5)
    return e.agg(r(F.avg("norm")).alias("norm_mean"), r(F.stddev_pop("norm")).alias("norm_std"), r(F.min("norm")).alias("norm_min"), r(F.max("norm")).alias("norm_max"), r(s / n).alias("global_mean"), r(F.sqrt(q / n - (s / n) * (s / n))).alias("global_std"))


@query("""WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)), m AS (SELECT i, avg(x) AS a, stddev_pop(x) AS s FROM e GROUP BY 1)
SELECT vec_id, round(sqrt(sum(((x - a) / s) * ((x - a) / s))), 4) AS norm, round(sum((x - a) / s), 4) AS total FROM e JOIN m USING (i) GROUP BY 1""")
def embedding_standardize(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    m = e.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(64)]).alias("a"), F.array(*[F.stddev_pop(F.col("v")[i]) for i in range(64)]).alias("s"))
    z = F.zip_with(F.zip_with("v", "a", lambda x, a: x - a), F.col("s"), lambda d, s: d / s)
    rows = e.crossJoin(F.broadcast(m)).select("vec_id", z.alias("z"))
    return rows.select("vec_id", F.round(F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"), F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"SELECT a.record_id, a.type_token_ratio * 0.25 AS lexical, b.comma * 0.25 AS marks, b.char_count FROM ({s_style27('merged_records', 'record_id', G)}) a JOIN ({s_style23('merged_records', 'record_id', G)}) b USING (record_id)")
def fused_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Feature blocks joined by record, each weighted by a quarter (not by position)."""
    m = texts(spark, sf, MERGED, "record_id", G)
    a, b = S.style27(m, "record_id", G).select("record_id", "type_token_ratio"), S.style23(m, "record_id", G).select("record_id", "comma", "char_count")
    return a.join(b, "record_id").select("record_id", (F.col("type_token_ratio") * 0.25).alias("lexical"), (F.col("comma") * 0.25).alias("marks"), "char_count")


S_TERMS_OF = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
S_DOC_TERMS = S_TERMS_OF.format(x=s_text("text"))


@query(f"""WITH c AS (SELECT doc_id, source_split, term, count(*) AS tf FROM (SELECT doc_id, source_split, unnest({S_DOC_TERMS}) AS term FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents WHERE source_split = 'train'),
v AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM c WHERE source_split = 'train' GROUP BY 1), n WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT 1000),
r AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term) WHERE source_split = 'test') SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM r""")
def tfidf_transform(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary fitted on the train documents, applied to the test documents."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source_split")
    terms = X.word_terms(T.text("text"))
    v = X.Vectorizer.fit(d.where("source_split = 'train'"), "doc_id", terms, 1000)
    return v.transform(d.where("source_split = 'test'"), "doc_id", terms).withColumn("tfidf", F.round("tfidf", 6))


@query()
def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors by the embedding hook."""
    from tidemill.operators import models as M

    e = M.embed(table(spark, sf, "documents"), "doc_id", "text")
    return e.select("doc_id", F.size("embedding").alias("dims"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("norm"))
