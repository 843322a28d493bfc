"""Vocabulary queries over the merged records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.functions.text import TOKEN
from tidemill.operators import vocabulary as V
from tidemill.plans.base import query, texts
from tidemill.plans.corpus import MERGED, s_text

G = "generated_text"
S_TOKENS = f"regexp_extract_all({s_text(G)}, '{TOKEN}')"
S_TOTAL = f"(SELECT count(*) AS total_tokens FROM (SELECT unnest({S_TOKENS}) FROM merged_records))"


def s_ranked(items: str, k: int, most: bool = True, less: int = 0) -> str:
    return f"SELECT item, n, round(n * 100.0 / (total_tokens - {less}), 4) AS percentage FROM (SELECT item, count(*) AS n FROM ({items}) GROUP BY 1 ORDER BY n {'DESC' if most else 'ASC'}, item LIMIT {k}), {S_TOTAL}"


def s_ngrams(n: int) -> str:
    parts = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return f"SELECT {parts} AS item FROM (SELECT t, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT {S_TOKENS} AS t FROM merged_records))"


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(T.word_count(T.text(G))).alias("total_tokens"))


@query(f"SELECT count(*) AS total_tokens, count(DISTINCT w) AS vocabulary_size, round(count(DISTINCT w) / count(*), 6) AS type_token_ratio FROM (SELECT unnest({S_TOKENS}) AS w FROM merged_records)")
def vocab_overview(spark: SparkSession, sf: str) -> DataFrame:
    return V.overview(texts(spark, sf, MERGED, G), T.text(G))


@query(s_ranked(f"SELECT unnest({S_TOKENS}) AS item FROM merged_records", 20))
def top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    df = texts(spark, sf, MERGED, G)
    return V.ranked(V.ngram_counts(df, T.text(G), 1), _total(df), 20)


@query(s_ranked(f"SELECT unnest({S_TOKENS}) AS item FROM merged_records", 20, most=False))
def bottom_tokens(spark: SparkSession, sf: str) -> DataFrame:
    df = texts(spark, sf, MERGED, G)
    return V.ranked(V.ngram_counts(df, T.text(G), 1), _total(df), 20, most=False)


@query(s_ranked(s_ngrams(2), 20, less=1))
def top_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    df = texts(spark, sf, MERGED, G)
    return V.ranked(V.ngram_counts(df, T.text(G), 2), _total(df), 20, less=1)


@query(s_ranked(s_ngrams(3), 20, less=2))
def top_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    df = texts(spark, sf, MERGED, G)
    return V.ranked(V.ngram_counts(df, T.text(G), 3), _total(df), 20, less=2)


@query(f"SELECT item, count(*) AS n FROM (SELECT unnest(regexp_extract_all({s_text(G)}, '(?s).')) AS item FROM merged_records) GROUP BY 1 ORDER BY n DESC, item LIMIT 20")
def top_chars(spark: SparkSession, sf: str) -> DataFrame:
    return V.char_counts(texts(spark, sf, MERGED, G), T.text(G)).orderBy(F.desc("n"), "item").limit(20)


@query(f"SELECT DISTINCT w AS token FROM (SELECT unnest(regexp_extract_all({s_text('text')}, '{TOKEN}')) AS w FROM documents)")
def vocabulary_union(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents", "text").select(F.explode(T.tokens(T.text("text"))).alias("token")).distinct()


@query(f"""WITH a AS (SELECT DISTINCT unnest({S_TOKENS}) AS w FROM merged_records), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower({s_text(G)}), '[a-z]+')) AS w FROM merged_records)
SELECT (SELECT count(*) FROM a) AS vocabulary_a, (SELECT count(*) FROM b) AS vocabulary_b, (SELECT count(*) FROM a JOIN b USING (w)) AS shared, round((1 - (SELECT count(*) FROM b) / (SELECT count(*) FROM a)) * 100, 4) AS reduction_percent""")
def vocab_coverage(spark: SparkSession, sf: str) -> DataFrame:
    df = texts(spark, sf, MERGED, G)
    a = df.select(F.explode(T.tokens(T.text(G))).alias("w")).distinct().withColumn("a", F.lit(1))
    b = df.select(F.explode(F.regexp_extract_all(F.lower(T.text(G)), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, "w", "full")
    return both.agg(F.count("a").alias("vocabulary_a"), F.count("b").alias("vocabulary_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared")).withColumn("reduction_percent", F.round((1 - F.col("vocabulary_b") / F.col("vocabulary_a")) * 100, 4))
