"""Golden values of the text functions."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemill.functions import python as P
from tidemill.functions import text as T
from tidemill.operators import stylometry as S
from tidemill.operators import tfidf as X

SAMPLE = "It's late, but we walk home. Why? Because trees are tall!\n\nNumbers: 42 (and more)."
DIRTY = "café &amp; tea​\r\nline\rtwo\t\tend "


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "t string").select(c.alias("r")).collect()[0]["r"]


def t():
    return T.text("t")


def test_lengths(spark):
    df = spark.createDataFrame([(SAMPLE,), (None,), ("   ",), ("no mark",)], "t string")
    rows = df.select(T.char_count(t()), T.word_count(t()), T.sentence_count(t()), T.paragraph_count(t())).collect()
    assert [tuple(r) for r in rows] == [(82, 15, 4, 2), (0, 0, 0, 0), (3, 0, 0, 0), (7, 2, 1, 1)]


def test_unicode_spaces_separate_words(spark):
    assert one(spark, T.word_count(t()), "a b　c d") == len("a b　c d".split())


def test_style27(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "  "), (3, None)], "i int, t string")
    rows = {r[0]: tuple(r)[1:] for r in S.style27(df, "i", "t").collect()}
    expected = (4.071429, 3.5, 1.0, 1.0, 14, 0.02439, 0.012195, 0.012195, 0.012195, 0, 0.012195, 0, 0, 0.012195, 0.02439, 0.04878, 4, 2, 7, 0.182927, 82, 0.25, 0.25, 0.214286, 0.142857, 106.596786, 0)
    assert rows[1] == pytest.approx(expected, abs=1e-6)
    assert rows[2] == rows[3] == (0.0,) * 27


def test_style23(spark):
    df = spark.createDataFrame([(1, SAMPLE)], "i int, t string")
    expected = (82, 16, 4, 16, 3.625, 4, 1, 1, 0.04878, 0.02439, 0.182927, 0.109756, 1, 2, 0, 1, 1, 1, 0, 0, 2, 0.125, 0.5)
    assert tuple(S.style23(df, "i", "t").collect()[0])[1:] == pytest.approx(expected, abs=1e-6)


def test_words_with_combining_marks_and_fractions(spark):
    df = spark.createDataFrame([(1, "½cup tea")], "i int, t string")
    assert S.style27(df, "i", "t").collect()[0]["word_count"] == 1.0  # a number touches "cup", so that is no word of letters


@pytest.mark.parametrize(
    "text,expected",
    [(DIRTY, "café & tea\nlinetwo end"), ("Don't stop! It's  a \"test\", isn't it?", 'Don\'t stop! It\'s a "test", isn\'t it?')],
)
def test_pipeline_a(spark, text, expected):
    assert one(spark, T.pipeline_a(T.text(P.decoded(F.col("t")))), text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [(DIRTY, "café tea​ line two end"), ("Don't stop! It's  a \"test\", isn't it?", "don stop test isn"), ("They'll can't won't “quoted” cats", "will will “quoted” cats")],
)
def test_pipeline_b(spark, text, expected):
    assert one(spark, T.pipeline_b(T.text(P.decoded(F.col("t")))), text) == expected


def test_contractions(spark):
    assert one(spark, T.expand_contractions(t()), "don't it's can't won't isn't i'm they'll") == "don not it is cannot will not isn not i am they will"


def test_tags_and_spaces(spark):
    assert one(spark, T.normalize_whitespace(T.strip_tags(t())), " <p>a  <b>b</b>\n c</p> ") == "a b c"


def test_nfc_and_entities_keep_null(spark):
    df = spark.createDataFrame([("café &lt;3",), (None,)], "t string")
    rows = [r[0] for r in df.select(P.decoded(F.col("t"))).collect()]
    assert rows == [unicodedata.normalize("NFC", "café") + " <3", None]


def test_ngrams_and_once_only(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["x"],), ([],)], "w array<string>")
    rows = df.select(T.ngrams(F.col("w"), 2), T.ngrams(F.col("w"), 3), T.once_only(F.col("w"))).collect()
    assert [tuple(r) for r in rows] == [(["a b", "b a", "a c"], ["a b a", "b a c"], 2), ([], [], 1), ([], [], 0)]


def test_char_ngrams_inside_words(spark):
    df = spark.createDataFrame([(["cat", "a"],)], "w array<string>")
    assert df.select(X.char_wb(F.col("w"), (3,))).collect()[0][0] == [" ca", "cat", "at ", " a "]
    assert df.select(X.char_wb(F.col("w"), (5,))).collect()[0][0] == [" cat ", " a "]


def test_tfidf_against_definition(spark):
    docs = {1: "red red blue", 2: "red green", 3: "blue green green"}
    df = spark.createDataFrame(list(docs.items()), "i int, t string")
    got = {(r["i"], r["term"]): r["tfidf"] for r in X.tfidf(df, "i", X.word_terms(t()), 10, min_df=1, max_df=1.0).collect()}
    raw = {}
    for i, d in docs.items():
        for w in set(d.split()):
            n = sum(w in x.split() for x in docs.values())
            raw[i, w] = (1 + math.log(d.split().count(w))) * (math.log((1 + 3) / (1 + n)) + 1)
    for (i, w), v in raw.items():
        norm = math.sqrt(sum(x * x for (j, _), x in raw.items() if j == i))
        assert got[i, w] == pytest.approx(v / norm)
    assert len(got) == len(raw)


def test_hooks_can_be_replaced(spark):
    old = P.HOOKS["lemma"]
    try:
        P.register("lemma", lambda s: s.str.upper())
        assert one(spark, P.hook("lemma", F.col("t")), "cats") == "CATS"
    finally:
        P.register("lemma", old)
    assert one(spark, P.hook("lemma", F.col("t")), "cats stories glass") == "cat story glass"
    assert one(spark, P.hook("language", F.col("t")), "der Hund und die Katze") == "de"
    assert one(spark, P.hook("subwords", F.col("t")), "a b") == ["a", "b"]


def test_term_weights_without_rows_per_document(spark):
    """Sums as of one row per document and term: repeated and missing keys, short words, more characters than fit, empty texts."""
    from tidemill.operators import grams as C

    wide = "".join(chr(0x4E00 + k) + (" " if k % 7 == 0 else "") for k in range(5000))
    rows = [(1, "The cat  sat\non a mat, a b c"), (2, "a cat a dog"), (2, "On THE mat"), (3, None), (4, ""), (5, " \n"), (None, "a lone cat"), (None, "b b b"), (6, wide), (7, wide[:900]), (8, "\U0001f600 the  mat x")] + [(k, f"the mat {k}") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    ranges = {"2-2": (2,), "4-4": (4,), "3-5": (3, 4, 5)}
    keyed = df.select(F.coalesce("i", F.lit(-1)).alias("i"), F.coalesce("t", F.lit("")).alias("t")).withColumn("w", T.tokens(F.lower("t")))
    n = df.count()
    for in_words in (True, False):
        c = F.lower(F.col("t")) if in_words else X.one_blank(F.col("t"))
        got = {(r["ngram_range"], r["term"]): (r["n_documents"], round(r["weight"], 9)) for r in C.term_weights(df, "i", T.text(c), ranges, 3000, in_words).collect()}
        want = {}
        for name, sizes in ranges.items():
            counts = X.term_counts(keyed, "i", X.char_wb(F.col("w"), sizes) if in_words else X.chars(F.col("t"), sizes))
            x = X.weights(counts, X.vocabulary(counts, n, 3000), "i").groupBy("term").agg(F.count("*").alias("n"), F.sum("tfidf").alias("s"))
            want |= {(name, r["term"]): (r["n"], round(r["s"], 9)) for r in x.collect()}
        assert len(want) > 500 and got == want
