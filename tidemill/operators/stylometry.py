"""Style features, as one projection of built-in expressions each; blank texts have zeros where the definition says so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as T

# A boundary between word characters (letters, numbers, the low line) and others: \b of Java leaves out other numbers.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
WORD27 = EDGE + "[a-zA-Z']+" + EDGE
WORD23 = r"[\p{L}\p{N}_]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _any(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def style27(df: DataFrame, key: str, c: str) -> DataFrame:
    """Five lexical, nine punctuation, two character, five structure, four syntax and two readability features."""
    t = F.col("t")
    rows = df.select(key, T.text(c).alias("t")).withColumn("words", F.regexp_extract_all(t, F.lit(WORD27), F.lit(0)))
    rows = rows.withColumn("low", F.transform("words", F.lower))
    # White space here is that of the pattern language, so that both sides of a check read it alike.
    full = lambda x: F.length(T.strip(x)) > 0
    rows = rows.withColumns({
        "n_words": F.size("words"), "n_chars": F.length(t), "n_sentences": F.greatest(F.lit(1), F.size(F.filter(F.split(t, rf"(?<=[.!?])[{T.SPACE}]+"), full))),
        "n_paragraphs": F.greatest(F.lit(1), F.size(F.filter(F.split(t, r"\n{2,}"), full))), "syllables": T.total(F.transform("words", T.syllables)), "letters": T.total(F.transform("words", F.length)),
    })
    nw, nc, ns, npar = (F.col(x) for x in ("n_words", "n_chars", "n_sentences", "n_paragraphs"))
    ease = F.when(nw > 0, 206.835 - 1.015 * (nw / ns) - 84.6 * (F.col("syllables") / nw)).otherwise(0.0)
    grade = F.when(nw > 0, 0.39 * (nw / ns) + 11.8 * (F.col("syllables") / nw) - 15.59).otherwise(0.0)
    features = {
        "avg_word_length": T.per(F.col("letters"), nw), "avg_sentence_length": nw / ns, "type_token_ratio": T.per(F.size(F.array_distinct("low")), nw), "hapax_legomena_ratio": T.per(T.once_only(F.col("low")), nw), "word_count": nw,
        **{f"punct_ratio_{name}": T.per(T.occurrences(t, mark), nc) for mark, name in T.STYLE_MARKS.items()},
        "digit_ratio": T.per(T.count_of(t, r"\p{Nd}"), nc), "uppercase_ratio": T.per(T.count_of(t, r"\p{Lu}"), nc),
        "sentence_count": ns, "paragraph_count": npar, "avg_paragraph_length": nw / npar, "whitespace_ratio": T.per(T.count_of(t, f"[{T.SPACE}]"), nc), "char_count": nc,
        "question_density": T.occurrences(t, "?") / ns, "exclamation_density": T.occurrences(t, "!") / ns, "conjunction_ratio": T.per(T.count_of(t, _any(T.CONJUNCTIONS)), nw), "pronoun_ratio": T.per(T.count_of(t, _any(T.PRONOUNS)), nw),
        "flesch_reading_ease": F.greatest(F.lit(-100.0), F.least(F.lit(121.0), ease)), "flesch_kincaid_grade": F.greatest(F.lit(0.0), F.least(F.lit(18.0), grade)),
    }
    blank = T.is_blank(t)
    return rows.select(key, *[F.round(F.when(blank, F.lit(0.0)).otherwise(v.cast("double")), 6).alias(n) for n, v in features.items()])


def style23(df: DataFrame, key: str, c: str) -> DataFrame:
    t = F.col("t")
    rows = df.select(key, T.text(c).alias("t")).withColumn("words", F.regexp_extract_all(F.lower(t), F.lit(WORD23), F.lit(0)))
    rows = rows.withColumns({"n": F.size("words"), "chars": F.length(t), "sentences": F.greatest(F.lit(1), F.size(F.filter(F.split(t, "[.!?]+"), lambda x: F.length(T.strip(x)) > 0)))})
    n, chars, one = F.col("n"), F.col("chars"), F.greatest(F.col("chars"), F.lit(1))
    of = lambda p: T.count_of(t, p) / one
    size_if = lambda f: F.size(F.filter("words", f))
    features = {
        "char_count": chars, "word_count": n, "sentence_count": F.col("sentences"), "unique_words": F.size(F.array_distinct("words")), "avg_word_length": T.per(T.total(F.transform("words", F.length)), n), "avg_sentence_length": n / F.col("sentences"),
        "type_token_ratio": T.per(F.size(F.array_distinct("words")), n), "hapax_ratio": T.per(T.once_only(F.col("words")), n), "uppercase_ratio": of(r"\p{Lu}"), "digit_ratio": of(r"\p{Nd}"), "whitespace_ratio": of(f"[{T.SPACE}]"), "punctuation_ratio": of(PUNCTUATION),
        "comma": T.occurrences(t, ","), "period": T.occurrences(t, "."), "semicolon": T.occurrences(t, ";"), "colon": T.occurrences(t, ":"), "question": T.occurrences(t, "?"), "exclamation": T.occurrences(t, "!"), "quotes": T.occurrences(t, '"'), "dash": T.occurrences(t, "-"),
        "parenthesis": T.occurrences(t, "(") + T.occurrences(t, ")"), "lexical_density": T.per(size_if(lambda w: F.length(w) >= 7), n), "short_word_ratio": T.per(size_if(lambda w: F.length(w) <= 3), n),
    }
    return rows.select(key, *[F.round(v.cast("double"), 6).alias(k) for k, v in features.items()])


def style14(df: DataFrame, key: str, c: str) -> DataFrame:
    t = F.col("t")
    rows = df.select(key, T.text(c).alias("t")).withColumn("words", T.tokens(t))
    n = F.size("words")
    features = {
        "word_count": n, "char_count": F.length(t), "avg_word_length": T.per(T.total(F.transform("words", F.length)), n), "lexical_diversity": T.per(F.size(F.array_distinct("words")), n), "uppercase": T.count_of(t, r"\p{Lu}"), "digits": T.count_of(t, r"\p{Nd}"), "punctuation": T.count_of(t, PUNCTUATION),
        "comma": T.occurrences(t, ","), "period": T.occurrences(t, "."), "question": T.occurrences(t, "?"), "exclamation": T.occurrences(t, "!"), "newline": T.occurrences(t, "\n"), "quotes": T.occurrences(t, '"'), "whitespace": T.count_of(t, f"[{T.SPACE}]"),
    }
    return rows.select(key, *[F.round(v.cast("double"), 6).alias(k) for k, v in features.items()])


def standardized(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; 0 where a column is constant. The moments are one row, broadcast."""
    moments = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = df.crossJoin(F.broadcast(moments))
    return both.select(key, *[F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) for c in columns])
