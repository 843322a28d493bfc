"""Problem 5: texts that a token budget, a storage limit or a broken transfer cut.

Histograms of the lengths of all values are counted per source and column: in characters, in bytes, and in characters per
token of the budget (in twentieths). A length is a spike where far more values end openly, that is without terminal
punctuation, than at the lengths around it; a budget's bin is one where nearly all do, as happens only at the maximum that a
budget leaves. Values at a spike that end openly are cut. All of that is built-in SQL over all rows.

A limit leaves a spike, a broken transfer does not. So two more kinds of evidence count, each told in the output: less is
stored than the model produced (`excess`), and a mark of omission (`mark`); there, and where nothing else speaks (`end`), a
linear model of last words decides whether a sentence stopped. It is fitted on a bounded sample (at most SAMPLE_ROWS rows) of
texts and pieces of them, and is asked only about values that end openly.

Defined results: null, empty and blank texts, and marks for no answer, are never cut; null lengths give no evidence; null
sources are one source; lists are cut only on evidence, tables and junk never; copies of the prefix and refusals are not
cases; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import NOTHING_SQL, HashedLogit, attach, bounded_sample, clean, copied, cut, h32, map_batches, words
from tidemill.llm.shapes import LIST, PROSE, describe, majority

BITS = 15
SAMPLE_ROWS = 2000
LEAST_END = 0.88  # without any other evidence, the last words must say so this clearly
LEAST_SPIKE, TIMES, REACH = 5, 6.0, 12
BUDGET_SHARE = 0.8

MARK = r"(?:\s*(?:[\[(<]?(?:\.{3}|…)[\])>]?|[\[<(](?:truncated|cut|cut off|snip|more|continued|omitted|end of buffer|eof)[\]>)]|�+))+$"
SIGNATURE = r"\n\s*(?:[—–-]{1,2} ?[^\n]{1,60}|[A-Z]\w{2,15}: ?[\d./]{1,8}|#\w+(?: #\w+)*)$"
SENTENCE_END = re.compile(r"[.!?]['\"”’)\]]*(?=\s)|\n")
BLANKS = " \t\n\r\f\v ­​‌‍‎‏  ⁠　﻿"
OPEN = r"[\p{L}\p{N},;:\-–—(“‘/&]$"
FIRST_PERSON = frozenset("i im i'm we my me you your us our am".split())


def blank_free(c: Column) -> Column:
    """Without blanks at the end; only texts that end with one are gone through."""
    return F.when(F.right(c, F.lit(1)).rlike(f"[{BLANKS}]"), F.rtrim(c, F.lit(BLANKS))).otherwise(c)


def end_of(text: Column) -> tuple[Column, Column, Column]:
    """The text without a closing mark of omission; whether there was one; whether what is left ends openly."""
    bare = blank_free(text)
    marked = F.right(bare, F.lit(64)).rlike("(?i)" + MARK)
    bare = F.when(marked, blank_free(F.regexp_replace(bare, "(?i)" + MARK, ""))).otherwise(bare)
    return bare, marked, F.right(bare, F.lit(1)).rlike(OPEN) & ~F.right(bare, F.lit(90)).rlike(SIGNATURE)


def lengths(df: DataFrame, source: str, columns: tuple[str, ...]) -> DataFrame:
    """The histograms: values and openly ending values per source, column, measure (chars, bytes) and length."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return by_measure(counted(df.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.explode(values).alias("v")).select("source", "v.column", "v.value"), "value", "source", "column"))


def counted(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Values and openly ending ones by length in characters and in bytes: one pass over the values."""
    rows = df.where(F.length(value) > 0).select(*by, F.length(value).alias("chars"), F.octet_length(value).alias("bytes"), end_of(F.col(value))[2].alias("is_open"))
    return rows.groupBy(*by, "chars", "bytes").agg(F.count("*").alias("n"), F.count_if("is_open").alias("n_open"))


def by_measure(counts: DataFrame) -> DataFrame:
    both = counts.select("source", "column", F.expr("stack(2, 'chars', chars, 'bytes', bytes) as (measure, length)"), "n", "n_open")
    return both.groupBy("source", "column", "measure", "length").agg(F.sum("n").alias("n"), F.sum("n_open").alias("n_open"))


def length_spikes(histogram: DataFrame, least: int = LEAST_SPIKE, times: float = TIMES, reach: int = REACH) -> DataFrame:
    """Lengths at which at least `least` values end openly, `times` as many as on average at the lengths around (and a half more)."""
    open_ = histogram.where("n_open > 0")
    shifts = open_.select("source", "column", "measure", "length", F.col("n_open").alias("other"), F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k])).alias("shift"))
    around = shifts.groupBy("source", "column", "measure", (F.col("length") + F.col("shift")).alias("length")).agg((F.sum("other") / (2 * reach)).alias("expected"))
    joined = open_.join(around, ["source", "column", "measure", "length"], "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    return joined.where((F.col("n_open") >= least) & (F.col("n_open") >= times * (F.col("expected") + 0.5)))


def budget_bin(n_chars: Column, budget: Column) -> Column:
    return F.when(budget > 0, F.floor(n_chars * 20 / budget).cast("bigint"))


def budget_spikes(counts: DataFrame, least: int = LEAST_SPIKE, share: float = BUDGET_SHARE) -> DataFrame:
    """Bins of characters per budgeted token (in twentieths) in and beside which nearly all values end openly."""
    rows = counts.where("chars > 60").select(budget_bin(F.col("chars"), F.col("budget")).alias("bin"), "n", "n_open").where("bin is not null")
    bins = rows.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("n_open").alias("n_open"))
    near = bins.select(F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"), "n", "n_open").groupBy("bin").agg(F.sum("n").alias("n_around"), F.sum("n_open").alias("open_around"))
    return bins.join(near, "bin").where((F.col("n_open") > 0) & (F.col("open_around") >= least) & (F.col("open_around") >= share * F.col("n_around"))).select("bin")


def chars_per_token(df: DataFrame, text: str, completion: str, model: str) -> DataFrame:
    """Median characters per token of each model whose completion lengths are in tokens, over all its rows."""
    ratio = F.length(text) / F.col(completion)
    rows = df.where((F.col(completion) >= 20) & ratio.between(2.5, 8.0)).select(F.col(model).cast("string").alias("_model"), ratio.alias("ratio"))
    return rows.groupBy("_model").agg(F.percentile_approx("ratio", F.lit(0.5), F.lit(1000)).alias("per_token"), F.count("*").alias("_n")).where("_n >= 20").drop("_n")


def observed(df: DataFrame, key: str, source: str, prefix: str, text: str, completion: str, budget: str, model: str) -> DataFrame:
    """Each record with what lengths and endings say, by built-in functions; texts and prefixes stay beside."""
    df = df.select(F.col(key).alias("record_key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(model).cast("string").alias("_model"), F.col(prefix).alias("prefix"), F.col(text).alias("text"), F.col(completion).cast("bigint").alias("completion"), F.col(budget).cast("bigint").alias("budget"))
    counts = cut(counted(df.withColumn("column", F.lit("text")), "text", "source", "column", "budget"))
    spikes = length_spikes(by_measure(counts))
    bare, mark, is_open = end_of(F.col("text"))
    rows = df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0))).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0))).withColumn("mark", F.coalesce(mark, F.lit(False)))
    nothing = (F.length(bare) < 80) & F.trim(F.regexp_replace("text", f"[{BLANKS}]+", " ")).rlike(NOTHING_SQL)  # longer ones end with a bracket
    rows = rows.withColumn("is_open", F.coalesce(is_open & ~nothing, F.lit(False)))
    for measure in ("chars", "bytes"):
        rows = attach(rows, spikes.where(F.col("measure") == measure).select("source", F.col("length").alias(f"n_{measure}"), F.lit(True).alias(f"spike_{measure}")), ["source", f"n_{measure}"])
    rows = attach(rows.withColumn("bin", budget_bin(F.col("n_chars"), F.col("budget"))), budget_spikes(counts).withColumn("spike_budget", F.lit(True)), ["bin"])
    rows = attach(rows, chars_per_token(df, "text", "completion", "_model"), ["_model"])
    n, c = F.col("n_chars"), F.col("completion")
    excess = F.when(c >= 0.97 * n, c > n * 1.02 + 6).otherwise(c * F.coalesce("per_token", F.lit(4.3)) > n * 1.06 + 6)
    flags = {"spike": F.coalesce("spike_chars", "spike_bytes", F.lit(False)), "at_budget": F.coalesce(F.col("spike_budget") & (n > 60), F.lit(False)), "excess": F.coalesce(excess, F.lit(False))}
    return rows.select("record_key", "source", "prefix", "text", "n_chars", "n_bytes", "mark", "is_open", *[v.alias(k) for k, v in flags.items()])


# The model of last words ------------------------------------------------------------------------------------------------


def _shape(w: str) -> str:
    if w[:1].isdigit():
        return "#"
    low = w.lower()
    if len(low) <= 4 and low == w:
        return low
    return ("C" if w[:1].isupper() else "") + next((s for s in ("ed", "ly", "s") if low.endswith(s)), "x")


TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[,;:—–(“”]")
_MARK = re.compile(MARK, re.I)


def tail_of(text: str) -> str:
    """A text without blanks and marks of omission at its end."""
    text = text.rstrip(BLANKS)
    near = text[-64:]
    m = _MARK.search(near)
    return text[: len(text) - len(near) + m.start()].rstrip(BLANKS) if m else text


def end_features(tail: str, known: frozenset[str]) -> tuple[np.ndarray, list[float]]:
    """Hashed and dense features of how a text stops: its last words, their shapes, and its last, unended sentence."""
    start = 0
    for m in SENTENCE_END.finditer(tail):
        start = m.end() if m.end() < len(tail) else start
    sentence = TOKEN.findall(tail, start)
    ws = [w for w in sentence if w[0].isalnum()]
    last = ws[-1] if ws else ""
    low, shapes = [w.lower() for w in ws], [_shape(w) for w in sentence[-6:]]
    n = len(ws)
    verbs = sum(1 for w in low[:-1] if w.endswith("ed") or w in ("was", "were", "is", "are", "had", "has"))
    f = [f"1{low[-1]}" if ws else "0", "2" + " ".join(low[-2:]), "3" + " ".join(low[-3:]), f"e{last[-3:]}", f"E{last[-2:]}", f"n{min(n, 14)}", f"v{min(verbs, 3)}", f"l{min(len(last), 9)}"]
    for k in (1, 2, 3, 4, 5):
        f.append(f"s{k} " + " ".join(shapes[-k:]))
    f.append(f"nv{min(n, 10)} {min(verbs, 3)}")
    f.append(f"w{(low[0] if low else '')} {min(n, 10)} {min(verbs, 2)}")
    unknown = bool(last) and last.lower() not in known and not last[:1].isdigit()
    dense = [unknown and not last[:1].isupper(), unknown and last[:1].isupper(), unknown and len(last) < 4, bool(sentence) and not sentence[-1][0].isalnum(), min(n, 40) / 20.0, not ws]
    return np.array([h32(x) & ((1 << BITS) - 1) for x in f], dtype=np.int64), [float(x) for x in dense]


class EndModel:
    """Whether a text that ends openly stopped within a sentence: fitted on pieces of texts that end properly."""

    def __init__(self, sample: list[tuple], seed: int = 11):
        """sample: bounded rows (prefix, text)."""
        rng = random.Random(seed)
        pairs = [r for r in sample if r[0] and r[1]]
        known: set[str] = set()
        for p, t, *_ in pairs:
            known.update(words(p))
            known.update(words(t)[:-1])
        self.known = frozenset(known)
        good = [t for _, t, *_ in pairs if len(t) > 60 and t.rstrip()[-1:] in tuple(".!?。") and "�" not in t and majority(describe(t)[1]) == PROSE]
        rows, dense, y = [], [], []
        for t in good:
            t = clean(t).rstrip()
            stops = [m.start() for m in SENTENCE_END.finditer(t + " ") if m.start() > 20 and t[m.start()] != "\n"]
            for _ in range(2):
                piece = t[: rng.randrange(max(20, len(t) // 4), len(t))].rstrip()
                if piece and (piece[-1].isalnum() or piece[-1] in ",;:"):
                    f, d = end_features(piece, self.known)
                    rows.append(f), dense.append(d), y.append(1.0)
            for _ in range(2):
                piece = t[: rng.choice(stops)] if stops else ""
                if piece and piece[-1].isalnum():
                    f, d = end_features(piece, self.known)
                    rows.append(f), dense.append(d), y.append(0.0)
        self.model, self.accuracy = HashedLogit(BITS, 6, l2=1e-4), 0.0
        if y:
            dense_a, y_a = np.array(dense), np.array(y)
            held = np.arange(len(y)) % 5 == 0
            keep = np.flatnonzero(~held)
            self.model.fit([rows[i] for i in keep], dense_a[keep], y_a[keep], epochs=8)
            self.held_out = (self.model.scores([rows[i] for i in np.flatnonzero(held)], dense_a[held]), y_a[held])
            self.accuracy = float(((self.held_out[0] > 0.5) == self.held_out[1]).mean())

    def scores(self, tails: list[str]) -> np.ndarray:
        if not tails:
            return np.zeros(0)
        features = [end_features(t, self.known) for t in tails]
        return self.model.scores([f for f, _ in features], np.array([d for _, d in features]))


def fit_ends(df: DataFrame, key: str = "record_id", prefix: str = "human_prefix", text: str = "generated_text", sample_rows: int = SAMPLE_ROWS) -> EndModel:
    """Fit on at most sample_rows rows, whatever the table's size."""
    rows = bounded_sample(df.where(F.col(prefix).isNotNull() & F.col(text).isNotNull()), key, [key, prefix, text], sample_rows)
    return EndModel([(r[1], r[2]) for r in sorted(rows, key=lambda r: str(r[0]))])


COLUMNS = {"key": "record_id", "source": "dataset_name", "prefix": "human_prefix", "text": "generated_text", "completion": "completion_length", "budget": "max_new_tokens", "model": "model_label"}
ROUTES = ("spike", "at_budget", "excess", "mark", "end")


def judge(prefix: str | None, text: str, p_end: float, evidence: tuple[bool, ...]) -> str | None:
    """The route by which a text that ends openly is a case, or none. evidence: at a spike, at the budget, excess, mark."""
    found = next((r for r, m in zip(ROUTES, evidence) if m), "end")
    _, votes, tokens = describe(text)
    kind = majority(votes)
    if kind == LIST:
        if found == "end":
            return None
    # A spike needs no model; an end alone must be clear.
    elif kind != PROSE or p_end < {"spike": 0.0, "at_budget": 0.0, "end": LEAST_END}.get(found, 0.02):
        return None
    if len(tokens) < 60 and sum(w in FIRST_PERSON for w in tokens) > 0.12 * len(tokens) and found not in ("spike", "at_budget"):
        return None  # a refusal
    if prefix:
        pre = words(prefix)
        cov, share = copied(tokens, pre, frozenset(pre))
        if cov >= 0.88 and share >= 0.4:
            return None
    return found


def truncated(df: DataFrame, ends: EndModel | None = None, **columns: str) -> DataFrame:
    """Each record with `is_cut` and the first evidence for it: spike, at_budget, excess, mark or end."""
    c = COLUMNS | columns
    ends = ends or fit_ends(df, c["key"], c["prefix"], c["text"])
    shared = df.sparkSession.sparkContext.broadcast(ends)
    rows = observed(df, **c)

    def fn(ids: list, sources: list, prefixes: list, texts: list, chars: list, sizes: list, *flags: list) -> dict[str, list]:
        p_end = shared.value.scores([tail_of(clean(t)) for t in texts])
        route = [judge(p, t, e, marks) for p, t, e, marks in zip(prefixes, texts, p_end.tolist(), zip(*flags))]
        return {"record_key": ids, "source": sources, "n_chars": chars, "n_bytes": sizes, "p_end": p_end.tolist(), "route": route}

    kind = df.schema[c["key"]].dataType.simpleString()
    judged = map_batches(rows.where("is_open"), ["record_key", "source", "prefix", "text", "n_chars", "n_bytes", *ROUTES[:4]], fn, f"record_key {kind}, source string, n_chars int, n_bytes int, p_end double, route string")
    out = ["record_key", "source", "n_chars", "n_bytes", "p_end", "route"]
    rest = rows.where("not is_open").select("record_key", "source", "n_chars", "n_bytes", F.lit(0.0).alias("p_end"), F.lit(None).cast("string").alias("route"))
    both = judged.select(*out, F.col("route").isNotNull().alias("is_cut")).unionByName(rest.select(*out, F.lit(False).alias("is_cut")))
    return both.withColumnRenamed("record_key", c["key"])
