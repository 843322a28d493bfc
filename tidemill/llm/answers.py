"""Problem 1: defective answers, each with its defect.

A multi-label linear classifier (one logistic model per label over the same hashed word n-grams and pair features) is trained
on a bounded sample of answers and on synthetic defects made from them: answers emptied, cut at a random character, replaced
by a refusal, by a copy of their prefix, or by an answer to a prefix of another language. Pair features are measures, not
verdicts: how much of the answer is copied and of the prefix repeated, how much more its words speak for another language than
for the prefix's, how it stops and what of the evidence of problem 5 it has. Thresholds are calibrated on held-out rows. The
classifier alone decides `empty`, `refusal`, `copy` and `other_language`; `truncated` is by its definition a case of problem 5,
so that its operator's verdict follows the classifier's as an exact check.

Defined results: a null or blank answer is `empty` whatever its prefix is; a null prefix can give neither `copy` nor
`other_language`; null lengths give no evidence; each record has at most one defect, the first of empty, refusal, copy,
other_language, truncated; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import truncation
from tidemill.llm.common import FUNCTION_WORDS, HashedLogit, best_threshold, bounded_sample, clean, copied, h32, language, language_scores, map_batches, words
from tidemill.llm.shapes import JUNK, LIST, PROSE, TABLE, describe, majority
from tidemill.llm.truncation import COLUMNS, FIRST_PERSON, EndModel, judge, tail_of

LABELS = ("empty", "truncated", "refusal", "copy", "other_language")
BITS = 15
SAMPLE_ROWS = 2000

LABEL = re.compile(r"^\s*(?:[*#>]*\s*)?(?:[A-Z][\w ]{0,24}|[qa])\s*:\s+", re.I)

# Parts of the synthetic refusals.
OPENINGS = ["", "", "", "I'm sorry, but ", "Sorry, ", "I apologize, but ", "Unfortunately, ", "Regrettably, ", "Hmm, ", "Hello! ", "Thanks for the passage. ", "Thank you for your message. ", "I am afraid that ", "My apologies, but "]
INABILITIES = [
    "I {cannot} {verb} {object}", "I am {unable} {verb} {object}", "we are {unable} {verb} {object}", "I must decline to {verb} {object}", "I have to pass on this one; {object} is not something I can discuss",
    "it would not be appropriate for me to {verb} {object}", "as an AI language model I do not {verb} {object}", "my guidelines keep me from {ving} {object}", "this falls outside what I may assist with", "that is something I'd rather not produce",
    "I don't feel comfortable {ving} {object}", "no continuation can be offered here, since {object} may break content rules", "I cannot provide a completion for {object}", "we are unable to generate a reply to {object}", "I can't help with that request", "I won't {verb} {object}", "I won't be able to {verb} {object}", "I will not be able to assist with {ving} {object}", "I do not have the ability to {verb} {object}",
]
UNABLE = ["not able to", "unable to", "not allowed to", "not in a position to", "not comfortable trying to"]
CANNOT = ["cannot", "can't", "can not", "could not", "am unable to"]
VERBS = ["continue", "complete", "extend", "answer", "rewrite", "write more of", "respond to", "carry on with", "help with", "write about", "produce"]
GERUNDS = ["adding to", "continuing", "producing more of", "writing about", "answering"]
OBJECTS = ["this", "it", "this passage", "the passage", "such a passage", "your request", "this request", "the prompt", "your prompt", "this question", "the text", "this text", "that request", "the piece about the {noun}", "your piece about the {noun}", "such a piece about the {noun}"]
CLOSINGS = ["", "", "", ", so I will stop here", " at this time", ". I hope you understand", ". Is there anything else you need?", ". Please try a different prompt", ". Feel free to ask something else"]
LEAD_INS = ["Sorry for the long wait. ", "“I'm sorry, but I can't help you,” said {name}. ", "The council declined to answer, and as {name} put it, “no, thank you”. ", "“I cannot do this,” wrote {name}. ", "Thanks for your patience. ", "“We are unable to comment,” {name} said. "]


def refusal(rng: random.Random, noun: str) -> str:
    s = rng.choice(INABILITIES).format(cannot=rng.choice(CANNOT), unable=rng.choice(UNABLE), verb=rng.choice(VERBS), ving=rng.choice(GERUNDS), object=rng.choice(OBJECTS).format(noun=noun))
    o = rng.choice(OPENINGS)
    s = o + (s if o and not o.endswith((". ", "! ")) else s[0].upper() + s[1:]) + rng.choice(CLOSINGS)
    s = s if s[-1] in ".?!" else s + "."
    if rng.random() < 0.3:
        s = s.replace("'", "’")
    return s.lower() if rng.random() < 0.1 else s.replace("'", "") if rng.random() < 0.05 else s


def foreign(rng: random.Random, lang: str, nouns: list[str]) -> str:
    """A stand-in for a text of another language, for samples that have none: its function words among nouns."""
    out = []
    for _ in range(rng.randrange(3, 9)):
        ws = [rng.choice(FUNCTION_WORDS[lang]) if k % 2 else rng.choice(nouns) for k in range(1, rng.randrange(7, 15))]
        out.append(" ".join(ws).capitalize() + ".")
    return " ".join(out)


def no_answer(rng: random.Random) -> str:
    """A mark or token that stands for no answer."""
    what = rng.choice(["null", "none", "nil", "nan", "n/a", "na", "undefined", "empty", "no answer", "no output", "no response", "no reply", "no text", "blank", "pad", "eos", "s", "/s", "|endoftext|", "|end|", "-", "--", "...", "…", ".", '""', "''", "[]", "{}", "()", "?", "*", "_", "", " ", "\n", "\t", "\n\n"])
    if what[:1].isalpha() or what[:1] in "/|":
        what = rng.choice([what, what, what.upper(), what.capitalize()])
        a, b = rng.choice([("<", ">"), ("[", "]"), ("(", ")"), ("", "")] if what[:1].isalpha() and len(what) > 1 else [("<", ">")])
        what = (a + what + b) * (rng.choice([1, 1, 2, 3]) if a == "<" else 1)
    return what + rng.choice(["", "", "\n", " "])


def junk(rng: random.Random) -> str:
    """Characters that nobody could read: not an answer, but not for want of one."""
    signs = rng.choice(["<>~_*#|/\\\\+=-^", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"])
    return "\n".join("".join(rng.choice(signs) for _ in range(rng.randrange(12, 80))) for _ in range(rng.randrange(2, 9)))


@dataclass
class Row:
    """What the classifier sees of one answer."""

    grams: np.ndarray
    dense: list[float]
    tokens: list[str]
    kind: int
    gap: float
    copy: tuple[float, float]


N_DENSE = 25
_prefixes: dict[str, tuple[list[str], frozenset[str], str, float]] = {}


def _prefix(prefix: str) -> tuple[list[str], frozenset[str], str, float]:
    """Words, language and its share of a prefix, which many answers have in common."""
    v = _prefixes.get(prefix)
    if v is None:
        p = words(prefix)
        v = (p, frozenset(p), *language(prefix, p))
        if len(_prefixes) >= 2000:
            _prefixes.clear()
        _prefixes[prefix] = v
    return v


def observe(prefix: str | None, text: str | None, p_end: float, is_open: bool, evidence: tuple[bool, ...]) -> Row:
    """evidence: at a spike, at the budget, shorter than produced, a mark of omission (of problem 5)."""
    body = clean(text or "")
    stripped = body.strip()
    _, votes, tokens = describe(body)
    kind = majority(votes)
    nw = len(tokens)
    cov = share = gap = 0.0
    if prefix and tokens:
        p, have, lp, sp = _prefix(prefix)
        a = tokens
        m = LABEL.match(body)
        if m and m.end() < 30:
            a = words(body[m.end() :]) or tokens
        cov, share = copied(a, p, have)
        if cov > 0.5 and (m2 := LABEL.match(clean(prefix))) and m2.end() < 30:
            share = share * len(p) / max(1, len(words(clean(prefix)[m2.end() :])))
        if kind != JUNK and lp and sp >= 0.12:
            scores = language_scores(body, tokens)
            if scores:
                gap = max(0.0, max(scores.values()) - scores.get(lp, 0.0))
    ids = np.array(list(map(h32, tokens)), dtype=np.int64)
    grams = np.concatenate([ids, (ids[:-1] * 31 + ids[1:] * 17 + 5)]) if nw > 1 else ids
    if len(stripped) <= 40:  # the whole of a short answer, and what it is made of
        low = "".join(stripped.lower().split())
        grams = np.concatenate([grams, np.array([h32(f"whole {low}"), h32(f"marks {''.join(c for c in low if not c.isalnum())}"), h32(f"few {min(nw, 6)}")], dtype=np.int64)])
    person = sum(1 for t in tokens if t in FIRST_PERSON) / max(1, nw)
    p_end = min(0.999, max(0.001, p_end)) if is_open else 0.001
    said = is_open and any(evidence)
    spike, budget, excess, mark = (float(x and is_open) for x in evidence)
    enough = min(1.0, nw / 8.0)
    dense = [
        float(nw == 0), 1.0 / (1.0 + nw / 15.0), 1.0 / (1.0 + nw), person * 4, min(1.0, person * 6) / (1.0 + nw / 15.0) if nw < 60 else 0.0,
        cov, min(share, 1.5), cov * min(1.0, share * 2), max(0.0, cov - 0.8) * 5 * min(1.0, share * 2.5), min(gap * 4, 2.0) * enough, float(gap > 0.0),
        min(1.0, len(stripped) / 40), float(is_open), float(np.log(p_end / (1 - p_end))) / 4, spike, budget, excess, mark, float(said and kind == PROSE), float(said and kind == LIST),
        float(kind == PROSE), float(kind == LIST), float(kind in (TABLE, JUNK)), float(is_open and kind in (TABLE, JUNK)), p_end * (1 - said) * (kind == PROSE) * is_open,
    ]
    return Row(grams & ((1 << BITS) - 1), [float(x) for x in dense], tokens, kind, gap * enough, (cov, share))


def plainly_open(text: str) -> bool:
    tail = tail_of(text)
    return bool(tail) and (tail[-1].isalnum() or tail[-1] in ",;:-–—(“‘/&")


class AnswerModels:
    """The end-of-text model, and the five label models with their thresholds."""

    def __init__(self, sample: list[tuple], seed: int = 11):
        """sample: bounded rows (prefix, text, is_open, evidence)."""
        rng = random.Random(seed)
        pairs = [r for r in sample if r[0] and r[1]]
        self.ends = EndModel([(p, t) for p, t, *_ in pairs])
        self._fit(pairs, rng)

    def _fit(self, pairs: list[tuple], rng: random.Random) -> None:
        data: list[tuple[Row, set[str]]] = []
        nouns = [w for w in sorted(self.ends.known) if w.isalpha() and len(w) > 4] or ["story"]
        good = [(p, t) for p, t, *_ in pairs if len(t) > 60 and t.rstrip()[-1:] in tuple(".!?。") and "�" not in t and majority(describe(t)[1]) == PROSE]
        nothing = (False,) * 4

        def add(p: str, t: str, evidence: tuple[bool, ...], *labels: str) -> None:
            is_open = plainly_open(t)
            p_end = float(self.ends.scores([tail_of(clean(t))])[0]) if is_open else 0.0
            data.append((observe(p, t, p_end, is_open, evidence), set(labels)))

        by_lang: dict[str, list[tuple]] = {}
        for g in good:
            by_lang.setdefault(language(g[0], words(g[0]))[0], []).append(g)
        markers = ["...", " …", " [...]", " [truncated]", " <cut>", "…"]
        for i, (p, t) in enumerate(good):
            name = rng.choice(t.split())
            same = observe(p, t, 0.0, False, nothing)
            if same.gap > 0.1 or same.copy[0] > 0.8:
                continue
            own = language(p, words(p))[0]
            add(p, t, nothing)
            add(p, rng.choice(LEAD_INS).format(name=name) + t, nothing)
            if rng.random() < 0.5:
                add(p, t.rstrip().rstrip(".!?。"), (False, False, rng.random() < 0.05, False))
            if i % 2 == 0:
                add(p, no_answer(rng), nothing, "empty")
            if i % 6 == 0:  # short answers that say something
                add(p, " ".join(rng.choice(nouns) for _ in range(rng.randrange(1, 4))).capitalize() + rng.choice([".", "", "!"]), nothing)
                add(p, junk(rng), nothing)
            for _ in range(2):
                add(p, refusal(rng, rng.choice(nouns)), nothing, "refusal")
            piece = t[: rng.randrange(max(20, len(t) // 4), len(t))].rstrip()
            if piece[-1].isalnum():
                marked = rng.random() < 0.25
                where = rng.random()
                add(p, piece + (rng.choice(markers) if marked else ""), (where < 0.2, 0.2 <= where < 0.5, where >= 0.5 and rng.random() < 0.8, marked), "truncated")
            if i % 2 == 0:
                start = 0 if rng.random() < 0.5 else len(p) * rng.randrange(40, 56) // 100
                add(p, ("Answer: " if rng.random() < 0.2 else "") + p[start:].strip(), nothing, "copy")
                add(p, p.split(". ")[0] + ". " + t, nothing)
                add(p, p[: len(p) // 3] + " " + t[len(t) // 4 :], nothing)
            others = [k for k in by_lang if k and k != own]
            if own and (i % 2 or i % 8 == 0):
                if others and i % 8:
                    o = rng.choice(by_lang[rng.choice(others)])
                else:
                    o = (p, foreign(rng, rng.choice([k for k in sorted(FUNCTION_WORDS) if k != own]), nouns))
                if i % 8 in (0, 3, 7) and o[0] != p:  # the other way round: this answer to a prefix of another language
                    add(o[0], t, nothing, "other_language")
                add(p, ("Here is the text: " if rng.random() < 0.2 else "") + o[1], nothing, "other_language")
        for p, t, is_open, evidence in pairs:  # texts that aren't prose, and open ends as they are, judged by problem 5
            p_end = float(self.ends.scores([tail_of(clean(t))])[0]) if is_open else 0.0
            row = observe(p, t, p_end, is_open, evidence)
            if row.tokens and len(row.tokens) >= 12 and row.gap < 0.1 and row.copy[0] < 0.8 and (row.kind != PROSE or is_open):
                cut_ = is_open and judge(p, t, p_end, evidence) is not None
                data.append((row, {"truncated"} if cut_ else set()))
        rows = [r.grams for r, _ in data]
        dense = np.array([r.dense for r, _ in data]) if data else np.zeros((0, N_DENSE))
        held = np.arange(len(data)) % 4 == 0
        keep, out = np.flatnonzero(~held), np.flatnonzero(held)
        self.models, self.thresholds, self.quality = {}, {}, {}
        for label in LABELS:
            y = np.array([float(label in s) for _, s in data])
            m = HashedLogit(BITS, N_DENSE, l2=1e-4)
            if y.any():
                use, held_out = keep, out
                m.fit([rows[i] for i in use], dense[use], y[use], epochs=6)
                if label == "refusal":  # the sample has refusals of its own: short texts that the first model takes for one
                    doubt = (y == 0) & (m.scores(rows, dense) > 0.2) & np.array([len(r.tokens) < 60 for r, _ in data])
                    use, held_out = keep[~doubt[keep]], out[~doubt[out]]
                    m = HashedLogit(BITS, N_DENSE, l2=1e-4).fit([rows[i] for i in use], dense[use], y[use], epochs=6)
                p = m.scores([rows[i] for i in held_out], dense[held_out])
                self.thresholds[label] = best_threshold(p, y[held_out])
                if label == "truncated":  # an exact check follows, so that the scores only have to find nearly all
                    self.thresholds[label] = min(self.thresholds[label], 0.5 * float(np.quantile(p[y[held_out] > 0], 0.005)))
                hit = p >= self.thresholds[label]
                self.quality[label] = (float((hit & (y[held_out] > 0)).sum() / max(1, hit.sum())), float((hit & (y[held_out] > 0)).sum() / max(1, y[held_out].sum())))
            else:
                m.b, self.thresholds[label] = -20.0, 0.5
            self.models[label] = m


def fit_models(df: DataFrame, sample_rows: int = SAMPLE_ROWS, **columns: str) -> AnswerModels:
    """Fit on at most sample_rows rows, whatever the table's size."""
    return _fit(truncation.observed(df, **(COLUMNS | columns)), sample_rows)


def _fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AnswerModels:
    some = rows.where("prefix is not null and text is not null")
    got = bounded_sample(some, "record_key", ["record_key", "prefix", "text", "is_open", *truncation.ROUTES[:4]], sample_rows)
    got.sort(key=lambda r: str(r[0]))
    return AnswerModels([(r[1], r[2], bool(r[3]), tuple(map(bool, r[4:]))) for r in got])


def scored(rows: DataFrame, models: AnswerModels, kind: str) -> DataFrame:
    """The score of each label, and whether the record is a case of problem 5; rows as truncation.observed gives them."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def fn(ids: list, prefixes: list, texts: list, opens: list, *flags: list) -> dict[str, list]:
        m = shared.value
        p_end = np.zeros(len(ids))
        at = [i for i, o in enumerate(opens) if o]
        p_end[at] = m.ends.scores([tail_of(clean(texts[i])) for i in at])
        evidence = list(zip(*flags))
        seen = [observe(p, t, e, o, ev) for p, t, e, o, ev in zip(prefixes, texts, p_end.tolist(), opens, evidence)]
        grams, dense = [r.grams for r in seen], np.array([r.dense for r in seen])
        out = {f"p_{label}": m.models[label].scores(grams, dense).tolist() for label in LABELS}
        return out | {"record_key": ids, "is_cut": [bool(o) and judge(p, t, e, ev) is not None for p, t, o, e, ev in zip(prefixes, texts, opens, p_end.tolist(), evidence)]}

    return map_batches(rows, ["record_key", "prefix", "text", "is_open", *truncation.ROUTES[:4]], fn, f"record_key {kind}, is_cut boolean" + "".join(f", p_{label} double" for label in LABELS))


def defects(df: DataFrame, models: AnswerModels | None = None, **columns: str) -> DataFrame:
    """Each record with its defect (null where it has none) and the score of each label."""
    c = COLUMNS | columns
    rows = truncation.observed(df, **c)
    models = models or _fit(rows)
    over = {label: F.col(f"p_{label}") >= F.lit(models.thresholds[label]) for label in LABELS}
    defect = (
        F.when(over["empty"], "empty").when(over["refusal"], "refusal").when(over["copy"], "copy")
        .when(over["other_language"], "other_language").when(over["truncated"] & F.col("is_cut"), "truncated")
    )
    return scored(rows, models, df.schema[c["key"]].dataType.simpleString()).select(F.col("record_key").alias(c["key"]), defect.alias("defect"), *[f"p_{label}" for label in LABELS])
