"""Problem 2: statistics of words, symbols and lines; noisy labelling functions over them; posterior text types.

Each labelling function looks at a few statistics and votes prose, list, table, junk or nothing. The accuracies of the
functions are learnt without labels, by expectation-maximization over how often each pattern of votes occurs in the whole
table (a few hundred patterns, counted in Spark), and every record gets the posterior of its pattern.

Defined results: null, empty and blank texts have zero statistics and the kind `empty`; texts that are only a mark for no
answer have their statistics and the kind `empty`, too; ties between kinds go to the first of KINDS; repeated rows are counted
and reported as often as they come.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import COMMON, NOTHING, WORD, attach, clean, cut, map_batches

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
NONE = 4

BULLET = re.compile(r"\s*(?:[-*•·‣▪◦–—+]\s+|\[[ xX✓]?\]\s*|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z][.)]\s+|\(?[ivxlIVXL]{1,5}[.)]\s+|(?:step|item|no\.?|point|schritt|étape|paso)\s*\d+\s*[:.)]\s*|[☐☑✓✔➤→]\s*)", re.I)
TERMINAL = re.compile(r"[.!?。！？…]['\"”’»)\]*]*\s*$")
FIELD_RULE = re.compile(r"^[\s|:+=-]+$")
NUMBER = re.compile(r"^[-+]?[\d.,]+%?$")
INNER = re.compile(r"[^\W\d_][.!?]['\"”’]* +['\"“‘]*[A-ZÀ-ÖØ-ÞА-Я\d]")
GAP = re.compile(r"\S(?:\t| {3,})\S")
HEX = re.compile(r"^(?:[0-9a-f]{2,16}[\s:,-]*)+$", re.I)
CJK, KANA = re.compile("[぀-鿿가-힯]"), re.compile("[぀-ヿ]")
MOJIBAKE = re.compile("[ÃÂâïð][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]|ï¿½|�")
# English determiners, and words that don't follow one in a sentence that a reader can follow.
DETERMINERS = frozenset("the a an every its his their our".split())
NEVER_AFTER = frozenset("the a an every its his their our of to in at by for from with and or but that which was were is are be been had has have would it they we he she as because although while before after until since so".split())
VOWELS = frozenset("aeiouyàáâäæãåāèéêëēėęîïíīįìôöòóœøōõûüùúūαεηιουωаеёиоуыэюя")

STATISTICS = "n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, terminal_share double, common_share double, distinct_share double, bullet_share double, field_share double, words_per_line double"


def _fields(lines: list[str]) -> tuple[float, float]:
    """Share of the lines that are rows of one same separator, and the share of numbers and empties in their fields."""
    n = len(lines)
    best = (0.0, 0.0)
    if n < 2:
        return best
    for sep in ("\t", "|", ";", ",", None):
        if sep is None:
            rows = [re.split(r"\s{2,}|\t", x.strip()) for x in lines if GAP.search(x)]
            rows = [r for r in rows if len(r) > 1]
            if len(rows) < 2:
                continue
            share = sum(1 for x in lines if GAP.search(x) or len(x.split()) <= 2) / n
        else:
            counts = [x.rstrip(",; ").count(sep) if sep in ",;" else x.count(sep) for x in lines]
            some = [c for c in counts if c]
            if len(some) < 2:
                continue
            usual = max(set(some), key=some.count)
            if sep in ",;" and usual < 2 and max(map(len, lines)) > 60:
                continue
            share = sum(1 for c in counts if c == usual or sep in "|\t" and c) / n
            rows = [[f.strip() for f in x.strip().strip("|").split(sep)] for x in lines if sep in x]
        flat = [f for r in rows for f in r]
        short = sum(1 for f in flat if len(f) <= 24) / max(1, len(flat))
        if short < 0.8:
            continue
        numeric = sum(1 for f in flat if not f or NUMBER.match(f)) / max(1, len(flat))
        if (share, numeric) > best:
            best = (share, numeric)
    return best


_PLAIN, _COMMON, _DIGITS, _BARE, _CLUSTER, _BARE_CLUSTER, _COMMON_BARE = range(1, 8)
_infos: dict[str, int] = {}


def _info(t: str) -> int:
    """What kind of word it is; kept for repeated words in a table of bounded size."""
    bare = len(t) > 2 and t.isalpha() and VOWELS.isdisjoint(t)
    if t.isdigit():
        v = _DIGITS
    elif t in COMMON:
        v = _COMMON_BARE if bare else _COMMON
    else:
        cluster = len(t) > 4 and not any(c.isdigit() for c in t) and sum(map(VOWELS.__contains__, t)) < 0.21 * len(t)
        v = (_BARE_CLUSTER if bare else _CLUSTER) if cluster else _BARE if bare else _PLAIN
    if len(_infos) < 200_000:
        _infos[t] = v
    return v


def _is_cjk(text: str) -> bool:
    """Whether the whole text is Chinese, Japanese or Korean by its letters, with the shares of common.language."""
    n = len(CJK.findall(text))
    if not n:
        return False
    letters = sum(map(str.isalpha, text))
    return n > 0.4 * letters or len(KANA.findall(text)) > 0.1 * letters


def describe(text: str | None) -> tuple[tuple, tuple[int, ...], list[str]]:
    """The statistics (in the order of STATISTICS), the votes of the labelling functions, the words."""
    text = clean(text) if text else ""
    if not text.strip():
        return (len(text), 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (NONE,) * 11, []
    tokens = WORD.findall(text.lower())
    lines = [x for x in text.splitlines() if x.strip()] or [text]
    n, nl, nw = len(text), len(lines), len(tokens)
    letters = sum(map(len, tokens))
    spaces = text.count(" ") + text.count("\n") + text.count("\t")
    symbols = max(0, n - letters - spaces) / n
    infos = [_infos.get(t) or _info(t) for t in tokens]
    digit_ratio = infos.count(_DIGITS) / max(1, nw)
    common = (infos.count(_COMMON) + infos.count(_COMMON_BARE)) / max(1, nw)
    kinds = len(set(tokens))
    distinct = kinds / max(1, nw)
    ended = sum(1 for x in lines if len(x) > 25 and TERMINAL.search(x.rstrip()[-8:])) / nl
    bullets = sum(1 for x in lines if BULLET.match(x)) / nl
    inner = len(INNER.findall(text)) if nw >= 14 and ended < 0.5 else 0
    body = lines[1:] if nl > 3 and not any(s in lines[0] for s in "|\t") else lines
    body = [x for x in body if not FIELD_RULE.match(x)] or body
    fields, numeric = _fields(body) if nl > 1 else (0.0, 0.0)
    per_line = nw / nl
    cjk = not text.isascii() and _is_cjk(text)
    loop = nw >= 24 and kinds <= max(8, min(0.12 * nw, 12))  # long prose repeats words, too, but not so few
    bare = infos.count(_BARE) + infos.count(_COMMON_BARE)
    consonants = bare / max(1, nw)
    cluster = (infos.count(_CLUSTER) + infos.count(_BARE_CLUSTER)) / max(1, nw)
    consonants += infos.count(_BARE_CLUSTER) / max(1, nw)
    bad = 0 if text.isascii() else len(MOJIBAKE.findall(text)) / max(1, n)
    hexes = sum(1 for x in lines if len(x) > 11 and HEX.match(x.strip()) and any(c.isdigit() for c in x)) / nl
    solid = 0.0 if cjk else sum(1 for x in lines if len(x) > 25 and len(x.split()) == 1) / nl
    body_bullets = sum(1 for x in body if BULLET.match(x)) / len(body)
    body_words = sorted(len(x.split()) for x in body)
    middle = body_words[len(body_words) // 2]
    word_mean = letters / max(1, nw)
    follows = [tokens[i + 1] for i, v in enumerate(infos[:-1]) if v == _COMMON and tokens[i] in DETERMINERS] if nw >= 12 else []
    stray = sum(1 for b in follows if b in NEVER_AFTER) / len(follows) if len(follows) > 2 else 0.0
    votes = (
        PROSE if (ended >= 0.5 or inner >= 2) and per_line >= 7 or (cjk and "。" in text) else NONE,
        (PROSE if 0.12 <= common <= 0.62 else JUNK if common > 0.78 else NONE) if nw >= (4 if nl == 1 and ended else 8) and not cjk else NONE,
        LIST if body_bullets >= 0.6 and len(body) >= 3 else NONE,
        LIST if len(body) >= 3 and middle <= 7 and max(body_words) <= 14 and fields < 0.5 and symbols < 0.22 and common < 0.4 and bad < 0.02 and cluster < 0.3 else NONE,
        TABLE if fields >= 0.7 and len(body) >= 3 and body_bullets < 0.6 else NONE,
        TABLE if fields >= 0.6 and numeric >= 0.2 and len(body) >= 2 and body_bullets < 0.6 else NONE,
        JUNK if symbols > 0.3 and fields < 0.5 or nw < 0.04 * n and n > 20 and not cjk else NONE,
        JUNK if loop or hexes >= 0.6 or solid >= 0.6 and fields < 0.5 else NONE,
        JUNK if bad > 0.02 or not cjk and (consonants > 0.2 or cluster > 0.25) and digit_ratio < 0.5 and fields < 0.5 else NONE,
        JUNK if common > 0.8 and nw >= 12 or stray > 0.15 else JUNK if nw >= 12 and common < 0.02 and ended == 0 and fields < 0.5 and body_bullets < 0.6 and middle > 7 and not cjk else NONE,
        PROSE if cjk and n >= 15 and text.count("。") * 80 >= n or nw >= 20 and per_line >= 12 and symbols < 0.12 and distinct > 0.3 and 2.5 < word_mean < 16 and (common >= 0.08 or ended >= 0.5) and common < 0.75 and cluster < 0.2 and bad < 0.02 else NONE,
    )
    stats = (n, nw, nl, word_mean, symbols, digit_ratio, ended, common, distinct, bullets, fields, per_line)
    return stats, votes, tokens


N_VOTES = 11


def majority(votes: tuple[int, ...]) -> int:
    """The kind with most votes, before any learning; prose where nothing speaks."""
    counts = [float(votes.count(k)) for k in range(4)]
    counts[PROSE] -= 0.6 * (votes[1] == PROSE)
    if not any(counts):
        return PROSE
    if JUNK in votes[6:9] and votes[10] != PROSE:
        return JUNK
    if counts[JUNK] and counts[JUNK] >= max(counts[LIST], counts[TABLE]) and counts[JUNK] >= counts[PROSE]:
        return JUNK
    return max(range(4), key=lambda k: (counts[k], -k))


def encode(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 5 + v
    return code


def decode(code: int) -> list[int]:
    out = []
    for _ in range(N_VOTES):
        out.append(code % 5)
        code //= 5
    return out[::-1]


def learn_accuracies(patterns: dict[int, int], rounds: int = 60) -> dict[int, np.ndarray]:
    """Expectation-maximization over counts of vote patterns: the posterior over KINDS of each pattern.

    Every function has its own table of P(vote | kind); abstaining counts as a vote. It starts from the majority vote.
    """
    codes = sorted(patterns)
    if not codes:
        return {}
    votes = np.array([decode(c) for c in codes])
    weight = np.array([patterns[c] for c in codes], dtype=float)
    post = np.full((len(codes), 4), 0.04)
    for i, row in enumerate(votes):
        post[i, majority(tuple(row))] += 0.84
    hot = np.stack([votes == v for v in range(5)], axis=2).astype(float)
    for _ in range(rounds):
        prior = (post * weight[:, None]).sum(0) + 1.0
        prior /= prior.sum()
        table = np.einsum("ik,i,ijv->kjv", post, weight, hot) + 0.1
        for k in range(4):  # a function that votes for a kind is taken to be better than chance at it
            table[k, :, k] += 0.3
        table /= table.sum(2, keepdims=True)
        logs = np.log(prior)[None, :] + np.einsum("ijv,kjv->ik", hot, np.log(table))
        logs -= logs.max(1, keepdims=True)
        new = np.exp(logs)
        new /= new.sum(1, keepdims=True)
        if np.abs(new - post).max() < 1e-7:
            post = new
            break
        post = new
    return {c: post[i] for i, c in enumerate(codes)}


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per record: its statistics and the code of its votes (null for empty texts)."""

    def fn(ids: list, texts: list) -> dict[str, list]:
        rows = [describe(t) for t in texts]
        names = [c.split()[0] for c in STATISTICS.split(", ")]
        out = {n: [r[0][i] for r in rows] for i, n in enumerate(names)}
        return out | {"record_key": ids, "votes": [encode(r[1]) if r[0][2] and not NOTHING.match(clean(t).strip()) else None for r, t in zip(rows, texts)]}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, [key, text], fn, f"record_key {kind}, {STATISTICS}, votes bigint")


def text_types(df: DataFrame, key: str = "record_id", text: str = "generated_text") -> DataFrame:
    """Every record with its statistics, its kind and the posterior of that kind."""
    rows = cut(statistics(df, key, text))
    counts = {r["votes"]: r["count"] for r in rows.where("votes is not null").groupBy("votes").count().collect()}
    learnt = [(c, KINDS[int(np.argmax(p))], float(p.max())) for c, p in learn_accuracies(counts).items()]
    rows = attach(rows, df.sparkSession.createDataFrame(learnt, "votes bigint, kind string, posterior double"), ["votes"])
    return rows.select(
        F.col("record_key").alias(key),
        *[c.split()[0] for c in STATISTICS.split(", ")],
        F.when(F.col("votes").isNull(), "empty").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("votes").isNull(), 1.0).otherwise(F.col("posterior")).alias("posterior"),
    )
