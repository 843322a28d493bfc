"""The text functions that Spark has no built-in for, as Arrow-batched functions, and hooks for external models.

A hook is a function over a pandas Series; the defaults are deterministic and need no model. Null stays null.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HOOKS: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register(name: str, f: Callable[[pd.Series], pd.Series]) -> None:
    """Replace a hook: lemma, language, subwords, embedding or generate."""
    HOOKS[name] = f


@contextmanager
def using(name: str, f: Callable[[pd.Series], pd.Series]) -> Iterator[None]:
    """A hook for as long as the block runs."""
    before = HOOKS.get(name)
    HOOKS[name] = f
    try:
        yield
    finally:
        if before is None:
            del HOOKS[name]
        else:
            HOOKS[name] = before


def nfc(c: Column) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return f(c)


def unescape(c: Column) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)

    return f(c)


def decoded(c: Column) -> Column:
    """NFC, then entities: one pass over the text."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            t = t if t.isascii() else unicodedata.normalize("NFC", t)
            return html.unescape(t) if "&" in t else t

        return s.map(one)

    return f(c)


def _lemma(s: pd.Series) -> pd.Series:
    """Suffix rules for English nouns; words that no rule fits stay as they are."""

    def one(w: str) -> str:
        if len(w) > 4 and w.endswith("ies"):
            return w[:-3] + "y"
        if len(w) > 4 and re.search(r"(?:ss|x|ch|sh)es$", w):
            return w[:-2]
        if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
            return w[:-1]
        return w

    return s.map(lambda t: None if t is None else " ".join(map(one, t.split(" "))))


def _language(s: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        if re.search("[一-鿿]", t):
            return "zh"
        if re.search("[Ѐ-ӿ]", t):
            return "ru"
        ws = re.findall(r"[^\W\d_]+", t.lower())
        marks = {"en": {"the", "of", "and", "in", "was", "to"}, "de": {"der", "die", "das", "und", "ein", "den"}, "fr": {"le", "la", "les", "une", "du", "et"}, "es": {"el", "los", "una", "del", "por", "que"}, "it": {"il", "di", "della", "che", "gli", "una"}}
        best = max(marks, key=lambda k: (sum(w in marks[k] for w in ws), k == "en"))
        return best if any(w in marks[best] for w in ws) else None

    return s.map(one)


def _subwords(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.split())


def _generate(s: pd.Series) -> pd.Series:
    """Stands in for a generator: the last ten words of the prompt, turned round."""
    return s.map(lambda t: None if t is None else " ".join(reversed(t.split()[-10:])))


def _embedding(s: pd.Series) -> pd.Series:
    """Hashed counts of words in 64 places, with signs."""

    def one(t: str | None) -> list[float] | None:
        if t is None:
            return None
        v = [0.0] * 64
        for w in t.lower().split():
            h = zlib.crc32(w.encode("utf-8", "replace"))
            v[h % 64] += 1.0 if h & 64 else -1.0
        return v

    return s.map(one)


HOOKS.update(embedding=_embedding, lemma=_lemma, language=_language, subwords=_subwords, generate=_generate)


def hook(name: str, c: Column) -> Column:
    f = HOOKS[name]
    kind = "array<string>" if name == "subwords" else "array<float>" if name == "embedding" else "string"

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return f(s)

    return run(c)
