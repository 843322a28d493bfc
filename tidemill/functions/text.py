"""Column functions over text: lengths, tokens, normalisation, style features. All of them run in the JVM.

Null text counts as the empty text everywhere. White space is what Unicode calls so, as a character class that Java and RE2
read alike. Expressions that use the tokens of a text more than once should get them as a column that was projected before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = f"[^{SPACE}]+"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STYLE_MARKS = {".": "period", ",": "comma", "!": "exclamation", "?": "question", ";": "semicolon", ":": "colon", "-": "dash", '"': "dquote", "'": "squote"}

# Contractions, in the order in which they are applied.
CONTRACTIONS = {
    "can't": "cannot", "won't": "will not", "n't": " not",
    "'re": " are", "'s": " is", "'d": " would", "'ll": " will",
    "'t": " not", "'ve": " have", "'m": " am",
}

# The stop words of the traditional pipeline.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by "
    "can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have "
    "haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into "
    "is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our "
    "ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs "
    "them themselves then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't "
    "we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't "
    "would wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()

# Conjunctions and pronouns of the style features.
CONJUNCTIONS = "and but or nor for yet so although because since while whereas however therefore furthermore moreover nevertheless consequently thus".split()
PRONOUNS = "i me my myself we our ours ourselves you your yours yourself he him his himself she her hers herself it its itself they them their theirs themselves".split()


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def char_count(c: Column) -> Column:
    return F.length(c).cast("bigint")


def word_count(c: Column) -> Column:
    return count_of(c, TOKEN)


def sentence_count(c: Column) -> Column:
    """Runs of closing marks, at least one; none in blank text."""
    return F.when(is_blank(c), F.lit(0)).otherwise(F.greatest(F.lit(1), F.regexp_count(c, F.lit("[.!?]+")))).cast("bigint")


def paragraph_count(c: Column) -> Column:
    """Parts between blank lines that hold anything."""
    return F.size(F.filter(F.split(c, "\n\n"), lambda x: F.length(strip(x)) > 0)).cast("bigint")


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def fingerprint_key(c: Column) -> Column:
    """The text by which duplicates are told: stripped, in lower case, white space collapsed."""
    return normalize_whitespace(F.lower(c))


def is_valid_unicode(c: Column) -> Column:
    return ~F.contains(c, F.lit("�"))


def drop_controls(c: Column) -> Column:
    """Without characters of Unicode's categories C*, but for line feeds and tabs."""
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t]]", "")


def clean_lines(c: Column) -> Column:
    """Line feeds only; runs of blanks and tabs collapsed; each line and the whole stripped."""
    lines = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")
    return strip(F.array_join(F.transform(lines, lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), "\n"))


def expand_contractions(c: Column) -> Column:
    for key, value in CONTRACTIONS.items():
        c = F.regexp_replace(c, rf"(?U)\b{key}\b", value)
    return c


def drop_punctuation(c: Column) -> Column:
    return F.translate(c, ASCII_PUNCTUATION, "")


def content_tokens(c: Column) -> Column:
    """Tokens that aren't stop words; the stop words are a constant of the plan."""
    return F.filter(tokens(c), lambda x: ~x.isin(*STOPWORDS))


def pipeline_a(c: Column) -> Column:
    """Style-preserving normalisation after Unicode and entities are done (see functions.python)."""
    return clean_lines(drop_controls(c))


def pipeline_b(c: Column) -> Column:
    """Traditional normalisation after Unicode and entities are done: no case, contractions, punctuation, stop words."""
    return clean_lines(F.array_join(content_tokens(drop_punctuation(expand_contractions(F.lower(c)))), " "))


def ngrams(tokens: Column, n: int) -> Column:
    """Adjacent tokens, joined by blanks; tokens must be a projected column."""
    out = F.slice(tokens, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    for k in range(1, n):
        part = F.slice(tokens, k + 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        out = F.zip_with(out, part, lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def syllables(word: Column) -> Column:
    return F.greatest(F.regexp_count(F.regexp_replace(F.lower(word), r"e+\z", ""), F.lit("[aeiou]+")), F.lit(1))


def once_only(tokens: Column) -> Column:
    """How many of the tokens occur once: neighbours in sorted order are compared, so it is not quadratic."""
    s = F.array_sort(tokens)
    n = F.size(s)
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(s, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(s, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    alone = F.zip_with(F.zip_with(s, before, lambda a, b: F.when(~a.eqNullSafe(b), a)), after, lambda a, b: F.when(a.isNotNull() & ~a.eqNullSafe(b), F.lit(1)).otherwise(F.lit(0)))
    return F.when(n > 0, F.aggregate(alone, F.lit(0), lambda x, y: x + y)).otherwise(F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def per(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def occurrences(c: Column, mark: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))).cast("bigint")
