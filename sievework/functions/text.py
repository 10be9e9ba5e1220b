"""Sentences, phrases and negation."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that cancel a phrase anywhere behind them in a sentence.
NEGATORS = (
    "aren't", "can't", "cannot", "didn't", "doesn't", "don't", "isn't", "neither",
    "never", "nor", "nothing", "not", "without", "won't", "wouldn't",
)
_WORD = re.compile(r"[a-z0-9]+(?:['’-][a-z0-9]+)*")


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column | str) -> Column:
    """Sentences: split behind . ! ? where white space follows; stripped, empty ones dropped.  Null gives none."""
    parts = F.split(stripped(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def phrase_regex(phrase: str) -> str:
    """The phrase's words with any white space between, not inside a longer run of letters or digits."""
    return r"(?<![0-9a-z])" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"(?![0-9a-z])"


@functools.lru_cache(maxsize=4096)
def _compiled(phrase: str) -> re.Pattern[str]:
    return re.compile(phrase_regex(phrase))


def phrases_in(sentence: Column, phrases: tuple[str, ...]) -> Column:
    """Sorted phrases that occur in the sentence, natively."""
    low = F.lower(sentence)
    found = [F.when(low.contains(p.split()[0]) & low.rlike("(?U)" + phrase_regex(p)), F.lit(p)) for p in sorted(phrases)]
    return F.array_compact(F.array(*found))


def phrase_counts(text: Column, phrases: tuple[str, ...]) -> Column:
    """Array of (phrase, hits) of the phrases that begin anywhere in the text."""
    low = F.lower(text)
    found = [F.when(low.contains(p.split()[0]), F.struct(F.lit(p).alias("phrase"), F.regexp_count(low, F.lit("(?U)" + phrase_regex(p))).alias("hits"))) for p in phrases]
    return F.filter(F.array(*found), lambda x: x["hits"] > 0)


def negated(sentence: str, start: int) -> bool:
    """Whether a phrase that starts there is cancelled by a word before it."""
    before = _WORD.findall(sentence[:start].lower())
    return bool(before) and (before[-1] == "no" or not set(NEGATORS).isdisjoint(before))


def affirmed(sentence: str, phrase: str) -> bool:
    """Whether the phrase occurs in the sentence at a place that isn't negated."""
    return any(not negated(sentence, m.start()) for m in _compiled(phrase).finditer(sentence.lower()))


def _affirmed_each(sentence: pd.Series, phrases: pd.Series) -> pd.Series:
    return pd.Series([[p for p in ps if affirmed(s, p)] for s, ps in zip(sentence, phrases)], dtype=object)


def affirmed_of(sentence: Column | str, phrases: Column | str) -> Column:
    """Those of the phrases of a sentence that aren't negated; only sentences with phrases should come here."""
    return F.pandas_udf(_affirmed_each, "array<string>")(sentence, phrases)


def word_count(text: Column | str) -> Column:
    """Runs of Unicode letters and digits; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), 1))


def duration(seconds: Column | str) -> Column:
    """A span of whole seconds in its largest unit and the next smaller one, where that isn't 0; null stays null."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    units = ((86_400, "d"), (3600, "h"), (60, "min"), (1, "s"))
    out = F.concat(c.cast("string"), F.lit(" s"))
    for (big, name), (small, below) in zip(units[-2::-1], units[:0:-1]):
        rest = F.floor(c % big / small)
        both = F.concat(F.floor(c / big).cast("string"), F.lit(f" {name}"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(f" {below}"))).otherwise(""))
        out = F.when(c >= big, both).otherwise(out)
    return out
