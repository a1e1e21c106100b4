"""Which of many terms occur in a text: one automaton for all of them, one pass over a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Bytes of the terms that are broadcast at most; their automaton is some 30 times larger in each worker.
MOST_BYTES = 8_000_000

#: A term of such characters only counts as a word of its own; others count anywhere.
_WORD_TERM = re.compile(r"[a-z0-9_ +.@:/-]+").fullmatch
_WORD = re.compile(r"[a-z0-9_]").match

#: The terms that a worker last built an automaton of, and that automaton.
_built: list = [None, None]


def _automaton(terms: tuple[str, ...]) -> object:
    """The automaton over `terms`, built once in a worker."""
    import ahocorasick

    if _built[0] != terms:
        built = ahocorasick.Automaton()
        for place, term in enumerate(terms):
            built.add_word(term, (place, len(term), _WORD_TERM(term) is not None))
        built.make_automaton()
        _built[:] = terms, built
    return _built[1]


def occurring(text: str, automaton: object) -> set[int]:
    """Places of the terms that occur in a lower-case text."""
    out: set[int] = set()
    for end, (place, length, word) in automaton.iter(text):
        if place in out:
            continue
        start = end - length + 1
        if not word or not (start and _WORD(text[start - 1]) or end + 1 < len(text) and _WORD(text[end + 1])):
            out.add(place)
    return out


def matcher(spark: SparkSession, terms: Iterable[str]) -> Callable[[Column], Column]:
    """A function of a text column: the terms that occur in it, each once, in the order given.

    Case does not count. A term of ASCII letters, digits and signs must not touch
    other letters, digits or underscores; one with any other character may stand
    anywhere. Texts are passed once, however many the terms. A null text has none;
    empty and repeated terms are left out.
    """
    listed = tuple(dict.fromkeys(t.strip().lower() for t in terms if t and t.strip()))
    size = sum(len(t.encode()) for t in listed)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of terms are more than the {MOST_BYTES} that may be broadcast")
    if not listed:
        return lambda text: F.array().cast("array<string>")
    sent = spark.sparkContext.broadcast(listed)

    @F.pandas_udf(ArrayType(StringType()))
    def found(texts: pd.Series) -> pd.Series:
        own = sent.value
        automaton = _automaton(own)
        return pd.Series([None if t is None else [own[p] for p in sorted(occurring(t, automaton))] for t in texts.str.lower()], dtype=object)

    return lambda text: F.coalesce(found(text), F.array().cast("array<string>"))
