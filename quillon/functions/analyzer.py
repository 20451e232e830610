"""The text analyzer: runs of letters and digits, lower-cased, those of 40 bytes or more left out."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 40


def tokens(text: Column) -> Column:
    """The tokens of a text column, null where it is null; built-in expressions only."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: F.octet_length(t) < LONGEST)


def analyze(text: str) -> list[str]:
    """The same for a literal of a query."""
    cleaned = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower())
    return [t for t in cleaned.split() if len(t.encode()) < LONGEST]


def padded(tokens_: Column) -> Column:
    """Tokens as one string in which each has a space of its own on either side, for phrase tests."""
    return F.concat(F.lit(" "), F.array_join(tokens_, "  "), F.lit(" "))


def phrase(words: list[str]) -> str:
    """The words as they stand in padded()."""
    return " " + "  ".join(words) + " "


def occurrences(tokens_: Column, word: str) -> Column:
    return F.size(tokens_) - F.size(F.array_remove(tokens_, word))


def phrase_occurrences(tokens_: Column, words: list[str]) -> Column:
    """Occurrences that don't overlap."""
    text, wanted = padded(tokens_), phrase(words)
    return ((F.length(text) - F.length(F.replace(text, F.lit(wanted), F.lit("")))) / len(wanted)).cast("long")


def near(tokens_: Column, words: list[str], slop: int) -> Column:
    """Whether each word has a place such that, less its rank in the phrase, all places lie within `slop`.

    Places are bound once by a one-element transform; a lambda that named the token array itself would
    evaluate the analyzer for each element.
    """

    def places(word: str, rank: int) -> Column:
        at = F.transform(tokens_, lambda t, k: F.when(t == word, k))
        return F.transform(F.filter(at, lambda p: p.isNotNull()), lambda p: p - rank)

    shifted = [places(w, i).alias(f"a{i}") for i, w in enumerate(words)]
    bound = F.array(F.struct(*shifted))

    def within(s: Column) -> Column:
        def start(m: Column) -> Column:
            tests = [F.exists(s[f"a{i}"], lambda p: (p >= m) & (p <= m + slop)) for i in range(len(words))]
            out = tests[0]
            for t in tests[1:]:
                out = out & t
            return out

        return F.exists(F.flatten(F.array(*[s[f"a{i}"] for i in range(len(words))])), start)

    return F.exists(bound, within)
