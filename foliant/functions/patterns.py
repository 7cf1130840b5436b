"""Named patterns for personal and reference data, as expressions.

``\\b`` in these patterns means an ASCII word boundary. Java's is Unicode-aware, so each
``\\b`` is written out with look-around; DuckDB's and most other engines' is ASCII already.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import arrays

#: The names in their order, and the pattern of each.
NAMED = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "phone-us": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "phone-intl": r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,14}\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit-card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6": r"\b[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]{0,16})?\b",
    "uk-postcode": r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b",
    "us-zip": r"\b\d{5}(?:-\d{4})?\b",
    "date-iso": r"\b\d{4}-\d{2}-\d{2}\b",
    "date-us": r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
}

_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: What a text with a match of the named pattern surely holds: looked for first, as most texts have no match.
_HINTS = {
    "email": "@", "phone-us": "[0-9]{3}", "phone-intl": r"\+[0-9]", "ssn": "[0-9]{2}", "credit-card": "[0-9]{4}", "ipv4": r"[0-9]\.[0-9]", "ipv6": "[0-9A-Fa-f]:[0-9A-Fa-f]",
    "iban": "[A-Z]{2}[0-9]{2}", "uk-postcode": "[A-Z][0-9]", "us-zip": "[0-9]{5}", "date-iso": "[0-9]-[0-9]{2}-[0-9]", "date-us": "[0-9]/[0-9]",
}
_HINT_OF = {pattern: _HINTS[name] for name, pattern in NAMED.items()}
#: A boundary next to what only a letter or digit can match needs one look-around.
_WORD_CHAR = r"(?:\\d|\[[A-Za-z0-9\\-]+\])"
_STARTS_IN_WORD = re.compile(r"^\\b(?=(?:\(\?:)?" + _WORD_CHAR + ")")
_ENDS_IN_WORD = re.compile("(?<=[]d})?])" + r"\\b$")


def java_pattern(pattern: str) -> str:
    """The pattern with ASCII word boundaries for Spark's regular expressions."""
    if pattern in _HINT_OF:
        # Every named pattern that ends in a boundary ends in a letter or digit.
        pattern = _ENDS_IN_WORD.sub("(?![A-Za-z0-9_])", _STARTS_IN_WORD.sub("(?<![A-Za-z0-9_])", pattern))
    return pattern.replace(r"\b", _EDGE)


def _hinted(text: Column, pattern: str, found: Column, none: Column) -> Column:
    return F.when(text.rlike(_HINT_OF[pattern]), found).otherwise(none) if pattern in _HINT_OF else found


def named_pattern(name: str) -> str:
    if name not in NAMED:
        raise ValueError(f"no pattern is named {name!r}; there are {', '.join(NAMED)}")
    return NAMED[name]


def checked_pattern(pattern: str) -> str:
    """A user's pattern, refused before any job starts if it is empty or not valid."""
    if not pattern:
        raise ValueError("an empty pattern matches nothing")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a valid pattern: {e}") from e
    return pattern


def available_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(NAMED.items())], "position int, name string, pattern string")


def matches(text: Column, pattern: str) -> Column:
    """All non-overlapping matches that are not empty, in order; null text gives none."""
    found = F.regexp_extract_all(text, F.lit(java_pattern(pattern)), 0)
    none = F.array().cast("array<string>")
    return _hinted(text, pattern, F.coalesce(F.filter(found, lambda m: m != ""), none), none)


def count(text: Column, pattern: str) -> Column:
    none = F.lit(0).cast("bigint")
    return _hinted(text, pattern, F.coalesce(F.regexp_count(text, F.lit(java_pattern(pattern))).cast("bigint"), none), none)


def redact(text: Column, pattern: str, mark: str) -> Column:
    """The text with the mark in place of each match. The text is bound once, so that calls can be nested at the cost of a sum."""
    return F.get(F.transform(F.array(text), lambda t: _hinted(t, pattern, F.regexp_replace(t, java_pattern(pattern), mark), t)), F.lit(0))


def redact_counted(text: Column, names: list[str], mark: str) -> Column:
    """struct<t, n>: the text after all named patterns in turn, and how often each was replaced in what the earlier ones left."""
    state = F.struct(text.alias("t"), F.array().cast("array<bigint>").alias("n"))
    for name in names:
        state = F.get(F.transform(F.array(state), partial(_redact_step, named_pattern(name), mark)), F.lit(0))
    return state


def _redact_step(pattern: str, mark: str, s: Column) -> Column:
    left = _hinted(s["t"], pattern, F.regexp_replace(s["t"], java_pattern(pattern), mark), s["t"])
    return F.struct(left.alias("t"), F.concat(s["n"], F.array(count(s["t"], pattern))).alias("n"))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, match>> of all matches, start from 0, in characters."""
    found = matches(text, pattern)
    # Splitting at the matches gives the gaps; each start follows from the stop before it.
    gaps = F.split(text, java_pattern(pattern), -1)
    rows = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap")))
    empty = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def placed(rows: Column) -> Column:
        before = arrays.sums_before(F.transform(rows, lambda r: r["gap"] + F.length(r["match"])))
        start = lambda r, b: b + r["gap"]
        return F.zip_with(rows, before, lambda r, b: F.struct(start(r, b).alias("start"), (start(r, b) + F.length(r["match"])).alias("stop"), r["match"].alias("match")))

    return F.when(F.size(found) > 0, arrays.bound(rows, placed)).otherwise(empty)
