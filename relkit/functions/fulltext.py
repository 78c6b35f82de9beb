"""Full-text predicates: natural and boolean search compiled to one Column each.

Text is compared as its lower-case words (runs of letters, digits and _).  There is no
ranking: a predicate holds or it does not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from relkit.functions.expr import col


def words(*columns) -> Column:
    """The distinct lower-case words of the columns."""
    text = F.concat_ws(" ", *(col(c) for c in columns))
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))


def _terms(query: str) -> list[str]:
    return re.findall(r"\w+", query.lower())


def natural(query: str, *columns) -> Column:
    """Any word of the query occurs."""
    terms = _terms(query)
    return F.arrays_overlap(words(*columns), F.array(*map(F.lit, terms))) if terms else F.lit(False)


def _begins(own: Column, start: str) -> Column:
    return F.exists(own, lambda w: w.startswith(start))


def boolean(query: str, *columns) -> Column:
    """`+must`, `-must not`, `"a phrase"`, `begins*`; with neither + nor phrase, any plain word must occur."""
    own = words(*columns)
    # words with single spaces around, for phrases
    line = F.concat(F.lit(" "), F.array_join(F.split(F.lower(F.concat_ws(" ", *(col(c) for c in columns))), r"[^\p{L}\p{N}_]+"), " "), F.lit(" "))
    must: list[Column] = []
    never: list[Column] = []
    may: list[Column] = []
    for sign, phrase, word, star in re.findall(r'([+-]?)(?:"([^"]*)"|(\w+)(\*?))', query):
        if phrase:
            found = line.contains(" " + " ".join(_terms(phrase)) + " ")
        elif star:
            found = _begins(own, word.lower())
        else:
            found = F.array_contains(own, word.lower())
        (must if sign == "+" else never if sign == "-" else may).append(found)
    out = F.lit(bool(must or may))
    for c in must:
        out = out & c
    if may and not must:
        some = may[0]
        for c in may[1:]:
            some = some | c
        out = out & some
    for c in never:
        out = out & ~c
    return out


def expanded(query: str, *columns, related: dict[str, list[str]] | None = None) -> Column:
    """Natural search with further terms for the query's words."""
    terms = _terms(query)
    return natural(" ".join(terms + [x for t in terms for x in (related or {}).get(t, [])]), *columns)
