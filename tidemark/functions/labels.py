"""Canonical answers of article labels, written in many ways."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of yes and no, and the illnesses that may be named.
YES = ("y", "yes", "true", "1", "t")
NO = ("n", "no", "false", "0", "f")
ILLNESSES = ("covid", "flu", "rsv", "respiratory_general")

#: Every canonical answer per field; illness answers are the sorted subsets, and none.
ANSWERS = {
    "relevant": ["n", "y"],
    "illness": ["none", *sorted("|".join(sorted(c)) for n in range(1, 5) for c in combinations(ILLNESSES, n))],
    "concern": ["0", "1", "2", "3"],
}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def relevant_answer(text: str | Column) -> Column:
    """y or n; null for blanks and anything else."""
    s = F.lower(F.trim(_c(text)))
    return F.when(s.isin(*YES), "y").when(s.isin(*NO), "n")


def illness_answer(text: str | Column) -> Column:
    """Lower case, distinct, sorted, joined by |, or none; null if blank, mixed with none, or unknown."""
    parts = F.split(F.regexp_replace(F.lower(_c(text)), "[,;]", "|"), r"\|")
    named = F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")))
    known = F.array(*[F.lit(x) for x in ILLNESSES])
    valid = (F.size(named) > 0) & (F.size(F.array_except(named, known)) == 0)
    return F.when((F.size(named) == 1) & (F.element_at(named, 1) == "none"), "none").when(valid, F.array_join(named, "|"))


def concern_answer(text: str | Column) -> Column:
    """0 to 3; whole numbers may carry a decimal zero; null otherwise."""
    return F.nullif(F.regexp_extract(F.trim(_c(text)), r"^\+?0*([0-3])(?:\.0*)?$", 1), F.lit(""))
