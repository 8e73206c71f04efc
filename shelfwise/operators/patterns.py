"""Long lists of name patterns: an index of what each pattern needs picks the few that can match a name.

A pattern's required literal is a run of characters that every match holds. One of its trigrams, the one that the fewest other
patterns have, stands for the pattern in a small table; a name's own trigrams are joined with it, and only the pairs that
meet are matched. Patterns without such a literal are matched with every name, as short lists are.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import count_matches
from ..functions.tables import small

#: Up to so many patterns are matched one by one; beyond, the index takes less.
MANY = 64
GRAM = 3


def required(pattern: str) -> str:
    """The longest run of ASCII characters that every match of a pattern (java.util.regex) holds, in lower case; empty where none
    is sure. Groups, classes and what may be left out are passed over; alternatives outside groups need nothing."""
    runs, run, i, n = [], "", 0, len(pattern)
    while i < n:
        c, ends = pattern[i], True
        if pattern.startswith("\\Q", i):
            e = pattern.find("\\E", i)
            run, i, ends = run + pattern[i + 2 : e if e >= 0 else n], e + 2 if e >= 0 else n, False
        elif c == "\\":
            plain = i + 1 < n and not pattern[i + 1].isalnum()
            run, i, ends = run + pattern[i + 1] * plain, i + 2, not plain
        elif c in "([":
            end = _closing(pattern, i)
            if end < 0 or re.match(r"\(\?[a-zA-Z-]*[xd]", pattern[i:]):
                return ""
            i = end + 1
        elif c == "|":
            return ""
        elif c in "*?{+":
            run = run if c == "+" else run[:-1]
            i = pattern.find("}", i) + 1 if c == "{" else i + 1
            if i == 0:
                return ""
            i += i < n and pattern[i] in "?+"
        elif c in ".^$":
            i += 1
        else:
            run, i, ends = run + c, i + 1, False
        if ends:
            runs, run = [*runs, run], ""
    return max((x for r in [*runs, run] for x in re.findall(r"[\x00-\x7f]+", r)), key=len, default="").lower()


def _closing(pattern: str, i: int) -> int:
    """Where the group or class that begins at i ends; -1 if it does not."""
    depth, in_class = 0, 0
    while i < len(pattern):
        if pattern.startswith("\\Q", i):
            i = pattern.find("\\E", i)
            if i < 0:
                return -1
            i += 2
            continue
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        in_class += (c == "[") - (c == "]" and in_class > 0)
        depth += (c == "(" and not in_class) - (c == ")" and not in_class)
        if not in_class and depth <= 0:
            return i
        i += 1
    return -1


def index_of(patterns: list[str]) -> tuple[list[tuple[str, str, int]], list[str]]:
    """(trigram, pattern, how often it is in the list) of patterns with a required literal, and the other patterns."""
    times = Counter(patterns)
    grams = {p: {lit[i : i + GRAM] for i in range(len(lit) - GRAM + 1)} for p in times for lit in [required(p)]}
    common = Counter(g for gs in grams.values() for g in gs)
    return [(min(gs, key=lambda g: (common[g], g)), p, times[p]) for p, gs in grams.items() if gs], [p for p in patterns if not grams[p]]


def with_counts(rows: DataFrame, patterns: tuple[str, ...], column: str, name: str = "name") -> DataFrame:
    """rows with how many of the patterns are found in the name; a pattern that is listed twice counts twice. Null names have none."""
    found, others = index_of(list(patterns))
    each = F.coalesce(count_matches(F.col(name), others), F.lit(0))
    if not found:
        return rows.withColumn(column, each)
    table = small(rows.sparkSession.createDataFrame(found, "_gram string, _pattern string, _times int"), len(found), 64 + max(len(p) for _, p, _ in found))
    low = F.lower("_name")
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM))))
    names = rows.select(F.col(name).alias("_name")).where(F.length(F.lower(F.col(name))) >= GRAM).distinct()
    met = names.select("_name", F.explode(own).alias("_gram")).join(table, "_gram").where(F.expr("_name rlike _pattern"))
    hits = met.groupBy("_name").agg(F.sum("_times").cast("int").alias("_hits"))
    return rows.join(hits, F.col(name) == F.col("_name"), "left").withColumn(column, each + F.coalesce("_hits", F.lit(0))).drop("_name", "_hits")


def counted(rows: DataFrame, **lists: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """rows, with a column for each list of more than MANY patterns, and for every list the column or expression that counts."""
    of = {}
    for key, patterns in lists.items():
        if len(patterns) > MANY:
            rows, of[key] = with_counts(rows, patterns, f"_{key}"), F.when(F.col("name").isNotNull(), F.col(f"_{key}"))  # null as in the plain form
        else:
            of[key] = count_matches(F.col("name"), list(patterns))
    return rows, of
