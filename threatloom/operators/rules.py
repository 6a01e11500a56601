"""User-supplied rule tables: audit, then use.

A rule table has the columns category, pattern, description, position.  It is a
rule catalogue, not data: patterns are compiled into the plan, so it is read to
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions import constants as K
from threatloom.operators.language import CATEGORIES, Rule, builtin_rules


def backtracking_form(pattern: Column) -> Column:
    """The first known unbounded-backtracking form a pattern contains, else null."""
    forms = F.array(*[F.lit(f) for f in K.BACKTRACKING_FORMS])
    return F.get(F.filter(forms, lambda f: F.contains(pattern, f)), F.lit(0))


def audit(rules: DataFrame) -> DataFrame:
    """Adds ``unsafe_form`` (null when none) and ``accepted``."""
    return rules.withColumn("unsafe_form", backtracking_form(F.col("pattern"))).withColumn(
        "accepted", F.col("unsafe_form").isNull()
    )


def load_rules(rules: DataFrame, extend: bool = True) -> list[Rule]:
    """Rules of a table in its order, after the built-in ones of each category.

    Raises ValueError for an unsafe pattern or an unknown category.
    """
    rows = (
        audit(rules)
        .select("category", "pattern", "description", "position", "accepted")
        .orderBy("position", "pattern")
        .collect()
    )
    for row in rows:
        if not row["accepted"]:
            raise ValueError(f"pattern may backtrack without bound: {row['pattern']!r}")
        if row["category"] not in CATEGORIES:
            raise ValueError(f"unknown category: {row['category']!r}")
    added = [Rule(r["category"], r["pattern"], r["description"]) for r in rows]
    known = builtin_rules() if extend else []
    return [r for c in CATEGORIES for r in (*known, *added) if r.category == c]
