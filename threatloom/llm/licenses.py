"""Licence scans: ordered signature rules over normalised words.

Texts are lower-cased in A-Z and cut into words of digits, letters and all
characters beyond ASCII.  A rule's expression runs only where its keyword
occurs.  Overlapping detections are resolved in the order of the rules: one that
lies within the interval of a kept detection of an earlier rule is suppressed,
unless it is one of the base phrases, which are always reported.

Null and empty texts have no words and no detections, score 0.  Ties between
detections of one rule go by position; repeated rows are scanned alike; an empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.batches import Texts, with_struct
from threatloom.llm.license_rules import Rule, rules

# fixed values: bytes of words, A-Z folded
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
DETECTION = "rule:string,label:string,first_word:bigint,last_word:bigint,score:double,base:boolean"
FIELDS = f"n_words bigint, detections array<struct<{DETECTION}>>"


def license_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Scanner:
    """The rules, grouped by keyword."""

    def __init__(self, known: list[Rule]) -> None:
        self.by_keyword: dict[bytes, list[Rule]] = defaultdict(list)
        for rule in known:
            self.by_keyword[rule.keyword].append(rule)

    def detect(self, words: list[bytes]) -> list[tuple[Rule, int, int]]:
        """(rule, first word, last word) of all detections that stand, by position."""
        line = b" " + b" ".join(words) + b" "
        found = []
        for keyword, group in self.by_keyword.items():
            if keyword in line:
                for rule in group:
                    for match in rule.pattern.finditer(line):
                        first = line.count(b" ", 0, match.start() + 1) - 1
                        found.append((rule, first, first + match.group().count(b" ") - 1))
        return resolved(found)


def resolved(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Detections that no kept detection of an earlier rule contains."""
    kept: list[tuple[Rule, int, int]] = []
    # widest kept intervals; none contains another, so their ends ascend with their starts
    firsts: list[int] = []
    lasts: list[int] = []
    for rule, first, last in sorted(found, key=lambda d: (d[0].priority, d[1])):
        at = bisect_right(firsts, first)
        contained = at > 0 and lasts[at - 1] >= last
        if rule.base or not contained:
            kept.append((rule, first, last))
        if not contained:
            low, high = bisect_left(firsts, first), bisect_right(lasts, last)
            firsts[low : max(low, high)] = [first]
            lasts[low : max(low, high)] = [last]
    return sorted(kept, key=lambda d: (d[1], d[0].priority))


def scan_licenses(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """Columns ``keep`` and a struct (n_words, detections); the name of that column."""

    def make():
        scanner = Scanner(rules())

        def scan(texts: Texts) -> list:
            sizes, detections = [], []
            for text in texts:
                words = license_words(text)
                sizes.append(len(words))
                names = ("rule", "label", "first_word", "last_word", "score", "base")
                detections.append(
                    [dict(zip(names, (r.name, r.label, a, b, r.score, r.base), strict=True)) for r, a, b in scanner.detect(words)]
                )
            return [sizes, detections]

        return scan

    return with_struct(docs, "text", FIELDS, make, keep)


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels of base and method, and how sure the surest detection is."""
    found, name = scan_licenses(docs, ["doc_id"])
    places = F.filter(f"{name}.detections", lambda d: d["base"])
    starts = F.transform(places, lambda d: d["first_word"])

    def joined(detections: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")

    return found.select(
        "doc_id",
        f"{name}.n_words",
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(places).alias("base_labels"),
        joined(F.col(f"{name}.detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform(f"{name}.detections", lambda d: d["score"])), F.lit(0.0)).alias("score"),
    )
