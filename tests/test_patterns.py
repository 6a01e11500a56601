"""The JVM patterns against the catalogue's own dialect, on random texts."""

import random
import re

from pyspark.sql import functions as F

from threatloom.functions import constants as K
from threatloom.functions.patterns import any_of, leading_texts, unicode_regex
from threatloom.operators import language, spam

RULES = language.builtin_rules()


def random_texts(n: int) -> list[str]:
    rng = random.Random(7)
    words = (
        "verify your account password urgent within 24 hours days expire expires expired act now don't delay limited"
        " time last chance bank certified free winner secret department of time-sensitive security alert update click"
        " here nigerian prince viagra pills éwin naïve ñfree ²free free² x_free free_ ＦＲＥＥ ЖBANK bank१"
    ).split(" ")
    seps = [" ", "  ", "\n", "\t", ".", ", ", "-", "", "_", "é", " ", "́"]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_scan_attributes_every_token_like_named_groups(spark):
    texts = random_texts(3000)
    master = re.compile("|".join(f"(?P<g{i}>{r.pattern})" for i, r in enumerate(RULES)))
    wanted = {}
    for i, t in enumerate(texts):
        found = [(m.group(), int(m.lastgroup[1:])) for m in master.finditer(t.lower())]
        wanted[i] = [(RULES[g].category, RULES[g].description, token) for token, g in found]
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id int, subject string, body_text string")
    got = {r.id: [tuple(m) for m in r.matches] for r in language.pattern_scan(rows).collect()}
    assert sum(map(len, wanted.values())) > 5000
    assert got == wanted


def test_keyword_counts_and_groups(spark):
    texts = random_texts(2000)
    combined = re.compile("|".join(f"(?:{p})" for p in K.SPAM_KEYWORD_GROUPS))
    rows = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(texts)], "id int, t string")
    got = rows.select("id", spam.keyword_count(F.col("t")).alias("n"), spam.keyword_groups(F.col("t")).alias("g"))
    for r in got.collect():
        low = texts[r.id].lower()
        assert r.n == len(combined.findall(low))
        seen = []
        for m in combined.finditer(low):
            group = next(p for p in K.SPAM_KEYWORD_GROUPS if re.fullmatch(p, m.group()))
            if group not in seen:
                seen.append(group)
        assert r.g == seen


def test_gate_never_changes_what_matches(spark):
    patterns = [r.pattern for r in RULES]
    assert leading_texts(patterns)
    rows = spark.createDataFrame([(t.lower(),) for t in random_texts(2000)], "t string")
    with_gate, without = (
        F.regexp_extract_all("t", F.lit(any_of(patterns, gate=g)), F.lit(0)) for g in (True, False)
    )
    assert rows.filter(with_gate != without).count() == 0


def test_patterns_without_edges_still_work(spark):
    custom = [r"\bfoo", r"ba[rz]+", r"\d{2}\b"]
    expected = re.compile("|".join(f"(?:{p})" for p in custom))
    texts = ["foo bar", "xfoo", "éfoo", "foox 12", "123", "12é", "bazz-foo_1 99"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", F.regexp_extract_all("t", F.lit(any_of(custom)), F.lit(0)).alias("m")).collect()
    for r in got:
        assert r.m == expected.findall(r.t), r.t


def test_address_tokens(spark):
    texts = ["a@b.c", "x <jürgen@exämple.de>", "@x", "a@", "n½@h.example", "áb@c.d"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", F.regexp_extract("t", unicode_regex(K.ADDRESS_PATTERN), 0).alias("m")).collect()
    for r in got:
        m = re.search(K.ADDRESS_PATTERN, r.t)
        assert r.m == (m.group() if m else ""), r.t


def test_grouping_by_first_seen(spark):
    rng = random.Random(3)
    lists = [[rng.choice("abcdef") for _ in range(rng.randint(1, 40))] for _ in range(200)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, x array<string>")
    for r in rows.select("id", "x", spam.grouped_by_first_seen(F.col("x")).alias("g")).collect():
        assert r.g == [u for u in dict.fromkeys(r.x) for _ in range(r.x.count(u))]
