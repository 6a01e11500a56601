"""Rules behind an index against one ordered alternation of all of them."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_patterns import random_texts
from threatloom.operators import language, rule_index, rules

COLUMNS = "category string, pattern string, description string, position int"
OWN = [
    ("PS", r"\b(secret|winner)\b", "late list", 9),
    ("SE", r"\b(account|bank|urgent)\b", "early list", 5),
    ("SE", r"\b(verify|confirm)\s+(your\s+)?(account|password)\b", "phrase", 1),
    ("SE", r"\b(account)\s+(password|urgent)\b", "phrase behind a list", 7),
    ("UG", r"\b(act)\s+now\b", "two words", 2),
    ("UG", r"\bact\b", "one word", 3),
    ("UG", r"\b(time[-\s]sensitive|don't\s+delay)\b", "no plain opening", 1),
    ("UG", r"\bdays?\b", "no plain opening", 4),
    ("UG", r"\b(security\s+)(alert|update)\b", "group with a space", 5),
    ("AU", r"\b(free)\s*(winner)?", "may end anywhere", 1),
    ("AU", r"\b(?:éwin|naïve|bank१)\b", "letters", 2),
    ("AU", r"\bdepartment of\b", "plain space", 3),
]


def found(df):
    return {r.id: [tuple(m) for m in r.matches] for r in df.collect() if r.matches}


@pytest.mark.parametrize("own", [OWN, OWN[:2], OWN[3:8]])
def test_same_as_one_alternation(spark, own):
    texts = random_texts(1500)
    rows = [(i, t, texts[-i]) for i, t in enumerate(texts)] + [(5000, None, "act now"), (5001, "", None)]
    df = spark.createDataFrame(rows, "id int, subject string, body_text string")
    table = spark.createDataFrame(own, COLUMNS)
    known = rules.load_rules(table, extend=False)
    wanted = found(language.pattern_scan(df, known))
    got = found(rule_index.scan_with_rules(df, table, ["id"]))
    assert sum(map(len, wanted.values())) > 500
    assert got == wanted


def test_the_built_in_catalogue_as_a_table(spark):
    built_in = [(r.category, r.pattern, r.description, n) for n, r in enumerate(language.builtin_rules())]
    texts = random_texts(800)
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id int, subject string, body_text string")
    got = rule_index.scan_with_rules(df, spark.createDataFrame(built_in, COLUMNS), ["id"])
    assert found(got) == found(language.pattern_scan(df))


def test_many_rules_of_the_same_words(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    own = [("SE UG AU PS".split()[i % 4], rf"\b({'|'.join(r.sample(words, 3))})\b", f"rule {i}", r.randrange(500)) for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(r.choices(words, k=9)), "W1, w2!") for i in range(50)], "id int, subject string, body_text string")
    table = spark.createDataFrame(own, COLUMNS)
    known = rules.load_rules(table, extend=False)
    assert found(rule_index.scan_with_rules(df, table, ["id"])) == found(language.pattern_scan(df, known))


@pytest.mark.parametrize("row", [("SE", r"\b(a+)+\b", "d", 1), ("XX", r"\ba\b", "d", 1), ("SE", "inside", "d", 1)])
def test_bad_rules_are_refused(spark, row):
    df = spark.createDataFrame([(1, "a inside", "")], "id int, subject string, body_text string")
    with pytest.raises(Exception, match="backtrack without bound|unknown category|begin at a word"):
        rule_index.scan_with_rules(df, spark.createDataFrame([row, ("SE", r"\ba\b", "d", 2)], COLUMNS), ["id"]).collect()


def test_no_rules_no_matches(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, subject string, body_text string")
    assert rule_index.scan_with_rules(df, spark.createDataFrame([], COLUMNS), ["id"]).collect() == []


def test_a_common_word_is_looked_up_once(spark):
    df = spark.range(1000).select(F.col("id").cast("int").alias("id"), F.lit("bank").alias("subject"), F.lit("x").alias("body_text"))
    plan = rule_index.scan_with_rules(df, spark.createDataFrame(OWN[:2], COLUMNS), ["id"])
    assert plan.count() == 1000


def test_places_of_one_word_lie_in_many_tasks(spark):
    """One word everywhere: no task of the joins gets most of its places."""
    rows = spark.range(4000).select("id", F.lit("act now").alias("subject"), F.lit("").alias("body_text"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        lists = spark.createDataFrame([("act", 1)], "word string, list_rule int")
        places = rows.select("id", F.lit(0).alias("part"), F.lit(0).alias("at"), F.lit("act").alias("word"))
        dealt = rule_index._at_places(places, lists, ["id"], "inner")
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        plan = rule_index.scan_with_rules(rows, spark.createDataFrame(OWN, COLUMNS), ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 4000
    assert max(sizes) < 2000
    assert "any#" not in plan
    assert "BroadcastNestedLoopJoin" in plan
