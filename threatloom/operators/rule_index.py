"""User-added language rules in any number: a table behind an inverted index of opening words.

Tokens are those of one ordered alternation of all rules, read from left to
right: at each word the first rule that matches there wins, and reading goes on
behind its match.  No such alternation is ever built.  A rule is filed under the
words it can begin with, and only rules whose word occurs in a text are tried:

* A list rule, ``\\b(a|b|c)\\b`` of plain words, matches one word whatever stands
  around it.  The first list rule of every distinct word is found once for all
  texts, by a partial minimum.
* Any other rule is tried where one of its opening words stands, if no list rule
  comes before it there, with the whole text as context.  Rules whose openings
  cannot be read from the pattern are tried at every word.

Rules stay a table throughout; nothing is compiled into the plan.  Patterns must
begin with ``\\b``; others could match within a word and raise an error, as do
unsafe patterns and unknown categories.  Rules are ordered by category, position,
then pattern.  Null texts have no words, an empty rule table no matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.patterns import WORD
from threatloom.functions.text import text
from threatloom.operators.language import CATEGORIES
from threatloom.operators.rules import audit

# patterns about patterns: a list of plain words, and a list of words that something follows
_LIST = r"^\\b(?:\((?:\?:)?([\p{L}\p{N}_]+(?:\|[\p{L}\p{N}_]+)*)\)|([\p{L}\p{N}_]+))\\b$"
_OPENING = r"^\\b(?:\((?:\?:)?([\p{L}\p{N}_]+(?:\|[\p{L}\p{N}_]+)*)\)|([\p{L}\p{N}_]+))(?:\\s\+|\\s(?![*?{])|\\b)"
_ANYWHERE = ""
# one word may make up any share of all words: its places are dealt over this many keys
_DEALT = 32
MATCHES = "array<struct<category:string,description:string,token:string>>"


def ranked_rules(rules: DataFrame) -> DataFrame:
    """(rank, category, description, regex, words, is_list) of a rule table, after an audit.

    ``rank`` orders rules like the catalogue; ``words`` are the openings, one empty text if unknown.
    """
    category = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    checked = audit(rules)
    bad = (
        F.when(~F.col("accepted"), F.concat(F.lit("pattern may backtrack without bound: "), "pattern"))
        .when(F.coalesce(category, F.lit(0)) == 0, F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("null"))))
        .when(~F.startswith("pattern", F.lit(r"\b")), F.concat(F.lit("pattern does not begin at a word: "), "pattern"))
    )

    def words(regex: str) -> Column:
        one, two = F.regexp_extract("pattern", regex, 1), F.regexp_extract("pattern", regex, 2)
        return F.split(F.lower(F.concat(one, two)), r"\|")

    is_list = F.col("pattern").rlike(_LIST)
    opening = F.when(is_list, words(_LIST)).when(F.col("pattern").rlike(_OPENING), words(_OPENING)).otherwise(F.array(F.lit(_ANYWHERE)))
    edge = F.lit(rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))")
    # the dialect of the catalogue, see functions.patterns
    regex = F.replace("pattern", F.lit(r"\b"), edge)
    regex = F.replace(F.replace(regex, F.lit(r"[\w"), F.lit(r"[\p{L}\p{N}_")), F.lit(r"\w"), F.lit(WORD))
    return checked.select(
        F.struct(category.alias("category"), "position", "pattern").alias("rank"),
        # raised where the rule is used, not on the driver
        F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("category")).alias("category"),
        "description",
        regex.alias("regex"),
        opening.alias("words"),
        is_list.alias("is_list"),
    )


def _first_lists(rules: DataFrame, words: DataFrame) -> DataFrame:
    """(word, list_rule): the first list rule of each word that occurs."""
    filed = rules.where("is_list").select("rank", "category", "description", F.explode("words").alias("word"))
    used = filed.join(words.select("word").distinct(), "word", "left_semi")
    return used.groupBy("word").agg(F.min(F.struct("rank", "category", "description")).alias("list_rule"))


def _at_places(placed: DataFrame, lists: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Places with the list rule of their word, of which there is one row: every key a word is dealt over gets a copy."""
    copies = lists.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1))))
    dealt = placed.withColumn("_deal", F.pmod(F.xxhash64(*keys, "part", "at"), F.lit(_DEALT)).cast("int"))
    return dealt.join(copies, ["word", "_deal"], how).drop("_deal")


def _other_matches(rules: DataFrame, placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, part, at, rank, category, description, token, words) of rules that are no lists."""
    filed = rules.where("NOT is_list").select("rank", "category", "description", "regex", F.explode("words").alias("word"))
    known = filed.where(F.col("word") != _ANYWHERE)
    here = placed.select(*keys, "part", "at", "word", "list_rule", "text")
    tried = here.join(known, "word")
    others = filed.where(F.col("word") == _ANYWHERE).drop("word")
    # few by their nature, since each is tried at every word: a rule without a readable opening; places stay where they are
    everywhere = here.crossJoin(F.broadcast(others))
    tried = tried.unionByName(everywhere).where(F.col("list_rule").isNull() | (F.col("rank") < F.col("list_rule.rank")))
    gap = rf"(?:(?!{WORD})[\s\S])*+"
    ahead = F.concat(F.lit(rf"(?U)\A{gap}(?:{WORD}++{gap}){{"), F.col("at").cast("string"), F.lit("}("), "regex", F.lit(")"))
    found = tried.withColumn("token", F.call_function("regexp_extract", F.col("text"), ahead, F.lit(1))).where("token <> ''")
    spans = F.size(F.regexp_extract_all("token", F.lit(f"{WORD}+"), F.lit(0)))
    return found.select(*keys, "part", "at", "rank", "category", "description", "token", spans.alias("words"))


def scan_with_rules(df: DataFrame, rules: DataFrame, keys: Sequence[str], parts: Sequence[str] = ("subject", "body_text")) -> DataFrame:
    """(keys, matches): tokens of the parts in order, with the rule of each; rows without any are left out.

    ``keys`` tell the rows of ``df`` apart.
    """
    ranked = ranked_rules(rules)
    texts = F.array(*[F.struct(F.lit(i).alias("part"), F.lower(text(F.col(p))).alias("text")) for i, p in enumerate(parts)])
    cut = df.select(*keys, F.explode(texts).alias("t")).select(*keys, "t.*")
    placed = cut.select(*keys, "part", "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0))).alias("at", "word"))
    lists = _first_lists(ranked, placed)
    single = _at_places(placed.drop("text"), lists, keys, "inner").select(
        *keys, "part", "at", "list_rule.rank", "list_rule.category", "list_rule.description", F.col("word").alias("token"), F.lit(1).alias("words")
    )
    other = _other_matches(ranked, _at_places(placed, lists, keys, "left"), keys)
    order = Window.partitionBy(*keys, "part", "at").orderBy("rank")
    won = single.unionByName(other).withColumn("place", F.row_number().over(order)).where("place = 1")
    option = F.struct("part", "at", "words", "category", "description", "token")
    found = won.groupBy(*keys).agg(F.array_sort(F.collect_list(option)).alias("found"), F.max("words").alias("longest"))
    return found.select(*keys, F.when(F.col("longest") == 1, F.col("found")).otherwise(_without_overlaps("found")).alias("found")).select(
        *keys, F.transform("found", lambda m: F.struct(m["category"], m["description"], m["token"])).cast(MATCHES).alias("matches")
    )


def _without_overlaps(found: str) -> Column:
    """Matches from left to right, each behind the end of the one before."""
    start = F.struct(
        F.lit(-1).alias("part"), F.lit(0).alias("end"), F.filter(found, lambda m: F.lit(False)).alias("kept")
    )

    def step(state: Column, m: Column) -> Column:
        free = (m["part"] != state["part"]) | (m["at"] >= state["end"])
        return F.when(
            free,
            F.struct(m["part"].alias("part"), (m["at"] + m["words"]).alias("end"), F.concat(state["kept"], F.array(m)).alias("kept")),
        ).otherwise(state)

    return F.aggregate(found, start, step, lambda state: state["kept"])
