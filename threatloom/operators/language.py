"""Layer 2: social-engineering language, as narrow projections.

One ordered alternation of all patterns is run over each text.  A token belongs
to the first pattern that matches it entirely; since every pattern starts and
ends at a word boundary, that is the alternative that won in the scan.  Tokens
of one category therefore never count for another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions import constants as K
from threatloom.functions.identity import sender_domain
from threatloom.functions.patterns import any_of, whole
from threatloom.functions.risk import risk_bucket
from threatloom.functions.text import at_most, count_of, let, text
from threatloom.params import DEFAULTS, Params
from threatloom.session import stored

CATEGORIES = ("SE", "UG", "AU", "PS")


@dataclass(frozen=True)
class Rule:
    """One language pattern."""

    category: str
    pattern: str
    description: str


def builtin_rules() -> list[Rule]:
    """The catalogue, in scan order."""
    lists = (K.SOCIAL_PATTERNS, K.URGENCY_PATTERNS, K.AUTHORITY_PATTERNS, K.PSYCHOLOGICAL_PATTERNS)
    return [Rule(c, p, d) for c, pairs in zip(CATEGORIES, lists, strict=True) for p, d in pairs]


def _tokens(part: Column, rules: list[Rule]) -> Column:
    """Matching tokens of one text, in text order."""
    return F.regexp_extract_all(F.lower(text(part)), F.lit(any_of([r.pattern for r in rules])), F.lit(0))


def pattern_scan(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``matches``: tokens of the subject, then of the body, with their rules.

    Each is a struct of category, description and token.
    """
    rules = rules or builtin_rules()

    def rule_number(token: Column) -> Column:
        out = F.when(token.rlike(whole(rules[0].pattern)), F.lit(0))
        for number, rule in enumerate(rules[1:], start=1):
            out = out.when(token.rlike(whole(rule.pattern)), F.lit(number))
        return out

    categories = F.split(F.lit("\n".join(r.category for r in rules)), "\n")
    descriptions = F.split(F.lit("\n".join(r.description for r in rules)), "\n")

    def describe(token: Column) -> Column:
        return let(
            rule_number(token),
            lambda number: F.struct(
                F.get(categories, number).alias("category"),
                F.get(descriptions, number).alias("description"),
                token.alias("token"),
            ),
        )

    # classified in a projection of its own: most messages have no token at all
    found = F.concat(_tokens(F.col("subject"), rules), _tokens(F.col("body_text"), rules))
    return df.withColumn("_tokens", found).withColumn("matches", F.transform("_tokens", describe)).drop("_tokens")


def counters(df: DataFrame) -> DataFrame:
    """Adds ``exclamations`` and ``caps_words`` over subject and body in original case."""
    subject, body = text(F.col("subject")), text(F.col("body_text"))
    # the two texts are separate lines, so counts simply add up
    caps = F.lit(any_of([K.CAPS_WORD_PATTERN]))
    return df.withColumns(
        {
            "exclamations": count_of(subject, "!") + count_of(body, "!"),
            "caps_words": (F.regexp_count(subject, caps) + F.regexp_count(body, caps)).cast("bigint"),
        }
    )


def _of(category: str, matches: Column | str = "matches") -> Column:
    return F.filter(matches, lambda m: m["category"] == category)


def _descriptions(matches: Column) -> Column:
    """Distinct descriptions in first-seen order; a handful per category."""
    return F.array_distinct(F.transform(matches, lambda m: m["description"]))


def _counted_lines(matches: Column) -> Column:
    def line(description: Column) -> Column:
        n = F.size(F.filter(matches, lambda m: m["description"] == description))
        return F.concat(description, F.lit(" ("), n.cast("string"), F.lit(" occurrences)"))

    return F.transform(_descriptions(matches), line)


def _weighted(df: DataFrame, category: str, weight: float, name: str) -> DataFrame:
    own = f"_{name}"
    return (
        df.withColumn(own, _of(category))
        .withColumns(
            {f"{name}_score": F.size(own) * F.lit(weight), f"{name}_indicators": _counted_lines(F.col(own))}
        )
        .drop(own)
    )


def social_checks(df: DataFrame) -> DataFrame:
    """Adds ``social_score``, ``social_indicators``; needs ``matches``."""
    return _weighted(df, "SE", 2.0, "social")


def psychological_checks(df: DataFrame) -> DataFrame:
    """Adds ``psych_score``, ``psych_indicators``; needs ``matches``."""
    return _weighted(df, "PS", 1.0, "psych")


def urgency_checks(df: DataFrame) -> DataFrame:
    """Adds ``urgency_score``, ``urgency_indicators``; needs ``matches`` and the counters."""
    out = _weighted(df, "UG", 1.5, "urgency")
    bangs, caps = F.col("exclamations"), F.col("caps_words")
    many_bangs, many_caps = bangs > 2, caps > 3
    extra = F.array_remove(
        F.array(
            F.when(many_bangs, F.concat(F.lit("Excessive exclamation marks ("), bangs, F.lit(")"))).otherwise(""),
            F.when(many_caps, F.concat(F.lit("Excessive caps words ("), caps, F.lit(")"))).otherwise(""),
        ),
        "",
    )
    zero = F.lit(0.0)
    return out.withColumns(
        {
            "urgency_score": F.col("urgency_score")
            + F.when(many_bangs, bangs * F.lit(0.5)).otherwise(zero)
            + F.when(many_caps, caps * F.lit(0.3)).otherwise(zero),
            "urgency_indicators": F.concat("urgency_indicators", extra),
        }
    )


def authority_checks(df: DataFrame) -> DataFrame:
    """Adds ``authority_score``, ``authority_indicators``; needs ``matches``.

    All tokens of a description count double-and-more when one of them does not
    occur in the sender's domain, or when there is no domain.
    """
    staged = df.withColumns({"_au": _of("AU"), "_domain": sender_domain(F.col("sender"))})

    def per_description(description: Column) -> Column:
        own = F.filter("_au", lambda m: m["description"] == description)
        stray = F.exists(own, lambda m: ~F.contains(F.col("_domain"), m["token"]))
        mismatch = (F.col("_domain") == "") | stray
        return F.struct(
            (F.size(own) * F.when(mismatch, F.lit(2.5)).otherwise(F.lit(0.5))).alias("score"),
            F.when(mismatch, F.concat(description, F.lit(" (domain mismatch)")))
            .otherwise(description)
            .alias("line"),
        )

    staged = staged.withColumn("_by", F.transform(_descriptions(F.col("_au")), per_description))
    return staged.withColumns(
        {
            "authority_score": F.aggregate("_by", F.lit(0.0), lambda a, x: a + x["score"]),
            "authority_indicators": F.transform("_by", lambda x: x["line"]),
        }
    ).drop("_au", "_domain", "_by")


# --- text model slot ----------------------------------------------------------


def model_text(subject: Column, body: Column, params: Params = DEFAULTS) -> Column:
    """Text handed to a classifier: subject, blank, body, cut to the model's limit if it has one."""
    return at_most(F.concat(text(subject), F.lit(" "), text(body)), params.max_model_chars)


# a text with more than one row in this many is sent to all tasks
HOT_SHARE = 1000


def score_distinct_texts(
    df: DataFrame, classify: Callable[[Column], Column], params: Params = DEFAULTS
) -> DataFrame:
    """Adds ``probability``: ``classify`` runs once per distinct model text.

    Only a 256-bit key is shuffled with the rows; texts are reduced to one per
    key, partially on the map side, before the (expensive) classifier sees them.
    One text may make up any share of the rows.  Texts with more than a
    thousandth of them, of which there are less than a thousand, are sent to all
    tasks; their rows then carry a key of their own and match nothing in the
    join that brings the others their scores, so no key is hot there.
    """
    keyed = df.withColumn("_text", model_text(F.col("subject"), F.col("body_text"), params)).withColumn(
        "text_key", F.sha2(F.col("_text"), 256)
    )
    distinct = keyed.groupBy("text_key").agg(F.any_value("_text").alias("_text"), F.count(F.lit(1)).alias("_n"))
    scored = stored(distinct.select("text_key", classify(F.col("_text")).alias("probability"), "_n"), "text-scores")
    total = scored.agg(F.sum("_n")).scalar()
    common = F.col("_n") * HOT_SHARE > total
    hot = scored.where(common).select("text_key", F.col("probability").alias("_hot"), F.lit(True).alias("_is_hot"))
    marked = keyed.drop("_text").join(F.broadcast(hot), "text_key", "left")
    # unequal to any key, and different for each row
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    marked = marked.withColumn("_key", F.when(F.col("_is_hot"), alone).otherwise(F.col("text_key")))
    cold = scored.select(F.col("text_key").alias("_key"), F.col("probability").alias("_cold"))
    joined = marked.join(cold, "_key", "left")
    return joined.withColumn("probability", F.coalesce("_hot", "_cold")).drop("_hot", "_is_hot", "_key", "_cold")


def model_score(probability: Column) -> Column:
    """0.5..1 maps to 0..10 points; everything else to none."""
    points = (probability - F.lit(0.5)) * F.lit(20.0)
    return F.when(probability > 0.5, points).otherwise(F.lit(0.0))


def model_indicator(probability: Column) -> Column:
    """Line for a probability above one half, else empty."""
    shown = F.format_string("%.2f", probability)
    line = F.concat(F.lit("ML Model detected high threat probability: "), shown)
    return F.when(probability > 0.5, line).otherwise(F.lit(""))


# --- layer --------------------------------------------------------------------


def language_layer(
    emails: DataFrame,
    params: Params = DEFAULTS,
    rules: list[Rule] | None = None,
    classify: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Adds ``nlp``: score, risk level and the four lists of findings.

    ``classify`` maps the model-text column to a probability column, typically
    a pandas UDF around a text model; without it no model runs.
    """
    kept = emails.columns
    staged = counters(pattern_scan(emails, rules))
    none = F.array().cast("array<string>")
    lists = {"social": none, "urgency": none, "authority": none, "psych": none}
    score = F.lit(0.0)
    for wanted, name, check in (
        (params.check_social, "social", social_checks),
        (params.check_urgency, "urgency", urgency_checks),
        (params.check_authority, "authority", authority_checks),
        (params.check_psychological, "psych", psychological_checks),
    ):
        if wanted:
            staged = check(staged)
            score = score + F.col(f"{name}_score")
            lists[name] = F.col(f"{name}_indicators")
    if classify is not None:
        staged = score_distinct_texts(staged.drop("matches"), classify, params)
        probability = F.coalesce(F.col("probability"), F.lit(0.0))
        score = score + model_score(probability)
        lists["social"] = F.concat(
            lists["social"], F.array_remove(F.array(model_indicator(probability)), "")
        )
    threshold = params.nlp_threshold * 10
    staged = staged.withColumn("_score", score)
    return staged.select(
        *kept,
        F.struct(
            F.col("_score").alias("score"),
            risk_bucket(F.col("_score"), threshold, threshold * 2).alias("risk_level"),
            lists["social"].alias("social_engineering_indicators"),
            lists["urgency"].alias("urgency_markers"),
            lists["authority"].alias("authority_impersonation"),
            lists["psych"].alias("psychological_triggers"),
        ).alias("nlp"),
    )
