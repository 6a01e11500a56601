"""From three layer results to one report, its routing and its displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions import constants as K
from threatloom.functions.risk import worst_risk
from threatloom.operators.attachments import media_layer
from threatloom.operators.language import language_layer
from threatloom.operators.scans import MAILBOX_KEY
from threatloom.operators.spam import spam_layer
from threatloom.params import DEFAULTS, Params


def recommendations(spam: Column, nlp: Column, media: Column) -> Column:
    """Advice lines in fixed order; one default line when nothing applies."""
    advice = F.array_remove(
        F.array(
            *[
                F.when(flag, F.lit(line)).otherwise(F.lit(""))
                for flag, line in (
                    (spam["risk_level"] == "high", K.REC_SPAM),
                    (F.size(nlp["social_engineering_indicators"]) > 0, K.REC_PHISHING),
                    (F.size(media["file_type_warnings"]) > 0, K.REC_ATTACHMENT),
                    (F.size(spam["suspicious_urls"]) > 0, K.REC_URLS),
                    (F.size(nlp["authority_impersonation"]) > 0, K.REC_AUTHORITY),
                    (F.size(nlp["urgency_markers"]) > 0, K.REC_URGENCY),
                )
            ]
        ),
        "",
    )
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(K.REC_CLEAN)))


def assemble_report(scored: DataFrame, report_time: Column | None = None) -> DataFrame:
    """Report rows from messages that carry ``spam``, ``nlp`` and ``media``."""
    spam, nlp, media = F.col("spam"), F.col("nlp"), F.col("media")
    columns = [
        *MAILBOX_KEY,
        "subject",
        "sender",
        "recipient",
        "date",
        (spam["score"] + nlp["score"] + media["score"]).alias("overall_threat_score"),
        worst_risk(spam["risk_level"], nlp["risk_level"], media["risk_level"]).alias("risk_level"),
        spam,
        nlp,
        media,
        recommendations(spam, nlp, media).alias("recommendations"),
    ]
    if report_time is not None:
        columns.append(report_time.alias("timestamp"))
    return scored.select(*columns)


def threat_report(
    emails: DataFrame,
    attachments: DataFrame,
    params: Params = DEFAULTS,
    archives: DataFrame | None = None,
) -> DataFrame:
    """One report per message.

    Both text layers run in the scan stage, so bodies are pruned before the
    only join: what is shuffled per message is its metadata and findings.
    """
    facts = (*MAILBOX_KEY, "subject", "sender", "recipient", "date")
    scored = language_layer(spam_layer(emails, params), params).select(*facts, "spam", "nlp")
    return assemble_report(media_layer(scored, attachments, params, archives))


# --- routing ------------------------------------------------------------------


def needs_alert(params: Params = DEFAULTS) -> Column:
    """Medium or high risk, or a total at or above the alert floor."""
    risky = F.lower(F.coalesce("risk_level", F.lit(""))).isin("medium", "high")
    return risky | (F.col("overall_threat_score") >= params.threat_low)


def alerts(reports: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Reports to be alerted on."""
    return reports.filter(needs_alert(params))


def threat_type(spam: Column, nlp: Column, media: Column) -> Column:
    """The layer with the highest score; ties go to spam, then phishing."""
    top = F.greatest(spam, nlp, media)
    return (
        F.when((top == spam) | (top == 0), "spam").when(top == nlp, "phishing").otherwise("malware")
    )


def detected_threats(reports: DataFrame) -> DataFrame:
    """(mailbox key, threat_type, severity) of medium and high reports."""
    return reports.filter(F.lower("risk_level").isin("medium", "high")).select(
        *MAILBOX_KEY,
        threat_type(F.col("spam.score"), F.col("nlp.score"), F.col("media.score")).alias("threat_type"),
        F.lower("risk_level").alias("severity"),
    )


# --- displays -----------------------------------------------------------------

# fixed values: lines shown per section
DIGEST_LIMITS = {
    "spam.indicators": 5,
    "spam.header_issues": 5,
    "spam.suspicious_urls": 3,
    "nlp.social_engineering_indicators": 3,
    "nlp.urgency_markers": 3,
    "nlp.authority_impersonation": 3,
    "nlp.psychological_triggers": 3,
    "media.file_type_warnings": 3,
    "media.suspicious_attachments": 3,
    "media.size_anomalies": 3,
    "media.potential_deepfakes": 3,
}


def report_digest(reports: DataFrame, limits: dict[str, int] = DIGEST_LIMITS) -> DataFrame:
    """The first lines of every section, as many as ``limits`` gives it."""
    return reports.select(
        *MAILBOX_KEY,
        "risk_level",
        *[F.slice(F.col(path), 1, k).alias(path.split(".")[1]) for path, k in limits.items()],
    )


def alert_meter(score: Column) -> Column:
    """Filled cells, of forty, for a score on the scale 0..100."""
    clamped = F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))
    return F.floor(clamped / 100 * 40).cast("bigint")


def clean_ratio(score: Column, params: Params = DEFAULTS) -> Column:
    """Share of the alert floor a clean message uses up, at most 1."""
    floor = params.threat_low if params.threat_low > 0 else 30.0
    return F.least(F.greatest(score, F.lit(0.0)) / F.lit(float(floor)), F.lit(1.0))


def clean_bar(ratio: Column) -> Column:
    """Ten cells."""
    filled = F.floor(ratio * 10).cast("int")
    return F.concat(F.repeat(F.lit("■"), filled), F.repeat(F.lit("·"), F.lit(10) - filled))


def recommendation_class(line: Column) -> Column:
    """``RED``, ``YELLOW`` or ``GREEN``."""
    loud = F.upper(line)
    return F.when(loud.rlike(K.REC_RED_PATTERN), "RED").when(loud.rlike(K.REC_YELLOW_PATTERN), "YELLOW").otherwise("GREEN")


def bare_recommendation(line: Column) -> Column:
    """Advice without its leading symbols, however many there are."""
    return F.regexp_replace(line, r"\A(?:" + "|".join(K.REC_PREFIXES) + ")+", "")
