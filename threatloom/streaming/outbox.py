"""Delivery of alerts: an outbox with attempts.

Alerts of committed cycles are handed to a channel in passes.  What the channel
does not confirm is tried again later, each time after twice the wait; after the
last attempt it goes to the table of dead letters with the reason.  A pass is
committed as a whole, so a pass that fails is run again.  If it failed after the
channel had sent, alerts are sent twice, so they carry a ``delivery_id`` that
stays the same, by which a receiver can tell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.operators.scans import MAILBOX_KEY
from threatloom.streaming.commits import Commits

_KEY = "account_email string, folder string, message_id string, payload string, delivery_id string"
PENDING = f"{_KEY}, attempts int, due double"
SENT = f"{_KEY}, attempts int, sent_at double"
DEAD = f"{_KEY}, attempts int, reason string"

# gets the alerts that are due, returns (delivery_id, delivered boolean, reason string)
Channel = Callable[[DataFrame], DataFrame]


def deliver(
    cycles: Commits, out: Commits, channel: Channel, now: float, max_attempts: int = 3, wait_seconds: float = 1.0
) -> int:
    """One pass over all alerts that are due; how many were handed to the channel."""
    done, latest = out.last(), cycles.last()
    upto = int(out.note(done) or -1)
    waiting = out.snapshot("pending", PENDING)
    fresh = cycles.read("alerts", "account_email string, folder string, message_id string, payload string", upto, latest)
    ids = F.sha2(F.concat_ws("\n", *MAILBOX_KEY, "payload"), 256)
    fresh = fresh.select(*MAILBOX_KEY, "payload", ids.alias("delivery_id"), F.lit(0).alias("attempts"), F.lit(now).alias("due"))
    # written once: the channel and the outcome must see the same rows
    path = out.write(waiting.unionByName(fresh), "offered")
    offered = out.spark.read.schema(PENDING).parquet(f"{out.root}/{path}")
    due = offered.where(F.col("due") <= now)
    handed = due.count()
    if not handed and upto == latest:
        return 0
    try:
        answer = channel(due).select("delivery_id", "delivered", F.col("reason").cast("string").alias("reason"))
        kept = out.write(answer.dropDuplicates(["delivery_id"]), "answers")
        answer = out.spark.read.parquet(f"{out.root}/{kept}")
    except Exception as error:
        told = F.lit(f"{type(error).__name__}: {error}"[:500])
        answer = due.select("delivery_id", F.lit(False).alias("delivered"), told.alias("reason")).distinct()
    tried = due.join(answer, "delivery_id", "left").withColumn("attempts", F.col("attempts") + 1)
    ok = F.coalesce("delivered", F.lit(False))
    over = F.col("attempts") >= max_attempts
    later = F.lit(now) + F.lit(wait_seconds) * F.pow(F.lit(2.0), F.col("attempts") - 1)
    facts = [*MAILBOX_KEY, "payload", "delivery_id", "attempts"]
    again = tried.where(~ok & ~over).select(*facts, later.alias("due")).unionByName(offered.where(F.col("due") > now))
    tables = {
        "sent": [out.write(tried.where(ok).select(*facts, F.lit(now).alias("sent_at")), "sent")],
        "dead": [out.write(tried.where(~ok & over).select(*facts, F.coalesce("reason", F.lit("not confirmed")).alias("reason")), "dead")],
        "pending": [out.write(again, "pending")],
    }
    out.commit(done + 1, tables, note=str(latest))
    return handed
