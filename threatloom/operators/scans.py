"""What is taken from the mailboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.params import DEFAULTS, Params

MAILBOX_KEY = ["account_email", "folder", "message_id"]


def unseen(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """Messages whose key is not among the processed ones."""
    return messages.join(processed.select(*MAILBOX_KEY), MAILBOX_KEY, "left_anti")


def first_per_folder(messages: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The first messages of each folder, in mailbox order; adds ``rank``.

    Ranks past the limit are cut on the map side, so a folder that holds a
    large share of all mail sends only the limit per map task.
    """
    order = Window.partitionBy("account_email", "folder").orderBy("seq", "message_id")
    return messages.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= params.max_per_folder)


def within_size(messages: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Messages small enough to be fetched."""
    return messages.filter(F.col("size") <= params.max_message_bytes)


def of_active_accounts(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Messages of accounts that are enabled and connected."""
    active = accounts.filter(F.col("enabled") & F.col("connected")).select("account_email")
    return messages.join(active, "account_email", "left_semi")


def fetch(messages: DataFrame, processed: DataFrame, accounts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One fetch cycle: active accounts, unseen, first per folder, then the size guard.

    The choice is made on keys and sizes alone.  Bodies are read only by the
    last join, whose other side is small: a few messages per folder.
    """
    keys = messages.select(*MAILBOX_KEY, "seq", "size")
    waiting = unseen(of_active_accounts(keys, accounts), processed)
    chosen = within_size(first_per_folder(waiting, params), params).select(*MAILBOX_KEY)
    return messages.join(chosen, MAILBOX_KEY, "left_semi")
