"""Quality rules: counts of words, symbols and repeats, and a language-model verdict.

The verdict is the log-likelihood ratio of a text's hashed byte n-grams between
two multinomials, one of trusted documents and one of the whole corpus, divided
by the number of n-grams.  A text below the threshold is rejected; the decision
depends on the text and the two models alone.

Null and empty texts have no words: all counts are 0, ``base_failed`` is true.
Repeated rows are judged alike.  Without trusted documents, or over an empty
table, both multinomials are equal, every ratio is 0 and only the base rules
reject.  Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.batches import CONTINUATION, WHITE_SPACE, Texts, byte_texts, with_struct
from threatloom.llm.bloom import Bloom, key_hash, may_hold
from threatloom.session import stored

SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = WHITE_SPACE + CONTINUATION
FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, llr double, kept boolean"
)


@dataclass(frozen=True)
class QualityParams:
    """All documents that the labels call good make the trusted model."""

    buckets: int = 1 << 16
    orders: tuple[int, ...] = (3,)
    smoothing: float = 0.5
    threshold: float = -0.25
    min_words: int = 50
    max_repeat_percent: int = 50


def hashed_ngrams(text: bytes, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """Bucket of every byte n-gram of each order."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    found = []
    for n in orders:
        if len(data) >= n:
            code = np.full(len(data) - n + 1, n, np.uint64)
            for i in range(n):
                code = (code << np.uint64(8)) | data[i : len(data) - n + 1 + i]
            found.append((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40))
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64) if found else np.zeros(0, np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) >= 1 << 21:  # three ids would not fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(index) + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def ngram_counts(docs: DataFrame, trusted: DataFrame, params: QualityParams) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of the trusted ones.

    Each task adds up its own documents and sends one row per bucket.  Trusted
    documents are told where they lie, by a cascade of Bloom filters: the second
    holds the ids that the first lets pass wrongly, the third those of trusted
    ones that the second lets pass, and so on, until none is left.  Only ids are
    joined for that.  If filters are full before, the documents still told wrongly
    are shuffled and counted the other way round, so the counts are exact.
    """
    trusted = trusted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    levels, wrong = _cascade(docs.where(F.col("doc_id").isNotNull()).select("doc_id"), trusted)
    counts = _counted(docs, levels, params)
    if wrong is None:
        return counts
    few = Bloom.of(wrong, "doc_id", seed=len(levels)).split(docs, "doc_id")[0].join(wrong, "doc_id", "left_semi")
    sign = -1 if len(levels) % 2 else 1
    told = _counted(few.select("doc_id", "text"), [], params).select("bucket", F.lit(0).alias("raw"), (sign * F.col("raw")).alias("target"))
    return counts.unionAll(told).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


LEVELS = 6


def _cascade(ids: DataFrame, trusted: DataFrame) -> tuple[list[Bloom], DataFrame | None]:
    """Filters that hold in turn what should pass and what should not, and the ids they still tell wrongly, if any."""
    levels = [Bloom.of(trusted, "doc_id")]
    passed = levels[0].split(ids, "doc_id")[0].distinct()
    inside, outside = trusted, stored(passed.join(trusted, "doc_id", "left_anti"), "wrongly-trusted")
    while not outside.isEmpty():
        if len(levels) == LEVELS:
            return levels, outside
        levels.append(Bloom.of(outside, "doc_id", seed=len(levels)))
        inside, outside = outside, stored(levels[-1].split(inside, "doc_id")[0], "wrongly-told")
    return levels, None


def _counted(docs: DataFrame, levels: list[Bloom], params: QualityParams) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of those that the filters tell as trusted."""
    sent = docs.sparkSession.sparkContext.broadcast([level.words for level in levels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(params.buckets, np.int64)
        target = np.zeros(params.buckets, np.int64)
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            passing = np.ones(batch.num_rows, bool)
            for level, words in enumerate(sent.value):
                hashes = batch.column(1 + level)
                passing &= may_hold(words, hashes.fill_null(0).to_numpy()) & hashes.is_valid().to_numpy(zero_copy_only=False)
                good = np.where(passing, level % 2 == 0, good)
            for text, trusted in zip(byte_texts(batch.column(0)), good.tolist(), strict=True):
                counts = np.bincount(hashed_ngrams(text, params.orders, params.buckets), minlength=1)
                raw[: len(counts)] += counts
                if trusted:
                    target[: len(counts)] += counts
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"]
        )

    hashes = [key_hash("doc_id", seed=level.seed).alias(f"h{n}") for n, level in enumerate(levels)]
    rows = docs.select(F.col("text").cast("string").alias("text"), *hashes)
    partial = rows.mapInArrow(run, "bucket bigint, raw bigint, target bigint")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, params: QualityParams) -> np.ndarray:
    """log p(target) - log p(raw) for every bucket; one row per bucket reaches the driver."""
    raw, target = np.zeros(params.buckets), np.zeros(params.buckets)
    for bucket, n, m in counts.collect():
        raw[bucket], target[bucket] = n, m
    if not target.sum():
        return np.zeros(params.buckets)

    def logs(counted: np.ndarray) -> np.ndarray:
        return np.log((counted + params.smoothing) / (counted.sum() + params.smoothing * params.buckets))

    return logs(target) - logs(raw)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents that the labels call good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), keep: list[str] | None = None
) -> tuple[DataFrame, str]:
    """Columns ``keep`` (all by default) and a struct with counts, ratio and verdict.

    Two passes over the texts, and joins of ids.
    """
    counts = ngram_counts(docs.select("doc_id", "text"), trusted_ids(labels), params)
    ratios = log_ratios(counts, params)

    def judge(texts: Texts) -> list:
        rows = []
        for text in texts:
            n_words, word_chars, n_symbols, n_dup_lines, n_repeat = base_counts(text)
            failed = n_words < params.min_words or 100 * n_repeat > params.max_repeat_percent * n_words
            grams = hashed_ngrams(text, params.orders, params.buckets)
            llr = float(ratios[grams].mean()) if len(grams) else 0.0
            kept = not failed and llr >= params.threshold
            rows.append((n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, llr, kept))
        return list(zip(*rows, strict=True)) if rows else [[]] * 8

    return with_struct(docs, "text", FIELDS, lambda: judge, docs.columns if keep is None else keep)
