"""Line dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, clashing, documents, kept_lines, prose
from threatloom.llm import line_dedup as L


def digests(docs, params):
    rows = L.cleaned_digests(docs, L.keep_bitmaps(docs, params)).collect()
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows}


@pytest.mark.parametrize("keep_first", [False, True])
def test_against_brute_force(spark, keep_first):
    pool = [" ".join(prose(i, 4)) for i in range(40)] + ["", "  ", "\u00e9", "X", "x "]
    texts = {}
    for i in range(120):
        r = np.random.RandomState(i)
        texts[i] = "\n".join(pool[j] for j in r.randint(0, len(pool), r.randint(0, 12)))
    params = L.LineParams(min_docs=10, keep_first=keep_first)
    assert digests(documents(spark, list(texts.items())), params) == kept_lines(texts, 10, keep_first)


def test_one_line_holds_a_third_of_all(spark):
    """The hot line is spread over several partitions, and still decided as one."""
    texts = {i: "\n".join(["hot", f"own {i}", "hot", f"pair {i // 2}"]) for i in range(400)}
    docs = documents(spark, list(texts.items()))
    params = L.LineParams(min_docs=10, keep_first=True)
    assert digests(docs, params) == kept_lines(texts, 10, True)


def test_a_hot_line_is_decided_from_sums(spark):
    """Its rows stay in the partitions they were dealt to; only sums of each partition are brought together."""
    texts = {i: "\n".join(["hot"] * (1 + i % 3) + [f"own {i}"]) for i in range(600)}
    docs = documents(spark, list(texts.items())).repartition(4)
    gone = L.dropped_lines(docs, L.LineParams())
    assert gone.count() == sum(1 + i % 3 for i in range(600))
    plan = gone._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    sizes = [r[1] for r in gone.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 600


def test_a_document_over_several_partitions_counts_once(spark):
    texts = {0: "\n".join(["hot"] * 5000), **{i: "hot" for i in range(1, 9)}}
    docs = documents(spark, list(texts.items()))
    assert all(gone == 0 for _, gone, _ in digests(docs, L.LineParams()).values())
    texts[9] = "hot"
    docs = documents(spark, list(texts.items()))
    assert digests(docs, L.LineParams(keep_first=True)) == kept_lines(texts, 10, True)


def test_threshold_counts_documents_not_lines(spark):
    texts = {0: "\n".join(["same"] * 30), **{i: "same" for i in range(1, 9)}}
    assert all(gone == 0 for _, gone, _ in digests(documents(spark, list(texts.items())), L.LineParams()).values())
    texts[9] = "SAME\t"
    assert all(gone == lines for lines, gone, _ in digests(documents(spark, list(texts.items())), L.LineParams()).values())


def test_bitmaps():
    for dropped in ([0], [7], [8], [0, 1, 2], [3, 100], list(range(16))):
        keep = L.unpack_bitmap(L.pack_bitmap(dropped), 120)
        assert set(np.flatnonzero(~keep).tolist()) == set(dropped)
    assert L.unpack_bitmap(None, 3).all()


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    bitmaps = L.keep_bitmaps(docs, L.LineParams(min_docs=2))
    rows = L.cleaned_digests(docs, bitmaps).collect()
    assert len(rows) == 10
    # the row of id 1 and the row without id are two documents
    assert sorted(r["n_dropped"] for r in rows) == [0] * 7 + [1] * 3
    kept = L.cleaned_documents(docs, bitmaps)
    assert kept.columns == docs.columns and kept.count() == 7


def test_empty_table(spark):
    docs = documents(spark, []).limit(0)
    assert L.cleaned_digests(docs, L.keep_bitmaps(docs)).count() == 0
    assert L.cleaned_documents(docs, L.keep_bitmaps(docs)).count() == 0


def test_documents_keep_their_columns_and_lengths(spark):
    docs = documents(spark, [f"boiler\nown {i}" for i in range(12)])
    kept = L.cleaned_documents(docs, L.keep_bitmaps(docs, L.LineParams(keep_first=True)))
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows[0]["text"] == "boiler\nown 0" and rows[5]["text"] == "own 5" and rows[5]["n_chars"] == 5
