"""The similarity join against all pairs."""

import numpy as np
import pytest

from tests.llm.helpers import awkward, clashing, components, documents, edited, prose
from threatloom.llm import jaccard_join as J
from threatloom.llm.components import component_labels


def found(docs, params):
    return {r["doc_id"]: r["component_id"] for r in J.join_components(docs, params).collect()}


def family(seed, copies, n, edits):
    base = prose(seed, n)
    return [" ".join(edited(base, seed * 1000 + i, i % (edits + 1))) for i in range(copies)]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_against_all_pairs(spark, words, percent):
    texts = [t for s, n in enumerate([3, 6, 9, 20, 45, 80, 150, 400]) for t in family(s, 12, n, 4)]
    texts += ["", "one", "One", "one two three four five"] * 2
    expected = components(dict(enumerate(texts)), words, percent)
    assert found(documents(spark, texts), J.JoinParams(words=words, percent=percent)) == expected


def test_large_group_of_near_copies(spark):
    """Members are compared by their differences from the centre; chains of links still end in one component."""
    base, texts = prose(7, 120, 10_000), []
    for i in range(90):
        changed = list(base)
        for k in range(6):
            changed[(i * 2 + k) % 120] = f"c{i}_{k}"
        texts.append(" ".join(changed))
    params = J.JoinParams(words=3, percent=80, large=8)
    assert found(documents(spark, texts), params) == components(dict(enumerate(texts)), 3, 80)


def test_every_linking_pair_shares_a_signature():
    r = np.random.RandomState(5)
    for percent in (60, 80, 85, 95):
        params = J.JoinParams(percent=percent)
        for size in (5, 9, 17, 40, 64, 65, 100, 300, 1200):
            for _ in range(12):
                a = r.randint(0, 2**63, size, dtype=np.int64).astype(np.uint64)
                most = (100 - percent) * size // 100
                gone = r.randint(0, most + 1)
                new = r.randint(0, most + 1)
                b = np.concatenate([a[gone:], r.randint(0, 2**63, new, dtype=np.int64).astype(np.uint64)])
                a, b = np.unique(a), np.unique(b)
                shared = len(np.intersect1d(a, b))
                if 100 * shared < percent * (len(a) + len(b) - shared) or (len(a) == len(b) == shared):
                    continue
                marks = [np.concatenate([J.signatures(s, c) for c in J.instances(len(s), params)]) for s in (a, b)]
                assert len(np.intersect1d(*marks)), (percent, size)
                counts = [J.bucket_counts(s)[None] for s in (a, b)]
                sizes = [np.array([len(s)]) for s in (a, b)]
                assert J.may_link(*sizes, *counts, percent).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(70, 60), (60, 80), (90, 90)], "a bigint, b bigint")
    labels = dict(component_labels(links).collect())
    assert labels == {**{i: 0 for i in range(51)}, 60: 60, 70: 60, 80: 60}


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    rows = J.join_components(docs, J.JoinParams()).collect()
    assert len(rows) == 10
    assert sorted((r["doc_id"], r["n_shingles"]) for r in rows if r["doc_id"] in (2, 3, 4)) == [(2, 0), (3, 0), (4, 0)]
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {1, None}
    kept = J.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6]


def test_empty_table(spark):
    docs = documents(spark, []).limit(0)
    assert J.join_components(docs).count() == 0
    assert J.without_near_duplicates(docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_clusters_of_every_kind_of_edit(spark, seed):
    """Shared, own, inserted and deleted words, and families within the family."""
    r = np.random.RandomState(seed)
    base, texts = prose(seed + 40, 90, 10_000), []
    sides = [edited(base, 500 + k, 3) for k in range(4)]
    for i in range(70):
        tokens = list(sides[r.randint(4)] if r.rand() < 0.6 else base)
        for _ in range(r.randint(0, 5)):
            at = r.randint(len(tokens))
            kind = r.randint(4)
            if kind == 0:
                tokens[at] = f"own{i}_{r.randint(9)}"
            elif kind == 1:
                tokens.insert(at, f"new{r.randint(3)}")
            elif kind == 2:
                del tokens[at : at + r.randint(1, 6)]
            else:
                tokens[r.randint(5) * 9] = f"common{r.randint(2)}"
        texts.append(" ".join(tokens))
    expected = components(dict(enumerate(texts)), 3, 80)
    for large in (3, 20):
        assert found(documents(spark, texts), J.JoinParams(words=3, percent=80, large=large)) == expected
