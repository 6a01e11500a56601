"""The fitted models: quality and toxicity."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import LABELS, awkward, clashing, documents, prose
from threatloom.llm import quality_gam, toxicity


def fixture(spark, toxic_words=("vile", "rotten")):
    texts, labels = [], []
    for i in range(400):
        r = random.Random(i)
        tokens = prose(i, 120)
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                tokens.insert(r.randrange(len(tokens)), r.choice(toxic_words))
        if bad:
            tokens = [t.upper() + "!!" for t in tokens]
        texts.append((i, " ".join(tokens)))
        labels.append((i, int(not bad), int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, LABELS), labels


def accuracy(rows, truth, divisor, rest):
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % divisor == rest}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])


def test_quality_on_held_out_rows(spark):
    docs, labels, known = fixture(spark)
    rows = quality_gam.quality_report(docs, labels).collect()
    assert len(rows) == 400
    assert accuracy(rows, {i: q for i, q, _ in known}, 3, 1) > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels, known = fixture(spark)
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert accuracy(rows, {i: t for i, _, t in known}, 5, 0) > 0.95
    toxic = next(r for r in rows if r["predicted"] == 1)
    assert toxic["neighbours"] and toxic["terms"]


def test_held_out_labels_are_not_read(spark):
    docs, labels, known = fixture(spark)
    flipped = spark.createDataFrame(
        [
            (i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t)
            for i, q, t in known
        ],
        LABELS,
    )
    for report in (quality_gam.quality_report, toxicity.toxicity_report):
        one, two = ({r["doc_id"]: r["score"] for r in report(docs, x).collect()} for x in (labels, flipped))
        assert one == two


def test_blocks_give_the_exact_neighbours():
    r = np.random.RandomState(4)
    vocabulary = toxicity.Vocabulary([f"t{i:02}" for i in range(30)])
    examples = []
    for n in range(500):
        own = sorted(set(r.randint(0, 30, r.randint(0, 6)).tolist()))
        examples.append((n, int(n % 3 == 0), own, [int(c) for c in r.randint(1, 5, len(own))]))
    idf = r.uniform(1, 5, 30)
    params = toxicity.ToxicityParams(neighbours=7, block=16)
    index = toxicity.Index.of(vocabulary, idf, examples, params)
    matrix = np.zeros((500, 30))
    for n, (_, _, own, counts) in enumerate(examples):
        matrix[n, own] = toxicity.unit(own, counts, idf) if own else 0
    for n, (_, _, own, counts) in enumerate(examples[:150]):
        if own:
            every = matrix @ matrix[n]
            places, cosines = index.nearest(own, counts)
            assert np.allclose(cosines, np.sort(every)[::-1][: len(cosines)])
            assert len(places) == min(7, (every > 0).sum())
            assert n not in index.nearest(own, counts, n)[0]


def test_trees_find_the_best_cut():
    gradient, weight = np.array([1.0, 1, 1, -2, -2, 5]), np.ones(6)
    step = quality_gam.best_step(gradient, weight, 0.0)
    assert step.tolist() == [1, 1, 1, -2, -2, 5]
    grid = np.array([[1.0, 1, -1], [1, 1, -1], [-1, -1, 3]])
    values, gain = quality_gam.best_quadrants(grid, np.ones((3, 3)), 0.0)
    assert np.array_equal(values, grid) and gain > 0


def test_interactions_are_learned():
    r = np.random.RandomState(0)
    rows = r.uniform(size=(3000, len(quality_gam.FEATURES)))
    labels = ((rows[:, 2] > 0.5) ^ (rows[:, 7] > 0.5)).astype(float)
    model = quality_gam.Gam.fit(rows, labels, quality_gam.GamParams())
    assert (2, 7) in model.pairs
    fresh = r.uniform(size=(1000, rows.shape[1]))
    truth = (fresh[:, 2] > 0.5) ^ (fresh[:, 7] > 0.5)
    assert ((model.scores(fresh) >= 0.5) == truth).mean() > 0.95


def test_models_on_awkward_rows(spark):
    docs, none = clashing(awkward(spark)), spark.createDataFrame([], LABELS)
    one_kind = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 1, 1), (5, 1, 0)], LABELS)
    for report in (quality_gam.quality_report, toxicity.toxicity_report):
        for labels in (none, one_kind):
            rows = report(docs, labels).collect()
            assert len(rows) == 10
            assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
        assert report(documents(spark, []).limit(0), one_kind).count() == 0


def test_copies_of_examples_without_telling_terms_are_found(spark):
    """Also where toxic examples are too few for any term to count for more."""
    docs, labels, _ = fixture(spark, toxic_words=("v1",))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:40]
    texts = {r["doc_id"]: r["text"] for r in docs.where(docs.doc_id.isin(ids)).collect()}
    copies = documents(spark, [(1000 + i, texts[i]) for i in ids])
    few = labels.where(labels.doc_id.isin(ids[:12]))
    for known in (labels, few):
        wanted = ids if known is labels else ids[:12]
        rows = {r["doc_id"]: r for r in toxicity.toxicity_report(docs.union(copies), known).collect()}
        assert all(rows[1000 + i]["neighbours"][0] == i and rows[1000 + i]["terms"] for i in wanted)
        assert all(r["neighbours"] for r in rows.values())


def test_cosines_are_of_whole_texts(spark):
    texts = [(i, " ".join(prose(i, 30, 90))) for i in range(60)]
    docs = documents(spark, texts)
    index = toxicity.fit_index(docs, spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)], LABELS))
    having = {}
    for _, text in texts:
        for w in set(text.split()):
            having[w] = having.get(w, 0) + 1

    def vector(text):
        n = {w: text.split().count(w) for w in set(text.split())}
        v = {w: (1 + np.log(c)) * (np.log(61 / (1 + having.get(w, 0))) + 1) for w, c in n.items()}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    query = texts[3][1] + " never seen seen"
    got = index.cosines([index.vocabulary.all_counts(query.encode())])[0]
    q = vector(query)
    wanted = [sum(x * q.get(w, 0) for w, x in vector(dict(texts)[i]).items()) for i in index.ids.tolist()]
    assert np.allclose(got, wanted)


def weighted_index(spark, telling=("v1", "v2")):
    docs, labels, _ = fixture(spark, toxic_words=telling)
    return docs, toxicity.fit_index(docs, labels, toxicity.ToxicityParams(block=8, neighbours=5))


def test_blocks_below_the_bound_are_not_needed(spark, monkeypatch):
    """Neighbours under weighted terms are those of comparing with every example, though not every block is read."""
    docs, index = weighted_index(spark)
    assert (index.idf > 3 * np.log(len(index.ids))).any()  # some terms tell
    texts = [index.vocabulary.all_counts(r["text"].encode()) for r in docs.limit(150).collect()]
    texts += [index.vocabulary.all_counts(t) for t in (b"", b"unheard of", b"v1", b"v1 v1 v2 and v3")]
    shares = []
    best = toxicity.Index._best
    monkeypatch.setattr(toxicity.Index, "_best", lambda self, exact, read: (shares.append(read.mean()), best(self, exact, read))[1])
    for (places, cosines), every in zip(index.nearest_of(texts), index.cosines(texts), strict=True):
        order = np.lexsort((index.rank, -every))
        order = order[every[order] > 0][:5]
        assert places.tolist() == order.tolist()
        assert np.array_equal(cosines, every[order])
    assert np.mean(shares) < 0.9


def test_evidence_is_copied_as_a_column(spark):
    """Shared terms stay numbers until they are copied from one column to the other; none is lost or moved."""
    docs, labels, _ = fixture(spark, toxic_words=("v1", "v2"))
    index = toxicity.fit_index(docs, labels)
    asked = documents(spark, [(1, "v1 v2 v2 unheard"), (2, None), (3, "unheard of"), (4, "v2 v1 v1 v1")])
    scored, name = toxicity.score_toxicity(asked, index, ["doc_id"])
    rows = {r["doc_id"]: r[name] for r in scored.collect()}
    for doc_id, text in ((1, b"v1 v2 v2 unheard"), (2, b""), (3, b"unheard of"), (4, b"v2 v1 v1 v1")):
        counted = index.vocabulary.all_counts(text)
        (places, _), = index.nearest_of([counted])
        shared = index.shared(counted, places.tolist())
        assert isinstance(shared, np.ndarray)
        has = set(np.concatenate([index.terms[:0], *(index.terms[index.ends[p - 1] if p else 0 : index.ends[p]] for p in places)]).tolist())
        weights = dict(zip(counted[0].tolist(), toxicity.unit(counted[0], counted[1], index.idf).tolist(), strict=True))
        wanted = sorted((t for t in weights if t in has and weights[t] > 0), key=lambda t: (-weights[t], t))
        assert shared.tolist() == wanted
        assert rows[doc_id]["terms"] == [index.vocabulary.terms[t] for t in wanted]
    assert rows[1]["terms"] and not rows[2]["terms"]


def test_a_copy_outvotes_all_others(spark):
    docs, index = weighted_index(spark)
    texts = {r["doc_id"]: index.vocabulary.all_counts(r["text"].encode()) for r in docs.collect()}
    for place in range(0, len(index.ids), 7):
        vote, places = next(index.votes([texts[int(index.ids[place])]]))
        assert index.ids[places[0]] == index.ids[place]
        assert (vote > 0.5) == (index.labels[place] == 1)


def test_the_curve_is_fitted_on_the_other_half(spark):
    docs, labels, known = fixture(spark)
    rows = toxicity.toxicity_report(docs, labels).collect()
    # scores of held-out rows are as sure as those of rows that were learned from
    toxic = {i for i, _, t in known if t}
    seen, unseen = ([r["score"] for r in rows if r["doc_id"] in toxic and r["held_out"] == h] for h in (False, True))
    assert abs(np.mean(seen) - np.mean(unseen)) < 0.2


def test_scores_are_sums_of_table_entries():
    """Row by row, bins found by walking over the cuts."""
    r = np.random.RandomState(6)
    rows = np.round(r.normal(size=(1500, len(quality_gam.FEATURES))), 1)  # ties with the cuts
    labels = ((rows[:, 1] + rows[:, 4] * rows[:, 9] + 0.3 * r.normal(size=1500)) > 0).astype(float)
    model = quality_gam.Gam.fit(rows, labels, quality_gam.GamParams(rounds=20, pair_rounds=10))
    assert model.pairs

    def bin_of(value, cuts):
        return sum(1 for cut in cuts if cut <= value)

    for row, got in zip(rows[:200], model.margins(rows[:200]), strict=True):
        total = model.constant
        for value, cuts, table in zip(row, model.cuts, model.tables, strict=True):
            total += table[bin_of(value, cuts)]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[bin_of(row[i], model.pair_cuts[i]), bin_of(row[j], model.pair_cuts[j])]
        assert abs(total - got) < 1e-9


def value_of(gradient, weight, ridge):
    return gradient.sum() ** 2 / (weight.sum() + ridge)


def test_cuts_are_the_best_of_all():
    r = np.random.RandomState(8)
    for _ in range(60):
        shape = tuple(r.randint(2, 7, 2))
        g, h, ridge = r.normal(size=shape), r.uniform(0.1, 2, shape), r.choice([0.0, 1.0, 2.0])
        step, gain = quality_gam.best_quadrants(g, h, ridge)
        every = {}
        for i in range(1, shape[0]):
            for j in range(1, shape[1]):
                parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
                every[i, j] = sum(value_of(g[p], h[p], ridge) for p in parts), parts
        best, parts = max(every.values(), key=lambda v: v[0])
        assert gain == pytest.approx(best - value_of(g, h, ridge))
        for p in parts:
            assert np.allclose(step[p], g[p].sum() / (h[p].sum() + ridge))


def test_a_tree_cuts_twice_where_it_gains_most():
    r = np.random.RandomState(9)
    for _ in range(100):
        n = r.randint(1, 9)
        g, h, ridge = r.normal(size=n), r.uniform(0.1, 2, n), 1.0
        pieces = [(0, n)]
        for _ in range(2):
            options = [
                (value_of(g[a:c], h[a:c], ridge) + value_of(g[c:b], h[c:b], ridge) - value_of(g[a:b], h[a:b], ridge), (a, b), c)
                for a, b in pieces
                for c in range(a + 1, b)
            ]
            if options:
                _, (a, b), c = max(options)
                pieces = [p for p in pieces if p != (a, b)] + [(a, c), (c, b)]
        step = quality_gam.best_step(g, h, ridge)
        for a, b in pieces:
            assert np.allclose(step[a:b], g[a:b].sum() / (h[a:b].sum() + ridge))
