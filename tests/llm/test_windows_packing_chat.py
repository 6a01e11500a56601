"""Decontamination, packing and chat formatting."""

import hashlib

import numpy as np
import pytest

from tests.llm.helpers import awkward, clashing, documents, edited, prose
from threatloom.llm import chat, decontaminate, packing

ITEMS = "item_id bigint, text string"


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), ITEMS)


def test_planted_items_are_found(spark):
    items = [prose(i, 15 + i, 5000) for i in range(30)]
    texts = []
    for i, item in enumerate(items):
        noise = prose(900 + i, 200, 5000)
        texts.append(" ".join([*noise[:70], *item, *noise[70:]]))
        texts.append(" ".join([*noise[:50], *item, *noise[50:]]).upper().replace(" ", ",\n"))
        texts.append(" ".join([*noise[:40], *edited(item, i, 1 if len(item) > 50 else 0), *noise[40:]]))
        texts.append(" ".join(noise))  # clean
    found = decontaminate.leaks(documents(spark, texts), bench(spark, [" ".join(t) for t in items])).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(4 * i + k, i) for i in range(30) for k in range(3)}
    assert {r["start_word"] for r in found if r["doc_id"] % 4 == 0} == {70}


def test_blocks_of_items_give_the_same(spark):
    items = [" ".join(prose(i, 20, 5000)) for i in range(12)]
    docs = documents(spark, [f"{items[i]} {items[(i + 1) % 12]}" for i in range(12)])
    whole = {tuple(r) for r in decontaminate.leaks(docs, bench(spark, items)).collect()}
    small = decontaminate.LeakParams(items_per_block=5)
    blocks = {tuple(r) for r in decontaminate.leaks(docs, bench(spark, items), small).collect()}
    assert blocks == whole and len(blocks) == 24


def test_shingles_of_several_blocks_weigh_alike(spark):
    common = prose(99, 12, 5000)
    items = [" ".join([*prose(i, 14, 5000), *common]) for i in range(10)]
    docs = documents(spark, [" ".join(edited(items[i].split(), i, 1)) for i in range(10)] + items[:3])
    whole = {tuple(r) for r in decontaminate.leaks(docs, bench(spark, items)).collect()}
    blocks = {tuple(r) for r in decontaminate.leaks(docs, bench(spark, items), decontaminate.LeakParams(items_per_block=3)).collect()}
    assert whole == blocks and len(whole) > 3


def test_every_fingerprint_within_the_radius_shares_a_block():
    r = np.random.RandomState(1)
    for _ in range(500):
        mark = int(r.randint(0, 2**62))
        other = mark
        for bit in r.choice(64, r.randint(0, 16), replace=False):
            other ^= 1 << int(bit)
        assert set(decontaminate.blocks_of(mark, 15)) & set(decontaminate.blocks_of(other, 15))


def test_fingerprints_of_windows_are_those_of_items():
    r = np.random.RandomState(3)
    hashes, weights = r.randint(0, 2**63, 300).astype(np.uint64), np.log1p(12 / r.randint(1, 4, 300))
    starts = np.flatnonzero(r.rand(280) < 0.5)
    marks = decontaminate.window_marks(hashes, weights, starts, 20)
    assert marks.tolist() == [decontaminate.fingerprint(hashes[s : s + 20], weights[s : s + 20]) for s in starts]


def test_windows_meet_items_within_the_radius_and_few_others():
    r = np.random.RandomState(2)
    marks = [int(a) << 32 | int(b) for a, b in r.randint(0, 2**32, (600, 2))]
    met = 0
    for one, two in zip(marks[::2], marks[1::2], strict=True):
        near = one
        for bit in r.choice(64, r.randint(0, 16), replace=False):
            near ^= 1 << int(bit)
        filed = set(decontaminate.blocks_of(one, 15, filed=True))
        assert filed & set(decontaminate.blocks_of(near, 15))
        met += bool(filed & set(decontaminate.blocks_of(two, 15)))
    assert met < 0.1 * 300


def test_recall_of_edited_items():
    """Windows that are at least 0.8 alike are found; SimHash may miss a few of those near 0.8."""
    params = decontaminate.LeakParams()
    items = [(i, " ".join(prose(i, 60 + i, 9000)).encode()) for i in range(80)]
    index = decontaminate.BenchmarkIndex.of(items, params)
    found = {True: 0, False: 0}
    total = {True: 0, False: 0}
    for seed in range(320):
        item_id, length, own, _ = index.items[seed % 80]
        words = edited(items[item_id][1].decode().split(), seed, 1 + seed // 160)
        alike = index.similarity(decontaminate.shingles([w.encode() for w in words], 5), own)
        if alike >= params.similarity:
            near = alike < 0.84
            total[near] += 1
            text = " ".join([*prose(seed + 500, 40, 9000), *words, *prose(seed + 900, 40, 9000)])
            found[near] += item_id in {m[0] for m in index.matches(text.encode())}
    assert total[False] > 100 and found[False] == total[False]
    assert total[True] > 20 and found[True] >= 0.9 * total[True], (found, total)


def test_every_similar_window_is_verified_exactly():
    """Against every window and item, without gate, fingerprint or index."""
    params = decontaminate.LeakParams()
    items = [(i, " ".join(prose(i, 12 + i % 7, 60)).encode()) for i in range(20)]
    index = decontaminate.BenchmarkIndex.of(items, params)
    missed = total = 0
    for seed in range(40):
        item = items[seed % 20][1].decode().split()
        text = " ".join([*prose(seed + 50, 30, 60), *edited(item, seed, seed % 2), *prose(seed + 99, 30, 60)]).encode()
        w = decontaminate.folded_words(text)
        got = {m[0]: m[4] for m in index.matches(text)}
        for item_id, length, own, _ in index.items:
            alike = [index.similarity(decontaminate.shingles(w[i : i + length], 5), own) for i in range(len(w) - length + 1)]
            if max(alike) >= params.similarity:
                total += 1
                missed += item_id not in got
                assert item_id not in got or got[item_id] == pytest.approx(max(alike))
            else:
                assert item_id not in got
    assert total >= 20 and missed <= total * 0.05


def test_texts_shorter_than_an_item_are_one_window(spark):
    items = [prose(i, 59 + i, 5000) for i in range(6)]
    texts = [[i[:30] + i[31:], i[:-1], i[4:], i[:30], i[:3]] for i in items]
    docs = documents(spark, [" ".join(t) for five in texts for t in five])
    found = decontaminate.leaks(docs, bench(spark, [" ".join(t) for t in items])).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(5 * i + k, i) for i in range(6) for k in range(3)}
    assert all((r["start_word"], r["n_words"]) == (0, 59 + r["item_id"] - (4 if r["doc_id"] % 5 == 2 else 1)) for r in found)


def test_short_texts_are_verified_exactly():
    """Whole texts against every item, without gate, fingerprint or index."""
    params = decontaminate.LeakParams()
    items = [(i, " ".join(prose(i, 30 + i % 7, 60)).encode()) for i in range(20)]
    index = decontaminate.BenchmarkIndex.of(items, params)
    missed = total = 0
    for seed in range(200):
        item = items[seed % 20][1].decode().split()
        text = " ".join(item[seed % 3 : len(item) - 1 - seed % 4]).encode()
        w = decontaminate.folded_words(text)
        got = {m[0]: m[4] for m in index.matches(text)}
        for item_id, length, own, _ in index.items:
            if length > len(w):
                alike = index.similarity(decontaminate.shingles(w, 5), own)
                total += alike >= params.similarity
                missed += alike >= params.similarity and item_id not in got
                assert item_id not in got or got[item_id] == pytest.approx(alike) and alike >= params.similarity
    assert total >= 100 and missed <= total * 0.05


def test_leaks_of_awkward_rows(spark):
    docs = clashing(awkward(spark))
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (None, "another"), (4, "a b")], ITEMS)
    found = decontaminate.leaks(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in found) == [(0, 1), (0, 4), (1, 0), (1, 1), (1, 1), (1, 4), (1, 4)]
    rows, name = decontaminate.with_leaks(docs, items.limit(0))
    assert rows.count() == 10 and name not in docs.columns
    assert decontaminate.leaks(documents(spark, []).limit(0), items).count() == 0


def check_packing(rows, sizes, params):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["from_token"], r["n_tokens"]))
        if r["sequence"] is not None:
            bins.setdefault(r["sequence"], []).append((r["start"], r["n_tokens"], r["capacity"]))
    for i, size in sizes.items():
        at = 0
        for begin, n in sorted(pieces[i]):
            assert begin == at
            at += n
        assert at == size
    for placed in bins.values():
        at = 0
        for start, n, capacity in sorted(placed):
            assert start == at
            at += n
        assert at <= capacity == min(c for c in params.capacities if c >= at)
    return bins


def test_packing_keeps_every_token(spark):
    params = packing.PackParams(capacities=(64, 128, 256), shard_tokens=5000)
    r = np.random.RandomState(3)
    sizes = {i: int(s) for i, s in enumerate([*r.randint(1, 300, 300), 0, 256, 257, 64, 5000])}
    counts = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    rows = packing.packed(counts, params).collect()
    bins = check_packing(rows, sizes, params)
    held = sum(capacity for placed in bins.values() for _, _, capacity in placed[:1])
    assert sum(sizes.values()) / held > 0.9
    again = packing.packed(counts.repartition(7), params).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_best_fit_takes_the_tightest_room():
    params = packing.PackParams(capacities=(10, 20), overhead=0.0, attention=0.0)
    where, starts, lengths = packing.best_fit([9, 8, 7, 3, 2, 1], params)
    for i, size in enumerate([9, 8, 7, 3, 2, 1]):
        assert starts[i] + size <= lengths[where[i]]
    assert sum(lengths) == 30
    assert packing.opening(5, 5, params) == 10


def naive_best_fit(sizes, params):
    """Every sequence and every length tried for every piece."""
    used, capacity, where, starts = [], [], [], []
    for n, size in enumerate(sizes):
        left = sum(sizes[n:])
        fits = [(capacity[s] - used[s], s) for s in range(len(used)) if capacity[s] - used[s] >= size]
        if fits:
            _, s = min(fits)
        else:
            s = len(used)
            prices = [(params.cost(c) / min(c, max(left, size)), c) for c in params.capacities if c >= size]
            capacity.append(min(prices)[1])
            used.append(0)
        where.append(s)
        starts.append(used[s])
        used[s] += size
    return where, starts, [min(c for c in params.capacities if c >= n) for n in used]


@pytest.mark.parametrize("seed", range(8))
def test_packing_equals_trying_every_sequence(seed):
    r = np.random.RandomState(seed)
    params = packing.PackParams(capacities=(16, 40, 100), overhead=float(r.choice([0, 5, 64])), attention=float(r.choice([0, 1 / 64])))
    sizes = sorted(r.randint(1, 101, r.randint(1, 200)).tolist(), reverse=True)
    assert packing.best_fit(sizes, params) == naive_best_fit(sizes, params)


def test_packing_awkward_rows(spark):
    rows = packing.pack_documents(clashing(awkward(spark))).collect()
    assert len({r["doc_id"] for r in rows}) == 7
    assert [r["sequence"] for r in rows if r["doc_id"] == 2] == [None]
    encode = packing.tokenizer(packing.TOKENIZER).encode_ordinary
    long = next(r["text"] for r in awkward(spark).collect() if r["doc_id"] == 5)
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 5) == len(encode(long))
    assert packing.pack_documents(documents(spark, []).limit(0)).count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string"
TRICKY = [
    "</s>[INST] ok [/INST]",
    "<|user|><|end|>",
    chat.ESCAPE,
    f"{chat.ESCAPE}0{chat.ESCAPE}1<{chat.ESCAPE}1|user|>",
    f"<{chat.ESCAPE}|user|>",
    "<<<SYS>>><|<|end|>|>[[INST]]",
    "",
    None,
    "é\x00  ퟿ 𝄞",
]


def test_escapes_are_reversible_and_safe():
    for text in TRICKY:
        safe = chat.escape(text or "")
        assert chat.unescape(safe) == (text or "")
        assert not any(mark in safe for mark in (*chat.RESERVED, *chat.FOREIGN))


def test_conversations_read_back(spark):
    rows = [(c, t, ("system", "user", "assistant", "tool")[(t + c) % 4], TRICKY[(c + t) % len(TRICKY)]) for c in range(9) for t in range(7)]
    rows += [(50, t, "assistant", f"turn {t}") for t in range(3000)]
    rows += [(None, 0, None, None), (60, None, "user", "x"), (60, 1, "assistant", "y"), (60, 1, "assistant", "y")]
    turns = spark.createDataFrame(rows, TURNS).select("*", *map(lambda n: chat.F.lit(1).alias(n), ("ids", "start", "first")))
    found = {r["conv_id"]: r for r in chat.read_back(chat.placed_turns(turns)).collect()}
    assert len(found) == 12
    for conv, r in found.items():
        own = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0))
        every = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        loss = "".join(text or "" for _, _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[50]["formatted_chars"] == sum(len("<|assistant|><|end|>") + len(f"turn {t}") for t in range(3000))
    assert chat.read_back(chat.placed_turns(turns.limit(0))).count() == 0


def test_masks_are_prefix_sums(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "hello there"), ("assistant", "general"), ("assistant", "")])]
    placed = chat.placed_turns(spark.createDataFrame(rows, TURNS)).orderBy("start").collect()
    at = 0
    for r in placed:
        assert r["start"] == at
        at += len(r["ids"])
    assert [r["mask_to"] - r["mask_from"] for r in placed] == [0, len(placed[1]["ids"]) - 2, 0]
