"""Conversation repair, ranked search and source mixing against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, clashing, documents, lower
from threatloom.llm import lexical_search, mixing, turn_repair
from threatloom.llm.lexical_search import SearchParams
from threatloom.llm.mixing import MixParams
from threatloom.llm.turn_repair import RepairParams

TURNS = "conv_id bigint, turn bigint, role string, text string"
TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


# ------------------------------------------------------------------ conversation repair


def faults(turns):
    seen, found = set(), []
    for role, text in turns:
        last = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        found.append(fault)
    return found


def all_edits(turns, inserts):
    """(cost, letters, roles and texts) of every sequence of edits, valid or not."""
    marks = faults(turns)

    def go(at, cost, letters, out, left):
        if left:
            for role in ("user", "assistant"):
                yield from go(at, cost + 3, letters + "I", [*out, (role, "")], left - 1)
        if at == len(turns):
            yield cost, letters, out
            return
        (role, text), fault = turns[at], marks[at]
        yield from go(at + 1, cost + 4, letters + "D", out, left)
        if fault in ("blank", "duplicate"):
            return
        more = 3 if fault else 0
        yield from go(at + 1, cost + more, letters + "K", [*out, (role, text)], left)
        for other in ("user", "assistant"):
            yield from go(at + 1, cost + 3 + more, letters + "R", [*out, (other, text)], left)

    yield from go(0, 0, "", [], inserts)


def brute_repair(turns, inserts=2):
    valid = (
        (cost, letters, out)
        for cost, letters, out in all_edits(turns, inserts)
        if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in out))
    )
    return min(valid, key=lambda v: v[:2])


def kinds(turns):
    marks = {"blank": turn_repair.GONE, "duplicate": turn_repair.GONE, "truncated": turn_repair.CUT, "": turn_repair.FINE}
    return bytes(turn_repair.kind_of(r.encode(), marks[f]) for (r, _), f in zip(turns, faults(turns), strict=True))


def some_turns(r, n):
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    return [(r.choice(roles), r.choice(["a.", "b!", "cut", " ", f"{i}?"])) for i in range(n)]


def test_cheapest_edits_are_those_of_trying_all():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 4, 4) * 12:
        turns = some_turns(r, n)
        cost, letters, out = brute_repair(turns)
        for block in (1, 2, 256):
            assert turn_repair.cheapest_edits(kinds(turns), block) == (cost, letters), turns
        got = [(role, text) for _, role, text in turn_repair.edited([(a.encode(), b.encode()) for a, b in turns], letters)]
        assert got == [(a.encode(), b.encode()) for a, b in out]


def by_strings(turns):
    """Least (cost, letters) by state, turn by turn, on plain strings."""
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}
    for (role, _), fault in zip(turns, faults(turns), strict=True):
        offers = defaultdict(list)
        for state, (cost, letters) in best.items():
            need = "a" if state == "u" else "u"
            for now, c, ls in ((state, cost, letters), (need, cost + 3, letters + "I")):
                offers[now].append((c + 4, ls + "D"))
                if fault in ("blank", "duplicate"):
                    continue
                c += 3 if fault else 0
                if role[:1] in steps[now]:
                    offers[steps[now][role[:1]]].append((c, ls + "K"))
                offers["a" if now == "u" else "u"].append((c + 3, ls + "R"))
        best = {state: min(found) for state, found in offers.items()}
    ends = [v for s, v in best.items() if s in ("", "a")] + [(v[0] + 3, v[1] + "I") for s, v in best.items() if s == "u"]
    return min(ends)


def test_blocks_of_a_long_conversation_give_the_same():
    r = random.Random(2)
    for n in (50, 400, 1500):
        turns = some_turns(r, n)
        for block in (7, 64, 256, 4096):
            assert turn_repair.cheapest_edits(kinds(turns), block) == by_strings(turns)


def expected_report(rows):
    """The report of every conversation, rows damaged first."""
    groups = defaultdict(list)
    plain = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = plain(role), plain(text)
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        groups[conv] += [(turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)
    found = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        said = [t[1:] for t in turns]
        numbers = {t[0] for t in turns} - {None}
        marks = Counter(faults(said))
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in itertools.pairwise(said)]
        cost, letters = by_strings(said)
        texts = [(a.encode(), b.encode()) for a, b in said]
        out = b"\n".join(role + b":" + text for _, role, text in turn_repair.edited(texts, letters))
        found[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            marks["blank"],
            marks["duplicate"],
            marks["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            letters,
            hashlib.sha256(out).hexdigest(),
        )
    return found


def some_conversations():
    r = random.Random(3)
    rows = [(c, t, *some_turns(r, 1)[0]) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(500, t, *some_turns(r, 1)[0]) for t in range(700)]  # most rows are one conversation's
    rows += [(500, t, "user", "said again.") for t in range(0, 700, 5)]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (7, None, "assistant", "b"), (8, 3, None, "x."), (9, 2, "user", None)]
    rows += [(600, 5, "user", "é" * 3 + "\x1c."), (600, 5, "user", "é" * 3 + "\x1c."), (601, 2, "", ""), (602, 9, "user", "long " * 40_000)]
    drop = next(c for c in itertools.count(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (drop, 0, "user", "gone.")], drop


@pytest.mark.parametrize("buffer_bytes", [32 << 20, 3000, -1])
def test_reports_equal_those_made_one_by_one(spark, buffer_bytes):
    rows, dropped = some_conversations()
    wanted = expected_report(rows)
    table = spark.createDataFrame(rows, TURNS).repartition(5)
    extra = table.select("*", *(F.lit(1).alias(n) for n in ("part", "idx", "report", "there", "fault", "a.b")))
    turns, there = turn_repair.damaged(extra)
    got = turn_repair.repair_report(turns, there, RepairParams(block=32, buffer_bytes=buffer_bytes)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == wanted
    assert len(got) == len(wanted)
    assert wanted[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_are_those_of_the_digest(spark):
    rows, _ = some_conversations()
    turns, there = turn_repair.damaged(spark.createDataFrame(rows, TURNS))
    out = defaultdict(list)
    for r in turn_repair.repaired_turns(turns, there).collect():
        out[r.conv_id].append((r.position, r.edit, f"{r.role}:{r.text}"))
    for conv, wanted in expected_report(rows).items():
        lines = sorted(out[conv])
        assert [n for n, _, _ in lines] == list(range(len(lines)))
        assert "".join(e for _, e, _ in lines) == wanted[6].replace("D", "")
        assert hashlib.sha256("\n".join(t for _, _, t in lines).encode()).hexdigest() == wanted[7]


def test_no_conversations(spark):
    assert turn_repair.repair_report(spark.createDataFrame([], TURNS)).collect() == []


def test_rows_of_a_hot_conversation_are_dealt(spark):
    rows = [(1, t, "user", f"text {t}.") for t in range(4000)] + [(2, 0, "user", "a.")]
    ordered = turn_repair._in_order(spark.createDataFrame(rows, TURNS).repartition(4), F.lit(True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = ordered.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r[1] for r in sizes) < 1500


# ------------------------------------------------------------------ ranked search


def brute_search(docs, items, top=10):
    bags = [(i, Counter(re.findall(TERM, lower(t or "")))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    found = []
    for item, text in items:
        terms = set(re.findall(TERM, lower(text or "")))
        scored = []
        for doc, bag in bags:
            m = 10 + (90 * bag.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in terms
                if t in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        found += [(item, n, s[3], -s[0]) for n, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(found, key=str)


def found_by(docs, items, params=SearchParams()):
    return sorted((tuple(r) for r in lexical_search.ranked_search(docs, items, params).collect()), key=str)


def test_search_equals_scoring_every_document(spark):
    r = random.Random(5)
    word = lambda: r.choice("Alpha beta GAMMA delta é5 zeta".split()) + str(r.randrange(12))
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(2000 + i, docs[3][1].upper() + "!") for i in range(5)]
    docs += [(None, docs[3][1]), (3, "other alpha1"), (5000, None), (5001, ""), (5002, " .,;"), (5003, "x" * 200_000 + " beta3")]
    items = [(i, " ".join(word() for _ in range(6))) for i in range(25)]
    items += [(3, items[3][1]), (90, None), (91, ""), (92, "unheard"), (None, docs[3][1])]
    table = clashing(documents(spark, docs)).repartition(7)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = brute_search(docs, items)
    assert found_by(table, queries) == wanted
    assert found_by(table, queries, SearchParams(block_bytes=300)) == wanted


def test_search_of_awkward_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b x85"), (2, None)], "item_id bigint, text string")
    docs = awkward(spark)
    assert found_by(docs, items) == brute_search([(r.doc_id, r.text) for r in docs.collect()], [(1, "a b x85"), (2, None)])
    assert found_by(docs.limit(0), items) == []
    assert found_by(docs, items.limit(0)) == []


def test_a_class_is_scored_once_and_sends_ten_members_a_task(spark):
    docs = documents(spark, ["one two three"] * 500 + ["three four"] * 3).repartition(3)
    index = lexical_search.Index([b"one three"])
    rows = lexical_search.bags(docs, index)
    members = lexical_search.classes(rows, 503, 1506, SearchParams()).groupBy("h").count().collect()
    assert sorted(r[1] for r in members) == [3, 10]


def test_large_sums_are_exact(monkeypatch, spark):
    docs, items = [(i, f"a b{i}") for i in range(20)], [(1, "a b1 b2")]
    monkeypatch.setattr(lexical_search, "_EXACT", 0)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    assert found_by(documents(spark, docs), queries) == brute_search(docs, items)


# ------------------------------------------------------------------ mixing


def test_targets_are_shared_until_none_is_above():
    sizes = {"b": 10, "a": 1000, None: 5, "c": 0, "d": 3000}
    total = sum(sizes.values())
    target = mixing.shared_targets(sizes, total, MixParams())
    # a weighs 1, b 2, c 3, d 1, null 2
    assert target["b"] == 30 and target["c"] == 0 and target[None] == 15
    assert target["a"] == target["d"] == Fraction(total - 45, 2)
    assert sum(target.values()) == total
    assert mixing.shared_targets({}, 0, MixParams()) == {}
    assert mixing.shared_targets({"a": 0}, 0, MixParams()) == {"a": 0}


def brute_flow(patterns, quotas, costs):
    """(words, cost) of the best routing, all amounts tried."""
    keys = list(patterns)
    names = list(quotas)

    def price(size, words):
        return sum(costs[i] * min(max(words - i * size, 0), size) for i in range(len(costs)))

    best = (0, 0)

    def go(at, left, words, cost):
        nonlocal best
        if at == len(keys):
            best = max(best, (words, -cost))
            return
        members, size = patterns[keys[at]]
        options = [range(min(left[s], len(costs) * size) + 1) for s in members]
        for given in itertools.product(*options):
            if sum(given) <= len(costs) * size:
                rest = {**left, **{s: left[s] - g for s, g in zip(members, given, strict=True)}}
                go(at + 1, rest, words + sum(given), cost + price(size, sum(given)))

    go(0, {s: quotas[s] for s in names}, 0, 0)
    return best[0], -best[1]


def test_flow_equals_trying_all_routings():
    r = random.Random(6)
    params = MixParams(copy_costs=(0, 1, 3))
    for _ in range(40):
        names = ["a", "b", "c"][: r.randrange(1, 4)]
        lists = [c for n in range(1, len(names) + 1) for c in itertools.combinations(names, n)]
        patterns = {str(p): (p, r.randrange(0, 4)) for p in r.sample(lists, min(3, len(lists)))}
        quotas = {s: r.randrange(0, 7) for s in names}
        flow = mixing.routed(patterns, quotas, params)
        words = sum(sum(f.values()) for f in flow.values())
        cost = 0
        for key, given in flow.items():
            size, taken = patterns[key][1], sum(given.values())
            assert taken <= 3 * size
            cost += sum(c * min(max(taken - i * size, 0), size) for i, c in enumerate(params.copy_costs))
        for s, quota in quotas.items():
            assert sum(f.get(s, 0) for f in flow.values()) <= quota
        assert (words, cost) == brute_flow(patterns, quotas, params.copy_costs)
    with pytest.raises(ValueError):
        mixing.routed({}, {}, MixParams(copy_costs=(1, 0)))


def mixed(docs, sources, params=MixParams()):
    taken, named = mixing.mixture(docs, sources, params)
    return taken.collect(), {r.source: r for r in named.collect()}


def some_sources(spark):
    r = random.Random(7)
    rows = []
    for i in range(3000):
        # one source has a third of the documents, another a single long one
        source = "big" if i % 3 == 0 else r.choice(["b", "c", "d", None])
        rows.append((i, " ".join(["w"] * min(5000, int(r.paretovariate(0.8) * 8))), "en", source, 0))
    rows += [(9000, "w " * 20_000, "en", "one", 0), (9001, None, "en", "empty", 0), (None, "x y", "en", "b", 0), (5, "w w", "en", "c", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_every_source_comes_to_its_target(spark):
    docs = clashing(some_sources(spark)).withColumn("key", F.lit("k")).withColumn("h", F.lit(1))
    rows, sources = mixed(docs.repartition(5), F.array("source"))
    assert len(rows) == docs.count()
    words, sizes = Counter(), Counter()
    for row in rows:
        (source,) = row.pattern
        assert row.taken % row.size == 0 if row.size else row.taken == 0
        assert row.taken <= 3 * row.size
        words[source] += row.taken
        sizes[source] += row.size
    assert sum(s.target for s in sources.values()) == pytest.approx(sum(sizes.values()))
    for name, row in sources.items():
        assert row.size == sizes[name]
        assert row.routed == math.floor(row.target + 0.5)
        # a single document is taken whole or not; elsewhere pairs of others make up for it
        near = sizes[name] if name == "one" else 2
        assert abs(words[name] - row.target) <= near, name
    again, _ = mixed(docs.repartition(3), F.array("source"))
    assert sorted(map(str, again)) == sorted(map(str, rows))
    other, _ = mixed(docs, F.array("source"), MixParams(seed=21))
    assert sorted(map(str, other)) != sorted(map(str, rows))


def test_cuts_equal_a_walk_in_seeded_order(spark):
    rows = mixing.units(some_sources(spark), F.array("source"), MixParams())
    lists = defaultdict(Counter)
    for r in rows.collect():
        lists[r.key][r.h] += r.size
    wanted = {k: sum(c.values()) // 3 for k, c in lists.items() if sum(c.values()) > 3}
    cuts = mixing.seeded_cuts(rows, wanted)
    for key, rest in wanted.items():
        for h in sorted(lists[key]):
            if lists[key][h] > rest:
                break
            rest -= lists[key][h]
        assert cuts[key] == (h, rest)


def test_changes_come_as_near_as_pairs_can():
    r = random.Random(8)
    for _ in range(200):
        offers = [(r.choice([-1, 1]) * r.randrange(1, 300), n) for n in range(r.randrange(0, 12))]
        gap = r.randrange(0, 200)
        chosen = mixing.changes(offers, gap)
        assert len(set(chosen)) == len(chosen) and set(chosen) <= set(offers)
        left = abs(gap - sum(w for w, _ in chosen))
        words = [0, 0, *(w for w, _ in offers)]
        assert left <= min(abs(gap - a - b) for a, b in itertools.combinations(words, 2))


def test_overlapping_sources_share_documents(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"] if i % 4 else ["b", "a", "b"]) for i in range(400)]
    rows += [(1000 + i, "w " * 10, None if i else []) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tags array<string>")
    got, sources = mixed(docs, F.col("tags"))
    assert {r.key for r in got} == {'["a"]', '["a","b"]', "[null]"}
    assert sources["a"].size == 4000 and sources["b"].size == 3000 and sources[None].size == 400
    total = 4400
    assert sources[None].target == 1200 and sources["a"].target == pytest.approx((total - 1200) / 3)
    for s in sources.values():
        assert s.routed == math.floor(s.target + 0.5)
    assert abs(sum(r.taken for r in got) - total) <= 10 * 3


def test_mixing_of_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    got, _ = mixed(docs, F.array("source"))
    assert len(got) == docs.count()
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert mixed(docs.limit(0), F.array("source"))[0] == []
    with pytest.raises(ValueError):
        mixing.mixture(docs, F.array("source"), MixParams(max_patterns=1))
