"""Mixing sources to target weights by a min-cost flow.

A document may belong to several sources.  Documents are added up by their
membership pattern, so the flow is as large as the number of patterns, however
many documents there are.  A pattern offers its words once for each permitted
copy; each further copy costs more (costs are convex, so copies fill up in
order).  Patterns send words to their sources, sources to their quotas; the
cheapest of the largest flows says how many words every pattern gives.

A pattern then gives whole documents: all of them as often as the words go into
its size, and once more those whose seeded hashes are smallest, as far as they
fit.  That hash is found by two histograms of 4096 ranges and an exact prefix
sum within the last range, so no task sorts a pattern and no document is
collected.  What is left is filled up with a few smaller documents: the first in
seeded order of every size class that still fit.

Quotas share all words by the sources' weights.  None is above ``max_copies``
times its source; what is above is shared again by weight among the others.

Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating.  A
null or empty membership list is the list of the null source.  Null and empty
texts have size 0 and are taken as 0 words.  Rows that repeat an id within a
pattern, with the same number of words, are taken or left together; null ids are
ids like others.  An empty table gives no rows.  Other columns are not read.
At most ``max_patterns`` patterns are accepted, as weights are stated for
sources by hand; more raise ValueError, nothing is left out.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.batches import quoted
from threatloom.session import stored

_WORDS = r"[^\x20\x09-\x0D]+"
_RANGE_BITS = 12


@dataclass(frozen=True)
class MixParams:
    """Copy number i of a word costs ``copy_costs[i]``, which must not fall."""

    weights: tuple[int, ...] = (1, 2, 3)
    copy_costs: tuple[int, ...] = (0, 1, 2)
    seed: int = 20
    fillers: int = 3
    max_patterns: int = 4096

    @property
    def max_copies(self) -> int:
        return len(self.copy_costs)


def shared_targets(sizes: dict[str | None, int], total: int, params: MixParams) -> dict[str | None, Fraction]:
    """Words that each source should get."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: params.weights[i % len(params.weights)] for i, s in enumerate(names)}
    target: dict[str | None, Fraction] = {}
    rest, open_ = Fraction(total), names
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > params.max_copies * sizes[s]]
        for s in above:
            target[s] = Fraction(params.max_copies * sizes[s])
            rest -= target[s]
        if not above:
            target.update({s: unit * weight[s] for s in open_})
            break
        open_ = [s for s in open_ if s not in target]
    return target


class Flow:
    """Cheapest of the largest flows, by phases of equal path cost."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, tail: int, head: int, room: int, cost: int = 0) -> int:
        for a, b, r, c in ((tail, head, room, cost), (head, tail, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, edge: int) -> int:
        return self.room[edge ^ 1]

    def _distances(self, start: int) -> list[int | None]:
        far: list[int | None] = [None] * len(self.out)
        far[start] = 0
        waiting, listed = deque([start]), {start}
        while waiting:
            node = waiting.popleft()
            listed.discard(node)
            for e in self.out[node]:
                head, d = self.to[e], far[node] + self.cost[e]
                if self.room[e] and (far[head] is None or d < far[head]):
                    far[head] = d
                    if head not in listed:
                        listed.add(head)
                        waiting.append(head)
        return far

    def _levels(self, start: int, tight: list[int | None]) -> list[int]:
        """Edges from the start over edges of shortest paths only."""
        level = [-1] * len(self.out)
        level[start], waiting = 0, deque([start])
        while waiting:
            node = waiting.popleft()
            for e in self.out[node]:
                head = self.to[e]
                if self.room[e] and level[head] < 0 and tight[head] == tight[node] + self.cost[e]:
                    level[head] = level[node] + 1
                    waiting.append(head)
        return level

    def solve(self, start: int, end: int) -> None:
        while (far := self._distances(start))[end] is not None:
            while (level := self._levels(start, far))[end] >= 0:
                at = [0] * len(self.out)
                path: list[int] = []
                node = start
                while True:
                    if node == end:
                        room = min(self.room[e] for e in path)
                        for e in path:
                            self.room[e] -= room
                            self.room[e ^ 1] += room
                        path, node = [], start
                    while at[node] < len(self.out[node]):
                        e = self.out[node][at[node]]
                        head = self.to[e]
                        if self.room[e] and level[head] == level[node] + 1 and far[head] == far[node] + self.cost[e]:
                            break
                        at[node] += 1
                    else:
                        if not path:
                            break
                        e = path.pop()
                        node = self.to[e ^ 1]
                        at[node] += 1
                        continue
                    path.append(e)
                    node = head


def routed(
    patterns: dict[str, tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], params: MixParams
) -> dict[str, dict[str | None, int]]:
    """Words that each pattern gives to each of its sources."""
    if list(params.copy_costs) != sorted(params.copy_costs):
        raise ValueError("costs of copies must not fall")
    sources = {s: i + 2 + len(patterns) for i, s in enumerate(quotas)}
    net = Flow(2 + len(patterns) + len(sources))
    sent: dict[str, dict[str | None, int]] = {}
    for node, (key, (members, size)) in enumerate(patterns.items(), 2):
        for cost in params.copy_costs:
            net.edge(0, node, size, cost)
        sent[key] = {s: net.edge(node, sources[s], params.max_copies * size) for s in members}
    for s, quota in quotas.items():
        net.edge(sources[s], 1, quota)
    net.solve(0, 1)
    return {key: {s: net.used(e) for s, e in edges.items()} for key, edges in sent.items()}


def units(docs: DataFrame, sources: Column, params: MixParams, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, pattern, key, h): words, sorted distinct sources and seeded hash of every document."""
    listed = F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))
    listed = F.when(F.size(listed) == 0, F.array(F.lit(None).cast("string"))).otherwise(listed)
    words = F.coalesce(F.regexp_count(F.col(quoted(text)).cast("string"), F.lit(_WORDS)), F.lit(0))
    rows = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"),
        words.cast("bigint").alias("size"),
        F.array_sort(F.array_distinct(listed)).alias("pattern"),
    )
    return rows.select(
        "doc_id", "size", "pattern", F.to_json("pattern").alias("key"), F.xxhash64(F.lit(params.seed), "doc_id", "size").alias("h")
    )


def _boundary(rows: DataFrame, bucket: Column, wanted: list[tuple], names: list[str]) -> list[tuple]:
    """For each of ``wanted`` (its last field the words still to take) the bucket where they run out, and what is left before it."""
    spark = rows.sparkSession
    if not wanted:
        return []
    types = {"key": "string", "left": "bigint"}
    table = spark.createDataFrame(wanted, ", ".join(f"{n} {types.get(n, 'bigint')}" for n in [*names, "left"]))
    here = rows.withColumn("bucket", bucket).join(F.broadcast(table), names)
    sums = here.groupBy(*names, "bucket", "left").agg(F.sum("size").alias("words"))
    order = Window.partitionBy(*names).orderBy("bucket")
    sums = sums.withColumn("before", F.sum("words").over(order) - F.col("words"))
    cut = sums.where("before <= left AND before + words > left")
    return [tuple(r) for r in cut.select(*names, "bucket", (F.col("left") - F.col("before")).alias("left")).collect()]


def seeded_cuts(rows: DataFrame, wanted: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each pattern the hash below which its documents are taken, and the words then missing."""
    first = F.shiftright("h", 64 - _RANGE_BITS)
    second = F.shiftright("h", 64 - 2 * _RANGE_BITS).bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))
    one = _boundary(rows, first, sorted(wanted.items()), ["key"])
    rows = rows.withColumn("first", first)
    two = _boundary(rows, second, one, ["key", "first"])
    rows = rows.withColumn("second", second)
    three = _boundary(rows, F.col("h"), two, ["key", "first", "second"])
    return {key: (h, left) for key, _, _, h, left in three}


def fillers(rows: DataFrame, cuts: dict[str, tuple[int, int]], params: MixParams) -> list[tuple[str, int, int]]:
    """(pattern, hash, 1 or -1): documents beyond the cut that are taken too, and some before it that are left."""
    spark = rows.sparkSession
    if not any(gap for _, gap in cuts.values()):
        return []
    table = spark.createDataFrame([(k, h) for k, (h, gap) in sorted(cuts.items()) if gap], "key string, cut bigint")
    sized = rows.join(F.broadcast(table), "key").where("size > 0").withColumn("taken", F.col("h") < F.col("cut"))
    # those nearest to the cut, of every class of sizes between powers of two; the limit is applied before the shuffle
    near = F.when(F.col("taken"), -F.col("h")).otherwise(F.col("h"))
    order = Window.partitionBy("key", "taken", F.length(F.bin("size"))).orderBy(near, "h")
    some = sized.withColumn("place", F.row_number().over(order)).where(F.col("place") <= params.fillers)
    picked = some.select("key", "h", "taken").distinct()
    # rows that share a hash are taken together
    whole = rows.join(F.broadcast(picked), ["key", "h"]).groupBy("key", "h", "taken").agg(F.sum("size").alias("words"))
    offers: dict[str, list[tuple[int, int]]] = {}
    for key, h, taken, words in sorted(whole.collect()):
        offers.setdefault(key, []).append((-words if taken else words, h))
    return [(key, h, 1 if words > 0 else -1) for key, own in sorted(offers.items()) for words, h in changes(own, cuts[key][1])]


def changes(offers: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Offers (words, hash) that bring the gap near 0: the best pair, one of which may be nothing, again and again."""
    chosen: list[tuple[int, int]] = []
    left = [(0, None), *offers]
    while gap:
        words = np.array([w for w, _ in left], np.int64)
        missed = np.abs(gap - words[:, None] - words[None, :])
        np.fill_diagonal(missed[1:, 1:], abs(gap))
        i, j = np.unravel_index(int(missed.argmin()), missed.shape)
        if missed[i, j] >= abs(gap):
            break
        gap -= int(words[i] + words[j])
        chosen += [left[k] for k in {int(i), int(j)} if k]
        left = [o for k, o in enumerate(left) if not k or k not in (i, j)]
    return chosen


def mixture(docs: DataFrame, sources: Column, params: MixParams = MixParams()) -> tuple[DataFrame, DataFrame]:
    """Every document with the words taken of it, and every source with its size, target and routed words.

    The first table has doc_id, size, pattern, key, copies and taken; the second
    source, key (that of the pattern of this source alone), size, target, routed.
    """
    spark = docs.sparkSession
    rows = stored(units(docs, sources, params), "mixing")
    totals = rows.groupBy("key", "pattern").agg(F.sum("size").alias("size")).limit(params.max_patterns + 1).collect()
    if len(totals) > params.max_patterns:
        raise ValueError(f"more than {params.max_patterns} patterns of sources")
    patterns = {key: (tuple(members), size) for key, members, size in sorted(totals, key=lambda r: r[0])}
    sizes: dict[str | None, int] = {}
    for members, size in patterns.values():
        for s in members:
            sizes[s] = sizes.get(s, 0) + size
    targets = shared_targets(sizes, sum(size for _, size in patterns.values()), params)
    quotas = {s: int(t + Fraction(1, 2)) for s, t in targets.items()}
    flow = routed(patterns, quotas, params)
    copies, wanted = {}, {}
    for key, (_, size) in patterns.items():
        copies[key], rest = divmod(sum(flow[key].values()), size) if size else (0, 0)
        if rest:
            wanted[key] = rest
    cuts = seeded_cuts(rows, wanted)
    more = spark.createDataFrame(fillers(rows, cuts, params), "key string, h bigint, more int")
    low = -(1 << 63)
    plan = spark.createDataFrame(
        [(key, n, cuts[key][0] if key in cuts else low) for key, n in copies.items()], "key string, whole int, cut bigint"
    )
    # both tables are bounded by the number of patterns
    placed = rows.join(F.broadcast(plan), "key").join(F.broadcast(more), ["key", "h"], "left")
    times = F.col("whole") + (F.col("h") < F.col("cut")).cast("int") + F.coalesce("more", F.lit(0))
    taken = placed.select("doc_id", "size", "pattern", "key", times.alias("copies"), (F.col("size") * times).alias("taken"))
    given = {s: sum(f.get(s, 0) for f in flow.values()) for s in sizes}
    named = spark.createDataFrame(
        [(s, sizes[s], float(targets[s]), given[s]) for s in sizes], "source string, size bigint, target double, routed bigint"
    )
    return taken, named.withColumn("key", F.to_json(F.array("source")))
