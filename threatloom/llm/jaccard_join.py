"""Similarity join of shingle sets by PartEnum signatures, and its linked components.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets
of distinct word shingles.  Equal sets form a class, and classes are compared:

* Sizes fall into bands.  Sets that may link lie in one band, or on either side
  of a band's upper end; each case is an instance with its own largest possible
  difference k between two linking sets.
* For an instance the domain of shingles is split into first-level parts and
  these into ``second`` sub-parts.  Of linking sets, some first-level part holds
  at most ``spare`` differences, so one choice of ``second - spare`` sub-parts
  has the same contents in both.  Each choice gives one signature.
* A set leaves out signatures over few shingles.  It keeps as many parts as the
  argument above needs, the fullest ones, so of two linking sets the one with
  the higher bar still proves a common signature, which the other keeps too.

Classes with a common signature are compared with the first of them, exactly,
on whole texts; what links is contracted to components.  Where a group still
holds several components, its pairs across components are compared if the group
is small.  Large groups, which near copies of one text make, are joined to
clusters, and each member is described by how it differs from what most of its
cluster have: differences are few and mostly its own, so an exact join on them
needs about as many comparisons as there are members.  No pair is lost that would
join two components, and nothing is capped.

Null, empty and blank texts have no shingles and link with nothing.  Repeated
rows fall into one class.  A null id takes part in links but is never the
smallest id of a component unless there is no other.  An empty table gives an
empty result.  Set hashes have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.llm.batches import byte_texts, fresh_name, quoted
from threatloom.llm.bloom import Bloom
from threatloom.llm.components import component_labels
from threatloom.llm.line_dedup import text_hash
from threatloom.session import stored

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)
BUCKETS = 128


@dataclass(frozen=True)
class JoinParams:
    """Link at ``percent`` of shared shingles; in groups of at most ``large`` classes all components are compared."""

    words: int = 5
    percent: int = 80
    large: int = 64
    band_ratio: float = 1.5
    small_set: int = 64
    slack: float = 1.35


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _S)) * _B
    return values ^ (values >> _S)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    wide = min(words, n)
    made = np.full(n - wide + 1, wide, np.uint64)
    for i in range(wide):
        made = _mixed(made * _A + hashed[i : n - wide + 1 + i])
    return np.unique(made)


def class_id(shingles: np.ndarray) -> int:
    """One signed 64-bit hash of a whole set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


@dataclass(frozen=True)
class Instance:
    """One case of set sizes: its number, and how its domain is split."""

    number: int
    differences: int
    first: int
    second: int
    spare: int


def instances(size: int, params: JoinParams) -> list[Instance]:
    """The cases in which a set of this many shingles may link with another set."""
    return list(_instances(size, params))


@lru_cache(maxsize=65_536)
def _instances(size: int, params: JoinParams) -> tuple[Instance, ...]:
    band = 0
    while _upper(band, params) < size:
        band += 1
    p = params.percent
    found = [(2 * band, 2 * _upper(band, params), _upper(band, params))]
    # the smaller set lies in the band that ends here, the larger one beyond its end
    ends = [(e, _upper(e, params)) for e in range(band + 1)]
    for edge, end in ends[:-1]:
        if p * size <= 100 * end:
            found.append((2 * edge + 1, end + 100 * end // p, end))
    if 100 * size >= p * (ends[-1][1] + 1):
        found.append((2 * band + 1, ends[-1][1] + 100 * ends[-1][1] // p, ends[-1][1]))
    made = []
    for number, both, end in found:
        k = (100 - p) * both // (100 + p)
        if k:
            second, spare = (3, 1) if end < params.small_set else (2, 1)
            needed = k // (spare + 1) + 1
            made.append(Instance(number, k, math.ceil(needed * params.slack), second, spare))
    return tuple(made)


@lru_cache(maxsize=4096)
def _upper(band: int, params: JoinParams) -> int:
    """Largest size in a band."""
    return 1 if band == 0 else max(_upper(band - 1, params) + 1, int(_upper(band - 1, params) * params.band_ratio))


def signatures(shingles: np.ndarray, case: Instance) -> np.ndarray:
    """The signatures a set keeps in one case."""
    cells = case.first * case.second
    cell = ((shingles >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    counts = np.bincount(cell, minlength=cells)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(shingles[order] * _A), dtype=np.uint64)])
    ends = np.cumsum(counts)
    sums = (running[ends] - running[ends - counts]).reshape(case.first, case.second)
    counts = counts.reshape(case.first, case.second)
    # each choice leaves one sub-part out
    held = counts.sum(axis=1, keepdims=True) - counts
    content = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums
    needed = case.differences // (case.spare + 1) + 1
    bar = np.partition(held.min(axis=1), case.first - needed)[case.first - needed]
    choice = np.arange(cells, dtype=np.uint64).reshape(held.shape) + np.uint64((case.number + 1) << 40)
    return _mixed(_mixed(content) + choice * _A)[held >= bar]


def classes(docs: DataFrame, params: JoinParams) -> DataFrame:
    """(doc_id, text_hash, cid, n): the class of every document and the size of its set; no class without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, params.words) for t in byte_texts(batch.column(2))]
            cids = pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), cids, sizes], names=["doc_id", "text_hash", "cid", "n"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, cid bigint, n bigint")


def signature_rows(docs: DataFrame, params: JoinParams) -> DataFrame:
    """(sig, cid); a task sends the signatures of a class only once as long as it remembers the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 500_000:
                seen.clear()
            sigs, cids, lengths = [], [], []
            for text in byte_texts(batch.column(0)):
                shingles = shingle_set(text, params.words)
                cid = class_id(shingles)
                if not len(shingles) or cid in seen:
                    continue
                seen.add(cid)
                for case in instances(len(shingles), params):
                    sigs.append(signatures(shingles, case))
                    cids.append(cid)
                    lengths.append(len(sigs[-1]))
            if sigs:
                sig = np.concatenate(sigs).view(np.int64)
                cid = np.repeat(np.array(cids, np.int64), lengths)
                for at in range(0, len(sig), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig[at : at + 100_000]), pa.array(cid[at : at + 100_000])], names=["sig", "cid"]
                    )

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "sig bigint, cid bigint")


def signature_groups(rows: DataFrame) -> DataFrame:
    """(sig, pivot, cid): every class with a shared signature, and the smallest class that shares it."""
    so_far = Window.partitionBy("sig").orderBy("cid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("sig", F.first("cid").over(so_far).alias("pivot"), "cid").where("cid <> pivot")


def class_texts(docs: DataFrame, known: DataFrame, wanted: DataFrame, params: JoinParams) -> DataFrame:
    """(cid, text, n, sketch): one whole text for each class in ``wanted``, and how its shingles fall into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, params.words) for t in byte_texts(batch.column(1))]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            sketches = pa.array([bucket_counts(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, sketches], names=["cid", "text", "n", "sketch"])

    chosen = known.join(wanted, "cid").groupBy("cid").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"))
    chosen = chosen.select("cid", F.col("at.doc_id").alias("other_id"), F.col("at.text_hash").alias("other_hash"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text")
    )
    same = (F.col("text_hash") == F.col("other_hash")) & F.col("doc_id").eqNullSafe(F.col("other_id"))
    chosen = stored(chosen, "chosen-documents")
    # only texts that may be wanted are shuffled
    wanted_keys = Bloom.of(chosen, F.coalesce("other_id", F.lit(0)), F.col("other_hash"))
    maybe, _ = wanted_keys.split(rows, F.coalesce("doc_id", F.lit(0)), F.col("text_hash"))
    texts = maybe.join(chosen, same).select("cid", "text").dropDuplicates(["cid"])
    return texts.mapInArrow(run, "cid bigint, text string, n bigint, sketch binary")


def bucket_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles in each of 128 buckets, modulo 256."""
    counts = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    return (counts & 255).astype(np.uint8)


def may_link(a_n: np.ndarray, b_n: np.ndarray, a_sketch: np.ndarray, b_sketch: np.ndarray, percent: int) -> np.ndarray:
    """False only where sizes or bucket counts prove more differences than a link allows."""
    apart = a_sketch - b_sketch  # modulo 256
    differences = np.minimum(apart, -apart).astype(np.int64).sum(axis=1)
    both = a_n + b_n
    differences = np.maximum(differences, np.abs(a_n - b_n))
    return (100 + percent) * differences <= (100 - percent) * both


def near(pairs: DataFrame, texts: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs (a, b) that sizes and bucket counts do not rule out; no text moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
            sketches = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BUCKETS) for i in (4, 5)]
            keep = pa.array(may_link(*sizes, *sketches, params.percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(keep)

    one = texts.select(F.col("cid").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    two = texts.select(F.col("cid").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    return joined.mapInArrow(run, "a bigint, b bigint")


def linked(pairs: DataFrame, texts: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, None
            for first, second in zip(byte_texts(batch.column(2)), byte_texts(batch.column(3)), strict=True):
                if first != last:
                    last, left = first, shingle_set(first, params.words)
                right = shingle_set(second, params.words)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * shared >= params.percent * (len(left) + len(right) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("cid").alias("b"), F.col("text").alias("b_text"))
    two = texts.select(F.col("cid").alias("a"), F.col("text").alias("a_text"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint")


def _clusters(groups: DataFrame, params: JoinParams) -> DataFrame:
    """(cid, cluster): classes that large groups connect."""
    sizes = Window.partitionBy("sig")
    large = groups.withColumn("members", F.count(F.lit(1)).over(sizes)).where(F.col("members") >= params.large)
    return stored(component_labels(large.select(F.col("pivot").alias("a"), F.col("cid").alias("b"))).toDF("cid", "cluster"), "clusters")


def _pairs_of_small_groups(groups: DataFrame, labels: DataFrame, clusters: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs (a, b) of different components within groups of a bounded size, unless one cluster holds both."""
    known = labels.join(clusters, "cid", "left").select("cid", "comp", F.coalesce("cluster", "cid").alias("cluster"))
    rows = groups.select("sig", "cid").union(groups.select("sig", F.col("pivot").alias("cid")).distinct())
    named = rows.join(stored(known, "known-classes"), "cid")
    group = Window.partitionBy("sig")
    mixed = [F.min(c).over(group) != F.max(c).over(group) for c in ("comp", "cluster")]
    # a large group lies in one cluster, so what is left is small
    still = named.withColumn("still", mixed[0] & mixed[1]).where("still").select("sig", "cid", "comp", "cluster")
    still = stored(still, "open-groups")
    a, b = still.alias("a"), still.alias("b")
    apart = (F.col("a.comp") != F.col("b.comp")) & (F.col("a.cluster") != F.col("b.cluster"))
    same = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.cid") < F.col("b.cid"))
    return a.join(b, same & apart).select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")).distinct()


def _differences(clusters: DataFrame, texts: DataFrame, params: JoinParams) -> DataFrame:
    """(cluster, cid, n, added, removed): how each member differs from a centre of its cluster.

    The centre holds the shingles of more than half of a bounded number of
    members.  Any set would do; one that is near to many members leaves them few
    differences.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, params.words).view(np.int64) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["cluster", "own"])

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added, removed = [], []
            for text, centre in zip(byte_texts(batch.column(3)), batch.column(4).to_pylist(), strict=True):
                own = shingle_set(text, params.words).view(np.int64)
                centre = np.array(centre or [], np.int64)
                added.append(np.setdiff1d(own, centre))
                removed.append(np.setdiff1d(centre, own))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (added, removed)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["cluster", "cid", "n", "added", "removed"])

    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("cid"), "cid"))
    few = stored(clusters.withColumn("place", place).where(F.col("place") <= params.large).drop("place"), "centre-members")
    own = few.join(texts.select("cid", "text"), "cid").select("cluster", "text").mapInArrow(sets, "cluster bigint, own array<bigint>")
    having = own.select("cluster", F.explode("own").alias("h")).groupBy("cluster", "h").agg(F.count(F.lit(1)).alias("having"))
    sizes = few.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    most = having.join(sizes, "cluster").where(F.col("having") * 2 > F.col("members"))
    # a written table, so that a large cluster's side of the join can be split
    centres = stored(most.groupBy("cluster").agg(F.collect_list("h").alias("centre")), "centres")
    members = clusters.join(texts.select("cid", "n", "text"), "cid")
    rows = members.join(centres, "cluster", "left").select("cluster", "cid", "n", "text", "centre")
    schema = "cluster bigint, cid bigint, n bigint, added array<bigint>, removed array<bigint>"
    return stored(rows.mapInArrow(against, schema), "differences")


def _pairs_of_clusters(clusters: DataFrame, texts: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs (a, b) that connect whatever links within large clusters; about as many as there are members.

    Two members differ in what their differences from the centre do not share.
    With d differences and n shingles let u = (100 + percent) d - (100 - percent) n;
    they link just if u + u' <= 2 (100 + percent) shared.  The hub has the least
    u.  Whoever has u + u(hub) <= 0 links with the hub, and so do both ends of a
    link that needs nothing shared.  Every other member must share some of its
    differences with its partner, and at most its removed shingles are shared
    removals: so it needs a number of added ones, or else of any.  Looking up its
    rarest differences but that number finds all partners.
    """
    scale, part = 100 + params.percent, 100 - params.percent
    rows = _differences(clusters, texts, params)
    rows = rows.withColumns({"a": F.size("added").cast("bigint"), "r": F.size("removed").cast("bigint")})
    rows = rows.withColumn("u", (F.col("a") + F.col("r")) * scale - F.col("n") * part)
    hubs = rows.groupBy("cluster").agg(F.min("u").alias("least_u"), F.min_by("cid", F.struct("u", "cid")).alias("hub"))
    # the least that u' - 2 scale min(r, r') comes to: partners with as few removals or fewer, and with more
    by_removed = rows.groupBy("cluster", "r").agg(F.min("u").alias("u"))
    fewer = Window.partitionBy("cluster").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    more = Window.partitionBy("cluster").orderBy("r").rowsBetween(1, Window.unboundedFollowing)
    own_removed = F.col("r") * (2 * scale)
    least = F.least(F.min(F.col("u") - own_removed).over(fewer), F.min("u").over(more) - own_removed)
    bounds = stored(by_removed.select("cluster", "r", least.alias("least_v")), "bounds")
    rows = rows.join(stored(hubs, "hubs"), "cluster").join(bounds, ["cluster", "r"])
    central = F.col("u") + F.col("least_u") <= 0
    star = rows.where(central & (F.col("cid") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    # how many added ones, or differences of any kind, a partner must share
    need_added = F.ceil((F.col("u") + F.col("least_v")) / (2 * scale))
    need_any = F.ceil((F.col("u") + F.col("least_u")) / (2 * scale))
    by_added = need_added >= 1
    size = F.when(by_added, F.col("a")).otherwise(F.col("a") + F.col("r"))
    rows = rows.withColumns(
        {
            "by_added": by_added,
            "size": size,
            "looked_up": F.when(central, F.lit(0)).otherwise(size - F.when(by_added, need_added).otherwise(need_any) + 1),
            "added": F.transform("added", lambda h: F.struct(h.alias("h"), F.lit(True).alias("is_added"))),
            "removed": F.transform("removed", lambda h: F.struct(h.alias("h"), F.lit(False).alias("is_added"))),
        }
    )
    # dealt evenly before every difference becomes a row
    spread = rows.drop("n", "least_u", "least_v", "hub").repartition("cid")
    each = spread.withColumn("d", F.explode(F.concat("added", "removed"))).drop("added", "removed").select("*", "d.*").drop("d")
    having = F.count(F.lit(1)).over(Window.partitionBy("cluster", "h"))
    counts = F.col("is_added") | ~F.col("by_added")
    rarest = Window.partitionBy("cluster", "cid").orderBy(counts.desc(), "having", "h")
    each = each.withColumn("having", having).withColumn("rank", F.row_number().over(rarest))
    index = stored(each.where("having > 1"), "difference-index")
    x, y = index.where(counts & (F.col("rank") <= F.col("looked_up"))).alias("x"), index.alias("y")
    shared = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.cid") != F.col("y.cid"))
    # of a pair's first common difference, what is left must hold all they have to share
    left = F.col("x.size") - F.col("x.rank") + 1
    any_shared = (F.col("x.u") + F.col("y.u")) / (2 * scale)
    added_shared = any_shared - F.least("x.r", "y.r")
    enough = F.when(F.col("x.by_added"), added_shared <= F.least(left, F.col("y.a"))).otherwise(
        any_shared <= F.least(left, F.col("y.a") + F.col("y.r"))
    )
    pairs = x.join(y, shared & enough).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))
    return star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(pairs).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: the components they connect are contracted."""
    one, two = labels.toDF("a", "a_comp"), labels.toDF("b", "b_comp")
    between = links.join(one, "a").join(two, "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    step = component_labels(between).toDF("comp", "next")
    merged = labels.join(step, "comp", "left").select("cid", F.coalesce("next", "comp").alias("comp"))
    return stored(merged, "labels")


def join_components(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    known = stored(classes(docs, params), "classes")
    groups = stored(signature_groups(signature_rows(docs, params)).distinct(), "signature-groups")
    wanted = groups.select("cid").union(groups.select(F.col("pivot").alias("cid"))).distinct()
    wanted = stored(wanted, "candidate-classes")
    texts = stored(class_texts(docs, known, wanted, params), "class-texts")
    tested = stored(groups.select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct(), "candidates")
    links = stored(linked(stored(near(tested, texts, params), "near"), texts, params), "links")
    labels = _merged(wanted.select("cid", F.col("cid").alias("comp")), links)
    clusters = _clusters(groups, params)
    pairs = _pairs_of_small_groups(groups, labels, clusters, params)
    several = clusters.join(labels, "cid").groupBy("cluster").agg(F.min("comp").alias("one"), F.max("comp").alias("two"))
    still = stored(clusters.join(several.where("one <> two").select("cluster"), "cluster").select("cid", "cluster"), "open-clusters")
    if not still.isEmpty():
        pairs = pairs.union(_pairs_of_clusters(still, texts, params)).distinct()
    new = stored(pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
    labels = _merged(labels, linked(stored(near(new, texts, params), "near"), texts, params))
    return _named(known, labels)


def _named(known: DataFrame, labels: DataFrame) -> DataFrame:
    """The smallest id of each component, given to every document in it."""
    smallest = known.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    roots = smallest.join(labels, "cid", "left").select("cid", "least", F.coalesce("comp", "cid").alias("comp"))
    ids = roots.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = roots.join(ids, "comp").select("cid", "component_id")
    with_words = known.where("cid is not null").join(named, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    blank = known.where("cid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(blank)


def _apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose id is in the column ``doc_id`` of ``ids``, and all others; texts move only where they may be in it."""
    other = fresh_name(docs, "other_id")
    named = ids.select(F.col("doc_id").alias(other))
    own = F.col("doc_id").cast("bigint")
    maybe, rest = Bloom.of(ids, "doc_id").split(docs, own)
    same = own == F.col(other)
    return maybe.join(named, same, "left_semi"), rest.unionByName(maybe.join(named, same, "left_anti"))


def without_near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; rows without an id stay.

    A repeated row is one document: where an id occurs several times, one of its
    rows with the smallest text fingerprint stays.
    """
    found = stored(join_components(docs, params), "components")
    goes = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    repeated = stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    _, kept = _apart(docs, goes)
    if repeated.isEmpty():
        return kept
    often, once = _apart(kept, repeated)
    # partial minima are taken before the shuffle, so a row repeated very often is no hot key
    one = often.groupBy(F.col("doc_id").alias("key_")).agg(
        F.min_by(F.struct(*[F.col(quoted(c)) for c in docs.columns]), text_hash()).alias("row_")
    )
    return once.unionByName(one.select(*[F.col("row_." + quoted(c)) for c in docs.columns]))
