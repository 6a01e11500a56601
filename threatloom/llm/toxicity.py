"""Toxicity by the nearest labelled examples under TF-IDF cosine over whole texts.

Fitting reads a bounded sample of labelled documents.  Every word of these
examples is a term, weighed by its document frequency in the whole corpus.
Words, how they begin, and whether the same occurs twice count for more, as
terms of their own, where toxic examples have them clearly more often than
other examples.  That is a further weight: no text is left out for having none
of them, so a copy of an example always finds it.

The examples form a block-max inverted index.  They are put in an order in which
alike ones are neighbours and cut into blocks; for each term that many examples
have, the largest weight in every block is kept.  Postings of rare terms are
added up for all examples.  What common terms can add to a block is bounded by one
small product, blocks are read from the highest bound down, and a block whose
bound is below the fifteenth cosine so far is never multiplied: the neighbours
are exactly those of comparing with every example.

The vote is the mean label of the neighbours, weighted by how near they are, so
steeply that a copy outvotes all others, with the share of toxic examples among
those without any term as a prior (of all, if each has one).  A logistic curve
turns it into a score; it is fitted on votes of examples that leave themselves
out, under weights of terms learned from the other half of the examples.  Evidence is the neighbours' ids and the terms shared
with them, the weightiest first.  Words that no example has count for the length
of a text, as those of no document.

Null and empty texts have no terms and get the score of an empty vote, as does
every text that shares no word with any example.  Ties between neighbours go to
the earlier example.  Repeated rows score alike.  Without labels of both kinds
the score is the share of toxic examples, one half without any; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.batches import Texts, bounded_sample, byte_texts, quoted, remainder, with_struct
from threatloom.llm.licenses import license_words as words_of
from threatloom.session import stored

HELD_OUT_OF, HELD_OUT_IS = 5, 0
FIELDS = "score double, vote double, neighbours array<bigint>, terms array<string>"


@dataclass(frozen=True)
class ToxicityParams:
    """``examples`` bounds the labelled sample; shares of a term that counts for more differ by ``least_z`` deviations.

    ``block`` examples share their bounds.  Terms that more than a share ``common``
    of the examples have are bounded, the postings of the others are added up.
    """

    examples: int = 8192
    least_docs: int = 8
    least_z: float = 6.0
    neighbours: int = 15
    block: int = 32
    common: float = 0.0625
    nearness: float = 0.02


PREFIXES = (4, 5, 6, 7)
TWICE = "+"
# texts whose cosines are computed together
TOGETHER = 256


def pieces(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def text_words(text: bytes) -> list[str]:
    return [w.decode() for w in words_of(text)]


def all_terms(text: bytes) -> set[str]:
    """Every piece of a text, and once more with a mark if it occurs twice."""
    counts = Counter(piece for word in text_words(text) for piece in pieces(word))
    return {*counts, *(piece + TWICE for piece, n in counts.items() if n > 1)}


class Vocabulary:
    """Finds given terms in texts; remembers a bounded number of words."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        bases = sorted({t.removesuffix(TWICE) for t in terms})
        self.base = {b: i for i, b in enumerate(bases)}
        place = {t: i for i, t in enumerate(terms)}
        self.once = np.array([place.get(b, -1) for b in bases], np.int32)
        self.twice = np.array([place.get(b + TWICE, -1) for b in bases], np.int32)
        self.starts = {b[: PREFIXES[0]] for b in bases if b.endswith("*")}
        self.seen: dict[bytes, int] = {}
        self.several: list[tuple[int, ...]] = []

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}, "several": []}

    def _find(self, word: bytes) -> int:
        """The term of a word that stands for nothing else, -1 for a word without a term; below, the place of all its bases."""
        text = word.decode()
        if text[: PREFIXES[0]] in self.starts:
            found = tuple(self.base[p] for p in pieces(text) if p in self.base)
        else:
            found = (self.base[text],) if text in self.base else ()
        if not found:
            return -1  # words of junk are mostly unique: not remembered
        if len(found) == 1 and text in self.base and self.twice[found[0]] < 0:
            code = int(self.once[found[0]])
        else:
            self.several.append(found)
            code = -1 - len(self.several)
        self.seen[word] = code
        return code

    def all_counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's terms in order, how often each occurs, and how often each word that has no term."""
        if len(self.seen) > 300_000:
            self.seen, self.several = {}, []
        words = Counter(words_of(text))
        codes = list(map(self.seen.get, words))
        if None in codes:
            codes = [self._find(w) if c is None else c for w, c in zip(words, codes, strict=True)]
        codes = np.array(codes, np.int64)
        n = np.fromiter(words.values(), np.int64, len(words))
        own, counts = codes[codes >= 0], n[codes >= 0]
        mixed = np.flatnonzero(codes < -1)
        if len(mixed):
            sums: dict[int, int] = defaultdict(int)
            for code, times in zip(codes[mixed].tolist(), n[mixed].tolist(), strict=True):
                for base in self.several[-2 - code]:
                    sums[base] += times
            more = [(self.once[b], k) for b, k in sums.items()] + [(self.twice[b], k) for b, k in sums.items() if k > 1]
            more = np.array([m for m in more if m[0] >= 0], np.int64).reshape(-1, 2)
            own, counts = np.concatenate([own, more[:, 0]]), np.concatenate([counts, more[:, 1]])
        order = np.argsort(own)
        return own[order], counts[order], n[codes == -1]


def alike_order(own: list[np.ndarray], weights: list[np.ndarray], block: int) -> np.ndarray:
    """Examples in an order in which alike ones are neighbours: halved again and again along their widest spread."""
    r = np.random.RandomState(7)
    wide, narrow = 4096, 32
    rays = r.standard_normal((wide, narrow))
    points = np.array([w @ rays[o % wide] for o, w in zip(own, weights, strict=True)]).reshape(len(own), narrow)
    parts, done = [np.arange(len(own))], []
    while parts:
        part = parts.pop()
        if len(part) <= block:
            done.append(part)
            continue
        spread = points[part] - points[part].mean(axis=0)
        axis = np.linalg.svd(spread.T @ spread)[0][:, 0]
        part = part[np.argsort(spread @ axis, kind="stable")]
        # whole blocks on one side
        half = -(-len(part) // (2 * block)) * block
        parts += [part[half:], part[:half]]
    return np.concatenate([np.zeros(0, np.int64), *done]).astype(np.int64)


@dataclass
class Index:
    """Inverted index over the examples: postings of rare terms, block maxima and weights of common ones.

    Terms and counts of the examples are sent to the tasks, which arrange them.
    """

    vocabulary: Vocabulary
    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    rank: np.ndarray  # of each place, for ties
    terms: np.ndarray  # of all examples, one behind the other
    counts: np.ndarray
    ends: np.ndarray  # of each example's terms
    params: ToxicityParams
    unknown: float = 0.0  # idf of a word that no example has
    prior: float = 0.5
    curve: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def of(
        cls, vocabulary: Vocabulary, idf: np.ndarray, examples: list[tuple], params: ToxicityParams, unknown: float = 0.0
    ) -> Index:
        """``examples`` are (id, label, terms, counts); the curve is still to be fitted."""
        own = [np.asarray(e[2], np.int32) for e in examples]
        counts = [np.asarray(e[3], np.int32) for e in examples]
        rank = alike_order(own, [unit(o, c, idf) for o, c in zip(own, counts, strict=True)], params.block)
        terms = np.concatenate([np.zeros(0, np.int32), *(own[r] for r in rank)])
        times = np.concatenate([np.zeros(0, np.int32), *(counts[r] for r in rank)])
        ends = np.cumsum([len(own[r]) for r in rank], dtype=np.int64)
        labels = np.array([examples[r][1] for r in rank], float)
        ids = np.array([examples[r][0] for r in rank], np.int64)
        index = cls(vocabulary, idf, labels, ids, rank, terms, times, ends, params, unknown)
        bare = [e[1] for e in examples if not len(e[2])] or labels.tolist()
        index.prior = (sum(bare) + 0.5) / (len(bare) + 1)
        index._arrange()
        return index

    def _arrange(self) -> None:
        """Postings of rare terms by term; weights of common terms by place, and the largest of each block."""
        size, n = self.params.block, len(self.ids)
        places = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.ends, prepend=0))
        weights = (1 + np.log(self.counts.astype(float))) * self.idf[self.terms]
        length = np.sqrt(np.bincount(places, weights=weights**2, minlength=n))
        weights = weights / np.where(length > 0, length, 1)[places]
        having = np.bincount(self.terms, minlength=len(self.idf))
        often = having > self.params.common * n
        self.common = np.where(often, np.cumsum(often) - 1, -1)
        blocks = -(-n // size)
        here = often[self.terms]
        self.matrix = np.zeros((int(often.sum()), blocks * size))
        self.matrix[self.common[self.terms[here]], places[here]] = weights[here]
        self.highest = self.matrix.reshape(len(self.matrix), blocks, size).max(axis=2, initial=0.0)
        rare = np.flatnonzero(~here)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.where(often, 0, having))])
        self.places, self.weights = places[rare], weights[rare]

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._arrange()

    @cached_property
    def marked(self) -> np.ndarray:
        """One flag for each term, all down."""
        return np.zeros(len(self.idf), bool)

    def _weighed(self, texts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """For each (terms, counts, counts of words without a term) its common terms, and the sums of its rare ones by place."""
        dense = np.zeros((len(texts), len(self.matrix)))
        sums = np.zeros((len(texts), self.matrix.shape[1]))
        for n, (own, counts, unknown) in enumerate(texts):
            own = np.asarray(own, np.int64)
            weights = unit(own, counts, self.idf, self.unknown * (1 + np.log(np.asarray(unknown, float))))
            row = self.common[own]
            dense[n, row[row >= 0]] = weights[row >= 0]
            own, weights = own[row < 0], weights[row < 0]
            low = self.first[own]
            size = self.first[own + 1] - low
            at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            added = np.repeat(weights, size) * self.weights[at]
            sums[n] = np.bincount(self.places[at], weights=added, minlength=sums.shape[1])
        return dense, sums

    def cosines(self, texts: list[tuple]) -> np.ndarray:
        """Cosines of each text with every example, none left out."""
        dense, sums = self._weighed(texts)
        return (sums + dense @ self.matrix)[:, : len(self.ids)].round(12)

    def nearest(self, own: list[int], counts: list[int], without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, as the examples were given, and cosines of the examples nearest to one text."""
        leave = [int(np.flatnonzero(self.rank == without)[0])] if without >= 0 else None
        places, cosines = next(self.nearest_of([(own, counts, ())], leave))
        return self.rank[places], cosines

    def nearest_of(self, texts: list[tuple], without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of each text's nearest examples, nearest first; exact.

        ``without`` leaves one place out for each text.
        """
        wanted, size = self.params.neighbours, self.params.block
        dense, sums = self._weighed(texts)
        rows, blocks = len(texts), self.highest.shape[1]
        # rare terms exactly, common ones at their most: no example of the block is nearer
        upper = dense @ self.highest + sums.reshape(rows, blocks, size).max(axis=2, initial=0.0) + 1e-9
        exact = np.full((rows, blocks, size), -1.0)
        read = np.zeros((rows, blocks), bool)

        def multiply(due: np.ndarray) -> None:
            for block in np.flatnonzero(due.any(axis=0)).tolist():
                some = np.flatnonzero(due[:, block])
                span = slice(block * size, (block + 1) * size)
                # alike copies tie, in whatever order their products were added
                exact[some, block] = (sums[some, span] + dense[some] @ self.matrix[:, span]).round(12)
            for n, place in enumerate(without or ()):
                exact[n, place // size, place % size] = -1.0
            read[due] = True

        first = max(1, -(-2 * wanted // size))
        if blocks > first:
            due = np.zeros((rows, blocks), bool)
            np.put_along_axis(due, np.argpartition(-upper, first, axis=1)[:, :first], True, axis=1)
            multiply(due)
            flat = exact.reshape(rows, -1)
            least = -np.partition(-flat, wanted - 1, axis=1)[:, wanted - 1]
            multiply((upper >= least[:, None]) & (upper > 1e-9) & ~read)
        else:
            multiply(np.ones((rows, blocks), bool))
        for n in range(rows):
            yield self._best(exact[n], read[n])

    def _best(self, exact: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = self.params.neighbours
        blocks = np.flatnonzero(read)
        scores = exact[blocks].ravel()
        least = -np.partition(-scores, wanted - 1)[wanted - 1] if len(scores) > wanted else 0.0
        found = np.flatnonzero((scores >= least) & (scores > 0))
        places = blocks[found // self.params.block] * self.params.block + found % self.params.block
        scores = scores[found]
        order = np.lexsort((self.rank[places], -scores))[:wanted]
        return places[order], scores[order]

    def votes(self, texts: list[tuple], without: Iterable[int] = ()) -> Iterator[tuple[float, np.ndarray]]:
        """For each text the weighted share of toxic neighbours, with a prior of weight one, and their places."""
        leave = list(without)
        for low in range(0, len(texts), TOGETHER):
            part = texts[low : low + TOGETHER]
            for places, cosines in self.nearest_of(part, leave[low : low + TOGETHER] or None):
                weight = cosines**2 / (1 - np.minimum(cosines, 1) + self.params.nearness)
                yield float((weight @ self.labels[places] + self.prior) / (weight.sum() + 1)), places

    def shared(self, text: tuple, places: list[int]) -> np.ndarray:
        """Numbers of the text's terms that one of the examples has, the weightiest first."""
        own = np.asarray(text[0], np.int64)
        weights = unit(own, text[1], self.idf)
        if not len(own) or not len(places):
            return np.zeros(0, np.int64)
        theirs = np.concatenate([self.terms[self.ends[p - 1] if p else 0 : self.ends[p]] for p in places])
        self.marked[theirs] = True
        has = self.marked[own] & (weights > 0)
        self.marked[theirs] = False
        order = np.argsort(-weights[has], kind="stable")
        return own[has][order]

    def score(self, vote: float) -> float:
        slope, shift = self.curve
        logit = np.log(vote / (1 - vote)) if 0 < vote < 1 else 40.0 * (2 * (vote >= 0.5) - 1)
        return float(1 / (1 + np.exp(-np.clip(slope * logit + shift, -40, 40))))


def unit(own: np.ndarray, counts: np.ndarray, idf: np.ndarray, more: np.ndarray = ()) -> np.ndarray:
    """TF-IDF weights, of length one together with weights ``more``; term frequencies are dampened."""
    weights = (1 + np.log(np.asarray(counts, float))) * idf[own]
    length = np.sqrt((weights**2).sum() + (np.asarray(more, float) ** 2).sum())
    return weights / length if length else weights


def logistic(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the votes' log-odds, by Newton's method with a slight ridge."""
    x = np.log(votes / (1 - votes))
    design = np.column_stack([x, np.ones_like(x)])
    beta = np.array([1.0, 0.0])
    ridge = np.diag([1e-2, 1e-2])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (labels - p) - ridge @ (beta - [1.0, 0.0])
        beta = beta + np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, gradient)
    return (float(beta[0]), float(beta[1])) if np.isfinite(beta).all() and beta[0] > 0 else (1.0, 0.0)


def labelled_sample(labels: DataFrame, params: ToxicityParams) -> DataFrame:
    """(doc_id, toxic) of at most ``examples`` rows that may be learned from."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    rows = rows.where(remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT_IS)
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return bounded_sample(rows, "doc_id", params.examples)


def telling_terms(examples: DataFrame, params: ToxicityParams) -> dict[str, float]:
    """Terms that a clearly larger share of toxic examples has than of other ones, and by how many deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having: Counter = Counter()
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                having.update(all_terms(text))
        columns = [pa.array(list(having), pa.string()), pa.array(list(having.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "docs"])

    toxic = examples.where("toxic = 1")
    counted = toxic.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, docs bigint")
    common = counted.groupBy("term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= params.least_docs)
    # of a bounded sample, these too are few
    found = sorted((r["term"], r["docs"]) for r in common.collect())
    if not found:
        return {}
    terms, with_it = [t for t, _ in found], np.array([n for _, n in found], float)
    n_toxic = toxic.count()
    others, n_other = term_frequencies(examples.where("toxic = 0"), terms)
    if not n_other:
        return {}
    share = (with_it + others) / (n_toxic + n_other)
    apart = with_it / n_toxic - others / n_other
    deviation = np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_other))
    return {
        t: a / d if d else params.least_z
        for t, a, d in zip(terms, apart.tolist(), deviation.tolist(), strict=True)
        if a >= params.least_z * d and a > 0
    }


def example_words(examples: DataFrame) -> list[str]:
    """Every word of the examples; of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[bytes] = set()
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                words.update(words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string())], names=["word"])

    found = examples.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string").distinct()
    return found.toArrow().column(0).to_pylist()


def term_frequencies(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        having, read = np.zeros(len(vocabulary.terms) + 1, np.int64), 0
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                having[vocabulary.all_counts(text)[0]] += 1
            read += batch.num_rows
        having[-1] = read
        some = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(having[some])], names=["term", "docs"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term bigint, docs bigint")
    found = counted.groupBy("term").agg(F.sum("docs")).toArrow()
    sent.destroy()
    having = np.zeros(len(terms) + 1)
    having[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return having[:-1], int(having[-1])


def fit_index(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Index:
    """The index over a bounded, labelled sample; only ids, labels and term counts of the sample reach the driver."""
    sample = F.broadcast(labelled_sample(labels, params))
    examples = docs.select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id"])
    examples = stored(examples.withColumn("half", half_of(F.col("doc_id"))), "toxicity-examples")
    telling = [telling_terms(part, params) for part in (examples, examples.where("half = 0"), examples.where("half = 1"))]
    vocabulary = Vocabulary(sorted({*example_words(examples), *telling[0], *telling[1], *telling[2]}))
    having, total = term_frequencies(docs, vocabulary.terms)
    # words weigh something anyway, other terms only where they tell
    plain = np.array([0.0 if t.endswith(("*", TWICE)) else 1.0 for t in vocabulary.terms])
    known = np.log((1 + total) / (1 + having)) + 1
    idf = [known * np.array([t.get(v, p) for v, p in zip(vocabulary.terms, plain.tolist(), strict=True)]) for t in telling]

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        vocabulary = sent.value

        def packed(texts: Texts) -> list:
            counted = [vocabulary.all_counts(t) for t in texts]
            return [[np.array(c[i], np.int32).tobytes() for c in counted] for i in range(2)]

        return packed

    counted, name = with_struct(examples, "text", "terms binary, counts binary", make, ["doc_id", "toxic", "half"])
    rows = counted.select("doc_id", "toxic", "half", f"{name}.*").collect()
    sent.destroy()
    rows = sorted((r[0], r[1], np.frombuffer(r[3], np.int32), np.frombuffer(r[4], np.int32), r[2]) for r in rows)
    unknown = float(np.log(1 + total) + 1)
    curve = fitted_curve(vocabulary, idf[1:], rows, params, unknown)
    index = Index.of(vocabulary, idf[0], rows, params, unknown)
    index.curve = curve
    return index


def half_of(key: Column) -> Column:
    """Which half of the examples a document belongs to, when weights of terms are learned from the other."""
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(2)).cast("int")


def fitted_curve(
    vocabulary: Vocabulary, idf: list[np.ndarray], rows: list[tuple], params: ToxicityParams, unknown: float
) -> tuple[float, float]:
    """The curve over votes that each example's own label had no part in."""
    labels, votes = [], []
    if len({r[1] for r in rows}) < 2:
        return 1.0, 0.0
    for half in (0, 1):
        index = Index.of(vocabulary, idf[1 - half], rows, params, unknown)
        place = np.argsort(index.rank)
        mine = [n for n, r in enumerate(rows) if r[4] == half]
        texts = [(rows[n][2], rows[n][3], ()) for n in mine]
        votes += [vote for vote, _ in index.votes(texts, place[mine].tolist())]
        labels += [rows[n][1] for n in mine]
    return logistic(np.array(votes), np.array(labels, float))


def score_toxicity(docs: DataFrame, index: Index, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Columns ``keep`` (all by default) and a struct with score, vote and evidence; its name.

    The index is a broadcast variable, of which a worker holds one for all its tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        index = sent.value
        names = pa.array(index.vocabulary.terms, pa.string())

        def score(texts: Texts) -> list:
            rows, evidence = [], []
            for low in range(0, len(texts), TOGETHER):
                counted = [index.vocabulary.all_counts(t) for t in texts[low : low + TOGETHER]]
                for text, (vote, places) in zip(counted, index.votes(counted), strict=True):
                    evidence.append(index.shared(text, places.tolist()))
                    rows.append((index.score(vote), vote, index.ids[places].tolist()))
            if not rows:
                return [[]] * 4
            # terms are copied from one column to the other, never made Python texts again
            ends = np.cumsum([0, *map(len, evidence)], dtype=np.int32)
            terms = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate(evidence))))
            return [*zip(*rows, strict=True), terms]

        return score

    return with_struct(docs, "text", FIELDS, make, docs.columns if keep is None else keep)


def toxicity_report(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted, vote, neighbours, terms) for every document."""
    scored, name = score_toxicity(docs, fit_index(docs, labels, params), ["doc_id"])
    held_out = F.coalesce(remainder(F.col(quoted("doc_id")), HELD_OUT_OF) == HELD_OUT_IS, F.lit(False))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        f"{name}.score",
        (F.col(f"{name}.score") >= 0.5).cast("int").alias("predicted"),
        f"{name}.vote",
        f"{name}.neighbours",
        f"{name}.terms",
    )
