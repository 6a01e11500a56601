"""Small tables and brute-force answers for the training-data operators."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
WORD = "[^\x20\x09-\x0d]+"


def documents(spark, texts, first=0):
    """Rows of documents from texts, or from (id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids."""
    long = " ".join(f"w{i * 7919 % 30_000}x" for i in range(30_000))
    rows = [
        (1, "a b c d e f g h", None, None, None),
        (1, "a b c d e f g h", None, None, None),
        (1, "another text under the same id", "en", "s", 5),
        (None, "a b c d e f g h", "en", None, 3),
        (None, None, None, None, None),
        (2, None, "en", "s", 0),
        (3, "", "en", "s", 0),
        (4, " \t\n \r\n", "en", "s", 5),
        (5, long, "en", "s", len(long)),
        (6, "é" * 50 + "\u2028 \x1c\x85 ß\x00x", "fr", "s", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """Further columns whose names the operators use themselves."""
    names = ["found", "source_text", "kept", "score", "cid", "sig", "pos", "row", "bitmap", "text_hash", "comp", "leaks", "m", "gone_id", "often_id", "other_id", "c0", "h", "known", "a.b", "kept_text", "edge", "part"]
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(WORD, text)


def shingles(text, wide):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + wide]) for i in range(max(1, len(w) - wide + 1)))


def components(texts, wide, percent):
    """Smallest reachable id for each id, all pairs compared."""
    sets = {i: shingles(t, wide) for i, t in texts.items()}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def kept_lines(texts, min_docs, keep_first=False):
    """(lines, dropped, hash of what stays) by id."""
    lines = {i: (t or "").split("\n") for i, t in texts.items()}
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    having = Counter(k for ls in lines.values() for k in {key(line) for line in ls})
    seen, found = set(), {}
    for i in sorted(lines):
        stays = []
        for line in lines[i]:
            k = key(line)
            common = len(k) >= 1 and having[k] >= min_docs
            if not common or (keep_first and k not in seen):
                stays.append(line)
            seen.add(k)
        found[i] = (len(lines[i]), len(lines[i]) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest())
    return found


def prose(seed, n, vocabulary=500):
    r = random.Random(seed)
    return [f"v{r.randrange(vocabulary)}" for _ in range(n)]


def edited(tokens, seed, edits):
    r, out = random.Random(seed), list(tokens)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10_000)}"
    return out
