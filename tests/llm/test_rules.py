"""Quality rules, licences and URLs against brute force."""

import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from tests.llm.helpers import LABELS, awkward, clashing, documents, lower, prose, words
from threatloom.llm import licenses, license_rules, quality_rules, url_filter


def counted(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
    )


def test_base_counts():
    texts = ["", " \n", "a b c a b c", "x " * 9, "é|ü <b>\n\né|ü <b>\n ", "a a a a", "a b\x1cc d\x85e", "\x00 $ %%"]
    texts += [" ".join(prose(i, 60, 5)) + "\n" + " ".join(prose(i, 9, 3)) for i in range(40)]
    for text in texts:
        assert quality_rules.base_counts(text.encode()) == counted(text), text


def test_verdicts_separate_trusted_from_noise(spark):
    good = [(i, " ".join(prose(i, 80))) for i in range(60)]
    noise = [(100 + i, " | ".join(f"{x}$$$" for x in prose(i, 80))) for i in range(15)]
    docs = documents(spark, [*good, *noise, (200, "too short"), (201, "again " * 80)])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in noise], LABELS)
    judged, name = quality_rules.quality_verdicts(docs, labels)
    kept = {r["doc_id"] for r in judged.where(f"{name}.kept").select("doc_id").collect()}
    assert kept == {i for i, _ in good}
    failed = {r["doc_id"] for r in judged.where(f"{name}.base_failed").select("doc_id").collect()}
    assert failed == {200, 201}


def test_ratios_are_those_of_two_multinomials(spark):
    params = quality_rules.QualityParams(buckets=256, orders=(2,))
    docs = documents(spark, ["aab", "abab", "zz"])
    trusted = spark.createDataFrame([(1,)], "doc_id bigint")
    ratios = quality_rules.log_ratios(quality_rules.ngram_counts(docs, trusted, params), params)
    raw, target = np.zeros(256), np.zeros(256)
    for text, to in (("aab", raw), ("abab", raw), ("zz", raw), ("abab", target)):
        np.add.at(to, quality_rules.hashed_ngrams(text.encode(), (2,), 256), 1)
    logs = lambda c: np.log((c + 0.5) / (c.sum() + 128))
    assert np.allclose(ratios, logs(target) - logs(raw))


def test_rules_on_awkward_rows(spark):
    docs, none = clashing(awkward(spark)), spark.createDataFrame([], LABELS)
    judged, name = quality_rules.quality_verdicts(docs, none)
    assert judged.count() == 10 and judged.where(f"{name}.kept").count() == 1
    assert licenses.license_report(docs).count() == 10
    empty = documents(spark, []).limit(0)
    judged, name = quality_rules.quality_verdicts(empty, none)
    assert judged.count() == 0 and licenses.license_report(empty).count() == 0


LICENSED = [
    "Under the MIT License. mit-license; MIT\nlicense and the MIT Licenses",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "GNU General Public License v3; general public license",
    "SPDX-License-Identifier: GPL-2.0-only",
    "the éMIT License, the MIT\u2003license",
    None,
    "",
    "mit license mit license",
]


def test_licence_phrases(spark):
    rows = {r["doc_id"]: r for r in licenses.license_report(documents(spark, LICENSED)).collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for i, text in enumerate(LICENSED):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
        places = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    assert rows[1]["labels"] == "apache,apache-2.0" and rows[2]["labels"] == "gpl,gpl-3.0" and rows[3]["labels"] == "gpl-2.0"


def test_containment_agrees_with_all_pairs():
    known = license_rules.rules()
    assert len(known) > 250 and len({r.name for r in known}) == len(known)
    r = np.random.RandomState(2)
    for _ in range(50):
        found = []
        for _ in range(40):
            first = int(r.randint(0, 60))
            found.append((known[r.randint(0, len(known))], first, first + int(r.randint(0, 12))))
        order = sorted(found, key=lambda d: (d[0].priority, d[1]))
        kept, wide = [], []
        for rule, a, b in order:
            inside = any(x <= a and b <= y for x, y in wide)
            if rule.base or not inside:
                kept.append((rule.name, a, b))
            if not inside:
                wide.append((a, b))
        assert sorted((x.name, a, b) for x, a, b in licenses.resolved(found)) == sorted(kept)


URLS = [
    "http://a.Example.ORG/es/x?y#z",
    "https://example.org/en/17",
    "https://notexample.org/en/17",
    "http://x.com/fr/1",
    "http://x.com/de/1",
    "http://x.com",
    "ftp://org/",
    "org/es/",
    "http://casino-win.example.net/en/1",
    "http://com:80/fr/",
    "https://b.org?x://c.com/de/",
    "https://www.example.org#/es/",
    "://org/a",
    "http://ORG/ES/",
    None,
    "",
]


def brute_url(url):
    head, cut, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest)[0] if cut else ""
    path = re.split("[?#]", rest[len(host) :])[0] if cut else ""
    host = lower(host)
    known = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]
    known += [("allow", "com", "/fr/"), ("block", "com", "/de/")]
    fits = [(len(h + p), h + p, v) for v, h, p in known if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=(0, None, None))[1:]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS)], "page_id bigint, url string, html string")
    for r in url_filter.filter_urls(pages, ["page_id", "html"]).collect():
        host, path, (rule, verdict) = brute_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        if rule:
            assert r["verdict"] == verdict
    assert url_filter.filter_urls(pages.limit(0), ["page_id"]).count() == 0


def test_index_finds_what_trying_every_rule_finds():
    known = [*url_filter.PAGE_RULES, *url_filter.method_rules()]
    index = url_filter.RuleIndex(known, {"org": 5, "com": 9, "example": 100})
    hosts = ["org", "a.example.org", "casino-win.example.com", "poker.x", "m.ads.y", "wiki.z.com", "x.edu", "xn--a.b", "a.wiki.b"]
    paths = ["", "/", "/es/", "/en/1", "/fr/", "/de/", "/wp-login.php", "/a/feed/", "/b/login", "/banner/1", "/calendar/2024", "/tag/x"]
    for page in (f"{h}{p}".encode() for h in hosts for p in paths):
        every = {r.text for r in known if re.match(r.regex.encode(), page, re.DOTALL)}
        assert {r.text for r in index.fitting(page)} == every, page


def test_all_good_labels_are_trusted(spark):
    """More than were once read: where every document is good, both models are the same."""
    ids = spark.range(20_500).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn("text", F.concat(F.lit("w"), F.sha2(F.col("doc_id").cast("string"), 256)))
    labels = ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            judged, name = quality_rules.quality_verdicts(docs, labels, keep=["doc_id"])
            far = judged.agg(F.max(F.abs(F.col(f"{name}.llr"))), F.count("*")).first()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert tuple(far) == (0.0, 20_500)


def forms(parsed):
    """Texts of every alternative of a parsed pattern, one character of each class, repeats at their bounds."""
    found = [""]
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            parts = [chr(value)]
        elif kind == "IN":
            parts = [chr(value[0][1][0] if str(value[0][0]) == "RANGE" else value[0][1])]
        elif kind == "BRANCH":
            parts = [t for branch in value[1] for t in forms(branch)]
        elif kind == "SUBPATTERN":
            parts = forms(value[-1])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            parts = [t * n for t in forms(inner) for n in {low, min(high, low + 1)}]
        else:
            assert kind == "ASSERT", kind
            parts = [""]
        found = [a + b for a in found for b in dict.fromkeys(parts)]
    return found


def test_every_form_of_a_rule_passes_its_own_gate():
    for rule in license_rules.rules():
        for form in forms(re._parser.parse(rule.pattern.pattern.decode())):
            line = form.encode() + b" "
            assert rule.pattern.fullmatch(line, 0, len(line)) or rule.pattern.match(line), form
            assert rule.keyword in line, (rule.name, rule.keyword, form)


def test_names_written_together_or_apart():
    scanner = licenses.Scanner(license_rules.rules())
    for text, label in (
        (b"beerware license", "beerware"),
        (b"beer ware license", "beerware"),
        (b"creative commons attribution share alike 3 0", "cc-by-sa-3.0"),
        (b"creative commons attribution share alike 4 0 international", "cc-by-sa-4.0"),
        (b"creative commons attribution sharealike 4 0", "cc-by-sa-4.0"),
        (b"machine executable object code generated by a source language processor", "bsl-1.0"),
    ):
        assert label in {rule.label for rule, _, _ in scanner.detect(licenses.license_words(text))}
