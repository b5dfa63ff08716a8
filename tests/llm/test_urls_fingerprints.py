from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tickweave.llm.fingerprint import added, fingerprints, in_buckets, likeness, spelt, vector
from tickweave.llm.q_rows import RULES, op6
from tickweave.llm.urls import url_filter

URLS = ["http://A.Example.NET/en/1?x", "https://example.net/de/2", "http://sub.b.org/fr/3#f", "http://b.com/de/4", "http://x.example.com/de/5", "nothing",
        None, "", "http://Host.org", "http://h.org?q=1", "a://b://c/d", "http://notexample.net/en/1", "http://ünder.org/a b/c"]
WANT = [("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de/2", "net/", "block"), ("sub.b.org", "/fr/3", "org/fr/", "allow"),
        ("b.com", "/de/4", None, "allow"), ("x.example.com", "/de/5", "example.com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("host.org", "", None, "allow"), ("h.org", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("notexample.net", "/en/1", "net/", "block"), ("ünder.org", "/a b/c", None, "allow")]


def test_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = url_filter(pages, spark.createDataFrame([], "page_id long, bad int"), RULES).orderBy("page_id").collect()
    assert [(g["host"], g["path"], g["rule"], g["verdict"]) for g in got] == WANT


def test_bad_templates_are_rejected(spark):
    """Two of the branches of one host are bad; alike branches are merged; one widely varying segment becomes a wildcard."""
    urls, bad = [], []
    for i in range(300):
        urls.append(f"http://h.com/{['news', 'spam', 'art'][i % 3]}/{i}")
        bad.append(int(i % 3 == 1))
    urls += [f"http://h.com/tag/name{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, None), (5, urls[5])], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit("x"), "template": F.lit("y"), "bad": F.lit(1)})
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad) if i < 240] + [(None, 1), (0, None), (1, 0)], "page_id long, bad int")
    got = {g["page_id"]: g for g in url_filter(pages, labels, []).collect()}
    assert len(got) == len(urls) + 1
    assert all((got[i]["verdict"] == "block") == (i < 300 and i % 3 == 1) for i in range(len(urls)))
    assert got[299]["template"] == "/art/*" and got[310]["template"] == "/tag/*/x" and got[0]["group"] == got[2]["group"]
    assert url_filter(pages.limit(0), labels, RULES).count() == 0


def test_supported_segments_stay(spark):
    """Beside a long tail of rare names, with digits, and below the sixth level."""
    kinds = [("wide", "spam", "news"), ("digit", "mp3", "v2"), ("a/b/c/d/e/f", "spam", "news")]
    rows = [(100 * k + i, f"http://h{k}.com/{at}/{[bad, good][i % 2]}/{i}", 1 - i % 2) for k, (at, bad, good) in enumerate(kinds) for i in range(100)]
    tail = [(1000 + i, f"http://h0.com/wide/rare{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(60)]
    pages = spark.createDataFrame([r[:2] for r in rows] + tail, "page_id long, url string")
    got = {g["page_id"]: g for g in url_filter(pages, spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad int"), []).collect()}
    assert len(got) == len(rows) + len(tail)
    for k, (at, bad, good) in enumerate(kinds):
        for i in range(100):
            g = got[100 * k + i]
            assert g["template"] == f"/{at}/{[bad, good][i % 2]}/*" and g["verdict"] == ["block", "allow"][i % 2]
    assert {got[1000 + i]["template"] for i in range(60)} == {"/wide/*/x"}


def test_merging_does_not_chain(spark):
    """30 sibling branches with bad shares evenly from 0 to 1: no group holds two that differ significantly."""
    names = [f"{chr(97 + i // 6)}{chr(97 + i % 6)}x" for i in range(30)]
    rows = [(200 * i + j, f"http://h.com/{name}/{j}", int(j < 200 * i / 29)) for i, name in enumerate(names) for j in range(200)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(10000 + i, f"http://h.com/q{chr(97 + i)}/1") for i in range(2)], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad int")
    got = url_filter(pages, labels, []).where("page_id < 10000").groupBy("template").agg(F.min("group").alias("group"), F.min("bad_share").alias("share")).collect()
    place = {g["template"]: (names.index(g["template"][1:4]), g["group"]) for g in got}
    assert len(place) == 30
    for i, a in place.values():
        for k, b in place.values():
            p, q = (200 * i / 29 + 5) / 210, (200 * k / 29 + 5) / 210
            error = (((p + q) / 2) * (1 - (p + q) / 2) * 2 / 210) ** 0.5
            assert a != b or abs(p - q) <= 2.2 * error
    assert all(abs(g["share"] - place[g["template"]][0] / 29) < 0.12 for g in got)


def test_every_page_has_one_row(spark):
    got = op6(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert got.count() == n and got.select("page_id").distinct().count() == n


def test_vectors_add(spark, prose):
    parts = [prose(i, 30) for i in range(4)]
    texts = ["\n".join(parts[:2]), "\n".join(parts[2:]), "\n".join(parts), "\n".join(parts[::-1]), "\n".join(parts[:3]), parts[2]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", vector("text").alias("v"))
    v = {r["i"]: r["v"] for r in rows.collect()}
    assert v[2] == v[3] != v[4] and len(v[0]) == 16 + 1 + 64 and all(0 <= x < 2**32 for x in v[2])
    pair = spark.createDataFrame([(v[0], v[1], v[2], v[4], v[5])], "a array<long>, b array<long>, c array<long>, d array<long>, e array<long>")
    got = pair.select(added(F.col("a"), F.col("b")).alias("sum"), added(F.col("c"), F.col("b"), -1).alias("rest"),
                      added(F.col("a"), F.col("e")).alias("more"), likeness(F.col("c"), F.col("c")).alias("same"),
                      likeness(F.col("a"), F.col("b")).alias("other"), likeness(F.col("c"), F.col("d")).alias("near")).first()
    assert got["sum"] == v[2] and got["rest"] == v[0] and got["more"] == v[4]
    assert got["same"] == 1 and got["other"] < 0.4 < got["near"]


def test_edited_texts(messy, messy_rows):
    """Rows that repeat doc_id and text are documents of their own; the order of null ids is that of a hash, so they are only counted."""
    rows = sorted(((r[0], r[1] or "") for r in messy_rows if r[0] is not None), reverse=True)
    want = []
    for i, (doc, t) in enumerate(rows):
        n, k = rows[(i + 1) % len(rows)][1], len(t) // 2
        want.append((doc, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    got = fingerprints(messy.where("doc_id is not null")).collect()
    assert sorted((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got) == sorted(want)
    assert all(0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1 for g in got)
    assert fingerprints(messy).count() == len(messy_rows)


def plain_vector(text):
    """The lanes of a text by loops."""
    def hashed(k, p):
        return xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))

    paragraphs, pieces = text.split("\n"), [xxhash.xxh64_intdigest(p.encode(), 42) for p in re.findall(r"[^\n]{1,32}", text)]
    equal = [sum(hashed(k, p) >> r & 0xFFFFFFFF for p in paragraphs) % 2**32 for k in range(8) for r in (0, 32)]
    return [*equal, len(pieces), *(sum(h >> b & 1 for h in pieces) for r in range(32) for b in (r, r + 32))]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a[16] or not b[16]:
        return 0.0
    x, y = ([2 * v - w[16] for v in w[17:]] for w in (a, b))
    dot = sum(p * q for p, q in zip(x, y, strict=True))
    size = (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    return max(0.0, min(1.0, dot / size)) if size else 0.0


def test_fingerprints_of_plain_python(messy, messy_rows):
    """Vectors and likeness of each text, its edited text and the next document."""
    rows = sorted(((r[0], r[1] or "") for r in messy_rows if r[0] is not None), reverse=True)
    want = []
    for i, (doc, t) in enumerate(rows):
        following, k = rows[(i + 1) % len(rows)][1], len(t) // 2
        a, b, c = (plain_vector(x) for x in (t, t[: len(t) - k] + following[:k], following))
        want.append((doc, a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    got = [(g["doc_id"], g["fingerprint"], g["edited_fingerprint"], round(g["near_edited"], 9), round(g["near_next"], 9))
           for g in fingerprints(messy.where("doc_id is not null")).collect()]
    assert sorted(got) == sorted(want)


def test_buckets_are_even(spark):
    """Clusters of ids and an id with a third of all rows do not fill a bucket; buckets follow the order of the rows."""
    ids = [*range(200), *(10**12 + i for i in range(200)), *([77] * 200), *([None] * 20)]
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string")
    got = in_buckets(docs, 16).select("doc_id", "row", "bucket").collect()
    assert max(Counter(g["bucket"] for g in got).values()) <= 620 / 16 * 2.5
    got.sort(key=lambda g: (g["doc_id"] is None, -(g["doc_id"] or 0), g["row"]))
    assert [g["bucket"] for g in got] == sorted(g["bucket"] for g in got)


def test_fingerprint_text(spark, empty):
    got = spark.createDataFrame([("",), ("a\nb",)], "text string").select(spelt(vector("text")).alias("f")).collect()
    assert all(len(g["f"]) == 81 * 8 for g in got) and got[0] != got[1]
    assert fingerprints(empty).count() == 0
