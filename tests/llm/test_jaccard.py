from __future__ import annotations

import random

import pytest

from tickweave.llm import jaccard
from tickweave.llm.components import components
from tickweave.llm.jaccard import jaccard_join


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def classes(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = classes(links, len(rows))
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], len(s), least.get(g)) for r, s, g in zip(rows, sets, group, strict=True)), key=str)


def check(spark, rows, docs=None, **options):
    docs = docs or spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)
    got = jaccard_join(docs, **options).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_messy(spark, messy, messy_rows):
    check(spark, messy_rows, messy)


@pytest.mark.parametrize(("frequent", "large"), [(1, 64), (1, 2), (6, 3), (16, 64)])
def test_near_copies_and_shared_passages(spark, prose, monkeypatch, frequent, large):
    """A large group of near copies, texts made mostly of one passage, and pairs at the limit of similarity."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    r, rows = random.Random(7), []
    base, passage = prose(10, 80).split(), prose(11, 40).split()
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "zz" + str(r.randrange(9))
        rows.append((i, " ".join(w)))
    for i in range(40, 70):
        rows.append((i, " ".join(passage + prose(100 + i, r.randrange(2, 40)).split())))
    for i in range(70, 110):
        w = prose(i // 2 * 2, 44).split()
        rows.append((i, " ".join(w[: 44 - r.randrange(9)] if i % 2 else w)))
    check(spark, rows, frequent=frequent)


def test_empty(empty):
    assert jaccard_join(empty).count() == 0


def test_components_of_a_random_graph(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(links, 461)
    on = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in on}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
