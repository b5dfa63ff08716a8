from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tickweave.llm.pieces import Batch, Vocabulary, decode, encode
from tickweave.llm.q_rows import model_path


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(model_path())


def test_round_trip_and_distinct(messy, messy_rows, vocabulary):
    made = encode(messy, vocabulary, k=3)
    got = made.collect()
    texts = Counter((r[0], r[1] or "") for r in messy_rows)
    back = Counter((r["doc_id"], r["text"]) for r in decode(made.where("sample = 0"), vocabulary).collect())
    assert back == texts
    for t in decode(made, vocabulary).collect():
        assert (t["doc_id"], t["text"]) in texts
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["sample"]), []).append(r)
        assert len(r["ids"]) == r["n_tokens"] and r["log_prob"] <= 0 and r["log_inclusion"] <= 0
    for i in (4, 8, 11, 12):
        ids = [tuple(by[i, s][0]["ids"]) for s in range(3) if (i, s) in by]
        assert len(set(ids)) == len(ids)
    assert by[1, 0][0]["ids"] == [] and (1, 1) not in by and by[1, 0][0]["log_inclusion"] == 0
    assert len({tuple(r["ids"]) for r in by[6, 0] if r["n_tokens"]}) == 1  # repeated rows give the same sample


def test_samples_do_not_depend_on_partitions(messy, vocabulary):
    a, b = (sorted(map(str, encode(messy.repartition(n), vocabulary).collect())) for n in (1, 5))
    assert a == b


def segmentations(vocabulary, text):
    chars, weight = "▁" + text, {}
    known = {vocabulary.spelt[i]: (int(i), w) for i, w in zip(vocabulary.ids, vocabulary.weights, strict=True)}
    for cut in itertools.product([0, 1], repeat=len(chars) - 1):
        parts, start = [], 0
        for i, c in enumerate(cut, 1):
            if c:
                parts.append(chars[start:i])
                start = i
        parts = [known.get(p.replace("▁", " ").encode()) for p in [*parts, chars[start:]]]
        if all(parts):
            weight[tuple(p[0] for p in parts)] = math.exp(sum(p[1] for p in parts))
    total = sum(weight.values())
    return {k: w / total for k, w in weight.items()}


def test_samples_follow_the_lattice_without_replacement():
    vocabulary, n = Vocabulary.load(model_path(), alpha=0.3), 6000
    p = segmentations(vocabulary, "there")
    batch = Batch(pa.array(["there"] * n), np.arange(n) * 7919, vocabulary)
    out = batch.sample(2)
    found = [batch.ids(path) for _, path, _, _ in out]
    first, pairs = Counter(), Counter()
    for i in range(n):
        a, b = (tuple(ids[at[i] : at[i + 1]].tolist()) for ids, at in found)
        assert a != b and out[0][2][i] == pytest.approx(math.log(p[a]), abs=1e-6) and out[1][2][i] == pytest.approx(math.log(p[b]), abs=1e-6)
        first[a] += 1
        pairs[a, b] += 1
    assert out[0][3].min() > -5 and (out[0][3] > out[1][3]).all() and (out[1][3] > batch.kappa).all()
    for a, q in p.items():
        assert abs(first[a] / n - q) < 4 * math.sqrt(q / n) + 1e-3
    for (a, b), c in pairs.items():
        q = p[a] * p[b] / (1 - p[a])
        assert abs(c / n - q) < 4 * math.sqrt(q / n) + 1e-3


def test_all_segmentations_are_given_once(vocabulary):
    p = segmentations(vocabulary, "the")
    batch = Batch(pa.array(["the"] * 20), np.arange(20), vocabulary)
    out = batch.sample(len(p) + 2)
    assert all(sum(bool(has[i]) for has, *_ in out) == len(p) for i in range(20))
    assert np.isneginf(batch.kappa).all()


def test_empty(empty, vocabulary):
    assert encode(empty, vocabulary).count() == 0
