from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import numpy as np

from tickweave.llm.exact_dedup import Directory, exact_dedup, keep_rows


def normal(t):
    return "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")


def check(rows, docs, **options):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r)
    got = exact_dedup(docs, **options).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for g in got:
        by[bytes(g["sha"])].append(g)
    for t, members in groups.items():
        found = by[sha256(t.encode()).digest()]
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        assert len(found) == len(members) and {g["group_size"] for g in found} == {len(members)}
        assert {g["keep_id"] for g in found} == {best[0]}
        kept = [g for g in found if g["kept"]]
        assert len(kept) == 1 and (kept[0]["doc_id"], kept[0]["n_chars"]) == (best[0], len(best[1] or ""))
    return got


def test_groups(messy, messy_rows):
    check(messy_rows, messy)


def test_colliding_keys_are_chained_and_buckets_split(messy, messy_rows):
    check(messy_rows, messy, key_bits=2, capacity=1)


def test_kept_rows_stay_once(messy, messy_rows):
    kept = keep_rows(messy, exact_dedup(messy).where("kept"))
    assert kept.columns == messy.columns
    assert sorted(normal(r["text"]) for r in kept.collect()) == sorted({normal(r[1]) for r in messy_rows})


def test_empty(empty):
    assert exact_dedup(empty).count() == 0 and keep_rows(empty, exact_dedup(empty)).count() == 0


def test_directory_doubles_where_keys_crowd():
    cells = np.zeros(256, np.int64)
    cells[:4], cells[200] = 100, 3
    d = Directory(cells, 100)
    assert d.depth == 8 and len(d.slots) == 256 and d.counts.max() == 100
    assert d.bucket(0) != d.bucket(1 << 56) and d.bucket(130 << 56) == d.bucket(255 << 56)
    owners = d.owners(3)
    assert (np.diff(owners) >= 0).all() and owners.max() <= 2
    assert Directory(cells, 1000).depth == 0
