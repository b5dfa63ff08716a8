from __future__ import annotations

import zlib
from collections import defaultdict

import duckdb
import pytest

from tickweave.llm.common import table
from tickweave.llm.mixing import mix
from tickweave.llm.q_rows import MIX_SQL, op7
from tickweave.llm.sharding import clockwise, intervals, ring, shard


def n_words(t):
    return len((t or "").encode().split())


def filled(sizes, weights, total):
    """Water filling by handing the excess round again and again."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), total
    while open_ and left > 1e-9:
        w, full = sum(weights[s] for s in open_), set()
        for s in sorted(open_, key=str):
            target[s] += left * weights[s] / w
        left = 0.0
        for s in open_:
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
        open_ -= full
    return target


def test_mix(messy, messy_rows):
    got = mix(messy).collect()
    sizes = defaultdict(int)
    for r in messy_rows:
        sizes[r[3]] += n_words(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    target = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    assert len(got) == len(messy_rows) and sorted(g["size"] for g in got) == sorted(n_words(r[1]) for r in messy_rows)
    taken = defaultdict(int)
    for g in got:
        assert g["source_size"] == sizes[g["source"]] and g["target"] == pytest.approx(target[g["source"]])
        assert 0 <= g["taken"] <= 2 * g["size"]
        assert (g["time_1"] is not None) == (g["taken"] > 0)
        taken[g["source"]] += g["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    times = [g["time_1"] for g in got if g["time_1"] is not None]
    assert times == sorted(times) and 0 < times[0] and times[-1] < 1
    assert sorted(map(str, got)) == sorted(map(str, mix(messy).collect()))


def test_the_schedule_meets_its_integral(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    got = mix(docs, weights=(3, 1), late=(1, 3), share=1.0).where("source = 'a'").toPandas()
    t = got.time_1.sort_values().reset_index(drop=True)  # 1000 words of which the mix takes 1500
    part = (t.index + 0.5) * 5 / 1500
    assert len(t) == 200 and (abs((3 * t - t * t) / 2 - part) < 1e-9).all()  # weight 3 falling to 1: the integral is 3t - t*t of 2


def test_mix_of_nothing(empty):
    assert mix(empty).count() == 0


def test_shards(messy, messy_rows):
    got = shard(messy, shards=4).collect()
    assert sorted((g["size"], g["text_crc32"]) for g in got) == sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in messy_rows)
    slots = defaultdict(list)
    for g in got:
        slots[g["shard"]].append(g["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_with_a_hot_text(spark, prose):
    rows = [(i, "the very same text" if i % 3 == 0 else prose(i, 5 + i % 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shard(docs).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() < 1.03 * load.mean() and load.min() > 0.93 * load.mean()
    again = shard(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    more = shard(docs, shards=9).toPandas().merge(got, on="doc_id")
    assert (more.shard_x != more.shard_y).mean() < 0.5  # a modulus would move 8 of 9


def test_overflow_goes_clockwise():
    points = ring(4, 8)
    loads = {a: 1000 if a == 5 else 10 for a in range(len(points))}
    cut = intervals(points, loads, 4, 0.01)
    total, by = sum(loads.values()), defaultdict(int)
    for arc, lo, hi, s in cut:
        by[s] += hi - lo
    assert sum(by.values()) == total and max(by.values()) <= total / 4 * 1.01 + 1
    assert [s for a, _, _, s in cut if a == 5] == clockwise(points, 5)[: len([1 for a, *_ in cut if a == 5])]


def test_shards_of_nothing(empty):
    assert shard(empty).count() == 0


def test_a_plain_ring_places_the_rows(spark, sf):
    """Rows in ring order, byte by byte: each goes to the shard whose interval of its arc it starts in, and takes the next slot there."""
    import xxhash

    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, sf, "documents").collect()]
    points = ring(8, 128)

    def tie(i):  # Spark's hash of a long
        return xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    rows = []
    for i, t in docs:
        place = xxhash.xxh64_intdigest(t.encode(), 42) % (1 << 32)
        arc = next((k for k, (p, _) in enumerate(points) if p >= place), 0)
        rows.append((arc, place, signed(tie(i)), i, len(t.encode()) + 1, zlib.crc32(t.encode())))
    rows.sort()
    loads, at = defaultdict(int), {}
    for arc, place, _, i, size, _ in rows:
        at[i] = loads[arc]
        loads[arc] += size
    mean = sum(loads.values()) / 8
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(r)
    for same in groups.values():
        if sum(r[4] for r in same) <= 0.01 * mean:
            first = min(at[r[3]] for r in same)
            at.update((r[3], first) for r in same)
    cuts, slots, want = intervals(points, dict(loads), 8, 0.005), defaultdict(int), {}
    for arc, _, _, i, size, crc in rows:
        where = next(s for a, lo, hi, s in cuts if a == arc and lo <= at[i] < hi)
        want[i] = (size, crc, where)
    got = {r["doc_id"]: r for r in shard(table(spark, sf, "documents")).collect()}
    assert {i: (r["size"], r["text_crc32"], r["shard"]) for i, r in got.items()} == want
    for arc, _, _, i, _, _ in rows:
        assert got[i]["slot"] == slots[want[i][2]]
        slots[want[i][2]] += 1


def test_targets_are_those_of_the_sql(spark):
    """Size, source_size and target of every document, by DuckDB."""
    sf = "/root/testdata/sf0.01"
    duckdb.execute(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql(MIX_SQL).fetchall()}
    got = {r["doc_id"]: r for r in op7(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, (size, source_size, target) in want.items():
        assert (got[i]["size"], got[i]["source_size"]) == (size, source_size) and got[i]["target"] == pytest.approx(target)
