"""Operator 11, spelling variants: words one edit apart, found by probing generated edits in Bloom filters.

1. Words and their counts over whole texts; `least` letters and `count` occurrences make a vocabulary. Counting is partial in each
   task, so a word that is a third of all text leaves a task once.
2. The vocabulary's Bloom filters are sharded by length: blocks of 512 bits, each word sets `BITS` bits of one block. A filter's
   blocks are folded from the words by Spark (groupBy block, bit_or). A length with more words than `capacity` is cut by
   hash into parts of at most that many, and one job handles as many parts as `LOAD` bytes of filter hold: what is broadcast has a bound
   however large the vocabulary is, more words make more jobs.
3. Each word's edits are generated in numpy as hashes, not strings: a word's hash is a sum over its code points, so an edit changes
   one or shifts the rest. Deletions are looked for among the words one shorter (insertions are the same pairs seen from the other side),
   replacements among those of equal length, with the letters words of that length have.
4. Only edits the filter says are there become strings and are shuffled to the exact join with the vocabulary, which removes false positives.

The form of a word is its near word of largest count (ties: smallest in code-point order) if that is at least `ratio` times the
word's own; counts at least double along forms, so `roots` ends after log2 of the longest chain of rounds of pointer doubling.
Null and empty texts have no words, an empty vocabulary gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, written
from .words import mix, powers

RUN = r"[A-Za-zÀ-ÿ]+"
BITS, PER_WORD, LOAD = 6, 14, 32 << 20
CHUNK = 1 << 19  # edits that are probed together
_RNG = np.random.default_rng(11)
_VALUE = _RNG.integers(0, 2**64, 1 << 16, dtype=np.uint64) | np.uint64(1)


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def noisy(doc_id: Column, run: Column, every: int) -> Column:
    """The run without one code point where `every` divides the hash of document and run: planted misspellings."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least: int = 5, count: int = 3, every: int | None = None) -> DataFrame:
    """word, n: the words of all texts with at least `least` code points and `count` occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least).select("doc_id", lowered(F.col("run")).alias("run"))
    words = runs.select((noisy(F.col("doc_id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def codes(words: pa.Array, size: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, size)


def hashes(points: np.ndarray) -> np.ndarray:
    """Unmixed hashes of words of one length."""
    up, _ = powers(points.shape[1])
    return (_VALUE[points & 0xFFFF] * up[: points.shape[1]]).sum(axis=1, dtype=np.uint64)


def places(h: np.ndarray, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each (mixed) hash, and a second hash from which its bits come."""
    h = mix(h)
    return ((h >> np.uint64(32)) * np.asarray(blocks, np.uint64)) >> np.uint64(32), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return mix(h * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(parts)


class Bloom:
    """The filters of one job: for each (length, part) the blocks, 8 words of 64 bits each."""

    def __init__(self, shards: dict[tuple[int, int], np.ndarray], parts: dict[int, int]):
        self.shards, self.parts = shards, parts

    def has(self, size: int, h: np.ndarray) -> np.ndarray:
        """Which of the unmixed hashes of words of one length may be in the filters of this job."""
        found = np.zeros(len(h), bool)
        for part in range(self.parts.get(size, 0)):
            blocks = self.shards.get((size, part))
            if blocks is None:
                continue
            mine = np.flatnonzero(part_of(h, self.parts[size]) == part) if self.parts[size] > 1 else np.arange(len(h))
            block, bits = places(h[mine], len(blocks))
            flat, first = blocks.reshape(-1), block.astype(np.int64) << 3
            for k in range(BITS):
                bit = bits >> np.uint64(9 * k)
                hit = np.flatnonzero((flat[first + ((bit >> np.uint64(6)) & np.uint64(7)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                mine, first, bits = mine[hit], first[hit], bits[hit]
            found[mine] = True
        return found


def bits_of(batches: Iterator[pa.RecordBatch], shards: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """size, part, block and the bits that each word sets there, as eight signed words. shards: parts and blocks of a part by length."""
    for b in batches:
        size = b.column("size").to_numpy()
        for s in np.unique(size):
            h = hashes(codes(b.column("word").filter(pa.array(size == s)), int(s)))
            parts, blocks = shards[int(s)]
            block, bits = places(h, blocks)
            rows = np.zeros((len(h), 8), np.uint64)
            at = np.arange(len(h))
            for k in range(BITS):
                bit = bits >> np.uint64(9 * k)
                rows[at, ((bit >> np.uint64(6)) & np.uint64(7)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(h), s, np.int32)), pa.array(part_of(h, parts).astype(np.int32)), pa.array(block.astype(np.int64)),
                 *(pa.array(rows[:, i].view(np.int64)) for i in range(8))], ["size", "part", "block", *(f"b{i}" for i in range(8))])


def edits(points: np.ndarray, letters: np.ndarray, bloom: Bloom) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code points of the edited word) of the edits of words of one length that the filter has."""
    n, size = points.shape
    up, down = powers(size + 1)
    terms = _VALUE[points & 0xFFFF] * up[:size]
    total = terms.sum(axis=1, dtype=np.uint64)
    if size > 1 and bloom.parts.get(size - 1):
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        for i in range(size):
            # of equal letters in a row only the last one's deletion counts
            rows = np.arange(n) if i == size - 1 else np.flatnonzero(points[:, i] != points[:, i + 1])
            head = before[rows, i] - terms[rows, i]
            hit = rows[bloom.has(size - 1, head + (total[rows] - before[rows, i]) * down[1])]
            yield hit, np.delete(points[hit], i, axis=1)
    if bloom.parts.get(size):
        step = max(1, CHUNK // max(1, len(letters)))
        for i in range(size):
            for lo in range(0, n, step):
                old = points[lo : lo + step, i]
                row, new = np.nonzero(letters[None] > old[:, None])  # each pair from its smaller side
                h = total[lo + row] + (_VALUE[letters[new] & 0xFFFF] - _VALUE[old[row] & 0xFFFF]) * up[i]
                hit = np.flatnonzero(bloom.has(size, h))
                out = points[lo + row[hit]]
                out[:, i] = letters[new[hit]]
                yield lo + row[hit], out


def near_pairs(words: DataFrame, capacity: int = 1 << 21) -> DataFrame:
    """word, n, other, other_n of all pairs of words (word, n) that differ by one edit, in both directions. words: a written table."""
    sized = words.withColumn("size", F.length("word"))
    # at most one row for each length of a word and letter of the alphabet of runs
    counts = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    letter = F.explode(F.array_distinct(F.split("word", ""))).alias("letter")
    letters: dict[int, list[int]] = {}
    for r in sized.select("size", letter).where("letter != ''").distinct().collect():
        letters.setdefault(r["size"], []).append(ord(r["letter"]))
    # the only word of its length has no other to be replaced by
    alphabet = {k: np.sort(np.array(v if counts[k] > 1 else [], np.uint32)) for k, v in letters.items()}
    shards = {s: (-(-n // capacity), max(1, -(-min(n, capacity) * PER_WORD // 512))) for s, n in counts.items()}
    parts = {s: p for s, (p, _) in shards.items()}
    jobs: list[list[tuple[int, int]]] = [[]]
    load = 0
    for s in sorted(shards):
        for part in range(shards[s][0]):
            if load and load + 64 * shards[s][1] > LOAD:
                jobs.append([])
                load = 0
            jobs[-1].append((s, part))
            load += 64 * shards[s][1]

    kinds = "size int, part int, block long, " + ", ".join(f"b{i} long" for i in range(8))
    folded = sized.select("word", "size").mapInArrow(lambda batches: bits_of(batches, shards), kinds)
    folded = folded.groupBy("size", "part", "block").agg(*(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(8)))
    if len(jobs) > 1:
        folded = written(folded, "spelling-filters")
    out = None
    for job in jobs:
        found = probed(sized, folded, job, shards, parts, alphabet)
        found = written(found, "spelling-positives") if len(jobs) > 1 else found
        out = found if out is None else out.unionByName(found)
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = written(out.join(other, "other").select("word", "n", "other", "other_n"), "spelling-pairs")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def probed(sized: DataFrame, folded: DataFrame, job: list[tuple[int, int]], shards: dict, parts: dict, alphabet: dict) -> DataFrame:
    """word, n, other: the edits that the filters of one job have; each pair once, if it is one."""
    only = F.struct("size", "part").isin(*[F.struct(F.lit(s), F.lit(p)) for s, p in job])
    got = (folded.where(only) if len(job) < sum(parts.values()) else folded).toArrow()
    size, part, block = (got.column(c).to_numpy() for c in ("size", "part", "block"))
    lanes = np.stack([got.column(f"b{i}").to_numpy().view(np.uint64) for i in range(8)], axis=1)
    filters = {}
    for s, p in job:
        mine = (size == s) & (part == p)
        filters[s, p] = np.zeros((shards[s][1], 8), np.uint64)
        filters[s, p][block[mine]] = lanes[mine]
    held = sized.sparkSession.sparkContext.broadcast(Bloom(filters, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = held.value
        for b in batches:
            sizes = b.column("size").to_numpy()
            for s in np.unique(sizes):
                mine = b.filter(pa.array(sizes == s))
                for row, out in edits(codes(mine.column("word"), int(s)), alphabet[int(s)], bloom):
                    if not len(row):
                        continue
                    joined = out.astype("<u4").tobytes().decode("utf-32-le")
                    width = out.shape[1]
                    other = pa.array([joined[i : i + width] for i in range(0, len(joined), width)])
                    some = mine.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([some.column("word"), some.column("n"), other], ["word", "n", "other"])

    return sized.select("word", "n", "size").mapInArrow(run, "word string, n long, other string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form. forms: word, form, written."""
    at, jump, done = forms, forms.select(F.col("word").alias("form"), F.col("form").alias("next")), []
    while not at.isEmpty():
        # a word whose pointer has no form has reached its root
        here = written(at.join(jump, "form", "left"), "spelling-roots")
        done.append(here.where("next is null").select("word", F.col("form").alias("root")))
        at = here.where("next is not null").select("word", F.col("next").alias("form"))
        further = jump.select(F.col("form").alias("next"), F.col("next").alias("further"))
        jump = written(jump.join(further, "next", "left").select("form", F.coalesce("further", "next").alias("next")), "spelling-jumps")
    return reduce(DataFrame.unionByName, done) if done else forms.withColumnRenamed("form", "root")


def variants(words: DataFrame, ratio: int = 2, capacity: int = 1 << 21) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of the vocabulary (word, n)."""
    words = written(words.repartition(partitions(words.sparkSession)), "spelling-words")
    pairs = near_pairs(words, capacity)
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other"))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.m") >= ratio * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    table = written(table, "spelling-forms")
    found = roots(table.where("form is not null").select("word", "form"))
    return table.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
