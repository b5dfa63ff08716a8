"""Operator 2, toxicity: votes of the nearest labelled examples, found exactly by TF-IDF cosine in a block-max inverted index.

Terms are words and their first 4 to 8 bytes, lower-cased. Vectors are plain TF-IDF of unit length, (1 + ln(1 + ln tf)) * idf, idf
from all documents, over a vocabulary of at most `terms` terms and one more that stands for all other words. The vocabulary is
chosen on the examples: terms that stand in toxic examples more often than chance has it (log-likelihood ratio of
`GAIN`) and whose share of toxic rows is at least `purity`. Without this choice the cosine sees chance words only; the
term of all others keeps a long clean text with one such word close to clean examples.

1. Of the training rows a quarter, by a hash of doc_id, is kept for calibration, at most `calibration` rows. Of the rest at most
   `examples` rows of each class are examples. Those with the smallest hash are taken: what is fitted on is bounded, and their
   texts are the only ones that are written.
2. The vocabulary is counted and chosen by Spark, and so are the documents that have each term; the driver sees `terms` rows.
3. The index: examples in an order that puts like ones together, cut into blocks; each term's list of (example, weight), and for each
   block the largest weight in it. A query bounds each block by its terms' maxima, scores the blocks with the best bounds,
   and then only those whose bound reaches the k-th best cosine. The result is that of a full scan.
4. The votes of the k nearest count by distance, 1 / (d + `NEAR`), times the labelled rows their example stands for. A monotone
   curve fitted on the calibration rows (pooled adjacent violators) turns the toxic share into a probability.

A text without words (a null or empty one too) has the share of toxic labels as its score. Without labelled rows of both classes
every score is that share, or 0. Evidence: of the neighbours those that share a term of the vocabulary with the text, with doc_id,
label and cosine, nearest first, ties by doc_id. Repeated rows score one by one; a null doc_id has no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, smallest, text_bytes, written
from .labelled import held_out, training
from .words import _BASE, _LOWER, _VALUE, _cuts, mix, powers, word_spans

LEADING = (4, 5, 6, 7, 8)
#: Least log-likelihood ratio of a term of the vocabulary; chosen, as was the damping of tf, on the calibration rows of sf0.1.
GAIN = 7.0
NEAR = 0.1
BLOCK, FIRST, BINS = 32, 4, 32
KEEP = 1 << 14  # results of equal vectors a worker keeps


def term_hashes(texts: pa.Array, wanted: np.ndarray | None = None, level: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all terms of the texts, or of the wanted ones (sorted), or of one level: so many first bytes, 0 whole words."""
    at, found = term_places(texts, wanted, level)
    return np.searchsorted(text_bytes(texts)[1], at, side="right") - 1, found


def term_places(texts: pa.Array, wanted: np.ndarray | None, level: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(byte at which it starts, hash) of the terms."""
    data, offsets = text_bytes(texts)
    sieve = None
    if wanted is not None:
        sieve = np.zeros(1 << 16, bool)
        sieve[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    cuts, places, found = _cuts(data, offsets), [], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = _LOWER[data[lo:hi]]
        if not len(part):
            continue
        edges = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo
        begin, end = word_spans(part, edges)
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], out=sums[1:])
        size = end - begin
        base, scale = sums[begin], down[begin]
        for k in (0, *LEADING) if level is None else (level,):
            use = slice(None) if k == 0 else np.flatnonzero(size > k)
            stop = end if k == 0 else begin[use] + k
            n = (size if k == 0 else np.full(len(stop), k)).astype(np.uint64)
            h = mix((sums[stop] - base[use]) * scale[use] + n * np.uint64(_BASE))
            at = begin[use]
            if sieve is not None:
                keep = np.flatnonzero(sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
                h, at = h[keep], at[keep]
                keep = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                h, at = h[keep], at[keep]
            found.append(h)
            places.append(at + lo)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(found)


def vectors_of(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) in this order and the number of words of each text. terms: sorted hashes; number len(terms) is all other words."""
    at, h = term_places(texts, terms, None) if len(terms) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    data, offsets = text_bytes(texts)
    words = np.zeros(len(offsets) - 1, np.int64)
    cuts = _cuts(data, offsets)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        begin, _ = word_spans(data[lo:hi], offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo)
        words += np.bincount(np.searchsorted(offsets, begin + lo, side="right") - 1, minlength=len(words))
    row = np.searchsorted(offsets, at, side="right") - 1
    hit = np.unique(at)
    other = words - np.bincount(np.searchsorted(offsets, hit, side="right") - 1, minlength=len(words))
    some = np.flatnonzero(other)
    key, tf = np.unique(row * (len(terms) + 1) + np.searchsorted(terms, h), return_counts=True)
    key, tf = np.concatenate([key, some * (len(terms) + 1) + len(terms)]), np.concatenate([tf, other[some]])
    order = np.argsort(key)
    return *np.divmod(key[order], len(terms) + 1), tf[order], words


class Index:
    """Block-max inverted index of unit vectors. row, term, tf: of the examples, in order; idf: of the terms and of all other words."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, label: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 totals: tuple[int, int], k: int):
        self.terms, self.idf, self.k = terms, idf, k
        starts, term, weight = self.weighed(row, term, tf, len(ids))
        # like examples stand together: by the rarest of their terms, then by its weight
        rarest = np.full(len(ids), len(terms))
        top = np.zeros(len(ids))
        for i in range(len(ids)):
            part = slice(starts[i], starts[i + 1])
            if starts[i] < starts[i + 1]:
                j = np.argmax(idf[term[part]])
                rarest[i], top[i] = term[part][j], weight[part][j]
        order = np.lexsort((ids, top, rarest))
        self.ids, self.label = ids[order], label[order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        at = place[row]
        by_term = np.lexsort((at, term))
        self.example, self.weight, posted = at[by_term], weight[by_term], term[by_term]
        self.blocks = max(1, -(-len(ids) // BLOCK))
        cell = posted * self.blocks + self.example // BLOCK
        self.start = np.searchsorted(cell, np.arange((len(terms) + 1) * self.blocks + 1))
        self.most = np.zeros((len(terms) + 1) * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(-1, self.blocks)
        stands = np.array([totals[c] / max(1, (label == c).sum()) for c in (0, 1)])
        self.stands_for = stands[self.label]
        self.rate = totals[1] / max(1, sum(totals))
        self.curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.kept: dict[bytes, tuple] = {}
        self.skipped = self.seen = 0  # blocks, for tests and tuning

    def weighed(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = (1 + np.log(1 + np.log(tf))) * self.idf[term]
        norm = np.sqrt(np.bincount(row, w * w, minlength=count))
        return np.searchsorted(row, np.arange(count + 1)), term, w / norm[row]

    def cosines(self, term: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the examples of some blocks that share a term with the query."""
        cell = (term[:, None] * self.blocks + blocks[None]).reshape(-1)
        lo, size = self.start[cell], self.start[cell + 1] - self.start[cell]
        post = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        num, inverse = np.unique(self.example[post], return_inverse=True)
        return num, np.bincount(inverse, np.repeat(np.repeat(q, len(blocks)), size) * self.weight[post], minlength=len(num))

    def nearest(self, term: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples that share a term with the query, ties by doc_id."""
        bound = q @ self.most[term]
        order = np.argsort(-bound, kind="stable")
        first, rest = order[:FIRST], order[FIRST:]
        num, cos = self.cosines(term, q, first)
        floor = np.partition(cos, -self.k)[-self.k] if len(cos) >= self.k else 0.0
        rest = rest[(bound[rest] >= floor - 1e-9) & (bound[rest] > 0)]
        self.seen += self.blocks
        self.skipped += self.blocks - len(first) - len(rest)
        if len(rest):
            more = self.cosines(term, q, rest)
            num, cos = np.concatenate([num, more[0]]), np.concatenate([cos, more[1]])
        top = np.lexsort((self.ids[num], -np.round(cos, 9)))[: self.k]
        return num[top], cos[top]

    def share(self, num: np.ndarray, cos: np.ndarray) -> float:
        """The toxic share of the votes."""
        votes = self.stands_for[num] / (np.sqrt(np.maximum(0.0, 2 - 2 * cos)) + NEAR)
        return float(votes[self.label[num] == 1].sum() / votes.sum())

    def judged(self, texts: pa.Array) -> Iterator[tuple[float | None, list[dict]]]:
        """(toxic share or None for a text without words, evidence) of each text."""
        starts, term, weight = self.weighed(*vectors_of(texts, self.terms)[:3], len(texts))
        for lo, hi in zip(starts, starts[1:], strict=False):
            t, q = term[lo:hi], weight[lo:hi]
            key = t.tobytes() + q.tobytes()
            if (found := self.kept.get(key)) is None:
                found = self.judge(t, q)
                if len(self.kept) >= KEEP:
                    self.kept.clear()
                self.kept[key] = found
            yield found

    def judge(self, term: np.ndarray, q: np.ndarray) -> tuple[float | None, list[dict]]:
        if not len(term):
            return None, []
        num, cos = self.nearest(term, q)
        if not len(num):
            return self.rate, []
        own = term[term < len(self.terms)]
        both = set(self.cosines(own, np.ones(len(own)), np.unique(num // BLOCK))[0].tolist()) if len(own) else ()
        return self.share(num, cos), [{"doc_id": int(self.ids[j]), "label": int(self.label[j]), "cosine": float(c)}
                                      for j, c in zip(num, cos, strict=True) if int(j) in both]

    def score(self, share: float | None) -> float:
        return float(self.rate if share is None else np.interp(share, *self.curve))


def pooled(share: np.ndarray, bad: np.ndarray, n: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of a curve that rises from bin to bin: pooled adjacent violators over counts of bins, each with one row at `rate` besides."""
    groups: list[list[float]] = []
    for x, b, m in zip(share, bad, n, strict=True):
        groups.append([x * m, b + rate, m, 1.0])
        while len(groups) > 1 and groups[-2][1] / (groups[-2][2] + groups[-2][3]) >= groups[-1][1] / (groups[-1][2] + groups[-1][3]):
            last = groups.pop()
            groups[-1] = [p + q for p, q in zip(groups[-1], last, strict=True)]
    return np.array([g[0] / g[2] for g in groups]), np.array([g[1] / (g[2] + g[3]) for g in groups])


def gain(bad: Column, good: Column, n: dict[int, int], rate: float) -> tuple[Column, Column]:
    """Log-likelihood ratio of a term that more often stands in toxic examples, and its share of toxic rows at the rate of all labels."""
    base = n[1] / (n[0] + n[1])
    each = bad + good
    ratio = bad * F.log(F.greatest(bad, F.lit(1)) / (each * base)) + good * F.log(F.greatest(good, F.lit(1)) / (each * (1 - base)))
    toxic, clean = bad * (rate / n[1]), good * ((1 - rate) / n[0])
    return F.when(bad / each > base, ratio).otherwise(0.0), toxic / (toxic + clean)


def train(docs: DataFrame, labels: DataFrame, examples: int, calibration: int, terms: int, purity: float, k: int) -> Index | float:
    """The index, or the share of toxic labels where one class has none."""
    spark = docs.sparkSession
    rows = training(labels, "toxic").withColumns({"h": F.xxhash64("doc_id"), "fit": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0})
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return 1.0 * bool(counts.get(1))
    totals = counts[0], counts[1]
    some = [smallest(rows.where((F.col("label") == c) & ~F.col("fit")), "h", counts[c], examples, "doc_id") for c in (0, 1)]
    some.append(smallest(rows.where("fit"), "h", sum(totals), calibration, "doc_id"))
    picked = F.broadcast(some[0].union(some[1]).union(some[2]).select("doc_id", "label", "fit"))  # 2 * examples + calibration rows at most
    texts = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id"), "toxic-examples")
    shown = texts.where("not fit")
    n = {r[0]: r[1] for r in shown.groupBy("label").count().collect()}
    if len(n) < 2:
        return totals[1] / sum(totals)
    rate = totals[1] / sum(totals)

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many examples of a batch have each term, toxic and clean ones."""
        for b in small_batches(batches, "text", 1 << 20):
            label = b.column("label").to_numpy()
            keys = []
            for level in (0, *LEADING):
                number, h = term_hashes(b.column("text"), None, level)
                order = np.lexsort((h, number))
                number, h = number[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (number[1:] != number[:-1]) | (h[1:] != h[:-1])
                keys.append((number[new], h[new]))
            number, h = (np.concatenate([x[i] for x in keys]) for i in (0, 1))
            found, at = np.unique(h, return_inverse=True)
            bad = np.bincount(at, label[number] == 1, minlength=len(found)).astype(np.int64)
            good = np.bincount(at, minlength=len(found)) - bad
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(bad), pa.array(good)], ["term", "bad", "good"])

    counted = shown.select("label", "text").mapInArrow(having, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio, pure = gain(F.col("bad"), F.col("good"), n, rate)
    best = counted.select("term", ratio.alias("gain"), pure.alias("pure")).where((F.col("gain") >= GAIN) & (F.col("pure") >= purity))
    chosen = [r["term"] for r in best.orderBy(F.desc("gain"), "term").limit(terms).collect()]
    vocabulary = np.sort(np.array(chosen, np.int64).view(np.uint64))
    held = spark.sparkContext.broadcast(vocabulary)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of a task have each term; the last number counts the documents."""
        total = np.zeros(len(held.value) + 2, np.int64)
        for b in small_batches(batches, "text"):
            total += np.bincount(vectors_of(b.column("text"), held.value)[1], minlength=len(total))
            total[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["term", "n"])

    have = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(documents, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(vocabulary) + 2)
    for r in have.collect():
        df[r["term"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of each example and how often it has them."""
        for b in small_batches(batches, "text"):
            row, term, tf, _ = vectors_of(b.column("text"), held.value)
            at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *lists], ["doc_id", "label", "terms", "tf"])

    # at most 2 * examples rows of terms + 1 numbers
    found = shown.select("doc_id", "label", "text").mapInArrow(weights, "doc_id long, label int, terms array<int>, tf array<int>").toArrow().combine_chunks().sort_by("doc_id")
    lists = found.column("terms").combine_chunks()
    row = np.repeat(np.arange(len(found)), lists.value_lengths().to_numpy())
    index = Index(vocabulary, idf, found.column("doc_id").to_numpy(), found.column("label").to_numpy(), row, lists.flatten().to_numpy().astype(np.int64),
                  found.column("tf").combine_chunks().flatten().to_numpy(), totals, k)
    trained = spark.sparkContext.broadcast(index)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([s for s, _ in trained.value.judged(b.column("text"))], pa.float64())], ["label", "share"])

    bins = texts.where("fit").select("label", "text").mapInArrow(shares, "label int, share double").where("share is not null")
    bins = bins.groupBy(F.floor(F.col("share") * BINS).alias("bin")).agg(F.avg("share").alias("share"), F.sum("label").alias("bad"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins and 0 < sum(r["bad"] for r in bins) < sum(r["n"] for r in bins):
        index.curve = pooled(*(np.array([float(r[c]) for r in bins]) for c in ("share", "bad", "n")), rate)
    index.kept.clear()
    return index


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = 2048, calibration: int = 4096, terms: int = 2048, purity: float = 0.8,
             k: int = 10, keep: list[str] | tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """doc_id, held_out, score, evidence of each row, and its other columns that `keep` names. labels: doc_id, toxic.

    score: the name of the score, where a kept column has that one; held_out and evidence then stay away if they are kept, too.
    """
    trained = docs.sparkSession.sparkContext.broadcast(train(docs, labels, examples, calibration, terms, purity, k))

    keep = [c for c in keep if c != "doc_id"]
    source = docs.select("doc_id", *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)), F.coalesce("text", F.lit("")).alias("scored"))
    names = source.columns[:-1]
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = trained.value
        for b in small_batches(batches, "scored"):
            if isinstance(index, float):
                scores, evidence = [index] * b.num_rows, [[]] * b.num_rows
            else:
                found = list(index.judged(b.column("scored")))
                scores, evidence = [index.score(s) for s, _ in found], [e for _, e in found]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(scores, pa.float64()), pa.array(evidence, kind)], [*names, "score", "evidence"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema[:-1]]
    scored = source.mapInArrow(run, ", ".join([*fields, "score double, evidence array<struct<doc_id:long,label:int,cosine:double>>"]))
    own = [c.alias(n) for n, c in (("held_out", held_out()), ("evidence", F.col("evidence"))) if n not in {c.lower() for c in keep}]
    return scored.select("doc_id", *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), F.col("score").alias(score), *own)
