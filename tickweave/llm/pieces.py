"""Operator 3, SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

A text's segmentations are the paths of its lattice of vocabulary pieces; a path's probability is the product of its
pieces' weights over the sum of all paths, which backward sums give for every lattice node. The search keeps regions of
paths (a prefix and a set of next pieces that are taken already), each with the largest perturbed log-probability of its
paths, drawn from its mass as a Gumbel variable truncated at the region it was cut from. Taking the best region, walking
down by conditional probabilities (the walk keeps the maximum) and cutting off what stands beside the walk gives the next
segmentation in falling order of perturbed log-probability: the k first are a sample without replacement. With the value of
the best region left, kappa, a segmentation's inclusion score is P(Gumbel(log p) > kappa).

Draws are hashes of the row's key, the sample's number and the character's place, so neither partitions nor retries change
them. Weights: a unigram model's scores; for a BPE model, whose scores are merge ranks, `1 / (rank + 2)`. `alpha` scales
their logarithms. No piece runs over the start of a run of spaces, so a lattice is cut there, and each different cut is
worked out once per batch. Characters outside the vocabulary are spelt in bytes, as U+2581 itself is, so that decoding is exact.

Null and empty text: one empty segmentation of probability 1. A text with fewer than k segmentations gives them all, with
inclusion 1. Invalid UTF-8 is replaced by U+FFFD. Rows that repeat key and text give the same samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes
from .words import _BASE, mix, powers

MARK, LITERAL = 0x2581, 0x110000
UNIT = float(1 << 32)  # log-probabilities are summed as whole 2**-32, so that sums do not depend on the batch


@dataclass
class Vocabulary:
    """Pieces by the hash of their characters; what the tasks need of a model file."""

    hashes: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    longest: int
    byte_ids: np.ndarray
    byte_weights: np.ndarray
    spelt: list[bytes]  # of each id, with spaces

    @staticmethod
    def load(path: str, alpha: float = 1.0) -> Vocabulary:
        """Reads the model where this is called; the executors need no file."""
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        model = SentencePieceProcessor(model_proto=proto.SerializeToString())
        unigram = proto.trainer_spec.model_type == 1
        n = model.get_piece_size()
        weight = np.array([model.get_score(i) for i in range(n)])
        if not unigram:
            weight = -np.log(np.minimum(-weight, n) + 2)
        weight *= alpha
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in normal]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space after another character")
        flat = np.array([ord(c) for p in pieces for c in p], np.int64)
        ends = np.cumsum([len(p) for p in pieces])
        hashes = span_hashes(running(flat), ends - [len(p) for p in pieces], ends)
        order = np.argsort(hashes)
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if any(not model.is_byte(int(i)) for i in byte_ids):
            raise ValueError("the model has no byte pieces")
        spelt = [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else
                 b"" if model.is_control(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        return Vocabulary(hashes[order], np.array(normal)[order], weight[normal][order], max(map(len, pieces)),
                          byte_ids, np.full(256, weight.min()), spelt)


def running(chars: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hashes` takes the hash of any span of the characters."""
    up, _ = powers(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(_BASE))


def draws(key: np.ndarray, *salts) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit keys and whole numbers."""
    h = key
    for s in salts:
        h = mix(h + np.asarray(s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Lattice:
    """Edges by start node, of all different cuts; node numbers run through the cuts, each with one more than characters."""

    first: np.ndarray  # start node of each cut
    size: np.ndarray
    starts: np.ndarray  # edges of each node
    to: np.ndarray
    piece: np.ndarray  # row of the vocabulary, or -1 - character
    p: np.ndarray  # probability given the start node
    upto: np.ndarray  # sum of the probabilities of the start node's edges up to this one; the last has 2
    logp: np.ndarray  # in UNIT


def lattice(chars: np.ndarray, begin: np.ndarray, end: np.ndarray, v: Vocabulary) -> Lattice:
    size = end - begin
    flat_at = np.concatenate([[0], np.cumsum(size)])
    flat = chars[np.repeat(begin - flat_at[:-1], size) + np.arange(flat_at[-1])]
    sums = running(flat)
    cut = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat))
    left = np.repeat(flat_at[1:], size) - place  # characters to the end of the cut
    sieve = np.zeros(1 << 20, bool)
    sieve[(v.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True
    found = []
    covered = np.zeros(len(flat), bool)
    for n in range(1, v.longest + 1):
        at = np.flatnonzero(left >= n)
        if not len(at):
            break
        h = span_hashes(sums, at, at + n)
        may = np.flatnonzero(sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        row = np.minimum(np.searchsorted(v.hashes, h[may]), len(v.hashes) - 1)
        hit = v.hashes[row] == h[may]
        found.append((n, at[may[hit]], row[hit]))
        if n == 1:
            covered[found[0][1]] = True
    spelt = np.flatnonzero(~covered)
    found.insert(0, (1, spelt, -1 - flat[spelt]))
    # edges by start node, the longest piece first: mostly the likeliest
    degree = np.zeros(len(flat) + len(size), np.int64)
    for _, at, _ in found:
        degree[at + cut[at]] += 1
    starts = np.concatenate([[0], np.cumsum(degree)])
    to, piece, filled = np.empty(starts[-1], np.int64), np.empty(starts[-1], np.int64), starts[:-1].copy()
    for n, at, row in reversed(found):
        node = at + cut[at]
        slot = filled[node]
        filled[node] = slot + 1
        to[slot], piece[slot] = node + n, row
    weight = v.weights[np.maximum(piece, 0)]
    for char in np.unique(piece[piece < 0]):
        weight[piece == char] = v.byte_weights[np.frombuffer(spell(int(-1 - char)), np.uint8)].sum()
    beta = np.zeros(len(degree))
    height = np.zeros(len(degree), np.int64)
    height[place + cut] = left
    small = height.astype(np.uint16) if len(size) and size.max() < 1 << 16 else height
    todo = np.argsort(small, kind="stable")  # nodes near the end first
    todo = todo[len(size) :]  # without the ends
    edges = np.repeat(starts[todo], degree[todo]) + running_index(degree[todo])
    heads = np.concatenate([[0], np.cumsum(degree[todo])])
    levels = np.searchsorted(height[todo], np.arange(1, (size.max() if len(size) else 0) + 2))
    for lo, hi in zip(levels, levels[1:], strict=False):
        if lo == hi:
            continue
        e, head = edges[heads[lo] : heads[hi]], heads[lo:hi] - heads[lo]
        value = weight[e] + beta[to[e]]
        top = np.maximum.reduceat(value, head)
        value -= np.repeat(top, degree[todo[lo:hi]])
        beta[todo[lo:hi]] = top + np.log(np.add.reduceat(np.exp(value), head))
    logp = np.minimum(weight + beta[to] - np.repeat(beta, degree), 0.0)
    p = np.exp(logp)
    total = np.cumsum(p)
    upto = total - np.repeat(np.concatenate([[0.0], total])[starts[:-1]], degree)
    upto[starts[1:][degree > 0] - 1] = 2.0
    return Lattice(flat_at[:-1] + np.arange(len(size)), size, starts, to, piece, p, upto, np.rint(logp * UNIT).astype(np.int64))


def running_index(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of the counts n, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def spell(char: int) -> bytes:
    return b"\xe2\x96\x81" if char == LITERAL else b" " if char == MARK else chr(char).encode("utf-8", "replace")


class Batch:
    """The texts of one batch as characters with a space in front, their cuts and lattices."""

    def __init__(self, texts: pa.Array, keys: np.ndarray, v: Vocabulary):
        data, at = text_bytes(texts)
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        if sums[-1] != len(chars):  # invalid bytes: text by text
            each = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in each])])
            chars = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32).astype(np.int64)
        else:
            ends = sums[at]
        chars = np.where(chars == MARK, LITERAL, np.where(chars == 32, MARK, chars))
        full = np.diff(ends) > 0
        self.chars = np.insert(chars, ends[:-1][full], MARK)
        self.ends = ends + np.concatenate([[0], np.cumsum(full)])
        self.text = np.repeat(np.arange(len(full)), np.diff(self.ends))
        self.keys, self.v = keys.view(np.uint64), v
        mark = self.chars == MARK
        opens = mark.copy()
        opens[1:] &= ~mark[:-1]
        opens[self.ends[:-1][full]] = True
        self.begin = np.flatnonzero(opens)
        self.finish = np.append(self.begin[1:], len(self.chars)) if len(self.begin) else self.begin
        h = span_hashes(running(self.chars), self.begin, self.finish)
        _, some, self.cut = np.unique(h, return_index=True, return_inverse=True)
        self.net = lattice(self.chars, self.begin[some], self.finish[some], v)

    def walk(self, path: np.ndarray, at: np.ndarray, node: np.ndarray, stop: np.ndarray, sample: int) -> None:
        """From each (character, node) on to the end of its cut, by conditional probabilities; edges go into path by character."""
        net = self.net
        while len(at):
            u = draws(self.keys[self.text[at]], sample, at - self.ends[self.text[at]])
            edge = net.starts[node]  # where the draw lies beyond an edge, the next one is tried
            beyond = np.flatnonzero(u >= net.upto[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[u[beyond] >= net.upto[edge[beyond]]]
            path[at] = edge
            to = net.to[edge]
            at = at + (to - node)
            on = np.flatnonzero(to < stop)
            at, node, stop = at[on], to[on], stop[on]

    def sample(self, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each sample: (has one, path, log p, perturbed log p) by text, then kappa; the path holds an edge where a piece starts."""
        net, texts = self.net, len(self.ends) - 1
        ids = np.arange(texts)
        path = np.full(len(self.chars), -1, np.int64)
        node = net.first[self.cut]
        stop = node + net.size[self.cut]
        self.walk(path, self.begin.copy(), node.copy(), stop.copy(), 0)
        value = -np.log(-np.log(draws(self.keys, 0, 1 << 40)))
        has = np.ones(texts, bool)
        empty = np.diff(self.ends) == 0
        out, pools, taken = [], [], {}
        branch = np.full(texts, -1)
        for s in range(k):
            at = np.flatnonzero(path >= 0)
            edge, text = path[at], self.text[at]
            logp = net.logp[edge]
            sums = np.concatenate([[0], np.cumsum(logp)])
            first = np.searchsorted(at, self.ends)
            total = (sums[first[1:]] - sums[first[:-1]]) / UNIT
            out.append((has, path, np.where(has, total, -np.inf), value))
            # the regions beside this path, from where it left the one before
            before = (sums[:-1] - sums[first[:-1]][text]) / UNIT
            rest = 1 - net.p[edge]
            for i in np.flatnonzero(branch >= 0):
                if has[i]:
                    j = np.searchsorted(at, branch[i])
                    rest[j] = max(0.0, 1 - net.p[list(taken[i, self.prefix(path, i, int(branch[i]))])].sum())
            rest[rest < 1e-12] = 0.0
            mass = np.where((rest > 0) & has[text] & (at >= branch[text]), before + np.log(np.maximum(rest, 1e-300)), -np.inf)
            e = -np.log(draws(self.keys[text], s, at - self.ends[text], 7))
            with np.errstate(divide="ignore", over="ignore"):
                g = np.where(mass > -np.inf, mass - np.log(np.exp(np.minimum(mass - value[text], 700)) + e), -np.inf)
            pools.append([at, g, path, first])
            best = np.full(texts, -np.inf)
            where = np.zeros((texts, 2), np.int64)
            for q, (_, gq, _, fq) in enumerate(pools):
                some = np.flatnonzero(fq[1:] > fq[:-1])
                if not len(some):
                    continue
                top = np.maximum.reduceat(gq, fq[some])
                more = top > best[some]
                holds = np.flatnonzero(gq == np.repeat(top, np.diff(fq)[some]))
                j = holds[np.searchsorted(holds, fq[some])]
                best[some[more]] = top[more]
                where[some[more]] = np.column_stack([np.full(more.sum(), q), j[more]])
            if s == k - 1:
                break
            has = best > -np.inf
            has &= ~empty
            value = best
            new = np.full(len(self.chars), -1, np.int64)
            branch = np.full(texts, -1)
            rows = ids[has]
            chars = np.array([pools[q][0][j] for q, j in where[rows]], np.int64)
            cuts = np.searchsorted(self.begin, chars, side="right") - 1
            here = net.first[self.cut[cuts]] + chars - self.begin[cuts]
            until = (net.first + net.size)[self.cut[cuts]]
            u = draws(self.keys[rows], s + 1, chars - self.ends[rows], 11)
            picks = np.empty(len(rows), np.int64)
            for x, (i, c) in enumerate(zip(rows.tolist(), chars.tolist(), strict=True)):
                q, j = where[i]
                _, gq, pq, _ = pools[q]
                gq[j] = -np.inf  # taken; what is left of it comes back beside the new path
                used = taken.setdefault((i, self.prefix(pq, i, c)), {int(pq[c])})
                free = [e for e in range(int(net.starts[here[x]]), int(net.starts[here[x] + 1])) if e not in used]
                sums = np.cumsum(net.p[free])
                picks[x] = free[min(int(np.searchsorted(sums, u[x] * sums[-1], side="right")), len(free) - 1)]
                used.add(int(picks[x]))
                new[self.ends[i] : c] = pq[self.ends[i] : c]
            new[chars] = picks
            branch[rows] = chars
            reached = net.to[picks]
            on = np.flatnonzero(reached < until)
            later = np.flatnonzero(has[self.text[self.begin]] & (self.begin > branch[self.text[self.begin]]))
            self.walk(new, np.concatenate([(chars + reached - here)[on], self.begin[later]]),
                      np.concatenate([reached[on], net.first[self.cut[later]]]),
                      np.concatenate([until[on], (net.first + net.size)[self.cut[later]]]), s + 1)
            path = new
        self.kappa = best
        return out

    def prefix(self, path: np.ndarray, i: int, c: int) -> tuple[int, int, int]:
        """Names the prefix of text i's path before character c."""
        part = path[self.ends[i] : c]
        at = np.flatnonzero(part >= 0)
        return c, len(at), int(mix(part[at].astype(np.uint64) * np.uint64(_BASE) + mix(at.astype(np.uint64))).sum(dtype=np.uint64))

    def ids(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and each text's offsets."""
        at = np.flatnonzero(path >= 0)
        piece = self.net.piece[path[at]]
        out = np.where(piece >= 0, self.v.ids[np.maximum(piece, 0)], -1)
        offsets = np.searchsorted(at, self.ends)
        bytes_at = np.flatnonzero(piece < 0)
        if len(bytes_at):
            spelt = [self.v.byte_ids[np.frombuffer(spell(int(-1 - piece[j])), np.uint8)] for j in bytes_at]
            more = np.ones(len(out), np.int64)
            more[bytes_at] = [len(x) for x in spelt]
            moved = np.concatenate([[0], np.cumsum(more)])
            longer = np.repeat(out, more)
            longer[np.repeat(moved[bytes_at], more[bytes_at]) + np.concatenate([np.arange(len(x)) for x in spelt])] = np.concatenate(spelt)
            out, offsets = longer, moved[offsets]
        return out.astype(np.int32), offsets


ENCODED = "doc_id long, sample int, log_prob double, log_inclusion double, n_tokens int, ids array<int>"


def encode(docs: DataFrame, vocabulary: Vocabulary, k: int = 2, seed: int = 0) -> DataFrame:
    """Up to k rows per document: doc_id, sample (0 first), log_prob, log_inclusion, n_tokens, ids. Other columns of docs are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 1 << 19):
            batch = Batch(b.column("text"), b.column("key").to_numpy(), vocabulary)
            for s, (has, path, logp, _) in enumerate(batch.sample(k)):
                rows = np.flatnonzero(has)
                if not len(rows):
                    continue
                ids, at = batch.ids(path)
                with np.errstate(over="ignore", divide="ignore"):
                    rate = np.exp(np.minimum(logp - batch.kappa, 700))
                    inside = np.where(rate < 1e-8, logp - batch.kappa, np.log(-np.expm1(-rate)))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                took = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(took), pa.array(np.full(len(rows), s), pa.int32()), pa.array(logp[rows]),
                     pa.array(np.minimum(inside, 0.0)[rows]), pa.array(np.diff(at)[rows], pa.int32()), lists.take(took)],
                    ["doc_id", "sample", "log_prob", "log_inclusion", "n_tokens", "ids"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", text).alias("key"), text.alias("text")).mapInArrow(run, ENCODED)


def decode_ids(ids, spelt: list[bytes]) -> str:
    return b"".join([spelt[i] for i in ids])[1:].decode("utf-8", "replace")


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id", "sample")) -> DataFrame:
    """The `keep` columns and the text that `ids` spell; null ids give null, ids outside the vocabulary raise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = [None if x is None else decode_ids(x, vocabulary.spelt) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return encoded.select(*keep, "ids").mapInArrow(run, f"{fields}, text string")
