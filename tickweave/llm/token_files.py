"""Operator 12, token ids as binary files: each document is one zstandard frame, compressed with a dictionary all of them share.

1. The dictionary is trained on the serialized ids of a bounded sample: the `sample` texts with the smallest hash among those of
   at most `LONGEST` code points (longer ones need no dictionary). Too few samples to train on are taken as they are.
2. Every text is encoded and compressed once; the frames, not the texts, are ranged by doc_id (null last, then by the frame's
   hash), so files and the documents in them rise with doc_id.
3. A task writes files of about `FILE` bytes under names of its own and returns a row for each: the manifest. Files of a lost
   attempt are in no manifest. The folder is opened by pyarrow's file systems (a path, file:, s3:, gs:, hdfs:).

A file: MAGIC, the frames, the index, the footer (JSON) and its length (8 bytes, little-endian). Ids are little-endian integers
of `width` bytes, 2 for vocabularies up to 65,536 ids, else 4. The index has five arrays of 8 bytes a document: doc_id, 1 if it
has one, offset of the frame, its bytes, number of ids. The footer names the dictionary by its sha256: one document is
read by its index entry, its frame and the dictionary, and a reader with another dictionary is refused.

Null and empty texts are the end id alone. Rows that repeat a doc_id stand one after the other; other columns are ignored.
An empty table has no files.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.session import shared_dir

from .common import partitions, small_batches, smallest, text_bytes, written

MAGIC = b"IDZ1"
MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
LONGEST, DICTIONARY, FILE, READ, BATCH, LINE = 1 << 14, 112_640, 64 << 20, 4 << 20, 4 << 20, 512
FRAMES = "doc_id long, n_tokens long, frame binary"
MANIFEST = "block int, nth int, file string, n_docs long, n_tokens long, first_id long, last_id long, has_null boolean"


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(("s3" if scheme == "s3a" else scheme) + ":" + rest)


class Encoder:
    """Ids of texts by a file of the tokenizers library, `end` appended, as little-endian bytes.

    words: encode each distinct word `[^\\x20\\x09-\\x0D]+` once, its last punctuation marks by themselves, and put the texts
    together from them. Only for tokenizers that first split at white space, which they drop, and between letters or
    digits and punctuation, such as word_bpe_49k.json; they give the same ids as whole texts. Words with added tokens in them stay whole.
    """

    CACHE = 3 << 18

    def __init__(self, path: str, end: int, words: bool):
        self.path, self.end, self.words = path, end, words

    @cached_property
    def tokenizer(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), self.end + 1) <= 1 << 16 else "<u4")

    def clear(self) -> None:
        """Of the known words: themselves, where their ids start in `flat`, and how many they are."""
        self.known, self.flat = pa.array([], pa.large_string()), np.zeros(0, self.kind)
        self.first = self.size = np.zeros(0, np.int64)

    @cached_property
    def added(self) -> re.Pattern:
        found = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        return re.compile(b"|".join(found) or rb"(?!)")

    def _holds_added(self, words: pa.Array) -> pa.Array:
        data, at = text_bytes(words)
        raw = data.tobytes()
        if not self.added.search(raw):
            return pa.repeat(False, len(words))
        return pa.array([self.added.search(raw[lo:hi]) is not None for lo, hi in zip(at, at[1:], strict=False)], pa.bool_())

    def _cut(self, words: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Which words end in ASCII marks (no apostrophes) after an ASCII letter or digit; these without the marks, and the marks."""
        body = pc.ascii_rtrim(words, MARKS)
        cut = pc.and_(pc.and_not(pc.not_equal(body, words), self._holds_added(words)), pc.match_substring_regex(body, r"[A-Za-z0-9]\z"))
        return cut, body.filter(cut), pc.replace_substring_regex(words.filter(cut), "^.*[A-Za-z0-9]", "")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @cached_property
    def mark(self) -> int:
        """The id of an exclamation mark by itself, -1 if it has several."""
        ids = self.tokenizer.encode("!", add_special_tokens=False).ids
        return ids[0] if len(ids) == 1 else -1

    @cached_property
    def folds(self) -> bool:
        """Whether the tokenizer lowers letters before anything else looks at them."""
        return '"type":"Lowercase"' in self.tokenizer.to_str().replace(" ", "")

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words by themselves, where each begins in them, and how many it has.

        Words are encoded as texts of LINE words with exclamation marks between them, by which the ids are told apart.
        """
        alone = pc.or_(pc.match_substring(words, "!"), self._holds_added(words))
        rest = words.filter(pc.invert(alone))
        cuts = [rest.slice(i, LINE).to_pylist() for i in range(0, len(rest), LINE)]
        lines = self._ids([" ! ".join(x) for x in cuts])
        if any(np.count_nonzero(x == self.mark) != len(c) - 1 for x, c in zip(lines, cuts, strict=True)):
            alone, lines = pa.repeat(True, len(words)), []
        parts = self._ids(words.filter(alone).to_pylist())
        one = np.array([self.mark], self.kind)
        told = np.concatenate([y for x in lines for y in (x, one)]) if lines else np.zeros(0, self.kind)
        ends = np.flatnonzero(told == self.mark) if lines else np.zeros(0, np.int64)
        first, size, odd = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), alone.to_numpy(zero_copy_only=False)
        first[~odd] = np.concatenate([[0], ends + 1])[: len(ends)]
        size[~odd] = ends - first[~odd]
        size[odd] = np.fromiter(map(len, parts), np.int64, len(parts))
        first[odd] = len(told) + np.cumsum(size[odd]) - size[odd]
        return np.concatenate([told, *parts]), first, size

    def _add(self, words: pa.Array, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.first, self.size = np.concatenate([self.first, len(self.flat) + first]), np.concatenate([self.size, size])
        self.flat, self.known = np.concatenate([self.flat, flat]), pa.concat_arrays([self.known, words])

    def _of(self, nth: np.ndarray) -> np.ndarray:
        """The ids of these known words, one after the other."""
        size = self.size[nth]
        return self.flat[np.repeat(self.first[nth] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of different words among the known ones, to which those are added that are not there."""
        if not hasattr(self, "known") or len(self.known) > self.CACHE:
            self.clear()
        at, new = found(words, self.known)
        words = words.filter(pa.array(new))
        cut, body, marks = self._cut(words)
        plain = words.filter(pc.invert(cut))
        pieces = pc.unique(pa.concat_arrays([plain, body, marks]))
        nth, unknown = found(pieces, self.known)
        nth[unknown] = len(self.known) + np.arange(np.count_nonzero(unknown))
        self._add(fresh := pieces.filter(pa.array(unknown)), *self._word_ids(fresh))
        body, marks = nth[found(body, pieces)[0]], nth[found(marks, pieces)[0]]
        size, whole = self.size[body] + self.size[marks], np.zeros(len(words), np.int64)
        whole[is_cut := cut.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(body))
        whole[~is_cut] = nth[found(plain, pieces)[0]]
        self._add(words.filter(cut), self._of(np.column_stack([body, marks]).ravel()), np.cumsum(size) - size, size)
        at[new] = whole
        return at

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        data, at = text_bytes(texts)
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(data))
        last = np.array([self.end], self.kind).tobytes()
        if not self.words:
            yield from (ids.tobytes() + last for ids in self._ids(texts.to_pylist()))
            return
        if self.folds:
            low = pc.ascii_lower(texts)
            texts = pc.if_else(self._holds_added(low), texts, low)
        split = pc.ascii_split_whitespace(texts)  # with an empty word, which has no ids, where white space begins or ends a text
        words = split.flatten().dictionary_encode()
        nth = self._numbers(words.dictionary)[words.indices.to_numpy()]
        ids, ends = self._of(nth), np.concatenate([[0], np.cumsum(self.size[nth])])
        at = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])].tolist()
        yield from (ids[lo:hi].tobytes() + last for lo, hi in zip(at, at[1:], strict=False))


def found(words: pa.Array, among: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of words in an array of different ones, and which are not there."""
    at = pc.index_in(words, among)
    return at.fill_null(-1).to_numpy().astype(np.int64), at.is_null().to_numpy(zero_copy_only=False)


@lru_cache(2)
def encoder(path: str, end: int, words: bool) -> Encoder:
    """One for each worker process, so that its words are kept over tasks."""
    return Encoder(path, end, words)


def trained(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; their own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Codec:
    def __init__(self, dictionary: bytes, level: int = 1):
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.hash = hashlib.sha256(dictionary).hexdigest()
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, **shared).compress
        self.decompress = zstandard.ZstdDecompressor(**shared).decompress


class FileWriter:
    """Frames of rising doc_id to the bytes of one file."""

    def __init__(self, sink):
        self.sink, self.rows, self.at = sink, [], len(MAGIC)
        sink.write(MAGIC)

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self.rows.append((doc_id or 0, doc_id is not None, self.at, len(frame), n_tokens))
        self.sink.write(frame)
        self.at += len(frame)

    def close(self, dictionary: str, width: int) -> None:
        self.sink.write(np.array(self.rows, "<i8").reshape(-1, 5).T.tobytes())
        footer = json.dumps({"dictionary": dictionary, "width": width, "docs": len(self.rows), "index": self.at}).encode()
        self.sink.write(footer + len(footer).to_bytes(8, "little"))


class FileReader:
    """Documents of one file by number or doc_id: the footer and the index are read at once, frames when they are asked for."""

    def __init__(self, source, codec: Codec):
        self.source, self.codec = source, codec
        size = source.size()
        source.seek(max(0, size - (1 << 16)))
        tail = source.read()
        n = int.from_bytes(tail[-8:], "little")
        self.footer = json.loads(tail[-8 - n : -8])
        if self.footer["dictionary"] != codec.hash:
            raise ValueError(f"the file was written with dictionary {self.footer['dictionary']}, not {codec.hash}")
        source.seek(self.footer["index"])
        fields = np.frombuffer(source.read(40 * self.footer["docs"]), "<i8").reshape(5, -1)
        self.doc_id, self.has_id, self.offset, self.size, self.n_tokens = fields
        self.kind = np.dtype(f"<u{self.footer['width']}")

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.codec.decompress(frame), self.kind)

    def document(self, i: int) -> np.ndarray:
        self.source.seek(int(self.offset[i]))
        return self._ids(self.source.read(int(self.size[i])))

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all rows with this doc_id."""
        n = int(self.has_id.sum())
        lo, hi = (int(np.searchsorted(self.doc_id[:n], doc_id, s)) for s in ("left", "right"))
        return [self.document(i) for i in range(lo, hi)]

    def all(self, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of the documents lo to hi, read in stretches of about READ bytes."""
        hi = len(self.offset) if hi is None else hi
        while lo < hi:
            to = max(lo + 1, min(hi, int(np.searchsorted(self.offset, self.offset[lo] + READ))))
            self.source.seek(int(self.offset[lo]))
            raw = self.source.read(int(self.offset[to - 1] + self.size[to - 1] - self.offset[lo]))
            for i in range(lo, to):
                begin = int(self.offset[i] - self.offset[lo])
                yield i, self._ids(raw[begin : begin + int(self.size[i])])
            lo = to


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = 1, words: bool = False, sample: int = 2048,
          file_bytes: int = FILE) -> str:
    """The folder with the files, dictionary.zdict and the table manifest. tokenizer: a path that all executors have."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(encoder(tokenizer, end, words).encode(b.column("text")), pa.binary())], ["ids"])

    hashed = texts.where((F.length("text") > 0) & (F.length("text") <= LONGEST)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    some = smallest(hashed, "h", docs.count(), sample, "text").select("text").repartition(partitions(spark)).mapInArrow(ids, "ids binary").orderBy(F.xxhash64("ids"), "ids")
    dictionary = trained(some.toArrow().column("ids").to_pylist())
    fs, root = store(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(dictionary)
    held = spark.sparkContext.broadcast(dictionary)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, coder = Codec(held.value), encoder(tokenizer, end, words)
        for b in small_batches(batches, "text", BATCH):
            found = [(len(x) // coder.kind.itemsize, codec.compress(x)) for x in coder.encode(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([f for _, f in found], pa.binary())],
                ["doc_id", "n_tokens", "frame"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        fs, root = store(folder)
        block, codec, width = TaskContext.get().partitionId(), Codec(held.value), encoder(tokenizer, end, words).kind.itemsize
        open_file, nth = None, 0

        def closed() -> pa.RecordBatch:
            name, out, w = open_file
            w.close(codec.hash, width)
            out.close()
            some = [r[0] for r in w.rows if r[1]]
            row = {"block": block, "nth": nth, "file": name, "n_docs": len(w.rows), "n_tokens": sum(r[4] for r in w.rows),
                   "first_id": some[0] if some else None, "last_id": some[-1] if some else None, "has_null": len(some) < len(w.rows)}
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.bool_()]
            return pa.RecordBatch.from_pylist([row], pa.schema(list(zip(row, kinds, strict=True))))

        for b in batches:
            for doc_id, n, frame in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame")), strict=True):
                if open_file is None:
                    name = f"part-{block:05d}-{nth:03d}-{uuid.uuid4().hex[:12]}.idz"
                    out = fs.open_output_stream(f"{root}/{name}")
                    open_file = name, out, FileWriter(out)
                open_file[2].add(doc_id, n, frame)
                if open_file[2].at >= file_bytes:
                    yield closed()
                    open_file, nth = None, nth + 1
        if open_file is not None:
            yield closed()

    encoded = written(texts.mapInArrow(frames, FRAMES), "token-frames")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("frame").asc()]
    ranged = encoded.repartitionByRange(partitions(spark), *order, F.monotonically_increasing_id().asc()).sortWithinPartitions(*order)
    ranged.mapInArrow(files, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: its rank, documents, ids, doc_id range, and `start`, the ids in the files before it.

    Files are ranked in one task: a row for each file of some 64 MB.
    """
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of all documents, or of those with low <= doc_id <= high.

    With bounds only the files that hold such ids are opened, and only the frames between them are read.
    """
    found = manifest(spark, folder)
    if low is not None or high is not None:
        low, high = -(1 << 63) if low is None else low, (1 << 63) - 1 if high is None else high
        found = found.where((F.col("last_id") >= low) & (F.col("first_id") <= high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        with fs.open_input_file(f"{root}/dictionary.zdict") as f:
            codec = Codec(f.read())
        for b in batches:
            for row in b.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    yield from documents(FileReader(source, codec), row["start"])

    def documents(file: FileReader, start: int) -> Iterator[pa.RecordBatch]:
        starts = start + np.cumsum(file.n_tokens) - file.n_tokens
        lo, hi = 0, len(starts)
        if low is not None:
            n = int(file.has_id.sum())
            lo, hi = int(np.searchsorted(file.doc_id[:n], low)), int(np.searchsorted(file.doc_id[:n], high, "right"))
        held, rows = io.BytesIO(), []
        for i, ids in file.all(lo, hi):
            rows.append(i)
            held.write(ids.astype("<u4").tobytes())
            if held.tell() > READ:
                yield batch(file, starts, rows, held)
                held, rows = io.BytesIO(), []
        if rows:
            yield batch(file, starts, rows, held)

    def batch(file: FileReader, starts: np.ndarray, rows: list[int], held: io.BytesIO) -> pa.RecordBatch:
        n = file.n_tokens[rows]
        ends = np.concatenate([[0], np.cumsum(4 * n)])
        ids = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(held.getvalue())])
        names = pa.array(file.doc_id[rows], mask=file.has_id[rows] == 0)
        return pa.RecordBatch.from_arrays([names, pa.array(starts[rows]), pa.array(n), ids.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return found.select("file", "start").repartition(partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
