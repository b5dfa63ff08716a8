"""Spelling variants, token files and hard negatives against plain Python."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickweave.llm import hard_negatives as hn
from tickweave.llm import spelling, token_files
from tickweave.llm.common import table
from tickweave.llm.q_words import op11, op12

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")


def small_words(rows, every=97, least=5, count=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def brute_variants(words, ratio=2):
    """By all strings one deletion away: equal ones are near, as are two words with a common one at the same place."""
    near, shorter = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
            shorter[cut, i].add(w)
    for group in shorter.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_of_the_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    want = brute_variants(small_words(docs))
    assert rows_of(op11(spark, sf)) == want and any(w[0] for w in want.values())


@pytest.mark.parametrize("capacity", [1 << 21, 40])
def test_variants_of_close_words(spark, capacity, monkeypatch):
    """Dense neighbourhoods, chains of forms, long words; a small capacity cuts lengths into parts and the work into jobs."""
    if capacity < 100:
        monkeypatch.setattr(spelling, "LOAD", 2000)
    r = random.Random(3)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(1, 7))): 2 ** r.randint(0, 9) for _ in range(900)}
    words |= {"chain"[:5] + "x" * k: 1000 - 0 * k if k == 0 else 500 // 2**k + 1 for k in range(8)}
    words |= {"y" * 3000: 7, "y" * 3001: 20, "aab": 3, "aa": 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(df, capacity=capacity)) == brute_variants(words)


def test_variants_of_messy_rows(spark, messy, messy_rows, empty):
    got = rows_of(spelling.variants(spelling.vocabulary(messy, every=5, least=3, count=2)))
    assert got == brute_variants(small_words([r[:2] for r in messy_rows], every=5, least=3, count=2))
    assert rows_of(spelling.variants(spelling.vocabulary(empty))) == {}


def ids_of(rows, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [(i, t.encode(text or "", add_special_tokens=False).ids + [end]) for i, text in rows]


def read_back(df):
    return [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in df.orderBy("start").collect()]


ODD = ["don't “quoted”. a… x<|endoftext|>, <|startoftext|>!! É́́. İstanbul, 3.14%$ it's. he'll! ''s ﬀ́,", "á, é́!! ́, \x1cfoo\x1d, a\xa0b. \x85, 12a!b, a≠, x̸ =b", "ΑΣ. ΑΣ! ΣΑΣ",
       "<|endoftext|>. <|ENDOFTEXT|>! a<|endoftext|>b, 9's.", "'''. a'. a'b.. -- 5% 五% x́%"]


@pytest.mark.parametrize("words", [True, False])
def test_files_hold_the_ids_of_whole_texts(spark, messy, messy_rows, words):
    rows = [r[:2] for r in messy_rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = messy.select("doc_id", "text").union(spark.createDataFrame(rows[len(messy_rows) :], "doc_id long, text string"))
    folder = token_files.write(docs, PATH, words=words, file_bytes=3000)
    want = sorted(ids_of(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = read_back(token_files.read(spark, folder))
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1])) == want
    assert [r[0] for r in got] == [r[0] for r in want]
    starts = token_files.read(spark, folder).orderBy("start").select("start", "n_tokens").collect()
    assert [r["start"] for r in starts] == [sum(len(x) for _, x in got[:i]) for i in range(len(got))]
    assert token_files.manifest(spark, folder).count() > 3
    some = read_back(token_files.read(spark, folder, 5, 1001))
    assert some == [r for r in got if r[0] is not None and 5 <= r[0] <= 1001]


def test_one_document_by_its_index_entry(spark, messy, tmp_path):
    folder = token_files.write(messy.where("doc_id is not null"), PATH, folder=str(tmp_path / "ids"), words=True)
    dictionary = (tmp_path / "ids" / "dictionary.zdict").read_bytes()
    codec, found = token_files.Codec(dictionary), {}
    whole = read_back(token_files.read(spark, folder))
    for row in token_files.manifest(spark, folder).collect():
        with pa.fs.LocalFileSystem().open_input_file(f"{folder}/{row['file']}") as f:
            reader = token_files.FileReader(f, codec)
            for i in {d for d, _ in whole if row["first_id"] <= d <= row["last_id"]}:
                found[i] = [x.tolist() for x in reader.find(i)]
            assert reader.find(10**9) == []
            with pytest.raises(ValueError, match="dictionary"):
                token_files.FileReader(f, token_files.Codec(b"another" * 9))
    assert all(sorted(found[i]) == sorted(ids for d, ids in whole if d == i) for i in found) and len(found) == len({d for d, _ in whole})


def test_files_of_an_empty_table_and_wide_ids(spark, empty):
    assert token_files.read(spark, token_files.write(empty, PATH)).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    folder = token_files.write(docs, PATH, end=70_000)
    assert [r[1][-1] for r in read_back(token_files.read(spark, folder))] == [70_000, 70_000]


def test_the_query_reads_the_files(spark, sf):
    docs = table(spark, sf, "documents").orderBy("doc_id").collect()
    start, want = 0, []
    for i, ids in ids_of([(r["doc_id"], r["text"]) for r in docs]):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = op12(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_subset_sums_give_inner_products():
    r = np.random.default_rng(0)
    for most, planes, kind in ((1, 2, np.int32), (145, 9, np.int32), (1 << 28, 30, np.int64)):
        a, c = r.integers(-most, most + 1, (5, 24)), r.integers(-most, most + 1, (30, 24))
        a[0], c[0], c[1] = most, -most, most
        assert (hn.scores(hn.tables(a.astype(kind)), hn.packed(c, planes)) == c @ a.T).all()


def brute_negatives(rows, positives=5, negatives=3, scale=256):
    use = []
    for at, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            use.append((at, i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label))
    out = []
    for at, i, q, label in use:
        if i is None or i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, w, strict=False)), j is None, j or 0, other) for n, j, w, other in use if n != at]
        for p in sorted(s for s in scored if s[3] == label)[:positives]:
            fit = sorted(s for s in scored if s[3] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0])[:negatives]
            out += [(i, None if p[1] else p[2], k + 1, None if s[1] else s[2], -p[0], -s[0]) for k, s in enumerate(fit)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("batch", [4 << 20, 300])
def test_negatives_of_messy_rows(spark, batch):
    """Ties, repeated rows and ids, shorter and empty vectors, nulls; a small batch makes several jobs."""
    r = random.Random(1)
    rows = [(r.choice([None, 0, 50, 100, *range(-60, 300)]), [r.choice([-0.5, 0.0, 0.25, 0.013, 1.0]) for _ in range(r.choice([9, 9, 9, 3, 0]))],
             r.choice([0, 1, 1, 2, None])) for _ in range(250)]
    rows += rows[:30] + [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")], 1), (4, [float("inf"), 1.0], 2), (5, [float("-inf")], None)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"row": F.lit(1), "score": F.lit(2), "q": F.lit("x")}).repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % 50 == 0, batch=batch)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_without_anchors_and_beyond_64_bits(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hn.hard_negatives(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], VECTORS), F.col("vec_id") % 50 == 0).count() == 0
    for x in (1e8, 3e38, -3e38):
        with pytest.raises(ValueError, match="64 bits"):
            hn.hard_negatives(spark.createDataFrame([(0, [x, 1.0], 1)], VECTORS), F.col("vec_id") % 50 == 0)


def test_words_are_learnt_once_and_not_held_one_by_one(monkeypatch):
    """Ids of texts put together from words are those of whole texts; a text's words do not become Python objects each."""
    r = random.Random(5)
    odd = ["don't", "a!b", "!!!", "end!", "x...", "É.", "é", "'s", "it's,", "<|endoftext|>", "a<|endoftext|>.", "A<|ENDOFTEXT|>", "1,2", " ", "\u0085x", "日本。", "𠮷?", "ß", "İ.", "_", "a_", "--", "“q”", "\x1c"]
    words = odd + ["".join(r.choice("abcXYZ") for _ in range(r.randint(1, 7))) + r.choice(["", ".", ",", "!?", "'"]) for _ in range(1500)]
    texts = [None, "", " ", "\n a\x0b\x0cb\t"] + ["".join(r.choice(words) + r.choice([" ", "\n", "  ", "\t\r"]) for _ in range(300)) for _ in range(40)]
    whole, parts = token_files.Encoder(PATH, 1, False), token_files.Encoder(PATH, 1, True)
    column = pa.array(["cut off", *texts], pa.string()).slice(1)
    assert list(parts.encode(column)) == list(whole.encode(column))
    monkeypatch.setattr(token_files.Encoder, "CACHE", 100)
    for n in (7, 1):
        for lo in range(0, len(column), n):
            assert list(parts.encode(column.slice(lo, n))) == list(whole.encode(column.slice(lo, n)))
    monkeypatch.setattr(token_files.Encoder, "CACHE", 1 << 20)
    column = pa.array([" ".join(r.choice(words) for _ in range(20_000))])
    first = list(parts.encode(column))
    before, again = sys.getallocatedblocks(), parts.encode(column)
    assert next(again) == first[0] and sys.getallocatedblocks() - before < 5000
