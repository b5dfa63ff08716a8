"""Operator 5, n-gram Jaccard join: a grouped prefix join over word shingles, exact.

A document's set: hashes of its distinct runs of `words` words; a shorter text with words has one run, of all of them; a
text without words has none and links with nothing. Two documents link when `100 * intersection >= percent * union`.

Equal sets are one class. In one global order of tokens, two sets that link share tokens in their first
`size - ceil(percent * size / 100) + 1` tokens; with `s` more tokens in that prefix they share `s + 1` (s being the smaller
of the two documents' surplus). Classes with the same prefix and size are one group, and groups are joined instead.

* First join, all groups, tokens in order of hash, surplus `SURPLUS` percent of the size. A token in more than `frequent` classes is
  frequent. Frequent tokens are left out: if a class has no more of them in its prefix than the surplus of any partner, a
  class it links with shares another token. Buckets of the others hold `frequent` classes at most.
* Second join, only the classes with more frequent tokens than that (large groups of near copies, and texts made of widely
  shared passages): tokens in order of their frequency among these classes, the rarest first. Large buckets are not
  paired out: in ROUNDS rounds each unit (the members of one group in one component so far) is verified against one leader
  of each of its buckets, and what links becomes one component; then only members of different components are paired, at
  the first token they share, and if their parity maps do not differ in more bits than the tokens they may not share.

Pairs of groups pass size and position filters; then members are expanded and verified by intersection. Components of the
links are found by star operations. Every pair that links is verified or lies in one component already.

Null and empty text: size 0, its own component. Repeated rows are one class; a component's id is its smallest doc_id (null
only if all are). Hashes have 64 bits, a set's signature 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .components import components
from .words import mix, shingles, word_hashes

ROUNDS = 1
LAST = 16  # tokens before an entry that it carries
LARGE = 64  # members from which a component's are not held against each other
SURPLUS = 4  # percent of the size
SMALL = 500_000  # rows of at most 40 bytes up to which a list of ids is broadcast (20 MB); beyond it is joined by shuffle


def prefix_size(size, percent: int):
    return size - -(-percent * size // 100) + 1


def surplus(size, percent: int):
    return size * SURPLUS // 100 + 1


def sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (signed) of each text."""
    h, at = shingles(*word_hashes(texts), words)
    h = h.view(np.int64)
    for lo, hi in zip(at, at[1:], strict=False):
        yield np.unique(h[lo:hi])


def signature(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    return tuple(int(mix(u ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) if len(u) else 0 for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


SKETCH = "doc_id long, size long, sig_a long, sig_b long, sig_p long, prefix array<long>"
FULL = "size long, sig_a long, sig_b long, tokens array<long>, bits array<long>"
BITS = 1024  # of a set's parity map: the bit of each token's hash is flipped


def sketcher(words: int, percent: int, whole: bool):
    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 2 << 20):
            found = list(sets(b.column("text"), words))
            sizes = np.array([len(s) for s in found])
            signs = np.array([signature(s) for s in found], np.int64).reshape(-1, 2)
            columns = [pa.array(sizes, pa.int64()), pa.array(signs[:, 0]), pa.array(signs[:, 1])]
            if whole:
                maps = [np.packbits((np.bincount((x.view(np.uint64) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)
                        for x in found]
                yield pa.RecordBatch.from_arrays([*columns, lists(found), lists(maps)], ["size", "sig_a", "sig_b", "tokens", "bits"])
                continue
            heads = [s[: prefix_size(len(s), percent) + surplus(len(s), percent)] if len(s) else s for s in found]
            marks = np.array([signature(h)[0] for h in heads], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(marks), lists(heads)],
                                             ["doc_id", "size", "sig_a", "sig_b", "sig_p", "prefix"])

    return run


def least(size_a: Column, size_b: Column, percent: int) -> Column:
    """The smallest intersection with which two sets of these sizes link."""
    return F.ceil(percent * (size_a + size_b) / (100 + percent))


def may_link(a: str, b: str, percent: int) -> Column:
    """Size and position filter of two entries of a token: what stands before in both, the token, and what is left."""
    sa, sb, pa_, pb = (F.col(c) for c in (f"{a}.size", f"{b}.size", f"{a}.pos", f"{b}.pos"))
    most = F.least(pa_, pb) + 1 + F.least(sa - pa_ - 1, sb - pb - 1)
    return (100 * F.least(sa, sb) >= percent * F.greatest(sa, sb)) & (most >= least(sa, sb, percent))


def bounded(ids: DataFrame) -> DataFrame:
    """A narrow table, marked for broadcast if its counted rows are few enough; else it is joined by shuffle."""
    ids = written(ids, "jaccard-ids")
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    pairs = written(pairs, "jaccard-checks")
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    full = full.join(F.broadcast(ids) if 2 * pairs.count() <= SMALL else ids, "rep", "left_semi")
    x = full.select(F.col("rep").alias("a"), F.col("size").alias("_sa"), F.col("tokens").alias("_ta"))
    y = full.select(F.col("rep").alias("b"), F.col("size").alias("_sb"), F.col("tokens").alias("_tb"))
    both = pairs.join(x, "a").join(y, "b").withColumn("_n", F.size(F.array_intersect("_ta", "_tb")))
    return both.where(F.col("_n") * (100 + percent) >= percent * (F.col("_sa") + F.col("_sb"))).select("a", "b")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def members_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """rep, size, tokens, bits of the wanted classes, from their texts; twice for a row that repeats doc_id and text."""
    keys = bounded(wanted.join(classes.select("rep", "rep_doc", "size", "sig_a", "sig_b"), "rep"))
    ids = keys.select(F.col("rep_doc").alias("doc_id"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    found = some.mapInArrow(sketcher(words, percent, True), FULL)
    return written(found.join(keys, ["size", "sig_a", "sig_b"]).select("rep", "size", "tokens", "bits"), "jaccard-sets")


def by_frequency(full: DataFrame, chosen: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries (token, pos, grp, size, before) and members (grp, rep) of the chosen classes, rarest tokens first; before: the tokens just before."""
    tokens = full.join(chosen, "rep", "left_semi").select("rep", "size", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    rare = tokens.join(shared, "token").groupBy("rep", "size").agg(F.sort_array(F.collect_set(F.struct("n", "token"))).alias("few"))
    alone = F.col("size") - F.size("few")  # tokens no other class has come first
    keep = F.col("size") - F.ceil(percent * F.col("size") / 100) + 1 - alone
    rows = rare.withColumns({"alone": alone, "keep": keep.cast("int")}).where("keep > 0")
    rows = rows.withColumn("prefix", F.transform(F.slice("few", F.lit(1), F.col("keep")), lambda t: t["token"]))
    rows = written(rows.withColumn("sig", F.xxhash64("prefix", "alone")).select("rep", "size", "alone", "prefix", "sig"), "jaccard-rare")
    groups = rows.groupBy("size", "sig").agg(F.min("rep").alias("grp"))
    entries = rows.join(groups.select("grp"), rows["rep"] == F.col("grp")).select(
        "grp", "size", "alone", "prefix", F.posexplode("prefix").alias("k", "token"))
    before = F.slice("prefix", F.greatest(F.col("k") - LAST + 1, F.lit(1)), F.least(F.col("k"), F.lit(LAST)))
    entries = entries.select("token", (F.col("k") + F.col("alone")).alias("pos"), "grp", "size", before.alias("before"))
    return written(entries, "jaccard-entries"), written(rows.select("size", "sig", "rep").join(groups, ["size", "sig"]).select("grp", "rep"), "jaccard-members")


def differ(a: str, b: str) -> Column:
    """A lower bound of the tokens that two sets do not share: the bits in which their parity maps differ."""
    bits = [F.bit_count(F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))) for i in range(BITS // 64)]
    return sum(bits[1:], bits[0])


def crowded(full: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """All links needed among classes whose tokens are frequent: leaders first, then classes of different components."""
    entries, members = by_frequency(full, chosen, percent)
    links = None
    if not entries.take(1):
        return full.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    maps = full.select(F.col("rep").alias("unit"), "bits").dropDuplicates(["unit"])
    near = may_link("x", "y", percent) & (
        differ("x", "y") <= F.col("x.size") + F.col("y.size") - 2 * least(F.col("x.size"), F.col("y.size"), percent))
    for step in range(ROUNDS + 1):
        if links is None:
            placed = members.withColumn("comp", F.col("rep"))
        else:
            comp = components(links)
            placed = members.join(comp, members["rep"] == comp["node"], "left").select("grp", "rep", F.coalesce("component", "rep").alias("comp"))
        if step < ROUNDS:  # one unit stands for the members of a group that are in one component
            units = placed.groupBy("grp", "comp").agg(F.min("rep").alias("unit"))
        else:
            units = placed.select("grp", "comp", F.col("rep").alias("unit"))
        rows = written(entries.join(units, "grp").join(maps, "unit"), "jaccard-rows")
        x, y = rows.alias("x"), rows.alias("y")
        if step < ROUNDS:
            turn = F.xxhash64("unit", "token", F.lit(step))  # another leader in each bucket
            lead = rows.groupBy("token").agg(F.max(turn).alias("turn"), F.count("*").alias("n")).where("n > 1").select("token", "turn")
            y = rows.withColumn("turn", turn).join(lead, ["token", "turn"]).alias("y")
            pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & near)
        else:
            # classes that share one of the tokens just before meet there already
            first = ~F.coalesce(F.arrays_overlap("x.before", "y.before"), F.lit(False))
            size = rows.groupBy("comp").agg((F.countDistinct("unit") > LARGE).alias("large"))
            rows = written(rows.join(size, "comp"), "jaccard-rows")
            # large components against each other, pair by pair of components; all others within their buckets, so that the
            # members of a large component are not held against each other
            spans = rows.where("large").groupBy("token", "comp").agg(F.count("*").alias("n"))
            p, q = spans.alias("p"), spans.alias("q")
            meet = p.join(q, (F.col("p.token") == F.col("q.token")) & (F.col("p.comp") != F.col("q.comp"))
                          & (F.struct("p.n", "p.comp") < F.struct("q.n", "q.comp")))
            meet = meet.select(F.col("p.token").alias("token"), F.col("p.comp").alias("c"), F.col("q.comp").alias("d")).alias("m")
            x, y = rows.where("large").alias("x"), rows.where("large").alias("y")
            both = (meet.join(x, (F.col("m.token") == F.col("x.token")) & (F.col("m.c") == F.col("x.comp")))
                    .join(y, (F.col("m.token") == F.col("y.token")) & (F.col("m.d") == F.col("y.comp")) & near & first))
            x, y = rows.where("not large").alias("x"), rows.alias("y")
            other = F.col("y.large") | (F.col("x.comp") < F.col("y.comp"))
            pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & other & near & first)
            pairs = both.select("x.unit", F.col("y.unit").alias("other")).union(pairs.select("x.unit", "y.unit"))
            pairs = pairs.select(F.struct("unit").alias("x"), F.struct(F.col("other").alias("unit")).alias("y"))
        new = verified(pairs.select(*ordered(F.col("x.unit"), F.col("y.unit"))).distinct(), full, percent)
        links = written(new if links is None else links.union(new), "jaccard-links")
    return links


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, frequent: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id, sig_a, sig_b of each row. Other columns of docs are ignored."""
    text = F.coalesce("text", F.lit(""))
    sketch = docs.select("doc_id", text.alias("text")).mapInArrow(sketcher(words, percent, False), SKETCH)
    sketch = written(sketch.withColumn("row", F.monotonically_increasing_id()), "jaccard-sketch")
    key = ["size", "sig_a", "sig_b"]
    classes = sketch.where("size > 0").groupBy(*key, "sig_p").agg(F.min("row").alias("rep"))
    classes = classes.join(sketch.select(F.col("row").alias("rep"), F.col("doc_id").alias("rep_doc")), "rep")
    classes = written(classes, "jaccard-classes")
    groups = classes.groupBy("size", "sig_p").agg(F.min("rep").alias("grp"), F.count("*").alias("n"))
    groups = written(groups, "jaccard-groups")
    heads = sketch.select("row", "prefix").join(groups, F.col("row") == F.col("grp"))
    entries = heads.select("grp", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    shared = entries.groupBy("token").agg(F.sum("n").alias("c"), F.count("*").alias("g")).where((F.col("g") > 1) | (F.col("c") > frequent))
    rows = written(entries.drop("n").join(shared, "token").select("token", "pos", "grp", (F.col("c") > frequent).alias("hot")), "jaccard-shared")
    rows = rows.join(groups.select("grp", "size"), "grp")
    spare = F.floor(F.col("size") * percent * SURPLUS / 10000) + 1
    hot = written(rows.where("hot").groupBy("grp", "size").agg(F.count("*").alias("hot")), "jaccard-hot")
    chosen = hot.where(F.col("hot") > spare).select("grp")
    in_group = classes.join(groups, ["size", "sig_p"])
    chosen = written(in_group.join(chosen, "grp", "left_semi").select("rep"), "jaccard-chosen")

    x, y = rows.where("not hot").alias("x"), rows.where("not hot").alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.grp") < F.col("y.grp"))
                   & (100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")))
    pairs = pairs.withColumn("ok", may_link("x", "y", percent)).groupBy(
        F.col("x.grp").alias("g"), F.col("y.grp").alias("h"), F.col("x.size").alias("sg"), F.col("y.size").alias("sh")).agg(
        F.count("*").alias("common"), F.min("ok").alias("ok")).where("ok")  # every token that linked sets share passes
    for group in ("g", "h"):
        pairs = pairs.join(hot.select(F.col("grp").alias(group), F.col("hot").alias("hot_" + group)), group, "left")
    rest = [F.col(c) - F.least(F.col(c), F.col(c) - F.ceil(percent * F.col(c) / 100) + 2 + F.floor(SURPLUS * F.col(c) / 100)) for c in ("sg", "sh")]
    most = F.col("common") + F.least(F.coalesce("hot_g", F.lit(0)), F.coalesce("hot_h", F.lit(0))) + F.greatest(*rest)
    pairs = pairs.withColumn("most", most).where(F.col("most") >= least(F.col("sg"), F.col("sh"), percent)).select("g", "h")
    few = in_group.where(F.col("n") <= frequent)
    a, b = few.select(F.col("grp").alias("g"), F.col("rep").alias("a")), few.select(F.col("grp").alias("h"), F.col("rep").alias("b"))
    across = pairs.join(a, "g").join(b, "h").select(*ordered(F.col("a"), F.col("b")))
    within = a.join(b, (F.col("g") == F.col("h")) & (F.col("a") < F.col("b"))).select("a", "b")
    pairs = written(across.union(within).distinct(), "jaccard-pairs")

    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(chosen).distinct()
    full = members_of(docs, written(wanted, "jaccard-wanted"), classes, words, percent)
    links = verified(pairs, full, percent).union(crowded(full, chosen, percent))
    comp = components(written(links, "jaccard-links"))
    known = classes.join(comp, classes["rep"] == comp["node"], "left").select(*key, F.coalesce("component", "rep").alias("comp"))
    placed = sketch.select("doc_id", "row", *key).join(known, key, "left").withColumn("comp", F.coalesce("comp", "row"))
    placed = written(placed, "jaccard-placed")
    ids = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return placed.join(ids, "comp").select("doc_id", F.col("size").alias("n_shingles"), "component_id", "sig_a", "sig_b")
