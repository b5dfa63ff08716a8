"""Queries whose results follow from a rule: exact dedup, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprint, jaccard, mixing, passages, pieces, sharding, urls
from .common import table
from .registry import query

EXACT_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) s from documents),
r as (select *, count(*) over (partition by s) c, first_value(doc_id) over (partition by s order by n desc, doc_id) k from t)
select doc_id, k as keep_id, c::bigint as group_size, doc_id = k as kept, s as text_sha256 from r
"""


@query("op4_exact_dedup", EXACT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
g as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (select source, source_size, [3.0::double, 1.0::double, 2.0::double][(k % 3 + 1)::int] as weight, 2 * source_size as cap from g),
l as (select *, (1.5::double * (select sum(source_size) from w)::double
                 - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::double)
             / sum(weight) over (o rows between current row and unbounded following) as level
      from w window o as (order by cap::double / weight, source nulls last)),
t as (select source, source_size, case when cap::double > level * weight
        then (select max(level) from l where cap::double > level * weight) * weight else cap::double end as target from l)
select d.doc_id, d.size, t.source_size, t.target from d join t on d.source is not distinct from t.source
"""


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL states all but `taken` and the times, which follow from Spark's xxhash64; see tests/llm/test_mixing_sharding.py."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "takes", "time_1", "time_2")


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", fingerprint.spelt(F.col("fingerprint")).alias("fingerprint"),
                        fingerprint.spelt(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op9_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the quality of the document of its number."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urls.url_filter(table(spark, sf_dir, "pages"), labels, RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template", "group", "bad_share")


def model_path() -> str:
    """The public tokenizer the queries use; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document."""
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(model_path()), k=2)
