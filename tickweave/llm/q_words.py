"""Queries over words and vectors: spelling variants, token files, hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, spelling, token_files
from .common import table
from .registry import query


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 5 letters and 3 occurrences, with misspellings planted where 97 divides the hash of document and run."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), least=5, count=3, every=97)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1, words=True)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


NEGATIVES_SQL = """
with u as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end::bigint as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) as q
           from embeddings where label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.q, c.q)::bigint as score
      from u a, u c where a.vec_id % 50 = 0 and a.vec_id <> c.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
             row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::int as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
