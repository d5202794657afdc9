"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontamination, html_extraction, licenses, pii, simhash, substring_dedup, toxicity
from .common import table
from .mixing import mix_to_weights, quality_weights
from .token_counts import count_tokens


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = quality_weights(table(spark, sf_dir, "labels"))
    return mix_to_weights(table(spark, sf_dir, "documents"), quality).drop("source")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return made.withColumn("has_repeat", (F.col("n_removed") > 0).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.audio_features(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_pii, op4_simhash, op5_html, op6_substrings, op7_toxicity, op8_decontamination, op9_licenses, op10_audio)}

ORACLES = {
    "op1_mixing": r"""
with q as (select doc_id, case when max(quality) >= 1 then 2.0 else 0.5 end::double quality from labels
           where doc_id is not null and quality is not null group by 1),
d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
k as (select d.*, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
             / coalesce(quality, 1.0) as key from d left join q using (doc_id)),
s as (select source, sum(size)::bigint source_size from k group by 1),
r as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source is null, source collate c) - 1) % 3 + 1)::int]::double weight,
             sum(source_size) over ()::double total from s),
c as (select *, 2.0::double * source_size stop, 2.0::double * source_size / weight ratio from r),
l as (select *, (1.5::double * total - coalesce(sum(stop) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as lev from c),
t as (select source, source_size, least(stop, coalesce(max(case when lev <= ratio then lev end) over () * weight, stop)) target from l),
b as (select *, case when source_size > 0 then floor(round(target) / source_size)::bigint else 0 end epochs from t),
p as (select k.doc_id, k.size, b.source_size, b.target, b.epochs, round(b.target)::bigint - b.epochs * b.source_size
             - coalesce(sum(k.size) over (partition by k.source order by key, k.size, k.doc_id rows between unbounded preceding and 1 preceding), 0) as room
      from k join b on k.source is not distinct from b.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, room)))::bigint taken from p
"""
}
