"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a budget in words. As many complete epochs as fit into it come first; the rest is a weighted sample
without replacement: every document draws u in (0, 1) from a hash of its id and gets the exponential key
-ln(u) / quality; the documents of a source with the smallest keys enter up to the budget, the last one with those
words that the budget has left. The prefix sums need no sort of a whole source: a monotone function of the key deals
the documents into buckets, sums of buckets are accumulated by source, and only rows within a bucket are sorted. The
number of buckets follows the number of rows, so a source of any share is spread over many tasks.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own and comes last; a null
doc_id draws as the text "null"; rows with equal keys are ordered by size; no quality label counts 1; an empty table
gives an empty result; columns of docs other than doc_id, text and source don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running_sums
from .common import materialise, word_count

#: Rows that a bucket of one source should hold.
BUCKET_ROWS = 200


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, quality: 2 where a label says 1, 0.5 where it says 0; the highest of repeated labels counts."""
    found = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return found.select("doc_id", F.when(F.col("q") >= 1, 2.0).otherwise(0.5).alias("quality"))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from 52 bits of the id's MD5."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """source, source_size, target from the same without target: one row a source.

    Weights repeat over the sources in order of code points, null last. All targets together are share of all sizes; a
    target stops at most times its source's size and the excess goes to the others by weight. That is a level: target
    = min(most * source_size, level * weight), found by filling the sources that stop soonest first. A share above most
    makes every target stop. Before the level is found a source's level lies above its ratio, after it levels only fall:
    the right one is the largest that doesn't exceed its ratio.
    """
    place = (F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).cast("binary").alias("name"))
    kinds = F.array(*map(F.lit, map(float, weights)))
    ranked = running_sums(sizes.withColumn("one", F.lit(1)), [], F.struct(*place), {"rank": "one"}).drop("one")
    ranked = ranked.withColumn("weight", F.element_at(kinds, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("rank")
    ranked = ranked.withColumn("stop", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("weight"))
    ranked = running_sums(ranked, [], F.struct("ratio", *place), {"filled": "stop", "passed": "weight"})
    totals = ranked.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("every"))  # one row
    ranked = ranked.join(F.broadcast(totals), how="cross")
    level = (F.lit(float(share)) * F.col("total") - (F.col("filled") - F.col("stop"))) / (F.col("every") - F.col("passed") + F.col("weight"))
    ranked = materialise(ranked.withColumn("level", F.when(level <= F.col("ratio"), level)), "mix-levels")
    ranked = ranked.drop("level").join(F.broadcast(ranked.agg(F.max("level").alias("level"))), how="cross")
    fair = F.coalesce(F.col("level") * F.col("weight"), F.col("stop"))
    return ranked.select("source", "source_size", F.least("stop", fair).alias("target"))


def mix_to_weights(
    docs: DataFrame, quality: DataFrame | None = None, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs (doc_id, text, source).

    quality (doc_id, quality > 0) weighs the documents; taken counts the words that the mix takes, repeats included.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    if quality is not None:
        sized = sized.join(quality.select("doc_id", "quality"), "doc_id", "left")
    else:
        sized = sized.withColumn("quality", F.lit(1.0))
    sized = sized.withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.coalesce("quality", F.lit(1.0))).drop("quality")
    sized = materialise(sized, "mix-sizes")

    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = materialise(sources, "mix-sources")
    rows = sources.agg(F.sum("n")).first()[0] or 0
    n = min(1 << 20, max(16, rows // bucket_rows))
    plan = targets(sources.drop("n"), share, weights, most)
    budget = F.round("target").cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))

    sized = sized.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * n), F.lit(n - 1)))
    # Null sources take part in the join below as a flag and an empty name.
    sized = sized.withColumns({"named": F.col("source").isNotNull(), "name": F.coalesce("source", F.lit(""))})
    sums = sized.groupBy("named", "name", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("named", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size")
    plan = plan.select(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target", "epochs", "rest")
    sums = sums.join(plan, ["named", "name"])
    joined = sized.join(sums, ["named", "name", "bucket"])
    within = Window.partitionBy("named", "name", "bucket").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", left))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
