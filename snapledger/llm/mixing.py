"""Mixing sources to target weights by capped water-filling.

The mix holds ``share`` times all words. Sources, in code-point order with null last,
get weights in turn; a source's target stops at ``max_epochs`` times its own words and
the excess goes to the others by weight. With caps c and weights w the targets are
min(c, L*w); sorted by c/w, the water level L is the largest of the candidate levels
(words left) / (weight left) that does not pass its own row's c/w, so one pass of
running sums over the table of sources finds what repeated resharing converges to.

Each source is then repeated a whole number of times; for the rest its documents are
taken in the order of a seeded hash until the target is met, to within half a document.
The cut is found from sums over 4096 hash buckets of each source, and inside the one
bucket in which it falls by a running sum over that bucket's documents only. Nothing
but a table with a row for each source is joined to the documents.

Null text has size 0. A null source is a source. Rows with one doc_id in one source
are taken or left together. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapledger.llm.common import WORD, cut, join_checked, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Sorts as the source by code point, null last; never null."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _rank(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (key, source_size) with each source's ``target``."""
    turn = Window.orderBy("key")
    whole = Window.partitionBy()
    level = Window.orderBy("ratio", "key")
    w = F.array(*[F.lit(float(x)) for x in weights])
    return (
        sources.withColumn("w", F.get(w, (F.row_number().over(turn) - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("left", F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
        .select("key", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with mix_size, source_size, target and mix_copies, the number of times the mix takes the row (columns of these names are replaced)."""
    docs = docs.drop("mix_size", "source_size", "target", "mix_copies")
    sizes = cut(docs.select("doc_id", _key(F.col("source")).alias("key"), _size(F.col("text")).alias("size")))
    ranked = sizes.groupBy("key", "doc_id").agg(F.sum("size").alias("size")).select("key", "size", _rank(F.col("doc_id"), seed).alias("rank"))
    bucket = F.substring("rank", 1, 3).alias("bucket")
    hist = sizes.groupBy("key", F.substring(_rank(F.col("doc_id"), seed), 1, 3).alias("bucket")).agg(F.sum("size").alias("size"))
    plan = targets(hist.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    plan = (
        plan.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    plan = cut(plan)
    wide = 48 + F.octet_length("key")
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        join_checked(hist.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))), plan.select("key", "need"), "key", "inner", wide)
        .filter((F.col("before") <= F.col("need")) & (F.col("before") + F.col("size") > F.col("need")))
        .select("key", "bucket", "before", "need")
    )
    inside = Window.partitionBy("key", "bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        join_checked(ranked.select("key", "size", "rank", bucket), edges, ["key", "bucket"], "inner", wide)
        .withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .groupBy("key")
        .agg(F.max(F.when(F.col("before") * 2 + F.col("size") <= F.col("need") * 2, F.col("rank"))).alias("last"), F.min("bucket").alias("bucket"))
        # the bucket's name sorts before all ranks in it and after all in earlier buckets
        .select("key", F.coalesce("last", "bucket").alias("last"))
    )
    # without an edge the documents' sizes never pass what is needed: all are taken if anything is needed
    plan = plan.join(cuts, "key", "left").withColumn("last", F.coalesce("last", F.when(F.col("need") > 0, F.lit("g")).otherwise(F.lit(""))))
    plan = plan.select(F.col("key").alias("__mix_key"), "source_size", "target", F.col("whole").alias("__mix_whole"), F.col("last").alias("__mix_last"))
    out = docs.withColumn("__mix_key", _key(F.col("source"))).withColumn("mix_size", _size(F.col("text")))
    out = join_checked(out, cut(plan), "__mix_key", "inner", 64 + F.octet_length("__mix_key"))
    copies = F.col("__mix_whole") + (_rank(F.col("doc_id"), seed) <= F.col("__mix_last")).cast("long")
    return out.withColumn("mix_copies", F.when(F.col("mix_size") > 0, copies).otherwise(F.lit(0)).cast("long")).drop("__mix_key", "__mix_whole", "__mix_last")


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS rk FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
t AS (SELECT source, source_size, coalesce(least(cap, max(CASE WHEN lev <= ratio THEN lev END) OVER () * w), cap) AS target FROM l),
n AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM t),
g AS (SELECT doc_id, source, rk, sum(size) AS size FROM d GROUP BY ALL),
p AS (SELECT g.doc_id, g.source, whole, target, source_size, g.size AS gsize, target - whole * source_size AS need,
      coalesce(sum(g.size) OVER (PARTITION BY g.source ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(d.size * (whole + CASE WHEN need > 0 AND 2 * before + gsize <= 2 * need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.source IS NOT DISTINCT FROM p.source
"""
