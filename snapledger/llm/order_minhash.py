"""Order MinHash fingerprints, in DataFrame functions only.

The k-mers are runs of ``K`` words (a shorter text is one k-mer). Each k-mer is numbered
among its equals, in text order, so that repeats count, and (k-mer, number) is hashed
once. The top bits of the hash deal it to one of ``2**BITS`` sketches; a sketch keeps its
``L`` smallest hashes, puts them in text order and hashes the tuple. Two texts agree in a
sketch only if they share its minimal k-mers and their order; the share of agreeing
sketches estimates a likeness sensitive to edit distance.

All steps are linear in the text but for two sorts of 64-bit integers, in which 36 bits
of hash stand above 28 bits of position. A text is worked on in its own row; nothing is
exploded.

Null text is empty. The empty fingerprint is ''; two empty fingerprints have likeness 1,
an empty and another 0. Rows that share a doc_id are ordered by text. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapledger.llm.common import table

K, L, BITS = 3, 2, 5
#: Rows that a range of doc_id aims at, and the most ranges.
RANGE_ROWS, MOST_RANGES = 2000, 100_000

_POS = 28
_MASK = (1 << _POS) - 1


def _starts(array: Column, bits_of) -> Column:
    """Indices at which ``bits_of`` an element differs from those of the element before."""
    n = F.size(array)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: ~bits_of(F.get(array, j)).eqNullSafe(bits_of(F.get(array, j - 1))))
    )


def _runs(array: Column, starts: Column, of) -> Column:
    """``of`` each slice between starts."""
    return F.transform(starts, lambda s, r: of(F.slice(array, s + 1, F.coalesce(F.get(starts, r + 1), F.size(array)) - s)))


def _words(text: Column) -> Column:
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def sketches(df: DataFrame, text: str, out: str, k: int = K, l: int = L, bits: int = BITS) -> DataFrame:  # noqa: E741
    """``df`` with an array ``out``: for each sketch that the text fills, its number above 32 bits of hash."""
    words, kmers, again, starts = (f"_{out}_{x}" for x in ("words", "kmers", "again", "starts"))
    df = df.withColumn(words, _words(F.coalesce(F.col(text), F.lit(""))))
    n = F.size(words)
    kmer = F.transform(
        F.slice(F.col(words), F.lit(1), F.when(n < k, F.least(n, F.lit(1))).otherwise(n - (k - 1))),
        lambda w, i: F.shiftleft(F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, k)]), _POS).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn(kmers, F.sort_array(kmer)).drop(words)
    # first occurrences keep their hash; the few others get one that holds their number
    high = lambda x: F.shiftrightunsigned(x, _POS)
    new = lambda x, j: ~high(x).eqNullSafe(high(F.get(F.col(kmers), j - 1)))
    df = df.withColumn(again, F.filter(F.col(kmers), lambda x, j: ~new(x, j))).withColumn(starts, _starts(F.col(again), high))
    number = lambda x, o: F.shiftleft(F.xxhash64(high(x), o), _POS).bitwiseOR(x.bitwiseAND(F.lit(_MASK)))
    numbered = F.flatten(_runs(F.col(again), F.col(starts), lambda run: F.transform(run, number)))
    df = df.withColumn(kmers, F.when(F.size(again) == 0, F.col(kmers)).otherwise(F.sort_array(F.concat(F.filter(F.col(kmers), new), numbered)))).drop(again)
    sketch = lambda x: F.shiftrightunsigned(x, 64 - bits)
    in_text_order = lambda run: F.transform(F.sort_array(F.transform(run, lambda x: F.shiftleft(x, 64 - _POS).bitwiseOR(high(x)))), lambda y: y.bitwiseAND(F.lit((1 << (64 - _POS)) - 1)))
    one = lambda run: F.shiftleft(sketch(F.get(run, F.lit(0))), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(in_text_order(F.slice(run, 1, l))), 32))
    return df.withColumn(starts, _starts(F.col(kmers), sketch)).withColumn(out, _runs(F.col(kmers), F.col(starts), one)).drop(starts, kmers)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), "-")


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches filled in either text that agree; 1 if both are empty."""
    number = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 32))
    either = F.size(F.array_union(number(a), number(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_next(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` (doc_id, text, sketch) with the text and sketch of the next document in descending doc_id; the first follows the last.

    doc_id is cut into ranges at approximate quantiles, so that one shuffle puts
    neighbours together without a global sort; the top row of each range also goes to
    the range above it, as the successor of that range's last row. Only quantiles and
    the top id of each range come to the driver.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    n, some = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    ranges = max(1, min(MOST_RANGES, n // rows))
    cuts = []
    if ranges > 1 and some:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], F.lit(max(10_000, 20 * ranges)))).first()[0]
    cuts = sorted(set(cuts))
    # two short scans find the range: of every step-th cut, then of those between
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda a, v: F.size(F.filter(a, lambda c: c < v))
    if cuts:
        literal = F.array(*[F.lit(c) for c in cuts])
        coarse = below(F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]), F.col("doc_id")) * step
        place = coarse + below(F.slice(literal, coarse + 1, step), F.col("doc_id"))
    else:
        place = F.lit(0)
    placed = docs.withColumn("place", F.coalesce(place, F.lit(0)))
    tops = {r[0]: r[1] for r in placed.groupBy("place").agg(F.max("doc_id")).collect()}
    order = sorted(tops)
    above = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    slots = range(len(cuts) + 1)
    top = F.get(F.array(*[F.lit(tops.get(p)).cast("long") for p in slots]), F.col("place"))
    up = F.get(F.array(*[F.lit(above.get(p, 0)) for p in slots]), F.col("place"))
    own = F.struct(F.col("place").alias("place"), F.lit(False).alias("guest"))
    sent = F.when(F.col("doc_id").eqNullSafe(top), F.array(own, F.struct(up.alias("place"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    w = Window.partitionBy("place").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return (
        placed.withColumn("sent", sent).select("doc_id", "text", "sketch", F.inline("sent"))
        .withColumn("next", F.lead(F.struct("text", "sketch")).over(w))
        .filter(~F.col("guest"))
        .select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))
    )


def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    both = with_next(sketches(docs, "text", "sketch"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    both = sketches(both.select("doc_id", "sketch", "next_sketch", "edited", n.cast("long").alias("n_chars")), "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
