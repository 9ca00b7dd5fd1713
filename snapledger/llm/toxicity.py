"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney bigram model. Its top level counts how often a
word follows another in the class's texts; its lower order is a distribution over words in
which a word counts by the distinct words it follows in that class (its continuation
count), so that a text copied a thousand times counts once there. A count c is discounted
by ``CHANCE`` times its square root (by all of it, if it is smaller), the scale of its
chance differences, whatever the size of the corpus. What the discounts of a word's
followers free goes to the lower order; what the lower order's free goes to one backoff
distribution, made of the continuation counts of both classes together: a rare expression
is left to the shared counts and says nothing, one far more usual in one class says much.

A text is judged by its length-normalised log-likelihoods under both classes' bigram
models and under their lower orders: by the differences, and by how far single words pass
that of the lower orders by more than ``MARGIN``. A logistic curve, fitted to about
``CALIBRATE`` distinct learning texts of each class, turns the three into a score.

Counts cover all learning rows, grow with them and are gathered by shuffles. Pairs are
counted, discounted and only then put into 2**SLOT_BITS slots, as words are, and contexts
into 2**CONTEXT_BITS; these tables come to the driver and are all that is broadcast.

Null and empty text: score from zero evidence. Null labels and null ids' labels are not
learnt from, nor labels other than 0 and 1; a document with several labels counts as toxic
if one says so. Equal rows get equal scores; scores equal to the threshold are toxic. If
only one class is labelled every score is the rate of toxic rows. Empty tables give empty
results; a column of the operator's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm import textbatch as tb
from snapledger.llm.common import held_out, join_checked, map_batches, sample_share, table
from snapledger.llm.fit import logistic

SLOT_BITS = 22
CONTEXT_BITS = 20
CHANCE = 1.5
MARGIN = 1.0
CALIBRATE = 4000
THRESHOLD = 0.3


def _before(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The hash of the word before each word, 0 for a text's first."""
    before = np.roll(h, 1)
    before[of[:-1][np.diff(of) > 0]] = 0
    return before


def _pairs(batches):
    """(word slot, word before, class), packed into a long, with their number in each run of texts."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint64)
        for i, j, data, off in tb.slices(batch.column("text"), 4 * tb.SLICE_BYTES):
            h, of = tb.word_hashes(data, off)
            before = _before(h, of)
            packed = (h >> tb.U64(64 - SLOT_BITS)) << tb.U64(64 - SLOT_BITS) | (before >> tb.U64(SLOT_BITS + 1)) << tb.U64(1) | label[i:j][tb.rows_of(of)]
            pair, n = np.unique(packed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], ["pair", "n"])


def discounted(count):
    """What is left of counts, of a NumPy array or a column."""
    if isinstance(count, np.ndarray):
        return np.maximum(count - CHANCE * np.sqrt(count), 0)
    return F.greatest(count - CHANCE * F.sqrt(count), F.lit(0.0))


def probabilities(count: np.ndarray, total: float, left: float, shared: np.ndarray) -> np.ndarray:
    """A class's probability of words: ``left`` is what discounts leave of its ``total`` counts, ``shared`` the backoff probability."""
    return discounted(count) / total + (total - left) / total * shared


@dataclass
class Model:
    """Both classes' models; ``model[slot]`` is log P(word | 1) - log P(word | 0) of the lower orders.

    ``log0`` is the lower order's log P(word | 0); of class 0 and 1, ``root`` has the square
    root of a pair's discounted count by the pair's slot, ``per`` one by the number of words
    after a context and ``left`` the share of them that discounts free, both by its slot.
    """

    ratio: np.ndarray
    log0: np.ndarray
    root: list
    per: list
    left: list

    def __getitem__(self, slot):
        return self.ratio[slot]

    def bigram(self, h: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(word | word before, 1) - log P(word | word before, 0) of words given by their hashes."""
        word = (h >> tb.U64(64 - SLOT_BITS)).astype(np.int64)
        pair = word ^ (before >> tb.U64(SLOT_BITS + 1)).astype(np.int64) & (1 << SLOT_BITS) - 1
        context = (before >> tb.U64(64 - CONTEXT_BITS)).astype(np.int64)
        low = np.exp(self.log0[word].astype(np.float32))
        p0, p1 = (self.root[k][pair].astype(np.float32) ** 2 * self.per[k][context] + self.left[k][context] * q for k, q in ((0, low), (1, low * np.exp(self.ratio[word]))))
        return np.log(p1) - np.log(p0)


def learn(labelled: DataFrame) -> Model | None:
    """The models of ``labelled`` (text, label 0/1); None without both classes."""
    one = F.col("pair").bitwiseAND(F.lit(1)) == 1
    n, kept = F.col("n").cast("double"), discounted(F.col("n").cast("double"))
    sides = lambda x: [F.sum(F.when(side, x).otherwise(0.0)).cast("float") for side in (one, ~one)]
    word = F.shiftrightunsigned("pair", 64 - SLOT_BITS)
    before = F.shiftrightunsigned("pair", 1)
    pairs = map_batches(labelled.select("text", "label"), _pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).persist()
    try:
        words = pairs.groupBy(word.cast("int").alias("slot")).agg(*sides(F.lit(1.0))).toDF("slot", "one", "zero").toArrow()
        n1, n0 = (words[c].to_numpy().astype(float) for c in ("one", "zero"))
        if not n1.any() or not n0.any():
            return None
        slot = word.bitwiseXOR(before.bitwiseAND(F.lit((1 << SLOT_BITS) - 1)))
        tops = pairs.filter(kept > 0).groupBy(slot.cast("int").alias("slot")).agg(*sides(kept)).toDF("slot", "one", "zero").toArrow()
        context = F.shiftrightunsigned("pair", 1 + 63 - SLOT_BITS - CONTEXT_BITS).bitwiseAND(F.lit((1 << CONTEXT_BITS) - 1))
        after = pairs.groupBy(context.cast("int").alias("slot")).agg(*sides(n), *sides(kept)).toDF("slot", "one", "zero", "kept_one", "kept_zero").toArrow()
    finally:
        pairs.unpersist()
    one, zero, left1, left0 = n1.sum(), n0.sum(), discounted(n1).sum(), discounted(n0).sum()
    total = one + zero + 0.5 * len(n1)
    p1, p0 = (probabilities(c, n_, left, (n1 + n0 + 0.5) / total) for c, n_, left in ((n1, one, left1), (n0, zero, left0)))
    ratio = np.full(1 << SLOT_BITS, np.log((one - left1) / one) - np.log((zero - left0) / zero), np.float32)
    log0 = np.full(1 << SLOT_BITS, np.log((zero - left0) / zero * 0.5 / total), np.float16)
    at = words["slot"].to_numpy()
    ratio[at], log0[at] = np.log(p1) - np.log(p0), np.log(p0)
    model = Model(ratio, log0, [], [], [])
    for side in ("zero", "one"):
        root = np.zeros(1 << SLOT_BITS, np.float16)
        root[tops["slot"].to_numpy()] = np.sqrt(tops[side].to_numpy())
        count, some = after[side].to_numpy(), after["slot"].to_numpy()[after[side].to_numpy() > 0]
        per, left = np.zeros(1 << CONTEXT_BITS, np.float32), np.ones(1 << CONTEXT_BITS, np.float32)
        per[some] = 1 / count[count > 0]
        left[some] = 1 - (after[f"kept_{side}"].to_numpy() / np.maximum(count, 1))[count > 0]
        model.root.append(root), model.per.append(per), model.left.append(left)
    return model


def evidence(column, model: Model) -> np.ndarray:
    """A row for each text: the lower orders' length-normalised log-likelihoods' difference, the words' excess over it, and the bigram models' difference."""
    out = np.zeros((len(column), 3))
    for i, j, data, off in tb.slices(column):
        h, of = tb.word_hashes(data, off)
        row, n = tb.rows_of(of), j - i
        r = model.ratio[(h >> tb.U64(64 - SLOT_BITS)).astype(np.int64)].astype(float)
        length = np.maximum(np.diff(of), 1)
        mean, both = np.bincount(row, r, n) / length, np.bincount(row, model.bigram(h, _before(h, of)), n) / length
        excess = np.bincount(row, np.maximum(r - mean[row] - MARGIN, 0), n)
        out[i:j] = np.stack([np.clip(mean, -3, 3), np.minimum(excess, 12.0), np.clip(both, -3, 3)], axis=1)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    """A scorer (model, logistic weights) from the rows of ``docs`` that are labelled and not held out."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~held_out(F.col("doc_id")))
    labelled = join_checked(texts, marks, "doc_id", "inner")
    model = learn(labelled)
    counted = {r[0]: r[1] for r in join_checked(texts.select("doc_id"), marks, "doc_id", "inner").groupBy("label").count().collect()}
    if model is None:
        return None, np.array([counted.get(1, 0) / max(1, sum(counted.values()))])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for batch in batches:
            x = evidence(batch.column("text"), held.value)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column("label"), batch.column("n")], ["mean", "excess", "both", "label", "n"])

    size = F.when(F.col("label") == 1, counted[1]).otherwise(counted[0])
    some = labelled.filter(sample_share(CALIBRATE, size, F.col("text"))).groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"))
    some = map_batches(some, features, "mean double, excess double, both double, label int, n long").toArrow()
    x = np.stack([some[c].to_numpy() for c in ("mean", "excess", "both")], axis=1)
    y, n = some["label"].to_numpy().astype(float), some["n"].to_numpy()
    weight = n * np.where(y == 1, max(1, counted[1] / CALIBRATE), max(1, counted[0] / CALIBRATE))
    return held, logistic(x, y, weight)


def score(docs: DataFrame, scorer) -> DataFrame:
    """``docs`` with a column toxicity, 0 to 1; all other columns are kept, one of that name is replaced."""
    held, w = scorer
    docs = docs.drop("toxicity")
    if held is None:
        return docs.withColumn("toxicity", F.lit(float(w[0])))
    schema = docs.withColumn("toxicity", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            z = evidence(batch.column("text"), held.value) @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], [*batch.schema.names, "toxicity"])

    return map_batches(docs, run, schema)


def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, scorer).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored toxic."""
    return score(docs, fit(docs, labels)).filter(F.col("toxicity") < THRESHOLD).drop("toxicity")
