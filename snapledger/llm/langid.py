"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: each slot holds a bit mask, bit L set if a hash of
an n-gram of language L falls there (masks of more than 64 languages take several words).
The masks at an n-gram's slots, and-ed, are the languages that contain it. A text's count
for a language is the number of its n-grams with that bit; from it goes what false
positives add, n times the share of set bits to the power of the number of hashes. The
largest corrected count decides, its share of all corrected counts is the score.

N-grams are runs of 5 bytes of the lower-cased text with all but letters made spaces. A
language contains an n-gram if it is at least ``SHARE`` as frequent in it as in the
language where it is most frequent, so that a foreign line in a text teaches nothing.

Filters are learnt from about ``PER_LANG`` distinct texts of each language, at most
``LANG_BYTES`` of each, of a text longer than ``PIECE`` characters its beginning: a bounded
sample, drawn by a hash of the text. All texts are read whole when they are identified.

Null text, or one without a letter: ``und``, score 0. Texts that match no filter get the
commonest language with score 0; ties go to the language first in code-point order. Null
languages are not learnt; without any language everything is ``und``. Equal rows, of null
ids too, get equal results. Empty tables give empty results; columns of the operator's
names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm import textbatch as tb
from snapledger.llm.common import held_out, learning_texts, map_batches, table

N, HASHES, SLOT_BITS = 5, 2, 20
PER_LANG, PIECE, LANG_BYTES, SHARE = 400, 1 << 16, 4 << 20, 0.2

_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams that hold a letter, and each text's offsets among them. A text stands between spaces."""
    n = len(off) - 1
    low = _KEEP[data]
    if len(data):
        # A-grave to thorn in UTF-8: lower case is 0x20 further
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        big = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        low[big] = data[big] + 0x20
    row = tb.rows_of(off)
    wide = np.full(len(data) + n * N, 0x20, np.uint8)
    wide[np.arange(len(data)) + row * N + 1] = low
    x = wide.astype(tb.U64)
    gram = x[: len(x) - N + 1].copy() if len(x) >= N else np.zeros(0, tb.U64)
    letter = wide != 0x20
    some = letter[: len(gram)].copy()
    for k in range(1, N):
        gram |= x[k : len(gram) + k] << tb.U64(8 * k)
        some |= letter[k : len(gram) + k]
    # a window starts at the space before a text or inside it; it ends in the spaces after it at the latest
    first = off[:-1] + np.arange(n) * N
    start = np.zeros(len(wide) + 1, np.int32)
    np.add.at(start, first, 1)
    np.add.at(start, first + np.diff(off) + 1, -1)
    at = np.flatnonzero(some & (np.cumsum(start)[: len(gram)] > 0))
    return tb.mix(gram[at]), np.searchsorted(at, np.append(first, len(wide)))


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    return [(grams >> tb.U64(64 - SLOT_BITS * (k + 1)) & tb.U64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


def build(samples: dict[str, pa.Array]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, masks (words of 64 languages x slots), and each language's rate of false positives."""
    langs = sorted(samples)
    grams, rates = [], []
    for lang in langs:
        found = [tb.mix(np.zeros(0, tb.U64))]
        for _, _, data, off in tb.slices(samples[lang]):
            found.append(_grams(data, off)[0])
        g, n = np.unique(np.concatenate(found), return_counts=True)
        grams.append(g)
        rates.append(n / max(1, n.sum()))
    every, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    most = np.zeros(len(every))
    np.maximum.at(most, inverse, np.concatenate(rates))
    masks = np.zeros(((len(langs) + 63) // 64, 1 << SLOT_BITS), tb.U64)
    wrong, at = [], 0
    for k, (g, rate) in enumerate(zip(grams, rates, strict=True)):
        kept = g[rate >= SHARE * most[inverse[at : at + len(g)]]]
        at += len(g)
        filled = np.zeros(1 << SLOT_BITS, bool)
        for s in _slots(kept):
            filled[s] = True
        masks[k // 64][filled] |= tb.U64(1 << (k % 64))
        wrong.append(filled.mean() ** HASHES)
    return langs, masks, np.array(wrong)


def counts(data: np.ndarray, off: np.ndarray, masks: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """Corrected number of n-grams of each text (rows) in each language (columns)."""
    grams, of = _grams(data, off)
    slots = _slots(grams)
    out = np.zeros((len(off) - 1, len(wrong)))
    for word in range(len(masks)):
        found = masks[word][slots[0]]
        for s in slots[1:]:
            found &= masks[word][s]
        for k in range(64 * word, min(len(wrong), 64 * word + 64)):
            seen = np.concatenate(([0], np.cumsum((found >> tb.U64(k % 64) & tb.U64(1)).astype(np.int64))))
            out[:, k] = seen[of[1:]] - seen[of[:-1]]
    return np.maximum(out - np.diff(of)[:, None] * wrong, 0) / (1 - wrong)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_ = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    seen = np.concatenate(([0], np.cumsum(ascii_)))
    out = seen[off[1:]] > seen[off[:-1]]
    for k in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[k] = any(c.isalpha() for c in data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def learn(docs: DataFrame, per_lang: int = PER_LANG):
    """(languages, masks, false-positive rates, commonest language) from rows (doc_id, text, lang) that are not held out, or None."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", F.col("lang").alias("label"))
    counted = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counted:
        return None
    got = learning_texts(rows, counted, per_lang, PIECE, LANG_BYTES)
    lang, text = got["label"].to_numpy(), got["text"].combine_chunks()
    samples = {k: text.filter(pa.array(lang == k)) for k in counted}
    return *build(samples), min(counted, key=lambda k: (-counted[k], k))


def identify(docs: DataFrame, filters) -> DataFrame:
    """``docs`` with lang_pred and lang_score; all other columns are kept, those of these names are replaced."""
    docs = docs.drop("lang_pred", "lang_score")
    if filters is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("lang_score", F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(filters)
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("lang_score", F.lit(0.0)).schema

    def run(batches):
        langs, masks, wrong, usual = held.value
        names = np.array([*langs, usual, "und"], dtype=object)
        for batch in batches:
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j, data, off in tb.slices(batch.column("text")):
                c = counts(data, off, masks, wrong)
                total = c.sum(axis=1)
                b = np.where(total > 0, c.argmax(axis=1), len(langs))
                letters = has_letter(data, off)
                best[i:j] = np.where(letters, b, len(langs) + 1)
                score[i:j] = np.where(letters, c.max(axis=1) / np.maximum(total, 1e-300), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "lang_score"])

    return map_batches(docs, run, schema)


def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), learn(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
