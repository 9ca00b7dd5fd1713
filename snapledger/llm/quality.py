"""Quality by a factorisation machine.

A text is a sparse vector: its distinct words, hashed to ``2**BITS`` columns with their
frequencies scaled to length 1, and a few dense columns of structure statistics (shares of
letter cases, digits, marks and bars, repetition of words and lines, lengths) and metadata
(size in bytes, words and lines). The score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2 ],

all pairwise interactions of rank ``RANK`` in time linear in the vector's entries.

The machine is fitted by AdaGrad on a bounded sample, about ``SAMPLE`` distinct texts of
each class's labelled rows that are not held out, at most ``SAMPLE_BYTES`` of each class;
of a text longer than ``PIECE`` characters its beginning is learnt from. The sample goes
to the driver. Weights are ``2**BITS`` x (1 + RANK) numbers at any input size. Statistics
are standardised by the sample. All texts are scored whole.

Null text is empty; an empty text has no words and neutral statistics of its own. Null
labels, null ids' labels and labels other than 0 and 1 are not learnt; a document with
several labels counts by the largest. Equal rows get equal scores; a score equal to the
threshold counts as 1. If only one class is labelled every score is the share of label 1.
Empty tables give empty results; a column of the operator's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm import textbatch as tb
from snapledger.llm.common import held_out, join_checked, learning_texts, map_batches, table

BITS, RANK = 16, 8
SAMPLE, PIECE, SAMPLE_BYTES = 3000, 1 << 16, 32 << 20
EPOCHS, RATE, RIDGE = 12, 0.05, 1e-4
THRESHOLD = 0.7

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "wide": range(0x80, 0x100),
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "mark": b"#$%&*@^~_=+<>\\{}[]",
    "quote": b"\"'()-/",
    "space": (0x20, *range(0x09, 0x0E)),
}
_TABLES = np.zeros((len(_CLASSES), 256), bool)
for _k, _members in enumerate(_CLASSES.values()):
    _TABLES[_k, list(_members)] = True


def _between(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[of[1:]] - sums[of[:-1]]


def _distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row: row, value, count."""
    row = tb.rows_of(of)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def vectors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (a row for each text), and the word entries: offsets by text, columns, values."""
    n, size = len(off) - 1, np.diff(off)
    h, of = tb.word_hashes(data, off)
    words = np.diff(of)
    row, value, count = _distinct(h, of)
    lines_end = np.flatnonzero(data == 0x0A)
    line_of = np.searchsorted(lines_end, off)
    start, line_row = np.concatenate((off[:-1], lines_end + 1)), np.concatenate((np.arange(n), np.searchsorted(off, lines_end, "right") - 1))
    order = np.argsort(start, kind="stable")
    start, line_row = start[order], line_row[order]
    lines = np.diff(line_of) + 1
    line_end = np.where(np.append(line_row[1:] == line_row[:-1], False), np.append(start[1:] - 1, 0), off[1:][line_row]) if n else start
    lh = tb.span_hashes(tb.prefix_sums(data), start, np.maximum(line_end, start))
    line_rows, _, _ = _distinct(lh, np.concatenate(([0], np.cumsum(lines))))
    letters = np.maximum(size, 1)
    columns = [_between(t[data], off) / letters for t in _TABLES]
    columns += [
        np.bincount(row, minlength=n) / np.maximum(words, 1),
        np.bincount(row[count > 1], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1),
        np.bincount(line_rows, minlength=n) / lines,
        size / np.maximum(words, 1) / 10,
        np.log1p(words / lines),
        np.log1p(size),
        np.log1p(words),
        np.log1p(lines),
    ]
    length = np.sqrt(np.bincount(row, count.astype(float) ** 2, n))
    entries_of = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
    return np.stack(columns, axis=1), entries_of, (value >> tb.U64(64 - BITS)).astype(np.int64), count / np.maximum(length[row], 1e-9)


def _sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)))
    return sums[of[1:]] - sums[of[:-1]]


class Machine:
    """Weights of the statistics' and words' columns and a constant; factors of all columns."""

    def __init__(self, dense: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.columns = dense + (1 << BITS)
        self.w = np.zeros(self.columns + 1)
        self.v = rng.normal(0, 0.05, (self.columns, RANK))
        self.middle, self.scale = np.zeros(dense), np.ones(dense)

    def raw(self, stats: np.ndarray, of: np.ndarray, column: np.ndarray, value: np.ndarray):
        """Raw scores, and what the gradient needs."""
        d = len(self.middle)
        x = np.clip((stats - self.middle) / self.scale, -4, 4) / 2
        vd = self.v[:d]
        entry = self.v[column + d] * value[:, None]
        total = x @ vd + _sums(entry, of)
        square = (x**2) @ (vd**2) + _sums(entry**2, of)
        z = self.w[-1] + x @ self.w[:d] + _sums((self.w[column + d] * value)[:, None], of)[:, 0]
        return z + 0.5 * (total**2 - square).sum(axis=1), x, total

    def fit(self, stats: np.ndarray, of: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> None:
        rng, d = np.random.default_rng(seed), stats.shape[1]
        self.middle, self.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
        past_w, past_v = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(EPOCHS):
            deal = rng.permutation(len(y))
            for part in np.array_split(deal, max(1, len(deal) // 256)):
                n = of[part + 1] - of[part]
                sub = np.concatenate(([0], np.cumsum(n)))
                at = np.repeat(of[part] - sub[:-1], n) + np.arange(sub[-1])
                col, val = column[at], value[at]
                z, x, total = self.raw(stats[part], sub, col, val)
                g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / weight[part].sum()
                row = np.repeat(np.arange(len(part)), n)
                used, inverse = np.unique(col, return_inverse=True)
                gv = g[row] * val
                grad_w = np.concatenate((x.T @ g, np.bincount(inverse, gv), [g.sum()]))
                index = np.concatenate((np.arange(d), used + d))
                grad_v = np.empty((len(index), RANK))
                for f in range(RANK):
                    grad_v[:d, f] = x.T @ (g * total[:, f]) - (x**2).T @ g * self.v[:d, f]
                    grad_v[d:, f] = np.bincount(inverse, gv * total[row, f]) - np.bincount(inverse, gv * val) * self.v[used + d, f]
                grad_v += RIDGE * self.v[index]
                index_w = np.append(index, self.columns)
                grad_w[:-1] += RIDGE * self.w[index]
                past_w[index_w] += grad_w**2
                past_v[index] += grad_v**2
                self.w[index_w] -= RATE * grad_w / np.sqrt(past_w[index_w])
                self.v[index] -= RATE * grad_v / np.sqrt(past_v[index])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality"):
    """A fitted Machine, or the share of label 1 if only one class is labelled."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    counted = {r[0]: r[1] for r in join_checked(docs.select("doc_id"), marks, "doc_id", "inner").groupBy("label").count().collect()}
    if len(counted) < 2:
        return float(counted.get(1, 0) > 0)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = learning_texts(join_checked(texts, marks, "doc_id", "inner"), counted, SAMPLE, PIECE, SAMPLE_BYTES)
    y, times = got["label"].to_numpy().astype(float), got["n"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return counted[1] / sum(counted.values())
    parts = [vectors(data, off) for _, _, data, off in tb.slices(got["text"])]
    of = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))))
    machine = Machine(parts[0][0].shape[1])
    weight = times * np.where(y == 1, counted[1] / times[y == 1].sum(), counted[0] / times[y == 0].sum())
    machine.fit(np.concatenate([p[0] for p in parts]), of, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), y, weight)
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
    return machine


def score(docs: DataFrame, machine) -> DataFrame:
    """``docs`` with a column quality_score, 0 to 1; all other columns are kept, one of that name is replaced."""
    docs = docs.drop("quality_score")
    if isinstance(machine, float):
        return docs.withColumn("quality_score", F.lit(machine))
    held = docs.sparkSession.sparkContext.broadcast(machine)
    schema = docs.withColumn("quality_score", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, off in tb.slices(batch.column("text")):
                out[i:j] = held.value.raw(*vectors(data, off))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], [*batch.schema.names, "quality_score"])

    return map_batches(docs, run, schema)


def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted")
    )
