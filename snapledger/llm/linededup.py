"""Removal of repeated passages, by overlapping windows and content-defined chunks of lines.

From every line the shortest run of lines with ``LONG_WORDS`` words or more that begins
there, and the shortest that ends there, are windows. They depend on their own lines
alone, and every line of every repeated run of ``LONG_WORDS`` words lies in a window that
repeats with it, so that such runs go whole, up to the last line that is equal.

Shorter repeats are found by chunks: a chunk ends after a line if a rolling hash over it
and the line before says so (one line in ``DIVISOR``). Chunks of several lines with at
least ``LEAST_WORDS`` words are looked up like the windows, by hash over all documents;
where a hash repeats, all but the first (smallest doc_id, then line) are to go, without
the lines that a window shares with its own first place.

The windows to go overlap. Of each document's, a few that cover the same lines are picked,
and their bytes are compared with the first place's, by grouping on the text itself. Is
there a hash of two texts among them, which hardly ever happens, the bytes of all are
grouped instead. Only hashes are shuffled, and the text of picked windows, pre-aggregated
by text in each task. What is to go is joined to the documents, by broadcast up to a
counted number of bytes, else by a shuffle.

A document is known by doc_id and text together: rows equal in both are one document, of
which every place is listed once, and all keep what it keeps. Of chunks at equal places
(ties of doc_id, then of the texts' hash, then of the line) the first in that order stays.
Null text stays null, an empty text has one empty line. Null ids sort first. Lines end at
\\n alone. Empty tables give empty results; columns of the operator's names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm import textbatch as tb
from snapledger.llm.common import cut, join_checked, map_batches, table

DIVISOR, LONG_WORDS, LEAST_WORDS = 2, 50, 10

_PLACE = "doc_id long, doc_key long, line int, lines int"


def _windows(words: np.ndarray, first: np.ndarray, last: np.ndarray, least: int):
    """First and last line of the shortest runs with ``least`` words from and up to every line, within its row's lines ``first`` to ``last``."""
    before = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(words))
    to = np.searchsorted(before, before[:-1] + least, "left") - 1
    since = np.searchsorted(before, before[1:] - least, "right") - 1
    down, up = to <= last, since >= first
    return np.concatenate((at[down], since[up])), np.concatenate((to[down], at[up]))


def chunks(data: np.ndarray, off: np.ndarray, divisor: int = DIVISOR, long_words: int = LONG_WORDS, least_words: int = LEAST_WORDS):
    """Row, first line, number of lines, hash, first and end byte of every window and chunk worth looking up."""
    n = len(off) - 1
    ends = np.flatnonzero(data == 0x0A)
    start = np.concatenate((off[:-1], ends + 1))
    row = np.concatenate((np.arange(n), np.searchsorted(off, ends, "right") - 1))
    order = np.argsort(start + row, kind="stable")  # an empty text begins where the next one does
    start, row = start[order], row[order]
    if not n:
        return (np.zeros(0, np.int64),) * 6
    last_of_row = np.append(row[1:] != row[:-1], True)
    end = np.where(last_of_row, off[1:][row], np.append(start[1:] - 1, 0))
    sums = tb.prefix_sums(data)
    h = tb.span_hashes(sums, start, end)
    word, _, _ = tb.word_spans(data, off)
    words = np.searchsorted(word, end) - np.searchsorted(word, start)
    before = np.roll(h, 1)
    first_of_row = np.append(True, last_of_row[:-1])
    before[first_of_row] = 0
    heavy = words >= long_words
    close = (tb.mix(h + before * tb.U64(tb.BASE)) % tb.U64(divisor) == 0) | heavy | np.append(heavy[1:], True) | last_of_row
    at_end = np.flatnonzero(close)
    at = np.concatenate(([0], at_end[:-1] + 1))
    lines = at_end - at + 1
    total = np.add.reduceat(words, at)
    worth = ((lines > 1) & (total >= least_words)) | (total >= long_words)
    first, last = np.flatnonzero(first_of_row)[row], np.flatnonzero(last_of_row)[row]
    since, to = _windows(words, first, last, long_words)
    at, at_end = np.divmod(np.unique(np.concatenate((at[worth], since)) * len(row) + np.concatenate((at_end[worth], to))), len(row))
    lines = at_end - at + 1
    number = np.arange(len(row)) - first
    return row[at], number[at], lines, tb.span_hashes(sums, start[at], end[at_end]), start[at], end[at_end]


def _find(mask: int):
    def run(batches):
        for batch in batches:
            ids, keys, parts = batch.column("doc_id"), batch.column("doc_key"), [[] for _ in range(4)]
            for i, _, data, off in tb.slices(batch.column("text")):
                row, line, lines, h, _, _ = chunks(data, off)
                for part, x in zip(parts, (row + i, line, lines, h.view(np.int64) & mask), strict=True):
                    part.append(x)
            if not parts[0]:
                continue
            row, line, lines, h = (np.concatenate(x) for x in parts)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h), ids.take(row), keys.take(row), pa.array(line.astype(np.int32)), pa.array(lines.astype(np.int32))], ["hash", "doc_id", "doc_key", "line", "lines"])

    return run


def cover(start: list[int], end: list[int]) -> list[int]:
    """Which of the spans, sorted by ``start``, to pick so that they cover what all cover; no place is in more than two."""
    out, at, covered = [], 0, -1
    while at < len(start):
        covered, best = max(covered, start[at]), -1
        while at < len(start) and start[at] <= covered:
            if best < 0 or end[at] > end[best]:
                best = at
            at += 1
        if end[best] > covered:
            out.append(best)
            covered = end[best]
    return out


def _pick(batches):
    """Of the chunks to go listed in ``found``, those that cover the lines of all; from_line and n_lines leave out what a chunk shares with its first place."""
    for batch in batches:
        lists = batch.column("found")
        x = dict(zip((f.name for f in lists.type.value_type), lists.flatten().flatten(), strict=True))
        line, lines, key, first, length = (x[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("line", "lines", "keep_key", "keep_line", "keep_lines"))
        of = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
        doc = tb.rows_of(of)
        own = key == batch.column("doc_key").to_numpy(zero_copy_only=False)[doc]
        end = line + lines
        start = np.where(own, np.maximum(line, np.minimum(first + length, end)), line)
        order = np.lexsort((-end, start, doc))
        start, end = start[order], end[order]
        picked = [k + of[d] for d in range(len(of) - 1) for k in cover(start[of[d] : of[d + 1]].tolist(), end[of[d] : of[d + 1]].tolist())]
        at = np.array(picked, np.int64)
        take = pa.array(order[at])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc[at])), batch.column("doc_key").take(pa.array(doc[at])), *(v.take(take) for v in x.values()), pa.array(start[at].astype(np.int32)), pa.array((end - start)[at].astype(np.int32))],
            ["doc_id", "doc_key", *x, "from_line", "n_lines"],
        )


def _texts(batches):
    """The text of the chunks listed in ``found`` (hash, line, lines), about a slice of text at a time."""
    kinds = dict(hash=pa.int64(), chunk=pa.string(), doc_id=pa.int64(), doc_key=pa.int64(), line=pa.int32(), lines=pa.int32())
    out, size = [], 0

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    for batch in batches:
        for doc, key, text, found in zip(*(batch.column(c) for c in ("doc_id", "doc_key", "text", "found")), strict=True):
            doc, key, lines = doc.as_py(), key.as_py(), text.as_py().split("\n")
            for x in found.as_py():
                chunk = "\n".join(lines[x["line"] : x["line"] + x["lines"]])
                out.append((x["hash"], chunk, doc, key, x["line"], x["lines"]))
                size += len(chunk)
                if size >= tb.SLICE_BYTES:
                    yield rows()
                    out, size = [], 0
    if out:
        yield rows()


def _key():
    return F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("doc_key")


def _picked(members: DataFrame) -> DataFrame:
    """The chunks to go that cover the lines of all, out of ``members`` (hash, place, keep)."""
    keep = (F.col("keep")[c].alias(f"keep_{c.removeprefix('doc_')}") for c in ("doc_id", "doc_key", "line", "lines"))
    # a set, as equal rows bring the same places
    lists = members.filter(F.struct("doc_id", "doc_key", "line", "lines") != F.col("keep")).groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("hash", "line", "lines", *keep)).alias("found"))
    return cut(map_batches(lists, _pick, "doc_id long, doc_key long, hash long, line int, lines int, keep_id long, keep_key long, keep_line int, keep_lines int, from_line int, n_lines int"))


def _repeated(docs: DataFrame, mask: int = -1) -> DataFrame:
    """(doc_id, doc_key, line, lines) of all lines to take out; of the hashes, only the bits in ``mask`` count."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key()).filter(F.col("text").isNotNull())
    found = map_batches(keyed, _find(mask), "hash long, " + _PLACE)
    place = F.struct("doc_id", "doc_key", "line", "lines")

    def texts_of(places):
        lists = cut(places.groupBy("doc_key").agg(F.collect_set(F.struct("hash", "line", "lines")).alias("found")))
        listed = join_checked(keyed, lists, "doc_key", "inner", 16 + 24 * F.size("found"))
        return map_batches(listed.select("doc_id", "doc_key", "text", "found"), _texts, "hash long, chunk string, " + _PLACE)

    groups = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keep")).filter("n > 1")
    members = found.join(groups.select("hash", "keep"), "hash")
    picked = _picked(members)
    first = picked.groupBy("hash").agg(F.min(F.struct("keep_key", "keep_line", "keep_lines")).alias("keep")).select("hash", F.col("keep.keep_key").alias("doc_key"), F.col("keep.keep_line").alias("line"), F.col("keep.keep_lines").alias("lines"))
    texts = texts_of(picked.select("hash", "doc_key", "line", "lines").unionByName(first))
    clash = texts.groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    if not clash.isEmpty():
        # different chunks with one hash: all are told apart by their text
        same = cut(texts_of(members.select("hash", "doc_key", "line", "lines").distinct()))
        first = same.groupBy("hash", "chunk").agg(F.min(place).alias("keep"))
        picked = _picked(same.join(first, ["hash", "chunk"]).drop("chunk"))
    return picked.select("doc_id", "doc_key", F.col("from_line").alias("line"), F.col("n_lines").alias("lines"))


def dedup(docs: DataFrame, mask: int = -1) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and lines_total and lines_removed; all other columns are kept, those of these names are replaced."""
    docs = docs.drop("lines_total", "lines_removed")
    lists = cut(_repeated(docs, mask).groupBy("doc_key").agg(F.collect_list(F.struct("line", "lines")).alias("__line_drops")))
    lists = lists.withColumnRenamed("doc_key", "__line_doc")
    keyed = docs.withColumn("__line_doc", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    joined = join_checked(keyed, lists, "__line_doc", "left", 16 + 16 * F.size("__line_drops"))
    schema = docs.withColumn("lines_total", F.lit(0)).withColumn("lines_removed", F.lit(0)).schema
    names = docs.columns

    def run(batches):
        for batch in batches:
            text, drops = batch.column("text"), batch.column("__line_drops")
            total, removed, changed = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32), {}
            at = 0
            for i, j, data, off in tb.slices(text):
                sums = np.concatenate(([0], np.cumsum(data == 0x0A)))
                total[i:j] = sums[off[1:]] - sums[off[:-1]] + 1
                at = j
            total[:at][text.is_null().to_numpy(zero_copy_only=False)[:at]] = 0
            for k in np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False)):
                rows = text[int(k)].as_py().split("\n")
                keep = np.ones(len(rows), bool)
                for d in drops[int(k)].as_py():
                    keep[d["line"] : d["line"] + d["lines"]] = False
                removed[k] = len(rows) - keep.sum()
                changed[int(k)] = "\n".join(r for r, y in zip(rows, keep, strict=True) if y)
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                text = pa.compute.replace_with_mask(text, pa.array(mask), pa.array(list(changed.values()), text.type))
            columns = [text if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(removed)], [*names, "lines_total", "lines_removed"])

    return map_batches(joined.select(*names, "__line_drops"), run, schema)


def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "lines_total", "lines_removed", F.length("text").cast("long").alias("n_chars"), "text")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` after dedup, with n_chars set anew; documents of which nothing but white space is left go."""
    out = dedup(docs)
    gone = (F.col("lines_removed") > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    return out.filter(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)
