"""Byte-level BPE encoding and decoding, each distinct word encoded once for the whole table.

Encoding goes in blocks of consecutive documents. Texts are split into pre-tokens, each
position keeping the number of its word among the block's distinct words; the blocks are
shuffled once. The words are dealt over buckets by hash, a block's words of a bucket as one
compressed row, and every bucket encodes each distinct word once, whatever number of
blocks it came from; the ids go back to the blocks in the same rows and each document is
put together by position. So a word crosses the network once for each block that has it,
never once for each position, and a frequent word weighs no more than a rare one.

Decoding looks the ids up in the table of token bytes, which the vocabulary bounds.

Ids are given as little-endian unsigned 32-bit integers in a binary column, which holds
for texts of any length and is what digests are taken of. Null and empty text give no
ids, no ids give empty bytes; a null id list is decoded as an empty one. Rows are
encoded one by one, equal or not, and null ids stay null. A text longer than a block is a
block of its own. Empty tables give empty results; ``encode`` reads doc_id and text only.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm import textbatch as tb
from snapledger.llm.common import map_batches, table

#: Characters of text in a block (one document more at most), and the most buckets.
BLOCK_CHARS, MOST_BUCKETS = 4 << 20, 4096

#: What the tokenizer library's \\s stands for: Unicode's White_Space.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def public_vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and splitting pattern of the public 50k vocabulary."""
    import public_tokenizers

    return vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@functools.lru_cache(2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern.replace("[^\\s", f"[^{_BLANK}").replace("\\s", f"[{_BLANK}]").replace("\\S", f"[^{_BLANK}]")).findall


def _pack(array: np.ndarray) -> bytes:
    """Compressed, with the bytes of equal weight together; begins with the number of items."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T.tobytes()
    return len(array).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if len(array) else b"")


def _unpack(packed: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(packed[8:], n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def _flat_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def _bucket(data: np.ndarray, length: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word, worked out for a slice of the words at a time."""
    off = np.concatenate(([0], np.cumsum(length)))
    out, i = np.zeros(len(length), np.int64), 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(off, off[i] + tb.SLICE_BYTES, "right")) - 1)
        of = off[i : j + 1] - off[i]
        out[i:j] = tb.span_hashes(tb.prefix_sums(data[off[i] : off[j]]), of[:-1], of[1:]) % tb.U64(buckets)
        i = j
    return out


def _split(pattern: str):
    """Blocks: their documents' ids and token counts, distinct words, and the words' numbers by position."""
    schema = "block long, ids array<long>, counts binary, data binary, lengths binary, positions binary"

    def block(number, ids, positions, seen):
        data, length = _flat_words([w.encode() for w in seen])
        counts = np.fromiter(map(len, positions), np.int64, len(positions))
        packed = (pa.array([_pack(x)], pa.binary()) for x in (counts, data, length, np.concatenate(positions)))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *packed], ["block", "ids", "counts", "data", "lengths", "positions"])

    def run(batches):
        find, number = _splitter(pattern), TaskContext.get().partitionId() << 32
        ids, positions, seen, size = [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                words = find(text)
                ids.append(doc_id.as_py())
                positions.append(np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.uint32, len(words)))
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield block(number, ids, positions, seen)
                    number += 1
                    ids, positions, seen, size = [], [], {}, 0
        if ids:
            yield block(number, ids, positions, seen)

    return run, schema


def _deal(buckets: int):
    """A row for each bucket of each block: its words, in the block's order."""

    def run(batches):
        for batch in batches:
            for block, data, lengths in zip(*(batch.column(c) for c in ("block", "data", "lengths")), strict=True):
                block, data, length = block.as_py(), _unpack(data.as_py(), np.uint8), _unpack(lengths.as_py(), np.int64)
                dealt = _bucket(data, length, buckets)
                order = np.argsort(dealt, kind="stable")
                off = np.concatenate(([0], np.cumsum(length)))
                sizes = np.bincount(dealt, minlength=buckets)
                by_bucket = length[order]
                # the words' bytes in bucket order
                at = np.repeat(off[order] - np.concatenate(([0], np.cumsum(by_bucket)[:-1])), by_bucket) + np.arange(len(data)) if len(order) else np.zeros(0, np.int64)
                data = data[at]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                byte_ends = np.concatenate(([0], np.cumsum(by_bucket)))[ends]
                some = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some.astype(np.int32)),
                        pa.array(np.full(len(some), block, np.int64)),
                        pa.array([_pack(data[byte_ends[b] : byte_ends[b + 1]]) for b in some], pa.binary()),
                        pa.array([_pack(by_bucket[ends[b] : ends[b + 1]]) for b in some], pa.binary()),
                    ],
                    ["bucket", "block", "data", "lengths"],
                )

    return run, "bucket int, block long, data binary, lengths binary"


def _encode(held):
    """The words' ids, from rows sorted by bucket; every distinct word of a bucket is encoded once and known as long as its bucket lasts."""

    def run(batches):
        import tiktoken

        ranks, pattern = held.value
        piece = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            out = [[], []]
            for bucket, data, lengths in zip(batch.column("bucket").to_pylist(), batch.column("data"), batch.column("lengths"), strict=True):
                if bucket != now:
                    known.clear()
                    now = bucket
                data, length = _unpack(data.as_py(), np.uint8).tobytes(), _unpack(lengths.as_py(), np.int64)
                ids, at = [], 0
                for n in length.tolist():
                    word = data[at : at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = piece(word)
                    ids.append(got)
                out[0].append(_pack(np.fromiter(map(len, ids), np.int64, len(ids))))
                out[1].append(_pack(np.array([x for i in ids for x in i], np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("block"), *(pa.array(x, pa.binary()) for x in out)], ["bucket", "block", "n", "tokens"])

    return run, "bucket int, block long, n binary, tokens binary"


def _gather(values: np.ndarray, off: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the items ``which`` one after another, and their number up to each item."""
    n = length[which]
    ends = np.concatenate(([0], np.cumsum(n)))
    return values[np.repeat(off[which] - ends[:-1], n) + np.arange(ends[-1])], ends


def _assemble(buckets: int, part: int = 1 << 17):
    """Documents' ids from the blocks and their words' ids; ``part`` positions at a time."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("data", "lengths", "found", "counts", "positions")}
                data, length = _unpack(row["data"], np.uint8), _unpack(row["lengths"], np.int64)
                order = np.argsort(_bucket(data, length, buckets), kind="stable")
                found = sorted(row["found"] or [], key=lambda x: x["bucket"])
                n = np.concatenate([np.zeros(0, np.int64), *(_unpack(x["n"], np.int64) for x in found)])
                tokens = np.concatenate([np.zeros(0, np.uint32), *(_unpack(x["tokens"], np.uint32) for x in found)])
                size, first = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
                size[order], first[order] = n, np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
                counts, positions = _unpack(row["counts"], np.int64), _unpack(row["positions"], np.uint32)
                of = np.concatenate(([0], np.cumsum(counts)))
                del row, found, data, n
                doc_ids, i = batch.column("ids")[k].values, 0
                while i < len(counts):
                    j = max(i + 1, int(np.searchsorted(of, of[i] + part, "right")) - 1)
                    ids, ends = _gather(tokens, first, size, positions[of[i] : of[j]])
                    ends = ends[of[i : j + 1] - of[i]]
                    raw = ids.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc_ids.slice(i, j - i),
                            pa.array(np.diff(ends)),
                            pa.array([raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                        ],
                        ["doc_id", "n_tokens", "ids"],
                    )
                    i = j

    return run, "doc_id long, n_tokens long, ids binary"


def _decode(held):
    """Id batches with the bytes of their ids."""

    def run(batches):
        data, length = held.value
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch, out = whole.slice(k, 256), []
                for raw in batch.column("ids"):
                    which = np.minimum(np.frombuffer(raw.as_py() or b"", "<u4"), len(length) - 1).astype(np.int64)
                    out.append(_gather(data, first, length, which)[0].tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def _token_bytes(spark, ranks: dict[bytes, int]):
    """The table of token bytes, flat: all bytes, and each id's number of them; one id more stands for what is no token."""
    size = np.zeros(max(ranks.values(), default=0) + 2, np.int64)
    for token, k in ranks.items():
        size[k] = len(token)
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8), size))


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of ``docs`` (doc_id, text). Without ``ranks`` and ``pattern``: the public 50k vocabulary.

    With ``decoded``, also what ``decode`` makes of the ids, worked out in the task that has them at hand.
    """
    if ranks is None or pattern is None:
        ranks, pattern = public_vocabulary()
    spark = docs.sparkSession
    buckets = max(16, min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # both uses below read this one exchange: its rows go to either as they are, all columns
    blocks = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), *_split(pattern)).repartition(buckets, "block")
    words = map_batches(blocks, *_deal(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = map_batches(words, *_encode(spark.sparkContext.broadcast((ranks, pattern)))).repartition(buckets, "block")
    found = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "tokens")).alias("found"))
    run, schema = _assemble(buckets)
    if decoded:
        again, assemble = _decode(_token_bytes(spark, ranks)), run
        run, schema = (lambda batches: again(assemble(batches))), schema + ", decoded binary"
    return map_batches(blocks.join(found.hint("merge"), "block", "left"), run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` in decoded (replaced if there); ids outside the vocabulary stand for nothing."""
    encoded = encoded.drop("decoded")
    held = _token_bytes(encoded.sparkSession, public_vocabulary()[0] if ranks is None else ranks)
    return map_batches(encoded, _decode(held), encoded.withColumn("decoded", F.lit(b"")).schema)


def op5(spark, sf_dir):
    coded = encode(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
