"""Jaccard join of word-shingle sets by PartEnum signatures.

A text's set holds its distinct runs of five words, hashed to 64 bits. Two sets of Jaccard
similarity 4/5 or more differ in at most (|A| + |B|) / 9 elements. Sets are banded by
size, each band up to twice the last; pairs inside a band and pairs across each border
between bands are looked for apart. For each of these searches the domain of shingles is
cut into groups of ``PARTS`` parts, more groups than half the elements in which a pair can
differ: in one group at least, all differences lie in a single part. So in every group all
subsets that leave one part out are enumerated, a subset's signature is the hash of what
the set holds in it, and two similar sets must agree in one.

A set uses only signatures that cover at least t telling elements, t being the largest
number up to ``LIGHT`` for which the groups whose every subset has as many still outnumber
half of what the set can differ in from any partner: of two similar sets, a signature used
by the one with the larger t must agree, and covers as much in the other. Shingles that
at least ``COMMON`` of about ``SAMPLE`` texts hold are not telling: a line or passage that
many texts share makes no signature by itself. Which shingles these are (the ``MOST_COMMON``
most frequent at most) decides only about cost, never about a link, so a bounded sample of
distinct texts is enough.

Equal sets are one node, and signatures that the same nodes share are one group. Each
group's nodes are tied to the one among them that stands in the largest groups, which of
copies is what they were copied from; where they are then in different components, ``TURNS``
times to another one drawn at random, which differs from group to group; nodes that share
a group and are still in different components are tied pairwise, but only those that agree
in one of their rarest elements: of n elements two similar sets lack no more than n / 5 of
each other's, so that one of the n / 5 + 1 rarest, counted among these nodes, is in both.
A tie counts only if the sets themselves pass the test: parities of the sets, in about as
many bits as they have elements (``FINE`` times as many for pairs within a group), which
differ in no more places than the sets do, spare most false pairs the comparison, the
texts of the others are compared. No link between different sets is lost and no group of copies is expanded
into its pairs.

The set of a text with fewer than five words is its whole sequence; without words or text
it is empty and linked with nothing. Rows are told apart by doc_id and text. Equal rows,
and all rows of a null doc_id, keep the component of their set; component_id is the least
id that is not null. Of equally good ties any may be taken, which changes no component.
Empty tables give empty results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm import textbatch as tb
from snapledger.llm.common import cut, gathered, join_checked, map_batches, sample_share, table
from snapledger.llm.components import components

WIDTH, PARTS, LIGHT, TURNS = 5, 3, 3, 1
SAMPLE, COMMON, MOST_COMMON, FINE = 16_000, 8, 200_000, 8
#: Longs of the parity that is compared before the fine one.
FIRST = [f"first_{k}" for k in range(8)]
#: Pairs of sets a task compares; nodes of a signature that are held to see whether another has the same ones.
PAIRS_PER_TASK, WHOLE = 10_000, 4096
#: Shingles whose signatures are sorted in one task.
SHINGLES_PER_TASK = 1_000_000
#: A signature has so many bits that this share of them (2**-SPARE) meets a foreign one by chance.
SPARE = 20

_ODD = tb.U64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the texts' offsets among them."""
    h, of = tb.window_hashes(*tb.word_hashes(data, off), width)
    row = tb.rows_of(of)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(off) - 1))))


def set_hashes(items: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A hash of each set as a whole."""
    sums = np.concatenate((np.zeros(1, tb.U64), np.cumsum(tb.mix(items ^ _ODD), dtype=tb.U64)))
    return tb.mix(sums[of[1:]] - sums[of[:-1]] + np.diff(of).astype(tb.U64))


def parities(items: np.ndarray, of: np.ndarray, bits: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Each set's parity in longs, a power of two of them with at least ``bits`` for each element, and the sets' offsets among them.

    Halving a parity by exclusive or gives the one in half as many bits.
    """
    longs = np.exp2(np.ceil(np.log2(np.maximum(1, np.diff(of) * bits / 64)))).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(longs)))
    row = tb.rows_of(of)
    bit = (items & (longs[row] * 64 - 1).astype(tb.U64)).astype(np.int64) + base[row] * 64
    odd = (np.bincount(bit, minlength=base[-1] * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), base


def _instances(n: np.ndarray):
    """For each set and each search that it takes part in: the set, the search's number, the set's most differences, the groups.

    Searches in which a set could differ in nothing from a partner find equal sets only, which are one node.
    """
    band = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    band += (1 << band) < n
    doc = np.arange(len(n))
    top = np.left_shift(1, band)
    out = [(doc, 2 * band, (n + np.minimum(top, 5 * n // 4)) // 9, 2 * top // 9)]
    for shift in (-1, 0):
        b = band + shift
        border = np.left_shift(1, np.maximum(b, 0))
        low, high = n <= border, n > border
        fits = (b >= 0) & ((low & (5 * n // 4 > border)) | (high & (4 * n <= 5 * border)))
        most = np.where(low, n + 5 * n // 4, n + border) // 9
        out.append((doc[fits], 2 * b[fits] + 1, most[fits], ((border + 5 * border // 4) // 9)[fits]))
    doc, search, most, bound = (np.concatenate(x) for x in zip(*out, strict=True))
    some = (n[doc] > 0) & (most > 0)
    doc, search, most, bound = doc[some], search[some], most[some], bound[some]
    return doc, search, most, bound // 2 + 1 + np.maximum(1, bound // 12)


def signatures(items: np.ndarray, of: np.ndarray, common: np.ndarray, light: int = LIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and the number of the set of each. ``common``: sorted shingles that do not tell."""
    telling = np.ones(len(items), bool)
    if len(common):
        telling = common[np.minimum(np.searchsorted(common, items), len(common) - 1)] != items
    doc, search, most, groups = _instances(np.diff(of))
    n = np.diff(of)[doc]
    instance = np.repeat(np.arange(len(doc)), n)
    ends = np.concatenate(([0], np.cumsum(n)))
    element = np.repeat(of[:-1][doc] - ends[:-1], n) + np.arange(ends[-1])
    x = items[element]
    base = np.concatenate(([0], np.cumsum(groups)))
    dealt = tb.mix(x + (search[instance].astype(tb.U64) + tb.U64(1)) * _ODD) >> tb.U64(32)
    part = PARTS * base[:-1][instance] + (dealt * (PARTS * groups[instance]).astype(tb.U64) >> tb.U64(32)).astype(np.int64)
    sums = np.zeros(PARTS * base[-1], tb.U64)
    np.add.at(sums, part, tb.mix(x ^ (_ODD << tb.U64(1))))
    held = np.bincount(part[telling[element]], minlength=len(sums)).reshape(-1, PARTS)
    # what a part holds, told from the same in another part of its group
    sums = tb.mix(sums + tb.mix(np.arange(PARTS, dtype=tb.U64))[np.arange(len(sums)) % PARTS]).reshape(-1, PARTS)
    owner = np.repeat(np.arange(len(doc)), groups)
    # telling elements outside each part, that is in the subset that leaves it out
    rest = held.sum(axis=1)[:, None] - held
    least = np.zeros(len(doc), np.int64)
    for t in range(1, light + 1):
        least[np.bincount(owner[rest.min(axis=1) >= t], minlength=len(doc)) > most // 2] = t
    group, left_out = np.nonzero(rest >= least[owner][:, None])
    subset = sums.sum(axis=1)[group] - sums[group, left_out]
    owner = owner[group]
    place = search[owner].astype(tb.U64) << tb.U64(40) | (PARTS * (group - base[:-1][owner]) + left_out).astype(tb.U64)
    return tb.mix(subset + tb.mix(place)), doc[owner]


def _describe(batches):
    """Size, node and parity of each text's set."""
    for batch in batches:
        size, node, parity, longs = [], [], [], []
        for _, _, data, off in tb.slices(batch.column("text")):
            items, of = shingle_sets(data, off)
            size.append(np.diff(of))
            node.append(set_hashes(items, of))
            values, base = parities(items, of)
            parity.append(values)
            longs.append(np.diff(base))
        if size:
            base = np.concatenate(([0], np.cumsum(np.concatenate(longs)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("doc_key"), pa.array(np.concatenate(size)), pa.array(np.concatenate(node).view(np.int64)), pa.ListArray.from_arrays(pa.array(base), pa.array(np.concatenate(parity)))],
                ["doc_id", "doc_key", "n", "node", "parity"],
            )


def first_parities(items: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Each set's parity in as many longs as ``FIRST`` has names, a row of them for each set."""
    bits = 64 * len(FIRST)
    bit = (items & tb.U64(bits - 1)).astype(np.int64) + tb.rows_of(of) * bits
    odd = (np.bincount(bit, minlength=(len(of) - 1) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(-1, len(FIRST))


def _fine(batches):
    """Size, elements, first and fine parity of each text's set."""
    for batch in batches:
        for i, j, data, off in tb.slices(batch.column("text")):
            items, of = shingle_sets(data, off)
            values, base = parities(items, of, FINE)
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(x)) for o, x in ((base, values), (of, items.view(np.int64)))]
            first = first_parities(items, of)
            columns = [batch.column("doc_key").slice(i, j - i), pa.array(np.diff(of)), *lists, *(pa.array(np.ascontiguousarray(x)) for x in first.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_key", "n", "parity", "items", *FIRST])


def _shingles(batches):
    for batch in batches:
        for _, _, data, off in tb.slices(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(data, off)[0].view(np.int64))], ["item"])


def _common(keyed: DataFrame, rows: int) -> np.ndarray:
    """Shingles that COMMON or more texts of a sample hold, the MOST_COMMON most frequent at most."""
    some = keyed.filter(F.col("text").isNotNull()).filter(sample_share(SAMPLE, F.lit(max(1, rows)), F.col("text"))).select("text").distinct()
    counted = map_batches(some, _shingles, "item long").groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(counted.orderBy(F.desc("n"), "item").limit(MOST_COMMON).select("item").toArrow()["item"].to_numpy().view(tb.U64))


def _sign(common, bits: int):
    """Signatures in ``bits`` bits of every node that a task meets, once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, off in tb.slices(batch.column("text")):
                items, of = shingle_sets(data, off)
                node = set_hashes(items, of)
                new = np.zeros(len(node), bool)
                for k, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[k] = True
                items = items[np.repeat(new, np.diff(of))]
                of = np.concatenate(([0], np.cumsum(np.diff(of)[new])))
                sig, doc = signatures(items, of, common.value)
                yield pa.RecordBatch.from_arrays([pa.array((sig >> tb.U64(64 - bits)).view(np.int64)), pa.array(node[new][doc].view(np.int64))], ["sig", "node"])

    return run


def _tie(batches):
    """From rows sorted by signature and node: (grp, node, size) of all nodes that share a signature with others.

    grp is a hash of the nodes that share the signature, so that signatures shared by the
    same nodes are one group; of a signature with more than ``WHOLE`` nodes, which are not
    held together, it is the signature's own.
    """

    def out(grp, node, size):
        return pa.RecordBatch.from_arrays([pa.array(grp.view(np.int64)), pa.array(node), pa.array(size.astype(np.int32))], ["grp", "node", "size"])

    sig, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    streamed = before = None  # a signature whose nodes are no longer held, and the last of them
    for batch in _and_end(batches):
        last = batch is None
        if not last:
            new_sig, new_node = (batch.column(c).to_numpy() for c in ("sig", "node"))
            if streamed is not None and len(new_sig):
                k = int(np.searchsorted(new_sig, streamed, "right"))
                x = new_node[:k]
                x = x[np.append(x[:1] != before, x[1:] != x[:-1])] if k else x
                if len(x):
                    yield out(np.full(len(x), tb.mix(np.array([streamed]).view(tb.U64))[0]), x, np.full(len(x), WHOLE))
                    before = x[-1]
                if k < len(new_sig):
                    streamed = None
                new_sig, new_node = new_sig[k:], new_node[k:]
            sig, node = np.concatenate((sig, new_sig)), np.concatenate((node, new_node))
        if not len(sig):
            continue
        once = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        sig, node = sig[once], node[once]
        done = len(sig) if last else int(np.searchsorted(sig, sig[-1]))
        if done:
            start = np.flatnonzero(np.append(True, sig[1:done] != sig[: done - 1]))
            size = np.diff(np.append(start, done))
            grp = tb.mix(np.add.reduceat(tb.mix(node[:done].view(tb.U64)), start) + size.astype(tb.U64))
            several = np.repeat(size > 1, size)
            yield out(np.repeat(grp, size)[several], node[:done][several], np.repeat(size, size)[several])
        sig, node = sig[done:], node[done:]
        if len(sig) > WHOLE:
            streamed, before = sig[0], node[-1]
            yield out(np.full(len(node), tb.mix(sig[:1].view(tb.U64))[0]), node, np.full(len(node), WHOLE))
            sig, node = sig[:0], node[:0]


def _and_end(batches):
    yield from batches
    yield None


def similar(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Whether the sets of each pair of texts have a Jaccard similarity of 4/5 or more."""
    good, i = [], 0
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y)))
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + tb.SLICE_BYTES, "right")))
        (a, a_of), (b, b_of) = (shingle_sets(*tb.flat(c.slice(i, j - i))) for c in (x, y))
        row, h = np.concatenate((tb.rows_of(a_of), tb.rows_of(b_of))), np.concatenate((a, b))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        # a value that a row has twice is in both of its sets
        both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=j - i)
        good.append(100 * both >= 80 * (np.diff(a_of) + np.diff(b_of) - both))
        i = j
    return np.concatenate(good) if good else np.zeros(0, bool)


def _compare(batches):
    for batch in batches:
        good = similar(batch.column("x"), batch.column("y"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _sizes_fit() -> Column:
    return F.expr("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")


def _near() -> Column:
    """Whether the parities of a and b, the longer one folded, differ in no more bits than similar sets may in elements."""
    size = F.least(F.size("parity_a"), F.size("parity_b"))
    fold = lambda p: F.transform(F.slice(p, F.lit(1), size), lambda x, i: x.bitwiseXOR(F.coalesce(F.get(p, i + size), F.lit(0).cast("long"))))
    differ = F.zip_with(fold(F.col("parity_a")), fold(F.col("parity_b")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x) * 9 <= F.col("n_a") + F.col("n_b")


def _texts(wanted: DataFrame, keyed: DataFrame) -> DataFrame:
    """(doc_key, text) of the keys in ``wanted``, each once."""
    return join_checked(keyed.select("doc_key", "text"), wanted, "doc_key", "left_semi", 8).dropDuplicates(["doc_key"])


def _links(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    of = lambda c: nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "parity", "doc_key")))
    near = pairs.join(of("a"), "a").join(of("b"), "b").filter(_sizes_fit()).filter(_near())
    near = cut(near.select("a", "b", "doc_key_a", "doc_key_b"))
    near = gathered(near, near.count(), PAIRS_PER_TASK)
    wanted = near.select(F.explode(F.array("doc_key_a", "doc_key_b")).alias("doc_key")).distinct()
    # written out, as Spark can split a hot leader's pairs only if both sides of their join are plain shuffles
    texts = cut(_texts(wanted, keyed))
    of = lambda c, name: texts.select(F.col("doc_key").alias(f"doc_key_{c}"), F.col("text").alias(name))
    both = near.join(of("b", "y"), "doc_key_b").join(of("a", "x"), "doc_key_a").select("a", "b", "x", "y")
    return cut(map_batches(both, _compare, "a long, b long"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of their node."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(grp, node, root) of all groups whose nodes have different roots."""
    rooted = _rooted(members.select("grp", "node"), roots)
    split = rooted.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("grp")
    return rooted.join(split, "grp", "left_semi")


def _left_over(apart: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes in ``apart`` (grp, node, root) that share a group, not the root, and may be similar.

    A node's groups are as many as it has signatures at most, whatever the groups' sizes.
    """
    own = cut(apart.groupBy("node").agg(F.first("root").alias("root"), F.collect_set("grp").alias("groups")).join(nodes.select("node", "doc_key"), "node"))
    firsts = ", ".join(f"{x} long" for x in FIRST)
    fine = map_batches(_texts(own.select("doc_key"), keyed), _fine, f"doc_key long, n long, parity array<long>, items array<long>, {firsts}")
    fine = cut(fine.join(own, "doc_key").drop("doc_key"))
    held = fine.select("node", "n", F.explode("items").alias("item"))
    often = held.groupBy("item").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # an element that one node only holds takes its place among the rarest, but ties nothing
    order = Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "item")
    rare = held.join(often, "item", "left").withColumn("place", F.row_number().over(order)).filter("place <= n div 5 + 1 AND often IS NOT NULL")
    # what goes along with each rare element is narrow; groups and fine parities meet the pairs that are left
    rare = cut(rare.select("node", "item").join(fine.select("node", "root", "n", *FIRST), "node"))
    side = lambda c: rare.select(F.col("item").alias(f"item_{c}"), F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("root", "n", *FIRST)))
    differ = " + ".join(f"bit_count({x}_a ^ {x}_b)" for x in FIRST)
    # tests are part of the join's own condition: pairs that they rule out are never rows
    condition = F.expr("item_a = item_b AND a < b AND root_a <> root_b") & _sizes_fit() & F.expr(f"9 * ({differ}) <= n_a + n_b")
    pairs = cut(side("a").join(side("b"), condition).select("a", "b").distinct())
    of = lambda c: fine.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("groups", "n", "parity")))
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter(_near() & F.arrays_overlap("groups_a", "groups_b"))
    return both.select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, n_shingles, component_id, root) of every row of ``docs`` (doc_id, text); doc_key tells texts with one id apart.

    component_id is the component's least doc_id, which is null where all ids are and may
    be another component's too; root tells components apart, and is null for empty sets.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = keyed.withColumn("doc_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    described = cut(map_batches(keyed, _describe, "doc_id long, doc_key long, n long, node long, parity array<long>"))
    nodes = described.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("doc_key").alias("doc_key"), F.max("n").alias("n"), F.min("parity").alias("parity"))
    nodes = cut(nodes)
    rows, shingles = described.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    common = spark.sparkContext.broadcast(_common(keyed, rows))
    bits = min(64, SPARE + math.ceil(math.log2(shingles + 2)))
    width = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // SHINGLES_PER_TASK)
    signed = map_batches(keyed.select("text"), _sign(common, bits), "sig long, node long").repartition(width, "sig").sortWithinPartitions("sig", "node")
    tied = cut(map_batches(signed, _tie, "grp long, node long, size int").groupBy("grp", "node").agg(F.max("size").alias("size")))

    # every group's leader: the node that stands in the largest groups
    weight = tied.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = tied.join(weight, "node").groupBy("grp").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    members = cut(tied.select("grp", "node").join(leaders, "grp").filter("node <> leader"))
    links = _links(members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes, keyed)
    roots = cut(components(links))

    # the other nodes of a group, where they are in different components
    for turn in range(TURNS):
        apart = cut(_apart(members, roots))
        drawn = apart.groupBy("grp").agg(F.max_by(F.struct("node", "root"), F.xxhash64(F.lit(turn), "grp", "node")).alias("drawn"))
        pairs = cut(apart.join(drawn, "grp").filter("root <> drawn.root").select(F.col("drawn.node").alias("a"), F.col("node").alias("b")).distinct())
        if pairs.isEmpty():
            break
        links = links.unionByName(_links(pairs, nodes, keyed))
        roots = cut(components(links))
    apart = cut(_apart(members, roots))
    pairs = cut(_left_over(apart, nodes, keyed))
    if not pairs.isEmpty():
        roots = cut(components(links.unionByName(_links(pairs, nodes, keyed))))

    by_node = _rooted(nodes.select("node", "least_id"), roots)
    least = by_node.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = by_node.join(least, "root").select("node", "component_id", "root")
    full, empty = described.filter("n > 0").join(by_node, "node"), described.filter("n = 0")
    full = full.select("doc_id", "doc_key", F.col("n").alias("n_shingles"), "component_id", "root")
    return full.unionByName(empty.select("doc_id", "doc_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def op2(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the least doc_id (null last; of rows with one id, that of the least key; of equal rows, one), and all documents with an empty set, with all their columns."""
    keyed = docs.withColumn("__jaccard_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    found = classes(docs).groupBy("doc_key").agg(F.first("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("root").alias("root"), (F.count(F.lit(1)) > 1).alias("again"))
    found = cut(found)
    first = found.filter("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key", "again")).alias("first"))
    keep = cut(first.select(F.col("first.doc_key").alias("__jaccard_key"), F.col("first.again").alias("__jaccard_again")).unionByName(found.filter("n = 0").select(F.col("doc_key").alias("__jaccard_key"), F.lit(False).alias("__jaccard_again"))))
    kept = join_checked(keyed, keep, "__jaccard_key", "inner")
    # only rows that have an equal are shuffled to leave one of them
    one = kept.filter("__jaccard_again").dropDuplicates(["__jaccard_key"])
    return kept.filter("NOT __jaccard_again").unionByName(one).select(docs.columns)
