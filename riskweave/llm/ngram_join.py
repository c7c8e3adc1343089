"""N-gram Jaccard join by vertical partitioning: the groups that links make, and each document's number of links.

The global order puts n-grams by how often they occur (a sketch of fixed size counts all of them), then by hash, and
is cut into fragments. Two sets that reach the threshold share some of the first n-grams of that order in each, so
candidates meet there. For each candidate pair the overlap is counted in each fragment by itself, and the counts are
summed. Texts with equal sets are one node. For groups, pairs within a group needn't be tested: first each set is
linked to one common partner of its bucket, and then every candidate pair whose sides are still in different groups is
tested. That loses no link that matters to a group, and never makes all pairs of a group as rows.

An n-gram of HOT sets or more has no bucket of its own, so no task gathers one. Sets that such n-grams connect are a
family; a family is compared in blocks, as below, and gives back one link for each two groups that meet.

Every link lies within a group. To count them all, a group's sets are dealt into blocks by size, and each two blocks
whose sizes can link meet in a task of their own that compares all their sets and gives back one number a set.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, mapped, picked, rare_gc, release, slices, staged, table
from .components import components
from .shingles import mixed, set_id, shingle_sets

#: Cells of the sketch that orders n-grams: 4 bytes each, whatever the corpus.
CELLS = 1 << 21
#: Cells of a row of the sketch.
SLICE_CELLS = 1 << 16
FRAGMENTS = 4
#: Two sets that link share this many n-grams of their prefixes (or all that they must share, if that is fewer).
SHARED = 4
#: Sets from which on an n-gram is hot: the largest bucket that a task gathers.
HOT = 512
#: Sets and n-grams of a block of a group, about; two blocks are in a worker's memory at once.
BLOCK_SETS, BLOCK_GRAMS = 256, 1 << 20
#: N-grams that this many sets of two blocks hold are counted by a product of matrices, so many at a time; rarer ones by lookups.
DENSE, DENSE_GRAMS = 32, 1 << 11
#: Pairs that lookups expand to at once.
LOOKUP = 1 << 21

_SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("sid", pa.binary()), ("cells", pa.int32()), ("counts", pa.binary())])
_PREFIX = pa.schema([("sid", pa.binary()), ("n", pa.int64()), ("grams", pa.list_(pa.int64())), ("often", pa.list_(pa.bool_()))])
_PARTS = pa.schema([("sid", pa.binary()), ("fragment", pa.int32()), ("grams", pa.binary())])


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _sets(n: int):
    """Each document's set, and at a task's end its part of the sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_gc()
        sketch = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                sketch += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS).astype(np.uint32) if sets else 0
                k = len(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=_SETS)
        for i in range(0, CELLS, SLICE_CELLS):
            own = sketch[i : i + SLICE_CELLS]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([i // SLICE_CELLS], pa.int32()), pa.array([zlib.compress(own.astype("<u4").tobytes(), 1)])], schema=_SETS)

    return rows


def _summed(key, t):
    total = np.zeros(SLICE_CELLS, dtype=np.uint64)
    for x in t.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_buffer()), dtype="<u4")
    return pa.table({"cells": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()])})


def _sketch(sets: DataFrame) -> np.ndarray:
    rows = sets.filter(F.col("cells").isNotNull()).select("cells", "counts").groupBy("cells").applyInArrow(_summed, "cells int, counts binary").collect()
    out = np.zeros(CELLS, dtype=np.uint32)  # 32 rows of 256 KB at most
    for r in rows:
        out[r["cells"] * SLICE_CELLS : (r["cells"] + 1) * SLICE_CELLS] = np.frombuffer(bytes(r["counts"]), dtype="<u4")
    return out


def _ordered(s: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, with each n-gram's count in the sketch."""
    counts = sketch[_cell(s)]
    order = np.argsort(counts, kind="stable")  # s is sorted by hash
    return s[order], counts[order]


def _prefixes(n: int, percent: int, shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_gc()
        for batch in batches:
            for part in slices(batch, "text"):
                sids, sizes, grams, often = [], [], [], []
                for s in shingle_sets(part.column("text").to_pylist(), n):
                    if len(s):
                        sids.append(set_id(s))
                        sizes.append(len(s))
                        # An overlap of percent / 100 of the set leaves out at most this many, less 1, and then come those that are shared.
                        first = len(s) + (-percent * len(s)) // 100 + SHARED
                        ordered, counts = _ordered(s, shared.value)
                        grams.append(ordered[:first].view(np.int64))
                        often.append(counts[:first] >= HOT)  # the sketch counts no less than there are
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.bool_()))], schema=_PREFIX)

    return rows


class Some:
    """A Bloom filter of ids, of a fixed size (2 MB): what it lets through by mistake is left out later."""

    BITS = 1 << 24
    #: Bytes of a piece that tasks send.
    PIECE = 1 << 16

    def __init__(self) -> None:
        self.bits = np.zeros(self.BITS // 8, dtype=np.uint8)

    @classmethod
    def slots(cls, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return (h & np.uint64(cls.BITS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(cls.BITS - 1)).astype(np.int64)

    @classmethod
    def of(cls, ids: DataFrame) -> "Some":
        """ids: one column of longs. Each task sends its filter packed, and they are joined on an executor."""

        def rows(batches):
            own = np.zeros(cls.BITS, dtype=bool)
            for b in batches:
                for slot in cls.slots(b.column(0).to_numpy()):
                    own[slot] = True
            packed = np.packbits(own, bitorder="little")
            for i in range(0, len(packed), cls.PIECE):
                if packed[i : i + cls.PIECE].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i // cls.PIECE], pa.int32()), pa.array([packed[i : i + cls.PIECE].tobytes()])], names=["i", "bits"])

        def joined(key, t):
            return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("bits")]).tobytes()])})

        out = cls()
        for r in mapped(ids, rows, "i int, bits binary").groupBy("i").applyInArrow(joined, "i int, bits binary").collect():
            out.bits[r["i"] * cls.PIECE : (r["i"] + 1) * cls.PIECE] = np.frombuffer(bytes(r["bits"]), np.uint8)
        return out

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        a, b = ((self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 for slot in self.slots(ids))
        return (a & b).astype(bool)


def _fragments(n: int, shared, cuts: np.ndarray, wanted):
    """The fragments of the sets of those documents that may be asked for; those without an id may always be."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_gc()
        for batch in batches:
            ids = batch.column("doc_id")
            batch = batch.filter(pa.array(wanted.value.may_hold(ids.fill_null(0).to_numpy(zero_copy_only=False)) | ~ids.is_valid().to_numpy(zero_copy_only=False)))
            for part in slices(batch, "text"):
                sids, numbers, grams = [], [], []
                for s in shingle_sets(part.column("text").to_pylist(), n):
                    if len(s):
                        ordered, counts = _ordered(s, shared.value)
                        ends = [0, *np.searchsorted(counts, cuts, side="right").tolist(), len(ordered)]
                        name = set_id(s)
                        for f, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                            if a < b:
                                sids.append(name)
                                numbers.append(f)
                                grams.append(np.sort(ordered[a:b]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(numbers, pa.int32()), pa.array(grams, pa.binary())], schema=_PARTS)

    return rows


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared n-grams of each pair's two fragments; a missing one is empty."""
    for b in batches:
        out = np.zeros(b.num_rows, dtype=np.int32)
        for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
            if x.is_valid and y.is_valid:
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                out[i] = (y[np.minimum(at, len(y) - 1)] == x).sum()
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("a", "b", "n_a", "n_b", "fragment", "own_a", "own_b")], pa.array(out)], names=["a", "b", "n_a", "n_b", "fragment", "own_a", "own_b", "shared"])


def _only(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parts of these nodes (and a few others), so that the rest isn't shuffled."""
    some = parts.sparkSession.sparkContext.broadcast(Some.of(nodes))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(some.value.may_hold(b.column("node").to_numpy())))

    return mapped(parts, rows, parts.schema)


def _counted(pairs: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    """a, b, n_a, n_b, shared, own_a, own_b: overlaps summed over the fragments in parts, each counted once even if parts repeats it."""
    left = parts.select(F.col("node").alias("p_a"), "fragment", F.col("grams").alias("x"))
    right = parts.select(F.col("node").alias("p_b"), F.col("fragment").alias("f"), F.col("grams").alias("y"))
    met = pairs.join(left, F.col("a") == F.col("p_a"), how).join(right, (F.col("b") == F.col("p_b")) & (F.col("fragment") == F.col("f")), how)
    size = lambda c: F.coalesce(F.octet_length(c) / 8, F.lit(0)).cast("int")
    met = met.select("a", "b", "n_a", "n_b", F.coalesce("fragment", F.lit(0)).alias("fragment"), size("x").alias("own_a"), size("y").alias("own_b"), "x", "y")
    counts = mapped(met, _overlaps, "a long, b long, n_a int, n_b int, fragment int, own_a int, own_b int, shared int")
    each = counts.groupBy("a", "b", "n_a", "n_b", "fragment").agg(*[F.max(c).alias(c) for c in ("shared", "own_a", "own_b")])
    return each.groupBy("a", "b", "n_a", "n_b").agg(*[F.sum(c).alias(c) for c in ("shared", "own_a", "own_b")])


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, n_a, n_b) of nodes and set sizes, those whose Jaccard similarity is at least percent / 100.

    The fragment of the rarest n-grams is counted first: pairs that can't reach the threshold even if they share all
    the rest end there. Then the other fragments are counted, and the counts summed.
    """
    pairs = staged(pairs, "pairs")
    reaches = lambda shared: (100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))
    ends = lambda df: df.select("a").union(df.select("b"))
    rare = _counted(pairs, _only(parts.filter("fragment = 0"), ends(pairs)), "left")
    rare = staged(rare.filter(reaches(F.col("shared") + F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b")))), "rare")
    discard(pairs)
    release(pairs.sparkSession)
    rest = _counted(rare.select("a", "b", "n_a", "n_b"), _only(parts.filter("fragment > 0"), ends(rare)), "inner")
    both = rare.select("a", "b", "n_a", "n_b", "shared").union(rest.select("a", "b", "n_a", "n_b", "shared"))
    found = staged(both.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared")).filter(reaches(F.col("shared"))).select("a", "b"), "links")
    discard(rare)
    return found


def _may_link(n_a: Column, at_a: Column, n_b: Column, at_b: Column, percent: int) -> Column:
    """Whether what is left from a shared n-gram on can make the overlap that the sizes ask for. True of a link's first shared one."""
    return (100 + percent) * F.least(n_a - at_a, n_b - at_b) >= percent * (n_a + n_b)


def _hopeful(postings: DataFrame, percent: int) -> DataFrame:
    """Postings without those that no other of the bucket can link with: sizes differ by less than percent / 100, and enough is left of both sets."""
    reach = math.ceil(-math.log(percent / 100) * 1e6) + 2
    near = Window.partitionBy("gram").orderBy(F.floor(F.ln("n") * 1e6)).rangeBetween(-reach, reach)
    left = F.col("n") - F.col("at")
    found = postings.withColumn("others", F.count("*").over(near)).withColumn("left", F.max(left).over(near)).withColumn("least", F.min("n").over(near))
    ok = (F.col("others") > 1) & ((100 + percent) * (F.least(left, F.col("left")) + (SHARED - 1)) >= percent * (F.col("n") + F.col("least")))
    return found.filter(ok).drop("others", "left", "least")


def _enough(postings: DataFrame, percent: int) -> DataFrame:
    """Postings of nodes that still have as many as a link's sets share."""
    own = postings.withColumn("own", F.count("*").over(Window.partitionBy("node")))
    return own.filter(F.col("own") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))).drop("own")


def _partners(now: DataFrame, percent: int) -> DataFrame:
    """Each node with one partner: the one that leads most of its buckets; ties go by an order common to all. The lead column holds them."""
    ok = (F.col("node") != F.col("lead.node")) & _may_link(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"), percent)
    led = now.filter(ok).groupBy("node", "n", F.col("lead.node").alias("l_node"), F.col("lead.n").alias("l_n")).agg(F.count("*").alias("buckets"))
    chosen = led.groupBy("node", "n").agg(F.max(F.struct("buckets", F.xxhash64("l_node").alias("h"), F.col("l_node").alias("node"), F.col("l_n").alias("n"))).alias("l"))
    return chosen.select(F.col("node").alias("a"), F.col("l.node").alias("b"), F.col("n").alias("n_a"), F.col("l.n").alias("n_b"))


def _left_over(now: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs across groups, from buckets of fewer than HOT sets."""
    side = lambda x: now.select(F.col("gram").alias(f"gram_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "at", "root")])
    met = side("a").join(side("b"), (F.col("gram_a") == F.col("gram_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _may_link(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), percent))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").distinct()


def _matches(own: list[np.ndarray], n: np.ndarray, rows: np.ndarray, columns: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets `rows` link with which of the sets `columns`: own holds all sets' n-grams, n their sizes."""
    owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
    gram, holders = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)[1:]
    kind = np.float32 if n.max() < 1 << 24 else np.float64  # whole numbers below this are exact
    shared = np.zeros((len(rows), len(columns)), dtype=kind)
    place = lambda some: np.where(np.isin(np.arange(len(own)), some), np.searchsorted(some, np.arange(len(own))), -1)
    at_row, at_column = place(rows), place(columns)
    often = np.flatnonzero(holders >= DENSE)
    for k in range(0, len(often), DENSE_GRAMS):
        column = np.full(len(holders), -1)
        column[often[k : k + DENSE_GRAMS]] = np.arange(len(often[k : k + DENSE_GRAMS]))
        a, b = np.zeros((len(rows), DENSE_GRAMS), kind), np.zeros((len(columns), DENSE_GRAMS), kind)
        for table, at in ((a, at_row), (b, at_column)):
            ok = (column[gram] >= 0) & (at[owner] >= 0)
            table[at[owner[ok]], column[gram[ok]]] = 1
        shared += a @ b.T
    rare = (holders >= 2) & (holders < DENSE)
    right = np.flatnonzero(rare[gram] & (at_column[owner] >= 0))
    right = right[np.argsort(gram[right], kind="stable")]
    begin = np.searchsorted(gram[right], np.arange(len(holders) + 1))
    left = np.flatnonzero(rare[gram] & (at_row[owner] >= 0))
    size = begin[gram[left] + 1] - begin[gram[left]]
    left, size = left[size > 0], size[size > 0]
    cut = np.searchsorted(np.cumsum(size), np.arange(LOOKUP, size.sum() + LOOKUP, LOOKUP), side="right")
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(left)], strict=True):
        if i < j:
            k = size[i:j]
            other = right[np.repeat(begin[gram[left[i:j]]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            np.add.at(shared, (np.repeat(at_row[owner[left[i:j]]], k), at_column[owner[other]]), 1)
    return (100 + percent) * shared.astype(np.float64) >= percent * (n[rows][:, None] + n[columns][None, :]).astype(np.float64)


def _meeting(links, empty: pa.Schema):
    """For a cell, in which one or two blocks of a group meet: what links() makes of its distinct nodes, sizes, weights, two sides and which of them link."""

    def met(key, t):
        one = key[1].as_py() == key[2].as_py()
        nodes, first, at = np.unique(t.column("node").to_numpy(), return_index=True, return_inverse=True)
        n, held, block = (t.column(c).to_numpy()[first] for c in ("n", "held", "block"))
        rows, columns = (np.arange(len(nodes)),) * 2 if one else (np.flatnonzero(block == key[k].as_py()) for k in (1, 2))
        if not len(rows) or not len(columns):
            return empty.empty_table()
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("grams")]
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(nodes) + 1))
        own = [np.concatenate([own[k] for k in order[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return links(nodes, held, rows, columns, own, n, one)

    return met


_COUNTS = pa.schema([("node", pa.int64()), ("links", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _counting(percent: int):
    """Each set's number of documents that it links with across a cell."""

    def links(nodes, held, rows, columns, own, n, one):
        ok = _matches(own, n, rows, columns, percent)
        if one:
            np.fill_diagonal(ok, False)
        found = np.zeros(len(nodes), dtype=np.int64)
        found[rows] += ok @ held[columns]
        if not one:
            found[columns] += held[rows] @ ok
        return pa.table([pa.array(nodes[found > 0]), pa.array(found[found > 0])], schema=_COUNTS)

    return _meeting(links, _COUNTS)


def _spanning(percent: int):
    """Links of a cell that connect whatever its links connect, at most one a set: each set of a layer's links to the set that reached it."""

    def links(nodes, held, rows, columns, own, n, one):
        ok = _matches(own, n, rows, columns, percent)
        edges, new_rows, new_columns = [], np.ones(len(rows), dtype=bool), np.ones(len(columns), dtype=bool)
        # In a cell of one block with itself each set is a row and a column, which link with each other, so both sides meet again.
        for start in range(len(rows)):
            if not new_rows[start]:
                continue
            new_rows[start] = False
            layer = np.array([start])
            while len(layer):
                hit = ok[layer].any(0) & new_columns
                to = np.flatnonzero(hit)
                edges.append((rows[layer[ok[layer][:, to].argmax(0)]], columns[to]))
                new_columns[to] = False
                back = np.flatnonzero(ok[:, to].any(1) & new_rows) if len(to) else to
                if len(back):
                    edges.append((rows[back], columns[to[ok[back][:, to].argmax(1)]]))
                new_rows[back] = False
                layer = back
        a, b = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
        real = a != b
        return pa.table([pa.array(nodes[a[real]]), pa.array(nodes[b[real]])], schema=_EDGES)

    return _meeting(links, _EDGES)


def _cells(members: DataFrame, parts: DataFrame, percent: int):
    """Members (root, node, n, held) dealt into cells, in each of which one or two blocks of a group meet, with their n-grams.

    Blocks are of one band of sizes, and only those of the same or the next band meet: others can't link.
    """
    width = -math.log(percent / 100) + 1e-9
    members = staged(members.withColumn("band", F.floor(F.ln("n") / width).cast("int")), "members")
    blocks = staged(members.groupBy(F.col("root").alias("b_root"), F.col("band").alias("b_band")).agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")), "blocks")
    same = (F.col("root") == F.col("b_root")) & (F.col("band") == F.col("b_band"))
    placed = members.join(blocks, same).withColumn("block", F.col("band").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).drop("b_root", "b_band", "blocks")
    other = (F.col("root") == F.col("b_root")) & (F.abs(F.col("band") - F.col("b_band")) <= 1)
    each = _only(parts, members.select("node")).dropDuplicates(["node", "fragment"]).select(F.col("node").alias("p_node"), "grams")
    dealt = placed.join(blocks, other).withColumn("turn", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("other", F.col("b_band").cast("long") * F.lit(1 << 32) + F.col("turn"))
    cells = dealt.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", F.col("n").cast("long").alias("n"), "held", "block")
    return cells.join(each, F.col("node") == F.col("p_node")).drop("p_node").groupBy("root", "lo", "hi"), (members, blocks)


def _links_within(roots: DataFrame, parts: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """node, links: for each set (node, n, held) of a group, the number of documents with another set that it links with. Written."""
    members = roots.select(F.col("node").alias("r_node"), "root").join(held, F.col("r_node") == F.col("node")).drop("r_node")
    cells, used = _cells(members, parts, percent)
    found = staged(cells.applyInArrow(_counting(percent), "node long, links long").groupBy("node").agg(F.sum("links").alias("links")), "within")
    discard(*used)
    return found


def _family_links(hot: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """a, b: links between sets that share a hot n-gram of their prefixes, enough of them to connect what all of them connect. Written.

    hot: node, n, lead (one node of the n-gram's). Sets connected by hot n-grams make a family, which is compared as a whole.
    """
    families = components(hot.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    sizes = hot.groupBy("node").agg(F.max("n").alias("n"))
    members = families.select(F.col("node").alias("f_node"), "root").join(sizes, F.col("f_node") == F.col("node")).select("root", "node", "n", F.lit(1).cast("long").alias("held"))
    cells, used = _cells(members, parts, percent)
    found = staged(cells.applyInArrow(_spanning(percent), "a long, b long").distinct(), "links")
    discard(*used)
    return found


def groups(docs: DataFrame, words: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, one row a document.

    A document's set holds its distinct n-grams of `words` lower-cased words (with fewer words, all of them as one).
    Two documents link when intersection * 100 >= union * percent; component_id is the smallest doc_id reachable by
    links. A null text, or one without words, has no n-grams and is linked with nothing; repeated rows link with each
    other; a null doc_id is never a component's id (it is null if there is no other). An empty table gives no rows;
    other columns are ignored.
    """
    return _grouped(docs, words, percent, doc_id, text, False)


def join(docs: DataFrame, words: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """groups() and n_links: how many other documents (rows) each one links with, those of equal sets included; every link counts, within groups too."""
    return _grouped(docs, words, percent, doc_id, text, True)


def text_key(text: Column) -> Column:
    """Tells different texts apart, a null one too."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("none"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (text_key): the rows that stay, one of each group, and those that link with nothing.

    A group's row of smallest doc_id stays; one with a null doc_id only if the group has no other; of rows that share an
    id, that of the smallest key. Rows of equal id and text are one. A text without words is no one's copy.
    """
    member = _grouped(docs, words, percent, doc_id, text, False, True)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = member.filter("whole").groupBy("root").agg(F.min(first).alias("f")).select("f.doc_id", "f.key")
    return kept.union(member.filter("NOT whole").select("doc_id", "key").distinct())


def _grouped(docs: DataFrame, words: int, percent: int, doc_id: str, text: str, count: bool, members: bool = False) -> DataFrame:
    spark = docs.sparkSession
    docs = picked(docs, doc_id=doc_id, text=text)
    keyed = docs.withColumn("key", text_key(F.col("text")) if members else F.lit(None).cast("string"))
    sets = staged(mapped(keyed, _sets(words), "doc_id long, key string, n long, sid binary, cells int, counts binary"), "sets")
    own = sets.filter(F.col("cells").isNull()).select("doc_id", "key", "n", "sid")
    sketch = _sketch(sets)
    shared = spark.sparkContext.broadcast(sketch)
    node = _node(own)
    own = own.withColumn("node", node)

    prefixes = mapped(docs, _prefixes(words, percent, shared), "sid binary, n long, grams array<long>, often array<boolean>").select(node.alias("node"), F.col("n").cast("int").alias("n"), "grams", "often").groupBy("node", "n").agg(F.first("grams").alias("grams"), F.first("often").alias("often"))
    postings = staged(prefixes.select("node", "n", F.posexplode(F.arrays_zip("grams", "often")).alias("at", "x")).select("node", "n", "at", F.col("x.grams").alias("gram"), F.col("x.often").alias("often")), "postings")
    release(spark)
    bucket = Window.partitionBy("gram")
    # Those that the sketch lets pass are counted; Spark broadcasts the few hot ones only if the written table is small.
    led = staged(postings.filter("often").groupBy(F.col("gram").alias("h_gram")).agg(F.count("*").alias("sets"), F.min_by("node", F.struct(F.xxhash64("node"), "node")).alias("h_lead")).filter(F.col("sets") >= HOT).drop("sets"), "hot")
    any_hot = not led.isEmpty()
    if any_hot:
        marked = postings.filter("often").join(led, F.col("gram") == F.col("h_gram"), "left").select("node", "n", "at", "gram", "h_lead")
        marked = marked.unionByName(postings.filter("NOT often").select("node", "n", "at", "gram", F.lit(None).cast("long").alias("h_lead")))
    else:
        marked = postings.select("node", "n", "at", "gram", F.lit(None).cast("long").alias("h_lead"))
    few = _hopeful(marked.filter("h_lead IS NULL"), percent)
    kept = _enough(few.unionByName(marked.filter("h_lead IS NOT NULL")) if any_hot else few, percent)
    kept = staged(kept, "open")
    release(spark)
    hot = kept.filter("h_lead IS NOT NULL").select("node", "n", F.col("h_lead").alias("lead"))
    # The set that has the n-gram earliest leads its bucket.
    open_ = staged(_hopeful(kept.filter("h_lead IS NULL").drop("h_lead"), percent).withColumn("lead", F.min(F.struct("at", "node", "n")).over(bucket)), "buckets")
    discard(postings, led)
    roots = within = None
    held = own.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("held"))
    if not kept.isEmpty():
        # The sets to be compared, in fragments of the global order of about equal weight.
        ranked = np.sort(sketch[sketch > 0])
        weight = np.cumsum(ranked, dtype=np.float64)
        cuts = np.unique(ranked[np.searchsorted(weight, weight[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)])
        holders = own.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("one"))
        holders = holders.join(kept.select("node").distinct(), "node", "left_semi")
        wanted = spark.sparkContext.broadcast(Some.of(holders.select("one").filter("one IS NOT NULL")))
        parts = mapped(docs, _fragments(words, shared, cuts, wanted), "sid binary, fragment int, grams binary").select(node.alias("node"), "fragment", "grams")
        parts = staged(parts, "fragments")
        links = linked(_partners(open_, percent), parts, percent)
        if any_hot:
            links = links.union(_family_links(hot, parts, percent))
        roots = components(links)
        release(spark)
        r = roots.select(F.col("node").alias("r_node"), "root")
        now = open_.drop("lead").join(r, F.col("node") == F.col("r_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("r_node")
        # Buckets whose sets are in one group have nothing left to say.
        now = staged(now.withColumn("lo", F.min("root").over(bucket)).withColumn("hi", F.max("root").over(bucket)).filter(F.col("lo") != F.col("hi")).drop("lo", "hi"), "open")
        fresh = linked(_left_over(now, percent), parts, percent)
        if not fresh.isEmpty():
            discard(roots)
            roots = components(links.union(fresh))
        release(spark)
        if count:
            within = _links_within(roots, parts, held, percent)
            release(spark)
        discard(now, parts)
    discard(kept, open_)
    member = own.withColumn("whole", F.col("n") > 0)
    if roots is not None:
        member = member.join(roots.select(F.col("node").alias("r_node"), "root"), F.col("node") == F.col("r_node"), "left")
        member = member.withColumn("root", F.when(F.col("whole"), F.coalesce("root", "node")))
    else:
        member = member.withColumn("root", F.when(F.col("whole"), F.col("node")))
    if members:
        return member.select("doc_id", "key", "whole", "root")
    # Written first, so that the join below is one of two shuffled tables, whose large partitions Spark can split.
    least = staged(member.filter("whole").groupBy("root").agg(F.min("doc_id").alias("least")).select(F.col("root").alias("r"), "least"), "least")
    out = member.join(least, F.col("root") == F.col("r"), "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("whole"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")]
    if count:
        equal = held.select(F.col("node").alias("h_node"), (F.col("held") - 1).alias("equal"))
        if within is not None:
            equal = equal.join(within.select(F.col("node").alias("w_node"), "links"), F.col("h_node") == F.col("w_node"), "left").select("h_node", (F.col("equal") + F.coalesce("links", F.lit(0))).alias("equal"))
        equal = staged(equal.filter("equal > 0"), "linked")
        out = out.join(equal, F.col("whole") & (F.col("node") == F.col("h_node")), "left")
        columns.append(F.coalesce("equal", F.lit(0)).alias("n_links"))
    return out.select(*columns)


#: Set ids of colliding hashes that a plan may name, at most; some ten are expected among 2e10 texts.
MOST_CLASHES = 10_000


def _hashed(sid: Column, seed: int) -> Column:
    return F.xxhash64(sid, F.lit(seed))


def _node(own: DataFrame, hashed=_hashed) -> Column:
    """A 64-bit number of a set from its 16-byte id, another for each id: a hash, and for the few ids whose hashes collide one under another seed.

    Of ids that share a number all but the smallest are hashed anew, and only those, until none do.
    """
    ids = own.select("sid").distinct()
    again: dict[bytes, int] = {}

    def node() -> Column:
        out = hashed(F.col("sid"), 0)
        for sid, seed in again.items():
            out = F.when(F.col("sid") == F.lit(sid), hashed(F.col("sid"), seed)).otherwise(out)
        return out

    while True:
        clashes = ids.groupBy(node().alias("node")).agg(F.count("*").alias("sids"), F.min("sid").alias("stays")).filter("sids > 1")
        met = ids.withColumn("own", node()).join(clashes, F.col("own") == F.col("node")).filter(F.col("sid") != F.col("stays")).select("sid") if not clashes.isEmpty() else None
        if met is None:
            return node()
        found = [bytes(r["sid"]) for r in met.limit(MOST_CLASHES + 1).collect()]
        if len(found) + len(again) > MOST_CLASHES:
            raise ValueError(f"over {MOST_CLASHES} set ids have colliding hashes")
        for sid in found:
            again[sid] = again.get(sid, 0) + 1


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), words=3, percent=90)
