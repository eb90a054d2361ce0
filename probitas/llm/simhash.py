"""SimHash fingerprints and near-duplicate groups, found by BK-trees over shards of the fingerprints.

A fingerprint has 64 bits; a bit is set where over half of the shingle hashes have it. Distinct fingerprints are
dealt into shards such that two fingerprints within the radius share a shard: for a radius of r, the 64 bits are cut
into r + 1 fields, and equal fields make a shard (two that differ in r bits agree in a field). A shard of more than
`tree_size` fingerprints is split in the same way by r + 1 fields of the bits that its fingerprints needn't share, again
and again, so every shard, however common its field, ends in trees of bounded size and no link is lost.

One BK-tree is built for each shard, children keyed by their integer Hamming distance to the parent; a search follows
only the edges within the radius. Trees go to the one task that asks them: broadcasting them all would grow with the
corpus. A tree emits a spanning star for each of its groups, never all pairs.

Cases: null and wordless texts have fingerprint zero and link like any other; a text shorter than a shingle is one
shingle; repeated rows give repeated results; rows of null doc_id have the component of their fingerprint, null if
nothing named is in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, column, join_hot, save, texts_of
from .components import components

SEED = 42


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 of the n-word shingles, repeats included; A-Z are lower-cased, ASCII white space separates words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """As an unsigned integer; zero for no hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[k] to begin[k] + count[k], one after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + count, count)


class BKTree:
    """Of distinct unsigned 64-bit integers under the Hamming distance, in arrays: built and searched level by level."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.values, self.edge = values, np.zeros(n, np.int64)
        parent = np.zeros(n, np.int64)
        items, at = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(items):  # all go down one edge; the first on an edge becomes its child
            d = np.bitwise_count(values[items] ^ values[at]).astype(np.int64)
            _, first, back = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            parent[items[first]], self.edge[items[first]] = at[first], d[first]
            at = items[first][back]
            items, at = items[items != at], at[items != at]
        self.children = 1 + np.argsort(parent[1:], kind="stable")
        self.first = np.searchsorted(parent[self.children], np.arange(n + 1))

    def within(self, value: np.uint64, radius: int) -> np.ndarray:
        """Nodes at most radius away."""
        found, now = [], np.zeros(min(1, len(self.values)), np.int64)
        while len(now):
            d = np.bitwise_count(self.values[now] ^ value).astype(np.int64)
            found.append(now[d <= radius])
            begin, count = self.first[now], self.first[now + 1] - self.first[now]
            kids = self.children[_ranges(begin, count)]
            now = kids[np.abs(self.edge[kids] - np.repeat(d, count)) <= radius]
        return np.concatenate(found) if found else now


def tree_links(fps: np.ndarray, radius: int, close: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """(place, first place of its group) of the places in fps that others reach, by BK-tree.

    Groups are walked breadth first: each place asks the tree for those not yet reached. `close` says which of the
    places within the radius count. Once half of a tree is reached, the rest is put into a new one.
    """
    if len(fps) == 2 and close is None:
        return [(1, 0)] if int(np.bitwise_count(fps[0] ^ fps[1])) <= radius else []
    out, alive, left = [], np.ones(len(fps), bool), len(fps)

    def plant() -> tuple[BKTree, np.ndarray, np.ndarray, int]:
        places = np.nonzero(alive)[0]
        values, of = np.unique(fps[places], return_inverse=True)
        order = np.argsort(of, kind="stable")
        return BKTree(values), places[order], np.searchsorted(of[order], np.arange(len(values) + 1)), len(places)

    tree, places, first, held = plant()
    for start in range(len(fps)):
        if not alive[start]:
            continue
        alive[start], left, front = False, left - 1, [start]
        while front and left:
            i = front.pop()
            nodes = tree.within(fps[i], radius)
            near = places[_ranges(first[nodes], first[nodes + 1] - first[nodes])]
            near = near[alive[near]]
            if close is not None and len(near):
                near = near[close(i, near)]
            alive[near] = False
            left -= len(near)
            front += near.tolist()
            out += [(j, start) for j in near.tolist()]
            if left < held // 2 and held > 64:
                tree, places, first, held = plant()
    return out


def fields(mask: int, radius: int) -> list[int]:
    """Masks that fix, beside the bits of `mask`, one of radius + 1 parts of the others; none if there are too few."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= radius:
        return []
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(distinct: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """(mask, part, fp): each fingerprint in all its shards, of at most tree_size fingerprints each."""
    spark = distinct.sparkSession

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        return rows.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")

    masks, out = fields(0, radius), None
    rows = dealt(distinct, masks)
    while True:
        final = [m for m in masks if not fields(m, radius)]
        large = rows.groupBy("mask", "part").agg(F.count("*").alias("n")).where(F.col("n") > tree_size).where(~F.col("mask").isin(*map(_signed, final)) if final else F.lit(True))
        large = save(large.select("mask", "part"), "simhash-large")
        none = large.isEmpty()
        small = rows if none else rows.join(large, ["mask", "part"], "left_anti")
        out = small if out is None else out.unionByName(small)
        if none:
            return out
        hot = save(rows.join(large, ["mask", "part"], "left_semi").select("fp", "mask"), "simhash-hot")
        split = [m for m in masks if fields(m, radius)]
        inner = spark.createDataFrame([(_signed(m), [_signed(k) for k in fields(m, radius)]) for m in split], "mask long, inner array<long>")  # (radius + 1) ** level rows
        rows = hot.join(F.broadcast(inner), "mask").select("fp", F.explode("inner").alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp").distinct()
        masks = sorted({k for m in split for k in fields(m, radius)})


def links(distinct: DataFrame, radius: int = 2, tree_size: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all that lie within the radius of each other."""
    bounded_batches(distinct.sparkSession)
    dealt = shards(distinct, radius, tree_size).repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")

    def run(batches: Batches) -> Batches:
        held, key = [], None  # the shard that may go on in the next batch

        def edges(fps: np.ndarray) -> list[tuple[int, int]]:
            return [(fps[a], fps[b]) for a, b in tree_links(fps, radius)] if len(fps) > 1 else []

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.array([e[j] for e in found], np.uint64).view(np.int64)) for j in (0, 1)], ["a", "b"])

        for batch in batches:
            masks, parts, fps = (np.asarray(column(batch, c)) for c in ("mask", "part", "fp"))
            if not len(fps):
                continue
            cuts = np.nonzero((masks[1:] != masks[:-1]) | (parts[1:] != parts[:-1]))[0] + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)]):
                own = (masks[a], parts[a])
                if own != key:
                    if held and sum(map(len, held)) > 1:
                        found += edges(np.concatenate(held))
                    held, key = [], own
                held.append(fps[a:b].view(np.uint64))
            yield rows(found)
        if held:
            yield rows(edges(np.concatenate(held)))

    return save(dealt.mapInArrow(run, "a long, b long"), "simhash-links")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, tree_size: int = 4096) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest doc_id reachable over links within the radius)."""
    marked = save(fingerprints(docs, shingle), "simhash")
    distinct = save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    groups = save(components(links(distinct.select("fp"), radius, tree_size)).withColumnRenamed("node", "fp"), "simhash-groups")
    of_root = groups.join(distinct, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = distinct.join(join_hot(groups, of_root, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return join_hot(marked, save(of_fp, "simhash-of"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """16 lowercase hexadecimal digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
