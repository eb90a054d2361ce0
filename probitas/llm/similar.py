"""Near-duplicate groups of documents by similarity of their word shingles: SimHash, BK-trees in shards, exact sets.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles is at least `similarity`.

1. Documents of equal sets are represented by one. It has a 64-bit SimHash fingerprint, a sketch of 256 minima (two
   bits each; standard error 0.03 at 0.8) and sixteen bands of three minima.
2. Each band names a shard, so two documents of similarity 0.8 share one with a probability of 0.99999, and unrelated
   ones hardly ever. A shard's BK-tree has children keyed by the integer Hamming distance to the parent; a search follows
   only the edges within `radius`; what it finds is a candidate if the sketches are alike, less five standard errors. A
   shard gives a spanning star of each group of candidates, never its pairs.
3. Connected groups of candidates are linked by the exact similarity of their shingle sets, breadth first.

Nothing unbounded comes into one task. A shard of more than BLOCK documents is cut into blocks, and a task has two of
them; their stars together connect what the shard connects. A group of candidates of more than BLOCK_BYTES is first
compared with one of it, in blocks. Those within the similarity of that one are linked by it. As the Jaccard distance
is a metric, a document at distance d from it can only be linked to those at least d less the tolerated distance away,
so all but the rest and its possible neighbours are done; these then meet in pairs of blocks.

Cases: null and wordless texts have no shingle and count as equal; a text of fewer words than a shingle is one
shingle; rows of null doc_id can't be named and stay alone. Rows of one doc_id are one document, which is linked by the
texts of all of them, and stays or goes as one; those equal in text stay once. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, column, drop, save, texts_of
from .components import components
from .simhash import fingerprint, shingle_hashes, tree_links

MINIMA, ROWS, BANDS = 256, 3, 16
#: Standard error of the sketch at 0.8, and how many of them a candidate may lie below the similarity.
ERROR, MARGIN = 0.03, 5
#: Documents of a block of a shard; bytes of shingle hashes of a block of a group; hashes that are compared at once.
BLOCK, BLOCK_BYTES, AT_ONCE = 4096, 16 << 20, 1 << 21
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64(0x5555555555555555)


def sketch(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """64 bytes with two bits of each minimum, and the keys of the bands."""
    if not len(hashes):
        return bytes(MINIMA // 4), [0] * BANDS
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * _FACTORS).min(axis=0), out=least)
    two = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)).astype(np.uint8).reshape(-1, 4)
    packed = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    keys = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        keys = (keys ^ least[k : ROWS * BANDS : ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(31)
    return packed.astype(np.uint8).tobytes(), keys.view(np.int64).tolist()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the sketches (as eight 64-bit words) of a and of each row of b."""
    x = a ^ b
    equal = MINIMA - np.bitwise_count((x | x >> np.uint64(1)) & LOW).sum(axis=-1, dtype=np.int64)
    return (equal / MINIMA - 0.25) / 0.75


def group_links(ids: list[int], fps: np.ndarray, sketches: np.ndarray, radius: int, least: float) -> list[tuple[int, int]]:
    """Spanning stars (id, first id of its group) of the candidates of one shard."""
    found = tree_links(fps, radius, lambda i, near: estimate(sketches[i], sketches[near]) >= least)
    return [(ids[j], ids[start]) for j, start in found]


def alike(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of one sorted set with each of the others (none of which is empty, unless `one` is)."""
    sizes = np.array([len(o) for o in others])
    if not len(one):
        return (sizes == 0).astype(float)
    flat = np.concatenate(others)
    equal = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(equal, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both / (sizes + len(one) - both)


def exact_links(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """(id, smallest id of its group) of one group of candidates; an id of several rows joins their groups."""
    sizes, left, parent = np.array([len(s) for s in sets]), np.arange(len(sets)), {i: i for i in ids}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def portions(rows: np.ndarray) -> Iterator[np.ndarray]:
        return iter(np.split(rows, np.nonzero(np.diff(np.cumsum(sizes[rows]) // AT_ONCE))[0] + 1)) if len(rows) else iter(())

    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            fits = left[np.minimum(sizes[left], sizes[i]) >= least * np.maximum(sizes[left], sizes[i]) - 1e-9]
            found = [j for part in portions(fits) for j in part[alike(sets[i], [sets[j] for j in part]) >= least - 1e-9].tolist()]
            for j in found:
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
            if found:
                left = np.setdiff1d(left, found, assume_unique=True)
                front += found
    return [(i, root(i)) for i in parent if root(i) != i]


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, digest, size, fp, sketch, keys) of every named row: of its set of shingles."""
    bounded_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            digests, sizes, fps, sketches, keys = [], [], [], [], []
            for text in texts_of(batch):
                hashes = np.unique(shingle_hashes(text, shingle))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sizes.append(len(hashes))
                fps.append(fingerprint(hashes))
                packed, own = sketch(hashes)
                sketches.append(packed)
                keys.append(own)
            made = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *made], ["id", "digest", "size", "fp", "sketch", "keys"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return save(rows.mapInArrow(run, "id long, digest binary, size long, fp long, sketch binary, keys array<long>"), "similar")


def _in_blocks(rows: DataFrame, keys: list[str], hot: DataFrame, by: str) -> DataFrame:
    """rows with (i, j): (0, 0) for most; rows of a hot key (`hot`: keys, blocks) in all pairs of blocks with their own."""
    own = F.pmod(F.xxhash64(by), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(F.least(other, own).alias("i"), F.greatest(other, own).alias("j")))
    return rows.join(hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).select(*rows.columns, F.inline(pairs))


def _edges(rows: DataFrame, keys: list[str], values: list[str], link) -> DataFrame:
    """Edges (a, b) that `link`(lists of ids and of the values) gives for the rows of each key; ids are in column id."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "id")

    def run(batches: Batches) -> Batches:
        key, held = None, [[] for _ in range(1 + len(values))]

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[j] for e in found], pa.int64()) for j in (0, 1)], ["a", "b"])

        for batch in batches:
            found = []
            own = zip(*(column(batch, c).to_pylist() for c in keys))
            for at, row in zip(own, zip(*(column(batch, c).to_pylist() for c in ["id", *values]))):
                if at != key:
                    if len(held[0]) > 1:
                        found += link(*held)
                    key, held = at, [[] for _ in range(1 + len(values))]
                for part, value in zip(held, row):
                    part.append(value)
            yield out(found)
        yield out(link(*held) if len(held[0]) > 1 else [])

    return dealt.select(*keys, "id", *values).mapInArrow(run, "a long, b long")


def candidates(reps: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Edges (a, b) that span the groups of candidates."""
    least = similarity - MARGIN * ERROR
    shards = reps.select("id", "fp", "sketch", F.posexplode("keys").alias("band", "key"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    hot = save(shards.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("band", "key", blocks.alias("blocks")), "similar-hot")

    def link(ids: list[int], fps: list[int], sketches: list[bytes]) -> list[tuple[int, int]]:
        grid = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(ids), -1)
        return group_links(ids, np.array(fps, np.int64).view(np.uint64), grid, radius, least)

    keys = ["band", "key"]
    if not hot.isEmpty():
        shards, keys = _in_blocks(shards, keys, hot, "id"), [*keys, "i", "j"]
    return save(_edges(shards, keys, ["fp", "sketch"], link), "similar-links")


def exact(docs: DataFrame, groups: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, bool]:
    """Edges (a, b) that connect what exact similarity links within groups of candidates (node, root); whether they are
    stars already, from each document to the smallest of its group, as they are where no group is cut into blocks."""

    def hashed(batches: Batches) -> Batches:
        for batch in batches:
            found = [np.unique(shingle_hashes(t, shingle)) for t in texts_of(batch)]
            made = [pa.array([len(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([column(batch, "root"), column(batch, "id"), *made], ["root", "id", "size", "hashes"])

    def link(ids: list[int], raw: list[bytes]) -> list[tuple[int, int]]:
        return exact_links(ids, [np.frombuffer(r, np.uint64) for r in raw], similarity)

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text").join(groups.select(F.col("node").alias("id"), "root"), "id")
    sets = save(texts.select("root", "id", "text").mapInArrow(hashed, "root long, id long, size long, hashes binary"), "similar-sets")
    hot = save(_hot(sets), "similar-hot")  # empty but for groups of many or long texts
    if hot.isEmpty():
        return save(_edges(sets, ["root"], ["hashes"], link), "similar-exact"), True
    small = _edges(sets.join(hot, "root", "left_anti"), ["root"], ["hashes"], link)
    large = sets.join(hot.select("root"), "root", "left_semi")
    far = save(_from_first(large, hot), "similar-distances")  # of each to the one that names the group
    least = far.where(F.col("near") < similarity - 1e-9).groupBy("root").agg(F.min(1 - F.col("near")).alias("closest"))
    rest = far.join(least, "root").where((F.col("near") < similarity - 1e-9) | (1 - F.col("near") >= F.col("closest") - (1 - similarity) - 1e-6)).select("root", "id").distinct()
    open_sets = save(large.join(rest, ["root", "id"], "left_semi"), "similar-rest")
    pairs = _edges(_in_blocks(open_sets, ["root"], _hot(open_sets), "id"), ["root", "i", "j"], ["hashes"], link)
    by_first = far.where((F.col("near") >= similarity - 1e-9) & (F.col("id") != F.col("root"))).select(F.col("id").alias("a"), F.col("root").alias("b"))
    return small.unionByName(pairs).unionByName(by_first), False


def _hot(sets: DataFrame) -> DataFrame:
    """(root, blocks) of the groups over BLOCK_BYTES."""
    blocks = F.ceil(8 * F.sum("size") / BLOCK_BYTES).cast("long")
    return sets.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1")


def _from_first(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """(root, id, near): exact similarity of each set with one of the document that names its group, which goes to each block."""
    first = sets.where("id = root").groupBy("root").agg(F.min("hashes").alias("hashes")).join(hot, "root")
    first = first.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), F.col("root").alias("id"), "hashes", F.lit(0).alias("later"))
    rows = sets.join(hot, "root").select("root", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("i"), "id", "hashes", F.lit(1).alias("later"))
    dealt = first.unionByName(rows).repartition("root", "i").sortWithinPartitions("root", "i", "later")

    def run(batches: Batches) -> Batches:
        one = np.zeros(0, np.uint64)
        for batch in batches:
            roots, ids, near = [], [], []
            for root, i, later, raw in zip(*(column(batch, c).to_pylist() for c in ("root", "id", "later", "hashes"))):
                own = np.frombuffer(raw, np.uint64)
                if not later:
                    one = own
                    continue
                roots.append(root)
                ids.append(i)
                near.append(float(alike(one, [own])[0]) if len(own) else float(not len(one)))
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(ids, pa.int64()), pa.array(near, pa.float64())], ["root", "id", "near"])

    return dealt.select("root", "id", "later", "hashes").mapInArrow(run, "root long, id long, near double")


def gone_ids(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 24) -> tuple[DataFrame, DataFrame]:
    """(doc_id) of the documents that go, all but the smallest of each group; and of those that have several rows."""
    spark = docs.sparkSession
    rows = _described(docs, shingle)
    reps = save(rows.groupBy("digest").agg(F.min_by(F.struct("id", "fp", "sketch", "keys"), "id").alias("r")).select("digest", "r.*"), "similar-reps")
    several = save(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "similar-several")
    same = rows.select("id", "digest").join(several, "id", "left_semi").join(reps.select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b")
    groups = components(candidates(reps, similarity, radius))
    edges, stars = exact(docs, groups, shingle, similarity)
    linked = edges.toDF("node", "root") if stars and several.isEmpty() else components(edges.unionByName(same))
    copies = rows.select("id").join(several, "id", "left_anti").join(reps.select("id"), "id", "left_anti")
    gone = save(copies.unionByName(linked.where("node != root").select(F.col("node").alias("id"))).distinct(), "similar-gone")
    for done in (rows, reps):
        drop(spark, done.scratch)
    return gone.withColumnRenamed("id", "doc_id"), several.withColumnRenamed("id", "doc_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """The rows of docs that stay: of each group the document of smallest doc_id, and all rows of null doc_id."""
    gone, several = gone_ids(docs, shingle, similarity, radius)
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if several.isEmpty():
        return stay
    again = stay.join(several, "doc_id", "left_semi").withColumn("_text", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", "_text"])
    return stay.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
