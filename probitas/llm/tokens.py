"""Token ids as binary blocks: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

The most frequent token gets rank 0, so most ranks fit one byte. A rank takes 1 to 4 little-endian bytes; a control
byte holds the lengths of four ranks, two bits each, apart from the data bytes. Decoding looks the control bytes up
in tables of lengths and offsets, all in numpy.

Files are Parquet (so that any store which Spark reaches can hold them), one folder `shard=N` a range of doc_id in
ascending order, a row a block: block number, tokens before the block in its shard, doc_ids, token counts, control
and data bytes. The vocabulary's ranks are a table beside them.

Cases: a null text encodes as the empty one, to the end id alone. A null doc_id comes first. Rows of one doc_id are
ordered by a hash of their text. An empty table writes no block. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, bounded_batches, column, drop, save, scratch_path, texts_of

#: A block is closed at so many tokens; a document is never split.
BLOCK_TOKENS = 1 << 18
HEAD = "shard int, block int, before long, doc_ids array<long>, counts array<int>"
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack_ranks(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    wide = 2 if not len(values) or values.max() <= 0xFFFF else 4
    values = np.ascontiguousarray(values, f"<u{wide}")
    extra = (values > 0xFF).astype(np.uint8)
    if wide == 4:
        extra += (values > 0xFFFF).astype(np.uint8) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.stack([extra >= k for k in range(wide)], axis=1)
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, wide)[used].tobytes()


def unpack_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The integers again."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.nonzero(lengths > k)[0]
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class LibraryCoder:
    """The tokenizers library with one tokenizer file; it is given whole texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes of `kind`; equal texts are encoded once. Hand in a few MB at most."""
        distinct = list(dict.fromkeys(texts))
        found = self.tokenizer.encode_batch_fast([t.decode() for t in distinct], add_special_tokens=False)
        ids_of = {t: np.array(e.ids, self.kind).tobytes() for t, e in zip(distinct, found)}
        return [ids_of[t] for t in texts]


@lru_cache(maxsize=2)
def coder(path: str) -> LibraryCoder:
    return LibraryCoder(path)


def portions(texts: list[bytes], size: int = 1 << 20) -> list[slice]:
    """Slices of about `size` bytes, a text at least."""
    out, first, held = [], 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= size:
            out.append(slice(first, k + 1))
            first, held = k + 1, 0
    return [*out, slice(first, len(texts))] if first < len(texts) else out


def encode_blocks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of raw ids (column ids, 16 or 32 bits each), by ascending doc_id over the shards."""
    bounded_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        code = coder(path)
        kind = np.uint16 if max(code.size, end_id + 1) <= 1 << 16 else np.uint32
        wide = kind().itemsize
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        counts: list[int] = []
        held = 0
        end = np.array([end_id], kind).tobytes()

        def close() -> pa.RecordBatch:
            nonlocal block, before, held, ids, doc_ids, counts
            row = [[shard], [block], [before], [doc_ids], [counts], [b"".join(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["shard", "block", "before", "doc_ids", "counts", "ids"])
            block, before, held, ids, doc_ids, counts = block + 1, before + held, 0, [], [], []
            return made

        for batch in batches:
            texts, names = texts_of(batch), column(batch, "doc_id").to_pylist()
            for part in portions(texts):
                for name, got in zip(names[part], code.encode(texts[part])):
                    if code.kind is not kind:
                        got = np.frombuffer(got, code.kind).astype(kind).tobytes()
                    ids += [got, end]
                    n = len(got) // wide + 1
                    doc_ids.append(name)
                    counts.append(n)
                    held += n
                    if held >= BLOCK_TOKENS:
                        yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return rows.mapInArrow(run, f"{HEAD}, ids binary")


def frequency_ranks(blocks: DataFrame, path: str, end_id: int) -> np.ndarray:
    """Ids by descending count over all blocks (ties: the smaller id first); at most as many as the vocabulary has."""

    def run(batches: Batches) -> Batches:
        size = max(coder(path).size, end_id + 1)
        kind, total = np.uint16 if size <= 1 << 16 else np.uint32, np.zeros(size, np.int64)
        for batch in batches:
            for ids in column(batch, "ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["id", "n"])

    counts = blocks.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r[0] for r in counts.orderBy(F.desc("n"), "id").collect()], np.int64)


def write_token_files(docs: DataFrame, path: str, end_id: int, out: str) -> None:
    """Encodes docs with the tokenizer file at `path`, an end id after each, into `out`/blocks and `out`/vocabulary."""
    spark = docs.sparkSession
    raw = save(encode_blocks(docs, path, end_id), "token-ids")
    by_rank = frequency_ranks(raw, path, end_id)
    size = int(by_rank.max()) + 1 if len(by_rank) else 1
    rank_of = np.zeros(size, np.uint16 if size <= 1 << 16 else np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank_of)  # 4 bytes an id of the vocabulary

    def run(batches: Batches) -> Batches:
        table = ranks.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                counts, ids = column(one, "counts")[0].values.to_numpy(), column(one, "ids")[0].as_buffer()
                kind = np.uint16 if len(ids) == 2 * counts.sum(dtype=np.int64) else np.uint32
                control, data = pack_ranks(table[np.frombuffer(ids, kind)])
                yield pa.RecordBatch.from_arrays([*one.columns[:5], pa.array([control], pa.binary()), pa.array([data], pa.binary())], [*one.schema.names[:5], "control", "data"])

    blocks = raw.mapInArrow(run, f"{HEAD}, control binary, data binary")
    blocks.write.partitionBy("shard").parquet(f"{out}/blocks")
    drop(spark, raw.scratch)
    rows = [(k, int(i)) for k, i in enumerate(by_rank)]
    spark.createDataFrame(rows, "rank int, id int").coalesce(1).write.parquet(f"{out}/vocabulary")


def read_token_files(spark: SparkSession, out: str, tokens: bool = False) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, and, if asked for, the ids."""
    bounded_batches(spark)
    blocks = spark.read.schema(f"block int, before long, doc_ids array<long>, counts array<int>, control binary, data binary, shard int").parquet(f"{out}/blocks")
    by_rank = np.array([r[0] for r in spark.read.parquet(f"{out}/vocabulary").orderBy("rank").select("id").collect()], np.uint32)
    ids_of = spark.sparkContext.broadcast(by_rank)
    names = ["doc_id", "at", "n_tokens", "ids_crc32", "shard"] + ["ids"] * tokens

    def run(batches: Batches) -> Batches:
        table = ids_of.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                doc_ids, counts = column(one, "doc_ids")[0].values, column(one, "counts")[0].values.to_numpy().astype(np.int64)
                ids = table[unpack_ranks(column(one, "control")[0].as_py(), column(one, "data")[0].as_py(), int(counts.sum()))]
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                starts = ends - counts
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                before, shard = column(one, "before")[0].as_py(), column(one, "shard")[0].as_py()
                made = [doc_ids, pa.array(starts + before), pa.array(counts), pa.array(sums, pa.int64()), pa.array([shard] * len(counts), pa.int32())]
                if tokens:
                    made.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(made, names)

    rows = blocks.mapInArrow(run, "doc_id long, at long, n_tokens long, ids_crc32 long, shard int" + ", ids array<int>" * tokens)
    sizes = blocks.select("shard", F.expr("before + aggregate(counts, 0L, (a, c) -> a + c)").alias("n")).groupBy("shard").agg(F.max("n").alias("n"))
    first = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))  # a row a shard
    out_cols = ["doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * tokens
    return rows.join(F.broadcast(first), "shard").select(*out_cols)


def token_round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes docs as token files into the shared folder and returns what the files say."""
    spark = docs.sparkSession
    out = scratch_path(spark, "token-files")
    write_token_files(docs, path, end_id, out)
    return read_token_files(spark, out)
