"""Quality rules on repetition: characters inside duplicated n-grams and lines, found by rolling hashes in numpy.

Words are separated by ASCII white space. Each distinct word of a text gets a 64-bit mixed id; for every n-gram
length a polynomial hash rolls over the ids, and words in n-grams that occur twice or more are covered (the first
occurrence too). Coverage is the share of the text's word characters that covered words hold. A text is rejected by
the method when its coverage for any length, or the share of characters in duplicated lines, exceeds its limit. The
limits fall with the length and lie below the base rule on 3-grams (half of the words). Public rule sets allow 0.15, 0.13
and 0.10 of characters in later occurrences alone; as the first one counts here too, that is twice as much, and a text in
which one line stands twice is left alone.

Cases: null and empty texts have no words, zero measures, and fail the base rules (under 50 words). Texts of any
length are read whole. Repeated rows are judged each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, column, texts_of

#: Largest share of characters in duplicated n-grams, by n, and in lines equal to an earlier one.
NGRAM_LIMITS = {5: 0.30, 7: 0.26, 10: 0.20}
LINE_LIMIT = 0.20
SPACE, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
ROLL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * ROLL
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(keys: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in an n-gram whose key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(words + 1, np.int32)
    steps[: len(keys)] += twice[:-1]
    steps[n : n + len(keys)] -= twice[:-1]
    return np.cumsum(steps[:words]) > 0


def rolling(mixed: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of the n-grams, by doubling: hash(2k) = hash(k) * B**k + the next hash(k)."""
    count = len(mixed) - n + 1
    total, width, part, size = None, 0, mixed, 1
    while n:
        if n & 1:
            piece = part[width : width + count]
            total = piece.copy() if total is None else total * ROLL ** np.uint64(size) + piece
            width += size
        n >>= 1
        if n:
            part = part[: len(part) - size] * ROLL ** np.uint64(size) + part[size:]
            size *= 2
    return total


def measure(text: bytes, lengths: tuple[int, ...]) -> dict:
    """Counts and coverages of one text."""
    words = text.split()
    n = len(words)
    code_points = len(text) if text.isascii() else len(text.decode())
    out = {"n_words": n, "word_chars": code_points - (len(text) - len(text.translate(None, SPACE))), "n_symbols": len(text) - len(text.translate(None, SYMBOLS))}
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += len(line.translate(None, SPACE).decode())
        elif not line.isspace() and line:
            seen.add(line)
    chars = max(1, out["word_chars"])
    out |= {"n_dup_lines": dup_lines, "dup_line_share": dup_chars / chars, "n_repeat_words": 0}
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        base = len(number)
        if base < 1 << 21:
            triples = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
        else:
            pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
            triples = pairs[:-1] * base + ids[2:]
        out["n_repeat_words"] = int(_covered(triples, 3, n).sum())
    for size in lengths:
        share = 0.0
        if out["n_repeat_words"] and n > size:  # what no 3-gram repeats, no longer one does
            covered = _covered(rolling(_mixed(ids), size), size, n)
            if covered.any():
                width = np.fromiter(map(len, words) if text.isascii() else (len(w.decode()) for w in words), np.int64, n)
                share = int(width[covered].sum()) / chars
        out[f"dup_share_{size}"] = share
    return out


def quality(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Per row: doc_id, the counts, shares by n-gram length and of lines, base_failed, kept."""
    bounded_batches(docs.sparkSession)
    limits = dict(limits or NGRAM_LIMITS)
    lengths = tuple(limits)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["dup_line_share", *(f"dup_share_{n}" for n in lengths)]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = [measure(t, lengths) for t in texts_of(batch)]
            made = [pa.array([r[c] for r in rows], pa.int64()) for c in counts] + [pa.array([r[c] for r in rows], pa.float64()) for c in shares]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *made], ["doc_id", *counts, *shares])

    schema = "doc_id long, " + ", ".join([*(f"{c} long" for c in counts), *(f"{c} double" for c in shares)])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.col("dup_line_share") > line_limit
    for n, most in limits.items():
        rejected = rejected | (F.col(f"dup_share_{n}") > most)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~rejected)


def kept_rows(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of docs that are kept, all columns."""
    bounded_batches(docs.sparkSession)
    limits = dict(limits or NGRAM_LIMITS)

    def keeps(m: dict) -> bool:
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        return not failed and m["dup_line_share"] <= line_limit and all(m[f"dup_share_{n}"] <= most for n, most in limits.items())

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pa.array([keeps(measure(t, tuple(limits))) for t in texts_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
