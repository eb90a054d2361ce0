"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment scores them.

A document holds an item if some passage of it aligns with the item word by word (local alignment: +1 equal, -1
different, -1 gap) with at least `cut` of the item's length, and at least LEAST words or the whole of a shorter item.
The score is that alignment divided by the item's length: 1 for a whole copy, lower the more is edited or left out.

Nothing that reaches the cut is missed. An alignment of m matches and e errors scores m - e and its matches stand in at
most e + 1 runs, so at least score - 1 of the item's two-word grams are whole in the passage. Hence:

1. A scan counts in how many documents each two-word gram of the items stands.
2. Of an item's L - 1 grams the L - need + 1 rarest are its seeds (need: the least score): every passage that reaches the
   cut has one of them, however common they are. No gram is dropped for being common; rarity only chooses.
3. A second scan takes the items whose seeds a text holds. Where need - 1 of the item's grams stand close enough
   together, the passage around them is aligned with the item, equal passages of a batch once.

Items are held in slices of bounded bytes (words and grams of a slice are broadcast); a larger benchmark takes two scans
of the corpus for each slice. Words are runs of letters, digits and underscores, lower-cased.

Cases: null and empty texts, and items without a word, match nothing. An empty corpus or benchmark gives no rows.
Repeated items count once; repeated doc_ids are one document whose best score counts. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, column, save, texts_of

#: Score from which a document counts as contaminated, words that must match at least; bytes of items in a slice.
CUT, LEAST, SLICE_BYTES = 0.5, 5, 32 << 20
#: Words of passages that wait for their alignment, that are aligned at once, and of a passage (longer ones are cut, with an overlap).
WAITING, AT_ONCE, LONGEST = 1 << 20, 1 << 19, 1 << 16
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def least_score(length: int, cut: float = CUT) -> int:
    """Matches less errors that an item of so many words must reach."""
    return max(int(np.ceil(cut * length - 1e-9)), min(length, LEAST), 1)


class Items:
    """A slice of the benchmark: words as numbers, two-word grams as sorted codes, and each item's grams and seeds."""

    def __init__(self, rows: list[tuple[int | None, str]], cut: float = CUT) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in rows:
            if words := words_of(text or ""):
                self.ids.append(item)
                self.words.append(np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64))
        self.need = [least_score(len(w), cut) for w in self.words]
        #: By item, the code of the gram that begins at each word; an item of one word has that word's own code.
        codes = [self.codes(w) if len(w) > 1 else -1 - w for w in self.words]
        self.grams = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]))
        self.of_item = [np.searchsorted(self.grams, c) for c in codes]
        self.choose(np.zeros(len(self.grams), np.int64))

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Of each two consecutive words; that of an unknown word is nobody's."""
        size = len(self.number)
        return np.where((words[:-1] >= 0) & (words[1:] >= 0), words[:-1] * size + words[1:], np.int64(size) * size)

    def choose(self, counts: np.ndarray) -> None:
        """Takes each item's rarest grams, by these counts, as its seeds."""
        seeds = [np.unique(own[np.argsort(counts[own], kind="stable")[: max(1, len(self.words[k]) - self.need[k] + 1)]]) for k, own in enumerate(self.of_item)]
        gram = np.concatenate([*seeds, np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.argsort(gram, kind="stable")
        #: Items of gram g: items[first[g] : first[g + 1]].
        self.items, self.first = item[order], np.searchsorted(gram[order], np.arange(len(self.grams) + 1))

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of a text (-1: no item's), the places where some item's gram begins, and which gram it is."""
        words = words_of(text)
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        known = np.nonzero(ids >= 0)[0]
        if not len(known) or not len(self.grams):
            return ids, known[:0], known[:0]
        codes = np.append(self.codes(ids), np.int64(len(self.number)) ** 2)
        places, codes = (known, codes[known]) if self.grams[0] >= 0 else (np.concatenate([known, known]), np.concatenate([codes[known], -1 - ids[known]]))
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        hit = self.grams[at] == codes
        return ids, places[hit], at[hit]

    def passages(self, text: str) -> list[tuple[int, np.ndarray]]:
        """(item, words as the item's numbers, -1 for others) of all passages that may reach the item's least score."""
        ids, places, grams = self.found(text)
        here = np.unique(grams)
        if not len(here):
            return []
        out = []
        for k in np.unique(np.concatenate([self.items[a:b] for a, b in zip(self.first[here], self.first[here + 1])])).tolist():
            length, need = len(self.words[k]), self.need[k]
            own = places[np.isin(grams, self.of_item[k])]
            least = max(1, need - 1)
            if len(own) < least:
                continue
            reach = 2 * length - need  # words of the text that an alignment takes at most
            begin, end = own[: len(own) - least + 1], own[least - 1 :]
            close = end - begin <= reach
            if not close.any():
                continue
            begin, end = np.maximum(end[close] - reach, 0), np.minimum(begin[close] + reach + 2, len(ids))
            cuts = np.nonzero(begin[1:] > end[:-1])[0]  # both ascend
            for a, b in zip(begin[np.append(0, cuts + 1)].tolist(), end[np.append(cuts, len(end) - 1)].tolist()):
                step = max(LONGEST, 4 * reach)
                for start in range(a, max(a + 1, b - reach), step - reach):
                    part = ids[start : min(b, start + step)]
                    out.append((k, np.where(np.isin(part, self.words[k]), part, -1)))
        return out


def align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment of the item's words with each row of windows (padded with -2)."""
    rows, width = windows.shape
    slope = np.arange(1, width + 1, dtype=np.int32)
    best, above = np.zeros(rows, np.int32), np.zeros((rows, width + 1), np.int32)
    for word in item:
        now = np.maximum(above[:, :-1] + np.where(windows == word, 1, -1), above[:, 1:] - 1)
        now = np.maximum(now, 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # a gap costs one a word
        above[:, 1:] = now
        np.maximum(best, now.max(axis=1), out=best)
    return best


@lru_cache(maxsize=1)
def _held(shared) -> Items:
    """The items of a broadcast, made once a worker process."""
    rows, cut, counts = shared.value
    items = Items(rows, cut)
    if counts is not None:
        items.choose(counts)
    return items


def contaminated(docs: DataFrame, benchmark: DataFrame, cut: float = CUT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, score) for every document and item whose score reaches the cut."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for seeded in _slices(docs, benchmark, cut, slice_bytes):

        def score(batches: Batches, seeded=seeded) -> Batches:
            items, waiting, size = _held(seeded), {}, 0
            for batch in batches:
                for name, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch)):
                    size += _wait(items, waiting, name, text)
                    if size >= WAITING:
                        yield _rows(*_scored(items, waiting))
                        waiting, size = {}, 0
            yield _rows(*_scored(items, waiting))

        out = out.unionByName(texts.mapInArrow(score, "doc_id long, item_id long, score double").groupBy("doc_id", "item_id").agg(F.max("score").alias("score")))
    return out


def kept_rows(docs: DataFrame, benchmark: DataFrame, cut: float = CUT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs whose text holds no item, all columns; each row is judged by itself, so nothing is joined."""
    out = docs
    for seeded in _slices(docs, benchmark, cut, slice_bytes):

        def keep(batches: Batches, seeded=seeded) -> Batches:
            items = _held(seeded)
            for batch in batches:
                waiting, size, bad = {}, 0, np.zeros(batch.num_rows, bool)
                for row, text in enumerate(texts_of(batch)):
                    size += _wait(items, waiting, row, text)
                    if size >= WAITING:
                        bad[_scored(items, waiting)[0]] = True
                        waiting, size = {}, 0
                bad[_scored(items, waiting)[0]] = True
                yield batch.filter(pa.array(~bad))

        out = out.mapInArrow(keep, docs.schema)
    return out


def _slices(docs: DataFrame, benchmark: DataFrame, cut: float, slice_bytes: int) -> Iterator:
    """A broadcast of items with their grams' document counts for each slice of the benchmark."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = save(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct(), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-total // slice_bytes))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").toArrow()  # about slice_bytes
        rows = list(zip(*(part.column(c).to_pylist() for c in ("item_id", "text"))))
        plain = spark.sparkContext.broadcast((rows, cut, None))

        def count(batches: Batches, plain=plain) -> Batches:
            held = _held(plain)
            found = np.zeros(len(held.grams), np.int64)
            for batch in batches:
                for text in texts_of(batch):
                    found[np.unique(held.found(text.decode())[2])] += 1
            here = np.nonzero(found)[0]
            yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(found[here])], ["gram", "n"])

        got = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # a row a gram of the slice
        counts = np.zeros(len(Items(rows, cut).grams), np.int64)
        counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
        plain.unpersist()
        yield spark.sparkContext.broadcast((rows, cut, counts))


Waiting = dict[int, dict[bytes, list]]


def _wait(items: Items, waiting: Waiting, name: int | None, text: bytes) -> int:
    """Adds a text's passages to those that wait under its name; their words."""
    size = 0
    for item, window in items.passages(text.decode()):
        waiting.setdefault(item, {}).setdefault(window.astype(np.int32).tobytes(), []).append(name)
        size += len(window)
    return size


def _rows(names: list, of: list, scores: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(of, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "item_id", "score"])


def _scored(items: Items, waiting: Waiting) -> tuple[list, list, list]:
    """Names, items and scores of the passages that reach their item's least score."""
    names, of, scores = [], [], []
    for item, by_window in waiting.items():
        words, windows = items.words[item], sorted(by_window, key=len)
        at = 0
        while at < len(windows):
            end = min(len(windows), at + max(1, 4 * AT_ONCE // len(windows[at])))
            while end > at + 1 and (end - at) * len(windows[end - 1]) > 4 * AT_ONCE:  # the longest sets the width
                end = at + (end - at) // 2
            part = [np.frombuffer(w, np.int32) for w in windows[at:end]]
            grid = np.full((len(part), max(map(len, part))), -2, np.int32)
            for i, window in enumerate(part):
                grid[i, : len(window)] = window
            for window, best in zip(windows[at:end], align(words, grid).tolist()):
                if best >= items.need[item]:
                    own = by_window[window]
                    names += own
                    of += [items.ids[item]] * len(own)
                    scores += [best / len(words)] * len(own)
            at = end
    return names, of, scores
