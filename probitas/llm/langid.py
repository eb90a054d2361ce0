"""Language identification by unigram pieces, with all segmentations of a word summed.

The vocabulary is a public tokenizer's, whose path is a parameter. Per language, piece probabilities are fitted by
expectation maximisation on a bounded sample of labelled rows. A word (letters, lower-cased, with a word mark before
it) has as its probability the sum over all its segmentations into pieces, by the forward algorithm; a text's score
is the sum of its words' logarithms. The best language wins; its score is its posterior with the logarithms divided
by the root of the number of words, as words of a text aren't independent.

Sums over words of up to LINEAR letters can't underflow and are taken as they are; those over longer words, such as
those of scripts without spaces, are taken in logarithms, for a word of any length.

Cases: a null text, or one without letters, is ``und`` with score 0, and so is everything if no labelled row is
there. Repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, column, sample_ids, texts_of

MARK, LINEAR = "▁", 32
#: Labelled rows of a language that are learned from; rounds of fitting; added to each expected count; probability of a character as such.
SAMPLE, ROUNDS, ADDED, UNKNOWN = 300, 4, 0.05, 1e-7
#: Words, and letters of words, that a worker remembers; cells (letters times languages) of words that are summed at once.
CACHE_WORDS, CACHE_LETTERS, AT_ONCE = 300_000, 16 << 20, 4 << 20
WORD, LETTER = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def portions(words: list[str], langs: int) -> list[list[str]]:
    """The words by length, in lists of a bounded number of cells (of the longest word by the number of words); short ones apart."""
    out: list[list[str]] = []
    for word in sorted(words, key=len):
        if not out or (len(out[-1]) + 1) * (len(word) + 2) * max(1, langs) > AT_ONCE or (len(word) > LINEAR) != (len(out[-1][-1]) > LINEAR):
            out.append([])
        out[-1].append(word)
    return out


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in kept]


class Lattice:
    """All occurrences of pieces in some words, by end."""

    def __init__(self, automaton: ahocorasick.Automaton, sizes: np.ndarray, words: list[str]) -> None:
        marked = [MARK + w for w in words]
        self.lengths = np.fromiter(map(len, marked), np.int64, len(words))
        self.width = int(self.lengths.max(initial=0))
        starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        ends, piece = np.fromiter(chain.from_iterable(automaton.iter("\n".join(marked))), np.int64).reshape(-1, 2).T
        word = np.repeat(np.arange(len(words)), self.lengths + 1)[ends]
        stop = ends - starts[word] + 1
        order = np.argsort(stop, kind="stable")
        self.word, self.stop, self.piece = word[order], stop[order], piece[order]
        self.start = self.stop - sizes[self.piece]
        self.cuts = np.searchsorted(self.stop, np.arange(self.width + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(word, place, language): probability of all segmentations up to there."""
        n, langs = len(self.lengths), p.shape[1]
        a = np.zeros((n, self.width + 1, langs))
        a[:, 0] = 1
        for end in range(1, self.width + 1):
            s = slice(self.cuts[end], self.cuts[end + 1])
            word = self.word[s]
            part = a[word, self.start[s]] * p[self.piece[s]]
            a[:, end] = a[:, end - 1] * UNKNOWN
            for k in range(langs):
                a[:, end, k] += np.bincount(word, part[:, k], n)
        return a

    def forward_logs(self, p: np.ndarray) -> np.ndarray:
        """The logarithms of the same, for words of any length."""
        n, langs = len(self.lengths), p.shape[1]
        with np.errstate(divide="ignore"):
            logs, unknown = np.log(p), np.log(UNKNOWN)
        a = np.zeros((n, self.width + 1, langs))
        for end in range(1, self.width + 1):
            a[:, end] = self._joined(a[:, end - 1] + unknown, slice(self.cuts[end], self.cuts[end + 1]), a, self.start, logs)
        return a

    def _joined(self, least: np.ndarray, rows, a: np.ndarray, at: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Logarithm of the sum, by word, of exp(least) and of what the pieces of `rows` add to the places `at` of a."""
        word = self.word[rows]
        part = a[word, at[rows]] + logs[self.piece[rows]]
        most = least.copy()
        np.maximum.at(most, word, part)
        total, part = np.exp(least - most), np.exp(part - most[word])
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(word, part[:, k], len(total))
        return most + np.log(total)

    def totals(self, p: np.ndarray) -> np.ndarray:
        """(word, language): logarithm of the probability of all segmentations."""
        last = np.arange(len(self.lengths)), self.lengths
        return self.forward_logs(p)[last] if self.width > LINEAR + len(MARK) else np.log(self.forward(p)[last])

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, where words occur `counts` (word, language) times."""
        n, langs = len(self.lengths), p.shape[1]
        long = self.width > LINEAR + len(MARK)
        a = self.forward_logs(p) if long else self.forward(p)
        total = a[np.arange(n), self.lengths]
        with np.errstate(divide="ignore"):
            logs, unknown = np.log(p), np.log(UNKNOWN)
        b = np.full_like(a, -np.inf) if long else np.zeros_like(a)
        b[np.arange(n), self.lengths] = -total if long else counts / total
        order = np.argsort(self.start, kind="stable")
        cuts = np.searchsorted(self.start[order], np.arange(self.width + 1))
        out = np.zeros_like(p)
        for begin in range(self.width - 1, -1, -1):
            here = order[cuts[begin] : cuts[begin + 1]]
            word, piece = self.word[here], self.piece[here]
            if long:
                inside = begin < self.lengths  # beyond a word's end there is nothing
                with np.errstate(invalid="ignore"):
                    b[:, begin] = np.where(inside[:, None], self._joined(b[:, begin + 1] + unknown, here, b, self.stop, logs), b[:, begin])
                used = np.exp(a[word, begin] + logs[piece] + b[word, self.stop[here]]) * counts[word]
            else:
                onward = b[word, self.stop[here]] * p[piece]
                b[:, begin] += b[:, begin + 1] * UNKNOWN
                used = a[word, begin] * onward
                for k in range(langs):
                    b[:, begin, k] += np.bincount(word, onward[:, k], n)
            for k in range(langs):
                out[:, k] += np.bincount(piece, used[:, k], len(p))
        return out


class Model:
    """Languages, pieces and probabilities (piece, language)."""

    def __init__(self, langs: list[str], pieces: list[str], p: np.ndarray) -> None:
        self.langs, self.pieces, self.p = langs, pieces, p
        self.automaton, self.sizes = _automaton(pieces)
        #: Words that are known, with their letters in all, and their logarithms by language.
        self.rows: dict[str, int] = {}
        self.letters, self.table = 0, np.zeros((0, len(langs)))

    def __reduce__(self):
        return Model, (self.langs, self.pieces, self.p)

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        found = [words_of(t) for t in texts]
        wanted = set().union(*found)
        new = list(wanted - self.rows.keys())
        self.letters += sum(map(len, new))
        if len(self.rows) + len(new) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self.rows, self.table, new = {}, self.table[:0], list(wanted)
            self.letters = sum(map(len, new))
        parts = [self.table]
        for words in portions(new, len(self.langs)):
            parts.append(Lattice(self.automaton, self.sizes, words).totals(self.p))
            self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.table = np.concatenate(parts)
        out = []
        for text, ws in zip(texts, found):
            if not ws or not self.langs or not LETTER.search(text):
                out.append(("und", 0.0))
                continue
            total = self.table[list(map(self.rows.__getitem__, ws))].sum(axis=0)
            best = int(total.argmax())
            weight = np.exp((total - total[best]) / np.sqrt(len(ws)))
            out.append((self.langs[best], float(1 / weight.sum())))
        return out


def _automaton(pieces: list[str]) -> tuple[ahocorasick.Automaton, np.ndarray]:
    automaton = ahocorasick.Automaton()
    for i, piece in enumerate(pieces):
        automaton.add_word(piece, i)
    automaton.make_automaton()
    return automaton, np.fromiter(map(len, pieces), np.int64, len(pieces))


def fit(rows: list[tuple[str, str]], path: str) -> Model:
    """From (language, text) rows."""
    langs = sorted({lang for lang, _ in rows})
    tally: dict[str, np.ndarray] = {}
    for lang, text in rows:
        k = langs.index(lang)
        for word in words_of(text):
            if word not in tally:
                tally[word] = np.zeros(len(langs))
            tally[word][k] += 1
    pieces = vocabulary(path)
    pieces = [p for p in pieces if "\n" not in p]
    automaton, sizes = _automaton(pieces)
    lattices = [(Lattice(automaton, sizes, part), np.array([tally[w] for w in part])) for part in portions(list(tally), len(langs))]
    p = np.full((len(pieces), max(1, len(langs))), 1 / len(pieces))
    for _ in range(ROUNDS if langs else 0):
        counts = sum((lattice.expected(p, n) for lattice, n in lattices), np.zeros_like(p)) + ADDED
        p = counts / counts.sum(axis=0)
    return Model(langs, pieces, p)


def train(docs: DataFrame, learned: Column, path: str, sample: int = SAMPLE) -> Model:
    """From at most `sample` documents a language of those where `learned` is true: those of least hash of doc_id."""
    bounded_batches(docs.sparkSession)
    known = docs.where(learned & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "doc_id", "text")
    rows = known.join(F.broadcast(sample_ids(known, "lang", sample)), ["lang", "doc_id"])  # `sample` ids a language
    texts = rows.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of repeated ids
    return fit(sorted((r[0], r[1]) for r in texts.select("lang", "text").collect()), path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 8 bytes a piece and language

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts, ids = [t.decode() for t in texts_of(batch)], column(batch, "doc_id")
            for at in range(0, len(texts), 1024):
                got = shared.value.score(texts[at : at + 1024])
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1024), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
