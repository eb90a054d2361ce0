"""Byte-level BPE that speculates and verifies, equal to the tokenizers library.

Words (pieces of the pre-tokenizer) are first cut greedily into the longest tokens. A cut is the exact encoding if
every token encodes to itself and every adjacent pair is compatible: no merge across their boundary comes before
the merges that hide its two sides. Pairs are tested all at once in numpy, along the right edges of the left token
and the left edges of the right one. Only words with a failing pair are merged exactly, rank by rank.

Cases: a null text encodes as the empty text, to no ids. Strings of added tokens in a text become their ids, as in
the library. Any text is encoded whole; one word may be as long as the text. Decoding joins the tokens' bytes and
replaces invalid UTF-8. Repeated rows are encoded each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, column, texts_of

#: White space as the library's pattern engine has it (fixed values).
SPACES = r"\t-\r" + "".join(map(chr, (0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The byte-level pre-tokenizer's published pattern (fixed value), with that white space.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Ends a word where bytes are written as characters; no rank; bytes of a word from which it is merged by itself.
END, NEVER, LONG = chr(256), np.int64(1) << 61, 64
#: The same pattern with the classes spelled out, for texts of these characters only: ASCII and Latin up to U+024F.
_LETTERS, _NUMBERS = rf"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-{chr(0x24F)}", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
OTHER = re.compile(rf"[^\t\n\r -\x7e\xa0-{chr(0x24F)}]")
#: Bytes of the words, ids and texts that a worker remembers, each with so many for its places in the tables; longer words aren't kept.
CACHE_BYTES, ENTRY_BYTES, KEPT_BYTES = 200 << 20, 400, 1 << 12
#: Characters of the texts that are encoded in one go, a text at least.
AT_ONCE = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class WordCoder:
    """Encodes texts by words (pieces of the pre-tokenizer), which it remembers. A subclass says how words are encoded."""

    def __init__(self, added: dict[str, int]) -> None:
        self.added = added
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pieces = regex.compile(PIECES)
        #: By word; an added token's word is its id.
        self.ids_of: dict[str | int, bytes] = {}
        self.name_of: dict[str | int, str] = {}
        self.held, self.long = 0, []

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def split(self, text: str) -> list[str]:
        return (self.pieces if OTHER.search(text) else PLAIN).findall(text)

    def cut(self, text: str) -> list[str | int]:
        """Words, and ids of added tokens, in order."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self.split(text)
        out: list[str | int] = []
        at = 0
        for m in self.added_pattern.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.split(text[at:])

    def learn(self, new: list[str | int]) -> None:
        """Encodes words that aren't known."""
        plain = [w for w in new if isinstance(w, str)]
        for word, ids in [*zip(plain, self.encode_words(plain)), *((w, [w]) for w in new if not isinstance(w, str))]:
            raw = array(self.code, ids).tobytes()
            name = ",".join(map(str, ids)) if self.named else ""
            self.ids_of[word] = raw
            if self.named:
                self.name_of[word] = name
            self.held += ENTRY_BYTES + len(raw) + len(name) + (4 * len(word) if isinstance(word, str) else 0)

    def forget(self) -> None:
        """Drops long words, and all words once they take too many bytes."""
        if self.held > CACHE_BYTES:
            self.ids_of, self.name_of, self.held = {}, {}, 0
            return
        for word in [w for w in self.long if w in self.ids_of]:
            raw, name = self.ids_of.pop(word), self.name_of.pop(word, "")
            self.held -= ENTRY_BYTES + len(raw) + len(name) + 4 * len(word)
        self.long = []

    #: Whether decimal texts are kept beside the ids; how an id is stored (array's type code).
    named, code = False, "I"

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str | None]]:
        """For each text its ids and, if named, their decimal text, joined by commas."""
        cut = [self.cut(t) for t in texts]
        self.forget()
        found = [list(map(self.ids_of.get, ws)) for ws in cut]
        new = list({w for ws, parts in zip(cut, found) if None in parts for w, part in zip(ws, parts) if part is None})
        self.learn(new)
        self.long = [w for w in new if isinstance(w, str) and len(w) > KEPT_BYTES]
        ids_of, name_of, out = self.ids_of, self.name_of, []
        for ws, parts in zip(cut, found):
            if None in parts:
                parts = [ids_of[w] if part is None else part for w, part in zip(ws, parts)]
            out.append((np.frombuffer(b"".join(parts), self.code), ",".join(map(name_of.__getitem__, ws)) if self.named else None))
        return out


class BPE(WordCoder):
    """Encoder and decoder for one tokenizer file."""

    named = True

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        super().__init__(added)
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge_of = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        codes = np.array([a * size + b for a, b in self.merge_of], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.array([r for r, _ in self.merge_of.values()], np.int64)[order]
        self._edges()
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _edges(self) -> None:
        """Right edges and left edges of each token: itself, then its last (first) part, and so on, with the rank that hides each."""
        size, never = self.size, np.int64(1) << 60
        left, right, birth = np.full(size, -1), np.full(size, -1), np.full(size, -1, np.int64)
        for (a, b), (rank, made) in self.merge_of.items():
            if birth[made] < 0:
                left[made], right[made], birth[made] = a, b, rank
        self.in_order = all(rank > birth[a] and rank > birth[b] for (a, b), (rank, _) in self.merge_of.items())
        self.birth = birth

        def spine(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nodes, hidden, now, by = [], [], np.arange(size), np.full(size, never)
            while (now >= 0).any():
                nodes.append(now)
                hidden.append(by)
                at = np.maximum(now, 0)
                by = np.where(now >= 0, birth[at], -1)
                now = np.where(now >= 0, part[at], -1)
            return np.stack(nodes, 1), np.stack(hidden, 1)

        self.right_edge, self.left_edge = spine(right), spine(left)
        made = np.nonzero(birth >= 0)[0]
        own = np.ones(size, bool)
        own[made] = ~self._crossed(left[made], right[made], birth[made])
        for i in made[np.argsort(birth[made])]:
            own[i] = own[i] and own[left[i]] and own[right[i]]
        #: Finds the longest token at each place; byte b is the character U+00b, U+0100 ends a word.
        self.automaton = ahocorasick.Automaton()
        for i in [*self.byte_ids, *made[own[made]]]:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), int(i))
        self.automaton.add_word(END, -1)
        self.automaton.make_automaton()
        self.made = np.array([m for _, m in self.merge_of.values()], np.int64)

    def _crossed(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge joins an edge of a with an edge of b while both are there (and, if given, at a rank below)."""
        out = np.zeros(len(a), bool)
        (rights, hide_r), (lefts, hide_l) = self.right_edge, self.left_edge
        for i in range(rights.shape[1]):
            x, until_x = rights[a, i], hide_r[a, i]
            for j in range(lefts.shape[1]):
                y, until_y = lefts[b, j], hide_l[b, j]
                here = np.nonzero((x >= 0) & (y >= 0) & ~out)[0]
                here = here[(self.birth[x[here]] < until_y[here]) & (self.birth[y[here]] < until_x[here])]
                if not len(here):
                    continue
                rank = self.rank_of(x[here], y[here])
                hit = (rank < until_x[here]) & (rank <= until_y[here])  # the leftmost of equal merges comes first
                if below is not None:
                    hit &= rank < below[here]
                out[here[hit]] = True
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs' merges; NEVER where there is none."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.ranks[at], NEVER)

    def speculate(self, words: list[bytes]) -> np.ndarray:
        """Greedy longest tokens of all words; -1 after each word."""
        text = END.join(w.decode("latin-1") for w in words) + END
        return np.fromiter((token for _, token in self.automaton.iter_long(text)), np.int64)

    def merge_exactly(self, words: list[bytes]) -> list[list[int]]:
        """Of words of similar length: in each, again and again, the leftmost pair of least rank is merged."""
        width, count = max(map(len, words)), len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width)
        lengths = np.fromiter(map(len, words), np.int64, count)
        ids = np.where(np.arange(width) < lengths[:, None], np.array(self.byte_ids, np.int64)[raw], -1)
        ids = np.concatenate([ids, np.full((count, 2), -1, np.int64)], axis=1)  # room for what moves in from the right
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[]] * count
        rows, places = np.arange(count), np.arange(ids.shape[1])
        while len(rows):
            at = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            best = ranks[here, at]
            done = best == NEVER
            if done.any():
                for row, got in zip(rows[done].tolist(), ids[done].tolist()):
                    out[row] = got[: got.index(-1)]
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            ids[here, at] = self.made[best]
            move = np.minimum(places + (places > at[:, None]), len(places) - 1)
            ids = np.take_along_axis(ids, move, axis=1)
            ids[:, -1] = -1
            move = np.minimum(places[:-1] + (places[:-1] >= at[:, None]), len(places) - 2)
            ranks = np.take_along_axis(ranks, move, axis=1)
            ranks[:, -1] = NEVER
            ranks[here, at] = self.rank_of(ids[here, at], ids[here, at + 1])
            inner = at > 0
            ranks[here[inner], at[inner] - 1] = self.rank_of(ids[here[inner], at[inner] - 1], ids[here[inner], at[inner]])
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, for a word of any length."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge_of.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = made, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left in (prv[i], i):
                if left >= 0 and nxt[left] < n and (m := self.merge_of.get((ids[left], ids[nxt[left]]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[nxt[left]], m[1]))
        return [t for t, here in zip(ids, alive) if here]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Exact ids of each word, by speculation where that holds."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        flat = self.speculate(raw)
        ends = np.nonzero(flat < 0)[0]
        codes = flat[:-1] * self.size + flat[1:]
        codes[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
        pairs, at = np.unique(codes, return_inverse=True)
        crossed = np.zeros(len(pairs), bool)
        real = pairs >= 0
        crossed[real] = self._crossed(pairs[real] // self.size, pairs[real] % self.size)
        starts = np.concatenate([[0], ends[:-1] + 1])
        failed = np.add.reduceat(np.append(crossed[at], False), starts) > 0
        if not self.in_order:
            failed[:] = True
        tokens = flat.tolist()
        out = [tokens[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        again = sorted(np.nonzero(failed)[0].tolist(), key=lambda k: len(raw[k]))
        for k in [k for k in again if len(raw[k]) > LONG]:
            out[k] = self.merge_long(raw[k])
        again = [k for k in again if len(raw[k]) <= LONG]
        for first in range(0, len(again), 4096):
            part = again[first : first + 4096]
            for k, ids in zip(part, self.merge_exactly([raw[k] for k in part])):
                out[k] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return ""
        places = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[places].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> BPE:
    """One encoder a worker process."""
    return BPE(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids (array of int), decoded (string), ids_text (decimal, joined by commas)."""
    return _run(docs, path, "doc_id long, ids array<int>, decoded string, ids_text string", lambda bpe, ids, text: (ids.astype(np.int32), bpe.decode(ids), text), [pa.list_(pa.int32()), pa.string(), pa.string()])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids' decimal text and of the decoded text, made beside the ids."""

    def sums(bpe: BPE, ids: np.ndarray, text: str) -> tuple:
        return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return _run(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", sums, [pa.int64(), pa.string(), pa.string()])


def _run(docs: DataFrame, path: str, schema: str, make, kinds: list[pa.DataType]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Batches) -> Batches:
        bpe = load(path)
        for batch in batches:
            texts = [t.decode() for t in texts_of(batch)]
            ends = np.cumsum([len(t) for t in texts]) // AT_ONCE
            cuts = [0, *(np.nonzero(np.diff(ends))[0] + 1).tolist(), len(texts)]
            for at, end in zip(cuts, cuts[1:]):
                rows = [make(bpe, ids, text) for ids, text in bpe.encode(texts[at:end])]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(at, end - at), *made], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
