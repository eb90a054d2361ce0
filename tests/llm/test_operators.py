"""The training-data operators: awkward rows for each, and brute force on small tables."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from probitas.llm import bpe, components, decontaminate, langid, licenses, quality, queries, sharding, similar, simhash, tokens, toxicity, urls
from probitas.llm.common import save

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "x" * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, repeated rows and ids, and columns that clash with the operators' own."""
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, "a b"), (5, "a b"), (5, "other text"), (None, "no id"), (None, None), (7, "¹²³ <|endoftext|> 漢字"), (8, "Licensed under the MIT License.")]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    return base.withColumns({c: F.lit(9) for c in ("lang", "fp", "key", "score", "size", "bucket", "shard", "ids", "digits")})


@pytest.fixture(scope="module")
def none(odd):
    return save(odd.limit(0), "none")


LIBRARY = Tokenizer.from_file(PATH)


def reference_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


#: Published notices as they stand.
APACHE = """   Copyright 2019 Example

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
MIT = """Copyright (c) 2019 Example

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Copyright (c) 2019, Example

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.
"""
BSD3 = """Copyright (c) 2019, Example
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
LGPL21 = """    This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize(
    "text, names",
    [
        (APACHE, ["Apache-2.0"]), (MIT, ["MIT"]), (ISC, ["ISC"]), (BSD3, ["BSD-3-Clause"]), (GPL3, ["GPL-3-or-later"]), (LGPL21, ["LGPL-2.1-or-later"]), (MPL, ["MPL-2.0"]),
        (BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE") :], ["BSD-2-Clause"]),
        (MIT + ISC + MPL, ["MIT", "ISC", "MPL-2.0"]),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2"]),
        ("This is free and unencumbered software released into the public domain.", ["PublicDomain"]),
        ("This work is released under CC BY 4.0.", ["CC-BY-4.0"]),
        ("// SPDX-License-Identifier: MIT\nint main() {}", ["SPDX:mit"]),
        ("SPDX-License-Identifier: Apache-2.0", ["SPDX:apache-2.0"]),
        ("This file is in the public\ndomain.", ["PublicDomain"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("some text.\nThis work is licensed under the GNU General Public License, version 3.\nmore", ["GPL-3"]),
        ("some text.\nReleased under the MIT License.\nmore", ["MIT"]),
        ("He had a license to drive. Permission was given.", []),
    ],
)
def test_published_notices(text, names):
    assert licenses.licences(licenses.identifiers(text)) == names
    for mark in ("# ", "// ", " * ", ";; ", "-- "):  # as comments
        lines = "".join(mark + line + "\n" if line.strip() else mark.rstrip() + "\n" for line in text.splitlines())
        assert licenses.licences(licenses.identifiers(lines)) == names


def test_licenses(spark, odd, none):
    got = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert got[8].licences == ["MIT"] and got[1].licences == [] and licenses.scan(none).isEmpty() and licenses.scan(odd).count() == 11
    long = MIT.replace("including without limitation", "including " + "without any limitation whatsoever, " * 400)
    table = spark.createDataFrame([(1, "word " * 50_000 + "\n\n" + long), (2, "Copyright 2001 Acme\n" * 3 + ISC)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert rows[1].licences == ["MIT"] and rows[2].licences == ["ISC"] and rows[2].n_copyright >= 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([x for t in (APACHE, MIT, ISC, BSD3, GPL3, MPL) for x in licenses.CUT.split(t)] + ["all rights reserved", "© 2019 Acme", "Copyright (c) Acme", "under", "the lic'ense", "a\nb"]), max_size=4), st.integers(0, 10**9))
def test_sentences_by_all_patterns(parts, seed):
    """The words that a pattern needs hide no sentence that it fits."""
    rng = random.Random(seed)
    s = " ".join(parts)
    for _ in range(rng.randint(0, 2)):
        at = rng.randint(0, len(s))
        s = s[:at] + rng.choice(["\n", "'", " ", "* ", "x"]) + s[at:]
    wanted = next(((name, m) for name, _, pattern in licenses._PATTERNS if (m := pattern.fullmatch(licenses.normalise(s)))), None)
    got = licenses.identify(s)
    assert (got and got[0]) == (wanted and wanted[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=3), max_size=5))
def test_rules_by_brute_force(ids, rules):
    named = [(f"r{k}", tuple(r)) for k, r in enumerate(rules)]
    want, text = [], "".join(ids)
    while text:
        hit = next((r for r in named if text.startswith("".join(r[1]))), None)
        want += [hit[0]] if hit else []
        text = text[len(hit[1]) if hit else 1 :]
    assert licenses.licences([(i, {}) for i in ids], named) == want


def brute_repeats(words, n):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n#*$%&|<>\t", max_size=120) | st.text(alphabet="ab \n*", max_size=120))
def test_quality_measures(text):
    words, got = [w.decode() for w in text.encode().split()], quality.measure(text.encode(), (4, 5))
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words)) and got["n_symbols"] == sum(map(text.count, "#*$%&|<>"))
    assert got["n_repeat_words"] == len(brute_repeats(words, 3))
    for n in (4, 5):
        assert got[f"dup_share_{n}"] == pytest.approx(sum(len(words[i]) for i in brute_repeats(words, n)) / max(1, sum(map(len, words)))) or len(words) <= n
    lines = [x for x in text.split("\n") if x.encode().split()]
    assert got["n_dup_lines"] == len(lines) - len(set(lines))


def brute_quality(text, limits=quality.NGRAM_LIMITS, line_limit=quality.LINE_LIMIT):
    """(base_failed, kept) by the rules, from texts of space-separated words."""
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.split()]
    base = len(words) < 50 or 100 * len(brute_repeats(words, 3)) > 50 * len(words)
    chars = max(1, sum(map(len, words)))
    again = sum(sum(map(len, x.split())) for k, x in enumerate(lines) if x in lines[:k])
    shares = [sum(len(words[i]) for i in brute_repeats(words, n)) / chars <= most for n, most in limits.items()]
    return base, not base and again / chars <= line_limit and all(shares)


def test_quality_rows(spark, odd, none):
    got = quality.quality(odd).collect()
    assert len(got) == 11 and all(r.base_failed for r in got) and quality.quality(none).isEmpty()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({c: F.lit("x") for c in ("kept", "base_failed", "n_words")})
    want = {r.doc_id: brute_quality(r.text) for r in docs.collect()}
    rows = quality.quality(docs).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in rows} == want
    tight = {5: 0.1, 7: 0.1, 10: 0.05}
    rows = quality.quality(docs, tight, 0.05).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in rows} == {r.doc_id: brute_quality(r.text, tight, 0.05) for r in docs.collect()} and any(not r.base_failed and not r.kept for r in rows)
    assert {r.doc_id for r in quality.kept_rows(docs).collect()} == {i for i, (_, k) in want.items() if k}
    assert quality.kept_rows(odd).columns == odd.columns


def test_quality_rejects_repetition(spark):
    rng = random.Random(8)

    def words(n):
        return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]

    run, short, line = words(40), words(6), " ".join(words(2))
    texts = {
        1: " ".join(words(200)),  # clean
        2: " ".join(words(150) + short + words(150) + short),  # 12 of 312 words repeat
        3: " ".join(words(200) + run + words(60) + run),  # 80 of 340 words, in long n-grams
        4: " ".join(words(5) + [w for _ in range(5) for w in short + words(9)] + words(5)),  # 30 of 85 words, in 5-grams only
        5: "\n".join(x for _ in range(20) for x in (" ".join(words(6)), line)),  # the line is 24 % but no 3-gram repeats
    }
    rows = quality.quality(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert not any(r.base_failed for r in rows) and {r.doc_id for r in rows if r.kept} == {1, 2}
    assert {r.doc_id for r in quality.kept_rows(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()} == {1, 2}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_variable_length_coding(values):
    control, data = tokens.pack_ranks(np.array(values, np.uint32))
    assert tokens.unpack_ranks(control, data, len(values)).tolist() == values and len(control) == -(-len(values) // 4)


def test_library_coder():
    parts = [" "] * 6 + ["\n"] * 4 + ["\t", "\r", chr(0xA0), chr(0x3000), "\x1c", chr(0x85), "a", "the", "é", "中文", "'s", "'", "12", "!", "<|endoftext|>", "<|", "\U0001f600"]
    rng = random.Random(7)
    texts = ["", "\n", "  ", "a\n\n\nb", "foo   bar", "foo \n bar ", "x  <|endoftext|> y", "long" * 5000] + ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(500)]
    code, raw = tokens.LibraryCoder(PATH), [t.encode() for t in texts]
    got = [ids for part in tokens.portions(raw, 1 << 12) for ids in code.encode(raw[part])]
    assert [np.frombuffer(g, code.kind).tolist() for g in got] == [reference_ids(t) for t in texts]


def test_token_files(spark, odd, none, docs):
    assert tokens.token_round_trip(none, PATH).isEmpty()
    got = {(r.doc_id, r.start): r for r in tokens.token_round_trip(odd, PATH).collect()}
    assert len(got) == 11 and sum(r.n_tokens for r in got.values()) == sum(len(reference_ids(r.text)) + 1 for r in odd.collect())
    start = 0
    found = {r.doc_id: r for r in tokens.token_round_trip(docs, PATH).collect()}
    for r in sorted(docs.collect()):
        ids = [*reference_ids(r.text), 2]
        assert (found[r.doc_id].start, found[r.doc_id].n_tokens, found[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


CODER = bpe.BPE(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="etaoin shrdlu'sTH\n ,.1", max_size=120))
def test_bpe_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, names = CODER.encode([text])[0]
    assert ids.tolist() == reference_ids(text) and names == ",".join(map(str, ids)) and CODER.decode(ids) == text


def test_bpe_rows(odd, none):
    got = bpe.digests(odd, PATH).collect()
    assert len(got) == 11 and bpe.digests(none, PATH).isEmpty()
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == 0 and by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].ids_sha256 == hashlib.sha256(",".join(map(str, reference_ids(LONG))).encode()).hexdigest() and by[4].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.encode_decode(odd, PATH).where("doc_id = 7").first().decoded == "¹²³ <|endoftext|> 漢字"


def test_bpe_forgets_by_bytes(monkeypatch):
    rng, coder = random.Random(2), bpe.BPE(PATH)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 50_000)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 40)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.choice((3, 8, 90)))) for _ in range(20)) for _ in range(5)]
        assert [ids.tolist() for ids, _ in coder.encode(texts)] == [reference_ids(t) for t in texts]
        coder.forget()
        words = coder.ids_of.keys() & coder.name_of.keys()
        assert len(words) == len(coder.ids_of) and max(map(len, words), default=0) <= 40
        assert coder.held == sum(bpe.ENTRY_BYTES + len(coder.ids_of[w]) + len(coder.name_of[w]) + 4 * len(w) for w in words) <= 50_000


def test_toxicity(spark, odd, none):
    rng = random.Random(3)
    clean = ["the cat of and sat mat dog house tree sun moon star".split()[k] for k in range(12)]
    texts = [" ".join(rng.choices(clean, k=40) + (["vilestuff" + rng.choice("abcdef")] if k % 4 == 0 else [])) for k in range(900)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(900)], "doc_id long, toxic int")
    net = toxicity.train(table, labels, F.col("doc_id") < 600)
    wrong = toxicity.score(table, net).where("doc_id >= 600").where("(score >= 0.7) != (doc_id % 4 = 0)").count()
    assert wrong <= 9
    got = toxicity.score(odd, net).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got) and toxicity.score(none, net).isEmpty()
    assert toxicity.kept_rows(odd, net).columns == odd.columns
    assert len(toxicity.score(odd, toxicity.train(table, labels, F.lit(False))).collect()) == 11
    clash = lambda df: df.withColumns({c: F.lit(9) for c in ("_y", "y", "score", "lang", "text2")})
    again = toxicity.train(clash(table), clash(labels), F.col("doc_id") < 600)
    assert np.array_equal(again.filters, net.filters) and again.thresholds.tolist() == net.thresholds.tolist()


def test_toxicity_of_one_label(spark, odd):
    """Without a row of label 1 nothing is toxic, the empty text included; empty texts never are."""
    table = spark.createDataFrame([(k, f"some words {k}") for k in range(40)] + [(50, ""), (51, None)], "doc_id long, text string")
    for labels, want in (([], 0), ([(k, 0) for k in range(30)], 0), ([(k, 1) for k in range(30)], 40), ([(50, 1), (51, 1)], 0)):
        net = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        got = {r.doc_id: r.score for r in toxicity.score(table, net).collect()}
        assert sum(v >= 0.7 for v in got.values()) == want and got[50] == got[51] == toxicity.EMPTY
        assert toxicity.kept_rows(table, net).count() == 42 - want


def test_convolution_by_brute_force():
    """Activations and logits by loops; the gradient by differences of the loss."""
    rng = np.random.default_rng(5)
    net = toxicity.Net(3)
    net.shift[:], net.only = 0.2, None
    net.bias[:] = rng.normal(0, 0.3, len(net.bias))
    words = ["alpha", "beta", "gammas", "delta", "beta", "omega"]
    buckets = toxicity.features(words)

    def logit(net, at):
        vectors = [net.embed[buckets[k]].astype(float).mean(axis=0) for k in at]
        tops, place = [], 0
        for j, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                sums = [sum(vectors[i + k] @ net.filters[:, (place + k) * toxicity.FILTERS + f].astype(float) for k in range(width) if i + k < len(at)) for i in range(len(at))]
                tops.append(max(sums) + net.bias[j * toxicity.FILTERS + f])
            place += width
        return sum(max(t, 0) * o for t, o in zip(tops, net.out.astype(float))) + net.shift[0]

    for at in ([0, 1, 2, 3, 4, 5], [2], [3, 1]):
        parts = toxicity._parts(net, buckets, np.array(at))
        assert net.logit(parts) == pytest.approx(logit(net, at), abs=1e-4)

    class Catch(toxicity.Adam):
        def step(self, name, value, grad, rows=None):
            self.state[name] = (grad.copy(), rows)

    texts, labels, weight = [np.array([0, 1, 2, 3, 4, 5]), np.array([3, 1])], np.array([1, 0], np.float32), np.array([1.5, 0.5], np.float32)
    catch = Catch(0.1)
    toxicity._step(net, catch, texts, labels, weight, buckets)

    def loss():
        z = np.array([logit(net, t.tolist()) for t in texts])
        return float((weight * np.where(labels == 1, np.log1p(np.exp(-z)), np.log1p(np.exp(z)))).sum() / 2)

    rows = catch.state["embed"][1]
    for name, value in (("filters", net.filters), ("bias", net.bias), ("out", net.out), ("shift", net.shift), ("embed", net.embed)):
        grad = catch.state[name][0]
        flat = np.argsort(-np.abs(grad).ravel())[:6]
        for k in flat.tolist():
            at = np.unravel_index(k, grad.shape)
            at = (int(rows[at[0]]), *at[1:]) if name == "embed" else at
            was, ends = value[at], []
            for step in (1e-3, -1e-3):
                value[at] = was + step
                ends.append(loss())
            value[at] = was
            assert grad.ravel()[k] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=0.05, abs=2e-4)


def test_toxicity_in_pieces(monkeypatch):
    """Long texts are learned from and scored as if whole."""
    rng = random.Random(11)
    clean = "the cat of and sat mat Dog der die und house tree sun".split()
    rows = [(" ".join(rng.choices(clean, k=rng.choice((1, 2, 3, 60))) + ["vile stuff"] * (k % 2) + rng.choices(clean, k=rng.randint(1, 60))), k % 2) for k in range(120)]
    texts = [t for t, _ in rows] + ["", " ", "x" * 200, "a", "..." * 50 + "b c"]
    whole = toxicity.fit(rows)
    scores = toxicity.Scorer(whole)(texts)
    monkeypatch.setattr(toxicity, "CHARS", 16)
    monkeypatch.setattr(toxicity, "PIECE", 5)
    monkeypatch.setattr(toxicity, "NUMBER_BYTES", 1500)
    assert [w for words in toxicity.pieces(texts[3]) for w in words] == toxicity.WORD.findall(texts[3].lower())
    net = toxicity.fit(iter(rows))
    assert np.allclose(net.filters, whole.filters, atol=0.02) and np.allclose(net.thresholds, whole.thresholds, atol=0.1)
    assert [k for a, b in toxicity.portions(texts) for k in range(a, b)] == list(range(len(texts))) and not list(toxicity.portions([]))
    got = toxicity.Scorer(whole)(texts)
    assert [g[1] for g in got] == [s[1] for s in scores] and np.allclose([g[0] for g in got], [s[0] for s in scores], atol=1e-5)


def test_toxicity_of_long_texts_on_the_driver(spark, monkeypatch):
    """The learned texts come to the driver a few at a time, in the order of their ids."""
    table = spark.createDataFrame([(k, f"t{k} " + "word " * 50_000) for k in range(60)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    seen, sent = [], []
    collect = type(table).collect

    def told(self):
        got = collect(self)
        sent.append(sum(len(str(r)) for r in got))
        return got

    monkeypatch.setattr(type(table), "collect", told)
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.extend((t.split(" ", 1)[0], y) for t, y in rows) or toxicity.Net())
    toxicity.train(table, labels, F.lit(True))
    assert seen == [(f"t{k}", k % 2) for k in range(60)] and sum(sent) < 1 << 20


def test_language(spark, odd, none, docs):
    model = langid.train(docs, F.col("doc_id") % 2 == 0, PIECES)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == "und" and 0 <= rows[4].score <= 1 and langid.identify(none, model).isEmpty()
    assert langid.identify(odd, langid.train(none.withColumn("lang", F.lit("en")), F.lit(True), PIECES)).first().lang_pred == "und"
    number = {p: k for k, p in enumerate(model.pieces)}
    words = ["the", "öffnung", "x", "abcdefghij", "q" * 32, "ab" * 17, "ausgangs" * 9, "zß" * 200]
    want = []
    for word in words:
        w, a = langid.MARK + word, [np.full(len(model.langs), Fraction(1))]
        for j in range(1, len(w) + 1):
            a.append(a[j - 1] * Fraction(langid.UNKNOWN) + sum((a[i] * np.array(list(map(Fraction, model.p[number[w[i:j]]]))) for i in range(max(0, j - 20), j) if w[i:j] in number), np.full(len(model.langs), Fraction(0))))
        want.append([math.log(v.numerator) - math.log(v.denominator) for v in a[-1]])
    assert max(map(len, number)) <= 20
    for part in langid.portions(words, len(model.langs)):
        got = langid.Lattice(model.automaton, model.sizes, part).totals(model.p)
        assert np.allclose(got, [want[words.index(w)] for w in part], rtol=1e-9)
    text = "ausgangs" * 9 + " the " + "zß" * 200
    total = sum(np.array(want[words.index(w)]) for w in text.split())
    assert model.score([text])[0][0] == model.langs[int(total.argmax())]


def test_language_expected_uses_are_the_same_in_logarithms(monkeypatch):
    automaton, sizes = langid._automaton(["▁a", "a", "b", "ab", "ba", "aba", "▁"])
    rng = np.random.default_rng(3)
    p, words = rng.dirichlet(np.ones(7), 2).T, ["ab", "abab", "xbaab", "a", "abcabab"]
    counts = rng.integers(1, 5, (5, 2)).astype(float)
    plain = langid.Lattice(automaton, sizes, words).expected(p, counts)
    totals = langid.Lattice(automaton, sizes, words).totals(p)
    monkeypatch.setattr(langid, "LINEAR", 0)
    assert np.allclose(langid.Lattice(automaton, sizes, words).expected(p, counts), plain) and np.allclose(langid.Lattice(automaton, sizes, words).totals(p), totals)


def test_urls(spark, monkeypatch):
    names = [None, "", "no scheme", "http://A.COM", "https://WWW.Example.com/en/1?b=2&utm_x=1&a=1#f", "http://x.example.com/en/1", "http://y.net/fr/2", "http://y.net/de/2", "ftp://y.net/de/2/?ref=q", "http://evil.org/p?x"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(names)] + [(9, names[9], "h", "r")] * 50, "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("http://y.net/de/2",), ("http://evil.org/p?x",), (None,)], "url string")

    def run():
        return sorted(urls.url_filter(pages, listed, queries.URL_RULES).collect(), key=str)

    got = {r.page_id: r for r in run()}
    assert (got[0].host, got[0].path, got[0].verdict) == ("", "", "allow") and got[3].host == "a.com" and got[3].path == "" and got[3].rule is None
    assert [got[k].rule for k in (4, 5, 6, 7)] == ["www.example.com/en/", "example.com/en/", "net/fr/", None]
    assert [got[k].verdict for k in (4, 5, 6, 7, 8, 9)] == ["allow", "block", "block", "block", "block", "block"]
    small = run()
    monkeypatch.setattr(urls, "BROADCAST_KEYS", -1)
    assert run() == small
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 1)
    many = spark.range(3000).select(F.concat(F.lit("http://l.org/"), "id").alias("url"))  # far more than the filter is made for
    asked = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://l.org/"), "id").alias("url"))
    assert {r.page_id for r in urls.url_filter(asked, many, []).where("listed").collect()} == set(range(3000))
    assert run() == small
    assert urls.url_filter(pages.limit(0), listed.limit(0), []).isEmpty()


def brute_groups(fps, radius):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(fps)
    for a in names:
        for b in names:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in names}


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("tree_size", [2, 4096])
def test_simhash(docs, odd, none, tree_size):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    got = simhash.near_duplicates(docs, tree_size=tree_size).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps and {r.doc_id: r.component_id for r in got} == brute_groups(fps, 2)
    assert simhash.near_duplicates(none).isEmpty()
    rows = simhash.near_duplicates(odd, tree_size=tree_size).collect()
    assert len(rows) == 11 and {r.component_id for r in rows if r.fp == 0} == {1}


def test_simhash_links(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {v: v for b in base for v in [b, *(b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(15))]}
    for b in base[:3]:  # a chain
        for _ in range(10):
            b ^= 3 << rng.randrange(62)
            fps[b] = b
    table = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in fps], "fp long")
    want = brute_groups(fps, 2)
    for size in (2, 5, 4096):
        got = {r.node % 2**64: r.root % 2**64 for r in components.components(simhash.links(table, 2, size)).collect()}
        parts = {}
        for v in fps:
            parts.setdefault(got.get(v, v), set()).add(v)
        assert {frozenset(p) for p in parts.values()} == {frozenset(v for v in fps if want[v] == r) for r in set(want.values())}


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (7, 7)] + [(200, 200 + k) for k in range(1, 40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[102] == 100 and got[239] == 200 and len(got) == 61 + 3 + 40
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_near_copies(spark, odd, none):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, want = [], set()
    for k in range(60):
        words = [word() for _ in range(200)]
        rows.append((10 * k, " ".join(words)))
        want.add(10 * k)
        if k % 3 == 0:
            rows.append((10 * k + 1, " ".join(words)))
            words[100] = "changed"
            rows.append((10 * k + 2, " ".join(words)))
    rows += [(10 * k + 5, " ".join([word() for _ in range(150)] + rows[0][1].split()[:60])) for k in range(40)]  # share a passage only
    want |= {10 * k + 5 for k in range(40)}
    table = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    assert {r.doc_id for r in similar.one_of_each(table).collect()} == want and similar.one_of_each(table).count() == len(want)
    assert similar.one_of_each(none).isEmpty() and similar.one_of_each(odd).columns == odd.columns
    kept = similar.one_of_each(odd).collect()
    assert sum(r.doc_id in (1, 2, 3) for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2
    h = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in (rows[0][1], rows[2][1])]
    exact = len(np.intersect1d(*h)) / len(np.union1d(*h))
    packed = [np.frombuffer(similar.sketch(x)[0], np.uint64) for x in h]
    assert abs(similar.estimate(packed[0], packed[1][None])[0] - exact) < 0.1


def test_similarity_near_the_threshold(spark):
    rng, rows, want = random.Random(4), [], set()

    def grams(words):
        return set(zip(*(words[i:] for i in range(5))))

    for k in range(120):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
        other = list(words)
        for at in rng.sample(range(5, 495, 6), 6 + k % 11):  # similarities of 0.88 to 0.72
            other[at] = "changed" + str(at)
        a, b = grams(words), grams(other)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want |= {2 * k} | ({2 * k + 1} if len(a & b) < 0.8 * len(a | b) else set())
    rows += [(1000 + k, " ".join(f"t{j}" if j % 50 else f"own{k}" for j in range(400))) for k in range(60)]  # all alike
    want.add(1000)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert 150 < len(want) < 230
    assert {r.doc_id for r in similar.one_of_each(table).collect()} == want


def test_exact_links(monkeypatch):
    rng = np.random.default_rng(6)
    base = [rng.choice(60, 40, replace=False) for _ in range(12)]
    sets = [np.unique(np.append(b[: rng.integers(30, 41)], rng.integers(60, 70, 3))).astype(np.uint64) for b in base for _ in range(8)]
    ids = list(range(len(sets)))
    links = {(a, b) for a in ids for b in ids if a < b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    want = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    for at_once in (similar.AT_ONCE, 100):
        monkeypatch.setattr(similar, "AT_ONCE", at_once)
        assert dict(similar.exact_links(ids, sets, 0.8)) == {i: r for i, r in want.items() if i != r} and len(set(want.values())) > 12
    assert similar.exact_links([5, 5, 3], [sets[0][:0], sets[0], sets[0][:0]], 0.8) == [(5, 3)]


def brute_similar(texts, least=0.8):
    """Smallest id of each document's group, by the similarity of all pairs that share a shingle."""
    sets = {i: frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in texts.items()}
    of: dict = {}
    for i, own in sets.items():
        for h in own or [None]:
            of.setdefault(h, []).append(i)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for ids in of.values() for a in ids for b in ids if a < b}:
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("block, size", [(4096, 16 << 20), (3, 4000)])
def test_similar_groups_by_brute_force(spark, monkeypatch, block, size):
    """Also where shards and groups are cut into blocks: chains, a large group of near copies, and outliers of it."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "BLOCK_BYTES", size)
    rng, texts = random.Random(9), {}

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(words)), n):
            out[at] = f"n{rng.randrange(10**9)}"
        return out

    for k in range(4):
        words = [f"b{k}x{j}" for j in range(120)]
        for _ in range(12):
            texts[len(texts)] = " ".join(edited(words, rng.randint(0, 5)))
        for _ in range(6):  # a chain, each from the one before
            words = edited(words, 2)
            texts[len(texts)] = " ".join(words)
    got = {r.doc_id for r in similar.one_of_each(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == set(brute_similar(texts).values()) and 4 <= len(got) < 60


def test_similar_documents_of_several_rows(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (3, a), (3, c), (4, c), (5, "alone"), (5, "alone"), (5, "other words"), (6, b), (6, "sixth text")]
    got = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, a), (2, b), (5, "alone"), (5, "other words")])  # 3 joins 1 and 4; 6 goes with 2


def test_similar_recall(spark):
    """Of the links of exact similarity among all documents of sf0.01, none is lost and none is added."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_similar({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == set(want.values()) and len(set(want.values())) < len(want) - 50


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1) | st.integers(0, 500), min_size=1, max_size=60), st.integers(0, 2**64 - 1) | st.integers(0, 500), st.integers(0, 30))
def test_bk_tree(values, asked, radius):
    values = np.array(sorted(values, key=lambda v: v % 7), np.uint64)
    tree = simhash.BKTree(values)
    assert sorted(tree.within(np.uint64(asked), radius).tolist()) == [k for k, v in enumerate(values.tolist()) if (v ^ asked).bit_count() <= radius]
    near = {k: {j for j, v in enumerate(values.tolist()) if (v ^ int(values[k])).bit_count() <= radius} for k in range(len(values))}
    want = {k: k for k in near}
    for _ in near:
        want = {k: min(want[j] for j in own) for k, own in near.items()}
    found = dict(simhash.tree_links(values, radius))
    assert {k: found.get(k, k) for k in near} == want


def brute_align(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (1 if x == y else -1), above[j + 1] - 1, row[j] - 1))
            best = max(best, row[-1])
        above = row
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=25))
def test_alignment(a, b):
    assert decontaminate.align(np.array(a), np.array([b + [-2, -2]]))[0] == brute_align(a, b)


def brute_contaminated(texts, items):
    """(doc, item): score of every pair that reaches the least score, by aligning all with all."""
    out = {}
    for d, text in texts.items():
        words = decontaminate.words_of(text or "")
        for i, item in items.items():
            own = decontaminate.words_of(item or "")
            if own and (best := brute_align(own, words)) >= max(-(-len(own) // 2), min(5, len(own))):
                out[d, i] = best / len(own)
    return out


def contaminated(spark, texts, items, **more):
    docs, tests = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, tests, **more).collect()}


def test_decontamination(spark, odd, none, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_contaminated({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()})
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, items).collect()} == want and want
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, items.union(items), slice_bytes=2000).collect()} == want
    assert decontaminate.contaminated(none, items).isEmpty() and decontaminate.contaminated(docs, items.limit(0)).isEmpty()
    extra = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "text"), (None, "no id")], "item_id long, text string").withColumns({c: F.lit(5) for c in ("doc_id", "score", "n", "gram")})
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, extra).collect()}
    assert got == {(5, 3), (5, 4), (None, None)}


def test_decontamination_by_brute_force(spark):
    """Items and texts of few words, so that grams are shared, and edits of every kind and rate around the cut."""
    rng = random.Random(12)
    vocab = ["the", "of", "and", *(f"v{k}" for k in range(25))]
    items = {k: " ".join(rng.choices(vocab, k=rng.choice((1, 2, 3, 5, 6, 9, 14, 30, 41)))) for k in range(40)}
    texts = {}
    for k in range(300):
        words = []
        for _ in range(rng.randint(0, 3)):
            words += rng.choices(vocab + [f"u{j}" for j in range(200)], k=rng.randint(0, 40))
            rate = rng.choice((0, 0.1, 0.2, 0.25, 0.3, 0.5))
            for w in items[rng.randrange(40)].split()[rng.choice((0, 0, 3, 10)) :]:
                edit = rng.random()
                words += [w] if edit >= rate else [[], ["new"], [w, "put"], ["put", w]][rng.randrange(4)]
        texts[k] = " ".join(words)
    want = brute_contaminated(texts, items)
    assert contaminated(spark, texts, items) == want and contaminated(spark, texts, items, slice_bytes=600) == want
    docs, tests = spark.createDataFrame([*texts.items(), (None, items[30]), (7, texts[7])], "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    bad = {d for d, _ in want}
    for size in (600, 1 << 20):
        assert sorted(r.doc_id for r in decontaminate.kept_rows(docs, tests, slice_bytes=size).collect()) == sorted([k for k in texts if k not in bad] + [7] * (7 not in bad))
    assert any(0.5 <= v < 0.55 for v in want.values()) and len(want) > 300


def test_decontamination_does_not_depend_on_how_common_a_gram_is(spark):
    """Copies that hold six of an item's ten words, in numbers that make each of their grams far commoner than the rest."""
    item = "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9"
    for many in (30, 1500):
        texts = {k: f"p{k} {item} q{k}" for k in range(5)} | {100 + k: f"x{k} a0 a1 a2 a3 a4 a5 y{k} z{k}" for k in range(many)}
        texts |= {9000 + k: "a0 a1 pad a3 pad a5 a6 pad" for k in range(40)}  # too few words
        assert contaminated(spark, texts, {1: item}) == {(k, 1): 1.0 for k in range(5)} | {(100 + k, 1): 0.6 for k in range(many)}


def test_decontamination_of_many_equal_edited_copies(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    edited = ["x" if k in (2, 6, 11, 15, 20, 24, 29, 33) else w for k, w in enumerate(words)]
    few = ["pad"] * 90 + words[34:] + ["pad"] * 90  # shares common seeds, but too few words
    long = ["pad", "w3", "w4"] * 400 + edited + ["w3", "w4", "pad"] * 400
    texts = [words] + [edited] * 300 + [[f"a{k}", "w1", *edited, f"b{k}"] for k in range(20)] + [long] + [few] * 3
    want = {(k, 1): brute_align(words, t) / 40 for k, t in enumerate(texts[:322])}
    texts = {k: " ".join(t) for k, t in enumerate(texts)}
    assert want[1, 1] == 0.6 and contaminated(spark, texts, {1: " ".join(words)}) == want
    held = decontaminate.Items([(1, " ".join(words))])
    monkeypatch.setattr(decontaminate, "LONGEST", 100)
    parts = [w for _, w in held.passages(texts[321])]
    assert len(parts) > 10 and max(map(len, parts)) <= 240 and max(decontaminate.align(held.words[0], w[None])[0] for w in parts) == 24


def by_bytes(rows, shards):
    """{(text, doc_id): sorted shards} by the rule, from (doc_id, text) rows; slots aside."""
    rows = sorted((hashlib.md5((t or "").encode()).hexdigest()[:16], (0, 0) if d is None else (1, d), len((t or "").encode()) + 16) for d, t in rows)
    total, below, want = sum(r[2] for r in rows), 0, []
    sizes: dict = {}
    for digest, _, size in rows:
        sizes[digest] = sizes.get(digest, 0) + size
    started: dict = {}
    for digest, ident, size in rows:
        first = started.setdefault(digest, below)
        whole = sizes[digest] * shards * sharding.WHOLE <= total
        at, wide = (first, sizes[digest]) if whole else (below, size)
        want.append((min(shards - 1, (2 * at + wide) * shards // (2 * total)), ident, size))
        below += size
    return want


def test_sharding(spark, docs, odd, none):
    assert sharding.shard_by_bytes(none).isEmpty()
    hot = spark.createDataFrame([(1, "same text")] * 400 + [(None, None)] * 300 + [(k, f"text {k} " * (k % 7)) for k in range(400)] + [(500 + k, "a group of copies") for k in range(6)], "doc_id long, text string")
    for table, shards in ((docs, 7), (odd, 3), (docs, 40), (hot, 40)):
        got = sharding.shard_by_bytes(table, shards).collect()
        want = by_bytes([(r.doc_id, r.text) for r in table.collect()], shards)
        assert sorted((r.shard, (0, 0) if r.doc_id is None else (1, r.doc_id), r.size) for r in got) == sorted(want)
        for k in range(shards):
            slots = sorted(r.slot for r in got if r.shard == k)
            assert slots == list(range(len(slots)))
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(40)]
    fair = sum(sizes) / 40
    assert all(abs(s - fair) <= fair / sharding.WHOLE + 80 for s in sizes) and len({r.shard for r in got if r.doc_id and r.doc_id >= 500}) == 1


def test_pipeline_by_brute_force(spark, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
    kept = save(p.quality_rules(spark, docs, SF), "t")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    calm = save(p.toxicity_filter(spark, kept, SF), "t")
    flagged = {r.doc_id for r in queries.op5_toxicity(spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in calm.collect()} == {r.doc_id for r in kept.collect()} - flagged
    one = save(p.simhash_near_dedup(spark, calm, SF), "t")
    texts = [r.text for r in one.collect()]
    assert len(texts) == len(set(texts)) and one.columns == docs.columns
    free = save(p.benchmark_decontamination(spark, one, SF), "t")
    bad = {r.doc_id for r in queries.op9_decontamination(spark, SF).collect()}
    assert {r.doc_id for r in free.collect()} == {r.doc_id for r in one.collect()} - bad
    assert {r.doc_id for r in p.run(spark, SF).collect()} == {r.doc_id for r in free.collect()}


def test_url_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as from '{SF}/pages.parquet'")
    got = sorted(map(str, map(tuple, queries.op7_url_filters(spark, SF).collect())))
    assert got == sorted(map(str, con.execute(queries.OP7_SQL).fetchall()))


def test_digest_of_many_edges(spark):
    """More edges than a sum of 40-bit hashes has room for; one edge more or another one makes another digest."""
    n = 1 << 25
    edges = spark.range(n).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    count, digest = components._mark(edges)
    assert count == n and digest != components._mark(edges.where("v > 0"))[1]
