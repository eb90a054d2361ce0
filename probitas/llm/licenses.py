"""License scans by sentence rules: sentences are mapped to identifiers, identifier sequences to licences.

A text is cut into sentences (at ``. ! ? ; :`` before white space, but not after ``v.`` or the colon of an SPDX tag; at
blank lines; and before the version clause of the GPL notices; a sentence that isn't known is tried line by line). Sentences
are normalised: lower case, comment marks and quotes dropped, spelling unified, white space collapsed. A known sentence, of
whatever length, gives an identifier. The sequence of identifiers is then read from the left: at each place the first rule,
in the given order, whose identifiers follow there names a licence and takes them. Sentences that aren't known, and
copyright lines, may stand between a rule's sentences.

Cases: null and empty texts have no sentence. Repeated rows are scanned each; columns other than doc_id and text are
ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, column, texts_of

_UNDER = r"(?:this \w+ is |these \w+ are )?(?:licensed|released|distributed|available) under (?:the terms of )?(?:a |the )?"
#: (identifier, words that every such sentence holds, pattern of the whole normalised sentence). What named groups hold goes with the identifier.
SENTENCES: list[tuple[str, str, str]] = [
    ("Copyright", "copyright", r"(?:portions )?copyright (?:\(c\) )?.+"),
    ("Copyright", "(c)", r"\(c\) \d{4}.*"),
    ("AllRights", "all rights reserved", r"all rights reserved"),
    ("ApacheRef", "apache license", _UNDER + r"apache license(?:,? version (?P<v>[\d.]+))?(?: \(the license\))?"),
    ("ApacheNotUse", "except in compliance with the license", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("ApacheObtain", "you may obtain a copy of the license at", r"you may obtain a copy of the license at(?: \S+)?"),
    ("ApacheAsIs", "unless required by applicable law", r"unless required by applicable law or agreed to in writing, (?:software|work) .*as is basis.*"),
    ("ApacheSee", "governing permissions and limitations", r"see the license for the specific language governing permissions and limitations under the license"),
    ("GPLFree", "is free software", r"(?:this program|this library|this file|it|[\w. +-]+) is free software"),
    ("GPLTerms", "as published by the free software foundation", r"you can redistribute it and/or modify it under the terms of the gnu (?P<k>lesser |library |affero )?general public license(?:,? version (?P<v>[\d.]+))?,? as published by the free software foundation"),
    ("GPLVersion", "any later version", r"either version (?P<v>[\d.]+) of the license, or (?:\(at your option\) )?any later version"),
    ("GPLOnly", "of the license", r"version (?P<v>[\d.]+) of the license"),
    ("GPLHope", "in the hope that it will be useful", r"(?:this program|this library|this file|[\w. +-]+) is distributed in the hope that it will be useful, but without any warranty"),
    ("GPLRef", "general public license", _UNDER + r"gnu (?P<k>lesser |library |affero )?general public license(?:,? version (?P<v>[\d.]+))?"),
    ("MITRef", "license", _UNDER + r"(?:mit|expat) license"),
    ("MITGrant", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software.*subject to the following conditions"),
    ("MITNotice", "this permission notice shall be included", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    ("MITAsIs", "without warranty of any kind", r"the software is provided as is, without warranty of any kind.*"),
    ("ISCGrant", "for any purpose with or without fee is hereby granted", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted.*"),
    ("ISCAsIs", "disclaims all warranties", r"the software is provided as is and .+ disclaims all warranties.*"),
    ("BSDGrant", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSDSource", "redistributions of source code must retain", r"(?:\d\.? ?)?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSDBinary", "redistributions in binary form must reproduce", r"(?:\d\.? ?)?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDAdvert", "advertising materials mentioning features", r"(?:\d\.? ?)?all advertising materials mentioning features or use of this software must display the following acknowledgement.*"),
    ("BSDEndorse", "endorse or promote products", r"(?:\d\.? ?)?neither the name of .+ may be used to endorse or promote products.*"),
    ("BSDAsIs", "this software is provided by", r"this software is provided by .+ as is.*"),
    ("BSDRef", "bsd license", _UNDER + r"(?:new |simplified |(?P<v>\d)-clause )?bsd license"),
    ("MPLRef", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license, v\. ?(?P<v>[\d.]+)"),
    ("CCRef", "under", _UNDER + r"(?:cc|creative commons)[ -](?P<k>by(?:-nc)?(?:-sa|-nd)?|zero|0)(?: (?P<v>[\d.]+))?(?: license)?"),
    ("PublicDomain", "public domain", r"this (?:software|work|file|is free and unencumbered software) (?:is )?(?:released into|in) the public domain"),
    ("SPDX", "spdx-license-identifier", r"spdx-license-identifier: ?(?P<k>[\w.+-]+)"),
]
#: (licence, identifiers), in order of preference. ``{v}`` and ``{k}`` stand for what the identifiers carry.
RULES: list[tuple[str, Sequence[str]]] = [
    ("SPDX:{k}", ("SPDX",)),
    ("Apache-{v}", ("ApacheRef", "ApacheNotUse", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs")),
    ("BSD-4-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDAdvert", "BSDEndorse", "BSDAsIs")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs")),
    ("{k}GPL-{v}-or-later", ("GPLFree", "GPLTerms", "GPLVersion", "GPLHope")),
    ("{k}GPL-{v}-or-later", ("GPLFree", "GPLTerms", "GPLVersion")),
    ("{k}GPL-{v}-only", ("GPLFree", "GPLTerms", "GPLOnly")),
    ("{k}GPL-{v}", ("GPLFree", "GPLTerms")),
    ("ISC", ("ISCGrant", "ISCAsIs")),
    ("Apache-{v}", ("ApacheRef", "ApacheNotUse")),
    ("Apache-{v}", ("ApacheRef",)),
    ("{k}GPL-{v}", ("GPLRef",)),
    ("MIT", ("MITRef",)),
    ("BSD", ("BSDRef",)),
    ("MPL-{v}", ("MPLRef",)),
    ("CC-{k}-{v}", ("CCRef",)),
    ("PublicDomain", ("PublicDomain",)),
]
KINDS = {"lesser ": "L", "library ": "L", "affero ": "A"}
CUT = re.compile(r"(?<=[.!?;:])(?<!\bv\.)(?<!license-identifier:)(?<!licence-identifier:)\s+|\n\s*\n|(?<=foundation,)\s+(?=(?:either|version)\s)", re.I)
#: Comment marks and white space at both ends of a line.
MARKS = re.compile(r"^[ \t\r/*#;%<!\-]+|[ \t\r*/>\-]+$", re.M)
QUOTES, SPACES = str.maketrans("", "", "\"'`‘’“”"), re.compile(r"\s+")
#: A sentence is tried against the patterns only if it holds the words of one of them.
NEEDS = re.compile("|".join(sorted({re.escape(needs) for _, needs, _ in SENTENCES})))
_PATTERNS = [(name, needs, re.compile(pattern)) for name, needs, pattern in SENTENCES]


def normalise(sentence: str) -> str:
    s = MARKS.sub("", sentence.lower()).translate(QUOTES)
    if "licence" in s or "©" in s:
        s = s.replace("licence", "license").replace("©", "(c)")
    return SPACES.sub(" ", s).strip(" .;:,!?")


def identify(sentence: str) -> tuple[str, dict] | None:
    """Identifier and what it carries; the first known pattern that the whole sentence fits."""
    s = normalise(sentence)
    if not NEEDS.search(s):
        return None
    for name, needs, pattern in _PATTERNS:
        if needs in s and (m := pattern.fullmatch(s)):
            return name, {k: v for k, v in m.groupdict().items() if v}
    return None


def identifiers(text: str) -> list[tuple[str, dict]]:
    """Of the known sentences, in order."""
    out = []
    for sentence in CUT.split(MARKS.sub("", text)):
        if found := identify(sentence):
            out.append(found)
        elif "\n" in sentence:
            out += [f for line in sentence.split("\n") if (f := identify(line))]
    return out


def licences(ids: list[tuple[str, dict]], rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> list[str]:
    """Licences that the identifiers spell, in order."""
    ids = [x for x in ids if x[0] not in ("Copyright", "AllRights")]
    out, at = [], 0
    while at < len(ids):
        for name, wanted in rules:
            part = ids[at : at + len(wanted)]
            if [p[0] for p in part] == list(wanted):
                carried = {"k": "", "v": "any"} | {k: v for _, c in part for k, v in c.items()}
                carried["k"] = KINDS.get(carried["k"], carried["k"].upper() if name.startswith("CC") else carried["k"])
                out.append(name.format(**carried))
                at += len(wanted)
                break
        else:
            at += 1
    return out


def scan(docs: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """Per row: doc_id, identifiers and licences (arrays of string, in order), n_copyright."""
    bounded_batches(docs.sparkSession)
    rules = list(rules)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [identifiers(t.decode()) for t in texts_of(batch)]
            made = [pa.array([[i for i, _ in f] for f in found], pa.list_(pa.string())), pa.array([licences(f, rules) for f in found], pa.list_(pa.string()))]
            count = pa.array([sum(i == "Copyright" for i, _ in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *made, count], ["doc_id", "identifiers", "licences", "n_copyright"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, identifiers array<string>, licences array<string>, n_copyright long")
