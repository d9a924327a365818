"""Licence recognition by sentence rules: known sentences become ids, ordered rules match id sequences.

A text is cut after ``.``, ``!`` or ``?`` before white space, and at lines without a letter a-z or digit.
What is between are one or more lines; a sentence is a line or several that follow each other, so
hard-wrapped texts are read like those on one line, and where several known ones begin at a line, the
longest counts.  Sentences are normalised: lower-case a-z and 0-9 words, one spelling of license and of
version numbers, and of "This module is released under the terms of the X" only "under x" stays, unless
the words before say "not".  Known sentences map to ids, others are passed over.  A rule is a sequence of
ids that must stand next to each other in a text's sequence, in order; a licence is named if one of its
rules holds and no licence that is more exact (``EXACTER``) is named.

Texts are judged one by one in Arrow batches, so nothing is shuffled; only what holds a word of some known
sentence is cut up.  ``ORACLE_SQL`` knows sentences on one line only: it gives the same rows where a text
has no wrapped ones.

Cases: a null or empty text has no sentence and no licence; repeated rows are judged each on its own; an
empty table gives an empty result; long texts are judged whole; other input columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import read_table
from .text import as_bytes
from .tokens import slices

#: Licences with the names that notices give them, in normal form.
NAMES = {
    "mit": ["mit license", "mit", "expat license", "mit x11 license"],
    "apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license version 2 0 the license", "asl 2 0", "apache software license version 2 0"],
    "bsd-2-clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause simplified license", "freebsd license"],
    "bsd-3-clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause new or revised license"],
    "bsd": ["bsd license", "bsd style license"],
    "isc": ["isc license", "isc"],
    "mpl-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0", "mpl version 2 0"],
    "epl-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"],
    "epl-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0", "epl 1 0"],
    "cddl-1.0": ["common development and distribution license version 1 0", "common development and distribution license", "cddl 1 0", "cddl"],
    "bsl-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license"],
    "zlib": ["zlib license", "zlib libpng license", "zlib"],
    "unlicense": ["unlicense", "unlicense license"],
    "wtfpl": ["wtfpl", "wtfpl version 2", "do what the fuck you want to public license"],
    "artistic-2.0": ["artistic license version 2 0", "artistic license 2 0"],
    "cc0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero", "creative commons cc0 license", "creative commons zero version 1 0 universal license"],
    "ofl-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "open font license version 1 1"],
    "psf-2.0": ["python software foundation license version 2", "python software foundation license", "psf license"],
    "postgresql": ["postgresql license"],
    "eupl-1.2": ["european union public license version 1 2", "eupl 1 2", "eupl version 1 2"],
}
_GNU = {"gpl": "general", "lgpl": "lesser general", "agpl": "affero general"}
for _short, _kind in _GNU.items():
    for _v in {"gpl": "2 3", "lgpl": "2.1 3", "agpl": "3"}[_short].split():
        _n = _v.replace(".", " ")
        NAMES[f"{_short}-{_v}" if "." in _v else f"{_short}-{_v}.0"] = [
            *(f"{_g}{_kind} public license{_m}{_n}{_z}" for _g in ("gnu ", "") for _m in (" version ", " ") for _z in ("", " 0", " only")),
            *(f"{_g}{_short}{_m}{_n}{_z}" for _g in ("gnu ", "") for _m in (" version ", "version ", " ", "v") for _z in ("", " 0", " license")),
        ]
        NAMES[f"{_short}-{_v if '.' in _v else _v + '.0'}-or-later"] = [
            f"{x}{_l}" for x in NAMES[f"{_short}-{_v if '.' in _v else _v + '.0'}"] if not x.endswith("only") for _l in (" or later", " or any later version", " or at your option any later version")
        ]
_PARTS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
for _short, _long in _PARTS.items():
    for _v in ("3 0", "4 0"):
        _s = _short.replace("-", " ")
        NAMES[f"cc-{_short}-{_v.replace(' ', '.')}"] = [
            f"cc {_s} {_v}", f"cc {_s} {_v} license", f"creative commons {_s} {_v}", f"creative commons {_s} {_v} license",
            *(f"creative commons {x}{w} license" for x in {_long, _long.replace("sharealike", "share alike").replace("noncommercial", "non commercial")} for w in (f" {_v} international", f" {_v}", f" {_v} unported", f" version {_v}")),
        ]

#: Sentences of licence texts and notices in normal form, by id; ids of 100 and more stand for "under" a licence, 500 and more for its SPDX line.
SENTENCES = {
    7: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    8: "the software is provided as is without warranty of any kind express or implied",
    9: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    10: "you may not use this file except in compliance with the license",
    11: "all rights reserved",
    12: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    13: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    14: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    15: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    16: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    17: "you may obtain a copy of the license at",
    18: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    19: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    20: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    21: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    22: "this software is provided as is without any express or implied warranty",
    23: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    24: "this is free and unencumbered software released into the public domain",
    25: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    26: "this source code form is subject to the terms of the mozilla public license version 2 0",
    27: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    28: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    29: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    30: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
}
_ID = {name: 100 + k for k, name in enumerate(NAMES)} | {"mit": 1, "apache-2.0": 2, "gpl-3.0": 3, "gpl-2.0": 4, "cc-by-nc-4.0": 5, "cc-by-4.0": 6}
_SPDX = {name: 500 + k for k, name in enumerate(NAMES)}
_GRANT = f"{SENTENCES[7]} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_AS_IS = f"{SENTENCES[8]} including but not limited to the warranties of merchantability fitness for a particular purpose and"
_FSF = "as published by the free software foundation"
#: Other forms of known sentences, and the ids they stand for.
VARIANTS = {s: str(i) for i, s in SENTENCES.items()}
VARIANTS |= {f"{w}{x}": str(_ID[name]) for name, xs in NAMES.items() for x in xs for w in ("under ", "", "the ") if w == "under " or "license" in x}
VARIANTS |= {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', name)}{w}": str(_SPDX[name]) for name in NAMES for w in ("", " only") if "later" not in name or not w}
VARIANTS |= {
    f"{_AS_IS} noninfringement": "8",
    f"{_AS_IS} non infringement": "8",
    f"{SENTENCES[9]} 1": "9",
    f"{SENTENCES[9]} {SENTENCES[14]}": "9 14",
    f"1 {SENTENCES[14]}": "14",
    f"2 {SENTENCES[15]}": "15",
    f"3 {SENTENCES[16]}": "16",
    "apache license version 2 0 january 2004": "2",
    "apache license version 2 0 january 2004 http www apache org licenses": "2",
    "gnu general public license version 2 june 1991": "4",
    "gnu general public license version 3 29 june 2007": "3",
    "gnu lesser general public license version 3 29 june 2007": str(_ID["lgpl-3.0"]),
    "gnu lesser general public license version 2 1 february 1999": str(_ID["lgpl-2.1"]),
    "gnu affero general public license version 3 19 november 2007": str(_ID["agpl-3.0"]),
    "mozilla public license version 2 0": str(_ID["mpl-2.0"]),
    "boost software license version 1 0 august 17th 2003": str(_ID["bsl-1.0"]),
    f"{SENTENCES[17]} http www apache org licenses license 2 0": "17",
    f"under apache license version 2 0 the license {SENTENCES[10]}": "2 10",
}
#: Those that also stand after other words, as a title and a copyright line are no sentences.
AFTER_TITLES = {_GRANT: "7", f"{_GRANT} {SENTENCES[12]}": "7 12", f"licensed under the apache license version 2 0 the license {SENTENCES[10]}": "2 10", SENTENCES[20]: "20"}
for _short, _kind in _GNU.items():
    _what = "library" if _short == "lgpl" else "program"
    for _v in ("2", "2 1", "3"):
        _name = f"{_short}-{_v.replace(' ', '.')}" + ("" if " " in _v else ".0")
        if _name in NAMES:
            _start = f"this {_what} is free software you can redistribute it and or modify it under the terms of the gnu {_kind} public license"
            for _terms in (
                f"{_FSF} either version {_v} of the license or at your option any later version", f"{_FSF} version {_v} of the license",
                f"{_FSF} version {_v}", f"version {_v} {_FSF}",
            ):
                AFTER_TITLES[f"{_start} {_terms}"] = str(_ID[_name])
#: Licence and the sentence ids that prove it, in order.
RULES = [
    *((name, [i]) for name, i in _ID.items()), *((name, [i]) for name, i in _SPDX.items()),
    ("apache-2.0", [2, 10]), ("apache-2.0", [2, 10, 17]), ("apache-2.0", [10, 17]), ("bsd", [11, 9]), ("bsd", [9]), ("bsd-2-clause", [9, 14, 15]), ("bsd-3-clause", [9, 14, 15, 16]),
    ("isc", [20, 21]), ("mit", [7, 8]), ("mit", [7, 12, 8]), ("zlib", [22, 23]), ("unlicense", [24]), ("unlicense", [24, 25]), ("mpl-2.0", [26]), ("mpl-2.0", [26, 27]),
    ("epl-2.0", [28]), ("cc0-1.0", [29]), ("bsl-1.0", [30]), ("reserved", [11]),
    *((f"{s}-{v}", [_ID[f"{s}-{v}"], w]) for s, v, w in (("gpl", "2.0", 18), ("gpl", "3.0", 18), ("agpl", "3.0", 18), ("lgpl", "2.1", 19), ("lgpl", "3.0", 19))),
]
#: A licence that is not named where a more exact one is.
EXACTER = {"bsd": ["bsd-2-clause", "bsd-3-clause"], "bsd-2-clause": ["bsd-3-clause"]}
_END = "\x01"
_V = re.compile(r"(?a)\bv\.[\x20\x09]+([0-9])")
_ENDS = re.compile(r"[.!?][\x20\x09-\x0D]+")
_OTHER = re.compile(rf"[^a-z0-9\n{_END}]+")
_CUT = re.compile(rf" ?(?:{_END}|\n ?\n)[ \n{_END}]*")
#: Every known sentence has one of these letters in it.
_SIGNS = re.compile(rb"(?i)licen|rights|permi|warrant|redist|copyright|distribut|public[^a-z0-9]+domain|liable|endorse|compiled|mozilla|law|spdx|(?:released|available|published|provided|covered|shared|software)[^a-z0-9]+under")
_VERBS = "(?:licensed|released|distributed|available|published|provided|covered|shared|free software)"
_UNDER = re.compile(rf"^((?:[a-z0-9]+ ){{0,8}}?){_VERBS} under (?:(?:the )?(?:terms|conditions|terms and conditions) of )?(?:the |a |an )?")
_NO = re.compile(r"\b(?:not|never|longer|unless|if|cannot)\b")
_SPELLED = [(re.compile(r"\blicence"), "license"), (re.compile(r"\b(?:version )?v ?([0-9])"), r"version \1")]


def canonical(sentence: str) -> str:
    """One form of a sentence's words; all that is said of being under a licence begins with "under"."""
    for pattern, to in _SPELLED:
        sentence = pattern.sub(to, sentence)
    m = _UNDER.match(sentence)
    return f"under {sentence[m.end():]}" if m and not _NO.search(m[1]) else sentence


KNOWN = {canonical(s): i for s, i in VARIANTS.items()}
_FIRST = {s.split()[0] for s in KNOWN}
#: No known sentence has more words than this in a text: the normal form drops twenty at most before and after "under", and one a version number.
_WORDS = 2 * max(len(s.split()) for s in KNOWN) + 20


def sentence_ids(raw: bytes) -> list[str]:
    """Ids of the known sentences of a text, in order."""
    if not _SIGNS.search(raw):
        return []
    text = raw.lower().decode("utf-8", "replace").replace(_END, " ")
    out: list[str] = []
    for segment in _CUT.split(_OTHER.sub(" ", _ENDS.sub(_END, _V.sub(r"v \1", text)))):
        if not _SIGNS.search(segment.encode()):
            continue
        lines = [x for x in (x.strip() for x in segment.split("\n")) if x]
        out += _in_lines(lines)
    return out


def _in_lines(lines: list[str]) -> list[str]:
    """Ids of the known sentences made of whole lines, and of those after titles."""
    ends, at = [], 0
    for x in lines:
        at += len(x) + 1
        ends.append(at - 1)
    whole = " ".join(lines)
    taken: list[tuple[int, int, str]] = []
    for s in sorted(AFTER_TITLES, key=len, reverse=True):
        at = whole.find(s)
        while at >= 0:
            end = at + len(s)
            if (not at or whole[at - 1] == " ") and end in ends and all(end <= a or b <= at for a, b, _ in taken):
                taken.append((at, end, AFTER_TITLES[s]))
            at = whole.find(s, at + 1)
    words = list(accumulate(len(x.split()) for x in lines))
    k = 0
    while k < len(lines):
        lo = ends[k] - len(lines[k])
        last = max(k + 1, bisect_right(words, (words[k - 1] if k else 0) + _WORDS))
        start = canonical(whole[lo : ends[last - 1]])
        if start.split(None, 1)[0] not in _FIRST and canonical(lines[k]).split(None, 1)[0] not in _FIRST:
            k += 1
            continue
        for j in range(last, k, -1):
            if any(a < ends[j - 1] and lo < b for a, b, _ in taken):
                continue
            got = KNOWN.get(canonical(whole[lo : ends[j - 1]]))
            if got:
                taken.append((lo, ends[j - 1], got))
                k = j - 1
                break
        k += 1
    return [i for _, _, ids in sorted(taken) for i in ids.split()]


_BY_NAME: dict[str, list[str]] = {}
for _name, _seq in sorted(RULES):
    _BY_NAME.setdefault(_name, []).append(f" {' '.join(map(str, _seq))} ")


def licences_of(ids: list[str]) -> list[str]:
    """Licences that a sequence of ids proves, in order of their names."""
    held = f" {' '.join(ids)} "
    names = [n for n, rules in _BY_NAME.items() if any(r in held for r in rules)] if ids else []
    return [n for n in names if not any(x in names for x in EXACTER.get(n, []))]


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences`` (known ones), ``sentence_ids`` and ``licences`` (comma-separated, in order of names)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = [sentence_ids(x) for x in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([" ".join(x) for x in ids]), pa.array([",".join(licences_of(x)) for x in ids])],
                ["doc_id", "n_sentences", "sentence_ids", "licences"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, n_sentences long, sentence_ids string, licences string")


def op8_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rules over sentences that are one line each."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    known = ", ".join(f"('{s}', '{i}', {len(i.split())})" for s, i in KNOWN.items())
    when = ", ".join(f"CASE WHEN {' OR '.join(f"contains(held, '{r}')" for r in rules)} THEN '{n}' END" for n, rules in _BY_NAME.items())
    hidden = " ".join(f"WHEN n = '{n}' THEN NOT list_has_any(names, {xs})" for n, xs in EXACTER.items())
    under = _UNDER.pattern.replace("{0,8}?", "{0,8}")
    spelled = "s"
    for pattern, to in _SPELLED:
        spelled = f"regexp_replace({spelled}, '{pattern.pattern}', '{to}', 'g')"
    return rf"""
WITH k(s, id, n) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{upper}', '{lower}'), '\bv\.[\x20\x09]+([0-9])', 'v \1', 'g'), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS ls FROM documents),
u AS (SELECT r, i, trim(regexp_replace(ls[i], '[^a-z0-9]+', ' ', 'g')) AS s FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
v AS (SELECT r, i, {spelled} AS s FROM u),
c AS (SELECT r, i, CASE WHEN regexp_matches(s, '{under}') AND NOT regexp_matches(regexp_extract(s, '{under}', 1), '{_NO.pattern}')
      THEN 'under ' || regexp_replace(s, '{under}', '') ELSE s END AS s FROM v),
m AS (SELECT r, sum(n) AS n, string_agg(id, ' ' ORDER BY i) AS ids FROM c JOIN k USING (s) GROUP BY r),
x AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, ' ' || coalesce(ids, '') || ' ' AS held FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, list_filter([{when}], lambda n: n IS NOT NULL) AS names FROM x)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_filter(names, lambda n: CASE {hidden} ELSE true END), ',') AS licences FROM y
"""


ORACLE_SQL = _sql()
