r"""License scans: ordered signature rules over normalised words.

Rules are regexes over a text's lower-cased words joined by single spaces: the sentences
of TEXTS and the hand-written FAMILIES in the TEMPLATES below (some hundreds). A rule is
tried only if one of its gate keywords begins a word of the text. Behind an SPDX marker
the expression is read identifier by identifier. Detections are resolved
in the order of priority, then length, then place, then rule: one that lies inside an
accepted interval is suppressed (lying inside any earlier one is the same, as that one
lies in an accepted one itself). Per rule, the work is in proportion to the text, and
n detections are resolved in n log n steps. Rows are looked at alone, whole, in Arrow
batches; nothing is shuffled.

Cases: null or empty text has no words and no detections (score 0); nulls and extra
columns pass through; repeated rows give repeated results; an empty table gives none;
input columns named like an output column go on as ``<name>_in``.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelwork.llm.common import apart, bounded, extended, tidy
from wheelwork.llm.words import column_bytes, with_columns, words_of

#: Phrases that are always reported, each place of them. Fixed values.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: label, gate keywords (any of them, with |, must begin a word), name, version (None: has none). In natural order by group.
FAMILIES = [
    ("gpl-1", "gnu", "gnu general public", "1(?: 0)?"),
    ("gpl-2", "gnu", "gnu general public", "2(?: 0)?"),
    ("gpl-3", "gnu", "gnu general public", "3(?: 0)?"),
    ("lgpl-2", "lesser", "gnu lesser general public", "2(?: 0)?"),
    ("lgpl-2.1", "lesser", "gnu lesser general public", "2 1"),
    ("lgpl-3", "lesser", "gnu lesser general public", "3(?: 0)?"),
    ("agpl-3", "affero", "gnu affero general public", "3(?: 0)?"),
    ("gfdl-1.2", "documentation", "gnu free documentation", "1 2"),
    ("gfdl-1.3", "documentation", "gnu free documentation", "1 3"),
    ("apache-1.1", "apache", "apache(?: software)?", "1 1"),
    ("apache-2", "apache", "apache(?: software)?", "2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public", "1 1"),
    ("mpl-2", "mozilla", "mozilla public", "2(?: 0)?"),
    ("epl-1", "eclipse", "eclipse public", "1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public", "2(?: 0)?"),
    ("eupl-1.2", "union", "european union public", "1 2"),
    ("cddl-1", "distribution", "common development and distribution", "1(?: 0)?"),
    ("osl-3", "open", "open software", "3(?: 0)?"),
    ("afl-3", "academic", "academic free", "3(?: 0)?"),
    ("artistic-1", "artistic", "artistic", "1(?: 0)?"),
    ("artistic-2", "artistic", "artistic", "2(?: 0)?"),
    ("odbl-1", "database", "open database", "1(?: 0)?"),
    ("ogl-3", "government", "open government", "3(?: 0)?"),
    ("bsl-1", "boost", "boost software", "1(?: 0)?"),
    ("busl-1.1", "business", "business source", "1 1"),
    ("sspl-1", "server", "server side public", "1(?: 0)?"),
    ("cecill-2", "cecill", "cecill(?: free software)?", "2(?: 1| 0)?"),
    ("ofl-1.1", "font", "sil open font", "1 1"),
    ("python-2", "python", "python(?: software foundation)?", "2(?: 0)?"),
    ("php-3", "php", "php", "3(?: 0| 01)?"),
    ("zpl-2", "zope", "zope public", "2(?: 1| 0)?"),
    ("lppl-1.3", "latex", "latex project public", "1 3c?"),
    ("mit", "mit", "mit", None),
    ("isc", "isc", "isc", None),
    ("zlib", "zlib", "zlib", None),
    ("wtfpl", "wtf", "(?:do )?wtf(?:pl)?(?: public)?", None),
    ("unlicense", "unlicense", "unlicense", None),
    ("bsd-2", "bsd", "(?:2 clause|simplified) bsd|bsd 2 clause", None),
    ("bsd-3", "bsd", "(?:3 clause|new|modified) bsd|bsd 3 clause", None),
    ("bsd-4", "bsd", "(?:4 clause|original) bsd|bsd 4 clause", None),
    ("ms-pl", "microsoft", "microsoft public", None),
    ("ms-rl", "microsoft", "microsoft reciprocal", None),
    ("ncsa", "ncsa", "university of illinois ncsa open source", None),
    ("postgresql", "postgresql", "postgresql", None),
    ("cc-by", "cc|creative", "(?:cc|creative commons) (?:by|attribution)(?! (?:nc|nd|sa|noncommercial|noderivatives|sharealike))", "(?:[1-4] [05])"),
    ("cc-by-sa", "cc|creative", "(?:cc|creative commons) (?:by|attribution) (?:sa|sharealike)", "(?:[1-4] [05])"),
    ("cc-by-nd", "cc|creative", "(?:cc|creative commons) (?:by|attribution) (?:nd|noderivatives)", "(?:[1-4] [05])"),
    ("cc-by-nc", "cc|creative", "(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial)(?! (?:nd|sa|noderivatives|sharealike))", "(?:[1-4] [05])"),
    ("cc-by-nc-sa", "cc|creative", "(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial) (?:sa|sharealike)", "(?:[1-4] [05])"),
    ("cc-by-nc-nd", "cc|creative", "(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial) (?:nd|noderivatives)", "(?:[1-4] [05])"),
    ("cc0", "cc0", "cc0", "(?:1 0)"),
]
GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|shared) (?:solely )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
#: priority, pattern of {name} and {version}; {version} makes it one for versioned families.
TEMPLATES = [
    (95, GRANT + "(?:{name})(?: licen[sc]e)? (?:version |v )?v?{version}"),
    (90, "(?:subject to|governed by|covered by) (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[sc]e)? (?:version |v )?v?{version}"),
    (85, "(?:{name}) licen[sc]e,? (?:version |v )?v?{version}"),
    (80, "(?:{name}) (?:version |v )?v?{version}"),
    (75, GRANT + "(?:{name})(?: licen[sc]e)?"),
    (70, "(?:see|read|copy of|text of) the (?:{name}) licen[sc]e"),
    (65, "licen[sc]e (?:name |identifier |type )?(?:is )?(?:the )?(?:{name})(?: licen[sc]e)"),
    (60, "(?:{name}) licen[sc]e"),
]
#: Short names and their versions, written as one word or several (gplv3, gpl v3, GPL-3.0), with what may follow a version and the label's end.
SHORT = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2.1", "3"), "agpl": ("1", "3"), "mpl": ("1.1", "2"), "epl": ("1", "2"), "eupl": ("1.1", "1.2"), "cddl": ("1",), "osl": ("3",), "afl": ("3",), "gfdl": ("1.2", "1.3"), "sspl": ("1",), "bsl": ("1",), "odbl": ("1",)}
AFTER = [(82, "", ""), (83, "-only", " only"), (83, "-or-later", "(?: |plus )or (?:any )?later(?: version)?"), (83, "-or-later", " or (?:at your option )?any later version")]
#: Identifiers of expressions behind "SPDX-License-Identifier", as words; fixed values. Versioned GNU ones are made of SHORT.
SPDX = {
    "mit": "mit", "mit 0": "mit-0", "isc": "isc", "zlib": "zlib", "0bsd": "0bsd", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "bsd 4 clause": "bsd-4", "unlicense": "unlicense", "wtfpl": "wtfpl", "json": "json",
    "beerware": "beerware", "ncsa": "ncsa", "postgresql": "postgresql", "ms pl": "ms-pl", "ms rl": "ms-rl", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2", "artistic 1 0": "artistic-1", "artistic 2 0": "artistic-2",
    "ofl 1 1": "ofl-1.1", "python 2 0": "python-2", "psf 2 0": "python-2", "php 3 01": "php-3", "php 3 0": "php-3", "zpl 2 1": "zpl-2", "zpl 2 0": "zpl-2", "lppl 1 3c": "lppl-1.3", "busl 1 1": "busl-1.1", "cecill 2 1": "cecill-2",
    "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by 3 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by sa 3 0": "cc-by-sa", "cc by nd 4 0": "cc-by-nd", "cc by nc 4 0": "cc-by-nc", "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nc nd 4 0": "cc-by-nc-nd",
    "classpath exception 2 0": "classpath-exception", "gcc exception 3 1": "gcc-exception", "gcc exception 2 0": "gcc-exception", "llvm exception": "llvm-exception", "linux syscall note": "syscall-note",
    "autoconf exception 3 0": "autoconf-exception", "bison exception 2 2": "bison-exception", "font exception 2 0": "font-exception",
}
SPDX_MARK, SPDX_RANK, SPDX_LONGEST = b" spdx license identifier ", 84, 7
#: priority, label, gate keyword, pattern: texts known by their wording.
TEXTS = [
    (100, "mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    (100, "mit", "notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (100, "mit-0", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    (100, "isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    (100, "0bsd", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    (100, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    (100, "bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (100, "bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    (100, "bsd-3", "neither", "neither the name of (?:the )?(?:[0-9a-z]+ ){1,8}nor the names of (?:its|any|the) contributors may be used to endorse or promote products derived from this software"),
    (100, "bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (100, "gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    (100, "gpl-2-or-later", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    (100, "gpl-3-or-later", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    (100, "gpl-2-only", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    (100, "lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (100, "agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    (100, "gpl", "received", "you should have received a copy of the gnu general public license along with this program"),
    (100, "lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    (100, "agpl", "received", "you should have received a copy of the gnu affero general public license"),
    (100, "gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (100, "apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this (?:file|work|software) except in compliance with the license"),
    (100, "apache-2", "apache", "you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0"),
    (100, "apache-2", "basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    (100, "apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    (100, "mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (100, "mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    (100, "epl-1", "eclipse", "made available under the terms of the eclipse public license v1 0"),
    (100, "epl-2", "eclipse", "made available under the terms of the eclipse public license (?:v )?2 0"),
    (100, "cddl-1", "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    (100, "bsl-1", "boost", "distributed under the boost software license version 1 0"),
    (100, "zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (100, "zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (100, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (100, "unlicense", "dedicate", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    (100, "wtfpl", "just", "you just do what the f[a-z]* you want to"),
    (100, "cc0", "waived", "to the extent possible under law (?:[0-9a-z]+ ){1,12}(?:has|have) waived all copyright and related or neighbou?ring rights"),
    (100, "cc-by", "creative", "this work is licensed under (?:a|the) creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic) license"),
    (100, "cc-by-sa", "creative", "this work is licensed under (?:a|the) creative commons attribution share ?alike (?:[1-4] [05] )?(?:international|unported|generic) license"),
    (100, "cc-by-nc", "creative", "this work is licensed under (?:a|the) creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international|unported|generic) license"),
    (100, "cc-by-nc-sa", "creative", "this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike (?:[1-4] [05] )?(?:international|unported|generic) license"),
    (100, "cc-by-nc-nd", "creative", "this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1-4] [05] )?(?:international|unported|generic) license"),
    (100, "python-2", "psf", "this license agreement is between the python software foundation psf and the individual or organization"),
    (100, "ofl-1.1", "sil", "this font software is licensed under the sil open font license version 1 1"),
    (100, "odbl-1", "database", "made available under the open database license"),
    (100, "beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    (100, "json", "evil", "the software shall be used for good not evil"),
    (55, "spdx", "spdx", "spdx license identifier [0-9a-z]+(?: [0-9a-z]+)?"),
    (56, "spdx-choice", "spdx", "spdx license identifier (?:[0-9a-z]+ ){1,6}or [0-9a-z]+(?: [0-9a-z]+){0,5}"),
    (56, "spdx-all", "spdx", "spdx license identifier (?:[0-9a-z]+ ){1,6}and [0-9a-z]+(?: [0-9a-z]+){0,5}"),
    (56, "spdx-exception", "spdx", "spdx license identifier (?:[0-9a-z]+ ){1,6}with [0-9a-z]+(?: [0-9a-z]+){0,5} exception"),
    (50, "public-domain", "domain", "(?:in|to|into) the public domain"),
    (45, "proprietary", "reserved", "all rights reserved"),
    (45, "proprietary", "proprietary", "proprietary and confidential"),
    (40, "no-derivatives", "derivative", "no derivative works"),
    (40, "non-commercial", "commercial", "for non commercial (?:use|purposes)(?: only)?"),
    (35, "gpl", "gpl", "gpl(?:v?[123])?"),
]


@functools.lru_cache(maxsize=1)
def rules() -> list[tuple[int, str, frozenset[bytes], re.Pattern]]:
    """priority, label, gates, regex; those with an open gate are tried in this order."""
    out = [(p, label, gate, pattern) for p, label, gate, pattern in TEXTS]
    for label, gate, name, version in FAMILIES:
        for p, pattern in TEMPLATES:
            if "{version}" in pattern and version is None:
                continue
            # a family with versions names one only where the version is told
            if "{version}" not in pattern and version is not None and not label.startswith("cc"):
                continue
            out.append((p, label, gate, pattern.replace("{name}", name).replace("{version}", version or "")))
    for short, versions in SHORT.items():
        for version in versions:
            number = version.replace(".", " ") + ("" if "." in version else "(?: 0)?")
            out += [(p, f"{short}-{version}{end}", short, f"{short}(?: licen[sc]e)?(?: version)? ?v?{number}{after}") for p, end, after in AFTER]
    families = {}
    for label, gate, name, version in FAMILIES:
        if version is not None and not label.startswith("cc"):
            families.setdefault((label.rsplit("-", 1)[0], gate, name), None)
    for label, gate, name in families:  # the version left open: lower in rank
        out += [(p - 30, label, gate, pattern.replace("{name}", name)) for p, pattern in TEMPLATES if "{version}" not in pattern]
    return [(p, label, frozenset(gate.encode().split(b"|")), re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")) for p, label, gate, pattern in out]


@functools.lru_cache(maxsize=1)
def gates() -> list[bytes]:
    return list(dict.fromkeys(g for _, _, several, _ in rules() for g in sorted(several)))


@functools.lru_cache(maxsize=1)
def identifiers() -> dict[tuple[bytes, ...], str]:
    """Words of an identifier and its label."""
    out = {tuple(k.encode().split()): v for k, v in SPDX.items()}
    for short, versions in SHORT.items():
        for version in versions:
            number = version.replace(".", " ") if "." in version else f"{version} 0"
            for end, after in (("", ""), ("-only", " only"), ("-or-later", " or later"), ("-or-later", " +")):
                out[tuple(f"{short} {number}{after}".encode().split())] = f"{short}-{version}{end}"
    return out


def expression(words: list[bytes], at: int) -> list[tuple[str, int, int]]:
    """label, first, end of the identifiers of an expression that begins at a word, joined by or, and, with; brackets are no words."""
    known, out = identifiers(), []
    while at < len(words):
        for n in range(min(SPDX_LONGEST, len(words) - at), 0, -1):
            if label := known.get(tuple(words[at : at + n])):
                out.append((label, at, at + n))
                at += n
                break
        else:
            return out
        if at >= len(words) or words[at] not in (b"or", b"and", b"with"):
            return out
        at += 1
    return out


def detect(words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int]]]:
    """Base places (label, first word) and resolved detections (label, first, end, priority)."""
    text = b" " + b" ".join(words) + b" "
    begins = list(itertools.accumulate((len(w) + 1 for w in words), initial=1))  # of each word, and past the last one
    word_at = lambda place: bisect.bisect_left(begins, place)
    base = []
    for phrase, label in BASE:
        at = text.find(pat := b" " + phrase.encode() + b" ")
        while at >= 0:
            base.append((label, word_at(at + 1)))
            at = text.find(pat, at + 1)
    open_gates = {g for g in gates() if b" " + g in text}
    found = []
    if open_gates:
        for k, (p, label, several, rx) in enumerate(rules()):
            if not several.isdisjoint(open_gates):
                for m in rx.finditer(text):
                    found.append((-p, m.start() - m.end(), word_at(m.start()), k, label, word_at(m.end() + 1)))
    at = text.find(SPDX_MARK)
    while at >= 0:
        # behind all rules in order, so their places among equals stay
        found += [(-SPDX_RANK, first - end, first, len(rules()), label, end) for label, first, end in expression(words, word_at(at + len(SPDX_MARK)))]
        at = text.find(SPDX_MARK, at + 1)
    kept: list[tuple[str, int, int, int]] = []
    reach = Reach(sorted({f[2] for f in found}))
    for p, _, first, _, label, end in sorted(found):
        if reach.of(first) < end:
            kept.append((label, first, end, -p))
        reach.add(first, end)
    return base, sorted(kept, key=lambda d: (d[1], d[2], d[0]))


class Reach:
    """The furthest end of the intervals so far that begin at a place or before (a tree of partial maxima)."""

    def __init__(self, begins: list[int]):
        self.begins, self.tree = begins, [-1] * (len(begins) + 1)

    def add(self, first: int, end: int) -> None:
        i = bisect.bisect_left(self.begins, first) + 1
        while i < len(self.tree):
            self.tree[i] = max(self.tree[i], end)
            i += i & -i

    def of(self, first: int) -> int:
        i, out = bisect.bisect_right(self.begins, first), -1
        while i:
            out = max(out, self.tree[i])
            i -= i & -i
        return out


def score(base: list, found: list) -> float:
    """One less the product of what each place leaves in doubt: 0 without any."""
    doubt = 1.0
    for p in [80] * len(base) + [d[3] for d in found]:
        doubt *= 1 - p / 101
    return 1 - doubt


DETECTION = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))
OUTPUT = {
    "n_words": "bigint", "base": "array<struct<label:string,first:bigint>>",
    "detections": "array<struct<label:string,first:bigint,end:bigint,priority:int>>", "score": "double",
}


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with n_words, base places, detections and score."""
    bounded(docs.sparkSession)
    docs = apart(docs, list(OUTPUT))

    @tidy
    def run(batches):
        for batch in batches:
            n, base, found, scores = [], [], [], []
            for text in column_bytes(batch, text_column):
                words = words_of(text)
                b, d = detect(words) if words else ([], [])
                n.append(len(words))
                base.append([{"label": x, "first": at} for x, at in b])
                found.append([dict(zip(("label", "first", "end", "priority"), x, strict=True)) for x in d])
                scores.append(score(b, d))
            yield with_columns(batch, [], {
                "n_words": pa.array(n, pa.int64()), "base": pa.array(base, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))),
                "detections": pa.array(found, DETECTION), "score": pa.array(scores, pa.float64()),
            })

    return docs.mapInArrow(run, extended(docs, OUTPUT))


def op2_license_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs)
    places, labels = F.transform("base", lambda b: b["first"]), F.transform("base", lambda b: b["label"])
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, F.transform("detections", lambda d: d["label"])))), ",").alias("labels"),
        "score",
    )
