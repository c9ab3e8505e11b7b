"""License scans: sentence-rule recognition.

A text is cut into sentences (after ``.``, ``!`` or ``?`` before white space, and at
line ends); a sentence is normalised to its lower-cased alphanumeric words, so
comment marks do not count.  Known licence sentences have identifiers, any other
sentence has none.  A known sentence may run over several lines and cuts of its
paragraph, and also begins or ends at a colon; the longest that fits is taken.  The
sequence of identifiers, in which unknown sentences part the known ones (copyright
lines and list marks do not), is matched against ordered rules: a rule is a licence
and a run of identifiers, earlier rules win where two could begin at the same
sentence, and matches do not overlap.

One pass over whole texts with a fixed small table; nothing is shuffled.

Edge cases: null, empty and word-free texts have no sentences and no licence;
sentences without words are not counted and part nothing; repeated sentences match
again; ids and extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import alnum_words, free_name

# Known licence sentences by identifier.
SENTENCES = {
    "mit-release": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    'and associated documentation files (the "Software"), to deal in the Software without restriction, including '
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
    "in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "Licensed under CC0 1.0.",
}

# Licence and the sentences it takes, in order of precedence.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("Apache-2.0", ("apache-grant", "apache-copy")),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-grant",)),
    ("GPL-3.0", ("gpl3-licensed",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
)

_FREE = "you can redistribute it and/or modify it under the terms of the GNU %s Public License as published by the Free Software Foundation"
_LATER = "version %s of the License, or (at your option) any later version."

#: Further licence sentences by identifier; ``<name>`` stands for any words.
MORE_SENTENCES = (
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License"),
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("gpl2-title", "GNU General Public License Version 2, June 1991"),
    ("gpl3-title", "GNU General Public License Version 3, 29 June 2007"),
    ("lgpl21-title", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("lgpl3-title", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("agpl3-title", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("gpl2-free", f"This program is free software; {_FREE % 'General'}; either {_LATER % '2'}"),
    ("lgpl21-free", f"This library is free software; {_FREE % 'Lesser General'}; either {_LATER % '2.1'}"),
    ("lgpl3-free", f"This program is free software: {_FREE % 'Lesser General'}, either {_LATER % '3'}"),
    ("lgpl3-free", f"This library is free software: {_FREE % 'Lesser General'}, either {_LATER % '3'}"),
    ("agpl3-free", f"This program is free software: {_FREE % 'Affero General'}, either {_LATER % '3'}"),
    ("mpl2-title", "Mozilla Public License Version 2.0"),
    ("mpl2-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd2-title", "BSD 2-Clause License"),
    ("bsd3-title", "BSD 3-Clause License"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
     "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-names", "Neither the name of <name> may be used to endorse or promote products derived from this software without "
     "specific prior written permission."),
    ("isc-title", "ISC License"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("boost-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
)

_BSD3 = ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")

#: Their rules, after ``RULES``.
MORE_RULES = (
    ("BSD-3-Clause", ("bsd3-title", *_BSD3)),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("BSD-2-Clause", ("bsd2-title", *_BSD3[:3])),
    ("BSD-2-Clause", _BSD3[:3]),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("ISC", ("isc-title", "isc-grant")),
    ("ISC", ("isc-title",)),
    ("ISC", ("isc-grant",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-warranty")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("boost-title",)),
)

LICENCES = "struct<n_sentences: bigint, matches: array<struct<licence: string, sentence: bigint, n: bigint>>>"
_MATCH = pa.struct([("licence", pa.string()), ("sentence", pa.int64()), ("n", pa.int64())])
_LICENCES = pa.struct([("n_sentences", pa.int64()), ("matches", pa.list_(_MATCH))])
_BREAK = re.compile(r"([.!?][ \t]+|[\r\n]+)")
_COLON = re.compile(r":(?=[ \t])")
#: Most words that ``<name>`` stands for.
NAME_WORDS = 20


def normalise(sentence: str) -> bytes:
    return b" ".join(alnum_words(sentence))


@dataclass(frozen=True)
class Piece:
    """A text between two cuts: its words, sentence by line cuts, line and paragraph."""

    words: list[bytes]
    sentence: int
    line: int
    paragraph: int


def pieces(text: str) -> tuple[list[Piece], int]:
    """Pieces of a text that have words, and the number of its sentences by line cuts."""
    out, sentence, line, paragraph, empty = [], 0, 0, 0, True
    for i, part in enumerate(_BREAK.split(text)):
        if i % 2:
            if part[0] in "\r\n":
                paragraph += empty or len(part.replace("\r\n", "\n")) > 1
                line, empty = line + 1, True
            continue
        found = [Piece(w, sentence, line, paragraph) for w in map(alnum_words, _COLON.split(part)) if w]
        if found:
            out += found
            sentence, empty = sentence + 1, False
    return out, sentence


class Recogniser:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES, more_sentences=MORE_SENTENCES, more_rules=MORE_RULES):
        self.heads: dict[bytes, list] = {}
        for name, sentence in [*sentences.items(), *more_sentences]:
            head, any_name, tail = sentence.partition("<name>")
            known = (alnum_words(head), NAME_WORDS if any_name else 0, alnum_words(tail), name)
            self.heads.setdefault(known[0][0], []).append(known)
        for known in self.heads.values():
            known.sort(key=lambda k: -len(k[0]) - len(k[2]))
        self.by_first: dict[str, list] = {}
        for licence, run in (*rules, *more_rules):
            self.by_first.setdefault(run[0], []).append((licence, run))

    def known_at(self, found: list[Piece], i: int) -> tuple[str, int] | None:
        """The longest known sentence that begins with a piece, and the piece after it."""
        for head, spare, tail, name in self.heads.get(found[i].words[0], ()):
            words, j, most = [], i, len(head) + spare + len(tail)
            while j < len(found) and found[j].paragraph == found[i].paragraph and len(words) < most:
                words, j = words + found[j].words, j + 1
                if words[: len(head)] != head[: len(words)]:
                    break
                middle = len(words) - len(head) - len(tail)
                if 0 <= middle <= spare and words[len(head) + middle :] == tail:
                    return name, j
        return None

    def identified(self, found: list[Piece]) -> list[tuple[str | None, int]]:
        """Identifier (none for unknown ones) and sentence, without copyright lines and list marks."""
        out, i, copyright_line = [], 0, -1
        while i < len(found):
            piece = found[i]
            if known := self.known_at(found, i):
                out.append((known[0], piece.sentence))
                i = known[1]
                continue
            if piece.words[0] == b"copyright" or piece.words[:3] == [b"all", b"rights", b"reserved"]:
                copyright_line = piece.line
            mark = len(piece.words) == 1 and (piece.words[0].isdigit() or len(piece.words[0]) == 1)
            if piece.line != copyright_line and not mark:
                out.append((None, piece.sentence))
            i += 1
        return out

    def scan(self, text: str | None) -> dict:
        found, n_sentences = pieces(text or "")
        told = self.identified(found)
        names = [name for name, _ in told]
        matches, i = [], 0
        while i < len(names):
            for licence, run in self.by_first.get(names[i], ()):
                if tuple(names[i : i + len(run)]) == run:
                    matches.append({"licence": licence, "sentence": told[i][1], "n": len(run)})
                    i += len(run) - 1
                    break
            i += 1
        return {"n_sentences": n_sentences, "matches": matches}


def find_licences(
    docs: DataFrame, text_col: str = "text", sentences=SENTENCES, rules=RULES, result: str = "licences"
) -> tuple[DataFrame, str]:
    """The documents with one more column of type ``LICENCES``, and that column's name."""

    @F.arrow_udf(LICENCES)
    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        recogniser = Recogniser(sentences, rules)
        for texts in it:
            yield pa.array([recogniser.scan(t.as_py()) for t in texts], _LICENCES)

    name = free_name(docs, result)
    return docs.withColumn(name, scan(F.col(text_col))), name
