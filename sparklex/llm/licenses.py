"""License scan with a positional index of rare words.

Templates are licence notices with mandatory key phrases at known word positions.
Document frequencies of all their words are counted over the whole corpus; each
template is posted under the highest-IDF words of its key phrases only.  A file's
occurrences of posted words are looked up, the postings of each template are
intersected by relative position, and an alignment at which all its rare words agree
is verified: every key phrase must stand within ``slack`` words of its place.  A
template's rare words lie inside its key phrases, so no match can be missed.

Defined results: null ids, null and empty texts match nothing; rows that share an id
are one document; a licence found several times is reported once, at its first
place; notices that contain one another are all reported; extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.text import word_hashes

MAX_TEMPLATES = 100_000  # they are held by every worker

#: name -> (notice, key phrases); a phrase's place is where the notice has it
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "MIT-notice": ("Released under the MIT License", ("under the MIT License",)),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction. The software is provided as is, without warranty of any kind.",
        ("Permission is hereby granted, free of charge", "in the Software without restriction"),
    ),
    "Apache-2.0-notice": ("Licensed under the Apache License, Version 2.0", ("under the Apache License, Version 2",)),
    "GPL-notice": ("This work is licensed under the GNU General Public License, version 3", ("under the GNU General Public License",)),
    "GPL-any-later": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("redistribute it and/or modify it", "terms of the GNU General Public License", "Free Software Foundation"),
    ),
    "CC-BY-NC-notice": ("Licensed under CC BY-NC 4.0", ("under CC BY-NC",)),
    "CC-BY-notice": ("Licensed under CC BY 4.0", ("under CC BY 4",)),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("Redistribution and use in source and binary forms", "are permitted provided that the following conditions"),
    ),
    "BSD-2-Clause-end": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer",
        ("Redistributions in binary form must reproduce the above copyright notice",),
    ),
    "BSD-3-Clause-end": (
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("nor the names of its contributors may be used to endorse or promote products derived from this software",),
    ),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable", ("without any express or implied warranty", "In no event will the authors be held liable")),
    "BSL-1.0-notice": ("Distributed under the Boost Software License, Version 1.0", ("Boost Software License",)),
    "Artistic-2.0-notice": ("under the terms of the Artistic License 2.0", ("Artistic License 2",)),
    "CDDL-notice": ("Common Development and Distribution License", ("Common Development and Distribution License",)),
    "WTFPL-notice": ("Do What The Fuck You Want To Public License", ("Do What The Fuck You Want To Public License",)),
    "OFL-notice": ("licensed under the SIL Open Font License, Version 1.1", ("SIL Open Font License",)),
    "public-domain": ("dedicated to the public domain", ("to the public domain",)),
    **{f"SPDX-{i}": (f"SPDX-License-Identifier: {i}", (f"SPDX-License-Identifier: {i}",)) for i in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0", "CC-BY-4.0", "EPL-2.0", "Unlicense", "Zlib", "BSL-1.0")},
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("Source Code Form is subject to", "Mozilla Public License"),
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("Permission to use, copy, modify, and/or distribute", "with or without fee is hereby granted"),
    ),
    "All-rights-reserved": ("All rights reserved.", ("All rights reserved",)),
    "LGPL-notice": ("GNU Lesser General Public License", ("GNU Lesser General Public License",)),
    "LGPL-2.0-notice": ("GNU Library General Public License", ("GNU Library General Public License",)),
    "AGPL-notice": ("GNU Affero General Public License", ("GNU Affero General Public License",)),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        ("free and unencumbered software released into the public domain",),
    ),
    "EPL-notice": ("Eclipse Public License", ("Eclipse Public License",)),
    "CC0-notice": ("Released under CC0 1.0", ("under CC0",)),
    "CC0": ("CC0 1.0 Universal", ("CC0 1",)),
    "CC0-long": ("Creative Commons Zero", ("Creative Commons Zero",)),
    "CC-BY-SA-notice": ("Licensed under CC BY-SA 4.0", ("under CC BY-SA",)),
    "CC-BY-ND-notice": ("Licensed under CC BY-ND 4.0", ("under CC BY-ND",)),
    "CC-BY-NC-SA-notice": ("Licensed under CC BY-NC-SA 4.0", ("under CC BY-NC-SA",)),
    "CC-BY-NC-ND-notice": ("Licensed under CC BY-NC-ND 4.0", ("under CC BY-NC-ND",)),
    **{f"CC-BY-{v}-notice": (f"Licensed under CC BY {v}", (f"under CC BY {v}",)) for v in ("1.0", "2.0", "2.5", "3.0")},
    **{f"CC-BY-{v}-long": (f"Creative Commons Attribution {v}", (f"Creative Commons Attribution {v}",)) for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
    "CC-BY-SA-long": ("Creative Commons Attribution-ShareAlike", ("Creative Commons Attribution-ShareAlike",)),
    "CC-BY-SA-spaced": ("Creative Commons Attribution-Share Alike", ("Creative Commons Attribution-Share Alike",)),
    "CC-BY-ND-long": ("Creative Commons Attribution-NoDerivatives", ("Creative Commons Attribution-NoDerivatives",)),
    "CC-BY-NC-long": ("Creative Commons Attribution-NonCommercial", ("Creative Commons Attribution-NonCommercial",)),
}


def hashed(text: str) -> np.ndarray:
    return next(word_hashes(pa.array([text])))[1]


@dataclass
class Template:
    name: str
    phrases: list[tuple[int, np.ndarray]]  # (word position in the notice, words)

    @classmethod
    def of(cls, name: str, notice: str, phrases: tuple[str, ...]) -> Template:
        words = hashed(notice)
        placed = []
        for phrase in phrases:
            own = hashed(phrase)
            at = [i for i in range(len(words) - len(own) + 1) if (words[i : i + len(own)] == own).all()]
            if not at:
                raise ValueError(f"{name}: its notice doesn't have the phrase {phrase!r}")
            placed.append((at[0], own))
        return cls(name, placed)

    def at(self, words: np.ndarray, offset: int, slack: int) -> bool:
        """Whether every key phrase stands within slack words of its place."""
        return all(any((words[i : i + len(own)] == own).all() for i in range(max(0, offset + p - slack), min(len(words) - len(own), offset + p + slack) + 1)) for p, own in self.phrases)


class Index:
    """Postings of each template's ``rare`` highest-IDF words."""

    def __init__(self, templates: list[Template], df: dict[int, int], rare: int = 3, slack: int = 4):
        self.templates, self.slack = templates, slack
        self.posted: dict[int, list[tuple[int, int, int]]] = {}
        self.needed = []
        for t, template in enumerate(templates):
            places = [(int(w), p + j) for p, own in template.phrases for j, w in enumerate(own)]
            words = sorted({w for w, _ in places}, key=lambda w: (df.get(w, 0), w))[:rare]
            self.needed.append(len(words))
            for which, w in enumerate(words):
                self.posted.setdefault(w, []).extend((t, which, p) for x, p in places if x == w)
        self.words = np.sort(np.array(list(self.posted), np.uint64))

    def scan(self, words: np.ndarray, hits: np.ndarray) -> list[tuple[int, int]]:
        """(template, offset of the first alignment), for words at whose ``hits`` posted words stand."""
        seen: dict[int, dict[int, list[int]]] = {}
        for i in hits.tolist():
            for t, which, p in self.posted[int(words[i])]:
                seen.setdefault(t, {}).setdefault(which, []).append(i - p)
        found = []
        for t, by_word in seen.items():
            if len(by_word) < self.needed[t]:
                continue
            # every rare word of a match is within slack of its place at one offset
            base, *others = (np.unique(x) for x in by_word.values())
            offsets = np.unique((base[:, None] + np.arange(-self.slack, self.slack + 1)).ravel())
            for other in others:
                at = np.searchsorted(other, offsets - self.slack)
                offsets = offsets[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= offsets + self.slack)]
            first = next((o for o in offsets.tolist() if self.templates[t].at(words, o, self.slack)), None)
            if first is not None:
                found.append((t, first))
        return found


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, tuple[str, ...]]] | DataFrame | None = None, rare: int = 3, slack: int = 4) -> DataFrame:
    """(doc_id, license, first_word): every notice of ``templates`` in every document.

    ``first_word`` is the least word offset of the notice at which all phrases stand
    within ``slack`` words of their places; it can be below 0 by as much.  Templates can
    also be a table (name, notice, phrases array) of at most MAX_TEMPLATES rows; there a
    later row of the same name takes the place of an earlier one.
    """
    templates = TEMPLATES if templates is None else templates
    if isinstance(templates, DataFrame):
        rows = templates.select("name", "notice", "phrases").where("name is not null and notice is not null and size(phrases) > 0").orderBy("name", "notice").limit(MAX_TEMPLATES + 1).collect()
        if len(rows) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        templates = {r["name"]: (r["notice"], tuple(r["phrases"])) for r in rows}
    made = [Template.of(name, *t) for name, t in sorted(templates.items())]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    vocabulary = np.unique(np.concatenate([w for t in made for _, w in t.phrases] or [np.zeros(0, np.uint64)]))

    @F.arrow_udf("array<bigint>")
    def known(texts: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for _, words, offsets in word_hashes(texts):
            at = _among(words, vocabulary)
            row = np.searchsorted(offsets, at, "right") - 1
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            out += [np.unique(words[at[a:b]]).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.array(out, pa.list_(pa.int64()))

    counted = own.select(F.explode(known("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect() if made else []
    index = Index(made, {r["w"] % 2**64: r["n"] for r in counted}, rare, slack)
    names = [t.name for t in made]

    @F.arrow_udf("array<struct<license:string,first_word:bigint>>")
    def scan(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for _, words, offsets in word_hashes(texts):
            at = _among(words, index.words)
            row = np.searchsorted(offsets, at, "right") - 1
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                found = index.scan(words[offsets[i] : offsets[i + 1]], at[a:b] - offsets[i]) if b > a else []
                out.append([{"license": names[t], "first_word": o} for t, o in found])
        return pa.array(out, pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64())])))

    hits = own.select("doc_id", F.explode(scan("text")).alias("m")).select("doc_id", "m.*")
    return hits.groupBy("doc_id", "license").agg(F.min("first_word").alias("first_word"))


def _among(words: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of the words that are in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    low = np.zeros(1 << 16, bool)
    low[wanted & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(low[words & np.uint64(0xFFFF)])
    return at[wanted[np.minimum(np.searchsorted(wanted, words[at]), len(wanted) - 1)] == words[at]]
