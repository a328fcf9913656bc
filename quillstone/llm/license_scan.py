"""Fuzzy search for short license notices: exact seeds, then bounded-error matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillstone.llm.frames import pick


@dataclass(frozen=True)
class Notice:
    """A notice and the number of edits (insertions, deletions, substitutions)
    allowed, outside ``exact``: the words that tell this licence from others,
    as they stand in the text. These must be there as they are (case aside, any
    one white space for a blank), not as part of a longer word or number."""

    license_id: str
    text: str
    errors: int
    exact: str = ""


NOTICES = (
    Notice("Apache-2.0", "Licensed under the Apache License, Version 2.0", 4, "Version 2.0"),
    Notice("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", 3, "Apache-2.0"),
    Notice("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted", 8),
    Notice("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License", 6, "Attribution 4.0"),
    Notice("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", 2, "BY-NC 4.0"),
    Notice("GPL-3.0", "licensed under the GNU General Public License, version 3", 5, "version 3"),
    Notice("GPL", "This program is free software: you can redistribute it and/or modify", 6),
    Notice("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose", 7),
    Notice("MIT", "Released under the MIT License", 2, "MIT"),
    Notice("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy", 7),
    Notice("MIT", "SPDX-License-Identifier: MIT", 2, "MIT"),
    Notice("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", 5, "v. 2.0"),
    Notice("proprietary", "All rights reserved. Unauthorized copying of this file", 5),
)

#: What may not stand beside the exact words: letters and digits, also behind the signs that names and numbers are made with.
_BEFORE = r"(?<![0-9a-z])(?<![0-9a-z][-.+])"
_AFTER = r"(?![0-9a-z]|[-.][0-9a-z]|\+)"


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 disjoint pieces: a match with so many edits has one of them whole."""
    n = errors + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def pattern(notice: Notice) -> regex.Pattern:
    return regex.compile(f"(?e)(?:{regex.escape(notice.text.lower(), literal_spaces=True)}){{e<={notice.errors}}}")


def exact_pattern(notice: Notice) -> regex.Pattern | None:
    """What a match has to hold without edits."""
    exact = notice.exact.lower()
    if not exact:
        return None
    words = r"\s".join(regex.escape(w) for w in exact.split(" "))
    # a version may go on with a zero: version 3 is version 3.0
    zero = r"(?:\.0)?" if exact[-1].isdigit() and "." not in exact else ""
    return regex.compile(f"{_BEFORE}{words}{zero}{_AFTER}")


def holds(exact: regex.Pattern | None, low: str, start: int, stop: int) -> bool:
    """Whether the exact words begin within a match; what stands beside them counts."""
    m = exact is None or exact.search(low, start)
    return bool(m) and (m is True or m.start() < stop)


@lru_cache(maxsize=8)
def _compiled(notices: tuple[Notice, ...]):
    seeds = defaultdict(list)
    for k, n in enumerate(notices):
        for at, piece in pieces(n.text.lower(), n.errors):
            seeds[piece].append((k, at))
    machine = ahocorasick.Automaton()
    for piece, where in seeds.items():
        machine.add_word(piece, (len(piece), where))
    machine.make_automaton()
    return machine, [(pattern(n), exact_pattern(n)) for n in notices]


def lowered(text: str) -> str:
    """Lower case without a change of length, so that offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find(text: str, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, int, int, int, int]]:
    """(notice, start, stop, substitutions, insertions, deletions) of all matches.

    The seeds give windows that hold every possible match; windows that touch
    are merged, and inside each the matches are taken from left to right.
    """
    machine, patterns = _compiled(notices)
    windows: dict[int, list[list[int]]] = defaultdict(list)
    low = lowered(text)
    for end, (size, where) in machine.iter(low):
        for k, at in where:
            e = notices[k].errors
            begin = end + 1 - size - at
            windows[k].append([max(0, begin - e), min(len(low), begin + len(notices[k].text) + e)])
    out = []
    for k, spans in windows.items():
        spans.sort()
        merged = [spans[0]]
        for s in spans[1:]:
            if s[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append(s)
        for a, b in merged:
            fuzzy, exact = patterns[k]
            out += [(k, m.start(), m.end(), *m.fuzzy_counts) for m in fuzzy.finditer(low, a, b) if holds(exact, low, m.start(), m.end())]
    return sorted(out)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """All approximate occurrences of the notices in whole texts.

    Returns (id, license_id, notice, start, stop, substitutions, insertions,
    deletions): character offsets from 0, and the edits of the match. Case is
    ignored. The words that tell licences apart (Notice.exact) take no edits. A match with k edits holds one of k + 1 disjoint pieces of its
    notice unchanged, so the exact seed search (one automaton over all pieces)
    loses nothing; the regex library's bounded-error matching then verifies.
    Map only: nothing is exchanged, and texts without a seed go no further.

    Null or empty text: no rows, nor from an empty table. Repeated rows: rows
    for each. Null ids stay null. Texts of any length are searched in whole.
    Matches of one notice don't overlap: the first from the left is taken, and
    of those that begin together the one with the fewest edits; matches of
    different notices may overlap. Other columns are ignored, whatever their
    names.
    """
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("license_id", T.StringType()), T.StructField("notice", T.StringType())]
        + [T.StructField(c, T.IntegerType()) for c in ("start", "stop", "substitutions", "insertions", "deletions")]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            texts = batch.column(1)
            for r in range(batch.num_rows):
                t = texts[r].as_py()
                if t:
                    rows += [(r, *f) for f in find(t, notices)]
            if rows:
                cols = list(zip(*rows, strict=True))
                found = [notices[k] for k in cols[1]]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(cols[0])), pa.array([n.license_id for n in found]), pa.array([n.text for n in found]), *[pa.array(c, pa.int32()) for c in cols[2:]]],
                    schema.names,
                )

    return pick(docs, id_col, text_col).mapInArrow(scan, schema)
