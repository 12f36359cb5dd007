"""License scans by conditional compression: how much a template shrinks the text of a notice.

Texts and templates are compared word by word, in lower case and without outer punctuation; words
are parted by any white space. A template is cut into one run of words more than the edits that
``max_difference`` of its words allows, so a notice within the limit holds at least one run
unchanged. Where runs stand, the stretches that their templates may take, joined where they overlap,
are the candidate blocks.

A block is compressed alone and with each of the templates as raw dictionary, and the templates are
ranked by the bytes they save. In this order the wording is confirmed, until one fits: the edit
distance in words to the nearest stretch of the block must be at most ``max_difference`` of the
template's words; the words missing and added are reported. Of templates that save the same, the one
with fewer edits, then the first by name, wins. What is left of the block on both sides of a notice is
a block again, so nothing within the limit stays.

Words inside a reported notice are not looked at again, so a notice is reported once. A null or
empty text has no notice, a template without words is never found. Rows are judged one by one:
repeated rows and null ids change nothing. Other columns are ignored. Memory follows the longest
text.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.decontaminate import best_edits
from stayrate.llm.shared import small_batches

# Wordings of public notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction"
    ),
    "all rights reserved": "All rights reserved.",
}


def plain(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]")


def runs_of(wording: list[str], edits: int) -> list[tuple[int, list[str]]]:
    """(offset, words) of runs of which ``edits`` edits leave at least one as it is."""
    n = min(edits + 1, len(wording))
    cuts = [i * len(wording) // n for i in range(n + 1)] if n else []
    return [(a, wording[a:b]) for a, b in zip(cuts, cuts[1:])]


class Template(NamedTuple):
    name: str
    words: list[str]
    most: int  # edits allowed
    tool: zstandard.ZstdCompressor


class Fit(NamedTuple):
    """A stretch of words that a template fits."""

    start: int
    end: int
    template: int
    edits: int
    missing: list[str]
    added: list[str]


class Scanner:
    """Templates with their compressors and their runs of words."""

    def __init__(self, templates: Mapping[str, str], max_difference: float) -> None:
        self.max_difference = max_difference
        options = {"level": 9}
        self.alone = zstandard.ZstdCompressor(**options, write_content_size=False)
        self.templates: list[Template] = []
        # By its longest word, each run as (template, offset in it, place of that word, words).
        self.runs: dict[str, list[tuple[int, int, int, list[str]]]] = {}
        for name, wording in sorted(templates.items()):
            words = [plain(w) for w in wording.split()]
            kind = zstandard.DICT_TYPE_RAWCONTENT
            given = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=kind)
            tool = zstandard.ZstdCompressor(**options, dict_data=given, write_content_size=False)
            most = int(max_difference * len(words))
            for offset, run in runs_of(words, most):
                longest = max(run, key=len)
                self.runs.setdefault(longest, []).append(
                    (len(self.templates), offset, run.index(longest), run)
                )
            self.templates.append(Template(name, words, most, tool))
        # Words that a text must hold somewhere for a run, the longest first.
        self.needed = sorted(
            {tuple(sorted(set(run), key=len, reverse=True)) for rs in self.runs.values() for *_, run in rs}
        )

    def scan(self, text: str) -> list[tuple]:
        """(license, start, end, saved, edits, missing, added): offsets in characters."""
        lowered = text.lower()
        if not any(all(w in lowered for w in needed) for needed in self.needed):
            return []
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        words = [plain(text[a:b]) for a, b in places]
        found = [
            (self.templates[fit.template].name, places[fit.start][0], places[fit.end - 1][1], saved)
            + (fit.edits, fit.missing, fit.added)
            for fit, saved in self.settled(words)
        ]
        return sorted(found, key=lambda f: f[1])

    def windows(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(template, low, high): stretches of words in which the template may lie."""
        begins = set()
        for at, word in enumerate(words):
            for t, offset, place, run in self.runs.get(word, ()):
                first = at - place
                if first >= 0 and words[first : first + len(run)] == run:
                    begins.add((t, first - offset))
        for t, begin in sorted(begins):
            _, wording, most, _ = self.templates[t]
            yield t, max(0, begin - most), min(len(words), begin + len(wording) + most)

    def fit(self, words: list[str], t: int, low: int, high: int) -> Fit | None:
        _, wording, most, _ = self.templates[t]
        if not wording or high - low < len(wording) - most:
            return None
        got = self.confirm(wording, words[low:high])
        if got is None:
            return None
        a, b, *rest = got
        return Fit(low + a, low + b, t, *rest)

    def blocks(self, words: list[str]) -> list[tuple[int, int]]:
        """Windows of all templates, joined where they overlap."""
        out: list[tuple[int, int]] = []
        for low, high in sorted((low, high) for _, low, high in self.windows(words)):
            if out and low < out[-1][1]:
                out[-1] = out[-1][0], max(high, out[-1][1])
            else:
                out.append((low, high))
        return out

    def ranked(self, words: list[str]) -> list[tuple[float, list[int]]]:
        """(share of bytes saved, templates that save it), the largest first."""
        block = " ".join(words).encode()
        size = len(self.alone.compress(block))
        saved: dict[float, list[int]] = {}
        for t, template in enumerate(self.templates):
            saved.setdefault(1 - len(template.tool.compress(block)) / size, []).append(t)
        return sorted(saved.items(), reverse=True)

    def settled(self, words: list[str]) -> Iterator[tuple[Fit, float]]:
        """The notices of all blocks, each the first in its block's ranking that fits."""
        blocks = self.blocks(words)
        while blocks:
            low, high = blocks.pop()
            for saved, templates in self.ranked(words[low:high]):
                fits = [f for t in templates if (f := self.fit(words, t, low, high))]
                if fits:
                    best = min(fits, key=lambda f: (f.edits, f.template))
                    yield best, saved
                    blocks += [(low, best.start), (best.end, high)]
                    break

    def confirm(self, wording: list[str], block: list[str]) -> tuple | None:
        """Where the template lies in the block, and how its wording differs."""
        number = {w: i for i, w in enumerate(dict.fromkeys([*wording, *block]))}
        item, text = (np.array([number[w] for w in ws]) for ws in (wording, block))
        edits, end = best_edits(item, text)
        if not end or edits > int(self.max_difference * len(wording)):
            return None
        _, size = best_edits(item[::-1], text[:end][::-1])
        missing, added = [], []
        stretch = block[end - size : end]
        for kind, a, b, c, d in difflib.SequenceMatcher(
            None, wording, stretch, autojunk=False
        ).get_opcodes():
            if kind != "equal":
                missing += wording[a:b]
                added += stretch[c:d]
        return end - size, end, edits, missing, added


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    max_difference: float = 0.15,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per notice: (id, license, start, end, saved, edits, missing, added)."""
    small_batches(docs.sparkSession)
    names = ["license", "start", "end", "saved", "edits", "missing", "added"]
    types = [
        pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(),
        pa.list_(pa.string()), pa.list_(pa.string()),
    ]
    given = dict(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, max_difference)
        for batch in batches:
            rows, columns = [], [[] for _ in names]
            for i, text in enumerate(batch.column(1).to_pylist()):
                for hit in scanner.scan(text):
                    rows.append(i)
                    for column, value in zip(columns, hit):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64()))]
                + [pa.array(c, t) for c, t in zip(columns, types)],
                names=[id_col, *names],
            )

    schema = (
        f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, license string, start bigint,"
        " end bigint, saved double, edits bigint, missing array<string>, added array<string>"
    )
    return (
        docs.select(id_col, text_col)
        .filter(F.col(text_col).isNotNull())
        .mapInArrow(scan, schema)
    )
