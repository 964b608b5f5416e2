"""Fuzzy search for short licence notices.

Each notice may match with up to `errors` edits (single-character insertions, deletions, substitutions). Split into
errors + 1 pieces, a notice with at most that many edits keeps one piece unchanged (pigeonhole), so an exact search for all
pieces finds every candidate; around each, the regex library's bounded-error matching verifies the edits and gives the
span. Notices that are too short for an edit are exact: their one piece is the match itself.

The text is searched as its words, lower-cased, with one space between, so line breaks and punctuation don't count.

Defined results: null and empty texts have no words, no matches and score 0. Overlapping matches of one notice count once
(the best, then the first). Repeated rows get equal results. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgrid.llm.common import small_batches
from relgrid.llm.vec import LOWER, NON_WORD

#: The phrases that count as base matches, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices searched with edits: words, label, most edits. About one edit in twelve characters, none under twelve.
NOTICES = (
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("licensed under the apache license", "apache", 2),
    ("apache license version 2 0", "apache", 2),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 3),
    ("mozilla public license", "mpl", 1),
    ("eclipse public license", "epl", 1),
    ("licensed under cc by", "cc-by", 1),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("all rights reserved", "all-rights-reserved", 1),
    ("spdx license identifier", "spdx", 1),
)
_CLEAN = LOWER.copy()
_CLEAN[NON_WORD] = 32
_CLEAN[65:91] = np.arange(97, 123)
_TABLE = _CLEAN.tobytes()


@dataclass(frozen=True)
class Match:
    label: str
    start: int  # first word
    words: int
    edits: int
    similarity: float


def plain(text: str | None) -> bytes:
    """The words of the text, in UTF-8, each with one space before it, and one at the end."""
    words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


class Scanner:
    """Exact phrases and fuzzy notices over one text at a time."""

    def __init__(self, phrases: dict[str, str] = BASE_PHRASES, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> None:
        self.phrases = {k.encode(): v for k, v in phrases.items()}
        ways = b"|".join(sorted(self.phrases, key=len, reverse=True))
        self.exact = regex.compile(rb"(?<= )(?:" + ways + rb")(?= )")
        self.fuzzy, self.seeds = [], ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (words, label, most) in enumerate(notices):
            for seed, offset in self.split(words, most):
                at.setdefault(seed, []).append((k, offset))
            self.fuzzy.append((words, label, most, regex.compile(rf"(?e)(?<= )(?:{words}){{e<={most}}}(?= )")))
        for seed, uses in at.items():
            self.seeds.add_word(seed, (len(seed), tuple(uses)))
        self.seeds.make_automaton()

    @staticmethod
    def split(words: str, most: int) -> list[tuple[str, int]]:
        """Pieces of the notice with their places, one more than the edits, of nearly equal length."""
        cut = [round(i * len(words) / (most + 1)) for i in range(most + 2)]
        return [(words[a:b], a) for a, b in zip(cut, cut[1:], strict=False)]

    def base(self, flat: bytes) -> list[tuple[int, str]]:
        """(word, label) of each place where a phrase's words stand."""
        out, seen, at = [], 0, 0
        for m in self.exact.finditer(flat, overlapped=True):
            seen += flat.count(b" ", at, m.start())
            at = m.start()
            out.append((seen - 1, self.phrases[m[0]]))
        return out

    def notices(self, flat: bytes) -> list[Match]:
        text = flat.decode("latin-1")
        windows: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self.seeds.iter(text):
            for k, offset in uses:
                words, _, most, _ = self.fuzzy[k]
                begin = end + 1 - length - offset
                span = [max(0, begin - most - 1), min(len(text), begin + len(words) + most + 1)]
                found = windows.setdefault(k, [])
                if found and span[0] <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], span[1])
                else:
                    found.append(span)
        out = []
        for k, spans in windows.items():
            words, label, most, pattern = self.fuzzy[k]
            seen = at = 0
            for a, b in spans:
                for m in pattern.finditer(text, a, b):
                    edits = sum(m.fuzzy_counts)
                    seen, at = seen + text.count(" ", at, m.start()), m.start()
                    out.append(Match(label, seen - 1, m[0].strip().count(" ") + 1, edits, 1.0 - edits / len(words)))
        return sorted(out, key=lambda x: (x.start, x.label, x.edits))


MATCH = "array<struct<label:string,start:bigint,words:bigint,edits:bigint,similarity:double>>"


def scan(rows: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Every row's `keep` columns with n_words, base (array of word and label) and notices (array of matches with spans in words)."""
    kept = small_batches(rows).select(*(keep or []), F.col(text).cast("string").alias("__text"))
    fields = kept.schema.fields[:-1]
    width = len(fields)
    added = T.StructType.fromDDL(f"n_words bigint, base array<struct<start:bigint,label:string>>, notices {MATCH}")
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            n_words, base, notices = [], [], []
            for text in batch.column(width).to_pylist():
                flat = plain(text)
                n_words.append(max(0, flat.count(b" ") - 1))
                base.append([{"start": s, "label": x} for s, x in scanner.base(flat)])
                notices.append([m.__dict__ for m in scanner.notices(flat)])
            columns = [batch.column(k) for k in range(width)]
            columns += [pa.array(v, kinds.field(k).type) for k, v in enumerate((n_words, base, notices))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:width], *added.names])

    return kept.mapInArrow(run, T.StructType([*fields, *added.fields]))
