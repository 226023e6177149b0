"""Licence scans: one automaton finds identifier tags and notice phrases, a shunting-yard parser reads expressions.

Texts are lower-cased (A-Z) and reduced to words of digits, letters and non-ASCII characters with one space between;
phrases are words in that form, so line breaks, hyphens and comment marks within a notice don't matter. A tag such as
``SPDX-License-Identifier:`` is followed by an expression in the raw text, which ends with its line or where no further
operator or operand can stand.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesloom.llm.text import LOWER, slices

# The phrases and labels that the contract names.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Words of licence notices and the identifier they stand for.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd-3-clause",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl-3.0",
    "affero general public license": "agpl-3.0",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "boost software license": "bsl-1.0",
    "isc license": "isc",
    "zlib license": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc0 1 0 universal": "cc0-1.0",
    "dedicated to the public domain": "cc0-1.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "creative commons attribution 4 0": "cc-by-4.0",
    "creative commons attribution sharealike 4 0": "cc-by-sa-4.0",
    "creative commons attribution noncommercial 4 0": "cc-by-nc-4.0",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")

# How freely a text under each licence may be used, from 0 (not at all) to 1 (without conditions).
FREEDOM = {
    "cc0-1.0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit-0": 1.0,
    "mit": 0.9, "apache": 0.9, "apache-2.0": 0.9, "bsd-2-clause": 0.9, "bsd-3-clause": 0.9, "isc": 0.9, "zlib": 0.9,
    "bsl-1.0": 0.9, "cc-by-4.0": 0.9, "python-2.0": 0.9,
    "mpl-2.0": 0.6, "epl-2.0": 0.6, "lgpl-2.1": 0.6, "lgpl-3.0": 0.6, "cc-by-sa-4.0": 0.6,
    "gpl": 0.4, "gpl-2.0": 0.4, "gpl-3.0": 0.4, "agpl-3.0": 0.3,
    "cc-by-nd-4.0": 0.2, "cc-by-nc-4.0": 0.1, "cc-by-nc-sa-4.0": 0.1, "cc-by-nc-nd-4.0": 0.1,
    "all-rights-reserved": 0.0,
}
OTHER, OTHER_FREEDOM = "other", 0.3  # an identifier that isn't listed
EXCEPTION_FREEDOM = 0.6  # what ``with`` an exception makes of a stricter licence

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_LEAD = re.compile(rb"[ \t\"']*[:=][ \t\"']*")


def parse(raw: bytes) -> list[str]:
    """The licence expression after the colon at the start of ``raw`` in postfix order, lower-cased; empty if there is none.

    ``with`` binds closer than ``and``, ``and`` closer than ``or``, equal ones to the left. The expression ends before a
    token that can't follow; an operator or bracket left without its operand there is dropped.
    """
    out: list[str] = []
    held: list[str] = []
    depth = 0
    lead = _LEAD.match(raw)
    at, operand = lead.end() if lead else len(raw), False

    def close(least: int) -> None:
        while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= least:
            out.append(held.pop())

    while found := _TOKEN.match(raw, at):
        token = found[1].decode().lower().rstrip(".:-")
        if token in _PRECEDENCE:
            if not operand:
                break
            close(_PRECEDENCE[token])
            held.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            held.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            close(0)
            held.pop()
            depth -= 1
        else:
            if operand:
                break
            out.append(token)
            operand = True
        at = found.end()
    while held and not operand:  # an operator that waits for its right side, and brackets without content
        operand = held.pop() != "("
    return out + [x for x in reversed(held) if x != "("]


def identifier(token: str) -> str:
    """The listed licence that an identifier names, whatever its version suffix; else ``other``."""
    for name in (token, token.removesuffix("+"), token.removesuffix("-only"), token.removesuffix("-or-later")):
        if name in FREEDOM:
            return name
    return OTHER


def evaluate(postfix: list[str]) -> tuple[float, set[str], str]:
    """(freedom, licences, canonical text): ``or`` gives the freer side, ``and`` the stricter one, and an exception lifts
    a stricter licence to at least that of a weak copyleft."""
    stack: list[tuple[float, set[str], deque, int]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            name = identifier(token)
            stack.append((FREEDOM.get(name, OTHER_FREEDOM), {name}, deque([token]), 4))
            continue
        (y, names_b, right, rank_b), (x, names_a, left, rank_a) = stack.pop(), stack.pop()
        rank = _PRECEDENCE[token]
        for side, inner in ((left, rank_a), (right, rank_b)):
            if inner < rank:
                side.appendleft("(")
                side.append(")")
        left.append(f" {token.upper()} ")
        if len(left) >= len(right):  # the longer side takes the shorter one in
            left.extend(right)
        else:
            right.extendleft(reversed(left))
            left = right
        if token == "with":
            stack.append((max(x, EXCEPTION_FREEDOM), names_a, left, rank))
        else:
            stack.append(((max if token == "or" else min)(x, y), names_a | names_b, left, rank))
    value, names, parts, _ = stack[0]
    return value, names, "".join(parts)


def _automaton(notices: Mapping[str, str]) -> ahocorasick.Automaton:
    """Phrases as bytes between spaces, one letter of the automaton for a byte; it holds (kind, label, words)."""
    found: dict[str, list[tuple[str, str, int]]] = {}
    for kind, phrases in (("base", BASE.items()), ("notice", notices.items()), ("tag", ((t, "") for t in TAGS))):
        for phrase, label in phrases:
            found.setdefault(phrase, []).append((kind, label, len(phrase.split(" "))))
    out = ahocorasick.Automaton()
    for phrase, uses in found.items():
        out.add_word(f" {phrase} ".encode().decode("latin-1"), uses)
    out.make_automaton()
    return out


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _normal(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(words of all documents with a space before and after each, and two between documents; where each word starts
    in it; where each word ends in ``data``; the index of each document's first word)."""
    low = LOWER[data]
    inside = np.concatenate([_WORD[low], [False]])
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    opens[firsts] = inside[firsts]
    starts = np.flatnonzero(opens)
    closes = inside[:-1] & ~(inside[1:] & ~opens[1:])
    ends = np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    length = ends - starts
    gap = np.ones(len(starts), np.int64)  # spaces before each word
    gap[first[:-1][first[:-1] < first[1:]]] = 2
    at = np.cumsum(gap + length) - length
    text = np.full(int(at[-1] + length[-1] + 1) if len(at) else 1, 32, np.uint8)
    inner = np.repeat(at - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(at) else np.zeros(0, np.int64)
    text[inner] = low[inside[:-1]]
    return text.tobytes().decode("latin-1"), at, ends, first


def _line(data: np.ndarray, at: int, end: int) -> bytes:
    """The bytes from ``at`` to the end of the line, looked for in growing steps."""
    size = 1 << 10
    while at + size < end and not np.isin(data[at : at + size], (10, 13)).any():
        size *= 2
    return re.split(rb"[\r\n]", data[at : min(end, at + size)].tobytes(), maxsplit=1)[0]


def _score(spans: list[tuple[int, int, float]]) -> float:
    """The least freedom of all statements that no longer one covers; 1 without any."""
    least, reach = 1.0, -1
    for _, end, value in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end > reach:
            least, reach = min(least, value), end
    return least


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expressions array<string>"
)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions) of every document.

    Base places are all places of the three base phrases; their first and last word index is null without any.
    ``labels`` are the base labels, those of further notices (any mapping of words to identifiers) and the identifiers of
    tagged expressions. ``expressions`` has each tag's expression in canonical form, in the order of the text. The score
    says how freely the text may be used by its own statements: the least of all of them, a statement within a longer
    one not counted, and of an expression what it evaluates to; a text that states nothing has 1.

    Null and empty texts have no words, empty labels and score 1. Repeated rows and null ids are documents of their
    own; the order of rows doesn't matter; an empty table gives no rows; other columns are not read. One text of any
    length is one value of its Arrow batch, and nothing but its own places is held for it.
    """
    id_field = docs.select(F.col(doc_id).alias("doc_id")).schema
    schema = StructType([*id_field, *StructType.fromDDL(FIELDS)])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(notices)
        for batch in batches:
            rows: list[tuple] = []
            for lo, hi, data, offsets in slices(batch.column(1)):
                normal, at, ends, first = _normal(data, offsets)
                base: list[list[tuple[int, str]]] = [[] for _ in range(hi - lo)]
                own: list[set[str]] = [set() for _ in range(hi - lo)]
                spans: list[list[tuple[int, int, float]]] = [[] for _ in range(hi - lo)]
                said: list[list[str]] = [[] for _ in range(hi - lo)]
                for last, uses in automaton.iter(normal):
                    # The hit ends with the space after its last word.
                    w = int(np.searchsorted(at, last)) - 1
                    doc = int(np.searchsorted(first, w, "right")) - 1
                    for kind, label, n in uses:
                        start = w - n + 1
                        if kind == "tag":
                            postfix = parse(_line(data, int(ends[w]), int(offsets[doc + 1])))
                            if postfix:
                                value, names, form = evaluate(postfix)
                                own[doc] |= names
                                said[doc].append(form)
                                spans[doc].append((start, w + 1, value))
                            continue
                        if kind == "base":
                            base[doc].append((start - int(first[doc]), label))
                        own[doc].add(label)
                        spans[doc].append((start, w + 1, FREEDOM.get(label, OTHER_FREEDOM)))
                for d in range(hi - lo):
                    places = [p for p, _ in base[d]]
                    rows.append((
                        int(first[d + 1] - first[d]), len(places), min(places, default=None), max(places, default=None),
                        ",".join(sorted({x for _, x in base[d]})), ",".join(sorted(own[d])), _score(spans[d]), said[d],
                    ))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, schema)
