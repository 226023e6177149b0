"""Collocations against counting in a dictionary, and automata against the phrases they were built from."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from seriesloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, rank int, f string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 1, "clash", "clash") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def plain(rows, least=30, top=2000, longest=4):
    f = Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^ \t]+", piece)
            for k in range(1, longest + 1):
                f.update((lang or "und" if lang is None else lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    total = Counter()
    for (lang, w), c in f.items():
        total[lang] += c if len(w) == 1 else 0
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        held = any(m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 80 * a for (m, v), b in found.items())
        if not held:
            cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, total[lang], -s)
        for lang, rows in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    )


def same(spark, rows, **settings):
    got = collocations.collocations(table(spark, rows), **settings)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, **settings)


def texts(r, n):
    words = ["a", "b", "New", "york", "é", "B\x00x", "\x85", "c\xa0d", "zz", *(f"w{i}" for i in range(30))]
    marks = [" ", " ", " ", "  ", "\t", " \t", ". ", ", ", "\n", "\r\n", "\x0b", "; ", "!", "?:"]
    common = ["new york city hall", "a b a b a", "the of the of", "w1 w2"]
    return ["".join((r.choice(common) if r.random() < 0.3 else r.choice(words)) + r.choice(marks) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_against_counting(spark):
    r = random.Random(2)
    rows = [(t, r.choice(["en", "en", "fr", None, ""])) for t in texts(r, 250)] + [(None, "en"), ("", None), (" \t", "de"), (".", "en")]
    same(spark, rows)
    same(spark, rows + rows[:100], least=12, top=7)  # repeated rows count each time


def test_small_shards_ranges_and_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 300)
    monkeypatch.setattr(collocations, "ranges_for", lambda *_: 64)
    monkeypatch.setattr(collocations, "passes", lambda bits, ids: np.ones(len(ids), bool))
    r = random.Random(8)
    same(spark, [(t, "en") for t in texts(r, 120)], least=5)


def test_shards_grow_with_the_ranges(spark, monkeypatch):
    sizes = [collocations.shard_bytes(2**k) for k in range(3, 14)]
    assert sizes[:4] == [collocations.SHARD] * 4 and sizes[4:] == [2 * collocations.SHARD] + [4 * collocations.SHARD] * 6
    monkeypatch.setattr(collocations, "SHARD", 300)
    monkeypatch.setattr(collocations, "ranges_for", lambda *_: 256)
    cut, seen = collocations.slices, []
    batch = pa.RecordBatch.from_pydict({"t": ["a b c d. " * 20] * 60, "lang": ["en"] * 60})
    monkeypatch.setattr(collocations, "slices", lambda column, limit: seen.append(limit) or cut(column, limit))
    rows = [b.num_rows for b in collocations._shards(2, 256, None)(iter([batch]))]
    assert seen == [1200] and len(rows) == 10 and sum(rows) <= 30
    monkeypatch.undo()
    monkeypatch.setattr(collocations, "FEW_RANGES", 2)
    same(spark, [(t, "en") for t in texts(random.Random(9), 120)], least=5)


def test_long_text_and_hot_phrase(spark):
    same(spark, [("x y z " * 60_000, "en"), ("x y", "fr"), ("x y q " * 40, "fr")])


def test_empty_table(spark):
    assert collocations.collocations(table(spark, [])).collect() == []


def test_union_of_automata():
    r = random.Random(1)
    want, automata = Counter(), []
    for _ in range(5):
        shard = Counter(tuple(r.choice([b"a", b"bb", b"c", b""]) for _ in range(3)) for _ in range(40))
        symbols = sorted({s for p in shard for s in p}, key=lambda s: r.random())
        paths = sorted((tuple(symbols.index(s) for s in p), n) for p, n in shard.items())
        built = collocations.build([np.array([p[d] for p, _ in paths]) for d in range(3)], np.array([n for _, n in paths]))
        assert len(built[1]) <= 3 * len(paths) and built[0].sum() == len(built[1])
        automata.append((pa.array(symbols, pa.binary()), collocations._load(collocations._dump(built))))
        want += shard
    symbols, _, paths, weights = collocations.unite(automata, 3)
    names = symbols.to_pylist()
    assert {tuple(names[p[i]] for p in paths): int(weights[i]) for i in range(len(weights))} == want
