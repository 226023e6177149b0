"""Repeated spans and near copies against brute force, with nulls, ties, hot groups and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import debruijn, jaccard, repeats, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, tid string, set_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "clash", "clash", "clash") for i, t in rows], SCHEMA).repartition(5)


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(r.choice([0, 3, 19, 20, 21, 80, 200]))]
        if r.random() < 0.5:
            at, a = r.randint(0, len(w)), r.randint(0, 30)
            w[at:at] = passage[a : a + r.randint(5, 60)]
        if r.random() < 0.2 and rows and rows[-1][1]:
            w += (rows[-1][1] or "").split()[:150]
        rows.append((i, r.choice([" ", "  ", "\n"]).join(w)))
    rows += [(200, None), (201, ""), (202, "   \n"), (203, "a " * 300), (204, "a " * 300), (205, "é" * 80), (206, "é" * 80), (207, "xé" * 40)]
    rows += [(208, "\x00" * 70), (209, "q\x00" * 70), (210, "q\x00" * 70), (211, "z" * 49), (212, "z" * 49), (213, "z" * 50), (214, "z" * 51)]
    rows += [(300 + i, " ".join(passage[: 60 - i % 3])) for i in range(40)]
    rows += [(400, " ".join(word() for _ in range(30_000)))]
    return rows


def words_left(rows, width=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        w = WORD.findall(text or "")
        gone = bytearray(len(w))
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            if k in seen:
                gone[j : j + width] = b"\1" * width
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def bytes_left(rows, width=50):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if first.setdefault(b[j : j + width], i) < i:
                gone[j : j + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.fixture(params=["usual", "hot"])
def anchors(request, monkeypatch):
    """With ``hot``, every branching anchor is dealt by single windows."""
    if request.param == "hot":
        monkeypatch.setattr(repeats, "HOT", 1)


def test_repeated_words(spark, anchors):
    rows = corpus()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in debruijn.cut_repeated_words(frame(spark, rows)).collect()}
    assert got == words_left(rows)


def test_repeated_bytes(spark, anchors):
    rows = corpus()
    found = suffix.cut_repeated_bytes(frame(spark, rows), carry=("lang",)).collect()
    assert all(r["lang"] == "x" for r in found)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in found}
    assert got == bytes_left(rows)


def test_repeated_bytes_near_a_nul(spark, anchors):
    r = random.Random(11)
    some = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = some(120)
    rows = [(1, some(40) + passage + some(40)), (2, some(40) + passage + "\x00" + some(40)), (3, some(60) + "\x00" + passage + some(9))]
    rows += [(4, passage[:70] + "\x00" + passage[70:]), (5, some(20) + passage[:70] + "\x00" + passage[70:90] + "\x01" + passage), (6, "\x00" * 30 + passage[30:90] + "\x00" * 60)]
    rows += [(10 + i, some(r.randint(0, 30)) + passage[r.randint(0, 50) :] + r.choice(["\x00", "\x01", "\xff"]) + some(r.randint(0, 30))) for i in range(30)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix.cut_repeated_bytes(frame(spark, rows)).collect()}
    assert got == bytes_left(rows)


def test_rows_that_repeat_an_id(spark):
    text, other = "b" * 30 + "c" * 60, "n" * 10 + "c" * 60
    rows = [(1, text), (1, text), (1, other), (2, text), (None, text)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix.cut_repeated_bytes(frame(spark, rows)).collect())
    assert got == [(-1, 90), (1, 0), (1, 0), (1, 0), (2, 90)]
    words = " ".join(f"w{i}" for i in range(30))
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in debruijn.cut_repeated_words(frame(spark, [(1, words), (1, words), (2, words), (None, words)])).collect())
    assert got == [(-1, 30), (1, 0), (1, 0), (2, 30)]


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("false")
    assert debruijn.cut_repeated_words(none).count() == suffix.cut_repeated_bytes(none).count() == jaccard.link_components(none).count() == 0


def test_boundaries_of_the_transform():
    r = np.random.default_rng(5)
    pieces = [r.integers(97, 99, n).astype(np.uint8) for n in r.integers(1, 60, 60)]
    lengths = np.array([len(p) for p in pieces])
    doc = r.integers(0, 40, 60)
    first: dict[bytes, int] = {}
    width = 6
    for p, d in zip(pieces, doc):
        for j in range(len(p) - width + 1):
            w = p[j : j + width].tobytes()
            first[w] = min(first.get(w, 99), d)
    want = [[first[p[j : j + width].tobytes()] < d for j in range(len(p) - width + 1)] for p, d in zip(pieces, doc)]
    got = suffix.repeated_masks(np.concatenate(pieces), lengths, doc, width)
    for mask, w in zip(got, want):
        assert [bool(int(mask) >> j & 1) for j in range(len(w))] == w


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def near_copies():
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows, base = [], [word() for _ in range(150)]
    for i in range(90):  # a hot group that drifts, so that its ends are linked only through others
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
        if i % 9 == 8:
            base = w
    passage = [word() for _ in range(60)]
    for i in range(60):  # a common passage in unlike documents, short ones among them
        rows.append((100 + i, " ".join([word() for _ in range(r.choice([0, 3, 10, 40]))] + passage)))
    for i in range(30):
        rows.append((200 + i, " ".join(word() for _ in range(r.randint(1, 12)))))
    rows += [(230 + i, t) for i, t in enumerate(["One Two", "one two", "ONE TWO three", None, "", " ", "É a b c d e", "é a b c d e"])]
    return rows


@pytest.mark.parametrize("rare", [32, 4])
def test_near_copies(spark, rare):
    rows = near_copies()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame(spark, rows), rare=rare).collect())
    assert got == components(rows)


def test_repeated_rows_are_linked(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None)]
    got = sorted(tuple(r) for r in jaccard.link_components(frame(spark, rows)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3)]


def null_ids():
    """Rows of a hot group, of pairs that counts leave open and of unlike texts, without ids or with shared ones."""
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows, passage = [], [word() for _ in range(60)]
    for i in range(80):  # near copies: their ends are linked through rows without an id
        w = list(passage)
        w[i % 50] = word()
        rows.append((None if i % 2 else i, " ".join(w)))
    common = [word() for _ in range(60)]
    rows += [(None if i % 3 else 100 + i, " ".join([word() for _ in range(r.choice([0, 3, 9, 12, 40]))] + common)) for i in range(60)]
    alone = [" ".join(word() for _ in range(25)) for _ in range(6)]
    rows += [(None, t) for t in alone[:3]] + [(500, t) for t in alone[3:]] + [(None, alone[0]), (501, alone[4]), (499, alone[5]), (None, None), (None, "")]
    return rows


def components_with_null_ids(rows):
    """(id, size, component) by brute force, and for each component its rows."""
    made = [(2000 + n if i is None else i, t) for n, (i, t) in enumerate(rows)]
    sets, parent = [shingles(t) for _, t in made], list(range(len(made)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(made)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(made)):
        groups.setdefault(find(a), []).append(a)
    least = {g: min((rows[a][0] for a in m if rows[a][0] is not None), default=None) for g, m in groups.items()}
    out = [(rows[a][0], len(sets[a]), least[find(a)]) for a in range(len(made))]
    return sorted(out, key=repr), [(least[g], [rows[a] for a in m]) for g, m in groups.items()]


@pytest.mark.parametrize("rare", [32, 4])
def test_near_copies_with_null_ids(spark, rare):
    rows = null_ids()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame(spark, rows), rare=rare).collect()]
    assert sorted(got, key=repr) == components_with_null_ids(rows)[0]


def test_pipeline_keeps_one_of_each_component(spark):
    import corpus_pipeline

    rows = null_ids()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    for least, group in components_with_null_ids(rows)[1]:
        kept = [x for x in set(group) if x in got]
        assert len(kept) == 1 and kept[0][0] == least
    assert got <= set(rows)


@pytest.mark.parametrize("chunks", [1, 3])
def test_near_copies_give_links_but_not_all_their_pairs(chunks):
    """Copies around the threshold, each a component of its own before: at most a forest leaves the task."""
    rng, size = np.random.default_rng(2), 150
    base, sets = np.unique(rng.integers(0, 2**48, 300)), []
    for _ in range(size):
        kept = base[rng.random(len(base)) < 0.9 + 0.03 * rng.random()]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**48, len(base) - len(kept))])).astype(np.uint64))
    places = [(1, i, i % chunks, min(i % chunks, o), max(i % chunks, o), len(t), i, jaccard.pack48(t << np.uint64(16))) for i, t in enumerate(sets) for o in range(chunks)]
    names = ["family", "set_id", "chunk", "low", "high", "n", "root", "tokens"]
    found = jaccard._tile_links(80)(pa.table(dict(zip(names, map(list, zip(*places))))))
    assert found.num_rows < size * chunks * (chunks + 1) // 2

    def components(pairs):
        root = np.arange(size)
        for x, y in pairs:
            root[root == max(root[x], root[y])] = min(root[x], root[y])
        return root.tolist()

    common = lambda x, y: len(np.intersect1d(sets[x], sets[y]))
    linked = [(x, y) for y in range(size) for x in range(y) if 100 * (c := common(x, y)) >= 80 * (len(sets[x]) + len(sets[y]) - c)]
    assert len(linked) > 20 and components(zip(*found.to_pydict().values())) == components(linked)


def sampled_sets():
    """Copies and near copies of 100 to 700 shingles, at both sides of the size from which sets are indexed by a sample,
    alone, around a hot text and with common passages."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    rows, common = [], [word() for _ in range(170)]
    for n in [100, 120, 140, 150, 158, 160, 162, 165, 180, 200, 300, 700]:
        base = [word() for _ in range(n + 4)]
        for edits in (0, 1, 2, 3, 4, 5, 6, 8, 12):
            w = list(base)
            for _ in range(edits * n // 150 + (edits > 0)):
                w[r.randrange(len(w))] = word()
            rows.append(w[r.randint(0, n // 8) :])
            rows.append(w + [word() for _ in range(r.randint(0, n // 4))])
    for i in range(60):
        w = list(common)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(len(w))] = word()
        rows.append([word() for _ in range(r.choice([0, 0, 5, 20, 35, 60]))] + w[: r.choice([130, 155, 165, 170])])
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("rare", [32, 4])
def test_sets_indexed_by_a_sample(spark, rare):
    rows = sampled_sets()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame(spark, rows), rare=rare).collect())
    assert got == components(rows) and len({c for *_, c in got}) > 20


def test_large_sets_travel_by_their_sample(spark):
    r = random.Random(6)
    rows = [(i, " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(2004))) for i in range(20)]
    sent = jaccard._index(frame(spark, rows), 5, 8).selectExpr("sum(length(keys)) / 6 AS n").first()["n"]
    assert 0.34 < sent / 40_000 < 0.41
