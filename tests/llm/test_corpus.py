"""Mixing, language, tokens, vectors, archives, tool calls and the pipeline on small fixtures."""

import base64
import gzip
import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import compare, connection

import corpus_pipeline
from seriesloom.llm import language, mixing, tokens, toolcalls, vectors, warc
from seriesloom.llm.queries import ORACLES, QUERIES
from seriesloom.llm.store import components
from seriesloom.session import shared_folder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, ids string, score string, number string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "clash", "clash", "clash", "clash") for i, t, lang, s in rows], DOCS).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], connection(SF), SF) is None


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 1), (5, 5)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {n: root for n, root in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in parent}


# Mixing


def test_targets_stop_at_three_times_the_source():
    size = np.array([1000, 10, 10, 0, 500])
    weight = np.array([5, 2, 1, 5, 2.0])
    got = mixing.targets(size, weight)
    assert got[1] == 30 and got[2] == 30 and got[3] == 0
    assert math.isclose(got.sum(), 1520) and math.isclose(got[0] / got[4], 2.5)
    assert (mixing.targets(np.array([0, 0]), np.array([5.0, 2.0])) == 0).all()


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        index = np.arange(n)
        p = mixing.permuted(index, np.full(n, n), np.full(n, 3), np.full(n, 1))
        assert sorted(p) == list(index)
        assert all(p[mixing._position(b, n, 3, 1)] == b for b in range(n))


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_RUN", 16)
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 90, 700])), None, r.choice(["a", "b", "b", "b", "z", None])) for i in range(150)]
    rows += [(900, None, None, "n"), (900, None, None, "n"), (901, "x y", None, ""), (901, "x y", None, ""), (None, "p q", None, "a")]
    docs = documents(spark, rows)
    placed, takes = mixing.mix(mixing.sized_documents(docs), block=16, shard=8)
    got = mixing.taken(placed, takes).collect()
    assert len(got) == len(rows)
    for source in {s for *_, s in rows}:
        mine = [x for x in got if x["source"] == source]
        assert all(x["taken"] <= 3 * x["size"] for x in mine)
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 1
        assert {x["source_size"] for x in mine} == {sum(x["size"] for x in mine)}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    sizes = [sum(len((t or "").split()) for _, t, _, s in rows if s == name) for name in names]
    want = mixing.targets(np.array(sizes), np.array([(5, 2, 1)[i % 3] for i in range(len(names))], float))
    assert all(math.isclose(next(x["target"] for x in got if x["source"] == n), w, abs_tol=1e-9) for n, w in zip(names, want))
    again = mixing.taken(*mixing.mix(mixing.sized_documents(docs.repartition(7)), block=16, shard=8)).collect()
    key = lambda rows: sorted((repr(x["doc_id"]), x["size"], x["taken"]) for x in rows)
    assert key(again) == key(got)
    texts = mixing.mixed_documents(docs, block=16, shard=8).collect()
    assert sum(len(x["text"].split()) for x in texts) == sum(x["taken"] for x in got)
    assert mixing.mixed_documents(docs.where("false")).count() == 0


# Language


def test_language_of_mixed_text(spark):
    en, fr = "the cat sat on the mat with another thing", "le chat est dans une maison avec des gens"
    rows = [(i, en, "en", "s") for i in range(30)] + [(100 + i, fr, "fr", "s") for i in range(30)] + [(200 + i, "привет как дела", "ru", "s") for i in range(9)]
    model = language.learn(documents(spark, rows + [(1, None, "en", "s"), (2, "no label", None, "s"), (3, "", "fr", "s")]))
    asked = [(1, f"{en} {en} {fr}", "fr", "s"), (2, None, "en", "s"), (3, "12 + 34 !", "en", "s"), (4, "", None, "s"), (5, "дела", None, "s"), (6, "x " * 50_000 + en, None, "s"), (6, fr, "de", "s")]
    got = language.label(documents(spark, asked), model).collect()
    by = {(r["doc_id"], r["text"]): r for r in got}
    first = by[1, asked[0][1]]
    assert first["lang_pred"] == "en" and 0.5 < first["score"] < 1 and [s["lang"] for s in first["spans"]] == ["en", "fr"]
    assert [s["from_word"] for s in first["spans"]] == [0, 18] and len(got) == len(asked) and first["size"] == "clash"
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in by if k[0] in (2, 3, 4))
    assert by[5, "дела"]["lang_pred"] == "ru" and by[6, fr]["lang_pred"] == "fr"
    nothing = language.learn(documents(spark, rows).where("false"))
    assert {r["lang_pred"] for r in language.label(documents(spark, asked), nothing).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(4)
    for _ in range(30):
        length = r.integers(0, 7, 4)
        first = np.concatenate([[0], np.cumsum(length)])
        scores = r.normal(0, 3, (first[-1], 3)).astype("float32")
        got = language.viterbi(scores, first, 2.0)
        for a, b in zip(first[:-1], first[1:]):
            value = lambda p: sum(float(scores[a + i, l]) for i, l in enumerate(p)) - 2 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731, E741
            paths = [()]
            for _ in range(b - a):
                paths = [(*p, l) for p in paths for l in range(3)]  # noqa: E741
            assert math.isclose(value(got[a:b]), max(map(value, paths)), abs_tol=1e-4)


def test_held_out_accuracy(spark):
    rows = QUERIES["op3_language_spans"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = [r["lang"] == r["lang_pred"] for r in rows.where("held_out AND lang IS NOT NULL").collect()]
    assert sum(right) >= 0.97 * len(right)


# Tokens


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_tokens_equal_the_library(spark, vocabulary):
    ranks = dict(zip(vocabulary.hash.keys, vocabulary.ids))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    point = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x500), r.randrange(0xE000, 0x33500), 32, 10]))
    texts = [None, "", " ", "a" * 3000, "ab" * 2000, "it's  \n\n fine ", "\x00\x01", "<|endoftext|>", "a\U00010ee7a1"]
    texts += ["".join(point() for _ in range(60)) for _ in range(200)]
    docs = documents(spark, [(i, t, None, "s") for i, t in enumerate(texts)])
    rows = tokens.decode(tokens.encode(docs, vocabulary), vocabulary).collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert np.frombuffer(x["ids"], "<u4").tolist() == library.encode_ordinary(x["text"] or "")
        assert bytes(x["decoded"]) == (x["text"] or "").encode()
    assert tokens.encode(docs.where("false"), vocabulary).count() == 0


def test_perfect_hash_is_minimal(vocabulary):
    h = vocabulary.hash
    assert len(set(h.keys)) == h.size == len(vocabulary.ids) and all(h.find(k) == i for i, k in enumerate(h.keys))
    assert h.find(b"no such piece in it") == -1


# Vectors


def vector_table(spark):
    r = np.random.default_rng(6)
    centre = r.normal(size=(6, 8))
    rows = []
    for i in range(300):
        v = centre[r.integers(6)] + r.normal(size=8) * r.choice([0.0, 0.05, 0.12])
        rows.append((i, [float(np.float32(x)) for x in v * r.choice([1.0, 3.0])], int(r.integers(2))))
    rows += [(i, rows[0][1], 0) for i in range(400, 460)]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 8, 0), (503, [1.0, None] * 4, 0), (504, [float("nan")] * 8, 1), (505, [float("inf")] * 8, 1), (506, rows[0][1], None), (507, [1.0, 2.0], 0), (508, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    return rows, spark.createDataFrame([(*x, "clash", 1.0) for x in rows], "vec_id long, embedding array<float>, label int, cell string, class double")


def test_metric_range_join(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 20)
    monkeypatch.setattr(vectors, "TILE", 16)
    rows, table = vector_table(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table).collect()}
    assert len(got) == len(rows)
    ok = [(i, np.array(v, float), g) for i, v, g in rows if i is not None and v and g is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: {j for j, w, h in ok if j != i and h == g and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} for i, v, g in ok}
    root = {i: i for i in links}
    for _ in range(len(links)):
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
        if new == root:
            break
        root = new
    for i, _, _ in rows:
        n, c = (len(links[i]), root[i]) if i in links else (0, i)
        assert got[i] == (n, c, i is not None and i == c)
    assert vectors.near_duplicates(table.where("false")).count() == 0


def test_exact_top_k(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(vectors, "TILE", 8)
    rows, table = vector_table(spark)
    got = [tuple(r) for r in vectors.top_k(table, F.col("vec_id") % 20 == 0, k=5, cells=9).collect()]
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in ok:
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in ok if j != i and len(w) == len(v))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert vectors.top_k(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_exact_top_k_of_repeated_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(vectors, "TILE", 8)
    rows, _ = vector_table(spark)
    rows += [rows[0]] * 2 + [(20, rows[7][1], 0), (40, [3.0, 1.0], 0)] + [(60, [1000.0] * 8, 0)] * 9 + [rows[3]] * 3
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in {(i, tuple(v)) for i, v in ok if i % 20 == 0}:
        best = sorted((-int(np.array(v) @ w), j) for j, w in ok if j != i and len(w) == len(v))[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    for cells in (9, 60):
        got = [tuple(r) for r in vectors.top_k(table, F.col("vec_id") % 20 == 0, k=5, cells=cells).collect()]
        assert sorted(got) == sorted(want)


def test_groups_of_queries_are_bundled(monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 5)
    pivots = {2: np.random.default_rng(1).normal(size=(30, 2)), 3: np.zeros((1, 3))}
    asked = {**{(2, c): 1 + c % 9 for c in range(1, 30)}, (3, 0): 130}
    bundles, waves = vectors._bundles(asked, pivots)
    held = np.bincount([bundles[cell] for cell in asked], list(asked.values()))
    assert set(bundles) == set(asked) and len({b for (d, _), b in bundles.items() if d == 2}) < 8
    assert max(held[:-1]) <= 40 and waves == [1] * (len(held) - 1) + [4]


def test_exact_top_k_by_small_pieces(spark, monkeypatch):
    from pyspark.sql import functions as F

    for name, value in (("TILE", 3), ("SLICE", 4), ("PIECE", 7), ("_AT_ONCE", 64)):
        monkeypatch.setattr(vectors, name, value)
    v = np.random.default_rng(2).normal(size=(900, 6)).astype("f4")
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    whole = np.floor(64 * v.astype(float)).astype(int)
    want = []
    for q in range(0, 900, 5):
        best = sorted((-int(s), j) for j, s in enumerate(whole @ whole[q]) if j != q)[:4]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in vectors.top_k(table, F.col("vec_id") % 5 == 0, k=4, cells=25).collect()) == want


# Archives


def test_archives_round_trip(spark):
    r = random.Random(7)
    html = ["", None, "é\r\n\r\nWARC/1.1\r\n\r\n" * 9, "x" * 1000, "same", "same", "same"] + ["".join(r.choices("ab\r\né", k=r.randint(0, 900))) for _ in range(60)]
    rows = [(i, f"http://a/{i}\n", h, "clash") for i, h in enumerate(html)] + [(None, None, "null id", "clash"), (5, "http://again", "same", "clash")]
    path = shared_folder(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3), path, chunk=100)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, path).collect())
    largest = {}
    for i, _, h, _ in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    want = Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first = largest.get(h or "", i)
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want[i, len(b), digest, "response" if first == i else "revisit", None if first == i else first] += 1
    assert got == want
    raw = b"".join(gzip.decompress(bytes(f["content"])) for f in spark.read.format("binaryFile").load(path).collect())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"WARC-Segment-Number: 2\r\n" in raw


def test_large_payloads_in_one_segment_and_in_several(spark):
    r = random.Random(4)
    letters = [chr(97 + r.randrange(26)) for _ in range(5000)]
    rows = [(i, "u", "".join(r.choices(letters, k=size))) for i, size in enumerate([300_000, 900_000, 1 << 20, 3_000_000, (1 << 20) + 1, 262_144])]
    path = shared_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    pieces = {}
    for c in warc.read_chunks(spark, path).collect():
        pieces.setdefault(c["page_id"], []).append((c["part"], bytes(c["data"] or b"")))
    for i, _, html in rows:
        parts = [part for part, _ in pieces[i]]
        assert len(set(parts)) == len(parts)  # whatever order they come in
        if len(parts) > 1:
            assert b"".join(d for _, d in sorted(pieces[i])) == html.encode()
    got = {x["page_id"]: (x["payload_bytes"], x["payload_digest"]) for x in warc.read_records(spark, path).collect()}
    assert got == {i: (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows}


def test_archives_are_bounded_and_an_empty_table_is_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 10 * (warc.CHUNK + warc._HEADER))
    path = shared_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(i, "u", f"{i}") for i in range(45)], "page_id long, url string, html string").coalesce(1), path)
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) == 5 and warc.read_records(spark, path).count() == 45
    empty = shared_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_records(spark, empty).collect() == []



# Tool calls


def test_tool_calls(spark):
    schema = {"add": {"a": ("integer", True), "b": ("number", False), "tags": ("array", False)}}
    calls = [
        (1, "x", "add", '{"b": 2.50, "a": 1}', None, 0), (1, "y", "add", '{"a":1,"tags":["é"]}', "x", 0), (1, "z", "add", '{"a":"1"}', "y", 0), (1, "c1", "add", '{"a":1}', "c2", 0),
        (1, "c2", "add", '{"a":1}', "c1", 0), (1, "lost", "add", '{"a":1}', "gone", 0), (1, "after", "add", '{"a":1}', "lost", 0), (1, "twice", "add", '{"a":2}', None, 0),
        (1, "twice", "add", '{"a":1}', None, 0), (1, "what", "mul", "{}", None, 0), (1, "bad", "add", "{a", None, 0), (1, "null", "add", None, None, 0), (1, "extra", "add", '{"a":1,"q":1}', None, 0),
        (1, "open", "add", '{"a":1}', None, 0), (2, "x", "add", '{"a":1}', None, 0), (None, "x", "add", '{"a":1}', None, 0), (1, None, "add", '{"a":1}', None, 0),
    ] + [(3, f"k{i}", "add", '{"a":1}', f"k{i - 1}" if i else None, 0) for i in range(40)]
    results = [(1, k, "v\n\"") for k in ("x", "y", "z", "c1", "after", "twice", "what", "bad", "null", "extra")] + [(1, "x", "a"), (2, "x", None), (9, "orphan", "v"), (None, "x", "v")]
    made = toolcalls.link_tool_calls(spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, after string, position int"), spark.createDataFrame(results, "conv_id long, call_id string, content string"), schema)
    rows = {(r["conv_id"], r["call_id"]): r for r in made.collect()}
    assert len(rows) == len({c[:2] for c in calls})
    status = {k[1]: r["status"] for k, r in rows.items() if k[0] == 1}
    assert status == {"x": "ok", "y": "ok", "z": "invalid_arguments", "c1": "blocked", "c2": "blocked", "lost": "blocked", "after": "blocked", "twice": "duplicate", "what": "unknown_tool", "bad": "invalid_arguments", "null": "invalid_arguments", "extra": "invalid_arguments", "open": "no_result", None: "unlinkable"}
    assert rows[1, "z"]["position"] == 3 and rows[2, "x"]["status"] == "ok" and rows[None, "x"]["status"] == "unlinkable"
    assert [rows[3, f"k{i}"]["position"] for i in range(40)] == list(range(1, 41))
    for r in rows.values():
        record = json.loads(r["record"])
        assert list(record) == sorted(record) and r["record"].startswith('{"after":')
    assert '"arguments":{"a":1,"b":2.5}' in rows[1, "x"]["record"] and json.loads(rows[1, "x"]["record"])["result"] == "a"
    assert "é" in rows[1, "y"]["record"] and "Python" not in made._jdf.queryExecution().toString()
    none = toolcalls.link_tool_calls(spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, after string, position int").where("false"), spark.createDataFrame(results, "conv_id long, call_id string, content string"), schema)
    assert none.count() == 0


# Pipeline


def test_pipeline_stages(spark):
    from test_spans import bytes_left, components as groups

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12 34", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns = corpus_pipeline.COLUMNS
    stage = [f for _, f in corpus_pipeline.STAGES]
    known = corpus_pipeline.stored(stage[0](spark, docs, SF), "a")
    assert known.columns == columns and {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in known.select("doc_id").collect()} == {9001, 9002}
    single = corpus_pipeline.stored(stage[1](spark, known, SF), "b")
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _, c in groups(rows) if i == c) and single.columns == columns
    cut = corpus_pipeline.stored(stage[2](spark, single, SF), "c")
    left = bytes_left([(r["doc_id"], r["text"]) for r in single.collect()])
    assert cut.columns == columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {i: x[-1].decode("utf-8", "ignore") for i, x in left.items()}
    mixed = corpus_pipeline.stored(stage[3](spark, cut, SF), "d")
    assert mixed.columns == columns and mixed.count() > 0
    out = stage[4](spark, mixed, SF).collect()
    assert len(out) == mixed.count() and all(r["exact"] for r in out)
