"""Licence scans against a plain scan over words, and the expression parser against recursive descent."""

import random
import re

import pytest

from seriesloom.llm import licenses
from seriesloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PHRASES = {**{p: p for p in licenses.BASE}, **{p: p for p in licenses.NOTICES}}


def plain(text):
    """Words, base places, labels and score of a text without tags, word by word."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for table, kind in ((licenses.BASE, "base"), (licenses.NOTICES, "notice")):
        for phrase, label in table.items():
            p = phrase.split()
            hits += [(i, i + len(p), kind, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    base = [h for h in hits if h[2] == "base"]
    free = [h for h in hits if not any(o[0] <= h[0] and h[1] <= o[1] and o[:2] != h[:2] for o in hits)]
    return (
        len(words), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None),
        ",".join(sorted({h[3] for h in base})), ",".join(sorted({h[3] for h in hits})),
        min((licenses.FREEDOM[h[3]] for h in free), default=1.0),
    )


def scanned(spark, rows, schema="doc_id long, text string, labels string, score int, n_words string"):
    df = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], schema).repartition(2)
    return licenses.scan_licenses(df).collect()


def test_query_against_word_scan(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_license_scan"](spark, SF).collect()
    assert len(got) == len(docs) and sum(r["n_base"] for r in got) > 0
    for r in got:
        assert tuple(r)[1:] == plain(docs[r["doc_id"]]), r


def test_phrases_in_all_forms(spark):
    r = random.Random(5)
    pieces = [*licenses.BASE, *licenses.NOTICES, "MIT", "License", "mit\n* License", "Apache-License,\tVersion 2.0", "é", "ü mit license", "x1", "general", "\x00"]
    texts = [r.choice([" ", "\n", "-", "; ", "\x7f", "é "]).join(r.choice(pieces) for _ in range(r.randrange(1, 12))) for _ in range(300)]
    texts += [None, "", " ", "MIT License", "MIT License" * 3, "mit license mit license", "mit", "license", "İmit license", "mit licensé"]
    got = {r["doc_id"]: tuple(r)[1:8] for r in scanned(spark, enumerate(texts))}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_long_text_null_ids_and_repeated_rows(spark):
    long = "word " * 400_000 + "MIT License " + "w " * 200_000 + "general public license"
    rows = [(1, long), (None, "mit license"), (None, None), (2, "isc license"), (2, "isc license")]
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["first_word"], r["last_word"], r["labels"]) for r in scanned(spark, rows)), key=str)
    assert got == sorted([(1, 600_005, 400_000, 600_002, "gpl,mit"), (0, 2, 0, 0, "mit"), (0, 0, None, None, ""), (2, 2, None, None, "isc"), (2, 2, None, None, "isc")], key=str)


def test_empty_table(spark):
    assert scanned(spark, []) == []


def descend(tokens):
    """(freedom, licences) of a well-formed expression by recursive descent."""

    def level(ops):
        value = level(ops[1:]) if ops else atom()
        while ops and tokens and tokens[0].lower() == ops[0]:
            tokens.pop(0)
            other = level(ops[1:])
            if ops[0] == "with":
                value = max(value[0], licenses.EXCEPTION_FREEDOM), value[1]
            else:
                value = (max if ops[0] == "or" else min)(value[0], other[0]), value[1] | other[1]
        return value

    def atom():
        t = tokens.pop(0)
        if t == "(":
            value = level(["or", "and", "with"])
            assert tokens.pop(0) == ")"
            return value
        name = licenses.identifier(t.lower())
        return licenses.FREEDOM.get(name, licenses.OTHER_FREEDOM), {name}

    return level(["or", "and", "with"])


def test_expressions_against_recursive_descent():
    r = random.Random(9)

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            name = r.choice(["MIT", "GPL-2.0-or-later", "Apache-2.0", "CC-BY-NC-4.0", "LicenseRef-x", "MPL-2.0+"])
            return [name] + (["WITH", "Some-exception"] if r.random() < 0.2 else [])
        inner = make(depth - 1) + [r.choice(["AND", "or", "Or", "and"])] + make(depth - 1)
        return ["(", *inner, ")"] if r.random() < 0.5 else inner

    for _ in range(500):
        tokens = make(4)
        value, names, text = licenses.evaluate(licenses.parse((": " + " ".join(tokens)).encode()))
        assert (value, names) == descend(list(tokens))
        again = licenses.evaluate(licenses.parse((":" + text).encode()))
        assert again == (value, names, text)


@pytest.mark.parametrize("raw, postfix", [
    (b": MIT", ["mit"]), (b": MIT OR", ["mit"]), (b": (MIT AND", ["mit"]), (b": MIT OR (", ["mit"]), (b": OR MIT", []), (b": ()", []),
    (b": MIT is fine", ["mit"]), (b": MIT) OR isc", ["mit"]), (b" for all", []), (b"", []), (b': "(MIT OR ISC)",', ["mit", "isc", "or"]),
    (b": MIT or ISC and GPL-2.0 with X.", ["mit", "isc", "gpl-2.0", "x", "with", "and", "or"]), (b": MIT OR ISC OR", ["mit", "isc", "or"]),
])
def test_ends_of_expressions(raw, postfix):
    assert licenses.parse(raw) == postfix


def test_tags(spark):
    rows = [
        (1, "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nMIT OR x"),
        (2, '/* SPDX-License-Identifier: (MIT OR GPL-3.0+) */ the rest, all rights reserved elsewhere'),
        (3, "License-Expression: MIT AND CC-BY-NC-4.0\r\nSPDX-License-Identifier: Nobody-1.0"),
        (4, "the SPDX license identifier of a file"),
        (5, "SPDX-License-Identifier:"),
        (6, "SPDX-License-Identifier: " + "MIT AND " * 5000 + "ISC"),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"], r["expressions"]) for r in scanned(spark, rows)}
    assert got[1] == ("gpl-2.0", 0.6, ["gpl-2.0-only WITH classpath-exception-2.0"])
    assert got[2] == ("all-rights-reserved,gpl-3.0,mit", 0.0, ["mit OR gpl-3.0+"])
    assert got[3] == ("cc-by-nc-4.0,mit,other", 0.1, ["mit AND cc-by-nc-4.0", "nobody-1.0"])
    assert got[4] == got[5] == ("", 1.0, [])
    assert got[6][:2] == ("isc,mit", 0.9) and len(got[6][2][0]) == 5000 * 8 + 3
