"""Language of mixed-language text: script ranges, per-word scores, and a Viterbi pass with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesloom.llm.text import LOWER, SLICE, slices, spaces, words

TABLE = 1 << 16  # cells of the gram table of one language
MAX_LANGUAGES = 1000
SWITCH = 8.0  # what a change of language between two words costs, in nats
TOGETHER = 1 << 21  # bytes of text whose documents advance together: a step costs the same for few and for many
LEAST_SHARE = 0.01  # of a language's training words in a script, for the script to make it a candidate
_FAR = np.float32(-1e4)
# First code points of script ranges of the Unicode standard, and the script that begins there.
RANGES = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00C0, "latin"),
    (0x0250, "none"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "other"),
]
SCRIPTS = list(dict.fromkeys(name for _, name in RANGES))
_STARTS = np.array([a for a, _ in RANGES])
_CODES = np.array([SCRIPTS.index(name) for _, name in RANGES], np.int8)


def _scripts() -> tuple[np.ndarray, np.ndarray]:
    """Script of a one-byte character, and of a longer one by its first two bytes."""
    one = _CODES[np.searchsorted(_STARTS, np.arange(256), "right") - 1]
    lead, after = np.divmod(np.arange(1 << 16), 256)
    point = np.where(lead < 0xE0, (lead & 31) << 6 | (after & 63), (lead & 15) << 12 | (after & 63) << 6)
    two = _CODES[np.searchsorted(_STARTS, point, "right") - 1]
    two[(lead < 0xC0) | (lead >= 0xF0)] = 0
    return one, two


_ONE, _TWO = _scripts()


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cell of the gram that ends at each byte, word starts and ends, first word of each document,
    and the script and letters of each word."""
    starts, ends, first = words(data, offsets)
    low = LOWER[data].astype(np.uint32)
    low[spaces(data)] = 32
    back1, back2 = np.full(len(low), 32, np.uint32), np.zeros(len(low), np.uint32)
    back1[1:], back2[2:] = low[:-1], low[:-2]
    back1[starts], back2[starts] = 32, 0
    inner = starts[starts + 1 < len(low)] + 1
    back2[inner] = 32
    key = (back2 << np.uint32(16) | back1 << np.uint32(8) | low).astype(np.uint64)
    cell = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32)
    pair = data.astype(np.int32) << 8
    pair[:-1] |= data[1:]
    script = np.where(data < 128, _ONE[data], np.where((data >= 0xC0) & (data < 0xF0), _TWO[pair], 0)).astype(np.int8)
    letters = script > 0
    total = np.concatenate([[0], np.cumsum(letters)])
    n_letters = total[ends] - total[starts]
    where = np.flatnonzero(letters)
    kind = np.zeros(len(starts), np.int8)
    has = n_letters > 0
    kind[has] = script[where[np.searchsorted(where, starts[has])]]  # that of the word's first letter
    return cell, starts, ends, first, kind, n_letters


@dataclass
class Model:
    """Log-probabilities of gram cells and the candidate languages of each script."""

    langs: list[str]
    table: np.ndarray  # (cells, languages)
    candidate: np.ndarray  # (scripts, languages)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts of byte grams and of scripts per language over all rows with a text and a language.

    Tasks add up whole tables before the shuffle; the driver gets at most TABLE + len(SCRIPTS) counts per language,
    whatever the input. More than MAX_LANGUAGES languages are refused.
    """
    names = sorted(r[0] for r in docs.select(lang).where(F.col(lang).isNotNull()).distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"at most {MAX_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, offsets in slices(batch.column(0)):
                cell, starts, ends, first, kind, _ = _grams(data, offsets)
                inside = ~spaces(data)
                for name in set(labels[lo:hi]):
                    mine = labels[lo:hi] == name
                    total = sums.setdefault(name, np.zeros(TABLE + len(SCRIPTS), np.int64))
                    total[:TABLE] += np.bincount(cell[np.repeat(mine, np.diff(offsets)) & inside], minlength=TABLE)
                    total[TABLE:] += np.bincount(kind[np.repeat(mine, np.diff(first))], minlength=len(SCRIPTS))
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "cell": at.astype("int32"), "n": total[at]})

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    counts = rows.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((TABLE + len(SCRIPTS), len(names)))
    np.add.at(table, (counts["cell"].to_numpy(), counts["lang"].map({n: i for i, n in enumerate(names)}).to_numpy("int64")), counts["n"].to_numpy())
    grams, scripts = table[:TABLE], table[TABLE:]
    logs = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * TABLE)) if names else grams
    return Model(names, logs.astype("float32"), scripts >= LEAST_SHARE * np.maximum(1, scripts[1:].sum(0)))


def _scores(data: np.ndarray, offsets: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each word in each language, first word of each document, and the letters of each word.

    Bytes are scored in runs of documents of about ``SLICE`` bytes: what is held for each byte is some fifty times its
    size, what is kept of a word little.
    """
    parts, n_words, lo = [], 0, 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        cell, starts, ends, first, kind, letters = _grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        scores = np.empty((len(starts), len(m.langs)), np.float32)
        for j in range(len(m.langs)):
            total = np.zeros(len(cell) + 1)
            np.cumsum(m.table[cell, j], out=total[1:])
            scores[:, j] = total[ends] - total[starts]
        scores += np.where(m.candidate[kind] | ~m.candidate[kind].any(1, keepdims=True), np.float32(0), _FAR)
        scores[letters == 0] = 0
        parts.append((scores, first[:-1] + n_words, letters))
        n_words, lo = n_words + len(starts), hi
    scores, first, letters = (np.concatenate(x) for x in zip(*parts))
    return scores, np.append(first, n_words), letters


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word: the path of highest score less ``switch`` per change, for all documents at once.

    Documents advance word by word together, the longest first, so that those still running are a leading block.
    Only differences to the best language are kept: d' = max(d, -switch) + score, then less its maximum. Ties go to the
    language that comes first, and to staying.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], first[:-1][order]
    n_words, n_langs = scores.shape
    stay = np.zeros((n_words, n_langs), bool)
    best = np.zeros(n_words, np.int16)
    steps = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(steps), "left")  # documents longer than each step
    d = np.zeros((len(length), n_langs), np.float32)
    for t in range(steps):
        m = running[t]
        at = begin[:m] + t
        here = d[:m]
        stay[at] = here >= -switch
        here = np.maximum(here, -switch) + scores[at]
        best[at] = here.argmax(1)
        d[:m] = here - here.max(1, keepdims=True)
    path = np.zeros(n_words, np.int16)
    state = np.zeros(len(length), np.int16)
    for t in range(steps - 1, -1, -1):
        m = running[t]
        at = begin[:m] + t
        ends = length[:m] == t + 1
        state[:m][ends] = best[at[ends]]
        path[at] = state[:m]
        if t:
            moved = ~stay[at, state[:m]]
            state[:m][moved] = best[at[moved] - 1]
    return path


def label(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` (first word, words, language) of the whole text.

    The script of a word narrows its candidates; its score is the sum of its grams' log-probabilities. The language
    with most letters wins and its share of the letters is the score; ``und`` and 0 where the text is null, has no
    letter or nothing was learned. Equal shares go to the language that comes first. Columns of these names are
    replaced, others stay. Nothing but the text is read; a document is one row of a batch however long it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TABLE x MAX_LANGUAGES
    added = ["lang_pred", "score", "spans"]
    kept = docs.drop(*added).withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    span = pa.struct([("from_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.langs, object)
        for batch in batches:
            n = batch.num_rows
            langs, share, runs = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            lettered = batch.column("_letters").to_pylist()
            for lo, hi, data, offsets in slices(batch.column(text), TOGETHER):
                if not len(names) or not len(data):
                    continue
                scores, first, letters = _scores(data, offsets, m)
                if not len(scores):
                    continue
                path = viterbi(scores, first, switch)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                weight = np.bincount(doc * len(names) + path, np.maximum(letters, 0), (hi - lo) * len(names)).reshape(hi - lo, -1)
                # A text may hold letters outside all ranges: then its words count evenly.
                plain = np.bincount(doc * len(names) + path, None, (hi - lo) * len(names)).reshape(hi - lo, -1)
                weight = np.where(weight.sum(1, keepdims=True) > 0, weight, plain)
                turn = np.flatnonzero(np.diff(path, prepend=-1) | np.diff(doc, prepend=-1))
                size = np.diff(turn, append=len(path))
                for a, b in zip(turn, size):
                    runs[lo + doc[a]].append((int(a - first[doc[a]]), int(b), names[path[a]]))
                for i in np.flatnonzero(np.diff(first)):
                    if lettered[lo + i]:
                        j = weight[i].argmax()
                        langs[lo + i], share[lo + i] = names[j], weight[i, j] / weight[i].sum()
            keep = [(c, f) for c, f in zip(batch.columns, batch.schema.names) if f != "_letters"]
            out = [pa.array(langs, pa.string()), pa.array(share), pa.array(runs, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([c for c, _ in keep] + out, [f for _, f in keep] + added)

    schema = StructType([*docs.drop(*added).schema, *StructType.fromDDL("lang_pred string, score double, spans array<struct<from_word: long, n_words: long, lang: string>>")])
    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def predict(docs: DataFrame) -> DataFrame:
    """``docs`` labelled by what the rows with a remainder other than 1 teach; a null id is not held out."""
    model = learn(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return label(docs, model)
