"""Language identification: script ranges narrow the candidates of each word, then
Viterbi over per-word scores with a switching penalty labels spans.

A word is a run of letters and their marks; marks alone are none. Its script, by code point ranges,
leaves as candidates the languages that were seen in that script. Its score per
language is the sum of log shares of its character trigrams, hashed to a fixed
number of buckets. The best label sequence pays a penalty for each change of
language, so short borrowings stay inside their span. The document's language
holds most of its letters, and the score is the share that it holds.

Learning takes about ``per_lang`` documents of each language, those whose hash of id and
text lies below the share that gives so many, so every language is learned at every size;
trigram counts are made on the executors, and only bucket sums (buckets times
languages) and one count per language reach the driver. Labelling is one narrow pass. Within a batch,
Viterbi runs over blocks of words in step: per-block transition matrices, a pass
over the blocks of each document, then the blocks' own paths.

Defined results: a null text or one without letters is ``und`` with score 0 and
no spans; words of scripts that no learned language uses carry no evidence; with
nothing to learn from, texts with letters are ``und`` too; equal scores go to the
language first in order; repeated documents give repeated rows; whole texts are
read, however long; other columns are not carried, so names cannot clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, pick, rest, slices

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTH = 0.5
#: Log shares that a change of language costs.
SWITCH = 12.0
PER_LANG = 10_000
BLOCK = 128
CHARS = 2_000_000
#: The least share of a language's letters in a script that makes it a candidate there.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

#: First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
OTHER = len(SCRIPTS) + 1


@cache
def script_table() -> np.ndarray:
    """Of every code point: 0 outside words, else the script's number from 1, OTHER where no range has it."""
    table = np.zeros(0x110000, "u1")
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha() or (code > 0x2FF and unicodedata.category(c)[0] == "M"):
            table[code] = OTHER
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            part = table[a : b + 1]
            part[part > 0] = number
    return table


@cache
def mark_table() -> np.ndarray:
    """Whether each code point may stand in a word only beside a letter."""
    return np.fromiter((script > 0 and not chr(code).isalpha() for code, script in enumerate(script_table())), bool, 0x110000)


class Words:
    """The words of some texts: places of their letters, scripts and trigram buckets."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").replace("İ", "i").lower() for t in texts]
        self.lengths = np.array([len(t) + 1 for t in low], "i8")
        codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        scripts = script_table()[codes]
        letter = scripts > 0
        before = np.append(False, letter[:-1])
        marks = mark_table()[codes]
        if marks.any():
            # runs of marks without any letter are no words
            start, stop = np.flatnonzero(letter & ~before), np.flatnonzero(~letter & before)
            plain = np.cumsum(letter & ~marks)
            bare = plain[stop - 1] - plain[start] + ~marks[start] == 0
            for a, b in zip(start[bare].tolist(), stop[bare].tolist(), strict=True):
                letter[a:b] = False
            before = np.append(False, letter[:-1])
        self.start = np.flatnonzero(letter & ~before)
        self.stop = np.flatnonzero(~letter & before)
        self.script = scripts[self.start]
        self.letters = self.stop - self.start
        self.doc = np.searchsorted(np.cumsum(self.lengths), self.start, "right")
        # Letters, and one place behind each word, where the code is 0.
        at = np.flatnonzero(letter | before)
        c = np.where(letter[at], codes[at], 0).astype("u4")
        self.first = np.cumsum(np.append(0, self.letters + 1))[:-1]
        p1 = np.append(np.uint32(0), c[:-1])
        p1[self.first] = 0
        p2 = np.append(np.uint32(0), p1[:-1])
        p2[self.first] = 0
        mixed = c * np.uint32(0x9E3779B1) ^ p1 * np.uint32(0x85EBCA77) ^ p2 * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        self.bucket = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKET_BITS)


class Model:
    """Languages, log shares of buckets by language, and the candidates of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        """counts: buckets by languages; letters: scripts by languages."""
        self.langs = langs
        if langs:
            shares = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS))
            self.shares = (shares - shares.max(1, keepdims=True)).astype("f4")
            seen = letters >= SCRIPT_SHARE * np.maximum(1, letters.sum(0))
            self.candidates, self.known = np.where(seen.any(1, keepdims=True), seen, True), seen.any(1)

    def scores(self, w: Words) -> np.ndarray:
        """Words by languages."""
        sums = np.add.reduceat(self.shares[w.bucket], w.first, axis=0) if len(w.first) else np.zeros((0, len(self.langs)), "f4")
        sums[~self.known[w.script]] = 0
        sums[~self.candidates[w.script]] = -1e4
        return sums

    def label(self, texts: list[str | None], switch: float = SWITCH) -> tuple[Words, np.ndarray]:
        """The words and the number of each one's language."""
        w = Words(texts)
        return w, viterbi(self.scores(w), np.bincount(w.doc, minlength=len(texts)), switch)

    def predict(self, texts: list[str | None], switch: float = SWITCH) -> list[tuple[str, float, list[dict]]]:
        """(language, score, spans) of each text; spans have characters' places."""
        if not self.langs:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        w, state = self.label(texts, switch)
        k = len(self.langs)
        held = np.bincount(w.doc * k + state, w.letters, len(texts) * k).reshape(-1, k)
        best, total = held.argmax(1), held.sum(1)
        share = held.max(1) / np.maximum(total, 1)
        base = np.cumsum(w.lengths) - w.lengths
        cut = np.flatnonzero(np.append(True, (np.diff(w.doc) != 0) | (np.diff(state) != 0))) if len(state) else np.zeros(0, int)
        last = np.append(cut[1:], len(state)) - 1
        spans: list[list[dict]] = [[] for _ in texts]
        for a, b in zip(cut.tolist(), last[: len(cut)].tolist(), strict=True):
            d = w.doc[a]
            spans[d].append({"lang": self.langs[state[a]], "start": int(w.start[a] - base[d]), "end": int(w.stop[b] - base[d])})
        return [(self.langs[i] if n else UNKNOWN, float(s), x) for i, n, s, x in zip(best, total, share, spans, strict=True)]


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best state of each word, for documents of so many words one after the other; changing state costs switch."""
    n, k = scores.shape
    state = np.zeros(n, "i4")
    if not n:
        return state
    sizes = sizes[sizes > 0]
    blocks = -(-sizes // BLOCK)
    doc_first = np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(sizes)), blocks)
    inside = np.arange(len(doc)) - doc_first[doc]
    start = (np.cumsum(sizes) - sizes)[doc] + inside * BLOCK
    size = np.minimum(BLOCK, sizes[doc] - inside * BLOCK)
    order = np.argsort(-size, kind="stable")
    # what a block makes of each state that it may be entered from; the last block of a document needs none
    enter = np.zeros((len(doc), k), "f4")
    if (blocks > 1).any():
        m = np.full((len(doc), k, k), -1e30, "f4")
        m[:, np.arange(k), np.arange(k)] = 0
        m = m[order]
        for t in range(BLOCK):
            if not (a := int((size[order] > t).sum())):
                break
            d = m[:a]
            m[:a] = np.maximum(d, d.max(2, keepdims=True) - switch) + scores[start[order[:a]] + t][:, None]
        back = np.empty_like(m)
        back[order] = m
        for j in range(1, int(blocks.max())):
            at = doc_first[blocks > j] + j
            made = (enter[at - 1][:, :, None] + back[at - 1]).max(1)
            enter[at] = made - made.max(1, keepdims=True)  # kept small, for exact sums however long the text
    # the blocks' own paths
    v = enter[order]
    came = np.zeros((n, k), "i1")
    own = np.arange(k, dtype="i1")
    for t in range(BLOCK):
        if not (a := int((size[order] > t).sum())):
            break
        d, at = v[:a], start[order[:a]] + t
        top = d.max(1) - switch
        came[at] = np.where(d >= top[:, None], own, d.argmax(1)[:, None])
        v[:a] = np.maximum(d, top[:, None]) + scores[at]
    leave = np.empty_like(v)
    leave[order] = v
    # the state at the end of each block, from each document's last block backwards
    end = leave.argmax(1)
    for j in range(int(blocks.max()) - 2, -1, -1):
        at = doc_first[blocks > j + 1] + j
        end[at] = _entry(enter[at + 1], back[at + 1], end[at + 1])
    cur = end.copy()
    for t in range(BLOCK - 1, -1, -1):
        some = np.flatnonzero(size > t)
        at = start[some] + t
        state[at] = cur[some]
        cur[some] = came[at, cur[some]]
    return state


def _entry(enter: np.ndarray, made: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The states from which blocks were entered that end in these states."""
    return (enter + made[np.arange(len(end)), :, end]).argmax(1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, fold_out: bool = True) -> Model:
    """A model of the languages of documents outside the held-out fold. Repeated rows share a hash, so they are learned from together or not at all."""
    known = pick(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where(F.col("lang").isNotNull())
    if fold_out:
        known = known.where(~held_out(F.col("doc_id")))
    # the share of a language's documents, as a bound of a hash of 62 bits; languages are few
    bounds = {lang: (per_lang << 62) // n for lang, n in known.groupBy("lang").count().collect() if n > per_lang}
    if bounds:
        bound = known.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound bigint")
        place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 2)
        known = known.join(F.broadcast(bound), "lang", "left").where(F.col("bound").isNull() | (place < F.col("bound"))).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in chunks(batch, chars=CHARS):
                langs = np.array(part.column(2).to_pylist())
                w = Words(texts)
                of_gram = np.repeat(w.doc, w.letters + 1)
                for lang in set(langs.tolist()):
                    mine = langs == lang
                    own = np.bincount(w.bucket[mine[of_gram]], minlength=BUCKETS + OTHER + 1).astype("i8")
                    own[BUCKETS:] += np.bincount(w.script[mine[w.doc]], w.letters[mine[w.doc]], OTHER + 1).astype("i8")
                    sums[lang] = sums.get(lang, 0) + own
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "bucket", "n"])

    sums = known.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique().tolist())
    table = np.zeros((BUCKETS + OTHER + 1, len(langs)))
    if langs:
        table[sums["bucket"], sums["lang"].map({x: i for i, x in enumerate(langs)})] = sums["n"]
    return Model(langs, table[:BUCKETS], table[BUCKETS:])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """Per document: doc_id, lang_pred, score, and spans of one language each. Narrow."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part, texts in chunks(batch, chars=CHARS):
                got = model.predict(texts, switch)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], spans)], names=["doc_id", "lang_pred", "score", "spans"])

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")


def sure(docs: DataFrame, model: Model, least: float):
    """Whether a text has a language that holds at least that share of its letters, as a function of a text column."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([lang != UNKNOWN and score >= least for some in slices(texts, CHARS) for lang, score, _ in held.value.predict(some)], dtype=bool)
        rest()

    return of
