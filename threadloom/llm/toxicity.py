"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence scores sigmoid(bias + sum of its words' weights); a word weighs what
it and its shape (first letters and length) weigh. A document is toxic
if any sentence is, so its score is the noisy-or 1 - prod(1 - sentence score).
Only documents carry labels; the gradient of the noisy-or shares each label out
among the sentences, and afterwards the sentence scores locate the offence.

Fitting takes a bounded sample of labelled documents (``max_toxic`` and
``max_clean`` rows, the smallest hashes of id and text; each label is weighted back to its share of
all labelled documents). Words are hashed and split into sentences on the executors; what
reaches the driver is that sample, as numbers. Scoring is one narrow pass.

Defined results: null, empty and wordless texts have the score of a document
without sentences' evidence, one empty sentence; a sample without both labels
gives every document the share of toxic labels; an id labelled both ways counts
as toxic, null labels are left out; rows that repeat id and text teach once; repeated documents
give repeated rows; the order and partitions of the tables do not matter; whole
texts are read, however long; other columns are not carried, so names cannot
clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_table, held_out, pick, rest, slices, write_table

#: A word, or the end of a sentence.
TOKEN = re.compile(r"\w+|[.!?\n]")
END = -1e9
ENDS = dict.fromkeys(".!?\n", END)
MAX_TOXIC, MAX_CLEAN = 3000, 6000
MIN_DOCS = 4
L1 = 4e-4
STEPS = 150
#: Words whose weights a worker keeps; others are looked up each time.
KEPT_WORDS = 200_000
THRESHOLD = 0.3
FLOOR = 1e-9


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(word: str) -> tuple[int, int]:
    """Hashes of the word and of its shape. A shape has a | , so that it is never a word."""
    return xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(f"{word[:5]}|{len(word)}")


class Features(dict):
    """The features of words, kept for as many as KEPT_WORDS."""

    def __missing__(self, word: str) -> tuple[int, int]:
        found = features(word)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


class Weights(dict):
    """The weight of any word, computed when first asked for."""

    def __init__(self, known: dict[int, float]):
        super().__init__(ENDS)
        self.known = known

    def __missing__(self, word: str) -> float:
        found = sum(self.known.get(f, 0.0) for f in features(word))
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


class Model:
    """Weights of features, and a bias. With a prior, every text has that score."""

    def __init__(self, known: dict[int, float], bias: float, prior: float | None = None):
        self.known, self.bias, self.prior = known, bias, prior
        self.weights = Weights(known)

    def forget(self) -> None:
        """Frees the words kept, as other work may follow in this worker."""
        self.weights = Weights(self.known)
        rest()

    def __reduce__(self):
        return Model, (self.known, self.bias, self.prior)

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all sentences that have words, and the number of the text of each."""
        of, flat, counts = self.weights.__getitem__, [], []
        for text in texts:
            tokens = TOKEN.findall(text.lower()) if text else ()
            flat += map(of, tokens)
            flat.append(END)
            counts.append(len(tokens) + 1)
        weights = np.array(flat)
        end = weights == END
        stops = np.flatnonzero(end)
        logit = np.add.reduceat(np.where(end, 0, weights), np.append(0, stops[:-1] + 1)) if len(stops) else np.zeros(0)
        some = np.diff(np.append(-1, stops)) > 1
        owner = np.repeat(np.arange(len(texts)), counts)[end]
        return sigmoid(logit[some] + self.bias), owner[some]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The noisy-or of each text's sentences; a text without any has one empty sentence."""
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        p, owner = self.sentences(texts)
        miss = np.bincount(owner, np.log1p(-np.minimum(p, 1 - FLOOR)), len(texts))
        miss[np.bincount(owner, minlength=len(texts)) == 0] = -np.log1p(np.exp(self.bias))
        return np.clip(-np.expm1(miss), 0, 1)

    def offending(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, float]]:
        """The sentences of a text that score at least threshold, with their scores."""
        spans = [s for s in re.findall(r"[^.!?\n]+[.!?\n]?", text or "") if re.search(r"\w", s)]
        p, owner = self.sentences(spans)
        best = np.zeros(len(spans))
        np.maximum.at(best, owner, p)
        return [(s.strip(), float(x)) for s, x in zip(spans, best, strict=True) if x >= threshold]


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: tuple[int, int], id_col: str = "doc_id", fold_out: bool = True) -> tuple[DataFrame, tuple[float, float]]:
    """Labelled docs(doc_id, text) as (doc_id, text, label, tie) without the held-out fold, at most so many rows of label 0 and 1, those with the smallest hashes; and the weight that each label's rows stand for.

    Ids are bounded first, then rows, as one id may have many. What is broadcast has that bound, and no other text is shuffled.
    """
    known = pick(labels, id_col, label_col).toDF("doc_id", "label").where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    if fold_out:
        known = known.where(~held_out(F.col("doc_id")))
    counts = dict(known.groupBy("label").count().collect())

    def least(rows: DataFrame, *order) -> DataFrame:
        parts = [rows.where(F.col("label") == k).orderBy(*order).limit(n) for k, n in enumerate(most)]
        return F.broadcast(parts[0].unionByName(parts[1]))

    weight = tuple(max(1.0, counts.get(k, 0) / n) for k, n in enumerate(most))
    tied = docs.join(least(known, F.xxhash64("doc_id"), "doc_id"), "doc_id").withColumn("tie", F.xxhash64("doc_id", "text"))
    chosen = least(tied.groupBy("doc_id", "tie").agg(F.first("label").alias("label")), "tie", "doc_id")
    return tied.join(chosen.select("doc_id", "tie"), ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"]), weight


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, min_docs: int = MIN_DOCS, steps: int = STEPS, l1: float = L1, fold_out: bool = True) -> Model:
    """A model of the labels. Features in fewer than min_docs documents of the sample have no weight; the L1 penalty keeps those at 0 that carry no evidence."""
    chosen, weight = sample(pick(docs, id_col, text_col).toDF("doc_id", "text"), labels, label_col, (max_clean, max_toxic), id_col, fold_out)
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("label", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary())])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            for part, texts in chunks(batch):
                words, sizes = [], []
                for text in texts:
                    flat, own = [], [0]
                    for w in TOKEN.findall((text or "").lower()):
                        if w in ENDS:
                            own.append(0)
                        else:
                            flat += of[w]
                            own[-1] += 2
                    words.append(np.array(flat, "u8").tobytes())
                    sizes.append(np.array([n for n in own if n], "i4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), part.column(3).cast(pa.int32()), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], schema=schema)

    rows = chosen.select("doc_id", "text", "tie", "label").mapInArrow(bags, "doc_id bigint, tie bigint, label int, words binary, sizes binary")
    found = write_table(rows, "bags")
    y, words, sizes, n_sent = [], [], [], []
    for row in found.orderBy("tie", "doc_id").toLocalIterator():
        y.append(float(row.label))
        words.append(np.frombuffer(row.words, "u8"))
        sizes.append(np.frombuffer(row.sizes, "i4"))
        n_sent.append(len(sizes[-1]))
    drop_table(found)
    if len(set(y)) < 2:
        return Model({}, 0.0, sum(y) / len(y) if y else 0.0)
    # features by number, without those of few documents
    names, count = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    names = names[count >= min_docs]
    ids, sent, base = [], [], 0
    for k, own in enumerate(sizes):
        w, words[k] = words[k], None
        at = np.minimum(np.searchsorted(names, w), max(0, len(names) - 1))
        kept = names[at] == w if len(names) else np.zeros(len(w), bool)
        ids.append(at[kept].astype("i4"))
        sent.append((np.repeat(np.arange(len(own), dtype="i4"), own)[kept] + base).astype("i4"))
        base += len(own)
    flat, place = np.concatenate(ids), np.concatenate(sent)
    del ids, sent, words
    w, b = train(flat, place, np.repeat(np.arange(len(y), dtype="i4"), n_sent), np.array(y), len(names), np.array(weight), steps, l1)
    return Model({int(f): float(x) for f, x in zip(names, w, strict=True) if x}, b)


class Sums:
    """Sums of values by group: of values[at], where at and group are given once. Few bytes an entry: a place, and nothing but parts while summing."""

    PART = 1 << 20

    def __init__(self, at: np.ndarray, group: np.ndarray, n: int):
        """group must be in order."""
        self.at, self.n = at, n
        self.group = np.flatnonzero(np.append(len(group) > 0, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
        self.name = group[self.group]

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if not len(self.at):
            return out
        found, ends = np.zeros(len(self.group)), np.append(self.group[1:], len(self.at))
        first = 0
        while first < len(self.group):  # whole groups, about PART entries at once
            last = max(first + 1, int(np.searchsorted(ends, self.group[first] + self.PART, "right")))
            a, b = int(self.group[first]), int(ends[last - 1])
            found[first:last] = np.add.reduceat(values[self.at[a:b]], self.group[first:last] - a)
            first = last
        out[self.name] = found
        return out


def train(ids: np.ndarray, sent: np.ndarray, owner: np.ndarray, y: np.ndarray, n_features: int, weight: np.ndarray, steps: int, l1: float) -> tuple[np.ndarray, float]:
    """Proximal Adam on the noisy-or's weighted log loss: weights and bias. ids are features in sentences sent, which are in order, of documents owner."""
    n, m = len(y), len(owner)
    of_sentence = Sums(ids, sent, m)
    order = np.argsort(ids, kind="stable").astype("i4")
    of_feature = Sums(sent[order], ids[order], n_features)
    del order
    w, b = np.zeros(n_features), -6.0
    m1, m2 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    rate, share = 0.3, weight[y.astype(int)]
    share = share / share.sum()
    for t in range(1, steps + 1):
        p = sigmoid(b + of_sentence.of(w))
        miss = np.bincount(owner, np.log1p(-np.minimum(p, 1 - FLOOR)), n)
        doc = np.clip(-np.expm1(miss), FLOOR, 1 - FLOOR)
        # d loss / d logit of a sentence: p for a clean document, -(1 - doc) / doc * p for a toxic one
        pull = p * (np.where(y > 0, -(1 - doc) / doc, 1.0) * share)[owner]
        grad = np.append(of_feature.of(pull), pull.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = rate / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        move = step * m1 / (1 - 0.9**t)
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - step[:-1] * l1, 0)
        b -= move[-1]
        if t in (steps // 2, steps * 3 // 4):
            rate /= 3
    return w, float(b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score, and its highest-scoring sentence that offends, if any. Narrow."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part, texts in chunks(batch):
                p = model.score(texts)
                worst = [max(model.offending(t), key=lambda x: x[1], default=(None,))[0] if s >= THRESHOLD else None for t, s in zip(texts, p.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(p), pa.array(worst, pa.string())], schema=schema)
        model.forget()

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double, sentence string")


def scorer(docs: DataFrame, model: Model):
    """The score as a function of a text column."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.concatenate([np.zeros(0), *[held.value.score(some) for some in slices(texts)]]))
        held.value.forget()

    return of
