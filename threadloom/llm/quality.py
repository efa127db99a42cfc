"""Quality by co-training: two classifiers with a view each teach one another.

The text view sees shares of character classes and of their pairs, repetition of
lines and words; the metadata view sees source, language and length. Both start from a
bounded sample of labelled documents; each round, each labels those of all unlabelled
documents that it is surest of, for the other to learn from.
Each view is calibrated (Platt scaling) on labelled documents set aside, and the
calibrated log-odds are combined, with weights fitted there too, to score all documents.

Features are made on the executors and written once; only those of the labelled sample
reach the driver, where each stands for as many labelled ones as the sample leaves out, so
that labels and pseudo-labels keep their proportion at every size. Which documents a view has labelled follows from its weights and the
bounds of each round, so nothing is kept per document. The bounds are exact ranks, found
digit by digit from counts; the weights come from Newton steps, for which each core sends
one sum of gradients and curvatures. Scoring is one narrow pass.

Defined results: null and empty texts have zero text features; null metadata is a
value of its own; an id labelled both ways counts as 0, null labels are left out;
documents with a null id are unlabelled; equally sure documents go by hash of all their columns,
so that the order and partitions of the table decide nothing but between rows alike; rows of a repeated labelled id
are labelled each; labels of one kind, or none, give every document their mean, or 0.5; repeated
documents give repeated rows; texts are read whole; other columns are not carried,
so names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_table, held_out, pick, write_table

MAX_LABELLED = 8000
ROUNDS = 4
#: Share of the pool that a view labels in a round, the surest of each class by its share among the labels.
TAKE = 0.05
CLASSES = 9
TEXT_DIM = CLASSES + CLASSES * CLASSES + 6
META_DIM = 1 + 64 + 32 + 24
L2 = 1e-3
#: Newton steps at most, and the move of all weights below which a view has settled.
STEPS, SETTLED = 25, 1e-4
#: Labels up to which they are broadcast to their documents, by count (about 40 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@cache
def class_table() -> np.ndarray:
    """Class of each code point: lower, upper, other letter, digit, space, line end, sentence sign, other ASCII sign, other."""
    table = np.full(0x110000, 8, "u1")
    for code in range(0x110000):
        c = chr(code)
        table[code] = 5 if c in "\n\r" else 4 if c.isspace() else 3 if c.isdigit() else 0 if c.islower() else 1 if c.isupper() else 2 if c.isalpha() else 6 if c in ".,;:?'\"()-" else 7 if code < 128 else 8
    return table


def text_features(text: str | None) -> np.ndarray:
    out = np.zeros(TEXT_DIM, "f4")
    if not text:
        return out
    kind = class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype("i4")
    n = len(kind)
    out[:CLASSES] = np.bincount(kind, minlength=CLASSES) / n
    if n > 1:
        out[CLASSES : CLASSES + CLASSES**2] = np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES**2) / (n - 1)
    words, lines = text.split(), text.splitlines()
    out[-6:] = (np.log1p(n) / 10, np.log1p(len(words)) / 10, len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), n / max(1, len(words)) / 10, n / max(1, len(lines)) / 1000)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_DIM, "f4")
    out[0] = np.log1p(max(0, n_chars or 0)) / 10
    out[1 + zlib.crc32(repr(source).encode()) % 64] = 1
    out[65 + zlib.crc32(repr(lang).encode()) % 32] = 1
    out[97 + (min(23, max(0, n_chars).bit_length()) if n_chars is not None else 0)] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Logistic regression on scaled features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = L2, steps: int = 200):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        self.w, self.b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        m1, m2 = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            pull = (sigmoid(z @ self.w + self.b) - y) / len(y)
            grad = np.append(z.T @ pull + l2 * self.w, pull.sum())
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
            move = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
            self.w, self.b = self.w - move[:-1], self.b - float(move[-1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


class Model:
    """Calibrated views and their combination; with a prior, every document has that score."""

    def __init__(self, prior: float | None = None, text: Linear | None = None, meta: Linear | None = None, calm: list[tuple[float, float]] | None = None, mix: tuple[float, float, float] | None = None):
        self.prior, self.text, self.meta, self.calm, self.mix = prior, text, meta, calm, mix

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(text), self.prior)
        a, b = (scale * view.logit(x) + shift for (scale, shift), view, x in zip(self.calm, (self.text, self.meta), (text, meta), strict=True))
        return sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


class Linear:
    """Weights of plain features, with the intercept last."""

    def __init__(self, w: np.ndarray):
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]


def sums(x: np.ndarray, y: np.ndarray, view: Linear) -> np.ndarray:
    """Rows, loss, sums of features and of their squares, gradient and curvature at these weights, in one array."""
    x1 = np.column_stack((x, np.ones(len(x)))).astype("f8")
    logit = x1 @ view.w
    q = sigmoid(logit)
    loss = (np.logaddexp(0, logit) - y * logit).sum()
    return np.concatenate(([len(y), loss], x1.sum(0), (x1**2).sum(0), x1.T @ (q - y), ((x1 * (q * (1 - q))[:, None]).T @ x1).ravel()))


class Newton:
    """Logistic regression on scaled features by damped Newton steps, from sums alone."""

    def __init__(self, w: np.ndarray):
        self.view, self.settled, self.last = Linear(w), False, None

    def step(self, total: np.ndarray) -> None:
        """Moves on by the sums at self.view."""
        k = len(self.view.w)
        n, loss, first, second, grad, curve = total[0], total[1], total[2 : 2 + k], total[2 + k : 2 + 2 * k], total[2 + 2 * k : 2 + 3 * k], total[2 + 3 * k :].reshape(k, k)
        mean = first[:-1] / n
        scale = np.sqrt(np.maximum(0, second[:-1] / n - mean**2)) + 1e-3
        plain = np.diag(np.append(1 / scale, 1.0))  # plain weights of scaled ones
        plain[-1, :-1] = -mean / scale
        held = np.append(np.full(k - 1, L2), 0.0)
        at = np.append(self.view.w[:-1] * scale, self.view.w[-1] + mean @ self.view.w[:-1])
        cost = loss / n + (held * at**2).sum() / 2
        if self.last is not None and cost > self.last[0] + 1e-12:
            move = self.last[2] / 2  # too far: half the way
            at = self.last[1]
            self.last = (self.last[0], at, move)
        else:
            move = -np.linalg.solve(plain.T @ curve @ plain / n + np.diag(held + 1e-9), plain.T @ grad / n + held * at)
            self.last = (cost, at, move)
        self.view = Linear(plain @ (at + move))
        self.settled = bool(np.abs(move).max() < SETTLED)


def learn(starts: list[np.ndarray], known: list[np.ndarray], y: np.ndarray, taught: Callable[[list[Linear | None]], list[np.ndarray | float]], weight: float = 1.0) -> list[Linear]:
    """The views learned from labelled rows, of that weight each, and what taught gives: of each view that is asked for, the sums over its pseudo-labelled rows."""
    views = [Newton(w) for w in starts]
    for _ in range(STEPS):
        more = taught([None if v.settled else v.view for v in views])
        for v, x, extra in zip(views, known, more, strict=True):
            if not v.settled:
                v.step(weight * sums(x, y, v.view) + extra)
        if all(v.settled for v in views):
            break
    return [v.view for v in views]


#: Of sureness, the logit times this, only the whole part counts: the order does not hang on the last bits of a product.
GRAIN = 2**20


def digits(logit: np.ndarray, tie: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """The place of rows in the order of a view's sureness, ties by hash and then by row, as digits from the highest."""
    sure = np.rint(np.clip(logit, -64, 64) * GRAIN).astype("i8")
    return [sure >> 14, sure & 0x3FFF, tie >> 48, (tie >> 32) & 0xFFFF, (tie >> 16) & 0xFFFF, tie & 0xFFFF, row >> 48, (row >> 32) & 0xFFFF, (row >> 16) & 0xFFFF, row & 0xFFFF]


def within(places: list[np.ndarray], bound: tuple[int, ...], end: int) -> np.ndarray:
    """Whether rows are at the bound, given by its first digits, or further towards that end: 0 for low, 1 for high."""
    same, out = np.ones(len(places[0]), bool), np.zeros(len(places[0]), bool)
    for d, b in zip(places, bound, strict=False):
        out |= same & ((d > b) if end else (d < b))
        same &= d == b
    return out | same


class Round:
    """A round's views and, of each view and end, the bound up to which it labels; None where it labels nothing."""

    def __init__(self, views: list[Linear], bounds: dict[tuple[int, int], tuple[int, ...] | None]):
        self.views, self.bounds = views, bounds


def pseudo(past: list[Round], x: list[np.ndarray], tie: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """The labels that each view's rows were given by the other in past rounds; -1 for none."""
    taught = [np.full(len(row), -1, "i1"), np.full(len(row), -1, "i1")]
    for one in past:
        for v in (0, 1):
            logit = one.views[v].logit(x[v])
            places, free, other = digits(logit, tie, row), taught[1 - v] < 0, taught[1 - v].copy()
            for end in (0, 1):
                if (bound := one.bounds[v, end]) is not None:
                    other[free & within(places, bound, end) & ((places[0] * 0x4000 + places[1] > 0) == bool(end))] = end
            taught[1 - v] = other
    return taught


class Pool:
    """All unlabelled documents' features, as a written table."""

    def __init__(self, rows: DataFrame):
        self.rows, self.past = rows, []
        self.size = rows.count()

    def run(self, work: Callable, schema: str) -> DataFrame:
        """What work makes of each batch's views, ties, rows and pseudo-labels; one task a core, so that sums are few."""
        past = self.past

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def parts() -> Iterator[tuple]:
                for batch in batches:
                    if n := batch.num_rows:
                        tie, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                        x = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "f4").reshape(n, -1) for i in (2, 3)]
                        yield x, tie, row, pseudo(past, x, tie, row)

            yield from work(parts())

        rows = self.rows.select("tie", "row", "text", "meta")
        return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).mapInArrow(each, schema)

    def taught(self, views: list[Linear | None]) -> list[np.ndarray | float]:
        """Of each view the sums over the rows that were labelled for it."""
        if not self.past or not self.size:
            return [0.0, 0.0]

        def work(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            total: list = [None, None]
            for x, _, _, labels in parts:
                for v, view in enumerate(views):
                    some = np.flatnonzero(labels[v] >= 0)
                    if view is not None and len(some):
                        own = sums(x[v][some], labels[v][some].astype("f8"), view)
                        total[v] = own if total[v] is None else total[v] + own
            found = [(v, t.tobytes()) for v, t in enumerate(total) if t is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int32()), pa.array([t for _, t in found], pa.binary())], names=["view", "sums"])

        out: list[np.ndarray | float] = [0.0, 0.0]
        for r in self.run(work, "view int, sums binary").collect():
            out[r.view] = out[r.view] + np.frombuffer(r.sums, "f8")
        return out

    def choose(self, views: list[Linear], wanted: tuple[int, int]) -> None:
        """Lets each view label so many rows at the low and at the high end, of those that it has not labelled yet, by exact rank."""
        need = {(v, end): wanted[end] for v in (0, 1) for end in (0, 1)}
        bounds: dict[tuple[int, int], tuple[int, ...] | None] = {k: () if n else None for k, n in need.items()}
        # a view's labels of the round do not depend on the other's: both are free to label the same row
        open_ends = [k for k, n in need.items() if n]
        while open_ends:
            asked = [(v, end, bounds[v, end]) for v, end in open_ends]

            def work(parts: Iterator[tuple], asked=asked) -> Iterator[pa.RecordBatch]:
                for x, tie, row, labels in parts:
                    places = [digits(views[v].logit(x[v]), tie, row) for v in (0, 1)]
                    for v, end, bound in asked:
                        some = labels[1 - v] < 0
                        for d, b in zip(places[v], bound, strict=False):
                            some &= d == b
                        digit, count = np.unique(places[v][len(bound)][some], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(digit), 2 * v + end, "i4")), pa.array(digit, pa.int64()), pa.array(count, pa.int64())], names=["which", "digit", "n"])

            found = self.run(work, "which int, digit bigint, n bigint").groupBy("which", "digit").agg(F.sum("n").alias("n")).collect()
            for v, end in list(open_ends):
                counts = sorted(((r.digit, r.n) for r in found if r.which == 2 * v + end), reverse=bool(end))
                left = need[v, end]
                for digit, n in counts:
                    if n >= left or (digit, n) == counts[-1]:
                        bounds[v, end] = (*bounds[v, end], digit)
                        need[v, end] = left
                        if n <= left or len(bounds[v, end]) == 10:
                            open_ends.remove((v, end))
                        break
                    left -= n
                if not counts:  # nothing is free
                    bounds[v, end] = None
                    open_ends.remove((v, end))
        self.past.append(Round(views, bounds))


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool | None, rounds: int = ROUNDS, weight: float = 1.0) -> Model:
    """A model of labelled rows and an unlabelled pool. Each labelled row counts as so many pseudo-labelled ones. Every fifth labelled row is set aside for calibration."""
    if len(set(y.tolist())) < 2:
        return Model(prior=float(y.mean()) if len(y) else 0.5)
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    tuned = aside if aside.any() else ~aside
    views, own = [text, meta], y[~aside]
    known = [x[~aside] for x in views]
    odds = np.log((own.mean() + 1e-3) / (1 - own.mean() + 1e-3))
    models = learn([np.append(np.zeros(x.shape[1]), odds) for x in known], known, own, lambda _: [0.0, 0.0])
    if pool is not None and pool.size:
        n = max(1, int(TAKE * pool.size))
        ones = round(n * float(y.mean()))
        for _ in range(rounds):
            pool.choose(models, (n - ones, ones))
            models = learn([m.w for m in models], known, own, pool.taught, weight)
    calm, logits = [], []
    for v in (0, 1):
        raw = models[v].logit(views[v][tuned])[:, None]
        fitted = Logistic(raw, y[tuned])
        scale = float(fitted.w[0] / fitted.scale[0])
        calm.append((scale, float(fitted.b - scale * fitted.mean[0])))
        logits.append(scale * raw[:, 0] + calm[-1][1])
    both = np.column_stack(logits)
    fitted = Logistic(both, y[tuned])
    weight = fitted.w / fitted.scale
    return Model(None, models[0], models[1], calm, (float(weight[0]), float(weight[1]), float(fitted.b - weight @ fitted.mean)))


def featurise(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, lang, n_chars, row, tie) with both views as bytes of float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                meta = [meta_features(*r).tobytes() for r in zip(*[part.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), part.column(6), pa.array([text_features(t).tobytes() for t in texts], pa.binary()), pa.array(meta, pa.binary())], names=["doc_id", "row", "tie", "text", "meta"])

    return docs.mapInArrow(run, "doc_id bigint, row bigint, tie bigint, text binary, meta binary")


def views_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars") -> DataFrame:
    rows = pick(docs, id_col, text_col, source_col, lang_col, size_col).toDF("doc_id", "text", "source", "lang", "n_chars")
    return rows.withColumns({"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, fold_out: bool = True) -> Model:
    """A model of labels and of all documents without. Sampled labels are those of the ids with the smallest hashes, and of their rows max_labelled at most; the held-out fold is in neither."""
    docs = views_of(docs, id_col)
    known = pick(labels, id_col, label_col).toDF("doc_id", "label").where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    if fold_out:
        known, docs = known.where(~held_out(F.col("doc_id"))), docs.where(~held_out(F.col("doc_id")))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", F.lit(True).alias("sampled"))
    known = write_table(known.join(F.broadcast(some), "doc_id", "left"), "labels")
    n = known.count()
    few = n <= BROADCAST_IDS
    tie = F.xxhash64("doc_id", "source", "lang", "n_chars", "text")
    made = featurise(docs.select("doc_id", "text", "source", "lang", "n_chars", F.monotonically_increasing_id().alias("row"), tie.alias("tie")))
    made = made.join(F.broadcast(known) if few else known, "doc_id", "left").where("label is null or sampled")
    made = write_table(made.select("tie", "row", "label", "text", "meta"), "views")
    # at most so many rows, also where ids repeat; in an order that does not hang on that of the table
    rows = made.where("label is not null").orderBy("tie", "text", "meta").limit(max_labelled).collect()
    y = np.array([r.label for r in rows], "f8")
    text = np.array([np.frombuffer(r.text, "f4") for r in rows]).reshape(-1, TEXT_DIM)
    meta = np.array([np.frombuffer(r.meta, "f4") for r in rows]).reshape(-1, META_DIM)
    model = cotrain(text, meta, y, Pool(made.where("label is null")) if len(rows) else None, rounds, max(1.0, n / max_labelled))
    drop_table(made)
    drop_table(known)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Per document: doc_id and score. Narrow."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                meta = np.array([meta_features(*r) for r in zip(*[part.column(i).to_pylist() for i in (2, 3, 4)], strict=True)])
                text = np.array([text_features(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(text, meta))], names=["doc_id", "score"])

    return views_of(docs, id_col).mapInArrow(run, "doc_id bigint, score double")
