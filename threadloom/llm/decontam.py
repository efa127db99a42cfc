"""Benchmark decontamination with generalised suffix automata over words.

The automaton holds every run of words of every test item. A document's words
are streamed through it, keeping the length of the longest match that ends at
each word. A match of at least ``window`` words covers hit words; so does the
whole of an item that is shorter than the window. Words that no item has reset
the match, so only stretches of known words long enough to matter are walked.

Items are dealt by hash into as many blocks as keep each at about ``block_words``
words, and the executors build one automaton per block, in a file of the shared folder. A worker
holds one block at a time, and of a benchmark in one block keeps it from batch to batch. A benchmark of
any size so needs bounded memory per worker and one more scan of the texts at hand per
block; the driver holds the number of blocks alone.

Defined results: null, empty and wordless texts have no words and are never
contaminated; wordless and null items are never found; items that repeat an id
count as one id, and a null item id is the text "null"; repeated documents give
repeated rows; an empty benchmark leaves all documents clean; whole texts are
read, however long. Other columns are not carried by ``scan``; ``clean`` keeps all columns
as they are and changes the text alone.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_table, new_path, pick, rest, write_table

#: Words, after A-Z is lower-cased: digits, letters a-z and everything beyond ASCII.
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
ANY_CASE = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Characters of text that are scanned at once if there are several blocks, as each is loaded anew for them.
MANY_CHARS = 16_000_000


def lower(text: str) -> str:
    """A-Z only: str.lower would also change, and lengthen, other letters."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text)) if text else []


class Automaton:
    """A generalised suffix automaton of (item number, words) pairs."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int):
        self.window = window
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        paths, self.shortest = [], window
        for number, text in items:
            if not text:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in text]
            self.shortest = min(self.shortest, len(ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
            paths.append((number, ids))
        #: Of states: items whose window ends there; of whole short items: (words, items).
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[int]] = {}
        for number, ids in paths:
            state = 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.items.setdefault(self.shrink(state, window), set()).add(number)
            if len(ids) < window:
                top = self.shrink(state, len(ids))
                if len(ids) not in self.short.setdefault(top, []):
                    self.short[top].append(len(ids))
                self.items.setdefault((top, len(ids)), set()).add(number)
        #: Of each state the short items that are suffixes of it, along its links.
        self.ends: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            own = tuple((s, n) for n in self.short.get(s, ()))
            self.ends[s] = own + self.ends[self.link[s]]

    def shrink(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.len.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur = self._new(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def scan(self, text: list[str], found: set[int], hit: list[tuple[int, int]]) -> None:
        """Adds numbers of items that occur to found, and (start, end) of hit words to hit, in order of their ends."""
        ids = np.fromiter(map(self.vocab.get, text, [-1] * len(text)), "i4", len(text))
        known = np.flatnonzero(ids >= 0)
        if len(known) < self.shortest:
            return
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        starts, stops = known[np.append(0, cut)], known[np.append(cut, len(known)) - 1] + 1
        long = stops - starts >= self.shortest
        step, link, size, window, ends = self.next, self.link, self.len, self.window, self.ends
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                while c not in step[state]:
                    if not state:
                        break
                    state = link[state]
                    length = size[state]
                else:
                    state = step[state][c]
                    length += 1
                if length >= window:
                    hit.append((i - length, i))
                    found |= self.items[self.shrink(state, window)]
                if ends[state]:
                    for top, n in ends[state]:
                        if n <= length:
                            hit.append((i - n, i))
                            found |= self.items[(top, n)]


def merged(hit: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hit):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: The block that a worker keeps: its place and its automaton with the items' names.
KEPT: dict[str, tuple[Automaton, list[str]]] = {}


def block_of(place: str) -> tuple[Automaton, list[str]]:
    """A block of the shared folder. Tasks reach what is kept through this function, which is sent by name."""
    if place not in KEPT:
        KEPT.clear()
        store, path = fs.FileSystem.from_uri(place)
        with store.open_input_stream(path) as source:
            KEPT[place] = pickle.loads(source.read())  # written by build
    return KEPT[place]


class Scanner:
    """The places of the blocks."""

    def __init__(self, places: list[str]):
        self.places = places
        self.chars = MANY_CHARS if len(places) > 1 else 2_000_000

    def scan(self, texts: list[list[str]]) -> list[tuple[list[str], list[tuple[int, int]]]]:
        """Of each text the ids of items found, sorted, and the spans of hit words."""
        found: list[set[str]] = [set() for _ in texts]
        hit: list[list[tuple[int, int]]] = [[] for _ in texts]
        for place in self.places:
            automaton, names = block_of(place)
            for text, f, h in zip(texts, found, hit, strict=True):
                own: set[int] = set()
                automaton.scan(text, own, h)
                f.update(names[i] for i in own)
        return [(sorted(f), merged(h)) for f, h in zip(found, hit, strict=True)]


def build(place: str, window: int):
    """Writes the automaton of each block of rows (block, item, text), sorted by block, to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        def stored(block: int, items: list[tuple[str, list[str]]]) -> pa.RecordBatch:
            numbers: dict[str, int] = {}
            pairs = [(numbers.setdefault(item, len(numbers)), text) for item, text in items]
            store, root = fs.FileSystem.from_uri(place)
            store.create_dir(root, recursive=True)
            name = f"{block:06d}-{uuid.uuid4().hex}"  # a task that runs twice writes twice; the rows name one of both
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pickle.dumps((Automaton(pairs, window), list(numbers))))
            return pa.RecordBatch.from_arrays([pa.array([f"{place}/{name}"])], names=["place"])

        for block, own in groupby(rows(), key=lambda r: r[0]):
            yield stored(block, [(item, got) for _, item, text in own if (got := words(text))])

    return run


def scanner(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Scanner:
    """The items in blocks, built on the executors."""
    spark = items.sparkSession
    rows = pick(items, id_col, text_col).toDF("i", "t").select(F.coalesce(F.col("i").cast("string"), F.lit("null")).alias("item"), F.col("t").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(words(t)) for b in batches for t in b.column(0).to_pylist())], pa.int64())], names=["n"])

    total = rows.select("text").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    if not total:
        return Scanner([])
    n = -(-total // block_words)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition(min(n, 10_000), "block").sortWithinPartitions("block", "item", "text")
    made = write_table(dealt.select("block", "item", "text").mapInArrow(build(new_path(spark, "automata"), window), "place string"), "blocks")
    places = sorted(r.place for r in made.collect())  # one per block
    drop_table(made)
    return Scanner(places)


SCHEMA = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>, items_sha256 string"


def scan(docs: DataFrame, items: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, spans of hit words (start and end in words), ids of the items found and their digest. Narrow: one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part, texts in chunks(batch, chars=items.chars):
                split = [words(t) for t in texts]
                got = items.scan(split)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()), pa.array([len(w) for w in split], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for _, s in got], pa.list_(span)),
                        pa.array([f for f, _ in got], pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for f, _ in got], pa.string()),
                    ],
                    names=["doc_id", "n_words", "spans", "item_ids", "items_sha256"],
                )

    return pick(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def report(found: DataFrame) -> DataFrame:
    """Counts of scan's rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "items_sha256", (n_hit > 0).alias("contaminated"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans, nor what stands between them."""
    places = [m.span() for m in ANY_CASE.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, items: Scanner, text_col: str = "text", max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """All columns of docs. Documents more than max_coverage of whose words are hit go; of others, hit spans of more than max_span words are cut from the text."""
    cols = docs.columns
    if text_col not in cols:
        raise ValueError(f"no column {text_col!r} among {cols}")
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text_at=at, chars=items.chars):
                split = [words(t) for t in texts]
                keep = np.ones(len(texts), bool)
                for i, (_, spans) in enumerate(items.scan(split)):
                    if not spans:
                        continue
                    keep[i] = sum(b - a for a, b in spans) <= max_coverage * len(split[i])
                    if keep[i] and (cut := [s for s in spans if s[1] - s[0] > max_span]):
                        texts[i] = without(texts[i], cut)
                columns = [pa.array(texts, part.schema.field(i).type) if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))
        rest()

    plain = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    return plain.mapInArrow(run, plain.schema).toDF(*cols)
