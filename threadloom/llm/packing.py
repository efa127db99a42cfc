"""Best-fit packing of token sequences, bulk-synchronous.

Pieces are range-sorted by length, and ranked within their length: each task
ranks its own part of the sorted table, and one count per part and length makes
the ranks global. Pieces of one length are interchangeable, and so are gaps of one
size, so both travel as runs: a size, a first rank or sequence, and a count. There
are at most ``capacity`` sizes, so the runs need memory for sizes, not for documents.

A superstep deals the runs of pieces and gaps by ranges of size over tasks. Each
task sweeps its range downwards: a piece's successor is the smallest gap of the range
that holds it; where many pieces seek the same gaps, rank decides, the longer piece
and then the lower rank first, and a gap takes as many pieces of one length as it
holds. Pieces whose successor lies in a higher range meet the gaps left there in a
second sweep. Then the gaps shrink and the next superstep begins. Pieces longer than
every gap get new sequences, as few as their tokens need. It ends when all are placed.

No superstep moves rows of documents: a piece's place follows from its length and rank,
in one pass over the ranked table. Counts per part and length number at most (parts +
capacity), since the table is range-sorted by length; they and the runs are what reaches the driver.

Ids are made once per distinct pre-token of a chunk: texts are cut, and pre-tokens hashed,
by array operations; a worker keeps ids in a table of fixed size, each entry told apart by
two hashes of 64 bits; what it lacks goes to the tokenizer.

Only documents longer than the capacity are cut, from the end, so that all pieces
but the first are full.

Defined results: a null text is an empty one, so its document is the end token
alone; repeated documents are packed each on its own; equal lengths rank by
document and piece, exact repeats in any order; an empty table has no sequences; a length
of 0, or beyond the capacity, is refused; texts are tokenised whole, however
long; a special token's string in a text is ordinary text, as the vocabulary's own notes advise;
other columns are not carried, so names cannot clash.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, drop_table, pick, rest, write_table

CAPACITY = 2048
END = 0
#: Characters of text that are split at once.
CHARS = 250_000
#: Entries of a worker's table of pre-tokens, a power of two, and the ids that an entry has room for.
ENTRIES, ROOM = 1 << 20, 8
#: Ranges of size over which a superstep deals its runs.
RANGES = 4
#: Texts of these characters split by array operations just as the tokenizer's own pattern does; others go to the tokenizer whole.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ɏ]*")
#: Which places of an entry are filled, by how many ids it has.
FILLED = np.arange(ROOM) < np.arange(ROOM + 1)[:, None]
U = np.uint64
BREAK, LETTER, DIGIT, SIGN, BLANK = range(5)


def _kinds() -> np.ndarray:
    """The kind of each code point that PLAIN has; 0 ends a text."""
    kinds = np.full(0x250, SIGN, "u1")
    for c in range(0x250):
        kinds[c] = LETTER if chr(c).isalpha() else DIGIT if c < 0x80 and chr(c).isdigit() else BLANK if c < 0x80 and chr(c).isspace() else SIGN
    kinds[0] = BREAK
    return kinds


KINDS = _kinds()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Places where pre-tokens start, in texts of PLAIN characters that each end with code 0; a 0 is a pre-token of its own.

    A run of letters, digits or signs is one, with a blank before it. White space is one but for its last character
    where a run follows. An apostrophe that starts a run by itself takes s, t, m, d, re, ve or ll after it.
    """
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == BREAK)
    space = codes == 32
    blank = kinds == BLANK
    opens = start[1:] & ~blank[1:] & (kinds[1:] != BREAK)
    start[1:][opens & space[:-1]] = False  # the blank before belongs to the run
    start[:-1][opens & blank[:-1]] = True  # the last white space before a run stands alone, or leads it
    mark = np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kinds[1:] == LETTER))
    if len(mark):
        padded = np.append(codes, [0, 0])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, width in ((mark[short], 2), (mark[long & ~short], 3)):
            start[at + 1] = False
            start[at + width] = True  # a text's end follows at the latest
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts. The vocabulary merges within pre-tokens only, so ids of pre-tokens are kept and joined."""

    def __init__(self, path: str, end: int = END, entries: int = ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end = end
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.key, self.proof = np.zeros(entries, "u8"), np.zeros(entries, "u8")
        self.long, self.ids = np.zeros(entries, "u1"), np.zeros((entries, ROOM), "<u4")  # of memory, only what is written is taken

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and how many each has; those without white space but a leading blank are encoded as the lines of one text, since a line end never merges with them."""
        if len(self.line_end) == 1 and words:
            ids = self._ids(["\n".join(words)])[0]
            cut = ids == self.line_end[0]
            ends = np.append(np.flatnonzero(cut), len(ids))
            if len(ends) == len(words):  # else the vocabulary merges across lines
                return ids[~cut], np.diff(np.append(-1, ends)) - 1
        each = self._ids(words)
        return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], "i8")

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of PLAIN texts, each with the end token, one after the other; and where each text's ids end."""
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = KINDS[codes]
        at = starts(codes, kinds)
        size = np.diff(np.append(at, len(codes)))
        x = ((np.arange(len(codes), dtype="u4") - np.repeat(at.astype("u4"), size)).astype("u8") << U(10)) | codes
        y = mix(x + U(1))
        key = np.add.reduceat(y, at) | U(1)
        proof = np.add.reduceat((y >> U(7)) * (x | U(1)), at)
        stop = kinds[at] == BREAK
        slot = (key >> U(64 - self.key.size.bit_length() + 1)).astype("i8")
        hit = (self.key[slot] == key) & (self.proof[slot] == proof)
        n = self.long[slot].astype("i8")
        miss = np.flatnonzero(~hit & ~stop)
        _, first, which = np.unique(key[miss], return_index=True, return_inverse=True)
        spot = miss[first]
        words = [joined[a : a + k] for a, k in zip(at[spot].tolist(), size[spot].tolist(), strict=True)]
        bare = np.array([w.isspace() for w in words], bool)
        flat, long = self._words([w for w in words if not w.isspace()])
        if bare.any():  # white space is encoded by itself, and stands behind the others
            each = self._ids([w for w in words if w.isspace()])
            flat, long = np.concatenate([flat, *each]), np.append(long, [len(x) for x in each])
            order = np.argsort(bare, kind="stable")
            spot, back = spot[order], np.empty(len(order), "i8")
            back[order] = np.arange(len(order))
            which = back[which]
        n[miss], n[stop] = long[which], 1
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]), "<u4")
        out[ends[stop] - 1] = self.end
        known = hit & ~stop
        own = n[known]
        out[np.repeat(known, n)] = self.ids[slot[known]][FILLED[own]]
        if len(miss):
            begin = np.cumsum(long) - long
            own = n[miss]
            step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            lacked = ~hit & ~stop
            out[np.repeat(lacked, n)] = flat[np.repeat(begin[which], own) + step]
            fits = np.flatnonzero(long <= ROOM)
            _, last = np.unique(slot[spot[fits]], return_index=True)  # one of those that share an entry
            fits = fits[last]
            place = slot[spot[fits]]
            self.key[place], self.proof[place], self.long[place] = key[spot[fits]], proof[spot[fits]], long[fits]
            padded = np.zeros((len(fits), ROOM), "<u4")
            filled = FILLED[long[fits]]
            step = np.broadcast_to(np.arange(ROOM), filled.shape)
            padded[filled] = flat[(begin[fits, None] + step)[filled]]
            self.ids[place] = padded
        return out, ends[stop]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end token."""
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t)]
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        if plain:
            ids, ends = self._plain([texts[i] for i in plain])
            for i, x in zip(plain, np.split(ids, ends[:-1]), strict=True):
                out[i] = x
        rest = sorted(set(range(len(texts))).difference(plain))
        for i, x in zip(rest, self._ids([texts[i] for i in rest]), strict=True):
            out[i] = np.append(x, np.uint32(self.end)).astype("<u4")
        return out


ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end: int) -> Encoder:
    """The encoder of this worker. Tasks reach it through this function, which is sent by name: a dictionary they named themselves would be sent empty with each task."""
    if (path, end) not in ENCODERS:
        ENCODERS[(path, end)] = Encoder(path, end)
    return ENCODERS[(path, end)]


def release() -> None:
    """Frees what the encoders of this worker keep, once all is encoded."""
    ENCODERS.clear()
    rest()


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, the crc32 of its ids as little-endian unsigned 32-bit numbers, and if asked for those ids. Narrow."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema(fields if ids else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, end)
        for batch in batches:
            for part, texts in chunks(batch, chars=CHARS):
                found: list[tuple] = []
                for doc, own in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in texts]), strict=True):
                    n, raw = len(own), memoryview(own).cast("B")
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row = (doc, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))
                        found.append((*row, bytes(raw[4 * a : 4 * b])) if ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if ids else ""))


#: What a row of a superstep is: pieces or gaps that were not matched, gaps that took pieces, or a match.
PIECES, GAPS, SHRUNK, MATCH = range(4)


def successors(runs: list[tuple[int, int, int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """One sweep over runs (kind, size, first, count) of pieces and gaps: rows (kind, size, first, count, place), of which a MATCH has the length, first rank, count and first sequence, and its offset as kind above MATCH."""
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[list[int]] = []  # gaps in falling size: the last one is the successor of what comes next
    for kind, size, first, count in sorted(runs, key=lambda r: (-r[1], -r[0], r[2])):
        if kind == GAPS:
            stack.append([size, first, count])
            continue
        while count and stack:
            room, sequence, n = stack[-1]
            each = room // size
            full = min(n, count // each)
            for j in range(each if full else 0):
                out.append((MATCH + capacity - room + j * size, size, first + j * full, full, sequence))
            first, count = first + each * full, count - each * full
            if full and room > each * size:
                out.append((SHRUNK, room - each * size, sequence, full, 0))
            sequence, n = sequence + full, n - full
            if count and n:  # fewer than one gap takes
                for j in range(count):
                    out.append((MATCH + capacity - room + j * size, size, first + j, 1, sequence))
                if room > count * size:
                    out.append((SHRUNK, room - count * size, sequence, 1, 0))
                sequence, n, count = sequence + 1, n - 1, 0
            if n:
                stack[-1] = [room, sequence, n]
            else:
                stack.pop()
        if count:
            out.append((PIECES, size, first, count, 0))
    return out + [(GAPS, room, sequence, n, 0) for room, sequence, n in stack]


def superstep(spark: SparkSession, runs: list[tuple[int, int, int, int]], capacity: int, ranges: int) -> list[tuple[int, int, int, int, int]]:
    """Sweeps by ranges of size on the executors, and one over the runs that have no successor in their own range."""

    def one_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
        if found := successors(own, capacity):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["kind", "size", "first", "count", "place"])

    table = spark.createDataFrame(runs, "kind int, size bigint, first bigint, count bigint")
    swept = table.repartitionByRange(ranges, "size").mapInArrow(one_range, "kind int, size bigint, first bigint, count bigint, place bigint")
    rows = [tuple(r) for r in swept.collect()]
    left = [r[:4] for r in rows if r[0] <= GAPS]
    return [r for r in rows if r[0] > GAPS] + successors(left, capacity)


def sweep(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, ranges: int = RANGES) -> list[tuple[int, int, int, int]]:
    """Best fit over counted lengths: rows (length, first rank, first sequence, offset). Pieces of a length from that rank on go to sequences from that one on, one each, until the next row of the length."""
    for length in counts:
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
    plan: list[tuple[int, int, int, int]] = []
    waiting = [(PIECES, length, 0, n) for length, n in counts.items() if n]
    gaps: list[tuple[int, int, int, int]] = []
    sequences = 0
    while waiting:
        widest = max((g[1] for g in gaps), default=0)
        homeless = [w for w in waiting if w[1] > widest]
        if homeless:
            # they fit no gap: as many new sequences as their tokens need, or those of them that cannot share one
            need = max(-(-sum(w[1] * w[3] for w in homeless) // capacity), sum(w[3] for w in homeless if 2 * w[1] > capacity))
            gaps.append((GAPS, capacity, sequences, need))
            sequences += need
        rows = superstep(spark, waiting + gaps, capacity, ranges)
        plan += [(size, first, place, kind - MATCH) for kind, size, first, _, place in rows if kind >= MATCH]
        waiting = [r[:4] for r in rows if r[0] == PIECES]
        gaps = joined([(GAPS, *r[1:4]) for r in rows if r[0] in (GAPS, SHRUNK)])
    return plan


def joined(gaps: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Gaps of one size and adjoining sequences as one run."""
    out: list[tuple[int, int, int, int]] = []
    for kind, size, first, n in sorted(gaps):
        if out and out[-1][1] == size and out[-1][2] + out[-1][3] == first:
            out[-1] = (kind, size, out[-1][2], out[-1][3] + n)
        else:
            out.append((kind, size, first, n))
    return out


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found(doc_id, piece, length, ...) with sequence_id and offset. Two written tables of found's columns, so leave ids out where they are not needed."""
    cols = found.columns
    spark = found.sparkSession
    # sampling for the range sort reads the written table, not the tokenizer again
    stored = write_table(found, "pieces")
    ordered = stored.repartitionByRange(F.col("length").desc(), "doc_id", "piece", F.monotonically_increasing_id()).sortWithinPartitions(F.col("length").desc(), "doc_id", "piece")
    at = cols.index("length")
    kinds = pa.schema([("part", pa.int32()), ("rank", pa.int64())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            length = batch.column(at).to_numpy()
            if not len(length):
                continue
            begin = np.flatnonzero(np.append(True, length[1:] != length[:-1]))
            size = np.diff(np.append(begin, len(length)))
            base = np.zeros(len(begin), "i8")
            if length[0] == last:
                base[0] = seen
            own = np.arange(len(length)) - np.repeat(begin, size) + np.repeat(base, size)
            last, seen = length[-1], int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, "i4")), pa.array(own)], schema=pa.schema([*batch.schema, *kinds]))

    schema = ", ".join(f"`{n}` {t}" for n, t in found.dtypes)
    ranked = write_table(ordered.mapInArrow(rank, f"{schema}, part int, rank bigint"), "ranked")
    drop_table(stored)
    tally = sorted(tuple(r) for r in ranked.groupBy("part", "length").count().collect())
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for part, length, n in tally:
        base[(part, length)] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    plan = sweep(spark, counts, capacity)
    wide = 1 << 48
    rows = sorted((length * wide + first, first, sequence, offset) for length, first, sequence, offset in plan)
    table = np.array(rows, "i8").reshape(-1, 4)
    held = spark.sparkContext.broadcast((base, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        base, table = held.value
        for batch in batches:
            length, part, own = (batch.column(i).to_numpy() for i in (at, len(cols), len(cols) + 1))
            own = own + np.fromiter(map(base.__getitem__, zip(part.tolist(), length.tolist(), strict=True)), "i8", len(own))
            row = table[np.searchsorted(table[:, 0], length * wide + own, "right") - 1] if len(own) else np.zeros((0, 4), "i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(row[:, 2] + own - row[:, 1]), pa.array(row[:, 3])], names=[*cols, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """pieces with the checksum of their ids in place of them."""
    return pieces(docs, tokenizer, ids=False)


def digest(found: DataFrame) -> DataFrame:
    """What pieces() returns, without the ids."""
    return found.select("doc_id", "piece", "start", "length", "ids_crc32")
