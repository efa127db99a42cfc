"""Media columns: bytes kept in ISO media containers, and what a walk over the boxes tells of them.

A container holds one track of raw 8-bit grey frames of 8 by 8 samples, so each
access unit is 64 bytes and nothing is lost. ``probe`` walks nested boxes and
decodes the sample tables only (stsd, mdhd, stts, stsz, stsc, stco or co64,
stss); it never touches the payload. ``read_payload`` follows the same tables.

Defined results: a null text is an empty one; an empty payload is 64 bytes of 0;
equal texts give equal containers; rows are never merged, so repeated rows give
repeated rows; an empty table gives an empty table; other columns are not
carried, so their names cannot clash. ``probe_column`` reads containers of an existing column, and gives an error
text for those that are broken. A container of more than 4 GB has 64-bit
offsets (co64) and a 64-bit mdat size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, chunks, pick

#: Fixed values of the container format.
SIDE = 8
UNIT = SIDE * SIDE
TIMESCALE = 25
KEYFRAME_EVERY = 16
CHUNK_UNITS = 64
CODEC = b"raw "
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def mux(payload: bytes) -> bytes:
    """A container of a payload, whose length is a positive multiple of UNIT."""
    units, rest = divmod(len(payload), UNIT)
    if rest or not units:
        raise ValueError("a payload is a positive multiple of the unit")
    n_chunks = -(-units // CHUNK_UNITS)
    last = units - (n_chunks - 1) * CHUNK_UNITS
    wide = len(payload) > 0xF0000000
    runs = [(1, CHUNK_UNITS, 1)] * (n_chunks > 1) + [(n_chunks, last, 1)] * (n_chunks == 1 or last != CHUNK_UNITS)
    keys = np.arange(1, units + 1, KEYFRAME_EVERY, dtype=">u4")
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(first: int) -> bytes:
        at = first + np.arange(n_chunks, dtype="u8") * (CHUNK_UNITS * UNIT)
        table = full(b"co64", struct.pack(">I", n_chunks), at.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", n_chunks), at.astype(">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            table,
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, units & 0xFFFFFFFF, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, units & 0xFFFFFFFF), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, units & 0xFFFFFFFF), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    front = len(ftyp) + len(moov(0)) + len(head)
    return b"".join((ftyp, moov(front), head, payload))


def walk(data, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box kinds, start of its body, end) of every box, outer ones first; bodies of plain boxes are not read."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def tracks(data) -> list[dict]:
    """Of each track: codec, timescale, duration, and byte offset and size of each sample, with which samples are keyframes."""
    found: list[dict] = []
    for path, body, stop in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"codec": "", "timescale": 0, "duration": 0, "keys": None})
        elif not found or b"trak" not in path:
            continue
        t = found[-1]
        if kind == b"mdhd":
            wide = data[body] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, body + (20 if wide else 12))
        elif kind == b"stsd":
            t["codec"] = bytes(data[body + 12 : body + 16]).decode("latin-1")
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, body + 4)
            t["sizes"] = np.full(n, size, "i8") if size else np.frombuffer(data, ">u4", n, body + 12).astype("i8")
        elif kind in (b"stco", b"co64"):
            (n,) = struct.unpack_from(">I", data, body + 4)
            t["chunks"] = np.frombuffer(data, ">u8" if kind == b"co64" else ">u4", n, body + 8).astype("i8")
        elif kind == b"stsc":
            (n,) = struct.unpack_from(">I", data, body + 4)
            t["runs"] = np.frombuffer(data, ">u4", 3 * n, body + 8).reshape(n, 3).astype("i8")
        elif kind == b"stss":
            (n,) = struct.unpack_from(">I", data, body + 4)
            t["keys"] = np.frombuffer(data, ">u4", n, body + 8).astype("i8") - 1
    for t in found:
        if lacking := [k for k in ("sizes", "chunks", "runs") if k not in t]:
            raise ValueError(f"a track has no table of {', '.join(lacking)}")
        sizes, places, runs = t["sizes"], t["chunks"], t["runs"]
        if len(sizes) and (not len(places) or not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(places)):
            raise ValueError("the sample tables do not fit one another")
        until = np.append(runs[1:, 0], len(places) + 1)
        per_chunk = np.repeat(runs[:, 1], until - runs[:, 0])
        chunk = np.repeat(np.arange(len(places)), per_chunk)[: len(sizes)]
        if len(chunk) < len(sizes) or (t["keys"] is not None and len(t["keys"]) and not 0 <= t["keys"].min() <= t["keys"].max() < len(sizes)):
            raise ValueError("the sample tables do not fit one another")
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk, np.arange(len(places)))
        t["offsets"] = places[chunk] + before - before[first[chunk]]
        t["keys"] = np.arange(len(sizes)) if t["keys"] is None else t["keys"]
    return found


def first_track(data) -> dict:
    try:
        found = tracks(data)
    except (struct.error, IndexError) as broken:
        raise ValueError(f"a box is cut off: {broken}") from broken
    if not found:
        raise ValueError("the container has no track")
    return found[0]


def probe(data) -> dict:
    """codec, duration_ms, n_samples, and the byte ranges of keyframes, of the first track. ValueError if there is none, or if boxes or tables are broken."""
    t = first_track(data)
    return {"codec": t["codec"], "duration_ms": t["duration"] * 1000 // max(1, t["timescale"]), "n_samples": len(t["sizes"]), "keyframes": np.column_stack((t["offsets"][t["keys"]], t["sizes"][t["keys"]]))}


def read_payload(data) -> bytes:
    """The samples of the first track in order; samples that touch are read as one range. ValueError as for probe, or if a sample lies outside the data."""
    t = first_track(data)
    at, size = t["offsets"], t["sizes"]
    if not len(at):
        return b""
    if at.min() < 0 or (at + size).max() > len(data):
        raise ValueError("a sample lies outside the container")
    cut = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    starts, stops = at[np.append(0, cut)], (at + size)[np.append(cut, len(at)) - 1]
    return b"".join(bytes(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


SCHEMA = "doc_id bigint, n_bytes bigint, media binary, payload binary, codec string, duration_ms bigint, n_samples bigint, keyframes array<struct<offset:bigint,length:bigint>>"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("codec", pa.string()), ("duration_ms", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch, chars=CHUNK_CHARS):
            n_bytes, media, payload, info, spans = [], [], [], [], [0]
            for text in texts:
                raw = (text or "").encode()
                stored = mux(pad(raw))
                n_bytes.append(len(raw))
                media.append(stored)
                payload.append(read_payload(stored))
                info.append(probe(stored))
                spans.append(spans[-1] + len(info[-1]["keyframes"]))
            pairs = np.concatenate([x["keyframes"] for x in info])
            ranges = pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["offset", "length"]))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), *[pa.array([x[k] for x in info], f.type) for k, f in zip(("codec", "duration_ms", "n_samples"), list(ARROW)[4:7], strict=True)], ranges], schema=ARROW)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its container, the payload read back from it, and what the sample tables tell. No shuffle: each row is on its own."""
    return pick(docs, id_col, text_col).mapInArrow(_store, SCHEMA)


def probe_column(rows: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """What the boxes of an existing binary column tell, per row: id, codec, duration_ms, n_samples, keyframes and error.

    Narrow, and payloads are not decoded. A null container has nulls only; one that is empty, broken or without a
    track has nulls and an error text. Ids are as they are; repeated rows give repeated rows; an empty table gives none.
    """
    fields = [("codec", pa.string()), ("duration_ms", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_buffer()
                row: dict = dict.fromkeys([n for n, _ in fields])
                if data is not None:
                    try:
                        row |= probe(memoryview(data))
                        row["keyframes"] = [{"offset": a, "length": n} for a, n in row["keyframes"].tolist()]
                    except ValueError as why:
                        row["error"] = str(why)
                found.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in found], t) for n, t in fields]], names=["id", *[n for n, _ in fields]])

    some = pick(rows, id_col, media_col).toDF("id", "media").withColumn("media", F.col("media").cast("binary"))
    out = some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, codec string, duration_ms bigint, n_samples bigint, keyframes array<struct<offset:bigint,length:bigint>>, error string")
    return out.withColumnRenamed("id", id_col)


def digests(media: DataFrame) -> DataFrame:
    """The digest columns of media_columns."""
    last = F.element_at("keyframes", -1)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.trim("codec")), F.concat(F.lit("duration_ms="), F.col("duration_ms").cast("string")), F.concat(F.lit("samples="), F.col("n_samples").cast("string")),
        F.concat(F.lit("keyframes="), F.size("keyframes").cast("string")), F.concat(F.lit("last="), last["offset"].cast("string"), F.lit("+"), last["length"].cast("string")),
        F.concat(F.lit("ranges="), F.crc32(F.to_json("keyframes").cast("binary")).cast("string")),
    )
    return media.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, greatest(length(payload) - {UNIT - 1}, 1), {UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
