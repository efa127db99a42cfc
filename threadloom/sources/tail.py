"""Reading on from where the last pass ended: windows of growing files, whole files of the others.

A source's cursor says how many bytes and lines were landed and carries the digest of the last
MiB before that place. A pass reads that MiB again, to know the file for the same, and then only
what is new, up to the last line end, in windows: at most `windows` of them, a window growing
past its size only where one line is longer. What a pass leaves behind is pending, and read by the next one.

Files are read by position on the executors, which Spark's own file sources cannot do: one row
per source goes in, lines and one cursor come out. A worker holds one window at a time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

__all__ = ["CURSORS", "WINDOW", "WINDOWS", "cursors_of", "lines_of", "tail"]

#: Bytes of a window; windows of a source in one pass; bytes before a cursor that are known by their digest.
WINDOW, WINDOWS, KNOWN = 8 << 20, 65, 1 << 20
#: Kinds whose files grow by lines; the others are replaced whole.
APPEND = ("main", "agent", "journal")
CURSORS = "src string, offset long, top long, known string, inode long, state string"
_LINES = [("ord", pa.int64()), ("off", pa.int64()), ("bytes", pa.int64()), ("payload", pa.string()), ("sha", pa.string())]
_CURSOR = [("offset", pa.int64()), ("top", pa.int64()), ("known", pa.string()), ("inode", pa.int64()), ("state", pa.string())]
_SCHEMA = pa.schema([("src", pa.string()), *_LINES, *_CURSOR])


def _open(path: str):
    """(file, its inode or null) of a qualified path."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        name = unquote(parts.path)
        return fs.LocalFileSystem().open_input_file(name), os.stat(name).st_ino
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name), None


def _sha(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()[:12]


def _rows(src: str, lines: list[tuple], cursor: tuple | None = None) -> pa.RecordBatch:
    own = [(src, *x, *[None] * len(_CURSOR)) for x in lines] + ([(src, *[None] * len(_LINES), *cursor)] if cursor else [])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _grown(src: str, path: str, offset: int, top: int, known: str | None, inode: int | None, window: int, windows: int) -> Iterator[pa.RecordBatch]:
    file, now = _open(path)
    with file:
        size = file.size()
        back = file.read_at(min(offset, KNOWN), max(0, offset - KNOWN)) if size >= offset else b""
        why = "replaced" if inode is not None and now is not None and inode != now else "truncated" if size < offset else "rewritten" if known is not None and hashlib.sha256(back).hexdigest() != known else None
        if why:
            yield _rows(src, [], (offset, top, known, inode, f"conflict: {why}"))
            return
        pending = False
        for turn in range(windows + 1):
            if turn == windows:
                pending = offset < size
                break
            data = file.read_at(min(window, size - offset), offset) if offset < size else b""
            while data and b"\n" not in data and offset + len(data) < size:
                data += file.read_at(min(window, size - offset - len(data)), offset + len(data))
            cut = data.rfind(b"\n") + 1
            if not cut:  # the rest is a line that is still being written
                break
            found, at = [], offset
            for line in data[: cut - 1].split(b"\n"):
                top += 1
                found.append((top, at, len(line), line.decode("utf-8", "replace"), _sha(line)))
                at += len(line) + 1
            yield _rows(src, found)
            back = (back + data[:cut])[-KNOWN:]
            offset += cut
        yield _rows(src, [], (offset, top, hashlib.sha256(back).hexdigest(), now, "pending" if pending else "even"))


def _whole(src: str, path: str, top: int, known: str | None) -> Iterator[pa.RecordBatch]:
    file, now = _open(path)
    with file:
        data = file.read()
    sha = hashlib.sha256(data).hexdigest()
    if sha == known:
        yield _rows(src, [], (len(data), top, known, now, "even"))
        return
    yield _rows(src, [(top + 1, 0, len(data), data.decode("utf-8", "replace"), _sha(data))], (len(data), top + 1, sha, now, "even"))


def tail(sources: DataFrame, cursors: DataFrame | None, window: int = WINDOW, windows: int = WINDOWS) -> DataFrame:
    """Of sources(src, path, source_kind, ...) what is new since the cursors: rows of lines (ord, off, bytes, payload, sha) and, with a null ord, each source's new cursor.

    A source whose file is another one, is shorter, or differs before its place is in conflict: it gives no lines, and as its
    cursor keeps that state, none later either. Text that is not valid UTF-8 is read with replacements; digests and
    sizes are of the bytes. Sources that are gone give nothing. An empty file, or one without a line end, has no lines yet.
    """
    if window < 1 or windows < 1:
        raise ValueError("window and windows are 1 at least")
    slim = sources.select("src", "path", "source_kind")
    slim = slim.join(cursors, "src", "left") if cursors is not None else slim.selectExpr("*", "null offset", "null top", "null known", "null inode", "null state")
    slim = slim.where("state is null or not startswith(state, 'conflict')").selectExpr("src", "path", "source_kind", "coalesce(cast(offset as long), 0) offset", "coalesce(cast(top as long), 0) top", "cast(known as string) known", "cast(inode as long) inode")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, path, kind, offset, top, known, inode in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield from _grown(src, path, offset, top, known, inode, window, windows) if kind in APPEND else _whole(src, path, top, known)

    return slim.repartition("src").mapInArrow(run, "src string, ord long, off long, bytes long, payload string, sha string, offset long, top long, known string, inode long, state string")


def lines_of(tailed: DataFrame) -> DataFrame:
    return tailed.where("ord is not null").select("src", "ord", "off", "bytes", "payload", "sha")


def cursors_of(tailed: DataFrame) -> DataFrame:
    return tailed.where("ord is null").select("src", "offset", "top", "known", "inode", "state")
