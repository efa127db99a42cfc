"""URL filters: a sorted digest array of 64-bit xxhash keys, probed by vectorised binary search.

A rule is (host, path, verdict): it fits its host and all subdomains, if the
url's path starts with the rule's; the longest fitting rule (host and path
together, then the longer host) wins. Its key is the xxhash of host + path. The index lies
in the shared folder in parts, each a range of keys with two files: the sorted keys, which workers
memory-map, and the rules' strings in the same order, which confirm every hit, so that a collision
of keys never decides. The executors range-sort the rules and write a part each, and
equal keys share a part; the driver learns of each part its first key and its size.

Probing tries, for each host suffix at a label, each path length that some rule
has; the lengths are a short list kept beside the keys.

Defined results: a null url or one without :// has an empty host and path, which
no rule fits; an unmatched url gets the default verdict; rules that repeat count
once, and of equal rules with both verdicts block wins; rules with a null host
or verdict are left out, a null path is empty; repeated pages give repeated
rows; other columns are not carried, so names cannot clash.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, new_path, pick, write_table

#: Host and path of a url, as groups 1 and 2.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"
MASK = (1 << 64) - 1


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _open(uri: str):
    """(filesystem, path) of a place in the shared folder, on whatever store that is."""
    return fs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{uri}")


def build_index(rules: DataFrame) -> str:
    """Writes the index of rules(host, path, verdict) to the shared folder and returns its place."""
    place = new_path(rules.sparkSession, "urlrules")
    clean = pick(rules, "host", "path", "verdict").where("host is not null and verdict in ('allow', 'block')")
    clean = clean.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    # Spark's xxhash64 of one string column is XXH64 with seed 42; shifted, its signed order is the unsigned one.
    keyed = clean.withColumn("order", F.expr("xxhash64(concat(host, path)) ^ (-9223372036854775808)"))
    order = keyed.repartitionByRange("order").sortWithinPartitions("order", "host", "path").select("order", "host", "path", "verdict")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, lengths, at, n = None, set(), 0, 0
        store, root = _open(f"{place}/{uuid.uuid4().hex}")  # a task that runs twice writes twice; the rows name one of both
        with ExitStack() as files:
            for batch in batches:
                for key, host, path, verdict in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    key ^= -1 << 63
                    if first is None:
                        first = key & MASK
                        store.create_dir(root, recursive=True)
                        keys, texts, offsets = (files.enter_context(store.open_output_stream(f"{root}/{x}", compression=None)) for x in ("keys", "rules", "offsets"))
                    line = json.dumps([host, path, verdict]).encode() + b"\n"
                    keys.write(struct.pack("<Q", key & MASK))
                    offsets.write(struct.pack("<Q", at))
                    texts.write(line)
                    lengths.add(len(path))
                    at, n = at + len(line), n + 1
            if first is not None:
                offsets.write(struct.pack("<Q", at))
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([root.rpartition("/")[2]]), pa.array([str(first)]), pa.array([n], pa.int64()), pa.array([sorted(lengths)], pa.list_(pa.int32()))], names=["part", "first", "n", "lengths"])

    made = write_table(order.mapInArrow(write, "part string, first string, n bigint, lengths array<int>"), "urlparts")
    parts = sorted(made.collect(), key=lambda r: int(r.first))
    drop_table(made)
    store, root = _open(place)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/about") as about:
        about.write(json.dumps({"parts": [[r.part, int(r.first), r.n] for r in parts], "path_lengths": sorted({k for r in parts for k in r.lengths})}).encode())
    return place


class Index:
    """The memory-mapped arrays of one index, by part."""

    def __init__(self, place: str):
        store, root = _open(place)
        self.about = json.loads(store.open_input_stream(f"{root}/about").read())
        self.firsts = np.array([p[1] for p in self.about["parts"]], "u8")
        self.keys, self.rules, self.offsets = [], [], []
        for part, _, _ in self.about["parts"]:
            keys, rules, offsets = (self._map(store, f"{root}/{part}/{x}") for x in ("keys", "rules", "offsets"))
            self.keys.append(np.frombuffer(keys, "<u8"))
            self.rules.append(rules)
            self.offsets.append(np.frombuffer(offsets, "<u8"))

    @staticmethod
    def _map(store, path: str):
        if isinstance(store, fs.LocalFileSystem):
            with open(path, "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        handle, own = tempfile.mkstemp()  # of this worker alone; unlinked while mapped
        with os.fdopen(handle, "r+b") as f, store.open_input_stream(path) as source:
            while part := source.read(1 << 20):
                f.write(part)
            f.flush()
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        os.unlink(own)
        return mapped

    def rule(self, part: int, i: int) -> tuple[str, str, str]:
        return tuple(json.loads(self.rules[part][int(self.offsets[part][i]) : int(self.offsets[part][i + 1])]))

    def match(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str, str] | None]:
        """The winning rule of each (host, path), or None."""
        out: list = [None] * len(hosts)
        if not len(self.firsts):
            return out
        owner, tried = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            prefixes = [path[:k] for k in self.about["path_lengths"] if k <= len(path)]
            at = 0
            while at >= 0:
                tail = host[at:]
                for p in prefixes:
                    owner.append(i)
                    tried.append((tail, p))
                dot = host.find(".", at)
                at = dot + 1 if 0 <= dot < len(host) - 1 else -1
        if not tried:
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest(h + p, seed=42) for h, p in tried), "u8", len(tried))
        parts = np.searchsorted(self.firsts, keys, "right") - 1
        for part in np.unique(parts[parts >= 0]).tolist():
            own, mine = self.keys[part], np.flatnonzero(parts == part)
            spot = np.searchsorted(own, keys[mine])
            hit = (spot < len(own)) & (own[np.minimum(spot, len(own) - 1)] == keys[mine])
            for j, k in zip(mine[hit].tolist(), spot[hit].tolist(), strict=True):
                while k < len(own) and own[k] == keys[j]:
                    rule = self.rule(part, k)
                    if rule[:2] == tried[j]:
                        best = out[owner[j]]
                        if best is None or (len(rule[0] + rule[1]), len(rule[0])) > (len(best[0] + best[1]), len(best[0])):
                            out[owner[j]] = rule
                        break
                    k += 1
        return out


OPENED: dict[str, Index] = {}


def filter_urls(pages: DataFrame, index: str, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per page: id, host, path, the winning rule or null, and the verdict. Narrow: one pass without a shuffle, reading two columns."""
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if index not in OPENED:
            OPENED.clear()
            OPENED[index] = Index(index)
        rules = OPENED[index]
        for batch in batches:
            won = rules.match(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array([r and r[0] + r[1] for r in won], pa.string()), pa.array([r[2] if r else default for r in won], pa.string())], schema=schema)

    url = F.col("url")
    split = pick(pages, id_col, url_col).toDF("page_id", "url").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    return split.mapInArrow(judge, "page_id bigint, host string, path string, rule string, verdict string")
