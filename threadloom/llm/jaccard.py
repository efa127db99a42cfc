"""N-gram Jaccard self-join by chosen paths.

A document is the set of its shingles (runs of ``size`` words). Documents with
equal sets are one class with a representative, so copies never meet. Then:

1. Chosen paths. In each run a set picks tokens whose hash under the run's seed
   lies below 1 / (threshold * set size), so that similar sets share about one
   pick; a pick names a bucket. Buckets of one set end there. Buckets of more than
   ``limit`` sets are split again by the same rule, seeded by the path so far;
   those still larger after ``depth`` levels are cut into tiles, and all pairs of
   tiles are compared. The number of runs follows from the target recall. Sizes are
   counted first, with partial sums; the few large buckets are named by a short list,
   so their rows are never gathered by bucket.
2. Small buckets are compared by brute force, on minhash sketches with a wide
   margin. A bucket returns a spanning star of each connected lot only, never
   its pairs, and the stars' connected components are the clusters.
3. Exact check. The sets of clusters of two and more (made again from their texts;
   no others are) meet once per cluster. Inside, only what sets do not share with
   most of the cluster is compared, through postings, so a cluster of near copies
   costs what its differences cost and no matrix of pairs is held. Each document gets
   its number of links; stars of the links give the classes. A cluster of more than
   ``together`` sets or ``TOKENS`` shingles is first cut by set size: sets that link
   have sizes within the threshold, so bands of sizes only meet their neighbours, and
   each set is in two groups. Only a group that is still larger is tiled.

Only counts, bucket ids, 64-byte sketches and the sets of clustered
representatives are shuffled. Joins on ids and buckets may be skewed and are
plain equi-joins, which Spark splits; aggregates are partial first.

Defined results: one row per input row with doc_id, class_id (least doc_id of
the class, or null if all its ids are null), n_links (documents other than itself
at the threshold or above, copies included) and copies. A text of fewer words than
``size`` is one shingle of all its words; a null or wordless text links to
nothing, and its class is its own id. Repeated rows are copies. Texts are read
whole; other columns are not carried, so names cannot clash. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_table, pick, rest, scratch, write_table

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.999
LIMIT = 1024
DEPTH = 3
#: Sets, and shingles, of one cluster that one task compares; a larger cluster is cut.
TOGETHER, TOKENS = 8192, 4_000_000
#: Sets up to which a dense product counts what they share.
DENSE = 48
SKETCH = 64
#: Standard deviations below the threshold at which sketches still let a pair pass.
MARGIN = 4.5
#: Bytes of a table, counted in full, up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
KEPT_WORDS = 200_000
WORD = re.compile(r"\w+")
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


SKETCH_SEEDS = mix(np.arange(1, SKETCH + 1, dtype="u8")) | U(1)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


HASHES = Hashes()


def forget() -> None:
    """Frees the words kept, as other work may follow in this worker."""
    HASHES.clear()
    rest()


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    out = []
    for text in texts:
        words = WORD.findall(text.lower()) if text else ()
        if not words:
            out.append(np.zeros(0, "u8"))
            continue
        h = np.fromiter(map(HASHES.__getitem__, words), "u8", len(words))
        k = min(size, len(h))
        rolled = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            rolled = rolled * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out.append(np.unique(mix(rolled + U(k))))
    return out


def key_of(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def sketch_of(tokens: np.ndarray) -> bytes:
    best = np.full(SKETCH, U(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(tokens), 16384):
        best = np.minimum(best, (tokens[None, i : i + 16384] * SKETCH_SEEDS[:, None]).min(1))
    return ((best >> U(8)) & U(255)).astype("u1").tobytes()


def picks(tokens: np.ndarray, paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The child paths of these paths for this set: indices of the parents, and the children."""
    bar = U(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
    parents, children = [], []
    step = max(1, 2_000_000 // len(tokens))
    for i in range(0, len(paths), step):
        part = paths[i : i + step]
        h = mix(tokens[None, :] ^ part[:, None])
        row, col = np.nonzero(h < bar)
        parents.append(row + i)
        children.append(mix(part[row] + tokens[col] * U(0x9E3779B97F4A7C15)))
    return np.concatenate(parents), np.concatenate(children)


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold, in buckets that are split to that depth, has met with this probability."""
    # the worst pair at the threshold is a set and its subset: so many shared picks per level
    shared, met = 1.0, 1.0
    for _ in range(depth):
        met = 1 - math.exp(-shared * met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def least_matches(threshold: float) -> int:
    """Equal sketch bytes that a pair at the threshold has, but for MARGIN standard deviations."""
    p = threshold + (1 - threshold) / 256
    return math.floor(SKETCH * p - MARGIN * math.sqrt(SKETCH * p * (1 - p)))


def components(near: np.ndarray) -> np.ndarray:
    """The least member of the connected lot of each row of a symmetric boolean matrix."""
    n = len(near)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (label < 0))
                label[front] = i
    return label


def features(docs: DataFrame, runs: int, threshold: float, size: int) -> DataFrame:
    """Of each of docs(doc_id, text, own) its set's key, size, sketch and first picks, and own as it is."""
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, runs + 1, dtype="u8"))
        for batch in batches:
            for part, texts in chunks(batch):
                sets = shingle_sets(texts, size)
                paths = [picks(s, roots, threshold)[1].view("i8") if len(s) else s.view("i8") for s in sets]
                spots = np.cumsum([0, *map(len, paths)], dtype="i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2), pa.array(map(key_of, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(spots), pa.array(np.concatenate(paths)))],
                    schema=schema,
                )
        forget()

    return docs.mapInArrow(run, "doc_id bigint, own binary, key binary, n bigint, sketch binary, paths array<bigint>")


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for a broadcast if its rows, counted, have at most BROADCAST_BYTES at that size each."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def texts_of(docs: DataFrame, wanted: DataFrame, row_bytes: int) -> DataFrame:
    """wanted(doc_id, ...), a written table, with the texts of its documents."""
    return docs.withColumnRenamed("doc_id", "id").join(sized(wanted, row_bytes), F.col("id").eqNullSafe(F.col("doc_id"))).drop("id")


def split_again(docs: DataFrame, members: DataFrame, threshold: float, size: int, runs: int) -> DataFrame:
    """members(path, key, doc_id) of large buckets, as written rows (path, key, doc_id) of the buckets of the next level."""
    wanted = members.groupBy("key", "doc_id").agg(F.collect_set("path").alias("parents"))  # a set is in about 1.3 buckets a run
    schema = pa.schema([("path", pa.int64()), ("key", pa.binary()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text_at=0):
                keys, ids, parents = (part.column(i).to_pylist() for i in (1, 2, 3))
                rows: list[tuple] = []
                for tokens, key, doc, own in zip(shingle_sets(texts, size), keys, ids, parents, strict=True):
                    if key_of(tokens) == key:
                        _, found = picks(tokens, np.array(own, "i8").view("u8"), threshold)
                        rows += [(p, key, doc) for p in set(found.view("i8").tolist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        forget()

    found = texts_of(docs, write_table(wanted, "split"), 100 + 16 * runs).select("text", "key", "doc_id", "parents")
    return write_table(found.mapInArrow(run, "path bigint, key binary, doc_id bigint").dropDuplicates(["path", "key"]), "level")


def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[list]]:
    """Lists of columns of many whole groups, from rows sorted by the first `width` columns, which name the group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True))
        last = names[-1]
        at = batch.num_rows
        while at and names[at - 1] == last:
            at -= 1
        if at:
            whole = pa.Table.from_batches([*held, batch.slice(0, at)])
            yield [whole.column(i).to_pylist() for i in range(whole.num_columns)]
            held = []
        held.append(batch.slice(at))
    if held:
        whole = pa.Table.from_batches(held)
        yield [whole.column(i).to_pylist() for i in range(whole.num_columns)]
        del whole, held
    rest()


def stars(buckets: DataFrame, threshold: float) -> DataFrame:
    """Of bucket rows (path, tile, key, n, sketch) the stars (key, leader) of pairs whose sketches and sizes agree."""
    least = least_matches(threshold)

    def near(n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        out = np.zeros((len(n), len(n)), bool)
        rows = max(1, 16_000_000 // (len(n) * SKETCH))
        for i in range(0, len(n), rows):
            out[i : i + rows] = (sketch[i : i + rows, None, :] == sketch[None, :, :]).sum(2, dtype="u1") >= least
        return out & (n[:, None] >= threshold * n[None, :] - 1e-9) & (n[None, :] >= threshold * n[:, None] - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, tile, keys, sizes, raw in grouped(batches, 2):
            name = np.array(path, "i8") * 1_000_003 + np.array(tile, "i8")
            cut = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            count = np.diff(np.append(cut, len(name)))
            n, sketch = np.array(sizes, "i8"), np.frombuffer(b"".join(raw), "u1").reshape(-1, SKETCH)
            a, b = [], []
            two = cut[count == 2]  # most buckets are pairs
            ok = ((sketch[two] == sketch[two + 1]).sum(1) >= least) & (np.minimum(n[two], n[two + 1]) >= threshold * np.maximum(n[two], n[two + 1]) - 1e-9)
            a += (two[ok] + 1).tolist()
            b += two[ok].tolist()
            for at, m in zip(cut[count > 2].tolist(), count[count > 2].tolist(), strict=True):
                lead = components(near(n[at : at + m], sketch[at : at + m]))
                own = np.flatnonzero(lead != np.arange(m))
                a += (own + at).tolist()
                b += (lead[own] + at).tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in a], pa.binary()), pa.array([keys[i] for i in b], pa.binary())], names=["key", "leader"])

    order = buckets.repartition("path", "tile").sortWithinPartitions("path", "tile", "key").select("path", "tile", "key", "n", "sketch")
    return order.mapInArrow(run, "key binary, leader binary")


def tiled(rows: DataFrame, size: Column, name: str, limit: int) -> DataFrame:
    """rows with a column tile: 0 where the group has at most limit rows; else each row in all the pairs of tiles that hold its own."""
    tiles = F.ceil(size / limit).cast("long")
    own = F.pmod(F.xxhash64(name), tiles)
    every = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda t: F.least(t, own) * tiles + F.greatest(t, own))
    return rows.withColumn("tile", F.explode(F.when(tiles <= 1, F.array(F.lit(0).cast("long"))).otherwise(every)))


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(key, root) of all ends of edges(key, leader): least keys are passed along edges and roots are shortened, in turn, until nothing changes."""
    both = edges.union(edges.select("leader", "key")).toDF("key", "other").distinct()
    both = write_table(both, "edges")
    roots = write_table(both.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("root")), "roots")
    for _ in range(most_rounds):
        seen = both.join(roots.select(F.col("key").alias("other"), F.col("root").alias("near")), "other").groupBy("key").agg(F.min("near").alias("near"))
        step = roots.join(seen, "key").select("key", "root", F.least("root", "near").alias("next"))
        up = roots.select(F.col("key").alias("next"), F.col("root").alias("top"))
        moved = write_table(step.join(up, "next").select("key", F.least("next", "top").alias("root"), (F.least("next", "top") != F.col("root")).alias("moved")), "roots")
        drop_table(roots)
        roots = moved.select("key", "root")
        if moved.where("moved").isEmpty():
            return roots
    raise RuntimeError("the components did not settle")


def cut_clusters(members: DataFrame, threshold: float, together: int) -> DataFrame:
    """members(cluster, n, key, doc_id, copies) in groups whose sets one task compares: with columns of_group, tile, mine, tiles and low, which holds if the row's links to any row of the group count there."""
    sizes = write_table(members.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")), "clusters")
    parts = lambda: F.greatest(F.ceil(F.col("sets") / together), F.ceil(F.col("shingles") / TOKENS)).cast("long")
    large = sizes.where(parts() > 1).select("cluster")
    whole = dict(of_group=F.col("cluster"), tile=F.lit(0).cast("long"), mine=F.lit(0).cast("long"), tiles=F.lit(1).cast("long"), low=F.lit(True))
    cols = ["of_group", "tile", "mine", "tiles", "low", "key", "doc_id", "copies"]
    if large.isEmpty():
        return members.withColumns(whole).select(cols)
    few = sized(large, 64)
    rest = members.join(few, "cluster", "left_anti").withColumns(whole).select(cols)
    # sizes of sets that link differ by one band at most; a group holds a band and the next one
    band = F.floor(F.log("n") / F.lit(-math.log(threshold) * (1 + 1e-9))).cast("long")
    cut = members.join(few, "cluster").withColumn("band", band).withColumn("group", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    cut = cut.withColumn("of_group", F.unhex(F.md5(F.concat("cluster", F.col("group").cast("string").cast("binary"))))).withColumn("low", F.col("band") == F.col("group"))
    tiles = cut.groupBy("of_group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), F.max("low").alias("some")).where("some and sets > 1").select("of_group", parts().alias("tiles"))
    cut = cut.join(sized(write_table(tiles, "groups"), 80), "of_group")
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("tiles")))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.least(t, F.col("mine")) * F.col("tiles") + F.greatest(t, F.col("mine")))
    return rest.unionByName(cut.withColumn("tile", F.explode(every)).select(cols))


def exact_links(docs: DataFrame, members: DataFrame, threshold: float, size: int, together: int) -> DataFrame:
    """Of members(cluster, n, key, doc_id, copies) rows (key, links, leader) by group: documents linked to, and a key of the linked lot."""
    cut = write_table(cut_clusters(members, threshold, together), "cut")
    found = texts_of(docs, cut, 250).select("text", "of_group", "tile", "mine", "tiles", "low", "key", "copies")
    sets = pa.schema([("of_group", pa.binary()), ("tile", pa.int64()), ("mine", pa.int64()), ("tiles", pa.int64()), ("low", pa.bool_()), ("key", pa.binary()), ("copies", pa.int64()), ("tokens", pa.binary())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text_at=0):
                made = shingle_sets(texts, size)
                keep = [i for i, (s, k) in enumerate(zip(made, part.column(6).to_pylist(), strict=True)) if key_of(s) == k]
                own = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[own.column(i) for i in range(1, 8)], pa.array([made[i].tobytes() for i in keep], pa.binary())], schema=sets)
        forget()

    rows = found.mapInArrow(tokens, "of_group binary, tile bigint, mine bigint, tiles bigint, low boolean, key binary, copies bigint, tokens binary")
    order = rows.repartition("of_group", "tile").sortWithinPartitions("of_group", "tile", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, tile, mine, tiles, low, keys, copies, raw in grouped(batches, 2):
            out: list[tuple] = []
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or (group[i], tile[i]) != (group[start], tile[start]):
                    out += _links(keys[start:i], copies[start:i], raw[start:i], mine[start:i], low[start:i], tile[start], tiles[start], threshold)
                    start = i
            if out:
                k, links, lead = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(links, pa.int64()), pa.array(lead, pa.binary())], names=["key", "links", "leader"])

    return order.select("of_group", "tile", "mine", "tiles", "low", "key", "copies", "tokens").mapInArrow(run, "key binary, links bigint, leader binary")


def _links(keys: list, copies: list, raw: list, mine: list, low: list, tile: int, tiles: int, threshold: float) -> list[tuple]:
    once = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]  # repeated rows of one representative
    if len(once) < 2:
        return []
    sets = [np.frombuffer(raw[i], "u8") for i in once]
    n = np.array([len(s) for s in sets], "i8")
    weight = np.array([copies[i] for i in once], "i8")
    # rows meet in one group and tile only: by the lower band, and by the pair of tiles
    own, side = np.array([low[i] for i in once], bool), np.array([mine[i] for i in once], "i8")
    across = tiles > 1 and tile // tiles != tile % tiles
    lead, links = np.arange(len(once)), np.zeros(len(once), "i8")
    for i, shared in shared_counts(sets, n):
        linked = shared >= threshold * (n[i] + n - shared) - 1e-9
        linked[i] = False
        if not own[i]:
            linked &= own
        if across:
            linked &= side != side[i]
        near = np.flatnonzero(linked)
        if len(near):
            links[i] = weight[near].sum()
            lots = np.unique(np.append(lead[near], lead[i]))
            if len(lots) > 1:
                lead[np.isin(lead, lots)] = lots[0]
    return [(keys[once[i]], int(links[i]), keys[once[lead[i]]]) for i in np.flatnonzero(links).tolist()]


def shared_counts(sets: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each set in turn, its number and how many tokens it shares with every other set; what stands for itself means nothing."""
    m = len(sets)
    if m <= DENSE:
        yield from enumerate(overlaps(sets, n))
        return
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), n)
    # tokens that most sets have count through the sets that lack them, others through those that have them
    common = count > m // 2
    number = np.cumsum(common) - 1
    lacks = np.ones((m, int(common.sum())), bool)
    held = common[token]
    lacks[owner[held], number[token[held]]] = False
    row, col = np.nonzero(lacks)
    some = (count[token] > 1) & ~held
    row, col = np.concatenate([row, owner[some]]), np.concatenate([col, token[some] + lacks.shape[1]])
    lacking = lacks.sum(1)
    del lacks, held, some, token, owner
    order = np.argsort(col, kind="stable")
    posting, of = row[order], col[order]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(of)))
    place = np.empty(len(of), "i8")
    place[order] = np.repeat(np.arange(len(begin)), size)
    by_row = np.argsort(row, kind="stable")
    place, cuts = place[by_row], np.searchsorted(row[by_row], np.arange(m + 1))
    whole = int(common.sum())
    for i in range(m):
        lists = place[cuts[i] : cuts[i + 1]]
        long = size[lists]
        at = np.repeat(begin[lists] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        yield i, np.bincount(posting[at], minlength=m) + whole - lacking - lacking[i]


def overlaps(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of a few sets, by products of incidence matrices over blocks of the tokens that sets share."""
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    kept = count[token] > 1
    number = np.cumsum(count > 1) - 1
    token, owner = number[token[kept]], owner[kept]
    width, total = 4096, int((count > 1).sum())
    shared = np.zeros((len(sets), len(sets)), "f4")
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for i in range(0, total, width):
        a, b = np.searchsorted(token, (i, i + width))
        block = np.zeros((len(sets), min(width, total - i)), "f4")
        block[owner[a:b], token[a:b] - i] = 1
        shared += block @ block.T
    return shared


def own_text(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def classes(docs: DataFrame, threshold: float, size: int, recall: float, limit: int, depth: int, together: int) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text, own) the written rows (doc_id, own, key), and of each key (key, class, class_id, n_links, copies): class names the class even where ids are null or shared."""
    with scratch(docs.sparkSession):
        runs = runs_for(recall, threshold, depth)
        made = write_table(features(docs, runs, threshold, size), "features", keep=True)
        docs = docs.drop("own")
        reps = made.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
        reps = write_table(reps, "representatives")
        level = reps.select(F.explode(F.array_distinct("paths")).alias("path"), "key", "doc_id")
        edges = None
        for k in range(1, depth + 1):
            sizes = write_table(level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), f"sizes-{k}")
            hot = sizes.where(F.col("size") > limit).select("path")
            large = None if k == depth or hot.isEmpty() else sized(hot, 32)
            now = level.join(large, "path", "left_anti") if large is not None else level
            now = now.join(sizes if large is None else sizes.where(F.col("size") <= limit), "path").join(reps.select("key", "n", "sketch"), "key")
            found = write_table(stars(tiled(now, F.col("size"), "key", limit), threshold).distinct(), f"stars-{k}")
            edges = found if edges is None else edges.unionByName(found)
            if large is None:
                break
            level = split_again(docs, level.join(large, "path"), threshold, size, runs)
        near = connected(edges)
        members = near.select(F.col("root").alias("cluster"), "key").join(reps.select("key", "n", "doc_id", "copies"), "key")
        members = write_table(members, "members")
        linked = write_table(exact_links(docs, members, threshold, size, together), "links")
        links = linked.groupBy("key").agg(F.sum("links").alias("links"))
        classes = connected(linked.select("key", "leader").distinct())
        least = classes.join(reps.select("key", "doc_id"), "key").groupBy("root").agg(F.min("doc_id").alias("class_id"))
        by_key = reps.select("key", "doc_id", "copies").join(classes, "key", "left").join(least, "root", "left").join(links, "key", "left")
        by_key = by_key.select("key", F.coalesce("root", "key").alias("class"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
        return made.select("doc_id", "own", "key"), write_table(by_key, "classes", keep=True)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT, depth: int = DEPTH, together: int = TOGETHER) -> DataFrame:
    """Per document: doc_id, class_id, n_links, copies."""
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("own"))
    made, by_key = classes(docs, threshold, size, recall, limit, depth, together)
    out = made.select("doc_id", "key").join(by_key, "key", "left")
    alone = F.col("key").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT, depth: int = DEPTH, together: int = TOGETHER) -> DataFrame:
    """docs, all columns as they are, with one row of each class: of its least id, null ids last, and of that id's texts the one of the least hash. Rows without words all stay.

    Rows are told apart by id and text together, so null and repeated ids take no other class with them. What goes is
    broadcast if its rows, counted, are at most BROADCAST_BYTES, and else joined by a shuffle.
    """
    cols = docs.columns
    at = {c: cols.index(c) for c in (id_col, text_col)}
    plain = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    row_id, row_text = F.col(f"_c{at[id_col]}").cast("long"), F.col(f"_c{at[text_col]}")
    with scratch(docs.sparkSession):
        made, by_key = classes(plain.select(row_id.alias("doc_id"), row_text.alias("text"), own_text(row_text).alias("own")), threshold, size, recall, limit, depth, together)
        rows = made.where("key is not null").groupBy("key", "doc_id", "own").agg(F.count("*").alias("n"))
        rows = write_table(rows, "rows")
        first = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own", "n")).alias("first"))
        first = first.join(by_key.select("key", "class"), "key").groupBy("class").agg(F.min("first").alias("first"))
        first = write_table(first.select(F.col("first.doc_id").alias("id"), F.col("first.own").alias("own"), F.col("first.n").alias("n")), "first")
        goes = write_table(rows.join(first.select("id", F.col("own").alias("_own")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("_own")), "left_anti").select("doc_id", "own"), "goes", keep=True)
        twice = write_table(first.where("n > 1").select("id", "own"), "twice", keep=True)
    if goes.isEmpty() and twice.isEmpty():
        return docs
    marked = plain.withColumns({"_id": row_id, "_own": own_text(row_text)})
    kept = marked.join(sized(goes, 120), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_own") == F.col("own")), "left_anti")
    if not twice.isEmpty():
        kept = kept.join(sized(twice, 120), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_own") == F.col("own")), "left")
        kept = kept.where("own is null").drop("id", "own").unionByName(kept.where("own is not null").drop("id", "own").dropDuplicates(["_id", "_own"]))
    return kept.drop("_id", "_own").toDF(*cols)
