"""Operators against plain versions of what they compute, and results that do not hang on the order, the partitions or the size of a table."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat, decontam, jaccard, langid, media, quality, toxicity

WORDS = ["".join(p) for p in itertools.product("bdgk", "aeiou", "mnr")]
SF01 = "/root/testdata/sf0.1"


def prose(n, rng, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


# n-gram Jaccard join


def copies(rng, n, words=60, edits=3):
    """So many near copies of one text, with words changed at random places."""
    base = prose(words, rng).split()
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"x{i}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("m", [5, jaccard.DENSE, jaccard.DENSE + 1, 300])
def test_shared_counts_are_intersections(m):
    rng = random.Random(m)
    sets = jaccard.shingle_sets([*copies(rng, m - 2), prose(9, rng), "x"])
    n = np.array([len(s) for s in sets])
    for i, row in jaccard.shared_counts(sets, n):
        assert [int(x) for j, x in enumerate(row) if j != i] == [len(np.intersect1d(sets[i], s)) for j, s in enumerate(sets) if j != i]


@pytest.mark.parametrize("together", [8, 8192])
def test_large_clusters_are_cut_without_loss(spark, together):
    """Near copies of many lengths in one cluster: bands of sizes, and tiles inside them, keep every link once."""
    rng = random.Random(4)
    base = prose(200, rng).split()
    texts = {}
    for i in range(90):
        own = base[: rng.choice([40, 46, 52, 60, 70, 82, 96])]
        if rng.random() < 0.5:
            own[rng.randrange(len(own))] = f"x{i}"
        texts[i] = " ".join(own)
    sets = {i: set(s.tolist()) for i, s in zip(texts, jaccard.shingle_sets(list(texts.values())), strict=True)}
    linked = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = {a: sum(linked(a, b) for b in texts if b != a) for a in texts}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = jaccard.join(rows, together=together).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    classes = {r.doc_id: r.class_id for r in got}
    assert all(classes[a] == classes[b] for a, b in itertools.combinations(texts, 2) if linked(a, b))
    assert len(set(classes.values())) >= 2


def test_rows_grow_in_proportion_to_a_hot_group(spark):
    """What the join makes per set does not grow with the group it is in, whether the group is split again or cut."""
    per_set = []
    for n in (400, 800, 1600):
        sets = jaccard.shingle_sets(copies(random.Random(1), n, words=150))
        members = spark.createDataFrame([(b"c", len(s), jaccard.key_of(s), i, 1) for i, s in enumerate(sets)], "cluster binary, n long, key binary, doc_id long, copies long")
        per_set.append(jaccard.cut_clusters(members, 0.8, 200).where("tiles = 1 or tile = mine * (tiles + 1)").count() / n)
        assert jaccard.cut_clusters(members, 0.8, jaccard.TOGETHER).count() == n
    assert max(per_set) <= 2.0


def test_recall_against_all_rows(spark):
    """Documents whose id is divisible by 50 against all rows, by counting: all their links lie in their class, and are counted."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = jaccard.shingle_sets([r.text for r in rows])
    n = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()}
    links = found = right = asked = 0
    for i, r in enumerate(rows):
        if r.doc_id % 50 == 0 and n[i]:
            a, b = np.searchsorted(tokens, sets[i]), np.searchsorted(tokens, sets[i], "right")
            shared = np.bincount(np.concatenate([owner[x:y] for x, y in zip(a, b, strict=True)]), minlength=len(sets))
            near = np.flatnonzero(shared >= 0.8 * (n[i] + n - shared) - 1e-9)
            near = near[near != i]
            links += len(near)
            found += sum(got[rows[j].doc_id][0] == got[r.doc_id][0] for j in near)
            right += got[r.doc_id][1] == len(near)
            asked += 1
    assert asked >= 190 and links > 20 and found >= 0.99 * links and right >= 0.99 * asked


# language ID


def test_scores_and_spans_against_a_plain_version():
    rng = random.Random(2)
    langs = ["aa", "bb", "cc"]
    model = langid.Model(langs, np.array([[rng.random() * 50 for _ in langs] for _ in range(langid.BUCKETS)]), np.array([[10.0, 10, 0], [100, 90, 0], [0, 0, 50]] + [[0, 0, 0]] * (langid.OTHER - 2)))
    text = "Abc déf́ 12 Ωmega x. Γάμμά und so"
    low, words, start = text.lower(), [], None
    for i, c in enumerate(low + " "):
        inside = c.isalpha() or (c in "́" and start is not None)
        if inside and start is None:
            start = i
        if not inside and start is not None:
            words.append((start, i))
            start = None
    w = langid.Words([text])
    assert list(zip(w.start.tolist(), w.stop.tolist(), strict=True)) == words

    def bucket(a: str, b: str, c: str) -> int:
        x, y, z = (ord(k) if k else 0 for k in (c, b, a))
        mixed = (x * 0x9E3779B1 & 0xFFFFFFFF) ^ (y * 0x85EBCA77 & 0xFFFFFFFF) ^ (z * 0xC2B2AE3D & 0xFFFFFFFF)
        return ((mixed ^ mixed >> 15) * 0x27D4EB2F & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS)

    def plain(a: int, b: int) -> list[float]:
        padded = ["", "", *low[a:b], ""]
        sums = sum(model.shares[bucket(*padded[i : i + 3])] for i in range(len(padded) - 2))
        script = langid.script_table()[ord(low[a])]
        if script >= 3:  # no language was seen in it
            return [0.0] * 3
        return [float(s) if (k < 2 if script == 1 else k == 2) else -1e4 for k, s in enumerate(sums)]

    scores = [plain(a, b) for a, b in words]
    assert np.allclose(model.scores(w), scores, atol=1e-3)
    best = max(itertools.product(range(3), repeat=len(words)), key=lambda p: (sum(s[k] for s, k in zip(scores, p, strict=True)) - langid.SWITCH * sum(a != b for a, b in itertools.pairwise(p))))
    lang, share, spans = model.predict([text])[0]
    held = Counter()
    for (a, b), k in zip(words, best, strict=True):
        held[k] += b - a
    assert (lang, share) == (langs[held.most_common(1)[0][0]], pytest.approx(held.most_common(1)[0][1] / sum(held.values())))
    want = []
    for (a, b), k in zip(words, best, strict=True):
        if want and want[-1][0] == langs[k]:
            want[-1][2] = b
        else:
            want.append([langs[k], a, b])
    assert [[s["lang"], s["start"], s["end"]] for s in spans] == want


def test_marks_alone_are_no_letters():
    model = langid.Model(["aa"], np.ones((langid.BUCKETS, 1)), np.ones((langid.OTHER + 1, 1)))
    assert [x[:2] for x in model.predict(["́̂", " ́ 12", None, "á", "́a"])] == [("und", 0.0)] * 3 + [("aa", 1.0)] * 2


def test_every_language_is_learned_at_every_size(spark):
    rows = [(i, "bade koro mina " * 3, "big") for i in range(4000)] + [(9000 + i, "xyl zuq wvo " * 3, "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_lang=50, fold_out=False)
    assert model.langs == ["big", "rare"]
    assert [x[0] for x in model.predict(["koro mina", "zuq wvo"])] == ["big", "rare"]
    other = langid.fit(docs.repartition(7), per_lang=50, fold_out=False)
    assert np.array_equal(model.shares, other.shares)


# toxicity


def test_noisy_or_against_a_plain_version():
    rng = random.Random(3)
    known = {f: rng.uniform(-3, 3) for w in WORDS[:40] for f in toxicity.features(w)}
    model = toxicity.Model(known, -2.0)
    texts = [None, "", "...", "Bam!", "bam bem. bim\n\nbom bum? dam"] + [". ".join(prose(rng.randint(1, 6), rng) for _ in range(rng.randint(1, 5))) for _ in range(30)]
    for text, got in zip(texts, model.score(texts), strict=True):
        miss, some = 1.0, False
        for line in "".join("|" if c in ".!?\n" else c for c in (text or "").lower()).split("|"):
            words = line.split()
            if words:
                some = True
                miss *= 1 - 1 / (1 + math.exp(-(sum(known.get(f, 0) for w in words for f in toxicity.features(w)) - 2)))
        assert got == pytest.approx(1 - miss if some else 1 / (1 + math.exp(2)), abs=1e-6)


def test_training_follows_the_gradient():
    """One step of the trainer's gradient against differences of the loss."""
    ids, sent, owner = np.array([0, 1, 1, 2, 0], "i4"), np.array([0, 0, 1, 2, 3], "i4"), np.array([0, 0, 1, 2], "i4")
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0])

    def loss(w: np.ndarray, b: float) -> float:
        p = toxicity.sigmoid(b + np.bincount(sent, w[ids], 4))
        doc = 1 - np.array([np.prod(1 - p[owner == d]) for d in range(3)])
        share = weight[y.astype(int)] / weight[y.astype(int)].sum()
        return float(-(share * (y * np.log(doc) + (1 - y) * np.log(1 - doc))).sum())

    w, b = toxicity.train(ids, sent, owner, y, 3, weight, 150, 0.0)
    assert loss(w, b) < 0.5 * loss(np.zeros(3), -1.0)


def test_samples_are_bounded_in_rows(spark):
    rows = [(i, f"w{i} text {j}") for i in range(30) for j in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    some = [toxicity.sample(x, labels, "toxic", (10, 8), fold_out=False)[0] for x in (docs, docs.unionByName(docs).repartition(6))]
    got = [sorted((r.doc_id, r.text, r.label) for r in x.collect()) for x in some]
    assert got[0] == got[1] and Counter(r[2] for r in got[0]) == {0: 10, 1: 8}
    a, b = (toxicity.fit(x, labels, fold_out=False, min_docs=1, max_toxic=8, max_clean=10) for x in (docs, docs.repartition(6)))
    assert a.known == b.known and a.bias == b.bias


# chat


def best_of(first, moves, scores):
    """The best path, by trying all."""
    k = len(first)
    return max(itertools.product(range(k), repeat=len(scores)), key=lambda p: first[p[0]] + sum(s[i] for s, i in zip(scores, p, strict=True)) + sum(moves[a][b] for a, b in itertools.pairwise(p)))


def some_model(rng) -> chat.Model:
    counts = Counter()
    for role in ("assistant", "system", "user"):
        counts[("role", role)] = 5
        counts[("first", role)] = rng.randint(1, 9)
        for other in ("assistant", "system", "user"):
            counts[("move", role, other)] = rng.randint(1, 9)
        for f, v in [(0, "none"), (0, role), (1, "5"), (1, "6"), (4, "."), (4, "?")]:
            counts[("seen", f, v, role)] = rng.randint(1, 9)
        for f, v in [(0, "5"), (0, "6"), (1, "."), (1, "?")]:
            counts[("line", f, v, role)] = rng.randint(1, 9)
    return chat.Model(counts)


def test_roles_are_the_best_of_all_paths():
    rng = random.Random(6)
    for _ in range(12):
        model = some_model(rng)
        texts = [prose(rng.randint(1, 9), rng) + rng.choice(".?") for _ in range(6)]
        scores = np.array([model.emit(t) for t in texts])
        assert tuple(model.path(scores, None, None)) == best_of(model.first, model.moves, scores)


def test_lines_are_the_best_of_all_paths():
    rng = random.Random(7)
    for _ in range(6):
        lines = chat.LineModel(some_model(rng))
        texts = [rng.choice(["", "User: ", "Assistant: ", "### System: "]) + prose(rng.randint(1, 6), rng) + rng.choice(".?") for _ in range(5)]
        with np.errstate(invalid="ignore"):
            path = best_of(lines.first, lines.moves, [lines.emit(t) for t in texts])
        k, want = len(lines.roles), []
        for t, s in zip(texts, path, strict=True):
            if s < k:
                want.append([lines.roles[s], t])
            else:
                want[-1][1] += "\n" + t
        assert [list(x) for x in lines.turns("\n".join(texts))] == want


def test_transcripts_are_split_into_turns(spark):
    rng = random.Random(8)
    data = [(c, k, "user" if k % 2 == 0 else "assistant", prose(5, rng) + "?" if k % 2 == 0 else prose(30, rng) + ".\n" + prose(20, rng) + ".") for c in range(30) for k in range(6)]
    model = chat.fit(chat.sort_turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")), fold_out=False)
    own, texts = [], []
    for c in range(40):
        turns = [("user" if k % 2 == 0 else "assistant", prose(5, rng) + "?" if k % 2 == 0 else prose(25, rng) + ".\n\n" + prose(20, rng) + ".") for k in range(rng.randint(1, 7))]
        own.append([chat.render(r, t) for r, t in turns])
        texts.append((c, "\n".join(("User: " if r == "user" else "### Assistant:\n") + t for r, t in turns), "more"))
    rows = spark.createDataFrame([*texts, (100, None, "x"), (101, " \n ", "x"), (102, texts[0][1], "x"), (None, "User: hi", "x")], "conv_id long, text string, turn string").repartition(3)
    got = {}
    for r in chat.parse_transcripts(rows, model).collect():
        got.setdefault(r.conv_id, {})[r.turn] = r.rendered
    flat = {c: [t[k] for k in sorted(t)] for c, t in got.items()}
    clean = lambda x: "".join(x.split())
    assert sum([clean(x) for x in flat[c]] == [clean(x) for x in own[c]] for c in range(40)) >= 38
    assert 100 not in flat and 101 not in flat and flat[102] == flat[0] and len(flat[None]) == 1
    assert chat.parse_transcripts(rows.limit(0), model).count() == 0


# quality


def test_scores_do_not_hang_on_the_tables_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    twice = docs.unionByName(docs.limit(20).withColumn("text", F.concat("text", F.lit(" more"))))
    for base in (docs, twice):
        a, b = ({(r.doc_id, round(r.score, 6)) for r in quality.score(base, quality.fit(x, y, rounds=2)).collect()} for x, y in ((base, labels), (base.repartition(7), labels.repartition(3))))
        assert a == b


# media


def test_broken_containers_give_an_error_text(spark):
    good = media.mux(media.pad(b"some text"))
    track = media.box(b"moov", media.box(b"trak", media.box(b"mdia")))
    rows = [("a", good), ("b", None), ("c", b""), ("d", good[:60]), ("e", b"\0\0\0\x09nope"), ("f", track), ("a", good), (None, good.replace(b"stsc", b"xxxx")), ("g", good.replace(b"stsz", b"free"))]
    found = media.probe_column(spark.createDataFrame([(*r, 1) for r in rows], "name string, codec binary, error int"), "name", "codec")
    got = sorted(found.collect(), key=lambda r: str(r.name))
    assert len(got) == len(rows) and found.columns == ["name", "codec", "duration_ms", "n_samples", "keyframes", "error"]
    for r in got:
        assert (r.error is None) == (r.name in ("a", "b")) and (r.codec is None) == (r.name != "a")
        if r.name == "a":
            want = media.probe(good)
            assert (r.duration_ms, r.n_samples, [list(k) for k in r.keyframes]) == (want["duration_ms"], want["n_samples"], want["keyframes"].tolist())
    assert media.probe_column(found.limit(0).selectExpr("name", "cast(null as binary) m"), "name", "m").count() == 0
    for wrong in (good[:60], track, b""):
        with pytest.raises(ValueError):
            media.read_payload(wrong)


# decontamination


def test_blocks_are_built_apart(spark):
    """Items in many blocks find what they find in one; ids that repeat over blocks are one id."""
    rng = random.Random(9)
    items = [(i % 25, prose(rng.randint(3, 30), rng, WORDS[:6])) for i in range(40)]
    docs = spark.createDataFrame([(i, prose(200, rng, WORDS[:6])) for i in range(20)], "doc_id long, text string")
    rows = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    one, many = decontam.scanner(rows), decontam.scanner(rows, block_words=60)
    assert len(one.places) == 1 and len(many.places) > 4
    a, b = ({tuple(r) for r in decontam.report(decontam.scan(docs, s)).collect()} for s in (one, many))
    assert a == b and any(r[3] > 1 for r in a)
