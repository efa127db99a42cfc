"""Edge cases, brute-force versions and round trips of the ten operators."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadloom.llm import chat, decontam, jaccard, langid, media, packing, quality, toxicity, urlfilter, warc
from threadloom.llm.queries import tokenizer_path

random.seed(7)
WORDS = ["".join(p) for p in itertools.product("bdgk", "aeiou", "mnr")]


def prose(n, words=WORDS):
    return " ".join(random.choice(words) for _ in range(n))


def test_languages_of_odd_rows(odd, none):
    model = langid.fit(odd, fold_out=False)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (5, "und"), (1, "en"), (4, "xx")} <= got
    assert langid.predict(odd, model).count() == odd.count()
    empty = langid.fit(none, fold_out=False)
    assert empty.langs == [] and langid.predict(none, empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 700, 0, 128, 3, 300])
    scores = rng.normal(0, 3, (sizes.sum(), 3)).astype("f4")
    got, at = langid.viterbi(scores, sizes, 4.0), 0
    for n in sizes:
        s = scores[at : at + n].astype(float)
        value = lambda path: sum(s[i, k] for i, k in enumerate(path)) - 4.0 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
        v = np.zeros(3)
        for e in s:
            v = np.maximum(v, v.max() - 4.0) + e
        if n:
            assert abs(value(got[at : at + n].tolist()) - v.max()) < 1e-2
        at += n


def test_spans_and_scripts_of_mixed_text(spark):
    latin = [(i, prose(40), "la") for i in range(20)]
    greek = [(100 + i, " ".join(random.choice(["αβγ", "δεζ", "ηθι"]) for _ in range(30)), "el") for i in range(20)]
    model = langid.fit(spark.createDataFrame(latin + greek, "doc_id long, text string, lang string"), fold_out=False)
    text = prose(10) + " αβγ δεζ ηθι αβγ δεζ " + prose(4)
    ((lang, score, spans),) = model.predict([text])
    assert lang == "la" and 0.5 < score < 1 and [s["lang"] for s in spans] == ["la", "el", "la"]
    assert text[spans[1]["start"] : spans[1]["end"]] == "αβγ δεζ ηθι αβγ δεζ"


def test_archives_read_back(spark, tmp_path):
    rows = [(5, "http://a/1", "<p>é</p>"), (3, "http://a/2", "<p>é</p>"), (9, None, "<p>é</p>"), (4, "http://a/ü\n", ""), (7, "u", None), (1, "v", "x" * 300_000), (1, "v", "x" * 300_000), (None, "w", "own"), (8, "z", "<p>é</p>\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, file string, offset int")
    index = warc.write_archive(pages)
    got = warc.read_records(index).collect()
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, u, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, u, h in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (4, "response", None), (7, "revisit", 4), (1, "response", None), (None, "response", None), (8, "response", None)}
    assert {bytes(r.payload) for r in got if r.page_id == 8} == {b"<p>\xc3\xa9</p>\r\n\r\n"}
    assert warc.read_records(index.where("page_id = 5")).count() == 1
    unshared = warc.read_records(warc.write_archive(pages, min_bytes=10)).where("record_type = 'revisit'").collect()
    assert {r.page_id for r in unshared} == set()
    assert warc.read_records(warc.write_archive(pages.limit(0))).count() == 0


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 105, 5)]
    assert [len(r) for r in warc.ranges(iter(rows), max_gap=4)] == [2, 1, 1]
    assert [len(r) for r in warc.ranges(iter(rows), max_gap=100, max_range=12)] == [1, 1, 1, 1]


def check_plan(plan, items, capacity):
    """The fill of each sequence that a plan makes of these lengths, with gapless offsets."""
    counts, used = Counter(items), defaultdict(dict)
    plan = sorted(plan)
    for (length, first, seq, offset), nxt in zip(plan, [*plan[1:], (None, 0, 0, 0)], strict=True):
        for k in range((nxt[1] if nxt[0] == length else counts[length]) - first):
            assert offset not in used[seq + k]
            used[seq + k][offset] = length
    for own in used.values():
        ends = np.cumsum([own[o] for o in sorted(own)])
        assert [0, *ends[:-1].tolist()] == sorted(own) and ends[-1] <= capacity
    assert sum(sum(own.values()) for own in used.values()) == sum(items)
    return used


@pytest.mark.parametrize("seed", range(4))
def test_sweeps_against_best_fit_decreasing(spark, seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(1, [50, 20, 50, 30][seed]) for _ in range([300, 400, 1, 60][seed])), reverse=True)
    bins = []
    for x in items:
        fit = [b for b in bins if sum(b) + x <= 50]
        (min(fit, key=lambda b: 50 - sum(b)) if fit else bins.append([]) or bins[-1]).append(x)
    used = check_plan(packing.sweep(spark, dict(Counter(items)), 50), items, 50)
    assert len(used) <= 1.01 * len(bins) + 1
    with pytest.raises(ValueError):
        packing.sweep(spark, {51: 1}, 50)


def test_each_gap_goes_to_the_longest_piece_it_succeeds():
    """One sweep against its plain form: pieces in falling order, each in the smallest gap that is free or holds its own length."""
    for seed in range(30):
        rng = random.Random(seed)
        items = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 60))), reverse=True)
        rooms = [rng.randint(1, 50) for _ in range(rng.randint(0, 40))]
        runs = [(packing.PIECES, x, 0, n) for x, n in Counter(items).items()] + [(packing.GAPS, g, i, 1) for i, g in enumerate(rooms)]
        rows = packing.successors(runs, 50)
        left, taken = list(rooms), {}
        lost = Counter()
        for x in items:
            fit = [i for i, g in enumerate(left) if g >= x and taken.get(i, x) == x]
            if not fit:
                lost[x] += 1
                continue
            # a gap that already holds this length is the smaller one, else the smallest
            i = min(fit, key=lambda i: (i not in taken, rooms[i]))
            left[i], taken[i] = left[i] - x, x
        assert Counter({r[1]: r[3] for r in rows if r[0] == packing.PIECES}) == lost
        got = Counter(left)
        rest = Counter()
        for r in rows:
            if r[0] in (packing.GAPS, packing.SHRUNK):
                rest[r[1]] += r[3]
        assert rest == Counter({g: n for g, n in got.items() if g})


def test_packing_of_odd_rows(odd, none):
    found = packing.pieces(odd, tokenizer_path()).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    texts = sorted((r.text or "" for r in odd.collect()))
    want = sorted(np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts)
    docs, last = [], None
    for r in found:
        if r.piece == 0:
            docs.append(b"")
            last = 0
        assert r.start == last and len(r.ids) == 4 * r.length and (r.piece == 0 or r.length == 2048)
        docs[-1] += bytes(r.ids)
        last += r.length
    assert sorted(docs) == want
    sums = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.digests(odd, tokenizer_path()).collect())
    assert sums == Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in found)
    packed = packing.pack(packing.digests(odd, tokenizer_path())).toPandas().sort_values(["sequence_id", "offset"])
    assert len(packed) == len(found)
    ends = packed.groupby("sequence_id").length.cumsum()
    assert (ends - packed.length == packed.offset).all() and ends.max() <= 2048
    assert packing.pack(packing.digests(none, tokenizer_path())).count() == 0


ODD_TEXTS = [
    "it's we'll THEY'RE", "a  b   \n\n c\t d ", "x1y22 3.5 $%^ é ñandú Ünder", "<|endoftext|> hi", "日本 mixed Ωmega", "\u2028 \x0b\x1c a", "  ", "don't 'tis ' s", "", "'", "''s 's's \n's\n\n're", "'re'r e'v", " 'll", "\n", "a\n\n", "\n a", "a'", "x" * 5000, "é'mÿ×÷ 12'3", "'\u00e9s", "\x00a", "\x7f", "'s", "'l", "'ve",
]


def test_split_is_the_tokenizers_own():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice("ab'strevlmd \n\t  19.-é") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    want = [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    small = packing.Encoder(tokenizer_path(), entries=16)  # entries are overwritten all the time
    large = packing.Encoder(tokenizer_path(), entries=1 << 12)
    for encoder in (small, large, large):
        assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [small.encode([t])[0].tolist() for t in texts] == want
    assert large.encode([]) == []


def brute_links(texts):
    sets = {i: set(s.tolist()) for i, s in zip(texts, jaccard.shingle_sets(list(texts.values())), strict=True)}
    links, root = Counter(), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (top(i), links[i]) for i in sets}


@pytest.mark.parametrize("limit", [1024, 4])
def test_jaccard_join_against_brute_force(spark, limit):
    """With a limit of 4 the buckets are split to full depth, then tiled."""
    texts, n = {}, 0
    shared = prose(30)
    for _ in range(25):
        base = prose(random.randint(30, 90)).split()
        for _ in range(random.choice([1, 1, 2, 12])):
            own = list(base)
            for _ in range(random.choice([0, 0, 1, 2])):
                own[random.randrange(len(own))] = "changed"
            texts[n] = " ".join(own) + (" " + shared if random.random() < 0.3 else "")
            n += 1
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, path string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(rows, limit=limit).collect()}
    assert got == brute_links(texts)


def test_jaccard_of_odd_rows(odd, none):
    got = [(r.doc_id, r.class_id, r.n_links, r.copies) for r in jaccard.join(odd).collect()]
    assert len(got) == odd.count()
    assert Counter(got)[(1, 1, 3, 3)] == 2 and (7, 1, 3, 3) in got and (2, 2, 0, 1) in got and (3, 3, 0, 1) in got and (6, 6, 0, 1) in got
    kept = jaccard.representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) in ([0, 1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6])
    assert jaccard.join(none).count() == 0 and jaccard.representatives(none).count() == 0


def brute_hits(texts, items, window=10):
    out = {}
    own = {i: decontam.words(t) for i, t in items}
    for doc, text in texts.items():
        words, hit, found = decontam.words(text), set(), set()
        for i, w in own.items():
            k = min(window, len(w))
            wins = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
            for j in range(len(words) - k + 1):
                if tuple(words[j : j + k]) in wins:
                    hit |= set(range(j, j + k))
                    found.add(i)
        out[doc] = (len(words), len(hit), sorted(map(str, found)))
    return out


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_decontamination_against_brute_force(spark, block):
    few = WORDS[:4]
    items = [(i, prose(random.choice([1, 2, 3, 8, 10, 11, 25]), few)) for i in range(30)] + [(90, ""), (91, None), (92, "...")]
    texts = {i: prose(random.randint(0, 120), few + WORDS[4:6]) for i in range(60)} | {100: None, 101: "", 102: items[0][1] * 2000}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_words int")
    scan = decontam.scanner(spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    rows = decontam.scan(docs, scan)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for r in rows.collect()}
    assert got == brute_hits(texts, items)
    for r in decontam.report(rows).collect():
        assert r.n_hit == got[r.doc_id][1] and r.contaminated == (r.n_hit > 0) and r.items_sha256 == hashlib.sha256(",".join(got[r.doc_id][2]).encode()).hexdigest()


def test_cleaning_cuts_spans_only(spark, odd, none):
    item = prose(12)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before it. " + item.upper() + "! After it, more words follow here and there and on and on for long."), (2, item), (3, None), (4, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontam.clean(docs, decontam.scanner(items)).collect()}
    assert got == {1: "Before it. ! After it, more words follow here and there and on and on for long.", 3: None, 4: "clean"}
    no_items = decontam.scanner(items.limit(0))
    assert decontam.clean(odd, no_items).collect() == odd.collect() and decontam.clean(none, no_items).count() == 0


def test_url_rules(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("COM", "/en/", "block"), ("a.org", None, "block"), (None, "/x", "block"), ("b.org", "/x", "allow"), ("b.org", "/x", "block"), ("c", "", None)]
    urls = [(1, "http://www.Example.COM/en/71?q#f"), (2, "http://x.com/en/7"), (3, "https://notexample.com/en/7"), (4, None), (5, "no scheme/en/"), (6, "ftp://deep.a.org"), (7, "http://b.org/xy"), (8, "http://com/en/?"), (8, "http://com/en/?"), (9, "x://..com/en/"), (10, "u://")]
    index = urlfilter.build_index(spark.createDataFrame(rules, urlfilter.RULES))
    pages = spark.createDataFrame([(*u, "r", "v") for u in urls], "page_id long, url string, rule string, verdict string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, index).collect()]
    assert sorted(got, key=lambda r: r[0]) == [
        (1, "www.example.com", "/en/71", "example.com/en/7", "allow"), (2, "x.com", "/en/7", "com/en/", "block"), (3, "notexample.com", "/en/7", "com/en/", "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "deep.a.org", "", "a.org", "block"), (7, "b.org", "/xy", "b.org/x", "block"), (8, "com", "/en/", "com/en/", "block"), (8, "com", "/en/", "com/en/", "block"), (9, "..com", "/en/", "com/en/", "block"), (10, "", "", None, "allow"),
    ]
    nothing = urlfilter.build_index(spark.createDataFrame([], urlfilter.RULES))
    assert {r.verdict for r in urlfilter.filter_urls(pages, nothing, default="block").collect()} == {"block"}


def test_equal_keys_are_told_apart(spark):
    """A key that hits without its string does not decide."""
    index = urlfilter.Index(urlfilter.build_index(spark.createDataFrame([("a", "/b", "block")], urlfilter.RULES)))
    index.rule = lambda part, i: ("other", "/b", "block")
    assert index.match(["a"], ["/b"]) == [None]


def test_toxicity_finds_the_sentence(spark, odd, none, some_labels):
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        parts = [prose(8) for _ in range(6)]
        if bad:
            parts[random.randrange(6)] += " vileword " + prose(3)
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].score >= toxicity.THRESHOLD) == bool(y) for i, y in labels)
    assert all("vileword" in got[i].sentence for i, y in labels if y)
    assert [s for s, _ in model.offending("All is well. A vileword here! Fine")] == ["A vileword here!"]
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, some_labels, fold_out=False)).count() == odd.count()
    prior = toxicity.fit(none, some_labels, fold_out=False)
    assert prior.prior == 0.0


def turns(n_convs=30):
    rows = []
    for c in range(n_convs):
        for k in range(random.randint(1, 9)):
            role = "user" if k % 2 == 0 else "assistant"
            rows.append((c, k, role, prose(5) + "?" if role == "user" else prose(40) + ".\n" + prose(20) + "."))
    return rows


def test_roles_are_recovered(spark):
    data = turns() + [(500, 0, "user", "User: " + prose(4)), (500, 1, "assistant", "### Assistant:\n" + prose(30)), (None, 3, None, None), (501, None, "user", ""), (501, 1, None, "x"), (501, 1, None, "x")]
    rows = spark.createDataFrame([(*r, "p", 0) for r in data], "conv_id long, turn long, role string, text string, part string, place int")
    stored = chat.sort_turns(rows)
    model = chat.fit(stored, fold_out=False)
    got = chat.recover(stored, model).collect()
    assert len(got) == len(data)
    truth = {(c, k): r for c, k, r, _ in data if r and c is not None and c < 500}
    assert sum(truth[(r.conv_id, r.turn)] == r.role_pred for r in got if (r.conv_id, r.turn) in truth) >= 0.95 * len(truth)
    assert next(r.rendered for r in got if (r.conv_id, r.turn) == (500, 1)).startswith("<|assistant|>\n") and "###" not in next(r.rendered for r in got if (r.conv_id, r.turn) == (500, 1))
    empty = chat.sort_turns(rows.limit(0))
    assert chat.recover(empty, chat.fit(empty)).count() == 0


def test_one_conversation_over_many_parts(spark):
    """The path over parts is the path over the whole."""
    data = [(1, k, "user" if random.random() < 0.5 else "assistant", prose(random.randint(1, 30)) + random.choice("?.")) for k in range(400)] + [(2, 0, "user", "a?"), (0, 0, "user", "b?")]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        stored = chat.sort_turns(rows.repartition(8))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert stored.where("conv_id = 1").select("part").distinct().count() > 2
    model = chat.fit(stored, fold_out=False)
    whole = [r for r in sorted(data) if r[0] == 1]
    counts = Counter((a[2], b[2]) for a, b in itertools.pairwise(whole))
    want = np.log([[(counts[(a, b)] + 0.5) / (sum(counts[(a, x)] for x in model.roles) + 1) for b in model.roles] for a in model.roles])
    assert np.allclose(model.moves, want)
    best = model.path(np.array([model.emit(r[3]) for r in whole]), None, None)
    got = {(r.conv_id, r.turn): r.role_pred for r in chat.recover(stored, model).collect()}
    assert [got[(1, r[1])] for r in whole] == [model.roles[i] for i in best]


def test_quality_views_teach_each_other(spark, odd, none, some_labels):
    rows = []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, prose(60).capitalize() + "." if good else "".join(random.choice("#$%& AB9") for _ in range(300)), "en", f"src{i % 2 if good else 5}", 300))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert sum((got[i] >= 0.5) == (i % 3 > 0) for i in got) >= 0.97 * len(got)
    model = quality.fit(odd, some_labels, fold_out=False)
    scored = quality.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(none, model).count() == 0 and quality.fit(none, some_labels).prior == 0.5


def test_media_round_trip(odd, none):
    got = media.media_columns(odd).collect()
    assert len(got) == odd.count()
    for row, src in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(odd.collect(), key=lambda r: (r.doc_id or 0, len((r.text or "").encode()))), strict=True):
        raw = (src.text or "").encode()
        assert row.payload == raw + bytes(-len(raw) % 64 if raw else 64) and row.n_bytes == len(raw)
        for r in row.keyframes:
            assert row.media[r.offset : r.offset + r.length] in bytes(row.payload) and r.length == 64
    digests = media.digests(media.media_columns(odd)).collect()
    for r, m in zip(digests, got, strict=True):
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-64:]), hashlib.sha256(m.media).hexdigest())
    assert media.media_columns(none).count() == 0


def test_boxes_are_checked():
    stored = media.mux(media.pad(b"x" * 10_000))
    kinds = [p[-1] for p, _, _ in media.walk(stored)]
    assert kinds[:3] == [b"ftyp", b"moov", b"mvhd"] and kinds[-1] == b"mdat"
    assert media.probe(stored)["n_samples"] == 157
    with pytest.raises(ValueError):
        list(media.walk(stored[:-1]))
    with pytest.raises(ValueError):
        media.mux(b"x")
