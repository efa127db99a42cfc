"""The registered queries on odd tables: their columns, types, rows and folds; and the pipeline from end to end."""

import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from threadloom.llm.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent.parent
COLUMNS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4_ngram_jaccard": "doc_id bigint, class_id bigint, n_links bigint",
    "op5_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_chat_formatting": "conv_id bigint, turn bigint, held_out boolean, role_pred string",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
}
TABLE = {"op2_warc": "pages", "op6_url_filter": "pages", "op8_chat_formatting": "conversations"}


@pytest.fixture(scope="module")
def odd_dir(spark, odd, none, tmp_path_factory):
    """Two folders of tables: with odd rows, and empty."""
    place = tmp_path_factory.mktemp("odd")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (4, 0, 1), (5, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "<p>x</p>", 1), (2, None, "<p>x</p>", 1), (2, None, "<p>x</p>", 1), (None, "no url", None, None), (4, "http://ü.com/de/ y?z", "", 1), (5, "HTTP://B.ORG/es/#f", "é" * 70000, 1)], "page_id long, url string, html string, key int")
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs far", "x"), (None, "far away", "y"), (2, None, "z"), (3, "...", "z"), (1, "into the dark wood", "z")], "item_id long, text string, spans string")
    turns = spark.createDataFrame([(1, 0, "user", "hi?", 1), (1, 1, "assistant", "yes.", 1), (1, 1, "assistant", "yes.", 1), (None, None, None, None, None), (2, None, "user", "", 1)], "conv_id long, turn long, role string, text string, part int")
    for name, rows in (("documents", odd), ("labels", labels), ("pages", pages), ("benchmark", items), ("conversations", turns)):
        rows.write.parquet(f"{place}/odd/{name}.parquet")
        rows.limit(0).write.parquet(f"{place}/none/{name}.parquet")
    return place


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, odd_dir, name):
    found = QUERIES[name](spark, f"{odd_dir}/odd")
    wanted = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    assert [x for x in found.dtypes if x in wanted] == wanted
    rows = found.collect()
    table = spark.read.parquet(f"{odd_dir}/odd/{TABLE.get(name, 'documents')}.parquet")
    ids = sorted(str(r[0]) for r in table.select(wanted[0][0]).collect())
    if name != "op3_best_fit_packing":
        assert sorted(str(r[wanted[0][0]]) for r in rows) == ids
    else:
        assert sorted(str(r.doc_id) for r in rows if r.piece == 0) == ids
    for r in rows:
        if "held_out" in r:
            key = r[wanted[0][0]]
            assert r.held_out == (zlib.crc32(("" if key is None else str(key)).encode()) % 4 == 2)
        if "score" in r:
            assert 0 <= r.score <= 1
        if "predicted" in r:
            assert r.predicted == int(r.score >= (0.3 if name == "op7_toxicity" else 0.5))
    empty = QUERIES[name](spark, f"{odd_dir}/none")
    assert empty.columns == found.columns and empty.count() == 0


def test_records_say_what_the_pages_say(spark, odd_dir):
    rows = QUERIES["op2_warc"](spark, f"{odd_dir}/odd").collect()
    assert sorted(str((r.page_id, r.url, r.record_type, r.refers_to)) for r in rows) == sorted(
        map(str, [(1, "http://a.com/en/x", "response", None), (2, None, "revisit", 1), (2, None, "revisit", 1), (None, "no url", "revisit", 4), (4, "http://ü.com/de/ y?z", "response", None), (5, "HTTP://B.ORG/es/#f", "response", None)])
    )


def test_pipeline_from_end_to_end(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = cp.run(spark, sf_dir).toPandas().sort_values(["sequence_id", "offset"])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert set(got["doc_id"]) == {r.doc_id for r in docs.select("doc_id").collect()} and docs.count() < 200
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert (ends - got["length"] == got["offset"]).all() and ends.max() <= 2048
    assert got["sequence_id"].nunique() <= 1.01 * -(-got["length"].sum() // 2048) + 1


def test_pack_of_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    got = cp.pack(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(str(r.doc_id) for r in docs.collect())
    again = cp.pack(spark, docs.repartition(5), "").collect()
    key = lambda rows: sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert key(got) == key(again)
    assert docs.where(F.col("text").isNull()).count() == 1 and any(r.doc_id == 2 and r.length == 1 for r in got)


def test_entry_outlives_a_missing_dependency():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
