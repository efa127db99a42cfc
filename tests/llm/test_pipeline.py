"""The pipeline's stages against plain versions, and its contract."""

import corpus_pipeline as cp
from threadloom.llm import decontam, jaccard, langid, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_of_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert cp.pack(spark, docs.limit(0), SF).count() == 0


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in cp.drop_toxic(spark, docs, SF).collect()}
    assert kept == {i for i, r in rows.items() if model.score([r.text])[0] < toxicity.THRESHOLD}
    langs = langid.fit(docs)
    kept = {r.doc_id for r in cp.keep_languages(spark, docs, SF).collect()}
    assert kept == {i for i, r in rows.items() if (p := langs.predict([r.text])[0])[0] != "und" and p[1] >= cp.LEAST_SHARE}
    classes = {r.doc_id: r.class_id for r in jaccard.join(docs).collect()}
    assert {r.doc_id for r in cp.one_of_each(spark, docs, SF).collect()} == {i for i in rows if classes[i] == i}
    items = {" ".join(w[j : j + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [decontam.words(r.text)] for j in range(max(0, len(w) - 9))}
    cleaned = cp.clean_benchmark(spark, docs, SF).collect()
    for r in cleaned:
        words = decontam.words(r.text)
        assert r.n_chars == len(r.text)
        if r.text == rows[r.doc_id].text:
            assert not any(" ".join(words[j : j + 10]) in items for j in range(len(words) - 9))


def test_names_and_stages():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language_id", "ngram_jaccard", "decontamination", "best_fit_packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
