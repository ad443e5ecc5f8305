"""The pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline
from geolark.llm import langid, linededup, packing
from geolark.llm.common import DOCUMENT_COLUMNS

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == DOCUMENT_COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if name == "language_id":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in langid.identify_documents(before).collect() if r.lang_pred != "und"}
            assert {r.doc_id: r.lang for r in docs.collect()} == {r.doc_id: r.lang_pred for r in langid.identify_documents(before).collect() if r.lang_pred != "und"}
        if name == "line_dedup":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
            grams: dict = {}
            for r in docs.collect():
                for h in linededup.Lines.of_texts([r.text])[0].winnow()[3].tolist():
                    assert grams.setdefault(h, r.doc_id) == r.doc_id
        if name == "near_dedup":
            assert len({r.doc_id for r in docs.collect()}) == kept[-1] < kept[-2]
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
    assert packing.END_ID == 0


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    again = corpus_pipeline.run(spark, DIR).collect()
    key = lambda r: str((r.doc_id, r.piece, r.length, r.ids_crc32))
    assert rows and sorted(map(key, rows)) == sorted(map(key, again))


def test_language_stage_writes_what_it_finds(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    wrong = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'xx' else lang end as lang", "source", "n_chars")
    more = wrong.union(wrong.limit(1).selectExpr("doc_id", "'123 456' as text", "lang", "source", "n_chars"))
    got = corpus_pipeline.language_id(spark, more, DIR)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = got.collect()
    assert len(rows) == docs.count() and "xx" not in {r.lang for r in rows}
    assert sum(r.lang == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_very_many_equal_rows(spark):
    """Equal rows are left out where they stand, before any shuffle; none of the plans numbers them in one task."""
    from geolark.llm import mixing, simhash

    row = (1, "the same words again and again in every row of it", "en", "hot", 50)
    docs = spark.createDataFrame([row] * 3000 + [(2, "other words that stand alone in this one document", "en", "b", 49), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.keep_one_of_each(docs)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted({tuple(r) for r in docs.collect()}, key=str)
    mixed = mixing.mix_documents(docs)
    want = {r.doc_id: 0 for r in docs.collect()}
    for r in mixing.mixed(docs).collect():
        want[r.doc_id] += r.copies
    got: dict = dict.fromkeys(want, 0)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert got == want and got[1] > 1000
    for plan in (kept, mixed):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "row_number" not in text and "partial_first" in text
