import corpus_pipeline
from trialspark.llm import bpe, mixing, substring_dedup

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    kept = corpus_pipeline.filter_quality(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    single = corpus_pipeline.drop_near_copies(spark, kept, SF)
    assert single.columns == docs.columns and single.count() <= kept.count()
    cut = corpus_pipeline.cut_repeats(spark, single, SF)
    assert cut.columns == docs.columns and cut.count() == single.count()
    removed = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(single).collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (single, cut))
    assert all(len((before[i] or "").split()) - len(after[i].split()) == removed[i] for i in after)
    out = corpus_pipeline.run(spark, SF)
    rows = mixing.mix_sources(cut).groupBy("doc_id").count().collect()
    assert sorted((r.doc_id, r["count"]) for r in rows) == sorted((r.doc_id, r["count"]) for r in out.groupBy("doc_id").count().collect())
    tokens = {r.doc_id: r.ids_sha256 for r in bpe.digests(cut.select("doc_id", "text")).collect()}
    assert all(tokens[r.doc_id] == r.ids_sha256 for r in out.collect())


def test_stages_take_odd_rows_and_empty_tables(spark):
    long = " ".join(f"word{i}" for i in range(120))
    rows = [(1, long, "en", "s", 5), (2, long, "en", "s", 5), (2, long + " more", None, None, None), (None, None, None, None, None), (None, "text", "en", "s", 4), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, " \n ", None, "t", 3), (5, "x" * 200_000, "en", "t", 200_000), (6, "tail " + long, "de", "u", 9)]
    docs = spark.createDataFrame([(*r, "extra", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, score double")
    for _, stage in corpus_pipeline.STAGES:
        plain = docs.select(*corpus_pipeline.COLUMNS)
        for d in (docs, plain):
            out = stage(spark, d, SF)
            assert out.count() >= (0 if stage is corpus_pipeline.mix else 1)
            assert stage is corpus_pipeline.tokenize or out.columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, plain.limit(0), SF).count() == 0
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs.where("doc_id in (1, 6)"), SF).collect()}
    assert cut == {1: long, 6: "tail "}
