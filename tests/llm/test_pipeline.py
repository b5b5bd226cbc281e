from pyspark.sql import functions as F

from .test_near_copies import brute


def stages_of():
    import corpus_pipeline

    return corpus_pipeline.STAGES


def test_stages_take_effect(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "secret scans", "bpe"]
    from palimpsest.llm import decontaminate, quality, secret_scan
    from palimpsest.llm.shared import written

    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir))
        if name == "bpe":
            assert out.count() == docs.count() and {"n_tokens", "input_ids"} <= set(out.columns)
            assert out.where("size(input_ids) <> n_tokens").count() == 0
            continue
        assert out.columns == docs.columns
        assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        if name == "quality rules":
            assert out.count() == quality.quality_rules(docs).where("kept").count()
        if name == "simhash near-dedup":
            assert {r.doc_id for r in out.collect()} == brute([(r.doc_id, r.text) for r in docs.collect()])
        if name == "benchmark decontamination":
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            before = decontaminate.contamination(docs, items)
            assert before.where("contaminated").count() > 0 and decontaminate.contamination(out, items).where("contaminated").count() == 0
            clean = {r.doc_id for r in before.where("not contaminated").collect()}
            assert clean <= {r.doc_id for r in out.collect()}
        if name == "secret scans":
            assert out.count() == docs.count()
            assert secret_scan.scan_secrets(out).where("n_assign + n_access + n_hex > 0").count() == 0
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_stages_on_odd_tables(spark, sf_dir, clashing, all_docs):
    """Nulls in any column, empty and long texts, repeated rows, columns with the stages' own names, tables of three columns only, empty tables."""
    for name, stage in stages_of():
        plain = stage(spark, all_docs, sf_dir)
        extra = stage(spark, clashing, sf_dir)
        bare = stage(spark, all_docs.select("doc_id", "text", "source"), sf_dir)
        some = ["doc_id", "n_tokens", "ids_sha256"] if name == "bpe" else ["doc_id", "text", "source"]
        rows = [sorted(map(repr, df.select(*some).collect())) for df in (plain, extra, bare)]
        assert rows[0] == rows[1] == rows[2], name
        if name != "bpe":
            assert extra.columns == clashing.columns and bare.columns == ["doc_id", "text", "source"]
        assert stage(spark, clashing.limit(0), sf_dir).count() == 0
        if name in ("benchmark decontamination", "secret scans"):
            assert plain.where("text is null").count() == all_docs.where("text is null").count()
