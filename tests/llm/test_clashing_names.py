"""Every operator and pipeline stage on columns whose names clash with each other or with an operator's own."""

from __future__ import annotations

import pytest

from planweft.llm import ann, jaccard, packing, pieces, pii, sharding, token_orc, topk, toxicity, warc

EXTRA = ["Doc_ID", "TEXT", "c0", "C1", "__text_to_score", "__spans", "base", "SPANS", "score", "toxicity_score", "Stood_For_0", "stood_for", "signature", "of_doc", "row", "part", "n", "ids", "size", "length", "rank", "to_score", "searched", "blocks", "Lang", "lang"]


@pytest.fixture(scope="module")
def clashing(spark, make):
    """Nulls, empty texts, repeated rows and copies, with extra columns of every awkward name."""
    texts = [make(1, 60), make(1, 60), None, "", make(2, 40) + " a@b.c", "one", "one", make(4, 300), "ÄÖ é 中 😀 x", " \n\t "]
    ids = [1, 2, 3, 4, None, 7, 7, 8, 9, 10]
    rows = [(i, t, *(None if k % 4 == 0 else f"{name}-{k}" for name in EXTRA)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, ", ".join(f"`x{i}` {t}" for i, t in enumerate(["long", "string", *["string"] * len(EXTRA)]))).toDF("doc_id", "text", *EXTRA)


def extras(df):
    return sorted(tuple(map(str, r[2:])) for r in df.collect())


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x", "y"), (2, 1, 1, "x", "y"), (None, 0, 1, "x", "y"), (8, 0, None, "x", "y")], "doc_id long, quality int, toxic int, a string, b string").toDF("doc_id", "quality", "toxic", "Toxic", "DOC_ID")


def test_token_operators(spark, clashing, tokenizers_dir):
    assert packing.pack(clashing, tokenizers_dir("word_bpe_49k.json")).count() == 10
    assert token_orc.token_files(clashing, tokenizers_dir("byte_bpe_50k.json")).count() == 10
    path = tokenizers_dir("piece_bpe_32k.model")
    assert pieces.digests(pieces.decode(pieces.encode(clashing, path), path)).count() == 10


def test_shards_and_archives(spark, clashing):
    assert sharding.balanced_shards(clashing, shards=3).count() == 10
    pages = clashing.toDF("page_id", "html", "url", *clashing.columns[3:])
    assert warc.round_trip(pages).count() == 10


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "x", "y") for i in range(30)], "a long, b array<double>, c string, d string").toDF("vec_id", "embedding", "Vector", "score")
    from pyspark.sql import functions as F

    for found in (topk.exact_topk(df, F.col("vec_id") % 10 == 0, k=2), ann.nearest(df, F.col("vec_id") % 10 == 0, k=2)):
        assert found.count() == 6


def test_jaccard(spark, clashing):
    assert jaccard.jaccard_join(clashing).count() == 10
    kept = jaccard.one_of_each(clashing)
    assert kept.columns == clashing.columns and kept.count() == 9
    assert set(extras(kept)) <= set(extras(clashing))


def test_personal_data(spark, clashing):
    model = pii.train(spark, 300)
    assert pii.personal_data(clashing, model).count() == 10
    clean = pii.redact(clashing, model)
    assert clean.columns == clashing.columns and extras(clean) == extras(clashing)


def test_toxicity(spark, clashing, labels):
    model = toxicity.train(clashing, labels)
    made = toxicity.score(clashing, model, name="Toxic_Score")
    assert made.columns == [*clashing.columns, "Toxic_Score"] and sorted(tuple(map(str, r[2:-1])) for r in made.collect()) == extras(clashing)
    assert toxicity.below(clashing, model, 2.0).columns == clashing.columns and extras(toxicity.below(clashing, model, 2.0)) == extras(clashing)


def test_pipeline_stages(spark, clashing, labels, tmp_path):
    import corpus_pipeline as p

    labels.toDF("doc_id", "quality", "toxic", "other", "more").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (clashing, clashing.limit(0)):
        for name, stage in p.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns, name
            assert set(extras(after)) <= set(extras(docs)), name
            docs = after
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(p.STAGES[-1][1](spark, docs, str(tmp_path)).columns)
        packed = p.STAGES[-1][1](spark, docs, str(tmp_path)).count()
        assert packed == docs.count()


def test_stage_results_on_odd_rows(spark, make, tmp_path):
    """Null, empty, repeated and near-copied rows: what each stage keeps."""
    import corpus_pipeline as p

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, make(1, 60)), (2, make(1, 60)), (3, None), (4, ""), (None, make(1, 60)), (7, "one"), (7, "one"), (8, make(1, 60) + " more"), (9, make(5, 90) + " x@y.z")]
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.drop_toxic(spark, docs, str(tmp_path))
    assert kept.count() == 9
    kept = p.keep_one_of_near_duplicates(spark, kept, str(tmp_path))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 7, 7, 9]
    kept = p.redact_personal_data(spark, kept, str(tmp_path))
    assert {r.doc_id: r.text for r in kept.collect()}[9].endswith(" [EMAIL]") and kept.where("n_chars <> char_length(text)").count() == 0
    assert {r.doc_id: r.text for r in kept.collect()}[3] is None
