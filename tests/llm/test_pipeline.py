"""The corpus pipeline against brute force, stage by stage, and the registered queries."""

from __future__ import annotations

import pytest

from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_packing

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline as p

    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        kept[name] = (docs, docs := spark.read.parquet(path))
    return kept


def test_names_and_columns(spark, stages):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "best_fit_packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == stages[name][0].columns


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages["toxicity"]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean, toxic = [d for d, t in labels.items() if t == 0], [d for d, t in labels.items() if t == 1]
    assert sum(d in kept for d in clean) >= 0.99 * len(clean) and sum(d in kept for d in toxic) <= 0.3 * len(toxic)
    assert after.subtract(before).count() == 0


def test_toxic_documents_of_a_larger_table_go(spark):
    """With the whole sample to learn from: nine in ten toxic documents go, and no clean one of a hundred."""
    import corpus_pipeline as p

    data = "/root/testdata/sf0.1"
    kept = {r.doc_id for r in p.drop_toxic(spark, spark.read.parquet(f"{data}/documents.parquet"), data).select("doc_id").collect()}
    stay = {0: [], 1: []}
    for r in spark.read.parquet(f"{data}/labels.parquet").collect():
        stay[r.toxic].append(r.doc_id in kept)
    assert sum(stay[1]) <= 0.1 * len(stay[1]) and sum(stay[0]) >= 0.99 * len(stay[0])


def test_one_of_each_group_stays(spark, stages):
    before, after = stages["ngram_jaccard_join"]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    wanted = brute(rows, 5, 80)
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(rows[x][0] for x, c in wanted.items() if c == rows[x][0])


def test_no_base_span_is_left(spark, stages):
    from planweft.llm import pii

    before, after = stages["pii"]
    assert before.count() == after.count()
    model = pii.Model(pii.train(spark, 600).trees, float("inf"))
    left = pii.personal_data(after, model).selectExpr("sum(n_email + n_ip + n_card + n_phone) AS n").collect()[0].n
    found = pii.personal_data(before, model).selectExpr("sum(n_email + n_ip + n_card + n_phone) AS n").collect()[0].n
    assert found > 10 and left == 0
    assert after.where("n_chars <> char_length(text)").count() == 0


def test_packing_of_what_is_left(stages, tokenizers_dir):
    before, after = stages["best_fit_packing"]
    rows = after.collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in before.collect()], tokenizers_dir("word_bpe_49k.json"), 2048)
    assert n <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_registered(spark):
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
