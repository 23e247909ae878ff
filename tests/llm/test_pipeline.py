import re

import corpus_pipeline as c
from .test_operators_llm import check_packing, near_brute, repeats_brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    kept = c.identify_language(spark, docs, sf_dir)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.text and re.search(r"[^\W\d_]", r.text)}
    near = c.drop_near_duplicates(spark, kept, sf_dir)
    comp = near_brute([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, k) in comp.items() if k == i)
    cut = c.drop_repeated_passages(spark, near, sf_dir)
    want = {i: v for (i, _), v in repeats_brute([(r.doc_id, r.text) for r in near.collect()]).items()}
    before = {r.doc_id: r.text for r in near.collect()}
    for r in cut.collect():
        assert len(WORD.findall(r.text)) == want[r.doc_id][0] - want[r.doc_id][1]
        assert want[r.doc_id][1] or r.text == before[r.doc_id]
    mixed = c.mix_sources(spark, cut, sf_dir)
    assert mixed.columns == c.COLUMNS and abs(sum(len(WORD.findall(r.text)) for r in mixed.collect()) - sum(len(WORD.findall(r.text)) for r in cut.collect())) <= cut.select("source").distinct().count()
    packed = c.pack_sequences(spark, mixed, sf_dir)
    assert packed.where("start = 0").count() == mixed.count()
    once = mixed.dropDuplicates(["doc_id"])
    check_packing(c.pack_sequences(spark, once, sf_dir).collect(), {r.doc_id: r.text for r in once.collect()})


def test_hard_rows_pass_every_stage(spark, hard_documents, empty_documents):
    for docs in (hard_documents, empty_documents):
        for k, (_, stage) in enumerate(c.STAGES):
            docs = stage(spark, docs, "")
            docs.count()
            if k < 4:
                assert docs.columns == c.COLUMNS


def test_hard_rows_keep_clean_documents(spark, hard_documents):
    kept = c.identify_language(spark, hard_documents, "")
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 8, 9, None, 11, 12, 13}
    near = c.drop_near_duplicates(spark, kept, "")
    assert sorted((r.doc_id or 0) for r in near.collect()) == [0, 1, 7, 8, 12, 13]
