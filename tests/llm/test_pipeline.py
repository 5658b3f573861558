import inspect

import pytest

import corpus_pipeline
from wardline.llm.exact_dedup import exact_duplicates
from wardline.llm.near_dedup import near_duplicates
from wardline.llm.common import without


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    from wardline.llm.common import stored

    docs, steps = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf_dir), "test-" + name)
        steps.append((name, docs, after))
        docs = after
    return steps


def test_stages(stages):
    assert [name for name, _, _ in stages] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    for name, before, after in stages[:-1]:
        assert after.schema == before.schema
        assert after.count() <= before.count()
        if name != "secrets":
            assert after.exceptAll(before).count() == 0


def test_stages_do_what_their_operators_say(stages):
    by_name = {name: (before, after) for name, before, after in stages}
    before, after = by_name["exact_dedup"]
    assert after.count() == before.selectExpr("lower(text) as t").distinct().count()
    assert exact_duplicates(after).where("not kept").count() == 0
    before, after = by_name["near_dedup"]
    assert after.count() == near_duplicates(before).select("component_id").distinct().count()
    before, after = by_name["secrets"]
    assert after.count() == before.count()
    assert after.where("text rlike 'AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}'").count() == 0
    before, after = by_name["packing"]
    assert after.select("doc_id").distinct().count() == before.count()


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = corpus_pipeline.run(spark, sf_dir).select(columns)
    assert found.exceptAll(stages[-1][2].select(columns)).count() == 0 and found.count() == stages[-1][2].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_awkward_documents_pass_every_stage(spark, sf_dir, awkward):
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, awkward, sf_dir)
        assert stage(spark, awkward.limit(0), sf_dir).count() == 0
        if name != "packing":
            assert out.columns == awkward.columns
        out.count()


def test_without(spark, frame):
    docs = frame([(1, "a"), (None, "b"), (2, "c"), (2, "d")])
    assert sorted(str(r.doc_id) for r in without(docs, spark.createDataFrame([(2,), (None,)], "doc_id long")).collect()) == ["1", "None"]


def test_other_texts_under_an_id_that_goes_stay(spark, sf_dir, frame):
    stay = lambda stage, rows: sorted((r.doc_id, r.text) for r in stage(spark, frame(rows), sf_dir).collect())
    rows = [(5, "a"), (5, "b"), (9, "A")]
    assert stay(corpus_pipeline.exact_dedup, rows) == [(5, "b"), (9, "A")]
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text), (5, text + " end"), (5, "other words under this id, not like any"), (7, text + " x"), (None, text)]
    found = corpus_pipeline.near_dedup(spark, frame(rows), sf_dir).collect()
    assert sorted((str(r.doc_id), r.text) for r in found) == sorted((str(i), t) for i, t in (rows[0], rows[2], rows[4]))


def test_equal_rows_under_one_id_leave_one(spark, sf_dir, frame):
    rows = [(5, "Some text"), (5, "some TEXT"), (5, "some text"), (4, "some text"), (6, "b"), (6, "b"), (6, "c"), (7, None), (7, ""), (None, "d"), (None, "d")]
    found = corpus_pipeline.exact_dedup(spark, frame(rows), sf_dir).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in found) == [
        ("5", "some text"), ("6", "b"), ("6", "c"), ("7", ""), ("None", "d"), ("None", "d")
    ]
