"""Each stage of the pipeline against a plain restatement, on what the stage before it kept."""

import math

import pandas as pd
import pytest

from salegrain.llm import quality, stages

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stage_results(spark, sf_dir, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.toPandas())
    return out


def pairs(df):
    return list(zip(df.doc_id, df.text, strict=True))


def test_all_but_the_last_return_documents(stage_results):
    assert all(list(df.columns) == COLUMNS for df in stage_results[:-1])


def test_quality_stage(spark, sf_dir, stage_results):
    before, after = stage_results[:2]
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality.score_quality(docs, quality.learn_quality(docs, labels)).toPandas()
    assert set(after.doc_id) == set(score.doc_id[score.score >= 0.5]) and 0 < len(after) < len(before)
    assert after.set_index("doc_id").text.equals(before.set_index("doc_id").text.loc[after.doc_id])


def test_line_stage(stage_results):
    before, after = stage_results[1:3]
    assert sorted(pairs(after)) == [(d, t) for d, _, _, t in brute.line_dedup(pairs(before))]
    assert (after.n_chars == after.text.str.len()).all()


def test_near_stage(stage_results):
    before, after = stage_results[2:4]
    want = brute.near_dedup(pairs(before), 5, 80)
    assert set(after.doc_id) == {d for d, (_, c) in want.items() if c == d} and len(after) < len(before)


def test_decontamination_stage(sf_dir, stage_results):
    before, after = stage_results[3:5]
    items = list(pd.read_parquet(f"{sf_dir}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False, name=None))
    assert set(after.doc_id) == {d for d, _, hit, _ in brute.decontaminate(pairs(before), items) if not hit}


def test_packing_stage(stage_results):
    docs, pieces = stage_results[4:]
    assert set(pieces.doc_id) == set(docs.doc_id)
    assert pieces.sequence_id.nunique() <= math.ceil(1.02 * pieces.length.sum() / 1024) + 1


def test_run_gives_what_the_stages_give(spark, sf_dir, stage_results):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert brute.counts(found[key].values) == brute.counts(stage_results[-1][key].values)


def test_stages_of_odd_rows(spark, docs_of, sf_dir):
    """Nulls, blanks, repeated rows and columns whose names the operators use inside."""
    docs = docs_of([(None, None), (1, ""), (1, ""), (2, "some plain text of words " * 3), (3, None), (4, "x " * 50_000)], extra=True)
    for stage in (stages.quality_stage, stages.line_stage, stages.near_dedup_stage, stages.decontaminate_stage):
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns and found.count() <= docs.count()
    assert stages.line_stage(spark, docs, sf_dir).count() == stages.near_dedup_stage(spark, docs, sf_dir).count() == 6
    assert stages.packing_stage(spark, docs, sf_dir).where("piece = 0").count() == 6
    none = docs.limit(0)
    for stage in (stages.quality_stage, stages.line_stage, stages.near_dedup_stage, stages.decontaminate_stage, stages.packing_stage):
        assert stage(spark, none, sf_dir).count() == 0
