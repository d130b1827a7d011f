"""The pipeline's stages on a small table with hard cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text import ODD, docs, labelled, prose

BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    texts, marks = labelled(240, np.random.default_rng(2))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, m, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    ids = [*range(240), *range(240, 240 + len(ODD)), None, None, BIG, BIG, 900, 901]
    same = prose(np.random.default_rng(5), 40)
    df = docs(spark, texts + ODD + [same + " tail", None, same, same, same, f'{same} more words token = "{"ab12" * 10}"'], ids)
    return df.withColumn("tox_score", F.lit("own")).withColumn("m_prob", F.lit(7)), path, texts, marks


def test_stages_keep_columns_and_decide(spark, table):
    df, path, texts, marks = table
    clean = corpus_pipeline.drop_toxic(spark, df, path)
    assert clean.columns == df.columns and {r.tox_score for r in clean.collect()} == {"own"}
    left = {r.doc_id for r in clean.collect()}
    assert sum(i in left for i in range(240) if not marks[i]) >= 178 and sum(i in left for i in range(240) if marks[i]) <= 4
    assert {BIG, 900} <= left
    near = corpus_pipeline.drop_near_copies(spark, df, path)
    got = [r.doc_id for r in near.collect()]
    assert near.columns == df.columns and 900 in got and BIG not in got and got.count(None) == 2
    twice = corpus_pipeline.drop_near_copies(spark, df.filter("doc_id > 1000"), path)
    assert [r.doc_id for r in twice.collect()] == [BIG]
    masked = corpus_pipeline.mask_secrets(spark, df, path)
    assert masked.columns == df.columns and masked.count() == df.count()
    mixed = corpus_pipeline.mix_sources(spark, df, path)
    assert mixed.columns == df.columns and 0 < mixed.count() < df.count()
    ids = corpus_pipeline.encode(spark, df, path)
    assert ids.count() == df.count() and ids.filter("not lossless").count() == 0


def test_empty_tables_pass_through(spark, table):
    df, path, *_ = table
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, df.limit(0), path).count() == 0


def test_run_chains_the_stages(spark, table):
    df, path, *_ = table
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_pieces", "ids", "lossless"] and 0 < out.count() < df.count()
