"""The pipeline's stages against what their operators say of single texts."""

import pytest

import corpus_pipeline
from corpuscope.llm import decontam, quality_crf, secrets, simhash
from corpuscope.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test")
        out.append(docs)
    return out


def test_stages_decide_as_their_operators(spark, sf_dir, steps):
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:5]]
    assert all(s.columns == steps[0].columns for s in steps[:5])
    assert len(rows[0]) > len(rows[1]) > len(rows[2]) > len(rows[3]) == len(rows[4]) > 0
    field = quality_crf.fit(steps[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert set(rows[1]) == {i for i, r in rows[0].items() if not quality_crf.base_failed(quality_crf.rules(r.text)) and quality_crf.content_share(field, r.text) >= 0.5}
    fps = {i: simhash.fingerprint(r.text) for i, r in rows[1].items()}
    assert all((fps[a] ^ fps[b]).bit_count() > 2 for a in rows[2] for b in rows[2] if a < b)
    assert all(any((fps[i] ^ fps[k]).bit_count() <= 2 for k in fps if k != i) for i in set(rows[1]) - set(rows[2]))
    m = decontam.Matcher(tuple({decontam.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}), decontam.RATE)
    assert set(rows[3]) == {i for i, r in rows[2].items() if not m.find(decontam.normal(r.text))}
    for i, r in rows[4].items():
        before = rows[3][i]
        assert (r.text == before.text) == (secrets.MASK not in r.text or secrets.MASK in before.text) and r.n_chars == (before.n_chars if r.text == before.text else len(r.text))


def test_last_stage_packs_all(steps):
    packed = steps[5].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in steps[4].collect()}


def test_odd_rows_pass_each_stage(spark, sf_dir):
    rows = [(None, None, None, None, None, 1), (1, "", "en", None, 0, 2), (2, "words and words " * 80, None, "s", 5, 3), (2, "words and words " * 80, None, "s", 5, 3), (3, "x " * 30000, "en", "s", 6, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key int")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).collect()
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert stored(corpus_pipeline.near_dedup(spark, docs, sf_dir), "odd").count() == 3
