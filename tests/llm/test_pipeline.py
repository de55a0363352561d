"""The pipeline on a small table against brute force, and all queries on the smallest scale."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from codequarry.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_pipeline_on_a_fixture(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "to", "in", "is"] * 20 + [f"word{i}" for i in range(300)]
    text = lambda n=120: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    passage = text(50)
    rows = [(i, text()) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + "\n"), (102, text().upper().replace(" ", "!! ")), (103, " ".join(["noise"] * 200)), (104, text() + " " + passage), (105, text() + " write to a@b.cd"), (106, None), (107, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(60), 105, 106}
    assert out[105].text.endswith(" write to [EMAIL]") and out[105].n_chars == len(out[105].text)
    assert all(r.n_tokens == len(r.token_ids) for r in out.values()) and out[106].text is None


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.count() > 0


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, __spans string, score double, token_ids string, k int"
    odd = [(1, None, None, None, None, "x", 1.0, "t", 5), (1, None, None, None, None, "x", 1.0, "t", 5), (None, "", "en", "s", 0, None, None, None, None), (2, "tie " * 30, "en", "s", 120, "x", 1.0, "t", 5), (3, "tie " * 30, "en", "s", 120, "x", 1.0, "t", 5), (4, "w" * 5000, "en", "s", 5000, "x", 1.0, "t", 5)]
    docs = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert out.count() <= len(odd), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and none.columns == docs.columns, name
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == [1, 2, 4]  # texts without words are copies of one another, as are the ties
