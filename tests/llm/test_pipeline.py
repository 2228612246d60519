import os

import pytest

import corpus_pipeline as cp
from tessera.llm import pieces, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not (os.path.exists(SMALL) and os.path.exists(pieces.MODEL)), reason="no test data here")
def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SMALL)
        if k + 1 < len(cp.STAGES):
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), out.schema)
            seen.append(docs.count())
        else:
            rows = out.collect()
            assert len(rows) == seen[-1] and all(r.round_trip for r in rows)
    assert seen[0] > seen[1] >= seen[2] == seen[3] >= seen[4] > 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(names)
