"""The pipeline's stages and the registered SQL on the smallest tables."""

import collections
import glob

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from sparktab.llm import blocks
from sparktab.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = QUERIES[name](spark, SF)
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(map(repr, rel.fetchall())) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = blocks.staged(stage(spark, docs, SF), name)
        after = {r.doc_id for r in docs.collect()}
        assert after <= set(before) and len(after) == docs.count()
        if name == "exact_dedup":
            best = collections.defaultdict(list)
            for i, t in before.items():
                best[t].append(i)
            assert after == {max(ids) for ids in best.values()}
        if name == "encoding":
            assert after == set(before) and docs.where("not round_trip").count() == 0
        else:
            assert docs.schema == schema
            before = {i: t for i, t in before.items() if i in after}
