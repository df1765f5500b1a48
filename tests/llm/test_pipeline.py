"""The pipeline against plain code on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from martforge.llm import queries

from ..conftest import SF_SMALL
from .plain import decontaminated, jaccard_components, token_rows


def test_pipeline_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").toPandas()
    good = {r.doc_id for r in queries.REGISTRY["op1_quality_gam"](spark, SF_SMALL).collect() if r.predicted}
    docs = docs[docs.doc_id.isin(good)]
    groups = jaccard_components(list(zip(docs.doc_id, docs.text)), 80, 5)
    docs = docs[[groups[i][1] == i for i in docs.doc_id]]
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_SMALL}/benchmark.parquet'").fetchall()
    docs = docs[[decontaminated(t, items)[1] == 0 for t in docs.text]]
    con = duckdb.connect()
    con.register("documents", docs)
    kept = {r[0] for r in con.sql(queries.ORACLES["op6_mixing"]).project("doc_id, kept").fetchall() if r[1]}
    docs = docs[docs.doc_id.isin(kept)]
    encode = Tokenizer.from_file(queries.VOCABULARY)
    want = token_rows(list(zip(docs.doc_id, docs.text)), lambda t: encode.encode(t, add_special_tokens=False).ids)
    got = sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, SF_SMALL).collect())
    assert got == want and len(got) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF_SMALL)
        assert out.columns == docs.columns and out.count() == 0, name
    assert isinstance(docs.limit(0).toPandas(), pd.DataFrame)
