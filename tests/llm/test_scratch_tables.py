"""What the pair operators write between their steps."""

from __future__ import annotations

import corpus_pipeline
from martforge.llm import decontaminate, jaccard_join
from martforge.session import CLEANUP_CONF

from ..conftest import SF_SMALL


def test_full_sets_are_not_written(make_docs, prose, monkeypatch):
    """They are shuffled to their pairs; a table beside that is the same bytes again."""
    base, written = prose(200, 12000), []
    rows = [(k, base.replace(base.split()[10 * k + 5], f"edited{k}", 1)) for k in range(6)] + [(9, prose(200, 12001))]
    plain = jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, *a: (written.append(df.columns), plain(df, *a))[1])
    got = {r.doc_id: r.component_id for r in jaccard_join.join(make_docs(rows), share=80, n=5).collect()}
    assert got == {**{k: 0 for k in range(6)}, 9: 9}
    assert written and not any("elements" in c for c in written)


def test_each_stage_alone_removes_its_shuffle_files(spark):
    """Whoever calls a stage gets the settings that ``run`` applies."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for key in CLEANUP_CONF:
            spark.conf.set(key, "false")
        stage(spark, docs, SF_SMALL)
        assert {k: spark.conf.get(k) for k in CLEANUP_CONF} == CLEANUP_CONF, name


def test_texts_are_not_shuffled_to_drop_some(make_docs, prose, monkeypatch):
    """Whatever size the planner guesses for the list of those that go."""
    passage = prose(40, 12100)
    docs = make_docs([(k, f"{prose(30, 12101 + k)} {passage if k % 2 else ''}") for k in range(8)] + [(8, prose(30, 12101)), (None, passage)])
    spark, key = docs.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    items = spark.createDataFrame([("a", passage)], "item_id string, text string")
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        clean, first = decontaminate.clean(docs, items), jaccard_join.keep_first(docs, 80, 5)
        for kept, want in ((clean, [0, 2, 4, 6, 8]), (first, [None, *range(8)])):
            assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
            assert sorted((r.doc_id for r in kept.collect()), key=lambda i: -1 if i is None else i) == want
    finally:
        spark.conf.set(key, before)
