"""Tables that several steps read are made once, and documents of many jobs share a file."""

import os

import pytest

from eventide.operators import graph
from eventide.plans import object_queries, reader_queries, review_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_documents_share_files(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(reader_queries, "work_path", lambda s, name, make=reader_queries.work_path: paths.append(make(s, name)) or paths[-1])
    got = reader_queries.q_event_documents(spark, SF)
    assert got.select("job").distinct().count() > 4
    found = os.listdir(paths[0].removeprefix("file://"))
    assert not [x for x in found if x.startswith("job=")] and sum(x.startswith("part-") for x in found) <= 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_links_and_groups_read_stored_tables(spark, monkeypatch):
    made = []
    for module in (graph, review_queries):
        monkeypatch.setattr(module, "stored", lambda df, name, keep=graph.stored: made.append(name) or keep(df, name), raising=False)
    plan = review_queries.q_evidence_graph(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert {"evidence-events", "evidence-seen", "evidence-links"} <= set(made)
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_detectors_read_stored_boxes(spark):
    plan = object_queries.q_findings_union(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
