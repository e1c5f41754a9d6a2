"""A folder of filing documents, good, empty and broken."""

from __future__ import annotations

import json

import pytest

from tidemark.plans import registry
from tidemark.sources.adapters import Inputs
from tidemark.sources import filing_folder as ff
from tidemark.sources.concepts import concept_map


@pytest.fixture
def folder(tmp_path):
    def doc(cik, name, tags):
        return json.dumps({"cik": cik, "entityName": name, "facts": {"us-gaap": tags}}, indent=1)

    entry = {"end": "2023-12-31", "val": 5, "accn": "a", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01", "frame": "CY2023"}
    flow = {**entry, "start": "2023-01-01", "val": 7.5}
    files = {
        "a.json": doc(1, "One", {"Revenues": {"label": "r", "units": {"USD": [flow, {**flow, "val": None}]}}, "Odd": {"units": {"USD": [entry, entry]}}}),
        "b.json": doc("0000000002", "Two", {"Assets": {"units": {"USD": [entry], "EUR": []}}}),
        "c.json": '{"cik": 3, "entityName": "Three", "facts"',
        "d.json": "",
        "e.json": json.dumps({"cik": 5, "entityName": "Five"}),
        "f.json": json.dumps({"entityName": "No number", "facts": {}}),
        "g.json": doc(7, "Seven", {"Odd": {"units": {"USD": [entry]}}}),
        "h.json": doc(1, "One again", {}),
        "notes.txt": "not looked at",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def status(found):
    return sorted((r.file.rsplit("/", 1)[1], r.cik, r.n_facts, r.status, r.message) for r in found.log().collect())


def test_one_pass_over_a_folder(spark, folder):
    found = ff.scan(spark, folder, concept_map(spark))
    got = sorted((r.cik, r.concept, str(r.period_start), r.val, r.form, r.frame) for r in found.facts().collect())
    assert got == [(1, "Revenues", "2023-01-01", 7.5, "10-K", "CY2023"), (2, "Assets", "None", 5.0, "10-K", "CY2023")]
    assert sorted((r.cik, r.concept, r.n_facts) for r in found.census().collect()) == [(1, "Odd", 2), (1, "Revenues", 2), (2, "Assets", 1), (7, "Odd", 1)]
    assert sorted(map(tuple, found.companies().collect())) == [(1, "One again"), (2, "Two"), (5, "Five"), (7, "Seven")]
    assert status(found) == [("a.json", 1, 1, "ok", None), ("b.json", 2, 1, "ok", None), ("c.json", None, 0, "error", "not a filing document"), ("d.json", None, 0, "error", "no document"), ("e.json", 5, 0, "empty", None),
                             ("f.json", None, 0, "error", "no company number"), ("g.json", 7, 0, "empty", None), ("h.json", 1, 0, "empty", None)]
    assert ff.scan(spark, folder).facts().count() == 5  # every tag


def test_the_first_files_by_name(spark, folder):
    found = ff.scan(spark, folder, concept_map(spark), first=3)
    assert [s[0] for s in status(found)] == ["a.json", "b.json", "c.json"] and found.facts().count() == 2
    assert ff.scan(spark, folder, first=0).log().count() == 0


def test_the_registered_folder_queries_read_every_company():
    from tidemark.plans.registry import oracle_sql

    assert "% 10" not in oracle_sql()["ingest_companyfacts"].rsplit("SELECT", 1)[1] and "% 10" not in oracle_sql()["census_of_docs"].rsplit("SELECT", 1)[1]


def test_whole_documents_of_all_companies_are_landed(spark):
    from tidemark.plans.registry import queries
    from tidemark.sources.adapters import Inputs

    sf = "/root/testdata/sf0.001"
    q, facts = queries(), Inputs(spark, sf).facts
    assert q["ingest_companyfacts"](spark, sf).count() == facts.count()
    assert q["census_of_docs"](spark, sf).select("cik").distinct().count() == facts.select("cik").distinct().count()


def test_documents_are_made_with_one_shuffle_by_company(spark):
    d = registry._documents(Inputs(spark, "/root/testdata/sf0.001"), False)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert d.count() == d.select("company").distinct().count() > 0
