"""The registered queries against their SQL, and the pipeline against its parts."""

import re

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from pricelens import llm
from pricelens.sources.tables import TABLES, load, table_path
from tests.conftest import SMALL
from tests.test_oracle import _rows
from . import data
from .test_decontaminate import brute as brute_window
from .test_near_dedup import brute_components, brute_print


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SMALL, t)}')")
    return c


def test_a_query_for_each_operator():
    names = [n for n in E.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(int(re.search(r"\d+", n)[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_query_matches_sql(spark, con, name):
    got = E.queries()[name](spark, SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.to_dict("records")) == _rows(want.columns, want.to_dict("records"))


def test_pipeline_stages_equal_brute_force(spark):
    docs = load(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SMALL)
    texts = {r.doc_id: r.text for r in good.collect()}
    one, first = {}, set()
    for d in sorted(texts):
        n = re.sub(r"[\x20\x09-\x0D]+", " ", texts[d])
        if n not in first:
            first.add(n)
            one[d] = texts[d]
    exact = stages["exact dedup"](spark, good, SMALL)
    assert {r.doc_id: r.text for r in exact.collect()} == one
    prints = [(d, brute_print(t)) for d, t in one.items()]
    comp = brute_components(prints)
    near = stages["simhash near-dedup"](spark, exact, SMALL)
    left = {d for d, f in prints if comp[f] == d}
    assert {r.doc_id for r in near.collect()} == left
    items = [(r.item_id, r.text) for r in load(spark, SMALL, "benchmark").collect()]
    clean = stages["benchmark decontamination"](spark, near, SMALL)
    want = {d for d in left if not brute_window(one[d], items)[-1]}
    assert {r.doc_id for r in clean.collect()} == want
    assert good.columns == exact.columns == near.columns == clean.columns == docs.columns
    out = E.queries()["pipeline"](spark, SMALL)
    assert {r.doc_id for r in out.collect()} == want


def test_pipeline_edges(spark, tmp_path):
    bench = load(spark, SMALL, "benchmark")
    for name, docs in (("some", data.frame(spark)), ("none", data.empty(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        rows = E.queries()["pipeline"](spark, str(tmp_path / name)).collect()
        assert (len(rows) == 0) == (name == "none")
