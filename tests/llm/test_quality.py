import pytest

from loanweave.llm import quality
from tests.compare import connect
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    """Fitted on half of the labels, right on nearly all of the others."""
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = {r.doc_id: r.keep for r in quality.score(documents, labels, train_rows=150).collect()}
    truth = connect(SF).sql("SELECT doc_id, quality FROM labels").fetchall()
    assert len(found) == documents.count()
    assert sum(found[d] == bool(q) for d, q in truth) / len(truth) > 0.97


def test_sparse_sites_are_shrunk_and_large_ones_are_not(spark):
    rows = [(i, cases.prose(i, 40), "en", "good", None) for i in range(60)]
    rows += [(100 + i, "### $$$ %%% &&& " * 10, "en", "bad", None) for i in range(60)]
    rows += [(300, "### $$$ %%% &&& " * 10, "en", "one", None), (301, cases.prose(7), "en", "one", None)]
    labels = cases.labels(spark, [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)])
    found = {r.doc_id: r for r in quality.score(cases.documents(spark, rows), labels).collect()}
    assert found[1].host_posterior > 0.9 and found[101].host_posterior < 0.1
    overall = 0.5
    assert abs(found[301].host_posterior - overall) < abs(found[101].host_posterior - overall)
    assert found[1].keep and not found[101].keep


@pytest.mark.parametrize("wide", [False, True])
def test_odd_rows(spark, wide):
    frame = cases.with_clashes(cases.documents(spark)) if wide else cases.documents(spark)
    rows = quality.score(frame, cases.labels(spark)).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r.evidence <= 1 and r.keep is not None for r in rows)
    kept = quality.accepted(frame, cases.labels(spark))
    assert kept.columns == frame.columns and kept.count() <= len(cases.ROWS)


def test_no_labels_and_no_rows(spark):
    none = cases.labels(spark, [(None, None, None)])
    assert len(quality.score(cases.documents(spark), none).collect()) == len(cases.ROWS)
    assert quality.score(cases.empty(spark), cases.labels(spark)).collect() == []
    assert quality.accepted(cases.empty(spark), none).collect() == []


def test_sparse_paths_of_a_real_hierarchy_lean_on_their_host(spark):
    """Paths are sections of hosts; one of a single document is near its host, a large one is not."""
    good, bad = cases.prose, "### $$$ %%% &&& " * 10
    rows = [(i, good(i, 40), "/news", "a.org", None) for i in range(60)]
    rows += [(100 + i, bad, "/spam", "a.org", None) for i in range(30)]
    rows += [(200 + i, bad, "/news", "b.org", None) for i in range(60)]
    rows += [(300, None, "/new", "a.org", None), (301, None, "/new", "b.org", None)]
    rows += [(400 + i, good(i, 40), f"/deep/{i // 2}", "a.org", None) for i in range(10)]
    frame = cases.documents(spark, rows).withColumnsRenamed({"source": "domain", "lang": "section"})
    labels = cases.labels(spark, [(i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(40)])
    found = {r.doc_id: r for r in quality.score(frame, labels, host="domain", path="section").collect()}
    assert len(found) == len(rows)
    assert found[1].path_posterior > 0.9 and found[101].path_posterior < 0.1  # sections of one host
    assert abs(found[1].host_posterior - found[101].host_posterior) < 0.02  # each without its own row
    assert found[201].path_posterior < 0.1  # the same path of another host
    assert abs(found[300].path_posterior - found[300].host_posterior) < 1e-9  # a path without evidence
    assert found[300].host_posterior > found[301].host_posterior
    large, sparse = found[1], found[400]
    assert sparse.host_posterior < sparse.path_posterior < large.path_posterior
