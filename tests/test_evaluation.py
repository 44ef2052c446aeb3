import pytest
from pyspark.sql import functions as F

from evidentia.operators import evaluation as V
from evidentia.sources.store import Catalog


def keyed(spark, rows):
    return spark.createDataFrame([(k, float(v)) for k, v in rows.items()], V.METRICS)


def test_statuses(spark):
    old = keyed(spark, {"p.all.recall": 0.5, "p.all.gap": 0.5, "p.all.n": 100, "p.few.recall": 0.5, "p.few.n": 4, "recall": 0.5, "n": 2, "p.all.gone": 1})
    new = keyed(spark, {"p.all.recall": 0.4, "p.all.gap": 0.4, "p.all.n": 90, "p.few.recall": 0.3, "p.few.n": 4, "recall": 1.0, "n": 3, "p.all.new": 1})
    got = {r.key: r.status for r in V.compare(new, old).collect()}
    # a drop of gaps is good; one case of four may be chance; two and more cases of three never are
    assert got == {"p.all.recall": "regressed", "p.all.gap": "improved", "p.all.n": "info", "p.few.recall": "ok", "p.few.n": "info", "recall": "improved", "n": "info"}
    got = {r.key: r.status for r in V.compare(new, old, gated=F.col("key").startswith("p.few")).collect()}
    assert set(got.values()) == {"info", "ok"}


def test_flatten_and_leave_one_out(spark):
    m = spark.createDataFrame([("full", "all", 0.8, 0.5, 10), ("-graph", "all", 0.7, 0.55, 10), ("full", "x", 0.2, None, 3)], "step string, type string, recall double, mrr double, n long")
    flat = {r.key: r.value for r in V.flatten(m, ["step", "type"], ["recall", "mrr", "n"]).collect()}
    assert flat["-graph.all.recall"] == 0.7 and flat["full.all.n"] == 10 and "full.x.mrr" not in flat
    rows = {(r.step, r.type): (r.recall_gain, r.mrr_gain) for r in V.leave_one_out(m).collect()}
    assert rows == {("full", "all"): (None, None), ("full", "x"): (None, None), ("-graph", "all"): (0.1, -0.05)}


def test_baselines_hold_their_conditions(spark, tmp_path):
    kept = V.Baselines(Catalog(spark, f"file://{tmp_path}"))
    one, under = keyed(spark, {"a.recall": 0.5}), {"k": 6, "model": None}
    with pytest.raises(ValueError, match="no baseline"):
        kept.compare("repo", "retrieval", one, under)
    with pytest.raises(LookupError):
        kept.promote("repo", "retrieval")
    kept.record("repo", "retrieval", one, under, "abc")
    kept.promote("repo", "retrieval")
    kept.record("repo", "retrieval", keyed(spark, {"a.recall": 0.9}), under)  # a later run leaves the baseline as it is
    assert kept.compare("repo", "retrieval", one, {"k": 6}).first().status == "ok"  # none equals missing
    with pytest.raises(ValueError, match="k: baseline=6 current=8"):
        kept.compare("repo", "retrieval", one, {"k": 8})
    assert kept.catalog.head("baseline-repo-retrieval")[1]["revision"] == "abc"


def test_digest_of_cases(spark):
    schema = "type string, text string, expect array<string>"
    a = [("p", "x", ["b", "a"]), ("q", "y", None), (None, None, [])]
    d = V.case_digest(spark.createDataFrame(a, schema))
    assert V.case_digest(spark.createDataFrame([a[2], ("p", "x", ["a", "b"]), a[1]], schema)) == d
    assert V.case_digest(spark.createDataFrame([*a, a[0]], schema)) != d
    assert V.case_digest(spark.createDataFrame([], schema)) == "0:0"
