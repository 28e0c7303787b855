import random

import pytest

from lineweave.plans import review_queue
from lineweave.plans.policies import policy_named
from lineweave.sources import selection


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_budget_by_root(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None, *(f"r{i}" for i in range(40))]), f"p{i:04d}", rng.choice([0, 1, 10, 100])) for i in range(600)]
    kept = set()
    for root in {r[0] for r in rows}:
        total, count = 0, 0
        for _, path, size in sorted((r for r in rows if r[0] == root), key=lambda r: r[1]):
            if count >= 50 or total >= 900 or total + size > 900:
                break
            kept.add(path)
            total, count = total + size, count + 1
    rng.shuffle(rows)
    out = selection.budget_prefix(spark.createDataFrame(rows, "root string, path string, size bigint"), 50, 900, partitions=partitions, root="root")
    got = out.collect()
    assert {r["path"] for r in got if r["within_budget"]} == kept and len(got) == len(rows)
    assert out.columns == ["root", "path", "size", "nth", "bytes_before", "within_budget"]


def body(text):
    import json
    return json.dumps({"choices": [{"message": {"content": text}}]})


@pytest.mark.parametrize("budget", [0, 1, 7, 1000])
def test_failures_leave_the_budget(spark, budget):
    rng = random.Random(budget)
    files = [f"f{i:03d}" for i in range(120)]
    answers = {f: rng.choice(["{}", "", "{broken", "x {\"findings\": []}", None]) for f in files}
    queue = spark.createDataFrame([(f,) for f in files], "path string")
    responses = spark.createDataFrame([(f, body(t)) for f, t in answers.items() if t is not None], "path string, body string")
    got = {r["path"]: (r["place"], r["outcome"], r["used_before"], r["attempted"]) for r in review_queue.by_outcome(queue, responses, budget).collect()}
    used = 0
    for n, f in enumerate(files, 1):
        outcome = "pending" if answers[f] is None else "failed" if answers[f] == "{broken" else "done"
        assert got[f] == (n, outcome, used, used < budget), f
        used += outcome != "failed"


def test_findings_over_the_limit_are_told(spark):
    import json
    many = json.dumps({"findings": [{"rule": f"r{i}", "severity": "HIGH "} for i in range(503)]})
    responses = spark.createDataFrame([("a", body(many)), ("b", body("{no")), ("c", None)], "path string, body string")
    found, said = review_queue.review_findings(responses, policy_named("security"))
    rows = found.collect()
    assert len(rows) == 503 and {(r["severity"], r["source"], r["origin"]) for r in rows} == {("high", "ollama:a", "external")}
    assert sorted((r["path"], r["message"]) for r in said.collect()) == [
        ("a", "ai provider security: 3 findings over the limit"), ("b", "ai provider security: decode provider findings payload")]
