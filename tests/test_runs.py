"""Event-log operators against brute force, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck.operators import classify, decisions, runs
from ladingcheck.operators.running import previous_value, running_counts


def skewed(n=3000):
    rng = random.Random(7)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 20)}", i, rng.random() < 0.6) for i in range(n)]


def test_running_counts_equal_brute_force(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k string, n long, flag boolean")
    got = {(r.k, r.n): r.before for r in running_counts(df, ["k"], "n", {"before": F.col("flag")}, span=100).collect()}
    seen = {}
    for k, n, flag in data:
        assert got[(k, n)] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + flag


def test_previous_value_crosses_empty_buckets(spark):
    data = [("a", t, t * 10) for t in (1, 5, 250, 251, 900)] + [("b", 7, 70)]
    df = spark.createDataFrame(data, "k string, t long, v long")
    got = {(r.k, r.t): r.p for r in previous_value(df, ["k"], ["t"], "v", "p", F.floor(F.col("t") / 100)).collect()}
    assert got == {("a", 1): None, ("a", 5): 10, ("a", 250): 50, ("a", 251): 2500, ("a", 900): 2510, ("b", 7): None}


def brute_limit(attempts):
    counted, out = {}, {}
    for actor, i, at, invalid in sorted(attempts, key=lambda a: (a[2], a[1])):
        c = counted[actor] = [t for t in counted.get(actor, []) if at - t < K.INVALID_WINDOW_MS]
        out[i] = len(c) >= K.INVALID_LIMIT
        if invalid and not out[i]:
            c.append(at)
    return out


def test_rate_limit_equals_brute_force(spark):
    rng = random.Random(3)
    attempts, at = [], 0
    for i in range(4000):
        at += rng.choice([500, 2000, 4000, 9000, 70_000]) if rng.random() < 0.3 else rng.randint(100, 6000)
        attempts.append(("hot" if rng.random() < 0.5 else f"a{rng.randint(0, 5)}", f"{i:06d}", at, rng.random() < 0.8))
    df = spark.createDataFrame(attempts, "actor string, attempt_id string, at_ms long, invalid boolean")
    got = {r.attempt_id: r.limited for r in runs.invalid_rate_limit(df).collect()}
    assert got == brute_limit(attempts)
    assert any(got.values()) and not all(got.values())


def test_rate_limit_of_a_flood_without_pause(spark):
    # Starts that never meet (one attempt a second), starts that do (random), equal times, ranges without a counted attempt.
    rng = random.Random(5)
    steady = [("steady", f"s{i:06d}", 1000 * i + 300, True) for i in range(4200)]
    at, mixed = 0, []
    for i in range(2500):
        at += rng.choice([0, 1500, 3000, 6500])
        mixed.append(("mixed", f"m{i:06d}", at, rng.random() < 0.7))
    tail = [("tail", f"t{i:02d}", 590_000 + 500 * i, True) for i in range(14)] + [
        ("tail", f"u{i:02d}", 600_500 + 7600 * i, False) for i in range(8)]
    attempts = steady + mixed + tail
    df = spark.createDataFrame(attempts, "actor string, attempt_id string, at_ms long, invalid boolean").repartition(7)
    got = {r.attempt_id: r.limited for r in runs.invalid_rate_limit(df).collect()}
    assert got == brute_limit(attempts)
    assert got["u00"] and not got["u07"]


def test_latest_run_is_determined_by_the_record(spark):
    rows = [("EVAL", "c", "r1", 5, q) for q in (3, 9, None, 1)] + [("EVAL", "d", "r2", None, 4), ("EVAL", "d", "r2", None, 4)]
    df = spark.createDataFrame(rows, "run_kind string, case_id string, run_id string, started_at long, quantity long")
    for layout in (df.repartition(4), df.coalesce(1).orderBy("quantity")):
        assert sorted((r.case_id, r.quantity) for r in runs.latest_run(layout).collect()) == [("c", 9), ("d", 4)]


def test_call_budget_and_first_decision(spark):
    calls = spark.createDataFrame([("r", i) for i in range(10)], "run_id string, call_no long")
    assert classify.call_budget(calls, 4, bucket_size=3).filter("allowed").count() == 4
    v = spark.createDataFrame(
        [("d1", "r", 5, None), ("d2", "r", 3, None), ("d3", "r", 1, "STALE_RUN"), ("d4", "s", 9, None)],
        "decision_id string, path_review_id string, at long, error_code string")
    assert {r.decision_id for r in decisions.first_accepted_wins(v).collect()} == {"d2", "d4"}


def test_job_outcomes(spark):
    log = [("a", 1, "STARTED"), ("a", 2, "FAILED"), ("b", 1, "FAILED"), ("b", 2, "FAILED"), ("c", 1, "STARTED"),
           ("c", 2, "DONE"), ("d", 1, "STARTED"), ("e", 1, "SUPERSEDED"), ("e", 2, "DONE")]
    df = spark.createDataFrame([(j, "c", "r", t, e) for j, t, e in log], "job_id string, case_id string, run_id string, at long, event string")
    assert {r.job_id: r.status for r in runs.job_outcomes(df).collect()} == {
        "a": "PENDING", "b": "FAILED", "c": "COMPLETED", "d": "PENDING", "e": "SUPERSEDED"}


def test_backlog_signature_ignores_order_and_repeats(spark):
    schema = "recipient string, key string, delivered boolean"
    one = spark.createDataFrame([("r", k, False) for k in "abcd"] + [("r", "z", True)], schema)
    two = spark.createDataFrame([("r", k, False) for k in "dcbaa"], schema)
    a, b = runs.backlog(one).collect()[0], runs.backlog(two).collect()[0]
    assert (a.waiting, a.digest, a.signature) == (4, True, b.signature)
