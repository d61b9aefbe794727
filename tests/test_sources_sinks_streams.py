"""File sources and sinks, and the streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from ladingcheck.operators import audit, runs
from ladingcheck.plans import queries, verify
from ladingcheck.sources import inbox, sinks
from ladingcheck.streaming.inbox_stream import stream_inbox
from ladingcheck.streaming.state import stream_case_state, stream_rate_limit
from tests.test_verify import SI, bl


@pytest.fixture()
def bundle(tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "attachments").mkdir()
    for i, body in enumerate(["Please compare the SI and draft BL.", "You have won a prize", "Lunch?"]):
        record = {"email_id": f"email_{i}", "from": "a@b.test", "subject": "S", "body": body,
                  "attachments": ["attachments/s.txt", "attachments/b.txt"] if i == 0 else []}
        (tmp_path / "inbox" / f"email_{i}.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "inbox" / "email_9.json").write_text(json.dumps({"email_id": "other", "from": "", "subject": "", "body": ""}))
    (tmp_path / "inbox" / "email_8.json").write_text("{ not json")
    (tmp_path / "attachments" / "s.txt").write_text(SI)
    (tmp_path / "attachments" / "b.txt").write_bytes(bl().replace("\n", "\r\n").encode())
    return str(tmp_path)


def test_inbox_files_to_assessment(spark, bundle):
    good, bad = inbox.validate_emails(inbox.read_inbox(spark, bundle))
    assert {r.file_stem: r.problem for r in bad.collect()} == {
        "email_8": "UNREADABLE_JSON", "email_9": "IDENTITY_MISMATCH"}
    mails = good.withColumns({"run_kind": F.lit("EVAL"), "registry": F.lit("participant")})
    files = inbox.read_files(spark, bundle, "participant")
    out = {r.case_id: r.status for r in verify.verify(mails, files).select("case_id", "assessment.status").collect()}
    assert out == {"email_0": "OK", "email_1": "OK", "email_2": "OK"}


def test_mail_stream_adds_each_id_once(spark, bundle, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")
    for _ in range(2):
        stream_inbox(spark, bundle, table, checkpoint).awaitTermination(120)
    stream_inbox(spark, bundle, table, str(tmp_path / "cp2")).awaitTermination(120)
    assert [r.email_id for r in spark.read.parquet(table).select("email_id").orderBy("email_id").collect()] == ["email_0"]
    refused = spark.read.parquet(table + "_refused")
    assert {(r.file_stem, r.problem) for r in refused.collect()} == {("email_8", "UNREADABLE_JSON"), ("email_9", "IDENTITY_MISMATCH")}


def test_stream_rate_limit_survives_valid_attempts_only(spark, tmp_path):
    src = str(tmp_path / "valid")
    attempts = spark.createDataFrame([("a", f"x{i}", 1000 * i, False) for i in range(3)] + [("b", "y", 5, True)],
                                     "actor string, attempt_id string, at_ms long, invalid boolean")
    attempts.coalesce(1).write.parquet(src)
    rows = {}
    q = stream_rate_limit(spark.readStream.schema(attempts.schema).parquet(src)).writeStream.outputMode("append").foreachBatch(
        lambda b, _: rows.update({r.attempt_id: r.limited for r in b.collect()})).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert rows == {"x0": False, "x1": False, "x2": False, "y": False}


def test_attachments_below_a_folder_of_that_name(spark, tmp_path):
    root = tmp_path / "attachments" / "in"
    (root / "attachments").mkdir(parents=True)
    (root / "attachments" / "late.txt").write_bytes(b"a" * 5000 + b"\x00")
    files = inbox.read_files(spark, str(root), "participant")
    row = files.select("path", inbox.detect_format(F.col("content"), F.lit(True)).alias("kind")).collect()
    assert [tuple(r) for r in row] == [("attachments/late.txt", "unsupported")]


def test_ids_of_long_keys_stay_whole(spark, sf_dir, tmp_path):
    from ladingcheck.plans import shipments

    for name in ("region", "nation", "customer", "supplier"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet").filter(F.col(key) < 20)
        table.withColumn(key, F.col(key) + 1_234_567_890).write.parquet(str(tmp_path / f"{name}.parquet"))
    ids = [r.email_id for r in shipments.facts(spark, str(tmp_path)).select("email_id").collect()]
    assert len(set(ids)) == len(ids) > 0 and all(i.startswith("email_12345") and len(i) == 16 for i in ids)


def test_stream_states_equal_batch(spark, tmp_path, sf_dir):
    events = queries.event_log(spark, sf_dir).withColumn("part", F.ntile(3).over(
        __import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("at", "event_id")))
    src = str(tmp_path / "events")
    for part in (1, 2, 3):
        events.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(src)
    latest = {}

    def keep(batch, _):
        latest.update({r.case_id: (r.run_id, r.status) for r in batch.collect()})

    q = stream_case_state(stream).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    batch = {r.case_id: (r.run_id, r.status) for r in runs.case_state(events.drop("part")).collect()}
    # In a stream a later run start makes earlier events of that run stale, as they came before it.
    assert set(latest) == set(batch)
    assert all(latest[c][0] == batch[c][0] for c in batch)


def test_stream_rate_limit_equals_batch(spark, tmp_path, sf_dir):
    attempts = queries._attempts(spark, sf_dir)
    src = str(tmp_path / "attempts")
    attempts.orderBy("at_ms").coalesce(1).write.parquet(src)
    rows = {}
    stream = spark.readStream.schema(attempts.schema).parquet(src)
    q = stream_rate_limit(stream).writeStream.outputMode("append").foreachBatch(
        lambda b, _: rows.update({r.attempt_id: r.limited for r in b.collect()})).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert rows == {r.attempt_id: r.limited for r in runs.invalid_rate_limit(attempts).collect()}


def test_submission_and_report_files(spark, sf_dir, tmp_path):
    c = queries.cases(spark, sf_dir).filter("run_kind = 'EVAL'")
    sinks.write_submission_object(c, str(tmp_path / "sub"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "sub").glob("part-*")))
    submission = json.loads(text)
    assert list(submission) == sorted(submission) and len(submission) == c.count()
    sinks.write_report_csv(c, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert len(back.columns) == 22 and back.count() == sinks.report_rows(c).count()
    assert sinks.payload_digest(c).collect() == sinks.payload_digest(c.repartition(5)).collect()


def test_digest_folds_ids_of_any_kind_to_one_group(spark):
    """Ids without a dense counter at the end; counters give the same as the plain levels."""
    import hashlib
    import uuid

    ids = [str(uuid.UUID(hashlib.md5(str(i).encode()).hexdigest())) for i in range(600)] + [f"<m{i}@host{i % 7}.example>" for i in range(60)] + ["", "z"]
    rows = [(i, 1, hashlib.sha256(i.encode()).hexdigest()) for i in ids]
    hashed = lambda: spark.createDataFrame(rows, "id string, n long, h string")
    longest = max(map(len, ids))
    left = sinks._groups(hashed(), 3, longest).collect()
    assert [(r["id"], r["n"]) for r in left] == [("", len(ids))]
    assert left == sinks._groups(hashed().repartition(5), 3, longest).collect()
    now = {i: h for i, _, h in rows}
    for level in range(-(-longest // 3)):
        groups = {}
        for i in sorted(now):
            groups.setdefault(i[:max(0, len(i) - 3)], []).append(now[i])
        now = {i: hs[0] if level >= 3 and len(hs) == 1 else hashlib.sha256("".join(hs).encode()).hexdigest() for i, hs in groups.items()}
    assert left[0]["h"] == now[""]
    rows = [(f"case_{i:08d}", 1, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(50)]
    assert [r["h"] for r in sinks._groups(hashed(), 3, 13).collect()] == [r["h"] for r in sinks._groups(hashed(), 3, 0).collect()]


def test_export_gate_fails_closed(spark, sf_dir):
    c = queries.cases(spark, sf_dir)
    assert audit.export_gate(c).filter("run_kind != 'EVAL'").count() == 0
    with pytest.raises(audit.ExportRefused):
        audit.export_gate(c, required=spark.createDataFrame([("nobody",)], "case_id string"))


def test_no_rule_is_broken(spark, sf_dir):
    from ladingcheck.plans.cases import comparison_rows

    c = queries.cases(spark, sf_dir)
    assert audit.audit_cases(c).count() == 0
    assert audit.audit_assessments(c).count() == 0
    assert audit.audit_comparisons(comparison_rows(c)).count() == 0
