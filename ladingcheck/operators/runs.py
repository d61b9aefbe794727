"""Runs, jobs, notices and event logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladingcheck import constants as K
from ladingcheck import schema
from ladingcheck.operators.running import previous_value
from ladingcheck.storage import stored


def latest_run(runs: DataFrame) -> DataFrame:
    """The current run of each case: last started; ties go to the larger run_id, then to the larger record as a whole."""
    rest = [c for c in runs.columns if c not in schema.KEY]
    order = ["started_at", "run_id", *sorted(c for c in rest if c not in ("started_at", "run_id"))]
    return runs.groupBy(*schema.KEY).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*schema.KEY, "r.*")


def reprocess(runs: DataFrame, reviews: DataFrame, jobs: DataFrame, decisions: DataFrame
              ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews, jobs, decisions) once superseded runs are closed.

    Open reviews of old runs close as SUPERSEDED, their pending or running jobs too,
    and their decisions that were never applied are dropped.
    """
    current = latest_run(runs).select("run_id", F.lit(True).alias("_current"))

    def marked(df):
        return df.join(current, "run_id", "left").withColumn("_old", F.col("_current").isNull()).drop("_current")

    r = marked(reviews)
    closing = F.col("_old") & (F.col("status") == "OPEN")
    r = r.withColumns({
        "close_reason": F.when(closing, "SUPERSEDED").otherwise(F.col("close_reason")),
        "status": F.when(closing, "CLOSED").otherwise(F.col("status")),
    }).drop("_old")
    j = marked(jobs)
    j = j.withColumn("status", F.when(F.col("_old") & F.col("status").isin("PENDING", "RUNNING"), "SUPERSEDED")
                     .otherwise(F.col("status"))).drop("_old")
    d = marked(decisions).filter(~(F.col("_old") & F.col("applied_at").isNull())).drop("_old")
    return r, j, d


def run_guard(rows: DataFrame, runs: DataFrame, decision_id: str = "decision_id") -> DataFrame:
    """Rows of current runs only, each decision once."""
    return rows.join(latest_run(runs).select("run_id"), "run_id", "left_semi").dropDuplicates([decision_id])


def run_identity(runs: DataFrame, snapshots: DataFrame, config_version: str) -> DataFrame:
    """Runs with ``problem``: state never recorded, or input or configuration changed since."""
    now = snapshots.select(*schema.KEY, F.col("input_version").alias("input_now"))
    return runs.join(now, schema.KEY, "left").withColumn(
        "problem",
        F.when(~F.col("has_state"), "RUN_STATE_UNAVAILABLE")
        .when(F.col("input_now").isNotNull() & (F.col("input_version") != F.col("input_now")), "RUN_IDENTITY_CHANGED")
        .when(F.col("config_version") != config_version, "RUN_IDENTITY_CHANGED")).drop("input_now")


def job_outcomes(attempts: DataFrame) -> DataFrame:
    """Attempt log (job_id, case_id, run_id, at, event) to the state of each job.

    Events: STARTED, FAILED, DONE, SUPERSEDED. One retry; the second failure is
    final; a job left running goes back to PENDING.
    """
    event = F.col("event")
    per_job = attempts.groupBy("job_id").agg(
        F.any_value("case_id").alias("case_id"), F.any_value("run_id").alias("run_id"),
        F.count_if(event == "FAILED").alias("failures"),
        F.max_by("event", F.struct("at", "event")).alias("last_event"),
        F.bool_or(event == "SUPERSEDED").alias("superseded"),
        F.max("at").alias("updated_at"),
    )
    status = (
        F.when(F.col("superseded"), "SUPERSEDED")
        .when(F.col("failures") >= K.MAX_ATTEMPTS, "FAILED")
        .when(F.col("last_event") == "DONE", "COMPLETED").otherwise("PENDING")
    )
    return per_job.withColumn("status", status).drop("superseded")


def batch_create(requested: DataFrame, existing: DataFrame, known: DataFrame, caller: str) -> DataFrame:
    """Requested ids with what becomes of each: created, existing, skipped or concealed.

    An id asked for twice is created once and exists the second time.
    """
    ids = requested.select(F.trim("email_id").alias("email_id")).filter("email_id != ''")
    asked = ids.groupBy("email_id").agg(F.count("*").alias("asked"))
    have = existing.select(F.col("case_id").alias("email_id"), F.col("run_kind").alias("have_kind"))
    source = known.select("email_id").distinct().withColumn("has_source", F.lit(True))
    joined = asked.join(have, "email_id", "left").join(source, "email_id", "left")
    outcome = (
        F.when((F.col("have_kind") == "EVAL") & F.lit(caller != "EVAL"), "concealed")
        .when(F.col("have_kind").isNotNull(), "existing")
        .when(F.col("has_source"), "created").otherwise("skipped")
    )
    made = F.when(F.col("outcome") == "created", 1).otherwise(0)
    return joined.withColumn("outcome", outcome).withColumns({
        "created": made,
        "existing": F.when(F.col("outcome") == "existing", F.col("asked")).otherwise(
            F.when(F.col("outcome") == "created", F.col("asked") - 1).otherwise(0)),
    }).select("email_id", "asked", "outcome", "created", "existing")


def idempotent_create(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Only the ids that are not there yet, each once."""
    return new.dropDuplicates(schema.KEY).join(existing.select(*schema.KEY), schema.KEY, "left_anti")


_STATUS_OF_EVENT = {
    "CASE_CREATED": "PROCESSING",
    "CASE_REPROCESSED": "PROCESSING",
    "DECISION_RECEIVED": "PROCESSING",
    "REVIEW_CREATED": "AWAITING_HUMAN",
    "REVIEW_NOTIFIED": "AWAITING_HUMAN",
    "PROCESSING_FAILED": "FAILED",
    "CASE_COMPLETED": "COMPLETED",
}


def status_of_event(event: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in _STATUS_OF_EVENT.items() for x in p]), event)


def case_state(events: DataFrame) -> DataFrame:
    """Current state per case from the whole event log: events of the current run only.

    The current run is the run of the last CASE_CREATED or CASE_REPROCESSED event.
    """
    order = F.struct("at", "event_id")
    starts = events.filter(F.col("type").isin("CASE_CREATED", "CASE_REPROCESSED")).groupBy("case_id").agg(
        F.max_by("run_id", order).alias("run_id"))
    return (
        events.join(starts, ["case_id", "run_id"], "left_semi")
        .withColumn("status", status_of_event(F.col("type"))).filter("status is not null")
        .groupBy("case_id").agg(
            F.max_by("run_id", order).alias("run_id"), F.max_by("status", order).alias("status"),
            F.max("at").alias("at"))
    )


def timeline(events: DataFrame) -> DataFrame:
    """Events of a case in order, each with the seconds since the one before."""
    with_before = previous_value(events, ["case_id"], ["at", "event_id"], "at", "previous_at",
                                 F.date_trunc("hour", "at"))
    gap = (F.unix_micros("at") - F.unix_micros("previous_at")) / 1e6
    return with_before.withColumn("seconds_since", F.round(gap, 6))


def run_durations(events: DataFrame) -> DataFrame:
    """Seconds from CASE_CREATED to the last CASE_COMPLETED of each run."""
    per_run = events.groupBy("case_id", "run_id").agg(
        F.min(F.when(F.col("type") == "CASE_CREATED", F.col("at"))).alias("created_at"),
        F.max(F.when(F.col("type") == "CASE_COMPLETED", F.col("at"))).alias("completed_at"))
    return per_run.filter("created_at is not null and completed_at is not null").withColumn(
        "seconds", F.round((F.unix_micros("completed_at") - F.unix_micros("created_at")) / 1e6, 6))


# --- invalid attempts ----------------------------------------------------------------------


#: Width of a range of time that one fold reads, and the rounds in which ranges guess how they start.
RANGE_MS = 600_000
GUESSES = 2


def _counted(times: np.ndarray, before: list[int]) -> list[int]:
    """Positions of the invalid attempts that count, after those at `before`; jumps over what a full minute keeps out."""
    kept, taken, i = list(before), [], 0
    while i < len(times):
        if len(kept) >= K.INVALID_LIMIT and times[i] - kept[-K.INVALID_LIMIT] < K.INVALID_WINDOW_MS:
            i = int(np.searchsorted(times, kept[-K.INVALID_LIMIT] + K.INVALID_WINDOW_MS))
        else:
            kept.append(int(times[i]))
            taken.append(i)
            i += 1
    return taken


def _last_counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by range to one row per range: the counted times that the next range can still see (at most twelve)."""
    key, kept = None, []
    for frame in batches:
        done = []
        for own, rows in frame.groupby(["actor", "burst", "range"], sort=False):
            if own != key:
                if key is not None:
                    done.append((*key, kept))
                key, kept = own, [int(t) for t in rows["before"].iloc[0]]
            times = rows.loc[rows["invalid"], "at_ms"].to_numpy()
            kept = (kept + [int(times[i]) for i in _counted(times, kept)])[-K.INVALID_LIMIT:]
        yield pd.DataFrame(done, columns=["actor", "burst", "range", "after"])
    if key is not None:
        yield pd.DataFrame([(*key, kept)], columns=["actor", "burst", "range", "after"])


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by burst and range, of which only a burst's first range knows its start: every range's start in turn."""
    burst, last, kept = None, None, []
    for frame in batches:
        starts = []
        for (actor, begun, number), rows in frame.groupby(["actor", "burst", "range"], sort=False):
            if (actor, begun) != burst:
                burst, last, kept = (actor, begun), None, [int(t) for t in rows["before"].iloc[0]]
            if number != last:
                last = number
                starts.append((actor, begun, number, kept))
            times = rows.loc[rows["invalid"], "at_ms"].to_numpy()
            kept = (kept + [int(times[i]) for i in _counted(times, kept)])[-K.INVALID_LIMIT:]
        yield pd.DataFrame(starts, columns=["actor", "burst", "range", "before"])


def _limit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by range and time, each range with its start, with ``limited``; holds one batch."""
    key, kept = None, []
    for frame in batches:
        parts = []
        for own, rows in frame.groupby(["actor", "burst", "range"], sort=False):
            if own != key:
                key, kept = own, [int(t) for t in rows["before"].iloc[0]]
            at, invalid = rows["at_ms"].to_numpy(), rows["invalid"].to_numpy(dtype=bool)
            places = np.flatnonzero(invalid)
            taken = places[_counted(at[places], kept)].astype(int)
            counted = np.concatenate([np.array(kept, np.int64), at[taken]])
            # How many counted attempts stand before each row; the twelfth last of them decides.
            n = len(kept) + np.searchsorted(taken, np.arange(len(at)))
            far = np.clip(n - K.INVALID_LIMIT, 0, None)
            if len(counted):
                full = (n >= K.INVALID_LIMIT) & (at - counted[np.minimum(far, len(counted) - 1)] < K.INVALID_WINDOW_MS)
            else:
                full = np.zeros(len(at), bool)
            parts.append(rows.assign(limited=full))
            kept = [int(t) for t in counted[-K.INVALID_LIMIT:]]
        if parts:
            yield pd.concat(parts).drop(columns=["range", "before"])


_RANGE = ["actor", "burst", "range"]


def _range_starts(attempts: DataFrame) -> DataFrame:
    """(actor, burst, range, before) for attempts (actor, burst, range, at_ms, invalid): a speculative scan.

    Every range is folded from a guessed start, at first nothing; its end is the start of the next one. A range whose
    start was guessed wrong is folded again. Once no start changes all are right. In a flood the starts may never meet,
    so after GUESSES rounds what is open is walked in order instead, from each burst's first open range, batch by batch.
    """
    types = {f.name: f.dataType.simpleString() for f in attempts.schema.fields}
    head = ", ".join(f"`{c}` {types[c]}" for c in _RANGE)
    nothing = F.array().cast("array<bigint>")
    order = Window.partitionBy("actor", "burst").orderBy("range")

    def folded(rows: DataFrame) -> DataFrame:
        return rows.repartition(*_RANGE).sortWithinPartitions(*_RANGE, "at_ms").mapInPandas(_last_counted, f"{head}, after array<bigint>")

    def proposed(state: DataFrame) -> DataFrame:
        # What left the minute before the range begins is of no effect.
        live = F.filter(F.lag("after").over(order), lambda t: F.col("range") * RANGE_MS - t < K.INVALID_WINDOW_MS)
        return state.withColumn("start", F.coalesce(live, nothing))

    state = stored(folded(attempts.withColumn("before", nothing)).withColumn("before", nothing), "ranges")
    for _ in range(GUESSES):
        wrong = stored(proposed(state).filter("start <> before").select(*_RANGE, F.col("start").alias("before")), "starts")
        if wrong.isEmpty():
            return state.drop("after")
        again = folded(attempts.join(wrong, _RANGE)).join(wrong, _RANGE)
        state = stored(state.join(wrong, _RANGE, "left_anti").unionByName(again), "ranges")
    guessed = proposed(state).withColumn("_open", F.col("start") != F.col("before"))
    guessed = guessed.withColumn("_open", F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    open_ranges = stored(guessed.filter("_open").select(*_RANGE, F.col("start").alias("before")), "open")
    walked = attempts.join(open_ranges, _RANGE).repartition("actor", "burst").sortWithinPartitions(*_RANGE, "at_ms").mapInPandas(
        _chained, f"{head}, before array<bigint>")
    return state.drop("after").join(open_ranges, _RANGE, "left_anti").unionByName(walked)


def invalid_rate_limit(attempts: DataFrame) -> DataFrame:
    """attempts (actor, attempt_id, at_ms, invalid) with ``limited``.

    Only counted attempts of the last minute matter, so a pause of a minute without
    an invalid attempt clears the state: attempts are cut into bursts there. Pauses
    are found over ranges of time, so an actor with most of the log is spread over
    many tasks. Only bursts with enough invalid attempts are folded, each range of
    RANGE_MS in its own task from the start that `_range_starts` finds for it.
    """
    hour = F.floor(F.col("at_ms") / 3_600_000)
    staged = attempts.withColumn("_inv_at", F.when(F.col("invalid"), F.col("at_ms")))
    # Last invalid attempt before this one: inside the hour, else carried over.
    order = ["at_ms", "attempt_id"]
    inside = Window.partitionBy("actor", "_hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    hourly = staged.withColumn("_hour", hour)
    per_hour = hourly.groupBy("actor", "_hour").agg(F.max("_inv_at").alias("_last"))
    before = Window.partitionBy("actor").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_hour.select("actor", "_hour", F.max("_last").over(before).alias("_carried"))
    with_last = hourly.withColumn("_prev", F.max("_inv_at").over(inside)).join(carried, ["actor", "_hour"]) \
        .withColumn("_prev", F.coalesce("_prev", "_carried"))
    quiet = F.col("_prev").isNull() | (F.col("at_ms") - F.col("_prev") >= K.INVALID_WINDOW_MS)
    started = with_last.withColumn("_start", F.when(quiet, F.col("at_ms")))
    upto = Window.partitionBy("actor", "_hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = started.groupBy("actor", "_hour").agg(F.max("_start").alias("_last_start"))
    carried_start = starts.select("actor", "_hour", F.max("_last_start").over(before).alias("_carried_start"))
    burst = started.withColumn("_in", F.max("_start").over(upto)).join(carried_start, ["actor", "_hour"]) \
        .withColumn("burst", F.coalesce("_in", "_carried_start"))
    flat = burst.select(*attempts.columns, "burst")
    dense = flat.groupBy("actor", "burst").agg(
        (F.count_if("invalid") >= K.INVALID_LIMIT).alias("_dense")).filter("_dense")
    keys = ["actor", "burst"]
    calm = flat.join(dense, keys, "left_anti").withColumn("limited", F.lit(False))
    busy = stored(flat.join(dense, keys, "left_semi").withColumn("range", F.floor(F.col("at_ms") / RANGE_MS)), "attempts")
    starts = _range_starts(busy.select(*_RANGE, "at_ms", "invalid"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields) + ", limited boolean"
    folded = busy.join(starts, _RANGE).repartition(*_RANGE).sortWithinPartitions(*_RANGE, *order).mapInPandas(_limit_batches, out)
    return calm.unionByName(folded).drop("burst")


def invalid_burst(attempts: DataFrame) -> DataFrame:
    """Cheap monitoring form: invalid attempts in the minute before, limits ignored.

    Each attempt is counted in its own minute range and the next one, so ranges
    stand alone and no actor is sorted in one task.
    """
    width = K.INVALID_WINDOW_MS
    slot = F.floor(F.col("at_ms") / width)
    own = attempts.withColumn("_slot", slot).withColumn("_own", F.lit(True))
    echo = attempts.filter("invalid").withColumn("_slot", slot + 1).withColumn("_own", F.lit(False))
    last_minute = Window.partitionBy("actor", "_slot").orderBy("at_ms").rangeBetween(-(width - 1), -1)
    return (
        own.unionByName(echo)
        .withColumn("invalid_before", F.count_if("invalid").over(last_minute))
        .filter("_own").drop("_own", "_slot")
        .withColumn("burst", F.col("invalid_before") >= K.INVALID_LIMIT)
    )


# --- notices ----------------------------------------------------------------------------------


def mark_notified(reviews: DataFrame, notices: DataFrame, runs: DataFrame) -> DataFrame:
    """Reviews with notified_at set once: only while OPEN and on the current run."""
    first = notices.groupBy("review_id", "run_id").agg(F.min("at").alias("_at"))
    current = latest_run(runs).select("run_id", F.lit(True).alias("_current"))
    joined = reviews.join(first, ["review_id", "run_id"], "left").join(current, "run_id", "left")
    may = (F.col("status") == "OPEN") & F.col("_current")
    return joined.withColumn("notified_at", F.coalesce("notified_at", F.when(may, F.col("_at")))).drop("_at", "_current")


def backlog(notices: DataFrame) -> DataFrame:
    """Undelivered notices (recipient, key, delivered) per recipient.

    The signature does not depend on order: key hashes are summed, so it combines
    before the shuffle and no recipient's keys are gathered anywhere.
    """
    waiting = notices.filter(~F.col("delivered")).dropDuplicates(["recipient", "key"])
    return waiting.groupBy("recipient").agg(
        F.count("*").alias("waiting"),
        F.sum(F.xxhash64("key").cast("decimal(38,0)")).cast("string").alias("signature"),
    ).withColumn("digest", F.col("waiting") > K.DIGEST_MIN_BACKLOG)


def digests_due(current: DataFrame, sent: DataFrame, now_ms: int) -> DataFrame:
    """Recipients whose digest goes out: never sent, or changed and a minute old.

    sent: recipient, signature, at_ms of the last digest.
    """
    prior = sent.select("recipient", F.col("signature").alias("_sig"), F.col("at_ms").alias("_at"))
    due = F.col("_sig").isNull() | (
        (F.col("_sig") != F.col("signature")) & (F.lit(now_ms) - F.col("_at") >= K.DIGEST_RESEND_MS))
    return current.filter("digest").join(prior, "recipient", "left").withColumn("due", due).drop("_sig", "_at")


# --- history and pending work ---------------------------------------------------------------


def emit_history(cases: DataFrame) -> DataFrame:
    """Event rows a finished automated pass leaves behind, in order per case."""
    def event(kind, summary, when_=None):
        e = F.struct(F.lit(kind).alias("type"), summary.alias("summary"))
        return e if when_ is None else F.when(when_, e)

    is_bl = F.col("category") == "BL_COMPARISON"
    parsed = F.transform(
        F.filter("listed", lambda d: d["present"]),
        lambda d: F.struct(F.lit("DOCUMENT_PARSED").alias("type"), F.concat(
            F.lit("Parsed "), d["filename"], F.lit(" ("), d["parse_status"], F.lit(")")).alias("summary")))
    head = F.array(event("EMAIL_CLASSIFIED", F.concat(
        F.lit("Email classified as "), "category", F.lit(" ("), "rule_id", F.lit(")"))))
    tail = F.array_compact(F.array(
        event("COMPARISON_COMPLETED", F.concat(F.lit("Comparison completed: "), F.col("assessment.status")), is_bl),
        event("REVIEW_CREATED", F.concat(F.lit("Review created: "), F.col("review.scope"), F.lit("/"),
                                         F.col("review.ui_mode")), F.col("review").isNotNull()),
        event("CASE_COMPLETED", F.concat(F.lit("Case completed automatically with "), F.col("assessment.status")),
              F.col("review").isNull())))
    return cases.select(
        *schema.KEY, "run_id", F.posexplode(F.concat(head, parsed, tail)).alias("n", "e"),
    ).select(
        F.concat(F.lit("evt_"), F.left(F.sha2(F.concat_ws("\x00", "run_id", "e.type", "n").cast("binary"), 256),
                                       F.lit(20))).alias("event_id"),
        *schema.KEY, "run_id", "n", "e.type", "e.summary")


def pending_work(emails: DataFrame, assessed: DataFrame) -> DataFrame:
    """Mails without an assessment."""
    done = assessed.select("run_kind", F.col("case_id").alias("email_id"))
    return emails.join(done, ["run_kind", "email_id"], "left_anti")

