"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from ladingcheck.operators import metrics
from ladingcheck.plans import queries as registry
from ladingcheck.plans import shipments, verify
from ladingcheck.plans.cases import to_cases

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "20g").config("spark.sql.shuffle.partitions", str(4 * int(CPUS)))
        # Tasks here are bound by CPU, not by bytes: keep all shuffle partitions.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def fresh_cases(spark: SparkSession) -> DataFrame:
    """Verified cases computed anew, nothing kept from another query."""
    emails, files = shipments.inbox(spark, SF_DIR)
    return to_cases(verify.verify(emails, files))


def _score(spark: SparkSession) -> DataFrame:
    registry.release()
    return registry.all_queries()["e07_final_score"](spark, SF_DIR)


HEADLINES = {
    "verify": lambda s: fresh_cases(s).select(
        "run_kind", "case_id", "category", "assessment", "workflow_status", "follow_up"),
    "stats": lambda s: metrics.stats(fresh_cases(s)),
    "score": _score,
    "port_codes": lambda s: metrics.port_codes(metrics.port_observations(registry.texts(s, SF_DIR))),
    "classify": lambda s: registry.all_queries()["k01_classify"](s, SF_DIR),
    "convention": lambda s: registry.all_queries()["n11_corpus_convention"](s, SF_DIR),
    "budget_ledger": lambda s: registry.all_queries()["d04_budget_ledger"](s, SF_DIR),
    "timeline": lambda s: registry.all_queries()["d16_timeline"](s, SF_DIR),
    "rate_limit": lambda s: registry.all_queries()["d17_invalid_rate_limit"](s, SF_DIR),
}


def main() -> None:
    spark = session()
    cases = shipments.table(spark, SF_DIR, "orders").count()
    times = {}
    for name, build in HEADLINES.items():
        start = time.perf_counter()
        run(build(spark))
        times[name] = round(time.perf_counter() - start, 3)
        registry.release()
    print(json.dumps({
        "metric": "headline queries, wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
        "cases": cases, "cases_per_sec": round(cases / times["verify"], 1)}))


if __name__ == "__main__":
    main()
