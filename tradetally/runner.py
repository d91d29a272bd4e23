"""One reconciliation day as Spark jobs: pre-flight, ingestion, matching,
ledger writes and the final run status (what the reconciled system's agents
do, without the printing).

Jobs per source: one ingestion pass (the source is parsed and validated once and
written once, valid and quarantined rows apart, and counted on that pass). The
first errors are a top-k over the quarantined rows alone, and matching reads the
written feed. Breaks are staged once and their counts observed on that write.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tradetally.operators import validate as V
from tradetally.operators.compare import Checks, Tolerances
from tradetally.operators.normalise import MALFORMED
from tradetally.operators.reconcile import break_id, by_type, reconcile
from tradetally.operators.summary import run_status
from tradetally.schemas import SEVERITIES
from tradetally.sinks.ledger import CODEC, Ledger
from tradetally.sources import files, readers


FILES_NAMED = 10


@dataclass
class SourceSpec:
    path: str
    name: str
    file_type: str = "csv"
    date_format: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class Ingested:
    name: str
    frame: DataFrame
    record_count: int
    valid_count: int
    invalid_count: int
    errors: list[str]
    files: int
    input_digest: str | None


def _ms(t0: float) -> int:
    return int((time.time() - t0) * 1000)


def preflight(spark: SparkSession, specs: list[SourceSpec], failed_files: str | None = None) -> list[str]:
    """S6 for every configured source path: presence and minimum size. The
    failing files go to the table ``failed_files``; the text names the first
    ``FILES_NAMED`` of a source and counts the rest."""
    failures = []
    for s in specs:
        if not s.path:
            failures.append(f"No file path configured for {s.name}")
            continue
        try:
            bad = files.profile_failures(files.source_profile(spark, s.path))
            if failed_files:
                bad.withColumn("source", F.lit(s.name)).write.mode("append").parquet(failed_files)
            count, first = bad.count(), bad.orderBy("name").limit(FILES_NAMED).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            failures.append(f"Source file not found: {s.path} ({s.name})")
            continue
        failures += [f"Source file {r['reason']}: {r['name']} ({s.name})" for r in first]
        if count > len(first):
            failures.append(f"{count - len(first)} more source files fail ({s.name})")
    return failures


def feed_path(led: Ledger, run_id: str, source: str) -> str:
    return led._p(f"feeds/run_id={run_id}/source={source}")


def quarantined(feed: DataFrame) -> DataFrame:
    """The quarantined rows of an ingested feed; only their files are read."""
    return feed.where(~F.col("valid")).select("ingest_seq", "trade_id", "error_codes", "message")


def ingest(spark: SparkSession, led: Ledger, run_id: str, spec: SourceSpec,
           strict_isin: bool = False) -> Ingested:
    """Load and validate once: the validated feed is written to the ledger's
    folder, a partition each for valid and quarantined rows, and counted on
    that pass; matching reads it there. Of the first errors each task keeps ten."""
    t0 = time.time()
    df, fp = readers.load_source(spark, spec.path, spec.name, spec.file_type,
                                 date_format=spec.date_format, dates="quarantine", **spec.options)
    v = V.validate(df, strict_isin=strict_isin, stripped=True)
    obs = Observation(f"ingest-{spec.name}")
    fpath = feed_path(led, run_id, spec.name)
    message = V.error_message(F.lit(spec.name), F.col("trade_id"), F.col("error_codes"))
    v = v.withColumn("message", F.when(~F.col("valid"), message))
    v.observe(obs, F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("ok")) \
        .write.mode("overwrite").option("compression", CODEC).partitionBy("valid").parquet(fpath)
    m = obs.get
    feed = spark.read.schema(v.schema).parquet(fpath)
    errors = [r["message"] for r in quarantined(feed).orderBy("ingest_seq", "message").limit(V.ERROR_LIST_LIMIT).collect()]
    files_n, digest = (0, None)
    if fp is not None:
        # per-file hashes go to a ledger table; the audit row gets the file
        # count and one order-independent digest of the set (exact sums of all
        # parts of each file's name-and-content hash), so nothing per file
        # passes through the driver
        fpath = led._p(f"fingerprints/run_id={run_id}/source={spec.name}")
        fp.write.mode("overwrite").parquet(fpath)
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        whole = spark.read.parquet(fpath).select(F.sha2(F.concat_ws(":", name, "sha256"), 256).alias("h"))
        agg = whole.agg(F.count(F.lit(1)).alias("n"), *[
            F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{at}")
            for at in range(1, 65, 8)]).first()
        files_n = agg["n"]
        digest = hashlib.sha256(":".join(map(str, agg)).encode()).hexdigest() if files_n else None
    ing = Ingested(spec.name, feed, m["n"], m["ok"], m["n"] - m["ok"], errors, files_n, digest)
    led.quick_audit("ingestion", "load_source", "SUCCESS" if ing.invalid_count == 0 else "WARNING",
                    run_id=run_id, duration_ms=_ms(t0), input_hash=digest,
                    detail={"source": spec.name, "files": files_n, "record_count": ing.record_count,
                            "valid_count": ing.valid_count, "invalid_count": ing.invalid_count,
                            "errors": errors})
    return ing


def run_day(spark: SparkSession, ledger_root: str, run_id: str, run_date: dt.date,
            source_a: SourceSpec, source_b: SourceSpec, tolerances: Tolerances | dict | None = None,
            checks: Checks | None = None, valid_only: bool = False) -> DataFrame:
    """Pre-flight, ingest A and B, reconcile, write breaks, close the run.
    Returns the run's final row from the ledger."""
    led = Ledger(spark, ledger_root)
    t_start = time.time()
    led.create_run(run_id, run_date)
    errors: list[str] = []

    failures = preflight(spark, [source_a, source_b], led._p(f"failed_files/run_id={run_id}"))
    led.quick_audit("guardrail", "pre_flight_validation", "FAILURE" if failures else "SUCCESS",
                    run_id=run_id, detail={"failures": failures} if failures else {"checks_passed": True},
                    error_message=f"{len(failures)} validation check(s) failed" if failures else None)
    if failures:
        led.complete_run(run_id, "FAILED", error_message="; ".join(failures))
        return led.get_run(run_id)

    sides = []
    for spec in (source_a, source_b):
        try:
            sides.append(ingest(spark, led, run_id, spec))
        except Exception as e:  # noqa: BLE001 - a failed source ends the run, as in the reference
            errors.append(f"{spec.name}: {e}")
            led.quick_audit("ingestion", "load_source", "FAILURE", run_id=run_id,
                            error_message=str(e))
    if len(sides) < 2:
        led.complete_run(run_id, run_status_value(len(errors), 0), error_message="; ".join(errors))
        return led.get_run(run_id)

    a, b = (s.frame.where("valid") if valid_only else _well_formed(s.frame) for s in sides)
    t0 = time.time()
    r = reconcile(a, b, order_by=["ingest_seq"], run_id=run_id, tolerances=tolerances, checks=checks)
    breaks, obs = r.observed_breaks()
    led.write_breaks(breaks, run_ids=[run_id], derived={"break_id": break_id(F.col("run_id"))})
    c = obs.get
    sev = r.checks.severity
    per_type = {t: sum(c[n] for n in names) for t, names in by_type(r.checks).items()}
    total = sum(per_type.values())
    of_level = {s: sum(v for k, v in per_type.items() if sev.get(k, "MEDIUM") == s) for s in SEVERITIES}
    counts = {"total_breaks": total, "critical_breaks": of_level["CRITICAL"], "high_breaks": of_level["HIGH"],
              "medium_breaks": of_level["MEDIUM"],
              "source_a_count": sides[0].valid_count, "source_b_count": sides[1].valid_count,
              "matched_count": c["clean"]}
    led.quick_audit("reconciliation", "reconcile", "SUCCESS", run_id=run_id, duration_ms=_ms(t0),
                    detail={"clean": c["clean"], "by_type": per_type, "excluded_a_rows": c["excluded_a_rows"],
                            "excluded_b_rows": c["excluded_b_rows"]})
    status = run_status_value(len(errors), total)
    led.complete_run(run_id, status, counts, error_message="; ".join(errors) or None)
    led.quick_audit("audit", "run_complete", "SUCCESS" if status == "COMPLETED" else "WARNING",
                    run_id=run_id, duration_ms=_ms(t_start),
                    detail=dict(counts, final_status=status))
    return led.get_run(run_id)


def _well_formed(df: DataFrame) -> DataFrame:
    """Rows whose fields can be told apart; malformed ones stay in quarantine."""
    return df.where(F.col(MALFORMED).isNull()) if MALFORMED in df.columns else df


def run_status_value(error_count: int, total_breaks: int) -> str:
    """A7 on driver-side scalars (the column form is ``summary.run_status``)."""
    if error_count and not total_breaks:
        return "FAILED"
    if error_count:
        return "PARTIAL"
    return "COMPLETED"


__all__ = ["SourceSpec", "preflight", "ingest", "quarantined", "run_day", "run_status", "run_status_value"]
