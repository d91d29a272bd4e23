"""Run, break and audit tables on Parquet.

Append-only event tables replace SQL UPDATEs: a run's state is its latest
event; an explanation is a later row keyed by ``break_id``. Breaks are
partitioned by ``run_id`` so per-run reads prune partitions. Spark's file
commit protocol makes every append all-or-nothing, so a lost executor
only costs a task retry; deterministic ids make a re-run a no-op.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tradetally.functions.ids import stable_id
from tradetally.operators.summary import ordered_breaks
from tradetally.operators.validate import check_non_negative
from tradetally.schemas import (AUDIT_SCHEMA, AUDIT_STATUSES, BREAK_TYPES, RUN_EVENT_SCHEMA,
                                RUN_STATUSES, SEVERITIES)
from tradetally.sinks.events import FILE_BYTES, EventTable


#: Break ids are hexadecimal text, which Parquet's default codec leaves as long as it is.
CODEC = "zstd"


class LedgerError(ValueError):
    pass


def utc_now() -> dt.datetime:
    """the present instant. It names its zone, since Spark takes a time
    without one as local to the driver."""
    return dt.datetime.now(dt.timezone.utc)


def latest_run_state(events: DataFrame) -> DataFrame:
    """Current state per run = its latest event by logical time: instant,
    then ``event_seq``, then ``writer``, as far as the events have them; runs without a create event are dropped (an UPDATE
    of an unknown id changes nothing). Partial aggregation keeps a run with a
    huge number of events cheap."""
    created = events.where(F.col("event") == "create").select("run_id").distinct()
    cols = [c for c in events.columns if c != "run_id"]
    order = F.struct(*[c for c in ("updated_at", "event_seq", "writer") if c in events.columns])
    latest = events.groupBy("run_id").agg(F.max_by(F.struct(*cols), order).alias("s"))
    return latest.join(created, "run_id", "left_semi").select("run_id", "s.*")


def insert_ignore(new: DataFrame, existing: DataFrame, key: str = "break_id") -> DataFrame:
    """K1: rows of ``new`` whose key is neither already stored nor repeated. What
    is stored is read once, so two writers of one run must not run together."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def keys_meet(new: DataFrame, existing: DataFrame, key: str = "break_id") -> bool:
    """Can a key of ``new`` be stored already, or repeated there? Hashes of the keys
    are counted, so no rows are shuffled; two keys of one hash only cost the exact way."""
    h = F.xxhash64(key).alias("h")
    both = new.select(h, F.lit(1).alias("is_new")).unionAll(existing.select(h, F.lit(0).alias("is_new")))
    return not (both.groupBy("h").agg(F.sum("is_new").alias("n_new"), F.count(F.lit(1)).alias("n"))
                .where("n_new > 0 AND n > 1").isEmpty())


def missing_parent_keys(child: DataFrame, parents: DataFrame, key: str = "run_id") -> DataFrame:
    """K6 on keys: the distinct non-null keys of ``child`` with no parent.
    All rows of a run share one key, so the check works on distinct keys
    (a partial aggregate), never on the rows themselves."""
    keys = child.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.join(parents.select(key).distinct(), key, "left_anti")


def fk_violations(child: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """K6: child rows whose non-null run id has no run."""
    return child.join(missing_parent_keys(child, runs, key), key, "left_semi")


def merge_explanations(breaks: DataFrame, explanations: DataFrame) -> DataFrame:
    """K5: latest explanation per break (``break_id, explanation, explained_at``)
    joined onto the breaks; breaks without one keep NULL. Of two explanations of
    one instant the greater text counts."""
    latest = explanations.groupBy("break_id").agg(
        F.max(F.struct("explained_at", "explanation")).alias("e"))
    return (breaks.join(latest, "break_id", "left")
            .withColumn("explanation", F.col("e.explanation"))
            .withColumn("explained_at", F.col("e.explained_at")).drop("e"))


def enum_violations(df: DataFrame, checks: dict[str, list[str]]) -> F.Column:
    cond = F.lit(False)
    for c, allowed in checks.items():
        if c in df.columns:
            cond = cond | (F.col(c).isNotNull() & ~F.col(c).isin(*allowed))
    return cond


class Ledger:
    """Tables under ``root`` (a shared folder): ``runs/``, ``breaks/``,
    ``audit/``, ``explanations/``."""

    def __init__(self, spark: SparkSession, root: str, writer: str | None = None):
        """``writer`` names who writes run events; it decides between two
        events of one instant and number, and must differ between writers."""
        self.spark, self.root, self.writer = spark, root, writer or uuid.uuid4().hex

    def _clock(self, now: dt.datetime, seen: tuple[dt.datetime, int | None] | None = None) -> dict:
        """Logical time of a new event: later than the one it has ``seen``, even
        within one instant or where this writer's clock is behind. A time without
        a zone is one that Spark returned, local to the driver."""
        if seen:
            seen = (seen[0].astimezone(dt.timezone.utc), seen[1])
        if seen and seen[0] >= now:
            return {"updated_at": seen[0], "event_seq": (seen[1] or 0) + 1, "writer": self.writer}
        return {"updated_at": now, "event_seq": 0, "writer": self.writer}

    def _p(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _fs_path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        p, fs = self._fs_path(self._p(name))
        return bool(fs.exists(p))

    def _read(self, name: str, schema) -> DataFrame:
        if not self._exists(name):                      # table not written yet
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._p(name))

    def run_table(self) -> EventTable:
        return EventTable(self.spark, self._p("runs"), RUN_EVENT_SCHEMA, ["updated_at"])

    def audit_table(self) -> EventTable:
        return EventTable(self.spark, self._p("audit"), AUDIT_SCHEMA, ["created_at"])

    def compact(self, file_bytes: int = FILE_BYTES) -> None:
        """Run events and audit rows into few files sorted by run; reads by run
        then open only files that can hold it. Not beside another compaction."""
        for t in (self.run_table(), self.audit_table()):
            t.compact(file_bytes)
            t.tidy()

    # ---- runs ---------------------------------------------------------------
    def _run_event(self, **vals) -> DataFrame:
        row = {f.name: vals.get(f.name) for f in RUN_EVENT_SCHEMA.fields}
        for k in ("total_breaks", "critical_breaks", "high_breaks", "medium_breaks",
                  "source_a_count", "source_b_count", "matched_count"):
            if row[k] is not None and row[k] < 0:
                raise LedgerError(f"{k} must be >= 0")                       # V14
        if row["status"] not in RUN_STATUSES:
            raise LedgerError(f"unknown run status {row['status']!r}")       # V15
        return self.spark.createDataFrame([tuple(row.values())], RUN_EVENT_SCHEMA)

    def create_run(self, run_id: str, run_date: dt.date, started_at: dt.datetime | None = None) -> None:
        """K2. A ``started_at`` without a zone is UTC."""
        now = started_at or utc_now()
        now = now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)
        ev = self._run_event(run_id=run_id, run_date=run_date, started_at=now, status="RUNNING",
                             total_breaks=0, critical_breaks=0, high_breaks=0, medium_breaks=0,
                             source_a_count=0, source_b_count=0, matched_count=0,
                             email_sent=False, event="create", **self._clock(now))
        ev.write.mode("append").parquet(self._p("runs"))

    def complete_run(self, run_id: str, status: str, counts: dict | None = None,
                     report_path: str | None = None, email_sent: bool = False,
                     error_message: str | None = None) -> None:
        """K3: appends the closing event; reads see it as the run's state."""
        now = utc_now()
        prev = self.get_run(run_id).first()
        base = prev.asDict() if prev else {"run_id": run_id}
        base.update(counts or {})
        base.update(status=status, completed_at=now, report_path=report_path,
                    email_sent=email_sent, error_message=error_message, event="complete",
                    **self._clock(now, (prev["updated_at"], prev["event_seq"]) if prev else None))
        self._run_event(**base).write.mode("append").parquet(self._p("runs"))

    def runs(self) -> DataFrame:
        return latest_run_state(self.run_table().read())

    def get_run(self, run_id: str) -> DataFrame:
        """L1: only files that can hold the run's events are read."""
        return latest_run_state(self.run_table().read_key(run_id))

    # ---- breaks -------------------------------------------------------------
    def write_breaks(self, breaks: DataFrame, run_ids: list[str] | None = None, stored: bool = False,
                     derived: dict[str, Column] | None = None) -> int:
        """K1 + K6 + V15: insert-or-ignore by ``break_id`` into ``breaks/``
        (partitioned by run_id). Returns the number of rows inserted.

        The upstream plan (a whole reconciliation) runs once: the breaks are
        staged as Parquet in the ledger folder, and the checks and the insert
        read the staged copy. ``run_ids`` limits the existing-key read to
        those partitions; ``stored`` says that ``breaks`` is a plain read of files,
        which needs no staging. ``derived`` names columns that a row's others yield:
        they are not staged but derived again, as break ids are most of a row's bytes."""
        if stored:
            return self._insert(breaks, run_ids)
        stage = self._p(f"_staging/breaks-{uuid.uuid4().hex}")
        try:
            breaks.drop(*derived or ()).write.mode("overwrite").option("compression", CODEC).parquet(stage)
            staged = self.spark.read.parquet(stage).withColumns(derived or {}).select(*breaks.columns)
            return self._insert(staged, run_ids)
        finally:
            self._remove(stage)

    def _insert(self, staged: DataFrame, run_ids: list[str] | None) -> int:
        chk = staged.agg(F.count_if(enum_violations(staged, {
            "break_type": BREAK_TYPES + ["CONSIDERATION_BREAK"], "severity": SEVERITIES})).alias("bad"),
            F.count_if(F.col("run_id").isNull()).alias("no_run")).first()
        if chk["bad"] or chk["no_run"]:
            raise LedgerError("break rows with unknown type or severity, or without a run id")
        if not missing_parent_keys(staged, self.runs()).isEmpty():
            raise LedgerError("breaks reference runs that do not exist")
        existing = self.read_breaks()
        if run_ids:
            existing = existing.where(F.col("run_id").isin(*run_ids))
        new = staged
        if keys_meet(staged, existing):
            if missing_parent_keys(staged, existing, "break_id").isEmpty() and staged.where("break_id IS NULL").isEmpty():
                return 0                                # all stored before: only keys were shuffled
            new = insert_ignore(staged, existing)
        obs = Observation("inserted")
        new.withColumn("created_at", F.current_timestamp()).observe(obs, F.count(F.lit(1)).alias("n")) \
            .write.mode("append").option("compression", CODEC).partitionBy("run_id").parquet(self._p("breaks"))
        return obs.get["n"]

    def _remove(self, path: str) -> None:
        """Drop a staging folder of this ledger through the Hadoop file system."""
        p, fs = self._fs_path(path)
        fs.delete(p, True)

    def read_breaks(self) -> DataFrame:
        if not self._exists("breaks"):
            return self.spark.createDataFrame([], "break_id string, run_id string")
        return self.spark.read.parquet(self._p("breaks"))

    def get_breaks_for_run(self, run_id: str, by_rank: bool = False) -> DataFrame:
        """L2: partition-pruned read, ordered by (severity, break_type)."""
        b = self.read_breaks().where(F.col("run_id") == run_id)
        exp = self._read("explanations", "break_id string, explanation string, explained_at timestamp")
        return ordered_breaks(merge_explanations(b, exp), by_rank)

    def update_break_explanations(self, explanations: DataFrame) -> None:
        """K5: append ``break_id, explanation`` rows (timestamped)."""
        (explanations.select("break_id", "explanation")
         .withColumn("explained_at", F.current_timestamp())
         .write.mode("append").option("compression", CODEC).parquet(self._p("explanations")))

    # ---- audit --------------------------------------------------------------
    def write_audit(self, entries: DataFrame) -> None:
        """K4: append-only; ``detail`` is JSON text."""
        if not entries.where(enum_violations(entries, {"status": AUDIT_STATUSES})).isEmpty():
            raise LedgerError("audit rows with unknown status")
        if "duration_ms" in entries.columns and not entries.where(check_non_negative(["duration_ms"])).isEmpty():
            raise LedgerError("duration_ms must be >= 0")
        if not missing_parent_keys(entries, self.runs()).isEmpty():
            raise LedgerError("audit rows reference runs that do not exist")
        self.audit_table().append(entries)

    def quick_audit(self, agent_name: str, action: str, status: str, run_id: str | None = None,
                    detail: dict | None = None, duration_ms: int | None = None,
                    input_hash: str | None = None, error_message: str | None = None) -> None:
        now = utc_now()
        audit_id = f"{run_id}|{agent_name}|{action}|{now.isoformat()}"
        row = (audit_id, run_id, agent_name, action, status,
               json.dumps(detail, default=str) if detail is not None else None,
               duration_ms, input_hash, error_message, now)
        df = self.spark.createDataFrame([row], AUDIT_SCHEMA)
        self.write_audit(df.withColumn("audit_id", stable_id(F.col("audit_id"))))

    def get_audit_for_run(self, run_id: str) -> DataFrame:
        """L3: only files that can hold the run's rows are read."""
        return self.audit_table().read_key(run_id).orderBy("created_at")
