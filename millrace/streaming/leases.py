"""Lease, commit and job states over a stream of ledger rows, by micro-batches.

The rows of open tasks lie below ``store`` in buckets by task. A batch reads the buckets
that its rows fall into and those where a lease runs out, and the batch operators of
:mod:`millrace.operators.ledger` judge their open tasks up to a *mark*: the latest time seen
less the allowed delay. Nothing before the mark can change any more, so what they say about
the time since the last mark is final and is written once, in the order of ``(ts, seq)``
whatever order the rows came in. A task that has ended leaves its rows behind and becomes
one row, by which later requests are answered; so a batch costs what it touches, however
long the stream has run. Every table of a batch has a folder of its own, so a batch that
runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import ledger as L
from millrace.streaming.runner import batch_table as _table
from millrace.streaming.runner import delete_folder as _delete
from millrace.streaming.runner import run_batches
from millrace.streaming.runner import write_batch as _write

TRANSITIONS = (
    "job_id string, task_id string, lease_id string, node_id string, attempt int, "
    "seq bigint, ts_us bigint, type string, reason string"
)
TERMINAL = {
    "TASK_COMMIT_ACCEPTED": "COMPLETED",
    "TASK_EXHAUSTED": "FAILED",
    "TASK_CANCELLED": "CANCELLED",
}
_CLOCK = "mark bigint, latest bigint"
_COUNTS = "job_id string, done bigint, failed bigint, completed bigint"
_BEGINNING = -(2**62)
#: Cuts of the table of open tasks.
BUCKETS = 32


def transitions(events: DataFrame, judged: DataFrame) -> DataFrame:
    """Everything that happened to leases and tasks, as ``TRANSITIONS``, from ledger rows
    and :func:`millrace.operators.ledger.judged_leases` of them."""
    current = judged.filter(F.col("won").isNull() | (F.col("attempt") <= F.col("won")))
    none = F.lit(None)

    def rows(df, ts, kind, seq=none, reason=none, attempt=F.col("attempt")):
        return df.select(
            *L.LEASE, "node_id", attempt.cast("int").alias("attempt"), seq.cast("bigint").alias("seq"),
            F.unix_micros(ts).alias("ts_us"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
            reason.cast("string").alias("reason"),
        )

    ended = current.filter(F.col("outcome") != "running")
    kind = (
        F.when(F.col("outcome") == "committed", "TASK_COMMIT_ACCEPTED")
        .when(F.col("outcome") == "failed", "TASK_ATTEMPT_FAILED")
        .otherwise("LEASE_EXPIRED")
    )
    superseded = F.when((kind == "LEASE_EXPIRED") & (F.col("ended_at") < F.col("deadline")), "superseded")
    # A lease that ends without a result gives its task back, unless it was the last.
    freed = ended.filter(
        (F.col("outcome") != "committed")
        & (F.col("cancelled_at").isNull() | (F.col("ended_at") < F.col("cancelled_at")))
    )
    after = F.when(F.col("attempt") >= F.col("max_attempts"), "TASK_EXHAUSTED").otherwise("TASK_REQUEUED")

    beats = events.filter(F.col("type") == "LEASE_RENEWED").select(*L.LEASE, "ts", "seq")
    renewed = beats.join(current.drop("seq"), L.LEASE).filter(
        F.col("ts").between(F.col("claim_ts"), F.col("last_beat"))
        & (F.col("ended_at").isNull() | (F.col("ts") <= F.col("ended_at")))
    )
    rejected = L.commits(events, judged).filter(~F.col("accepted"))

    over = current.groupBy(*L.TASK).agg(
        F.min(
            F.when(
                (F.col("outcome") == "committed")
                | ((F.col("attempt") >= F.col("max_attempts")) & (F.col("outcome") != "running")),
                F.col("ended_at"),
            )
        ).alias("over")
    )
    cancels = (
        events.filter(F.col("type") == "TASK_CANCELLED")
        .groupBy(*L.TASK)
        .agg(F.min(F.struct("ts", "seq")).alias("c"))
        .join(over, L.TASK, "left")
        .filter(F.col("over").isNull() | (F.col("c.ts") <= F.col("over")))
    )
    cancelled = cancels.select(
        *L.TASK, none.cast("string").alias("lease_id"), none.cast("string").alias("node_id"), "c"
    )
    return (
        rows(current, F.col("claim_ts"), "LEASE_CLAIMED", F.col("claim_seq"))
        .unionByName(rows(renewed, F.col("ts"), "LEASE_RENEWED", F.col("seq")))
        .unionByName(rows(ended, F.col("ended_at"), kind, F.col("closing_seq"), superseded))
        .unionByName(rows(freed, F.col("ended_at"), after, F.col("closing_seq")))
        .unionByName(
            rows(rejected, F.col("ts"), "TASK_COMMIT_REJECTED", F.col("seq"), F.col("reason"), none)
        )
        .unionByName(rows(cancelled, F.col("c.ts"), "TASK_CANCELLED", F.col("c.seq"), none, none))
    )


def _count_jobs(made: DataFrame, tasks: DataFrame, store: str, batch: int) -> None:
    """Add the tasks that ended to the counts of their jobs; write the jobs that are done.
    Only jobs with an ended task and none finished are carried on."""
    spark = made.sparkSession
    of = lambda kind: F.count_if(F.col("type") == kind)
    fresh = made.filter(F.col("type").isin(list(TERMINAL))).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("done"),
        of("TASK_EXHAUSTED").alias("failed"),
        of("TASK_COMMIT_ACCEPTED").alias("completed"),
    )
    before = _table(spark, store, "job-counts", batch - 1, _COUNTS)
    counts = before.unionByName(fresh).groupBy("job_id").agg(
        *[F.sum(c).alias(c) for c in ("done", "failed", "completed")]
    )
    totals = tasks.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    counts = counts.join(totals, "job_id")
    state = (
        F.when(F.col("failed") > 0, "FAILED")
        .when(F.col("completed") == F.col("total"), "SUCCEEDED")
        .otherwise("CANCELLED")
    )
    _write(counts.filter("done = total").select("job_id", state.alias("state")), store, "jobs", batch)
    _write(counts.filter("done < total").select("job_id", "done", "failed", "completed"), store, "job-counts", batch)


class _Buckets:
    """Tables of the open tasks, cut into buckets by task. A batch writes new versions of
    the buckets it touches; ``heads`` says which batch wrote the version that counts:
    ``bucket, open, done`` (null: empty) and ``due``, when a task of it next needs judging."""

    HEADS = "bucket int, open bigint, done bigint, due bigint"

    def __init__(self, spark: SparkSession, store: str, before: int):
        self.spark, self.store = spark, store
        rows = _table(spark, store, "heads", before, self.HEADS).collect()  # one a bucket
        self.heads = {r["bucket"]: r.asDict() for r in rows}

    def due(self, mark: int) -> set[int]:
        return {k for k, h in self.heads.items() if h["due"] is not None and h["due"] <= mark}

    def read(self, name: str, touched: list[int], schema: str) -> DataFrame:
        held = [(self.heads[k][name], k) for k in touched if self.heads.get(k, {}).get(name) is not None]
        if not held:
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        paths = [f"{self.store}/{name}/batch={batch}/bucket={k}" for batch, k in held]
        reader = self.spark.read.schema(f"{schema}, batch bigint, bucket int").option("basePath", f"{self.store}/{name}")
        return reader.parquet(*paths).drop("batch")

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        path = f"{self.store}/{name}/batch={batch}"
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def move(self, touched: list[int], open_: DataFrame, done: DataFrame, batch: int) -> None:
        """What was written for the touched buckets is what counts from now on."""
        due = {r["bucket"]: r["due"] for r in open_.groupBy("bucket").agg(F.min("due").alias("due")).collect()}
        over = {r["bucket"] for r in done.select("bucket").distinct().collect()}
        for k in touched:
            self.heads[k] = {
                "bucket": k, "open": batch if k in due else None, "done": batch if k in over else None, "due": due.get(k),
            }
        rows = [tuple(h[c] for c in ("bucket", "open", "done", "due")) for h in self.heads.values()]
        _write(self.spark.createDataFrame(rows, self.HEADS).coalesce(1), self.store, "heads", batch)

    def forget(self, batch: int) -> None:
        """Remove the versions that the batch before the last one read and the last one replaced."""
        if batch < 2:
            return
        old, new = (_Buckets(self.spark, self.store, batch - k).heads for k in (2, 1))
        for k, head in old.items():
            for name in ("open", "done"):
                if head[name] is not None and new[k][name] != head[name]:
                    _delete(self.spark, f"{self.store}/{name}/batch={head[name]}/bucket={k}")


def _finished(ended: DataFrame, judged: DataFrame) -> DataFrame:
    """What later requests for a task that has ended are judged by, one row for each:
    the leases it granted, how many more it would grant, and whether it has a result."""
    known = judged.select(*L.TASK, "lease_id", "max_attempts", "won", F.unix_micros("ended_at").alias("us"))
    rows = ended.join(known, L.TASK, "left").groupBy(*L.TASK, "bucket").agg(
        F.collect_set("lease_id").alias("leases"),  # as many as the task may have attempts
        (F.max("max_attempts") - F.count("lease_id")).alias("more"),
        F.max("won").isNotNull().alias("won"),
        F.max("us").alias("ended"),
    )
    return rows.withColumn("grants", F.when(F.col("won"), F.col("more")).otherwise(0).cast("int")).drop("more")


def _regranted(done: DataFrame, after: DataFrame) -> DataFrame:
    """``done`` with the leases that claims after the end were granted."""
    first = after.filter(F.col("type") == "LEASE_CLAIMED").groupBy(*L.LEASE).agg(F.min(F.struct("ts", "seq")).alias("at"))
    fresh = first.groupBy(*L.TASK).agg(F.array_sort(F.collect_list(F.struct("at", "lease_id"))).alias("new"))
    rows = done.join(fresh, L.TASK, "left")
    new = F.coalesce(F.slice(F.array_except(F.col("new.lease_id"), "leases"), 1, F.col("grants")), F.array().cast("array<string>"))
    rows = rows.withColumn("_new", new)
    return rows.select(
        *L.TASK, "bucket", F.concat("leases", "_new").alias("leases"), "won", "ended",
        (F.col("grants") - F.size("_new")).alias("grants"),
    )


def _too_late(after: DataFrame, done: DataFrame) -> DataFrame:
    """Commits offered for tasks that had ended, as ``TRANSITIONS``."""
    known = done.select(*L.TASK, "leases", "won")
    offered = after.filter(F.col("type") == "COMMIT_OFFERED").join(known, L.TASK)
    reason = (
        F.when(~F.array_contains("leases", F.col("lease_id")), "unknown_lease")
        .when(F.col("won"), "duplicate")
        .otherwise("late")
    )
    return offered.select(
        *L.LEASE, "node_id", F.lit(None).cast("int").alias("attempt"), "seq", F.unix_micros("ts").alias("ts_us"),
        F.lit("TASK_COMMIT_REJECTED").alias("type"), reason.alias("reason"),
    )


_DONE = "job_id string, task_id string, leases array<string>, won boolean, ended bigint, grants int"


def lease_batches(
    tasks: DataFrame, store: str, delay_s: float, forget_s: float | None = None, buckets: int = BUCKETS, jobs: bool = True
) -> Callable:
    """Function for ``foreachBatch`` over ledger rows; see :func:`run_leases`."""
    columns = [column.split()[0] for column in schemas.LEDGER.split(", ")]
    bucket = F.pmod(F.xxhash64(*L.TASK), F.lit(buckets)).cast("int")
    bound = L.most_attempts(tasks)

    def run(batch: DataFrame, batch_id: int, end=None) -> None:
        spark = batch.sparkSession
        clock = _table(spark, store, "clock", batch_id - 1, _CLOCK).first()
        old_mark, latest = (clock["mark"], clock["latest"]) if clock else (_BEGINNING, _BEGINNING)
        state = _Buckets(spark, store, batch_id - 1)
        us = F.unix_micros("ts")
        # Rows behind the mark come too late to count; those of no task are no lease's.
        fresh = batch.select(*columns).filter((us > old_mark) & F.col("task_id").isNotNull() & F.col("job_id").isNotNull())
        fresh = fresh.withColumns({"due": F.lit(None).cast("bigint"), "bucket": bucket})
        newest = batch.agg(F.max(us)).first()[0]
        latest = max(latest, newest if newest is not None else latest)
        mark = max(old_mark, latest - int(delay_s * 1_000_000)) if end is None else end
        came = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}  # as many as buckets
        touched = sorted(came | state.due(mark))
        held = state.read("open", touched, f"{schemas.LEDGER}, due bigint").unionByName(fresh)
        done = state.read("done", touched, _DONE)

        known = held.filter(us <= mark)
        active = known.join(done.select(*L.TASK), L.TASK, "left_anti").select(*columns)
        after = known.join(done.select(*L.TASK), L.TASK, "left_semi").filter(us > old_mark)
        own = tasks.filter(bucket.isin(touched)) if 2 * len(touched) < buckets else tasks
        judged = L.judged_leases(active, own, F.timestamp_micros(F.lit(mark)), bound)
        _write(judged, store, "judged", batch_id)  # six kinds of rows are read off it
        judged = _table(spark, store, "judged", batch_id, judged.schema)
        regranted = _regranted(done, after)
        made = transitions(active, judged).unionByName(_too_late(after, regranted))
        made = made.filter((F.col("ts_us") > old_mark) & (F.col("ts_us") <= mark))
        _write(made, store, "transitions", batch_id)
        made = _table(spark, store, "transitions", batch_id, TRANSITIONS)
        if jobs:
            _count_jobs(made, tasks, store, batch_id)

        # Ended tasks keep one row; of the others, and ahead of the mark, rows stay as they are.
        ended = made.filter(F.col("type").isin(list(TERMINAL))).select(*L.TASK, bucket.alias("bucket")).distinct()
        over = regranted.unionByName(_finished(ended, judged))
        if forget_s is not None:
            over = over.filter(F.coalesce("ended", F.lit(mark)) >= mark - int(forget_s * 1_000_000))
        state.write("done", over, batch_id)
        next_end = judged.filter(F.col("outcome") == "running").groupBy(*L.TASK).agg(
            F.min(F.unix_micros("deadline")).alias("_deadline")
        )
        gone = done.select(*L.TASK).unionByName(ended.select(*L.TASK)).withColumn("_gone", F.lit(True))
        stay = held.join(gone, L.TASK, "left").filter(F.col("_gone").isNull() | (us > mark)).join(next_end, L.TASK, "left")
        due = F.when(us > mark, us).otherwise(F.col("_deadline"))
        state.write("open", stay.select(*columns, due.alias("due"), "bucket"), batch_id)
        written = {name: spark.read.schema(f"{schema}, bucket int").parquet(f"{store}/{name}/batch={batch_id}")
                   for name, schema in (("open", "due bigint"), ("done", "won boolean"))}
        state.move(touched, written["open"], written["done"], batch_id)
        _write(spark.createDataFrame([(mark, latest)], _CLOCK).coalesce(1), store, "clock", batch_id)
        state.forget(batch_id)
        for name in ("judged", "heads", "clock", "job-counts"):
            if batch_id > 2:
                _delete(spark, f"{store}/{name}/batch={batch_id - 3}")

    return run


def run_leases(
    ledger: DataFrame, tasks: DataFrame, store: str, delay_s: float = 3600.0, forget_s: float | None = None,
    buckets: int = BUCKETS, jobs: bool = True,
) -> DataFrame:
    """Take what the ledger stream has, and return all transitions so far.

    A row counts if no row ``delay_s`` or more younger came in an earlier batch. Progress
    and state live below ``store``; calling again, with the same number of ``buckets``, goes
    on from there. A task that has ended is one row, which answers the commits that still
    come; ``forget_s`` after its end that goes too. ``jobs`` also counts the jobs' states.
    """
    spark = ledger.sparkSession
    run_batches(ledger, lease_batches(tasks, store, delay_s, forget_s, buckets, jobs), store)
    return all_transitions(spark, store)


def finish(spark: SparkSession, tasks: DataFrame, store: str, as_of, buckets: int = BUCKETS, jobs: bool = True) -> DataFrame:
    """The stream has ended: judge what is held up to ``as_of`` too."""
    last = spark.read.parquet(f"{store}/clock").agg(F.max("batch")).first()[0]
    end = spark.range(1).select(F.unix_micros(L.instant(as_of))).first()[0]
    none = spark.createDataFrame([], schemas.LEDGER)
    lease_batches(tasks, store, 0.0, None, buckets, jobs)(none, int(last) + 1, end)
    return all_transitions(spark, store)


def all_transitions(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(f"{TRANSITIONS}, batch bigint").parquet(f"{store}/transitions").drop("batch")


def job_states(spark: SparkSession, store: str) -> DataFrame:
    """Jobs whose tasks have all ended: ``job_id, state``."""
    return spark.read.schema("job_id string, state string, batch bigint").parquet(f"{store}/jobs").drop("batch")


def stream_commits(made: DataFrame) -> DataFrame:
    """Accepted and rejected commits out of the transitions."""
    return made.filter(
        F.col("type").isin("TASK_COMMIT_ACCEPTED", "TASK_COMMIT_REJECTED")
    ).withColumn("accepted", F.col("type") == "TASK_COMMIT_ACCEPTED")
