"""Running-state streams: the final state of each equals its batch operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalgate.functions.columns import first_reason
from evalgate.operators.metrics import dice_value
from evalgate.sources import versions

# Labels of the no-progress causes.
CAUSES = {
    "active_guard": "Active process guard", "load_guard": "Load guard", "mem_guard": "Memory guard", "disk_guard": "Disk guard",
    "proposal_guard": "Proposal guard", "promotion_pause": "Promotion pause",
    "promotion_evidence_required": "Promotion evidence required", "signature_exhausted": "Signature exhausted",
    "deduped_existing_run": "Deduped existing run", "timeout": "Timeout", "unknown_no_progress": "Unknown no-progress",
}


def stream_dice(scores: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Running tp/fp/fn and Dice per group; works on a stream (update or complete mode) and on a batch."""
    pred, truth = F.col("prob") >= threshold, F.col("label") >= 0.5
    counts = scores.groupBy(*by).agg(
        F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"), F.count_if(~pred & truth).alias("fn"))
    return counts.withColumn("dice", dice_value(F.col("tp"), F.col("fp"), F.col("fn")))


def cause_code(line: Column) -> Column:
    """No-progress cause of a log line by ordered rules, NULL when it has none."""
    raw = F.trim(line)
    explicit = F.regexp_extract(raw, r"NO_PROGRESS_CAUSE\s+code=([a-z_]+)", 1)
    guards = [(raw.contains(f"SKIP {g}"), g) for g in ("active_guard", "load_guard", "mem_guard", "disk_guard", "proposal_guard")]
    return first_reason(
        (explicit != "", explicit), *guards,
        (raw.contains("Promotion gate is ready") | raw.contains("pausing exploration"), "promotion_pause"),
        (raw.contains("promotion action required") | raw.contains("Run linked seed-repeat LOO"), "promotion_evidence_required"),
        (raw.contains("No novel one-change proposals remain"), "signature_exhausted"),
        (raw.contains("deduped"), "deduped_existing_run"),
        (F.lower(raw).contains("timeout") | raw.contains("exit_code=124"), "timeout"),
        (raw.contains("QUALITY_SKIP no new run produced") | raw.contains("STALE cycle produced no new run"), "unknown_no_progress"),
    )


def classify_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with a cause: code, label and leading timestamp. Stateless, so it runs on streams too."""
    stamp = F.regexp_extract(F.trim(F.col(line)), r"^\[?([0-9]{4}-[0-9]{2}-[0-9]{2}T[^\]\s]+)", 1)
    out = lines.withColumns({"code": cause_code(F.col(line)), "timestamp": F.nullif(stamp, F.lit(""))}).filter("code IS NOT NULL")
    label = F.create_map(*[F.lit(x) for kv in CAUSES.items() for x in kv])[F.col("code")]
    return out.withColumn("cause", F.coalesce(label, F.col("code")))


def cause_counts(classified: DataFrame) -> DataFrame:
    """Running count and latest timestamp per cause."""
    return classified.groupBy("code").agg(F.count(F.lit(1)).alias("lines"), F.max("timestamp").alias("latest"))


def loo_progress(rows: DataFrame, by: list[str], total: int) -> DataFrame:
    """Completed, failed and remaining tasks as rows arrive."""
    failed = F.coalesce(F.col("returncode"), F.lit(0)) != 0
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("completed"), F.count_if(failed).alias("failed"))
    return agg.withColumns({"total": F.lit(total), "remaining": F.lit(total) - F.col("completed")})


def job_state(events: DataFrame, now: Column) -> DataFrame:
    """Latest event per job with its attempts and whether it can be leased at ``now``."""
    latest = F.max_by(F.struct("status", "lease_expires_at", "worker_id", "event_at"), F.struct("event_at", "event_id"))
    jobs = events.groupBy("job_id").agg(latest.alias("e"), F.min("created_at").alias("created_at"), F.count_if(F.col("status") == "leased").alias("attempts"))
    leasable = (F.col("e.status") == "queued") | ((F.col("e.status") == "leased") & (F.col("e.lease_expires_at") <= now))
    return jobs.select("job_id", "created_at", "attempts", F.col("e.status").alias("status"), F.col("e.lease_expires_at").alias("lease_expires_at"),
                       F.coalesce(leasable, F.lit(False)).alias("leasable"))


def next_jobs(state: DataFrame, n: int) -> DataFrame:
    """First leasable jobs by creation time and id."""
    return state.filter("leasable").orderBy("created_at", "job_id").limit(n)


def stream_dedupe(stream: DataFrame, key: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """First config per key; the watermark only bounds the state."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def dedupe_batch(df: DataFrame, key: str, event_time: str, tie: str) -> DataFrame:
    """Batch form of the dedupe: earliest row per key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(event_time, tie)).alias("r")).select(key, "r.*").select(*df.columns)


#: Batches whose counts are put together into a new base.
COMPACT = 16


def dice_deltas(batch: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Counts that one batch adds: a row per group seen in it."""
    return stream_dice(batch, threshold, by).drop("dice")


class DiceState:
    """Dice counts of a stream as a base and the deltas of the batches after it, all read through their commits.

    A batch writes only the groups it touched and is committed by its number; a number that is committed already is left
    alone, so running a batch again changes nothing. Every ``compact`` batches base and deltas are summed into a new base. The
    state can be read at any time: a reader sees the commits that are complete.
    """

    def __init__(self, path: str, threshold: float, by: list[str], compact: int = COMPACT) -> None:
        self.path, self.threshold, self.by, self.compact = path.rstrip("/"), threshold, by, compact

    def _bases(self) -> str:
        return f"{self.path}/base"

    def _deltas(self) -> str:
        return f"{self.path}/deltas"

    def _pending(self, spark: SparkSession) -> tuple[Row | None, list[Row]]:
        """The last base and the commits after it, one for each batch."""
        base = versions.last_commit(spark, self._bases())
        later = versions.commits(spark, self._deltas()).filter(F.col("covers") > (base["covers"] if base else -1))
        each = later.groupBy("covers").agg(F.min_by("folder", "version").alias("folder"))
        # at most as many rows as batches since the last base
        return base, each.orderBy("covers").collect()

    def counts(self, spark: SparkSession) -> DataFrame | None:
        base, later = self._pending(spark)
        folders = ([base["folder"]] if base else []) + [row["folder"] for row in later]
        if not folders:
            return None
        rows = spark.read.parquet(*[f"{f}/counts" for f in folders])
        return rows.groupBy(*self.by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])

    def read(self, spark: SparkSession) -> DataFrame:
        """Counts and Dice of every group as far as batches are committed."""
        rows = self.counts(spark)
        if rows is None:
            raise FileNotFoundError(f"no batch committed below {self.path}")
        return rows.withColumn("dice", dice_value(F.col("tp"), F.col("fp"), F.col("fn")))

    def add(self, batch: DataFrame, number: int) -> None:
        """Fold one batch in, unless its number is committed."""
        spark = batch.sparkSession
        base, later = self._pending(spark)
        if (base and base["covers"] >= number) or any(row["covers"] == number for row in later):
            return
        save = lambda d, p: d.write.parquet(p)
        folder = versions.stage({"counts": (dice_deltas(batch, self.threshold, self.by), save)}, self._deltas())
        versions.commit(spark, self._deltas(), folder, ["counts"], number)
        if len(later) + 1 >= self.compact:
            folder = versions.stage({"counts": (self.counts(spark), save)}, self._bases())
            versions.commit(spark, self._bases(), folder, ["counts"], number)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Fold the files present in, batch by batch."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, path: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Drive a stream over the files present into parquet below ``path``.

    Complete mode keeps the latest full state; append mode keeps one folder per batch, so a
    batch that is run again replaces its own rows. Executors write the rows.
    """

    def save(batch: DataFrame, number: int) -> None:
        target = f"{path}/state" if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    return (df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
