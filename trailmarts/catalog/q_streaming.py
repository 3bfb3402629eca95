"""Streaming jobs run over the given tables as streams."""

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import records_b
from ..session import fresh_dir
from ..sources.files import clear_folder
from ..streaming import jobs
from .q_rollouts import lines_b
from .q_transcripts import otlp_lines
from .registry import Tables, query


class Streamed(Tables):
    """The role views with one table read as a stream of several slices, one to a batch.

    ``place`` is a number along which the slices are cut; each slice has the same
    number of files, by the rows of the smallest, so large ones are written and read by many tasks. ``late`` sends every
    tenth row a slice after its neighbours, and the second slice before the first. ``closing`` adds a last row far in the
    future that lets the watermark pass everything before it.
    """

    SLICES = 4
    FILE_ROWS = 1 << 18

    def __init__(self, t: Tables, table: str, place: str, late: bool = True, closing: dict | None = None):
        super().__init__(t.spark, t.folder)
        self.table = table
        batch = super().raw(table)
        self.schema, self.parts = batch.schema, fresh_dir(t.spark, f"stream-{table}")
        at = F.expr(place)
        ends = batch.agg(F.min(at).alias("low"), F.max(at).alias("top"))
        low, top = (F.lit(x).cast(ends.schema[0].dataType) for x in ends.first())
        at = F.coalesce(at, low)
        n = F.floor((at - low) * self.SLICES / (top - low + 1))
        if late:
            n = F.least(n + (at % 10 == 7).cast("int"), F.lit(self.SLICES - 1))
        sliced = batch.withColumn("slice", n)
        with jobs.settings(t.spark, jobs.LEAN):
            sizes = [r["count"] for r in sliced.groupBy("slice").count().collect()]  # a row a slice
            self.files = max(min(sizes) // self.FILE_ROWS, 1) if len(sizes) == self.SLICES else 1
            for i in (1, 0, 2, 3) if late else range(self.SLICES):
                part = sliced.where(F.col("slice") == i).drop("slice")
                (part.repartition(self.files) if self.files > 1 else part.coalesce(1)).write.mode("append").parquet(self.parts)
        if closing:
            last = batch.limit(1).select(*(F.lit(closing[c]).cast(batch.schema[c].dataType).alias(c) if c in closing else F.col(c) for c in batch.columns))
            last.write.mode("append").parquet(self.parts)

    def raw(self, name):
        if name != self.table:
            return super().raw(name)
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.parts)

    def clear(self) -> None:
        """Take away the slices, once the stream has read them."""
        clear_folder(self.parts)


TIME = "unix_millis(CAST(ts AS TIMESTAMP))"  # ids need not follow the times by which streams drop rows


def run(stream, folder, mode="append", rocksdb=False):
    """The rows of a job, which must have taken several batches; some may have written none. It is not run again, so its checkpoint goes."""
    if len(jobs.run_available(stream, folder, mode, rocksdb)) < 3:
        raise ValueError("the stream took fewer than three batches")
    clear_folder(f"{folder}/checkpoint")
    return jobs.output(stream.sparkSession, folder)


@query("stream_message_dedup", "SELECT session, thread, message_id, line, model, input_tokens, output_tokens FROM messages", "messages")
def _(t):
    folder = fresh_dir(t.spark, "dedup")
    # Rows come up to half of the dates late; the state of earlier days is dropped on the way.
    place = "unix_date(CAST(l_shipdate AS DATE))"
    days = t.raw("lineitem").agg(F.expr(f"max({place}) - min({place})")).first()[0] or 0
    slices = Streamed(t, "lineitem", place)
    rows = run(jobs.message_updates(slices.snapshots, f"{days // 2 + 30} days"), folder, "update", rocksdb=True)
    slices.clear()
    keys = ["session", "thread", "message_id"]
    days = jobs.latest_per_key(rows.repartition(*keys), [*keys, "day_ms"])  # one shuffle for the days and the messages
    return jobs.merged_messages(days).select(*keys, "line", "model", "input_tokens", "output_tokens")


@query(
    "stream_telemetry",
    """SELECT session, ts_ms - ts_ms % 86400000 AS window_ms, count(*) FILTER (event_type = 'view') AS requests, CAST(sum(k * 0.5) FILTER (event_type = 'view' AND k % 4 <> 0) AS DOUBLE) AS cost_usd,
       count(*) FILTER (event_type = 'click') AS decisions, CAST(sum(k * 2) FILTER (event_type = 'view') AS DOUBLE) AS duration_sum FROM ev WHERE event_type IN ('view', 'click', 'signup') GROUP BY ALL""",
    "ev",
)
def _(t):
    folder = fresh_dir(t.spark, "telemetry")
    rows = run(jobs.telemetry_windows(otlp_lines(Streamed(t, "events", TIME)), "1 day", "20 days"), folder, "update")
    return jobs.latest_per_key(rows, ["session", "window_ms"]).drop("batch")


@query(
    "stream_live_periods",
    """SELECT session, min(ts_ms) AS start_ms, max(ts_ms) + 7200000 AS end_ms, count(*) AS events FROM (
       SELECT *, sum(CASE WHEN p IS NULL OR ts_ms - p > 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY line) AS n FROM (
         SELECT session, line, ts_ms, lag(ts_ms) OVER (PARTITION BY session ORDER BY line) AS p FROM ev) x) y GROUP BY session, n""",
    "ev",
)
def _(t):
    folder = fresh_dir(t.spark, "live")
    closing = {"ts": datetime(2100, 1, 1), "user_id": -1}
    jobs.run_available(jobs.live_periods(Streamed(t, "events", TIME, closing=closing).ev, "2 hours", "20 days"), folder, "append")
    return jobs.output(t.spark, folder).where("session <> 's-1'").drop("batch")


@query(
    "stream_counter_deltas",
    """SELECT session, line, k * 12 AS fresh_tokens, k * 2 AS output_tokens, k * 11 AS context_tokens FROM (
       SELECT session, event_id * 2 + 2 AS line, k, lag(k) OVER (PARTITION BY session ORDER BY event_id) AS pk FROM ev WHERE event_type = 'view') c WHERE pk IS NULL OR pk <> k""",
    "ev",
)
def _(t):
    folder = fresh_dir(t.spark, "counters")
    closing = {"ts": datetime(2100, 1, 1), "user_id": -1, "event_type": "view"}
    rows = lines_b(Streamed(t, "events", TIME, closing=closing), headers=False)
    return run(jobs.counter_deltas(records_b.records(rows), "20 days"), folder, rocksdb=True).where("session <> 's-1'").drop("batch")
