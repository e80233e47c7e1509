"""Stream queries, and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.sources.tables import settled, shared_dir, table
from foliant.streaming import keyed, throttle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


def stream(spark, d):
    """The events table as a file stream."""
    where = f"{d}/events.parquet"
    schema = spark.read.parquet(where).schema
    return spark.readStream.schema(schema).parquet(f"{d}/*events.parquet")


def drained(spark, frame, mode: str = "append"):
    """Runs a stream over what there is, into a table in the shared folder."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = frame.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return settled(spark.read.schema(frame.schema).parquet(f"{root}/out"), root)


def drained_updates(spark, frame, keys: list[str]):
    """Like it for an aggregate: what changed in each batch goes to the folder, and the last state of each key is read back. Nothing is held in the driver."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(changed, batch: int) -> None:
        changed.withColumn("__batch", F.lit(batch)).write.mode("append").parquet(f"{root}/out")

    q = frame.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in frame.columns if c not in keys]
    kept = spark.read.parquet(f"{root}/out").groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("last")).select(*keys, "last.*")
    return settled(kept, root)


def _at(spark, d):
    return stream(spark, d).withColumn("at", F.col("ts").cast("timestamp"))


@query("""WITH r AS (SELECT user_id * 100 + day(ts) AS batch_id, hour(ts) AS run, bool_or(event_type IN ('purchase', 'error')) AS ended, max(ts) AS last, any_value(1 + user_id % 4) AS expected FROM events GROUP BY ALL),
b AS (SELECT batch_id, count(*) AS runs, count(*) FILTER (NOT ended) AS open, max(epoch_ms(last)) AS last, any_value(expected) AS expected FROM r GROUP BY batch_id)
SELECT batch_id, CASE WHEN runs >= expected AND open = 0 THEN 'complete' ELSE 'overdue' END AS notice, runs, open FROM b WHERE (runs >= expected AND open = 0) OR last + 86400000 < (SELECT max(epoch_ms(ts)) - 3600000 FROM events)""")
def completion_notices(spark, d):
    """A user's day is a batch, its hours are runs, which end with a purchase or an error. One notice when all that were expected have ended, or when nothing is heard for a day."""
    at = _at(spark, d)
    rows = at.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("batch_id"), F.hour("ts").cast("long").alias("run_id"), F.col("event_type").isin("purchase", "error").alias("ended"), (F.col("user_id") % 4 + 1).alias("expected"), "at")
    with keyed.state_with_timers(spark):
        return drained(spark, keyed.completed_once(rows, patience_seconds=86_400, keep_seconds=7 * 86_400))


@query("""SELECT user_id AS run_id, unnest(s.kept) AS token FROM (SELECT user_id, list_reduce(list_prepend({'ms': -21600000, 'token': 0::BIGINT, 'kept': []::BIGINT[]}, list({'ms': epoch_ms(ts), 'token': event_id, 'kept': []::BIGINT[]} ORDER BY epoch_ms(ts), event_id)),
 lambda x, y: CASE WHEN y.ms >= x.ms + 21600000 THEN {'ms': y.ms, 'token': y.token, 'kept': list_append(x.kept, y.token)} ELSE x END) AS s FROM events GROUP BY user_id)""")
def handed_in_again(spark, d):
    """Tokens that may go to the queue: one a user in six hours."""
    rows = _at(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("token"), "at")
    with keyed.state_with_timers(spark):
        return drained(spark, keyed.once_per_spell(rows, 6 * 3600)).drop("ms")


@query("SELECT user_id, event_id AS token, row_number() OVER (PARTITION BY user_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) ORDER BY epoch_ms(ts), event_id) <= 2 AS allowed FROM events")
def daily_quota_stream(spark, d):
    """Two hits a user and day of New York, whichever batch they come in."""
    rows = _at(spark, d).select("user_id", F.col("event_id").alias("token"), "at")
    with keyed.state_with_timers(spark):
        return drained(spark, keyed.daily_quota(rows, 2, "America/New_York"))


@query("SELECT user_id, max(n) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY user_id")
def throttle_sliding(spark, d):
    """An upper bound of the sliding throttle's load: refused hits count too."""
    rows = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, 0))
    return rows.select("user_id", n.alias("n")).groupBy("user_id").agg(F.max("n").alias("most"))


@query("""SELECT user_id, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s""")
def session_idle(spark, d):
    """Sessions end after 30 idle minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    at = table(spark, d, "events").withColumn("fresh", F.when(gap <= F.expr("INTERVAL 30 MINUTE"), 0).otherwise(1)).withColumn("s", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts")).drop("s")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Tumbling windows over the stream; the watermark lets old ones go from the state."""
    rows = stream(spark, d).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "60 days")
    out = rows.groupBy("event_type", F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    last = drained_updates(spark, out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total")), ["event_type", "hour"])
    return last.select("event_type", "hour", "n", "total")


def _hits(state: str) -> str:
    """A user's hits by the second, in order, behind a first state for a fold; hits carry the state's other fields empty."""
    return f"list_prepend({{'at': -3600::BIGINT, {state}}}, list({{'at': floor(epoch(ts))::BIGINT, {state}}} ORDER BY floor(epoch(ts))))"


@query(f"""SELECT user_id, s.allowed AS allowed, s.refused AS refused FROM (SELECT user_id, list_reduce({_hits("'used': 0::BIGINT, 'allowed': 0::BIGINT, 'refused': 0::BIGINT")}, lambda x, y: CASE WHEN y.at >= x.at + 3600 THEN {{'at': y.at, 'used': 1, 'allowed': x.allowed + 1, 'refused': x.refused}}
 WHEN x.used < 5 THEN {{'at': x.at, 'used': x.used + 1, 'allowed': x.allowed + 1, 'refused': x.refused}} ELSE {{'at': x.at, 'used': x.used + 1, 'allowed': x.allowed, 'refused': x.refused + 1}} END) AS s FROM events GROUP BY user_id)""")
def throttle_fixed_from_first_hit(spark, d):
    return drained(spark, throttle.fixed_from_first_hit(stream(spark, d), 5, 3600))


@query(f"""SELECT user_id, s.allowed AS allowed, s.refused AS refused FROM (SELECT user_id, list_reduce({_hits("'held': []::BIGINT[], 'allowed': 0::BIGINT, 'refused': 0::BIGINT")}, lambda x, y: CASE WHEN len(list_filter(x.held, lambda h: h > y.at - 3600)) < 5
 THEN {{'at': y.at, 'held': list_append(list_filter(x.held, lambda h: h > y.at - 3600), y.at), 'allowed': x.allowed + 1, 'refused': x.refused}} ELSE {{'at': y.at, 'held': list_filter(x.held, lambda h: h > y.at - 3600), 'allowed': x.allowed, 'refused': x.refused + 1}} END) AS s FROM events GROUP BY user_id)""")
def throttle_sliding_stateful(spark, d):
    return drained(spark, throttle.sliding(stream(spark, d), 5, 3600))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS tokens FROM events")
def dedupe_tokens(spark, d):
    return drained(spark, throttle.once_per_token(stream(spark, d)).select("event_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("tokens"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 13")
def dead_letter_after_n(spark, d):
    """The delivery of a token that is one too many goes to the dead letters; the counter is state and lives on from batch to batch."""
    return drained(spark, throttle.dead_letters(stream(spark, d), 12))


@query("SELECT count(*) AS first_run, 0 AS second_run FROM events")
def ack_and_restart(spark, d):
    """What is written is acknowledged with its offsets: a second run from the same checkpoint reads nothing again."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for run in ("a", "b"):
        q = stream(spark, d).select("event_id").writeStream.format("parquet").option("path", f"{root}/{run}").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    written = lambda run, name: spark.read.schema("event_id long").parquet(f"{root}/{run}").agg(F.count(F.lit(1)).alias(name))
    try:
        second = written("b", "second_run")
    except AnalysisException as e:  # a run that had nothing to write makes no folder
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        second = table(spark, d, "events").filter("false").agg(F.count(F.lit(1)).alias("second_run"))
    return settled(written("a", "first_run").join(second, F.lit(True)), root)


@query("SELECT user_id AS run_id, min(ts) AS handed_in, count(*) AS events FROM events GROUP BY user_id")
def produce_and_consume(spark, d):
    """Work tokens written to a queue folder by one stream and read by another."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream(spark, d).select(F.col("user_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")).writeStream.format("json").option("path", f"{root}/queue").option("checkpointLocation", f"{root}/producer").trigger(availableNow=True).start()
    q.awaitTermination()
    tokens = spark.readStream.schema("run_id long, ts long").json(f"{root}/queue")
    q = tokens.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/consumer").trigger(availableNow=True).start()
    q.awaitTermination()
    taken = spark.read.schema("run_id long, ts long").parquet(f"{root}/out")
    return settled(taken.groupBy("run_id").agg(F.timestamp_micros(F.min("ts")).cast("timestamp_ntz").alias("handed_in"), F.count(F.lit(1)).alias("events")), root)
