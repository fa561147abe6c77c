"""Streams that are drained, and sources that are read, as queries beside their SQL; captures are made of the tables' rows."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import filters
from siltstone.operators import progress as blocks
from siltstone.plans.queries import query, read
from siltstone.sources.captures import numbered_lines
from siltstone.sources.samples import read_samples
from siltstone.sources.services import file_transport, read_services
from siltstone.sources.shared import shared_folder
from siltstone.sources.walk import local_listing, walk
from siltstone.streaming import counters, due, outbox, progress

PROGRESS_SQL = """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN floor(value * 1000000) / 1000000 / 120 END AS share, CAST(event_id % 60 AS DOUBLE) AS fps, (event_id % 4) / 2.0::DOUBLE AS speed, event_type = 'purchase' AS done,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT *, least(greatest(share, 0.0), 0.999) AS p FROM e),
r AS (
  SELECT user_id, event_id, n, fps, speed, done, share, coalesce(p, 0.0) AS high, p > 0 AS kept, CASE WHEN p > 0 THEN p END AS last FROM s WHERE n = 1
  UNION ALL
  SELECT s.user_id, s.event_id, s.n, s.fps, s.speed, s.done, s.share, greatest(r.h, coalesce(s.p, 0.0)),
    s.p IS NOT NULL AND CASE WHEN r.l IS NULL THEN greatest(r.h, s.p) > 0 ELSE greatest(r.h, s.p) >= r.l + 0.01 END,
    CASE WHEN s.p IS NOT NULL AND CASE WHEN r.l IS NULL THEN greatest(r.h, s.p) > 0 ELSE greatest(r.h, s.p) >= r.l + 0.01 END THEN greatest(r.h, s.p) ELSE r.l END
  FROM (SELECT *, CASE WHEN done THEN 0.0 ELSE high END AS h, CASE WHEN NOT done THEN last END AS l FROM r) r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id AS job_id, event_id, high AS progress, fps, speed, CASE WHEN speed > 0 THEN (120.0 - high * 120.0) / speed END AS remaining, kept FROM r WHERE share IS NOT NULL
"""

#: Numbers of lines by which a job is split: what one task holds of a job at most, far more than most jobs have of a stretch,
#: as each piece of a job is a row that is grouped, carried and joined back.
STRETCH = 1 << 20
#: Text that a task writes to a capture, on average.
CAPTURED_BYTES = 64 << 20


def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a transcode writes them, a block an event: elapsed time (not in every block), rate, speed, progress."""
    event = F.col("event_id")
    texts = F.array(
        F.when(event % 7 != 0, F.concat(F.lit("out_time_us="), F.floor(F.col("value") * 1_000_000).cast("string"))).otherwise("frame=1"),
        F.concat(F.lit("fps="), (event % 60).cast("string")),
        F.concat(F.lit("speed="), (event % 4 / 2).cast("string"), F.lit("x")),
        F.concat(F.lit("progress="), F.when(F.col("event_type") == "purchase", "end").otherwise("continue")),
    )
    lines = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), event, F.posexplode(texts).alias("k", "line"))
    return lines.select("job_id", (event * 4 + F.col("k")).alias("line_no"), "line", F.lit(120.0).alias("duration"))


@query(PROGRESS_SQL)
def progress_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of jobs from their lines, as a batch; a job is split by stretches of its lines."""
    piece = F.floor(F.col("line_no") / STRETCH)
    found = blocks.live(blocks.blocks(progress_lines(spark, sf_dir), piece), piece)
    return found.select("job_id", F.floor(F.col("line_no") / 4).alias("event_id"), "progress", "fps", "speed", "remaining", "kept")


@query(PROGRESS_SQL)
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream with state: three deliveries of lines, after each of which the stream is drained and stopped."""
    lines, most = progress_lines(spark, sf_dir), read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    delivered, state, out = (shared_folder(spark, f"progress-{x}") for x in ("lines", "state", "found"))
    for k in range(3):
        part = F.col("line_no") * 3 / ((most + 1) * 4)
        lines.where((part >= k) & (part < k + 1)).write.mode("append").parquet(delivered)
        progress.drain(progress.live_progress(spark.readStream.schema(lines.schema).parquet(delivered)), state, progress.into(out))
    found = spark.read.parquet(out)
    return found.select("job_id", F.floor(F.col("line_no") / 4).alias("event_id"), "progress", "fps", "speed", "remaining", "kept")


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25 OFFSET (SELECT CAST(floor(count(*) / 50) * 25 AS BIGINT) FROM lineitem)
""")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the middle of all lines by price; no task holds the pages before."""
    lines = read(spark, sf_dir, "lineitem")
    order = [("l_extendedprice", False), ("l_orderkey", True), ("l_linenumber", True), ("l_partkey", True)]
    return filters.deep_page(lines, order, lines.count() // 50 + 1, 25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(r"""
WITH l AS (SELECT coalesce(lang, '') AS grp, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY doc_id, k) AS BIGINT) AS line_no, md5(regexp_replace(line, '\r$', '')) AS line FROM l
""".replace("\\\\", "\\"))
def captured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of captures with their numbers; a capture a language, rolled over as it grows, read in as many splits as it takes."""
    folder = shared_folder(spark, "captures")
    grp, text = F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))
    texts = read(spark, sf_dir, "documents").select(F.concat(F.lit("x"), F.hex(grp)).alias("grp"), "doc_id", text.alias("value"))  # hex: any name is a folder's
    parts = (texts.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0) // CAPTURED_BYTES + 1
    texts.repartitionByRange(parts, "grp", "doc_id").sortWithinPartitions("grp", "doc_id").select("grp", "value").write.partitionBy("grp").text(folder)
    found = numbered_lines(spark, folder, "part-*", rolled=True)
    return found.select(F.unhex(F.regexp_extract("path", "grp=x([^/]*)/", 1)).cast("string").alias("grp"), "line_no", F.md5("line").alias("line"))


@query("""
SELECT n_name AS connection, CASE WHEN n_nationkey % 6 = 5 THEN 1 ELSE greatest(1, CAST(ceil(count(c_custkey) / 200.0) AS INTEGER)) END AS pages, CASE WHEN n_nationkey % 6 = 5 THEN 0 ELSE count(c_custkey) END AS records,
  CASE WHEN n_nationkey % 6 <> 5 THEN count(*) FILTER (c_acctbal > 0) ELSE 0 END AS importing, n_nationkey % 6 = 5 AS failed
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3) GROUP BY n_name, n_nationkey
""")
def service_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues of services, a connection a nation, pulled in pages of 200; some do not answer, which takes nothing from others."""
    folder, nation = shared_folder(spark, "answers"), read(spark, sf_dir, "nation")
    known = nation.where("n_nationkey % 6 <> 5").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("connection"))
    customer = read(spark, sf_dir, "customer").join(known, "c_nationkey")
    place = F.row_number().over(Window.partitionBy("connection").orderBy("c_custkey"))
    record = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 0, "importing").otherwise("queued").alias("trackedDownloadState"))
    paged = customer.withColumn("page", F.floor((place - 1) / 200) + 1).groupBy("connection", "page").agg(F.sort_array(F.collect_list(record)).alias("records"))
    totals = customer.groupBy("connection").agg(F.count("*").alias("totalRecords"))
    empty = known.join(totals, "connection", "left_anti").select("connection", F.lit(1).cast("long").alias("page"), F.lit('{"totalRecords":0,"records":[]}').alias("value"))
    answers = paged.join(totals, "connection").select("connection", "page", F.to_json(F.struct("page", "totalRecords", "records")).alias("value"))
    answers.unionByName(empty).repartition("connection", "page").write.partitionBy("connection", "page").text(folder)
    names = [r[0] for r in nation.where("n_regionkey in (1, 3)").select("n_name").collect()]
    body = F.from_json("body", "totalRecords long, records array<struct<id: long, title: string, trackedDownloadState: string>>")
    pulled = read_services(spark, file_transport(folder), names).withColumn("records", body["records"])
    busy = F.size(F.filter("records", lambda r: r["trackedDownloadState"] == "importing"))
    return pulled.groupBy("connection").agg(
        F.count("*").cast("int").alias("pages"), F.sum(F.when(F.col("records").isNotNull(), F.size("records")).otherwise(0)).alias("records"), F.sum(F.when(F.col("records").isNotNull(), busy).otherwise(0)).alias("importing"), F.max(F.col("error").isNotNull()).alias("failed")
    )


@query("""
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS counter, CAST(event_id AS DOUBLE) AS "at", CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE floor(event_id * 0.37::DOUBLE) END AS value FROM events),
d AS (SELECT counter, "at", value - lag(value) OVER w AS dv, "at" - lag("at") OVER w AS dt FROM s WINDOW w AS (PARTITION BY counter ORDER BY "at"))
SELECT counter, "at", CAST(least(100.0, greatest(0.0, dv / dt * 100)) AS DOUBLE) AS percent FROM d WHERE dt IS NOT NULL
""")
def sampled_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utilisation from a source of samples: six ticks in three deliveries, the stream started anew for each."""
    events = read(spark, sf_dir, "events")
    most = events.agg(F.max("event_id")).first()[0] or 0
    event = F.col("event_id")
    sample = F.struct(F.col("user_id").cast("string").alias("counter"), event.cast("double").alias("at"), F.when(event % 97 == 0, 0.0).otherwise(F.floor(event * F.lit(0.37)).cast("double")).alias("value"))
    ticks = events.select(F.floor(event * 6 / (most + 1)).alias("tick"), F.to_json(sample).alias("line"))
    captured, state, out = (shared_folder(spark, f"samples-{x}") for x in ("captured", "state", "found"))
    for k in range(3):
        ticks.where(F.floor(F.col("tick") / 2) == k).write.mode("append").partitionBy("tick").text(captured)
        progress.drain(counters.utilisation_stream(read_samples(spark, captured)), state, progress.into(out))
    return spark.read.parquet(out).select("counter", "at", "percent")


def _written(folder: str):
    """A recipient that writes what it takes, and takes nothing the first time that it is asked for some of the statuses.

    Each task has a copy of it, which adds what it takes to a file of its own.
    """
    own = None

    def send(messages: list[dict]) -> None:
        nonlocal own
        base = Path(folder.removeprefix("file://"))
        base.mkdir(parents=True, exist_ok=True)
        refused = base / "refused"
        if any(m["o_orderstatus"] == "P" for m in messages) and not refused.exists():
            refused.touch()
            raise ConnectionError("busy")
        own = own or base / f"{uuid.uuid4().hex}.json"
        with own.open("a") as file:
            file.write("".join(json.dumps(m) + "\n" for m in messages))

    return send


@query("""
SELECT o_orderstatus, count(*) AS taken, count(*) AS changes FROM orders GROUP BY o_orderstatus
""")
def pushed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of jobs pushed by a stream whose recipient fails once, so that its batch is repeated; each is taken once."""
    changes, state, taken, known = (shared_folder(spark, f"push-{x}") for x in ("changes", "state", "taken", "known"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for k in range(2):  # the second delivery repeats a part of the first
        rows.where(F.col("o_orderkey") % 3 >= k).write.mode("append").parquet(changes)
        if k == 0:
            rows.where(F.col("o_orderkey") % 3 == 0).write.mode("append").parquet(changes)
        stream = spark.readStream.schema(rows.schema).parquet(changes)
        try:
            progress.drain(stream, state, outbox.outbox(known, _written(taken), 50))
        except Exception as failure:  # noqa: BLE001  the recipient was busy: the same batch again
            if "were not taken" not in str(failure):
                raise
            progress.drain(stream, state, outbox.outbox(known, _written(taken), 50))
    got = spark.read.schema("key string, o_orderkey long, o_orderstatus string").option("pathGlobFilter", "*.json").json(taken)
    return got.groupBy("o_orderstatus").agg(F.count("*").alias("taken"), F.count_distinct("key").alias("changes"))


@query("""
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, (event_id + 1000) * 1000 AS seen, (event_id + 1000 + event_id % 40 * 20) * 1000 + 500 AS due FROM events),
n AS (SELECT *, coalesce(lead(seen) OVER (PARTITION BY session_id ORDER BY seen), max(seen) OVER ()) AS until FROM s)
SELECT session_id, due AS expired_ms FROM n WHERE due <= until
""")
def expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end by themselves unless they are renewed in time; the rows drive the clock, in three deliveries."""
    events = read(spark, sf_dir, "events")
    most, event = events.agg(F.max("event_id")).first()[0] or 0, F.col("event_id")
    sessions = events.select(F.col("user_id").cast("string").alias("session_id"), F.timestamp_seconds(event + 1000).alias("seen_at"), F.timestamp_millis((event + 1000 + event % 40 * 20) * 1000 + 500).alias("expires_at"))
    told, state, out = (shared_folder(spark, f"sessions-{x}") for x in ("told", "state", "found"))
    for k in range(3):
        part = (F.unix_seconds("seen_at") - 1000) * 3 / (most + 1)
        sessions.where((part >= k) & (part < k + 1)).write.mode("append").parquet(told)
        progress.drain(due.expired_sessions(spark.readStream.schema(sessions.schema).parquet(told)), state, progress.into(out))
    return spark.read.parquet(out).select("session_id", F.unix_millis("expires_at").alias("expired_ms"))


@query("""
WITH d AS (SELECT DISTINCT o_orderstatus AS a, o_custkey % 7 AS b FROM orders)
SELECT 0 AS level, count(DISTINCT a) AS folders, 0 AS files, 0 AS failed FROM d
UNION ALL SELECT 1, count(*), 0, 0 FROM d
UNION ALL SELECT 2, 0, count(*) FILTER (b <> 3), count(*) FILTER (b = 3) FROM d
""")
def walked_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over folders of which some can't be listed; what it found on each level."""
    folder = shared_folder(spark, "walked").removeprefix("file://")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("a"), (F.col("o_custkey") % 7).alias("b"), F.col("o_orderkey").cast("string").alias("value"))
    rows.repartition("a", "b").write.partitionBy("a", "b").text(f"file://{folder}")

    def listing(path: str):
        if path.endswith("b=3"):
            raise PermissionError(path)
        return [entry for entry in local_listing(path) if not entry[0].startswith((".", "_"))]

    found = walk(spark, folder, listing)
    is_folder, failed = F.col("is_folder"), F.col("error").isNotNull()
    return found.groupBy("level").agg(F.count_if(is_folder & ~failed).alias("folders"), F.count_if(~is_folder).alias("files"), F.count_if(failed).alias("failed"))
