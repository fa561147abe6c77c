"""Further operators as queries beside their SQL: positions, roll-ups, stateful scans, gates, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import media
from siltstone.functions import scalars as S
from siltstone.operators import decisions, joins, sequences
from siltstone.plans.queries import cents, query, read


@query("""
WITH l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(CASE WHEN l_discount > 0.08 THEN 'X' ELSE l_returnflag END ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(a) AS tracks, CAST(coalesce(list_position(list_transform(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i]), TRUE) - 1, -1) AS BIGINT) AS first_difference FROM l
""")
def positional_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and found lists compared place by place."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("a"), F.when(F.col("l_discount") > 0.08, "X").otherwise(F.col("l_returnflag")).alias("b"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    at = joins.first_difference(F.col("x.a"), F.col("x.b"))
    return rows.select("l_orderkey", F.size("x").cast("long").alias("tracks"), F.coalesce(at, F.lit(-1)).cast("long").alias("first_difference"))


@query("""
SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) AS active, CAST(coalesce(sum(CASE WHEN c_acctbal > 0 THEN 1 + c_custkey % 3 END), 0) AS BIGINT) AS sessions,
  coalesce(string_agg(DISTINCT CASE WHEN c_acctbal > 0 THEN c_mktsegment END, ', ' ORDER BY CASE WHEN c_acctbal > 0 THEN c_mktsegment END), '') AS names
FROM customer GROUP BY c_nationkey
""")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active services, their sessions and names."""
    active = F.col("c_acctbal") > 0
    names = F.array_join(F.array_sort(F.collect_set(F.when(active, F.col("c_mktsegment")))), ", ")
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(active).alias("active"), F.coalesce(F.sum(F.when(active, 1 + F.col("c_custkey") % 3)), F.lit(0)).alias("sessions"), names.alias("names"))


@query("""
SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1000 ELSE least(greatest(CAST(o_orderkey % 1500 AS BIGINT) - 200, 0), 1000) END) AS DOUBLE) / count(*) / 1000 AS progress FROM orders GROUP BY o_custkey
""")
def average_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of progress in thousandths, completed as all of it, each within bounds."""
    share = F.when(F.col("o_orderstatus") == "F", F.lit(1000).cast("long")).otherwise(S.clamp(F.col("o_orderkey") % 1500 - 200, 0, 1000))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.sum(share).cast("double") / F.count("*") / 1000).alias("progress"))


@query("""
WITH s AS (SELECT user_id, event_type, sum(CAST(floor(value) AS BIGINT) % 7) AS v FROM events GROUP BY 1, 2)
SELECT user_id, max_by(event_type, (v, event_type)) AS event_type, CAST(greatest(0.0, least(100.0, CAST(max(v) AS DOUBLE))) AS DOUBLE) AS value FROM s GROUP BY user_id
""")
def busiest_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "events").select("user_id", "event_type", (F.floor("value") % 7).alias("value"))
    return decisions.busiest(samples, "user_id", "event_type", "value")


@query("""
SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) - min(CAST(round(s_acctbal * 100) AS BIGINT)) OVER (PARTITION BY s_nationkey) AS above_least FROM supplier
""")
def least_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value as its distance from the least of its group."""
    value = cents("s_acctbal")
    return read(spark, sf_dir, "supplier").select("s_suppkey", (value - F.min(value).over(Window.partitionBy("s_nationkey"))).alias("above_least"))


@query("""
WITH f AS (SELECT user_id, event_id, value, event_type = 'view' AS k, row_number() OVER (PARTITION BY user_id ORDER BY events.ts, event_id) AS n FROM events)
SELECT user_id, CASE WHEN max_by(value, n) FILTER (k AND value <= 50) IS NOT NULL AND min_by(value, n) FILTER (value >= 50) IS NOT NULL
  THEN greatest(0.0, min_by(value, n) FILTER (value >= 50) - max_by(value, n) FILTER (k AND value <= 50)) END AS "offset" FROM f GROUP BY user_id
""")
def keyframe_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame at or after a time less the last key frame up to it, in file order."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    frames = read(spark, sf_dir, "events").select("user_id", n.alias("frame_no"), (F.col("event_type") == "view").cast("int").alias("is_key"), F.col("value").alias("ts"))
    return decisions.keyframe_offset(frames, "user_id", F.lit(50.0))


@query("""
SELECT user_id, event_id, CAST(n AS INTEGER) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20
""")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last points of each series."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return read(spark, sf_dir, "events").select("user_id", "event_id", place.alias("place")).where("place <= 20")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus WHEN o_orderkey % 5 >= 3 THEN 'Failed' ELSE 'Queued' END AS status, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE 1.0 END AS progress FROM orders
""")
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that were running are queued again, or failed after too many attempts."""
    jobs = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "Transcoding").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_orderkey") % 5).alias("attempt"), F.lit(1.0).alias("progress"), F.lit(None).cast("string").alias("error_message"))
    return decisions.recovered(jobs, 3).select("o_orderkey", "status", "progress")


@query("""
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND o_orderdate < TIMESTAMP '1999-01-08' - INTERVAL 7 DAY
""")
def orphan_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nothing owns any more, past its days of grace."""
    files = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified_at"))
    owners = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"))
    return decisions.orphans(files, owners, F.lit("1999-01-08").cast("timestamp_ntz")).select(F.col("path").alias("o_orderkey"))


@query("""
SELECT p_partkey, greatest(0, least(51, p_size) - CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 0 END - CAST(p_partkey % 4 AS INTEGER) * 3) AS effective, CASE WHEN p_partkey % 3 = 0 THEN 'CQ' ELSE 'CRF' END AS mode FROM part
""")
def encoder_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = F.when(F.col("p_partkey") % 3 == 0, "hevc_nvenc").otherwise("libx265")
    q = decisions.encoder_quality(encoder, F.col("p_size"), (F.col("p_partkey") % 4).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", q["effective"].alias("effective"), q["mode"].alias("mode"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'The queue is paused.' WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 = 1 THEN s_name
  WHEN s_acctbal < 3072 THEN 'low' END AS reason FROM supplier
""")
def dispatch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pause first, then activity unless bypassed, then free space."""
    k = F.col("s_suppkey")
    gate = decisions.dispatch_gate(F.lit(3072).cast("long"), F.floor("s_acctbal"), k % 5 == 0, F.col("s_name"), k % 2 == 0, k % 11 == 0, F.lit(None).cast("string"))
    reason = F.when(gate["reason"].startswith("Free disk space"), "low").otherwise(gate["reason"])
    return read(spark, sf_dir, "supplier").select("s_suppkey", reason.alias("reason"))


@query("""
SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN rtrim(rtrim(printf('%.1f', floor(b / 102.4 + 0.5) / 10), '0'), '.') || ' KB' ELSE rtrim(rtrim(printf('%.1f', floor(b / 104857.6 + 0.5) / 10), '0'), '.') || ' MB' END AS size
FROM (SELECT doc_id, n_chars * 16 AS b FROM documents)
""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", media.binary_size(F.col("n_chars") * 16).alias("size"))


@query("""
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_nationkey > 20 THEN 'unknown nation' END, CASE WHEN length(c_name) > 512 THEN 'name too long' END], lambda x: x IS NOT NULL), '; ') AS errors FROM customer
""")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations of a row, in order."""
    found = decisions.violations([(F.col("c_acctbal") < 0, "negative balance"), (F.col("c_nationkey") > 20, "unknown nation"), (F.char_length("c_name") > 512, "name too long")])
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(found, "; ").alias("errors"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, v, v >= 0.4 AS emitted, CASE WHEN v >= 0.4 THEN v ELSE 0.0 END AS last FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.v, e.v >= r.last + 0.4, CASE WHEN e.v >= r.last + 0.4 THEN e.v ELSE r.last END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, count(*) FILTER (emitted) AS emissions, max(last) AS last_value FROM r GROUP BY user_id
""")
def emit_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a value was written that is a step above the last one written."""
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 100).alias("v"))
    found = sequences.emissions(rows, "user_id", ["ts", "event_id"], "v", 0.4, F.to_date("ts")).groupBy("user_id").agg(F.count("*").alias("emissions"), F.max("v").alias("last_value"))
    return rows.select("user_id").distinct().join(found, "user_id", "left").select("user_id", F.coalesce("emissions", F.lit(0)).alias("emissions"), F.coalesce("last_value", F.lit(0.0)).alias("last_value"))


@query(r"""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS s FROM pages),
c AS (SELECT page_id, CASE WHEN len(s) >= 2 THEN s[-2] ELSE s[1] END AS folder FROM p)
SELECT page_id, trim(replace(replace(folder, '.', ' '), '_', ' ')) AS title FROM c
""")
def media_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of films from their folders."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return read(spark, sf_dir, "pages").select("page_id", media.title_and_year(path, F.lit(False))["title"].alias("title"))
