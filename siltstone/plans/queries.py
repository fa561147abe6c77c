"""The operators as queries over the driver's tables, each beside the SQL that DuckDB answers it with.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``SQL`` maps it to its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators import aggregates as A
from siltstone.operators import decisions, filters, joins, merge, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NIGHT = (22 * 60, 6 * 60)


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task whose expressions cost far more than their bytes.
SPREAD = 20_000


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``read`` for costly expressions: rows are dealt to tasks by their number, as a scan deals few bytes to one task."""
    rows = read(spark, sf_dir, name)
    return rows.repartition(rows.count() // SPREAD + 1)  # the count is in the files' footers


def cents(column: str) -> F.Column:
    """Exact sums need whole numbers."""
    return F.round(F.col(column) * 100).cast("long")


def stamp(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


CATEGORY_SQL = "CASE WHEN event_type LIKE '%error%' THEN 'Failure' WHEN event_type LIKE '%signup%' OR event_type LIKE '%purchase%' THEN 'Outcome' ELSE 'Other' END"


def category(text) -> F.Column:
    return S.first_match([(S.contains_any(text, ["error"]), "Failure"), (S.contains_any(text, ["signup", "purchase"]), "Outcome")], "Other")


@query(f"""
SELECT category, group_count, sample, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (
  SELECT *, count(*) OVER (PARTITION BY category) AS group_count, CAST(row_number() OVER (PARTITION BY category ORDER BY ts DESC, event_id) AS INTEGER) AS sample
  FROM (SELECT event_id, ts, {CATEGORY_SQL} AS category FROM events)) WHERE sample <= 5
""")
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by category, each with its count and five newest samples."""
    rows = read(spark, sf_dir, "events").select("event_id", "ts", category(F.col("event_type")).alias("category"))
    found = A.with_samples(rows, "category", [F.col("ts").desc_nulls_last(), F.col("event_id")], 5)
    return found.select("category", "group_count", "sample", "event_id", stamp("ts").alias("ts"))


@query("""
SELECT count(*) AS n_jobs, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS running,
  count(*) FILTER (o_orderstatus = 'F') AS failed, coalesce(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT), 0) AS total_cents,
  coalesce(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS BIGINT), 0) AS reclaimable_cents,
  CASE WHEN sum(CAST(round(o_totalprice * 100) AS BIGINT)) > 0 THEN (1 - CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) / CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)) * 100 ELSE 0.0 END AS saving
FROM orders
""")
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of the start page in one pass; empty sums are 0."""
    o, status, size = read(spark, sf_dir, "orders"), F.col("o_orderstatus"), cents("o_totalprice")
    total, part = F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(status == "F", size)), F.lit(0))
    counts = {"queued": "O", "running": "P", "failed": "F"}
    sums = o.agg(F.count("*").alias("n_jobs"), *[F.count_if(status == v).alias(k) for k, v in counts.items()], total.alias("total_cents"), part.alias("reclaimable_cents"))
    return sums.withColumn("saving", S.saving_percent(F.col("total_cents").cast("double"), F.col("reclaimable_cents").cast("double")))


@query("""
SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'F') AS eligible, count(o_orderkey) FILTER (o_orderstatus <> 'F') AS skipped
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def per_library_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    status = F.col("o_orderstatus")
    return joins.with_counts(read(spark, sf_dir, "customer").select("c_custkey"), facts, "c_custkey", {"eligible": status == "F", "skipped": status != "F"})


@query("""
SELECT o_custkey, strftime(max(o_orderdate) FILTER (o_orderstatus = 'F'), '%Y-%m-%d %H:%M:%S') AS last_completed,
  strftime(max(o_orderdate) FILTER (o_orderstatus = 'O'), '%Y-%m-%d %H:%M:%S') AS last_failed FROM orders GROUP BY o_custkey
""")
def latest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "orders")).select("o_custkey", stamp("last_completed").alias("last_completed"), stamp("last_failed").alias("last_failed"))


def latest(orders: DataFrame) -> DataFrame:
    last = lambda v: F.max(F.when(F.col("o_orderstatus") == v, F.col("o_orderdate")))
    return orders.groupBy("o_custkey").agg(last("F").alias("last_completed"), last("O").alias("last_failed"))


@query("""
WITH l AS (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F') AS done, max(o_orderdate) FILTER (o_orderstatus = 'O') AS failed FROM orders GROUP BY o_custkey)
SELECT o_orderkey, CASE WHEN done >= o_orderdate THEN 'Optimised since' WHEN failed >= o_orderdate THEN 'Failed since' ELSE 'Eligible' END AS reason,
  NOT coalesce(done >= o_orderdate OR failed >= o_orderdate, FALSE) AS eligible
FROM orders JOIN l USING (o_custkey)
""")
def history_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completed run wins over a failed one; either skips what hasn't changed since."""
    o = read(spark, sf_dir, "orders")
    joined = o.join(latest(o), "o_custkey")
    reason = S.first_match([(F.col("last_completed") >= F.col("o_orderdate"), "Optimised since"), (F.col("last_failed") >= F.col("o_orderdate"), "Failed since")], "Eligible")
    return joined.select("o_orderkey", reason.alias("reason")).withColumn("eligible", F.col("reason") == "Eligible")


@query("""
WITH r AS (SELECT page_id, url, CASE WHEN strlen(html) >= 4096 THEN TRUE WHEN strlen(html) < 2048 THEN FALSE END AS eligible FROM pages WHERE url ILIKE '%example.com%'),
t AS (SELECT count(*) AS n_all, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (NOT eligible) AS n_skipped, count(*) FILTER (eligible IS NULL) AS n_unprobed FROM r)
SELECT page_id, url, n_all, n_eligible, n_skipped, n_unprobed FROM (SELECT page_id, url FROM r WHERE eligible ORDER BY url, page_id LIMIT 50) CROSS JOIN t
""")
def inventory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of eligible rows, with tallies over what was searched for, before the verdict filter."""
    size = F.octet_length("html")
    rows = read(spark, sf_dir, "pages").where(filters.search("url", " example.com ")).select("page_id", "url", F.when(size >= 4096, True).when(size < 2048, False).alias("eligible"))
    tallies = rows.agg(F.count("*").alias("n_all"), *[F.count_if(filters.verdict(F.col("eligible"), v)).alias(f"n_{v}") for v in ("eligible", "skipped", "unprobed")])
    shown = filters.page(rows.where(filters.verdict(F.col("eligible"), "eligible")), [F.col("url"), F.col("page_id")], 1, 50)
    return shown.select("page_id", "url").crossJoin(F.broadcast(tallies))  # one row of tallies


@query("""
SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, o_orderpriority, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS has_running
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'
""")
def job_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional filters over a coalesced time, an outer join for the name, and a flag by semi-join."""
    o = read(spark, sf_dir, "orders")
    wanted = filters.conjunction([F.col("o_orderstatus") == "O", None, filters.time_range(F.coalesce(F.col("o_orderdate")), F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1998-12-31").cast("timestamp_ntz"))])
    running = o.where("o_orderstatus = 'P'").select("o_custkey").distinct().withColumn("r", F.lit(True))
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    joined = o.where(wanted).join(names, "o_custkey", "left").join(running, "o_custkey", "left")
    return joined.select("o_orderkey", "c_name", stamp("o_orderdate").alias("at"), "o_orderpriority", F.coalesce("r", F.lit(False)).alias("has_running"))


@query("""
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
WHERE hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 360
ORDER BY CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END DESC, events.ts, event_id LIMIT 100
""")
def scheduler_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What starts next inside a window that wraps past midnight: by priority, age and id, as many as there are slots."""
    e = read(spark, sf_dir, "events").where(S.in_daily_window(S.minute_of_day("ts"), *NIGHT))
    priority = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return e.orderBy(priority.desc(), "ts", "event_id").limit(100).select("event_id", "user_id", stamp("ts").alias("ts"))


@query("""
SELECT c_custkey, 'idle' AS state FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT c_custkey, 'active' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('O', 'P'))
""")
def active_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    idle = c.join(o, "c_custkey", "left_anti").withColumn("state", F.lit("idle"))
    return idle.unionByName(c.join(o.where(F.col("o_orderstatus").isin("O", "P")), "c_custkey", "left_semi").withColumn("state", F.lit("active")))


@query("""
SELECT coalesce(n_name, 'Unassigned') AS library, coalesce(c_mktsegment, 'None') AS segment, count(*) AS queued, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""")
def dimension_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer joins to dimensions whose missing rows get a label; aggregated by the key before the names come in."""
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    by_customer = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("queued"), F.sum(cents("o_totalprice")).alias("cents"))
    found = joins.with_dimension(by_customer, c, "o_custkey", {"segment": "None"})
    named = joins.with_dimension(found, read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("library")), "n_nationkey", {"library": "Unassigned"})
    return named.groupBy("library", "segment").agg(F.sum("queued").alias("queued"), F.sum("cents").alias("cents"))


STEM_SQL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[0-9]+$', '')"


def url_stem() -> F.Column:
    return F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"[0-9]+$", "")


@query(f"""
WITH p AS (SELECT page_id, {STEM_SQL} AS stem, contains(url, '?') AS marked FROM pages)
SELECT page_id, stem, NOT marked AND EXISTS (SELECT 1 FROM p q WHERE q.marked AND q.stem IS NOT DISTINCT FROM p.stem) AS has_sibling FROM p
""")
def sibling_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row that isn't marked but shares its stem with a marked one."""
    p = read(spark, sf_dir, "pages").select("page_id", url_stem().alias("stem"), F.col("url").contains("?").alias("marked"))
    return joins.sibling_flag(p, ["stem"], F.col("marked"), "has_sibling").select("page_id", "stem", "has_sibling")


FOLDER_SQL = """
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
parts AS (SELECT DISTINCT string_split(path, '/') AS s FROM p),
f AS (SELECT DISTINCT array_to_string(s[1:3], '/') AS folder FROM parts UNION SELECT DISTINCT array_to_string(s[1:4], '/') FROM parts)
"""


def folders(pages: DataFrame) -> DataFrame:
    s = F.split("path", "/")
    return pages.select(F.explode(F.array(F.array_join(F.slice(s, 1, 3), "/"), F.array_join(F.slice(s, 1, 4), "/"))).alias("folder")).distinct()


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))


@query(FOLDER_SQL + "SELECT page_id, min(folder) AS import_folder FROM p LEFT JOIN f ON path = folder OR starts_with(path, folder || '/') GROUP BY page_id")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first folder, in list order, that holds each path."""
    p = page_paths(spark, sf_dir)
    return joins.under_folders(p, "path", folders(p), "folder", F.min("folder"), "import_folder").select("page_id", "import_folder")


@query(FOLDER_SQL + "SELECT page_id, max_by(folder, length(folder)) AS mount FROM p LEFT JOIN f ON path = folder OR starts_with(path, folder || '/') GROUP BY page_id")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mount with the longest path that holds each path."""
    p = page_paths(spark, sf_dir)
    return joins.under_folders(p, "path", folders(p), "folder", F.max_by("folder", F.length("folder")), "mount").select("page_id", "mount")


@query("""
SELECT l_returnflag, l_linestatus,
  round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(greatest(l_quantity, 1) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(greatest(l_quantity, 1) AS BIGINT)) AS DOUBLE), 3) AS mean_cents,
  round(sum(CASE WHEN l_extendedprice > 0 THEN greatest(l_quantity, 1) END) / sum(CASE WHEN l_extendedprice > 0 THEN greatest(l_quantity, 1) / l_extendedprice END), 3) AS harmonic,
  min(l_extendedprice) AS least, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, CAST(sum(l_quantity) AS BIGINT) AS frames,
  CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS common_status
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def window_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of windows as one: weighted and harmonic means, the least, the fifth percentile, the common value."""
    price, frames, rows = F.col("l_extendedprice"), F.col("l_quantity"), read(spark, sf_dir, "lineitem")
    low = A.exact_percentile(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.05, "p5").withColumn("p5", F.round("p5", 4))
    scores = rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(A.weighted_mean(cents("l_extendedprice"), frames.cast("long")), 3).alias("mean_cents"),
        F.round(A.harmonic_mean(price, frames), 3).alias("harmonic"),
        F.min(price).alias("least"),
        F.sum(frames).cast("long").alias("frames"),
        A.common_value(F.col("l_linestatus")).alias("common_status"),
    )
    return scores.join(low, ["l_returnflag", "l_linestatus"])


@query("""
SELECT l_suppkey, count(*) AS samples,
  round_even(CASE WHEN bool_and(l_discount > 0) THEN CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE)
    ELSE CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) END, 2) AS mean_cents
FROM lineitem GROUP BY l_suppkey
""")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted mean only where every sample has a weight, else a plain one."""
    mean = A.guarded_mean(cents("l_extendedprice"), cents("l_discount"))
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("samples"), F.bround(mean, 2).alias("mean_cents"))


@query("""
WITH e AS (SELECT *, CASE WHEN event_type <> 'signup' THEN value END AS dts FROM events),
b AS (SELECT *, last_value(dts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT user_id, count(dts) AS n, count(*) FILTER (dts < before) AS regressions, min_by(event_id, (ts, event_id)) FILTER (dts < before) AS first_regression, max(dts) AS greatest
FROM b GROUP BY user_id
""")
def timestamp_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("dts", F.when(F.col("event_type") != "signup", F.col("value")))
    return sequences.regressions(e, "user_id", ["ts", "event_id"], "dts", "event_id", F.to_date("ts"))


@query("""
SELECT event_id, max(least(greatest(value / 1000, 0.0), 0.999)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS progress FROM events
""")
def progress_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = S.clamp(F.col("value") / 1000, 0.0, 0.999)
    return sequences.high_water(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], value, "progress", F.date_trunc("week", "ts")).select("event_id", "progress")


@query("""
WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
s AS (SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT event_id, CAST(streak AS BIGINT) AS streak, streak >= 3 AS excluded FROM s
""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    found = sequences.streaks(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], kind == "error", kind == "purchase", "streak", F.to_date("ts"))
    return found.select("event_id", "streak", (F.col("streak") >= 3).alias("excluded"))


@query("""
WITH b AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM events)
SELECT user_id, CAST(block AS BIGINT) AS block, count(*) AS lines, max_by(value, (ts, event_id)) FILTER (event_type = 'click') AS last_click, max_by(value, (ts, event_id)) FILTER (event_type = 'view') AS last_view,
  bool_or(event_type = 'purchase') AS complete
FROM b GROUP BY user_id, block
""")
def progress_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys gathered until a line ends the block; the last value of each key counts."""
    kind = F.col("event_type")
    b = sequences.blocks(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], kind == "purchase", "block", F.to_date("ts"))
    last = lambda v: F.max_by("value", F.when(kind == v, F.struct("ts", "event_id")))
    return b.groupBy("user_id", "block").agg(F.count("*").alias("lines"), last("click").alias("last_click"), last("view").alias("last_view"), F.bool_or(kind == "purchase").alias("complete"))


@query("""
WITH d AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -2 ELSE 0 END AS delta FROM events),
s AS (SELECT *, sum(delta) OVER w AS total FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CAST(total - least(0, min(total) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS counter FROM s
""")
def clamped_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -2).otherwise(0)
    rows = read(spark, sf_dir, "events").withColumn("delta", delta)
    return A.clamped_counter(rows, "user_id", ["ts", "event_id"], "delta", "counter", F.to_date("ts")).select("event_id", "counter")


@query("""
WITH d AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1, 2),
c AS (SELECT o_orderstatus, day, sum(n) OVER w AS total, sum(n - u) OVER w AS idle FROM d WINDOW w AS (PARTITION BY o_orderstatus ORDER BY day ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, total - lag(total) OVER w AS dt, idle - lag(idle) OVER w AS di FROM c WINDOW w AS (PARTITION BY o_orderstatus ORDER BY day))
SELECT o_orderstatus, strftime(day, '%Y-%m-%d') AS day, CASE WHEN dt > 0 THEN greatest(0.0, least(100.0, CAST(dt - di AS DOUBLE) / CAST(dt AS DOUBLE) * 100)) WHEN dt IS NOT NULL THEN 0.0 END AS busy FROM l
""")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utilisation from cumulative counters."""
    d = read(spark, sf_dir, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    w = sequences._so_far(["o_orderstatus"], ["day"])
    c = d.withColumn("total", F.sum("n").over(w)).withColumn("idle", F.sum(F.col("n") - F.col("u")).over(w))
    return sequences.utilisation(c, "o_orderstatus", ["day"], "total", "idle", "busy").select("o_orderstatus", F.date_format("day", "yyyy-MM-dd").alias("day"), "busy")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS lines FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, lines, greatest(lines - 4, 0) AS elided, sha256(line) AS line_sha256 FROM n WHERE line_no <= 2 OR line_no > lines - 2
""")
def head_tail_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last lines of each log and how many lie between."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    found = sequences.head_and_tail(rows, "doc_id", ["at"], 2, 2)
    return found.select("doc_id", "line_no", "lines", "elided", F.sha2(F.encode("line", "UTF-8"), 256).alias("line_sha256"))


@query("""
WITH x AS (SELECT o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS c, sha256(concat_ws(chr(10), 'order', CAST(o_orderkey AS VARCHAR), '', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR))) AS h
  FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY)
SELECT o_orderstatus, count(*) AS expired, CAST(sum(c) AS BIGINT) AS cents, sha256(concat_ws(',', '30', 'false', CAST(count(*) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS VARCHAR))) AS token
FROM x GROUP BY o_orderstatus
""")
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is past its retention, the cutoff included, with a token over the identities that a confirmation must match."""
    expired = read(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS"))
    files = expired.select("o_orderstatus", F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.lit("").alias("path"), cents("o_totalprice").alias("bytes"))
    return decisions.cleanup_plan(files, ["o_orderstatus"], 30).select("o_orderstatus", F.col("files").alias("expired"), F.col("bytes").alias("cents"), "token")


@query("""
WITH n AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey + 1000000000 ELSE o_orderkey END AS k, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS size, o_orderdate AS modified FROM orders)
SELECT coalesce(o.o_orderkey, n.k) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.o_totalprice IS DISTINCT FROM n.size OR o.o_orderdate IS DISTINCT FROM n.modified THEN 'updated' ELSE 'unchanged' END AS action
FROM orders o FULL JOIN n ON o.o_orderkey = n.k
""")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan against the table: what is new, gone, changed in size or time, or as it was."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("modified"), "o_orderstatus", "o_orderpriority")
    scanned = o.select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") + 1_000_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        F.when(F.col("o_orderstatus") == "P", F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        "modified",
    )
    return merge.diff(o, scanned, "o_orderkey", ["size", "modified"]).select("o_orderkey", "action")


@query("""
WITH k AS (SELECT user_id, event_type AS key, max_by(json_extract_string(props, '$.k'), (ts, event_id)) AS v FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2)
SELECT user_id, greatest(coalesce(TRY_CAST(max(CASE WHEN key = 'click' THEN v END) AS INTEGER), 1), 5) AS slots,
  coalesce(TRY_CAST(max(CASE WHEN key = 'view' THEN v END) AS INTEGER), 30) AS days, coalesce(max(CASE WHEN key = 'error' THEN v END), 'none') AS mode
FROM k GROUP BY user_id
""")
def settings_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value rows as one typed row, with defaults and a least value."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error"))
    k = e.groupBy("user_id", "event_type").agg(F.max_by(F.get_json_object("props", "$.k"), F.struct("ts", "event_id")).alias("v"))
    wide = k.groupBy("user_id").pivot("event_type", ["click", "view", "error"]).agg(F.first("v"))
    number = lambda c, default: F.coalesce(F.col(c).try_cast("int"), F.lit(default))
    return wide.select("user_id", F.greatest(number("click", 1), F.lit(5)).alias("slots"), number("view", 30).alias("days"), F.coalesce("error", F.lit("none")).alias("mode"))


@query("""
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2
""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT source, list(DISTINCT lang ORDER BY lang) AS langs FROM documents GROUP BY source)
SELECT source, array_to_string(langs, ',') AS langs,
  CASE WHEN len(list_filter(langs, lambda x: x IN ('en', 'de'))) > 0 THEN array_to_string(list_filter(range(len(langs)), lambda i: langs[i + 1] NOT IN ('en', 'de')), ',') ELSE '' END AS removed
FROM l
""")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of tracks in other languages than those kept; none if no track would be left."""
    from siltstone.functions.languages import track_removals

    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    removed = track_removals(F.col("langs"), ["eng", "de"])
    return rows.select("source", F.array_join("langs", ",").alias("langs"), F.array_join(F.transform(removed, lambda x: x.cast("string")), ",").alias("removed"))


@query("""
SELECT source, CASE WHEN lower(text) LIKE '%licensed under%' THEN 'License' WHEN lower(text) LIKE '%password%' OR lower(text) LIKE '%secret%' OR lower(text) LIKE '%token%' THEN 'Secret'
  WHEN text LIKE '%|%' THEN 'Table' ELSE 'Other' END AS category, count(*) AS n
FROM documents GROUP BY 1, 2
""")
def text_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    kind = S.first_match([(S.contains_any(text, ["licensed under"]), "License"), (S.contains_any(text, ["password", "secret", "token"]), "Secret"), (text.contains("|"), "Table")], "Other")
    return read(spark, sf_dir, "documents").groupBy("source", kind.alias("category")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'No size' WHEN p_type LIKE '%ECONOMY%' THEN 'Already economical' WHEN p_size < 5 THEN 'Below minimum size' WHEN p_size > 40 AND p_retailprice < 1500 THEN 'Over height limit'
  WHEN p_retailprice / p_size < 40 THEN 'Below the efficiency floor' ELSE 'Eligible' END AS reason FROM part
""")
def decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules; the first that holds gives the reason."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    reason = S.first_match(
        [
            (size.isNull(), "No size"),
            (F.col("p_type").contains("ECONOMY"), "Already economical"),
            (size < 5, "Below minimum size"),
            ((size > 40) & (price < 1500), "Over height limit"),
            (F.try_divide(price, size) < 40, "Below the efficiency floor"),
        ],
        "Eligible",
    )
    return read(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, 'Duration' AS name, CASE WHEN l_tax <= 0.05 THEN 'Passed' ELSE 'Failed' END AS outcome FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'Size saving', CASE WHEN l_discount > 0.02 THEN 'Passed' ELSE 'Failed' END FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'Audio tracks', CASE WHEN l_quantity >= 10 THEN 'Passed' ELSE 'Failed' END FROM lineitem WHERE l_returnflag <> 'R')
SELECT name, outcome, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM c GROUP BY 1, 2
""")
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of named checks per row, those that apply, counted by outcome."""
    from siltstone.operators.checks import check, outcomes, report

    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        report(
            check("Duration", F.col("l_tax") <= 0.05, F.lit("")),
            check("Size saving", F.col("l_discount") > 0.02, F.lit("")),
            check("Audio tracks", F.col("l_quantity") >= 10, F.lit(""), applies=F.col("l_returnflag") != "R"),
        ).alias("checks"),
    )
    return outcomes(rows, "l_orderkey", ["Duration", "Size saving", "Audio tracks"]).withColumnRenamed("keys", "orders")


@query(r"""
WITH s AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS s FROM pages)
SELECT page_id, s[-2] AS folder, regexp_replace(lower(s[3]), '[^\p{L}\p{Nd}]', '', 'g') AS title_key, coalesce(TRY_CAST(regexp_extract(s[-1], '([0-9]+)$', 1) AS INTEGER), -1) AS year FROM s
""")
def title_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.split(F.regexp_replace("url", r"[?#].*$", ""), "/")
    rows = read(spark, sf_dir, "pages").select("page_id", s.alias("s"))
    return rows.select("page_id", F.try_element_at("s", F.lit(-2)).alias("folder"), S.alnum_key(F.try_element_at("s", F.lit(3))).alias("title_key"), F.coalesce(F.regexp_extract(F.element_at("s", -1), r"([0-9]+)$", 1).try_cast("int"), F.lit(-1)).alias("year"))


@query("""
SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, c_mktsegment FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
""")
def three_way_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.col("o_custkey").alias("c_custkey"))
    joined = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left")
    return joined.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "c_mktsegment")


@query("""
SELECT n_nationkey, 'both' AS kind FROM (SELECT s_nationkey AS n_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)
UNION ALL SELECT n_nationkey, 'without suppliers' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT r_regionkey, 'region' FROM region
""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    both = s.unionByName(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))).distinct().withColumn("kind", F.lit("both"))
    without = read(spark, sf_dir, "nation").select("n_nationkey").join(s, "n_nationkey", "left_anti").withColumn("kind", F.lit("without suppliers"))
    return both.unionByName(without).unionByName(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.lit("region").alias("kind")))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, 'newest' AS list FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 3)
UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'largest' FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)
""")
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k lists, each a take-ordered plan."""
    o = read(spark, sf_dir, "orders")
    pick = lambda by, k, name: o.orderBy(F.col(by).desc(), "o_orderkey").limit(k).select("o_orderkey", stamp("o_orderdate").alias("at"), F.lit(name).alias("list"))
    return pick("o_orderdate", 3, "newest").unionByName(pick("o_totalprice", 25, "largest"))


@query("""
WITH q AS (SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'O') AS queued, bool_or(o_orderstatus = 'X') AS runnable FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)
SELECT CAST(sum(queued) AS BIGINT) AS total, (SELECT c_mktsegment FROM q ORDER BY queued DESC, c_mktsegment LIMIT 1) AS waits_for FROM q HAVING NOT bool_or(runnable)
""")
def wait_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many wait and for which library mostly (ties by name); no row while any library could run."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    per = read(spark, sf_dir, "orders").join(c, "o_custkey", "left").groupBy("c_mktsegment").agg(F.count_if(F.col("o_orderstatus") == "O").alias("queued"), F.bool_or(F.col("o_orderstatus") == "X").alias("runnable"))
    busiest = F.min_by("c_mktsegment", F.struct(-F.col("queued"), "c_mktsegment"))
    return per.agg(F.sum("queued").alias("total"), busiest.alias("waits_for"), F.bool_or("runnable").alias("r")).where("not r").select("total", "waits_for")


@query("""
SELECT p_partkey, CAST(unnest(list_distinct([floor(greatest(p_size * 60 * 0.1 - 6, 0)), floor(greatest(p_size * 60 * 0.5 - 6, 0)), floor(greatest(least(p_size * 60 * 0.9 - 6, p_size * 60 - 12), 0))])) AS BIGINT) AS start_s FROM part
""")
def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct starts of clips about the tenth, the middle and nine tenths of a duration, inside it."""
    d = F.col("p_size") * 60
    at = lambda share, most=None: F.floor(F.greatest(d * share - 6 if most is None else F.least(d * share - 6, most), F.lit(0)))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.array(at(0.1), at(0.5), at(0.9, d - 12)))).alias("start_s"))


@query("""
WITH o AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
n AS (SELECT user_id, 'error' AS event_type, 0.0 AS value FROM (SELECT DISTINCT user_id FROM events))
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)
""")
def key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    current = e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    new = e.select("user_id").distinct().select("user_id", F.lit("error").alias("event_type"), F.lit(0.0).alias("value"))
    return merge.upsert(current, new, ["user_id", "event_type"])
