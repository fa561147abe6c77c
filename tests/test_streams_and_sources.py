"""Emission on change, streams with state, pull sources, line numbers and deep pages, each against plain code."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.operators import filters, sequences
from siltstone.operators import progress as batch_progress
from siltstone.sources import captures, samples, services, walk
from siltstone.streaming import counters, due, outbox, progress


def emitted(rows, step, eager=False):
    """Plain code: the (key, n, value) that are emitted of rows in order."""
    out, last, first = [], {}, set()
    for key, n, value in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if key is None or value is None or value != value or value in (float("inf"), -float("inf")):
            continue
        at = last.get(key, 0.0)
        if value >= at + step or eager and key not in first and value > 0:
            out.append((key, n, value))
            last[key] = value
            first.add(key)
    return Counter(out)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("eager", [False, True])
def test_emissions_equal_the_loop(spark, seed, eager):
    rng = random.Random(seed)
    rows = [("hot", n, round(n / 700 + rng.random() / 50, 4)) for n in range(700)]  # grows, with ties and steps back
    rows += [("ties", n, rng.choice([0.0, 0.01, 0.02, 0.5, 0.5, 1.0])) for n in range(60)]
    rows += [("odd", n, rng.choice([None, float("nan"), float("inf"), -1.0, 0.004, 0.3, 1e9])) for n in range(40)]
    rows += [(None, 1, 0.5), ("once", 1, 0.5), ("never", 1, 0.0), ("gap", 1, 0.5), ("gap", 2, 90.0), ("gap", 3, 90.005), ("gap", 4, 100.0)]
    rows += [(f"k{k}", n, rng.random() * 3) for k in range(5) for n in range(30)]
    df = spark.createDataFrame(rows, "key string, n int, v double").repartition(4)
    for piece in (None, F.floor(F.col("n") / 50)):
        got = sequences.emissions(df, "key", ["n"], "v", 0.01, piece, eager)
        assert Counter(tuple(r) for r in got.collect()) == emitted(rows, 0.01, eager)
    assert sequences.emissions(df.limit(0), "key", ["n"], "v", 0.01).count() == 0


def test_emissions_plan_has_no_python(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("key"), "id", F.rand(1).alias("v"))
    plan = sequences.records(df, "key", ["id"], "v", F.floor(F.col("id") / 100))._jdf.queryExecution().toString()
    jumps = sequences.next_jumps(df.select("key", F.col("v").alias("value")), 0.1)._jdf.queryExecution().toString()
    assert not any(word in plan + jumps for word in ("Python", "Pandas", "Arrow"))


def protocol_lines(rng, jobs):
    """Lines of jobs as they might come: names in any order, repeated, broken, without an elapsed time, several runs a job."""
    out = []
    for job in range(jobs):
        at = 0.0
        for block in range(rng.randint(1, 40)):
            at += rng.choice([0.0, 0.3, 2.0, -5.0])
            lines = [f"fps={rng.choice(['30', '29.97', 'N/A', ''])}", f" speed = {rng.choice(['1.5x', ' 2x', 'N/A', '0x'])}", "frame", "=x", "out_time_us=bad"]
            lines += rng.choice([[f"out_time_us={int(at * 1e6)}"], [f"out_time_ms={int(at * 1e6)}", "out_time=00:00:09"], [f"out_time=00:01:{rng.randint(0, 59)}.5"], ["out_time=N/A"], []])
            rng.shuffle(lines)
            out += [(job, len(out) + k, line, rng.choice([100.0]) if job else None) for k, line in enumerate([*lines, f"progress={'end' if rng.random() < 0.1 else 'continue'}"])]
    return out + [(jobs, len(out), "progress=", 5.0), (jobs, len(out) + 1, "out_time_us=1", 5.0)]


def test_progress_stream_equals_the_batch_in_any_batching(spark, tmp_path):
    rng = random.Random(11)
    rows = protocol_lines(rng, 8)
    shape = "job_id long, line_no long, line string, duration double"
    df = spark.createDataFrame(rows, shape)
    norm = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    want = Counter(norm(r) for r in batch_progress.live(batch_progress.blocks(df)).collect())
    assert want and any(r[-1] for r in want) and not all(r[-1] for r in want)
    assert want == Counter(norm(r) for r in batch_progress.live(batch_progress.blocks(df, F.floor(F.col("line_no") / 40)), F.floor(F.col("line_no") / 40)).collect())
    cuts = sorted(rng.sample(range(len(rows)), 3))  # a block may be cut anywhere
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], shape).write.mode("append").parquet(str(tmp_path / "in"))
        stream = progress.live_progress(spark.readStream.schema(shape).parquet(str(tmp_path / "in")))
        progress.drain(stream, str(tmp_path / "state"), progress.into(str(tmp_path / "out")))  # from the checkpoint, each time
    assert want == Counter(norm(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect())


def test_progress_state_of_finished_jobs_is_gone(spark, tmp_path):
    lines = ["out_time_us=5000000", "progress=continue", "out_time_us=9000000", "progress=end"]
    df = spark.createDataFrame([(j, n, line, 10.0) for j in range(3) for n, line in enumerate(lines)], "job_id long, line_no long, line string, duration double")
    df.write.parquet(str(tmp_path / "in"))
    stream = progress.live_progress(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = progress.drain(stream, str(tmp_path / "state"), progress.into(str(tmp_path / "out")))
    assert spark.read.parquet(str(tmp_path / "out")).where("kept").count() == 6
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_line_numbers_over_splits(spark, tmp_path, split):
    rng = random.Random(split)
    want = Counter()
    for name in ("a.log", "b.log", "sub/a.log", "empty.log", "other.txt"):
        lines = [] if name == "empty.log" else ["é" * rng.randint(0, 30) + str(k) + rng.choice(["", "\r"]) for k in range(200)]
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes("\n".join(lines).encode() + (b"\n" if name == "b.log" else b""))
        if name.endswith(".log"):
            want.update((f"/{name}", n, line.removesuffix("\r")) for n, line in enumerate(lines, 1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = captures.numbered_lines(spark, str(tmp_path), "*.log").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert Counter((r["path"].partition(str(tmp_path))[2], r["line_no"], r["line"]) for r in rows) == want


def test_deep_pages_equal_offset_and_limit(spark):
    rng = random.Random(12)
    rows = [(k, rng.choice([None, 1.5, 2.5, float(rng.randrange(40))]), rng.choice(["a", "b", None])) for k in range(1000)]
    df = spark.createDataFrame(rows, "id int, v double, s string").repartition(5).cache()
    for order in ([("v", False), ("id", True)], [("v", True), ("s", False), ("id", False)], [("id", True)]):
        by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
        everything = [tuple(r) for r in df.orderBy(*by).collect()]
        for number, size in ((1, 7), (0, 7), (50, 20), (77, 13), (51, 20), (4, 333), (1, 5000), (99, 999)):
            start = (max(1, number) - 1) * size
            assert [tuple(r) for r in filters.deep_page(df, order, number, size, 8).collect()] == everything[start : start + size], (order, number, size)
        assert Counter(tuple(r) for r in filters.deep_page(df, order, 3, 0, 8).collect()) == Counter(everything)
    assert filters.deep_page(df.limit(0), [("id", True)], 2, 5).count() == 0


def test_deep_page_reads_few_ranges(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    page = filters.deep_page(table, [("k", True)], 15_001, 10, 100)
    assert [r["k"] for r in page.collect()] == list(range(150_000, 150_010))
    plan = page._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(k," in plan
    rows = page.sparkSession.createDataFrame(filters.ranges(table, [("k", True)], 100))
    assert rows.count() > 50 and rows.agg(F.max("n")).first()[0] < 20_000


def test_service_pages_failures_and_pushdown(spark):
    def transport(connection, page, size):
        if connection == "down" or connection == "breaks" and page == 2:
            raise TimeoutError("no answer")
        if connection == "odd":
            return "<html>"
        total = {"none": 0, "one": 1, "many": 450, "breaks": 300}[connection]
        return json.dumps({"totalRecords": total, "records": list(range((page - 1) * size, min(total, page * size)))})

    names = ["none", "one", "many", "down", "breaks", "odd"]
    found = services.read_services(spark, transport, names)
    rows = {(r["connection"], r["page"]): (r["body"] and len(json.loads(r["body"])["records"]), r["error"]) for r in found.collect()}
    assert {k: v[0] for k, v in rows.items()} == {("none", 1): 0, ("one", 1): 1, ("many", 1): 200, ("many", 2): 200, ("many", 3): 50, ("down", 1): None, ("breaks", 1): 200, ("breaks", 2): None, ("odd", 1): None}
    assert all(("no answer" in v[1] or "JSON" in v[1]) == (v[0] is None) for v in rows.values() if v[1])
    assert found.rdd.getNumPartitions() == 6 and found.where("connection = 'one'").rdd.getNumPartitions() == 1
    assert {r["connection"] for r in found.where(F.col("connection").isin("one", "none")).collect()} == {"one", "none"}


def test_samples_are_replayed_after_a_restart(spark, tmp_path):
    rng, folder, kept = random.Random(13), tmp_path / "in", []

    def tick(n):
        (folder / f"tick={n}").mkdir(parents=True)
        rows = [{"counter": c, "at": float(n), "value": float(n * rng.randint(0, 2))} for c in ("cpu", "gpu")]
        (folder / f"tick={n}" / "part-0").write_text("".join(json.dumps(r) + "\n" for r in rows))
        kept.extend(rows)

    def drain(write):
        progress.drain(counters.utilisation_stream(samples.read_samples(spark, str(folder))), str(tmp_path / "state"), write)

    def broken(batch, number):
        batch.collect()
        raise RuntimeError("lost")

    tick(0), tick(1), tick(3)  # 3 waits for 2
    drain(progress.into(str(tmp_path / "out")))
    assert spark.read.parquet(str(tmp_path / "out")).select(F.max("at")).first()[0] == 1.0
    tick(2), tick(4)
    with pytest.raises(Exception, match="lost"):
        drain(broken)
    drain(progress.into(str(tmp_path / "out")))
    drain(progress.into(str(tmp_path / "out")))
    got = {(r["counter"], r["at"]): r["percent"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    value = {(r["counter"], r["at"]): r["value"] for r in kept}
    assert got == {(c, float(n)): min(100.0, max(0.0, (value[c, float(n)] - value[c, n - 1.0]) * 100)) for c in ("cpu", "gpu") for n in range(1, 5)}
    assert samples.SampleReader(str(folder)).latestOffset() == {"ticks": 5}


def test_outbox_sends_each_change_once(spark, tmp_path):
    known, taken = str(tmp_path / "known"), tmp_path / "taken"
    taken.mkdir()

    def send(messages):
        import uuid

        bad = [m for m in messages if m["id"] == 7]
        if bad and not (taken / "failed").exists():
            (taken / "failed").touch()
            raise ConnectionError("busy")
        (taken / f"{uuid.uuid4().hex}.json").write_text("".join(json.dumps(m) + "\n" for m in messages))

    write = outbox.outbox(known, send, at_once=3)
    batch = spark.createDataFrame([(k % 20, None if k % 5 else "x") for k in range(40)], "id int, status string")
    with pytest.raises(RuntimeError, match="3 changes were not taken|changes were not taken"):
        write(batch, 0)
    some = sum(len(p.read_text().splitlines()) for p in taken.glob("*.json"))
    assert 0 < some < 20
    write(batch, 0)
    write(batch, 1)
    write(batch.limit(0), 2)
    sent = [json.loads(line) for p in taken.glob("*.json") for line in p.read_text().splitlines()]
    assert sorted(m["id"] for m in sent) == list(range(20)) and len({m["key"] for m in sent}) == 20
    assert all(m["status"] == (None if m["id"] % 5 else "x") for m in sent) and outbox.acknowledged(spark, known).count() == 20


def test_files_are_held_until_they_have_settled(spark, tmp_path):
    """Files go on when they are two minutes old by the listings' clock; a newer change waits anew; no state at the end."""
    from datetime import datetime, timezone

    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    scans = [
        [("/a", 1, at(0), at(10)), ("/b", 2, at(5), at(10)), ("/old", 3, at(-500), at(10)), ("/none", 4, None, at(10))],
        [("/a", 9, at(60), at(100)), ("/b", 2, at(5), at(100))],
        [("/c", 5, at(125), at(130))],
        [("/a", 9, at(60), at(400))],
    ]
    seen = []
    for scan in scans:
        spark.createDataFrame(scan, "path string, size_bytes long, modified_at timestamp, listed_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("path string, size_bytes long, modified_at timestamp, listed_at timestamp").parquet(str(tmp_path / "in"))
        query = progress.drain(due.settled_files(stream), str(tmp_path / "state"), lambda df, _: seen.extend((r["path"], r["size_bytes"]) for r in df.collect()))
    assert Counter(seen) == Counter({("/old", 3): 1, ("/b", 2): 1, ("/a", 9): 2, ("/c", 5): 1})  # /a waited, and was listed again
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_walk_goes_on_after_failures(spark, tmp_path):
    for name in ("a.mkv", "x/b.MP4", "x/y/c.txt", "x/y/z/d.avi", "shut/e.mkv", "é/f.mkv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1234")
    (tmp_path / "x" / "loop").symlink_to(tmp_path)
    (tmp_path / "empty").mkdir()

    def listing(folder):
        if folder.endswith("/shut"):
            raise PermissionError("not yours")
        return walk.local_listing(folder)

    found = walk.walk(spark, f"{tmp_path}/", listing, 2)
    assert [tuple(r) for r in walk.walk_counts(found, "Video").collect()] == [(4, 1, 6, 1)]
    media = {r["relative_path"]: (r["size_bytes"], r["settled"]) for r in walk.walked(found, str(tmp_path), "Video", (tmp_path / "a.mkv").stat().st_mtime + 60).collect()}
    assert media == {n: (4, False) for n in ("a.mkv", "x/b.MP4", "x/y/z/d.avi", "é/f.mkv")}
    assert [r["path"] for r in found.where("error is not null").collect()] == [f"{tmp_path}/shut"]
    assert walk.walk_counts(walk.walk(spark, f"{tmp_path}/nowhere"), "Video").first()["failed"] == 1
