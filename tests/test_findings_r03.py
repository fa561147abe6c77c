"""Findings of round 3: queries on odd rows against their SQL, and how their work is dealt to tasks."""

import json
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_operators import CHANGES, HEALTHY, KINDS, rows_of
from test_queries import SF, plain

from siltstone.functions import parsers
from siltstone.operators import checks, verification
from siltstone.plans import queries, stream_queries
from siltstone.plans.queries import QUERIES, SQL
from siltstone.sources import samples
from siltstone.sources.shared import shared_folder


def same_as_sql(spark, folder, name, **tables):
    """Whether the query over these tables, each a dict of columns, has the rows of its SQL."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found, answer = QUERIES[name](spark, str(folder)), con.execute(SQL[name])
    named = [c[0] for c in answer.description]
    got = pd.DataFrame([tuple(r) for r in found.collect()], columns=found.columns, dtype=object)  # as objects, whole numbers stay whole beside nulls
    want = pd.DataFrame(answer.fetchall(), columns=named, dtype=object)
    assert sorted(found.columns) == sorted(named)
    assert plain(got, named) == plain(want, named)
    return len(got)


def test_scanned_files_of_equal_paths(spark, tmp_path):
    """Pages that share a path are a file each; one without content, and one whose own name looks like a video's."""
    ids = [5, 10, 300, 305, 11, 12, 4, 9, 3]
    urls = ["https://a/x"] * 4 + ["http://b/y", "http://b/z.mp4", "http://c/v.mp4", "http://c/w.mkv", "http://c/t"]
    html = ["é", "bb", None, "", "x", "y", "z", "q", "t"]
    assert same_as_sql(spark, tmp_path, "scanned_files", pages={"page_id": pa.array(ids, pa.int64()), "url": urls, "html": pa.array(html, pa.string())}) == 7


def test_captured_lines_of_odd_languages_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """Languages without a name or with an odd one, and one that no task writes as a whole."""
    folders = []
    monkeypatch.setattr(stream_queries, "shared_folder", lambda s, name: folders.append(shared_folder(s, name)) or folders[-1])
    monkeypatch.setattr(stream_queries, "CAPTURED_BYTES", 1000, raising=False)
    texts = [None, "", "a\r\nb\r\r\nc\n", "\r", *[f"line {k}\nö {k}\n\n" * 5 for k in range(200)]]
    langs = ["", None, "a/b =%", "é", *["en"] * 200]
    ids = [7, 3, 5, 9, *range(250, 50, -1)]
    documents = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())}
    assert same_as_sql(spark, tmp_path, "captured_lines", documents=documents) == 1 + 1 + 4 + 1 + 200 * 16
    written = Path(folders[0].removeprefix("file://"))
    sizes = [p.stat().st_size for p in written.rglob("part-*")]
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 4


@pytest.mark.parametrize("name", ["device_counters", "probe_facts", "captured_logs", "service_answers", "path_and_number_rules", "server_answers"])
def test_parsed_rows_are_dealt_to_many_tasks(spark, monkeypatch, name):
    """A small file is one split of a scan; what is parsed of it is dealt by the number of rows."""
    monkeypatch.setattr(queries, "SPREAD", 2, raising=False)
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() > 4


def test_keys_in_lower_case_keep_the_last(spark):
    tags = F.create_map(*[F.lit(x) for x in ("A", "1", "b", "2", "a", "3", "B", None)])
    row = spark.range(1).select(parsers.lower_keys(tags).alias("x"), parsers.lower_keys(F.lit(None).cast("map<string,string>")).alias("none"), parsers.lower_keys(F.create_map().cast("map<string,string>")).alias("empty")).first()
    assert tuple(row) == ({"a": "3", "b": None}, None, {})


def test_costly_columns_are_worked_out_once(spark):
    """The JSON of a probe is parsed once a row, the lines of a client are split once."""
    text = F.col("id").cast("string")
    plans = [spark.range(1).select(c(text).alias("x"))._jdf.queryExecution().optimizedPlan().toString() for c in (parsers.probed, parsers.drm_client)]
    assert plans[0].count("from_json(") == 1 and plans[1].count("split(") == 1


def test_failures_are_those_of_the_report(spark):
    """The names that fail, as one text, are those of the report, for videos, pictures and music; unknown facts fail as there."""
    types = ", ".join(f"{k} {KINDS[type(v)]}" for k, v in HEALTHY.items())
    rows = [HEALTHY | c | more | {"id": k} for k, (c, _) in enumerate(CHANGES) for more in ({}, {"output_bytes": None, "decode_errors": 1}, {"media_kind": "Audio"}, {"media_kind": None})]
    df = rows_of(spark, rows, types).withColumn("source_tags", F.create_map(F.lit("YEAR"), F.lit("1"))).withColumn("output_tags", F.when(F.col("id") % 2 == 0, F.create_map(F.lit("date"), F.lit("1"))))
    policy = verification.Policy(loudness_tolerance=1.0, peak_ceiling=0.0)
    both = verification.failures(verification.verified(df, policy), policy).select(F.array_join(checks.failed_names(F.col("checks")), ", ").alias("want"), "failed").collect()
    assert [r["failed"] for r in both] == [r["want"] for r in both] and len({r["failed"] for r in both}) > 20


@pytest.mark.parametrize("name", ["verification_report", "video_verification"])
def test_counting_failures_works_out_no_details(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in text and "outcome" not in text


@pytest.mark.parametrize("split", [1, 7, 40, 1 << 20])
def test_samples_are_read_by_splits_of_files(tmp_path, monkeypatch, split):
    """Each line of a tick's files by one split, whatever the splits' size; a file without a last line feed, empty files, odd lines."""
    monkeypatch.setattr(samples, "SPLIT", split, raising=False)
    want = [(f"c{k} é", float(k), None if k % 3 else k / 2) for k in range(40)]
    text = [json.dumps({"counter": c, "at": a, "value": v} if k % 2 else {"at": a, "more": [1], "counter": c, **({} if v is None else {"value": v})}, ensure_ascii=False) for k, (c, a, v) in enumerate(want)]
    for name, lines in {"tick=0/part-0": "\n".join(text[:20]) + "\n", "tick=0/part-1": "", "tick=0/part-2": "\n", "tick=1/part-0": "\n".join(text[20:])}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(lines, encoding="utf-8")
    reader = samples.SampleReader(str(tmp_path))
    splits = reader.partitions({"ticks": 0}, reader.latestOffset())
    rows = [tuple(row.values()) for s in splits for batch in reader.read(s) for row in batch.to_pylist()]
    assert sorted(rows, key=lambda r: r[1]) == want
    assert len(splits) > 2 * 40 if split < 40 else len(splits) >= 3


def test_what_is_pushed_is_written_to_a_file_a_task(spark, monkeypatch):
    """The recipient's files grow with the tasks that send, not with the calls; each change is in them once."""
    folders = []
    monkeypatch.setattr(stream_queries, "shared_folder", lambda s, name: folders.append((name, shared_folder(s, name))) or folders[-1][1])
    QUERIES["pushed_changes"](spark, SF).collect()
    taken = list(Path(dict(folders)["push-taken"].removeprefix("file://")).glob("*.json"))
    keys = [json.loads(line)["o_orderkey"] for p in taken for line in p.read_text().splitlines()]
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert len(keys) == len(set(keys)) == orders and len(taken) < orders / 50 / 1.5


def test_jobs_are_split_into_few_pieces(spark, tmp_path, monkeypatch):
    """Many jobs at once, one of them with half of all lines: pieces are few beside the lines, and what they carry is right."""
    given = []
    monkeypatch.setattr(stream_queries.blocks, "blocks", lambda lines, piece=None, blocks=stream_queries.blocks.blocks: given.append((lines, piece)) or blocks(lines, piece))
    n = 20_000
    events = {
        "event_id": pa.array(range(n), pa.int64()), "user_id": pa.array([0 if k % 2 else k * 7 % 500 for k in range(n)], pa.int64()),
        "value": [(k * 37 % 1000) * k / n / 8 for k in range(n)], "event_type": ["purchase" if k % 3001 == 0 else "view" for k in range(n)],
    }
    assert same_as_sql(spark, tmp_path, "progress_protocol", events=events) > n * 0.8
    lines, piece = given[0]
    assert lines.groupBy("job_id", piece).count().count() * 100 < lines.count()
