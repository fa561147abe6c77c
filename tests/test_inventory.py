"""The composed inventory, pages, sources and aggregates on small frames."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import languages, parsers
from siltstone.operators import aggregates, filters, inventory, rules, sequences
from siltstone.sources import config, files

DAY = dt.datetime(2024, 1, 2)
FILE = "id long, library_id long, path string, relative_path string, size_bytes long, modified_at timestamp, status string, media_kind string, video_codec string, audio_codecs string, height int, width int, duration_seconds double, container string, is_hdr boolean, is_dolby_vision boolean, optimised_marker string, pixel_format string, bits_per_raw_sample int, frame_count int, attached_picture_count int, subtitle_track_count int, max_audio_channels int, source_audio_kbps int, audio_languages array<string>, subtitle_languages array<string>"


def file(n, library, name, marker=None, status="Probed"):
    return (n, library, f"/m/{name}", name, 4 << 30, DAY, status, "Video", "h264", "ac3", 1080, 1920, 3600.0, "matroska", False, False, marker, "yuv420p", None, None, 0, 0, 6, None, None, None)


@pytest.fixture(scope="module")
def frames(spark):
    rows = [file(1, 1, "a.mkv"), file(2, 1, "a.mp4", "v1"), file(3, 2, "a.avi"), file(4, None, "b.avi"), file(5, None, "b.mkv", "v1"), file(6, 9, "c.mkv"), file(7, 1, "d.mkv"), file(8, 1, "e.mkv"), file(9, 1, "f.mkv", status="Discovered"), file(10, 1, "g.mkv")]
    libraries = spark.createDataFrame([(1, "x", 5, "ExperimentalAv1"), (2, "y", 3, None)], "id long, name string, priority int, rule_profile string").withColumns({c: F.lit(None).cast("array<string>") for c in inventory.LISTS})
    jobs = spark.createDataFrame([(1, 7, "Normal", "Completed", DAY), (2, 8, "Normal", "Failed", DAY - dt.timedelta(1)), (3, 8, "Preview", "Completed", DAY), (4, 6, "Normal", "Queued", None), (5, 10, "Calibration", "Queued", None)], "id long, media_file_id long, type string, status string, finished_at timestamp")
    return spark.createDataFrame(rows, FILE), libraries, jobs, spark.createDataFrame([("/m/g.mkv",), ("/m/g.mkv",)], "path string")


def test_candidates(frames):
    got = {r["media_file_id"]: (r["profile"], r["eligible"], r["reason"]) for r in inventory.candidates(*frames).collect()}
    beside = "An optimised copy already exists alongside this file"
    assert got == {
        1: ("ExperimentalAv1", False, beside), 2: ("ExperimentalAv1", False, "Already optimised (file is tagged)"), 3: ("ConservativeHevc", True, "h264 → hevc"), 4: ("ConservativeHevc", False, beside),
        5: ("ConservativeHevc", False, "Already optimised (file is tagged)"), 6: ("ConservativeHevc", True, "h264 → hevc"), 7: ("ExperimentalAv1", False, "Already optimised"), 8: ("ExperimentalAv1", True, "h264 → av1"),
        10: ("ExperimentalAv1", False, "Excluded — won't be optimised"),
    }
    again = {r["media_file_id"]: r["eligible"] for r in inventory.candidates(frames[0], frames[1]).collect()}
    assert again[7] and again[10] and not again[1]


def test_enqueue_and_pages(spark, frames):
    decided = inventory.candidates(*frames)
    folders = spark.createDataFrame([("\\m\\a.avi", 0), ("", 1)], "folder string, place int")
    new, counts = inventory.enqueue(decided, frames[2], frames[1], folders, F.lit(DAY))
    assert [(r["media_file_id"], r["priority"], r["status"], r["enqueue_reason"]) for r in new.collect()] == [(8, 5, "Queued", "h264 → av1")]
    assert counts.first().asDict() == {"enqueued": 1, "active": 1, "ineligible": 6, "importing": 1}
    page, tallies = inventory.listing(frames[0], decided, None, "all", 2, 4)
    assert [r["relative_path"] for r in page.collect()] == ["b.mkv", "c.mkv", "d.mkv", "e.mkv"]
    assert tallies.first().asDict() == {"n_all": 10, "n_eligible": 3, "n_skipped": 6, "n_unprobed": 1}
    assert inventory.listing(frames[0], decided, None, "all", 3, 0)[0].count() == 10 and inventory.listing(frames[0], decided, "zzz")[0].isEmpty()


def test_pages_after_a_row(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(40)], "a int, b int")
    seen, last = [], None
    while part := [tuple(r) for r in filters.after(rows, ["a", "b"], last, 9).collect()]:
        seen, last = seen + part, part[-1]
    assert seen == sorted((k % 7, k) for k in range(40))


def test_an_allowed_value_is_found_without_regard_to_case(spark):
    kinds = ("Normal", "Preview")
    assert filters.member("type", None, kinds) is None
    assert spark.createDataFrame([("Normal",), ("Preview",)], "type string").where(filters.member("type", " normal ", kinds)).count() == 1
    with pytest.raises(ValueError, match="Normal, Preview"):
        filters.member("type", "odd", kinds)


def test_rescan_resets_changed_content(spark):
    state = spark.createDataFrame([("a", "a", 1, DAY, "Probed", "hevc", True), ("b", "b", 1, DAY, "Probed", "hevc", True), ("c", "c", 1, DAY, "Probed", "hevc", True)], "path string, relative_path string, size_bytes long, modified_at timestamp, status string, video_codec string, is_hdr boolean")
    scanned = spark.createDataFrame([("a", "a", 2, DAY), ("b", "moved/b", 1, DAY), ("d", "d", 1, DAY)], "path string, relative_path string, size_bytes long, modified_at timestamp")
    facts = ["status", "video_codec", "is_hdr"]
    got = {r["path"]: (r["relative_path"], r["status"], r["video_codec"], r["is_hdr"], r["action"]) for r in inventory.rescanned(state, scanned, facts).collect()}
    assert got == {"a": ("a", "Discovered", None, False, "updated"), "b": ("moved/b", "Probed", "hevc", True, "updated"), "d": ("d", "Discovered", None, False, "added")}


def test_profiles_by_other_names(spark):
    libraries = spark.createDataFrame([(1, "mine"), (2, "RemuxCleanup"), (3, "unknown")], "id int, rule_profile string")
    assert {r["id"]: r["profile"] for r in rules.resolved_rules(libraries, spark, {"mine": "SmallStereoHevc"}).collect()} == {1: "SmallStereoHevc", 2: "RemuxCleanup", 3: "ConservativeHevc"}


def test_languages_of_three_letters(spark):
    codes = ["fil", "HAW", "ast", "cnr", "ger", "en", "afa", "qaa", "und", "mul", "xx", "", None]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in codes], "c string").select(languages.canonical(F.col("c"))).collect()] == ["fil", "haw", "ast", "cnr", "deu", "eng", *[None] * 7]
    assert languages.parse_list(["fil", "ger", "deu"]) == ["fil", "deu"] and languages.parse_list(["fil", "afa"]) is None
    removed = languages.track_removals(F.array(F.lit("fil"), F.lit("eng"), F.lit("und")), ["en"])
    assert spark.range(1).select(removed.alias("x")).first()["x"] == [0]


def test_scan_below_a_root_with_a_quote(spark, tmp_path):
    root = tmp_path / "it's"
    root.mkdir()
    (root / "a film.MKV").write_bytes(b"x")
    (root / "poster.jpg").write_bytes(b"x")
    assert [r["relative_path"] for r in files.scan(spark, str(root), "Tv").collect()] == ["a film.MKV"]
    assert files.scan(spark, str(root)).count() == 2
    with pytest.raises(ValueError, match="Photo"):
        files.extensions_for("Vinyl")


def test_a_damaged_configuration_is_an_error(spark, tmp_path):
    good = {"version": 1, "settings": {"a": "1"}, "libraries": [{"name": "x", "path": "/x", "mediaType": "TV", "ruleProfile": "TrackCleanup", "imageDownscaleMode": "none", "autoEnqueueWindowStart": "00:00", "autoEnqueueWindowEnd": "9:00"}]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps(good)[:-9])
    read = config.read_config(spark, str(tmp_path / "good.json"))
    assert read.select(config.config_errors(read, ["a"]).alias("x")).first()["x"] == ["Library #1 auto-enqueue window end must use HH:mm format."]
    with pytest.raises(Exception, match="(?i)malformed"):
        config.read_config(spark, str(tmp_path / "bad.json")).collect()


def test_exact_percentile(spark):
    rng = random.Random(1)
    rows = [(k % 3 or None, rng.choice([rng.gauss(0, 1), 0.5, None, 1e9])) for k in range(2000)] + [(7, 2.0), (8, None), (9, 1.0), (9, 1.0), (9, 4.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    for share in (0.0, 0.05, 0.5, 0.973, 1.0):
        want = {r["g"]: r["p"] for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.lit(share)).alias("p")).collect()}
        got = {r["g"]: r["p"] for r in aggregates.exact_percentile(df, ["g"], "v", share, "p", bins=16).collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


def test_decode_errors_keep_their_digits(spark):
    log = F.lit("x\n line 1 of 2\n\n line 2 of 3\n")
    assert spark.range(1).select(parsers.decode_errors(log).alias("x")).first()["x"].asDict() == {"errors": 3, "first": "x"}
    assert spark.range(1).select(parsers.decode_errors(F.lit("\n\nbroken 2")).alias("x")).first()["x"]["first"] == "broken 2"


def test_windows_without_a_measured_one(spark):
    kind = "k int, n int, measured boolean, error string, mean double, harmonic double, least double, p5 double, frames int, model string"
    rows = [(1, 0, True, None, 90.0, 90.0, 50.0, 60.0, 10, "a"), (1, 1, True, None, 80.0, 0.0, 40.0, 70.0, None, "a"), (2, 0, True, None, 1.0, 1.0, 1.0, 1.0, 1, "a"), (2, 2, False, "late", None, None, None, None, None, None), (2, 1, None, None, None, None, None, None, None, None)]
    got = {r["k"]: r for r in aggregates.combined_windows(spark.createDataFrame(rows, kind), "k", "n").collect()}
    assert (got[1]["measured"], got[1]["error"], got[1]["least"], got[1]["p5"], got[1]["frames"], got[1]["model"]) == (True, None, 40.0, 60.0, 10, "a")
    assert got[1]["mean"] == pytest.approx(980 / 11) and got[1]["harmonic"] == 90.0
    assert (got[2]["measured"], got[2]["error"], got[2]["mean"]) == (False, "A VMAF sample produced no usable score.", None)


def test_pieces_of_a_key_carry_over(spark):
    """Every sequence gives the same result in one window a key and in pieces, whatever they begin and end with."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), n, rng.choice([None, *range(9)]), rng.choice("frx"), rng.randrange(-4, 5)) for n in range(400)]
    df = spark.createDataFrame(rows, "k int, n int, v int, e string, d int")
    failed, reset, order = F.col("e") == "f", F.col("e") == "r", ["n"]
    cases = [
        lambda **o: sequences.high_water(df, "k", order, F.col("v"), "x", **o), lambda **o: sequences.streaks(df, "k", order, failed, reset, "x", **o), lambda **o: sequences.blocks(df, "k", order, reset, "x", **o),
        lambda **o: aggregates.clamped_counter(df, "k", order, "d", "x", **o), lambda **o: sequences.regressions(df, "k", order, "v", "n", **o),
    ]
    for case in cases:
        want = case()
        for size in (1, 7, 1000):
            got = case(piece=F.floor(F.col("n") / size))
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_probes_are_drained_in_batches(spark, tmp_path):
    from siltstone.streaming import probing, progress

    (tmp_path / "in").mkdir()
    good = json.dumps({"format": {"format_name": "avi"}, "streams": [{"codec_type": "video", "codec_name": "h264"}]})
    outputs = [(good, None), ("{bad", None), (None, "no such file"), (good, " "), (good, None)]
    for k, (output, error) in enumerate(outputs):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"path": f"/m/{k}", "output": output, "error": error}))
    for _ in range(2):  # the second finds nothing new
        stream = probing.read_probes(spark, str(tmp_path / "in"), 2)
        progress.drain(stream, str(tmp_path / "state"), probing.into(str(tmp_path / "out")))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    got = {r["path"]: (r["status"], r["probe_error"], r["facts"] and r["facts"]["video_codec"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    unread = ("ProbeFailed", "The probe's output could not be read.", None)
    assert got == {"/m/0": ("Probed", None, "h264"), "/m/1": unread, "/m/2": ("ProbeFailed", "no such file", None), "/m/3": ("Probed", None, "h264"), "/m/4": ("Probed", None, "h264")}
