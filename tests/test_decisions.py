import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.functions import media
from siltstone.operators import decisions as D


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dispatch_gate(spark):
    def gate(free=None, active=False, bypass=False, paused=False):
        return tuple(one(spark, D.dispatch_gate(F.lit(10 * 1024**3), F.lit(free).cast("long"), F.lit(active), F.lit("Plex plays"), F.lit(bypass), F.lit(paused), F.lit(None).cast("string"))))

    assert gate() == (True, None) and gate(20 * 1024**3) == (True, None)
    assert gate(1536 * 1024**2) == (False, "Free disk space (1.5 GB) is below the 10 GB minimum.")
    assert gate(active=True) == (False, "Plex plays") and gate(active=True, bypass=True) == (True, None)
    assert gate(1, active=True, paused=True, bypass=True) == (False, "The queue is paused.")


def test_encoders(spark):
    caps = spark.createDataFrame([("hevc_qsv", "hevc", "Intel QSV", True, 0), ("libx265", "hevc", "CPU", True, 1), ("hevc_nvenc", "hevc", "NVIDIA NVENC", False, 2), ("libx264", "h264", "CPU", True, 3), ("h264_qsv", "h264", "Intel QSV", True, 4)], "name string, codec string, mode string, available boolean, place int")
    wanted = spark.createDataFrame([(1, "H265", "Auto", 10), (2, "hevc", "CPU", None), (3, "h264", "Auto", 10), (4, "h264", "Intel QSV", 10), (5, "h264", "Auto", 12), (6, "vp9", "Auto", 8), (7, "hevc", "VAAPI", 8), (8, "h264", "Auto", None)], "id int, codec string, mode string, bit_depth int")
    got = {r["id"]: (r["encoder"], r["failure"]) for r in D.chosen_encoders(wanted, caps).collect()}
    assert got == {1: ("hevc_qsv", None), 2: ("libx265", None), 3: ("libx264", None), 4: (None, "bit depth not supported"), 5: (None, "bit depth not supported"), 6: (None, "unknown codec"), 7: (None, "no available encoder"), 8: ("h264_qsv", None)}
    q = lambda e, r, n: tuple(one(spark, D.encoder_quality(F.lit(e).cast("string"), F.lit(r), F.lit(n))))
    assert q(None, 60, 0) == (51, 51, "CRF") and q("hevc_nvenc", 24, 1) == (24, 17, "CQ") and q("x_qsv", 3, 5) == (3, 0, "ICQ")
    assert one(spark, D.quality_acceleration(F.lit("hevc_NVENC"), F.lit(True))) == "Cuda" and one(spark, D.quality_acceleration(F.lit("hevc_nvenc"), F.lit(False))) == "None"


def test_recovery_exclusion_and_orphans(spark):
    jobs = spark.createDataFrame([(1, "Transcoding", 1, 0.5, None), (2, "Verifying", 3, 0.9, None), (3, "Completed", 3, 1.0, None)], "id int, status string, attempt int, progress double, error_message string")
    got = {r["id"]: (r["status"], r["progress"]) for r in D.recovered(jobs, 3).collect()}
    assert got == {1: ("Queued", 0.0), 2: ("Failed", 0.0), 3: ("Completed", 1.0)}
    why = lambda names, retries, quality: one(spark, D.immediate_exclusion(F.array(*[F.lit(n) for n in names]), F.lit(True), F.lit(retries), F.lit(quality).cast("int")))
    assert why(["Duration", "Size saving"], 0, 5) == "SizeSaving" and why([D.QUALITY], 1, 5) == "VmafAfterHigherQualityRetry"
    assert why([D.QUALITY], 0, 0) == "VmafAtMaximumQuality" and why([D.QUALITY], 0, 5) is None and why([D.QUALITY, "Duration"], 1, 5) is None
    now = dt.datetime(2024, 2, 1)
    files = spark.createDataFrame([("a", now - dt.timedelta(days=8)), ("b", now - dt.timedelta(days=8)), ("c", now)], "path string, modified_at timestamp")
    assert [r["path"] for r in D.orphans(files, files.where("path = 'b'"), F.lit(now)).collect()] == ["a"]


def test_sequences_and_groups(spark):
    frames = spark.createDataFrame([(1, k, *v) for k, v in enumerate([(1, 0.0), (0, 1.0), (1, 4.0), (0, 5.5), (1, 8.0)])] + [(2, 0, 0, 9.0)], "clip int, frame_no int, is_key int, ts double")
    assert dict(D.keyframe_offset(frames, "clip", F.lit(5.0)).collect()) == {1: 1.5, 2: None}
    samples = spark.createDataFrame([(1, "3d", 60.0), (1, "3d", 70.0), (1, "video", 90.0), (2, "video", -4.0)], "gpu int, engine string, busy double")
    assert sorted(tuple(r) for r in D.busiest(samples, "gpu", "engine", "busy").collect()) == [(1, "3d", 100.0), (2, "video", 0.0)]
    settings = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0)], "session int, setting string, rank int")
    ratings = spark.createDataFrame([(1, "a", "Worse"), (1, "b", "Acceptable"), (2, "a", "Worse")], "session int, setting string, rating string")
    assert [tuple(r) for r in D.recommended(settings, ratings).collect()] == [(1, "b")]
    assert one(spark, D.violations([(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(False), "c"), (F.lit(True), "d")])) == ["a", "d"]
    kv = spark.createDataFrame([("x", "1"), ("token", "s"), ("a", "2")], "key string, value string")
    assert D.exported(kv, ["x", "a"]).first()[0] == '{"a":"2","x":"1"}'


@pytest.mark.parametrize(
    ("path", "series", "want"),
    [
        ("TV/The Show (2019)/Season 01/the.show.S01E02.1080p.mkv", True, ("The Show", 2019)),
        ("Films/A_Film (1999)/a.film.1999.bluray.mkv", False, ("A Film", 1999)),
        ("Some.Film.2020.2160p.mkv", False, ("Some Film", 2020)),
        ("Show/x.mkv", True, ("Show", None)),
        ("1080p/Good Name.mkv", False, ("Good Name", None)),
        ("", False, None),
    ],
)
def test_titles(spark, path, series, want):
    got = one(spark, media.title_and_year(F.lit(path), F.lit(series)))
    assert (None if got is None else tuple(got)) == want


def test_media_expressions(spark):
    x = lambda c: one(spark, c)
    kind = lambda e, v, a: x(media.media_kind(F.lit(e).cast("string"), F.lit(v), F.lit(a)))
    assert [kind("JPG", True, False), kind(".mkv", True, True), kind(None, False, True), kind(".x", False, False)] == ["Image", "Video", "Audio", "Unknown"]
    fmt = lambda p, b=None: x(media.pixel_format(F.lit(p), F.lit(b).cast("int")))
    assert tuple(fmt("yuv420p10le")) == (10, 1) and tuple(fmt("rgb48be")) == (16, 3) and tuple(fmt("yuv422p", 12)) == (12, 2) and tuple(fmt("gray")) == (8, 0) and fmt(" ") is None
    assert [x(media.binary_size(F.lit(n))) for n in (512, 1536, 1024**2, 3 * 1024**4)] == ["512 B", "1.5 KB", "1 MB", "3 TB"]
    assert x(media.kept_out_of_mp4(F.lit("ac3, TrueHD"))) and not x(media.kept_out_of_mp4(F.lit("ac3"))) and not x(media.kept_out_of_mp4(F.lit(None).cast("string")))
    assert x(media.picture_subtitle(F.lit(" PGSSUB "))) and not x(media.picture_subtitle(F.lit("subrip"))) and x(media.primary_codec(F.lit(" aac , ac3"))) == "aac"
    assert x(media.marker_value(F.lit(" Tool:v1 "), "tool:")) == "v1" and x(media.marker_value(F.lit("Other"), "tool:")) is None
    assert x(media.content_type(F.lit(b"\x89PNG123"))) == "image/png" and x(media.rate_saving(F.lit(1000), F.lit(100.0), F.lit(50), F.lit(10.0))) == 50.0
    assert x(media.utc_stamp(F.lit(dt.datetime(2024, 3, 4, 5, 6, 7, 89000)))) == "20240304T050607089"


def test_policies_and_advice(spark):
    x = lambda c: one(spark, c)
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert x(D.auto_replaces(F.lit("ReadyToReplace"), yes, yes, no, no)) and not x(D.auto_replaces(F.lit("ReadyToReplace"), unknown, yes, no, no))
    assert x(D.kept_for_diagnosis(F.lit("Preview"), F.lit("Failed"))) and not x(D.kept_for_diagnosis(F.lit("Normal"), F.lit("Failed")))
    assert x(D.streak_excludes(F.lit(3), F.lit(3))) and not x(D.streak_excludes(F.lit(3), F.lit(0)))
    jobs = spark.createDataFrame([(1, "Completed"), (2, "Failed"), (3, "Queued"), (4, "Cancelled")], "id int, status string")
    assert sorted(r["id"] for r in D.clearable(jobs, spark.createDataFrame([(2,), (2,)], "job_id int")).collect()) == [1, 4]
    assert x(D.software_decode_helps(F.lit("x INIT_HW_device y"))) and not x(D.software_decode_helps(F.lit(None).cast("string")))
    assert "MKV" in x(D.explained(F.lit("Only possible from TEXT to text or bitmap to bitmap"))) and x(D.explained(F.lit("other"))) is None
    q = lambda names, measured, n, level: x(D.quality_retry(F.array(*[F.lit(v) for v in names]), F.lit(measured), F.lit(n), F.lit(level).cast("int")))
    assert q([D.QUALITY], True, 0, 5) and not q([D.QUALITY], True, 1, 5) and not q([D.QUALITY], False, 0, 5) and not q([D.QUALITY], True, 0, None) and not q([D.QUALITY, "Duration"], True, 0, 5)
    assert x(D.calibratable(yes, no, F.lit("Preserve"), yes)) and not x(D.calibratable(yes, no, F.lit("Exclude"), yes)) and not x(D.calibratable(no, yes, F.lit("Preserve"), yes))
    assert x(D.ladder(F.lit("AAC"))) == [96, 128, 160, 192, 256] and x(D.ladder(F.lit("flac"))) is None
    assert [x(D.effective_bitrate(F.lit(100), F.lit(n), F.lit(d))) for n, d in ((2, False), (5, False), (6, False), (6, True))] == [100, 300, 300, 100]


def test_output_spec(spark):
    def spec(kind, path, container, pictures=False, unfit=False, hdr=False, copies=True):
        rules = F.struct(F.lit(container).cast("string").alias("target_container"), F.lit("hevc").alias("target_video_codec"), F.lit(None if copies else "aac").cast("string").alias("video_audio_codec"), F.lit("opus").alias("target_audio_codec"), F.lit("JPEG").alias("target_image_format"), F.lit("TonemapToSdr").alias("hdr"))
        return tuple(one(spark, D.output_spec(F.lit(kind), F.lit(path), rules, F.lit(pictures), F.lit(unfit), F.lit(hdr), "/work/")))

    assert spec("Video", "a.b/Film.one.avi", "mp4", hdr=True) == ("mp4", "/work/a.b/Film.one.mp4", True)
    assert spec("Video", "x.avi", ".MOV", pictures=True)[0] == "mkv" and spec("Video", "x.avi", "mp4", unfit=True)[0] == "mkv" and spec("Video", "x.avi", "mp4", unfit=True, copies=False)[0] == "mp4"
    assert spec("Video", "d\\x.avi", None) == ("avi", "/work/d/x.avi", False) and spec("Unknown", "x", "mkv", unfit=True) == ("mkv", "/work/x.mkv", False)
    assert spec("Audio", "x.flac", "mp4", hdr=True) == ("opus", "/work/x.opus", False) and spec("Image", "x.png", None) == ("jpg", "/work/x.jpg", False)


def test_cleanup(spark):
    files = spark.createDataFrame([("failed", 1, "/w/a", 10), ("quarantine", 2, None, None), ("failed", 3, "/w/c", 5)], "kind string, id int, path string, bytes long")
    plan = lambda df, **o: D.cleanup_plan(df, [], 30, **o).first()
    first = plan(files)
    assert (first["files"], first["bytes"], len(first["token"])) == (3, 15, 64) and plan(files.orderBy(F.desc("id")).repartition(3)) == first
    assert len({first["token"], plan(files.where("id < 3"))["token"], plan(files, dry_run=True)["token"], plan(files.withColumn("bytes", F.lit(1).cast("long")))["token"], plan(files.limit(0))["token"]}) == 5
    now, old = dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(1, "Failed", "/w/a", old), (2, "Failed", "/w/b", old), (3, "Queued", "/w/b", None), (4, "Failed", "/w/c", now), (5, "Failed", "/work/x", old), (6, "Failed", "/w/d", None)], "id int, status string, path string, finished_at timestamp")
    assert [r["id"] for r in D.failed_outputs(jobs, "/w/", F.lit(now), 30).collect()] == [1]
    assert sorted(r["id"] for r in D.lapsed(jobs, "finished_at", F.lit(now)).collect()) == [1, 2, 4, 5]
