"""Requests, policies, transcodes and verdicts that are resolved row by row, by hand."""

from collections import Counter

from pyspark.sql import functions as F

from siltstone.operators import aggregates, decisions, joins, transcode, verification
from siltstone.sources import requests

GOOD = {"name": " Films ", "path": "/media ", "path_exists": True, "media_type": "FILM", "rule_profile": "conservativehevc"}


def rows_of(spark, cases, schema):
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(c.get(n) for n in names) for c in cases], schema)


def test_requests_give_their_first_error(spark):
    cases = [
        ({}, None),
        ({"name": "  ", "path": None}, "A library name is required."),
        ({"path": " "}, "A library path is required."),
        ({"path_exists": False}, "Directory does not exist: /media"),
        ({"media_type": "video"}, "Unknown media type: video. Expected one of Film, Tv, Music, Other, Photo."),
        ({"rule_profile": "TrackCleanup", "media_type": "photo"}, "Track cleanup applies only to Film, TV, or mixed libraries that can contain video files."),
        ({"rule_profile": "trackcleanup", "hdr_handling": "nothing"}, "Unknown HDR handling: nothing. Expected one of Preserve, Exclude, TonemapToSdr."),
        ({"hdr_handling": " ", "min_file_size_bytes": 0, "max_height": 0}, "Maximum resolution must be greater than zero."),
        ({"quality_crf": 64, "vmaf_p5": 101.0}, "Quality (CRF) must be between 0 and 63."),
        ({"vmaf_p5": float("nan")}, "VMAF overrides must be between 0 and 100."),
        ({"vmaf_min": 90.0, "vmaf_harmonic": 80.0}, "VMAF floors must be ordered: catastrophic frame ≤ fifth percentile ≤ harmonic mean."),
        ({"vmaf_frame_interval": 11}, "VMAF frame sampling must be between 1 and 10."),
        ({"video_audio_codec": "COPY", "audio_target_codec": "vorbis"}, "Unknown audio codec: vorbis. Expected one of opus, aac, mp3."),
        ({"keep_subtitle_languages": "eng,,qqq"}, 'Subtitle languages must be comma-separated, registered individual ISO 639 codes and at most 256 characters (e.g. "eng, jpn").'),
        ({"target_image_format": "avif"}, "Unsupported image format: avif. Expected one of jpeg, webp."),
        ({"image_downscale_mode": "percent", "image_downscale_value": 100}, "Image downscale percentage must be between 1 and 99."),
        ({"image_downscale_mode": "maxlongedge"}, "Image max long-edge must be between 16 and 100000 pixels."),
        ({"window_start": "24:00"}, "Auto-enqueue window start must use HH:mm format."),
        ({"move_on_complete": True, "target_folder": " /x ", "target_folder_exists": False}, "Target folder does not exist: /x"),
    ]
    found = requests.parsed(rows_of(spark, [GOOD | c for c, _ in cases], requests.REQUEST)).collect()
    assert Counter(r["error"] for r in found) == Counter(e for _, e in cases)
    stored = requests.parsed(rows_of(spark, [GOOD | {"keep_audio_languages": "ger, DEU,ja", "image_downscale_value": 5, "video_audio_codec": " AAC "}], requests.REQUEST)).first()
    assert (stored["name"], stored["path"], stored["media_type"], stored["rule_profile"], stored["enabled"], stored["priority"], stored["window_end"]) == ("Films", "/media", "Film", "ConservativeHevc", True, 0, "00:00")
    assert (stored["keep_audio_languages"], stored["keep_subtitle_languages"], stored["image_downscale_value"], stored["video_audio_codec"], stored["target_folder"]) == ("deu, jpn", None, 0, "aac", None)


def test_policies_are_resolved_within_bounds(spark):
    shape = "quality_gate boolean, least_vmaf_harmonic double, least_vmaf_p5 double, least_vmaf_min double, clip_gate boolean, frame_interval int"
    rows = spark.createDataFrame([(None,) * 6, (True, 120.0, -5.0, 55.5, True, 0), (False, 0.0, None, None, False, 99)], shape)
    got = [tuple(r) for r in rows.select(*[c.alias(n) for n, c in verification.resolved_policy().items()]).collect()]
    assert got == [(False, 93.0, 80.0, 50.0, False, 1), (True, 100.0, 0.0, 55.5, True, 1), (False, 0.0, 80.0, 50.0, False, 10)]


def test_verdicts_of_windows(spark):
    windows = spark.createDataFrame(
        [("a", 1, True, None, 90.0, 80.0, 70.0, 75.0, 2, "m", 40.0, 0.9, "x"), ("a", 2, True, None, 60.0, 0.0, 50.0, 55.0, None, " ", None, 0.8, "x"), ("b", 1, True, None, 1.0, 1.0, 1.0, 1.0, 1, "m", 1.0, 1.0, "x"), ("b", 2, False, "late", None, None, None, None, None, None, None, None, None)],
        "k string, n int, measured boolean, error string, mean double, harmonic double, least double, p5 double, frames int, model string, psnr double, ssim double, preprocessing string",
    )
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    got = {r["k"]: r for r in aggregates.combined_windows(windows, "k", "n", keys, F.lit("two windows")).collect()}
    assert (got["a"]["measured"], got["a"]["mean"], got["a"]["psnr"], round(got["a"]["ssim"], 6), got["a"]["preprocessing"], got["a"]["frames"]) == (True, 80.0, 40.0, 0.866667, "x; two windows", 2)
    assert (got["b"]["measured"], got["b"]["error"], got["b"]["psnr"]) == (False, "late", None)
    assert (got["c"]["measured"], got["c"]["error"], len(got)) == (False, "No VMAF samples were measured.", 3)


def test_calibration_takes_each_kind_by_its_rule(spark):
    rows = [(1, 1, "Probed", "Video", False, 48.0, None, 5), (2, 1, "Probed", "Video", True, 99.0, None, 9), (3, 1, "Probed", "Video", False, 47.9, None, 9), (4, 1, "Probed", "Audio", None, 60.0, None, 5), (5, 1, "Probed", "Image", None, None, None, 7), (6, 1, "Probed", "Image", None, None, 2, 9), (7, 2, "Probed", "Image", None, None, 1, 9), (8, 1, "Queued", "Image", None, None, 1, 9), (9, 1, "Probed", "Video", None, 99.0, None, 9)]
    df = spark.createDataFrame(rows, "id int, library_id int, status string, media_kind string, is_dolby_vision boolean, duration_seconds double, frame_count int, size_bytes long")
    assert [r["id"] for r in decisions.calibration_sources(df, 1).collect()] == [5, 1, 4]
    assert [r["id"] for r in decisions.calibration_sources(df, 1, 1).collect()] == [5]


def test_transcodes_are_resolved(spark):
    rules = "struct<target_container:string,target_video_codec:string,video_audio_codec:string,target_audio_codec:string,target_image_format:string,hdr:string,image_quality:int,audio_kbps:int,video_audio_kbps:int,downmix:boolean>"
    facts = "struct<picture_subtitles:boolean,audio_not_for_mp4:boolean,is_hdr:boolean,image_codec:string,channels:int,variable_frame_rate:boolean,audio_languages:array<string>,subtitle_languages:array<string>>"
    base = (".mp4", "hevc", None, "opus", "webp", "TonemapToSdr", 80, 96, 128, False)
    film = (False, False, True, None, 6, True, ["eng", "ger", None], ["fre", "eng"])
    rows = [
        ("Video", "a\\b.avi", base, film),
        ("Video", "c.mkv", (None, None, "AAC", *base[3:]), film),
        ("Image", "d.png", base, (None, None, None, "PNG", None, None, None, None)),
        ("Audio", "e.flac", base[:-1] + (True,), (None, None, None, None, 6, None, ["eng"], None)),
    ]
    df = spark.createDataFrame(rows, f"kind string, path string, rules {rules}, facts {facts}")
    spec = transcode.transcode_spec(F.col("kind"), F.col("path"), F.col("rules"), F.col("facts"), "/work/", ["eng"], ["eng"])
    a, b, c, d = (r["s"] for r in df.select(spec.alias("s")).collect())
    assert (a["output_path"], a["tonemap"], a["audio_encoder"], a["audio_kbps"], a["removed_audio"], a["removed_subtitles"], a["variable_frame_rate"]) == ("/work/a/b.mp4", True, None, None, [1], [0], True)
    assert (b["output_path"], b["tonemap"], b["video_codec"], b["audio_encoder"], b["audio_kbps"]) == ("/work/c.mkv", False, None, "aac", 384)
    assert (c["container"], c["image_encoder"], c["image_quality"], c["image_lossless"], c["video_codec"], c["removed_audio"]) == ("webp", "libwebp", 80, True, None, None)
    assert (d["container"], d["audio_encoder"], d["audio_kbps"], d["downmix"], d["removed_audio"]) == ("opus", "libopus", 96, True, None)


def test_removed_positions_go(spark):
    row = spark.range(1).select(joins.without_positions(F.array(*map(F.lit, "abcd")), F.array(F.lit(1), F.lit(9))).alias("x")).first()
    assert row["x"] == ["a", "c", "d"]
