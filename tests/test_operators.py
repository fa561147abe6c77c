"""Operators on small frames; expected values are worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import languages, parsers, scalars
from siltstone.operators import aggregates, checks, joins, merge, rules, sequences, verification
from siltstone.sources import files
from siltstone.streaming import progress

GIB = 1 << 30
VIDEO = {
    "media_kind": "Video", "relative_path": "Films/a.mkv", "size_bytes": 4 * GIB, "duration_seconds": 3600.0, "container": "matroska,webm", "video_codec": "h264", "width": 1920, "height": 1080,
    "frame_count": None, "pixel_format": "yuv420p", "bits_per_raw_sample": None, "attached_picture_count": 0, "audio_codec": "ac3", "audio_languages": ["eng", "fra"], "max_audio_channels": 6,
    "source_audio_kbps": None, "subtitle_track_count": 1, "subtitle_languages": ["ger"], "is_hdr": False, "is_dolby_vision": False, "optimised_marker": None,
}
LIBRARY = {"rule_profile": "ConservativeHevc", "exclude_segments": None, "keep_audio_languages": None, "keep_subtitle_languages": None}
TYPES = (
    "media_kind string, relative_path string, size_bytes long, duration_seconds double, container string, video_codec string, width int, height int, frame_count int, pixel_format string, bits_per_raw_sample int, "
    "attached_picture_count int, audio_codec string, audio_languages array<string>, max_audio_channels int, source_audio_kbps int, subtitle_track_count int, subtitle_languages array<string>, is_hdr boolean, is_dolby_vision boolean, optimised_marker string, "
    "rule_profile string, exclude_segments array<string>, keep_audio_languages array<string>, keep_subtitle_languages array<string>, hdr string, min_file_size_bytes long, max_height int, reencode_same_codec_above_bytes long, optimise_dolby_vision boolean, "
    "skip_efficient_sources boolean, reencode_lossy_audio boolean, reencode_lossy_images boolean, target_image_format string, target_video_codec string, target_container string, downmix_to_stereo boolean, id int, target_audio_codec string"
)
AUDIO = {"media_kind": "Audio", "audio_codec": "flac", "size_bytes": 40 << 20, "max_audio_channels": 2, "subtitle_track_count": 0}
IMAGE = {"media_kind": "Image", "video_codec": "png", "size_bytes": 4 << 20, "pixel_format": "rgb24", "frame_count": 1}
DENSE = {"size_bytes": 300 << 20}
CASES = [
    ({}, True, "h264 → hevc"),
    ({"optimised_marker": "x"}, False, "Already optimised (file is tagged)"),
    ({"video_codec": None}, False, "No video stream detected (not probed, or audio-only)"),
    ({"exclude_segments": ["nothing", "FILMS"]}, False, 'Path excluded by rule: "FILMS"'),
    ({"is_hdr": True}, False, "HDR / Dolby Vision excluded by this library's rules"),
    ({"is_hdr": True, "hdr": "Preserve"}, True, "h264 → hevc"),
    ({"is_dolby_vision": True}, False, "Dolby Vision — re-encoding would drop the DV layer and risk a colour shift (Profile 5); left untouched"),
    ({"is_dolby_vision": True, "optimise_dolby_vision": True}, True, "h264 → hevc"),
    ({"size_bytes": 100 << 20}, False, "Below minimum size (200 MB)"),
    ({"min_file_size_bytes": 6 * GIB + GIB // 2}, False, "Below minimum size (6.5 GB)"),
    ({"max_height": 720}, False, "Resolution 1080p above limit (720p)"),
    ({"height": None, "max_height": 720}, True, "h264 → hevc"),
    ({"video_codec": "HEVC"}, False, "Already hevc (no expected saving)"),
    ({"video_codec": "hevc", "reencode_same_codec_above_bytes": 4 * GIB}, True, "Already hevc but 4 GB ≥ 4 GB — re-encoding to shrink"),
    (DENSE, False, "Already efficiently encoded (~0.7 Mbps at 1080p) — re-encoding is unlikely to save space"),
    (DENSE | {"skip_efficient_sources": False}, True, "h264 → hevc"),
    (DENSE | {"duration_seconds": 0.0}, True, "h264 → hevc"),
    (DENSE | {"rule_profile": "ExperimentalAv1"}, True, "h264 → av1"),
    ({"rule_profile": None}, True, "h264 → hevc"),
    ({"rule_profile": "RemuxCleanup"}, False, "Already in the target container (mkv)"),
    ({"rule_profile": "RemuxCleanup", "container": "mov,mp4"}, True, "Remux to mkv (mov,mp4 → mkv)"),
    ({"rule_profile": "RemuxCleanup", "keep_audio_languages": ["en"]}, True, "Remove 1 audio track(s) (fra) not in the kept languages"),
    ({"rule_profile": "TrackCleanup"}, False, "No kept audio or subtitle languages configured — nothing to remove"),
    ({"rule_profile": "TrackCleanup", "target_video_codec": "av1", "keep_audio_languages": ["eng"], "keep_subtitle_languages": ["eng"]}, True, "Remove 1 audio track(s) (fra) + 1 subtitle track(s) (ger) not in the kept languages"),
    ({"rule_profile": "TrackCleanup", "keep_audio_languages": ["spa"]}, False, "No removable tracks (all tracks match the kept languages or are unknown)"),
    ({"rule_profile": "TrackCleanup", "keep_audio_languages": ["eng"], "audio_languages": None}, False, "Track languages not captured yet — re-probe the file to evaluate the kept-languages rule"),
    (AUDIO | {"rule_profile": "TrackCleanup"}, False, "Track cleanup applies only to video files"),
    (AUDIO, True, "flac → aac"),
    (AUDIO | {"audio_codec": ""}, False, "No audio stream detected"),
    (AUDIO | {"size_bytes": 3 << 20}, False, "Below minimum size (4 MB)"),
    (AUDIO | {"audio_codec": "AAC"}, False, "Already aac (no expected saving)"),
    (AUDIO | {"attached_picture_count": 1}, False, "aac cannot safely preserve embedded cover art with the shipped FFmpeg; choose MP3 for this library"),
    (AUDIO | {"target_audio_codec": "opus", "subtitle_track_count": 1}, False, "opus cannot preserve the embedded timed lyrics/subtitle stream"),
    (AUDIO | {"target_audio_codec": "mp3", "max_audio_channels": 6}, False, "mp3 cannot safely encode the 6-channel layout; enable stereo downmix or choose another codec"),
    (AUDIO | {"target_audio_codec": "mp3", "max_audio_channels": 6, "downmix_to_stereo": True}, True, "flac → mp3"),
    (AUDIO | {"audio_codec": "mp3"}, False, "mp3 is already a space-efficient (lossy) codec — left untouched"),
    (AUDIO | {"audio_codec": "mp3", "reencode_lossy_audio": True}, False, "mp3 source bitrate unknown — cannot confirm a saving, left untouched"),
    (AUDIO | {"audio_codec": "mp3", "reencode_lossy_audio": True, "source_audio_kbps": 159}, False, "mp3 at 159 kbps is not far enough above the 128 kbps target to save space — left untouched"),
    (AUDIO | {"audio_codec": "mp3", "reencode_lossy_audio": True, "source_audio_kbps": 160}, True, "mp3 160 kbps → aac 128 kbps"),
    (IMAGE, False, "png → jpeg is a lossy conversion; explicit opt-in required"),
    (IMAGE | {"target_image_format": "webp"}, True, "png → webp"),
    (IMAGE | {"reencode_lossy_images": True}, True, "png → jpeg"),
    (IMAGE | {"video_codec": "gif", "frame_count": None}, False, "Frame count could not be proven for an animated-capable image"),
    (IMAGE | {"frame_count": 5}, False, "Animated image (5 frames) — not optimised"),
    (IMAGE | {"size_bytes": 1000}, False, "Below minimum size (0.2 MB)"),
    (IMAGE | {"video_codec": "mjpeg"}, False, "Already jpeg (no expected saving)"),
    (IMAGE | {"video_codec": "tiff"}, False, "TIFF multi-page status cannot be proven safely"),
    (IMAGE | {"video_codec": "webp"}, False, "webp is already a compressed (lossy) image — left untouched"),
    (IMAGE | {"pixel_format": "rgba"}, False, "Target format cannot safely preserve the source alpha channel"),
    (IMAGE | {"pixel_format": None, "target_image_format": "webp"}, False, "Target format cannot safely preserve the source bit depth"),
    (IMAGE | {"pixel_format": "rgb48be", "target_image_format": "webp"}, False, "Target format cannot safely preserve the source bit depth"),
]


def rows_of(spark, dicts, types):
    names = [t.split()[0] for t in types.split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], types)


def test_candidate_matrix(spark):
    files_ = rows_of(spark, [VIDEO | LIBRARY | change | {"id": k} for k, (change, *_) in enumerate(CASES)], TYPES)
    got = {r["id"]: r["decision"] for r in rules.evaluate(rules.resolved_rules(files_, spark)).select("id", "decision").collect()}
    wrong = [(CASES[k][0], got[k]["reason"], CASES[k][2]) for k in range(len(CASES)) if (got[k]["eligible"], got[k]["reason"]) != CASES[k][1:]]
    assert not wrong


def test_overlays(spark):
    day = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(k, *v) for k, v in enumerate([(True, None, None, None), (True, True, None, None), (True, False, day, day), (True, False, None, day), (False, True, day, None), (True, None, None, None)])], "id int, ok boolean, sibling boolean, done timestamp, failed timestamp")
    decision = F.struct(F.col("ok").alias("eligible"), F.lit("rule").alias("reason"))
    out = rules.overlaid(decision, F.col("sibling"), F.col("done"), F.col("failed"), F.lit(day), F.col("id") == 5)
    got = [r[0]["reason"] for r in df.orderBy("id").select(out.alias("d")).collect()]
    assert got == ["rule", "An optimised copy already exists alongside this file", "Already optimised", "Previously failed — retry from the Queue page", "rule", "Excluded — won't be optimised"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("message", "category"),
    [("Verification failed: Size saving", "SizeSaving"), ("Verification failed: A/V sync", "Verification"), ("no tag for codec none in stream #37", "ContainerIncompatibility"), ("from text to text or bitmap to bitmap", "BitmapSubtitles"), ("would collide with an existing file.", "ReplacementCollision"), ("it no longer exists", "SourceMissing"), ("odd", "Other"), (None, "Other"), (" ", "Other")],
)
def test_failure_categories(spark, message, category):
    assert one(spark, rules.classify_failure(F.lit(message).cast("string"))) == category


def test_scalars(spark):
    x = lambda c: one(spark, c)
    assert x(scalars.path_stem(F.lit("a/b.c/film.2020.mkv"))) == "a/b.c/film.2020" and x(scalars.path_stem(F.lit("a/b."))) == "a/b."
    assert x(scalars.human_size(F.lit(1536 << 20))) == "1.5 GB" and x(scalars.human_size(F.lit(200 << 20))) == "200 MB"
    assert x(scalars.rational(F.lit("24000/1001"))) == pytest.approx(23.976, abs=1e-3) and x(scalars.rational(F.lit("0/0"))) is None
    assert x(scalars.saving_percent(F.lit(1000.0), F.lit(500.0))) == 50.0 and x(scalars.saving_percent(F.lit(0.0), F.lit(0.0))) == 0.0
    assert [x(scalars.in_daily_window(F.lit(m), 22 * 60, 360)) for m in (1320, 359, 360, 1000)] == [True, True, False, False]
    assert x(scalars.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None and x(scalars.duration_text(F.lit(3725))) == "1h 2m"
    assert x(scalars.remaining_seconds(F.lit(100.0), F.lit(40.0), F.lit(2.0))) == 30.0 and x(scalars.remaining_seconds(F.lit(100.0), F.lit(40.0), F.lit(0.0))) is None


def test_languages(spark):
    remove = lambda langs, keep, **o: one(spark, languages.track_removals(F.lit(langs) if langs is None else F.array(*[F.lit(v) for v in langs]), keep, **o))
    assert remove(["fra", "eng", "spa"], ["eng"]) == [0, 2] and remove(["jpn", "eng", "kor"], ["en", "jpn"]) == [2] and remove(["fra", "spa"], ["eng"]) == []
    assert remove(["und", "mul", "eng", "fre"], ["eng"]) == [3] and remove(["fra"], ["eng"], guard=False) == [0]
    assert languages.parse_list(["en", "ger", "deu"]) == ["eng", "deu"] and languages.parse_list(["en", "xx-bad"]) is None


def test_window_scores(spark):
    df = spark.createDataFrame([(94.0, 93.0, 50.0, 100), (90.0, 88.0, 42.0, 200), (92.0, 91.0, 47.0, 100)], "mean double, harmonic double, least double, frames int")
    r = df.agg(aggregates.weighted_mean(F.col("mean"), F.col("frames")).alias("m"), aggregates.harmonic_mean(F.col("harmonic"), F.col("frames")).alias("h"), F.min("least").alias("l")).first()
    assert r["m"] == 91.5 and r["h"] == pytest.approx(400 / (100 / 93 + 200 / 88 + 100 / 91)) and r["l"] == 42.0
    hundred = spark.range(1, 101).agg(F.percentile("id", F.lit(0.05)).alias("p")).first()["p"]
    assert hundred == pytest.approx(5.95)
    nulls = spark.createDataFrame([(None, 5), (10.0, None)], "v double, n int").agg(aggregates.weighted_mean(F.col("v"), F.col("n")).alias("m"), aggregates.guarded_mean(F.col("v"), F.col("n")).alias("g")).first()
    assert nulls["m"] == 10.0 and nulls["g"] == 10.0


def test_clamped_counter_and_streaks(spark):
    deltas = [3, -5, 2, -1, -9, 4]
    df = spark.createDataFrame([(1, k, d) for k, d in enumerate(deltas)], "u int, k int, d int")
    total, want = 0, []
    for d in deltas:
        total = max(0, total + d)
        want.append(total)
    assert [r["c"] for r in aggregates.clamped_counter(df, "u", ["k"], "d", "c").orderBy("k").collect()] == want
    kinds = spark.createDataFrame([(1, k, v) for k, v in enumerate("ffrfxff")], "u int, k int, v string")
    got = sequences.streaks(kinds, "u", ["k"], F.col("v") == "f", F.col("v") == "r", "s").orderBy("k")
    assert [r["s"] for r in got.collect()] == [1, 2, 0, 1, 1, 2, 3]


def test_regressions_skip_unknown_stamps(spark):
    lines = spark.createDataFrame([("a", k, v) for k, v in enumerate(["0.1,0.0", "0.3,0.2", "0.2,N/A", "0.5,0.1", "bad", "0.4,0.2"])], "stream string, n int, line string")
    p = parsers.packets(lines, "stream", "n", F.col("line"))
    r = sequences.regressions(p, "stream", ["n"], "dts", "n").first()
    assert (r["n"], r["regressions"], r["first_regression"], r["greatest"]) == (4, 1, 3, 0.2)


def test_emitted_changes_and_head_tail(spark):
    assert one(spark, sequences.emitted_changes(F.array(*[F.lit(v) for v in (0.004, 0.012, 0.015, 0.022, 0.5)]), 0.01)) == [0.012, 0.022, 0.5]
    df = spark.createDataFrame([(1, k) for k in range(10)] + [(2, 0)], "j int, k int")
    got = sequences.head_and_tail(df, "j", ["k"], 2, 3).orderBy("j", "k").collect()
    assert [(r["j"], r["k"], r["elided"]) for r in got] == [(1, 0, 5), (1, 1, 5), (1, 7, 5), (1, 8, 5), (1, 9, 5), (2, 0, 0)]


def test_joins(spark):
    paths = spark.createDataFrame([(1, "/tv/show/a.mkv"), (2, "/tv/showcase/b"), (3, "/films"), (4, None)], "id int, path string")
    folders = spark.createDataFrame([("/tv/show", 2), ("/tv", 1), ("/films", 3), ("", 0)], "folder string, place int")
    got = {r["id"]: r["f"] for r in joins.under_folders(paths, "path", folders, "folder", F.min_by("folder", "place"), "f").collect()}
    assert got == {1: "/tv", 2: "/tv", 3: "/films", 4: None}
    rows = spark.createDataFrame([(1, None, "s", False), (2, None, "s", True), (3, 7, "s", False)], "id int, lib int, stem string, marked boolean")
    flags = {r["id"]: r["x"] for r in joins.sibling_flag(rows, ["lib", "stem"], F.col("marked"), "x").collect()}
    assert flags == {1: True, 2: False, 3: False}
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, joins.first_difference(arr("a", "b"), arr("a", "c"))) == 1 and one(spark, joins.first_difference(arr("a"), arr("a"))) is None
    assert one(spark, joins.without_positions(arr("a", "b", "c"), arr(1))) == ["a", "c"]
    tags = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p])
    assert one(spark, joins.tags_preserved(tags(Title="x"), tags(TITLE="x", more="y"))) and not one(spark, joins.tags_preserved(tags(title="x"), tags(title="z")))


def test_diff_is_idempotent_and_cascades(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "path string, size int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4), ("c", None)], "path string, size int")
    assert {r["path"]: r["action"] for r in merge.diff(old, new, "path", ["size"]).collect()} == {"a": "unchanged", "b": "updated", "c": "unchanged", "d": "added"}
    assert merge.diff(new, new, "path", ["size"]).where("action <> 'unchanged'").count() == 0
    assert dict(merge.upsert(old, new.where("path = 'b'"), ["path"]).collect()) == {"a": 1, "b": 3, "c": None}
    parents, children = merge.delete_cascade(old, new, "path", old.where("path = 'a'").select("path"))
    assert parents.count() == 2 and children.count() == 3


def test_probe_and_logs(spark):
    probe = {
        "streams": [
            {"codec_type": "video", "codec_name": "mjpeg", "disposition": {"attached_pic": 1}},
            {"codec_type": "video", "codec_name": "hevc", "width": 3840, "height": 2160, "pix_fmt": "yuv420p10le", "r_frame_rate": "24000/1001", "avg_frame_rate": "24000/1001", "color_transfer": "smpte2084", "side_data_list": [{"side_data_type": "DOVI configuration record"}]},
            {"codec_type": "audio", "codec_name": "eac3", "channels": 6, "tags": {"language": "eng"}},
            {"codec_type": "audio", "codec_name": "aac", "channels": 2},
            {"codec_type": "subtitle", "tags": {"language": "fre"}},
        ],
        "format": {"format_name": "matroska,webm", "duration": "120.5", "tags": {"TITLE": "x"}},
    }
    r = one(spark, parsers.probed(F.lit(json.dumps(probe))))
    assert (r["video_codec"], r["width"], r["duration_seconds"], r["attached_picture_count"], r["max_audio_channels"]) == ("hevc", 3840, 120.5, 1, 6)
    assert r["audio_languages"] == ["eng", "und"] and r["subtitle_languages"] == ["fre"] and r["is_hdr"] and r["is_dolby_vision"] and r["variable_frame_rate"] is False
    assert r["format_tags"] == {"title": "x"} and one(spark, parsers.probed(F.lit("{bad")))["video_codec"] is None
    assert one(spark, parsers.import_folders(F.lit('{"records":[{"series":{"path":"/tv/a"}},{"movie":{"path":"/m"}},{"series":{"path":"/tv/a"}},{}]}'))) == ["/tv/a", "/m"]
    assert one(spark, parsers.session_elements(F.lit('<C size="5"><V/><V/></C>'))) == 2 and one(spark, parsers.session_elements(F.lit('<C size="5"/>'))) == 5
    assert one(spark, parsers.playing_sessions(F.lit('[{"NowPlayingItem":{"Name":"x"}},{}]'))) == 1
    assert one(spark, parsers.loudness(F.lit("I:  -23.1 LUFS\nPeak: -1.5 dBFS"))).asDict() == {"integrated": -23.1, "true_peak": -1.5}
    assert one(spark, parsers.last_similarity(F.lit("All:0.91 x\nAll:0.95 y"))) == 0.95
    assert one(spark, parsers.decode_errors(F.lit("\nNon monotonically increasing dts\nbroken\n")))["errors"] == 1
    assert one(spark, parsers.progress_line(F.lit("fps= 30 time=01:02:03.50 speed=1.5x"))).asDict() == {"elapsed": 3723.5, "fps": 30.0, "speed": 1.5}
    assert one(spark, parsers.cpu_sample(F.lit("cpu  100 0 50 800 40 0 10 0"))).asDict() == {"total": 1000, "idle": 840} and one(spark, parsers.cpu_sample(F.lit("cpu 1 2"))) is None
    report = '{"checks":[{"name":"A","outcome":"Failed"},{"name":"B","outcome":"Passed"}]}'
    assert [c["name"] for c in one(spark, parsers.failed_checks(F.lit(report)))] == ["A"] and one(spark, parsers.failed_checks(F.lit("{x"))) == []


HEALTHY = {
    "id": 0, "media_kind": "Video", "decode_errors": 0, "output_probed": True, "source_duration": 3600.0, "output_duration": 3600.0, "source_audio_tracks": 2, "output_audio_tracks": 2, "removed_audio_tracks": None,
    "source_subtitle_tracks": 1, "output_subtitle_tracks": 1, "removed_subtitle_tracks": None, "source_bytes": 10**9, "output_bytes": 6 * 10**8, "output_video_codec": "hevc", "expected_video_codec": "hevc", "source_is_hdr": False,
    "output_is_hdr": False, "source_video_start": 0.0, "source_audio_start": 0.0, "output_video_start": 0.0, "output_audio_start": 0.0, "timestamp_regressions": 0, "output_timestamps_measured": True, "output_last_presentation": 3600.0,
    "source_timestamps_measured": False, "source_last_presentation": 3600.0, "vmaf_harmonic": 94.5, "vmaf_p5": 90.0, "vmaf_min": 88.0, "least_vmaf_harmonic": 92.0, "source_loudness": -23.0, "output_loudness": -23.0, "source_peak": -1.0, "output_peak": -1.0,
    "video_reencoded": True, "source_video_codec": "h264", "source_width": 1920, "source_height": 1080, "output_width": 1920, "output_height": 1080, "source_pixel_format": "yuv420p", "output_pixel_format": "yuv420p10le",
    "source_video_profile": "High", "output_video_profile": "Main 10", "container_fixed": False, "source_container": "matroska", "output_container": "Matroska", "source_color_primaries": "bt709", "output_color_primaries": "BT709", "tone_mapped": False,
    "source_audio_channels": 6, "output_audio_channels": 6, "source_sample_rate": 48000, "output_sample_rate": 48000, "downmixed": False, "audio_reencoded": False, "downscaled": False, "ssim": 0.99, "image_metadata_measured": True, "source_has_exif": True,
    "output_has_exif": True, "source_attached_pictures": 1, "output_attached_pictures": 1, "quality_gate": True,
}
KINDS = {int: "long", float: "double", str: "string", bool: "boolean", type(None): "long"}
IMAGE, AUDIO = {"media_kind": "Image"}, {"media_kind": "Audio"}
CHANGES = [
    ({}, None), ({"decode_errors": 3}, "Decode health"), ({"output_duration": 3500.0}, "Duration"), ({"output_duration": None}, "Duration"), ({"output_audio_tracks": 1}, "Audio tracks"), ({"output_audio_tracks": 1, "removed_audio_tracks": 1}, None),
    ({"removed_audio_tracks": 1}, "Audio tracks"), ({"output_audio_tracks": 1, "removed_audio_tracks": 2}, None), ({"output_subtitle_tracks": 0}, None), ({"removed_subtitle_tracks": 1}, "Subtitle tracks"), ({"output_bytes": 10**9}, "Size saving"),
    ({"output_bytes": 0}, "Size saving"), ({"output_video_codec": "h264"}, "Video structure"), ({"output_width": 1280}, "Video structure"), ({"source_pixel_format": None}, "Video structure"), ({"source_pixel_format": "yuv422p"}, "Video structure"),
    ({"output_video_profile": "Main"}, "Video structure"), ({"video_reencoded": False, "source_video_codec": "hevc"}, "Video structure"), ({"source_is_hdr": True}, "HDR signal"), ({"source_is_hdr": True, "tone_mapped": True}, None),
    ({"output_color_primaries": "bt2020"}, "Colour metadata"), ({"output_color_primaries": None}, None), ({"output_color_primaries": "bt2020", "tone_mapped": True}, "Colour metadata"), ({"output_audio_start": 0.6}, "A/V sync"),
    ({"output_audio_start": 0.6, "source_audio_start": 0.6}, None), ({"output_audio_start": 0.6, "source_audio_start": None}, "A/V sync"), ({"timestamp_regressions": 1}, "Timestamp integrity"), ({"output_timestamps_measured": False, "timestamp_regressions": 1}, None),
    ({"output_last_presentation": 3500.0}, "Tail integrity"), ({"output_last_presentation": 3540.0}, None), ({"source_timestamps_measured": True, "source_last_presentation": 3000.0}, "Source video timeline"), ({"vmaf_harmonic": None}, "Perceptual quality (VMAF)"),
    ({"vmaf_p5": 70.0}, "Perceptual quality (VMAF)"), ({"vmaf_p5": None}, None), ({"vmaf_harmonic": 92.5}, None), ({"vmaf_harmonic": 92.5, "least_vmaf_harmonic": None}, "Perceptual quality (VMAF)"), ({"quality_gate": False, "vmaf_p5": 70.0}, None),
    ({"output_loudness": -20.0}, "Audio loudness (EBU R128)"), ({"output_peak": 0.5}, "Audio clipping (true peak)"), ({"output_peak": None}, "Audio clipping (true peak)"), ({"output_audio_channels": 2}, "Audio fidelity"), ({"output_audio_channels": 2, "downmixed": True}, None),
    ({"output_sample_rate": 44100}, "Audio fidelity"), ({"output_sample_rate": 44100, "audio_reencoded": True}, None), ({"container_fixed": True, "output_container": "mp4"}, "Container unchanged"), ({"container_fixed": True}, None),
    (IMAGE, None), (IMAGE | {"output_video_codec": " "}, "Picture"), (IMAGE | {"output_width": 960, "output_height": 540}, "Dimensions"), (IMAGE | {"output_width": 960, "output_height": 540, "downscaled": True}, None),
    (IMAGE | {"output_width": 960, "output_height": 600, "downscaled": True}, "Dimensions"), (IMAGE | {"source_width": None, "output_width": 1}, None), (IMAGE | {"ssim": None}, "Image quality (SSIM)"), (IMAGE | {"output_has_exif": False}, "Image metadata (EXIF/ICC)"),
    (IMAGE | {"image_metadata_measured": False}, "Image metadata (EXIF/ICC)"), (AUDIO | {"output_attached_pictures": 0}, "Audio metadata and artwork"), (AUDIO | {"output_sample_rate": 44100}, None),
]


def test_verification_matrix(spark):
    types = ", ".join(f"{k} {KINDS[type(v)]}" for k, v in HEALTHY.items())
    df = rows_of(spark, [HEALTHY | c | {"id": k} for k, (c, _) in enumerate(CHANGES)], types)
    df = df.withColumn("expected_audio_codecs", F.array(F.lit("eac3"))).withColumn("output_audio_codecs", F.array(F.lit("EAC3")))
    policy = verification.Policy(loudness_tolerance=1.0, peak_ceiling=0.0)
    got = verification.verified(df, policy).select("id", "passed", checks.failed_names(F.col("checks")).alias("f")).orderBy("id").collect()
    assert [(CHANGES[r["id"]][0], r["f"], r["passed"]) for r in got] == [(c, [w] if w else [], w is None) for c, w in CHANGES]


def test_verification_of_languages_codecs_and_tags(spark):
    kind = "id int, media_kind string, expected_audio_languages array<string>, output_audio_languages array<string>, container_fixed boolean, expected_audio_codecs array<string>, output_audio_codecs array<string>, source_tags map<string,string>, output_tags map<string,string>"
    rows = [
        (0, "Video", ["ger", None, "en"], ["deu", "fra", "eng"], False, None, None, None, None),
        (1, "Video", ["ger"], ["en"], False, None, None, None, None),
        (2, "Video", ["ger"], ["de", "en"], False, None, None, None, None),
        (3, "Video", ["ger"], None, True, ["aac", "ac3"], ["AAC", None], None, None),
        (4, "Video", None, None, True, ["aac"], ["AAC"], None, None),
        (5, "Audio", None, None, False, None, None, {"Title": "x", "YEAR": "1999", "encoder": "a", "blank": " "}, {"title": " x ", "date": "1999"}),
        (6, "Audio", None, None, False, None, None, {"title": "x"}, {"title": "X"}),
        (7, "Audio", None, None, False, None, None, {"title": "x", "TITLE": "y"}, {"Title": "x"}),
    ]
    watched = {"Audio languages", "Container unchanged", "Audio codecs unchanged", "Audio metadata and artwork"}
    found = verification.verified(spark.createDataFrame(rows, kind)).select("id", "checks").collect()
    outcomes = {r["id"]: {c["name"]: c["outcome"] == "Passed" for c in r["checks"] if c["name"] in watched} for r in found}
    assert [outcomes[k].get("Audio languages") for k in range(5)] == [True, False, False, False, None]
    assert outcomes[3]["Audio codecs unchanged"] is False and outcomes[4]["Audio codecs unchanged"] is True and outcomes[4]["Container unchanged"] is False
    assert [outcomes[k]["Audio metadata and artwork"] for k in (5, 6)] == [True, False] and 7 in outcomes


def test_scan_of_a_folder(spark, tmp_path):
    for name in ("a/Film.MKV", "a/notes.txt", "b/song.flac"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    got = {r["relative_path"]: r["settled"] for r in files.scan(spark, str(tmp_path), "Video").collect()}
    assert got == {"a/Film.MKV": False}
    later = dt.datetime.now() + dt.timedelta(days=2)
    assert all(r["settled"] for r in files.scan(spark, str(tmp_path), "Other", now=later).collect()) and files.scan(spark, str(tmp_path)).count() == 2
    rows = spark.createDataFrame([("slots", "7"), ("on", "true"), ("days", "x")], "key string, value string")
    assert files.settings(rows, {"slots": 1, "days": 30, "on": False, "mode": "none"}, {"slots": 9}).first().asDict() == {"slots": 9, "days": 30, "on": True, "mode": "none"}


def test_progress_stream(spark, tmp_path):
    lines = ["frame=1", "fps=29.97", "out_time=01:02:03.500000", "speed=1.5x", "progress=continue", "out_time_us=2500000", "fps=bad", "progress=continue", "out_time_ms=3750000"]
    more = ["progress=end"]
    for k, part in enumerate((lines, more)):
        rows = spark.createDataFrame([(1, k * 100 + n, x) for n, x in enumerate(part)], "job_id long, line_no long, line string")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, line_no long, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    progress.drain(progress.progress_blocks(stream), str(tmp_path / "state"), lambda df, _: seen.extend(tuple(r) for r in df.collect()))
    assert sorted(seen, key=str) == sorted([(1, 3723.5, 29.97, 1.5, False), (1, 2.5, None, None, False), (1, 3.75, None, None, True)], key=str)


def test_emissions_equal_a_loop(spark):
    import random

    draw = random.Random(3)
    rows = [(k, n, draw.choice([None, round(draw.random(), 3)])) for k in range(5) for n in range(60)] + [(9, 0, 0.1), (None, 1, 0.9)]
    want = []
    for k in range(5):
        last = 0.0
        for key, n, v in rows:
            if key == k and v is not None and v >= last + 0.1:
                want.append((k, n, v))
                last = v
    df = spark.createDataFrame(rows, "k int, n int, v double").withColumn("other", F.lit("x"))
    assert sorted(tuple(r) for r in sequences.emissions(df, "k", ["n"], "v", 0.1).collect() if r["k"] != 9) == want
    assert sequences.emissions(df.limit(0), "k", ["n"], "v", 0.1).count() == 0


def test_listings_and_devices(spark):
    x = lambda c: one(spark, c)
    assert x(parsers.accelerators(F.lit("note\nHardware acceleration methods:\n cuda \n\nvaapi\n"))) == ["cuda", "vaapi"] and x(parsers.accelerators(F.lit("cuda"))) == []
    filters = F.lit(" T.. libvmaf_cuda VV->V x\nlibvmaf")
    assert x(parsers.has_filter(filters, "libvmaf_cuda")) and not x(parsers.has_filter(filters, "libvmaf")) and not x(parsers.has_filter(F.lit(None).cast("string"), "a"))
    listing = " V....D libx265   text\n V....D hevc_nvenc  text\n V..... hevc_qsv x\n A.. h264_qsv"
    machines = spark.createDataFrame([("a", listing, True, False), ("b", None, True, True)], "machine string, listing string, nvidia boolean, dri boolean")
    got = parsers.capabilities(machines, "listing", "nvidia", "dri").where("available").select("machine", "name").collect()
    assert sorted(tuple(r) for r in got) == [("a", "hevc_nvenc"), ("a", "libx265")] and parsers.capabilities(machines, "listing", "nvidia", "dri").count() == 24
    text = "pos: 0\ndrm-driver:\ti915\ndrm-client-id: 7\ndrm-engine-render: 100 ns\ndrm-engine-render: 150 ns\ndrm-engine-video:\t0 ns\ndrm-engine-copy: x ns"
    assert x(parsers.drm_client(F.lit(text))).asDict() == {"client_id": 7, "driver": "i915", "engines": {"render": 150}}
    assert x(parsers.drm_client(F.lit("drm-client-id: 7"))) is None and x(parsers.drm_client(F.lit("drm-engine-render: 1 ns"))) is None
    assert [x(parsers.utilisation_report(F.lit(t))) for t in ("bad\n 37 %\n40", "250", "x")] == [37, 100, None] and [x(parsers.busy_percent(F.lit(t))) for t in (" 12\n", "-3", "1 2")] == [12, 0, None]


def test_server_answers(spark):
    x = lambda c: one(spark, c)
    flat = {"MediaContainer": {"Metadata": [{"type": "movie", "year": 1990, "art": "/a"}, {"type": "show", "year": "x", "art": ""}], "Hub": [{"Metadata": [{"type": "show", "year": 2001, "art": "/b"}, {"type": "episode", "year": 2002, "art": "/c", "thumb": "/t"}]}, {}]}}
    art = lambda series, year, field="art": x(parsers.search_art(F.lit(json.dumps(flat)), field, F.lit(series), F.lit(year).cast("int")))
    assert [art(True, 2002), art(True, None), art(True, 1990), art(False, 2020), art(False, 1, "thumb")] == ["/c", "/b", "/b", "/a", "/t"] and x(parsers.search_art(F.lit("{bad"), "art", F.lit(True), F.lit(1))) is None
    items = {"Items": [{"Id": "1", "Type": "Movie", "ProductionYear": 2000, "BackdropImageTags": ["q"], "ImageTags": {"Primary": "p"}}, {"Id": "2", "Type": "Series", "ProductionYear": 2001, "BackdropImageTags": []}]}
    image = lambda backdrop, series: x(parsers.item_image(F.lit(json.dumps(items)), backdrop, F.lit(series), F.lit(2001)))
    assert image(True, True) == "/Items/1/Images/Backdrop/0?tag=q" and image(False, False) == "/Items/1/Images/Primary?tag=p"
    posters = [{"title": "The Show!", "year": 1999, "images": [{"coverType": "fanart", "remoteUrl": "f"}, {"coverType": "poster", "remoteUrl": "old"}]}, {"title": "the show", "year": 2010, "images": [{"coverType": "poster", "remoteUrl": "new"}]}]
    poster = lambda title, year: x(parsers.remote_poster(F.lit(json.dumps(posters)), F.lit(title).cast("string"), F.lit(year).cast("int")))
    assert [poster("The Show", 2010), poster("the.show", None), poster("other", 1999), poster(None, 1999)] == ["new", "old", None, None]
    owned = [
        {"name": "home", "provides": "client, Server", "accessToken": "t", "connections": [{"uri": "https://relay", "relay": True, "local": True, "protocol": "https"}, {"uri": "http://far"}, {"uri": "https://near", "local": True, "protocol": "https"}, {"uri": "http://near2", "local": True, "protocol": "http"}]},
        {"name": "phone", "provides": "client", "connections": [{"uri": "u"}]}, {"name": "none", "provides": "server", "connections": [{"uri": " "}]},
    ]
    assert [(s["name"], s["uri"], s["access_token"]) for s in x(parsers.servers(F.lit(json.dumps(owned))))] == [("home", "https://near", "t")] and x(parsers.servers(F.lit("x"))) == []
    assert x(parsers.server_info(F.lit('{"MediaContainer":{"friendlyName":"n","version":"1"}}'))).asDict() == {"name": "n", "version": "1"} and x(parsers.server_info(F.lit('{"ServerName":"j"}')))["version"] is None and x(parsers.server_info(F.lit("{}"))) is None
    assert x(parsers.sign_in(F.lit('{"id":5,"code":"ab","authToken":""}'))).asDict() == {"pin_id": 5, "code": "ab", "secret": None, "token": None, "granted": False}
    assert x(parsers.sign_in(F.lit('{"Authenticated":true,"AccessToken":"t","Secret":"s"}'))).asDict() == {"pin_id": None, "code": None, "secret": "s", "token": "t", "granted": True}


def test_utilisation_stream(spark, tmp_path):
    from siltstone.streaming import counters

    for rows in ([("a", 0.0, 1.0), ("a", 2.0, 2.0), ("b", 0.0, 9.0)], [("a", 4.0, 9.0), ("a", 3.0, 2.0), ("b", 1.0, 3.0), ("b", 1.0, 4.0), ("b", None, 1.0)]):
        spark.createDataFrame(rows, "counter string, at double, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("counter string, at double, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    progress.drain(counters.utilisation_stream(stream), str(tmp_path / "state"), lambda df, _: seen.extend(tuple(r) for r in df.collect()))
    assert sorted(seen) == [("a", 2.0, 50.0), ("a", 3.0, 0.0), ("a", 4.0, 100.0), ("b", 1.0, 0.0)]
