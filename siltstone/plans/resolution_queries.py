"""Policies, sources and scores that are resolved for each row, and probes as a drained stream, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import aggregates, decisions, joins, transcode, verification
from siltstone.operators.rules import PROFILES
from siltstone.plans.queries import query, read
from siltstone.sources import requests
from siltstone.sources.shared import shared_folder
from siltstone.streaming import probing, progress


@query("""
SELECT s_suppkey, coalesce(CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) AS quality_gate,
  coalesce(CASE WHEN s_suppkey % 4 > 0 THEN greatest(0.0, least(100.0, CAST(s_acctbal AS DOUBLE) / 10)) END, 93.0::DOUBLE) AS harmonic, coalesce(CASE WHEN s_suppkey % 5 > 0 THEN greatest(0.0, least(100.0, CAST(s_nationkey * 6 AS DOUBLE))) END, 80.0::DOUBLE) AS p5,
  coalesce(CASE s_suppkey % 7 WHEN 0 THEN true END, false) AS clip_gate, CAST(coalesce(CASE WHEN s_suppkey % 2 = 0 THEN greatest(1, least(10, s_nationkey - 3)) END, 1) AS INTEGER) AS frame_interval
FROM supplier
""")
def policy_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's own policy where it has one, within bounds, else what holds for all."""
    k, none = F.col("s_suppkey"), F.lit(None)
    own = read(spark, sf_dir, "supplier").select(
        k, F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("quality_gate"), F.when(k % 4 > 0, F.col("s_acctbal").cast("double") / 10).alias("least_vmaf_harmonic"), F.when(k % 5 > 0, (F.col("s_nationkey") * 6).cast("double")).alias("least_vmaf_p5"),
        none.cast("double").alias("least_vmaf_min"), F.when(k % 7 == 0, True).alias("clip_gate"), F.when(k % 2 == 0, F.col("s_nationkey") - 3).cast("int").alias("frame_interval"),
    )
    r = verification.resolved_policy()
    return own.select(k, r["quality_gate"].alias("quality_gate"), r["least_vmaf_harmonic"].alias("harmonic"), r["least_vmaf_p5"].alias("p5"), r["clip_gate"].alias("clip_gate"), r["frame_interval"].alias("frame_interval"))


@query("""
SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
WHERE o_custkey % 3 = 1 AND o_orderstatus = 'O' AND CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 5 <> 0 AND o_orderkey % 97 >= 48 WHEN 1 THEN o_orderkey % 97 >= 60 ELSE CASE WHEN o_orderkey % 4 = 3 THEN true ELSE o_orderkey % 4 <= 1 END END
ORDER BY cents DESC, o_orderkey LIMIT 25
""")
def calibration_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a calibration may take, each kind by a rule of its own; the largest first."""
    k = F.col("o_orderkey")
    files = read(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 3).alias("library_id"), F.when(F.col("o_orderstatus") == "O", "Probed").otherwise("Discovered").alias("status"), F.when(k % 3 == 0, "Video").when(k % 3 == 1, "Audio").otherwise("Image").alias("media_kind"),
        (k % 5 == 0).alias("is_dolby_vision"), (k % 97).cast("double").alias("duration_seconds"), F.when(k % 4 != 3, k % 4).alias("frame_count"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"),
    )
    return decisions.calibration_sources(files, 1).select(F.col("id").alias("o_orderkey"), F.col("size_bytes").alias("cents"))


@query("""
WITH l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY l_orderkey),
k AS (SELECT l_orderkey, a, [CAST(l_orderkey % 3 AS INTEGER), CAST(l_orderkey % 5 AS INTEGER)] AS removed FROM l)
SELECT l_orderkey, array_to_string(list_filter(a, lambda x, i: NOT list_contains(removed, i - 1)), ',') AS kept,
  list_filter(a, lambda x, i: NOT list_contains(removed, i - 1)) IS DISTINCT FROM list_filter(a, lambda x, i: i - 1 <> l_orderkey % 3) AS differs FROM k
""")
def removed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that are expected in an output: those of the source without the removed places, compared place by place."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("a"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    at = lambda n: (F.col("l_orderkey") % n).cast("int")
    expected = joins.without_positions(F.col("x.a"), F.array(at(3), at(5)))
    return rows.select("l_orderkey", F.array_join(expected, ",").alias("kept"), joins.first_difference(expected, joins.without_positions(F.col("x.a"), F.array(at(3)))).isNotNull().alias("differs"))


@query("""
WITH w AS (SELECT l_orderkey, l_tax < 0.08 AS measured, l_partkey % 90 + 1 AS v, CAST(l_quantity AS INTEGER) % 4 AS frames, CASE WHEN l_orderkey % 2 = 0 THEN 'scaled' ELSE 'p' || l_returnflag END AS preprocessing FROM lineitem WHERE l_partkey % 4 <> 0),
x AS (SELECT *, greatest(frames, 1) AS wt FROM w),
g AS (SELECT l_orderkey, bool_and(measured) AS measured, CAST(sum(v * wt) AS DOUBLE) / sum(wt) AS mean, CASE WHEN count(DISTINCT preprocessing) = 1 THEN min(preprocessing) || '; ' ELSE '' END || 'three windows' AS preprocessing FROM x GROUP BY 1)
SELECT o_orderkey, coalesce(measured, false) AS measured, CASE WHEN measured IS NULL THEN 'No VMAF samples were measured.' WHEN measured THEN '' ELSE 'A VMAF sample produced no usable score.' END AS error,
  CASE WHEN measured THEN round(mean, 4) ELSE -1 END AS psnr, CASE WHEN measured THEN preprocessing ELSE '' END AS preprocessing
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey
""")
def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of jobs from their windows, failed where a job has none, with what the windows have in common."""
    v, none = (F.col("l_partkey") % 90 + 1).cast("double"), F.lit(None)
    w = read(spark, sf_dir, "lineitem").where("l_partkey % 4 <> 0").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), (F.col("l_tax") < 0.08).alias("measured"), none.cast("string").alias("error"), v.alias("mean"), v.alias("harmonic"), v.alias("least"), v.alias("p5"),
        (F.col("l_quantity").cast("int") % 4).alias("frames"), none.cast("string").alias("model"), v.alias("psnr"), v.alias("ssim"), F.when(F.col("l_orderkey") % 2 == 0, "scaled").otherwise(F.concat(F.lit("p"), "l_returnflag")).alias("preprocessing"),
    )
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    r = aggregates.combined_windows(w, "l_orderkey", "place", jobs, F.lit("three windows"))
    return r.select(F.col("l_orderkey").alias("o_orderkey"), "measured", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.round("psnr", 4), F.lit(-1.0)).alias("psnr"), F.coalesce("preprocessing", F.lit("")).alias("preprocessing"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'ProbeFailed' ELSE 'Probed' END AS status,
  CASE WHEN p_partkey % 5 = 0 THEN 'no such file' WHEN p_partkey % 7 = 0 THEN 'The probe''s output could not be read.' ELSE '' END AS error, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN -1 ELSE CAST(p_size AS DOUBLE) END AS seconds FROM part
""")
def probed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured probes drained in two deliveries; what fails is recorded with why."""
    k = F.col("p_partkey")
    output = F.when(k % 7 == 0, "{damaged").otherwise(F.format_string('{"format":{"format_name":"matroska,webm","duration":"%d"},"streams":[]}', "p_size"))
    probes = read(spark, sf_dir, "part").select(F.concat(F.lit("/media/"), k.cast("string")).alias("path"), output.alias("output"), F.when(k % 5 == 0, "no such file").alias("error"))
    captured, state, out = (shared_folder(spark, f"probes-{x}") for x in ("captured", "state", "found"))
    for half in range(2):
        probes.where(F.substring("path", 8, 20).cast("long") % 2 == half).write.mode("append").json(captured)
        progress.drain(probing.read_probes(spark, captured), state, probing.into(out))
    found = spark.read.parquet(out)
    return found.select(F.substring("path", 8, 20).cast("long").alias("p_partkey"), "status", F.coalesce("probe_error", F.lit("")).alias("error"), F.coalesce("facts.duration_seconds", F.lit(-1.0)).alias("seconds"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS s, CASE p_partkey % 3 WHEN 0 THEN 'Image' WHEN 1 THEN 'Audio' ELSE 'Video' END AS kind FROM part),
e AS (SELECT *, CASE WHEN kind = 'Audio' THEN 'libopus' WHEN kind = 'Video' AND k % 4 = 0 THEN 'aac' END AS encoder, CASE WHEN kind = 'Audio' THEN 96 ELSE 128 END AS rate, s % 9 AS channels, k % 7 = 0 AS mixed FROM p)
SELECT k AS p_partkey, '/work/dir/' || CAST(k AS VARCHAR) || '.' || CASE kind WHEN 'Image' THEN CASE WHEN k % 2 = 0 THEN 'webp' ELSE 'jpg' END WHEN 'Audio' THEN 'opus' ELSE CASE WHEN s > 40 OR s % 2 = 0 AND k % 4 <> 0 THEN 'mkv' ELSE 'mp4' END END AS output_path,
  CASE WHEN kind = 'Image' THEN CASE WHEN k % 2 = 0 THEN 'libwebp' ELSE 'mjpeg' END ELSE '' END AS image_encoder, CASE WHEN kind = 'Image' THEN 82 ELSE -1 END AS image_quality, kind = 'Image' AND k % 2 = 0 AND s > 25 AS image_lossless,
  coalesce(encoder, '') AS audio_encoder, CASE WHEN encoder IS NULL THEN -1 WHEN mixed OR channels <= 2 THEN rate ELSE rate * CAST(ceil(channels / 2.0) AS INTEGER) END AS audio_kbps, encoder IS NOT NULL AND mixed AS downmix,
  CASE WHEN kind <> 'Video' THEN '' WHEN s % 3 = 0 THEN '1' ELSE '' END AS removed_audio, CASE WHEN kind = 'Video' AND s % 5 = 0 THEN '0,2' ELSE '' END AS removed_subtitles
FROM e
""")
def transcode_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is decided for a transcode from the rules and the file's facts."""
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 3 == 0, "Image").when(k % 3 == 1, "Audio").otherwise("Video")
    rules = F.struct(
        F.lit(".mp4").alias("target_container"), F.lit("hevc").alias("target_video_codec"), F.when(k % 4 == 0, "AAC").alias("video_audio_codec"), F.lit("opus").alias("target_audio_codec"), F.when(k % 2 == 0, "webp").otherwise("jpeg").alias("target_image_format"),
        F.lit("TonemapToSdr").alias("hdr"), F.lit(82).alias("image_quality"), F.lit(96).alias("audio_kbps"), F.lit(128).alias("video_audio_kbps"), (k % 7 == 0).alias("downmix"),
    )
    audio = F.when(s % 3 == 0, F.array(F.lit("ger"), F.lit("fr"))).when(s % 3 == 1, F.array(F.lit("fr"), F.lit("es")))  # none is kept: none goes
    facts = F.struct(
        (s > 40).alias("picture_subtitles"), (s % 2 == 0).alias("audio_not_for_mp4"), F.lit(False).alias("is_hdr"), F.when(s > 25, "PNG").otherwise("jpeg").alias("image_codec"), (s % 9).cast("int").alias("channels"), F.lit(True).alias("variable_frame_rate"),
        audio.alias("audio_languages"), F.when(s % 5 == 0, F.array(F.lit("fr"), F.lit("und"), F.lit("spa"), F.lit("de"))).alias("subtitle_languages"),
    )
    spec = transcode.transcode_spec(kind, F.concat(F.lit("dir\\"), k.cast("string"), F.lit(".avi")), rules, facts, "/work/", ["deu"], ["deu"])
    x = read(spark, sf_dir, "part").select(k, spec.alias("x"))
    text = lambda name: F.coalesce(F.array_join(F.col("x")[name].cast("array<string>"), ","), F.lit(""))
    return x.select(
        k, F.col("x.output_path").alias("output_path"), F.coalesce("x.image_encoder", F.lit("")).alias("image_encoder"), F.coalesce("x.image_quality", F.lit(-1)).alias("image_quality"), F.col("x.image_lossless").alias("image_lossless"), F.coalesce("x.audio_encoder", F.lit("")).alias("audio_encoder"),
        F.coalesce("x.audio_kbps", F.lit(-1)).alias("audio_kbps"), F.col("x.downmix").alias("downmix"), text("removed_audio").alias("removed_audio"), text("removed_subtitles").alias("removed_subtitles"),
    )


@query("""
WITH r AS (SELECT p_partkey AS k, p_size AS s FROM part),
e AS (SELECT k, s, CASE WHEN k % 11 = 0 THEN 'A library name is required.' WHEN k % 7 = 0 THEN 'Directory does not exist: /media/' || k WHEN k % 5 = 0 THEN 'Unknown media type: video. Expected one of Film, Tv, Music, Other, Photo.'
  WHEN k % 3 = 0 AND k % 5 = 1 THEN 'Track cleanup applies only to Film, TV, or mixed libraries that can contain video files.' WHEN s % 10 = 9 THEN 'Minimum file size cannot be negative.' WHEN s > 43 THEN 'Quality (CRF) must be between 0 and 63.'
  WHEN k % 2 = 0 AND s > 33 THEN 'VMAF overrides must be between 0 and 100.' WHEN k % 4 = 0 AND s < 30 THEN 'VMAF floors must be ordered: catastrophic frame ' || chr(8804) || ' fifth percentile ' || chr(8804) || ' harmonic mean.'
  WHEN k % 2 = 1 AND (s < 3 OR s > 42) THEN 'Audio bitrate must be between 32 and 512 kbps.' WHEN s % 6 = 5 THEN 'Audio languages must be comma-separated, registered individual ISO 639 codes and at most 256 characters (e.g. "eng, jpn").'
  WHEN k % 13 = 0 THEN 'Auto-enqueue window start must use HH:mm format.' WHEN k % 17 = 0 THEN 'A target folder is required when ''move output on complete'' is enabled.' END AS error FROM r)
SELECT k AS p_partkey, coalesce(error, '') AS error, CASE WHEN error IS NULL THEN 'Library ' || k ELSE '' END AS name, CASE WHEN error IS NOT NULL THEN '' WHEN k % 5 = 1 THEN 'Music' ELSE 'Film' END AS media_type,
  CASE WHEN error IS NULL AND s % 6 < 3 THEN 'deu, jpn' ELSE '' END AS languages, error IS NULL AND k % 2 = 0 AS enabled FROM e
""")
def library_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to create libraries: the first error of each, or what is stored."""
    k, s = F.col("p_partkey"), F.col("p_size")
    given = {
        "name": F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" Library "), k.cast("string"))), "path": F.concat(F.lit("/media/"), k.cast("string")), "path_exists": k % 7 != 0,
        "media_type": F.when(k % 5 == 0, "video").when(k % 5 == 1, "MUSIC").otherwise("film"), "rule_profile": F.when(k % 3 == 0, "trackcleanup").otherwise(PROFILES[0][0]), "min_file_size_bytes": F.when(s % 10 == 9, -1), "quality_crf": s + 20,
        "vmaf_harmonic": F.when(k % 2 == 0, s * 3.0), "vmaf_p5": F.when(k % 4 == 0, 90.0), "audio_bitrate_kbps": F.when(k % 2 == 1, s * 12), "keep_audio_languages": F.when(s % 6 == 5, "eng, xyzzy").when(s % 6 < 3, "GER,jpn, deu"),
        "window_start": F.when(k % 13 == 0, "25:00").otherwise("07:30"), "move_on_complete": k % 17 == 0, "enabled": k % 2 == 0,
    }
    fields = [f.split() for f in requests.REQUEST.split(", ")]
    rows = read(spark, sf_dir, "part").select(k, *[given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in fields])
    found = requests.parsed(rows)
    return found.select(k, *[F.coalesce(c, F.lit("")).alias(n) for c, n in (("error", "error"), ("name", "name"), ("media_type", "media_type"), ("keep_audio_languages", "languages"))], F.coalesce("enabled", F.lit(False)).alias("enabled"))
