"""Decisions around the queue: dispatch, encoders, retries, recovery, exclusion, waiting, cleanup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.media import binary_size
from siltstone.functions.scalars import contains_any, first_match

from .verification import QUALITY, SIZE_SAVING

# The order in which encoders are tried, and families by the end of a name.
ENCODER_ORDER = ("NVIDIA NVENC", "Intel QSV", "VAAPI", "CPU")
FAMILIES = (("_qsv", "ICQ"), ("_nvenc", "CQ"), ("_vaapi", "QP"))
ACCELERATION = (("_nvenc", "Cuda"), ("_qsv", "Qsv"), ("_vaapi", "Vaapi"))
HEADROOM, RETRY_STEP = 4, 3
RUNNING = ("Probing", "Transcoding", "Verifying")


def _reasoned(cases: Sequence[tuple[Column, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, reason in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(out)
    return out


def dispatch_gate(least_free: Column, free: Column, active: Column, active_reason: Column, bypass: Column, paused: Column, paused_reason: Column) -> Column:
    """struct<allowed, reason>: a manual pause first, then active services unless bypassed, then free space, if it is known."""
    space = F.concat(F.lit("Free disk space ("), binary_size(free), F.lit(") is below the "), binary_size(least_free), F.lit(" minimum."))
    reason = _reasoned([(paused, F.coalesce(paused_reason, F.lit("The queue is paused."))), (active & ~bypass, F.coalesce(active_reason, F.lit("A watched media server is currently active."))), ((least_free > 0) & (free < least_free), space)])
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def encoder_codec(codec: Column) -> Column:
    low = F.lower(F.trim(codec))
    return F.when(low.isin("hevc", "h265", "x265"), "hevc").when(low.isin("h264", "avc", "x264"), "h264").when(low == "av1", "av1")


def chosen_encoders(wanted: DataFrame, capabilities: DataFrame) -> DataFrame:
    """wanted (id, codec, mode, bit_depth) with encoder: the first available in order; null with a failure if there is none.

    capabilities (name, codec, mode, available, place) is a table of a machine's encoders. More than 8 bits of H.264 are
    for the CPU, more than 10 for none.
    """
    order = F.create_map(*[F.lit(x) for k, m in enumerate(ENCODER_ORDER) for x in (m.lower(), k)])
    caps = capabilities.where("available").select(F.lower("codec").alias("__codec"), F.lower("mode").alias("__mode"), "name", "place").withColumn("__rank", F.try_element_at(order, F.col("__mode")))
    caps = caps.groupBy("__codec", "__mode", "__rank").agg(F.min_by("name", "place").alias("name"), F.min("place").alias("place"))  # the rest never win
    asked = wanted.withColumn("__codec", encoder_codec(F.col("codec")))
    deep = (F.col("__codec") == "h264") & (F.col("bit_depth") > 8)
    none = F.coalesce(deep & ((F.col("bit_depth") > 10) | ~F.lower("mode").isin("auto", "cpu")), F.lit(False))
    mode_fits = F.when(F.coalesce(deep, F.lit(False)), F.col("__mode") == "cpu").otherwise((F.lower(asked["mode"]) == "auto") | (F.lower(asked["mode"]) == F.col("__mode")))
    tried = asked.withColumn("__none", none).join(caps, "__codec", "left")
    fits = ~F.col("__none") & mode_fits & F.col("__rank").isNotNull()
    best = F.min_by("name", F.when(F.coalesce(fits, F.lit(False)), F.struct("__rank", "place")))
    found = tried.groupBy("id").agg(best.alias("encoder"), F.bool_or("__none").alias("__none"), F.max("__codec").alias("__codec"))
    failure = first_match([(F.col("encoder").isNotNull(), ""), (F.col("__codec").isNull(), "unknown codec"), (F.col("__none"), "bit depth not supported")], "no available encoder")
    return wanted.join(found.select("id", "encoder", F.nullif(failure, F.lit("")).alias("failure")), "id", "left")


def encoder_quality(encoder: Column, requested: Column, retries: Column) -> Column:
    """struct<requested, effective, mode>: hardware gets headroom, each retry a step more, not below 0."""
    low = F.lower(F.coalesce(encoder, F.lit("")))
    bounded = F.greatest(F.lit(0), F.least(F.lit(51), requested))
    mode, headroom = F.lit("CRF"), F.lit(0)
    for end, name in FAMILIES:
        mode, headroom = F.when(F.endswith(low, F.lit(end)), name).otherwise(mode), F.when(F.endswith(low, F.lit(end)), HEADROOM).otherwise(headroom)
    effective = F.greatest(F.lit(0), bounded - headroom - F.greatest(F.lit(0), retries) * RETRY_STEP)
    return F.struct(bounded.alias("requested"), effective.alias("effective"), mode.alias("mode"))


def quality_acceleration(encoder: Column, hardware: Column) -> Column:
    low, out = F.lower(F.coalesce(encoder, F.lit(""))), F.lit("None")
    for end, name in ACCELERATION:
        out = F.when(hardware & F.endswith(low, F.lit(end)), name).otherwise(out)
    return out


def access_message(exists: Column, readable: Column, writable: Column) -> Column:
    """The worst problem first."""
    return first_match([(~exists, "Path does not exist"), (~readable, "Not readable"), (~writable, "Readable but not writable")], "Readable and writable")


def recovered(jobs: DataFrame, most_attempts: int) -> DataFrame:
    """Jobs that were running when the worker stopped: queued again, or failed after as many attempts."""
    cut_off = F.col("status").isin(*RUNNING)
    spent = cut_off & (F.col("attempt") >= most_attempts)
    return jobs.withColumns({
        "error_message": F.when(spent, "Interrupted too many times (worker restarted while running).").otherwise(F.col("error_message")),
        "progress": F.when(cut_off, 0.0).otherwise(F.col("progress")),
        "status": F.when(spent, "Failed").when(cut_off, "Queued").otherwise(F.col("status")),
    })


def only_quality(failed: Column) -> Column:
    """Whether the visual score is all that failed."""
    return (F.size(failed) == 1) & (F.get(failed, 0) == QUALITY)


def quality_retry(failed: Column, measured: Column, retries: Column, quality: Column) -> Column:
    """Whether one more encode at a higher quality may help: the first time, and if quality can still be raised."""
    return F.coalesce((retries <= 0) & (quality > 0) & measured & only_quality(failed), F.lit(False))


def immediate_exclusion(failed: Column, measured: Column, retries: Column, quality: Column) -> Column:
    """Why another encode can't help, from the names of failed checks; null if it may."""
    open_ = F.coalesce(measured & only_quality(failed), F.lit(False))
    return F.when(F.array_contains(failed, SIZE_SAVING), "SizeSaving").when(open_ & (retries > 0), "VmafAfterHigherQualityRetry").when(open_ & ~F.coalesce(quality > 0, F.lit(False)), "VmafAtMaximumQuality")


def recommended(settings: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per session the first setting, by rank, that was rated as good; sessions without one are left out."""
    good = ratings.where(F.col("rating").isin("Indistinguishable", "Acceptable"))
    return settings.join(good.select("session", "setting"), ["session", "setting"]).groupBy("session").agg(F.min_by("setting", "rank").alias("setting"))


def keyframe_offset(frames: DataFrame, key: str, requested: Column) -> DataFrame:
    """Per key: the first frame at or after the requested time less the last key frame at or before it, in file order."""
    at = F.col("ts")
    before = F.max_by("ts", F.when((F.col("is_key") == 1) & (at <= requested), F.col("frame_no")))
    after = F.min_by("ts", F.when(at >= requested, F.col("frame_no")))
    found = frames.groupBy(key).agg(before.alias("b"), after.alias("a"))
    return found.select(key, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest(F.lit(0.0), F.col("a") - F.col("b"))).alias("offset"))


def busiest(samples: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Per key the group with the largest sum, clamped to 0..100."""
    sums = samples.groupBy(key, group).agg(F.sum(value).alias("__v"))
    best = sums.groupBy(key).agg(F.max_by(group, F.struct("__v", group)).alias(group), F.max("__v").alias("__v"))
    return best.select(key, group, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("__v").cast("double"))).alias(value))


def orphans(files: DataFrame, jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Work files that no job owns and that are older than the grace time."""
    return files.join(jobs.select("path"), "path", "left_anti").where(F.col("modified_at") < now - F.expr(f"INTERVAL {days} DAYS"))


def violations(rules: Sequence[tuple[Column, str]]) -> Column:
    """All messages whose condition is violated, in order; an unknown condition isn't."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in rules]), lambda x: x.isNotNull())


def exported(settings: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Portable settings as one JSON object."""
    return settings.where(F.col("key").isin(*allowed)).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("json"))


# States a job doesn't leave by itself, states that hold on to a path, and what a decoder of the graphics
# card says when it can't be used.
ENDED = ("Completed", "Failed", "Cancelled")
HOLDING = ("Queued", "Probing", "Transcoding", "Verifying", "ReadyToReplace")
DECODER_SIGNS = ("hwaccel", "failed setup for format", "impossible to convert between the formats", "error while opening decoder", "no decoder surfaces left", "device creation failed", "decoder not found", "no usable decoder", "init_hw_device")
PICTURE_SUBTITLE_SIGN = "only possible from text to text or bitmap to bitmap"
# Settings tried per kind of media, the least efficient last; containers of audio and image targets.
AUDIO_LADDERS = {"opus": (64, 80, 96, 128, 160), "aac": (96, 128, 160, 192, 256), "mp3": (128, 160, 192, 256, 320)}
IMAGE_LADDER = (40, 55, 70, 82, 92)
EXTENSION_OF = {"opus": "opus", "aac": "m4a", "mp3": "mp3", "jpeg": "jpg", "webp": "webp"}
# Reasons by the mode of the encoder that a new installation is advised to use.
SETUP_REASONS = {"NVIDIA NVENC": "nvidia", "Intel QSV": "intel", "VAAPI": "vaapi", "CPU": "cpu"}


def auto_replaces(status: Column, passed: Column, library_wants: Column, dry_run: Column, paused: Column) -> Column:
    """Unknown verification is no pass."""
    return (status == "ReadyToReplace") & F.coalesce(passed, F.lit(False)) & library_wants & ~dry_run & ~paused


def kept_for_diagnosis(job_type: Column, status: Column) -> Column:
    return (job_type != "Normal") & (status == "Failed")


def clearable(jobs: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """Jobs (id, status) that have ended and whose replacement can't be undone any more (rollbacks: job_id)."""
    return jobs.where(F.col("status").isin(*ENDED)).join(rollbacks.select(F.col("job_id").alias("id")), "id", "left_anti")


def streak_excludes(failures: Column, threshold: Column) -> Column:
    return (threshold > 0) & (failures >= threshold)


def software_decode_helps(log: Column) -> Column:
    return F.coalesce(contains_any(log, DECODER_SIGNS), F.lit(False))


def explained(log: Column) -> Column:
    """What a user can do about a tool's message; null where nothing is known."""
    return F.when(F.lower(log).contains(PICTURE_SUBTITLE_SIGN), "Subtitles that are pictures don't fit an MP4 file; choose MKV as the target container or remove them. The original was not touched.")


def setup_advice(capabilities: DataFrame, machines: DataFrame) -> DataFrame:
    """Per machine the encoder mode to start with, whether it decodes in hardware, and the tier of visual scores.

    capabilities: (machine, mode, codec, available); machines: (machine, vmaf, cuda_vmaf). A machine without rows gets CPU.
    """
    rank = F.create_map(*[F.lit(x) for k, m in enumerate(ENCODER_ORDER[:-1]) for x in (m, k)])
    able = capabilities.where(F.col("available") & (F.col("codec") == "hevc") & F.col("mode").isin(*ENCODER_ORDER[:-1]))
    best = able.groupBy("machine").agg(F.min_by("mode", F.element_at(rank, F.col("mode"))).alias("mode"))
    mode = F.coalesce("mode", F.lit("CPU"))
    scored = F.col("vmaf") & F.col("cuda_vmaf") & (mode == "NVIDIA NVENC")
    reasons = F.create_map(*[F.lit(x) for pair in SETUP_REASONS.items() for x in pair])
    return machines.join(best, "machine", "left").select(
        "machine", mode.alias("mode"), (mode != "CPU").alias("hardware_decode"), F.when(scored, "Balanced").otherwise("Off").alias("vmaf_tier"),
        F.element_at(reasons, mode).alias("encoder_reason"), F.when(scored, "cuda-balanced").when(F.col("vmaf"), "cpu-cost").otherwise("unavailable").alias("vmaf_reason"),
    )


def calibratable(is_hdr: Column, is_dolby_vision: Column, hdr_mode: Column, playback_confirmed: Column) -> Column:
    return ~is_dolby_vision & (~is_hdr | ((hdr_mode == "Preserve") & playback_confirmed))


# Seconds of a sample that a calibration takes.
SAMPLE_SECONDS, AUDIO_SAMPLE_SECONDS = 12, 15


def calibration_sources(files: DataFrame, library_id: int, most: int = 25) -> DataFrame:
    """The largest probed files of a library that a calibration can take samples from: what is enough depends on their kind.

    Films need four samples' length and no Dolby Vision, music four of its own, pictures a single frame. What isn't known
    is not long enough; an unknown number of frames is one. Files of equal size come by id.
    """
    kind, seconds = F.col("media_kind"), F.col("duration_seconds")
    fit = (kind == "Video") & ~F.col("is_dolby_vision") & (seconds >= 4 * SAMPLE_SECONDS) | (kind == "Audio") & (seconds >= 4 * AUDIO_SAMPLE_SECONDS) | (kind == "Image") & (F.coalesce("frame_count", F.lit(1)) <= 1)
    return files.where((F.col("library_id") == library_id) & (F.col("status") == "Probed") & fit).orderBy(F.col("size_bytes").desc(), "id").limit(most)


def ladder(codec: Column) -> Column:
    """The bit rates to compare for an audio codec; null for one that isn't compared."""
    out = F.lit(None).cast("array<int>")
    for name, steps in AUDIO_LADDERS.items():
        out = F.when(F.lower(codec) == name, F.array(*[F.lit(s) for s in steps])).otherwise(out)
    return out


def effective_bitrate(kbps: Column, channels: Column, downmix: Column) -> Column:
    """The configured rate is for two channels; a pair more costs as much again."""
    return F.when(downmix | (channels <= 2), kbps).otherwise(kbps * F.ceil(channels / 2).cast("int"))


def output_spec(kind: Column, relative_path: Column, rules: Column, picture_subtitles: Column, audio_not_for_mp4: Column, is_hdr: Column, work_root: str) -> Column:
    """struct<container, output_path, tonemap>: what a transcode of a file makes, and where.

    rules: struct<target_container, target_video_codec, video_audio_codec, target_audio_codec, target_image_format, hdr>. An
    MP4 target becomes MKV where the subtitles, or sound that is only copied, don't fit; without a target the file keeps its
    own extension.
    """
    by_target = F.create_map(*[F.lit(x) for pair in EXTENSION_OF.items() for x in pair])
    path = F.regexp_replace(relative_path, r"\\", "/")
    own = F.regexp_extract(path, r"\.([^./]+)$", 1)
    target = rules["target_container"]
    mp4 = F.lower(F.ltrim(target, F.lit("."))).isin("mp4", "m4v", "mov")
    unfit = F.coalesce(picture_subtitles | (audio_not_for_mp4 & rules["video_audio_codec"].isNull()), F.lit(False))
    container = (
        F.when(kind == "Image", F.try_element_at(by_target, F.lower(rules["target_image_format"])))
        .when(kind == "Audio", F.try_element_at(by_target, F.lower(rules["target_audio_codec"])))
        .otherwise(F.when(target.isNull(), own).when(unfit & mp4, "mkv").otherwise(F.ltrim(target, F.lit("."))))
    )
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    tonemap = ~kind.isin("Image", "Audio") & is_hdr & rules["target_video_codec"].isNotNull() & (rules["hdr"] == "TonemapToSdr")
    return F.struct(container.alias("container"), F.concat(F.lit(work_root.rstrip("/") + "/"), stem, F.lit("."), container).alias("output_path"), F.coalesce(tonemap, F.lit(False)).alias("tonemap"))


def lapsed(rows: DataFrame, expires_at: str, now: Column) -> DataFrame:
    """What has run out, the very moment included."""
    return rows.where(F.col(expires_at) <= now)


def cleanup_plan(files: DataFrame, keys: list[str], days: int, dry_run: bool = False) -> DataFrame:
    """Per keys: files, their bytes and a token over their identities (kind, id, path, bytes), which a confirmation must match.

    The token adds up parts of each identity's digest, so it needs no order, is combined before the shuffle, and no group is
    ever put in one place.
    """
    identity = F.sha2(F.encode(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("kind", "id", "path", "bytes")]), "UTF-8"), 256)
    parts = [F.sum(F.conv(F.substring(identity, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string") for k in range(4)]
    head = [F.lit(str(days)), F.lit(str(dry_run).lower()), F.count("*").cast("string")]
    token = F.sha2(F.encode(F.concat_ws(",", *head, *[F.coalesce(p, F.lit("0")) for p in parts]), "UTF-8"), 256)
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), token.alias("token"))


def failed_outputs(jobs: DataFrame, root: str, now: Column, days: int) -> DataFrame:
    """Failed jobs (id, status, path, finished_at) past their retention whose file lies below root and is held by no other job."""
    held = jobs.where(F.col("status").isin(*HOLDING)).select("path")
    old = jobs.where((F.col("status") == "Failed") & (F.col("finished_at") <= now - F.expr(f"INTERVAL {days} DAYS")) & F.startswith("path", F.lit(root.rstrip("/") + "/")))
    return old.join(held, "path", "left_anti")


def on_scale(quality: Column, best: int, worst: int) -> Column:
    """A quality from 0 to 100 on an encoder's scale between worst and best, rounded half to even."""
    return F.bround(F.lit(worst) + (best - worst) * (quality / 100.0), 0).cast("int")
