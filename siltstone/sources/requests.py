"""Requests to create or change a library: the first thing that is wrong with each row, or the row as it is to be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import languages
from siltstone.operators.rules import PROFILES
from siltstone.sources.config import DOWNSCALES, HDR, LIST_LENGTH, MEDIA_TYPES

#: A row of requests; whether path and target_folder are folders that exist is told beside them.
REQUEST = (
    "name string, path string, path_exists boolean, media_type string, rule_profile string, hdr_handling string, min_file_size_bytes long, max_height int, reencode_same_codec_above_bytes long, quality_crf int, "
    "vmaf_harmonic double, vmaf_p5 double, vmaf_min double, vmaf_frame_interval int, audio_target_codec string, audio_bitrate_kbps int, video_audio_codec string, video_audio_bitrate_kbps int, "
    "keep_audio_languages string, keep_subtitle_languages string, target_image_format string, image_quality int, image_downscale_mode string, image_downscale_value int, "
    "window_start string, window_end string, enabled boolean, priority int, move_on_complete boolean, target_folder string, target_folder_exists boolean"
)
# What may be asked for.
AUDIO_CODECS, IMAGE_TARGETS, CLEANUP = ("opus", "aac", "mp3"), ("jpeg", "webp"), "TrackCleanup"


def trimmed(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _canonical(value: Column, names: tuple[str, ...]) -> Column:
    """The name that value is but for case; null for none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)]), F.lower(F.trim(value)))


def _codes(value: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(value, ","), lambda x: F.trim(x) != ""), languages.canonical))


def _between(value: Column, low: float, high: float) -> Column:
    """If a value is there and outside its bounds; NaN is outside."""
    return F.isnan(value.cast("double")) | (value < low) | (value > high)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def first_error(c=F.col) -> Column:
    """What is wrong first, in the order in which a request is read; null if nothing is."""
    profiles = tuple(p[0] for p in PROFILES)
    media, profile, mode = _canonical(c("media_type"), MEDIA_TYPES), _canonical(c("rule_profile"), profiles), _canonical(F.coalesce(trimmed(c("image_downscale_mode")), F.lit("None")), DOWNSCALES)
    harmonic, fifth, least, size = c("vmaf_harmonic"), c("vmaf_p5"), c("vmaf_min"), F.coalesce(c("image_downscale_value"), F.lit(0))
    unknown = lambda name, allowed: trimmed(c(name)).isNotNull() & _canonical(c(name), allowed).isNull()
    one_of = lambda words, name, allowed: _text(f"Unknown {words}: ", c(name), f". Expected one of {', '.join(allowed)}.")
    listed = f" languages must be comma-separated, registered individual ISO 639 codes and at most {LIST_LENGTH} characters (e.g. \"eng, jpn\")."
    bad_list = lambda name: (F.char_length(c(name)) > LIST_LENGTH) | F.exists(_codes(c(name)), lambda x: x.isNull())
    bad_time = lambda name: trimmed(c(name)).isNotNull() & ~F.trim(c(name)).rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")
    moves = F.coalesce(c("move_on_complete"), F.lit(False))
    rules = [
        (trimmed(c("name")).isNull(), F.lit("A library name is required.")),
        (trimmed(c("path")).isNull(), F.lit("A library path is required.")),
        (~F.coalesce(c("path_exists"), F.lit(False)), _text("Directory does not exist: ", F.trim(c("path")))),
        (media.isNull(), one_of("media type", "media_type", MEDIA_TYPES)),
        (profile.isNull(), one_of("rule profile", "rule_profile", profiles)),
        ((profile == CLEANUP) & media.isin("Music", "Photo"), F.lit("Track cleanup applies only to Film, TV, or mixed libraries that can contain video files.")),
        (unknown("hdr_handling", HDR), one_of("HDR handling", "hdr_handling", HDR)),
        (c("min_file_size_bytes") < 0, F.lit("Minimum file size cannot be negative.")),
        (c("max_height") <= 0, F.lit("Maximum resolution must be greater than zero.")),
        (c("reencode_same_codec_above_bytes") <= 0, F.lit("The same-codec re-encode size threshold must be greater than zero.")),
        (_between(c("quality_crf"), 0, 63), F.lit("Quality (CRF) must be between 0 and 63.")),
        (F.coalesce(_between(harmonic, 0, 100), F.lit(False)) | F.coalesce(_between(fifth, 0, 100), F.lit(False)) | F.coalesce(_between(least, 0, 100), F.lit(False)), F.lit("VMAF overrides must be between 0 and 100.")),
        (_between(c("vmaf_frame_interval"), 1, 10), F.lit("VMAF frame sampling must be between 1 and 10.")),
        (F.coalesce(fifth > harmonic, F.lit(False)) | F.coalesce(least > fifth, F.lit(False)) | F.coalesce(least > harmonic, F.lit(False)), F.lit("VMAF floors must be ordered: catastrophic frame ≤ fifth percentile ≤ harmonic mean.")),
        (unknown("audio_target_codec", AUDIO_CODECS), one_of("audio codec", "audio_target_codec", AUDIO_CODECS)),
        (_between(c("audio_bitrate_kbps"), 32, 512), F.lit("Audio bitrate must be between 32 and 512 kbps.")),
        (unknown("video_audio_codec", ("copy", *AUDIO_CODECS)), _text("Unknown video audio codec: ", F.trim(c("video_audio_codec")), f". Expected copy or one of {', '.join(AUDIO_CODECS)}.")),
        (_between(c("video_audio_bitrate_kbps"), 32, 512), F.lit("Video audio bitrate must be between 32 and 512 kbps.")),
        (bad_list("keep_audio_languages"), F.lit(f"Audio{listed}")),
        (bad_list("keep_subtitle_languages"), F.lit(f"Subtitle{listed}")),
        (unknown("target_image_format", IMAGE_TARGETS), _text("Unsupported image format: ", F.trim(c("target_image_format")), f". Expected one of {', '.join(IMAGE_TARGETS)}.")),
        (_between(c("image_quality"), 1, 100), F.lit("Image quality must be between 1 and 100.")),
        (mode.isNull(), F.lit("Image downscale mode must be one of None, MaxLongEdge, or Percent.")),
        ((mode == "MaxLongEdge") & _between(size, 16, 100_000), F.lit("Image max long-edge must be between 16 and 100000 pixels.")),
        ((mode == "Percent") & _between(size, 1, 99), F.lit("Image downscale percentage must be between 1 and 99.")),
        (bad_time("window_start"), F.lit("Auto-enqueue window start must use HH:mm format.")),
        (bad_time("window_end"), F.lit("Auto-enqueue window end must use HH:mm format.")),
        (moves & trimmed(c("target_folder")).isNull(), F.lit("A target folder is required when 'move output on complete' is enabled.")),
        (moves & ~F.coalesce(c("target_folder_exists"), F.lit(False)), _text("Target folder does not exist: ", F.trim(c("target_folder")))),
    ]
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in rules])


def parsed(requests: DataFrame) -> DataFrame:
    """requests with error, and where that is null their values as they are stored: trimmed, in canonical names, with defaults."""
    mode = _canonical(F.coalesce(trimmed(F.col("image_downscale_mode")), F.lit("None")), DOWNSCALES)
    kept = lambda name: trimmed(F.array_join(_codes(F.col(name)), ", "))
    stored = {
        "name": F.trim("name"), "path": F.trim("path"), "media_type": _canonical(F.col("media_type"), MEDIA_TYPES), "rule_profile": _canonical(F.col("rule_profile"), tuple(p[0] for p in PROFILES)), "hdr_handling": _canonical(F.col("hdr_handling"), HDR),
        **{n: F.lower(trimmed(F.col(n))) for n in ("audio_target_codec", "video_audio_codec", "target_image_format")}, **{n: kept(n) for n in ("keep_audio_languages", "keep_subtitle_languages")},
        "image_downscale_mode": mode, "image_downscale_value": F.when(mode == "None", 0).otherwise(F.coalesce("image_downscale_value", F.lit(0))), **{n: F.coalesce(trimmed(F.col(n)), F.lit("00:00")) for n in ("window_start", "window_end")},
        "enabled": F.coalesce("enabled", F.lit(True)), "priority": F.coalesce("priority", F.lit(0)), "move_on_complete": F.coalesce("move_on_complete", F.lit(False)), "target_folder": trimmed(F.col("target_folder")),
    }
    found = requests.withColumn("error", first_error())
    ok = F.col("error").isNull()
    return found.withColumns({n: F.when(ok, v) for n, v in stored.items()})
