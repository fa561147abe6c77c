"""Verification of an output against its source: named checks, those that apply, in one pass over wide rows.

A row holds the facts of ``FACTS``, and those of ``SIDE`` twice, with the prefixes source_ and output_. Facts that a frame
lacks are null, so one frame can hold videos, music and pictures. A check that applies but needs an unknown fact fails.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from siltstone.functions.languages import canonical
from siltstone.functions.media import pixel_format
from siltstone.functions.scalars import bound

from .checks import Check, all_passed, check, failed_text, first_failure, report
from .joins import last_of_keys

SIDE = (
    "duration double, bytes long, container string, video_codec string, video_profile string, width int, height int, pixel_format string, bits_per_raw_sample int, audio_tracks int, subtitle_tracks int, "
    "audio_languages array<string>, subtitle_languages array<string>, audio_codecs array<string>, audio_channels int, sample_rate int, is_hdr boolean, color_primaries string, color_transfer string, color_space string, "
    "video_start double, audio_start double, last_presentation double, timestamps_measured boolean, loudness double, peak double, has_icc boolean, has_exif boolean, attached_pictures int, tags map<string,string>"
)
FACTS = (
    "media_kind string, decode_errors int, output_probed boolean, expected_video_codec string, expected_audio_languages array<string>, expected_subtitle_languages array<string>, expected_audio_codecs array<string>, "
    "removed_audio_tracks int, removed_subtitle_tracks int, container_fixed boolean, video_reencoded boolean, audio_reencoded boolean, downmixed boolean, downscaled boolean, tone_mapped boolean, "
    "timestamp_regressions int, vmaf_harmonic double, vmaf_p5 double, vmaf_min double, ssim double, image_metadata_measured boolean, "
    "quality_gate boolean, least_vmaf_harmonic double, least_vmaf_p5 double, least_vmaf_min double"
)
# Names of checks that other decisions look for; tags that belong to the container; tags with two spellings.
SIZE_SAVING, QUALITY = "Size saving", "Perceptual quality (VMAF)"
CONTAINER_TAGS = ("encoder", "vendor_id", "major_brand", "minor_version", "compatible_brands", "handler_name", "duration", "language")
SPELLINGS = {"albumartist": "album_artist", "year": "date"}
# How far starts may drift, how much picture may be missing (both bounds must be passed), the margin of a
# peak's measurement, how far a picture's proportions may move.
SYNC_SECONDS, TAIL_SECONDS, TAIL_PERCENT, PEAK_MARGIN, ASPECT = 0.5, 1.0, 2.0, 0.1, 0.02

Facts = Callable[[str], Column]


@dataclass(frozen=True)
class Policy:
    """What a library asks for. A row's own quality_gate and least_vmaf_* come before the policy's, within 0 to 100."""

    duration_tolerance_percent: float = 1.0
    require_audio: bool = True
    require_subtitles: bool = False
    require_size_reduction: bool = True
    quality_gate: bool = False
    vmaf_harmonic: float = 93.0
    vmaf_p5: float = 80.0
    vmaf_min: float = 50.0
    loudness_tolerance: float | None = None
    peak_ceiling: float | None = None
    least_ssim: float | None = 0.95
    image_metadata: bool = True
    marker_tag: str | None = None


def facts_of(rows: DataFrame) -> Facts:
    kinds = {f.name: f.dataType for f in DataType.fromDDL(FACTS)}
    kinds |= {f"{side}_{f.name}": f.dataType for side in ("source", "output") for f in DataType.fromDDL(SIDE)}
    return lambda name: F.col(name) if name in rows.columns else F.lit(None).cast(kinds[name])


def flag(condition: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def percent_drift(before: Column, after: Column) -> Column:
    return F.when((before > 0) & (after > 0), F.abs(after - before) / before * 100)


def kept_tracks(c: Facts, kind: str, least: int, required: bool) -> Column:
    """Exactly what a planned removal leaves, though not below ``least``; else no fewer than before, if that is required."""
    before, after, removed = c(f"source_{kind}_tracks"), c(f"output_{kind}_tracks"), F.coalesce(c(f"removed_{kind}_tracks"), F.lit(0))
    left = F.greatest(before - removed, F.least(before, F.lit(least)))
    return F.when(removed > 0, after == left).when(F.lit(not required), F.lit(True)).otherwise(after >= before)


def same_languages(expected: Column, found: Column) -> Column:
    """Place by place; what was expected in no known language matches anything."""
    pairs = F.zip_with(F.transform(expected, canonical), F.transform(found, canonical), lambda e, x: e.isNull() | e.eqNullSafe(x))
    return (F.size(expected) == F.size(found)) & F.forall(pairs, lambda ok: ok)


def same_codecs(expected: Column, found: Column) -> Column:
    pairs = F.zip_with(expected, found, lambda e, x: flag((F.trim(e) != "") & (F.lower(e) == F.lower(x))))
    return (F.size(expected) == F.size(found)) & F.forall(pairs, lambda ok: ok)


def media_tags(tags: Column, marker: str | None) -> Column:
    """key -> value of the tags that describe the media, keys in one spelling, without blanks."""
    left_out = [*CONTAINER_TAGS, *([marker.lower()] if marker else [])]

    def entry(e: Column) -> Column:
        key = F.lower(F.trim(e["key"]))
        for other, one in SPELLINGS.items():
            key = F.when(key == other, one).otherwise(key)
        return F.struct(key.alias("key"), F.trim(e["value"]).alias("value"))

    entries = F.transform(F.coalesce(F.map_entries(tags), F.array().cast("array<struct<key:string,value:string>>")), entry)
    return last_of_keys(F.filter(entries, lambda e: ~e["key"].isin(*left_out) & flag(e["value"] != "")))


def span(c: Facts) -> Column:
    """How long the source's picture lasts: to its last measured packet, else as long as the file."""
    measured = flag(c("source_timestamps_measured")) & c("source_last_presentation").isNotNull()
    return F.when(measured, F.greatest(F.lit(0.0), c("source_last_presentation") - F.coalesce(c("source_video_start"), F.lit(0.0)))).otherwise(c("source_duration"))


def complete(whole: Column, part: Column) -> Column:
    short = whole - part
    return ~((short > TAIL_SECONDS) & (short / whole * 100 > TAIL_PERCENT))


def structure_rules(c: Facts) -> list[tuple[Column, str]]:
    """What a video keeps, in the order of the messages."""
    wanted = F.when(flag(c("video_reencoded")), c("expected_video_codec")).otherwise(c("source_video_codec"))
    before, after = (pixel_format(c(f"{s}_pixel_format"), c(f"{s}_bits_per_raw_sample")) for s in ("source", "output"))
    profile = c("output_video_profile")
    return [
        ((F.trim(wanted) != "") & (F.lower(wanted) == F.lower(c("output_video_codec"))), "codec differs from what was expected"),
        ((c("source_width") == c("output_width")) & (c("source_height") == c("output_height")), "resolution changed or unknown"),
        (before.isNotNull() & after.isNotNull(), "pixel format unknown"),
        (after["depth"] >= before["depth"], "bit depth dropped"),
        (after["chroma"] >= before["chroma"], "chroma sampling reduced"),
        (F.trim(profile) != "", "profile unknown"),
        (flag(c("video_reencoded")) | (F.lower(c("source_video_profile")) == F.lower(profile)), "profile changed by a remux"),
        ((after["depth"] <= 8) | profile.rlike("10|12") | (F.lower(c("output_video_codec")) == "av1"), "profile does not fit the bit depth"),
    ]


def dimensions_kept(c: Facts) -> Column:
    """Unknown sizes of a source aren't compared; a downscale that was asked for keeps the proportions."""
    w, h, x, y = c("source_width"), c("source_height"), c("output_width"), c("output_height")
    scaled = (x <= w) & (y <= h) & (F.abs(w / h - x / y) <= w / h * ASPECT)
    return F.when(w.isNull() | h.isNull(), F.lit(True)).when(flag(c("downscaled")), scaled).otherwise((x >= w) & (y >= h))


def fidelity(c: Facts) -> Column:
    """No fewer channels, unless that was asked for, and no lower rate where sound was only copied."""
    before, after = c("source_audio_channels"), F.coalesce(c("output_audio_channels"), F.lit(0))
    rate, out_rate = c("source_sample_rate"), c("output_sample_rate")
    lower = flag((rate > 0) & (out_rate > 0) & (out_rate < rate))
    made_anew = flag(c("media_kind") == "Audio") | flag(c("audio_reencoded"))
    return F.when(after < before, flag(c("downmixed")) & (after > 0)).otherwise(made_anew | ~lower)


def colours_kept(c: Facts) -> Column:
    """Values that both sides declare are equal; after tone mapping, declared ones are Rec. 709."""
    same, mapped = F.lit(True), F.lit(True)
    for name in ("color_primaries", "color_transfer", "color_space"):
        before, after = F.lower(c(f"source_{name}")), F.lower(c(f"output_{name}"))
        same, mapped = same & F.coalesce(before == after, F.lit(True)), mapped & F.coalesce(after == "bt709", F.lit(True))
    return F.when(flag(c("tone_mapped")), mapped).otherwise(same)


def meets_gate(c: Facts, policy: Policy) -> Column:
    bound = lambda name, default: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c(name))), F.lit(default))
    own = lambda name, default: F.when(c(name).isNull(), F.lit(default)).otherwise(bound(name, default))
    low = F.coalesce(c("vmaf_p5"), c("vmaf_min"))
    return (c("vmaf_harmonic") >= own("least_vmaf_harmonic", policy.vmaf_harmonic)) & (low >= own("least_vmaf_p5", policy.vmaf_p5)) & (c("vmaf_min") >= own("least_vmaf_min", policy.vmaf_min))


#: Of so many frames at most one is scored.
MOST_FRAMES = 10


def resolved_policy(policy: Policy = Policy(), clip_gate: bool = False, frame_interval: int = 1) -> dict[str, Column]:
    """The policy of a row with its own overrides (null: as the policy says): bounds within 0 and 100, intervals within 1 and MOST_FRAMES."""
    own = lambda name, default: F.coalesce(F.when(F.col(name).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(name)))), F.lit(float(default)))
    interval = F.when(F.col("frame_interval").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(MOST_FRAMES), F.col("frame_interval"))))
    return {
        "quality_gate": F.coalesce("quality_gate", F.lit(policy.quality_gate)),
        "least_vmaf_harmonic": own("least_vmaf_harmonic", policy.vmaf_harmonic),
        "least_vmaf_p5": own("least_vmaf_p5", policy.vmaf_p5),
        "least_vmaf_min": own("least_vmaf_min", policy.vmaf_min),
        "clip_gate": F.coalesce("clip_gate", F.lit(clip_gate)),
        "frame_interval": F.coalesce(interval, F.lit(frame_interval)),
    }


def named_checks(rows: DataFrame, policy: Policy) -> list[Check]:
    """All checks in a fixed order."""
    c = facts_of(rows)
    named = lambda name, passed, detail, applies=None: (name, passed, detail, applies)
    video, image, audio = (flag(c("media_kind") == k) for k in ("Video", "Image", "Audio"))
    moving, none = ~image, F.lit("")
    of = lambda name: F.concat_ws(" to ", c(f"source_{name}").cast("string"), c(f"output_{name}").cast("string"))
    drift = percent_drift(c("source_duration"), c("output_duration"))
    removed = lambda side: (c(f"source_{side}").isNull() | ~c(f"source_{side}") | c(f"output_{side}"))
    smaller = (c("output_bytes") > 0) & (F.lit(not policy.require_size_reduction) | (c("output_bytes") < c("source_bytes")))
    tags, kept = media_tags(c("source_tags"), policy.marker_tag), media_tags(c("output_tags"), policy.marker_tag)
    pictures = F.coalesce(c("output_attached_pictures"), F.lit(0)) >= F.coalesce(c("source_attached_pictures"), F.lit(0))
    structure = structure_rules(c)
    coloured = F.coalesce(c("source_color_primaries"), c("source_color_transfer"), c("source_color_space")).isNotNull()
    offset = c("output_video_start") - c("output_audio_start")
    sync = F.abs(offset - F.coalesce(c("source_video_start") - c("source_audio_start"), F.lit(0.0)))
    source_measured, output_measured = (flag(c(f"{s}_timestamps_measured")) for s in ("source", "output"))
    shown = F.greatest(F.lit(0.0), c("output_last_presentation") - F.coalesce(c("output_video_start"), F.lit(0.0)))
    gated = F.coalesce(c("quality_gate"), F.lit(policy.quality_gate)) & video & flag(c("video_reencoded"))
    codec = F.trim(c("output_video_codec")) != ""
    checks = [
        named("Decode health", c("decode_errors") == 0, c("decode_errors")),
        named("Output readable", c("output_probed"), none),
        named("Duration", drift <= policy.duration_tolerance_percent, F.format_string("%.2f%%", drift), moving),
        named("Audio tracks", kept_tracks(c, "audio", 1, policy.require_audio), of("audio_tracks"), moving),
        named("Subtitle tracks", kept_tracks(c, "subtitle", 0, policy.require_subtitles), of("subtitle_tracks"), moving),
        *[named(f"{kind.title()} languages", same_languages(c(f"expected_{kind}_languages"), c(f"output_{kind}_languages")), none, moving & c(f"expected_{kind}_languages").isNotNull()) for kind in ("audio", "subtitle")],
        named("Container unchanged", F.lower(c("source_container")) == F.lower(c("output_container")), of("container"), moving & c("container_fixed")),
        named("Audio codecs unchanged", same_codecs(c("expected_audio_codecs"), c("output_audio_codecs")), none, moving & c("container_fixed")),
        named("Audio metadata and artwork", pictures & bound(kept, lambda k: F.forall(F.map_entries(tags), lambda e: k[e["key"]].eqNullSafe(e["value"]))), of("attached_pictures"), audio),
        named(SIZE_SAVING, smaller, of("bytes")),
        named("Picture", codec, c("output_video_codec"), image),
        named("Dimensions", dimensions_kept(c), F.concat(of("width"), F.lit(" x "), of("height")), image),
    ]
    if policy.least_ssim is not None:
        checks.append(named("Image quality (SSIM)", c("ssim") >= policy.least_ssim, c("ssim"), image))
    if policy.image_metadata:
        checks.append(named("Image metadata (EXIF/ICC)", c("image_metadata_measured") & removed("has_icc") & removed("has_exif"), none, image))
    checks += [
        named("Video stream", codec, c("output_video_codec"), video),
        named("Video structure", first_failure(structure).isNull(), F.coalesce(first_failure(structure), none), video),
        named("HDR signal", flag(c("tone_mapped")) | c("output_is_hdr"), none, video & c("source_is_hdr")),
        named("Audio fidelity", fidelity(c), of("audio_channels"), F.lit(policy.require_audio) & (c("source_audio_channels") > 0)),
        named("Colour metadata", colours_kept(c), none, video & coloured),
        named("A/V sync", sync <= SYNC_SECONDS, F.format_string("%.3f s", sync), video & offset.isNotNull()),
        named("Timestamp integrity", F.coalesce(c("timestamp_regressions"), F.lit(0)) == 0, c("timestamp_regressions"), video & output_measured),
        named("Source video timeline", complete(c("source_duration"), span(c)), F.format_string("%.2f s", c("source_duration") - span(c)), video & source_measured & c("source_last_presentation").isNotNull() & (c("source_duration") > 0)),
        named("Tail integrity", complete(span(c), shown), F.format_string("%.2f s", span(c) - shown), video & output_measured & c("output_last_presentation").isNotNull() & (span(c) > 0)),
        named(QUALITY, meets_gate(c, policy), F.format_string("%.2f", c("vmaf_harmonic")), gated),
    ]
    if policy.loudness_tolerance is not None:
        checks.append(named("Audio loudness (EBU R128)", F.abs(c("output_loudness") - c("source_loudness")) <= policy.loudness_tolerance, of("loudness"), moving))
    if policy.peak_ceiling is not None:
        clipped = (c("output_peak") > policy.peak_ceiling) & (c("output_peak") > c("source_peak") + PEAK_MARGIN)
        checks.append(named("Audio clipping (true peak)", c("source_peak").isNotNull() & c("output_peak").isNotNull() & ~clipped, of("peak"), moving))
    return checks


def verified(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """rows with checks: array<struct<name, outcome, detail>> in a fixed order, and passed."""
    return rows.withColumn("checks", report(*[check(*c) for c in named_checks(rows, policy)])).withColumn("passed", all_passed(F.col("checks")))


def failures(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """rows with failed: the names of the checks of ``verified`` that fail, as one text, for counting many rows."""
    return rows.withColumn("failed", failed_text(named_checks(rows, policy)))
