"""Eligibility of media files: profiles, overrides, three decision trees and three overlays, all as columns.

A tree is an ordered list of (condition, eligible, reason); the first condition that holds decides. Conditions that are
null do not hold. The order of the cases and the texts of the reasons are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.languages import canonical
from siltstone.functions.scalars import blank_to_null, contains_any, first_match, human_size

MIB = 1 << 20
Case = tuple[Column, bool, Column | str]

RULES = (
    "profile string, target_video_codec string, target_container string, default_crf int, min_file_size_bytes long, efficiency_floor double, "
    "hdr string, video_audio_codec string, video_audio_bitrate_kbps int, downmix_to_stereo boolean, target_audio_codec string, audio_bitrate_kbps int"
)
# The six profiles' defaults, in the order of RULES. The fourth is stored under a person's name elsewhere:
# resolved_rules maps names that a store uses to these.
PROFILES = [
    ("ConservativeHevc", "hevc", "mp4", 24, 200 * MIB, 1.0, "Exclude", "aac", 160, False, "aac", 128),
    ("CompatibilityH264", "h264", "mp4", 20, 200 * MIB, 2.0, "Exclude", "aac", 160, False, "aac", 128),
    ("ExperimentalAv1", "av1", "mkv", 30, 200 * MIB, None, "Preserve", None, 160, False, "aac", 128),
    ("SmallStereoHevc", "hevc", "mp4", 24, 200 * MIB, 1.0, "Preserve", "aac", 96, True, "aac", 96),
    ("RemuxCleanup", None, "mkv", None, 0, None, "Preserve", None, 160, False, "aac", 128),
    ("TrackCleanup", None, None, None, 0, None, "Preserve", None, 160, False, "aac", 128),
]
# Codecs whose sources lose nothing, what each image format is probed as, sizes below which nothing is done.
LOSSLESS_AUDIO = ("flac", "alac", "ape", "wavpack", "tta", "tak", "truehd", "mlp")
LOSSLESS_IMAGES = ("png", "bmp", "tiff", "gif")
PROBED_AS = {"jpeg": ("mjpeg", "jpeg"), "webp": ("webp",), "avif": ("av1",), "jxl": ("jpegxl", "jxl")}
LEAST_AUDIO_BYTES, LEAST_IMAGE_BYTES = 4 * MIB, 200 * 1024
LOSSY_SAVING = 1.25
ALPHA_FORMATS = r"^(pal8$|ya8$|rgba|bgra|argb|abgr|yuva|gbrap|ya16)"
CONTAINER_KEYWORDS = {"mkv": "matroska", "mka": "matroska", "m4v": "mp4"}


def profile_dimension(spark: SparkSession) -> DataFrame:
    """Six rows, for a broadcast join."""
    return F.broadcast(spark.createDataFrame(PROFILES, RULES))


RULE_COLUMNS = (
    "profile", "target_video_codec", "target_container", "target_audio_codec", "hdr", "min_file_size_bytes", "audio_bitrate_kbps", "video_audio_bitrate_kbps", "downmix_to_stereo", "video_audio_codec",
    "max_height", "reencode_same_codec_above_bytes", "optimise_dolby_vision", "reencode_lossy_audio", "reencode_lossy_images", "target_image_format", "efficiency_floor",
)
#: The rules of a library that overrides nothing; those that are left out are null.
DEFAULT_RULES = dict(zip([c.split()[0] for c in RULES.split(", ")], PROFILES[0])) | {"optimise_dolby_vision": False, "reencode_lossy_audio": False, "reencode_lossy_images": False, "target_image_format": "jpeg"}


def resolved_rules(libraries: DataFrame, spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """Libraries with their rules: an override, where it isn't blank, before the profile's default.

    names maps other names of profiles to those of PROFILES. A library of an unknown profile has the first profile's rules.

    Missing override columns count as null. Track cleanup takes no override but of paths and languages. ``copy`` as the
    audio codec of a video means none.
    """
    texts = ["target_video_codec", "target_container", "target_audio_codec", "hdr"]
    numbers = {"min_file_size_bytes": "long", "audio_bitrate_kbps": "int", "video_audio_bitrate_kbps": "int", "downmix_to_stereo": "boolean"}
    own = {"max_height": "int", "reencode_same_codec_above_bytes": "long", "optimise_dolby_vision": "boolean", "reencode_lossy_audio": "boolean", "reencode_lossy_images": "boolean", "skip_efficient_sources": "boolean", "target_image_format": "string"}
    kinds = {**{c: "string" for c in [*texts, "video_audio_codec"]}, **numbers, **own}
    over = lambda c: (F.col(f"lib.{c}") if c in libraries.columns else F.lit(None)).cast(kinds[c])
    narrow = F.col("p.profile") == "TrackCleanup"
    open_ = lambda c: F.when(~narrow, c)
    stored = F.col("rule_profile")
    for other, name in (names or {}).items():
        stored = F.when(F.col("rule_profile") == other, name).otherwise(stored)
    known = F.when(stored.isin(*[p[0] for p in PROFILES]), stored).otherwise(PROFILES[0][0])
    joined = libraries.withColumn("__profile", known).alias("lib").join(profile_dimension(spark).alias("p"), F.col("__profile") == F.col("p.profile"))
    audio = blank_to_null(over("video_audio_codec"))
    columns = {c: F.coalesce(open_(blank_to_null(over(c))), F.col(f"p.{c}")) for c in texts}
    columns |= {c: F.coalesce(open_(over(c)), F.col(f"p.{c}")) for c in numbers}
    columns["video_audio_codec"] = F.when(~narrow & (F.lower(audio) == "copy"), F.lit(None)).otherwise(F.coalesce(open_(audio), F.col("p.video_audio_codec")))
    columns |= {c: open_(over(c)) for c in ("max_height", "reencode_same_codec_above_bytes")}
    columns |= {c: F.coalesce(open_(over(c)), F.lit(False)) for c in ("optimise_dolby_vision", "reencode_lossy_audio", "reencode_lossy_images")}
    columns["target_image_format"] = F.coalesce(open_(blank_to_null(over("target_image_format"))), F.lit("jpeg"))
    columns["efficiency_floor"] = F.when(F.coalesce(over("skip_efficient_sources"), F.lit(True)), F.col("p.efficiency_floor"))
    kept = [c for c in libraries.columns if c not in columns]
    return joined.select(*[F.col(f"lib.{c}") for c in kept], F.col("p.profile").alias("profile"), *[v.alias(k) for k, v in columns.items()])


def decided(cases: Sequence[Case], otherwise: Column | str) -> Column:
    """struct<eligible, reason> of the first case that holds; else eligible for the reason otherwise."""
    as_column = lambda r: F.lit(r) if isinstance(r, str) else r
    made = lambda ok, r: F.struct(F.lit(ok).alias("eligible"), as_column(r).alias("reason"))
    out = None
    for condition, ok, reason in cases:
        held = F.coalesce(condition, F.lit(False))
        out = F.when(held, made(ok, reason)) if out is None else out.when(held, made(ok, reason))
    return out.otherwise(made(True, otherwise))


def text(*parts: Column | str) -> Column:
    """Parts as one string; a null part is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def is_blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def same(a: str, b: str | Column) -> Column:
    return F.lower(a) == F.lower(b)


def density() -> Column:
    """Bits per pixel and second; null where a part is unknown or not above zero."""
    known = (F.col("duration_seconds") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    return F.when(known, F.col("size_bytes") * 8.0 / F.col("duration_seconds") / (F.col("width").cast("double") * F.col("height")))


def removal_reason() -> Column:
    def part(kind: str) -> Column:
        removed, langs = F.col(f"__{kind}_removed"), F.col(f"{kind}_languages")
        names = F.transform(removed, lambda i: F.coalesce(F.get(langs, i), F.lit("und")))
        return F.when(F.size(removed) > 0, text(F.size(removed), f" {kind} track(s) (", F.array_join(names, ", "), ")"))

    return text("Remove ", F.concat_ws(" + ", part("audio"), part("subtitle")), " not in the kept languages")


def video_tree() -> Column:
    segments = F.coalesce("exclude_segments", F.array().cast("array<string>"))
    segment = F.try_element_at(F.filter(segments, lambda s: F.lower("relative_path").contains(F.lower(s))), F.lit(1))
    removing = F.size("__audio_removed") + F.size("__subtitle_removed") > 0
    keeps = lambda kind: F.size(F.coalesce(f"keep_{kind}_languages", F.array().cast("array<string>"))) > 0
    unknown = (keeps("audio") & F.col("audio_languages").isNull()) | (keeps("subtitle") & F.col("subtitle_languages").isNull())
    target, container, probed = F.col("target_video_codec"), F.col("target_container"), F.col("container")
    no_codec, cleanup = target.isNull(), target.isNull() & container.isNull()
    keyword = F.lower(F.trim(container))
    for name, word in CONTAINER_KEYWORDS.items():
        keyword = F.when(F.lower(F.trim(container)) == name, word).otherwise(keyword)
    clean = F.coalesce(F.lower(probed).contains(keyword), F.lit(False))
    size, height = F.col("size_bytes"), F.col("height")
    mbps = F.format_string("%.1f", size * 8.0 / F.col("duration_seconds") / 1_000_000.0)
    return decided(
        [
            (is_blank("video_codec"), False, "No video stream detected (not probed, or audio-only)"),
            (segment.isNotNull(), False, text('Path excluded by rule: "', segment, '"')),
            ((F.col("hdr") == "Exclude") & F.col("is_hdr"), False, "HDR / Dolby Vision excluded by this library's rules"),
            (~no_codec & F.col("is_dolby_vision") & ~F.col("optimise_dolby_vision"), False, "Dolby Vision — re-encoding would drop the DV layer and risk a colour shift (Profile 5); left untouched"),
            (size < F.col("min_file_size_bytes"), False, text("Below minimum size (", human_size(F.col("min_file_size_bytes")), ")")),
            (height > F.col("max_height"), False, text("Resolution ", height, "p above limit (", F.col("max_height"), "p)")),
            (cleanup & ~keeps("audio") & ~keeps("subtitle"), False, "No kept audio or subtitle languages configured — nothing to remove"),
            (cleanup & removing, True, removal_reason()),
            (cleanup & unknown, False, "Track languages not captured yet — re-probe the file to evaluate the kept-languages rule"),
            (cleanup, False, "No removable tracks (all tracks match the kept languages or are unknown)"),
            (no_codec & ~clean, True, text("Remux to ", container, " (", probed, " → ", container, ")")),
            (no_codec & removing, True, removal_reason()),
            (no_codec, False, text("Already in the target container (", container, ")")),
            (same("video_codec", target) & (size >= F.col("reencode_same_codec_above_bytes")), True, text("Already ", target, " but ", human_size(size), " ≥ ", human_size(F.col("reencode_same_codec_above_bytes")), " — re-encoding to shrink")),
            (same("video_codec", target), False, text("Already ", target, " (no expected saving)")),
            (density() < F.col("efficiency_floor"), False, text("Already efficiently encoded (~", mbps, " Mbps at ", height, "p) — re-encoding is unlikely to save space")),
        ],
        text(F.col("video_codec"), " → ", target),
    )


def audio_tree() -> Column:
    codec, target, channels = F.col("audio_codec"), F.col("target_audio_codec"), F.coalesce("max_audio_channels", F.lit(0))
    out_channels = F.when(F.col("downmix_to_stereo"), F.least(channels, F.lit(2))).otherwise(channels)
    fits = (out_channels <= 0) | F.when(F.lower(target) == "mp3", out_channels <= 2).when(F.lower(target).isin("aac", "opus"), out_channels <= 8).otherwise(False)
    pairs = F.when(F.col("downmix_to_stereo") | (channels <= 2), F.lit(1)).otherwise(F.ceil(channels / 2).cast("int"))
    kbps, source = F.col("audio_bitrate_kbps") * pairs, F.col("source_audio_kbps")
    lossless = F.lower(codec).startswith("pcm_") | F.lower(codec).isin(*LOSSLESS_AUDIO)
    return decided(
        [
            (is_blank("audio_codec"), False, "No audio stream detected"),
            (F.col("size_bytes") < LEAST_AUDIO_BYTES, False, text("Below minimum size (", human_size(F.lit(LEAST_AUDIO_BYTES)), ")")),
            (same("audio_codec", target), False, text("Already ", target, " (no expected saving)")),
            ((F.lower(target) != "mp3") & (F.col("attached_picture_count") > 0), False, text(target, " cannot safely preserve embedded cover art with the shipped FFmpeg; choose MP3 for this library")),
            ((F.lower(target) != "aac") & (F.col("subtitle_track_count") > 0), False, text(target, " cannot preserve the embedded timed lyrics/subtitle stream")),
            (~fits, False, text(target, " cannot safely encode the ", channels, "-channel layout; enable stereo downmix or choose another codec")),
            (lossless, True, text(codec, " → ", target)),
            (~F.col("reencode_lossy_audio"), False, text(codec, " is already a space-efficient (lossy) codec — left untouched")),
            (source.isNull(), False, text(codec, " source bitrate unknown — cannot confirm a saving, left untouched")),
            (source < kbps * LOSSY_SAVING, False, text(codec, " at ", source, " kbps is not far enough above the ", kbps, " kbps target to save space — left untouched")),
        ],
        text(codec, " ", source, " kbps → ", target, " ", kbps, " kbps"),
    )


def image_tree() -> Column:
    codec, target, pixels = F.col("video_codec"), F.col("target_image_format"), F.lower("pixel_format")
    already = F.lit(False)
    for name, codecs in PROBED_AS.items():
        already = already | ((F.lower(target) == name) & F.lower(codec).isin(*codecs))
    lossless, opted = F.lower(codec).isin(*LOSSLESS_IMAGES), F.col("reencode_lossy_images")
    deep = F.coalesce(F.col("bits_per_raw_sample") > 8, F.lit(False)) | is_blank("pixel_format") | pixels.rlike("10|12|14|16|48|64")
    jpeg = F.lower(target) == "jpeg"
    return decided(
        [
            (is_blank("video_codec"), False, "No image data detected"),
            (F.lower(codec).isin("gif", "webp") & F.col("frame_count").isNull(), False, "Frame count could not be proven for an animated-capable image"),
            (F.col("frame_count") > 1, False, text("Animated image (", F.col("frame_count"), " frames) — not optimised")),
            (F.col("size_bytes") < LEAST_IMAGE_BYTES, False, text("Below minimum size (", human_size(F.lit(LEAST_IMAGE_BYTES)), ")")),
            (already, False, text("Already ", target, " (no expected saving)")),
            (F.lower(codec) == "tiff", False, "TIFF multi-page status cannot be proven safely"),
            (~lossless & ~opted, False, text(codec, " is already a compressed (lossy) image — left untouched")),
            (jpeg & (is_blank("pixel_format") | pixels.rlike(ALPHA_FORMATS)), False, "Target format cannot safely preserve the source alpha channel"),
            (F.lower(target).isin("jpeg", "webp") & deep, False, "Target format cannot safely preserve the source bit depth"),
            (lossless & jpeg & ~opted, False, text(codec, " → ", target, " is a lossy conversion; explicit opt-in required")),
        ],
        text(codec, " → ", target),
    )


def with_removals(files: DataFrame) -> DataFrame:
    """Positions of unwanted tracks: each row's library has its own kept languages, so they are compared as columns."""
    none = F.array().cast("array<int>")

    def removed(kind: str, guard: bool) -> Column:
        known = F.transform(F.col(f"{kind}_languages"), canonical)
        listed = F.transform(F.coalesce(f"keep_{kind}_languages", F.array().cast("array<string>")), canonical)
        usable = (F.size(listed) > 0) & F.forall(listed, lambda x: x.isNotNull())  # an unknown code makes the list void
        marked = F.filter(F.transform(known, lambda x, i: F.when(x.isNotNull() & ~F.array_contains(listed, x), i)), lambda x: x.isNotNull())
        kept = F.exists(known, lambda x: F.coalesce(F.array_contains(listed, x), F.lit(False)))
        return F.coalesce(F.when(usable & (kept if guard else F.lit(True)), marked), none)

    return files.withColumn("__audio_removed", removed("audio", True)).withColumn("__subtitle_removed", removed("subtitle", False))


def evaluate(files: DataFrame) -> DataFrame:
    """files, each with its library's resolved rules, and column decision: struct<eligible, reason>."""
    kind = F.col("media_kind")
    skip = lambda reason: F.struct(F.lit(False).alias("eligible"), F.lit(reason).alias("reason"))
    decision = (
        F.when(~is_blank("optimised_marker"), skip("Already optimised (file is tagged)"))
        .when((F.col("profile") == "TrackCleanup") & ~F.coalesce(kind == "Video", F.lit(False)), skip("Track cleanup applies only to video files"))
        .when(kind == "Audio", audio_tree())
        .when(kind == "Image", image_tree())
        .otherwise(video_tree())
    )
    return with_removals(files).withColumn("decision", decision).drop("__audio_removed", "__subtitle_removed")


def overlaid(decision: Column, sibling: Column | None = None, completed: Column | None = None, failed: Column | None = None, modified: Column | None = None, excluded: Column | None = None) -> Column:
    """The decision after what is known besides the rules: siblings and history only skip what is eligible; an exclusion always does."""
    skip = lambda reason: F.struct(F.lit(False).alias("eligible"), F.lit(reason).alias("reason"))
    holds = lambda c: F.coalesce(c, F.lit(False))
    out = decision
    if sibling is not None:
        out = F.when(out["eligible"] & holds(sibling), skip("An optimised copy already exists alongside this file")).otherwise(out)
    if modified is not None:
        done = holds(completed >= modified) if completed is not None else F.lit(False)
        bad = holds(failed >= modified) if failed is not None else F.lit(False)
        out = F.when(out["eligible"] & done, skip("Already optimised")).when(out["eligible"] & bad, skip("Previously failed — retry from the Queue page")).otherwise(out)
    if excluded is not None:
        out = F.when(holds(excluded), skip("Excluded — won't be optimised")).otherwise(out)
    return out


# Categories of failures by phrases of their messages, in order.
FAILURES = (
    ("SizeSaving", ("Size saving",)),
    ("BitmapSubtitles", ("text to text or bitmap to bitmap", "image-based subtitles")),
    ("ContainerIncompatibility", ("codec none", "incorrect codec parameters", "not currently supported in container")),
    ("ReplacementCollision", ("collide with an existing file", "Another optimised file")),
    ("SourceMissing", ("no longer exists", "missing from the work directory", "No such file")),
    ("Verification", ("Verification failed",)),
)


def classify_failure(message: Column) -> Column:
    """The first category any of whose phrases is in the message; blank, null or none of them: Other."""
    return first_match([(contains_any(message, phrases), name) for name, phrases in FAILURES], "Other")
