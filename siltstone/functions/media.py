"""Expressions over media facts: titles, kinds, pixel formats, sizes, markers, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.scalars import trimmed_number
from siltstone.sources.files import EXTENSIONS

# Subtitle codecs that are pictures; audio codecs that an MP4 file can't hold.
PICTURE_SUBTITLES = ("hdmv_pgs_subtitle", "pgssub", "dvd_subtitle", "dvdsub", "dvb_subtitle", "dvbsub", "xsub")
NOT_IN_MP4 = ("truehd", "mlp", "pcm_bluray", "pcm_dvd")
# What ends a title, what a season's folder is called, a year.
RELEASE_MARKER = r"(?i)(\(?(?:19|20)\d{2}\)?|\bS\d{1,2}E\d{1,2}\b|\b\d{3,4}p\b|\b(?:bluray|blu-ray|remux|web-?rip|web-?dl|hdtv|dvdrip|bdrip|x264|x265|h264|h265|hevc|avc|aac|dts|ddp?5)\b)"
SEASON_FOLDER = r"(?i)^(season\s*\d+|s\d+|specials)$"
YEAR = r"((?:19|20)\d{2})"
SIGNATURES = {"image/jpeg": "FFD8FF", "image/png": "89504E47", "image/gif": "47494638", "image/bmp": "424D"}


def cleaned_title(text: Column) -> Column:
    """What stands before the first release marker, separators as single blanks."""
    before = F.split(text, RELEASE_MARKER, 2)[0]
    return F.btrim(F.regexp_replace(F.regexp_replace(before, "[._]", " "), r"\s{2,}", " "), F.lit(" -–"))


def title_and_year(path: Column, is_series: Column) -> Column:
    """struct<title, year>: of a series from the folder above its season, of a film from its own folder; null without a title."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: s != "")
    name = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(?<=.)\.[^.]*$", "")
    season = F.array_position(F.transform(parts, lambda s: s.rlike(SEASON_FOLDER)), F.lit(True)).cast("int")
    show = F.when(season > 1, F.get(parts, season - 2)).otherwise(F.get(parts, 0))
    folder = F.when(is_series, show).otherwise(F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(name))
    title = F.coalesce(F.nullif(cleaned_title(folder), F.lit("")), F.nullif(cleaned_title(name), F.lit("")))
    year = F.coalesce(*[F.nullif(F.regexp_extract(x, YEAR, 1), F.lit("")).try_cast("int") for x in (folder, name)])
    return F.when(title.isNotNull(), F.struct(title.alias("title"), year.alias("year")))


def media_kind(extension: Column, has_video: Column, has_audio: Column) -> Column:
    """A picture by its extension, else by the streams; attached pictures are no video."""
    dotted = F.lower(F.when(F.startswith(extension, F.lit(".")), extension).otherwise(F.concat(F.lit("."), extension)))
    return F.when(dotted.isin(*EXTENSIONS["Photos"]), "Image").when(has_video, "Video").when(has_audio, "Audio").otherwise("Unknown")


def pixel_format(name: Column, bits: Column) -> Column:
    """struct<depth, chroma>: bits of a sample, and 3 for 4:4:4 down to 0 where unknown; null for a blank name."""
    low = F.lower(name)
    suffix = F.nullif(F.regexp_extract(low, r"p(\d{2})(?:le|be)?$", 1), F.lit("")).try_cast("int")
    depth = F.when(bits > 0, bits).when(low.rlike("rgb48|rgba64"), 16).otherwise(F.coalesce(suffix, F.lit(8)))
    chroma = F.when(low.rlike("444|^(gbr|rgb|bgr)"), 3).when(low.contains("422"), 2).when(low.rlike("420|^(nv12|p010)"), 1).otherwise(0)
    return F.when(F.trim(name) != "", F.struct(depth.cast("int").alias("depth"), chroma.alias("chroma")))


def binary_size(size: Column) -> Column:
    """With the largest of B, KB, MB, GB, TB that leaves one at least."""
    value = size.cast("double")
    out = F.concat(trimmed_number(value / 1024**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(value < 1024 ** (power + 1), F.concat(trimmed_number(value / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def picture_subtitle(codec: Column) -> Column:
    return F.coalesce(F.lower(F.trim(codec)).isin(*PICTURE_SUBTITLES), F.lit(False))


def kept_out_of_mp4(codecs: Column) -> Column:
    """Whether any codec of a comma-separated list can't be put in an MP4 file."""
    return F.coalesce(F.exists(F.split(codecs, ","), lambda c: F.lower(F.trim(c)).isin(*NOT_IN_MP4)), F.lit(False))


def primary_codec(codecs: Column) -> Column:
    return F.nullif(F.trim(F.get(F.split(codecs, ","), 0)), F.lit(""))


def marker_value(field: Column, prefix: str) -> Column:
    """What follows the prefix, without regard to case; null for another program's field."""
    trimmed = F.trim(field)
    return F.when(F.startswith(F.lower(trimmed), F.lit(prefix.lower())), F.substr(trimmed, F.lit(len(prefix) + 1)))


def content_type(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 4)), F.lit("application/octet-stream")
    for name, start in SIGNATURES.items():
        out = F.when(F.startswith(head, F.lit(start)), name).otherwise(out)
    return out


def rate_saving(before: Column, before_seconds: Column, after: Column, after_seconds: Column) -> Column:
    """Percent saved by bytes per second, rounded half to even at one decimal; null where a part isn't above zero."""
    known = (before > 0) & (before_seconds > 0) & (after > 0) & (after_seconds > 0)
    return F.when(known, F.bround((1 - (after / after_seconds) / (before / before_seconds)) * 100, 1))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmssSSS")
