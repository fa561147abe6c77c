"""Imported configurations: JSON read against a fixed schema, and all that is wrong with it, as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import languages
from siltstone.operators.rules import PROFILES

VERSION = 1
LIBRARY = (
    "struct<name:string,path:string,mediaType:string,ruleProfile:string,hdrHandling:string,keepAudioLanguages:string,keepSubtitleLanguages:string,targetImageFormat:string,imageDownscaleMode:string,"
    "imageDownscaleValue:int,autoEnqueueWindowStart:string,autoEnqueueWindowEnd:string,minVmafHarmonicMean:double,minVmafMin:double,minVmafCatastrophicMin:double,vmafFrameSubsample:int>"
)
CONFIG = f"version int, settings map<string,string>, libraries array<{LIBRARY}>, activityWatchers array<struct<name:string,type:string,baseUrl:string>>, notificationTargets array<struct<name:string,type:string,url:string>>, arrConnections array<struct<name:string,type:string,baseUrl:string>>"
# What each named field may be, compared without regard to case, and how long a list of languages may be.
MEDIA_TYPES = ("Film", "Tv", "Music", "Other", "Photo")
HDR = ("Preserve", "Exclude", "TonemapToSdr")
IMAGE_FORMATS = ("jpeg", "webp", "avif")
DOWNSCALES = ("None", "MaxLongEdge", "Percent")
WATCHERS, TARGETS, CONNECTIONS = ("Plex", "Jellyfin", "Emby"), ("Webhook", "Ntfy", "Apprise", "Discord"), ("Sonarr", "Radarr")
LIST_LENGTH = 256


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The configurations in path; a file that is damaged or does not fit the schema is an error, so none is read in part."""
    return spark.read.schema(CONFIG).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _missing(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def _none_of(value: Column, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(F.lower(F.trim(value)).isin(*[a.lower() for a in allowed]), F.lit(False))


def _bad_languages(value: Column) -> Column:
    """A list is right if it is empty, or short and every code in it is known."""
    codes = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return (F.char_length(value) > LIST_LENGTH) | ~F.forall(codes, lambda c: languages.canonical(c).isNotNull())


def _outside(value: Column, low: float, high: float) -> Column:
    return F.isnan(value.cast("double")) | (value < low) | (value > high)


def library_errors(x: Column, where: Column) -> list[tuple[Column, Column]]:
    """(condition, message) for each rule of a library, in order."""
    harmonic, fifth, least, mode, size = x["minVmafHarmonicMean"], x["minVmafMin"], x["minVmafCatastrophicMin"], F.lower(F.trim(x["imageDownscaleMode"])), x["imageDownscaleValue"]
    listed = " languages must be comma-separated registered individual ISO 639 codes and at most 256 characters."
    out = [(_missing(x["name"]), _text(where, " name is required.")), (_missing(x["path"]), _text(where, " path is required."))]
    named = [("mediaType", "media type", MEDIA_TYPES), ("ruleProfile", "rule profile", [p[0] for p in PROFILES])]
    out += [(_none_of(x[c], allowed), _text(where, f" {label} is not valid: ", x[c], ".")) for c, label, allowed in named]
    out.append((x["hdrHandling"].isNotNull() & _none_of(x["hdrHandling"], HDR), _text(where, " HDR handling is not valid: ", x["hdrHandling"], ".")))
    out += [(_bad_languages(x[f"keep{k}Languages"]), _text(where, f" kept {k.lower()}{listed}")) for k in ("Audio", "Subtitle")]
    out.append((x["targetImageFormat"].isNotNull() & _none_of(x["targetImageFormat"], IMAGE_FORMATS), _text(where, " image target is not supported: ", x["targetImageFormat"], ".")))
    out.append((_none_of(x["imageDownscaleMode"], DOWNSCALES), _text(where, " image downscale mode is not valid: ", x["imageDownscaleMode"], ".")))
    out.append(((mode == "maxlongedge") & _outside(size, 16, 100_000), _text(where, " image max long-edge must be between 16 and 100000 pixels.")))
    out.append(((mode == "percent") & _outside(size, 1, 99), _text(where, " image downscale percentage must be between 1 and 99.")))
    out += [(~F.coalesce(x[f"autoEnqueueWindow{k}"].rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.lit(False)), _text(where, f" auto-enqueue window {k.lower()} must use HH:mm format.")) for k in ("Start", "End")]
    ranged = [(harmonic, 0, 100, "VMAF harmonic-mean floor"), (fifth, 0, 100, "VMAF fifth-percentile floor"), (least, 0, 100, "VMAF catastrophic floor"), (x["vmafFrameSubsample"], 1, 10, "VMAF frame sampling interval")]
    out += [(_outside(v, a, b), _text(where, f" {label} must be between {a} and {b}.")) for v, a, b, label in ranged]
    out.append((least > fifth, _text(where, " VMAF catastrophic floor cannot exceed the fifth-percentile floor.")))
    out.append((fifth > harmonic, _text(where, " VMAF fifth-percentile floor cannot exceed the harmonic-mean floor.")))
    out.append((fifth.isNull() & (least > harmonic), _text(where, " VMAF catastrophic floor cannot exceed the harmonic-mean floor.")))
    return out


def _named_errors(label: str, address: str, words: str, kinds: Sequence[str]) -> Callable[[Column, Column], list[tuple[Column, Column]]]:
    def rules(x: Column, where: Column) -> list[tuple[Column, Column]]:
        return [(_missing(x["name"]), _text(where, " name is required.")), (_missing(x[address]), _text(where, f" {words} is required.")), (_none_of(x["type"], kinds), _text(where, " type is not valid: ", x["type"], "."))]

    return rules


def held(rules: list[tuple[Column, Column]]) -> Column:
    """The messages of the rules whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in rules]), lambda m: m.isNotNull())


def config_errors(configs: DataFrame, allowed_settings: Sequence[str]) -> Column:
    """array<string>: all that is wrong with a row of CONFIG; empty if it may be imported."""
    v = F.col("version")
    version = held([(v.isNull() | (v < 1), _text("Unsupported config version ", F.coalesce(v, F.lit(0)), ".")), (v > VERSION, _text("Config version ", v, f" was exported by a newer version (this build supports up to version {VERSION})."))])
    keys = F.coalesce(F.map_keys("settings"), F.array().cast("array<string>"))
    unknown = F.transform(F.filter(keys, lambda k: ~k.isin(*allowed_settings)), lambda k: _text("Unknown setting key: ", k, "."))
    kinds = {f.name: f.dataType for f in configs.schema}

    def of(column: str, label: str, rules: Callable[[Column, Column], list[tuple[Column, Column]]]) -> Column:
        items = F.coalesce(column, F.array().cast(kinds[column]))
        return F.flatten(F.transform(items, lambda x, i: held(rules(x, _text(f"{label} #", i + 1)))))

    return F.concat(
        version,
        unknown,
        of("libraries", "Library", library_errors),
        of("activityWatchers", "Activity watcher", _named_errors("watcher", "baseUrl", "base URL", WATCHERS)),
        of("notificationTargets", "Notification target", _named_errors("target", "url", "URL", TARGETS)),
        of("arrConnections", "Sonarr/Radarr connection", _named_errors("connection", "baseUrl", "base URL", CONNECTIONS)),
    )
