"""Captured tool output as columns: JSON, XML, CSV, key-value protocols and logs.

Every number goes through try_cast, so damaged text gives nulls and no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import alnum_key, bound, rational

STREAM = (
    "struct<codec_type:string,codec_name:string,codec_tag_string:string,profile:string,width:string,height:string,bit_rate:string,nb_frames:string,pix_fmt:string,bits_per_raw_sample:string,"
    "channels:string,sample_rate:string,duration:string,duration_ts:string,time_base:string,r_frame_rate:string,avg_frame_rate:string,color_transfer:string,"
    "tags:map<string,string>,disposition:map<string,string>,side_data_list:array<struct<side_data_type:string>>>"
)
PROBE = f"struct<streams:array<{STREAM}>,format:struct<format_name:string,duration:string,bit_rate:string,tags:map<string,string>>>"
SCORES = "struct<frames:array<struct<frameNum:long,metrics:struct<vmaf:double>>>,pooled_metrics:map<string,struct<min:double,max:double,mean:double,harmonic_mean:double>>>"
FOLDERS = "struct<records:array<struct<series:struct<path:string>,movie:struct<path:string>>>>"
REPORT = "struct<checks:array<struct<name:string,outcome:string,detail:string>>>"


def json_of(text, schema: str) -> Column:
    """Damaged or null JSON is a struct of nulls or null."""
    return F.from_json(text, schema)


def lower_keys(tags: Column) -> Column:
    """Keys in lower case; of keys that are then equal the last one stays."""
    entries = F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))
    return bound(entries, lambda found: F.map_from_entries(last(found)))


def clock_seconds(text: Column) -> Column:
    """``HH:MM:SS.ff``; null unless minutes and seconds are below 60 and nothing is negative."""
    part = F.split(text, ":")
    h, m, s = (F.try_element_at(part, F.lit(k)).try_cast("double") for k in (1, 2, 3))
    return F.when((F.size(part) == 3) & (h >= 0) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60), h * 3600 + m * 60 + s)


def probed(text) -> Column:
    """Facts of a file from its probe JSON: the first real video stream counts; attached pictures are counted apart."""
    streams_of = lambda p: F.coalesce(p["streams"], F.array().cast(f"array<{STREAM}>"))
    of = lambda streams, kind: F.filter(streams, lambda s: s["codec_type"] == kind)
    parts = lambda p: F.struct(p["format"].alias("format"), *[of(streams_of(p), k).alias(k) for k in ("video", "audio", "subtitle")])
    return bound(bound(json_of(text, PROBE), parts), lambda x: bound(F.get(F.filter(x["video"], lambda s: ~_picture(s)), 0), lambda v: _facts(x, v)))


def _picture(stream: Column) -> Column:
    return F.coalesce(stream["disposition"]["attached_pic"] == "1", F.lit(False))


def _facts(x: Column, v: Column) -> Column:
    """Of a struct of a probe's format and its streams by type, and the video stream that counts."""
    language = lambda s: F.coalesce(F.nullif(F.trim(s["tags"]["language"]), F.lit("")), F.lit("und"))
    tag_clock = clock_seconds(F.try_element_at(lower_keys(v["tags"]), F.lit("duration")))
    duration = F.coalesce(x["format"]["duration"].try_cast("double"), v["duration"].try_cast("double"), v["duration_ts"].try_cast("double") * rational(v["time_base"]), tag_clock)
    usable = lambda r: (r["nominal"] > 0) & (r["average"] > 0) & (r["nominal"] <= 1000) & (r["average"] <= 1000)
    rates = F.struct(rational(v["r_frame_rate"]).alias("nominal"), rational(v["avg_frame_rate"]).alias("average"))
    variable = bound(rates, lambda r: F.when(usable(r), F.abs(r["nominal"] - r["average"]) / r["average"] > 0.001))
    vision = F.coalesce(F.exists(v["side_data_list"], lambda d: d["side_data_type"].contains("DOVI")), F.lit(False)) | F.coalesce(F.lower(v["codec_tag_string"]).rlike("^(dvh|dav)"), F.lit(False))
    return F.struct(
        x["format"]["format_name"].alias("container"),
        duration.alias("duration_seconds"),
        v["codec_name"].alias("video_codec"),
        v["width"].try_cast("int").alias("width"),
        v["height"].try_cast("int").alias("height"),
        v["nb_frames"].try_cast("int").alias("frame_count"),
        v["pix_fmt"].alias("pixel_format"),
        v["bits_per_raw_sample"].try_cast("int").alias("bits_per_raw_sample"),
        variable.alias("variable_frame_rate"),
        F.size(F.filter(x["video"], _picture)).alias("attached_picture_count"),
        F.transform(x["audio"], lambda s: s["codec_name"]).alias("audio_codecs"),
        F.transform(x["audio"], language).alias("audio_languages"),
        F.coalesce(F.array_max(F.transform(x["audio"], lambda s: s["channels"].try_cast("int"))), F.lit(0)).alias("max_audio_channels"),
        F.size(x["subtitle"]).alias("subtitle_track_count"),
        F.transform(x["subtitle"], language).alias("subtitle_languages"),
        (F.coalesce(F.lower(v["color_transfer"]).isin("smpte2084", "arib-std-b67"), F.lit(False)) | vision).alias("is_hdr"),
        vision.alias("is_dolby_vision"),
        lower_keys(F.coalesce(x["format"]["tags"], F.get(x["audio"], 0)["tags"])).alias("format_tags"),
    )


def pooled_scores(text) -> Column:
    """min, mean and harmonic_mean of the quality score; values that aren't finite are null."""
    vmaf = F.try_element_at(json_of(text, SCORES)["pooled_metrics"], F.lit("vmaf"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return F.struct(*[finite(vmaf[n]).alias(n) for n in ("min", "mean", "harmonic_mean")])


def frame_scores(text) -> Column:
    return F.filter(F.transform(json_of(text, SCORES)["frames"], lambda f: f["metrics"]["vmaf"]), lambda v: v.isNotNull() & ~F.isnan(v))


def failed_checks(report) -> Column:
    """Of a stored report; damaged JSON has none."""
    checks = F.coalesce(json_of(report, REPORT)["checks"], F.array().cast("array<struct<name:string,outcome:string,detail:string>>"))
    return F.filter(checks, lambda c: c["outcome"] == "Failed")


def import_folders(text) -> Column:
    """Distinct folders of a download queue in their order, a series before a film."""
    records = F.coalesce(json_of(text, FOLDERS)["records"], F.array().cast("array<struct<series:struct<path:string>,movie:struct<path:string>>>"))
    return F.array_distinct(F.filter(F.transform(records, lambda r: F.coalesce(r["series"]["path"], r["movie"]["path"])), lambda p: F.coalesce(F.trim(p) != "", F.lit(False))))


def playing_sessions(text) -> Column:
    """How many sessions of a JSON list play something."""
    return F.size(F.filter(F.from_json(text, "array<struct<NowPlayingItem:map<string,string>>>"), lambda s: s["NowPlayingItem"].isNotNull()))


def session_elements(xml) -> Column:
    """How many elements the root of an XML answer has; its size attribute where there are none."""
    n = F.xpath_int(xml, F.lit("count(/*/*)"))
    return F.when(n > 0, n).otherwise(F.xpath_string(xml, F.lit("/*/@size")).try_cast("int"))


def loudness(log) -> Column:
    number = lambda pattern: F.nullif(F.regexp_extract(log, pattern, 1), F.lit("")).try_cast("double")
    return F.struct(number(r"I:\s*(-?[0-9.]+) LUFS").alias("integrated"), number(r"Peak:\s*(-?[0-9.]+) dBFS").alias("true_peak"))


def last_similarity(log) -> Column:
    """The last ``All:x`` of a log."""
    found = F.regexp_extract_all(log, F.lit(r"All:([0-9.]+)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def decode_errors(log) -> Column:
    """Count and first of the lines that aren't blank, without the muxer's remark on equal stamps."""
    lines = F.filter(F.transform(F.split(F.coalesce(log, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).contains("non monotonically increasing dts"))
    return F.struct(F.size(lines).alias("errors"), F.get(lines, 0).alias("first"))


def progress_line(line) -> Column:
    """Elapsed seconds, frames per second and speed of a progress line."""
    part = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return F.struct(clock_seconds(part(r"time=\s*([0-9:.]+)")).alias("elapsed"), part(r"fps=\s*([0-9.]+)").try_cast("double").alias("fps"), part(r"speed=\s*([0-9.]+)x").try_cast("double").alias("speed"))


def cpu_sample(line) -> Column:
    """total and idle of a ``cpu`` line of counters; null with fewer than five of them."""
    n = F.transform(F.slice(F.split(F.trim(line), r"\s+"), 2, 8), lambda x: x.try_cast("long"))
    total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long")))
    idle = F.get(n, 3) + F.coalesce(F.get(n, 4), F.lit(0).cast("long"))
    return F.when(F.startswith(F.trim(line), F.lit("cpu ")) & (F.size(n) >= 5), F.struct(total.alias("total"), idle.alias("idle")))


def packets(lines: DataFrame, stream: str, number: str, line: str) -> DataFrame:
    """(stream, number, pts, dts) of ``pts,dts`` lines, for operators.sequences.regressions."""
    part = F.split(line, ",")
    value = lambda k: F.try_element_at(part, F.lit(k)).try_cast("double")
    return lines.select(stream, number, value(1).alias("pts"), value(2).alias("dts"))


def metadata_groups(listing) -> Column:
    """Whether an image's tag listing has colour profile and camera groups."""
    lines = F.split(F.coalesce(listing, F.lit("")), "\n")
    has = lambda *names: F.exists(lines, lambda x: F.lower(F.trim(x)).rlike("^\\[?(" + "|".join(names) + ")"))
    return F.struct(has("icc_profile").alias("has_icc"), has("exif", "ifd0", "exififd").alias("has_exif"))


# The encoders that are looked for, each with its codec and mode, and what a listing of accelerators starts with.
ENCODERS = [
    ("libx264", "h264", "CPU"), ("libx265", "hevc", "CPU"), ("libsvtav1", "av1", "CPU"), ("h264_nvenc", "h264", "NVIDIA NVENC"), ("hevc_nvenc", "hevc", "NVIDIA NVENC"), ("av1_nvenc", "av1", "NVIDIA NVENC"),
    ("h264_qsv", "h264", "Intel QSV"), ("hevc_qsv", "hevc", "Intel QSV"), ("av1_qsv", "av1", "Intel QSV"), ("h264_vaapi", "h264", "VAAPI"), ("hevc_vaapi", "hevc", "VAAPI"), ("av1_vaapi", "av1", "VAAPI"),
]
ACCELERATOR_HEADING = "hardware acceleration methods:"


def text_lines(text) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def second_words(text, least_first: int = 1) -> Column:
    """The second word of each line whose first word is long enough: the names in a listing of flags and names."""
    words = F.transform(text_lines(text), lambda x: F.split(x, r"\s+"))
    return F.transform(F.filter(words, lambda w: (F.size(w) >= 2) & (F.char_length(w[0]) >= least_first)), lambda w: w[1])


def accelerators(text) -> Column:
    """The lines after the heading."""
    at = lambda lines: F.array_position(F.transform(lines, F.lower), F.lit(ACCELERATOR_HEADING)).cast("int")
    later = lambda lines: F.slice(lines, at(lines) + 1, F.size(lines))
    return bound(text_lines(text), lambda lines: F.when(at(lines) > 0, F.filter(later(lines), lambda x: F.lower(x) != ACCELERATOR_HEADING)).otherwise(F.array().cast("array<string>")))


def has_filter(text, name: str) -> Column:
    return F.array_contains(second_words(text), name)


def capabilities(machines: DataFrame, listing: str, nvidia: str, render_device: str) -> DataFrame:
    """machines with a row for each known encoder: name, codec, mode, place, and whether it is listed and its hardware is there."""
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("codec"), F.lit(m).alias("mode"), F.lit(k).alias("place")) for k, (n, c, m) in enumerate(ENCODERS)])
    present = F.when(F.col("mode") == "NVIDIA NVENC", F.col(nvidia)).when(F.col("mode") == "CPU", F.lit(True)).otherwise(F.col(render_device))
    listed = machines.withColumn("__listed", second_words(F.col(listing), 6)).withColumn("__e", F.explode(known)).select("*", "__e.*").drop("__e")
    return listed.withColumn("available", F.coalesce(F.array_contains("__listed", F.col("name")) & present, F.lit(False))).drop("__listed")


def drm_client(text) -> Column:
    """struct<client_id, driver, engines: map<engine, nanoseconds>>; null without an id or a busy engine."""
    return bound(text_lines(text), lambda lines: bound(F.struct(_last_id(lines).alias("id"), _engines(lines).alias("engines")), lambda c: F.when(c["id"].isNotNull() & (F.size(c["engines"]) > 0), _client(lines, c))))


def _after(lines: Column, key: str) -> Column:
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(key))), lambda x: F.regexp_replace(F.substr(x, F.lit(len(key) + 1)), r"^\s+|\s+$", ""))


def _last_id(lines: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(_after(lines, "drm-client-id:"), lambda v: v.try_cast("long")), lambda v: v.isNotNull()), F.lit(-1))


def _engines(lines: Column) -> Column:
    """Those that were busy."""
    entry = lambda x: F.struct(F.regexp_extract(x, "^drm-engine-([^:]+):", 1).alias("key"), F.regexp_extract(x, r":\s*([0-9]+)(?:\s|$)", 1).try_cast("long").alias("value"))
    return F.filter(F.transform(F.filter(lines, lambda x: x.rlike("^drm-engine-[^:]+:")), entry), lambda e: e["value"] > 0)


def _client(lines: Column, c: Column) -> Column:
    unique = F.filter(c["engines"], lambda e, i: ~F.exists(F.slice(c["engines"], i + 2, F.size(c["engines"])), lambda later: later["key"] == e["key"]))
    return F.struct(c["id"].alias("client_id"), F.coalesce(F.try_element_at(_after(lines, "drm-driver:"), F.lit(-1)), F.lit("")).alias("driver"), F.map_from_entries(unique).alias("engines"))


def _percent(number: Column) -> Column:
    return F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), number)))


def utilisation_report(text) -> Column:
    """The first whole number that starts a line of a graphics card's report, within 0 to 100."""
    numbers = F.transform(text_lines(text), lambda x: F.split(F.rtrim(F.regexp_replace(x, r"%+$", "")), " ")[0].try_cast("int"))
    return _percent(F.try_element_at(F.filter(numbers, lambda n: n.isNotNull()), F.lit(1)))


def busy_percent(text) -> Column:
    """A file that holds one whole number, within 0 to 100."""
    return _percent(F.regexp_replace(text, r"^\s+|\s+$", "").try_cast("int"))


# Search answers of media servers. Numbers and flags are read as text, so one odd value doesn't void an answer.
ITEM = "struct<type:string,year:string,art:string,thumb:string>"
SEARCH = f"struct<MediaContainer:struct<Metadata:array<{ITEM}>,Hub:array<struct<Metadata:array<{ITEM}>>>>>"
ITEMS = "struct<Items:array<struct<Id:string,Type:string,ProductionYear:string,BackdropImageTags:array<string>,ImageTags:struct<Primary:string>>>>"
POSTERS = "array<struct<title:string,year:string,images:array<struct<coverType:string,remoteUrl:string>>>>"
SERVERS = "array<struct<name:string,provides:string,accessToken:string,clientIdentifier:string,connections:array<struct<uri:string,local:string,relay:string,protocol:string>>>>"
NAMED = "struct<MediaContainer:struct<friendlyName:string,version:string>,ServerName:string,Version:string>"


def _best(found: Column, year: Column) -> Column:
    """value of array<struct<value, fits, year>>: of the right kind and year, else of the right kind, else any; the first of each."""
    usable = F.filter(found, lambda x: x["value"] != "")
    first = lambda want: F.get(F.filter(usable, lambda x: F.coalesce(want(x), F.lit(False))), 0)["value"]
    return F.coalesce(first(lambda x: x["fits"] & (x["year"] == year)), first(lambda x: x["fits"]), first(lambda x: F.lit(True)))


def search_art(text, field: str, is_series: Column, year: Column) -> Column:
    """art or thumb of the best item, from a flat answer and from its groups."""
    box = F.from_json(text, SEARCH)["MediaContainer"]
    none = F.array().cast(f"array<{ITEM}>")
    grouped = F.flatten(F.transform(F.coalesce(box["Hub"], F.array().cast(f"array<struct<Metadata:array<{ITEM}>>>")), lambda h: F.coalesce(h["Metadata"], none)))
    items = F.concat(F.coalesce(box["Metadata"], none), grouped)
    fits = lambda x: F.when(is_series, x["type"].isin("show", "season", "episode")).otherwise(x["type"] == "movie")
    return _best(F.transform(items, lambda x: F.struct(x[field].alias("value"), F.coalesce(fits(x), F.lit(False)).alias("fits"), x["year"].try_cast("int").alias("year"))), year)


def item_image(text, backdrop: bool, is_series: Column, year: Column) -> Column:
    """The path of the best item's backdrop or primary image."""
    items = F.from_json(text, ITEMS)["Items"]
    tag = lambda x: F.get(x["BackdropImageTags"], 0) if backdrop else x["ImageTags"]["Primary"]
    path = lambda x: F.concat(F.lit("/Items/"), F.nullif(x["Id"], F.lit("")), F.lit("/Images/Backdrop/0?tag=" if backdrop else "/Images/Primary?tag="), F.nullif(tag(x), F.lit("")))
    fits = lambda x: x["Type"] == F.when(is_series, "Series").otherwise("Movie")
    return _best(F.transform(items, lambda x: F.struct(path(x).alias("value"), F.coalesce(fits(x), F.lit(False)).alias("fits"), x["ProductionYear"].try_cast("int").alias("year"))), year)


def remote_poster(text, title: Column, year: Column) -> Column:
    """The poster of the entry with this title, compared by letters and digits; one of the same year before others."""
    url = lambda x: F.get(F.filter(x["images"], lambda i: (i["coverType"] == "poster") & (i["remoteUrl"] != "")), 0)["remoteUrl"]
    named = F.filter(F.from_json(text, POSTERS), lambda x: alnum_key(x["title"]) == alnum_key(title))
    found = F.transform(named, lambda x: F.struct(url(x).alias("value"), F.lit(True).alias("fits"), x["year"].try_cast("int").alias("year")))
    return F.when(F.trim(title) != "", _best(found, year))


def servers(text) -> Column:
    """array<struct<name, access_token, client_id, uri>> of the resources that are servers, each with its best connection.

    Local and direct comes first, then direct, then an encrypted one; equals keep their order.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    yes = lambda c: F.coalesce(c == "true", F.lit(False)).cast("int")

    def best(resource: Column) -> Column:
        direct = lambda c: 1 - yes(c["relay"])
        ranked = F.transform(F.filter(resource["connections"], lambda c: blank(c["uri"]).isNotNull()), lambda c, i: F.struct((-yes(c["local"]) * direct(c)).alias("a"), (-direct(c)).alias("b"), (-yes(F.when(F.lower(F.coalesce(c["protocol"], F.lit("https"))) == "https", "true"))).alias("c"), i.alias("i"), c["uri"].alias("uri")))
        return F.array_min(ranked)["uri"]

    is_server = lambda r: F.exists(F.split(F.coalesce(r["provides"], F.lit("")), ","), lambda p: F.lower(F.trim(p)) == "server")
    made = F.transform(F.filter(F.from_json(text, SERVERS), is_server), lambda r: F.struct(F.coalesce(r["name"], F.lit("Plex Server")).alias("name"), r["accessToken"].alias("access_token"), r["clientIdentifier"].alias("client_id"), best(r).alias("uri")))
    return F.coalesce(F.filter(made, lambda r: r["uri"].isNotNull()), F.array().cast("array<struct<name:string,access_token:string,client_id:string,uri:string>>"))


def server_info(text) -> Column:
    """struct<name, version> of either kind of server; null without a name."""
    x = F.from_json(text, NAMED)
    box = x["MediaContainer"]
    return F.when(box["friendlyName"].isNotNull(), F.struct(box["friendlyName"].alias("name"), box["version"].alias("version"))).when(x["ServerName"].isNotNull(), F.struct(x["ServerName"].alias("name"), x["Version"].alias("version")))


def sign_in(text) -> Column:
    """What an answer to a sign-in holds: pin id, code, secret, token, and whether it is granted; blanks are null."""
    field = lambda name: F.get_json_object(text, f"$.{name}")  # noqa: E731  names differ in case alone
    filled = lambda *names: F.coalesce(*[F.nullif(field(n), F.lit("")) for n in names])
    return F.struct(field("id").try_cast("long").alias("pin_id"), filled("code", "Code").alias("code"), filled("Secret").alias("secret"), filled("authToken", "AccessToken").alias("token"), F.coalesce(field("Authenticated") == "true", F.lit(False)).alias("granted"))
