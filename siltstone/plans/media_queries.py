"""The inventory's own operators on media rows, which are made of the driver's tables by expressions that both engines read.

Each frame below is a select list over one table: Spark evaluates it with ``selectExpr``, and the same text is a common table
expression in the SQL. What is done with the frames is written twice, by the library's operators and by SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import languages
from siltstone.operators import filters, inventory, rules
from siltstone.plans.queries import query, read, stamp

LIBRARIES = [
    "n_nationkey AS id", "n_name AS name", "n_regionkey AS priority",
    "CASE n_nationkey % 7 WHEN 0 THEN 'ConservativeHevc' WHEN 1 THEN 'CompatibilityH264' WHEN 2 THEN 'ExperimentalAv1' WHEN 3 THEN 'SmallStereoHevc' WHEN 4 THEN 'RemuxCleanup' WHEN 5 THEN 'TrackCleanup' END AS rule_profile",
    "CASE n_nationkey % 9 WHEN 3 THEN 'av1' WHEN 4 THEN ' ' END AS target_video_codec", "CASE WHEN n_nationkey % 8 = 5 THEN 'mp4' END AS target_container",
    "CASE n_nationkey % 4 WHEN 1 THEN 'opus' WHEN 3 THEN 'mp3' END AS target_audio_codec", "CASE n_nationkey % 6 WHEN 2 THEN 'Exclude' WHEN 4 THEN '' END AS hdr",
    "CASE WHEN n_nationkey % 5 = 0 THEN CAST(2147483648 AS BIGINT) END AS min_file_size_bytes", "CASE WHEN n_nationkey % 7 = 1 THEN 96 END AS audio_bitrate_kbps",
    "CASE WHEN n_nationkey % 3 = 0 THEN 1080 END AS max_height", "CASE WHEN n_nationkey % 5 = 2 THEN CAST(4294967296 AS BIGINT) END AS reencode_same_codec_above_bytes",
    "n_nationkey % 4 = 2 AS optimise_dolby_vision", "n_nationkey % 2 = 0 AS reencode_lossy_audio", "n_nationkey % 3 = 1 AS reencode_lossy_images", "n_nationkey % 5 <> 4 AS skip_efficient_sources",
    "CASE n_nationkey % 4 WHEN 2 THEN 'webp' WHEN 3 THEN 'avif' END AS target_image_format", "CASE WHEN n_nationkey % 11 = 4 THEN TRUE END AS downmix_to_stereo",
    "split(CASE WHEN n_nationkey % 6 = 1 THEN 'promo/,BURNISHED' END, ',') AS exclude_segments",
    "split(CASE n_nationkey % 7 WHEN 4 THEN 'en,fil' WHEN 5 THEN CASE WHEN n_nationkey < 12 THEN 'ger' WHEN n_nationkey < 19 THEN 'fil,eng' END WHEN 6 THEN 'eng,afa' END, ',') AS keep_audio_languages",
    "split(CASE WHEN n_nationkey % 7 = 4 AND n_nationkey > 10 THEN 'eng' END, ',') AS keep_subtitle_languages",
]
FILES = [
    "p_partkey AS id", "CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(floor(p_partkey / 2) AS BIGINT) % 27 END AS library_id",
    "'/media/' || lower(replace(p_brand, '#', '/')) || '/' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)) || CASE WHEN p_partkey % 2 = 0 THEN '.mkv' ELSE '.avi' END AS path",
    "lower(split(p_type, ' ')[0 + {one}]) || '/' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)) || CASE WHEN p_partkey % 2 = 0 THEN '.mkv' ELSE '.avi' END AS relative_path",
    "CAST(p_partkey % 61 AS BIGINT) * CASE p_partkey % 5 WHEN 3 THEN 1048576 WHEN 4 THEN 102400 ELSE 104857600 END AS size_bytes", "CASE WHEN p_partkey % 17 = 0 THEN 'Discovered' WHEN p_partkey % 23 = 0 THEN 'ProbeFailed' ELSE 'Probed' END AS status",
    "CASE p_partkey % 5 WHEN 3 THEN 'Audio' WHEN 4 THEN 'Image' ELSE CASE WHEN p_partkey % 41 = 0 THEN 'Unknown' ELSE 'Video' END END AS media_kind",
    "CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN CASE p_size % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'mjpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'tiff' WHEN 4 THEN 'webp' WHEN 5 THEN 'bmp' END ELSE CASE p_size % 6 WHEN 0 THEN 'HEVC' WHEN 1 THEN 'av1' WHEN 5 THEN CASE WHEN p_size % 4 = 1 THEN '' ELSE 'vp9' END ELSE 'h264' END END AS video_codec",
    "CASE p_size % 8 WHEN 0 THEN 'flac' WHEN 1 THEN 'aac, ac3' WHEN 2 THEN 'mp3' WHEN 3 THEN ' opus ,aac' WHEN 4 THEN 'pcm_s16le' WHEN 5 THEN '' ELSE 'ac3' END AS audio_codecs",
    "CASE WHEN p_size % 9 = 8 THEN NULL ELSE 480 + p_size % 4 * 400 END AS height", "640 + p_size % 4 * 600 AS width", "CASE WHEN p_size % 10 = 7 THEN NULL ELSE CAST(600 + p_size * 97 AS DOUBLE) END AS duration_seconds",
    "CASE p_size % 3 WHEN 0 THEN 'matroska,webm' WHEN 1 THEN 'mov,mp4' ELSE 'avi' END AS container", "p_size % 11 = 3 AS is_hdr", "p_size % 13 = 5 AS is_dolby_vision",
    "CASE WHEN p_partkey % 29 = 0 AND p_partkey % 2 = 0 THEN 'v1' WHEN p_partkey % 3 = 0 THEN '' END AS optimised_marker",
    "CASE p_size % 5 WHEN 0 THEN 'rgba' WHEN 1 THEN 'rgb24' WHEN 2 THEN 'rgb48be' WHEN 3 THEN '' ELSE 'yuvj420p' END AS pixel_format", "CASE WHEN p_size % 6 = 0 THEN 8 END AS bits_per_raw_sample",
    "CASE p_size % 4 WHEN 0 THEN NULL WHEN 3 THEN 12 ELSE 1 END AS frame_count", "CASE WHEN p_size % 12 = 0 THEN 1 ELSE 0 END AS attached_picture_count", "CASE WHEN p_size % 14 = 0 THEN 1 ELSE 0 END AS subtitle_track_count",
    "CASE p_size % 4 WHEN 0 THEN 6 WHEN 1 THEN 8 ELSE 2 END AS max_audio_channels", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE 40 + p_size * 9 END AS source_audio_kbps",
    "split(CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'eng,fil,und' WHEN 2 THEN 'fre' WHEN 3 THEN 'deu,ENG' WHEN 4 THEN 'fil,afa,fra' ELSE 'eng' END, ',') AS audio_languages",
    "split(CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'eng,ger' WHEN 2 THEN 'haw' ELSE 'en' END, ',') AS subtitle_languages",
    "CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '1996-06-01 00:00:00' ELSE TIMESTAMP '1994-01-01 00:00:00' END AS modified_at",
]
JOBS = [
    "o_orderkey AS id", "o_custkey AS media_file_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'Preview' ELSE 'Normal' END AS type",
    "CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Failed' ELSE 'Completed' END WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Transcoding' ELSE 'Cancelled' END ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'Queued' ELSE 'Completed' END END AS status",
    "CASE WHEN o_orderstatus = 'F' OR o_orderkey % 4 = 0 THEN o_orderdate END AS finished_at", "o_orderdate - INTERVAL 3 DAY AS enqueued_at", "CAST(split(o_orderpriority, '-')[0 + {one}] AS INTEGER) AS priority",
]
EXCLUSIONS = ["'/media/' || lower(replace(p_brand, '#', '/')) || '/' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)) || '.mkv' AS path"]
EXCLUDED = "p_partkey % 19 = 0"
FOLDERS = [("/media/brand/11/", 2), ("\\media\\brand\\23", 1), ("/media/brand/1", 0), ("", 3), ("/media/brand/23/40", 0)]


def frame(spark: SparkSession, sf_dir: str, table: str, columns: list[str]) -> DataFrame:
    return read(spark, sf_dir, table).selectExpr(*[c.replace("{one}", "0") for c in columns])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "part", FILES)


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "nation", LIBRARIES)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "orders", JOBS)


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(EXCLUDED).selectExpr(*EXCLUSIONS)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.candidates(files(spark, sf_dir), libraries(spark, sf_dir), jobs(spark, sf_dir), exclusions(spark, sf_dir))


def _cte(name: str, table: str, columns: list[str], where: str = "") -> str:
    return f"{name} AS (SELECT {', '.join(c.replace('{one}', '1') for c in columns)} FROM {table}{' WHERE ' + where if where else ''})"


_PROFILE_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rules.PROFILES)
_PROFILE_COLUMNS = ", ".join(c.split()[0] for c in rules.RULES.split(", "))


def _size(x: str) -> str:
    number = lambda v: f"rtrim(rtrim(printf('%.1f', {v}), '0'), '.')"
    return f"CASE WHEN {x} >= 1073741824 THEN {number(f'{x} / 1073741824.0')} || ' GB' ELSE {number(f'{x} / 1048576.0')} || ' MB' END"


_KNOWN = "MAP {'en': 'eng', 'eng': 'eng', 'fil': 'fil', 'fre': 'fra', 'fra': 'fra', 'ger': 'deu', 'deu': 'deu', 'haw': 'haw'}"
_REMOVED = """CASE WHEN len(keep_{k}) > 0 AND NOT list_contains(list_transform(keep_{k}, lambda x: x IS NULL), TRUE) {guard}
  THEN list_filter(range(1, len({k}_languages) + 1), lambda i: {k}_known[i] IS NOT NULL AND NOT list_contains(keep_{k}, {k}_known[i])) ELSE [] END"""

CANDIDATES_SQL = f"""
WITH {_cte("lib", "nation", LIBRARIES)}, {_cte("f", "part", FILES)}, {_cte("jobs", "orders", JOBS)}, {_cte("excl", "part", EXCLUSIONS, EXCLUDED)},
prof({_PROFILE_COLUMNS}) AS (VALUES {_PROFILE_ROWS}),
lp AS (SELECT * FROM lib UNION ALL BY NAME SELECT -1 AS id),
r AS (SELECT l.id AS rule_id, p.profile, p.profile = 'TrackCleanup' AS narrow, l.exclude_segments,
    list_transform(coalesce(l.keep_audio_languages, []), lambda x: {_KNOWN}[lower(trim(x))]) AS keep_audio, list_transform(coalesce(l.keep_subtitle_languages, []), lambda x: {_KNOWN}[lower(trim(x))]) AS keep_subtitle,
    CASE WHEN narrow THEN p.target_video_codec ELSE coalesce(nullif(trim(l.target_video_codec), ''), p.target_video_codec) END AS tv,
    CASE WHEN narrow THEN p.target_container ELSE coalesce(nullif(trim(l.target_container), ''), p.target_container) END AS tc,
    CASE WHEN narrow THEN p.target_audio_codec ELSE coalesce(nullif(trim(l.target_audio_codec), ''), p.target_audio_codec) END AS ta,
    CASE WHEN narrow THEN p.hdr ELSE coalesce(nullif(trim(l.hdr), ''), p.hdr) END AS hdr_rule,
    CASE WHEN narrow THEN p.min_file_size_bytes ELSE coalesce(l.min_file_size_bytes, p.min_file_size_bytes) END AS least,
    CASE WHEN narrow THEN p.audio_bitrate_kbps ELSE coalesce(l.audio_bitrate_kbps, p.audio_bitrate_kbps) END AS kbps,
    CASE WHEN narrow THEN p.downmix_to_stereo ELSE coalesce(l.downmix_to_stereo, p.downmix_to_stereo) END AS downmix,
    CASE WHEN NOT narrow THEN l.max_height END AS max_h, CASE WHEN NOT narrow THEN l.reencode_same_codec_above_bytes END AS above,
    coalesce(NOT narrow AND l.optimise_dolby_vision, FALSE) AS dv_ok, coalesce(NOT narrow AND l.reencode_lossy_audio, FALSE) AS lossy_a, coalesce(NOT narrow AND l.reencode_lossy_images, FALSE) AS lossy_i,
    CASE WHEN narrow THEN 'jpeg' ELSE coalesce(nullif(trim(l.target_image_format), ''), 'jpeg') END AS ti, CASE WHEN coalesce(l.skip_efficient_sources, TRUE) THEN p.efficiency_floor END AS floor
  FROM lp l JOIN prof p ON p.profile = coalesce(l.rule_profile, 'ConservativeHevc')),
j AS (SELECT f.*, r.*, nullif(trim(split(f.audio_codecs, ',')[1]), '') AS ac, lower(f.video_codec) AS vc,
    list_transform(audio_languages, lambda x: {_KNOWN}[lower(trim(x))]) AS audio_known, list_transform(subtitle_languages, lambda x: {_KNOWN}[lower(trim(x))]) AS subtitle_known
  FROM f JOIN r ON r.rule_id = CASE WHEN f.library_id IN (SELECT id FROM lib) THEN f.library_id ELSE -1 END WHERE f.status = 'Probed'),
rm AS (SELECT *, coalesce({_REMOVED.format(k="audio", guard="AND list_has_any(audio_known, keep_audio)")}, []) AS a_out, coalesce({_REMOVED.format(k="subtitle", guard="")}, []) AS s_out,
    list_filter(exclude_segments, lambda s: contains(lower(relative_path), lower(s)))[1] AS segment, lower(ac) AS a, coalesce(trim(pixel_format), '') = '' AS no_pixels,
    CASE WHEN downmix THEN least(max_audio_channels, 2) ELSE max_audio_channels END AS out_ch, kbps * CASE WHEN downmix OR max_audio_channels <= 2 THEN 1 ELSE CAST(ceil(max_audio_channels / 2.0) AS INTEGER) END AS want,
    size_bytes * 8.0 / duration_seconds AS bps, len(keep_audio) > 0 AS ka, len(keep_subtitle) > 0 AS ks,
    'Remove ' || concat_ws(' + ', CASE WHEN len(a_out) > 0 THEN len(a_out) || ' audio track(s) (' || array_to_string(list_transform(a_out, lambda i: audio_languages[i]), ', ') || ')' END,
      CASE WHEN len(s_out) > 0 THEN len(s_out) || ' subtitle track(s) (' || array_to_string(list_transform(s_out, lambda i: subtitle_languages[i]), ', ') || ')' END) || ' not in the kept languages' AS removing FROM j),
d AS (SELECT *, CASE
    WHEN coalesce(trim(optimised_marker), '') <> '' THEN '-Already optimised (file is tagged)'
    WHEN profile = 'TrackCleanup' AND media_kind <> 'Video' THEN '-Track cleanup applies only to video files'
    WHEN media_kind = 'Audio' THEN CASE
      WHEN ac IS NULL THEN '-No audio stream detected' WHEN size_bytes < 4194304 THEN '-Below minimum size (4 MB)' WHEN a = ta THEN '-Already ' || ta || ' (no expected saving)'
      WHEN ta <> 'mp3' AND attached_picture_count > 0 THEN '-' || ta || ' cannot safely preserve embedded cover art with the shipped FFmpeg; choose MP3 for this library'
      WHEN ta <> 'aac' AND subtitle_track_count > 0 THEN '-' || ta || ' cannot preserve the embedded timed lyrics/subtitle stream'
      WHEN out_ch > CASE WHEN ta = 'mp3' THEN 2 ELSE 8 END THEN '-' || ta || ' cannot safely encode the ' || max_audio_channels || '-channel layout; enable stereo downmix or choose another codec'
      WHEN a = 'flac' OR starts_with(a, 'pcm_') THEN '+' || ac || ' → ' || ta
      WHEN NOT lossy_a THEN '-' || ac || ' is already a space-efficient (lossy) codec — left untouched'
      WHEN source_audio_kbps IS NULL THEN '-' || ac || ' source bitrate unknown — cannot confirm a saving, left untouched'
      WHEN source_audio_kbps < want * 1.25 THEN '-' || ac || ' at ' || source_audio_kbps || ' kbps is not far enough above the ' || want || ' kbps target to save space — left untouched'
      ELSE '+' || ac || ' ' || source_audio_kbps || ' kbps → ' || ta || ' ' || want || ' kbps' END
    WHEN media_kind = 'Image' THEN CASE
      WHEN coalesce(vc, '') = '' THEN '-No image data detected' WHEN vc IN ('gif', 'webp') AND frame_count IS NULL THEN '-Frame count could not be proven for an animated-capable image'
      WHEN frame_count > 1 THEN '-Animated image (' || frame_count || ' frames) — not optimised' WHEN size_bytes < 204800 THEN '-Below minimum size (0.2 MB)'
      WHEN ti = 'jpeg' AND vc = 'mjpeg' OR ti = 'webp' AND vc = 'webp' THEN '-Already ' || ti || ' (no expected saving)' WHEN vc = 'tiff' THEN '-TIFF multi-page status cannot be proven safely'
      WHEN vc NOT IN ('png', 'bmp', 'gif') AND NOT lossy_i THEN '-' || video_codec || ' is already a compressed (lossy) image — left untouched'
      WHEN ti = 'jpeg' AND (no_pixels OR starts_with(pixel_format, 'rgba')) THEN '-Target format cannot safely preserve the source alpha channel'
      WHEN ti IN ('jpeg', 'webp') AND (no_pixels OR contains(pixel_format, '48')) THEN '-Target format cannot safely preserve the source bit depth'
      WHEN vc IN ('png', 'bmp', 'gif') AND ti = 'jpeg' AND NOT lossy_i THEN '-' || video_codec || ' → jpeg is a lossy conversion; explicit opt-in required'
      ELSE '+' || video_codec || ' → ' || ti END
    WHEN coalesce(vc, '') = '' THEN '-No video stream detected (not probed, or audio-only)' WHEN segment IS NOT NULL THEN '-Path excluded by rule: "' || segment || '"'
    WHEN hdr_rule = 'Exclude' AND is_hdr THEN '-HDR / Dolby Vision excluded by this library''s rules'
    WHEN tv IS NOT NULL AND is_dolby_vision AND NOT dv_ok THEN '-Dolby Vision — re-encoding would drop the DV layer and risk a colour shift (Profile 5); left untouched'
    WHEN size_bytes < least THEN '-Below minimum size (' || {_size("least")} || ')' WHEN height > max_h THEN '-Resolution ' || height || 'p above limit (' || max_h || 'p)'
    WHEN tv IS NULL AND tc IS NULL THEN CASE WHEN NOT ka AND NOT ks THEN '-No kept audio or subtitle languages configured — nothing to remove' WHEN len(a_out) + len(s_out) > 0 THEN '+' || removing
      WHEN ka AND audio_languages IS NULL OR ks AND subtitle_languages IS NULL THEN '-Track languages not captured yet — re-probe the file to evaluate the kept-languages rule'
      ELSE '-No removable tracks (all tracks match the kept languages or are unknown)' END
    WHEN tv IS NULL THEN CASE WHEN NOT contains(container, CASE tc WHEN 'mkv' THEN 'matroska' ELSE tc END) THEN '+Remux to ' || tc || ' (' || container || ' → ' || tc || ')' WHEN len(a_out) + len(s_out) > 0 THEN '+' || removing
      ELSE '-Already in the target container (' || tc || ')' END
    WHEN vc = tv AND size_bytes >= above THEN '+Already ' || tv || ' but ' || {_size("size_bytes")} || ' ≥ ' || {_size("above")} || ' — re-encoding to shrink' WHEN vc = tv THEN '-Already ' || tv || ' (no expected saving)'
    WHEN bps / width / height < floor THEN '-Already efficiently encoded (~' || printf('%.1f', bps / 1000000) || ' Mbps at ' || height || 'p) — re-encoding is unlikely to save space'
    ELSE '+' || video_codec || ' → ' || tv END AS verdict FROM rm),
h AS (SELECT media_file_id, max(finished_at) FILTER (status = 'Completed') AS completed_at, max(finished_at) FILTER (status = 'Failed') AS failed_at FROM jobs WHERE type = 'Normal' AND finished_at IS NOT NULL GROUP BY 1),
o AS (SELECT d.*, CASE WHEN d.path IN (SELECT path FROM excl) THEN '-Excluded — won''t be optimised' WHEN verdict LIKE '-%' THEN verdict
    WHEN coalesce(d.optimised_marker, '') = '' AND EXISTS (SELECT 1 FROM j s WHERE s.optimised_marker <> '' AND s.library_id IS NOT DISTINCT FROM d.library_id AND left(s.relative_path, len(s.relative_path) - 4) = left(d.relative_path, len(d.relative_path) - 4))
      THEN '-An optimised copy already exists alongside this file'
    {{history}} ELSE verdict END AS final FROM d LEFT JOIN h ON h.media_file_id = d.id),
c AS (SELECT id AS media_file_id, library_id, path, relative_path, size_bytes, video_codec, height, is_hdr, media_kind, CASE WHEN media_kind = 'Audio' THEN ac ELSE video_codec END AS codec, profile, final LIKE '+%' AS eligible, final[2:] AS reason FROM o)
"""
_HISTORY = "WHEN completed_at >= d.modified_at THEN '-Already optimised' WHEN failed_at >= d.modified_at THEN '-Previously failed — retry from the Queue page'"
WITH_CANDIDATES = CANDIDATES_SQL.replace("{history}", _HISTORY)


@query(WITH_CANDIDATES + "SELECT * REPLACE (coalesce(library_id, -1) AS library_id, coalesce(height, -1) AS height) FROM c")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every probed file's decision: rules of its library, siblings, history and exclusions."""
    return decided(spark, sf_dir).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("library_id", "height")})


@query(CANDIDATES_SQL.replace("{history}", "") + "SELECT media_file_id, eligible, reason FROM c")
def recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision just before the work, without history."""
    return inventory.candidates(files(spark, sf_dir), libraries(spark, sf_dir), None, exclusions(spark, sf_dir)).select("media_file_id", "eligible", "reason")


@query(WITH_CANDIDATES + "SELECT library_id, count(*) FILTER (eligible) AS eligible, count(*) FILTER (NOT eligible) AS skipped FROM c WHERE library_id IS NOT NULL GROUP BY library_id")
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.summary(decided(spark, sf_dir))


_LISTED = WITH_CANDIDATES + ", l AS (SELECT f.id, f.relative_path, c.eligible, c.reason FROM f LEFT JOIN c ON f.id = c.media_file_id WHERE f.path ILIKE '%brand/1_/%') "


@query(
    _LISTED
    + """SELECT 'second' AS list, * FROM (SELECT id, relative_path, eligible, reason FROM l WHERE NOT eligible ORDER BY relative_path, id LIMIT 20 OFFSET 20)
UNION ALL SELECT 'beyond', * FROM (SELECT id, relative_path, eligible, reason FROM l WHERE eligible ORDER BY relative_path, id LIMIT 20 OFFSET 1000000)
UNION ALL SELECT 'below', * FROM (SELECT id, relative_path, eligible, reason FROM l WHERE eligible ORDER BY relative_path, id LIMIT 5)
UNION ALL SELECT 'whole', id, relative_path, eligible, reason FROM l WHERE eligible IS NULL"""
)
def inventory_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the inventory: the second, one beyond the end, one below the first, and a whole list."""
    everything, verdicts = files(spark, sf_dir), decided(spark, sf_dir)
    asked = {"second": ("skipped", 2, 20), "beyond": ("eligible", 50_001, 20), "below": ("eligible", 0, 5), "whole": ("unprobed", 1, 0)}
    pages = [inventory.listing(everything, verdicts, " brand/1_/ ", *a)[0].select(F.lit(name).alias("list"), "id", "relative_path", "eligible", "reason") for name, a in asked.items()]
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out


@query(_LISTED + "SELECT count(*) AS n_all, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (NOT eligible) AS n_skipped, count(*) FILTER (eligible IS NULL) AS n_unprobed FROM l")
def inventory_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.listing(files(spark, sf_dir), decided(spark, sf_dir), "brand/1_/")[1]


_QUEUED = (
    WITH_CANDIDATES
    + """, i(folder, place) AS (VALUES ('/media/brand/11', 2), ('/media/brand/23', 1), ('/media/brand/1', 0), ('/media/brand/23/40', 0)),
q AS (SELECT c.*, EXISTS (SELECT 1 FROM jobs WHERE jobs.media_file_id = c.media_file_id AND jobs.type = 'Normal' AND jobs.status IN ('Queued', 'Probing', 'Transcoding', 'Verifying', 'ReadyToReplace')) AS active,
  EXISTS (SELECT 1 FROM i WHERE c.path = folder OR starts_with(c.path, folder || '/')) AS importing FROM c) """
)


@query(_QUEUED + "SELECT media_file_id, coalesce(library_id, -1) AS library_id, 'Queued' AS status, 'Normal' AS type, coalesce(lib.priority, 0) AS priority, reason[:512] AS enqueue_reason, '1998-12-01 00:00:00' AS enqueued_at FROM q LEFT JOIN lib ON lib.id = q.library_id WHERE eligible AND NOT active AND NOT importing")
def enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New jobs for what is eligible, not worked on and not being imported."""
    made, _ = inventory.enqueue(decided(spark, sf_dir), jobs(spark, sf_dir), libraries(spark, sf_dir), spark.createDataFrame(FOLDERS, "folder string, place int"), F.lit("1998-12-01").cast("timestamp_ntz"))
    return made.withColumn("enqueued_at", stamp("enqueued_at")).withColumn("library_id", F.coalesce("library_id", F.lit(-1)))


@query(_QUEUED + "SELECT count(*) FILTER (eligible AND NOT active AND NOT importing) AS enqueued, count(*) FILTER (eligible AND active) AS active, count(*) FILTER (NOT eligible) AS ineligible, count(*) FILTER (eligible AND NOT active AND importing) AS importing FROM q")
def enqueue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = spark.createDataFrame(FOLDERS, "folder string, place int")
    return inventory.enqueue(decided(spark, sf_dir), jobs(spark, sf_dir), libraries(spark, sf_dir), folders, F.current_timestamp())[1]


@query(f"""
WITH {_cte("f", "part", FILES)},
n AS (SELECT path, CASE WHEN id % 13 = 0 THEN 'moved/' || relative_path ELSE relative_path END AS relative_path, CASE WHEN id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN id % 11 = 0 THEN modified_at + INTERVAL 1 DAY ELSE modified_at END AS modified_at, id % 7 = 0 OR id % 11 = 0 AS changed FROM f WHERE id % 5 <> 0
  UNION ALL SELECT path || '.new', relative_path, size_bytes, modified_at, TRUE FROM f WHERE id % 5 = 0)
SELECT n.path, n.relative_path, n.size_bytes, strftime(n.modified_at, '%Y-%m-%d %H:%M:%S') AS modified_at, CASE WHEN changed THEN 'Discovered' ELSE f.status END AS status, CASE WHEN changed THEN 'Unknown' ELSE f.media_kind END AS media_kind,
  CASE WHEN NOT changed THEN f.video_codec END AS video_codec, CASE WHEN changed THEN 0 ELSE f.max_audio_channels END AS max_audio_channels, CASE WHEN changed THEN FALSE ELSE f.is_hdr END AS is_hdr, CASE WHEN NOT changed THEN f.optimised_marker END AS optimised_marker,
  CASE WHEN f.id IS NULL THEN 'added' WHEN changed OR f.id % 13 = 0 THEN 'updated' ELSE 'unchanged' END AS action
FROM n LEFT JOIN f ON n.path = f.path
""")
def rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory after a scan: changed content is to be probed anew, a move keeps what is known."""
    f, k = files(spark, sf_dir), F.col("id")
    moved = F.when(k % 13 == 0, F.concat(F.lit("moved/"), "relative_path")).otherwise(F.col("relative_path"))
    kept = f.where(k % 5 != 0).select(
        "path", moved.alias("relative_path"), F.when(k % 7 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(k % 11 == 0, F.col("modified_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("modified_at")).alias("modified_at"),
    )
    new = f.where(k % 5 == 0).select(F.concat("path", F.lit(".new")).alias("path"), "relative_path", "size_bytes", "modified_at")
    facts = ["status", "media_kind", "video_codec", "max_audio_channels", "is_hdr", "optimised_marker"]
    return inventory.rescanned(f, kept.unionByName(new), facts).withColumn("modified_at", stamp("modified_at"))


@query(f"""
WITH {_cte("jobs", "orders", JOBS)}, w AS (SELECT *, coalesce(finished_at, enqueued_at) AS ended FROM jobs WHERE type = 'Normal' AND coalesce(finished_at, enqueued_at) >= TIMESTAMP '1995-01-01' AND coalesce(finished_at, enqueued_at) <= TIMESTAMP '1996-12-31')
SELECT id, priority, strftime(enqueued_at, '%Y-%m-%d %H:%M:%S') AS enqueued_at, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended, (SELECT count(*) FROM w) AS total FROM (SELECT * FROM w ORDER BY priority DESC, enqueued_at, id LIMIT 50 OFFSET 100)
""")
def job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of jobs in a range of when they ended, or else were queued: the most urgent first, then the oldest."""
    ended = F.coalesce("finished_at", "enqueued_at")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    wanted = filters.conjunction([filters.member("type", "normal", ("Normal", "Preview", "Calibration")), filters.time_range(ended, day("1995-01-01"), day("1996-12-31"))])
    rows = jobs(spark, sf_dir).where(wanted)
    shown = filters.page(rows, [F.col("priority").desc(), F.col("enqueued_at"), F.col("id")], 3, 50)
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    return shown.select("id", "priority", stamp("enqueued_at").alias("enqueued_at"), stamp(ended).alias("ended")).crossJoin(total)


@query(f"""
WITH {_cte("f", "part", FILES)}, k AS (SELECT id, audio_languages AS l, list_transform(audio_languages, lambda x: {_KNOWN}[lower(trim(x))]) AS known FROM f)
SELECT id, array_to_string(known, ',') AS known, CASE WHEN l IS NOT NULL THEN CASE WHEN list_has_any(known, ['fil', 'deu']) THEN array_to_string(list_filter(range(len(l)), lambda i: known[i + 1] NOT IN ('fil', 'deu')), ',') ELSE '' END END AS removed FROM k
""")
def language_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical languages of tracks, and which tracks go where German and Filipino are kept."""
    tracks = F.col("audio_languages")
    removed = languages.track_removals(tracks, ["ger", "fil"])
    known = F.filter(F.transform(tracks, languages.canonical), lambda x: x.isNotNull())
    return files(spark, sf_dir).select("id", F.array_join(known, ",").alias("known"), F.array_join(removed, ",").alias("removed"))
