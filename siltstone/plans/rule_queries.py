"""Small rules, decisions and server answers on values made of the driver's columns, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import media, parsers
from siltstone.functions import scalars as S
from siltstone.operators import decisions, merge
from siltstone.plans.queries import query, read, spread


@query("""
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'Image' WHEN p_size % 4 <> 0 THEN 'Video' WHEN p_size % 3 <> 0 THEN 'Audio' ELSE 'Unknown' END AS kind,
  CASE p_size % 6 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 3 THEN 16 WHEN 4 THEN 14 ELSE -1 END AS depth, CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE -1 END AS chroma,
  CASE p_size % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/bmp' ELSE 'application/octet-stream' END AS content,
  CASE WHEN p_partkey % 9000 >= 3600 THEN CAST(CAST(floor(p_partkey % 9000 / 3600) AS INTEGER) AS VARCHAR) || 'h ' || CAST(CAST(floor(p_partkey % 9000 / 60) AS INTEGER) % 60 AS VARCHAR) || 'm' ELSE CAST(CAST(floor(p_partkey % 9000 / 60) AS INTEGER) AS VARCHAR) || 'm' END AS lasts,
  CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE (p_size - p_size % 7) * 100.0 / (p_size % 7) END AS change, coalesce(CASE p_size % 4 WHEN 1 THEN 25.0 WHEN 2 THEN p_size / 8.0 WHEN 3 THEN CAST(p_size AS DOUBLE) END, -1) AS rate,
  coalesce(CASE WHEN p_size % 3 <> 0 THEN greatest(CAST(40 - p_size AS DOUBLE), 0) / 2 END, -1) AS remaining, p_size % 5 <> 4 AS picture_subtitle, p_size % 3 = 0 AS kept_out, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'none' END AS filled FROM part
""")
def media_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, pixel formats, signatures, durations, changes, rates, codecs and blanks."""
    k = F.col("p_size")
    pixels = F.when(k % 6 == 0, "yuv420p10le").when(k % 6 == 1, "YUV422P").when(k % 6 == 2, "gbrp12be").when(k % 6 == 3, "rgb48le").when(k % 6 == 4, "p010").otherwise(" ")
    found = media.pixel_format(pixels, F.when(k % 6 == 4, 14))
    raw = F.unhex(F.when(k % 5 == 0, "FFD8FFE0").when(k % 5 == 1, "89504E470D").when(k % 5 == 2, "47494638").when(k % 5 == 3, "424D00").otherwise("00"))
    fraction = F.when(k % 4 == 0, "1/0").when(k % 4 == 1, "25").when(k % 4 == 2, F.concat(k.cast("string"), F.lit("/8"))).otherwise(F.concat(k.cast("string"), F.lit("/1")))
    subtitle = F.when(k % 5 == 0, "PGSSUB").when(k % 5 == 1, " dvd_subtitle").when(k % 5 == 2, "xsub").when(k % 5 == 3, "dvbsub").otherwise("subrip")
    return read(spark, sf_dir, "part").select(
        "p_partkey", media.media_kind(F.when(k % 6 == 0, "JPEG").otherwise(".mkv"), k % 4 != 0, k % 3 != 0).alias("kind"), F.coalesce(found["depth"], F.lit(-1)).alias("depth"), F.coalesce(found["chroma"], F.lit(-1)).alias("chroma"),
        media.content_type(raw).alias("content"), S.duration_text(F.col("p_partkey") % 9000).alias("lasts"), S.percent_change(k % 7, k).alias("change"), F.coalesce(S.rational(fraction), F.lit(-1.0)).alias("rate"),
        F.coalesce(S.remaining_seconds(F.lit(40), k, F.when(k % 3 != 0, 2.0).otherwise(0.0)), F.lit(-1.0)).alias("remaining"), media.picture_subtitle(subtitle).alias("picture_subtitle"),
        media.kept_out_of_mp4(F.when(k % 3 == 0, "aac, TrueHD").otherwise("aac,ac3")).alias("kept_out"), F.coalesce(S.blank_to_null(F.when(k % 2 == 0, F.col("p_brand")).otherwise("  ")), F.lit("none")).alias("filled"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Path does not exist' WHEN o_orderkey % 3 = 0 THEN 'Not readable' WHEN o_orderkey % 2 = 0 THEN 'Readable but not writable' ELSE 'Readable and writable' END AS access,
  CASE WHEN o_custkey % 2 = 0 THEN CASE o_custkey % 5 WHEN 0 THEN 'Cuda' ELSE 'None' END ELSE 'None' END AS acceleration, o_orderkey % 4 <> 0 AND (o_orderkey % 4 = 1 OR o_custkey % 3 <> 0) AS calibratable,
  o_orderkey % 6 = 1 AS software_helps, o_orderkey % 6 = 2 AS explained, o_orderkey % 7 >= 3 AS excluded, strftime(o_orderdate, '%Y%m%dT%H%M%S') || '000' AS stamp, CAST(round_even(CAST((1 - (o_orderkey % 8 + 1) / 16.0) * 100 AS DOUBLE), 1) AS DOUBLE) AS saving
FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'
""")
def small_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access, acceleration, calibration, decoder logs, streaks, stamps and rates, of rows that have lapsed."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    encoder = F.when(c % 5 == 0, "hevc_nvenc").otherwise("libx265")
    log = F.when(k % 6 == 1, "[h264] Failed setup for FORMAT cuda").when(k % 6 == 2, "Subtitle encoding currently only possible from text to text or bitmap to bitmap").otherwise("fine")
    rows = decisions.lapsed(read(spark, sf_dir, "orders"), "o_orderdate", F.lit("1996-06-30").cast("timestamp_ntz"))
    return rows.select(
        "o_orderkey", decisions.access_message(k % 5 != 0, k % 3 != 0, k % 2 != 0).alias("access"), decisions.quality_acceleration(encoder, c % 2 == 0).alias("acceleration"),
        decisions.calibratable(k % 4 != 1, k % 4 == 0, F.lit("Preserve"), c % 3 != 0).alias("calibratable"), decisions.software_decode_helps(log).alias("software_helps"), decisions.explained(log).isNotNull().alias("explained"),
        decisions.streak_excludes(k % 7, F.lit(3)).alias("excluded"), media.utc_stamp(F.col("o_orderdate")).alias("stamp"), media.rate_saving(F.lit(16.0), F.lit(2.0), (k % 8 + 1).cast("double"), F.lit(2.0)).alias("saving"),
    )


@query("""
WITH c AS (SELECT s_nationkey AS machine, s_suppkey AS place, CASE s_suppkey % 3 WHEN 0 THEN 'hevc' WHEN 1 THEN 'h264' ELSE 'av1' END AS codec, s_suppkey % 4 AS rank, s_suppkey % 5 <> 0 AS available FROM supplier),
w AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'hevc' WHEN 1 THEN 'h264' WHEN 2 THEN 'av1' ELSE 'mpeg2' END AS codec, CASE WHEN n_nationkey % 3 = 0 THEN 3 END AS one_mode, CASE WHEN n_nationkey % 5 = 0 THEN 10 WHEN n_nationkey % 5 = 1 THEN 12 ELSE 8 END AS depth FROM nation),
b AS (SELECT id, min_by('enc' || place, (rank, place)) FILTER (available AND c.codec IS NOT NULL AND NOT (w.codec = 'h264' AND depth > 8 AND (depth > 10 OR FALSE)) AND CASE WHEN w.codec = 'h264' AND depth > 8 THEN rank = 3 WHEN one_mode IS NOT NULL THEN rank = one_mode ELSE TRUE END) AS encoder FROM w LEFT JOIN c ON w.codec = c.codec GROUP BY id)
SELECT w.id, coalesce(encoder, '') AS encoder, CASE WHEN encoder IS NOT NULL THEN '' WHEN w.codec = 'mpeg2' THEN 'unknown codec' WHEN w.codec = 'h264' AND depth > 10 THEN 'bit depth not supported' ELSE 'no available encoder' END AS failure FROM w JOIN b ON w.id = b.id
""")
def encoder_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first available encoder in order of preference, within what a codec's bit depth allows."""
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    mode = F.when(s % 4 == 0, "NVIDIA NVENC").when(s % 4 == 1, "Intel QSV").when(s % 4 == 2, "VAAPI").otherwise("CPU")
    codec = F.when(s % 3 == 0, "hevc").when(s % 3 == 1, "h264").otherwise("av1")
    able = read(spark, sf_dir, "supplier").select(F.concat(F.lit("enc"), s.cast("string")).alias("name"), codec.alias("codec"), mode.alias("mode"), (s % 5 != 0).alias("available"), s.alias("place"))
    asked = read(spark, sf_dir, "nation").select(
        k.alias("id"), F.when(k % 4 == 0, "X265").when(k % 4 == 1, " avc").when(k % 4 == 2, "av1").otherwise("mpeg2").alias("codec"), F.when(k % 3 == 0, "cpu").otherwise("auto").alias("mode"), F.when(k % 5 == 0, 10).when(k % 5 == 1, 12).otherwise(8).alias("bit_depth")
    )
    found = decisions.chosen_encoders(asked, able)
    return found.select("id", F.coalesce("encoder", F.lit("")).alias("encoder"), F.coalesce("failure", F.lit("")).alias("failure"))


@query("""
SELECT user_id AS session, min_by(setting, rank) AS setting FROM (SELECT user_id, event_type AS setting, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS rank, max(value) AS v FROM events GROUP BY ALL) WHERE CAST(floor(v * 10) AS BIGINT) % 3 < 2 GROUP BY 1
""")
def calibration_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session the most efficient setting that was rated as good."""
    kind = F.col("event_type")
    seen = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session"), kind.alias("setting")).agg(F.max("value").alias("v"))
    rank = F.when(F.col("setting") == "click", 1).when(F.col("setting") == "error", 2).when(F.col("setting") == "purchase", 3).when(F.col("setting") == "signup", 4).otherwise(5)
    third = F.floor(F.col("v") * 10) % 3
    rating = F.when(third == 0, "Indistinguishable").when(third == 1, "Acceptable").otherwise("Worse")
    return decisions.recommended(seen.select("session", "setting", rank.alias("rank")), seen.select("session", "setting", rating.alias("rating")))


@query("""
SELECT 'parents' AS side, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'children', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of orders and their lines when some orders go."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    gone = o.where("o_orderstatus = 'P'").select("o_orderkey")
    parents, children = merge.delete_cascade(o.select("o_orderkey"), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", gone)
    count = lambda rows, side: rows.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(side).alias("side"), "n", "keys")
    return count(parents, "parents").unionByName(count(children, "children"))


@query("""
SELECT '{' || string_agg('"' || r_name || '":"' || CAST(r_regionkey AS VARCHAR) || '"', ',' ORDER BY r_name) || '}' AS json FROM region WHERE r_name IN ('AFRICA', 'AMERICA')
""")
def config_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that may leave the installation, as one document."""
    return decisions.exported(read(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value")), ["AMERICA", "AFRICA", "ATLANTIS"])


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'a' WHEN 2 THEN 'c' ELSE '' END AS art, CASE s_suppkey % 3 WHEN 0 THEN '/Items/2/Images/Primary?tag=p2' WHEN 1 THEN '/Items/1/Images/Primary?tag=p1' ELSE '' END AS image,
  CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN 'u2' ELSE 'u1' END AS poster, CASE s_suppkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'direct' WHEN 2 THEN 'relay' ELSE '' END AS uri, CASE s_suppkey % 3 WHEN 0 THEN 'Home 1.2' WHEN 1 THEN 'Den 3' ELSE '' END AS server,
  CASE s_suppkey % 3 WHEN 0 THEN 't1 true' WHEN 1 THEN 't2 false' ELSE ' false' END AS sign_in FROM supplier
""")
def server_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artwork by kind and year, a server's best connection, names, and sign-ins, from media servers' JSON."""
    k = F.col("s_suppkey")
    item = lambda kind, year, art: f'{{"type":"{kind}","year":{year},"art":"{art}"}}'
    flat, grouped = item("movie", 1999, "a"), item("movie", "\"2001\"", "b")
    search = F.when(k % 4 == 0, f'{{"MediaContainer":{{"Metadata":[{flat}],"Hub":[{{"Metadata":[{grouped}]}}]}}}}').when(k % 4 == 1, f'{{"MediaContainer":{{"Hub":[{{}},{{"Metadata":[{flat}]}}]}}}}').when(
        k % 4 == 2, f'{{"MediaContainer":{{"Metadata":[{item("show", 2001, "c")}]}}}}'
    ).otherwise("{broken")
    entry = lambda n, kind, year: f'{{"Id":"{n}","Type":"{kind}","ProductionYear":{year},"ImageTags":{{"Primary":"p{n}"}}}}'
    items = F.when(k % 3 == 0, f'{{"Items":[{entry(1, "Movie", 2001)},{entry(2, "Series", 2001)}]}}').when(k % 3 == 1, f'{{"Items":[{entry(1, "Series", 1990)},{{"Id":"9","Type":"Series","ProductionYear":2001}}]}}').otherwise('{"Items":[]}')
    poster = lambda title, year, url: f'{{"title":"{title}","year":{year},"images":[{{"coverType":"fanart","remoteUrl":"x"}},{{"coverType":"poster","remoteUrl":"{url}"}}]}}'
    posters = F.when(k % 5 == 0, "[" + poster("Another", 2001, "u0") + "]").when(k % 2 == 0, "[" + poster("The Film!", 1990, "u1") + "," + poster("the film", 2001, "u2") + "]").otherwise("[" + poster("THE-FILM", 1990, "u1") + "]")
    link = lambda uri, local, relay: f'{{"uri":"{uri}","local":{local},"relay":{relay},"protocol":"https"}}'
    relay, direct, local = link("relay", "true", "true"), link("direct", "false", "false"), link("local", "true", "false")
    resource = lambda provides, *links: f'[{{"name":"x","provides":"{provides}","connections":[{",".join(links)}]}}]'
    resources = F.when(k % 4 == 0, resource("player, Server", relay, direct, local)).when(k % 4 == 1, resource("server", relay, direct)).when(k % 4 == 2, resource("server", relay)).otherwise(resource("player", local))
    info = F.when(k % 3 == 0, '{"MediaContainer":{"friendlyName":"Home","version":"1.2"}}').when(k % 3 == 1, '{"ServerName":"Den","Version":"3"}').otherwise("{}")
    signed = F.when(k % 3 == 0, '{"id":5,"authToken":"t1","Authenticated":true}').when(k % 3 == 1, '{"AccessToken":"t2"}').otherwise('{"authToken":""}')
    year, blank = F.lit(2001), lambda c: F.coalesce(c, F.lit(""))
    named, given = parsers.server_info(info), parsers.sign_in(signed)
    return spread(spark, sf_dir, "supplier").select(
        "s_suppkey", blank(parsers.search_art(search, "art", F.lit(False), year)).alias("art"), blank(parsers.item_image(items, False, F.lit(True), year)).alias("image"), blank(parsers.remote_poster(posters, F.lit("The Film"), year)).alias("poster"),
        blank(F.get(parsers.servers(resources), 0)["uri"]).alias("uri"), blank(F.concat_ws(" ", named["name"], named["version"])).alias("server"), F.concat(blank(given["token"]), F.lit(" "), given["granted"].cast("string")).alias("sign_in"),
    )


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_custkey % 50 END AS client, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'i915' ELSE '' END AS driver, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_custkey * 10 END AS render,
  CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE least(CAST(c_custkey % 130 AS INTEGER), 100) END AS utilisation, CASE WHEN c_custkey % 6 = 0 THEN -1 ELSE CAST(c_custkey % 101 AS INTEGER) END AS busy FROM customer
""")
def device_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graphics client's engines, a card's utilisation report, and a busy file."""
    k = F.col("c_custkey")
    text = k.cast("string")
    client = F.concat(F.when(k % 3 == 0, "drm-driver: i915\n").otherwise("pos: 0\n"), F.when(k % 4 == 0, "drm-client-id: none\n").otherwise(F.concat(F.lit("drm-client-id: "), (k % 50).cast("string"), F.lit("\n"))), F.lit("drm-engine-render: "), (k * 10).cast("string"), F.lit(" ns\ndrm-engine-copy: 0 ns\ndrm-engine-capacity-x: many\n"))
    report = F.when(k % 5 == 0, "utilization.gpu [%]\nN/A").otherwise(F.concat(F.lit("utilization.gpu [%]\n"), (k % 130).cast("string"), F.lit(" %")))
    busy = F.when(k % 6 == 0, F.concat(text, F.lit(" x"))).otherwise(F.concat(F.lit(" "), (k % 101).cast("string"), F.lit("\n")))
    found = spread(spark, sf_dir, "customer").select("c_custkey", parsers.drm_client(client).alias("d"), parsers.utilisation_report(report).alias("u"), parsers.busy_percent(busy).alias("b"))
    known = lambda c, other=-1: F.coalesce(c, F.lit(other))
    return found.select("c_custkey", known(F.col("d.client_id")).alias("client"), known(F.col("d.driver"), "").alias("driver"), known(F.try_element_at("d.engines", F.lit("render"))).alias("render"), known(F.col("u")).alias("utilisation"), known(F.col("b")).alias("busy"))
