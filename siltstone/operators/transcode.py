"""What a transcode makes of a file, resolved from its library's rules and the facts of the file: the data decision alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import languages
from siltstone.operators import decisions

# What encodes a target, and what pictures lose nothing in their format.
AUDIO_ENCODERS = {"opus": "libopus", "aac": "aac", "mp3": "libmp3lame"}
IMAGE_ENCODERS = {"jpeg": "mjpeg", "webp": "libwebp"}
LOSSLESS_IMAGES = ("png", "bmp", "tiff", "gif")


def _of(table: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(name))


def transcode_spec(kind: Column, relative_path: Column, rules: Column, facts: Column, work_root: str, keep_audio: Sequence[str] = (), keep_subtitles: Sequence[str] = ()) -> Column:
    """struct of container, output_path, tonemap, video_codec, image_encoder, image_quality, image_lossless, audio_encoder,
    audio_kbps, downmix, variable_frame_rate, removed_audio, removed_subtitles; null for what does not apply.

    rules: those of ``decisions.output_spec``, and image_quality, audio_kbps, video_audio_kbps, downmix. facts:
    picture_subtitles, audio_not_for_mp4, is_hdr, image_codec, channels, variable_frame_rate, audio_languages,
    subtitle_languages. Sound of films is copied unless the rules name a codec; copied sound has no rate and is not mixed
    down. Tracks in languages that are not kept go, audio only if one in a kept language stays; no list keeps all, and an
    empty selection is null.
    """
    image, audio = (F.coalesce(kind == k, F.lit(False)) for k in ("Image", "Audio"))
    video, none = ~image & ~audio, F.lit(None)
    where = decisions.output_spec(kind, relative_path, rules, facts["picture_subtitles"], facts["audio_not_for_mp4"], facts["is_hdr"], work_root)
    image_encoder = F.when(image, _of(IMAGE_ENCODERS, rules["target_image_format"]))
    encoder = F.when(audio, _of(AUDIO_ENCODERS, rules["target_audio_codec"])).when(video, _of(AUDIO_ENCODERS, rules["video_audio_codec"]))
    rate = F.when(audio, rules["audio_kbps"]).when(video, rules["video_audio_kbps"])
    downmix = F.coalesce(rules["downmix"], F.lit(False))
    some = lambda removed: F.when(video & (F.size(removed) > 0), removed)
    return F.struct(
        where["container"].alias("container"),
        where["output_path"].alias("output_path"),
        where["tonemap"].alias("tonemap"),
        F.when(video, rules["target_video_codec"]).alias("video_codec"),
        image_encoder.alias("image_encoder"),
        F.when(image, rules["image_quality"]).otherwise(none).alias("image_quality"),
        F.coalesce((image_encoder == "libwebp") & F.lower(facts["image_codec"]).isin(*LOSSLESS_IMAGES), F.lit(False)).alias("image_lossless"),
        encoder.alias("audio_encoder"),
        F.when(encoder.isNotNull(), decisions.effective_bitrate(rate, F.coalesce(facts["channels"], F.lit(0)), downmix)).alias("audio_kbps"),
        (encoder.isNotNull() & downmix).alias("downmix"),
        F.coalesce(video & facts["variable_frame_rate"], F.lit(False)).alias("variable_frame_rate"),
        some(languages.track_removals(facts["audio_languages"], keep_audio)).alias("removed_audio"),
        some(languages.track_removals(facts["subtitle_languages"], keep_subtitles, guard=False)).alias("removed_subtitles"),
    )
