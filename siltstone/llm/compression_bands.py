"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Repetitive text compresses too well and noise hardly at all. Short texts compress less, so each limit holds from a
length in bytes up to the next; text mostly outside ASCII has limits of its own. Rows stay in their partitions: there is no shuffle.

Edge cases: null or empty text has no words, so the base rule rejects it; repeated rows are judged each by itself; a
null id is returned as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .support import SPACE, table

#: (from this many bytes, least ratio, greatest ratio) for a whole text; below the first there is no limit.
#: Each greatest ratio lies between what prose in English and Spanish reaches at most where the band begins (0.74 at 512
#: bytes, 0.64 at 1024, 0.58 at 2048, 0.52 at 4096) and what blank-separated base64 reaches at least where it ends (0.79
#: at 511 bytes, 0.74 at 1023, 0.72 at 2047, 0.71 at 4095); noise of printable characters is above base64. Under 256
#: bytes the two overlap. Hexadecimal digits (0.53 and more) compress as prose does.
WHOLE_BANDS = (
    (128, 0.38, 1.00), (256, 0.38, 0.85), (320, 0.38, 0.81), (384, 0.38, 0.785), (512, 0.32, 0.745),
    (768, 0.32, 0.70), (1024, 0.32, 0.67), (2048, 0.27, 0.64), (4096, 0.27, 0.62), (8192, 0.22, 0.60),
)
#: The same for one chunk.
CHUNK_BANDS = ((1024, 0.25, 0.67), (2048, 0.25, 0.64), (4096, 0.22, 0.62))
#: Where over this share of the bytes is no ASCII, characters take several bytes and short prose compresses less:
#: Chinese, Japanese and Korean reach 0.93 at 512 bytes, 0.80 at 1024, 0.69 at 2048, 0.61 at 4096 and 0.54 at 8192.
WIDE_SHARE = 0.3
WIDE_WHOLE_BANDS = ((128, 0.38, 1.20), (512, 0.32, 0.95), (1024, 0.32, 0.83), (2048, 0.27, 0.72), (4096, 0.27, 0.65), (8192, 0.22, 0.60))
WIDE_CHUNK_BANDS = ((1024, 0.25, 0.83), (2048, 0.25, 0.72), (4096, 0.22, 0.65))
ASCII = bytes(range(128))
CHUNK_BYTES = 4096
#: A text is rejected when over this share of its chunks' bytes lies outside the band.
MOST_OUTSIDE = 0.3
LEVEL = 3
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunks_outside double"
)


def repeat_words(words: Sequence[bytes], width: int = 3) -> int:
    """Words that lie in a window of width words which is found twice or more."""
    if len(words) < width + 1:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    key = ids[: len(ids) - width + 1]
    for k in range(1, width):  # renumbered after each word, so keys are exact and stay small
        key = key * len(number) + ids[k : len(ids) - width + 1 + k]
        _, key, count = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[key] > 1)
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + width, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def base_stats(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def outside(ratio: float, size: int, bands: Sequence[tuple[int, float, float]]) -> bool:
    band = next((b for b in reversed(bands) if size >= b[0]), None)
    return band is not None and not band[1] <= ratio <= band[2]


def wide(raw: bytes) -> bool:
    return len(raw.translate(None, ASCII)) > WIDE_SHARE * len(raw)


def score(documents: DataFrame, whole_bands=WHOLE_BANDS, chunk_bands=CHUNK_BANDS, chunk_bytes: int = CHUNK_BYTES, most_outside: float = MOST_OUTSIDE, level: int = LEVEL, wide_whole_bands=WIDE_WHOLE_BANDS, wide_chunk_bands=WIDE_CHUNK_BANDS) -> DataFrame:
    """Statistics, ratios and verdict for each (doc_id, text) row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                stats = base_stats(text)
                failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
                raw = text.encode()
                ratio = len(compress(raw)) / len(raw) if raw else 0.0
                judged = bad = 0
                for at in range(0, len(raw), chunk_bytes):
                    part = raw[at : at + chunk_bytes]
                    if len(part) >= min(chunk_bands[0][0], wide_chunk_bands[0][0]):
                        judged += len(part)
                        bad += len(part) * outside(len(compress(part)) / len(part), len(part), wide_chunk_bands if wide(part) else chunk_bands)
                share = bad / judged if judged else 0.0
                kept = not failed and not outside(ratio, len(raw), wide_whole_bands if wide(raw) else whole_bands) and share <= most_outside
                out.append((doc_id, *stats, failed, kept, ratio, share))
            columns = list(zip(*out)) or [()] * 10
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(judge, SCHEMA)


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
