"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash runs over a text's bytes; its value after a word is that of the last 32 bytes. A word ends a chunk if its
value is the least in some window of ``WINDOW_WORDS`` words, so chunks hold half as many words on average and never more
than a window. Cuts depend on the nearby text alone, so an insertion shifts none of those that follow. Chunks are
deduplicated by a digest of 128 bits: of the documents that hold one, that with the smallest id keeps it. Neighbouring
chunks that a document loses make one span; a span counts from ``MIN_WORDS`` words, which a repeated passage of over 50
words reaches and chance doesn't. ``dedup`` also takes away what a text repeats from itself, all but the first time; the
query reports what is repeated across documents.

Edge cases: null or empty text has no chunk; a row without an id keeps its text and counts for no other document; rows
that repeat an id are one document as to what is first, but each has spans of its own, by a hash of its text; other
columns are kept by ``dedup`` and ignored by the query; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import SPACE, materialise, mix64, table

WINDOW_WORDS = 13
MIN_WORDS = 16

#: A random number for each byte, of 32 bits: what is shifted out after 32 bytes is forgotten.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in SPACE]] = True


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = (h << 1) + GEAR[byte], by doubling the length that is summed up."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
    return h


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], (~_BLANK[raw]).view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def cuts(values: np.ndarray, window: int) -> np.ndarray:
    """Words (their numbers plus one) after which a chunk ends; the last word always ends one."""
    n = len(values)
    if n <= window:
        return np.array([n] if n else [], dtype=np.int64)
    key = (values.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    least, span = key, 1
    while span < window:  # the least of windows, by doubling
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    found = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1
    return found if found[-1] == n else np.append(found, n)


def chunks_of(text: str | None, window: int = WINDOW_WORDS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(digests, first words, word counts) of the chunks."""
    import xxhash

    raw = (text or "").encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    first, last = word_bounds(data)
    if not len(first):
        return [], first, last
    ends = cuts(gear_hash(data)[last - 1], window)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh3_128_digest
    return [digest(raw[a:b]) for a, b in zip(first[starts].tolist(), last[ends - 1].tolist())], starts, ends - starts


#: a and b are the digest; again: the same row has had it before.
CHUNKS = "doc_id long, row long, a long, b long, start int, n int, again boolean"


def _chunks(window: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, starts, counts, again = [], [], [], [], []
            for text in batch.column("text"):
                d, s, n = chunks_of(text.as_py(), window)
                sizes.append(len(d))
                digests += d
                starts.append(s)
                counts.append(n)
                seen: set[bytes] = set()
                again += [x in seen or seen.add(x) is not None for x in d]
            of_row = np.repeat(np.arange(len(sizes)), sizes)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            whole = lambda parts: pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(of_row)), batch.column("row").take(pa.array(of_row)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), whole(starts), whole(counts), pa.array(again, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in CHUNKS.split(", ")])

    return step


def repeated_spans(documents: DataFrame, window: int = WINDOW_WORDS, min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """(doc_id, row, start, end, first_doc_id): spans of words that an earlier document holds, and which one mostly.

    row is a hash of the text. within: also spans that the same text holds before, whose first_doc_id is doc_id.
    """
    texts = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    chunks = materialise(texts.mapInArrow(_chunks(window), CHUNKS), "chunks")
    repeats = F.max("again") if within else F.lit(False)
    shared = chunks.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), repeats.alias("repeats")).where("first < last or repeats").select("a", "b", "first")
    shared = materialise(shared, "shared-chunks")
    lost = chunks.join(shared, ["a", "b"]).where((F.col("doc_id") > F.col("first")) | (F.col("again") if within else F.lit(False)))
    by_row = Window.partitionBy("doc_id", "row").orderBy("start")
    end = F.col("start") + F.col("n")
    # rows alike in id and text have their chunks more than once: these begin no span of their own
    new = F.when(F.col("start") <= F.max(end).over(by_row.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    runs = lost.withColumn("new", new).withColumn("run", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max(end).alias("end"), F.mode("first", True).alias("first_doc_id"))
    return spans.where(F.col("end") - F.col("start") >= min_words).select("doc_id", "row", "start", "end", "first_doc_id")


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of spans and the white space after them."""
    if not text or not spans:
        return text
    raw = text.encode()
    first, last = word_bounds(np.frombuffer(raw, dtype=np.uint8))
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = min(a, len(first)), min(b, len(first))
        if a < b and first[a] >= at:
            out.append(raw[at : first[a]])
            at = first[b] if b < len(first) else last[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def dedup(documents: DataFrame, window: int = WINDOW_WORDS, min_words: int = MIN_WORDS, within: bool = True) -> DataFrame:
    """documents with text cut to what neither an earlier document nor, with within, the text itself holds before.

    A row keeps all its other columns.
    """
    spans = repeated_spans(documents, window, min_words, within)
    lists = spans.groupBy(F.col("doc_id").alias("__sub_doc"), F.col("row").alias("__sub_row")).agg(F.collect_list(F.struct("start", "end")).alias("__sub_spans"))
    cut = F.udf(lambda text, spans: without_spans(text, [tuple(s) for s in spans or ()]), "string", useArrow=True)
    joined = documents.withColumn("__sub_text", F.xxhash64("text")).join(lists, (F.col("doc_id") == F.col("__sub_doc")) & (F.col("__sub_text") == F.col("__sub_row")), "left")
    return joined.withColumn("text", F.when(F.col("__sub_spans").isNull(), F.col("text")).otherwise(cut("text", "__sub_spans"))).drop("__sub_doc", "__sub_row", "__sub_text", "__sub_spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each span that a document repeats from an earlier one, in words; equal rows of documents give one."""
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id")
