"""Quality classifier by importance resampling.

Two generative models count hashed n-grams: one of target text (documents labelled good) and one of raw text (all
documents). A document's weight is the log ratio of its probabilities under them; documents are sampled without
replacement in proportion to their weights by adding Gumbel noise and taking the top k. The noise is a hash of the id,
so every run draws the same sample.

Features are words, pairs of words (with one number for a word that repeats), and pairs and triples of word shapes
(capitals, digits, runs of symbols), hashed to ``BUCKETS`` numbers. Good is a label of quality alone, for the target as for
k, which is the labelled share of good documents times all documents; its threshold is found exactly by narrowing a
histogram, without sorting rows in one place.

A few words make a text toxic, and they weigh little in the sum over all n-grams, so the sample alone can't tell. A
document is toxic if it holds a telling word, one for which documents labelled toxic are at least ``TELLING`` times as
frequent as others, and more so than chance explains over the whole vocabulary. The query's column ``kept`` is the sample
by quality, ``toxic`` says whether a telling word was found, and ``accepted`` is what is kept and not toxic. ``keep_good``
leaves toxic documents out of the models, of labels and of k, and samples from the others alone.

Texts are read twice: once for the raw counts, once for the weights, whose rows are written. Raw counts are taken over all
documents. Target counts are taken over at most ``MAX_TARGET`` labelled documents, chosen by a hash of their ids, which
bounds what is broadcast.

Edge cases: null or empty text has weight 0 and takes part with its noise alone; a null id draws its noise from the
text; rows with equal keys at the threshold are all kept; rows that repeat an id are weighed each by itself; conflicting
labels count as the worst of them; without a good label, or without documents, all are kept, and without a toxic label or
one that is not, no document is toxic; other columns are ignored by the query and kept by ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .support import LOWER_TABLE, materialise, mix64, table

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
MAX_TARGET = 20_000
#: Of a telling word, labelled documents that hold it are toxic this many times as often as not.
TELLING = 4.0
#: Counts added to either model in each bucket, so rare n-grams weigh little.
PRIOR = 20.0
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")
_ODD = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shape(token: bytes) -> bytes:
    c = token[0]
    if c >= 128 or token[:1].isalpha():
        return b"A" if len(token) > 1 and token.isupper() else b"X" if token[:1].isupper() else b"x"
    return b"9" if token[:1].isdigit() else token[:4]


class ShapeHash(dict):
    def __missing__(self, token: bytes) -> int:
        h = crc32(shape(token))
        if len(self) < 150_000:  # bounds a worker's memory
            self[token] = h
        return h


_SHAPES = ShapeHash()


def tokens_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Words and runs of symbols, as they are and with A-Z lower-cased."""
    raw = (text or "").encode()
    return TOKEN.findall(raw), TOKEN.findall(raw.translate(LOWER_TABLE))


def features(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of text."""
    return buckets(*tokens_of(text))


def buckets(tokens: list[bytes], lower: list[bytes]) -> np.ndarray:
    n = len(tokens)
    if not n:
        return np.empty(0, dtype=np.int64)
    words = np.fromiter(map(crc32, lower), dtype=np.uint64, count=n)
    shapes = np.fromiter(map(_SHAPES.__getitem__, tokens), dtype=np.uint64, count=n)
    pairs = np.where(words[1:] == words[:-1], np.uint64(1), words[1:] * _ODD[0] + words[:-1] * _ODD[1])
    grams = np.concatenate([words * _ODD[2], pairs * _ODD[3] + np.uint64(1), shapes[1:] * _ODD[4] + shapes[:-1] * _ODD[5], shapes[2:] * _ODD[4] + shapes[1:-1] * _ODD[6] + shapes[:-2] * _ODD[7]])
    return (mix64(grams) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def gumbel(ids: np.ndarray) -> np.ndarray:
    u = ((mix64(ids ^ np.uint64(0x51ED270B4D2F1E35)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def _counts(target_ids, telling: frozenset[bytes]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = target_ids.value
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                tokens, lower = tokens_of(text.as_py())
                if not telling.isdisjoint(lower):
                    continue
                f = buckets(tokens, lower)
                found = np.bincount(f, minlength=BUCKETS) if len(f) > BUCKETS else None
                for counts in (raw, target) if doc_id.as_py() in targets else (raw,):
                    if found is None:
                        np.add.at(counts, f, 1)
                    else:
                        counts += found
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return step


def fit(documents: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET, prior: float = PRIOR, telling: frozenset[bytes] = frozenset()) -> tuple[np.ndarray | None, float]:
    """(log ratio of each bucket, labelled share of good documents); no ratios without a good label.

    Documents that hold one of telling are left out.
    """
    spark = documents.sparkSession
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    judged = materialise(judged, "labels")
    good, all_of = judged.agg(F.count_if(F.col("quality") == 1), F.count("*")).first()
    chosen = judged.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).select("doc_id")
    ids = frozenset(r[0] for r in chosen.collect())
    if not ids:
        return None, 1.0
    targets = spark.sparkContext.broadcast(ids)
    counted = documents.select("doc_id", "text").mapInArrow(_counts(targets, telling), "bucket long, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"].to_numpy()] = rows["raw"].to_numpy()
    target[rows["bucket"].to_numpy()] = rows["target"].to_numpy()
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + prior) / (expected + prior)), good / all_of


def scored(documents: DataFrame, ratios: np.ndarray | None, telling: frozenset[bytes], columns: list[str]) -> DataFrame:
    """columns of documents with struct __quality, as a table: log weight, key (weight plus noise), if a telling word was found."""
    shared = documents.sparkSession.sparkContext.broadcast((None if ratios is None else ratios.astype(np.float64), telling))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of, words = shared.value
        for batch in batches:
            sizes, weights, toxic, noise = [], [], [], np.empty(batch.num_rows, dtype=np.uint64)
            for k, (doc_id, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"))):
                doc_id, text = doc_id.as_py(), text.as_py()
                tokens, lower = tokens_of(text)
                f = buckets(tokens, lower)
                sizes.append(len(f))
                weights.append(float(table_of[f].sum()) if table_of is not None and len(f) else 0.0)
                toxic.append(not words.isdisjoint(lower))
                noise[k] = crc32((text or "").encode()) + (1 << 63) if doc_id is None else doc_id & 0xFFFFFFFFFFFFFFFF
            found = (pa.array(sizes, pa.int64()), pa.array(weights, pa.float64()), pa.array(np.array(weights) + gumbel(noise), pa.float64()), pa.array(toxic, pa.bool_()))
            quality = pa.StructArray.from_arrays(found, names=["n_features", "log_weight", "key", "toxic"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), quality], names=[*columns, "__quality"])

    rows = documents.select(*{c: None for c in (*columns, "doc_id", "text")})
    schema = StructType([rows.schema[c] for c in columns]).add("__quality", DataType.fromDDL("n_features long, log_weight double, key double, toxic boolean"))
    return materialise(rows.mapInArrow(step, schema), "importance")


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float | None:
    """The k-th largest value, by narrowing a histogram until few rows are left; None if there are fewer than k rows."""
    found = keys.agg(F.count(column), F.min(column), F.max(column)).first()
    n, low, high = found
    if k <= 0 or n < k:
        return None
    value = F.col(column)
    while n > few and low < high:
        width = (high - low) / bins
        if low + width <= low:  # neighbouring numbers: too narrow to split
            break
        bin_of = F.least(F.floor((value - low) / width), F.lit(bins - 1))
        counts = keys.where((value >= low) & (value <= high)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        for row in sorted(counts, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                n, low, high = row["n"], row["low"], row["high"]
                break
            k -= row["n"]
    if low == high:
        return low
    return keys.where((value >= low) & (value <= high)).select(column).orderBy(value.desc()).limit(k).agg(F.min(column)).first()[0]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents hold each word; the empty word stands for the documents themselves."""

    def done() -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([counts[w][k] for w in words], pa.int64()) for k in (0, 1))], names=["word", "toxic", "other"])

    counts: dict[bytes, list[int]] = {}
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word in {b"", *TOKEN.findall((text or "").encode().translate(LOWER_TABLE))}:
                counts.setdefault(word, [0, 0])[0 if toxic else 1] += 1
        if len(counts) > 200_000:  # bounds a worker's memory
            yield done()
            counts.clear()
    if counts:
        yield done()


def telling_words(documents: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET, telling: float = TELLING) -> frozenset[bytes]:
    """Words that tell toxic documents, learned from at most max_target labelled ones of either kind."""
    judged = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    judged = materialise(judged, "toxic-labels")
    some = [judged.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target) for kind in (True, False)]
    all_toxic, all_of = judged.agg(F.count_if("toxic"), F.count("*")).first()
    if not 0 < all_toxic < all_of:
        return frozenset()
    chosen = documents.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")
    counted = chosen.select("toxic", "text").mapInArrow(_word_counts, "word binary, toxic long, other long")
    counted = materialise(counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxic-words")
    held = counted.where(F.octet_length("word") == 0).first()
    if held is None or not held["toxic"] or not held["other"]:
        return frozenset()
    share = held["toxic"] / (held["toxic"] + held["other"])
    toxic, other = F.col("toxic"), F.col("other")
    both = toxic + other
    surprise = toxic * F.log(toxic / (both * share)) + F.when(other > 0, other * F.log(other / (both * (1 - share)))).otherwise(0.0)
    odds = (toxic / held["toxic"] * all_toxic) / (F.greatest(other, F.lit(0.5)) / held["other"] * (all_of - all_toxic))
    found = counted.where((F.octet_length("word") > 0) & (toxic > 0) & (odds >= telling) & (surprise >= float(np.log(counted.count()))))
    return frozenset(bytes(r["word"]) for r in found.select("word").collect())


def without_toxic(documents: DataFrame, words: frozenset[bytes]) -> DataFrame:
    """The rows of documents that hold none of words."""
    if not words:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.isdisjoint(tokens_of(text.as_py())[1]) for text in batch.column("text")], pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)


def keep_good(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of documents that are not toxic and are sampled, with all their columns; options as ``fit``."""
    telling = telling_words(documents, labels)
    toxic = labels.where("toxic > 0").select("doc_id").distinct()
    ratios, share = fit(documents, labels.join(toxic, "doc_id", "left_anti"), telling=telling, **options)
    clean = scored(documents, ratios, telling, documents.columns).where("not __quality.toxic")
    least = None if ratios is None else kth_largest(clean.select("__quality.key"), "key", round(clean.count() * share))
    return (clean if least is None else clean.where(F.col("__quality.key") >= least)).drop("__quality")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: weight, key, kept (sampled by quality), toxic (a telling word), accepted (kept and not toxic)."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratios, share = fit(documents, labels)
    rows = scored(documents, ratios, telling_words(documents, labels), ["doc_id"]).select("doc_id", "__quality.*")
    least = None if ratios is None else kth_largest(rows, "key", round(rows.count() * share))
    kept = F.lit(True) if least is None else F.col("key") >= least
    return rows.withColumn("kept", kept).withColumn("accepted", kept & ~F.col("toxic"))
