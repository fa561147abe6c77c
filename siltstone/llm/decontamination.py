"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents inside a task. Its words are numbered by the test phrases' vocabulary; a word
outside it can lie in no phrase, so it only separates runs, and runs shorter than the shortest phrase are left out. Over
the rest the task builds a suffix array, the Burrows-Wheeler transform, a wavelet matrix for ranks, and a sample of
suffix positions. All phrases of a block are searched backwards at once; occurrences are located by walking to a sampled
position, and their spans are merged. Documents are read once and never shuffled; the phrases go to the tasks in blocks of
bounded size, as arrays of numbers, and each task searches a shard for one block after another.

Edge cases: null or empty text has no words and is not contaminated; an item without words has no phrase; a null item_id
counts as the item named ``null``; repeated items count once; repeated rows of documents are judged each by itself; other
columns are ignored; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import table

WINDOW = 13
#: Words of a shard, at which the next begins.
SHARD_WORDS = 2_000_000
#: Bytes of benchmark text that are searched for at once, on average; the driver holds one such block while it is made.
BLOCK_BYTES = 4 << 20
SAMPLE_EVERY = 8

#: A-Z to a-z, other ASCII that is no digit or letter to a blank; words are what is left between blanks.
WORD_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))

HITS = "doc_id long, n_words long, hit array<struct<start:int,end:int>>, items array<string>"


def contract_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_TABLE).split()


class WaveletMatrix:
    """Rank and access over a sequence of small numbers, each for many positions at once."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels: list[tuple[np.ndarray, int, int]] = []
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            before = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(ones, out=before[1:])
            zeros = len(values) - int(before[-1])
            self.levels.append((before, zeros, bit))
            values = np.concatenate([values[ones == 0], values[ones == 1]])
        self.start: np.ndarray | None = None

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position at."""
        low = np.zeros_like(at)
        for before, zeros, bit in self.levels:
            one = (symbol >> bit) & 1 == 1
            at = np.where(one, zeros + before[at], at - before[at])
            low = np.where(one, zeros + before[low], low - before[low])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for before, zeros, bit in self.levels:
            one = before[at + 1] - before[at]
            out |= one << bit
            at = np.where(one == 1, zeros + before[at], at - before[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; the last symbol of text must be smaller than all others."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        if new[-1] == n - 1 or 2 * width >= n:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        width *= 2


class FMIndex:
    """Counts and locates patterns in text, whose symbols are from 1 up; the index adds a last symbol 0."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.size = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        sampled = order % every == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of patterns, all of one length: their ranges of suffixes."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.size, dtype=np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            low[alive] = self.before[symbol] + self.bwt.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.bwt.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin, by steps to the left until a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        at, where, steps = rows.copy(), np.arange(len(rows)), 0
        while len(at):
            sampled = self.sampled_before[at + 1] > self.sampled_before[at]
            out[where[sampled]] = self.samples[self.sampled_before[at[sampled]]] + steps
            at, where = at[~sampled], where[~sampled]
            symbol = self.bwt.access(at)
            at = self.before[symbol] + self.bwt.rank(symbol, at)
            steps += 1
        return out


class Phrases:
    """The windows of a block of items: a vocabulary, and by length the distinct windows and whose they are."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        numbered = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words], dtype=np.int32) for _, words in items]  # 0 ends, 1 separates
        lengths = np.array([min(len(ids), width) for ids in numbered], dtype=np.int64)
        self.shortest = int(lengths[lengths > 0].min(initial=width)) if (lengths > 0).any() else 0
        #: by length: the distinct windows, and the items of window k, as places in names, from begin[k] to begin[k + 1]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({*lengths[lengths > 0].tolist()}):
            of = np.flatnonzero(lengths == length)
            views = [np.lib.stride_tricks.sliding_window_view(numbered[k], length) for k in of.tolist()]
            windows, which = np.unique(np.concatenate(views), axis=0, return_inverse=True)
            owned = np.unique(np.stack([which.reshape(-1), np.repeat(of, [len(v) for v in views])]), axis=1)
            self.by_length[length] = windows, np.searchsorted(owned[0], np.arange(len(windows) + 1)), owned[1].astype(np.int32)


Spans = list[tuple[int, int]]


def merged(spans: Spans) -> Spans:
    """Spans that meet or overlap become one."""
    out: Spans = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[Spans, set[str]]]:
    """For each document's word numbers, 0 where outside the vocabulary: merged hit spans, items."""
    starts = np.concatenate([[0], np.cumsum([len(ids) + 1 for ids in docs])])
    joined = np.zeros(int(starts[-1]), dtype=np.int64)
    for at, ids in zip(starts, docs):
        joined[at : at + len(ids)] = ids
    inside = np.concatenate([[0], (joined != 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    first, last = edges[::2], edges[1::2]
    long = (last - first) >= max(1, phrases.shortest)
    first, last = first[long], last[long]
    cover = np.zeros(len(joined) + 1, dtype=np.int64)  # how many occurrences begin less how many end
    pairs = [np.empty((2, 0), dtype=np.int64)]  # documents and the items that occur in them
    if len(first) and phrases.shortest:
        size = last - first
        place = np.concatenate([[0], np.cumsum(size + 1)])[:-1]  # of each run in the indexed text
        text = np.ones(int((size + 1).sum()), dtype=np.int64)
        slots = _within(size)
        text[np.repeat(place, size) + slots] = joined[np.repeat(first, size) + slots]
        index = FMIndex(text, len(phrases.vocabulary) + 2)
        for length, (windows, begin, owners) in phrases.by_length.items():
            low, high = index.ranges(windows)
            count = high - low
            which = np.repeat(np.arange(len(windows)), count)
            at = index.locate(np.repeat(low, count) + _within(count))
            run = np.searchsorted(place, at, side="right") - 1
            at = first[run] + at - place[run]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            found = np.unique(np.stack([np.searchsorted(starts, at, side="right") - 1, which]), axis=1)
            owned = begin[found[1] + 1] - begin[found[1]]
            pairs.append(np.unique(np.stack([np.repeat(found[0], owned), owners[np.repeat(begin[found[1]], owned) + _within(owned)]]), axis=1))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)])))
    a, b = edges[::2], edges[1::2]
    of = np.searchsorted(starts, a, side="right") - 1
    hits: dict[int, tuple[Spans, set[str]]] = defaultdict(lambda: ([], set()))
    for d, x, y in zip(of.tolist(), (a - starts[of]).tolist(), (b - starts[of]).tolist()):
        hits[d][0].append((x, y))
    for d, item in np.concatenate(pairs, axis=1).T.tolist():
        hits[d][1].add(phrases.names[item])
    return [hits[d] if d in hits else ([], set()) for d in range(len(docs))]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size less one, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def search_blocks(texts: list[list[bytes]], blocks: list[Broadcast]) -> list[tuple[Spans, list[str]]]:
    """For each document's words: merged hit spans and items of all blocks, of which one is in memory at a time."""
    hits: list[tuple[Spans, set[str]]] = [([], set()) for _ in texts]
    for block in blocks:
        phrases = block.value
        get = phrases.vocabulary.get
        found = search_shard([np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words)) for words in texts], phrases)
        hits = [(merged(spans + more), items | others) if more else (spans, items) for (spans, items), (more, others) in zip(hits, found)]
        if len(blocks) > 1 and getattr(block, "_path", None):  # the worker's file, from which the next shard reads it again
            block.__dict__.pop("_value", None)
    return [(spans, sorted(items)) for spans, items in hits]


def contaminated(n_hit: int, n_words: int) -> bool:
    """If a twentieth of the words, and one at least, is hit."""
    return n_hit > 0 and 20 * n_hit >= n_words


def _search(blocks: list[Broadcast], shard_words: int, clean_rows: bool):
    """With clean_rows, the rows given that are not contaminated, with all columns; else HITS."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        shard: list[list[bytes]] = []
        words = 0

        def done() -> Iterator[pa.RecordBatch]:
            hits = search_blocks(shard, blocks)
            if clean_rows:
                keep = pa.array([not contaminated(sum(b - a for a, b in spans), len(w)) for w, (spans, _) in zip(shard, hits)], pa.bool_())
                at = 0
                for part in rows:
                    yield part.filter(keep.slice(at, part.num_rows))
                    at += part.num_rows
                return
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for part in rows for i in part.column("doc_id").to_pylist()], pa.int64()),
                    pa.array([len(w) for w in shard], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for spans, _ in hits], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([items for _, items in hits], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "hit", "items"],
            )

        for batch in batches:
            first = 0
            for k, text in enumerate(batch.column("text")):
                shard.append(contract_words(text.as_py()))
                words += len(shard[-1])
                if words >= shard_words:
                    rows.append(batch.slice(first, k + 1 - first))
                    yield from done()
                    rows, shard, words, first = [], [], 0, k + 1
            rows.append(batch.slice(first))
        if shard:
            yield from done()

    return step


def phrase_blocks(benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The benchmark's phrases in blocks of block_bytes of text at most on average; the driver holds one while it is made."""
    asked = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    made = []
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        made.append(benchmark.sparkSession.sparkContext.broadcast(Phrases([(r["item"], contract_words(r["text"])) for r in part.collect()], width)))
    return made


def find_hits(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hit spans in words, items found) for each row of documents."""
    return documents.select("doc_id", "text").mapInArrow(_search(phrase_blocks(benchmark, width, block_bytes), shard_words, False), HITS)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents that are not contaminated, each by its own hits, with all their columns."""
    return documents.mapInArrow(_search(phrase_blocks(benchmark, width, block_bytes), shard_words, True), documents.schema)


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """find_hits with the verdict: contaminated if a twentieth of the words, and one at least, is hit."""
    hits = find_hits(documents, benchmark, **options)
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
windows AS (
  SELECT DISTINCT item, len(win) AS n, array_to_string(win, ' ') AS win
  FROM (SELECT id AS item, list_slice(w, i, i + 12) AS win FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM words WHERE side = 'b' AND len(w) > 0))),
spots AS (
  SELECT d.id AS doc_id, d.i, s.n, array_to_string(list_slice(d.w, d.i, d.i + s.n - 1), ' ') AS win
  FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE side = 'd') d, (SELECT DISTINCT n FROM windows) s
  WHERE d.i + s.n - 1 <= len(d.w)),
hits AS (SELECT a.doc_id, a.i, a.n, w.item FROM spots a JOIN windows w ON a.win = w.win AND a.n = w.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit_words h ON w.id = h.doc_id LEFT JOIN hit_items i ON w.id = i.doc_id WHERE w.side = 'd'
"""
