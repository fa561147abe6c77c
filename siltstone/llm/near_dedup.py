"""Near-duplicate components by fast similarity sketching, banding and exact verification.

A document's set are its distinct shingles of five words. Documents with one set are one class, represented by a digest
of the set, before anything else. A sketch has ``COORDINATES`` coordinates and is made in rounds: each round hashes every
element to one coordinate and a value, and a coordinate keeps the least value of the first round that reaches it. After
as many rounds as coordinates, round t + k puts all elements into coordinate k, so every coordinate is filled. Agreement
of two sketches is concentrated about the similarity of the sets as strongly as that of independent coordinates.

Classes that agree in all rows of a band are candidates, unless their sketches agree too little to be linked. In a band's
bucket every class is first held against the least one only, which makes clusters; then classes of one bucket but of
different clusters are held against each other, by blocks of a bounded number of classes and of shingles, which joins
clusters. So all candidates of a class are in its cluster. The pairs that made the clusters are confirmed on the full sets, and in each
cluster that these links leave in parts, all candidates across parts are confirmed too, again by blocks. No step makes a
row for every pair of a group.

Edge cases: null or empty text has an empty set and is linked with nothing; a row without an id is a document of its own
that is linked with nothing and kept; rows that repeat an id are one document for the components, each row is returned
and kept alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .support import byte_words, materialise, mix64, table

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDINATES = 128
#: 32 bands of 4 rows: a pair at 0.75 shares no band with a probability of 5e-6.
ROWS = 4
#: Agreeing coordinates under which a pair isn't verified; at 0.75 their number is 96, with a deviation under 5.
LEAST_AGREEING = 76
#: Classes of a block, and shingles of its classes where they are needed, on average at most: two blocks are held against
#: each other in one step.
BLOCK = 512
BLOCK_SHINGLES = 4 << 20

_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        padded = [*hashes.tolist(), len(words)]
        total = 0
        for k, h in enumerate(padded):
            total = (total + h * int(_MULTIPLIERS[k + 32])) & 0xFFFFFFFFFFFFFFFF
        return mix64(np.array([total], dtype=np.uint64))
    n = len(hashes) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += mix64(hashes[k : k + n] * _MULTIPLIERS[k])
    return np.unique(mix64(total))


_SEEDS = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketch(elements: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The coordinates of a set of hashes that isn't empty; coordinates is a power of two, at most COORDINATES."""
    shift = np.uint64(64 - (coordinates.bit_length() - 1))
    out = np.zeros(coordinates, dtype=np.uint64)
    empty = np.ones(coordinates, dtype=bool)
    step = max(1, 1024 // len(elements))  # small sets take many rounds, which are hashed together
    for first in range(0, coordinates, step):
        rounds = np.arange(first, min(first + step, coordinates))
        values = np.sort(mix64(elements[None, :] ^ _SEEDS[rounds, None]), axis=1)
        for r, row in zip(rounds.tolist(), values):
            bins, at = np.unique((row >> shift).astype(np.int64), return_index=True)  # the least of a bin comes first
            new = empty[bins]
            out[bins[new]] = mix64(row[at[new]] + np.uint64(r))
            empty[bins] = False
            if not empty.any():
                return out
    for k in np.flatnonzero(empty).tolist():  # the rounds that fill what no round has reached
        out[k] = mix64(np.min(mix64(elements ^ _SEEDS[coordinates + k]))[None] + np.uint64(coordinates + k))[0]
    return out


SKETCHES = "doc_id long, n_shingles long, digest binary, agree binary, bands array<long>"
SETS = "doc_id long, shingles array<long>"


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    for doc_id, text in zip(batch.column(0), batch.column(1)):
        yield doc_id.as_py(), shingle_hashes(byte_words(text.as_py(), lower=True))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    values = pa.array(np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    none = np.empty(0, dtype=np.uint64)
    for batch in batches:
        ids, sizes, digests, low, bands = [], [], [], [], []
        for d, s in _sets_of(batch):
            ids.append(d)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            low.append(None)
            bands.append(none)
            if len(s):
                k = sketch(s)
                rows = k.reshape(-1, ROWS)
                band = np.arange(len(rows), dtype=np.uint64)
                for c in range(ROWS):
                    band = mix64(band * _MULTIPLIERS[c] + rows[:, c])
                low[-1] = (k & np.uint64(0xFF)).astype(np.uint8).tobytes()
                bands[-1] = band
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(low, pa.binary()), _lists(bands)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "agree", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(_sets_of(batch))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), _lists([s for _, s in found])], names=["doc_id", "shingles"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def agreeing(pairs: DataFrame, sketches: DataFrame, least: int, percent: int) -> DataFrame:
    """The (a, b) of pairs whose sizes and sketches allow a link."""
    left = sketches.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("agree").alias("ka"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("agree").alias("kb"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ka", "kb"))
            keep = (x == y).sum(axis=1) >= least if batch.num_rows else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    # the larger id first: it is in few pairs, and the least of a bucket, which may be in many, is met last
    sized = pairs.join(right, "b").join(left, "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sized.select("a", "b", "ka", "kb").mapInArrow(close, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose full sets are linked."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.asarray(x.values), np.asarray(y.values), percent) for x, y in zip(batch.column("sa"), batch.column("sb"))]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


def in_blocks(rows: DataFrame, block: int, block_weight: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows of (unit, doc_id, part, weight) of units with several parts, dealt into pairs of blocks (p, q) and marked mine: p or q.

    A unit's largest part needs no comparison within itself: its blocks meet only the others' blocks. Every two rows of
    different parts meet in one pair of blocks at least, and none holds over twice block rows or block_weight on average.
    """
    counts = rows.groupBy("unit", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    units = counts.groupBy("unit").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "part")).alias("main")).where("parts > 1")
    blocks = lambda n, w: F.ceil(F.greatest(n / block, w / block_weight)).cast("int")
    units = units.select("unit", F.col("main.part").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("o"), blocks(F.col("main.n"), F.col("main.w")).alias("m"))
    units = materialise(units, "units")
    placed = rows.join(units, "unit").withColumn("is_main", F.col("part") == F.col("main"))
    at = F.xxhash64("doc_id")
    mine = F.when(F.col("is_main"), F.col("o") + F.pmod(at, F.col("m"))).otherwise(F.pmod(at, F.col("o"))).cast("int")
    others = F.explode(F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("o") - 1)).otherwise(F.sequence(F.lit(0), F.col("o") + F.col("m") - 1)))
    dealt = placed.withColumn("mine", mine).withColumn("other", others)
    return dealt.select("unit", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "doc_id", "part")


def _across(least: int, percent: int, exact: bool):
    """Links that join the parts of a pair of blocks: pairs of different parts that agree and, with exact, are linked.

    Pairs that others have joined already are left out, so there are fewer links than rows.
    """

    def step(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        k = np.frombuffer(b"".join(rows["agree"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        ids, n, mine = (rows[c].to_numpy() for c in ("doc_id", "n_shingles", "mine"))
        parts = np.unique(rows["part"].to_numpy(), return_inverse=True)[1]
        if exact:
            sets = rows["shingles"].combine_chunks()
            begin, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        same_set = lambda i, j: not exact or linked(values[begin[i] : begin[i + 1]], values[begin[j] : begin[j + 1]], percent)
        out_a, out_b = [], []
        second = np.flatnonzero(mine == q)
        for i in np.flatnonzero(mine == p).tolist():
            js = second[second > i] if p == q else second
            js = js[(parts[js] != parts[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
            if not len(js):
                continue
            same = (k[js] == k[i]).sum(axis=1)
            order = np.argsort(-same, kind="stable")
            for j in js[order[same[order] >= least]].tolist():
                if parts[j] != parts[i] and same_set(i, j):
                    parts[parts == parts[j]] = parts[i]
                    out_a.append(min(ids[i], ids[j]))
                    out_b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return step


def across(dealt: DataFrame, facts: DataFrame, least: int, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) that join parts of the units of ``in_blocks``; exact: confirmed on the shingles in facts."""
    full = dealt.join(facts.select("doc_id", "n_shingles", "agree", *(["shingles"] if exact else [])), "doc_id")
    return full.groupBy("unit", "p", "q").applyInArrow(_across(least, percent, exact), "a long, b long").distinct()


def near_components(documents: DataFrame, percent: int = PERCENT, least_agreeing: int = LEAST_AGREEING, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text)."""
    texts = documents.select("doc_id", "text")
    everyone = materialise(texts.mapInArrow(_sketches, SKETCHES), "sketches")
    counted = everyone.where("doc_id is not null and digest is not null")
    first = materialise(counted.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("last")), "classes")
    copies = counted.select("doc_id", "digest").join(first.where("class_id < last"), "digest").where("doc_id > class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    heads = first.select(F.col("class_id").alias("doc_id"), "digest")
    # rows that repeat an id have sketches of their own, one for each class that the id is the head of
    sketches = counted.join(heads, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("doc_id", "n_shingles", "agree", "bands")
    bands = sketches.select("doc_id", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").select("bucket", "leader")
    shared = materialise(shared, "shared-buckets")  # a plain table, so Spark can split a bucket's rows when it joins them
    members = materialise(bands.join(shared, "bucket").select("bucket", "doc_id", "leader").distinct(), "members")
    inside = members.select("doc_id").distinct()
    light = materialise(sketches.join(inside, "doc_id", "left_semi").select("doc_id", "n_shingles", "agree"), "light-sketches")

    # clusters: by the least class of each bucket, then across clusters in a bucket
    stars = members.where("doc_id > leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = materialise(agreeing(stars, light, least_agreeing, percent), "stars")
    cluster = materialise(components(stars), "star-clusters")
    rows = with_part(members.select(F.col("bucket").alias("unit"), "doc_id", F.lit(0).cast("long").alias("weight")), cluster)
    bridges = materialise(across(in_blocks(rows, block), light, least_agreeing, percent, exact=False), "bridges")
    joined = bridges.unionByName(cluster.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b"))
    cluster = materialise(components(joined), "clusters")

    # links: of the pairs that made the clusters, then across what these leave apart in a cluster
    wanted = cluster.select(F.col("node").alias("doc_id"))
    sets = materialise(texts.hint("merge").join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets, SETS), "sets")
    links = materialise(verified(stars.unionByName(bridges), sets, percent), "links")
    part = materialise(components(links), "parts")
    sizes = light.groupBy("doc_id").agg(F.sum("n_shingles").alias("weight"))
    rows = with_part(cluster.select(F.col("component").alias("unit"), F.col("node").alias("doc_id")).join(sizes, "doc_id"), part)
    more = across(in_blocks(rows, block, block_shingles), light.join(sets, "doc_id"), least_agreeing, percent, exact=True)

    whole = components(part.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more).unionByName(copies))
    found = whole.withColumnRenamed("node", "__near_node")
    out = everyone.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("__near_node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """documents with one row of each group of near duplicates, that with the smallest doc_id; options as near_components.

    Each row is a document of its own here, whether ids repeat or are null; of rows with one id, any one stays, and a row
    without an id goes before one that has an id. All columns stay.
    """
    numbered = materialise(documents.withColumn("__near_row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col("__near_row").alias("doc_id"), F.col("doc_id").alias("id"), "text")
    found = materialise(near_components(rows.select("doc_id", "text"), **options).select("doc_id", "component_id"), "row-components")
    groups = found.where("doc_id <> component_id").select("component_id").distinct()
    members = found.join(groups, "component_id", "left_semi").join(rows.select("doc_id", "id"), "doc_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("first")
    stay = members.groupBy("component_id").agg(first).select(F.col("first.doc_id").alias("doc_id"))
    gone = members.join(stay, "doc_id", "left_anti").select(F.col("doc_id").alias("__near_gone"))
    return numbered.join(gone, F.col("__near_row") == F.col("__near_gone"), "left_anti").drop("__near_row")


def with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with part: the component of their doc_id, itself where it has none."""
    return rows.join(parts.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
