"""Best-fit packing of tokenised documents by a grouping genetic algorithm over islands.

Documents are tokenised once, cut into pieces no longer than a sequence, and dealt by hash into blocks of a bounded
number of pieces. Each block is one bin-packing problem, solved by several islands (rows of a DataFrame that Spark deals
out). An island starts from pieces best-fitted in random order, which wastes some room, and evolves a small population:
a crossover injects whole well-filled bins of one parent into the other, drops the bins there that hold any of their
pieces and the emptiest ones, and best-fits the displaced pieces. A population whose best packing has as few bins as the
pieces' total length allows is done. After each epoch every island's best packing migrates to the next island of its
block. At the end the best packing of each block is unfolded. While there are several blocks, the emptiest bins of each
are taken apart again, and their pieces make the blocks of a further round; so only the last block has a part-filled bin
that nothing else could fill.

Edge cases: null text is empty text, whose only token is the end token; repeated rows of a document are pieces of their
own (each row is packed); a null id packs like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import drop_scratch, materialise, table
from .wordcache import CachedTokenizer

CAPACITY = 4096
END_ID = 1
BLOCK_PIECES = 8192
ISLANDS = 3
POPULATION = 4
EPOCHS = 2
CROSSOVERS = 12
#: Blocks or islands of a task on average, which come to it in one Arrow batch.
TASK_ROWS = 64
#: Shares of a packing's bins: at most that is injected into another, at most that of the emptiest is taken apart with
#: it, and that of the emptiest is left to the next round.
INJECTED, EMPTIEST, LEFT = 0.25, 0.3, 1 / 64
#: By how much the order of displaced pieces, the longest first, is blurred.
BLUR = 0.02

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenised_pieces(documents: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: its document's ids from start, length of them, and their CRC-32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = CachedTokenizer.of(tokenizer_path).encode_bytes
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = ([], [], [], [], [])
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text in zip(ids, texts):
                raw = encode(text) + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.mapInArrow(cut, PIECES)


class Packing:
    """Bins of one block: which pieces each holds and how full it is."""

    def __init__(self, lengths: np.ndarray, capacity: int, bins: list[list[int]]):
        self.lengths, self.capacity = lengths, capacity
        self.bins = bins
        flat, starts = self._flat()
        self.fill = np.add.reduceat(lengths[flat], starts).tolist() if len(bins) else []

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All bins' pieces, one bin after another, and where each bin begins."""
        sizes = np.fromiter(map(len, self.bins), dtype=np.int64, count=len(self.bins))
        return np.fromiter(chain.from_iterable(self.bins), dtype=np.int64, count=int(sizes.sum())), np.cumsum(sizes) - sizes

    @classmethod
    def from_labels(cls, lengths: np.ndarray, capacity: int, labels: np.ndarray) -> Packing:
        order = np.argsort(labels, kind="stable")
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        return cls(lengths, capacity, [b.tolist() for b in np.split(order, cuts)] if len(order) else [])

    def labels(self) -> np.ndarray:
        flat, starts = self._flat()
        out = np.empty(len(self.lengths), dtype="<i4")
        out[flat] = np.repeat(np.arange(len(self.bins)), np.diff(np.append(starts, len(flat))))
        return out

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first; among as many, uneven fills, which leave room that later pieces can use."""
        return -len(self.bins), float(np.square(np.asarray(self.fill, dtype=float) / self.capacity).sum())

    def best_fit(self, pieces: list[int]) -> None:
        """Each piece, as given, goes to the fullest bin that has room, or to a new one."""
        free = sorted((self.capacity - f, k) for k, f in enumerate(self.fill) if f < self.capacity)
        lengths = self.lengths
        for p in pieces:
            need = int(lengths[p])
            at = bisect.bisect_left(free, (need, -1))
            if at < len(free):
                room, k = free.pop(at)
                self.bins[k].append(p)
                self.fill[k] += need
            else:
                room, k = self.capacity, len(self.bins)
                self.bins.append([p])
                self.fill.append(need)
            if room > need:
                bisect.insort(free, (room - need, k))

    def emptiest(self, share: float) -> list[int]:
        """That share of the bins, and one at least: the emptiest."""
        return np.argsort(self.fill, kind="stable")[: max(1, int(len(self.fill) * share))].tolist()

    def crossed(self, other: Packing, rng: np.random.Generator) -> Packing:
        """Inject whole well-filled bins of other, drop the bins that share a piece with them, best-fit what is displaced."""
        fill = np.asarray(other.fill)
        well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        number = int(len(fill) * rng.uniform(0, INJECTED))
        injected = [other.bins[k] for k in rng.choice(well, size=max(1, min(len(well), number)), replace=False)]
        inside = np.fromiter(chain.from_iterable(injected), dtype=np.int64)
        hit = {*self.labels()[inside].tolist(), *self.emptiest(rng.uniform(0, EMPTIEST))}
        taken = set(inside.tolist())
        displaced = np.array([p for k in hit for p in self.bins[k] if p not in taken], dtype=np.int64)
        child = Packing(self.lengths, self.capacity, [list(b) for b in injected] + [list(b) for k, b in enumerate(self.bins) if k not in hit])
        blurred = self.lengths[displaced] * (1 + BLUR * rng.random(len(displaced)))
        child.best_fit(displaced[np.argsort(-blurred, kind="stable")].tolist())
        return child


def seeded(lengths: np.ndarray, capacity: int, rng: np.random.Generator, noise: float | None = None) -> Packing:
    """Pieces best-fitted in random order, or, with noise, in decreasing order of their lengths blurred by it."""
    out = Packing(lengths, capacity, [])
    order = rng.permutation(len(lengths)) if noise is None else np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    out.best_fit(order.tolist())
    return out


def evolve(lengths: np.ndarray, capacity: int, people: list[Packing], crossovers: int, rng: np.random.Generator) -> tuple[list[Packing], int, int]:
    """The population, best first, and how many crossovers were made and accepted.

    Steady state: each child takes the worst place if it is better and as fit as no other. Ends early once no packing can
    have fewer bins.
    """
    least = math.ceil(int(lengths.sum()) / capacity)
    people = sorted(people, key=Packing.fitness, reverse=True)
    made = accepted = 0
    while made < crossovers and len(people) > 1 and len(people[0].bins) > least:
        a, b = rng.choice(len(people), size=2, replace=False)
        child = people[a].crossed(people[b], rng)
        made += 1
        fitness = [p.fitness() for p in people]
        if child.fitness() > fitness[-1] and child.fitness() not in fitness:
            accepted += 1
            people[-1] = child
            people.sort(key=Packing.fitness, reverse=True)
    return people, made, accepted


#: bins is the best packing's number of bins, seed_bins that of the best one before any crossover, least what none can be under.
ISLAND = "block long, island int, lengths binary, population array<binary>, bins int, spread double, seed_bins int, least int, made int, accepted int"
_ISLAND = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("population", pa.list_(pa.binary())), ("bins", pa.int32()), ("spread", pa.float64()), *((c, pa.int32()) for c in ("seed_bins", "least", "made", "accepted"))])


def _epoch(capacity: int, population: int, crossovers: int, epoch: int):
    """Evolve each island of a batch; its population comes with it, the elite that migrated in as its last member."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], dtype="<i4").astype(np.int64)
                rng = np.random.default_rng([row["block"], row["island"], epoch])
                if row["population"]:
                    people = [Packing.from_labels(lengths, capacity, np.frombuffer(p, dtype="<i4")) for p in row["population"]]
                else:
                    people = [seeded(lengths, capacity, rng) for _ in range(population)]
                seeds = row["seed_bins"] or min(len(p.bins) for p in people)
                people, made, accepted = evolve(lengths, capacity, people, crossovers, rng)
                bins, spread = people[0].fitness()
                found = row | {"population": [p.labels().tobytes() for p in people[:population]], "bins": -bins, "spread": spread, "seed_bins": seeds}
                found |= {"least": math.ceil(int(lengths.sum()) / capacity), "made": row["made"] + made, "accepted": row["accepted"] + accepted}
                yield pa.RecordBatch.from_pylist([found], schema=_ISLAND)

    return step


def evolved(blocks: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, crossovers: int = CROSSOVERS, tasks: int = 200) -> DataFrame:
    """The islands of (block, lengths) rows after their epochs, as rows of ISLAND; fewer epochs if all are done before."""
    state = blocks.select("block", F.explode(F.expr(f"sequence(0, {islands - 1})")).alias("island"), "lengths", F.lit(None).cast("array<binary>").alias("population"))
    state = state.withColumns({"seed_bins": F.lit(None).cast("int"), "made": F.lit(0), "accepted": F.lit(0)})
    for epoch in range(epochs):
        last = state
        if epoch:  # migration: the best of an island joins the next island of its ring
            ring = F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")
            elite = state.select("block", ring.alias("island"), F.col("population")[0].alias("elite"))
            state = state.join(elite, ["block", "island"]).withColumn("population", F.concat("population", F.array("elite")))
        state = state.select("block", "island", "lengths", "population", "seed_bins", "made", "accepted")
        state = state.repartition(tasks, "block", "island").mapInArrow(_epoch(capacity, population, crossovers, epoch), ISLAND)
        state = materialise(state, f"epoch{epoch}")
        if epoch:
            drop_scratch(last)
        if state.where("bins > least").isEmpty():
            break
    return state


def _unfold(capacity: int, names: list[str], first_id: int, leave: bool):
    """A block's pieces with the bin each lies in and its place there; with leave, those of its emptiest bins have none."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pieces = row["pieces"]
                lengths = np.array([p["length"] for p in pieces], dtype=np.int64)
                packed = Packing.from_labels(lengths, capacity, np.frombuffer(row["best"], dtype="<i4"))
                sequence, offset = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
                left = np.zeros(len(pieces), dtype=bool)
                for k, members in enumerate(packed.bins):
                    sequence[members] = first_id + (row["block"] << 24) + k
                    offset[members] = np.cumsum(lengths[members]) - lengths[members]
                for k in packed.emptiest(LEFT) if leave else ():
                    left[packed.bins[k]] = True
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in pieces], t) for n, t in zip(names, kinds)] + [pa.array(sequence, mask=left), pa.array(offset, mask=left)], names=[*names, "sequence_id", "offset"])

    return step


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, **options) -> DataFrame:
    """Give every piece of (doc_id, piece, start, length, ids_crc32) a sequence_id and an offset in it.

    Lengths must be from 1 to capacity. Memory of a task is bounded by block_pieces, whatever the input. A piece of full
    capacity is a sequence by itself. options are those of ``evolved``. A round leaves a small part of its pieces to the
    next, so the number of rounds grows with the logarithm of the input.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    spark = pieces.sparkSession
    pieces = materialise(pieces.select(*names), "pieces")
    # a full piece's number is unique and apart from the blocks' numbers, which are not negative
    done = [pieces.where(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, before = pieces.where(F.col("length") < capacity), None
    most = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = lambda rows: max(min(rows, most), math.ceil(rows / TASK_ROWS))

    def lengths_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(x, dtype="<i4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["block", "lengths"])

    for number in range(64):
        found = left.count()
        blocks = max(1, math.ceil(found / block_pieces))
        last = blocks == 1 or before == found
        # the piece's whole identity and a row number in its partition, so that repeated rows spread as well
        block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks))
        grouped = materialise(left.withColumn("block", block).groupBy("block").agg(F.collect_list(F.struct(*names)).alias("pieces")), "blocks")
        start = grouped.select("block", F.col("pieces.length").alias("lengths")).mapInArrow(lengths_only, "block long, lengths binary")
        state = evolved(start, capacity, tasks=tasks(blocks * options.get("islands", ISLANDS)), **options)
        best = state.groupBy("block").agg(F.min_by(F.struct(F.col("population")[0].alias("best")), F.struct("bins", -F.col("spread"), "island")).alias("x")).select("block", "x.best")
        dealt = grouped.repartition(tasks(blocks), "block").join(best.repartition(tasks(blocks), "block"), "block")
        packed = dealt.select("block", "pieces", "best").mapInArrow(_unfold(capacity, names, number << 57, not last), PACKED)
        if last:
            done.append(packed)
            break
        packed = materialise(packed, "packed")
        drop_scratch(state)
        drop_scratch(grouped)
        done.append(packed.where("sequence_id is not null"))
        left, before = packed.where("sequence_id is null").select(*names), found
    return reduce(DataFrame.unionByName, done)


def pack_documents(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, **options) -> DataFrame:
    """Tokenise (doc_id, text) documents, end each with end_id, cut only what is longer than capacity, and pack."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(tokenised_pieces(documents.select("doc_id", "text"), tokenizer_path, capacity, end_id), capacity, **options)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
