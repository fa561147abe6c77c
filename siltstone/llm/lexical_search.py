"""Ranked lexical search by the threshold algorithm over a forward index.

The forward index is a written table with a row for each document that has a term: its length and its terms with their
counts. From it come the number of documents and of terms, and the document frequencies of the queries' terms. To answer
queries, each partition of the index makes lists of postings for the queries' terms, sorted by impact, segment by segment.
For each query the lists are read round robin, a few entries more each round; what is new is scored by looking its
document up in the forward index. The threshold is the sum of the impacts read last. Reading stops when it falls strictly
below the k-th best score so far, of this segment and those before it, so no document and no tie can be missed; no other
bound cuts a list. Partitions return their best k for each query; those are ranked in two steps, so that the results of
many partitions never meet in one task at once.

Terms are runs of ASCII letters, digits and whatever is not ASCII, with A-Z lower-cased. A query's terms count once.
The queries go to the tasks in blocks of about ``BLOCK`` bytes, one after the other, each dropped after use.

Edge cases: null and empty texts have no terms, are no part of the counts and are never found; repeated rows and rows that
repeat an id or have none are documents of their own, a null id ranks after others of the same score; queries that repeat
an id are one query with the terms of all; a query without terms, or with none that occurs, has no rows; other columns are
ignored. A task holds one segment: ``SEGMENT`` postings of the block's terms, or one longer document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import materialise, table

#: Postings of a segment, bytes of a block of queries, and parts that each query's results are ranked in first.
SEGMENT, BLOCK, PARTS = 1_500_000, 2 << 20, 64
#: Documents that are split into terms at once.
AT_ONCE = 1000
#: Entries that the first round reads of each list; each round reads twice as many.
FIRST = 8
#: Upper to lower case, and blanks for all that parts terms, in UTF-8 bytes.
TERM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_TABLE).split()


def forward_index(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, terms, counts) for each row of df with a term: n terms in all, and each term with how often it is there."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                kept, sizes, ends, terms, counts = [], [], [0], [], []
                for row, content in enumerate(batch.column("text").to_pylist()):
                    found = Counter(terms_of(content))
                    if found:
                        kept.append(row)
                        sizes.append(found.total())
                        terms += found.keys()
                        counts += found.values()
                        ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(kept, pa.int64())),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                    ],
                    names=["key", "n", "terms", "counts"],
                )

    return rows.mapInArrow(step, f"key {rows.schema['key'].dataType.simpleString()}, n long, terms array<string>, counts array<long>")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start to before its end, one range after the other."""
    sizes = ends - starts
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class Segment:
    """Documents with lists of postings sorted by impact, and their terms to look up; documents in the order of ties."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        by_doc = np.argsort(doc, kind="stable")
        self.term, self.impact = term[by_doc], impact[by_doc]
        self.first = np.searchsorted(doc[by_doc], np.arange(n_docs + 1))
        by_impact = np.lexsort((doc, -impact, term))
        self.list_doc, self.list_impact = doc[by_impact], impact[by_impact]
        self.list_first = np.searchsorted(term[by_impact], np.arange(n_terms + 1))
        self.seen = np.zeros(n_docs, dtype=bool)
        self.wanted = np.zeros(n_terms, dtype=bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """The scores of docs, each of which has a posting, for the wanted terms, by their terms in the forward index."""
        starts, ends = self.first[docs], self.first[docs + 1]
        at = _ranges(starts, ends)
        sizes = ends - starts
        return np.add.reduceat(np.where(self.wanted[self.term[at]], self.impact[at], 0), np.cumsum(sizes) - sizes)

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for terms and their scores; those below floor may be missing."""
        at, ends = self.list_first[terms], self.list_first[terms + 1]
        filled = ends > at
        terms, at, ends = terms[filled], at[filled], ends[filled]
        docs, scores, read, step = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [], FIRST
        self.wanted[terms] = True
        threshold = self.list_impact[at].sum()
        while len(at) and threshold >= floor:
            upto = np.minimum(at + step, ends)
            met = self.list_doc[_ranges(at, upto)]
            new = np.unique(met[~self.seen[met]])
            if len(new):
                self.seen[new] = True
                read.append(new)
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new)])
                top = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[top], scores[top]
            if len(scores) == k:
                floor = max(floor, scores[-1])
            left = upto < ends
            threshold = self.list_impact[upto[left] - 1].sum()
            at, ends, step = upto[left], ends[left], step * 2
        self.wanted[terms] = False
        for new in read:
            self.seen[new] = False
        return docs, scores


def _answers(index: DataFrame, block: list, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, score, key): the best k of each partition of index for each query (item, terms, weights) of a block."""
    spark = index.sparkSession
    names = sorted({t for _, terms, _ in block for t in terms})
    number = {t: i for i, t in enumerate(names)}
    weights = np.zeros(len(names), dtype=np.int64)
    for _, terms, given in block:
        weights[[number[t] for t in terms]] = given
    queries = spark.sparkContext.broadcast((names, weights, [np.array(sorted(number[t] for t in terms)) for _, terms, _ in block]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, wanted = queries.value
        vocabulary = pa.array(names, pa.string())
        best: list[tuple[np.ndarray, list]] = [(np.empty(0, dtype=np.int64), []) for _ in wanted]  # scores and keys, best first

        def search(parts: list[tuple]) -> None:
            """Let the segment of parts (keys, doc, term, impact) change best."""
            keys = pa.concat_arrays([p[0] for p in parts])
            shift = np.cumsum([0, *(len(p[0]) for p in parts)])
            rank = np.empty(len(keys), dtype=np.int64)
            rank[pa.compute.sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(len(keys))
            inverse = np.argsort(rank)
            doc = rank[np.concatenate([p[1] + s for p, s in zip(parts, shift)])]
            segment = Segment(doc, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), len(keys), len(names))
            for q, terms in enumerate(wanted):
                scores, held = best[q]
                docs, found = segment.best(terms, k, int(scores[k - 1]) if len(scores) >= k else 0)
                docs, found = docs[found > 0], found[found > 0]
                if len(docs):
                    together = [*zip(scores.tolist(), held), *zip(found.tolist(), keys.take(pa.array(inverse[docs])).to_pylist())]
                    together.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
                    best[q] = np.array([s for s, _ in together[:k]]), [key for _, key in together[:k]]

        parts, held = [], 0
        for batch in batches:
            lists = batch.column("terms")
            flat = pa.compute.index_in(lists.flatten(), value_set=vocabulary)
            owner = pa.compute.list_parent_indices(lists).to_numpy()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            term = flat.drop_null().to_numpy().astype(np.int32)
            doc = owner[there]
            count = batch.column("counts").flatten().to_numpy()[there]
            m = 10 + 90 * batch.column("n").to_numpy() * n_docs // n_terms
            impact = weights[term] * (1_000_000_000 * count // (1000 * count + 8 * m[doc]))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            row = 0
            while row < batch.num_rows:  # a part never goes over what the segment has room for, but for one document
                upto = max(row + 1, int(np.searchsorted(ends, ends[row] + SEGMENT - held, side="right")) - 1)
                a, b = ends[row], ends[upto]
                parts.append((batch.column("key").slice(row, upto - row), doc[a:b] - row, term[a:b], impact[a:b]))
                held += b - a
                row = upto
                if held >= SEGMENT or row < batch.num_rows:
                    search(parts)
                    parts, held = [], 0
        if parts:
            search(parts)
        rows = [(q, s, key) for q, (scores, keys) in enumerate(best) for s, key in zip(scores.tolist(), keys)]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], key_type)], names=["query", "score", "key"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(index.schema["key"].dataType)
    found = index.mapInArrow(step, f"query int, score long, key {index.schema['key'].dataType.simpleString()}")
    found = materialise(found, "lexical-answers")
    queries.destroy()
    return found


def _query_blocks(queries: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """(block, item, terms, weights): the queries with those of their terms that occur, dealt to blocks; a written table."""
    wanted = materialise(queries.select(F.col("key").alias("item"), F.explode("terms").alias("term")).distinct(), "lexical-queries")
    postings = index.select(F.explode("terms").alias("term"))
    frequency = postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighted = materialise(wanted.join(frequency.select("term", weight.alias("weight")), "term"), "lexical-weights")
    size = weighted.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    entry = F.sort_array(F.collect_list(F.struct("term", "weight")))
    grouped = weighted.groupBy("item").agg(entry.alias("entry"))
    return grouped.select(
        F.pmod(F.xxhash64("item"), F.lit(size // BLOCK + 1)).cast("int").alias("block"), "item", F.col("entry.term").alias("terms"), F.col("entry.weight").alias("weights")
    )


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item, rank, key, score): the k best rows of a written forward index for each row (key, terms) of queries."""
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    schema = f"item {queries.schema['key'].dataType.simpleString()}, rank int, key {index.schema['key'].dataType.simpleString()}, score long"
    if not n_docs:
        return spark.createDataFrame([], schema)
    blocks = materialise(_query_blocks(queries, index, n_docs), "lexical-blocks")
    found = None
    for (number,) in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        block = [(r.item, r.terms, r.weights) for r in blocks.where(F.col("block") == number).toLocalIterator()]
        items = spark.createDataFrame([(q, item) for q, (item, _, _) in enumerate(block)], f"query int, item {queries.schema['key'].dataType.simpleString()}")
        part = _answers(index, block, n_docs, n_terms, k).join(F.broadcast(items), "query").select("item", "score", "key")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    part = F.pmod(F.xxhash64("key", "score"), F.lit(PARTS)).alias("part")
    best = found.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "key", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialise(forward_index(table(spark, sf_dir, "documents"), "doc_id"), "forward-index")
    found = search(index, forward_index(table(spark, sf_dir, "benchmark"), "item_id"), 10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}'))"
OP12_SQL = f"""
WITH posting AS (SELECT place, doc_id, term, count(*) AS tf FROM (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
doc AS (SELECT place, sum(tf)::BIGINT AS n FROM posting GROUP BY place),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM doc),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
weight AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
    FROM posting, corpus WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs
),
impact AS (
    SELECT place, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS impact
    FROM posting JOIN weight USING (term) JOIN doc USING (place), corpus
),
scored AS (SELECT item_id, place, doc_id, sum(impact)::BIGINT AS score FROM wanted JOIN impact USING (term) GROUP BY ALL HAVING sum(impact) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
