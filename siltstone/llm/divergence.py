"""Source divergence audit: how the terms of each language's sources differ, by mergeable radix tries.

Each partition counts terms in one byte trie a language; a leaf has the documents that hold its term and a counter for
each source. A trie travels as rows of its leaves in byte order, each with how many bytes it shares with the one before,
cut by the first bytes of the terms. Pieces of the same language and prefix meet in one group and merge; a prefix whose
pieces hold more than ``RANGE`` leaves is cut deeper first, so no group grows with the corpus. Merged tries keep the terms
of enough documents. Their traversal, in the order of UTF-8 bytes, gives the sums of each pair of sources and the best
candidates of each source, equal ones in the order met.

With count c of N in a group and V kept terms of the language, p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and two such p and
q differ by floor((p - q)^2 / (p + q)); all in integers, exact for up to 2 * 10^14 occurrences.

Edge cases: null text, language and source are read as ''; repeated rows count each; groups without a term, and languages
without a kept one, have their pairs, with value 0 if V is 0; an empty table has no rows; other columns are ignored. A
task holds tries of up to about ``BUFFER`` leaves and one document, or one merged range.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import drop_scratch, materialise, table

#: Leaves of a task's tries from which they go on, and that the pieces of one merged range have at most.
BUFFER, RANGE = 300_000, 500_000
#: First bytes that are one step of a trie and that pieces are cut by; each round of cutting large ones deeper doubles them.
DEPTH = 3
#: Terms times sources that are computed with at once.
CELLS = 2_000_000
UNIT = 1_000_000_000
TERM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

PIECE = "lang string, prefix binary, leaves int, sources array<string>, shared array<int>, rest array<binary>, docs array<long>, size array<int>, source array<int>, count array<long>"
PIECE_ARROW = pa.schema(
    [
        ("lang", pa.string()),
        ("prefix", pa.binary()),
        ("leaves", pa.int32()),
        ("sources", pa.list_(pa.string())),
        ("shared", pa.list_(pa.int32())),
        ("rest", pa.list_(pa.binary())),
        ("docs", pa.list_(pa.int64())),
        ("size", pa.list_(pa.int32())),
        ("source", pa.list_(pa.int32())),
        ("count", pa.list_(pa.int64())),
    ]
)


class Node:
    """A trie's node: the bytes that lead to it, its children by their first byte, and counters if a term ends here."""

    __slots__ = ("label", "children", "docs", "counts")

    def __init__(self, label: bytes):
        self.label, self.children, self.docs, self.counts = label, None, 0, None


class Trie:
    """Terms with the documents that hold them and their occurrences by source.

    The first step is by the first DEPTH bytes, or by a whole shorter term; known leads to a term's leaf at once.
    """

    def __init__(self):
        self.roots, self.known = {}, {}

    def leaf(self, term: bytes) -> Node:
        """The node of a term, made if it is new."""
        node = self.known.get(term)
        if node is None:
            node = self.known[term] = self._descend(term)
            node.counts = {}
        return node

    def _descend(self, term: bytes) -> Node:
        at, size = DEPTH, len(term)
        node = self.roots.get(term[:DEPTH])
        if node is None:
            node = self.roots[term[:DEPTH]] = Node(term[:DEPTH])
        while at < size:
            children = node.children
            if children is None:
                child = Node(term[at:])
                node.children = {term[at]: child}
                return child
            child = children.get(term[at])
            if child is None:
                child = children[term[at]] = Node(term[at:])
                return child
            label = child.label
            if term.startswith(label, at):
                at += len(label)
            else:
                same = _shared(label, term, at)
                middle = children[term[at]] = Node(label[:same])
                child.label = label[same:]
                middle.children = {label[same]: child}
                child, at = middle, at + same
            node = child
        return node

    def walk(self) -> Iterator[tuple[bytes, Node, int]]:
        """Terms and their nodes in the order of bytes, each with how many bytes it surely shares with the one before."""
        for key in sorted(self.roots):
            stack, low = [(self.roots[key], b"")], 0
            while stack:
                node, path = stack.pop()
                if len(path) < low:
                    low = len(path)
                path += node.label
                if node.counts is not None:
                    yield path, node, low
                    low = len(path)
                if node.children:
                    stack += [(node.children[b], path) for b in sorted(node.children, reverse=True)]

    def cut(self, lang: str, depth: int, least: int = 0) -> Iterator[tuple]:
        """(lang, prefix, shared, rest, docs, counts) of each leaf of at least so many documents, for pieces of depth bytes."""
        for key in sorted(self.roots):
            stack, low, before = [(self.roots[key], b"")], 0, None
            while stack:
                node, path = stack.pop()
                if len(path) < low:
                    low = len(path)
                path += node.label
                if node.counts is not None and node.docs >= least:
                    prefix = path[:depth]
                    if prefix != before or not low:
                        before = prefix
                        yield lang, prefix, 0, path, node.docs, node.counts
                    else:
                        yield lang, prefix, low, path[low:], node.docs, node.counts
                    low = len(path)
                children = node.children
                if children:
                    if len(children) == 1:
                        stack.append((*children.values(), path))
                    else:
                        stack += [(children[b], path) for b in sorted(children, reverse=True)]


class Merger:
    """Adds up the leaves of many pieces of one prefix; what is in enough documents becomes their merged trie."""

    def __init__(self):
        self.terms, self.sources = {}, {}
        self.leaf, self.docs, self.owner, self.source, self.count = ([] for _ in range(5))

    def add(self, batch: pa.RecordBatch) -> None:
        term, terms, leaf = b"", self.terms, []
        for shared, rest in zip(batch.column("shared").flatten().to_pylist(), batch.column("rest").flatten().to_pylist()):
            term = term[:shared] + rest
            leaf.append(terms.setdefault(term, len(terms)))
        leaf = np.array(leaf, dtype=np.int64)
        lists = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        names = np.array([self.sources.setdefault(s, len(self.sources)) for s in batch.column("sources").flatten().to_pylist()], dtype=np.int64)
        widths = pa.compute.list_value_length(batch.column("sources")).to_numpy()
        first = np.repeat(np.cumsum(widths) - widths, pa.compute.list_value_length(batch.column("source")).to_numpy())
        for held, new in ((self.leaf, leaf), (self.docs, lists("docs")), (self.owner, np.repeat(leaf, lists("size"))), (self.source, names[first + lists("source")]), (self.count, lists("count"))):
            held.append(new)

    def trie(self, least: int) -> Trie:
        trie, n = Trie(), len(self.sources)
        docs = np.zeros(len(self.terms), dtype=np.int64)
        np.add.at(docs, np.concatenate(self.leaf), np.concatenate(self.docs))
        owner = np.concatenate(self.owner)
        kept = docs[owner] >= least
        cells, cell = np.unique(owner[kept] * n + np.concatenate(self.source)[kept], return_inverse=True)
        counts = np.zeros(len(cells), dtype=np.int64)
        np.add.at(counts, cell, np.concatenate(self.count)[kept])
        terms, sources = list(self.terms), list(self.sources)
        for at, count in zip(cells.tolist(), counts.tolist()):
            trie.leaf(terms[at // n]).counts[sources[at % n]] = count
        for term, leaf in trie.known.items():
            leaf.docs = int(docs[self.terms[term]])
        return trie


def _shared(label: bytes, term: bytes, at: int) -> int:
    """How many bytes label and term from a place on have in common at their beginning."""
    same = 0
    while same < min(len(label), len(term) - at) and label[same] == term[at + same]:
        same += 1
    return same


def leaves(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, int, list[tuple[str, int]]]]:
    """Each term of pieces with its row, documents and counts by source; in the order of bytes in each piece."""
    flat = {c: batch.column(c).flatten().to_pylist() for c in ("shared", "rest", "docs", "size", "source", "count")}
    entries, at = zip(flat["shared"], flat["rest"], flat["docs"], flat["size"]), 0
    for row, (n, sources) in enumerate(zip(batch.column("leaves").to_pylist(), batch.column("sources").to_pylist())):
        term = b""
        for _ in range(n):
            shared, rest, docs, size = next(entries)
            term = term[:shared] + rest
            yield row, term, docs, [(sources[s], c) for s, c in zip(flat["source"][at : at + size], flat["count"][at : at + size])]
            at += size


def _rows(cut: Iterator[tuple], most: int = 50_000, totals: bool = False) -> Iterator[pa.RecordBatch]:
    """Leaves that follow each other, as pieces, in record batches of some leaves each; with the sums by source if wanted."""
    pieces, ends, number = [], [0], {}
    flat: dict[str, list] = {c: [] for c in ("shared", "rest", "docs", "size", "source", "count")}
    heads: dict[str, list] = {"sources": [], "totals": []}

    def closed() -> None:
        if len(flat["shared"]) > ends[-1]:
            ends.append(len(flat["shared"]))
            heads["sources"].append(list(number))
            if totals:
                sums = np.zeros(len(number), dtype=np.int64)
                np.add.at(sums, flat["source"][starts[-1] :], flat["count"][starts[-1] :])
                heads["totals"].append(sums.tolist())
            number.clear()
            starts.append(len(flat["source"]))

    def batch() -> pa.RecordBatch:
        lists = lambda c, kind, of: pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(flat[c], kind))
        columns = [
            pa.array([p[0] for p in pieces], pa.string()),
            pa.array([p[1] for p in pieces], pa.binary()),
            pa.array(np.diff(ends), pa.int32()),
            pa.array(heads["sources"], pa.list_(pa.string())),
            *(lists(c, PIECE_ARROW.field(c).type.value_type, ends) for c in ("shared", "rest", "docs", "size")),
            *(lists(c, PIECE_ARROW.field(c).type.value_type, starts) for c in ("source", "count")),
        ]
        names = PIECE_ARROW.names
        if totals:
            columns, names = [*columns, pa.array(heads["totals"], pa.list_(pa.int64()))], [*names, "totals"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    starts = [0]
    add_shared, add_rest, add_docs, add_size, add_source, add_count = (held.append for held in flat.values())
    for lang, prefix, shared, rest, docs, counts in cut:
        if not pieces or pieces[-1] != (lang, prefix):
            closed()
            if len(flat["shared"]) >= most:
                yield batch()
                pieces, ends, starts = [], [0], [0]
                for held in (*flat.values(), *heads.values()):
                    held.clear()
            pieces.append((lang, prefix))
        add_shared(shared)
        add_rest(rest)
        add_docs(docs)
        add_size(len(counts))
        for source, n in counts.items():
            add_source(number.setdefault(source, len(number)))
            add_count(n)
    closed()
    if pieces:
        yield batch()


def counted(documents: DataFrame) -> DataFrame:
    """The tries of each partition of (text, lang, source), as pieces."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        for batch in batches:
            for row, (text, lang, source) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                trie = tries.get(lang) or tries.setdefault(lang, Trie())
                known, leaf = trie.known, trie.leaf
                for term, n in Counter(text.encode().translate(TERM_TABLE).split()).items():
                    node = known.get(term) or leaf(term)
                    node.docs += 1
                    held = node.counts
                    held[source] = held.get(source, 0) + n
                if row % 200 == 0 and sum(len(t.known) for t in tries.values()) >= BUFFER:
                    yield from _rows(x for of, t in tries.items() for x in t.cut(of, DEPTH))
                    tries.clear()
        yield from _rows(x for of, t in tries.items() for x in t.cut(of, DEPTH))

    return documents.select("text", "lang", "source").mapInArrow(step, PIECE)


def _deeper(pieces: DataFrame, depth: int) -> DataFrame:
    """pieces cut by longer prefixes."""

    def cut(batch: pa.RecordBatch) -> Iterator[tuple]:
        langs, before, last = batch.column("lang").to_pylist(), None, b""
        for row, term, docs, counts in leaves(batch):
            shared = _shared(last, term, 0) if (row, term[:depth]) == before else 0
            before, last = (row, term[:depth]), term
            yield langs[row], term[:depth], shared, term[shared:], docs, dict(counts)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _rows(cut(batch.slice(row, 1)))

    return pieces.mapInArrow(step, PIECE)


def in_ranges(pieces: DataFrame) -> DataFrame:
    """A written table of pieces, cut so that those of one prefix have at most RANGE leaves, or one term."""
    depth = DEPTH
    while True:
        sizes = pieces.groupBy("lang", "prefix").agg(F.sum("leaves").alias("total"), F.max("leaves").alias("most"))
        large = materialise(sizes.where((F.col("total") > RANGE) & (F.col("most") > 1)).select("lang", "prefix"), "trie-large")
        if large.isEmpty():
            drop_scratch(large)
            return pieces
        depth *= 2
        cut = _deeper(pieces.join(large, ["lang", "prefix"], "left_semi").select(pieces.columns), depth)
        pieces = materialise(pieces.join(large, ["lang", "prefix"], "left_anti").select(pieces.columns).unionByName(cut), "trie-pieces")


def merged(pieces: DataFrame, least_docs: int) -> DataFrame:
    """The merged trie of each language and prefix, of terms in at least so many documents, with its sums by source."""
    def step(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, lang, prefix = Merger(), None, b""
        for batch in group:
            lang, prefix = batch.column("lang")[0].as_py(), batch.column("prefix")[0].as_py()
            merger.add(batch)
        yield from _rows(merger.trie(least_docs).cut(lang, len(prefix), least_docs), totals=True)

    return pieces.groupBy("lang", "prefix").applyInArrow(step, PIECE + ", totals array<long>")


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / total), by long division in two steps."""
    first, rest = np.divmod((count + 2) * 31_250, total)
    return 1 + first * 32_000 + rest * 32_000 // total


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def compared(tries: DataFrame, k: int) -> DataFrame:
    """(lang, source, part, item, value) of tries with their language's sources, sizes and vocabulary.

    Sums of pairs are those of a partition, to be added up; terms are the k best of a partition for each source.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        names: dict[str, list[str]] = {}
        best: dict[tuple[str, int], list[tuple[int, bytes]]] = defaultdict(list)  # negative value and term: sorts as asked for

        def compare(lang: str, terms: list[bytes], count: np.ndarray, of_source: np.ndarray, vocabulary: int) -> None:
            total = of_source + 2 * vocabulary
            p = shares(count, total)
            q = shares(count.sum(axis=1), of_source.sum() + 2 * vocabulary)
            for g in range(len(of_source) - 1):
                sums[lang][g, g + 1 :] += difference(p[:, g : g + 1], p[:, g + 1 :]).sum(axis=0)
            for g in range(len(of_source)):
                value = difference(p[:, g], q)
                there = np.flatnonzero((count[:, g] > 0) & (p[:, g] > q))
                top = there[np.argsort(-value[there], kind="stable")[:k]]
                if len(top):
                    best[lang, g] = sorted(best[lang, g] + [(-int(value[t]), terms[t]) for t in top])[:k]

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, found in sums.items():
                rows = [(names[lang][g], "pair", names[lang][h], int(found[min(g, h), max(g, h)])) for g in range(len(found)) for h in range(len(found)) if g != h]
                rows += [(names[lang][g], "term", term.decode(), -value) for (of, g), held in best.items() if of == lang for value, term in held]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["lang", "source", "part", "item", "value"]
                )
            sums.clear()
            best.clear()

        for batch in batches:
            for k_row in range(batch.num_rows):
                piece = batch.slice(k_row, 1)
                row = piece.select(["lang", "leaves", "all_sources", "all_totals", "vocabulary"]).to_pylist()[0]
                lang, names[row["lang"]] = row["lang"], row["all_sources"]
                if lang not in sums:
                    if len(sums) >= 50:
                        yield from sent()
                    sums[lang] = np.zeros((len(row["all_sources"]),) * 2, dtype=np.int64)
                of_source = np.array(row["all_totals"], dtype=np.int64)
                number = {s: g for g, s in enumerate(row["all_sources"])}
                terms, most = [], max(1, CELLS // len(number))
                count = np.zeros((min(most, row["leaves"]), len(number)), dtype=np.int64)
                for _, term, _, counts in leaves(piece):
                    for s, n in counts:
                        count[len(terms), number[s]] = n
                    terms.append(term)
                    if len(terms) == most:
                        compare(lang, terms, count, of_source, row["vocabulary"])
                        terms, count = [], np.zeros_like(count)
                if terms:
                    compare(lang, terms, count[: len(terms)], of_source, row["vocabulary"])
        yield from sent()

    return tries.mapInArrow(step, "lang string, source string, part string, item string, value long")


def audit(documents: DataFrame, least_docs: int = 10, k: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the language's others, and its k most telling terms."""
    given = documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = given.select("lang", "source").distinct()
    pieces = in_ranges(materialise(counted(given), "trie-pieces"))
    tries = materialise(merged(pieces, least_docs), "trie-merged")
    sums = tries.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    sized = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    entry = F.sort_array(F.collect_list(F.struct("source", "total")))
    stats = sized.groupBy("lang").agg(entry.alias("entry")).join(tries.groupBy("lang").agg(F.sum("leaves").alias("vocabulary")), "lang", "left")
    stats = materialise(stats.select("lang", F.col("entry.source").alias("all_sources"), F.col("entry.total").alias("all_totals"), "vocabulary"), "trie-totals")
    found = materialise(compared(tries.join(stats, "lang"), k), "trie-compared")

    pairs = stats.select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item")).where("source <> item")
    summed = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= k))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), 10, 10)


OP13_SQL = r"""
WITH doc AS (
    SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
occurring AS (SELECT DISTINCT lang, source FROM doc),
found AS (SELECT place, lang, source, term, count(*) AS n FROM (SELECT place, lang, source, unnest(terms) AS term FROM doc) GROUP BY ALL),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(*) >= 10),
vocabulary AS (SELECT lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM doc) LEFT JOIN kept USING (lang) GROUP BY lang),
cell AS (
    SELECT o.lang, o.source, k.term, coalesce(sum(f.n), 0)::HUGEINT AS n
    FROM occurring o JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = o.lang AND f.source = o.source AND f.term = k.term GROUP BY ALL
),
share AS (
    SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 2)) // ((sum(c.n) OVER (PARTITION BY c.lang, c.source))::HUGEINT + 2 * v) AS p,
           1 + (1000000000 * ((sum(c.n) OVER (PARTITION BY c.lang, c.term))::HUGEINT + 2)) // ((sum(c.n) OVER (PARTITION BY c.lang))::HUGEINT + 2 * v) AS q
    FROM cell c JOIN vocabulary USING (lang)
),
pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT l.lang, l.source, r.source AS other, sum(((l.p - r.p) * (l.p - r.p)) // (l.p + r.p)) AS value
        FROM share l JOIN share r ON l.lang = r.lang AND l.term = r.term AND l.source <> r.source GROUP BY ALL
    ) x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM share WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
