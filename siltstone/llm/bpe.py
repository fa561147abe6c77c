"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database in each Spark task.

A partition's texts are split into pieces by the pattern; each distinct piece that the worker has not met becomes rows
(piece, position, token), one a byte. A recursive query joins neighbours with the merge table and contracts every piece's
leftmost pair of least rank, until no pair of any piece is in the table. Ordered aggregation then puts the pieces' ids
together for each text, and decodes ids: each (text, position, id) row joins the vocabulary, bytes follow in order.

A piece that is itself in the vocabulary is its id. Pieces longer than ``LONG`` bytes first are cut between bytes that no
token holds side by side, which no merge can cross; the recursive query for them takes all pairs of the least rank at
once, a bounded number of steps at a time. That is the same as the leftmost one by one if no token has a lower rank than
the two that make it, which is checked for the vocabulary; else this query takes the leftmost alone too.

The pattern's classes are those of tiktoken's own regular expressions: they are read off that library, so both know the
same release of Unicode. DuckDB has no look-ahead, so a mark, a character that no text of the batch holds, is put before
the last blank of a run that a word follows.

Edge cases: null and empty text have no ids and decode to nothing; null ids decode to nothing; null or repeated row ids
are kept, each row by itself; other columns stay, those named like results are replaced; a null or unknown id in what is
to be decoded is an error. A task holds one slice of texts (``SLICE`` characters, or a longer text without a place to cut it) and up to ``KNOWN``
remembered pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import table

#: Characters of text, or ids, that are worked on at once; the last text may go over it.
SLICE = 2_000_000
#: Pieces that go into one recursive query, and pieces that a worker remembers; a full memory is emptied.
AT_ONCE, KNOWN = 25_000, 1_200_000
#: Bytes from which a piece is cut and contracted by rank instead of pair by pair.
LONG = 96
#: What DuckDB may take in a worker, besides a slice and its results.
MEMORY = "500MB"
NO_RANK = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks of a file with a base64 token and a rank in each line."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose contraction ends the encoding of token's own bytes; None if its bytes do not become it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, NO_RANK), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NO_RANK:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache
def class_of(pattern: str) -> str:
    """The characters that a one-character pattern of tiktoken's regular expressions matches, as ranges for a class."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    reader = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    codes = np.array(sorted({*map(ord, bytes(reader.encode_ordinary(every)).decode())}))
    starts = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
    ends = np.append(starts[1:], len(codes)) - 1
    return "".join(rf"\x{{{codes[a]:X}}}-\x{{{codes[b]:X}}}" for a, b in zip(starts, ends))


#: What the split pattern has to end with: blanks up to the one before a word, or to the end.
BLANKS = r"|\s+(?!\S)|\s+"


def split_pattern(pattern: str, mark: str) -> tuple[str, str]:
    """pattern without look-ahead for texts with mark in them, and the pattern of the place that mark goes to."""
    words = pattern.removesuffix(BLANKS)
    if words == pattern or "(?" in words or r"\S" in words:
        raise ValueError(f"the pattern has to end with {BLANKS} and have no other look-around")
    space = class_of(r"\s")
    at = rf"\x{{{ord(mark):X}}}"
    words = words.replace(r"[^\s\p{L}\p{N}]", "[^" + at + space + class_of(r"\p{L}") + class_of(r"\p{N}") + "]")
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        words = words.replace(name, f"[{class_of(name)}]")
    return rf"{words}|[{space}]+", rf"([{space}])([{space}][^{space}])"


# Contracts the leftmost pair of least rank in each piece of ``start`` (w, pos, tok); pieces without a pair drop out, so
# a piece's last rows are its tokens. The key holds piece and byte position, len the bytes of a token.
CONTRACT = """
WITH RECURSIVE state AS (
    SELECT (w::BIGINT << 32) | pos AS key, tok, 1 AS len, 0 AS step FROM start
    UNION ALL
    (WITH pair AS (
        SELECT l.key, l.tok, l.len, l.step, r.len AS next_len, m.rank
        FROM state l LEFT JOIN state r ON r.key = l.key + l.len LEFT JOIN merges m ON m.a = l.tok AND m.b = r.tok
    ), least AS (
        SELECT key >> 32 AS w, min(rank) AS rank, arg_min(key, (rank::BIGINT << 32) | (key & 4294967295)) AS spot,
               arg_min(len, (rank::BIGINT << 32) | (key & 4294967295)) AS len
        FROM pair WHERE rank IS NOT NULL GROUP BY 1
    )
    SELECT p.key, CASE WHEN p.key = spot THEN least.rank ELSE p.tok END, CASE WHEN p.key = spot THEN p.len + p.next_len ELSE p.len END, p.step + 1
    FROM pair p JOIN least ON p.key >> 32 = least.w
    WHERE p.key <> spot + least.len)
)
SELECT (key >> 32)::INT AS w, list(tok ORDER BY key) AS ids
FROM state JOIN (SELECT key >> 32 AS piece, max(step) AS last FROM state GROUP BY 1) ON key >> 32 = piece AND step = last GROUP BY 1
"""

# The same for long pieces: all pairs of the piece's least rank at once. Where the same token stands many times in a row,
# pairs overlap; every second one of such a chain is taken. Stops after some steps, and goes on from what it returned.
CONTRACT_BY_RANK = """
WITH RECURSIVE state AS (
    SELECT (w::BIGINT << 32) | pos AS key, tok, len, 0 AS step FROM start
    UNION ALL
    (WITH pair AS (
        SELECT l.key, l.len, r.len AS next_len, m.rank FROM state l JOIN state r ON r.key = l.key + l.len JOIN merges m ON m.a = l.tok AND m.b = r.tok
    ), least AS (
        SELECT *, lag(key + len) OVER chain AS before, row_number() OVER chain AS n
        FROM (SELECT *, min(rank) OVER (PARTITION BY key >> 32) AS low FROM pair) WHERE rank = low
        WINDOW chain AS (PARTITION BY key >> 32 ORDER BY key)
    ), taken AS (
        SELECT * FROM (SELECT *, n - max(CASE WHEN before = key THEN 0 ELSE n END) OVER (PARTITION BY key >> 32 ORDER BY key) AS link FROM least) WHERE {which}
    )
    SELECT s.key, coalesce(t.rank, s.tok), s.len + coalesce(t.next_len, 0), s.step + 1
    FROM state s LEFT JOIN taken t USING (key)
    WHERE s.step < {steps} AND s.key >> 32 IN (SELECT key >> 32 FROM taken) AND s.key NOT IN (SELECT key + len FROM taken))
)
SELECT (key >> 32)::INT AS w, key & 4294967295 AS pos, tok, len, step FROM (SELECT *, max(step) OVER (PARTITION BY key >> 32) AS last FROM state) WHERE step = last
"""
#: Rows that the steps of one query for long pieces make.
STEP_ROWS = 2_000_000


def cut_text(text: str) -> list[str]:
    """text in parts of up to SLICE characters, cut before a single blank between other characters, where a piece begins."""
    parts, start = [], 0
    while len(text) - start > SLICE:
        at = next((at for at in range(start + SLICE, start + 1, -1) if text[at] in " \n" and not text[at - 1].isspace() and not text[at + 1 : at + 2].isspace()), 0)
        if not at or at + 1 == len(text):
            break
        parts.append(text[start:at])
        start = at
    return [*parts, text[start:]]


class Codec:
    """A vocabulary in a DuckDB database of this process, with the pieces met so far."""

    _open: dict[tuple, Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str, classes: dict[str, str]) -> Codec:
        """One for each worker process and vocabulary, so that tasks share what is remembered."""
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern, classes)
        return cls._open[path, pattern]

    def __init__(self, path: str, pattern: str, classes: dict[str, str]):
        import duckdb

        ranks = read_ranks(path)
        merges = {t: pair for t in ranks if len(t) > 1 and (pair := last_merge(t, ranks))}
        self.by_rank = all(ranks[t] > max(ranks[a], ranks[b]) for t, (a, b) in merges.items())
        self.beside = {t[i : i + 2] for t in ranks for i in range(len(t) - 1)}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pattern, self.split = pattern, classes
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks, pa.binary()), "chars": [t.decode("latin-1") for t in ranks]})
        merged = pa.table({c: pa.array([ranks[x] for x in v], pa.int32()) for c, v in (("a", [p[0] for p in merges.values()]), ("b", [p[1] for p in merges.values()]), ("rank", merges))})
        self._keep("vocabulary", vocabulary)
        self._keep("merges", merged)
        self.db.execute("CREATE TABLE known (w VARCHAR, ids INT[])")
        self.size = 0

    def _keep(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _mark(self, texts: pa.Array) -> str:
        """A character that is in no text: of the first ones that Unicode gives to nobody, else any."""
        for code in (0xFDD0, 0xFDD1, 0xFDD2):
            if not pa.compute.any(pa.compute.match_substring(texts, chr(code))).as_py():
                return chr(code)
        held = set().union(*texts.to_pylist())
        return next(chr(c) for c in (*range(0xF0000, 0x110000), *range(0xE000, 0xF900)) if chr(c) not in held)

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as lists in the order of texts."""
        return self._in_slices(texts.cast(pa.string()).fill_null(""), pa.compute.utf8_length, cut_text, self._encode, pa.list_(pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes that each list of ids stands for."""
        cut = lambda x: [x[at : at + SLICE] for at in range(0, len(x), SLICE)]
        return self._in_slices(ids, pa.compute.list_value_length, cut, self._decode, pa.binary())

    @staticmethod
    def _in_slices(values: pa.Array, measure, cut, work, kind: pa.DataType) -> pa.Array:
        """work on values, or if they measure more than a slice one by one, on what cut makes of a longer one in turn."""
        sizes = measure(values).fill_null(0).to_numpy(zero_copy_only=False)
        if sizes.sum() <= SLICE:
            return work(values)
        out = []
        for size, value in zip(sizes, values.to_pylist()):
            made = [work(pa.array([part], values.type))[0].as_py() for part in (cut(value) if size > SLICE else [value])]
            out.append(made[0] if len(made) == 1 else [x for part in made for x in part] if pa.types.is_list(kind) else b"".join(made))
        return pa.array(out, kind)

    def _encode(self, texts: pa.Array) -> pa.Array:
        mark = self._mark(texts)
        split, place = self.split.get(mark) or split_pattern(self.pattern, mark)
        self._keep("texts", pa.table({"row": pa.array(np.arange(len(texts), dtype=np.int32)), "text": texts}))
        self.db.execute(
            """CREATE OR REPLACE TEMP TABLE pieces AS SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1)::INT AS i FROM (
            SELECT row, regexp_extract_all(CASE WHEN regexp_matches(text, $2) THEN regexp_replace(text, $2, $3, 'g') ELSE text END, $1) AS ws FROM texts)""",
            [split, place, rf"\1{mark}\2"],
        )
        self.db.execute(
            """CREATE OR REPLACE TEMP TABLE met AS SELECT w, CASE WHEN v.id IS NULL THEN k.ids ELSE [v.id] END AS ids
            FROM (SELECT DISTINCT w FROM pieces) LEFT JOIN known k USING (w) LEFT JOIN vocabulary v ON v.token = encode(w)"""
        )
        self.db.execute("CREATE OR REPLACE TEMP TABLE learned (w VARCHAR, ids INT[])")
        new = self.db.sql("SELECT w FROM met WHERE ids IS NULL").to_arrow_table().column("w")
        for at in range(0, len(new), AT_ONCE):
            self._learn(new.slice(at, AT_ONCE).combine_chunks())
        found = self.db.sql(
            """SELECT row, ids FROM texts LEFT JOIN (
                SELECT row, flatten(list(ids ORDER BY i)) AS ids FROM pieces JOIN (FROM met WHERE ids IS NOT NULL UNION ALL FROM learned) USING (w) GROUP BY row
            ) USING (row) ORDER BY row"""
        ).to_arrow_table()
        self.size += len(new)
        if self.size > KNOWN:
            self.db.execute("DELETE FROM known")
            self.size = len(new)
        self.db.execute("INSERT INTO known FROM learned")
        lists = found.column("ids").combine_chunks()
        return lists if lists.null_count == 0 else pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))

    def _learn(self, words: pa.Array) -> None:
        """Encode new pieces and remember them."""
        raw = [w.encode() for w in words.to_pylist()]
        if short := [k for k, w in enumerate(raw) if len(w) <= LONG]:
            self._start([raw[k] for k in short])
            self._keep("owners", pa.table({"part": np.arange(len(short), dtype=np.int32), "word": words.take(pa.array(short))}))
            self.db.execute(f"INSERT INTO learned SELECT word, ids FROM ({CONTRACT}) JOIN owners ON part = w")
        for k, w in enumerate(raw):
            if len(w) > LONG:
                cuts = [0, *(i for i in range(1, len(w)) if w[i - 1 : i + 1] not in self.beside), len(w)]
                self._start([w[a:b] for a, b in zip(cuts, cuts[1:])])
                contracted = 1
                while contracted:
                    rows = self.db.sql("SELECT count(*) FROM start").fetchall()[0][0]
                    query = CONTRACT_BY_RANK.format(which="link % 2 = 0" if self.by_rank else "n = 1", steps=max(1, STEP_ROWS // rows))
                    self.db.execute(f"CREATE OR REPLACE TEMP TABLE later AS {query}")
                    self.db.execute("CREATE OR REPLACE TEMP TABLE start AS SELECT w, pos, tok, len FROM later")
                    contracted = self.db.sql("SELECT max(step) FROM later").fetchall()[0][0]
                self.db.execute("INSERT INTO learned SELECT $1, list(tok ORDER BY w, pos) FROM start", [w.decode()])

    def _start(self, parts: list[bytes]) -> None:
        """Rows (w, pos, tok, len), one for each byte of parts."""
        sizes = np.array([len(p) for p in parts])
        place = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tok = self.single[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        self._keep("start", pa.table({"w": place, "pos": pa.array(pos.astype(np.int64)), "tok": tok, "len": np.ones(len(tok), dtype=np.int32)}))

    def _decode(self, ids: pa.Array) -> pa.Array:
        self._keep("coded", pa.table({"row": pa.array(np.arange(len(ids), dtype=np.int32)), "ids": ids}))
        # a character of Latin-1 stands for a byte, so bytes are put together as text
        found = self.db.sql(
            """SELECT row, n, chars FROM coded LEFT JOIN (
                SELECT row, count(*) AS n, string_agg(chars, '' ORDER BY i) AS chars
                FROM (SELECT row, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM coded) JOIN vocabulary USING (id) GROUP BY row) USING (row) ORDER BY row"""
        ).to_arrow_table()
        wanted = pa.compute.sum(pa.compute.list_value_length(ids)).as_py() or 0
        if (pa.compute.sum(found.column("n")).as_py() or 0) != wanted:
            raise ValueError("an id is not in the vocabulary")
        return pa.array([(x or "").encode("latin-1") for x in found.column("chars").to_pylist()], pa.binary())


def _slices(batch: pa.RecordBatch, column: str, measure) -> Iterator[pa.RecordBatch]:
    """batch in pieces whose column measures up to SLICE, or has one row."""
    sizes = measure(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for row, size in enumerate(sizes):
        if total and total + size > SLICE:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def _mapped(df: DataFrame, source: str, results: dict[str, T.DataType], measure: str, path: str, pattern: str, work) -> DataFrame:
    """df with results, a name's values by work(codec, values of source); columns that bear a result's name go."""
    columns = [c for c in df.columns if c not in results]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField(c, t) for c, t in results.items()])
    classes = {mark: split_pattern(pattern, mark) for mark in map(chr, (0xFDD0, 0xFDD1, 0xFDD2))}
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.col(f"`{source}`").alias("given"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern, classes)
        for batch in batches:
            for part in _slices(batch, "given", getattr(pa.compute, measure)):
                made = work(codec, part.column("given"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *results])

    inner_schema = T.StructType([T.StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(columns)] + [T.StructField(c, t) for c, t in results.items()])
    return inner.mapInArrow(step, inner_schema).toDF(*schema.names)


IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each row's text."""
    return _mapped(df, text, {ids: IDS}, "utf8_length", path, pattern, lambda codec, texts: [codec.encode(texts)])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", content: str = "content") -> DataFrame:
    """df with the bytes that each row's ids stand for."""
    return _mapped(df, ids, {content: T.BinaryType()}, "list_value_length", path, pattern, lambda codec, lists: [codec.decode(lists)])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", content: str = "content") -> DataFrame:
    """df with the ids of each row's text and the bytes that these ids decode to, in one pass."""

    def both(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        made = codec.encode(texts)
        return [made, codec.decode(made)]

    return _mapped(df, text, {ids: IDS, content: T.BinaryType()}, "utf8_length", path, pattern, both)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )
