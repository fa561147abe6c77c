"""Token counts as delta-maintained rollups.

A change of a document has the group and count before it and after it: an insert has no before, a delete no after, a
revision both. Each side is a signed delta, -1 or +1 document and its tokens, so totals by source, language and
tokenizer version are sums of deltas, whatever their order. A batch is committed once: its summed deltas are written to
a folder named by the batch, which counts from when its marker file is made. Committing a batch again does nothing; one
that was cut off is written anew.

The totals themselves are maintained: ``fold`` adds the committed batches to the last snapshot of the totals and writes
the next one, whose marker file lists the batches it took in; only then are their folders cleared away, so a fold that
was cut off is finished or done again without counting anything twice. ``commit`` folds whenever ``FOLD_AT`` batches are
pending, so reading totals takes one snapshot and a bounded number of small batches, however many there have been. There
is one writer at a time.

Edge cases: null text has the tokens of empty text; null source or lang is a group of its own; rows that repeat an id
are counted each; groups whose documents have all gone leave no row; an empty batch commits no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contract_words
from .support import byte_words, materialise, scratch_path, table
from .wordcache import CachedTokenizer

GROUP = ("source", "lang", "tokenizer_version")
DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


FOLD_AT = 64
MARKER = "_committed"


class TokenRollup:
    """Totals in the folder path, which any store of Spark's can hold.

    ``pending/<batch>`` has a batch's deltas, ``snapshots/<number>`` the totals after a fold; both count once they have a
    marker. ``done/<batch>`` is the name of a batch whose deltas a snapshot holds.
    """

    def __init__(self, spark: SparkSession, path: str, fold_at: int = FOLD_AT):
        self.spark, self.path, self.fold_at = spark, path.rstrip("/"), fold_at

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, fs = self._fs(path)
        return fs.exists(at)

    def _names(self, path: str) -> list[str]:
        at, fs = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _mark(self, path: str, content: str = "") -> None:
        at, fs = self._fs(path)
        out = fs.create(at, True)
        out.write(bytearray(content.encode()))
        out.close()

    def _content(self, path: str) -> str:
        at, fs = self._fs(path)
        stream = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _delete(self, path: str) -> None:
        at, fs = self._fs(path)
        fs.delete(at, True)

    def committed(self, batch: str) -> bool:
        return self._exists(f"pending/{batch}/{MARKER}") or self._exists(f"done/{batch}")

    def batches(self) -> list[str]:
        """The names of all committed batches."""
        return sorted({*self._names("done"), *self.pending()[1], *self.pending()[2]})

    def pending(self) -> tuple[str | None, list[str], list[str]]:
        """The last snapshot, the batches that it took in last, and those that it has not taken in."""
        made = [s for s in self._names("snapshots") if self._exists(f"snapshots/{s}/{MARKER}")]
        last = max(made, key=int, default=None)
        taken = self._content(f"snapshots/{last}/{MARKER}").split() if last else []
        waiting = [b for b in self._names("pending") if b not in set(taken) and self._exists(f"pending/{b}/{MARKER}")]
        return last, taken, waiting

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add changes (before struct, after struct, each of GROUP and n_tokens or null) under the batch's name; whether it was new."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError("a batch is named by letters, digits and _ . -")
        if self.committed(batch):
            return False
        sides = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("x")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("x"))))
        signed = changes.select(sides.alias("d")).where("d.x is not null").select("d.sign", "d.x.*")
        summed = signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(f"{self.path}/pending/{batch}")
        self._mark(f"pending/{batch}/{MARKER}")
        if len(self.pending()[2]) >= self.fold_at:
            self.fold()
        return True

    def _clear(self, last: str | None, taken: list[str]) -> None:
        """Finish what a fold leaves to do once its snapshot counts."""
        for batch in taken:
            self._mark(f"done/{batch}")
            self._delete(f"pending/{batch}")
        for old in self._names("snapshots"):
            if last and int(old) < int(last):
                self._delete(f"snapshots/{old}")

    def fold(self) -> int:
        """Add the pending batches to the snapshot of the totals; how many there were."""
        last, taken, waiting = self.pending()
        self._clear(last, taken)
        if waiting:
            number = str(int(last or 0) + 1)
            self._totals(last, waiting).write.mode("overwrite").parquet(f"{self.path}/snapshots/{number}")
            self._mark(f"snapshots/{number}/{MARKER}", "\n".join(waiting))
            self._clear(number, waiting)
        return len(waiting)

    def _totals(self, last: str | None, waiting: list[str]) -> DataFrame:
        parts = [f"{self.path}/pending/{b}" for b in waiting] + ([f"{self.path}/snapshots/{last}"] if last else [])
        if not parts:
            return self.spark.createDataFrame([], DELTAS)
        summed = self.spark.read.schema(DELTAS).parquet(*parts).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        last, _, waiting = self.pending()
        return self._totals(last, waiting)


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(None).cast(_STATE).alias("before"), _state().alias("after"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(_state().alias("before"), F.lit(None).cast(_STATE).alias("after"))


_STATE = "struct<source:string,lang:string,tokenizer_version:string,n_tokens:bigint>"


def _state(count: str = "n_tokens") -> F.Column:
    return F.struct(*GROUP, F.col(count).cast("long").alias("n_tokens"))


def revisions(rows: DataFrame, count: str) -> DataFrame:
    """rows whose n_tokens becomes their column count."""
    return rows.select(_state().alias("before"), _state(count).alias("after"))


def token_counts(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """documents' (doc_id, source, lang, digest) with counts: of the tokenizer, of blank-separated words, of words of letters and digits."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = CachedTokenizer.of(tokenizer_path).encode_bytes
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [[len(encode(t)) // 4 for t in texts], [len(byte_words(t)) for t in texts], [len(contract_words(t)) for t in texts]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "digest")), *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", "source", "lang", "digest", "bpe", "words", "terms"])

    columns = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text", F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)).alias("digest"))
    return columns.mapInArrow(count, "doc_id long, source string, lang string, digest binary, bpe long, words long, terms long")


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents.

    ``load`` inserts every document under two tokenizer versions; it is committed twice, as a retry would. ``terms``
    revises the word counts to words of letters and digits. These two are folded into a snapshot. ``copies`` deletes each
    document whose text an earlier one has.
    """
    counts = materialise(token_counts(table(spark, sf_dir, "documents")), "token-counts")
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    two = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(first).alias("n_tokens"), F.col(then).alias("then")) for v, first, then in (("word_bpe_49k", "bpe", "bpe"), ("words", "words", "terms"))]))
    rows = counts.select("doc_id", "source", "lang", "digest", two.alias("v")).select("doc_id", "source", "lang", "digest", "v.*")
    for _ in range(2):
        rollup.commit("load", inserts(rows))
    rollup.commit("terms", revisions(rows.where("tokenizer_version = 'words'"), "then"))
    rollup.fold()
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    first = materialise(first, "first-copies")  # a plain table, so Spark can split the rows of a text with many copies
    gone = counts.join(first, "digest").where("doc_id > first")
    copies = gone.select("source", "lang", two.alias("v")).select("source", "lang", "v.*").withColumn("n_tokens", F.col("then"))
    rollup.commit("copies", deletes(copies))
    return rollup.totals()
