"""Line dedup: explode normalised lines, hash them, count documents per hash, drop lines over the threshold, reassemble.

Lines are exploded with their positions and hashed; distinct documents are counted per hash in two steps, first by hash
and document and then by hash, so a line that a third of all documents hold is one row per task in the second. Lines of
repeated hashes come back to their rows as positions, and each row's other lines are put together in order of position.
A row is known by its id and a hash of its text. All of it is DataFrame functions, and its work is linear in lines.

Edge cases: null or empty text is one empty line; a row without an id keeps its lines and counts for no other document;
rows that repeat an id are one document for counting and lose the same lines; other columns are kept by ``dedup`` and
ignored by the query; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import SPACE, ascii_lower, materialise, table

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line) -> F.Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_hash(key) -> F.Column:
    """128 bits, as two numbers whose seeds differ."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def lines_of(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """documents with __line_doc, __line_row and __line_all (null for null text) in place of text."""
    text = F.col(text_col)
    return documents.withColumns({"__line_doc": F.col(id_col), "__line_row": F.xxhash64(text), "__line_all": F.split(text, "\n", -1)}).drop(text_col)


def dropped_positions(lined: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(__lost_doc, __lost_row, __line_lost): for each row of ``with_lines`` that loses lines, their positions from 0."""
    placed = lined.where("__line_doc is not null").select(F.col("__line_doc").alias("doc"), F.col("__line_row").alias("row"), F.posexplode(F.transform("__line_all", line_key)).alias("pos", "key"))
    placed = placed.where(F.char_length("key") >= min_chars).select("doc", "row", "pos", line_hash(F.col("key")).alias("h"))
    placed = materialise(placed.select("doc", "row", "pos", "h.a", "h.b"), "lines")
    counted = placed.groupBy("a", "b").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("first")).where(F.col("n") >= min_docs)
    repeated = materialise(counted.select("a", "b", "first"), "repeated-lines")  # a plain table, so Spark can split hot lines
    lost = placed.join(repeated, ["a", "b"]).where(F.col("doc") > F.col("first"))
    return lost.groupBy(F.col("doc").alias("__lost_doc"), F.col("row").alias("__lost_row")).agg(F.collect_set("pos").alias("__line_lost"))


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """documents with struct column ``line_dedup``: n_lines (before), n_dropped, kept (the text that is left)."""
    lined = with_lines(documents, id_col, text_col)
    lost = dropped_positions(lined, min_chars, min_docs)
    joined = lined.join(lost, (F.col("__line_doc") == F.col("__lost_doc")) & (F.col("__line_row") == F.col("__lost_row")), "left")
    lines = F.coalesce("__line_all", F.array(F.lit("")))
    # positions that stay, in order; array_except is linear
    stay = F.array_except(F.sequence(F.lit(0), F.size("__line_all") - 1), F.col("__line_lost"))
    kept = F.when(F.col("__line_lost").isNull(), lines).otherwise(F.transform(stay, lambda i: F.get("__line_all", i)))
    n, gone = F.size(lines).cast("long"), F.when(F.col("__line_lost").isNull(), 0).otherwise(F.size("__line_lost")).cast("long")
    result = F.struct(n.alias("n_lines"), gone.alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))
    return joined.select(*[F.array_join("__line_all", "\n").alias(c) if c == text_col else F.col(c) for c in documents.columns], result.alias("line_dedup"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.encode("line_dedup.kept", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, key FROM (
    SELECT doc_id, pos, line,
      translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents))),
repeated AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.first AS dropped
  FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
