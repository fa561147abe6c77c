"""WARC archives of individually compressed records with a dictionary of their own.

Each archive is one partition. Its task builds a Zstandard dictionary from the records of the archive, and writes the
dictionary in a leading skippable frame, then a frame for each record. It learns from all records up to ``TRAIN_BYTES``,
which is several times an archive's size, and writes the rest as they come; so its memory is bounded whatever the rows.
Spark's text writer puts the frames into a file: its line separator is an empty skippable frame, so every file is a valid
run of frames, and a lost executor's task is simply written again by Spark's commit protocol. Any store that Spark can
write to will do.

Equal payloads of at least ``min_bytes`` are written once, by the page with the smallest id; other pages revisit it.
Pages and revisits are dealt to archives by id and digest, which is also how they are joined, so payloads move once.

Edge cases: null html is an empty payload; a page without an id is always a response; rows that repeat a page's id and
payload are all responses if that id is the smallest, numbered apart in their record ids; a null url becomes an urn of
the page; other columns are ignored; an empty table writes no record and reads none. Where many rows are alike in id and
payload, they are dealt to archives in parts, and numbered apart in each.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import materialise, scratch_path, table

MIN_BYTES = 100
#: Bytes of an archive's records, on average.
ARCHIVE_BYTES = 16 << 20
#: Bytes of records that a dictionary is built from, and that a task holds, at most.
TRAIN_BYTES = 64 << 20
#: Bytes that a record takes besides its payload, about.
HEAD_BYTES = 512
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Rows alike in id and payload that go to one archive together; more are dealt out.
ALIKE = 256
DATE = "2024-01-01T00:00:00Z"
#: The magic number of a frame that holds a dictionary, and of the empty frame between records.
DICTIONARY_MAGIC, EMPTY_MAGIC = 0x184D2A5D, 0x184D2A50
EMPTY_FRAME = struct.pack("<II", EMPTY_MAGIC, 0)

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"


def plan_records(pages: DataFrame, min_bytes: int, archive_bytes: int, alike: int = ALIKE) -> tuple[DataFrame, int]:
    """Pages with their role, dealt out to archives, and how many archives there are.

    Rows are dealt by id and digest; of those that more than some rows share, by a part too, so they spread.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.length("payload").cast("long")})
    facts = materialise(sized.select("page_id", "digest", "bytes"), "page-digests")
    total = facts.agg(F.sum(F.col("bytes") + HEAD_BYTES)).first()[0] or 0
    archives = max(1, math.ceil(total / archive_bytes))
    large = facts.where(F.col("page_id").isNotNull() & (F.col("bytes") >= min_bytes))
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    first = materialise(first, "first-pages")  # a plain table, so Spark can split the pages of a payload with many copies
    revisits = large.join(first, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    copies = facts.groupBy("page_id", "digest").agg(F.count("*").alias("n")).where(F.col("n") > alike)
    many = materialise(copies.select(F.col("page_id").alias("of_id"), F.col("digest").alias("of_digest"), F.ceil(F.col("n") / alike).alias("parts")), "alike-pages")
    keys = ["page_id", "digest"]
    if not many.isEmpty():
        keys.append("part")
        of = lambda x: x.join(many, F.col("page_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
        part = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), "parts"), F.lit(0)).cast("int")
        sized = of(sized).withColumn("part", part).drop("of_id", "of_digest", "parts")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("int")))
        revisits = of(revisits).select("page_id", "digest", "refers_to", every.alias("part"))
    # both sides dealt alike by the join's keys, so the join needs no other exchange and each partition is an archive
    by = lambda rows: rows.repartition(archives, *keys)
    dealt = by(sized).join(by(revisits), keys, "left")
    return dealt.select("page_id", "url", "payload", "digest", "refers_to", F.col("part") if "part" in keys else F.lit(0).alias("part")), archives


def record_id(page_id: int | None, digest: str, number: int = 0, part: int = 0) -> str:
    """number counts rows alike in id and payload, from 0, in each of the parts that they are dealt out in."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}{f':{number}' if number or part else ''}{f':{part}' if part else ''}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, part: int = 0, number: int = 0) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "null" if page_id is None else str(page_id)
    target = (url or f"urn:page:{name}").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, number, part)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes], size: int):
    """A trained dictionary, or raw content of the records where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records, k=256, d=8, f=18, accel=4, level=LEVEL)
    except zstandard.ZstdError:
        content = b"".join(records)[-size:]
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _frames(dictionary_bytes: int, level: int, train_bytes: int):
    """An archive's frames from its rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seen: Counter = Counter()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = [c[k].as_py() for c in batch.columns]
                    alike = (row[0], row[3], row[5])
                    yield record(*row, seen[alike])
                    seen[alike] += 1

        def frame(parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["frame"])

        rest, held, size = records(), [], 0
        for made in rest:
            held.append(made)
            size += len(made)
            if size >= train_bytes:
                break
        if not held:
            return
        dictionary = dictionary_of(held, dictionary_bytes)
        raw = dictionary.as_bytes()
        yield frame([struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw])
        compress = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True).compress
        while held:
            for at in range(0, len(held), 256):
                yield frame([compress(r) for r in held[at : at + 256]])
            held = list(islice(rest, 256))

    return write


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL, train_bytes: int = TRAIN_BYTES) -> None:
    """Write (page_id, url, html) rows as archives into the folder path."""
    records, _ = plan_records(pages, min_bytes, archive_bytes)
    frames = records.mapInArrow(_frames(dictionary_bytes, level, train_bytes), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode()).text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary's frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    stream = io.BufferedReader(decompressor.stream_reader(memoryview(content)[8 + size :], read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"a record was expected, not {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


def _page(urn: str) -> int | None:
    name = urn[len("<urn:page:") : -1].split(":")[0]
    return None if name == "null" else int(name)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives in path; payload_ok is null for a revisit, else whether its digest holds."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for fields, block in parse_archive(content.as_py()) if len(content.as_py()) else ():
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest, revisit = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"] == "revisit"
                    whole = None if revisit else len(payload) == size and hashlib.sha256(payload).hexdigest() == digest
                    out.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields["warc-refers-to"]) if revisit else None, whole))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names=[x.split()[0] for x in RECORDS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    broken = F.raise_error(F.lit("a payload read back differs from its digest"))
    return records.select("page_id", "payload_bytes", F.when(F.coalesce("payload_ok", F.lit(True)), F.col("payload_digest")).otherwise(broken).alias("payload_digest"), "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
