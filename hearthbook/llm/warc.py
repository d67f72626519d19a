"""WARC archives without repeated payloads, written and read as Spark text with WARC's own separators.

Records are UTF-8 rows whose row separator is the CRLF CRLF that ends a record,
so Spark's text writer lays down valid WARC/1.1 files in any store.  Its reader
splits them at ``WARC/1.1 CRLF WARC-Type: ``, and blocks are cut by
Content-Length.  No start of that separator is the end of a record, so a read
buffer that ends anywhere misses none.  Records that hold it a second time go to
archives of their own, whose pieces are put together again by Content-Length, one
after another.

Only headers are shuffled by payload digest: per digest the record with the
largest id stays a response, the others become revisits of it.  A filter of the
revisits' ids, ``BITS`` bits whatever their number, then tells most responses
apart where they stand; only rows that hit it are shuffled to learn what they are.
"""

from __future__ import annotations

from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthbook.llm._store import Scratch

END, MARK = "\r\n\r\n", "WARC/1.1\r\nWARC-Type: "
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTS = ("plain", "nested")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column: eight groups of five hex digits, four letters each."""
    digits = F.sha1(payload.cast("binary"))
    def letters(k: int) -> list[Column]:
        group = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(ALPHABET), F.shiftright(group, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*(c for k in range(8) for c in letters(k)))


def resolve(records: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """records (id, digest, bytes, ...) plus refers_to: the id of the equal payload's response, null for responses; with a target column also refers_target.

    Payloads below least_bytes are never revisits.  A null id is below all
    others; rows that share the largest id are all responses.
    """
    more = ["target"] if "target" in records.columns else []
    largest = records.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max(F.struct("id", *more)).alias("r"), F.count("*").alias("copies"))
    groups = largest.where("copies > 1").select("digest", "bytes", F.col("r.id").alias("response"), *(F.col(f"r.{c}").alias(f"refers_{c}") for c in more))
    # written, so that the join is a plain one, which adaptive execution can split at a very common payload
    groups = scratch.keep("groups", groups.select(F.col("digest").alias("of_digest"), F.col("bytes").alias("of_bytes"), "response", *(f"refers_{c}" for c in more)))
    joined = records.join(groups, (F.col("digest") == F.col("of_digest")) & (F.col("bytes") == F.col("of_bytes")), "left")
    again = ~F.col("id").eqNullSafe(F.col("response"))
    return joined.select(*records.columns, F.when(again, F.col("response")).alias("refers_to"), *(F.when(again, F.col(f"refers_{c}")).alias(f"refers_{c}") for c in more))


#: Bits of the filter, which every task holds (8 MB); with far more revisits than bits it lets all rows through to the join.
BITS = 1 << 26
_WORD = 1 << 15  # bits of one row of it


def _hits(pages: DataFrame, revisits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that are surely no revisit, all others): pages (page_id, ...) by a filter of revisits (revisit)."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    word, bit = F.expr(f"cast(place div {_WORD} as int)"), F.expr(f"cast(place % {_WORD} as bigint)")
    bits = revisits.select(place("revisit").alias("place")).select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # BITS / _WORD rows of 4 KB at most, so small enough for every executor
    kept = pages.columns
    seen = pages.withColumn("place", place("page_id")).withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.bit_get(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return seen.where(~hit).select(kept), seen.where(hit).select(kept)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, date: str | None = None, least_bytes: int = 0, compression: str = "gzip") -> None:
    """pages (page_id, url, html) -> WARC files under path, one record a row.

    date (ISO 8601, UTC) is every record's capture time, by default the time of
    writing.  A revisit names its response's id, target and date.  Null html is an
    empty payload, a null url an empty target; line breaks in a url are percent-encoded.
    Of rows with one page_id and payload, each is a record of its own, a response if
    that id is the payload's largest.  Payloads of any length are written whole.  Empty
    tables give empty archives.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select("page_id", "url", "html")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    described = lambda some: some.select(F.col("page_id").alias("id"), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("target"), payload.alias("payload"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    scratch = Scratch(pages.sparkSession, "resolve")
    headers = scratch.keep("headers", described(pages).select("id", "digest", "bytes", "target"))
    decided = resolve(headers, scratch, least_bytes).where("refers_to is not null").select(F.col("id").alias("revisit"), F.col("digest").alias("of_digest"), "refers_to", "refers_target").distinct()
    decided = scratch.keep("revisits", decided)
    apart, asked = _hits(pages, decided.select("revisit"))
    # both sides grow with the pages, so neither is broadcast
    asked = described(asked).join(decided.hint("merge"), F.col("id").eqNullSafe(F.col("revisit")) & (F.col("digest") == F.col("of_digest")), "left").drop("revisit", "of_digest")
    full = described(apart).withColumns({c: F.lit(None).cast(decided.schema[c].dataType) for c in ("refers_to", "refers_target")}).unionByName(asked)
    again = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:hearthbook:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        F.lit(MARK), F.when(again, F.lit("revisit\r\n")).otherwise(F.lit("response\r\n")),
        _header("WARC-Record-ID", name(F.col("id"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("target")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block))),
        F.when(again, F.concat(
            _header("WARC-Refers-To", name(F.col("refers_to"))), _header("WARC-Refers-To-Target-URI", F.col("refers_target")), _header("WARC-Refers-To-Date", F.lit(date)), _header("WARC-Profile", F.lit(PROFILE)),
        )).otherwise(F.lit("")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    )
    nested = F.contains(block, F.lit(MARK))
    written = full.select(record.alias("value"), F.when(nested, F.lit(PARTS[1])).otherwise(F.lit(PARTS[0])).alias("part"))
    written.write.mode("overwrite").partitionBy("part").option("lineSep", END).option("compression", compression).text(path)


def _joined(batches):
    """Pieces between separators, in a file's order, as whole records: (head, block).

    A record's block may hold the separator, so pieces are added until the block
    has its Content-Length.
    """
    held, file = b"", None
    for batch in batches:
        heads, blocks = [], []
        for path, piece in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if path != file:
                held, file = b"", path
            elif not held and not piece:
                continue  # before a file's first record
            held = (held + MARK.encode() if held else MARK.encode()[len("WARC/1.1\r\n") :]) + piece.encode()
            head, found, rest = held.partition(END.encode())
            if not found:
                held = b"" if not piece else held
                continue
            size = next((int(v) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")) if k.lower() == "content-length"), 0)
            if len(rest) >= size:
                heads.append(head.decode("utf-8", "replace"))
                blocks.append(rest[:size])
                held = b""
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], ["head", "block"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, target, date, digest, block_digest, refers_to, refers_target, refers_date, http, payload) of the archives that write_archives left."""
    pieces = spark.read.option("lineSep", MARK).text(path)
    if "part" not in pieces.columns:  # an empty table left no files
        pieces = pieces.withColumn("part", F.lit(PARTS[0]))
    text = pieces.where(F.col("part") == PARTS[0]).where("value <> ''").select("value")  # nothing stands before a file's first record
    whole = F.concat(F.lit("WARC-Type: "), "value")
    head = F.substring_index("value", END, 1)
    size = F.regexp_extract("head", r"(?m)^Content-Length: (\d+)", 1).cast("int")
    plain = text.select(whole.alias("value")).withColumn("head", head)
    plain = plain.select("head", F.substring(F.col("value").cast("binary"), F.octet_length("head") + 5, size).alias("block"))
    # the pieces of a file in its order, streamed past one record at a time
    order = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")]
    nested = pieces.where(F.col("part") == PARTS[1]).select("value", *order).repartition("file").sortWithinPartitions("file", "start", "n").select("file", "value")
    both = plain.unionAll(nested.mapInArrow(_joined, "head string, block binary"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r]*)", 1), F.lit(""))
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    cut = both.select("head", "block", http.alias("http"))
    return cut.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target"), field("WARC-Date").alias("date"),
        *(F.regexp_replace(field(f"WARC-{n}-Digest"), "^sha1:", "").alias(c) for n, c in (("Payload", "digest"), ("Block", "block_digest"))),
        field("WARC-Refers-To").alias("refers_to"), field("WARC-Refers-To-Target-URI").alias("refers_target"), field("WARC-Refers-To-Date").alias("refers_date"), "http",
        F.expr("substring(block, octet_length(http) + 5)").alias("payload"),
    )
