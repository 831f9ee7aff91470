"""WARC archives with revisit records for repeated payloads, written and read back through Spark's file systems.

Method. Headers (page id, url, payload digest, payload bytes) are written once and shuffled by digest,
without payloads; of those with equal payloads of at least LEAST_BYTES the largest page id is the
response and the others become revisits that refer to it. The HEAVY digests that repeat most bytes are
sent to the tasks that read the payloads, which blank those of their revisits before anything moves;
payloads of the other revisits are blanked where they meet their headers. Rows are dealt evenly, so a payload or page id that very many rows share
moves no more than others; only rows that tie for the response of a payload are written by one task, one
after the other. Archives of bounded size are written with fresh headers, each
record a gzip member of its own, so that records can be addressed. Reading takes any number of members
a file and of records a member, parses records by Content-Length and joins revisits to their responses
by record id.

Defined results. A null html is an empty payload. Rows that tie for the largest page id of a payload
are all responses, each with its own record id; revisits refer to the first. Null page ids are never
the response of others unless all are null; null urls have no target header; line breaks in urls are
percent-encoded. Payloads of any length up to Spark's 2 GB a value are one record. An empty table gives
empty archives. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, small_batches

#: Payload bytes of the smallest payload that is worth a revisit record.
LEAST_BYTES = 1000
#: Uncompressed bytes of an archive, about.
ARCHIVE_BYTES = 8 << 20
#: Digests whose revisits are blanked before they move, at most.
HEAVY = 1 << 15
#: A pair of page and payload with more rows than one in HOT of all, and than HOT_ROWS, is dealt out.
HOT, HOT_ROWS = 4096, 1000
#: Bytes of an archive that are inflated at once.
PIECE = 1 << 14
#: Fixed values of the headers.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string"


def headers_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes and payload_digest of each row."""
    out = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), F.coalesce(column(pages, html_col).cast("string"), F.lit("")).alias("payload"))
    return out.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})


def originals(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """payload_digest, refers_to, its url, and whether several rows tie for it, of each payload that is worth revisits."""
    large = headers.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    last = F.max(F.struct("page_id", "url")).alias("last")
    found = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("payload_bytes").alias("size"))
    tops = large.groupBy("payload_digest", "page_id").agg(F.count("*").alias("same"), F.max("url").alias("url"))
    tops = tops.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url", "same")).alias("last"))
    out = found.where("n > 1").join(tops, "payload_digest").where("n > last.same")
    return out.select("payload_digest", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url"), (F.col("last.same") > 1).alias("tied"), ((F.col("n") - 1) * F.col("size")).alias("spared"))


def _urn(*parts):
    """A urn:uuid of these values."""
    h = F.md5(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, a zero, which the writer puts after each row.

    The last byte of a member is the highest of the record's length, so it is zero below 16 MB; a
    longer record keeps it, and the zero that follows is padding, which gzip readers skip.
    """
    seen: dict[str, int] = {}  # record ids that several rows of this task share; few, as ties are
    for batch in batches:
        out = []
        for name, tied, head, payload in zip(*(batch.column(c).to_pylist() for c in ("record_id", "tied", "head", "payload")), strict=True):
            if tied:
                seen[name] = seen.get(name, -1) + 1
                if seen[name]:
                    h = hashlib.md5(f"{name} {seen[name]}".encode()).hexdigest()
                    name = f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            made = packer.compress(f"{VERSION}\r\nWARC-Record-ID: <{name}>\r\n{head}".encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n") + packer.flush()
            out.append(made[:-1] if not made[-1] else made)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each row of pages to gzipped archives in folder, in any store that Spark writes to."""
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "warc-headers")
    records = headers_of(pages, id_col, url_col, html_col)
    headers = scratch.keep(records.drop("payload"), "headers")
    total = headers.agg(F.sum(F.col("payload_bytes") + 500)).first()[0] or 0
    files = max(1, -(-int(total) // ARCHIVE_BYTES))
    found = scratch.keep(originals(headers, least_bytes), "originals")
    # HEAVY rows at most
    heavy = found.orderBy(F.desc("spared"), "payload_digest").limit(HEAVY).select("payload_digest", F.col("refers_to").alias("heavy"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    again = lambda refers_to: F.col(refers_to).isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col(refers_to)))
    blanked = lambda refers_to: F.when(again(refers_to), F.lit("")).otherwise(F.col("payload"))
    # a pair of page and payload that holds many rows is dealt out; HOT rows at most
    pairs = headers.withColumn("key", key).groupBy("key", "payload_digest").agg(F.count("*").alias("same"))
    rows_in_all = max(1, headers.count())
    least = max(HOT_ROWS, rows_in_all // HOT)
    # tied responses that revisits refer to stay together, so that exactly one has the record id that these name
    named = found.select(F.col("refers_to").cast("string").alias("key"), "payload_digest")
    hot = pairs.where(F.col("same") > least).join(named, ["key", "payload_digest"], "left_anti")
    hot = scratch.keep(hot.select("key", "payload_digest", F.ceil(F.col("same") / least).cast("int").alias("splits")), "hot")
    decided = headers.select(key.alias("key"), "payload_digest").distinct().join(found, "payload_digest")
    decided = decided.join(F.broadcast(hot), ["key", "payload_digest"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)))
    rows = records.withColumns({"key": key, "row": F.monotonically_increasing_id()})
    rows = rows.join(F.broadcast(heavy), "payload_digest", "left").withColumn("payload", blanked("heavy")).drop("heavy")
    rows = rows.join(F.broadcast(hot), ["key", "payload_digest"], "left").withColumn("salt", F.pmod("row", F.coalesce("splits", F.lit(1))).cast("int"))
    # payloads move once: dealt to as many tasks as there are archives, joined and written there
    rows = rows.repartition(files, "key", "payload_digest", "salt").join(decided.select("key", "payload_digest", "salt", "refers_to", "refers_url", "tied"), ["key", "payload_digest", "salt"], "left")
    first = F.coalesce(F.col("page_id") == F.col("refers_to"), F.lit(False))
    rows = rows.withColumns({"revisit": again("refers_to"), "payload": blanked("refers_to"), "tied": F.coalesce(F.col("tied") & first, F.lit(False))})
    name = F.when(first, _urn(F.col("page_id"), F.col("payload_digest"))).otherwise(_urn(F.col("page_id"), F.col("payload_digest"), F.col("row")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    url = lambda c: F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")
    of_revisit = lambda name, value: F.when(F.col("revisit"), line(name, value)).otherwise("")
    head = F.concat(
        F.lit("WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise("response"), F.lit("\r\n"),
        F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Target-URI", url("url")), line("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        of_revisit("WARC-Profile", F.lit(PROFILE)),
        of_revisit("WARC-Refers-To", F.concat(F.lit("<"), _urn(F.col("refers_to"), F.col("payload_digest")), F.lit(">"))),
        of_revisit("WARC-Refers-To-Target-URI", url("refers_url")), of_revisit("WARC-Refers-To-Date", F.lit(date)),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length("payload")).cast("string"), F.lit("\r\n\r\n"), http,
    )
    members = rows.select(name.alias("record_id"), "tied", head.alias("head"), F.col("payload").cast("binary").alias("payload")).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\u0000").option("compression", "none").text(folder)
    scratch.drop("headers", "originals", "hot")


def records_in(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def inflated(raw: bytes) -> bytes:
    """The content of a file that is plain, or gzipped in any number of members, with or without zeros after them."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out, at, member = [], 0, zlib.decompressobj(31)
    while at < len(raw):
        if member.eof:
            if not raw[at]:  # padding
                at += 1
                continue
            member = zlib.decompressobj(31)
        part = raw[at : at + PIECE]
        out.append(member.decompress(part))
        at += len(part) - len(member.unused_data)
    if not member.eof:
        raise ValueError("an archive ends within a gzip member")
    return b"".join(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("content"):
            rows = []
            for head, block in records_in(inflated(value.as_buffer().to_pybytes())):
                if head.get("warc-type") not in ("response", "revisit"):
                    continue
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                first = head["warc-type"] == "response"
                page = head.get("x-page-id")
                digest = hashlib.sha1(payload).hexdigest() if first else head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                rows.append((None if page is None else int(page), len(payload) if first else None, digest, head["warc-type"], head["warc-record-id"].strip("<>"), None if first else head.get("warc-refers-to", "").strip("<>") or None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record in folder.

    Payload digests of responses are computed anew; a revisit's figures are those of the response that
    it refers to (its bytes and page are null where that isn't in the folder). Records of other types
    are passed over. Archives are read whole, one at a time; write_archives bounds them.
    """
    small_batches(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(_parse, _FOUND)
    found = Scratch(spark, "warc-records").keep(found, "records")
    first = found.where("record_type = 'response'").drop("refers_to_id").withColumn("refers_to", F.lit(None).cast("long"))
    again = found.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id", F.col("payload_digest").alias("told"))
    wanted = again.select(F.col("refers_to_id").alias("record_id")).distinct()
    known = first.join(wanted, "record_id", "left_semi").groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    again = again.join(known.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left").withColumn("payload_digest", F.coalesce("payload_digest", "told"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.select(columns).unionByName(again.select(columns))
