"""WARC archives of pages, and a normaliser for archives that are one gzip stream.

Pages are written as WARC records into whole-file gzip streams by Spark's text writer. The normaliser
inflates such a stream once and writes every record as a gzip member of its own; so records can be read
alone afterwards. One pass over the written files then checks every record and writes a side table with
its offset, its fields and the digest of its payload. Spark's writer puts a separator behind each row:
here an empty gzip member, so the files are members and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry.llm.common import partitions_for, ready, staged
from inkferry.operators.skew import checkpoint_dir

ARCHIVE_BYTES = 32 << 20  # of payload in one archive
MOST_HOT_PAGES = 100_000  # pages that are so many rows that they take several archives, at most
RECORD_BYTES = 500  # of a record beside its payload, about
# Fixed value: the gzip member of no bytes
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
INFLATE = 1 << 20
FLUSH_BYTES = 4 << 20
CRLF = "\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "archive string, number bigint, offset bigint, length bigint, page_id bigint, url string, "
    "record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
)
RECORD = f"{INDEX}, payload binary"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hexadecimal digits are eight of base 32."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.upper(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)
    ]
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")


def revisits(narrow: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages that repeat the payload of a larger page id.

    `narrow` is a table of (page_id, payload_digest, payload_bytes). Only digests move. Keepers are found
    by partial aggregation and staged, so that the join with a payload that many pages share is one of
    two plain shuffles, which adaptive execution splits.
    """
    long = narrow.filter(F.col("payload_bytes") >= least_bytes)
    keepers = (
        long.groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least"))
        .filter("refers_to <> _least")
        .drop("_least")
    )
    return (
        long.join(staged(keepers, "keepers"), ["payload_digest", "payload_bytes"])
        .filter("page_id < refers_to")
        .select("page_id", "payload_digest", "refers_to")
        .distinct()
    )


def _hot_pages(narrow: DataFrame, total: int) -> DataFrame:
    """Repeated rows (page_id, payload_digest) of over an archive, and over how many `_deals` to spread them.

    They must also be over a MOST_HOT_PAGES-th of all bytes, which bounds the table. At 100 TB that is
    1 GB, an archive that can still be read whole.
    """
    size = F.sum(F.col("payload_bytes") + RECORD_BYTES)
    sizes = narrow.groupBy("page_id", "payload_digest").agg(size.alias("_bytes"))
    least = max(ARCHIVE_BYTES, total // MOST_HOT_PAGES)
    deals = F.ceil(F.col("_bytes") / ARCHIVE_BYTES).cast("bigint").alias("_deals")
    return sizes.filter(F.col("_bytes") > least).select("page_id", "payload_digest", deals)


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows with the `_deals` of their page; null for nearly all. A null page id can be hot too."""
    same = F.col("r.page_id").eqNullSafe(F.col("h.page_id")) & (F.col("r.payload_digest") == F.col("h.payload_digest"))
    return rows.alias("r").join(F.broadcast(hot).alias("h"), same, "left").select("r.*", "h._deals")


def _record() -> Column:
    """A whole record without the empty lines behind it, which the writer adds."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    is_revisit = F.col("refers_to").isNotNull()
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("_payload").cast("string")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("_url")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archives(
    pages: DataFrame, path: str, html: str = "html", url: str = "url", least_bytes: int = 0
) -> None:
    """Write one record per row of pages(page_id, url, html) into gzip streams of bounded size.

    Of records with equal payloads of at least `least_bytes` bytes the one with the largest page id is a
    response, the others revisit it; shorter payloads are all responses. Rows that repeat the keeper's
    page id and payload are responses too. A null html is an empty payload, a null page id an empty one,
    a null url `about:blank`; blanks and control characters in a url are percent-encoded. Other columns
    are not read; an empty table gives no records.
    """
    payload = _payload(html)
    address = F.coalesce(F.col(url).cast("string"), F.lit("about:blank"))
    source = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(address, r"[\x00-\x20\x7f]", "%20").alias("_url"),
        payload.alias("_payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        sha1_base32(payload).alias("payload_digest"),
    )
    narrow = staged(source.select("page_id", "payload_digest", "payload_bytes"), "digests")
    total = narrow.agg(F.sum(F.col("payload_bytes") + RECORD_BYTES)).first()[0] or 0
    hot = staged(_hot_pages(narrow, total), "hot-pages")
    deal = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_deals")), F.lit(0))
    last = F.coalesce(F.col("_deals") - 1, F.lit(0).cast("bigint"))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    dealt = _dealt(source, hot).withColumn("_deal", deal).drop("_deals")
    roles = _dealt(revisits(narrow, least_bytes), hot).withColumn("_deal", copies).drop("_deals")
    # both sides are dealt alike, so that the pages move this one time for the join and for the files
    keys = ["page_id", "payload_digest", "_deal"]
    n = partitions_for(pages.sparkSession, total, ARCHIVE_BYTES)
    spread = dealt.repartition(n, *keys).join(roles.repartition(n, *keys).hint("merge"), keys, "left")
    records = spread.select(_record().alias("value"))
    records.write.option("compression", "gzip").option("lineSep", CRLF * 2).text(path)


def inflated(content: bytes) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece."""
    at, stream = 0, zlib.decompressobj(31)
    while at < len(content):
        piece = content[at : at + INFLATE]
        at += len(piece)
        yield stream.decompress(piece)
        while stream.eof:
            rest = stream.unused_data.lstrip(b"\0")
            if not rest:
                if at >= len(content):
                    return
                stream = zlib.decompressobj(31)
                while at < len(content) and content[at] == 0:
                    at += 1
                break
            stream = zlib.decompressobj(31)
            yield stream.decompress(rest)


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of a WARC stream; holds one record at a time."""
    buffer = bytearray()
    need = 0
    for piece in pieces:
        buffer += piece
        while len(buffer) >= need:
            end = buffer.find(b"\r\n\r\n")
            if end < 0:
                break
            headers = parse_headers(bytes(buffer[:end]))
            need = end + 4 + int(headers["content-length"]) + 4
            if len(buffer) < need:
                break
            whole = bytes(buffer[:need])
            del buffer[:need]
            need = 0
            yield headers, whole[end + 4 : -4], whole
    if buffer:
        raise ValueError(f"{len(buffer)} bytes behind the last record")


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split(CRLF)
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def page_number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def member(record: bytes) -> bytes:
    stream = zlib.compressobj(6, zlib.DEFLATED, 31)
    return stream.compress(record) + stream.flush()


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]


def _folder(path: str) -> str:
    return path.rsplit("/", 2)[-2].removeprefix("archive=")


def _batches(rows: Iterator[dict], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= FLUSH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("number", pa.int64()), ("member", pa.binary())])

    def rows() -> Iterator[dict]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                pieces = inflated(content.as_buffer().to_pybytes())
                for number, (_, _, whole) in enumerate(records_of(pieces)):
                    yield {"archive": _name(path.as_py()), "number": number, "member": member(whole)}

    yield from _batches(rows(), schema, lambda r: len(r["member"]))


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive under `source` with a member per record; returns the offset index.

    Archives go to `target`/archives, one file each, the index to `target`/index: archive, number, offset
    and length of the member, and the record's fields, all taken from the files as they were written, in
    one pass. An archive without records leaves no file.
    """
    ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    members = files.select("path", "content").mapInArrow(
        _rewrite, "archive string, number bigint, member binary"
    )
    (
        members.sortWithinPartitions("archive", "number")
        .select("archive", F.col("member").cast("string").alias("value"))
        .write.partitionBy("archive")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .text(f"{target}/archives")
    )
    records = read_archives(spark, target, with_payload=False)
    records.drop("payload").write.parquet(f"{target}/index")
    return read_index(spark, target)


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def _contents(spark: SparkSession, target: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = files.option("pathGlobFilter", "part-*").load(f"{target}/archives")
    return found.select("path", "content")


def split_members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, inflated member) of a normalised archive; empty members only part the others."""
    at = 0
    while at < len(content):
        stream = zlib.decompressobj(31)
        out, begin = [], at
        while not stream.eof:
            piece = content[at : at + INFLATE]
            if not piece:
                raise ValueError("the archive ends inside a member")
            out.append(stream.decompress(piece))
            at += len(piece) - len(stream.unused_data)
        record = b"".join(out)
        if record:
            yield begin, at - begin, record


def read_record(record: bytes) -> dict:
    """The fields of one record; a response's digest and length are taken from its payload."""
    headers, block, _ = next(records_of(iter([record])))
    kind = headers.get("warc-type")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    size, payload = int(headers.get("payload-length", 0)), None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "page_id": page_number(headers.get("warc-record-id")),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": page_number(headers.get("warc-refers-to")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


def _reader(with_payload: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for path, content in zip(batch.column("path"), batch.column("content")):
                    archive = _folder(path.as_py())
                    members = split_members(content.as_buffer().to_pybytes())
                    for number, (offset, length, record) in enumerate(members):
                        row = read_record(record)
                        if not with_payload:
                            row["payload"] = None
                        yield {"archive": archive, "number": number, "offset": offset, "length": length} | row

        yield from _batches(rows(), schema, lambda r: 200 + len(r["payload"] or b""))

    return run


def read_archives(spark: SparkSession, target: str, with_payload: bool = True) -> DataFrame:
    """All records of normalised archives; revisits have no payload of their own."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    ready(spark)
    schema = T._parse_datatype_string(RECORD)
    return _contents(spark, target).mapInArrow(_reader(with_payload, to_arrow_schema(schema)), schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as archives, normalise them and read their records back, without payloads."""
    spark = ready(pages.sparkSession)
    folder = f"{checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(pages, f"{folder}/streams", least_bytes=least_bytes)
    return normalise(spark, f"{folder}/streams", f"{folder}/normal")
