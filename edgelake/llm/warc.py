"""WARC archives: written, normalised from one gzip stream to a member per record, and read by an offset index.

A monolithic archive is a single gzip stream over all its records, which can only be read from its beginning. The
normaliser inflates each such stream once, in chunks, rewrites every record as a gzip member of its own, and
writes an index of the members' places beside the archives. Readers then take any range of members.

Archives are written by Spark's text sink, records being lines that end as WARC records do. Normalised archives
are written by the tasks through ``pyarrow.fs`` into the shared folder under names that depend on the input's, first
under a name of the attempt, so a task that runs again replaces what it wrote.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelake.operators.scale import lookup_join
from edgelake.session import new_table_path, stored

MIN_REVISIT_BYTES = 100
RECORDS_PER_ARCHIVE = 50_000
CHUNK = 1 << 20
RANGE_BYTES = 8 << 20
MOST_TASKS = 20_000
LEVEL = 6
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
END = b"\r\n\r\n"


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages with the digest of their payload, their record type and the response that a revisit refers to.

    Of payloads of at least 100 bytes that are equal, the smallest id is the response and rows of other ids
    revisit it; null ids come last. Columns: page_id, url, payload, digest, record_type, refers_to.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    again = (
        rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return lookup_join(rows, stored(again.select("digest", "first"), "payloads"), ["digest"], "left").select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_text(date: str = DATE) -> Column:
    """The text of a record, without the blank lines that end it. A revisit has the HTTP header only."""
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    page = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), page("page_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\n"), F.coalesce(uri, F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), page("refers_to"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block,
    )


def write_archives(records: DataFrame, folder: str, per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write records as monolithic archives, each one gzip stream of at most ``per_archive`` records."""
    (
        records.select(record_text().alias("value"))
        .write.option("compression", "gzip")
        .option("lineSep", END.decode())
        .option("maxRecordsPerFile", per_archive)
        .text(folder)
    )


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark prints it, or of a plain path."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", uri)
    return fs.FileSystem.from_uri(uri)


def _inflated(stream) -> Iterator[bytes]:
    """Bytes of a gzip file of one or more members, at most a chunk at a time however well they are packed."""
    inflate, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        full = False
        while data or full:
            piece = inflate.decompress(data, CHUNK)
            yield piece
            begun, full = not inflate.eof, len(piece) == CHUNK and not inflate.eof
            data = inflate.unconsumed_tail if begun else inflate.unused_data
            if not begun:
                inflate = zlib.decompressobj(31)
    if begun:
        raise ValueError("an archive is cut off")


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and whole bytes of each record of a stream, with the blank lines that end it."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        searched = 0
        while (end := held.find(END, searched)) < 0:
            searched = max(0, len(held) - len(END) + 1)
            if not more():
                if held.strip():
                    raise ValueError("a WARC header does not end")
                return
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + len(END) + int(header["content-length"]) + len(END)
        while len(held) < size:
            if not more():
                raise ValueError("a WARC record is cut off")
        yield header, bytes(held[:size])
        del held[:size]


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive of a folder with a member per record, and return the sidecar index.

    The index is a table in ``target``/index: archive, offset and length of the member, record_id, record_type.
    A stream is inflated once and never held as a whole. An empty folder gives an empty index.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{target}/{path.rpartition('/')[2].removesuffix('.txt.gz').removesuffix('.gz')}.warc.gz"
                system, final = place(name)
                attempt = f"{final}.{uuid.uuid4().hex}"
                system.create_dir(final.rpartition("/")[0], recursive=True)
                rows: dict[str, list] = {"offset": [], "length": [], "record_id": [], "record_type": []}
                at = 0
                from_system, from_path = place(path)
                with from_system.open_input_stream(from_path, compression=None) as stream, system.open_output_stream(attempt, compression=None) as out:
                    for header, whole in _records(_inflated(stream)):
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = squeeze.compress(whole) + squeeze.flush()
                        out.write(member)
                        for key, value in (("offset", at), ("length", len(member)), ("record_id", header.get("warc-record-id")), ("record_type", header.get("warc-type"))):
                            rows[key].append(value)
                        at += len(member)
                        if len(rows["offset"]) == 8192:
                            yield _index(name, rows)
                            rows = {key: [] for key in rows}
                system.move(attempt, final)
                yield _index(name, rows)

    schema = "archive string, offset bigint, length bigint, record_id string, record_type string"
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    index = archives.mapInArrow(rewrite, schema)
    index.write.mode("overwrite").parquet(f"{target}/index")
    return spark.read.schema(schema).parquet(f"{target}/index")


def _index(name: str, rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(rows["offset"]), pa.string()), pa.array(rows["offset"], pa.int64()),
            pa.array(rows["length"], pa.int64()), pa.array(rows["record_id"], pa.string()), pa.array(rows["record_type"], pa.string()),
        ],
        ["archive", "offset", "length", "record_id", "record_type"],
    )


_RECORD = "page_id bigint, url string, record_type string, refers_to bigint, digest string, payload binary"


def read_records(index: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of normalised archives by their index: page_id, url, record_type, refers_to, digest, payload.

    Members are taken in ranges of about ``range_bytes``, each a task, so one archive is read by many. The digest is that of the
    payload for a response, of which the header must agree, and the header's for a revisit, which has no payload.
    """
    stop = F.col("offset") + F.col("length")
    ranges = index.groupBy("archive", F.floor(F.col("offset") / range_bytes).alias("part")).agg(
        F.min("offset").alias("start"), F.max(stop).alias("stop")
    )
    ranges = stored(ranges.select("archive", "start", "stop"), "ranges")
    ranges = ranges.repartition(min(MOST_TASKS, max(1, ranges.count())))

    def number(value: str | None) -> int | None:
        text = (value or "").removeprefix(f"<{ID}").removesuffix(">")
        return int(text) if re.fullmatch(r"-?\d+", text) else None

    def members(path: str, start: int, stop: int) -> Iterator[bytes]:
        system, file = place(path)
        with system.open_input_file(file) as f:
            f.seek(start)
            left = stop - start
            inflate = zlib.decompressobj(31)
            while left and (chunk := f.read(min(CHUNK, left))):
                left -= len(chunk)
                while chunk:
                    yield inflate.decompress(chunk)
                    chunk = inflate.unused_data
                    if inflate.eof:
                        inflate = zlib.decompressobj(31)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for header, whole in _records(members(row["archive"], row["start"], row["stop"])):
                    block = whole[whole.index(END) + len(END) : -len(END)]
                    payload = block[block.index(END) + len(END) :]
                    digest = header["warc-payload-digest"].removeprefix("sha256:")
                    if header["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {header['warc-record-id']} does not have its digest")
                    rows.append((
                        number(header["warc-record-id"]), header.get("warc-target-uri"), header["warc-type"],
                        number(header.get("warc-refers-to")), digest, payload if header["warc-type"] == "response" else None,
                    ))
                    held += len(payload)
                    if held > CHUNK:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(read, _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Size and digest of every record's full payload; a revisit has those of the response it refers to.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to. A revisit whose response is missing
    or has another digest gets nulls.
    """
    narrow = stored(
        records.select(
            "page_id", "url", "record_type", "refers_to", "digest",
            F.octet_length("payload").cast("bigint").alias("size"),
        ),
        "records",
    )
    responses = narrow.where("record_type = 'response'")
    known = responses.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("size").alias("size"))
    again = narrow.where("record_type = 'revisit'").drop("size")
    known = known.join(again.select("refers_to", "digest").distinct(), ["refers_to", "digest"], "left_semi")
    found = lookup_join(again, stored(known, "responses"), ["refers_to", "digest"], "left")
    return responses.unionByName(found).select(
        "page_id", "url", F.col("size").alias("payload_bytes"),
        F.when(F.col("size").isNotNull(), F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per page, normalise the archives, and read them back by their index; one row per page.

    A null payload is empty, a null url is left out of the record, rows without an id are read back without one,
    repeated rows are repeated records, and no pages give no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = new_table_path(spark, "warc")
    write_archives(revisits(pages, id_col, url_col, payload_col), f"{folder}/monolithic")
    index = normalise(spark, f"{folder}/monolithic", f"{folder}/normal")
    return resolved(read_records(index))
