"""WARC archives as a Spark data source: planned by files, filtered by headers before any payload is read."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from trackweave.llm.common import scratch, written

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Columns and the headers that they come from.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, headers map<string,string>, payload binary"
ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
MANIFEST = "_files-"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _clean(value: str | None) -> str:
    """A header's value on one line."""
    return " ".join((value or "").split())


def page_record(row: dict) -> bytes:
    """A response with the payload after an HTTP head, or a revisit with that head alone."""
    revisit = row["record_type"] == "revisit"
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(row["target_uri"])), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha256:" + row["payload_digest"]), ("X-Payload-Length", str(row["payload_length"]))]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["refers_to"])]
    return record(headers, HTTP if revisit else HTTP + (row["payload"] or b""))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; commit() lists those of the tasks that ended."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path.rstrip("/"), file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc")
                    out, size = system.open_output_stream(f"{folder}/{files[-1]}"), 0
                data = page_record(row)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        for name in [f for m in messages if m for f in m.files]:
            if system.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
                system.delete_file(f"{folder}/{name}")


@dataclass
class WarcFile(InputPartition):
    uri: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, batch_bytes: int):
        self.path, self.payload, self.batch_bytes = path.rstrip("/"), payload, batch_bytes
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and IN on the columns that are headers; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        """A partition for each file: those that manifests list, or all archives (.warc and .warc.gz) of a folder without one."""
        system, folder = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(folder).type == fs.FileType.File:
            return [WarcFile(self.path)]
        found = [f for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]
        lists = [f for f in found if f.base_name.startswith(MANIFEST)]
        names = [f.base_name for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        if lists:
            names = []
            for f in lists:
                with system.open_input_stream(f.path) as stored:
                    names += json.loads(stored.read())
        return [WarcFile(f"{self.path}/{n}") for n in sorted(names)] or [WarcFile("")]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        if not partition.uri:  # no archive: Spark asks for one partition at least
            return
        system, name = fs.FileSystem.from_uri(partition.uri)
        rows, size = [], 0
        packed = name.endswith(".gz")
        with gzip.GzipFile(fileobj=system.open_input_stream(name, compression=None)) if packed else system.open_input_file(name) as stored:
            for row in records(Forward(stored) if packed else stored, self.wanted, self.payload):
                rows.append(row)
                size += len(row["payload"] or b"") + 1024
                if size >= self.batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class Forward:
    """A stream that can only be read on, as one whose later parts are asked for by place."""

    def __init__(self, stream):
        self.stream, self.at, self.held = stream, 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        if at < self.at:
            raise ValueError("a place already passed")
        while at > self.at + len(self.held):  # passed over a piece at a time
            self.at, self.held = self.at + len(self.held), self.stream.read(min(1 << 20, at - self.at - len(self.held)))
            if not self.held:
                return b""
        self.at, self.held = at, self.held[at - self.at :]
        while len(self.held) < n and (more := self.stream.read(n - len(self.held))):
            self.held += more
        return self.held[:n]


def records(stored, wanted: dict[str, set[str]], payload: bool, ahead: int = 2048) -> Iterator[dict]:
    """Records that pass: the head is read first, and the block only if the head passes and the payload is asked for.

    Bytes of a head outside UTF-8 become replacement characters; a head that
    doesn't end, has no length, or a record that is cut off is an error.
    """
    at = 0
    while True:
        n = ahead
        while (stop := (head := stored.read_at(n, at)).find(b"\r\n\r\n")) < 0:
            if not head.strip():
                return
            if len(head) < n:
                raise ValueError(f"record head at byte {at} doesn't end")
            n *= 4
        lines = head[:stop].decode(errors="replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not headers.get("content-length", "").isdigit():
            raise ValueError(f"record at byte {at} has no length")
        length, begin, block = int(headers["content-length"]), at, at + stop + 4
        at = block + length + 4
        row = {c: headers.get(h) for c, h in HEADERS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
        if all(row[c] in values for c, values in wanted.items()):
            body = None
            if payload and row["record_type"] != "revisit":
                data = head[stop + 4 : stop + 4 + length]  # the block may lie in what was read for the head
                if len(data) < length:
                    data = stored.read_at(length, block) if isinstance(stored, Forward) else data + stored.read_at(length - len(data), block + len(data))
                if len(data) < length:
                    raise ValueError(f"record at byte {begin} is cut off")
                body = data.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else data
            yield row | {"content_length": length, "headers": list(headers.items()), "payload": body}
        if length and not stored.read_at(1, block + length - 1):
            raise ValueError(f"record at byte {begin} is cut off")


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder): option payload=false leaves all payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("batch_bytes", 4 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 64 << 20)))


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Records to write: record_type, record_id, target_uri, refers_to, payload_digest, payload_length, payload.

    Of pages with equal payloads of at least `least` bytes the one with the
    smallest page_id is the response and the others revisit it. The smallest
    ids of repeated payloads are a table of their own, so only pages whose
    payload repeats can meet in one key, and a payload is moved once at most.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    heads = keyed.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    heads = written(heads.select(F.col("payload_digest").alias("digest"), "first"), "repeated")
    joined = keyed.join(heads, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_length") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), "target_uri",
        F.when(revisit, urn(F.col("first"))).alias("refers_to"), "payload_digest", "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write pages as WARC archives; returns their folder."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    spark.dataSource.register(WarcSource)
    plan_records(pages).write.format("warc").mode("append").options(**options).save(path)
    return path


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payload, whose size and digest are computed
    anew; revisits from their heads alone, where the writer put both. Null html
    counts as an empty payload and null page_id is returned as null; rows that
    repeat the smallest page_id of their payload are all responses; an empty
    table gives an empty result; further columns are ignored.
    """
    spark, path = pages.sparkSession, archive_pages(pages)
    page = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")
    responses = read_warc(spark, path).where("record_type = 'response'").select(page(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_warc(spark, path, payload="false").where("record_type = 'revisit'").select(page(F.col("record_id")).alias("page_id"), F.element_at("headers", "x-payload-length").cast("long").alias("payload_bytes"), "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
    return responses.union(revisits)
