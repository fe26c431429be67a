"""WARC archives of pages: monolithic gzip files, and a normaliser that gives each record a member of its own and an index."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import checkpointed, with_checkpoints

#: Payloads of fewer bytes are always stored; later ones that equal one of at least so many only refer to it.
LEAST = 1000
#: Bytes of records after which a file is full; bytes read at once; effort of the first files, which are read once, and of
#: those that stay; the date that records have where none is given.
FILE, CHUNK, FAST, EFFORT, DATE = 64 << 20, 1 << 20, 1, 4, "2000-01-01T00:00:00Z"
#: Files are read in a task each, up to so many tasks.
TASKS = 20_000
#: Tasks that the rows of one payload are dealt over where the copies' list is too long to be sent to all tasks; that list.
SALTS, SENT = 16, 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


class Record(NamedTuple):
    """A record's fields, of which names keep their case, and its block."""

    fields: dict[str, str]
    block: bytes


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pa.fs.LocalFileSystem(), path


def clean(value: str, also: str = "") -> str:
    """A field's value in one line: control characters, white space and those of ``also`` are percent-encoded."""
    return re.sub(rf"[\x00-\x20\x7f{also}]", lambda m: f"%{ord(m[0]):02X}", value)


def response_block(payload: bytes | None, size: int) -> bytes:
    """An HTTP response with the payload, or its head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    return head.encode() + (payload or b"")


def written(record: Record) -> bytes:
    fields = record.fields | {"Content-Length": str(len(record.block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + record.block + _END


def response(name: str, url: str | None, page: str | None, payload: bytes, date: str = DATE) -> Record:
    """The record of a page; ``name`` identifies it, and a null address or page number has no field."""
    sha = hashlib.sha1(payload).hexdigest()
    fields = {"WARC-Type": "response", "WARC-Record-ID": f"<{name}>", "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha}"}
    fields |= ({} if url is None else {"WARC-Target-URI": clean(url)}) | ({} if page is None else {"Page-Id": clean(page, "%")})
    return Record(fields, response_block(payload, len(payload)))


def revisit(record: Record, name: str, page: str | None) -> Record:
    """What stays of a response whose payload the record ``name`` has: all its fields, and the head of its block."""
    fields = record.fields | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<{name}>"}
    fields |= {} if page is None else {"Refers-To-Page-Id": clean(page, "%")}
    return Record(fields, record.block[: record.block.index(_END) + len(_END)])


def inflated(source: BinaryIO, chunk: int = CHUNK) -> Iterator[bytes]:
    """The contents of a gzip file of one or many members, in one pass and a chunk at a time."""
    engine = zlib.decompressobj(31)
    while data := source.read(chunk):
        while data:
            if out := engine.decompress(data, chunk):
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)
    if rest := engine.flush():
        yield rest


def records(chunks: Iterator[bytes]) -> Iterator[Record]:
    """The records of a stream; of them one at a time is in memory. A stream that ends within a record is an error."""
    held, at = bytearray(), 0

    def more() -> None:
        nonlocal held, at
        if at > CHUNK:
            del held[:at]
            at = 0
        try:
            held += next(chunks)
        except StopIteration:
            raise ValueError("the archive ends within a record") from None

    for first in chunks:
        held += first
        while at < len(held):
            seen = at
            while (end := held.find(_END, seen)) < 0:
                left = len(held) - at
                more()
                seen = max(at, at + left - 3)
            lines = held[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size, begin = int(fields.pop("Content-Length")), end + len(_END) - at
            while len(held) - at < begin + size + len(_END):
                more()
            yield Record(fields, bytes(held[at + begin : at + begin + size]))
            at += begin + size + len(_END)
        held, at = bytearray(), 0


def payload_of(record: Record) -> bytes:
    return record.block[record.block.index(_END) + len(_END) :]


class Monolith:
    """A file that is one gzip stream of records."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, path = opened(self.path)
        fs.create_dir(path.rsplit("/", 1)[0])
        self.sink, self.engine, self.bytes, self.count = fs.open_output_stream(path, compression=None), zlib.compressobj(FAST, zlib.DEFLATED, 31), 0, 0

    def add(self, record: Record) -> None:
        data = written(record)
        self.sink.write(self.engine.compress(data))
        self.bytes, self.count = self.bytes + len(data), self.count + 1

    def close(self) -> None:
        self.sink.write(self.engine.flush())
        self.sink.close()


def normalised(source: str, target: str, of: Callable[[int, Record], Record] = lambda _, r: r) -> list[dict]:
    """Inflates the file ``source`` once and writes its records to ``target``, each as a member of its own, changed by
    ``of(number, record)``. Returns the index, which lies beside the target as JSON lines: offset, length and id of each."""
    fs, path = opened(source)
    out, to = opened(target)
    index, at = [], 0
    out.create_dir(to.rsplit("/", 1)[0])
    with fs.open_input_stream(path, compression=None) as held, out.open_output_stream(to, compression=None) as sink:
        for number, record in enumerate(records(inflated(held))):
            record, engine = of(number, record), zlib.compressobj(EFFORT, zlib.DEFLATED, 31)
            member = engine.compress(written(record)) + engine.flush()
            sink.write(member)
            index.append({"offset": at, "length": len(member), "id": record.fields["WARC-Record-ID"], "type": record.fields["WARC-Type"]})
            at += len(member)
    with out.open_output_stream(f"{to}.idx", compression=None) as sink:
        sink.write("".join(json.dumps(line) + "\n" for line in index).encode())
    return index


def member(source: BinaryIO, offset: int, length: int) -> Record:
    """The record of one line of an index, read alone."""
    source.seek(offset)
    return next(records(iter([zlib.decompress(source.read(length), 31)])))


def spread(files: DataFrame) -> DataFrame:
    """``files``, a row a file, dealt over a task each: rows are tiny, so Spark by itself would put them in one task."""
    return files.repartition(max(1, min(files.count(), TASKS)))


def monoliths(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", most: int = FILE) -> DataFrame:
    """Writes a response record of every row to files of one gzip stream each, of about ``most`` bytes of records, and
    returns (file, number, page, size, sha256), a row a record. Files are named anew by each attempt of a task; only those
    that the table names count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rows = None, []

        def told() -> pa.RecordBatch:
            file.close()
            out = pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("number", pa.int32()), ("page", pa.string()), ("size", pa.int64()), ("sha256", pa.binary())]))
            rows.clear()
            return out

        for batch in batches:
            for number, address, text in zip(*batch.columns, strict=True):
                if file is None:
                    file = Monolith(folder)
                payload = (text.as_py() or "").encode()
                rows.append({"file": file.path, "number": file.count, "page": number.as_py(), "size": len(payload), "sha256": hashlib.sha256(payload).digest()})
                file.add(response(f"{uuid.uuid5(uuid.NAMESPACE_URL, file.path).urn}:{file.count}", address.as_py(), number.as_py(), payload))
                if file.bytes >= most:
                    yield told()
                    file = None
        if file is not None:
            yield told()

    held = pages.select(*(F.col(f"`{c}`").cast("string") for c in (page, url, html)))
    return held.mapInArrow(run, "file string, number int, page string, size long, sha256 binary")


def revisits(listed: DataFrame, order: str = "bigint", least: int = LEAST) -> DataFrame:
    """(file, number, to_file, to_number, to_page) of the records whose payload another one stores: the one of the largest
    page, taken as ``order``, null least; of equal ones the last by file and number. Payloads are equal if size and SHA-256
    are.

    The one that stores it comes from a grouped maximum, which is combined early. Payloads that occur twice or more are
    sent to all tasks if they are at most SENT; else a hot payload's rows are dealt over SALTS tasks.
    """
    large = listed.where(F.col("size") >= least)
    key = F.col("page").cast(order)
    last = F.max(F.struct(key.isNotNull(), key, "file", "number", "page")).alias("last")
    copied = checkpointed(large.groupBy("sha256", "size").agg(last, F.count("*").alias("n")).where("n > 1").select("sha256", "size", F.col("last.file").alias("to_file"), F.col("last.number").alias("to_number"), F.col("last.page").alias("to_page")))
    on = ["sha256", "size"]
    if copied.count() <= SENT:
        held = large.join(F.broadcast(copied), on)
    else:
        salt = F.pmod(F.hash("file", "number"), F.lit(SALTS))
        held = large.withColumn("salt", salt).join(copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"])
    return held.where("file <> to_file or number <> to_number").select("file", "number", "to_file", "to_number", "to_page")


def archived(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, most: int = FILE) -> DataFrame:
    """Writes ``pages`` as an archive under ``folder`` and returns its files: (file, records), a row a file.

    The pages go to monolithic files first; the table of their records decides which of them are revisits; the normaliser
    then inflates each file once and writes every record as its own member, with an index beside. Monoliths go when their
    table isn't needed any more. What a task holds is one record and the index of one file. Null html is an empty
    payload, a null address or page number has no field, repeated rows are records each, and of equal page numbers with
    equal payloads one is the response. An empty table has no files. Columns other than the three named are not stored.
    """
    spark = pages.sparkSession
    with_checkpoints(spark)
    order = pages.select(f"`{page}`").dtypes[0][1]
    monoliths(pages, f"{folder}/monoliths", page, url, html, most).write.parquet(f"{folder}/listed")
    listed = spark.read.parquet(f"{folder}/listed")
    known = revisits(listed, order, least).groupBy("file").agg(F.collect_list(F.struct("number", "to_file", "to_number", "to_page")).alias("to"))  # of one file of bounded size
    files = spread(checkpointed(listed.select("file").distinct().join(known, "file", "left")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, to in zip(*batch.columns, strict=True):
                path, held = file.as_py(), {t["number"]: t for t in to.as_py() or []}

                def of(number: int, record: Record, held: dict = held) -> Record:
                    t = held.get(number)
                    return record if t is None else revisit(record, f"{uuid.uuid5(uuid.NAMESPACE_URL, t['to_file']).urn}:{t['to_number']}", t["to_page"])

                target = f"{folder}/archive/{uuid.uuid4().hex}.warc.gz"
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([len(normalised(path, target, of))], pa.int64())], ["file", "records"])

    files.mapInArrow(run, "file string, records long").write.parquet(f"{folder}/files")
    fs, path = opened(f"{folder}/monoliths")
    if listed.take(1):
        fs.delete_dir(path)
    return spark.read.parquet(f"{folder}/files")


def read_back(files: DataFrame, file: str = "file", batch: int = 1 << 24) -> DataFrame:
    """(file, number, page, url, type, payload_bytes, payload_digest, refers_to, refers_to_page, payload) of all records, each
    read alone by its line of the index. The payload of a revisit is null, its size and digest are those of what it
    refers to, as its own fields say; a response's are worked out anew, and must be what its fields say."""
    kinds = [("file", pa.string()), ("number", pa.int32()), ("page", pa.string()), ("url", pa.string()), ("type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("refers_to_page", pa.string()), ("payload", pa.binary())]

    def told(path: str, number: int, record: Record) -> dict:
        fields, body = record.fields, payload_of(record)
        size, digest = int(re.search(rb"Content-Length: (\d+)", record.block)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        here = fields["WARC-Type"] == "response"
        if here and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError(f"record {number} of {path} is damaged")
        page, to = (unquote(fields[f]) if f in fields else None for f in ("Page-Id", "Refers-To-Page-Id"))
        return {"file": path, "number": number, "page": page, "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("WARC-Refers-To"), "refers_to_page": to, "payload": body if here else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names in batches:
            for path in names.column(0).to_pylist():
                fs, at = opened(path)
                with fs.open_input_stream(f"{at}.idx", compression=None) as lines:
                    index = [json.loads(line) for line in lines.read().splitlines()]
                rows, size = [], 0
                with fs.open_input_file(at) as source:
                    for number, line in enumerate(index):
                        rows.append(told(path, number, member(source, line["offset"], line["length"])))
                        size += len(rows[-1]["payload"] or b"")
                        if size >= batch:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return spread(files.select(file)).mapInArrow(run, "file string, number int, page string, url string, type string, payload_bytes long, payload_digest string, refers_to string, refers_to_page string, payload binary")


def op12_warc(pages: DataFrame) -> DataFrame:
    """Per page what the archive has of it, see ``archived`` and ``read_back``; the archive lies in the checkpoint folder."""
    spark = pages.sparkSession
    with_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    order = pages.select("page_id").dtypes[0][1]
    back = read_back(archived(pages, folder))
    return back.select(F.col("page").cast(order).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").cast(order).alias("refers_to"))
