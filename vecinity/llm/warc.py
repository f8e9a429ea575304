"""WARC archives: written, normalised from one gzip stream to a member per record, and read back through a sidecar index.

`write` makes one monolithic archive per task (a single gzip member over the whole file, as careless writers do). `normalise`
inflates such a file once as a stream, finds each record by its Content-Length, rewrites it as a gzip member of its own and
writes a sidecar index (offset, length of the member, record id, type) as a text file beside it. `read` takes the index and
inflates members one by one. Files are reached by pyarrow's file systems from the address given (file:, hdfs:, s3:, gs:),
so it is a folder that all machines share; a task writes under a name of its own attempt and the driver's list of
finished files decides, so lost executors leave files that nobody reads.

Records with equal payloads of at least `least` bytes: the one with the largest id is the response, the others are revisits that
refer to it and carry no payload. Only ids and digests are shuffled for that; counts are pre-aggregated, so a page that is
a third of all rows costs one entry a task. The join back is on (digest, salt) with a table of groups of two or more.

Defined results: a null html is the empty payload; a null url is written as an empty target; equal ids with equal payloads: each row is
a record, all responses if theirs is the largest id; an empty table gives no files and no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecinity.llm.common import saved, scratch

SALTS = 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CHUNK = 1 << 20
INDEX = "page_id long, archive string, offset long, length long, record_type string"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32, from built-in functions: 40 bits are 10 hex and 8 base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def classified(pages: DataFrame, least: int = 0, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", sha1_base32(F.col("payload"))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = groups.select("payload_digest", "payload_bytes", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.join(groups, ["payload_digest", "payload_bytes", "salt"], "left")
    revisit = F.col("last").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("last")) | (F.col("last").isNotNull() & F.col("page_id").isNull())
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def record(page_id, url: str, payload: bytes, digest: str, kind: str, refers) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def gzip_writer():
    return zlib.compressobj(6, zlib.DEFLATED, 31)


def member(raw: bytes) -> bytes:
    packer = gzip_writer()
    return packer.compress(raw) + packer.flush()


def inflated(stream):
    """The bytes of a gzip file, member after member, as they come."""
    unpacker, rest = zlib.decompressobj(31), b""
    while data := rest or stream.read(CHUNK):
        out = unpacker.decompress(data, 1 << 22)
        rest = unpacker.unconsumed_tail
        if unpacker.eof:
            rest = unpacker.unused_data
            unpacker = zlib.decompressobj(31)
        if out:
            yield out


def records(stream):
    """Raw records of an inflated stream, each found by its Content-Length."""
    held, source = bytearray(), inflated(stream)
    need = -1
    while True:
        if need < 0 and (end := held.find(b"\r\n\r\n")) >= 0:
            fields = dict(line.split(": ", 1) for line in bytes(held[:end]).decode().split("\r\n")[1:])
            need = end + 4 + int(fields["Content-Length"]) + 4
        if 0 <= need <= len(held):
            yield bytes(held[:need])
            del held[:need]
            need = -1
            continue
        piece = next(source, None)
        if piece is None:
            if held:
                raise ValueError("the archive ends inside a record")
            return
        held += piece


def place(address: str):
    """pyarrow's file system and path for an address."""
    return fs.FileSystem.from_uri(address)


def attempt_name() -> str:
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"


def write(rows: DataFrame, folder: str) -> DataFrame:
    """One monolithic archive per task; returns (archive) of finished files. Materialise it once: each run writes anew."""

    def run(batches):
        system, base = place(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/whole-{attempt_name()}.warc.gz"
        packer, out, n = gzip_writer(), None, 0
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(7))):
                page, url, payload, _, digest, kind, refers = (x.as_py() for x in row)
                if out is None:
                    out = system.open_output_stream(name, compression=None)
                if made := packer.compress(record(page, url, payload, digest, kind, refers)):
                    out.write(made)
                n += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([n], pa.int64())], ["archive", "records"])

    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member per record and a sidecar index; returns the index rows."""

    def run(batches):
        system, base = place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = f"members-{name.removesuffix('.warc.gz')}-{attempt_name()}.warc.gz"
                rows, offset = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as source, system.open_output_stream(f"{base}/{new}", compression=None) as out:
                    for raw in records(source):
                        fields, _ = parse(raw)
                        packed = member(raw)
                        out.write(packed)
                        page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                        rows.append((None if page == "null" else int(page), new, offset, len(packed), fields["WARC-Type"]))
                        offset += len(packed)
                with system.open_output_stream(f"{base}/{new}.idx", compression=None) as out:
                    out.write("".join(f"{'null' if p is None else p} {o} {size} {kind}\n" for p, _, o, size, kind in rows).encode())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["page_id", "archive", "offset", "length", "record_type"])

    return archives.select("archive").mapInArrow(run, INDEX)


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Records of normalised archives by their sidecar indexes: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    A response's digest and length are computed from the payload read; a revisit's are the recorded ones, which `verified` holds against the response
    that it refers to. intact: what is recorded and what is read agree."""

    def run(batches):
        system, base = place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    entries = [line.split(" ") for line in io.TextIOWrapper(f, "utf-8").read().splitlines()]
                rows = []
                with system.open_input_file(f"{base}/{name}") as source:
                    for page, offset, length, kind in entries:
                        source.seek(int(offset))
                        fields, block = parse(zlib.decompress(source.read(int(length)), 31))
                        payload = block.partition(b"\r\n\r\n")[2]
                        noted = (int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        got = noted if kind == "revisit" else (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
                        refers = int(fields["WARC-Refers-To"][len("<urn:page:") : -1]) if kind == "revisit" else None
                        rows.append((None if page == "null" else int(page), *got, fields["WARC-Type"], refers, got == noted and fields["WARC-Type"] == kind))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

    return archives.select("archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def spread(names: DataFrame) -> DataFrame:
    """Archive names (one per writing task), a task each."""
    found = sorted(r["archive"] for r in names.select("archive").collect())
    table = names.sparkSession.createDataFrame(list(enumerate(found)), "place int, archive string")
    return table.repartitionById(max(1, len(found)), F.col("place")).select("archive")


def remove(archives: DataFrame, folder: str) -> None:
    """Deletes archives."""

    def run(batches):
        system, base = place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if system.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{base}/{name}")
            yield batch

    archives.mapInArrow(run, "archive string").count()


def verified(rows: DataFrame) -> DataFrame:
    """Records read back, with revisits held against the payload of the response that they refer to.

    Only different (response, length, digest) triples meet the responses, so a response that many revisits name is one row."""
    known = ["refers_to", "payload_bytes", "payload_digest"]
    responses = rows.where("record_type = 'response' and intact").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    wrong = rows.where("record_type = 'revisit'").select(*known).distinct().join(responses, known, "left_anti").withColumn("wrong", F.lit(True))
    return rows.join(wrong, known, "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("intact") & F.col("wrong").isNull()).alias("intact"))


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0, **columns) -> DataFrame:
    """Writes pages as archives, normalises them and reads them back."""
    folder = folder or scratch(pages.sparkSession, "warc")
    whole = saved(write(classified(pages, least, **columns), folder), "warc-whole")
    index = saved(normalise(spread(whole), folder), "warc-index")
    remove(spread(whole), folder)  # the monoliths are done with
    return verified(saved(read(spread(index.select("archive").distinct()), folder), "warc-read"))
