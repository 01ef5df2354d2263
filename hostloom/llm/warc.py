"""Web archives: a converter from legacy ARC files to WARC files, with readers and writers of both.

An ARC file begins with a version block, whose first line is a URL record of its own and whose second line tells the
version; that version decides which fields the header lines of the documents have, and the last field of each is the
declared length of the document that follows. The converter walks a file by these lengths and gives each document the
equivalent WARC header: an identifier made from the file and the offset, the timestamp in ISO form, the record type by
the document's scheme, and digests of block and payload. Every record is a gzip member of its own, in both formats.

A file is read record by record by one task and written up to a bounded size, so memory follows the largest record.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs  # noqa: F401  as pa.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, narrow_batches, tidy

#: Uncompressed bytes and records after which a writer begins another file; least bytes of a payload that may be revisited.
FILE_BYTES, FILE_RECORDS, LEAST = 64 << 20, 20_000, 1000
#: Fields of a header line by the version that the file declares (fixed values of the format).
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: A URL may hold spaces and so may a media type: the address, the date and the fields after the type can't.
_LINE = {1: re.compile(rb"(.*?) (\S+) (\d{12,14}) (.*) (\d+)"), 2: re.compile(rb"(.*?) (\S+) (\d{12,14}) (.*) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)")}
_NOT_IN_URLS = {c: f"%{c:02X}" for c in range(33)}
_EMPTY_LINE = re.compile(rb"\r\n\r\n|\n\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, n_records long, n_bytes long"
ARC_ROWS = "path string, offset long, version long, record_id string, type string, uri string, date string, http string, payload_bytes long, sha1 string, sha256 string"
WARC_ROWS = "record_id string, type string, uri string, date string, http string, refers_to string, payload_digest string, payload_bytes long, sha1 string"


# Storage: files in the shared folder, or any store that Arrow can open


def place(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith(("/", "file:")):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)


class Members:
    """A file of gzip members, or a plain one, read as one stream: memory is bounded whatever the file's size."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.held, self.at = raw, b"", 0
        self.left = raw.read(2)
        self.z = zlib.decompressobj(31) if self.left == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Reads on; whether there was anything."""
        while True:
            data = self.left or self.raw.read(1 << 16)
            if not data:
                if self.z and not self.z.eof:
                    raise EOFError("the last gzip member is cut off")
                return False
            self.left = b""
            if self.z is None:
                self.held += data
                return True
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data, 1 << 22)
            self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                self.held += out
                return True

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more():
                raise EOFError(f"{n} bytes are declared, {have} are left")
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held, self.at = whole[n:], self.at + n
        return whole[:n]

    def line(self, most: int = 1 << 20) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (k := self.held.find(b"\n")) < 0:
            if len(self.held) > most:
                raise ValueError("a header line without an end")
            before, self.held = self.held, b""
            if not self.more():
                self.at += len(before)
                return before or None
            self.held = before + self.held
        out, self.held = self.held[:k], self.held[k + 1 :]
        self.at += k + 1
        return out.removesuffix(b"\r")


class Files:
    """A writer of record files below a folder. Each file has a name of its own, and only files that the task's rows name
    are ever read, so what a lost task leaves behind does no harm."""

    def __init__(self, folder: str, suffix: str, head):
        self.folder, self.suffix, self.head = folder, suffix, head
        self.out, self.done = None, []

    def add(self, record: bytes) -> tuple[str, int]:
        """Writes a record; its file and offset among the uncompressed bytes."""
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            system, at = place(self.name)
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            self.out, self.n, self.size = system.open_output_stream(at, compression=None), 0, 0
            self._put(self.head(self.name))
        at = self.size
        self._put(record)
        self.n += 1
        name = self.name
        if self.size >= FILE_BYTES or self.n >= FILE_RECORDS:
            self.close()
        return name, at

    def _put(self, record: bytes) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(z.compress(record) + z.flush())
        self.size += len(record)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.n, self.size))
            self.out = None

    def rows(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])


# ARC


class ArcRecord(NamedTuple):
    offset: int
    version: int
    fields: dict[str, str]
    block: bytes


def arc_line(line: bytes, version: int) -> dict[str, str]:
    """The fields of a document's header line under the file's version."""
    found = _LINE[version].fullmatch(line)
    if not found:
        raise ValueError(f"no header line of version {version}: {line[:200]!r}")
    return dict(zip(FIELDS[version], (v.decode("utf-8", "replace") for v in found.groups()), strict=True))


def arc_records(raw: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block among them. Empty lines between records are passed over."""
    source, version = Members(raw), None
    while True:
        at = source.at
        line = source.line()
        if line is None:
            return
        if not line:
            continue
        # the version block's own line has the fields of version 1; its body begins with the version
        fields = arc_line(line, version or 1)
        block = source.take(int(fields["length"]))
        if version is None:
            if not line.startswith(b"filedesc:"):
                raise ValueError("an ARC file begins with a version block")
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
        yield ArcRecord(at, version, fields, block)


def arc_head(version: int, name: str, date: str = "19960101000000", origin: str = "hostloom") -> bytes:
    body = f"{version} 0 {origin}\n{TITLES[version]}\n".encode()
    return f"filedesc://{name.rsplit('/', 1)[-1]} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, date: str, content_type: str, block: bytes, result: str = "200") -> bytes:
    checksum = base64.b32encode(hashlib.sha1(block).digest()).decode()
    more = f" {result} {checksum} - {offset} {name.rsplit('/', 1)[-1]}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {content_type}{more} {len(block)}\n".encode("utf-8", "replace") + block + b"\n"


# WARC


def iso_date(date: str) -> str:
    """An ARC date of 12 to 14 digits in ISO form; seconds that it doesn't give are 0."""
    full = date.ljust(14, "0")
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_type(url: str, block: bytes) -> str:
    scheme = url.split(":", 1)[0].lower()
    if scheme == "filedesc":
        return "warcinfo"
    return "response" if scheme in ("http", "https") and block.startswith(b"HTTP/") else "resource"


def record_id(path: str, offset: int, url: str, date: str) -> str:
    """The identifier of the document at an offset of a file; the same however often the file is converted, and wherever it lies."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join((path.rsplit('/', 1)[-1], str(offset), date, url)))}>"


def payload(block: bytes, kind: str) -> tuple[bytes, bytes]:
    """The HTTP header of a response, with its empty line, and what follows it; other documents are all payload."""
    if kind != "response":
        return b"", block
    found = _EMPTY_LINE.search(block)
    at = found.end() if found else len(block)
    return block[:at], block[at:]


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    body = b"software: hostloom\r\nformat: WARC file version 1.1\r\n"
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Date", "1996-01-01T00:00:00Z"), ("WARC-Filename", name.rsplit("/", 1)[-1]), ("WARC-Record-ID", record_id(name, 0, "", "")), ("Content-Type", "application/warc-fields")], body)


def converted(path: str, record: ArcRecord, revisit: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; as a revisit it keeps the HTTP header and names the record it refers to."""
    f = record.fields
    kind = record_type(f["url"], record.block)
    head, body = payload(record.block, kind)
    block = head if revisit else record.block
    media = "application/http; msgtype=response" if kind == "response" else "text/plain" if kind == "warcinfo" else f["content_type"]
    headers = [("WARC-Type", "revisit" if revisit else kind), ("WARC-Record-ID", record_id(path, record.offset, f["url"], f["date"])), ("WARC-Date", iso_date(f["date"])), ("Content-Type", media)]
    if kind == "warcinfo":
        return warc_record([*headers, ("WARC-Filename", path.rsplit("/", 1)[-1])], block)
    headers += [("WARC-Target-URI", f["url"]), ("WARC-Block-Digest", sha1_32(block)), ("WARC-Payload-Digest", sha1_32(body))]
    if f["ip"] != "0.0.0.0":  # noqa: S104  the placeholder of an unknown address
        headers.append(("WARC-IP-Address", f["ip"]))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", revisit[0]), ("WARC-Refers-To-Target-URI", revisit[1]), ("WARC-Refers-To-Date", revisit[2])]
    return warc_record(headers, block)


def warc_records(raw: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, in lower case, and block of each record of a WARC file."""
    source = Members(raw)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:200]!r}")
        headers, name = {}, ""
        while line := source.line():
            if line[:1] in b" \t" and name:  # a folded line
                headers[name] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
        yield headers, source.take(int(headers["content-length"]))


@contextlib.contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    """The file's bytes; what is wrong with it is told with its name."""
    system, at = place(path)
    with system.open_input_stream(at, compression=None) as raw:
        try:
            yield raw
        except (EOFError, ValueError, zlib.error) as e:
            raise ValueError(f"{path}: {e}") from e


# As DataFrames


def spread(files: DataFrame) -> DataFrame:
    """A task a file: their rows are few and small, but not their work."""
    return files.repartition(max(1, files.count()))


def record_batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [c.split() for c in schema.split(", ")]
    for part in itertools.batched(rows, 512):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64() if t == "long" else pa.string()) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def each_file(rows, schema: str):
    """A map over tables of paths: rows of schema that rows(path, raw) gives for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as raw:
                    yield from record_batches(rows(path, raw), schema)

    return tidy(run)


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "19960101000000") -> DataFrame:
    """ARC files of pages below folder, as rows path, n_records, n_bytes. Lazy: to be written once.

    A row is an HTTP response with the row's id in a header, X-Page-Id (none for a null id); a null body is empty, a null
    url 'http://null/'; a url that isn't of HTTP is 'http://' and what it says, white space in it percent-encoded. Partitions
    write versions 1 and 2 in turn. An empty table gives no file.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        out = Files(folder, ".arc.gz", lambda name: arc_head(version, name, date))
        for batch in batches:
            for page, url, body in zip(*batch.columns, strict=True):
                data = body.as_buffer().to_pybytes() if body.is_valid else b""
                url = (url.as_py() or "http://null/").translate(_NOT_IN_URLS)
                url = url if url.lower().startswith(("http:", "https:")) else "http://" + url
                own = f"X-Page-Id: {page}\r\n" if page.is_valid else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(data)}\r\n\r\n"
                name, at = (out.name, out.size) if out.out else ("-", 0)
                out.add(arc_record(version, name, at, url, date, "text/html; charset=utf-8", head.encode() + data))
        yield out.rows()

    return rows.mapInArrow(tidy(run), FILES)


def arc_index(files: DataFrame) -> DataFrame:
    """Per document of ARC files: path, offset, version, record_id, type, uri, date, http (a response's header), payload_bytes,
    sha1, sha256. The version blocks are left out. files: path, a written table."""

    def rows(path: str, raw: BinaryIO) -> Iterator[tuple]:
        for r in arc_records(raw):
            f, kind = r.fields, record_type(r.fields["url"], r.block)
            if kind != "warcinfo":
                head, body = payload(r.block, kind)
                own = path, r.offset, r.version, record_id(path, r.offset, f["url"], f["date"]), kind, f["url"], iso_date(f["date"]), head.decode("utf-8", "replace")
                yield *own, len(body), hashlib.sha1(body).hexdigest(), hashlib.sha256(body).hexdigest()

    return spread(files.select("path")).mapInArrow(each_file(rows, ARC_ROWS), ARC_ROWS)


def page_id(http: str = "http"):
    """The id that write_arc() put into a response's header; null if there is none."""
    return F.nullif(F.regexp_extract(F.col(http), r"\r\nX-Page-Id: (-?\d+)\r\n", 1), F.lit("")).cast("long")


def arc_to_warc(files: DataFrame, folder: str, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Converts ARC files to WARC files below folder, as rows path, n_records, n_bytes. Lazy: to be written once.

    files: path, a written table. Of documents of equal payloads of least bytes or more, the one of the largest X-Page-Id (then path and
    offset; none is the smallest) stays what it is and the others become revisits of it. Payloads are equal if both of
    their digests and their lengths are. A file that breaks off or has a header line of another form is an error that
    names it.
    """
    index = scratch.cut(arc_index(files))
    may = index.filter((F.col("payload_bytes") >= least) & (F.col("type") == "response"))
    key = ["sha256", "sha1", "payload_bytes"]
    order = F.struct(page_id().alias("page"), "path", "offset", "record_id", "uri", "date")
    groups = scratch.cut(may.groupBy(*key).agg(F.max(order).alias("of"), F.count("*").alias("n")).filter("n > 1"))
    revisits = may.select("path", "offset", *key).join(groups.hint("merge"), key).filter("path <> of.path or offset <> of.offset")
    # a file has FILE_RECORDS records at most where this module wrote it, and a file's records are one task's anyway
    told = scratch.cut(revisits.groupBy("path").agg(F.collect_list(F.struct("offset", "of.record_id", "of.uri", "of.date")).alias("revisits")))
    rows = files.select("path").join(told, "path", "left").repartition(max(1, files.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Files(folder, ".warc.gz", warc_info)
        for batch in batches:
            for path, revisits in zip(*batch.columns, strict=True):
                path = path.as_py()
                refers = {r["offset"]: (r["record_id"], r["uri"], r["date"]) for r in revisits.as_py() or []}
                with opened(path) as raw:
                    for r in arc_records(raw):
                        out.add(converted(path, r, refers.get(r.offset)))
        yield out.rows()

    return rows.mapInArrow(tidy(run), FILES)


def read_warc(files: DataFrame) -> DataFrame:
    """Per record of WARC files, warcinfo left out: record_id, type, uri, date, http, refers_to, payload_digest (as the
    header gives it), payload_bytes and sha1 (lower-case hex) of the payload that the record holds, both null for a revisit. A
    payload whose digest isn't that of its header ends in an error. files: path, a written table."""

    def rows(path: str, raw: BinaryIO) -> Iterator[tuple]:
        for h, block in warc_records(raw):
            kind, digest = h["warc-type"], h.get("warc-payload-digest")
            if kind == "warcinfo":
                continue
            head, body = payload(block, "response" if kind == "revisit" else kind)
            own = (None, None) if kind == "revisit" else (len(body), hashlib.sha1(body).hexdigest())
            if kind != "revisit" and digest and digest.startswith("sha1:") and digest != sha1_32(body):
                raise ValueError(f"the payload of {h['warc-record-id']} has another digest than its header tells")
            yield h["warc-record-id"], kind, h.get("warc-target-uri"), h.get("warc-date"), head.decode("utf-8", "replace"), h.get("warc-refers-to"), digest, *own

    return spread(files.select("path")).mapInArrow(each_file(rows, WARC_ROWS), WARC_ROWS)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST) -> DataFrame:
    """pages, written as ARC files, converted to WARC files and read back. Per row: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    Of rows of equal payloads of least bytes or more, that of the largest id is the response (a null id is the smallest; of
    rows that repeat an id, any) and the others revisit it: refers_to is its id. Smaller payloads are all responses. A
    null body is empty. An empty table gives an empty result. Other columns are not read.
    """
    narrow_batches(pages.sparkSession, 256)
    scratch = Scratch(pages.sparkSession)
    arcs = scratch.cut(write_arc(pages, f"{scratch.path}/arc", id_col, url_col, body_col))
    warcs = scratch.cut(arc_to_warc(arcs, f"{scratch.path}/warc", scratch, least))
    records = scratch.cut(read_warc(warcs).withColumn("page_id", page_id()))
    held = records.filter("type <> 'revisit'").select("record_id", "page_id", "payload_bytes", F.col("sha1").alias("payload_digest"))
    own = held.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    # a revisit's full payload is that of the record it refers to; revisits of one record meet it in a join whose hot keys are split
    of = held.select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = records.filter("type = 'revisit'").select("page_id", F.col("refers_to").alias("of")).join(of.hint("merge"), "of", "left")
    return own.unionByName(again.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP13_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS body FROM pages),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS of_page FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN of_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN of_page <> page_id THEN of_page END AS refers_to FROM w
"""
