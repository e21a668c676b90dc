"""Legacy web archives (ARC) to WARC: header lines by version, declared lengths, synthesised WARC fields.

An ARC record is a header line, as many bytes as it declares, and a line break. Version 1 has
five fields (URL, IP address, 14-digit date, type, length), version 2 ten (URL, IP address,
date, type, result code, checksum, location, offset, file name, length); the version is on
the second line of the file's first record, ``filedesc://``. URLs may hold spaces, so fields
are counted from the line's end.

The converter reads records by their declared lengths and never looks for a marker inside a
payload. Files are written as one gzip member for each record, as archives of both formats
commonly are; offsets are those of the uncompressed file, and plain files are read too. Of each it makes a WARC record: an id that is a name-based UUID of the file and
offset, the date in ISO 8601, a type (``warcinfo`` for the file description, ``response``
where the block starts with a status line, else ``resource``), and SHA-256 digests of block
and payload. Payloads that occur before become ``revisit`` records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from seqlake.llm.shared import new_path, open_fs, ship, table

#: Compressed bytes after which an archive file ends and the next begins, the compression's level, and the least payload that is a revisit.
FILE_BYTES, LEVEL, LEAST_REVISIT = 8 << 20, 3, 100
STATUS = re.compile(rb"HTTP/\d\.\d \d{3}")


def arc_head(version: int, name: str) -> bytes:
    """The first record of an ARC file."""
    fields = b"URL IP-address Archive-date Content-type Archive-length" if version == 1 else b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = b"%d 0 seqlake\n%s\n" % (version, fields)
    extra = b"" if version == 1 else b"200 - - 0 " + name.encode() + b" "
    return b"filedesc://%s 0.0.0.0 19960101000000 text/plain %s%d\n%s\n" % (name.encode(), extra, len(body), body)


def arc_record(version: int, url: str, date: str, block: bytes, offset: int, name: str) -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    extra = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{safe} 0.0.0.0 {date} text/html {extra}{len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"


class BadRecord(ValueError):
    """A header line or a length that the format does not allow."""


def read_arc(f, lenient: bool = False):
    """(offset, fields, block) of each record of an open ARC file; the version comes from its first record.

    A malformed header line or a file that ends inside a record raises BadRecord. ``lenient``
    gives (offset, None, why) instead and goes on with the next line that is a header.
    """
    version, offset = 0, 0
    while line := f.readline():
        if line == b"\n":
            offset += 1
            continue
        count = 10 if version == 2 or not version and len(line.split()) >= 10 else 5
        part = line.rstrip(b"\r\n").rsplit(b" ", count - 1)
        why = None
        if len(part) != count or not part[-1].isdigit() or lenient and not part[2].isdigit():
            why = f"at {offset}: {line[:80]!r}"
        else:
            size = int(part[-1])
            block = f.read(size)
            if len(block) != size:
                why = f"at {offset}: {len(block)} of {size} bytes"
            elif not version:
                first = block.split(b" ", 1)[0]
                version = int(first) if first.isdigit() else 0
                if version not in (1, 2):
                    why = f"version {version}"
        if why:
            if not lenient:
                raise BadRecord(why)
            yield offset, None, why.encode()
            offset += len(line)
            continue
        names = ("url", "ip", "date", "type", "length") if count == 5 else ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length")
        yield offset, dict(zip(names, (p.decode("utf-8", "surrogatepass") for p in part))), block
        offset += len(line) + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload); without a status line all is payload."""
    if not STATUS.match(block):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")


def iso(date: str) -> str:
    """A 14-digit date as ISO 8601; shorter ones are filled up, others become the epoch."""
    try:
        return datetime.strptime((date + "19960101000000"[len(date) :])[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>"


def warc_record(kind: str, rid: str, url: str, date: str, block: bytes, payload: bytes | None, media: str, extra: dict | None = None) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": date}
    if kind != "warcinfo":
        head["WARC-Target-URI"] = url
    if payload is not None:
        head["WARC-Payload-Digest"] = "sha256:" + hashlib.sha256(payload).hexdigest()
    head |= {"WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Type": media, **(extra or {}), "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(f):
    """(fields, block) of each record of an open WARC file, by declared lengths."""
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise BadRecord(repr(line[:80]))
        head = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.partition(b":")
            head[k.decode().lower()] = v.strip().decode("utf-8", "surrogatepass")
        size = int(head["content-length"])
        block = f.read(size)
        if len(block) != size:
            raise BadRecord("the file ends inside a record")
        yield head, block


def _opened(uri: str):
    """A buffered binary reader of an archive file, compressed or plain."""
    import io

    fs, name = open_fs(uri)
    f = io.BufferedReader(fs.open_input_stream(name, compression=None), 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 20) if name.endswith(".gz") else f


def _files(folder: str, suffix: str):
    """Makes new files in ``folder``; write(record) compresses it and gives (path, offset)."""
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    held: list = []

    def write(data: bytes, head=None) -> tuple[str, int]:
        if not held or held[1] > FILE_BYTES:
            close()
            name = f"{uuid.uuid4().hex}{suffix}"
            held.extend([fs.open_output_stream(f"{base}/{name}", compression=None), 0, name])
            if head:
                first = gzip.compress(head(name), LEVEL, mtime=0)
                held[0].write(first)
                held[1] += len(first)
        at, data = held[1], gzip.compress(data, LEVEL, mtime=0)
        held[0].write(data)
        held[1] += len(data)
        return f"{folder}/{held[2]}", at

    def close() -> None:
        if held:
            held[0].close()
            held.clear()

    return write, close


def _to_arc(folder: str, of: int):
    def run(frames):
        """(page_id, url, html) to ARC files; each file once."""
        import pyarrow as pa

        from pyspark import TaskContext

        write, close = _files(folder, ".arc.gz")
        seen: dict = {}
        version = of or 1 + TaskContext.get().partitionId() % 2
        for b in frames:
            for page, url, html in zip(*(b.column(i).to_pylist() for i in range(3))):
                body = (html or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: %s\r\nContent-Length: %d\r\n\r\n" % (b"-" if page is None else str(page).encode(), len(body)) + body
                path, _ = write(arc_record(version, url or "", "20200101000000", block, 0, "-"), lambda name: arc_head(version, name))
                seen[path] = seen.get(path, 0) + 1
        close()
        if seen:
            yield pa.RecordBatch.from_pydict({"path": list(seen), "records": list(seen.values())}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return run


def write_arc(pages: DataFrame, version: int = 1) -> DataFrame:
    """Legacy archives of ``pages`` (page_id, url, html): a manifest of their paths and records. Null html is an empty payload.

    ``version`` is 1 or 2, or 0 for both, by turns of partitions.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string"))
    return table(rows.mapInArrow(_to_arc(new_path(spark, "arc"), version), "path string, records long"), "arcs")


def page_of(head: bytes) -> int | None:
    m = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(m[1]) if m else None


def _index(lenient: bool):
    def run(frames):
        yield from _indexed(frames, lenient)

    return run


def _indexed(frames, lenient: bool):
    """ARC paths to (path, offset, digest, bytes, page_id)."""
    import pyarrow as pa

    names = ("path", "offset", "digest", "bytes", "page_id")
    for b in frames:
        for path in b.column(0).to_pylist():
            rows: list = []
            with _opened(path) as f:
                for offset, fields, block in read_arc(f, lenient):
                    if fields is None or fields["url"].startswith("filedesc://"):
                        continue
                    head, payload = split_http(block)
                    rows.append((path, offset, hashlib.sha256(payload).digest(), len(payload), page_of(head)))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64()), ("page_id", pa.int64())]))


def _convert(folder: str, lenient: bool):
    def run(frames):
        """(path, offset, first page, path and offset of the first, is it the first), sorted by path and offset, to WARC files."""
        import pyarrow as pa

        from seqlake.llm.minhash import groups

        write, close = _files(folder, ".warc.gz")
        made: dict = {}
        for (path,), t in groups(frames, 1):
            of = {r[0]: r[1:] for r in zip(*(t.column(i).to_pylist() for i in range(1, 6)))}
            with _opened(path) as f:
                for offset, fields, block in read_arc(f, lenient):
                    if fields is None:
                        continue
                    short = path.rsplit("/", 1)[-1]
                    rid, date = record_id(short, offset), iso(fields["date"])
                    if fields["url"].startswith("filedesc://"):
                        info = f"software: seqlake\r\nformat: WARC File Format 1.0\r\nconverted-from: {short}\r\n".encode()
                        data = warc_record("warcinfo", rid, "", date, info, None, "application/warc-fields")
                    else:
                        head, payload = split_http(block)
                        page, first_path, first_offset, again = of[offset]
                        http = bool(head)
                        kind = "revisit" if again else "response" if http else "resource"
                        extra = {"WARC-IP-Address": fields["ip"]} if fields["ip"] != "0.0.0.0" else {}
                        if again:
                            extra |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first_path.rsplit("/", 1)[-1], first_offset), "X-Refers-To-Page": str(page), "X-Payload-Length": str(len(payload))}
                        data = warc_record(kind, rid, fields["url"], date, head if again else block, payload, "application/http; msgtype=response" if http else fields["type"], extra)
                    at, _ = write(data)
                    made[at] = made.get(at, 0) + 1
        close()
        if made:
            yield pa.RecordBatch.from_pydict({"path": list(made), "records": list(made.values())}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return run


def _damaged(frames):
    import pyarrow as pa

    for b in frames:
        for path in b.column(0).to_pylist():
            with _opened(path) as f:
                rows = [(path, offset, why.decode("utf-8", "replace")) for offset, fields, why in read_arc(f, True) if fields is None]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("path", "offset", "why"), map(list, zip(*rows)))), schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("why", pa.string())]))


def damaged(arcs: DataFrame) -> DataFrame:
    """(path, offset, why) of the header lines and records in a manifest's ARC files that the format does not allow."""
    ship(arcs.sparkSession)
    return _dealt(arcs.select("path")).mapInArrow(_damaged, "path string, offset long, why string")


def _tasks(paths: DataFrame) -> int:
    """Tasks over files of some megabytes: one a file, and several files a task where there are many."""
    n = paths.count()
    return max(1, min(n, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n // 8)


def _dealt(paths: DataFrame) -> DataFrame:
    return paths.repartition(_tasks(paths))


def convert(arcs: DataFrame, lenient: bool = False) -> DataFrame:
    """WARC files of the ARC files in a manifest (path); a manifest of their paths and records.

    Of records with equal payloads of at least LEAST_REVISIT bytes, that with the smallest
    page id (then path and offset) stays a response and the others become revisits that name
    it; they keep their HTTP head and the payload's digest. A malformed header line or a file
    that ends inside a record raises BadRecord, or with ``lenient`` is left out: ``damaged``
    lists what is. No files: no files.
    """
    spark = arcs.sparkSession
    ship(spark)
    paths = arcs.select("path")
    spread = _tasks(paths)
    index = table(paths.repartition(spread).mapInArrow(_index(lenient), "path string, offset long, digest binary, bytes long, page_id long"), "arc-index")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset")
    first = table(index.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("m")).where("n > 1").select("digest", "m"), "firsts")
    long_ones = index.join(first, "digest", "left")
    again = (F.col("bytes") >= LEAST_REVISIT) & F.col("m").isNotNull() & ~((F.col("m.path") == F.col("path")) & (F.col("m.offset") == F.col("offset")))
    rows = long_ones.select("path", "offset", F.col("m.page_id").alias("page"), F.col("m.path").alias("fp"), F.col("m.offset").alias("fo"), F.coalesce(again, F.lit(False)).alias("again"))
    rows = table(rows, "revisits")
    empty = paths.join(rows.select("path").distinct(), "path", "left_anti").select("path", *[F.lit(None).cast(t).alias(c) for c, t in (("offset", "long"), ("page", "long"), ("fp", "string"), ("fo", "long"), ("again", "boolean"))])
    placed = rows.union(empty).repartition(spread, "path").sortWithinPartitions("path", "offset")
    return table(placed.mapInArrow(_convert(new_path(spark, "warc"), lenient), "path string, records long"), "warcs")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string, block_bytes long"


def _read(frames):
    import pyarrow as pa

    for b in frames:
        for path in b.column(0).to_pylist():
            rows: list = []
            with _opened(path) as f:
                for head, block in read_warc(f):
                    if head["warc-type"] == "warcinfo":
                        continue
                    if head["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                        raise BadRecord(head["warc-record-id"])
                    http, payload = split_http(block)
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    again = head["warc-type"] == "revisit"
                    if again:  # the payload is the other record's
                        size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                    rows.append((page_of(http), size, digest, head["warc-type"], int(head["x-refers-to-page"]) if again else None, head["warc-record-id"], head["warc-date"], head["warc-target-uri"], len(block)))
            if rows:
                schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()), ("block_bytes", pa.int64())])
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema)


def read(warcs: DataFrame) -> DataFrame:
    """READ columns of every record but file descriptions, from the files that a manifest names."""
    ship(warcs.sparkSession)
    return _dealt(warcs.select("path")).mapInArrow(_read, READ)
