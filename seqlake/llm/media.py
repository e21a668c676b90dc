"""Content-addressed media in tar shards.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the samples
of a grey 8-bit PNG image 64 pixels wide. Equal contents are stored once, under the digest
of the stored form; rows carry digest, shard, offset and length. Metadata columns come from
reads of an image's first bytes at its offset, never of whole shards.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from seqlake.llm.shared import new_path, open_fs, ship, table

WIDTH, SHARD_BYTES, HEADER = 64, 32 << 20, 33
#: Contents that a task remembers; one that it forgets is stored again, and the index has one place of it.
KNOWN = 100_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 3) -> bytes:
    """PNG of the payload's bytes as rows of WIDTH pixels."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from an image's first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not an image of this format")
    width, height, bits, color = struct.unpack(">IIBB", data[16:26])
    if color != 0:
        raise ValueError("not a grey image")
    return width, height, bits


def decode(data: bytes) -> bytes:
    """The payload of an image; raises ValueError where a checksum or a row's filter is wrong."""
    width, height, _ = header(data)
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that this format doesn't use")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Height, mean, deviation, and a 64-bit average hash of the image's 8 x 8 areas."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    edge = np.linspace(0, len(x), 9).astype(int)
    total = np.concatenate((np.zeros((1, 8), np.int64), x.reshape(len(x), 8, 8).sum(2).cumsum(0)))
    area = (total[np.maximum(edge[1:], edge[:-1] + 1).clip(max=len(x))] - total[np.minimum(edge[:-1], len(x) - 1)]) / (8 * np.maximum(1, np.diff(edge)))[:, None]
    bits = (area > area.mean()).ravel()
    return f"h{len(x)}:m{x.mean():.3f}:s{x.std():.3f}:{int("".join("1" if b else "0" for b in bits), 2):016x}"


def _store(folder: str):
    def run(frames):
        """(doc_id, text) to tar shards; a row for each: doc_id, n_bytes, digest, path, offset, length. Of KNOWN contents each is written once by a task."""
        import pyarrow as pa

        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, at, path = None, 0, ""
        known: dict = {}
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for b in frames:
            rows: list = []
            for doc, item in zip(b.column(0).to_pylist(), b.column(1)):
                text = item.as_py()
                raw = (text or "").encode("utf-8", "surrogatepass")
                content = hashlib.sha256(raw).digest()
                if content not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    data = encode(payload_of(text))
                    digest = hashlib.sha256(data)
                    if out is None or at > SHARD_BYTES:
                        if out is not None:
                            out.write(bytes(1024))
                            out.close()
                        name = f"{uuid.uuid4().hex}.tar"
                        out, at, path = fs.open_output_stream(f"{base}/{name}"), 0, f"{folder}/{name}"
                    info = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                    info.size = len(data)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % 512))
                    known[content] = (digest.digest(), path, at + 512, len(data))
                    at += 512 + len(data) + -len(data) % 512
                rows.append((doc, len(raw), *known[content]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return run


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, index) of ``docs`` (doc_id, text): rows of doc_id, n_bytes, digest; index of digest, path, offset, length.

    Texts are not shuffled: each task writes the distinct contents of its rows, and of the places
    of a digest the index has the least. A null text is an empty one; repeated rows and null
    doc_ids are rows like others. A shard that a lost task leaves is in no index. An empty table has an empty index.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = table(d.mapInArrow(_store(new_path(spark, "media")), "doc_id long, n_bytes long, digest binary, path string, offset long, length long"), "media-rows")
    place = rows.groupBy("digest").agg(F.min(F.struct("path", "offset", "length")).alias("p"))
    return rows.select("doc_id", "n_bytes", "digest"), table(place.select("digest", "p.*"), "media-index")


def _read(frames):
    """(digest, path, offset, length) sorted by path and offset to digests and features of the stored bytes."""
    import pyarrow as pa

    at, f = None, None
    names = ("digest", "width", "height", "bits", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    for b in frames:
        rows: list = []
        for digest, path, offset, length in zip(*(b.column(i).to_pylist() for i in range(4))):
            if path != at:
                fs, name = open_fs(path)
                at, f = path, fs.open_input_file(name)
            f.seek(offset)
            head = header(f.read(HEADER))
            f.seek(offset)
            data = f.read(length)
            payload = decode(data)
            rows.append((digest, *head, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
        if rows:
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=pa.schema(list(zip(names, kinds))))


def _headers(frames):
    import pyarrow as pa

    at, f = None, None
    for b in frames:
        rows: list = []
        for digest, path, offset in zip(*(b.column(i).to_pylist() for i in range(3))):
            if path != at:
                fs, name = open_fs(path)
                at, f = path, fs.open_input_file(name)
            f.seek(offset)
            rows.append((digest, *header(f.read(HEADER))))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("digest", "width", "height", "bits"), map(list, zip(*rows)))), schema=pa.schema([("digest", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32())]))


def metadata(index: DataFrame) -> DataFrame:
    """(digest, width, height, bits) of every stored image, from reads of HEADER bytes each."""
    ship(index.sparkSession)
    return index.select("digest", "path", "offset").repartition("path").sortWithinPartitions("path", "offset").mapInArrow(_headers, "digest binary, width int, height int, bits int")


def features(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Every row with its media's metadata, from header reads, and the digests and features of its stored bytes, read back whole."""
    ship(index.sparkSession)
    spread = index.select("digest", "path", "offset", "length").repartition("path").sortWithinPartitions("path", "offset")
    got = spread.mapInArrow(_read, "digest binary, width int, height int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    got = table(got, "media-features")
    return rows.join(got, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")
