"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive is ``name.warc.zst``: a skippable frame (magic 0x184D2A5D) whose content is the dictionary,
then one frame per WARC record, each written with that dictionary and its content size. The reader
loads the dictionary, decodes frame by frame and checks versions, required headers, lengths and digests.
Archives are written to a folder that all executors share and are read through Spark's ``binaryFile``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import join_kind, map_arrow, shared_dir, spread_join, stored

#: Folder of what task attempts write, below that of the archives.
ATTEMPTS = "_attempts"
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Uncompressed bytes after which a task starts its next archive, so that an archive fits in a worker.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
#: Compressed bytes that the reader feeds at a time.
SLICE_BYTES = 16 << 10
#: Payloads (by bytes) that a dictionary is trained on.
DICTIONARY_SAMPLE_BYTES = 2 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2000-01-01T00:00:00Z"
NO_DIGEST = hashlib.sha256(b"").hexdigest()


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_id(page_id: int | None, digest: str) -> str:
    """The id of the record of a page with this payload; a page_id with several payloads has several records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or revisit record; a revisit keeps the HTTP header, with the length of the payload, and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", "".join(quote(c) if c.isspace() or ord(c) < 32 else c for c in url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"a header without a name: {line[:60]!r}")
        out[name.strip().decode("utf-8").lower()] = value.strip().decode("utf-8")
    return out


def parse_record(raw: bytes) -> dict:
    """Fields of one record; WarcError where version, headers, lengths or the digest are wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if not found or not version.startswith(b"WARC/1."):
        raise WarcError("not a WARC record")
    h = _headers(fields)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not h.get(name):
            raise WarcError(f"{name} is missing")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block does not have the stated length")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    if not found:
        raise WarcError("the block has no HTTP header")
    size = int(_headers(http.partition(b"\r\n")[2])["content-length"])
    digest = h.get("warc-payload-digest", "").partition(":")[2]
    if h["warc-type"] == "response":
        if len(payload) != size:
            raise WarcError("the payload does not have the length of its HTTP header")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("the payload does not have the stated digest")
    elif payload:
        raise WarcError("a revisit with a payload")
    number = lambda k: int(h[k]) if h.get(k) else None
    return {"page_id": number("x-page-id"), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload": payload if h["warc-type"] == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": number("x-refers-to-page-id")}


class ArchiveWriter:
    """Collects records and gives the bytes of an archive."""

    def __init__(self, dictionary: bytes):
        self.head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)
        self.frames: list[bytes] = []
        self.size = 0

    def add(self, record: bytes) -> None:
        self.frames.append(self.zip.compress(record))
        self.size += len(record)

    def take(self) -> bytes:
        out, self.frames, self.size = self.head + b"".join(self.frames), [], 0
        return out


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def read_archive(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    if len(raw) < 8:
        raise WarcError("the archive is cut off")
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICTIONARY_MAGIC or len(raw) < 8 + size:
        raise WarcError("the archive does not begin with its dictionary")
    held = raw[8 : 8 + size]
    if held[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
        held = zstandard.ZstdDecompressor().decompress(held)
    dictionary = zstandard.ZstdCompressionDict(held) if held else None
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    at, view = 8 + size, memoryview(raw)
    while at < len(raw):
        if raw[at : at + 4] != struct.pack("<I", FRAME_MAGIC):
            raise WarcError(f"no frame at byte {at}")
        stated = zstandard.get_frame_parameters(raw[at : at + 18]).content_size
        one, begin, parts = unzip.decompressobj(), at, []
        try:
            while not one.eof and at < len(raw):  # slices, as what follows a frame is copied
                parts.append(one.decompress(view[at : at + SLICE_BYTES]))
                at = min(len(raw), at + SLICE_BYTES)
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {begin} cannot be decoded: {e}") from e
        record = b"".join(parts)
        if not one.eof or (stated != zstandard.CONTENTSIZE_UNKNOWN and len(record) != stated):
            raise WarcError(f"the frame at byte {begin} does not have its stated length")
        at -= len(one.unused_data)
        yield record


def _digest() -> Column:
    return F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)


def revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, digest, refers_to): pages whose payload, of least_bytes or more, a page with a smaller id has too."""
    marks = pages.where(F.octet_length("html") >= least_bytes).select("page_id", _digest().alias("digest"))
    marks = stored(marks, "digests")
    first = marks.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return spread_join(marks, first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def _write(out_dir: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out_dir)
        task = TaskContext.get()
        stem, attempt, n = f"part-{task.partitionId():06d}", uuid.uuid4().hex, 0
        writer, early, early_bytes, names, counts = None, [], 0, [], []
        held = 0

        def close() -> None:
            """Each attempt writes files of its own; only those in the committed index are read."""
            nonlocal n, held
            name = f"{stem}-{n:05d}-{attempt}.warc.zst"
            with store.open_output_stream(f"{root}/{ATTEMPTS}/{name}", compression=None) as f:
                f.write(writer.take())
            names.append(name)
            counts.append(held)
            n, held = n + 1, 0

        def put(record: bytes) -> None:
            nonlocal held
            writer.add(record)
            held += 1
            if writer.size >= ARCHIVE_BYTES:
                close()

        def start() -> None:
            nonlocal writer
            writer = ArchiveWriter(train_dictionary([r for r in early if len(r) >= 64]))
            for r in early:
                put(r)
            early.clear()

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                record = record_bytes(page_id, url, "response" if refers_to is None else "revisit", payload, hashlib.sha256(payload).hexdigest(), refers_to)
                if writer is None:
                    early.append(record)
                    early_bytes += len(record)
                    if early_bytes >= DICTIONARY_SAMPLE_BYTES:
                        start()
                else:
                    put(record)
        if early:
            start()
        if writer is not None and held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "records"])

    return write


def _publish(out_dir: str):
    """Moves the files that the index names to where readers look; a move that was made before is left as it is."""

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out_dir)
        for b in batches:
            for name in b.column("name").to_pylist():
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    try:
                        store.move(f"{root}/{ATTEMPTS}/{name}", f"{root}/{name}")
                    except OSError:
                        if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                            raise
            yield b

    return publish


def write_archives(pages: DataFrame, out_dir: str | None = None, least_bytes: int = 100) -> tuple[str, int]:
    """Writes a record per row of pages (page_id, url, html) and gives the folder and the number of records.

    Null html is an empty payload, a null url an empty target. Of equal payloads of least_bytes or more
    the row with the smallest page_id is a response and the others are revisits; a page_id that occurs
    twice with the same payload is a response twice, and each payload of a page_id with several is written.
    An empty table gives an empty folder. The folder must be one that all executors share. Archives of task attempts
    that were not committed stay in a folder of their own, which readers do not see.
    """
    at = out_dir or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    uri = at if "://" in at or at.startswith("file:") else f"file://{at}"
    uri = uri if "://" in uri else uri.replace("file:", "file://", 1)
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(f"{root}/{ATTEMPTS}", recursive=True)
    again = stored(revisits(pages, least_bytes), "revisits")
    rows = pages.select("page_id", "url", "html", _digest().alias("digest")).join(again.hint(join_kind(again)), ["page_id", "digest"], "left")
    written = stored(map_arrow(rows.drop("digest"), _write(uri), "name string, records long"), "warc-index")
    written = stored(map_arrow(written, _publish(uri), "name string, records long"), "warc-published")
    return uri, int(written.agg(F.sum("records")).first()[0] or 0)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    for b in batches:
        for raw in b.column(0).to_pylist():
            rows: list[dict] = []
            for record in read_archive(raw):
                rows.append(parse_record(record))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names)


def read_archives(spark: SparkSession, at: str) -> DataFrame:
    """Records of all archives in a folder; an archive that breaks the format fails the job with its reason."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(at).select("content")
    return map_arrow(files, _read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back and give the fields of each record without its payload.

    The number of records read is checked against the number written.
    """
    at, n = write_archives(pages)
    rows = stored(read_archives(pages.sparkSession, at).drop("payload"), "warc-records")
    if rows.count() != n:
        raise WarcError(f"{n} records were written, {rows.count()} were read")
    return rows
