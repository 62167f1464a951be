"""WARC archives with a Zstandard dictionary: written by Spark tasks, one frame per record, and read back.

A dictionary is built from a bounded sample of the records and stands in a skippable frame at the head of every archive
(the public ``.warc.zst`` layout). Archives go through ``pyarrow.fs``, so the folder may be any store it knows. Each writing
task makes files of its own name and reports them in a manifest, which is the result: what a lost executor left behind is
in no manifest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import new_path, pick, shuffle_parts, ship, stage

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 112_640
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 65_536
ARCHIVE_BYTES = 64 << 20
SALTS = 32
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, salt: bytes = b"") -> str:
    """A version 8 UUID that holds the page id; without a page id, one drawn from ``salt``."""
    if page_id is None:
        low, high = int.from_bytes(hashlib.sha1(salt).digest()[:7], "big"), 0x800
    else:
        bits = page_id & (2**64 - 1)
        low, high = bits & (2**62 - 1), bits >> 62
    return f"<urn:uuid:{uuid.UUID(int=0x7761726370616765 << 64 & ~(0xFFFF << 64) | (0x8000 | high) << 64 | 0b10 << 62 | low)}>"


def page_of(identifier: str) -> int | None:
    """The page id inside a record id."""
    bits = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    high = bits >> 64 & 0xFFF
    if high & 0x800:
        return None
    value = high << 62 | bits & (2**62 - 1)
    return value - 2**64 if value >= 2**63 else value


def _digest(hex_sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """A whole WARC record. A revisit holds the HTTP header only; its Content-Length is that of the full payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
             f"WARC-Record-ID: {record_id(page_id, (url or '').encode() + payload)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{_digest(sha1)}", "Content-Type: application/http; msgtype=response"]
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on records; where they are too few or too small to train on, their own bytes."""
    import zstandard

    total = sum(map(len, records))
    if len(records) >= 16 and total >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, total // 4), records).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-size:] or b"WARC/1.1\r\n"


def _compression_dict(data: bytes):
    import zstandard

    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store, inner


def _write(folder: str, dictionary, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        data = dictionary.value
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=_compression_dict(data), write_checksum=True)
        head = SKIPPABLE.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data
        info = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, b'info')}\r\nWARC-Date: {DATE}\r\n"
                "Content-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n").encode()
        out, done, path, records, size = None, [], "", 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            done.append((path, records, size))
            out = None

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, sha1, refers, revisit = (batch.column(i)[row].as_py() for i in range(6))
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    store, inner = _open(path)
                    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(inner, compression=None)
                    out.write(head)
                    out.write(squeeze.compress(info))
                    size = len(head)
                frame = squeeze.compress(make_record(page, url, payload.encode("utf-8", "surrogatepass"), sha1, refers, revisit))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        paths, counts, sizes = (list(x) for x in zip(*done)) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                                         names=["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, revisit_min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
                   level: int = 3) -> DataFrame:
    """Writes one record per row of ``pages`` (page_id, url, html) and returns the manifest (path, records, bytes).

    Rows with equal payloads of at least ``revisit_min_bytes`` bytes share one response, the row with the largest page_id; the
    others are revisits that refer to it. Null html is an empty payload. Rows that repeat the largest page_id are all
    responses; a null page_id is below every other. An empty table writes no archive.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "archives")
    src = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    src = src.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    sample = src.where(F.octet_length("payload") <= SAMPLE_BYTES).select("page_id").where("page_id is not null")
    sample = sample.orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_RECORDS).distinct()
    rows = src.join(F.broadcast(sample), "page_id", "left_semi").where(F.octet_length("payload") <= SAMPLE_BYTES)
    rows = rows.orderBy("page_id", "sha1").limit(SAMPLE_RECORDS).collect()
    records = [make_record(r.page_id, r.url, r.payload.encode("utf-8", "surrogatepass"), r.sha1, None, False) for r in rows]
    dictionary = spark.sparkContext.broadcast(build_dictionary(records))

    same = src.where(F.octet_length("payload") >= revisit_min_bytes).groupBy("sha1").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response")).where("n > 1")
    same = same.select(F.col("sha1").alias("key"), "response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_key"))
    salted = src.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    joined = salted.join(same, (F.col("sha1") == F.col("key")) & (F.col("salt") == F.col("salt_key")), "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    out = joined.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"))
    manifest = out.mapInArrow(_write(folder, dictionary, archive_bytes, level), "path string, records long, bytes long")
    return stage(manifest, "manifest")


def _headers(stream: io.BufferedReader, end: bytes = b"\r\n") -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (end, b""):
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        found[name.lower()] = value.strip()
    return found


def read_records(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of one archive, from a file object."""
    import zstandard

    magic, size = int.from_bytes(raw.read(4), "little"), int.from_bytes(raw.read(4), "little")
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    own = _compression_dict(raw.read(size))
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=own).stream_reader(raw, read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = _headers(stream)
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")
        yield head, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, inner = _open(path)
            rows, held, found = [], 0, 0
            with store.open_input_stream(inner, compression=None) as raw:
                for head, block in read_records(raw):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    found += 1
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or _digest(hashlib.sha1(payload).hexdigest()) != digest):
                        raise ValueError(f"{head['warc-record-id']} in {path}: the payload does not match its digest")
                    rows.append((page_of(head["warc-record-id"]), head.get("warc-target-uri"), kind, length, digest,
                                 page_of(head["warc-refers-to"]) if kind == "revisit" else None,
                                 payload.decode("utf-8", "surrogatepass") if kind == "response" else None))
                    held += len(payload)
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
            if rows:
                yield table(rows)
            if found != expected:
                raise ValueError(f"{path} holds {found} records, the manifest says {expected}")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives of a manifest: (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload).

    Sizes and digests are those of full payloads; a revisit has no payload of its own. Every response is checked against
    its digest, every archive against its number of records.
    """
    spark = manifest.sparkSession
    ship(spark)
    files = manifest.select("path", "records").repartition(max(1, shuffle_parts(spark)))
    return files.mapInArrow(_read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
                                   "refers_to long, payload string")
