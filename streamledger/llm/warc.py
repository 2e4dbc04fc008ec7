"""WARC archives compressed with Zstandard: a writer, and a reader that checks what it reads.

An archive is a file whose first frame is a skippable frame (magic 0x184D2A5D) that
holds the compression dictionary, followed by one Zstandard frame for each record.
Each task writes its records in archives of about ``ARCHIVE_BYTES``, under names of its
own attempt, and what the job returns names those of the attempts that counted. The
reader takes these names, so what a lost or repeated attempt left is not read. The reader takes whole files from Spark's
``binaryFile`` source, so it reads from any store that Spark can list.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.llm.common import shared_dir, stage, text_or_empty

#: Compressed bytes after which an archive is closed; a task holds one archive at a time.
ARCHIVE_BYTES = 4 << 20
#: Pages from which the dictionary is trained, at most, and its size.
SAMPLE, DICTIONARY_BYTES = 500, 64 << 10
#: Tasks that read named archives, at most.
MOST_TASKS = 20_000
MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = (
    "page_id long, record_type string, url string, record_id string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, error string"
)


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of ``data``; five bytes give eight digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def classified(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` with ``payload_digest``, ``payload_bytes``, ``record_type`` and ``refers_to``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest
    page_id is the response and the others revisit it; rows that repeat one page_id are
    told apart by their place in the input, and a null page_id comes last.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        text_or_empty("html").alias("html"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": sha1_base32(F.encode("html", "UTF-8")), "same": F.sha2(F.encode("html", "UTF-8"), 256)}
    )
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    # one row for each task and payload is shuffled, so many copies of one page weigh no more than one
    firsts = rows.groupBy("same").agg(F.min(order).alias("first"))
    joined = rows.join(firsts, "same")
    first = (F.col("row") == F.col("first.row")) | (F.col("payload_bytes") < least_bytes)
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.when(~first, F.col("first.id")).alias("refers_to"),
    )


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most ``SAMPLE`` pages, the first by a hash of their ids; empty if they are too few to train on."""
    ids = pages.where("page_id is not null and html is not null").select("page_id")
    ids = ids.groupBy(F.xxhash64("page_id").alias("order"), "page_id").agg(F.lit(1)).orderBy("order", "page_id").limit(SAMPLE).select("page_id")
    # at most SAMPLE ids, so they can be sent to every task; only their pages come to the driver
    sample = pages.join(F.broadcast(ids), "page_id").select(F.encode(F.col("html").cast("string"), "UTF-8").alias("b")).take(SAMPLE)
    parts = [bytes(r["b"]) for r in sample if r["b"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def _header_value(text: str) -> str:
    """One header line, in ASCII; other characters are percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def _record_id(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id, url, html: bytes, digest: str, kind: str, refers_to) -> bytes:
    """A WARC/1.1 record; a revisit has HTTP headers and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + f"Content-Length: {len(html)}\r\n\r\n".encode()
    block = http + html if kind == "response" else http
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_header_value(url)}" if url is not None else "",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "".join(f"{x}\r\n" for x in lines if x).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write what ``classified`` gives; returns ``archive, records, bytes``, one row for each file.

    Each evaluation writes anew: keep the result (``stage``) and read the archives it names.
    """
    shared = rows.sparkSession.sparkContext.broadcast(dictionary)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        data = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True, write_checksum=True)
        lead = struct.pack("<II", MAGIC, len(shared.value)) + shared.value
        held, size, number, attempt = [lead], len(lead), 0, uuid.uuid4().hex

        def close():
            nonlocal held, size, number
            # no two attempts share a name, so none changes what another has written
            name = f"part-{TaskContext.get().partitionId():06d}-{attempt}-{number:05d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}") as out:
                for x in held:
                    out.write(x)
            done = pd.DataFrame({"archive": [name], "records": [len(held) - 1], "bytes": [size]})
            held, size, number = [lead], len(lead), number + 1
            return done

        for pdf in it:
            for x in pdf.itertuples(index=False):
                page = None if pd.isna(x.page_id) else int(x.page_id)
                refers = None if pd.isna(x.refers_to) else int(x.refers_to)
                held.append(packer.compress(record(page, x.url, x.html.encode("utf-8"), x.payload_digest, x.record_type, refers)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if len(held) > 1:
            yield close()

    # whole numbers that can be null would come as floating point
    exact = rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return exact.mapInPandas(run, "archive string, records long, bytes long")


def frames(content: bytes) -> Iterator[tuple[bytes | None, bytes, str | None]]:
    """``(dictionary, frame, error)`` of each frame after the leading one; broken data ends the archive with an error."""
    if len(content) < 8 or struct.unpack_from("<I", content)[0] != MAGIC:
        yield None, b"", "no leading dictionary frame"
        return
    size = struct.unpack_from("<I", content, 4)[0]
    dictionary = content[8 : 8 + size]
    if len(dictionary) < size:
        yield None, b"", "dictionary frame cut short"
        return
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=64 << 20)
    at = 8 + size
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    view = memoryview(content)
    while at < len(content):
        try:
            # fed by pieces: what the last one leaves over tells where the frame ends
            unpacker, parts, here = zstandard.ZstdDecompressor(dict_data=data).decompressobj(), [], at
            while not unpacker.eof and here < len(content):
                parts.append(unpacker.decompress(view[here : here + (1 << 14)]))
                here += 1 << 14
            if not unpacker.eof:
                yield dictionary, b"", "frame cut short"
                return
            at = min(here, len(content)) - len(unpacker.unused_data)
            yield dictionary, b"".join(parts), None
        except zstandard.ZstdError as e:
            yield dictionary, b"", f"bad frame: {e}"
            return


def parse(data: bytes) -> dict:
    """One record's fields; ``error`` names the first rule that it breaks."""
    out = dict.fromkeys(["page_id", "record_type", "url", "record_id", "refers_to", "payload_bytes", "payload_digest", "payload", "error"])
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            return out | {"error": f"bad header line {name[:40]!r}"}
        fields[name.lower()] = value.strip()
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", x or "")) else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out |= {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "payload_digest": digest}
    out |= {"page_id": number(fields.get("warc-record-id")), "refers_to": number(fields.get("warc-refers-to"))}
    if not out["record_id"] or not out["record_type"] or "warc-date" not in fields:
        return out | {"error": "a required header is missing"}
    if not re.fullmatch(r"\d+", fields.get("content-length", "")):
        return out | {"error": "bad Content-Length"}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        return out | {"error": "length and record differ"}
    if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", _digest(block)):
        return out | {"error": "block digest differs"}
    http, gap, body = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not gap or not http.startswith(b"HTTP/") or not said:
        return out | {"error": "no HTTP header"}
    out["payload_bytes"] = int(said[1])
    if out["record_type"] == "response":
        if len(body) != out["payload_bytes"]:
            return out | {"error": "HTTP length and payload differ"}
        if digest and digest != _digest(body):
            return out | {"error": "payload digest differs"}
        out["payload"] = body
    elif out["record_type"] == "revisit" and not fields.get("warc-refers-to"):
        return out | {"error": "revisit without WARC-Refers-To"}
    return out


def read_archives(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """All records of the ``.warc.zst`` files of a folder, as ``archive`` and ``RECORD_SCHEMA``; ``error`` is null for sound ones.

    With ``names(archive)`` only these files are read, from the store that ``write_archives`` writes to.
    """

    columns = ["archive", "page_id", "record_type", "url", "record_id", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]

    def records(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = []
        for _, frame, error in frames(content):
            rows.append({"archive": name} | (parse(frame) if error is None else {"error": error}))
            if len(rows) == 256:
                yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})

    def listed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield from records(path.rsplit("/", 1)[-1], bytes(content))

    def named(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        for pdf in it:
            for name in pdf["archive"]:
                with store.open_input_stream(f"{base}/{name}") as file:
                    content = file.read()
                yield from records(name, content)

    if names is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
        return files.mapInPandas(listed, f"archive string, {RECORD_SCHEMA}")
    # the names weigh little, what they name does not: as many tasks as files, up to a bound
    tasks = max(1, min(MOST_TASKS, names.count()))
    return names.select("archive").repartition(tasks, "archive").mapInPandas(named, f"archive string, {RECORD_SCHEMA}")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read all records back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = write_archives(classified(pages), folder, train_dictionary(pages))
    written = stage(written, "archives")
    if written.isEmpty():
        return spark.createDataFrame([], f"archive string, {RECORD_SCHEMA}")
    return read_archives(spark, folder, written)
