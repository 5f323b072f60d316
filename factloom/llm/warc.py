"""WARC archives: a writer with revisit records and a splittable reader.

Archives are ``.warc.gz`` files in which every record is a gzip member.  The reader cuts each file into byte
ranges.  A task looks for the gzip magic in its range, believes a candidate only if its member decodes to a
record header, and follows the members from there to the first that starts behind the range.  A payload may
itself hold whole records, so a range may have several such chains: the true one is that which the ranges
before it lead to, from the start of the file on.  A range owns the records whose members start inside it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import arrow_map, attach, filesystem, materialize, scratch_path
from factloom.llm.sift import split as split_rows

#: The start of a gzip member as written by any gzip: magic and the deflate method.
MAGIC = b"\x1f\x8b\x08"
#: Payloads below this are never stored as revisits.
LEAST = 1000
#: Bytes of a range that one task scans, and of one read.
SPLIT = 16 << 20
CHUNK = 1 << 18
HEADER_LIMIT = 1 << 16
#: Tasks of one scan; beyond so many ranges a task takes several.
TASKS = 100_000


@dataclass
class Record:
    headers: dict[str, str]
    body: bytes


def record_bytes(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8")) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


def parse_headers(head: bytes) -> dict[str, str] | None:
    """Named fields of a record header, lower-cased names; None if it is no record header."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out if "warc-type" in out and out.get("content-length", "").isdigit() else None


def plausible(raw: bytes) -> bool:
    """Whether a gzip member starts here that decodes to a record header; ``raw`` may be cut."""
    try:
        text = zlib.decompressobj(31).decompress(raw, HEADER_LIMIT)
    except zlib.error:
        return False
    head, end, _ = text.partition(b"\r\n\r\n")
    return bool(end) and parse_headers(head) is not None


class Window:
    """Reads of a file with a buffer of a few chunks."""

    def __init__(self, stream, size: int) -> None:
        self.stream, self.size, self.base, self.buffer = stream, size, 0, b""

    def at(self, place: int, least: int) -> bytes:
        """Bytes from ``place`` on, at least so many unless the file ends."""
        if place < self.base or min(place + least, self.size) > self.base + len(self.buffer):
            self.stream.seek(place)
            self.base, self.buffer = place, self.stream.read(min(max(least, 2 * CHUNK), self.size - place))
        return self.buffer[place - self.base :]

    def find(self, place: int, end: int) -> int:
        """The first magic that starts in ``[place, end)``, or -1."""
        while place < end:
            some = self.at(place, CHUNK)
            found = some.find(MAGIC)
            if found >= 0:
                return place + found if place + found < end else -1
            if place + len(some) >= self.size:
                return -1
            place += len(some) - len(MAGIC) + 1
        return -1

    def member(self, start: int) -> tuple[bytes, int]:
        """The content of the gzip member at ``start`` and where it ends; an error if it is cut or damaged."""
        decoder, parts, place = zlib.decompressobj(31), [], start
        while not decoder.eof:
            raw = self.at(place, 1)[:CHUNK]
            if not raw:
                raise zlib.error("cut")
            parts.append(decoder.decompress(raw))
            place += len(raw) - len(decoder.unused_data)
        return b"".join(parts), place


def parse_record(content: bytes) -> Record | None:
    """The record that a member holds; None if it holds no whole record and nothing else."""
    head, end, body = content.partition(b"\r\n\r\n")
    headers = parse_headers(head) if end else None
    return Record(headers, body[:-4]) if headers and len(body) == int(headers["content-length"]) + 4 else None


def chains(window: Window, start: int, end: int) -> list[tuple[list[int], int]]:
    """For each chain of records in a range, the starts of its members there and the first start behind the range."""
    found: list[tuple[list[int], int]] = []
    exits: dict[int, int] = {}
    at = start - 1
    while (at := window.find(at + 1, end)) >= 0:
        if at in exits or not plausible(window.at(at, HEADER_LIMIT)):
            continue
        starts, place = [], at
        try:
            while place < min(end, window.size) and place not in exits:
                content, after = window.member(place)
                if parse_record(content) is None:
                    raise zlib.error("no record")
                starts.append(place)
                place = after
        except zlib.error:
            continue
        leaves = exits.get(place, place)
        exits.update(dict.fromkeys(starts, leaves))
        found.append((starts, leaves))
    return found


def read_range(window: Window, entry: int, end: int) -> Iterator[Record]:
    """Records from the confirmed start ``entry`` on, up to the last that starts before ``end``."""
    while entry < min(end, window.size):
        try:
            content, after = window.member(entry)
        except zlib.error as fault:
            raise ValueError(f"the record at {entry} is damaged") from fault
        record = parse_record(content)
        if record is None:
            raise ValueError(f"there is no record at {entry}")
        yield record
        entry = after


def repeated_payloads(pages: DataFrame, digest: str, key: str) -> DataFrame:
    """Digests of more than one row: ``(d, owner, n)`` with the greatest key; null digests are none."""
    rows = pages.filter(F.col(digest).isNotNull()).select(F.col(digest).alias("d"), F.col(key).alias("k"))
    return materialize(rows.groupBy("d").agg(F.max("k").alias("owner"), F.count("*").alias("n")).filter("n > 1"), "digests")


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> None:
    """Write one record per row into ``folder``, one archive per partition.

    Of equal payloads of at least ``least`` bytes the row with the greatest key is a response and the others
    are revisits of it; all smaller ones are responses.  A null payload is empty.  Several rows with the
    greatest key are all responses; a null key counts as the least, and where all are null all are responses.
    Only rows with a payload that repeats take part in a shuffle, and a payload that more than 1/1000 of all rows
    share (so at most 1000 do) in none.  Archives are written under a name of the attempt and moved at its end,
    so a lost task leaves no part.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    digest = F.when(F.octet_length(body) >= least, F.sha2(body, 256))
    chosen = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"), digest.alias("d"))
    groups = repeated_payloads(chosen, "d", "key")
    again, once = split_rows(chosen, groups, "d")
    met = attach(again, groups, ["d"], "n")
    owner = F.when(~F.col("key").eqNullSafe(F.col("owner")), F.col("owner"))
    marked = once.withColumn("owner", F.lit(None).cast("long")).unionByName(met.withColumn("owner", owner).drop("n")).select("key", "owner", "url", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = filesystem(folder)
        name = f"{base}/part-{task.partitionId():06d}.warc.gz"
        part = f"{base}/_{task.partitionId():06d}-{task.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    content = (row["payload"] or "").encode("utf-8")
                    digest = hashlib.sha1(content).hexdigest()
                    headers = [("WARC-Type", "revisit" if row["owner"] is not None else "response"), ("WARC-Record-ID", f"<urn:page:{'' if row['key'] is None else row['key']}>"), ("WARC-Target-URI", (row["url"] or "").replace("\r", " ").replace("\n", " ")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(content)))]
                    if row["owner"] is not None:
                        headers += [("WARC-Refers-To", f"<urn:page:{row['owner']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                        content = b""
                    out.write(record_bytes(headers, content))
                    n += 1
        fs.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    marked.mapInArrow(write, "n long").agg(F.sum("n")).collect()


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_warc(spark: SparkSession, folder: str, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """All records of the archives in a folder: ids, digests, types, URLs and (if asked) payload bytes.

    The result does not depend on ``split``, whatever the payloads hold.  A damaged archive is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("size")).filter("size > 0")
    whole, cut = files.filter(F.col("size") <= split), files.filter(F.col("size") > split)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("first")
    ranges = cut.select("path", "size", first).withColumn("last", F.least(F.col("first") + split, "size"))
    entries = whole.select("path", "size", F.lit(0).cast("long").alias("entry"), F.col("size").alias("last"))
    many = ranges.count()
    if many:

        def of_range(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as stream:
                    found = chains(Window(stream, row["size"]), row["first"], row["last"])
                out += [(row["path"], row["size"], row["first"], row["last"], starts if len(found) > 1 else starts[:1], leaves) for starts, leaves in found or [([], -1)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) if k != 4 else pa.array(c, pa.list_(pa.int64())) for k, c in enumerate(zip(*out))], [f.split()[0] for f in _CHAIN.split(", ")])

        found = materialize(arrow_map(ranges.repartition(min(many, TASKS)), of_range, _CHAIN), "chains")
        entries = entries.unionByName(found.groupBy("path").applyInArrow(_entries, "path string, size long, entry long, last long"))
    entries = entries.repartition(max(1, min(TASKS, many + whole.count())))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            fs, path = filesystem(row["path"])
            with fs.open_input_file(path) as stream:
                held: list[tuple] = []
                size = 0
                for record in read_range(Window(stream, row["size"]), row["entry"], row["last"]):
                    held.append(_row(record, payloads))
                    size += len(record.body)
                    if size > CHUNK * 8 or len(held) >= 5000:
                        yield _records(held)
                        held, size = [], 0
                if held:
                    yield _records(held)

    return arrow_map(entries, each, _RECORD)


_CHAIN = "path string, size long, first long, last long, starts array<long>, leaves long"


def _entries(key: tuple, chains_: pa.Table) -> pa.Table:
    """Where the first record of each range of one file starts: the chain that leads on from the file's start."""
    by_range: dict[int, list[dict]] = {}
    for row in chains_.to_pylist():
        by_range.setdefault(row["first"], []).append(row)
    place, out = 0, []
    for first in sorted(by_range):
        rows = by_range[first]
        if place < rows[0]["last"]:
            led = [r for r in rows if place in r["starts"]]
            if not led:
                raise ValueError(f"{key[0].as_py()} has no whole record at {place}")
            out.append((key[0].as_py(), rows[0]["size"], place, rows[0]["last"]))
            place = led[0]["leaves"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["path", "size", "entry", "last"])


def _page(text: str | None) -> int | None:
    number = (text or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def _row(record: Record, payloads: bool) -> tuple:
    h = record.headers
    kind = h["warc-type"]
    digest = hashlib.sha1(record.body).hexdigest() if kind == "response" else h.get("warc-payload-digest", "").rpartition(":")[2]
    if kind == "response" and h.get("warc-payload-digest", "sha1:" + digest) != "sha1:" + digest:
        raise ValueError(f"the payload of {h.get('warc-record-id')} is damaged")
    size = len(record.body) if kind == "response" else int(h.get("x-payload-length", 0))
    return _page(h.get("warc-record-id")), size, digest, kind, _page(h.get("warc-refers-to")), h.get("warc-target-uri"), record.body if payloads else None


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in _RECORD.split(", ")])


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back: one row per page.

    Null payloads are empty; rows with null or repeated page ids are rows of their own (see ``write_warc``); an
    empty table gives an empty result; further columns are ignored.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_warc(pages, folder)
    return read_warc(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
