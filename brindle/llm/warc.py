"""WARC files read in byte splits; boundaries are verified by the chain of lengths from the start of each file."""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, cut, plain, scratch_path

MAGIC = re.compile(rb"WARC/\d\.\d\r?\n")
MAGIC_LONGEST = 12
BLANK = re.compile(rb"\r?\n\r?\n")
LENGTH = re.compile(rb"(?im)^content-length[ \t]*:[ \t]*(\d{1,18})[ \t]*\r?$")
#: A gzip member as archives write them: deflate, no reserved flags.
GZIP = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
STEP = 1 << 16
#: A header of more bytes is none.
MAX_HEADER = 1 << 20

Head = tuple[int, int, bytes, int]  # offset of the block, its length, header, bytes that end the record


def parse_head(buf: bytes | bytearray, at: int) -> Head | None:
    """The record header at ``at``; None if there is none, or not all of it."""
    m = MAGIC.match(buf, at)
    end = BLANK.search(buf, m.end() - 2, at + MAX_HEADER) if m else None
    length = LENGTH.search(buf, m.end(), end.start() + 2) if end else None
    # a record ends in two line ends of the kind that its first line has
    return (end.end(), int(length[1]), bytes(buf[m.end() : end.start()]), 4 if m[0][-2:] == b"\r\n" else 2) if length else None


class _Split:
    """Bytes of a file from ``at`` on, read further as they are asked for."""

    def __init__(self, file: pa.NativeFile, at: int, size: int, upto: int):
        self.file, self.at, self.size = file, at, size
        file.seek(at)
        self.buf = bytearray(file.read(max(0, min(upto, size) - at)))

    def more(self) -> bool:
        """Reads on, twice as far each time; False at the end of the file."""
        self.file.seek(self.at + len(self.buf))
        got = self.file.read(max(STEP, len(self.buf)))
        self.buf += got
        return bool(got)

    def header(self, offset: int) -> Head | None:
        """The header of a record that would start at ``offset``, its block's offset in the file; None if none can."""
        i = offset - self.at
        while len(self.buf) < i + MAGIC_LONGEST and self.more():
            pass
        m = MAGIC.match(self.buf, i)
        start = m.end() - 2 if m else 0
        while m and not BLANK.search(self.buf, start, i + MAX_HEADER):
            start = max(start, len(self.buf) - 4)
            if len(self.buf) >= i + MAX_HEADER or not self.more():
                return None
        head = parse_head(self.buf, i)
        return head and (self.at + head[0], *head[1:])

    def member(self, offset: int, sink=None) -> int | None:
        """Where the gzip member at ``offset`` ends, its bytes given to ``sink`` piece by piece; None if it is damaged, cut off, or
        doesn't hold a record. A record is told by its first bytes, so what only looks like a member is given up early."""
        z, first, at = zlib.decompressobj(31), b"", offset - self.at
        while not z.eof:
            while at >= len(self.buf):
                if not self.more():
                    return None
            piece = bytes(self.buf[at : at + STEP])
            try:
                out = z.decompress(piece)
            except zlib.error:
                return None
            at += len(piece) - len(z.unused_data)
            if len(first) < MAGIC_LONGEST:
                first += out[:MAGIC_LONGEST]
                if len(first) >= MAGIC_LONGEST and not MAGIC.match(first):
                    return None
            if sink is not None:
                sink(out)
        return self.at + at if MAGIC.match(first) else None


def _next(file_size: int, head: Head) -> int | None:
    """Where the following record starts: two line ends after the block, or the end of the file; None if the block is cut off."""
    end = head[0] + head[1]
    return None if end > file_size else min(end + head[3], file_size)


def candidates_of(file: pa.NativeFile, size: int, a: int, b: int, gzipped: bool = False) -> list[tuple[int, int, int | None]]:
    """(offset, successor, exit) of each place in [a, b) where a record could start, inside payloads too. ``exit`` is where the
    chain from there first leaves the split, None where it breaks off or ends within."""
    s = _Split(file, a, size, b + MAGIC_LONGEST)
    found, at = [], 0
    while (m := (GZIP if gzipped else MAGIC).search(s.buf, at)) and a + m.start() < b:
        at = m.start() + 1
        if gzipped:
            after = s.member(a + m.start())
        else:
            head = s.header(a + m.start())
            after = _next(size, head) if head else None
        if after is not None:
            found.append((a + m.start(), after))
    exits: dict[int, int | None] = {}
    for offset, after in reversed(found):
        exits[offset] = (after if after < size else None) if after >= b else exits.get(after)
    return [(o, n, exits[o]) for o, n in found]


def _opened(path: str) -> pa.NativeFile:
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "a", "b")), strict=True):
            with _opened(path) as f:
                rows = candidates_of(f, size, a, b, path.endswith(".gz"))
            if rows:
                o, n, e = zip(*rows, strict=True)
                yield pa.record_batch([pa.array([path] * len(o)), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(e, pa.int64())], names=["path", "off", "next", "exit"])


FIELDS = {b"warc-type": "type", b"warc-target-uri": "uri", b"warc-record-id": "record_id", b"warc-date": "date"}
RECORD = "path string, offset bigint, next bigint, type string, uri string, record_id string, date string, block binary"


def _found(s: _Split, at: int, gzipped: bool) -> tuple[int, bytes, bytes] | None:
    """(successor, header, block) of the record at ``at``; None where the chain breaks."""
    if not gzipped:
        head = s.header(at)
        after = _next(s.size, head) if head else None
        if after is None:
            return None
        block, length, header, _ = head
        while len(s.buf) < block + length - s.at and s.more():
            pass
        return after, header, bytes(s.buf[block - s.at : block - s.at + length])
    out = bytearray()
    after = s.member(at, out.extend)
    head = parse_head(out, 0) if after is not None else None
    if head is None or head[0] + head[1] > len(out):
        return None
    return after, head[2], bytes(out[head[0] : head[0] + head[1]])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), *((c, pa.string()) for c in ("type", "uri", "record_id", "date")), ("block", pa.binary())])
    for batch in batches:
        for path, size, b, entry in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "b", "entry")), strict=True):
            rows: list[dict] = []
            held = 0
            with _opened(path) as f:
                s, at = _Split(f, entry, size, b), entry
                while at < b and (record := _found(s, at, path.endswith(".gz"))):
                    after, header, block = record
                    named = {}
                    for line in header.splitlines():
                        k, _, v = line.partition(b":")
                        if (name := FIELDS.get(k.strip().lower())) and name not in named:
                            named[name] = v.strip().decode("utf-8", "replace")
                    rows.append({"path": path, "offset": at, "next": after, **{c: named.get(c) for c in FIELDS.values()}, "block": block})
                    held += len(block)
                    at = after
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                    if at >= size:
                        break
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, upto): how far the chain from each entry gets within its split."""
    for batch in batches:
        rows = []
        for path, size, b, entry in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "b", "entry")), strict=True):
            with _opened(path) as f:
                s, at = _Split(f, entry, size, entry), entry
                while at < b and at < size:
                    head = None if path.endswith(".gz") else s.header(at)
                    after = s.member(at) if path.endswith(".gz") else _next(size, head) if head else None
                    if after is None:
                        break
                    at = after
                    if at > s.at + len(s.buf):
                        s = _Split(f, at, size, at)  # nothing of a block is needed
            rows.append((path, size, at))
        p, n, u = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(p, pa.string()), pa.array(n, pa.int64()), pa.array(u, pa.int64())], names=["path", "size", "upto"])


def _splits(spark: SparkSession, folder: str, split_bytes: int) -> DataFrame:
    fs, name = pafs.FileSystem.from_uri(folder)
    info = fs.get_file_info(pafs.FileSelector(name, recursive=True)) if fs.get_file_info(name).type == pafs.FileType.Directory else [fs.get_file_info(name)]
    prefix = folder[: len(folder) - len(name)] if folder.endswith(name) else "file://"
    files = sorted((prefix + i.path, i.size) for i in info if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_")) and i.size)
    count = sum(-(-size // split_bytes) for _, size in files)
    splits = spark.createDataFrame(files, "path string, size bigint").select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split_bytes}L)")).alias("a"))
    return splits.withColumn("b", F.least(F.col("a") + split_bytes, F.col("size"))).repartition(max(1, min(count, 100_000)), "path", "a")


def _entries(spark: SparkSession, splits: DataFrame, split_bytes: int) -> DataFrame:
    """(path, size, b, entry): where the chain from a file's start enters each split that it gets to."""
    scratch = Scratch(spark)
    found = scratch.written(splits.mapInArrow(_candidates, "path string, off bigint, next bigint, exit bigint"), "warc-candidates")
    reached = cut(found.where("off = 0").select("path", "off"))
    entries = found.where("exit is not null").select("path", F.col("exit").alias("off")).unionByName(reached).distinct()
    jump = cut(found.where("exit is not null").select("path", "off", "exit").join(entries, ["path", "off"], "left_semi"))
    while not jump.isEmpty():
        further = reached.join(jump, ["path", "off"]).select("path", F.col("exit").alias("off"))
        reached = cut(reached.unionByName(further).distinct())
        on = jump.select("path", F.col("off").alias("exit"), F.col("exit").alias("to"))
        jump = cut(jump.join(on, ["path", "exit"]).select("path", "off", F.col("to").alias("exit")))
    scratch.drop(found)
    starts = reached.select("path", F.expr(f"off div {split_bytes} * {split_bytes}").alias("a"), F.col("off").alias("entry"))
    return splits.join(starts, ["path", "a"]).select("path", "size", "b", "entry")


def read_warc(spark: SparkSession, folder: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(path, offset, next, type, uri, record_id, date, block) of the records of the WARC files in ``folder``: plain ones, and
    those called ``.gz`` with a gzip member for each record, whose offsets are those of the members.

    Files are cut into splits anywhere. A first pass lists every place that looks like a record's start with the offset that
    its length (its member's end) points to; inside a split the chains are followed at once, so what is left to join are the
    places where chains cross from split to split. Pointer jumping from offset 0 of each file then finds the ones that are
    reached, in as many rounds as the logarithm of a file's splits. A second pass reads records from these places only, so text
    inside a payload that looks like a record, however well formed, is never one.

    Lines may end in CRLF or in LF; a record whose first line ends in LF is followed by two LF. A header of more than
    ``MAX_HEADER`` bytes is none. A file that doesn't start with a record has none. Where a chain breaks (a bad header, a length
    past the end, a damaged member) the records before it stay and the rest of the file is left out; ``left_out`` says how much
    that is. Empty files and an empty folder give no rows."""
    return _entries(spark, _splits(spark, folder, split_bytes), split_bytes).mapInArrow(_records, RECORD)


def left_out(spark: SparkSession, folder: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(path, size, left_out) of every file of ``read_warc``: the bytes after the place where its chain breaks, 0 if it doesn't."""
    splits = _splits(spark, folder, split_bytes)
    upto = _entries(spark, splits, split_bytes).mapInArrow(_reach, "path string, size bigint, upto bigint").groupBy("path").agg(F.max("upto").alias("upto"))
    files = splits.select("path", "size").distinct().join(upto, "path", "left")
    return files.select("path", "size", (F.col("size") - F.coalesce("upto", F.lit(0))).alias("left_out"))


def header_of(kind: str, uri: str, record_id: str, length: int) -> bytes:
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {length}\r\n\r\n").encode()


#: What write_warc appends to every fifth page: a record inside a payload, as crawled archives hold them.
DECOY = "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://inside.example/\r\nWARC-Record-ID: <urn:inside>\r\nContent-Length: 5\r\n\r\ninner\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _bundles(n_files: int):
    """(file, bundle): the rows of a batch that go to one file, packed together, so the shuffle carries them compressed. A row's
    file is a hash of it and, for rows that repeat within a batch, of its turn: no row is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=3)
        for b in batches:
            by_file: dict[int, list[tuple]] = {}
            turns: dict[tuple, int] = {}
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                turn = turns[page_id, url] = turns.get((page_id, url), -1) + 1
                file = xxhash.xxh3_64_intdigest(f"{page_id}:{turn}:{url}".encode("utf-8", "surrogatepass")) % n_files
                by_file.setdefault(file, []).append((page_id, url, html))
            packed = [zstd.compress(pickle.dumps(rows, protocol=5)) for rows in by_file.values()]
            yield pa.record_batch([pa.array(list(by_file), pa.int64()), pa.array(packed, pa.binary())], names=["file", "bundle"])

    return run


def _writer(folder: str, gzipped: bool):
    def run(pages: pa.Table) -> pa.Table:
        fs, name = pafs.FileSystem.from_uri(folder)
        fs.create_dir(name, recursive=True)
        zstd = zstandard.ZstdDecompressor()
        rows = [r for b in pages.column("bundle").to_pylist() for r in pickle.loads(zstd.decompress(b))]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
        group = pages.column("file")[0].as_py()
        target, part = f"{name}/{group:09d}.warc" + ".gz" * gzipped, f"{name}/.{group:09d}-{uuid.uuid4().hex}"

        def packed(record: bytes) -> bytes:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            return z.compress(record) + z.flush() if gzipped else record

        with fs.open_output_stream(part, compression=None) as out:
            info = b"software: brindle\r\n"
            out.write(packed(header_of("warcinfo", "", "urn:info", len(info)) + info + b"\r\n\r\n"))
            for page_id, url, html in rows:
                block = (HTTP + (html or "") + (DECOY if page_id is not None and page_id % 5 == 0 else "")).encode("utf-8", "surrogatepass")
                uri = re.sub(r"[\r\n]", " ", url or "")
                out.write(packed(header_of("response", uri, f"urn:page:{'' if page_id is None else page_id}", len(block)) + block + b"\r\n\r\n"))
        fs.move(part, target)  # whole or not at all, however often the task runs
        return pa.table({"file": pa.array([target]), "n": pa.array([len(rows)], pa.int64())})

    return run


def write_warc(pages: DataFrame, folder: str, per_file: int = 1024, gzipped: bool = False) -> None:
    """Pages (page_id, url, html) as WARC files of about ``per_file`` pages each, a task a file, whatever their ids; ``gzipped``
    with a member a record. Null texts are empty, null ids are left blank; repeated rows become repeated records."""
    rows = plain(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("bigint"))
    rows = rows.mapInArrow(_bundles(max(1, -(-pages.count() // per_file))), "file bigint, bundle binary")
    rows.groupBy("file").applyInArrow(_writer(folder, gzipped), "file string, n bigint").agg(F.sum("n")).collect()


def round_trip(pages: DataFrame, per_file: int = 1024, split_bytes: int = 1 << 20, gzipped: bool = False) -> DataFrame:
    """(page_id, url, n_bytes, digest): the pages written as WARC to the shared folder and read again from verified records.

    ``n_bytes`` and ``digest`` (MD5) are those of the whole block. Null ids stay null, every BIGINT comes back as it was; a null
    url or text comes back empty, line ends in a url as blanks; repeated rows come back as often; extra columns are ignored; an
    empty table gives no rows."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_warc(pages, folder, per_file, gzipped)
    r = read_warc(spark, folder, split_bytes).where("type = 'response'")
    return r.select(F.regexp_extract("record_id", "urn:page:(-?[0-9]*)>", 1).try_cast("bigint").alias("page_id"), F.col("uri").alias("url"), F.octet_length("block").cast("bigint").alias("n_bytes"), F.md5("block").alias("digest"))
