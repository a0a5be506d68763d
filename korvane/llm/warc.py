"""WARC archives with a two-level capture index.

Archives are WARC/1.1 files of one gzip member for each record, so a record can be read by its range alone. The index
has lines "key, page_id, file, offset, length", sorted by key (the URL with its host reversed) and page_id, in
compressed blocks; a sparse directory holds each block's first and last key and place. A lookup searches the directory
by halving, reads one block's range, searches its lines by halving and reads one record's range. Many lookups are
dealt to the index files by the files' first keys; each file's meet that file's part of the directory.

Files are written by tasks through pyarrow's file systems, under a name of the attempt's own; what the job returns
names the files that count, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_broadcast, materialize, new_path

#: Index lines in a block, and bytes that are read at once when neighbouring records are read.
BLOCK_LINES, READ_BYTES = 3000, 4 << 20
GZIP_LEVEL = 4
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
RECORD_ID = "urn:korvane:page:"


def url_key(url: str | None) -> str:
    """The URL in lower case, without its scheme and its host reversed: ``com,example,www)/path?query``."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else "//" + text)
        host, port = parts.hostname or "", f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        host, port, parts = "", "", None
    key = ",".join(reversed(host.split("."))) + port + ")" + ((parts.path or "/") + (f"?{parts.query}" if parts.query else "") if parts else text)
    return quote(key.lower(), safe="/:?&=%+,;@()!$'*~#[]|^.-_")


def _safe(url: str | None) -> str:
    return quote(url or "", safe="/:?&=%+,;@()!$'*~#[]|^.-_")


def digest32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, place: str = "") -> bytes:
    """One compressed record: the response, or a revisit that keeps its HTTP header only.

    A record's id is its page_id and digest, which only one response has; ``place`` is added for all others, since rows
    may repeat both.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, body, more = ("response", http + payload, "") if refers_to is None else ("revisit", http, f"WARC-Refers-To: <{RECORD_ID}{refers_to}:{digest}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}:{digest}{place}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {_safe(url)}\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode() + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """A record's headers and payload. A response's digest is taken from its payload and must be the one it states."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if headers["WARC-Type"] == "response" and (digest32(payload) != stated or len(payload) != size):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        text = headers.get(name, "")[len(RECORD_ID) + 1 : -1].split(":")[0]
        return int(text) if text else None

    return {"page_id": page("WARC-Record-ID"), "url": headers["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": stated, "record_type": headers["WARC-Type"], "refers_to": page("WARC-Refers-To")}


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _attempt() -> str:
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for every page to archives below ``path``; returns the captures, a written table.

    Of records with equal payloads of ``min_bytes`` or more, the one with the largest page_id (null last) is the
    response and the others revisit it; of rows that repeat that page_id, one: the last in the order of the scan, so
    ``pages`` must give its rows in the same order when read again, as a scan of files does. Null html is an empty
    payload, an empty table gives no archives, other columns are not read. A page of up to 2 GB fits. Pages stay where
    they are: only digests are shuffled, and the digests that occur more than once come back by broadcast if
    a count shows that they are few, else by a join.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"), F.monotonically_increasing_id().alias("row"))
    large = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row"))
    first = large.groupBy("digest").agg(F.sum("n").alias("all"), F.max(F.struct("page_id", "n", "row")).alias("w")).where("all > 1")
    first = materialize(first.select(F.col("digest").alias("w_digest"), F.col("w.page_id").alias("w_id"), F.col("w.n").alias("w_n"), F.col("w.row").alias("w_row")), "warc-first")
    rows = rows.join(bounded_broadcast(first, 500_000), F.col("digest") == F.col("w_digest"), "left")
    own = F.col("w_digest").isNull() | (F.col("page_id").eqNullSafe(F.col("w_id")) & ((F.col("w_n") == 1) | (F.col("row") == F.col("w_row"))))
    rows = rows.select("page_id", "url", "html", F.when(own, F.lit(None)).otherwise(F.coalesce(F.col("w_id").cast("string"), F.lit(""))).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(path)
        store.create_dir(top, recursive=True)
        name, at, out = f"archive-{_attempt()}.warc.gz", 0, None
        try:
            for batch in batches:
                done: list[list] = [[], [], [], [], []]
                out = out or store.open_output_stream(f"{top}/{name}", compression=None, buffer_size=1 << 20)
                for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    lone = refers_to is None and len(payload) >= min_bytes
                    member = record(page_id, url, payload, digest32(payload), refers_to, "" if lone else f":{name}:{at}")
                    out.write(member)
                    for column, value in zip(done, (url_key(url), page_id, name, at, len(member))):
                        column.append(value)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return materialize(rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "warc-captures")


#: A null page_id sorts before all others.
NO_PAGE = -(1 << 63)
#: What the name of an index file's directory ends in.
DIRECTORY = ".dir"


def place_of(line: str) -> tuple[str, int]:
    """What an index line is sorted by."""
    key, page, _ = line.split("\t", 2)
    return key, int(page) if page else NO_PAGE


def write_index(captures: DataFrame, path: str) -> DataFrame:
    """Sort the captures by key into compressed blocks below ``path``; returns the directory, a written table. Each index
    file has its blocks' part of it beside it."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "file", "offset"]  # captures of one key and page may be many: they are told apart by their place
    ranged = captures.select(*order, "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(path)
        store.create_dir(top, recursive=True)
        name, at, out, lines, own = f"index-{_attempt()}.z", 0, None, [], []

        def block(lines: list[str]) -> pa.RecordBatch:
            nonlocal at
            raw = zlib.compress("\n".join(lines).encode())
            out.write(raw)
            (first, first_page), (last, last_page) = place_of(lines[0]), place_of(lines[-1])
            row = [first, first_page, last, last_page, name, at, len(raw), len(lines)]
            own.append("\t".join(map(str, (first, first_page, last, last_page, at, len(raw)))))
            at += len(raw)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["first_key", "first_page", "last_key", "last_page", "file", "offset", "length", "n"])

        try:
            for batch in batches:
                out = out or store.open_output_stream(f"{top}/{name}", compression=None, buffer_size=1 << 20)
                for key, page_id, *rest in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    lines.append("\t".join([key, "" if page_id is None else str(page_id), *map(str, rest)]))
                    if len(lines) == BLOCK_LINES:
                        yield block(lines)
                        lines = []
            if lines:
                yield block(lines)
            if own:  # the file's own directory, for searches
                with store.open_output_stream(f"{top}/{name}{DIRECTORY}") as f:
                    f.write(zlib.compress("\n".join(own).encode()))
        finally:
            if out:
                out.close()

    return materialize(ranged.mapInArrow(run, "first_key string, first_page long, last_key string, last_page long, file string, offset long, length long, n long"), "warc-directory")


def read_block(store, top: str, file: str, offset: int, length: int) -> list[str]:
    with store.open_input_file(f"{top}/{file}") as f:
        return zlib.decompress(f.read_at(length, offset)).decode().split("\n")


def read_directory(store, top: str, file: str) -> list[tuple[str, int, str, int, int, int]]:
    """The blocks of an index file in order: first key and page, last key and page, offset, length."""
    with store.open_input_file(f"{top}/{file}{DIRECTORY}") as f:
        rows = [line.split("\t") for line in zlib.decompress(f.read()).decode().split("\n")]
    return [(a, int(p), b, int(q), int(at), int(n)) for a, p, b, q, at, n in rows]


def find_captures(requests: DataFrame, directory: DataFrame, path: str) -> DataFrame:
    """The index lines (file, offset, length) of all captures of the requests (url, page_id), each found by searching.

    The files' first places, as many as the index has partitions, deal each request to the file or files that may hold
    it. Requests are then sorted as the index is and go by as a stream, over as many tasks as they need: the directory of
    the file at hand is searched by halving, then the one or more blocks that may hold the request, each read by its
    range once for all requests in a row. A task holds a file's directory and one block. Requests count once, however
    often they are repeated.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["key", "page"])

    page = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE))
    wanted = requests.select("url", page.alias("page")).mapInArrow(keys, "key string, page long").distinct()
    ends = directory.groupBy("file").agg(F.min(F.struct("first_key", "first_page")).alias("a"), F.max(F.struct("last_key", "last_page")).alias("b")).collect()
    files = sorted(((r.a[0], r.a[1]), (r.b[0], r.b[1]), r.file) for r in ends)
    firsts, lasts, names = ([f[i] for f in files] for i in range(3))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(*want, names[i]) for i in range(bisect_left(lasts, want), bisect_right(firsts, want))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["key", "page", "index"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(path)
        file, now, lines, order = None, -1, [], []
        for batch in batches:
            found = []
            for index, *want in zip(*(batch.column(c).to_pylist() for c in ("index", "key", "page"))):
                if index != file:
                    file, now, places = index, -1, read_directory(store, top, index)
                    begins, ends = [p[:2] for p in places], [p[2:4] for p in places]
                want = tuple(want)
                for i in range(bisect_left(ends, want), bisect_right(begins, want)):
                    if i != now:
                        now, lines = i, read_block(store, top, file, *places[i][4:])
                        order = [place_of(line) for line in lines]
                    found += [line.split("\t")[2:] for line in lines[bisect_left(order, want) : bisect_right(order, want)]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), *(pa.array([int(f[i]) for f in found], pa.int64()) for i in (1, 2))], names=["file", "offset", "length"])

    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = wanted.mapInArrow(deal, "key string, page long, index string")
    asked = asked.repartitionByRange(parts, "index", "key", "page").sortWithinPartitions("index", "key", "page")
    return asked.mapInArrow(search, "file string, offset long, length long")


RECORD_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _records(members: list[bytes], payload: bool) -> pa.RecordBatch:
    rows = [parse(m) for m in members]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payload else {})
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def read_records(captures: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """The records of ``captures`` (file, offset, length), read by range; neighbours are read together."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(path)

        def read(file: str, spans: list[tuple[int, int]]) -> pa.RecordBatch:
            begin, end = spans[0][0], spans[-1][0] + spans[-1][1]
            with store.open_input_file(f"{top}/{file}") as f:
                raw = f.read_at(end - begin, begin)
            return _records([raw[a - begin : a - begin + n] for a, n in spans], payload)

        now, spans = None, []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if spans and (file != now or offset != spans[-1][0] + spans[-1][1] or offset - spans[0][0] > READ_BYTES):
                    yield read(now, spans)
                    spans = []
                now = file
                spans.append((offset, length))
        if spans:
            yield read(now, spans)

    return ranged.mapInArrow(run, RECORD_FIELDS + (", payload binary" if payload else ""))


def lookup(directory: DataFrame, path: str, urls: list[str], payload: bool = True) -> DataFrame:
    """The records of all captures of ``urls`` (a list given by hand, so it is small)."""
    keys = sorted({url_key(u) for u in urls})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(path)
        for batch in batches:
            blocks = sorted(batch.to_pylist(), key=lambda b: (b["first_key"], b["file"], b["offset"]))
            firsts = [b["first_key"] for b in blocks]
            for key in keys:
                i = max(bisect_left(firsts, key) - 1, 0)  # the block before may hold the key too
                while i < len(blocks) and firsts[i] <= key:
                    if blocks[i]["last_key"] >= key:
                        lines = read_block(store, top, blocks[i]["file"], blocks[i]["offset"], blocks[i]["length"])
                        j, members = bisect_left(lines, key + "\t"), []
                        while j < len(lines) and lines[j].startswith(key + "\t"):
                            _, _, file, offset, length = lines[j].split("\t")
                            with store.open_input_file(f"{top}/{file}") as f:
                                members.append(f.read_at(int(length), int(offset)))
                            j += 1
                        if members:
                            yield _records(members, payload)
                    i += 1

    return directory.select("first_key", "last_key", "file", "offset", "length").mapInArrow(run, RECORD_FIELDS + (", payload binary" if payload else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive and index all pages, then find every page's capture in the index and read it."""
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    directory = write_index(write_archives(pages, path), path)
    return read_records(find_captures(pages, directory, path), path).drop("url")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as d from pages),
h as (select *, row_number() over (partition by d order by page_id desc nulls last) as i, max(page_id) over (partition by d) as m from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(d, cast(5 * (x // 4) + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (x % 4) as bigint)) & 31) + 1 as bigint), 1)), '') as payload_digest,
  case when i = 1 then 'response' else 'revisit' end as record_type, case when i > 1 then m end as refers_to from h
"""
