"""WARC archives of pages, a two-level capture index over them, and reading back through it.

Archives: one gzip member for each record, so any record can be read by its byte range. Equal payloads are
kept once; later pages become revisit records. Index: entries sorted by reversed-host URL keys lie in
compressed blocks; beside each index file lies its sparse directory, which keeps the keys and byte range of each block.
A lookup deals the wanted keys to the index files whose key range holds them, searches the directory of the file,
reads a block by range, searches it, and reads the records by range.

Files are written where the shared folder is, through pyarrow's file systems, under names no other attempt
of a task uses; a table of what was written names the files that count.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.frames import NULL_ID, removed, shared_dir, shuffle_partitions, stored, table, written

#: Bytes after which an archive ends and the next begins; entries in an index block; bytes read at once.
ARCHIVE_BYTES, BLOCK, READ = 64 << 20, 256, 8 << 20
#: Revisits up to this number (about 60 MB) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
DIRECTORY = ".directory"
ENTRY = "key string, id long, file string, offset long, length long"
URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)(:\d+)?([^#]*)", re.I)


def reversed_host(url: str | None) -> str:
    """com,example,www:8080)/path?query; without a host the url itself; null as empty."""
    found = URL.match(url or "")
    if not found or not found[1]:
        return url or ""
    return ",".join(reversed(found[1].lower().rstrip(".").split("."))) + (found[2] or "") + ")" + (found[3] or "/")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """One WARC record, a gzip member of its own. A revisit has the headers only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers is not None else head + payload
    clean = re.sub(r"[\r\n]+", " ", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{None if refers == NULL_ID else refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + press.flush()


def parsed(raw: bytes) -> dict:
    """The fields of one gzip member; a response's payload is held against its digest and length."""
    raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda x: None if x in (None, "<urn:page:None>") else int(x.removeprefix("<urn:page:").rstrip(">"))
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To"))}


def _writer(folder: str, date: str, limit: int) -> Callable:
    def run(batches):
        fs, root = _open(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, name, at, k = None, "", 0, 0
        for b in batches:
            rows = []
            for page, url, html, sha1, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, at, k = f"pages-{part:06d}-{attempt}-{k:04d}.warc.gz", 0, k + 1
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                raw = record(page, url, (html or "").encode(), base32(bytes.fromhex(sha1)), refers, date)
                out.write(raw)
                rows.append((reversed_host(url), page, name, at, len(raw)))
                at += len(raw)
                if at >= limit:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", limit: int = ARCHIVE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes archives of all rows of `pages` (page_id, url, html) and returns their entries (ENTRY).

    Of equal payloads of at least `min_payload` bytes, the one with the smallest page_id is the response (a
    null id comes last; rows that repeat the smallest id are responses all); the others revisit it."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), "url", "html")
    rows = rows.withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    keys = rows.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_payload).select(F.coalesce("id", F.lit(NULL_ID)).alias("ord"), "sha1")
    first = keys.groupBy("sha1").agg(F.min("ord").alias("refers"), F.max("ord").alias("last")).filter("refers < last").select("sha1", "refers")
    again = written(first)
    size = again.count()  # one row for each payload that several pages have
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    # a written table, so that the shuffled join is of two plain exchanges and the adaptive plan can split a common payload
    joined = rows.join(F.broadcast(again) if size <= broadcast_rows else again, "sha1", "left")
    small = F.octet_length(F.coalesce("html", F.lit(""))) < min_payload
    refers = F.when(~small & (F.coalesce("id", F.lit(NULL_ID)) > F.col("refers")), F.col("refers"))
    return written(joined.select("id", "url", "html", "sha1", refers.alias("refers")).mapInArrow(_writer(folder, date, limit), ENTRY))


def write_index(entries: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sorts entries by key into compressed blocks in files of the folder, each with its directory beside it; returns
    the directories, one row for each block: (first_key, last_key, file, offset, length, n).

    Entries of equal keys follow each other, also into the next blocks and files. No entries give no files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        name, out, at, held, blocks = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.cdx", None, 0, [], []

        def flush(lines):
            nonlocal out, at
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(raw)
            at += len(raw)
            blocks.append((lines[0][0], lines[-1][0], name, at - len(raw), len(raw), len(lines)))
            return blocks[-1]

        cols = ["first_key", "last_key", "file", "offset", "length", "n"]
        for pdf in batches:
            held += [(k, None if pd.isna(i) else int(i), f, int(o), int(n)) for k, i, f, o, n in zip(*(pdf[c] for c in ("key", "id", "file", "offset", "length")))]
            full = len(held) // block * block
            if full:
                yield pd.DataFrame([flush(held[i : i + block]) for i in range(0, full, block)], columns=cols)
                held = held[full:]
        if held:
            yield pd.DataFrame([flush(held)], columns=cols)
        if out:
            out.close()
            with fs.open_output_stream(f"{root}/{name}{DIRECTORY}", compression=None) as f:
                f.write(zlib.compress("\n".join(json.dumps([*x[:2], *x[3:]]) for x in blocks).encode(), 6))

    n = shuffle_partitions(entries.sparkSession)
    # files break ties of a key that very many pages share, so that its rows spread over partitions
    ordered = entries.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInPandas(run, "first_key string, last_key string, file string, offset long, length long, n long"))


def _lines(f, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "id", "file", "offset", "length"])


def _blocks(folder: str) -> Callable:
    """All entries of the blocks in a part of the directory."""

    def run(batches):
        fs, root = _open(folder)
        for b in batches:
            for file, offset, length in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                with fs.open_input_file(f"{root}/{file}") as f:
                    yield _batch(_lines(f, offset, length))

    return run


def within(firsts: list[str], lasts: list[str], key: str) -> range:
    """Which of the ranges firsts[i]..lasts[i], in order, hold the key: by binary search on either side."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def _found(folder: str) -> Callable:
    """Entries of the keys in rows (file, key), sorted by both: a search in the file's directory, then in each block."""

    def run(batches):
        fs, root = _open(folder)
        name, f, firsts, lasts, places, at, keys, lines = None, None, [], [], [], -1, [], []
        for b in batches:
            rows = []
            for file, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != name:
                    if f:
                        f.close()
                    name, f, at = file, fs.open_input_file(f"{root}/{file}"), -1
                    with fs.open_input_file(f"{root}/{file}{DIRECTORY}") as d:
                        blocks = _lines(d, 0, d.size())
                    firsts, lasts, places = [x[0] for x in blocks], [x[1] for x in blocks], [x[2:4] for x in blocks]
                for k in within(firsts, lasts, key):
                    if k != at:
                        at, lines = k, _lines(f, *places[k])
                        keys = [x[0] for x in lines]
                    rows += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                    if len(rows) >= 4 * BLOCK:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)
        if f:
            f.close()

    return run


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(folder: str, payloads: bool) -> Callable:
    def run(batches):
        fs, root = _open(folder)
        name, f, base, held = None, None, 0, b""
        for b in batches:
            rows = []
            for file, offset, length in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                if file != name:
                    if f:
                        f.close()
                    name, f, base, held = file, fs.open_input_file(f"{root}/{file}"), 0, b""
                if not base <= offset <= offset + length <= base + len(held):
                    base, held = offset, f.read_at(max(length, READ), offset)
                rows.append(parsed(held[offset - base : offset - base + length]))
            cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else [])]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(cols, types)], cols)
        if f:
            f.close()

    return run


def _read(entries: DataFrame, folder: str, payloads: bool) -> DataFrame:
    # stretches of an archive, so that neither a large archive nor many small ones fall to one task
    stretch = (F.col("offset") / READ).cast("long")
    dealt = entries.repartition(shuffle_partitions(entries.sparkSession), "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_reader(folder, payloads), RECORDS + (", url string, payload binary" if payloads else ""))


def read_back(directory: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record that the index names, read by range, without a search; with `payloads` also url and payload.

    What was written for a null page is an empty payload and a null url an empty target; repeated pages have a record
    each, also with equal keys; an empty directory gives an empty result."""
    entries = directory.repartition(shuffle_partitions(directory.sparkSession)).mapInArrow(_blocks(folder), ENTRY)
    return _read(entries, folder, payloads)


def lookup(directory: DataFrame, folder: str, urls: DataFrame, payloads: bool = False) -> DataFrame:
    """The captures of all urls in the column `url`, each once however often it is asked for.

    A null url finds the captures without one; unknown urls find nothing; no urls or an empty index give no rows. The
    driver keeps the key range of each index file, as many as shuffle partitions wrote them; a key that very many
    pages have is looked up in every file that holds it."""
    ranges = directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect()
    ranges.sort(key=lambda r: r.file)  # their names follow the order of keys
    spark = directory.sparkSession
    shared = spark.sparkContext.broadcast(([r.file for r in ranges], [r["first"] for r in ranges], [r["last"] for r in ranges]))

    def dealt(batches):
        files, firsts, lasts = shared.value
        for b in batches:
            keys = {reversed_host(u) for u in b.column(0).to_pylist()}
            rows = [(files[i], k) for k in keys for i in within(firsts, lasts, k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["file", "key"])

    wanted = urls.select(F.col("url").cast("string")).mapInArrow(dealt, "file string, key string").distinct()
    wanted = wanted.repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "key")
    return _read(wanted.mapInArrow(_found(folder), ENTRY), folder, payloads)


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes archives and index of `pages` into the shared folder and finds every page's record by its url.

    Null html is an empty payload; null and repeated ids and urls are kept row by row; an empty table
    gives an empty result; other columns are left out; payloads of any length are kept whole. The files are deleted
    once the result, which holds no payloads, is written."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("/"):
        folder = folder.replace("file:", "file://", 1)
    directory = write_index(write_archives(pages, folder, min_payload), folder)
    out, _ = stored(lookup(directory, folder, pages.select("url")))
    removed(spark, folder)
    return out


def op4_warc_index(spark, sf_dir: str) -> DataFrame:
    """round_trip() of all pages: nulls, ties, repeated rows and empty tables as stated there."""
    return round_trip(table(spark, sf_dir, "pages"))
