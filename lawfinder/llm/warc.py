"""WARC archives with revisits, and their index by an external merge.

Pages become archive files, one record each: the payload itself, or a revisit that refers to the record
which holds an equal payload. Reading the archives back gives captures; each file's are sorted by URL key and
time into runs. The index is the merge of all runs: runs are cut at key boundaries (a range shuffle), and in
each range a loser tree merges the pieces, so the ranges together hold every capture in global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lawfinder.llm.common import filesystem, leaving, parallelism, removed, shared_dir, table, written

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 0
#: An archive file is closed when it holds this many bytes of compressed records.
FILE_BYTES = 64 << 20
#: Captures of one sorted run.
RUN_ROWS = 20_000
#: Pages carry no time: page n counts as captured n seconds after this (2024-01-01, in seconds since 1970).
EPOCH = 1_704_067_200
#: Page numbers are taken modulo this for their time, so that it can be written as a date.
WRAP = 1 << 36
#: Captures that one task of the merge holds, about.
RANGE_ROWS = 100_000
#: Repeated payloads (some 60 bytes each) whose smallest page_ids are broadcast; more of them are joined by shuffling.
SMALL_LEAST = 200_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


_URL = re.compile(r"[a-z][a-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]+)?", re.S)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, in lower case: ``com,example)/a?b``.

    User, port and fragment are left out. What has no host is its own key, no URL an empty one; nothing is refused.
    """
    text = (url or "").strip().lower()
    found = _URL.match(text)
    host = found[1].rpartition("@")[2] if found else ""
    host = host[: host.find("]") + 1] if host.startswith("[") and "]" in host else host.partition(":")[0]
    if not host:
        return text
    labels = [host] if host.startswith("[") else reversed(host.split("."))
    return ",".join(labels) + ")" + (found[2] or "/") + (found[3] or "")


def moment(seconds: int) -> datetime:
    """Seconds since 1970 as a time that an archive can state; what lies outside the years 1970 to 9999 is moved to their ends."""
    return datetime.fromtimestamp(min(max(seconds, 0), 253_402_300_799), UTC)


def record(page_id: int, url: str | None, when: datetime, payload: bytes, kind: str, refers: int | None) -> bytes:
    """One gzip member: a WARC record around an HTTP response; a revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    while version := stream.readline():
        if version.strip() == b"":
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def with_decisions(pages: DataFrame, least_bytes: int = LEAST_BYTES, small: int = SMALL_LEAST) -> DataFrame:
    """Add payload (binary), kind and refers: equal payloads of ``least_bytes`` or more go to their smallest page_id.

    Of rows that repeat this page_id too, one is the response. Payloads without any page_id are all responses. Only digests
    and ids are shuffled to find the smallest ids; where they are ``small`` rows at most, they are broadcast to the payloads,
    which stay where they are.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("_sum", F.unhex(F.sha1("payload")))
    slim = written(base.where(F.octet_length("payload") >= least_bytes).select("page_id", "_sum"), "warc-digests")
    least = slim.groupBy("_sum").agg(F.min("page_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1 AND _least IS NOT NULL").drop("_n")
    least = written(least, "warc-least")
    few = least.count() <= small
    at = F.broadcast(least) if few else least
    # how often the smallest page_id itself occurs with the payload
    own = slim.join(at, "_sum").where("page_id = _least").groupBy("_sum").agg(F.count("*").alias("_own"))
    least, gone = written(least.join(own, "_sum"), "warc-least"), least
    removed(slim, gone)
    base = base.join(F.broadcast(least) if few else least, "_sum", "left")
    if least_bytes > 0:
        base = base.withColumn("_least", F.when(F.octet_length("payload") >= least_bytes, F.col("_least")))
    again = F.col("_least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_least"))
    many = F.coalesce(~again & F.col("_least").isNotNull() & (F.col("_own") > 1), F.lit(False))
    once = base.where(~many) if (repeated := least.where("_own > 1").limit(1).count()) else base
    columns = ("page_id", "url", "payload", "kind", "refers")
    out = once.withColumn("kind", F.when(again, "revisit").otherwise("response")).withColumn("refers", F.when(again, F.col("_least"))).select(*columns)
    if repeated:
        rows = base.where(many).groupBy("_sum", "page_id", "url").agg(F.first("payload").alias("payload"), F.count("*").alias("_c"))
        rows = rows.join(rows.groupBy("_sum").agg(F.min(F.coalesce(F.concat(F.lit("u"), "url"), F.lit(""))).alias("_first")), "_sum")
        first = (F.col("_k") == 1) & (F.coalesce(F.concat(F.lit("u"), "url"), F.lit("")) == F.col("_first"))
        rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_c")))
        out = out.unionByName(rows.withColumn("kind", F.when(first, "response").otherwise("revisit")).withColumn("refers", F.when(~first, F.col("page_id"))).select(*columns))
    return out


def write_archives(decided: DataFrame, folder: str, when: Column | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records to ``folder``; the answer, one row for each file, is the archives' manifest (path, records, bytes).

    when: seconds since 1970 at which a page was captured (by default EPOCH and page_id, wrapped round at WRAP). A file appears under its final name only when it is whole, and only files in the manifest count, so a task
    that is tried again or twice leaves nothing that would be read.
    """
    seconds = F.lit(EPOCH).cast("long") + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(WRAP)) if when is None else F.coalesce(when.cast("long"), F.lit(0))
    rows = decided.select("page_id", "url", seconds.alias("_when"), "payload", "kind", "refers")

    def run(batches):
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        parts, size, n = [], 0, 0

        def close():
            name = f"{base}/{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(name + ".part", compression=None) as out:
                for p in parts:
                    out.write(p)
            store.move(name + ".part", name)
            return pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for page, url, at, payload, kind, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts.append(record(page, url, moment(at), payload, kind, refers))
                size += len(parts[-1])
                n += 1
                if size >= file_bytes:
                    yield close()
                    parts, size, n = [], 0, 0
        if parts:
            yield close()

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


_CAPTURE = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("captured", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("run", T.StringType()),
    ]
)


def _order(row: tuple) -> tuple:
    """Order of the index: URL key, time, page; nulls first."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def read_archives(manifest: DataFrame, folder: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """The captures of all archives in ``manifest``, as runs: each sorted by URL key, time and page_id.

    Payload digests of responses are those of the bytes read; a response whose header says otherwise fails.
    """

    def ident(name: str | None) -> int | None:
        tail = (name or "").rpartition(":")[2].rstrip(">")
        return int(tail) if tail not in ("", "None") else None

    def batch(rows, name):
        rows.sort(key=_order)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[(*r, name) for r in rows], strict=True), kinds, strict=True)], names=_CAPTURE.names)

    def run(batches):
        store, _ = filesystem(folder)
        for path in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            rows, number = [], 0
            with store.open_input_stream(path, compression=None) as raw, gzip.open(raw, "rb") as stream:
                for headers, block in parse(stream):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = headers["warc-type"]
                    claimed = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
                    if kind == "response" and (digest(payload), len(payload)) != (claimed, size):
                        raise ValueError(f"{path}: {headers['warc-record-id']} is damaged")
                    at = int(datetime.strptime(headers["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                    rows.append((url_key(headers.get("warc-target-uri")), at, ident(headers["warc-record-id"]), size, claimed, kind, ident(headers.get("warc-refers-to")) if kind == "revisit" else None))
                    if len(rows) >= run_rows:
                        yield batch(rows, f"{path}#{number}")
                        rows, number = [], number + 1
            if rows:
                yield batch(rows, f"{path}#{number}")

    files = manifest.select("path").repartition(max(1, parallelism(manifest.sparkSession)), "path")
    return files.mapInArrow(run, _CAPTURE)


class LoserTree:
    """Merges sorted runs of keys: each inner node keeps the loser of its match, so a step replays one path to the root.

    Yields (run, place in the run).
    """

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.losers = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self.replay(i, True)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.at[a], self.at[b]
        if x == len(self.runs[a]) or y == len(self.runs[b]):
            return y == len(self.runs[b])
        return (self.runs[a][x], a) <= (self.runs[b][y], b)

    def replay(self, i: int, filling: bool = False) -> None:
        node, winner = (i + len(self.losers)) // 2, i
        while node:
            other = self.losers[node]
            if filling and other == -1:
                self.losers[node] = winner
                return
            if other != -1 and self.beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        while self.runs and self.at[i := self.losers[0]] < len(self.runs[i]):
            yield i, self.at[i]
            self.at[i] += 1
            self.replay(i)


def _merge(batches):
    """All pieces of runs in a range of keys, one run after another, each in order, merged."""
    held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if held is None or not len(held):
        return
    names = held.column("run").to_pylist()
    cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
    keys = list(map(_order, zip(*[held.column(c).to_pylist() for c in _CAPTURE.names[:3]], strict=True)))
    order = pa.array((cuts[i] + at for i, at in LoserTree([keys[a:b] for a, b in itertools.pairwise(cuts)])), pa.int64())
    merged = held.drop_columns("run").take(order).append_column("place", pa.array(range(len(held)), pa.int64()))
    yield from merged.to_batches(max_chunksize=10_000)


def merged_index(captures: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """The captures (a table that can be read again) in global order, with capture_seq from 0: ranges of keys are merged apart, then counted on.

    There are as many ranges as give each about ``rows`` captures. They are cut by URL key, time, page_id and run, so neither a URL with most of
    the captures nor a row that is repeated without end fills one; Spark's sort, which spills, brings each run's piece in order.
    """
    spark = captures.sparkSession
    ranges = max(parallelism(spark), -(-captures.count() // rows))
    ranged = captures.repartitionByRange(ranges, "url_key", "captured", "page_id", "run").sortWithinPartitions("run", "url_key", "captured", "page_id")
    schema = T.StructType([*_CAPTURE.fields[:-1], T.StructField("place", T.LongType())])
    merged = written(ranged.mapInArrow(_merge, schema).withColumn("part", F.spark_partition_id()), "warc-index")
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))  # one row for each range
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return leaving(merged.join(F.broadcast(ahead), "part").select(*_CAPTURE.names[:-1], (F.col("ahead") + F.col("place")).alias("capture_seq")), merged)


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, when: Column | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, read them back, and return the merged index of captures.

    A null html is an empty payload, a null URL has an empty key, a null page_id is written as no number and
    never referred to; rows that repeat a page_id are each archived, the one that is referred to included.
    ``folder`` is one that all executors share, where the archives stay; without it they are written below
    spark.checkpoint.dir and removed when they have been read.
    """
    spark = pages.sparkSession
    base = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(with_decisions(pages, least_bytes), base, when)
    runs = written(read_archives(manifest, base), "warc-runs")
    index = merged_index(runs)
    removed(manifest, runs)
    if folder is None:
        store, path = filesystem(base)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)
    return index


def op2_warc(spark, sf_dir: str) -> DataFrame:
    index = archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_seq")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s,
           lower(trim(coalesce(url, ''))) AS u FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS low,
      regexp_extract(u, '^[a-z]+://([^/?#]*)([^?#]*)([^#]*)', ['host', 'path', 'query']) AS x FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(x.host, '.')), ',') || ')' || CASE WHEN x.path = '' THEN '/' ELSE x.path END || x.query AS url_key FROM q)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) // CAST(power(32, 3 - i % 4) AS INTEGER)) % 32 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to, url_key,
       row_number() OVER (ORDER BY encode(url_key), page_id) - 1 AS capture_seq
FROM k
"""
