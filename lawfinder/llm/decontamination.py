"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts become words: A-Z lower-cased, runs of digits, letters and bytes above 127 kept, everything else
separates. Each benchmark item gives windows of ten consecutive words (an item of fewer words is one
window). All windows of one length are searched together: a shift table, keyed by blocks of three words,
says how far the search may jump; at shift zero the block's bucket, narrowed by the window's first words,
names the test strings, and a direct comparison confirms each occurrence.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawfinder.llm.common import bounded_batches, filesystem, shared_dir, table, utf8, without

WINDOW = 10
#: Bytes of benchmark text whose tables a worker holds at a time, and of documents that it searches for one block after another.
BLOCK_BYTES, HELD_BYTES = 4 << 20, 32 << 20

_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


class WuManber:
    """All windows of one length; symbols are word numbers, 0 for a word that no window has."""

    def __init__(self, length: int, vocabulary: int):
        self.length = length
        self.block = min(3, length)
        self.base = vocabulary + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[list[int], int]]]] = {}

    def key(self, symbols: list[int]) -> int:
        k = 0
        for s in symbols:
            k = k * self.base + s
        return k

    def add(self, window: list[int], number: int) -> None:
        n, b = self.length, self.block
        for end in range(b, n + 1):
            k = self.key(window[end - b : end])
            self.shift[k] = min(self.shift.get(k, n), n - end)
        k = self.key(window[n - b :])
        self.buckets.setdefault(k, {}).setdefault(window[0], []).append((window, number))

    def search(self, text: list[int]):
        """Pairs (start, window number) of all occurrences."""
        n, b, base, size = self.length, self.block, self.base, len(text)
        default, shift, buckets = n - b + 1, self.shift.get, self.buckets
        end = n
        while end <= size:
            if b == 3:
                k = (text[end - 3] * base + text[end - 2]) * base + text[end - 1]
            elif b == 2:
                k = text[end - 2] * base + text[end - 1]
            else:
                k = text[end - 1]
            jump = shift(k, default)
            if jump:
                end += jump
                continue
            start = end - n
            for window, number in buckets[k].get(text[start], ()):
                if text[start:end] == window:
                    yield start, number
            end += 1


class Matcher:
    """The tables for a block of items: (item_id, text bytes)."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: list[list[int]] = []
        windows: dict[tuple[int, ...], int] = {}
        for item, raw in items:
            found = words(raw)
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            size = min(window, len(numbers))
            for i in range(len(numbers) - size + 1 if size else 0):
                at = windows.setdefault(tuple(numbers[i : i + size]), len(windows))
                if at == len(self.owners):
                    self.owners.append([])
                if not self.owners[at] or self.owners[at][-1] != item:  # items come in order
                    self.owners[at].append(item)
        self.searches: dict[int, WuManber] = {}
        for w, number in windows.items():
            self.searches.setdefault(len(w), WuManber(len(w), len(self.vocabulary))).add(list(w), number)

    def find(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of covered words (start, end) and the items whose windows occur."""
        get = self.vocabulary.get
        text = [get(w, 0) for w in found]
        spans, numbers = [], set()
        for length, search in self.searches.items():
            for start, number in search.search(text):
                spans.append((start, start + length))
                numbers.add(number)
        return merge(spans), set().union(*(self.owners[n] for n in numbers))


_BUILT: dict[str, Matcher] = {}


def built(key: str, items: Callable[[], list[tuple[int, bytes]]], window: int) -> Matcher:
    """The block's tables, built once in each Python worker; only the latest block's are kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(sorted(items()), window)
    return _BUILT[key]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
        T.StructField("hit_items", T.ArrayType(T.LongType())),
    ]
)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[tuple[str, Callable[[], list[tuple[int, bytes]]]]]:
    """The items in blocks of about ``block_bytes``, each a name and a function that a worker calls for its items.

    A single block is broadcast. More of them are written to the shared folder, dealt by the items' ids, and read by
    the workers that search them, so the driver holds none.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text")).where("item_id IS NOT NULL")
    name, n = uuid.uuid4().hex, -(-(rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // block_bytes)
    if n <= 1:
        sent = spark.sparkContext.broadcast([(r.item_id, bytes(r.text)) for r in rows.collect()])
        return [(name, lambda: sent.value)]
    folder = f"{shared_dir(spark)}/benchmark-{name}"
    rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n))).repartition(n, "block").write.partitionBy("block").parquet(folder)

    def reader(k: int):
        def read() -> list[tuple[int, bytes]]:
            store, path = filesystem(f"{folder}/block={k}")
            if store.get_file_info(path).type == fs.FileType.NotFound:
                return []
            found = dataset.dataset(path, filesystem=store, format="parquet").to_table(columns=["item_id", "text"])
            return list(zip(found.column("item_id").to_pylist(), found.column("text").to_pylist(), strict=True))

        return read

    return [(f"{name}-{k}", reader(k)) for k in range(n)]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES
) -> DataFrame:
    """Add n_words, hit_spans (flat start, end pairs of words), hit_items (sorted ids) and n_hit to each document.

    A null or empty text has no words; equal windows of several items count for each of them; rows that
    repeat are each answered. Items with a null id are passed over, an empty benchmark hits nothing.
    Existing columns with these names are replaced. Documents are never shuffled: they are read once, and a worker
    searches ``held_bytes`` of them for one block of the benchmark after another.
    """
    bounded_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, block_bytes)
    kept = without(docs, [*_ADDED.names, "n_hit"])
    names = kept.columns
    at = [c.lower() for c in names].index(text.lower())

    def search(held: list[pa.RecordBatch]):
        split = [words(raw) for b in held for raw in utf8(b.column(at))]
        spans: list[list] = [[] for _ in split]
        items: list[set] = [set() for _ in split]
        for name, read in blocks:
            matcher = built(name, read, window)
            for i, found in enumerate(split):
                now, hit = matcher.find(found)
                if now:
                    spans[i] = merge([*spans[i], *now])
                    items[i] |= hit
        rows = iter(zip(split, spans, items, strict=True))
        for b in held:
            mine = list(itertools.islice(rows, len(b)))
            counts = pa.array([len(w) for w, _, _ in mine], pa.int64())
            flat = pa.array([[x for s in found for x in s] for _, found, _ in mine], pa.list_(pa.int64()))
            named = pa.array([sorted(hit) for _, _, hit in mine], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, counts, flat, named], names=[*names, *_ADDED.names])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(at).nbytes
            if len(blocks) == 1 or size >= held_bytes:
                yield from search(held)
                held, size = [], 0
        if held:
            yield from search(held)

    out = kept.mapInArrow(run, T.StructType(kept.schema.fields + _ADDED.fields))
    hit = "aggregate(sequence(0, size(hit_spans) - 2, 2), 0L, (a, i) -> a + hit_spans[i + 1] - hit_spans[i])"
    return out.withColumn("n_hit", F.expr(f"CASE WHEN size(hit_spans) < 2 THEN 0L ELSE {hit} END"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with the columns they came with."""
    return find_contamination(docs, benchmark, text).where("n_hit = 0").select(*docs.columns)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    named = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS named
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
