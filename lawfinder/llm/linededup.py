"""Line deduplication by overlapping windows of three lines.

Each three consecutive lines of a document are hashed. A window that occurs in an earlier document (by
doc_id), or earlier in its own, is a later occurrence; the lines that such windows cover are merged and
removed. Only hashes are compared, of 128 bits (XXH3), so among a million million different windows no two meet by
chance.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawfinder.llm.common import add_columns, leaving, table, utf8, without, written

LINES = 3
#: Bytes of the repeated windows of all documents that are broadcast to the texts; where there are more, texts and windows meet in a shuffle.
SMALL_LATER = 16 << 20


def windows(lines: list[bytes], size: int = LINES) -> list[bytes | None]:
    """Hash of each ``size`` consecutive lines; windows of blank lines alone are None and never count."""
    digest = xxhash.xxh3_128_digest
    blank = [not line.strip() for line in lines]
    return [None if all(blank[i : i + size]) else digest(b"\n".join(lines[i : i + size])) for i in range(len(lines) - size + 1)]


def _hashes(batches):
    for b in batches:
        hashes, who = [], []
        for doc, raw in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            if doc is not None:
                found = set(windows(raw.split(b"\n"))) - {None}
                hashes += found
                who += [doc] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(who, pa.int64())], names=["h", "doc"])


def kept_lines(lines: list[bytes], late: set[bytes]) -> list[bytes]:
    """The lines that no window of ``late`` covers, nor one that has been in the text before."""
    gone, seen = bytearray(len(lines)), set()
    for i, h in enumerate(windows(lines)):
        if h is not None:
            if h in late or h in seen:
                gone[i : i + LINES] = b"\1" * LINES
            seen.add(h)
    return [x for x, g in zip(lines, gone, strict=True) if not g]


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", small: int = SMALL_LATER) -> DataFrame:
    """``docs`` with the text rid of repeated windows' lines, and n_lines (before) and n_removed added.

    The first occurrence is in the document of the smallest doc_id, and in it the first place; all others
    go. Documents of fewer than three lines have no window and stay as they are, and so do those
    without a doc_id; a null text has no lines and stays null. Rows that repeat a doc_id are one document: they keep
    the same lines. Columns called n_lines or n_removed are replaced. Texts are shuffled only if the
    repeated windows take more than ``small`` bytes.
    """
    names = without(docs, ["n_lines", "n_removed"]).columns
    slim = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    seen = slim.mapInArrow(_hashes, "h binary, doc long")
    first = seen.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h", "first")
    later = seen.join(first, "h").where("doc > first").groupBy("doc").agg(F.collect_set("h").alias("__lf_later")).withColumnRenamed("doc", "__lf_doc")
    later = written(later, "lines-later")
    size = later.agg(F.sum(F.size("__lf_later") * 32 + 64)).first()[0] or 0
    base = docs.select(*[F.col(f"`{c}`") for c in names])
    base = base.join(F.broadcast(later) if size <= small else later, F.col(doc_id).cast("long") == F.col("__lf_doc"), "left")
    added = T.StructType([T.StructField("__lf_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def fresh():
        def make(ids, column, late):
            texts, sizes, removed = [], [], []
            for known, given, raw, hits in zip(ids.is_valid().to_pylist(), column.is_valid().to_pylist(), utf8(column), late.to_pylist(), strict=True):
                lines = raw.split(b"\n") if given else []
                kept = kept_lines(lines, set(hits or ())) if known else lines
                texts.append(b"\n".join(kept) if given else None)
                sizes.append(len(lines))
                removed.append(len(lines) - len(kept))
            return [pa.array(texts, pa.binary()).cast(pa.string()), sizes, removed]

        return make

    out = add_columns(base, [doc_id, text, "__lf_later"], added, fresh)
    out = out.select(*[F.col("__lf_text").alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in names], "n_lines", "n_removed")
    return leaving(out, later)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS win
      FROM (SELECT r, doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3 AND doc_id IS NOT NULL)),
v AS (SELECT * FROM w WHERE regexp_matches(win, '[^\\x20\\x09-\\x0D]')),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first, min(i) OVER (PARTITION BY win, r) AS place FROM v),
g AS (SELECT DISTINCT r, unnest(range(i, i + 3)) AS p FROM f WHERE doc_id > first OR i > place),
e AS (SELECT r, l[p] AS line, p FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS p FROM d) WHERE (r, p) NOT IN (SELECT r, p FROM g)),
t AS (SELECT r, string_agg(line, chr(10) ORDER BY p) AS kept FROM e GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM g GROUP BY r)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN t USING (r) LEFT JOIN n USING (r)
"""
