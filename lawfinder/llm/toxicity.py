"""Toxicity by class-conditional Kneser-Ney models.

Two models spell words byte by byte, one learnt from toxic and one from ordinary documents: six-byte
sequences, padded at a word's start, are counted for each class, and both classes back off to one shared
Kneser-Ney model, counted over all documents, labelled or not, in which shorter sequences count by the number of
different bytes that precede them. What a class has rarely seen thus gets the shared probability and is no
evidence. All sequences are kept, in tables: Spark adds up the orders and their contexts. The evidence of the most
frequent sequences is broadcast, that of others joined to the texts that have them. A word's evidence is the difference of its two log-likelihoods. A toxic document
is for the most part ordinary words, so the text's length-normalised log-likelihood as a mixture, of which the toxic model
wrote a given share, is compared with that as an ordinary text, for several shares; these differences, the strongest
word's and the length go through a logistic layer, which makes a probability of them. Words are modelled apart from each other.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawfinder.llm import logistic
from lawfinder.llm.common import add_columns, removed, table, utf8, written
from lawfinder.llm.decontamination import words
from lawfinder.llm.quality import remainder

ORDER = 6
DISCOUNT = 0.75
#: Sequences of a context that a class must have seen for its own counts to weigh as much as the shared model.
STRENGTH = 40.0
START, END = 1, 2
#: Labelled documents that are counted at most (those whose ids hash lowest), and of these, set apart for the last layer.
TRAIN_DOCS, CALIBRATE_DOCS = 200_000, 4000
#: Shares of a toxic document's words that the toxic model is taken to have written, the others being ordinary.
SHARES = (0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
#: Evidence of one word beyond which more of it says nothing.
MOST_EVIDENCE = 20.0
#: Words longer than this many bytes are spelt in pieces of this length.
LONGEST = 64
THRESHOLD = 0.3
#: Words whose evidence a worker remembers.
REMEMBERED = 400_000
#: Sequences, the most frequent ones, whose evidence is broadcast.
BROADCAST = 3 << 21


def spelt(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte sequences that end at each byte and at the end of each word, and the number of each word's."""
    joined = np.frombuffer(b"".join(b"\x01\x01\x01\x01\x01" + w + b"\x02" for w in found), np.uint8)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    grams = np.zeros(len(joined) - ORDER + 1, np.int64)
    for k in range(ORDER):
        grams = (grams << 8) | joined[k : len(joined) - ORDER + 1 + k]
    ends = np.cumsum(size + ORDER - 1) - (ORDER - 1)  # one after each word's last sequence
    starts = ends - size
    keep = np.zeros(len(grams) + 1, np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    return grams[np.cumsum(keep)[:-1] > 0], size


def pieces(raw: bytes) -> list[bytes]:
    found = words(raw)
    if len(raw) > LONGEST and any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def _count(batches):
    """(text, class or -1) to rows (g: six-byte sequence, n, n0, n1: its number in all, ordinary and toxic documents)."""
    total: tuple[np.ndarray, np.ndarray] | None = None
    for b in batches:
        raws, kinds = utf8(b.column(0)), b.column(1).to_pylist()
        grams, counts = ([total[0]], [total[1]]) if total else ([], [])
        for kind in sorted(set(kinds)):
            found: dict[bytes, int] = {}
            for raw in itertools.compress(raws, (k == kind for k in kinds)):
                for w in pieces(raw):
                    found[w] = found.get(w, 0) + 1
            if found:
                g, size = spelt(list(found))
                n = np.repeat(np.fromiter(found.values(), np.int64, len(found)), size)
                grams.append(g)
                counts.append(np.stack([n, n * (kind == 0), n * (kind == 1)]))
        if grams:
            keys, back = np.unique(np.concatenate(grams), return_inverse=True)
            n = np.concatenate(counts, axis=1)
            total = keys, np.stack([np.bincount(back, x, len(keys)).astype(np.int64) for x in n])
    for at in range(0, len(total[0]) if total else 0, 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (total[0], *total[1])], names=["g", "n", "n0", "n1"])


def counted(texts: DataFrame) -> DataFrame:
    """(g, n, n0, n1) of all distinct sequences of (text, class or -1)."""
    rows = texts.mapInArrow(_count, "g long, n long, n0 long, n1 long")
    return rows.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")])


def sequence_evidence(sequences: DataFrame) -> DataFrame:
    """(g, n, e), a table: n, and the log of the toxic over the ordinary probability of each sequence's last byte.

    Every order is one table that holds the endings of all longer sequences. Sequences that were never counted
    may be among the rows with counts of 0: they get what the backoff gives them and add to no context. A context or an
    ending has 256 rows at most, so no key is crowded.
    """
    ending = lambda order: F.col("g").bitwiseAND(F.lit((1 << 8 * order) - 1))
    levels = {ORDER: sequences}
    for order in range(ORDER - 1, 0, -1):
        rows = levels[order + 1].groupBy(ending(order).alias("g")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n"))
        levels[order] = written(rows, "toxicity-order") if order > 2 else rows
    bytes_ = levels[1].collect()
    total = sum(r.n for r in bytes_)
    single = [(r.g, (1e-6 + r.n / max(total, 1)) / (256e-6 + (total > 0))) for r in bytes_]
    lower = sequences.sparkSession.createDataFrame(single, "g long, p double")
    same = Window.partitionBy(F.shiftright("g", 8))

    def smooth(n: str, strength: float):
        total = F.sum(n).over(same) + F.lit(strength)
        rest = F.lit(strength) + F.lit(DISCOUNT) * F.sum((F.col(n) > 0).cast("long")).over(same)
        return F.greatest(F.col(n) - F.lit(DISCOUNT), F.lit(0.0)), rest, total

    for order in range(2, ORDER + 1):
        names = ["n", "n0", "n1"] if order == ORDER else ["n"]
        parts = {f"{n}_{k}": x for n in names for k, x in enumerate(smooth(n, 0.0 if n == "n" else STRENGTH))}
        rows = levels[order].select("g", "n", *[x.alias(k) for k, x in parts.items()]).withColumn("g_", ending(order - 1))
        rows = rows.join(lower.withColumnsRenamed({"g": "g_", "p": "below"}), "g_")
        rows = rows.withColumn("p", F.expr("CASE WHEN n_2 > 0 THEN (n_0 + n_1 * below) / n_2 ELSE below END"))
        lower = rows.select("g", "p") if order < ORDER else rows
    e = F.expr("ln((n1_0 + n1_1 * p) / n1_2) - ln((n0_0 + n0_1 * p) / n0_2)")
    out = written(lower.select("g", "n", e.alias("e")), "toxicity-evidence")
    removed(*[levels[order] for order in range(3, ORDER)])
    return out


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in the sorted table; its length for those that it lacks."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    return np.where(table[np.minimum(at, len(table) - 1)] == keys, at, len(table))


class Level:
    """Sequences of one order and their contexts, with counts and, for each context, its sum and its kinds."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams = grams
        self.contexts, back = np.unique(grams >> 8, return_inverse=True)
        pad = lambda x: np.append(x, 0.0)
        self.counts = pad(np.maximum(counts - DISCOUNT, 0))
        self.sums = pad(np.bincount(back, counts, len(self.contexts)))
        self.kinds = pad(np.bincount(back, counts > 0, len(self.contexts)))

    def smooth(self, at: np.ndarray, context: np.ndarray, below: np.ndarray, strength: float) -> np.ndarray:
        """Discounted counts, the rest by the probabilities ``below``."""
        total = self.sums[context] + strength
        seen = total > 0
        rest = np.where(seen, strength + DISCOUNT * self.kinds[context], 1)
        return (self.counts[at] + rest * below) / np.where(seen, total, 1)


class Spelling:
    """What the tables say, for few sequences in memory; counts: of all, ordinary and toxic documents."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        levels, n = [(grams, counts[0].astype(float))], None
        for order in range(ORDER - 1, 0, -1):
            keys, n = np.unique(levels[-1][0] & ((1 << 8 * order) - 1), return_counts=True)
            levels.append((keys, n.astype(float)))
        self.single = np.full(256, 1e-6)
        self.single[levels[-1][0]] += levels[-1][1] / max(levels[-1][1].sum(), 1)
        self.single /= self.single.sum()
        self.shared = [Level(g, n) for g, n in reversed(levels[:-1])]
        self.classes = [Level(grams, counts[c].astype(float)) for c in (1, 2)]

    def evidence(self, grams: np.ndarray) -> np.ndarray:
        """Log of the toxic over the ordinary probability of each sequence's last byte."""
        p = self.single[grams & 0xFF]
        for order, level in zip(range(2, ORDER + 1), self.shared, strict=True):
            g = grams & ((1 << 8 * order) - 1)
            at, context = find(level.grams, g), find(level.contexts, g >> 8)
            p = level.smooth(at, context, p, 0.0)
        ordinary, toxic = (c.smooth(at, context, p, STRENGTH) for c in self.classes)  # these share the top level's sequences
        return np.log(toxic) - np.log(ordinary)


class Evidence:
    """Evidence of sequences: that of the most frequent ones broadcast, the others, if any, in a table to be joined."""

    def __init__(self, sequences: DataFrame, most: int):
        table_ = rows = sequence_evidence(sequences)
        # classes of frequency, eight for each doubling
        rows = rows.withColumn("often", F.floor(F.log2(F.greatest("n", F.lit(1))) * 8).cast("int"))
        sizes = sorted(((r["often"], r["count"]) for r in rows.groupBy("often").count().collect()), reverse=True)
        least, size = 1 << 20, 0
        for often, count in sizes:
            size += count
            if size > most:
                break
            least = often
        known = rows.where(F.col("often") >= least).select("g", "e").toArrow().sort_by("g")
        self.sent = sequences.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("g", "e")))
        self.name = uuid.uuid4().hex
        self.rare = rows.where(F.col("often") < least).select("g", "e") if size > most else None
        if self.rare is None:
            removed(table_)


@dataclass
class Model:
    sequences: DataFrame
    combine: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    docs: DataFrame
    text: str
    evidence: Evidence
    most: int

    def evidence_for(self, docs: DataFrame, text: str) -> Evidence:
        """That of all sequences of ``docs``; those of other documents than the counted ones join the tables with counts of 0."""
        if docs is self.docs and text == self.text:
            return self.evidence
        new = counted(docs.select(F.col(text).cast("string").alias("text"), F.lit(-1).alias("y")))
        rows = self.sequences.unionByName(new.select("g", *[F.lit(0).cast("long").alias(c) for c in ("n", "n0", "n1")]))
        return Evidence(written(rows.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")]), "toxicity-sequences"), self.most)


#: One for each share, the strongest word's evidence, and the length.
FEATURES = len(SHARES) + 2
_REMEMBERED: dict[str, dict[bytes, float | None]] = {}


def remember(found: list[list[bytes]], sent, name: str) -> dict[bytes, float | None]:
    """The words' evidence; None where a sequence's is not broadcast."""
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = {}
    known = _REMEMBERED[name]
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set(itertools.chain.from_iterable(found)).difference(known))
    for at in range(0, len(new), 50_000):
        part = new[at : at + 50_000]
        grams, size = spelt(part)
        keys, e = sent.value
        sums = np.add.reduceat(np.append(e, np.nan)[find(keys, grams)], np.cumsum(size) - size)
        known.update(zip(part, [None if x != x else x for x in sums.tolist()], strict=True))
    return known


def spelt_out(missing: list[bytes], sent, more: dict[int, float]) -> dict[bytes, float]:
    """Evidence of words that have sequences of ``more``."""
    grams, size = spelt(missing)
    keys, e = sent.value
    at = find(keys, grams)
    each = np.append(e, 0.0)[at]
    lacks = np.flatnonzero(at == len(keys))
    each[lacks] = [more[g] for g in grams[lacks].tolist()]
    return dict(zip(missing, np.add.reduceat(each, np.cumsum(size) - size).tolist(), strict=True))


def compared(e: np.ndarray) -> np.ndarray:
    """What the words' evidence ``e`` says of a text: for each share, its length-normalised log-likelihood as toxic less that as ordinary
    (on a scale that compresses large differences), the strongest word's evidence, and the logarithm of the length."""
    out = np.zeros(FEATURES)
    if len(e):
        e = np.minimum(e, MOST_EVIDENCE)
        ratio = np.expm1(e)
        mean = np.array([np.log1p(s * ratio).mean() if s < 1 else e.mean() for s in SHARES])
        out[: len(SHARES)] = np.sign(mean) * np.log1p(100 * np.abs(mean))
        out[-2:] = e.max(), np.log1p(len(e))
    return out


def features(texts: list[bytes], sent, name: str, more: list[dict[int, float]] | None = None) -> np.ndarray:
    """``compared`` of each text; ``more`` has the evidence of each text's sequences that is not broadcast."""
    split = [pieces(raw) for raw in texts]
    known = remember(split, sent, name)
    out = np.zeros((len(texts), FEATURES))
    for i, found in enumerate(split):
        e = list(map(known.__getitem__, found))
        if more is not None and None in e:
            own = spelt_out(list({w for w, x in zip(found, e, strict=True) if x is None}), sent, more[i])
            e = [own[w] if x is None else x for w, x in zip(found, e, strict=True)]
        out[i] = compared(np.array(e, np.float64))
    return out


def with_features(docs: DataFrame, text: str, evidence: Evidence, added: T.StructType, made: Callable[[np.ndarray], list]) -> DataFrame:
    """Add the columns that ``made`` makes of each text's features."""
    sent, name = evidence.sent, evidence.name
    if evidence.rare is None:

        def fresh():
            return lambda column: made(features(utf8(column), sent, name))

        return add_columns(docs, [text], added, fresh)

    def keys():
        return lambda column: [pa.array([xxhash.xxh3_128_digest(raw) for raw in utf8(column)], pa.binary())]

    def pairs(batches):
        seen = set()
        for b in batches:
            split = [pieces(raw) for raw in utf8(b.column(0))]
            known = remember(split, sent, name)
            for found, key in zip(split, b.column(1).to_pylist(), strict=True):
                missing = [] if key in seen else [w for w in set(found) if known[w] is None]
                seen.add(key)
                if missing:
                    g = np.unique(spelt(missing)[0])
                    g = g[find(sent.value[0], g) == len(sent.value[0])]
                    for at in range(0, len(g), 50_000):
                        part = g[at : at + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.binary()), pa.array(part)], names=["__lf_key", "g"])

    keyed = add_columns(docs, [text], T.StructType([T.StructField("__lf_key", T.BinaryType())]), keys)
    found = keyed.select(F.col(text).cast("string"), "__lf_key").mapInArrow(pairs, "__lf_key binary, g long").distinct().join(evidence.rare, "g")
    found = found.groupBy("__lf_key").agg(F.collect_list(F.struct("g", "e")).alias("__lf_more"))

    def fresh():
        def make(column, lists):
            return made(features(utf8(column), sent, name, [{x["g"]: x["e"] for x in r or ()} for r in lists.to_pylist()]))

        return make

    joined = keyed.join(found, "__lf_key", "left").drop("__lf_key")
    return add_columns(joined, [text, "__lf_more"], added, fresh).drop("__lf_more")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = TRAIN_DOCS, calibrate: int = CALIBRATE_DOCS, broadcast: int = BROADCAST) -> Model:
    """Learn from labelled documents with crc32(doc_id) mod 4 not 2.

    One quarter of these, by the next bits of the checksum, is set apart for the last layer, the others are
    counted; a doc_id with several labels takes its smallest one. No labels: every score is 1/2.
    """
    crc = F.crc32(F.col("_id").cast("string").cast("binary"))
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.where(remainder("_id", 4) != 2).groupBy("_id").agg(F.min("_y").alias("_y"))
    apart = F.floor(crc / 4) % 4 == 0
    learnt = known.where(~apart).orderBy(F.xxhash64("_id"), "_id").limit(most)
    base = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).cast("string").alias("text"))
    seen = base.join(F.broadcast(learnt), F.col("_doc") == F.col("_id"), "left").select("text", F.coalesce("_y", F.lit(-1)).alias("y"))
    sequences = written(counted(seen), "toxicity-sequences")
    model = Model(sequences, None, docs, text, Evidence(sequences, broadcast), broadcast)
    held = known.where(apart).orderBy(F.xxhash64("_id"), "_id").limit(calibrate)
    held = base.join(F.broadcast(held), F.col("_doc") == F.col("_id")).orderBy(F.xxhash64("_id"), "_id", "text").limit(calibrate).select("text", "_y")
    x = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = with_features(held, "text", model.evidence, x, lambda made: [pa.array(list(made), pa.list_(pa.float64()))]).select("x", "_y").collect()
    found = sorted((list(r.x), r._y) for r in found)
    if found:
        model.combine = logistic.fit(np.array([x for x, _ in found]), np.array([y for _, y in found], float))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability that each whole text is toxic (null like empty, which has no evidence)."""
    combine = model.combine

    def score(x):
        return [pa.array(np.full(len(x), 0.5) if combine is None else logistic.apply(combine, x), pa.float64())]

    return with_features(docs, text, model.evidence_for(docs, text), T.StructType([T.StructField(name, T.DoubleType())]), score)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
