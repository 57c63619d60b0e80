"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. In each chunk, learned
filters run over embedded bytes; the largest response of each filter goes through a small hidden layer to the
chunk's log-odds. A logistic layer over the mean, smallest and largest chunk log-odds, and the document's
length, gives the probability that the document is of good quality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lawfinder.llm import logistic
from lawfinder.llm.common import add_columns, table, utf8

#: Bytes of a chunk, and from one chunk's start to the next one's.
CHUNK, STEP = 512, 384
#: Bytes of half a filter (which is also its stride), embedding width, filters and hidden units.
HALF, WIDTH, FILTERS, HIDDEN = 4, 8, 32, 16
#: The fit reads this many labelled documents at most, those whose ids hash lowest, and no more of them than take this many bytes.
TRAIN_DOCS, TRAIN_BYTES = 4000, 64 << 20
#: Chunks that one pass of the training draws from a text at random; the texts are read whole, and the next pass draws anew.
DRAWN = 12
THRESHOLD = 0.3
#: Chunks that pass through the network at once.
BATCH = 512
#: The byte that fills the last chunk.
FILL = 0


def chunks(raw: bytes) -> np.ndarray:
    """(n, CHUNK) bytes: overlapping chunks that cover the text, one at least."""
    n = max(1, 1 + -(-(len(raw) - CHUNK) // STEP)) if len(raw) > CHUNK else 1
    data = np.frombuffer(raw.ljust((n - 1) * STEP + CHUNK, bytes([FILL])), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::STEP]


@dataclass
class Network:
    embed: np.ndarray  # 256, WIDTH
    first: np.ndarray  # HALF * WIDTH, 2 * FILTERS: both halves of each filter
    bias: np.ndarray  # FILTERS
    hidden: np.ndarray  # FILTERS, HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1

    @classmethod
    def start(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s: r.standard_normal(s).astype(np.float32)
        z = lambda *s: np.zeros(s, np.float32)
        return cls(n(256, WIDTH) * 0.5, n(HALF * WIDTH, 2 * FILTERS) / 8, z(FILTERS), n(FILTERS, HIDDEN) / 6, z(HIDDEN), n(HIDDEN) / 4, z(1))

    def respond(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and where."""
        x = self.embed[data].reshape(-1, HALF * WIDTH)
        y = (x @ self.first).reshape(len(data), CHUNK // HALF, 2 * FILTERS)
        y = y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]
        where = y.argmax(axis=1)
        return np.take_along_axis(y, where[:, None], axis=1)[:, 0] + self.bias, where

    def odds(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(data), np.float32)
        for at in range(0, len(data), BATCH):
            x = self.embed[data[at : at + BATCH]].reshape(-1, HALF * WIDTH)
            y = (x @ self.first).reshape(-1, CHUNK // HALF, 2 * FILTERS)
            top = (y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]).max(axis=1) + self.bias
            h = np.maximum(np.maximum(top, 0) @ self.hidden + self.hidden_bias, 0)
            out[at : at + BATCH] = h @ self.out + self.out_bias
        return out

    def gradients(self, data: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        top, where = self.respond(data)
        a = np.maximum(top, 0)
        h = np.maximum(a @ self.hidden + self.hidden_bias, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))
        d = ((p - label) / len(label)).astype(np.float32)
        dh = np.outer(d, self.out) * (h > 0)
        da = (dh @ self.hidden.T) * (top > 0)
        # only the place of the largest response learns
        at = where[:, :, None] * HALF + np.arange(2 * HALF)
        seen = np.take_along_axis(data[:, None, :], at, axis=2)
        patch = self.embed[seen].reshape(len(data), FILTERS, 2, HALF * WIDTH)
        dw = np.einsum("nf,nfhk->khf", da, patch).reshape(HALF * WIDTH, 2 * FILTERS)
        w = self.first.reshape(HALF * WIDTH, 2, FILTERS).transpose(2, 1, 0)
        back = (da[:, :, None, None] * w).reshape(-1, WIDTH)
        flat = seen.reshape(-1)
        de = np.stack([np.bincount(flat, back[:, k], 256) for k in range(WIDTH)], axis=1).astype(np.float32)
        return [de, dw, da.sum(axis=0), a.T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()], np.float32)]

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def train(texts: list[np.ndarray], label: np.ndarray, passes: int = 8, rate: float = 4e-3, seed: int = 0) -> Network:
    """Adam over shuffled mini-batches; each pass draws DRAWN chunks of every text (all, if it has no more)."""
    net, r = Network.start(seed), np.random.default_rng(seed)
    m, v, t = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()], 0
    for turn in range(passes):
        drawn = [c if len(c) <= DRAWN else c[np.sort(r.choice(len(c), DRAWN, replace=False))] for c in texts]
        data, y = np.concatenate(drawn), np.repeat(label, [len(c) for c in drawn])
        order = r.permutation(len(data))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            t += 1
            step = rate * (1 if turn < passes - 2 else 0.3)
            for a, g, x, z in zip(net.arrays(), net.gradients(data[pick], y[pick]), m, v, strict=True):
                x += 0.1 * (g - x)
                z += 0.001 * (g * g - z)
                a -= (step * (x / (1 - 0.9**t)) / (np.sqrt(z / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def pooled(odds: np.ndarray, n_bytes: int) -> list[float]:
    return [float(odds.mean()), float(odds.min()), float(odds.max()), float(np.log1p(n_bytes))]


@dataclass
class Model:
    network: Network
    combine: tuple[np.ndarray, np.ndarray, np.ndarray]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of whole texts; texts of a batch share the network's passes."""
        out = np.empty((len(texts), 4))
        held: list[np.ndarray] = []
        who: list[int] = []
        size = 0

        def flush():
            odds = self.network.odds(np.concatenate(held) if len(held) > 1 else held[0])
            at = 0
            for i, c in zip(who, held, strict=True):
                out[i] = pooled(odds[at : at + len(c)], len(texts[i]))
                at += len(c)

        for i, raw in enumerate(texts):
            c = chunks(raw)
            held.append(c)
            who.append(i)
            size += len(c)
            if size >= BATCH:
                flush()
                held, who, size = [], [], 0
        if held:
            flush()
        return logistic.apply(self.combine, out)


def remainder(doc_id: str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def learnt(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int, text: str, doc_id: str) -> DataFrame:
    """(text, y) of the labelled documents that may be learnt from, ``most`` rows at most, in the order of their ids' hashes.

    A doc_id with several labels takes its smallest one; rows that repeat a doc_id all count, but make the sample no larger.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.where(~held_out).groupBy("_id").agg(F.min("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    return rows.orderBy(F.xxhash64("_id"), "_id", "text").limit(most).select("text", F.col("_y").alias("y"), "_id")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = TRAIN_DOCS, seed: int = 0, most_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from at most ``most`` labelled documents of ``most_bytes`` in sum, with crc32(doc_id) mod 5 not 0. No labels: every score is 1/2.

    The network draws from all chunks of these, and the last layer is fitted to what it says about their whole texts.
    """
    rows = learnt(docs, labels, "quality", remainder("_id", 5) == 0, most, text, doc_id)
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.orderBy(F.xxhash64("_id"), "_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("text", "y").toArrow()  # ``most`` rows at most
    texts = sorted(zip(utf8(found.column("text").combine_chunks()), found.column("y").to_pylist(), strict=True))  # the same model however the rows arrive
    if not texts:
        return Model(Network.start(seed), (np.zeros(4), np.ones(4), np.zeros(5)))
    parts, y = [chunks(raw) for raw, _ in texts], np.array([y for _, y in texts], np.float32)
    net = train(parts, y, seed=seed)
    pools = np.array([pooled(net.odds(p), len(raw)) for p, (raw, _) in zip(parts, texts, strict=True)])
    return Model(net, logistic.fit(pools, y))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of good quality of each whole text (null like empty)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fresh():
        return lambda column: [pa.array(sent.value.score(utf8(column)), pa.float64())]

    return add_columns(docs, [text], T.StructType([T.StructField(name, T.DoubleType())]), fresh)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with the columns they came with."""
    model = fit(docs, labels, text, doc_id)
    return scored(docs, model, text, "__lf_score").where(F.col("__lf_score") >= threshold).drop("__lf_score").select(*docs.columns)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
