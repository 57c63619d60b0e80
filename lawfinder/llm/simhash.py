"""SimHash near-duplicates by a binary-trie self-join.

A fingerprint is a path in a binary trie of 64 levels. The join walks pairs of trie nodes together, adds up
the bits in which they part and drops a pair as soon as it exceeds the error budget. To spread the trie over
tasks, the 64 levels are read in three rotations whose leading blocks have 22, 21 and 21 levels: two
fingerprints with at most two differing bits agree on one block at least, so each rotation only walks
below nodes where the block is equal. A block with many fingerprints is divided by further levels into
pairs of nodes whose prefixes are within the budget, one task group for each pair.

A few bits of one fingerprint of the whole text find slight edits only. To keep one of each group of near copies, the
same join runs over the SimHashes of several small samples of a text's five-word shingles, which name the
first candidates, and each candidate pair is confirmed by its exact similarity. That gathers most of each group. What it
leaves apart is then joined exactly: similar texts share one at least of the shingles that come first in a common order
(prefix filter), so all pairs of different groups that share one, and enough of them, are compared too. Shingles that the same
texts share are joined once, and where many texts share one, marks of a few bytes tell which pairs cannot be similar.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawfinder.llm.common import add_columns, checkpointed, leaving, left_tables, parallelism, removed, table, utf8, written
from lawfinder.llm.components import connected_components

#: Differing bits that still link two fingerprints.
BUDGET = 2
#: (rotation to the left, levels in the leading block)
ROTATIONS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints under one trie node beyond which the node is divided further.
NODE_LIMIT = 1024
#: Levels by which a crowded block is divided at most.
MOST_LEVELS = 16
#: Near copies in a corpus: words of a shingle and least Jaccard similarity.
WIDTH, SIMILARITY = 5, 0.8
#: Samples of a text's shingles that are fingerprinted and shingles in each; single shingles of texts that have SHORT at most. Two texts of
#: similarity s share a given sample with a chance of about s ** SAMPLE: of those with 0.8, one in 130 shares none of the sixteen.
SAMPLES, SAMPLE, SINGLES, SHORT = 16, 6, 3, 40
#: Texts whose shingles are counted to put the frequent ones last in the order of the exact join (any order is exact; this one keeps its lists
#: short), least count there, and most shingles that are listed.
ORDER_TEXTS, ORDER_COUNT, ORDER_MOST = 10_000, 3, 100_000
#: Leading shingles that are compared at once, and the bytes of a shingle's hash and of a text's key that are kept of each.
LEADING_ROWS, HASH_BYTES, KEY_BYTES = 2_000_000, 5, 6
#: Most bits of a text's mark; texts that share a shingle beyond which marks are compared instead of joining them in SQL, how many of these meet
#: in a task at once, and 64-bit words of marks that are compared at once.
MARK_BITS, CROWD, CROWD_ROWS, MARK_WORDS = 4096, 16, 4096, 1 << 21
#: Pairs up to which the keys of the texts that are compared are broadcast to find these; for more, all texts are shuffled by key.
ASKED_PAIRS = 200_000
#: Differing bits that still link the fingerprints of two samples, and the rotations for them.
SAMPLE_BUDGET, SAMPLE_ROTATIONS = 1, ((0, 32), (32, 32))
#: Trie-node pairs walked at once; more of them wait on a stack.
FRONTIER = 1 << 20


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """SimHash of word shingles with XXH64 (seed 42), as signed 64-bit numbers; no words: 0."""
    out = np.zeros(len(texts), np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i, raw in enumerate(texts):
        found = raw.lower().split()
        if not found:
            continue
        shingles = zip(*(itertools.islice(found, k, None) for k in range(width)), strict=False) if len(found) >= width else [found]
        hashes = np.array([digest(join(s), 42) for s in shingles], np.uint64)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def fingerprinted(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """Add the SimHash of the whole text as column ``name`` (null and empty texts: 0)."""

    def fresh():
        return lambda column: [pa.array(fingerprints(utf8(column), width), pa.int64())]

    return add_columns(docs, [text], T.StructType([T.StructField(name, T.LongType())]), fresh)


def trie_join(paths: np.ndarray, starts: np.ndarray, middles: np.ndarray, ends: np.ndarray, depth: int, budget: int = BUDGET):
    """Links among sorted paths: walk the trie under each group, its node against itself or its two nodes.

    A group is the range starts..ends; where middles is below ends, its left node is starts..middles and its
    right node middles..ends, each sorted. Yields (left, right) arrays of positions.
    """
    alone = middles >= ends
    stack = [(np.stack([starts, np.where(alone, ends, middles), np.where(alone, starts, middles), ends]).astype(np.int64), np.zeros(len(starts), np.int8), depth)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        nodes, wrong, level = stack.pop()
        if nodes.shape[1] > FRONTIER:
            half = nodes.shape[1] // 2
            stack += [(nodes[:, :half], wrong[:half], level), (nodes[:, half:], wrong[half:], level)]
            continue
        a, ae, b, be = nodes
        single = (ae - a == 1) & (be - b == 1)
        if single.any():
            i, j = a[single], b[single]
            near = (np.bitwise_count(paths[i] ^ paths[j]) <= budget) & (i != j)
            yield i[near], j[near]
            nodes, wrong = nodes[:, ~single], wrong[~single]
            a, ae, b, be = nodes
        if not len(a) or level >= 64:
            continue
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((paths >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)])
        sums = ones[level]
        am, bm = ae - (sums[ae] - sums[a]), be - (sums[be] - sums[b])
        same = a == b
        pairs = [
            (np.stack([a, am, b, bm]), wrong, np.ones(len(a), bool)),
            (np.stack([am, ae, bm, be]), wrong, np.ones(len(a), bool)),
            (np.stack([a, am, bm, be]), wrong + 1, np.ones(len(a), bool)),
            (np.stack([am, ae, b, bm]), wrong + 1, ~same),
        ]
        held = [(n[:, k], w[k]) for n, w, keep in pairs for k in [keep & (w <= budget) & (n[0] < n[1]) & (n[2] < n[3]) & ~((n[0] == n[2]) & (n[1] - n[0] == 1))]]
        stack.append((np.concatenate([n for n, _ in held], axis=1), np.concatenate([w for _, w in held]), level + 1))


def stars(size: int, links) -> np.ndarray:
    """For each of ``size`` positions the smallest one that the links reach."""
    label = np.arange(size)
    for i, j in links:
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            if np.array_equal(before, label):
                break
    return label


def _groups(batches):
    """Columns of whole groups at a time: rows of a group that a batch cuts wait for the next batch."""
    rest = None
    for batch in batches:
        now = [np.asarray(c) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate([r, n]) for r, n in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        same = np.ones(len(now[0]), bool)
        for c in now[:4]:
            same &= c == c[-1]
        cut = len(same) - same[::-1].argmin() if not same.all() else 0
        rest = [c[cut:] for c in now]
        if cut:
            yield [c[:cut] for c in now]
    if rest is not None and len(rest[0]):
        yield rest


def _join_groups(batches, rotations=ROTATIONS, budget=BUDGET):
    """Rows (r, block, low, high, side, path), sorted, to star-shaped links (a, b) of fingerprints."""
    for r, block, low, high, side, path in _groups(batches):
        paths = path.view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (block[1:] != block[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        ends = np.append(new[1:], len(r))
        rights = np.concatenate([[0], np.cumsum(side)])
        middles = ends - (rights[ends] - rights[new])
        two = (ends - new > 1) & ((low[new] == high[new]) | ((middles > new) & (middles < ends)))
        if not two.any():
            continue
        start, middle, end = new[two], np.where(low[new] == high[new], ends, middles)[two], ends[two]
        label = stars(len(paths), trie_join(paths, start, middle, end, min(levels for _, levels in rotations), budget))
        linked = np.flatnonzero(label != np.arange(len(label)))
        if len(linked):
            back = np.array([turn for turn, _ in rotations], np.uint64)[r[linked]]
            turned = [(p >> back) | (p << ((np.uint64(64) - back) % np.uint64(64))) for p in (paths[linked], paths[label[linked]])]
            turned = [np.where(back == 0, p, t).view(np.int64) for p, t in zip((paths[linked], paths[label[linked]]), turned, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(t) for t in turned], names=["a", "b"])


def links(nodes: DataFrame, limit: int = NODE_LIMIT, rotations: tuple = ROTATIONS, budget: int = BUDGET) -> DataFrame:
    """Star-shaped links (a, b) that connect all of the distinct fingerprints ``nodes.fp`` within the budget.

    The rotations' leading blocks must cover all 64 levels, in one more block than the budget has bits.
    """
    spark = nodes.sparkSession
    turned = [
        F.struct(
            F.lit(i).alias("r"),
            F.shiftrightunsigned(p := (F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn)) if turn else F.col("fp")), 64 - levels).alias("block"),
            p.alias("path"),
            F.lit(levels).alias("levels"),
        )
        for i, (turn, levels) in enumerate(rotations)
    ]
    rows = nodes.select(F.explode(F.array(*turned)).alias("x")).select("x.*")
    crowd = rows.groupBy("r", "block").count().where("count > 1")
    s = f"CASE WHEN count <= {limit} THEN 0 ELSE CAST(least({MOST_LEVELS}, ceil(log2(count / {limit})) + 1) AS INT) END"
    rows = rows.join(crowd, ["r", "block"]).withColumn("s", F.expr(s))
    masks = [F.array(*[F.lit(m).cast('long') for m in near_masks(k, budget)]) for k in range(MOST_LEVELS + 1)]
    rows = rows.withColumn("node", F.when(F.col("s") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(shiftleft(path, levels), 64 - s)")))
    rows = rows.withColumn("mask", F.explode(F.element_at(F.array(*masks), F.col("s") + 1)))
    other = F.col("node").bitwiseXOR(F.col("mask"))
    rows = rows.select("r", "block", F.least("node", other).alias("low"), F.greatest("node", other).alias("high"), (F.col("node") > other).cast("int").alias("side"), "path")
    keys = ["r", "block", "low", "high"]
    # unsigned order of the path: flip the sign bit for the sort
    dealt = rows.repartition(parallelism(spark), *keys).sortWithinPartitions(*keys, "side", F.col("path").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.mapInArrow(lambda batches: _join_groups(batches, rotations, budget), "a long, b long")


def near_masks(levels: int, budget: int = BUDGET) -> list[int]:
    """All differences of ``levels`` bits within the budget."""
    return [sum(1 << b for b in bits) for n in range(min(budget, levels) + 1) for bits in itertools.combinations(range(levels), n)]


def components(prints: DataFrame, doc_id: str = "doc_id", limit: int = NODE_LIMIT) -> DataFrame:
    """(fp, component, component_id) of each distinct ``prints.fp``.

    component is a fingerprint that names the linked group, component_id the smallest doc_id in it (null ids
    never count; null if there are no others).
    """
    # by parts of the ids first, so that what many tasks have of one crowded fingerprint does not meet at once
    each = prints.groupBy("fp", F.pmod(F.xxhash64(doc_id), F.lit(16))).agg(F.min(doc_id).alias("own")).groupBy("fp").agg(F.min("own").alias("own"))
    each = checkpointed(each)
    joined = checkpointed(connected_components(links(each.select("fp"), limit)).withColumnsRenamed({"node": "fp"}))
    linked = each.join(joined, "fp")
    least = linked.groupBy("component").agg(F.min("own").alias("component_id"))
    linked = linked.select("fp", "component").join(least, "component").select("fp", "component", "component_id")
    return each.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other; equal rows get equal answers; a null
    doc_id never names a component (all of a component's ids null: null). Only these three columns return.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = written(fingerprinted(slim).select("doc_id", "fp"), "simhash")
    # read anew, the components do not tie the documents to their partitioning: a fingerprint of many copies can be split
    known = checkpointed(components(prints).drop("component"))
    return leaving(prints.join(known, "fp", "left").select("doc_id", "fp", "component_id"), prints)


# ---- near copies by five-word similarity


def shingle_set(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The different shingles of a text, as sorted XXH64 hashes; a text of fewer words is one shingle, one without words has none."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(itertools.islice(found, k, None) for k in range(width)), strict=False) if len(found) >= width else [found]
    return np.unique(np.fromiter((digest(join(s), 42) for s in shingles), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


_TURNS = np.random.default_rng(6).integers(1, 1 << 63, (SAMPLES + SINGLES, 2), dtype=np.uint64) | np.uint64(1)


def sample_prints(shingles: np.ndarray) -> np.ndarray:
    """SimHashes of small samples of the shingles: for each of SAMPLES orders, of the SAMPLE shingles that come first in it.

    Texts of at most SHORT shingles also give the fingerprints of single shingles, the first in each of SINGLES more orders.
    """
    if not len(shingles):
        return np.zeros(1, np.int64)
    out = []
    for i, (turn, salt) in enumerate(_TURNS):
        if i >= SAMPLES and len(shingles) > SHORT:
            break
        size = SAMPLE if i < SAMPLES else 1
        order = shingles * turn
        order ^= order >> np.uint64(31)
        order *= salt
        top = shingles[np.argpartition(order, size - 1)[:size]] if len(shingles) > size else shingles
        mixed = (top ^ salt) * turn
        mixed ^= mixed >> np.uint64(29)
        mixed *= salt
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * bits > len(mixed), bitorder="little").view("<u8")[0])
    return np.unique(np.array(out, np.uint64)).view(np.int64)


def mark(shingles: np.ndarray) -> bytes:
    """For each remainder of the hashes whether an odd number of shingles has it, two bits and more for a shingle up to MARK_BITS.

    A shingle that only one of two texts has changes one bit, so their marks differ in no more bits than there are such shingles. The
    halves of a mark, one XOR the other, are the mark of half the bits.
    """
    bits = min(MARK_BITS, max(64, 1 << (2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _marks(raws, words: int) -> np.ndarray:
    """Marks of one length as rows of ``words`` 64-bit words, which may be fewer than they have."""
    out = np.frombuffer(b"".join(raws), "<u8").reshape(len(raws), -1)
    while out.shape[1] > words:
        out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
    return out


def most_apart(both, least: float):
    """Shingles that one of two texts with ``both`` shingles in sum may have alone, if their similarity is ``least`` or more."""
    return (1 - least) / (1 + least) * both + 1e-6


def _marked(batches, least: float):
    """(a, b, marks of a and b, shingles of both) to those pairs (a, b) that their marks allow."""
    for x in batches:
        left, right = (np.array(x.column(k).to_pylist() + [None], object)[:-1] for k in (2, 3))
        lengths = np.array([[len(m) for m in left], [len(m) for m in right]])
        gap = np.zeros(len(left), np.int64)
        for one, other in np.unique(lengths, axis=1).T:
            at = np.flatnonzero((lengths[0] == one) & (lengths[1] == other))
            gap[at] = np.bitwise_count(_marks(left[at], min(one, other) // 8) ^ _marks(right[at], min(one, other) // 8)).sum(axis=1)
        stay = pa.array(np.flatnonzero(gap <= most_apart(np.asarray(x.column(4)), least)))
        yield pa.RecordBatch.from_arrays([x.column(0).take(stay), x.column(1).take(stay)], names=["a", "b"])


def _close(side, size, component, marks, halves: bool, least: float):
    """Positions (i, j) of the rows of a group (``halves``: on different sides) that are of different classes and may be similar."""
    component = np.unique(component, return_inverse=True)[1]
    lengths = np.array([len(m) for m in marks])
    at = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    for n, m in itertools.combinations_with_replacement(at, 2):
        ours, theirs = _marks(marks[at[n]], n // 8), _marks(marks[at[m]], n // 8)
        rows = max(1, MARK_WORDS // (len(at[m]) * (n // 8)))
        for start in range(0, len(at[n]), rows):
            i, j = at[n][start : start + rows, None], at[m][None, :]
            ok = (component[i] != component[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-6)
            ok &= (i < j) if n == m else True
            ok &= (side[i] != side[j]) if halves else True
            i, j = np.nonzero(ok)
            i += start
            gap = np.bitwise_count(ours[i] ^ theirs[j]).sum(axis=1)
            i, j = at[n][i], at[m][j]
            near = gap <= most_apart(size[i] + size[j], least)
            yield i[near], j[near]


def _crowded(batches, least: float):
    """Rows (h, low, high, w, side, key, size, component, mark), sorted, to the pairs (a, b, most, both, w) that may be similar."""
    for h, low, high, w, side, key, size, component, marks in _groups(batches):
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        for a, b in zip(new, [*new[1:], len(h)], strict=True):
            n = size[a:b]
            for i, j in _close(side[a:b], n, component[a:b], marks[a:b], low[a] != high[a], least):
                if len(i):
                    columns = [key[a:b][i], key[a:b][j], np.maximum(n[i], n[j]), n[i] + n[j], np.full(len(i), w[a])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.binary()] * 2 + [pa.int64()] * 3, strict=True)], names=["a", "b", "most", "both", "w"])


def _verified(batches, width: int, least: float):
    """(a, text of a, b, text of b) to the pairs (a, b) that are similar enough."""
    known: dict[bytes, np.ndarray] = {}
    for b in batches:
        keep = []
        for k, (raw, other, text) in enumerate(zip(utf8(b.column(1)), b.column(2).to_pylist(), utf8(b.column(3)), strict=True)):
            if other not in known:
                if len(known) > 100:
                    known.clear()
                known[other] = shingle_set(text, width)
            if similarity(shingle_set(raw, width), known[other]) >= least:
                keep.append(k)
        if keep:
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(2).take(pa.array(keep))], names=["a", "b"])


def _confirmed(base: DataFrame, marks: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of keys whose texts are similar enough; ``marks`` (key, size, mark) are asked first."""
    one, other = (marks.select(F.col("key").alias(c), F.col("size").alias(f"size_{c}"), F.col("mark").alias(f"mark_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "mark_a", "mark_b", F.expr("size_a + size_b").alias("both"))
    pairs = written(both.mapInArrow(lambda batches: _marked(batches, least), "a binary, b binary"), "simhash-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    if pairs.count() <= ASKED_PAIRS:
        asked = F.broadcast(asked)
    texts = written(base.join(asked, "key", "left_semi").groupBy("key").agg(F.first("text", True).alias("text")), "simhash-texts")
    both = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"key": "b", "text": "tb"}), "b")
    found = checkpointed(both.select("a", "ta", "b", "tb").mapInArrow(lambda batches: _verified(batches, width, least), "a binary, b binary"))
    removed(pairs, texts)
    return found


def frequent_shingles(base: DataFrame, width: int, texts: int) -> np.ndarray:
    """Hashes of the shingles that several of some ORDER_TEXTS of the ``texts`` texts have, the most frequent ones last."""

    def hashed(batches):
        for b in batches:
            found = [shingle_set(raw, width) for raw in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["h"])

    share = min(1.0, ORDER_TEXTS / max(1, texts))
    some = base.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counts = some.mapInArrow(hashed, "h long").groupBy("h").count().where(F.col("count") >= ORDER_COUNT)
    found = counts.orderBy(F.desc("count"), "h").limit(ORDER_MOST).collect()
    return np.array([r.h for r in reversed(found)], np.int64).view(np.uint64)


def leading(shingles: np.ndarray, least: float, frequent: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The shingles that come first in the common order, so many that two sets of similarity ``least`` share one at least.

    The order is that of the hashes, after which the ``frequent`` shingles (sorted) come by their ``places``.
    """
    size = len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        place = np.where(frequent[at] == shingles, places[at], -1)
        if (place >= 0).any():
            shingles = shingles[np.argsort(place, kind="stable")]
    return shingles[:size]


def _leading_rows(batches, width: int, least: float, frequent: np.ndarray, buckets: int):
    """(key, text) to (bucket, rows), the leading shingles of many texts packed as bytes of hash and key."""
    places = np.argsort(frequent)
    frequent = frequent[places]
    for b in batches:
        found = [leading(shingle_set(raw, width), least, frequent, places) for raw in utf8(b.column(1))]
        if not sum(map(len, found)):
            continue
        hashes = np.concatenate(found)
        keys = np.frombuffer(b"".join(k[:KEY_BYTES].ljust(KEY_BYTES, b"\0") for k in b.column(0).to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
        bucket = ((hashes >> np.uint64(8 * HASH_BYTES)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = np.concatenate([hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES], np.repeat(keys, [len(f) for f in found], axis=0)], axis=1)[order]
        there, starts = np.unique(bucket[order], return_index=True)
        packed = [part.tobytes() for part in np.split(rows, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(packed, pa.binary())], names=["bucket", "rows"])


def _shared(batches):
    """(bucket, rows), sorted, to (h, short), the leading shingles that several texts have."""

    def several(bucket, parts):
        rows = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, HASH_BYTES + KEY_BYTES)
        wide = np.zeros((2, len(rows), 8), np.uint8)
        wide[0, :, :HASH_BYTES], wide[1, :, :KEY_BYTES] = rows[:, :HASH_BYTES], rows[:, HASH_BYTES:]
        h, key = wide.view("<i8")[..., 0]
        order = np.lexsort((key, h))
        h, key = h[order], key[order]
        # copies of a text that several tasks have read
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
        h, key = h[new], key[new]
        like = h[1:] == h[:-1]
        stay = np.concatenate([[False], like]) | np.concatenate([like, [False]])
        h, key = h[stay] | (bucket << 8 * HASH_BYTES), key[stay]
        for at in range(0, len(h), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 18)]), pa.array(key[at : at + (1 << 18)])], names=["h", "short"])

    now, parts = None, []
    for b in batches:
        for bucket, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != now and parts:
                yield from several(now, parts)
                parts = []
            now = bucket
            parts.append(rows)
    if parts:
        yield from several(now, parts)


def sharing(named: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, most, both, w) of the keys of different classes that share a shingle in ``named`` (h, key, size, component).

    most and both are the greater and the sum of the two sizes, the sum of a pair's w is the number of shingles that it shares. Shingles
    that the same texts share (long copies have thousands) are taken once, with their number as w. Up to CROWD texts are joined with each
    other; of more, pairs that their marks tell apart are left out, and what is crowded beyond CROWD_ROWS is compared part by part.
    """
    spark = named.sparkSession
    texts = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"s{i}") for i in range(2)]
    sets = named.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), *texts).where("x < y")
    sets = sets.groupBy("n", "s0", "s1").agg(F.min("h").alias("h"), F.count("*").alias("w")).select("h", "n", "w")
    rows = written(named.join(sets, "h"), "simhash-sharing")
    left, right = (rows.where(f"n <= {CROWD}").select("h", "w", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "size", "component")]) for s in "ab")
    few = left.join(right.drop("w"), "h").where(f"component_a < component_b AND least(size_a, size_b) >= {least!r} * greatest(size_a, size_b) - 1e-6")
    few = few.selectExpr("least(key_a, key_b) AS a", "greatest(key_a, key_b) AS b", "greatest(size_a, size_b) AS most", "size_a + size_b AS both", "w")
    many = rows.where(f"n > {CROWD}").withColumn("parts", F.expr(f"cast(ceil(n / {CROWD_ROWS}) AS long)")).withColumn("node", F.expr("pmod(xxhash64(key), parts)"))
    many = many.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).join(marks.select("key", "mark"), "key")
    many = many.selectExpr("h", "least(node, other) AS low", "greatest(node, other) AS high", "w", "cast(node > other AS int) AS side", "key", "size", "component", "mark")
    many = many.repartition(parallelism(spark), "h", "low", "high").sortWithinPartitions("h", "low", "high")
    many = many.mapInArrow(lambda batches: _crowded(batches, least), "a binary, b binary, most long, both long, w long")
    return leaving(few.unionByName(many.selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "most", "both", "w")), rows)


def apart(base: DataFrame, marks: DataFrame, classes: DataFrame, width: int, least: float) -> DataFrame:
    """All pairs (a, b) of keys of similar texts in ``base`` (key, text) that ``classes`` (node, component) leaves in two classes.

    Two sets of n and m shingles with similarity s have s * max(n, m) in common at least, so one at least of the n - ceil(s * n) + 1 and
    m - ceil(s * m) + 1 that come first in any order. If they have k of these in common, they have at most k + max(ceil(s * n), ceil(s * m)) - 1
    in all, and need s / (1 + s) * (n + m); in (1 - s) / (1 + s) * (n + m) they may differ, and ``marks`` (key, size, mark) differ in no more
    bits. Pairs within these bounds are compared; there is no other limit.
    """
    spark = base.sparkSession
    total = marks.agg(F.count("*").alias("texts"), F.coalesce(F.sum("size"), F.lit(0)).alias("shingles")).first()
    frequent = frequent_shingles(base, width, total.texts)
    parts = parallelism(spark)
    buckets = min(1 << 22, max(4 * parts, int((total.shingles * (1 - least) + total.texts) / LEADING_ROWS)))
    rows = base.select("key", "text").mapInArrow(lambda batches: _leading_rows(batches, width, least, frequent, buckets), "bucket long, rows binary")
    rows = rows.repartition(max(parts, buckets // 4), "bucket").sortWithinPartitions("bucket")
    shared = written(rows.mapInArrow(_shared, "h long, short long"), "simhash-shared")
    # the first bytes of a key, as the packed rows have them; where two keys begin alike, both are meant
    short = F.conv(F.concat(*[F.hex(F.substring("key", i, 1)) for i in range(KEY_BYTES, 0, -1)]), 16, 10).cast("long")
    known = marks.select("key", "size").join(classes.withColumnRenamed("node", "key"), "key", "left")
    known = known.select(short.alias("short"), "key", "size", F.coalesce("component", "key").alias("component"))
    named = written(shared.join(known, "short").select("h", "key", "size", "component"), "simhash-named")
    pairs = sharing(named, marks, least)
    alike = pairs.groupBy("a", "b").agg(F.sum("w").alias("k"), F.first("most").alias("most"), F.first("both").alias("both"))
    alike = alike.where(f"k + ceil({least!r} * most - 1e-9) - 1 >= {least / (1 + least)!r} * both - 1e-6")
    found = _confirmed(base, marks, alike.select("a", "b"), width, least)
    removed(shared, named, *left_tables(pairs))
    return found


def similar_texts(base: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """(node, component) of the different texts in ``base`` (key, text, samples, size, mark; a table, in which copies may be left out) that are near copies of others.

    Two texts are linked if the exact Jaccard similarity of their shingles is ``least`` or more; a class is what links connect. First
    candidates are found by the trie join: texts that share the SimHash of a sample, up to SAMPLE_BUDGET bits, form a bucket, in which each
    is compared with the bucket's least and largest key, so a bucket of n texts gives 2 n pairs at most. This joins most of what belongs
    together, and all links between the classes that it leaves are then found by ``apart``, exactly. Buckets and links are tables; of the
    rows nothing but the hashes of frequent shingles in a sample reaches the driver.
    """
    marks = written(base.groupBy("key").agg(F.first("size").alias("size"), F.first("mark").alias("mark")), "simhash-marks")
    prints = written(base.select("key", F.explode("samples").alias("fp")).distinct(), "simhash-samples")
    near = checkpointed(connected_components(links(prints.select("fp").distinct(), NODE_LIMIT, SAMPLE_ROTATIONS, SAMPLE_BUDGET)).withColumnRenamed("node", "fp"))
    buckets = prints.join(near, "fp", "left").select("key", F.coalesce("component", "fp").alias("bucket"))
    ends = buckets.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    pairs = buckets.join(ends, "bucket").select(F.col("key").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
    found = _confirmed(base, marks, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), width, least)
    removed(prints)
    classes = checkpointed(connected_components(found))
    more = apart(base.select("key", "text"), marks, classes, width, least)
    removed(marks)
    return checkpointed(connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each group of near copies: that of the smallest doc_id.

    Texts are linked if their sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more (all such
    pairs, see similar_texts); groups are what links connect. Texts without words, null ones included, are copies of each other.
    Rows that repeat a doc_id within a group count as one, and a group without any doc_id keeps one row too. Columns are those of ``docs``.
    """
    names = docs.columns
    added = T.StructType([T.StructField("__lf_key", T.BinaryType()), T.StructField("__lf_samples", T.ArrayType(T.LongType())), T.StructField("__lf_size", T.LongType()), T.StructField("__lf_mark", T.BinaryType())])

    def fresh():
        seen: set[bytes] = set()

        def make(column):
            # copies have one key, and so have all texts without words; a task samples the first of them only
            raws = utf8(column)
            keys = [xxhash.xxh3_128_digest(r) if r and not r.isspace() else b"" for r in raws]
            samples, sizes, marks = [], [], []
            for raw, key in zip(raws, keys, strict=True):
                shingles = None if key in seen else shingle_set(raw, width)
                samples.append(None if shingles is None else sample_prints(shingles))
                sizes.append(None if shingles is None else len(shingles))
                marks.append(None if shingles is None else mark(shingles))
                seen.add(key)
            return [pa.array(keys, pa.binary()), pa.array(samples, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())]

        return make

    base = written(add_columns(docs, [text], added, fresh), "simhash-docs")
    ids = base.select("__lf_key", F.col(doc_id).cast("long").alias("id"))
    once = base.where("__lf_samples IS NOT NULL")
    once = once.select(F.col("__lf_key").alias("key"), F.col(text).cast("string").alias("text"), *[F.col(f"__lf_{c}").alias(c) for c in ("samples", "size", "mark")])
    classes = similar_texts(once, width, least)
    # of each text the row with the smallest id, and how often that id repeats it
    rows = ids.groupBy("__lf_key", "id").agg(F.count("*").alias("n"))
    first = rows.groupBy("__lf_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("x"))
    first = first.join(classes, F.col("__lf_key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "__lf_key"))
    stay = first.groupBy("component").agg(F.min(F.struct("x.none", "x.id", "__lf_key", "x.n")).alias("x"))
    stay = checkpointed(stay.select(F.col("x.__lf_key").alias("__lf_print"), F.col("x.id").alias("__lf_id"), F.col("x.n").alias("__lf_n")))
    kept = base.join(stay, (F.col("__lf_key") == F.col("__lf_print")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__lf_id")))
    if stay.where("__lf_n > 1").limit(1).count():
        kept = kept.where("__lf_n = 1").unionByName(kept.where("__lf_n > 1").dropDuplicates(["__lf_print", "__lf_id"]))
    return leaving(kept.select(*[F.col(f"`{c}`") for c in names]), base)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
