"""Operators 5, 6, 8 and 9 against brute force on small tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lawfinder.llm import decontamination, mixing, sharding, simhash
from lawfinder.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta Eps Zeta été ß 12 the of and a".split()) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, copies, near copies, repeated rows, and clashing names."""
    base = prose(1, 120)
    rows = [(i, base if i % 3 == 0 else prose(i, 5 + i), "en" if i % 4 else None, f"s{i % 3}" if i % 5 else None, 1) for i in range(60)]
    rows += [(None, base, "en", "s1", 1), (100, None, None, None, None), (101, "", "en", "s1", 0), (7, prose(7, 12), "en", "s1", 1), (7, prose(7, 12), "en", "s1", 1)]
    rows += [(200 + i, base + " " + w, "fr", "s2", 1) for i, w in enumerate("x y z".split())] + [(300, prose(9, 200_000), "en", "s9", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("old") for c in ("fp", "n_words", "shard", "epoch", "component", "_fp", "_id", "_n", "_source", "_hash", "_domain", "_tokens", "_score", "_spans")}), rows


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items):
    w = brute_words(text)
    hit, found = set(), set()
    for item, t in items:
        b = brute_words(t)
        n = min(10, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination_is_brute_force(spark, odd, block):
    df, rows = odd
    items = [(1, prose(1, 30)), (2, "ZETA, beta!"), (3, None), (4, ""), (5, prose(13, 14)), (6, prose(1, 30)), (7, "absent words"), (8, "été")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    short = df.where("doc_id IS NULL OR doc_id <> 300")
    got = decontamination.find_contamination(short, bench, block_bytes=block, held_bytes=2000)
    assert got.where("doc_id = 0").first()["n_words"] == 120
    key = lambda x: str(x)
    want = sorted(((r[0], *brute_hits(r[1], items)) for r in rows if r[0] != 300), key=key)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in got.collect()), key=key) == want
    clean = decontamination.decontaminate(short, bench)
    assert clean.columns == df.columns and clean.count() == sum(w[2] == 0 for w in want)


def test_contamination_of_nothing(spark, odd):
    df, _ = odd
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(df, none).where("n_hit > 0").count() == 0
    assert decontamination.find_contamination(df.limit(0), none).count() == 0


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    part = {p: p for p in prints}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(sorted(part), 2):
        if (a ^ b).bit_count() <= 2:
            part[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in part}


def test_simhash_is_brute_force(spark, odd):
    df, rows = odd
    prints = [brute_print(r[1]) for r in rows]
    part = brute_components(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[part[p]] = min(r[0], least.get(part[p], r[0]))
    want = sorted(((str(r[0]), p, least[part[p]]) for r, p in zip(rows, prints, strict=True)))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == want


def brute_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_classes(texts):
    """The least text of each group of near copies."""
    sets, part = {t: brute_shingles(t) for t in texts}, {t: t for t in texts}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(sorted(part), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            part[max(top(a), top(b))] = min(top(a), top(b))
    return {t: top(t) for t in texts}


def test_near_copies_are_brute_force(spark, odd):
    df, rows = odd
    part, least = brute_classes({r[1] or "" for r in rows}), {}
    for r in rows:
        if r[0] is not None:
            c = part[r[1] or ""]
            least[c] = min(r[0], least.get(c, r[0]))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_near_copies_recall(spark):
    """Edits of one word in every 60 to 30 (similarities of about 0.8 to 0.9), short and long; what is less similar stays."""
    r = random.Random(11)
    word = lambda: f"w{r.randint(0, 50_000)}"
    rows, n = [], 0
    for size in (8, 20, 60, 300, 2000):
        for _ in range(40):
            base = [word() for _ in range(size)]
            copy = list(base)
            for k in range(0, size, max(45, size // 30)):
                copy[min(size - 1, k + r.randint(0, 40))] = word()
            far = [w if r.random() < 0.9 else word() for w in base]
            rows += [(n, " ".join(base)), (n + 1, " ".join(copy)), (n + 2, " ".join(far))]
            n += 3
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    near = [i for i in range(0, n, 3) if jaccard(brute_shingles(text[i]), brute_shingles(text[i + 1])) >= 0.8]
    assert len(near) > 80 and sum(i + 1 not in kept for i in near) >= 0.95 * len(near)
    for i in range(0, n, 3):
        like = [j for j in (i, i + 1) if jaccard(brute_shingles(text[i + 2]), brute_shingles(text[j])) >= 0.8]
        assert i in kept and (like or i + 2 in kept) and (i in near or i + 1 in kept)


def test_near_copies_within_a_bucket(spark):
    """Pairs of similarity 0.8 that share most of it with all others: neither end of the buckets in which they meet is like them."""
    r = random.Random(5)
    word = lambda n: " ".join(f"w{r.getrandbits(48)}" for _ in range(n))
    long, texts = word(160), []
    for _ in range(40):
        own = word(10)
        texts += [f"{long} {own} {word(20)}" for _ in range(2)]
    like = [(i, j) for i, j in itertools.combinations(range(80), 2) if jaccard(brute_shingles(texts[i]), brute_shingles(texts[j])) >= 0.8]
    assert like == [(i, i + 1) for i in range(0, 80, 2)]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == list(range(0, 80, 2))


def test_leading_shingles_meet():
    """In any order of frequent shingles, sets at the bound share a leading one, and more of them the more alike their sizes are."""
    r = np.random.default_rng(4)
    for size in [*range(1, 30), 200, 1001]:
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = r.integers(0, len(a) // 5 + 1)
            b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 1 << 63, r.integers(0, len(a) // 9 + 1), dtype=np.uint64)]))
            frequent = np.sort(r.permutation(a)[: r.integers(0, len(a) + 1)])
            places = r.permutation(len(frequent))
            k = len(np.intersect1d(*[simhash.leading(x, 0.8, frequent, places) for x in (a, b)]))
            if simhash.similarity(a, b) >= 0.8:
                assert k >= 1 and k + np.ceil(0.8 * max(len(a), len(b)) - 1e-9) - 1 >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-6


def joined_rows(spark, since):
    """Most rows that a join has made in the queries from number ``since`` on, and the number of the next one."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, last = 0, store.executionsCount()
    runs = store.executionsList()
    for i in range(runs.size()):
        if (at := runs.apply(i).executionId()) >= since:
            values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
            for node in map(nodes.apply, range(nodes.size())):
                for m in map(node.metrics().apply, range(node.metrics().size())) if "Join" in node.name() else ():
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
            last = max(last, at + 1)
    return most, last


def test_near_copies_in_a_crowd(spark, monkeypatch):
    """Rewritings of one text, most of which are less similar than 0.8: what is joined does not grow with the square of their number."""
    r = random.Random(8)
    word = lambda: f"w{r.getrandbits(40)}"
    base, texts = [word() for _ in range(150)], []
    for _ in range(200):
        edited = list(base)
        for at in r.sample(range(150), 5):
            edited[at] = word()
        texts.append(" ".join(edited))
        if r.random() < 0.1:
            texts.append(" ".join([*edited, word()]))
    part = brute_classes(texts)
    want = sorted({min(i for i, t in enumerate(texts) if part[t] == c) for c in set(part.values())})
    assert 50 < len(want) < len(texts) - 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    since = joined_rows(spark, 1 << 60)[1]
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == want
    assert joined_rows(spark, since)[0] < 40 * len(texts)
    monkeypatch.setattr(simhash, "CROWD_ROWS", 30)  # crowds in parts
    monkeypatch.setattr(simhash, "ASKED_PAIRS", 0)  # texts found by a shuffle
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == want


def test_marks_never_part_similar_texts():
    r = np.random.default_rng(9)
    for size in [*range(1, 40), 63, 64, 65, 250, 260, 3000]:
        for _ in range(10):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([r.permutation(a)[r.integers(0, len(a) // 5 + 1) :], r.integers(0, 1 << 63, r.integers(0, len(a) // 9 + 1), dtype=np.uint64)]))
            x, y = simhash.mark(a), simhash.mark(b)
            words = min(len(x), len(y)) // 8
            gap = int(np.bitwise_count(simhash._marks([x], words) ^ simhash._marks([y], words)).sum())
            assert gap <= len(np.setxor1d(a, b))
            assert simhash.similarity(a, b) < 0.8 or gap <= simhash.most_apart(len(a) + len(b), 0.8)


def test_keep_one_of_no_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (4, None), (5, ""), (6, " \n"), (7, "x y"), (7, "x y"), (7, "z")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("4", None), ("7", "x y"), ("7", "z"), ("None", "a b c")]


@pytest.mark.parametrize("limit", [1024, 8])
def test_trie_links_are_brute_force(spark, limit):
    r = random.Random(3)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        c = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 5, 40])):
            p = c
            for _ in range(r.randint(0, 4)):
                p ^= 1 << r.randint(0, 63)
            prints.add(p)
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    got = {x.node % 2**64: x.component % 2**64 for x in connected_components(simhash.links(nodes, limit)).collect()}
    want = brute_components(prints)
    groups = lambda m: {frozenset(k for k in prints if m.get(k, k) == v) for v in {m.get(k, k) for k in prints}}
    assert groups(got) == groups(want)


def test_simhash_of_nothing(spark, odd):
    df, _ = odd
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (5, 5), (None, 3)] + [(400, k) for k in range(401, 430)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 200: 100} | {k: 400 for k in range(400, 430)}


def test_shards_are_even_and_mixed(spark, odd):
    df, rows = odd
    got = sharding.interleaved(df, shards=7, ties=("text",)).collect()
    assert len(got) == len(rows)
    sizes = np.bincount([r.shard for r in got], minlength=7)
    assert sizes.max() - sizes.min() <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source in ("s1", "s2", None):
        n = sum(r.source == source for r in got)
        for s in range(7):
            assert abs(sum(r.source == source for r in got if r.shard == s) - n / 7) <= 2
    # a plain sort by fractional rank gives the same order
    k = lambda r: (r.shard, r.slot)
    by = {}
    for r in sorted(got, key=k):
        by.setdefault(r.source, []).append(r)
    n = {s: len(x) for s, x in by.items()}
    rank = {(s, i): (2 * i + 1) / (2 * n[s]) for s in by for i in range(n[s])}
    order = []
    seen = dict.fromkeys(by, 0)
    for r in sorted(got, key=k):
        order.append(rank[r.source, seen[r.source]])
        seen[r.source] += 1
    assert order == sorted(order)
    assert sharding.interleaved(df.limit(0)).count() == 0
    assert sharding.interleaved(df, shards=500).count() == len(rows)


def test_shards_do_not_depend_on_the_buckets(spark):
    """Sources with more rows than buckets, with fewer, and with a single row."""
    rows = [(i, "a" if i < 200 else f"s{i % 40}" if i < 300 else f"only{i}") for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    found = [sorted((r.doc_id, r.shard, r.slot) for r in sharding.interleaved(df, shards=7, bits=bits).collect()) for bits in (2, 5, 12)]
    assert found[0] == found[1] == found[2]
    assert [d for d, _, _ in found[0]] == [i for i, _ in rows]
    for s in range(7):
        slots = sorted(slot for _, shard, slot in found[0] if shard == s)
        assert slots == list(range(len(slots))) and 51 <= len(slots) <= 52


def brute_divide(budget, children):
    """children: name to (weight, cap); fill by raising one level until it is spent."""
    given = {}
    left = dict(children)
    while left:
        w = sum(x[0] for x in left.values())
        full = [c for c, (cw, cap) in left.items() if cap * w <= budget * cw]
        if not full:
            return given | {c: min(cap, budget * cw // w) for c, (cw, cap) in left.items()}
        c = min(full, key=lambda c: (left[c][1] / left[c][0], left[c][1], left[c][0], c))
        given[c] = left.pop(c)[1]
        budget -= given[c]
    return given


def test_weight_of_a_branch(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 1000), ("a", "fr", "x", 1000), ("b", "en", "x", 1000), ("b", "fr", "x", 1000)], "domain string, lang string, source string, total long")
    got = {(r.domain, r.lang): r.given for r in mixing.budgets(leaves, F.lit(1200), {"lang": {"en": 2, ("b", "en"): 5}}).collect()}
    assert got == {("a", "en"): 400, ("a", "fr"): 200, ("b", "en"): 500, ("b", "fr"): 100}


def test_mix(spark, odd):
    df, rows = odd
    weights = {"lang": {"en": 3}, "source": {"s0": 2, "s9": 0}}
    got = mixing.mix(df, F.lit(2500), weights, epochs=2).collect()
    deep = mixing.mix(df, F.lit(2500), weights, epochs=2, edge_rows=1).collect()  # as many digits as it takes
    assert sorted(map(str, got)) == sorted(map(str, deep))
    none = mixing.NO_VALUE
    leaves = {}
    for r in rows:
        k = ("all", r[2] or none, r[3] or none)
        leaves.setdefault(k, []).append((r[0], -(-len((r[1] or "").encode()) // 4)))
    cap = {k: 2 * sum(t for _, t in v) * (k[2] != "s9") for k, v in leaves.items()}
    total = min(2500, sum(cap.values()))
    langs = {k[1] for k in leaves}
    by_lang = brute_divide(total, {x: (3 if x == "en" else 1, sum(c for k, c in cap.items() if k[1] == x)) for x in langs})
    given = {}
    for x in langs:
        for s, g in brute_divide(by_lang[x], {k[2]: (2 if k[2] == "s0" else 1, c) for k, c in cap.items() if k[1] == x}).items():
            given["all", x, s] = g
    want = []
    for k, docs in leaves.items():
        tokens = sum(t for _, t in docs)
        if not given[k]:
            continue
        whole, part = divmod(given[k], tokens)
        h = lambda d, w=whole: hashlib.md5(f"{mixing.SEED}:{w}:{'' if d is None else d}".encode()).hexdigest()
        at = 0
        for d, t in sorted(docs, key=lambda x: (h(x[0]), x[0] is not None, x[0] or 0, x[1])):
            want += [(str(d), e) for e in range(whole + (at < part))]
            at += t
    assert sorted((str(r.doc_id), r.epoch) for r in got) == sorted(want)
    assert mixing.mix(df.limit(0), F.col("total")).count() == 0
