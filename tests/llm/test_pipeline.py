"""The pipeline's rows against a brute-force version of all five stages."""

import hashlib
import struct

import xxhash

import corpus_pipeline
from lawfinder.llm import mixing, quality, sharding
from lawfinder.llm.common import table
from tests.llm.test_blocks import brute_classes, brute_divide, brute_hits


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spark_hash(seed, value):
    """Spark's xxhash64(seed, value): each value hashed with the hash so far."""
    start = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    return xxhash.xxh64_intdigest(value.encode() if isinstance(value, str) else struct.pack("<q", value), start)


def brute_mix(docs):
    size = {d: -(-len(x[0].encode()) // 4) for d, x in docs.items()}
    leaves = {}
    for d, (_, lang, source) in docs.items():
        leaves.setdefault((lang, source), []).append(d)
    cap = {k: sum(size[d] for d in v) for k, v in leaves.items()}
    budget = int(sum(cap.values()) * corpus_pipeline.MIX_SHARE)
    langs = {k[0] for k in leaves}
    by_lang = brute_divide(budget, {x: (1, sum(c for k, c in cap.items() if k[0] == x)) for x in langs})
    kept = []
    for x in langs:
        given = brute_divide(by_lang[x], {k[1]: (1, c) for k, c in cap.items() if k[0] == x})
        for source, g in given.items():
            whole, part = divmod(g, cap[x, source])
            at = 0
            for d in sorted(leaves[x, source], key=lambda d: (hashlib.md5(f"{mixing.SEED}:{whole}:{d}".encode()).hexdigest(), d)):
                kept += [d] * (whole + (at < part))
                at += size[d]
    return kept


def brute_shards(docs, shards=sharding.SHARDS):
    by = {}
    for d, (_, _, source) in docs.items():
        by.setdefault(source, []).append(d)
    order = []
    for source, ids in by.items():
        for k, d in enumerate(sorted(ids, key=lambda d: (spark_hash(sharding.SEED, d), d))):
            order.append(((2 * k + 1) / (2 * len(ids)), signed(spark_hash(sharding.SEED, source)), source, k, d))
    out, used = {}, dict.fromkeys(range(shards), 0)
    for p, (*_, d) in enumerate(sorted(order)):
        s = p * shards // len(order)
        out[d] = (s, used[s])
        used[s] += 1
    return out


def test_pipeline_is_brute_force(spark, sf_dir):
    docs = {r.doc_id: (r.text, r.lang, r.source) for r in table(spark, sf_dir, "documents").collect()}
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    good = {d: x for d, x in docs.items() if model.score([x[0].encode()])[0] >= quality.THRESHOLD}
    part, first = brute_classes({x[0] for x in good.values()}), {}
    for d in sorted(good):
        first.setdefault(part[good[d][0]], d)
    one = {d: good[d] for d in first.values()}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = {d: x for d, x in one.items() if not brute_hits(x[0], items)[1]}
    mixed = {d: clean[d] for d in brute_mix(clean)}
    want = {d: (*x, *s) for (d, x), s in zip(mixed.items(), map(brute_shards(mixed).get, mixed), strict=True)}
    got = {r.doc_id: (r.text, r.lang, r.source, r.shard, r.slot) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert len(docs) > len(good) > len(one) > len(clean) > len(mixed) == len(got)
    assert got == want
