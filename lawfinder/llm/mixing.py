"""Mixing sources to target weights, with DataFrame operations only.

The token budget flows down a tree of domains, languages and sources. Each node divides its budget among its
children by weight, none of them above what its documents can give in the allowed epochs; what one child
cannot take goes to its siblings, again by weight, and only what none of them can take was never given to
their parent. Each leaf then takes whole seeded epochs of its documents and the token-prefix of one more.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawfinder.llm.common import checkpointed, removed, table, without, written

LEVELS = ("domain", "lang", "source")
SEED = 29
#: Digits of the seeded hash by which a leaf's rows are counted at a time, and rows of a leaf that are put in order at last.
HEX, EDGE_ROWS = 2, 50_000
BYTES_PER_TOKEN = 4
#: Leaves whose plan (some 100 bytes each) is broadcast; a larger plan is joined by shuffling.
SMALL_PLAN = 50_000
#: Stands for null in a level, a node of its own.
NO_VALUE = "\x00none"


def tokens(text: Column) -> Column:
    """Estimated tokens: UTF-8 bytes over four, rounded up (null: 0)."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(BYTES_PER_TOKEN)).cast("long")


def divide(nodes: DataFrame, parent: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add ``given``: each parent's ``budget`` divided among its children, of ``weight`` and capacity ``cap``.

    Children fill up in order of cap / weight; a child is full if its share of what is left, by weight among
    those not yet full, reaches its capacity. Token counts are whole numbers: shares are rounded down.
    """
    whole = Window.partitionBy(*(parent or [F.lit(0)]))
    order = whole.orderBy(F.col("cap").cast("double") / F.col("weight"), "cap", "weight", *names)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns(
        {
            "__lf_cap": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "__lf_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    nodes = nodes.withColumn("__lf_full", F.expr("cast(cap as decimal(38)) * __lf_weight <= cast(budget - __lf_cap as decimal(38)) * weight"))
    nodes = nodes.withColumns(
        {
            "__lf_cap": F.coalesce(F.sum(F.when(F.col("__lf_full"), F.col("cap"))).over(whole), F.lit(0)),
            "__lf_weight": F.coalesce(F.sum(F.when(~F.col("__lf_full"), F.col("weight"))).over(whole), F.lit(0)),
        }
    )
    share = F.expr("cast((cast(budget - __lf_cap as decimal(38)) * weight) div greatest(__lf_weight, 1) as bigint)")
    return nodes.withColumn("given", F.when(F.col("__lf_full"), F.col("cap")).otherwise(F.least("cap", share)))


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str | tuple[str, ...], int]] | None = None, epochs: int = 1) -> DataFrame:
    """``leaves`` (LEVELS, total: tokens) with ``given``, the tokens that each leaf is to deliver.

    weights: by level, in whole numbers, of a node's value wherever it stands, or of one branch, as the tuple of values from the
    domain down, which goes before the value's own weight (others weigh 1); a node of weight 0 takes nothing.
    budget: the tokens to divide, an expression over ``total``, the tokens of all leaves; what exceeds all
    that the leaves have in ``epochs`` is not given.
    """
    used = F.lit(1).cast("long")
    for i, level in enumerate(LEVELS):
        at = F.lit(1).cast("long")
        for value, w in sorted((weights or {}).get(level, {}).items(), key=lambda x: isinstance(x[0], tuple)):
            path = zip(LEVELS, value, strict=False) if isinstance(value, tuple) else [(level, value)]
            at = F.when(functools.reduce(operator.and_, [F.col(k) == v for k, v in path]), F.lit(w).cast("long")).otherwise(at)
        leaves = leaves.withColumn(f"__lf_w{i}", at)
        used = F.least(used, F.col(f"__lf_w{i}"))
    leaves = leaves.withColumn("cap", F.when(used > 0, F.col("total") * epochs).otherwise(0))
    known = leaves.groupBy().agg(F.sum("total").alias("total"), F.sum("cap").alias("__lf_all"))
    known = known.select(F.least(budget.cast("long"), "__lf_all").alias("budget"))
    for i in range(len(LEVELS)):
        parent, names = list(LEVELS[:i]), list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*names).agg(F.sum("cap").alias("cap"), F.greatest(F.max(f"__lf_w{i}"), F.lit(1)).alias("weight"))
        nodes = nodes.join(known, parent) if parent else nodes.crossJoin(F.broadcast(known))  # known is one row here
        known = divide(nodes, parent, names).select(*names, F.col("given").alias("budget"))
    return leaves.join(known, list(LEVELS)).select(*LEVELS, "total", F.col("budget").alias("given"))


def mix(
    docs: DataFrame, budget: Column, weights: dict[str, dict[str | tuple[str, ...], int]] | None = None, epochs: int = 1, domain: Column | None = None,
    n_tokens: Column | None = None, doc_id: str = "doc_id", seed: int = SEED, edge_rows: int = EDGE_ROWS,
) -> DataFrame:
    """The chosen rows of ``docs`` with domain, epoch, n_tokens and leaf_budget added (columns so named are replaced).

    A leaf gives all its documents in each whole epoch, and of one more epoch, in an order seeded by the
    epoch's number, the documents that begin before its budget ends, so it exceeds its budget by less than one
    document. Documents without tokens (null or empty) are chosen where they begin before that end; a leaf
    without tokens gives nothing. Null domain, lang, source and doc_id are values of their own; rows that
    repeat are each counted and chosen; ties in the seeded order go by doc_id, then by tokens.

    Only counts are shuffled, and the rows among which a leaf's budget ends. These are found by the seeded hash: sums over
    its first digits say where the budget ends, sums over the next ones where in there, and so on until a leaf has at
    most EDGE_ROWS rows left, so one leaf with most of the rows is many tasks' work at any size.
    """
    names = without(docs, ["domain", "epoch", "n_tokens", "leaf_budget"]).columns
    base = docs.select(
        *[F.col(f"`{c}`") for c in names],
        F.coalesce((F.lit("all") if domain is None else domain).cast("string"), F.lit(NO_VALUE)).alias("__lf_domain"),
        *[F.coalesce(F.col(k).cast("string"), F.lit(NO_VALUE)).alias(f"__lf_{k}") for k in LEVELS[1:]],
        (tokens(F.col("text")) if n_tokens is None else n_tokens).cast("long").alias("__lf_tokens"),
    )
    keys = [f"__lf_{k}" for k in LEVELS]
    slim = written(base.select(F.col(doc_id), *keys, "__lf_tokens"), "mixing-rows")
    totals = checkpointed(slim.groupBy(*keys).agg(F.sum("__lf_tokens").alias("total")).withColumnsRenamed(dict(zip(keys, LEVELS, strict=True))))
    plan = budgets(totals, budget, weights, epochs).where("given > 0")
    plan = checkpointed(plan.select(*[F.col(k).alias(f"__lf_{k}") for k in LEVELS], F.col("given").alias("__lf_given"), F.expr("given div total").alias("__lf_whole"), F.expr("given % total").alias("__lf_part")))
    plan_rows = plan.count()

    def ordered(rows: DataFrame, plan: DataFrame) -> DataFrame:
        hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__lf_whole").cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
        return rows.join(F.broadcast(plan) if plan_rows <= SMALL_PLAN else plan, keys).withColumn("__lf_hash", hashed)

    known = plan.withColumn("__lf_end", F.lit("")).withColumn("__lf_ahead", F.lit(0).cast("long"))
    for digits in range(HEX, 32 + 1, HEX):
        rows = ordered(slim, known).where(F.expr("startswith(__lf_hash, __lf_end)")).withColumn("__lf_bucket", F.substring("__lf_hash", 1, digits))
        sums = rows.groupBy(*keys, "__lf_part", "__lf_ahead", "__lf_bucket").agg(F.sum("__lf_tokens").alias("__lf_n"), F.count("*").alias("__lf_rows"))
        upto = F.col("__lf_ahead") + F.sum("__lf_n").over(Window.partitionBy(*keys).orderBy("__lf_bucket"))
        sums = sums.withColumn("__lf_upto", upto).where("__lf_upto - __lf_n < __lf_part AND __lf_upto >= __lf_part")
        ends = sums.select(*keys, F.col("__lf_bucket").alias("__lf_end"), F.expr("__lf_upto - __lf_n").alias("__lf_ahead"), "__lf_rows")
        known = checkpointed(plan.join(ends, keys))
        if (known.agg(F.max("__lf_rows")).first()[0] or 0) <= edge_rows:
            break
    removed(slim)
    plan = checkpointed(plan.join(known.select(*keys, "__lf_end", "__lf_ahead"), keys, "left"))
    rows = ordered(base, plan)
    at_end = F.coalesce(F.expr("startswith(__lf_hash, __lf_end)"), F.lit(False))
    sure = rows.where(~at_end).withColumn("__lf_in", F.coalesce(F.col("__lf_hash") < F.col("__lf_end"), F.lit(False)))
    start = F.sum("__lf_tokens").over(Window.partitionBy(*keys).orderBy("__lf_hash", doc_id, "__lf_tokens").rowsBetween(Window.unboundedPreceding, -1))
    edge = rows.where(at_end).withColumn("__lf_in", F.col("__lf_ahead") + F.coalesce(start, F.lit(0)) < F.col("__lf_part"))
    epoch = F.explode(F.expr("CASE WHEN __lf_in THEN sequence(0, cast(__lf_whole AS int)) WHEN __lf_whole > 0 THEN sequence(0, cast(__lf_whole AS int) - 1) ELSE CAST(array() AS array<int>) END"))
    return sure.unionByName(edge).select(
        *[F.col(f"`{c}`") for c in names],
        F.nullif(F.col("__lf_domain"), F.lit(NO_VALUE)).alias("domain"),
        epoch.alias("epoch"),
        F.col("__lf_tokens").alias("n_tokens"),
        F.col("__lf_given").alias("leaf_budget"),
    )


def op8_domain() -> Column:
    """The query's domains: documents have none, so sources are dealt to three by their last character."""
    return F.concat(F.lit("d"), F.pmod(F.ascii(F.reverse(F.coalesce("source", F.lit("")))), F.lit(3)).cast("string"))


#: Domain d1 is to weigh twice as much as each other one, English three times as much as each other language.
OP8_WEIGHTS = {"domain": {"d1": 2}, "lang": {"en": 3}}
OP8_EPOCHS = 2


def op8_mix(spark, sf_dir: str) -> DataFrame:
    """As many tokens as ``documents`` has, in OP8_WEIGHTS, with two epochs at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    mixed = mix(docs, F.col("total"), OP8_WEIGHTS, OP8_EPOCHS, op8_domain())
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "leaf_budget")


def _level(i: int) -> str:
    parent, names = ", ".join(LEVELS[:i]), ", ".join(LEVELS[: i + 1])
    weight = {"domain": "CASE WHEN domain = 'd1' THEN 2 ELSE 1 END", "lang": "CASE WHEN lang = 'en' THEN 3 ELSE 1 END", "source": "1"}[LEVELS[i]]
    by = f"PARTITION BY {parent}" if parent else ""
    known = f"JOIN g{i - 1} USING ({parent})" if parent else "CROSS JOIN g"
    return f"""
n{i} AS (SELECT * FROM (SELECT {names}, CAST(sum(total) * {OP8_EPOCHS} AS BIGINT) AS cap, {weight} AS weight FROM leaves GROUP BY {names}) {known}),
a{i} AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap0, sum(weight) OVER ({by}) - coalesce(sum(weight) OVER b, 0) AS w0 FROM n{i}
       WINDOW b AS ({by} ORDER BY CAST(cap AS DOUBLE) / weight, cap, weight, {names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{i} AS (SELECT *, CAST(cap AS HUGEINT) * w0 <= CAST(budget - cap0 AS HUGEINT) * weight AS isfull FROM a{i}),
s{i} AS (SELECT *, coalesce(sum(CASE WHEN isfull THEN cap END) OVER ({by}), 0) AS cap1, coalesce(sum(CASE WHEN NOT isfull THEN weight END) OVER ({by}), 0) AS w1 FROM f{i}),
g{i} AS (SELECT {names}, CASE WHEN isfull THEN cap ELSE least(cap, CAST((CAST(budget - cap1 AS HUGEINT) * weight) // greatest(w1, 1) AS BIGINT)) END AS budget FROM s{i}),"""


OP8_SQL = f"""
WITH docs AS (SELECT doc_id, lang, source, 'd' || CAST(ascii(reverse(coalesce(source, ''))) % 3 AS VARCHAR) AS domain,
              CAST(ceil(coalesce(strlen(text), 0) / {BYTES_PER_TOKEN}) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS total FROM docs GROUP BY ALL),
g AS (SELECT CAST(sum(total) AS BIGINT) AS budget FROM leaves),{"".join(_level(i) for i in range(3))}
plan AS (SELECT domain, lang, source, CAST(budget AS BIGINT) AS leaf_budget, CAST(budget // total AS BIGINT) AS whole, budget % total AS part
         FROM g2 JOIN leaves USING (domain, lang, source) WHERE budget > 0),
o AS (SELECT *, md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM docs JOIN plan USING (domain, lang, source)),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < part AS inside FROM o)
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, n_tokens, leaf_budget
FROM (SELECT *, unnest(range(0, whole + CAST(inside AS BIGINT))) AS e FROM p)
"""
