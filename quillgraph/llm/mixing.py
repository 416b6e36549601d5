"""One training mix from several sources: temperature weights, block permutations.

Weights come from one exponent.  With natural token shares ``q`` and target shares
``p`` the family ``w(x) ~ q * (p / q) ** x`` runs from the natural shares (x = 0)
to the targets (x = 1); the largest x in [0, 1] is bisected at which no source needs
more than ``max_repeats`` passes for the wanted total.  For a wanted entropy
``w(x) ~ q ** x`` is bisected to it in place of the target shares.

A source's budget is realised as whole passes over its documents and a part of one
more.  Every pass is its own permutation (a seeded hash), cut into steps by the leading
bits of the hash.  The sizes of all steps, STEPS rows at most, are broadcast: steps before
the cut of the last pass are taken whole; the one step a source is cut in is cut again by
further bits, and only what is left of that is looked at document by document.  So the
documents are never shuffled, and no source, however large, is sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import cut, need

MAX_SOURCES = 100_000
#: Rows of a broadcast table of sizes.
STEPS = 1 << 18


def source_key(c: Column) -> Column:
    """A source's name without case and outer or repeated blanks; '' for null."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def bisect(ok: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """Largest x in [low, high] with ``ok(x)``, if ``ok`` holds up to some point; else ``low``."""
    if ok(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def _normal(w: dict[str, float]) -> dict[str, float]:
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total else w


def tempered(q: dict[str, float], p: dict[str, float], x: float) -> dict[str, float]:
    """Weights at exponent x between natural shares ``q`` and targets ``p``."""
    return _normal({s: math.exp((1 - x) * math.log(q[s]) + x * math.log(p[s])) for s in q})


def entropy_exponent(q: dict[str, float], entropy: float) -> float:
    """Exponent in [0, 1] at which ``q ** x`` has the wanted entropy (nats); 0 gives
    equal shares, so an entropy above log(sources) gives 0."""

    def h(x: float) -> float:
        w = _normal({s: v**x for s, v in q.items()})
        return -sum(v * math.log(v) for v in w.values() if v > 0)

    return bisect(lambda x: h(x) >= entropy, 0.0, 1.0)


def plan_mix(
    tokens: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None, entropy: float | None = None
) -> tuple[dict[str, float], float, float]:
    """Weights of the sources that have documents and a target, the total, and the exponent.

    Without ``total_tokens`` the total is the largest at which every such source
    reaches its target within its repeats.  A larger total than all sources can
    give is lowered to what they can.  With ``entropy`` (nats) the natural shares,
    tempered to it, stand for the target shares.
    """
    here = {s: (p, r) for s, (p, r) in targets.items() if p > 0 and r > 0 and tokens.get(s, 0) > 0}
    if not here:
        return {}, 0.0, 1.0
    p = _normal({s: v[0] for s, v in here.items()})
    q = _normal({s: float(tokens[s]) for s in here})
    most = {s: float(tokens[s]) * here[s][1] for s in here}
    to_entropy = None if entropy is None else entropy_exponent(q, entropy)
    if to_entropy is not None:
        p = _normal({s: v**to_entropy for s, v in q.items()})
    total = min(most[s] / p[s] for s in here) if total_tokens is None else float(min(total_tokens, sum(most.values())))

    def fits(x: float) -> bool:
        w = tempered(q, p, x)
        return all(w[s] * total <= most[s] * (1 + 1e-12) for s in here)

    x = bisect(fits, 0.0, 1.0) if to_entropy is None else to_entropy
    w = tempered(q, p, x) if to_entropy is None else p
    while any(w[s] * total > most[s] * (1 + 1e-9) for s in here):  # natural shares, or those of the entropy, ask too much: fill up to the limits
        full = {s for s in here if w[s] * total >= most[s]}
        rest, room = {s: w[s] for s in here if s not in full}, total - sum(most[s] for s in full)
        if not rest:
            return {s: most[s] / total for s in here}, total, x
        scale = room / sum(rest.values()) / total
        w = {s: most[s] / total if s in full else rest[s] * scale for s in here}
    return w, total, x


def mix_sources(
    docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, entropy: float | None = None, block_tokens: int = 1_000_000, step_bits: int | None = None, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``docs``: ``doc_id, source, n_tokens``; ``targets``: ``source, target_share,
    max_repeats`` (at most MAX_SOURCES rows).  The mix has ``doc_id, source, copy,
    n_tokens, block, order_key``: to read it in order, sort by block and order_key.
    Every block holds every source in proportion.  A source is met to within one
    document.  With ``entropy`` the shares have it (as far as repeats allow) and those
    of ``targets`` only name the sources.

    Documents without tokens (null, empty) are not used; sources differ in case and
    blanks only by mistake and count as one; a null source and sources without a
    target get no share; a target without documents is reported with share 0.
    Repeated doc_ids are documents of their own.  Empty tables give an empty mix.
    """
    need(docs, "doc_id", "source", "n_tokens")
    need(targets, "source", "target_share", "max_repeats")
    spark = docs.sparkSession
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in targets")
    goals = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in wanted}
    named = docs.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    stats = named.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    have = {r["source"]: r for r in stats.where(F.col("source").isin(*goals) if goals else F.lit(False)).collect()}  # <= MAX_SOURCES rows
    weights, total, exponent = plan_mix({s: r["tokens"] for s, r in have.items()}, goals, total_tokens, entropy)
    rows = []
    for s, w in weights.items():
        full, left = divmod(w * total, have[s]["tokens"])
        if have[s]["tokens"] - left < 1e-6 * have[s]["tokens"]:  # a whole pass but for rounding
            full, left = full + 1, 0.0
        full = min(int(full), goals[s][1])
        rows.append((s, full, float(left) if full < goals[s][1] else 0.0, float(w * total), int(have[s]["tokens"])))
    plan = spark.createDataFrame(rows, "source string, full int, part double, budget double, source_tokens bigint")
    turns = sum(full + 1 for _, full, *_ in rows) or 1
    if step_bits is None:
        step_bits = max(0, min(10, int(math.log2(max(1, STEPS // turns)))))
    # documents of the step that a source is cut in, in pieces of some 10,000, as far as the sizes stay few
    largest = max((r["docs"] for r in have.values()), default=0) >> step_bits
    fine_bits = max(0, min(20, math.ceil(math.log2(max(1, largest / 10_000))), int(math.log2(max(1, STEPS // max(1, len(rows)))))))
    bits = lambda c, n: F.lit(0).cast("bigint") if n == 0 else F.shiftrightunsigned(c, 64 - n)
    passes = (
        named.where("n_tokens > 0")
        .join(F.broadcast(plan), "source")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("full") - F.when(F.col("part") > 0, 0).otherwise(1))))
        .where("pass >= 0")
        .withColumn("h", F.xxhash64(F.lit(seed), F.col("pass"), F.col("doc_id")))
        .withColumn("step", bits(F.col("h"), step_bits))
    )

    def sizes(df: DataFrame, keys: list[str], at: str, label: str) -> DataFrame:
        """Tokens of each place of a permutation and before it: few rows, written once."""
        before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        summed = df.groupBy(*keys, at).agg(F.sum("n_tokens").alias("here"))
        return F.broadcast(cut(summed.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))), label))

    placed = passes.join(sizes(passes, ["source", "pass"], "step", "steps"), ["source", "pass", "step"])
    whole = placed.where("pass < full or before + here <= part")
    at_cut = placed.where("pass = full and before < part and before + here > part").withColumnRenamed("before", "start").drop("here")
    at_cut = cut(at_cut.withColumn("fine", bits(F.shiftleft("h", step_bits), fine_bits)), "at-cut")
    finer = at_cut.join(sizes(at_cut, ["source"], "fine", "fine-steps"), ["source", "fine"]).withColumn("upto", F.col("start") + F.col("before"))
    in_fine = Window.partitionBy("source").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        finer.where("upto < part and upto + here > part")
        .withColumn("upto", F.col("upto") + F.coalesce(F.sum("n_tokens").over(in_fine), F.lit(0)))
        .where("upto + n_tokens / 2 <= part")
    )
    kept = ["doc_id", "source", "n_tokens", "pass", "h", "budget", "source_tokens"]
    taken = whole.select(*kept, "before").unionByName(finer.where("upto + here <= part").select(*kept, F.col("start").alias("before"))).unionByName(edge.select(*kept, F.col("start").alias("before")))
    blocks = max(1, min(1 << 30, math.ceil(total / block_tokens)))
    through = (F.col("pass") * F.col("source_tokens") + F.col("before")) / F.col("budget")
    mix = taken.select(
        "doc_id",
        "source",
        (F.col("pass") + 1).alias("copy"),
        "n_tokens",
        F.least(F.lit(blocks - 1), F.floor(through * blocks)).cast("int").alias("block"),
        F.xxhash64(F.lit(seed + 1), "h", "source").alias("order_key"),
    )
    mix = cut(mix, "mix")
    used = cut(mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.max("copy").alias("most_copies"), F.count("*").alias("docs_used")), "used")
    goal = spark.createDataFrame([(s, p, r, float(weights.get(s, 0.0))) for s, (p, r) in goals.items()], "source string, target_share double, max_repeats int, weight double")
    everything = used.agg(F.sum("tokens_used")).first()[0] or 0
    report = (
        stats.join(F.broadcast(goal), "source", "full_outer")
        .join(used, "source", "left")
        .select(
            "source",
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            F.coalesce("weight", F.lit(0.0)).alias("weight"),
            F.coalesce("docs", F.lit(0)).alias("docs"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("docs_used", F.lit(0)).alias("docs_used"),
            F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.lit(exponent).alias("exponent"),
        )
        .withColumn("actual_share", F.coalesce(F.try_divide("tokens_used", F.lit(everything)), F.lit(0.0)))
    )
    return mix, report
