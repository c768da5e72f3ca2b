"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often the mix should take it. Among all rates that give each
source its target number of words and never exceed ``cap``, entropy balancing picks those
closest to one in relative entropy: ``rate = min(cap, exp(lambda * size / mean size))`` with one
multiplier a source. The multipliers are the optimum of a convex dual, found by safeguarded
Newton steps; each step is one distributed aggregate over a histogram of sizes. Rates are then
rounded into whole copies by systematic rounding along the sizes, so that the words taken from
a source differ from its target by about one document.

All sums are of integers, so reruns agree whatever the order of rows. A null text has size 0;
null sources form a source of their own; documents of size 0 are taken 0 words. Repeated rows
are documents of their own (ties in the rounding order take equal turns). Empty input: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.llm.common import Workspace, whole_text

WEIGHTS = (5, 2, 1)
VOLUME = 1.5
CAP = 2
STEPS = 40
# Fixed-point units: of a rate, and of words in the Newton sums.
RATE_UNIT = 1 << 30
WORD_UNIT = 1 << 10


def word_count(text: Column | str) -> Column:
    """Words of the whole text; a word is a run of characters other than ASCII white space."""
    return F.regexp_count(whole_text(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, volume: float = VOLUME, cap: float = CAP) -> DataFrame:
    """Per source: source, source_size, target. ``sizes`` has one row per source.

    Sharing by weight, stopping at ``cap`` times a source's size and sharing the excess anew ends
    at ``min(cap * size, weight * level)`` with one common level. Sorted by cap / weight, the
    sources that stop come first, so running sums give the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    named = named.withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) * volume
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    placed = named.withColumn("level", level)
    # The first source that does not stop sets the level, which is the highest of those that fit.
    fits = F.col("level") * F.col("weight") <= F.col("most")
    final = F.max(F.when(fits, F.col("level"))).over(everything)
    target = F.least("most", F.coalesce(F.col("weight") * final, F.col("most")))
    return placed.withColumn("final", final).select("source", "source_size", target.alias("target"))


def _newton(cells: DataFrame, goals: DataFrame, space: Workspace, cap: float, steps: int) -> DataFrame:
    """Multipliers per source: source, lam (null where every rate is the cap)."""
    solved = goals.select(
        "source", "target", F.col("source_size").alias("whole"), "mean_size",
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        ((F.col("target") >= F.col("source_size") * float(cap)) | (F.col("source_size") == 0)).alias("done"),
    )
    state = space.put("newton0", solved)
    for step in range(1, steps + 1):
        joined = cells.join(state, cells["source"].eqNullSafe(state["source"])).where("not done")
        tilt = F.col("lam") * F.col("size") / F.col("mean_size")
        rate = F.least(F.exp(F.least(tilt, F.lit(50.0))), F.lit(float(cap)))
        words = F.col("size") * F.col("n") * rate
        slope = F.when(F.exp(F.least(tilt, F.lit(50.0))) < float(cap), words * F.col("size") / F.col("mean_size")).otherwise(0.0)
        sums = joined.select(
            state["source"],
            F.round(words * WORD_UNIT).cast("decimal(28,0)").alias("words"),
            F.round(slope * WORD_UNIT).cast("decimal(28,0)").alias("slope"),
        ).groupBy("source").agg(
            (F.sum("words").cast("double") / WORD_UNIT).alias("got"),
            (F.sum("slope").cast("double") / WORD_UNIT).alias("slope"),
        )
        now = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "g.got", "g.slope")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        now = now.withColumn("gap", gap).withColumn("low", low).withColumn("high", high)
        step_to = F.col("lam") - F.col("gap") / F.col("slope")
        middle = (
            F.when(F.col("low").isNull(), F.col("lam") - F.greatest(F.lit(0.5), F.abs("lam")))
            .when(F.col("high").isNull(), F.col("lam") + F.greatest(F.lit(0.5), F.abs("lam")))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (F.col("slope") > 0) & (step_to > F.coalesce("low", F.lit(-math.inf))) & (step_to < F.coalesce("high", F.lit(math.inf))) & (F.abs(step_to - F.col("lam")) <= 4.0)
        done = F.col("done") | (F.abs("gap") <= F.greatest(F.lit(0.25), F.col("target") * 1e-6))
        moved = F.when(done, F.col("lam")).when(inside, step_to).otherwise(middle)
        now = now.withColumn("next", moved).withColumn("done", done)
        state = space.put(f"newton{step}", now.select("source", "target", "whole", "mean_size", F.col("next").alias("lam"), "low", "high", "done"))
        if state.where("not done").isEmpty():
            break
    return state.select("source", F.when((F.col("target") < F.col("whole") * float(cap)) & (F.col("whole") > 0), F.col("lam")).alias("lam"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, volume: float = VOLUME, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """Per document: key, size, source_size, target, rate, copies, taken (= copies * size)."""
    space = Workspace(docs.sparkSession, "mix")
    sized = space.put("sized", docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")))
    hist = space.put("hist", sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goals = targets(per_source.select("source", "source_size"), weights, volume, cap)
    goals = goals.alias("t").join(per_source.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source"))).select(
        "t.*", F.greatest(F.col("t.source_size") / F.col("p.docs"), F.lit(1.0)).alias("mean_size")
    )
    goals = space.put("goals", goals)
    lam = _newton(hist.where("size > 0"), goals, space, cap, steps)
    fixed = goals.alias("t").join(lam.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source"))).select("t.*", "l.lam")
    cells = hist.alias("h").join(fixed.alias("f"), F.col("h.source").eqNullSafe(F.col("f.source"))).select("h.*", "f.source_size", "f.target", "f.mean_size", "f.lam")
    tilt = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean_size"), F.lit(50.0))), F.lit(float(cap)))
    rate = F.coalesce(tilt, F.lit(float(cap)))
    cells = cells.withColumn("rate", F.round(rate * RATE_UNIT).cast("long"))
    cells = space.put("cells", cells.select("source", "size", "n", "source_size", "target", "rate", F.ceil(F.sqrt("n") / 8).cast("long").alias("parts")))

    # A crowded cell is dealt into parts by key. Their number grows with the root of its rows, so
    # neither a part nor the list of parts becomes one long window.
    joined = sized.alias("d").join(
        cells.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size"))
    ).select("d.*", "c.source_size", "c.target", "c.rate", F.pmod(F.xxhash64("d.key"), F.col("c.parts")).alias("part"))
    dealt = space.put("dealt", joined)
    parts = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("n"), F.first("rate").alias("rate"))
    # Running sums of rates before each part: over blocks of sizes first, then inside a block.
    parts = parts.withColumn("mass", (F.col("n") * F.col("rate")).cast("decimal(38,0)")).withColumn("block", F.floor(F.col("size") / 64))
    parts = space.put("parts", parts)
    none = F.lit(0).cast("decimal(38,0)")
    blocks = parts.groupBy("source", "block").agg(F.sum("mass").cast("decimal(38,0)").alias("mass"))
    over_blocks = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("mass").over(over_blocks).cast("decimal(38,0)"), none).alias("base"))
    in_block = Window.partitionBy("source", "block").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "size", "part", "block", F.coalesce(F.sum("mass").over(in_block).cast("decimal(38,0)"), none).alias("start"))
    starts = starts.alias("s").join(blocks.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.block") == F.col("b.block")))
    # Only the position inside one rate unit matters for rounding.
    starts = starts.select("s.source", "s.size", "s.part", F.pmod(F.col("s.start") + F.col("b.base"), F.lit(RATE_UNIT).cast("decimal(38,0)")).cast("long").alias("offset"))
    starts = space.put("starts", starts)
    ranked = dealt.withColumn("turn", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("key")).cast("long"))
    final = ranked.alias("d").join(
        starts.alias("s"),
        F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.size") == F.col("s.size")) & (F.col("d.part") == F.col("s.part")),
    ).select("d.*", "s.offset")
    half = RATE_UNIT // 2
    upto = F.floor((F.col("offset") + F.col("rate") * F.col("turn") + half) / F.lit(RATE_UNIT))
    earlier = F.floor((F.col("offset") + F.col("rate") * (F.col("turn") - 1) + half) / F.lit(RATE_UNIT))
    final = final.withColumn("copies", (upto - earlier).cast("long"))
    return final.select(
        F.col("key").alias(key), "size", "source_size", "target",
        (F.col("rate") / RATE_UNIT).alias("rate"), "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeat_by_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: every row as many times as it is taken, with all its columns.

    Rows that share key and size can't be told apart; they share their copies evenly.
    """
    plan = mix(docs, key, text, source, **how).select(F.col(key).alias("key_"), "size", "copies")
    space = Workspace(docs.sparkSession, "mixed")
    plan = space.put("plan", plan.groupBy("key_", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"))
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body")
    rows = docs.select(F.col(key).alias("key"), word_count(text).alias("words"), body)

    def taken(plan: DataFrame) -> DataFrame:
        return rows.join(plan, rows["key"].eqNullSafe(plan["key_"]) & (rows["words"] == plan["size"]))

    out = taken(plan.where("rows = 1")).select("body", "copies")
    shared = plan.where("rows > 1")
    if not shared.isEmpty():
        turn = F.row_number().over(Window.partitionBy("key", "words").orderBy(F.xxhash64("body")))
        even = taken(shared).withColumn("turn", turn)
        even = even.select("body", (F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("turn") <= F.col("copies") % F.col("rows"), 1).otherwise(0)).alias("copies"))
        out = out.unionByName(even.where("copies > 0"))
    return out.select("body", F.explode(F.expr("sequence(1L, copies)"))).select("body.*")


# What the targets of the contract's parameters are; rates and copies have no SQL form.
TARGETS_SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, source_size * {CAP}::DOUBLE AS most,
         CAST([{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight
  FROM sums),
placed AS (
  SELECT *, ({VOLUME}::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named),
final AS (SELECT *, max(level) FILTER (level * weight <= most) OVER () AS top FROM placed)
SELECT doc_id, size, source_size, least(most, coalesce(weight * top, most)) AS target
FROM sized JOIN final ON sized.source IS NOT DISTINCT FROM final.source
"""
