"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Rows have a mass (their bytes, say; 1 where none is given). The rows of a source are laid end to end, and block j holds
those that begin in its stretch [j b, (j + 1) b), where b is the mass of a block; a row longer than b leaves the blocks
that it covers empty, so that its source pays for it. The target weights are turned into whole shares q of ``period``
slots (largest remainders, at least one each for a weight above 0). By default the period is 2 ** 36 slots, far more than
any table has blocks, so that shares stand for the weights to 2e-11. Block j of a source may not run before its release
floor(j * period / q) and must run before its deadline ceil((j + 1) * period / q); in every slot the released block with
the earliest deadline runs. One resource at full use is feasible under this rule, so no deadline is missed and after any
number of slots a source that still has rows has less than one block more or less than its weight asks for; in mass, less
than a block and the part of its last row that stands over.

A block has ``block_mass``, or the ``blocks``-th part of all mass where that is more: 1 / 4,096 by default. The schedule
is then some thousands of blocks however large the table is. It is folded in SQL, one step a block, in a row of that size.

No row is dropped. Once a source has run out the others keep their windows, and a slot without a released block stays
empty. Sources without weight (0, or missing from the given weights) get no share: their blocks come in turn after the
last deadline of the others.

A source may hold any part of all rows: it is laid out in parts by hash, whose rows and masses are summed up first. The
table of blocks is written and joined; sources are taken to be a list of names.

Defined results: a null source is a source of its own; a null or negative mass counts as 0, a source whose masses are
all 0 has no weight; columns of ``docs`` keep their names inside ``row``, so none can clash; rows with equal or null ids
are laid in any order among themselves; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm.common import shuffle_partitions, written

PERIOD = 1 << 36


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def _mass(mass: str | Column | None) -> Column:
    if mass is None:
        return F.lit(1).cast("double")
    own = F.col(f"`{mass}`") if isinstance(mass, str) else mass
    return F.coalesce(F.greatest(own.cast("double"), F.lit(0.0)), F.lit(0.0))


def shares(docs: DataFrame, weights: dict[str | None, float] | None = None, *, mass: str | Column | None = None, temperature: float = 0.5, period: int = PERIOD) -> DataFrame:
    """skey, mass, q, slots (the period) of each source; q is 0 without weight. Without ``weights`` a source weighs
    m ** temperature, where m is the sum of ``mass`` (a column or its name), or its rows if there is none."""
    if weights is not None and not all(0 <= v < float("inf") for v in weights.values()):
        raise ValueError("weights must be 0 or more")
    counts = docs.groupBy(_key().alias("skey")).agg(F.sum(_mass(mass)).alias("mass"))
    if weights is None:
        weight = F.when(F.col("mass") > 0, F.pow("mass", F.lit(temperature))).otherwise(0.0)
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit("null" if k is None else f"={k}"), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("skey")), F.lit(0.0)) if pairs else F.lit(0.0)
    listed = counts.select("skey", "mass", weight.alias("weight")).agg(F.sort_array(F.collect_list(F.struct("skey", "mass", "weight"))).alias("s"))
    one = listed.select("s", F.expr("size(filter(s, x -> x.weight > 0))").alias("n"), F.expr("aggregate(s, 0D, (t, x) -> t + x.weight)").alias("total"), F.greatest(F.lit(period), F.size("s") * 2).cast("long").alias("slots"))
    each = one.select("slots", F.expr("slots - n").alias("free"), F.explode(F.expr("transform(s, x -> struct(x.skey, x.mass, if(x.weight > 0, x.weight / total, 0D) AS w))")).alias("x")).select("slots", "free", "x.*")
    # the remainders go to the largest fractions; one row per source
    cut = each.withColumn("floor", F.floor(F.col("w") * F.col("free"))).withColumn("fraction", F.col("w") * F.col("free") - F.col("floor"))
    together = W.partitionBy("slots")
    extra = F.row_number().over(together.orderBy(F.desc("fraction"), F.desc("w"), "skey")) <= F.col("free") - F.sum("floor").over(together)
    return cut.select("skey", "mass", F.when(F.col("w") > 0, 1 + F.col("floor") + extra.cast("long")).otherwise(F.lit(0)).cast("long").alias("q"), "slots")


def schedule(shared: DataFrame, chunk: int = 512) -> DataFrame:
    """skey, q, slots, nth, at (its slot), release, deadline of the first ``blocks`` blocks of each source of ``shared``
    (skey, q, slots, blocks) with a share: earliest deadline first. Steps are folded in chunks to keep arrays short."""
    cut = "struct(x.q AS q, x.blocks AS blocks, 0L AS nth, 0L AS release, (slots + x.q - 1) div x.q AS deadline)"
    one = shared.filter("q > 0 AND blocks > 0").agg(F.sort_array(F.collect_list(F.struct("skey", "q", "blocks"))).alias("s"), F.max("slots").alias("slots"), F.sum("blocks").alias("n")).filter("n > 0")
    moved = "named_struct('q', x.q, 'blocks', x.blocks, 'nth', x.nth + 1, 'release', ((x.nth + 1) * slots) div x.q, 'deadline', ((x.nth + 2) * slots + x.q - 1) div x.q)"
    empty = "cast(array() AS array<struct<i: int, nth: bigint, at: bigint>>)"
    step = f"""(a, k) -> transform(array(greatest(a.t, array_min(transform(a.s, x -> if(x.nth < x.blocks, x.release, NULL))))), t ->
        transform(array(array_min(transform(a.s, (x, i) -> if(x.nth < x.blocks AND x.release <= t, named_struct('deadline', x.deadline, 'i', i), NULL)))), p ->
            named_struct('t', t + 1, 's', transform(a.s, (x, i) -> if(i = p.i, {moved}, x)), 'run', concat(a.run, array(named_struct('i', p.i, 'nth', a.s[p.i].nth, 'at', t)))))[0])[0]"""
    fold = f"""aggregate(sequence(0L, (n - 1) div {chunk}), named_struct('t', 0L, 's', transform(s, x -> {cut}), 'runs', cast(array() AS array<array<struct<i: int, nth: bigint, at: bigint>>>)),
        (b, c) -> transform(array(aggregate(sequence(c * {chunk}, least(n, (c + 1) * {chunk}) - 1), named_struct('t', b.t, 's', b.s, 'run', {empty}), {step})), r ->
            named_struct('t', r.t, 's', r.s, 'runs', concat(b.runs, array(r.run))))[0]).runs"""
    run = one.select("s", "slots", F.explode(F.expr(fold)).alias("runs")).select("s", "slots", F.explode("runs").alias("r"))
    return run.select(F.expr("s[r.i].skey").alias("skey"), F.expr("s[r.i].q").alias("q"), "slots", "r.nth", "r.at").withColumns(
        {"release": F.expr("(nth * slots) div q"), "deadline": F.expr("((nth + 1) * slots + q - 1) div q")}
    )


def period_table(shared: DataFrame) -> DataFrame:
    """The schedule of one whole period."""
    return schedule(shared.withColumn("blocks", F.col("q")))


def block_table(shared: DataFrame) -> DataFrame:
    """skey, nth, at, release, deadline of every block of (skey, q, slots, blocks): the schedule, then in turn the blocks of
    sources without weight."""
    timed = schedule(shared).select("skey", "nth", "at", "release", "deadline")
    end = timed.agg(F.coalesce(F.max("deadline"), F.lit(0)).alias("end"))
    rest = shared.filter("q = 0").select("skey", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("nth")).join(F.broadcast(end), how="cross")
    late = rest.withColumn("at", F.col("end") + F.row_number().over(W.orderBy("nth", "skey")) - 1)
    return timed.unionByName(late.select("skey", "nth", "at", F.col("at").alias("release"), (F.col("at") + 1).alias("deadline")))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, *, mass: str | Column | None = None, block_mass: float = 1.0, blocks: int = 4096, temperature: float = 0.5, period: int = PERIOD) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, source) in a struct ``row``, with source_block, release, deadline, slot,
    source_row (its place in its source) and starts (the mass of its source before it). Ordering by slot and source_row
    gives the mix."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_partitions(docs.sparkSession))).alias("part")
    parts = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key().alias("skey"), part, _mass(mass).alias("m"))
    sizes = docs.groupBy(_key().alias("skey"), part).agg(F.count(F.lit(1)).alias("rows"), F.sum(_mass(mass)).alias("mass"))
    upto = W.partitionBy("skey").orderBy("part")
    before = sizes.select("skey", "part", (F.sum("rows").over(upto) - F.col("rows")).alias("rows_before"), (F.sum("mass").over(upto) - F.col("mass")).alias("mass_before"))
    laid = W.partitionBy("skey", "part").orderBy("row.doc_id")
    inside = parts.withColumn("nth", F.row_number().over(laid) - 1).withColumn("upto", F.coalesce(F.sum("m").over(laid.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    numbered = inside.join(before, ["skey", "part"]).select("row", "skey", (F.col("rows_before") + F.col("nth")).alias("source_row"), (F.col("mass_before") + F.col("upto")).alias("starts"))

    shared = written(shares(docs, weights, mass=mass, temperature=temperature, period=period))
    size = shared.agg(F.greatest(F.lit(float(block_mass)), F.sum("mass") / blocks).alias("size"))
    counted = shared.join(F.broadcast(size), how="cross").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("mass") / F.col("size"))))
    plan = written(block_table(counted)).withColumnRenamed("nth", "source_block").withColumnRenamed("at", "slot")
    # rows of no mass behind the last stretch belong to the last block
    placed = numbered.join(F.broadcast(counted.select("skey", "size", "blocks")), "skey").withColumn("source_block", F.least(F.floor(F.col("starts") / F.col("size")), F.col("blocks") - 1))
    return placed.join(plan, ["skey", "source_block"]).select("row", "source_block", "release", "deadline", "slot", "source_row", "starts")
