"""Mixing sources to target weights by entropy balancing.

Targets: each source's share of all words by its weight, at most ``cap`` times
its size, the excess dealt again by weight until none is above.  Rates: of all
document rates between 0 and ``cap`` that meet each source's word total, those
closest in relative entropy to one copy of every document, sum of
r log r - r + 1.  The convex dual has one multiplier a source; a document of x
mean sizes has the rate min(cap, exp(l x)), its tilted unit weight.  Newton's
method solves the dual for all sources at once: a step is one aggregate of the
documents' gradient and curvature (documents of one source and size are added
up once, before), kept in a bracket where the cap bends the dual.  Sums are in
fixed point, so they are the same under any partitioning.  Rates
become copies by error diffusion: within cells of a source, long documents
first, the words owed are carried from document to document, so a cell ends
within half of its last, short documents of its target.

Defined cases: a null source is a source of its own, last in order; null and
empty texts have size 0 and take 0; repeated rows count each; an empty table
gives an empty mix; sources of size 0 have target and rate 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, partitions, prepare, written

WORD = r"[^\x20\x09-\x0D]+"
CELL_ROWS = 1000
#: Newton steps at most, the relative error of a source's words that ends them, and the unit of fixed-point sums.
STEPS, TOLERANCE, FIXED = 80, 1e-7, 1 << 30
BROADCAST_SOURCES = 50_000


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by code point of ``source``, null last, without gathering all rows in one task."""
    spark = sources.sparkSession
    held = written(
        sources.repartitionByRange(max(1, min(partitions(spark), 64)), F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()),
        "sources",
    )
    part = F.shiftright("at", 33)
    sizes = sorted((r["p"], r["n"]) for r in held.groupBy(part.alias("p")).agg(F.max(F.col("at").bitwiseAND((1 << 33) - 1)).alias("m"), F.count("*").alias("n")).collect())
    before, offset = [], 0
    for p, n in sizes:
        before += [F.lit(p).cast("long"), F.lit(offset).cast("long")]
        offset += n
    shift = F.element_at(F.create_map(*before), part.cast("long")) if before else F.lit(0)
    return held.withColumn("rank", shift + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, rows) -> adds ``target``; each round is one small aggregate."""
    table = _ranked(sources).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words per unit of weight
    while True:
        # sources whose cap lies below their share at this level are full
        full = F.col("source_size") * cap <= F.col("weight") * level
        r = table.agg(F.sum(F.when(full, F.col("source_size") * cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        new = (total - (r["held"] or 0.0)) / r["open"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return table.withColumn("target", F.least(F.col("source_size") * cap, F.col("weight") * level)).drop("rank")


def tilted(l: Column, size: Column, unit: Column, cap: float) -> Column:
    """The rate of a document by its source's multiplier (per ``unit`` of size); null stands for an infinite one."""
    return F.when(l.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(l * size / unit, F.lit(700.0)))))


def multipliers(sizes: DataFrame, sources: DataFrame, cap: float, small: bool) -> DataFrame:
    """(key, size, n) documents, (key, source_size, rows, target) -> adds ``unit`` and ``l``; each Newton step is one aggregate over the documents."""
    x = F.col("size") / F.col("unit")
    rate = tilted(F.col("l"), F.col("size"), F.col("unit"), cap)
    fixed = lambda v: F.round(v * FIXED).cast("decimal(20,0)") * (F.col("n") * F.col("size")).cast("decimal(18,0)")
    state = sources.withColumn("unit", F.col("source_size") / F.col("rows")).withColumn("open", (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12)))
    state = written(state.withColumn("l", F.when(F.col("open"), F.lit(0.0))).withColumn("lo", F.lit(-math.inf)).withColumn("hi", F.lit(math.inf)), "duals")
    for _ in range(STEPS):
        now = state.filter("open").select("key", "unit", "l")
        if now.isEmpty():
            break
        sums = sizes.join(F.broadcast(now) if small else now, "key").groupBy("key").agg((F.sum(fixed(rate)) / FIXED).cast("double").alias("mass"), (F.sum(fixed(F.when(rate < cap, x * rate).otherwise(0.0))) / FIXED).cast("double").alias("slope"))
        over = F.col("mass") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("l")), F.when(over, F.col("l")).otherwise(F.col("hi"))
        # on the logarithm of the mass, which is nearly straight; at most 2 + |l| at a time
        step = F.when((F.col("slope") > 0) & (F.col("mass") > 0), F.col("mass") * F.log(F.col("target") / F.col("mass")) / F.col("slope")).otherwise(F.when(over, F.lit(-math.inf)).otherwise(F.lit(math.inf)))
        most = F.abs("l") + 2
        to = F.col("l") + F.greatest(-most, F.least(most, step))
        to = F.when((to > F.col("lo")) & (to < F.col("hi")), to).otherwise((F.col("lo") + F.col("hi")) / 2)
        met = state.join(sums, "key", "left").withColumn("lo", F.when(F.col("open"), lo).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("open"), hi).otherwise(F.col("hi")))
        met = met.withColumn("open", F.col("open") & (F.abs(F.col("mass") - F.col("target")) > TOLERANCE * F.col("target")))
        before, state = state, written(met.withColumn("l", F.when(F.col("open"), to).otherwise(F.col("l"))).drop("mass", "slope"), "duals")
        drop(before)
    return state.select("key", "source_size", "rows", "target", "unit", "l")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, share: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken, and the columns to ``carry``."""
    spark = docs.sparkSession
    prepare(spark)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *[F.col(c).alias(f"c_{c}") for c in carry])
    sized = base.select("doc_id", "source", "size")
    if not carry:
        sized = base = written(sized, "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, cap, share)
    key = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c))
    sources = written(sources.select(key(F.col("source")).alias("key"), "source_size", "rows", "target"), "targets")
    small = sources.count() <= BROADCAST_SOURCES
    sizes = written(sized.filter("size > 0").groupBy(key(F.col("source")).alias("key"), "size").agg(F.count("*").alias("n")), "size-counts")
    solved = multipliers(sizes, sources, float(cap), small)
    drop(sizes, sources)
    if small:
        solved = F.broadcast(solved)
    rate = F.when(F.col("target") > 0, tilted(F.col("l"), F.col("size"), F.col("unit"), float(cap))).otherwise(F.lit(0.0))
    cells = F.greatest(F.lit(1), F.ceil(F.col("rows") / CELL_ROWS))
    rows = base.withColumn("key", key(F.col("source"))).join(solved, "key").withColumn("rate", rate).drop("l", "unit").withColumn("cell", F.pmod(F.xxhash64("doc_id", "size"), cells)).drop("rows")
    n = max(partitions(spark), 1)
    rows = rows.repartition(n, "key", "cell").sortWithinPartitions("key", "cell", F.desc("size"), "doc_id")
    schema = pa.schema([("copies", pa.int32())])
    names = ["doc_id", "source", "size", "source_size", "target", "rate", *[f"c_{c}" for c in carry]]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out_schema = ", ".join(f"`{x}` {types[x]}" for x in names) + ", copies int"

    def diffuse(batches):
        now, owed = None, 0.0
        for batch in batches:
            col = lambda x: batch.column(batch.schema.get_field_index(x))
            keys, cell = col("key").to_pylist(), col("cell").to_pylist()
            sizes, rates = col("size").to_pylist(), col("rate").to_pylist()
            copies = np.zeros(len(sizes), np.int32)
            for i, (k, c, s, r) in enumerate(zip(keys, cell, sizes, rates)):
                if (k, c) != now:
                    now, owed = (k, c), 0.0
                whole = min(math.floor(r), cap)
                owed += (r - whole) * s
                extra = s > 0 and whole < cap and owed >= s / 2
                owed -= s * extra
                copies[i] = whole + extra
            yield pa.RecordBatch.from_arrays([*[col(x) for x in names], pa.array(copies, schema.field(0).type)], [*names, "copies"])

    done = rows.select(*names, "key", "cell").mapInArrow(diffuse, out_schema)
    return done.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *[F.col(f"c_{c}").alias(c) for c in carry if c not in ("doc_id", "source")])
