"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come by water-filling: a source gets words in proportion to its weight, but three times its own size at most; what
is left over is shared again among the others.  The words are dealt in blocks of equal size.  The house of all blocks is apportioned to the
sources by highest quotients, with targets as weights.  Each source is cut into shards of one expected size by a seeded hash, and the shards into about as many groups as a group has shards;
its quota is apportioned to the groups and theirs to the shards by highest quotients again, with sizes as weights and the quota above as the house.  A shard's documents lie on
a tape in seeded order; the quota takes the tape's blocks from the start, going round again where it exceeds the tape.

Only (id, source, size) travels.  A hot source is spread over shards in proportion to its size: a window over documents holds one shard, and
one over shards or groups the square root of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_RE, new_folder, settle

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 32
SHARD_WORDS = 250_000
MAX_REPEAT = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes: source, source_size, one row each -> source, source_size, weight, target.

    A source is full below the level at which its cap over its weight is reached; with sources sorted by that ratio the level is the
    first at which what remains, shared by the remaining weights, fills no further source.  Windows here go over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn("all_weight", F.sum("weight").over(whole))
    # What each source would get per weight if exactly those before it were full.
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("fills", F.col("cap") <= F.col("level") * F.col("weight"))
    # Those that fill come first in this order; the level that holds is the one of the first that does not.
    holds = F.min(F.when(~F.col("fills"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("place").alias("p"), F.col("level").alias("level")))).over(whole)
    return ranked.withColumn("held", holds["level"]).select("source", "source_size", "weight", F.when(F.col("fills"), F.col("cap")).otherwise(F.col("held") * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], weight: str, house: str, tie: list[str]) -> DataFrame:
    """``parties`` with ``seats``: within each group ``house`` seats go one by one to the highest quotient weight / (2 * seats + 1).

    The natural divisor's rounding gives all but a few seats; the seats too few or too many are then settled by quotients alone,
    so that rows made are the parties times that small difference.
    """
    g = Window.partitionBy(*group)
    base = parties.withColumn("__all", F.sum(weight).over(g))
    ideal = F.when(F.col("__all") > 0, F.col(house) * F.col(weight) / F.col("__all")).otherwise(F.lit(0.0))
    base = base.withColumn("__base", F.floor(ideal + 0.5).cast("long"))
    base = base.withColumn("__miss", F.when(F.col("__all") > 0, F.col(house) - F.sum("__base").over(g)).otherwise(F.lit(0)).cast("int"))
    # Candidates: the next seats up where seats are missing, the last seats down where there are too many.
    steps = F.when(F.col("__miss") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.abs("__miss")))
    seat = F.when(F.col("__miss") > 0, F.col("__base") + F.col("__step") - 1).otherwise(F.col("__base") - F.col("__step"))
    offers = base.select(*group, *tie, weight, "__miss", "__base", F.explode(steps).alias("__step")).withColumn("__seat", seat).where("__seat >= 0")
    quotient = F.col(weight) / (2 * F.col("__seat") + 1)
    best = Window.partitionBy(*group).orderBy(F.when(F.col("__miss") > 0, -quotient).otherwise(quotient), *tie, "__seat")
    moved = offers.withColumn("__rank", F.row_number().over(best)).where("__rank <= abs(__miss)").groupBy(*group, *tie).agg(F.sum(F.signum("__miss")).cast("long").alias("__moved"))
    keys = [*group, *tie]
    moved = moved.select(*[F.col(k).alias(f"__m_{k}") for k in keys], "__moved")
    on = [base[k].eqNullSafe(moved[f"__m_{k}"]) for k in keys]
    return base.join(moved, on, "left").withColumn("seats", F.col("__base") + F.coalesce("__moved", F.lit(0))).select(*parties.columns, "seats")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, key: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target and taken (words the mix takes, repeats counted), and the column ``key`` if given.

    Null text has size 0 and gives nothing; a null source is a source of its own, last in order; repeated rows each take part.
    No document gives more than three times its size. The same rows and seed give the same result, however they are partitioned.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"), F.xxhash64(docs[text_col]).alias("text_hash"), *([docs[key].alias("key")] if key else []))
    rows = settle(rows.withColumn("dealt", F.xxhash64(F.lit(seed), F.col("id"), F.col("source"))))
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    house = F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_words + 0.5).cast("long")
    sources = sainte_lague(sources.withColumn("house", house), ["house"], "target", "house", ["source"]).withColumnRenamed("seats", "quota")
    n_groups = F.greatest(F.lit(1), F.ceil(F.sqrt(F.ceil(F.col("source_size") / F.lit(float(SHARD_WORDS)))))).cast("long")
    n_shards = n_groups * F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(SHARD_WORDS)) / n_groups)).cast("long")
    sources = settle(sources.select(F.col("source").alias("s"), "source_size", "target", "quota", n_groups.alias("n_groups"), n_shards.alias("n_shards")))
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = settle(placed.withColumn("shard", F.pmod("dealt", "n_shards")).withColumn("group", F.col("shard") % F.col("n_groups")).drop("n_shards", "n_groups"))
    shards = placed.groupBy("source", "quota", "group", "shard").agg(F.sum("size").alias("words"))
    groups = sainte_lague(shards.groupBy("source", "quota", "group").agg(F.sum("words").alias("words")), ["source", "quota"], "words", "quota", ["group"])
    groups = groups.select(F.col("source").alias("s"), F.col("group").alias("g"), F.col("seats").alias("house"))
    shards = shards.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).drop("s", "g")
    shards = sainte_lague(shards, ["source", "group", "house"], "words", "house", ["shard"])
    # A shard gives three times its words at most; going round the tape, whole turns count for every document.
    give = F.least(F.col("seats") * block_words, F.col("words") * MAX_REPEAT)
    shards = shards.withColumn("tape", F.greatest(F.lit(1), F.col("words"))).select(F.col("source").alias("s"), F.col("shard").alias("h"), F.floor(give / F.col("tape")).cast("long").alias("turns"), (give % F.col("tape")).cast("long").alias("rest"))
    tape = Window.partitionBy("source", "shard").orderBy("dealt", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(tape), F.lit(0)))
    out = placed.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    taken = F.when(F.col("size") > 0, F.col("size") * F.coalesce("turns", F.lit(0)) + F.coalesce(part, F.lit(0))).otherwise(F.lit(0))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *([F.col("key").alias(key)] if key else []))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document is there as often as it is taken, whole each time. One that the plan takes in part (one in a shard at most) is taken whole once more if that part is half of it or
    more, and not otherwise, so a shard's words are off by half of one document at most. What isn't taken goes; rows that repeat an id each take part.

    The rows are written to the shared folder with a key of their own, by which they meet their plan.
    """
    spark, key = docs.sparkSession, "__row"
    while key in docs.columns:
        key = f"_{key}"
    folder = new_folder(spark, "mix")
    docs.withColumn(key, F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    plan = mix_plan(rows, id_col=id_col, text_col=text_col, source_col=source_col, key=key, **options).where("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size")) + F.when(2 * (F.col("taken") % F.col("size")) >= F.col("size"), 1).otherwise(0)
    plan = plan.select(F.col(key).alias("__key"), copies.cast("int").alias("__copies")).where("__copies > 0")
    out = rows.join(plan, rows[key] == plan["__key"])
    return out.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")
