"""Exact deduplication by deterministic block naming (the recursive naming of Karp, Miller and Rosenberg).

Texts are cut in blocks of ``block_chars`` characters.  The distinct blocks are sorted and take their places in that order as integer names; then the
names of adjacent pairs of blocks are named in the same way, level by level, until every document has one name.  Equal names mean equal
texts: a block's name stands for its whole content, a pair's for two names.

What travels: each distinct block goes through one shuffle, after a map-side combine; documents carry only two 64-bit
fingerprints of each block, by which they fetch the name.  The fingerprints are *verified*: the naming counts the distinct blocks under each
of them, and if any has two the pass is repeated with another seed, so no name ever rests on a hash being lucky.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import settle, text_of

BLOCK_CHARS = 8192


def _ranked(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names of distinct rows: their places in the sorted partitions, partition by partition."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _block_names(spine: DataFrame, blocks: DataFrame) -> DataFrame:
    names = settle(_ranked(blocks.groupBy("h1", "h2", "block").agg(F.count(F.lit(1)).alias("n")), ["block"]).select("h1", "h2", "name"))
    if not names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
        raise LookupError("two blocks with one fingerprint")
    # The key is written in another way than the naming's, so that both sides of the join are dealt anew and a hot block's side can be split.
    k = F.struct(F.col("h1").alias("a"), F.col("h2").alias("b"))
    left = spine.select("row_id", "levels", F.posexplode("hashes").alias("pos", "h")).select("row_id", "levels", "pos", F.struct(F.col("h.a"), F.col("h.b")).alias("k"))
    return left.join(names.select(k.alias("k"), "name"), "k").select("row_id", "levels", "pos", "name")


def identities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(spine, named). spine: row_id (a number of the row), id, text_sha256 for each row of ``docs``; named: row_id, levels and name, and
    two rows have equal (levels, name) if and only if their texts are equal."""
    cut = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t"))
    n = F.greatest(F.lit(1), F.ceil(F.length("t") / F.lit(float(block_chars))).cast("int"))
    cut = cut.withColumn("blocks", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("t", i * block_chars + 1, F.lit(block_chars))))
    for seed in range(16):
        two = lambda b: F.struct(F.xxhash64(F.lit(seed), b).alias("a"), F.xxhash64(F.lit(~seed), b).alias("b"))  # noqa: B023, E731
        sha = F.sha2(F.col("t").cast("binary"), 256)
        spine = settle(cut.select(F.monotonically_increasing_id().alias("row_id"), "id", sha.alias("text_sha256"), F.size("blocks").alias("levels"), F.transform("blocks", two).alias("hashes")))
        blocks = cut.select(F.explode("blocks").alias("block")).select(two(F.col("block")).alias("h"), "block").select(F.col("h.a").alias("h1"), F.col("h.b").alias("h2"), "block")
        try:
            level = _block_names(spine, blocks)
            break
        except LookupError:
            continue
    else:
        raise RuntimeError("sixteen seeds gave equal fingerprints to different blocks")
    most = spine.agg(F.max("levels")).first()[0] or 1
    level = level.withColumn("left_over", F.col("levels"))
    done: DataFrame | None = None
    while True:
        level = settle(level) if most > 1 else level
        # A document of n blocks is named with others of n blocks only, so that names of different heights can't meet.
        ready = level.where("left_over = 1").select("row_id", "levels", "name")
        done = ready if done is None else done.unionByName(ready)
        if most <= 1:
            return spine.select("row_id", "id", "text_sha256"), done
        pairs = (
            level.where("left_over > 1")
            .groupBy("row_id", "levels", "left_over", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("r"))
            .withColumn("r", F.coalesce("r", F.lit(-1).cast("long")))
        )
        pairs = settle(pairs)
        names = _ranked(pairs.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n")), ["l", "r"]).select(F.struct("l", "r").alias("k"), F.col("name").alias("pair_name"))
        level = pairs.withColumn("k", F.struct("l", "r")).join(names, "k").select("row_id", "levels", "pos", F.col("pair_name").alias("name"), F.ceil(F.col("left_over") / 2).cast("int").alias("left_over"))
        most = (most + 1) // 2


def dedup_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept and text_sha256 (of the text in UTF-8).

    Of rows with equal texts the one with the largest id stays; a null id gives way to any other, and of repeated rows
    with one id a single one stays. Null text counts as empty. An empty table gives no rows. Other columns are not read.
    """
    spine, named = identities(docs, id_col=id_col, text_col=text_col, block_chars=block_chars)
    named = settle(named.join(spine, "row_id"))
    best = named.groupBy("levels", "name").agg(F.max(F.struct(F.col("id").isNotNull().alias("o"), F.col("id").alias("id"), F.col("row_id").alias("row_id"))).alias("top"), F.count(F.lit(1)).alias("group_size"))
    best = best.select(F.struct("levels", "name").alias("k"), "top", "group_size")
    out = named.select("row_id", "id", "text_sha256", F.struct("levels", "name").alias("k")).join(best, "k")
    return out.select(F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("top.row_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text another row keeps, all columns as they were."""
    report = settle(dedup_report(docs, id_col=id_col, text_col=text_col, block_chars=block_chars).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), "kept"))
    rows = report.groupBy("__id", "__sha").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    keyed = docs.withColumn("__own", F.sha2(text_of(docs, text_col).cast("binary"), 256))
    gone = rows.where("not stays")
    kept = keyed.join(gone, keyed[id_col].eqNullSafe(gone["__id"]) & (keyed["__own"] == gone["__sha"]), "left_anti")
    if not rows.where("stays and n > 1").isEmpty():  # repeated rows: one of each stays
        kept = kept.dropDuplicates([id_col, "__own"])
    return kept.drop("__own")
