"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

Source token shares ``p`` become weights ``p**a / sum(p**a)``. The exponent is the largest in [0, 1] whose
weights reach the target entropy, raised where a source would otherwise repeat more often than allowed; it
is found by bisection, five halvings a job, on the table of sources, which stays in Spark. Each source's
quota of tokens is then met by whole passes over its documents and one part pass: its documents are dealt
into blocks by hash, the blocks put into a seeded order, and documents taken in that order while they fit. All
blocks but one of each source are taken whole or not at all, so only the rows of that one are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.llm.common import broadcast_if_small, checkpointed, count_words, table

TARGET_ENTROPY, MOST_PASSES, BUDGET, SEED, BLOCK_ROWS = 0.95, 4.0, 1.0, 7, 5_000
#: Halvings of [0, 1] in a job, and jobs.
HALVINGS, ROUNDS = 5, 6
BLANKS = r"\x20\x09-\x0D"


def _bisect(shares: DataFrame, enough: Callable[[Column, Column, Column, float], Column], low_is_good: bool) -> float:
    """Bisect [0, 1]: the end of the range of exponents for which ``enough`` holds."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        parts = 1 << HALVINGS
        tried = [lo + (hi - lo) * i / parts for i in range(parts + 1)]
        tests = []
        for i, a in enumerate(tried):
            power = F.pow("p", F.lit(a))
            tests.append(enough(F.sum(power), F.sum(power * F.log("p")), F.min("p"), a).alias(f"t{i}"))
        holds = shares.agg(*tests).first()
        good = [x for i, x in enumerate(tried) if holds[f"t{i}"]]
        if low_is_good:
            if not good or good[-1] == 1.0:
                return good[-1] if good else 0.0
            lo, hi = good[-1], good[-1] + (hi - lo) / parts
        else:
            if not good or good[0] == 0.0:
                return good[0] if good else 1.0
            lo, hi = good[0] - (hi - lo) / parts, good[0]
    return lo if low_is_good else hi


def source_weights(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, most_passes: float = MOST_PASSES, budget: float = BUDGET) -> DataFrame:
    """``sources`` (columns ``source_key``, ``total``) with ``exponent``, ``weight`` and ``quota`` in tokens.

    ``target_entropy`` is a part of the largest entropy possible, ``budget`` a multiple of all tokens. Where
    the target would repeat a source more than ``most_passes`` times, the exponent that just does not is taken.
    Sources without tokens have weight and quota 0.
    """
    some = sources.where("total > 0")
    total, n = some.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    if not total:
        return sources.select("*", F.lit(1.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    shares = some.select((F.col("total") / F.lit(float(total))).alias("p"))
    top = F.log(F.lit(float(n)))
    by_entropy = _bisect(shares, lambda z, zl, p, a: F.log(z) - F.lit(a) * zl / z >= F.lit(target_entropy) * top - 1e-12, True)
    by_passes = _bisect(shares, lambda z, zl, p, a: F.lit(budget) * F.pow(p, F.lit(a - 1.0)) / z <= most_passes, False)
    a = max(by_entropy, by_passes)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    weight = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(float(total)), F.lit(a)) / F.lit(z)).otherwise(0.0)
    return sources.select("*", F.lit(a).alias("exponent"), weight.alias("weight")).withColumn("quota", F.round(F.col("weight") * F.lit(budget * total)).cast("long"))


def _weighed(docs: DataFrame, seed: int) -> DataFrame:
    """Of every row its source key, text hash, tokens and place; columns beside ``doc_id`` and ``source`` are not read."""
    source_key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    tokens = count_words(F.col("text"), BLANKS)
    rows = docs.select("doc_id", "source", source_key.alias("source_key"), F.xxhash64("text").alias("text_hash"), tokens.alias("n_tokens"))
    return rows.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))


def _turn(seed: int, source_key: str = "source_key", block: str = "block") -> Column:
    """What a source's blocks are ordered by."""
    return F.struct(F.xxhash64(F.lit(seed), source_key, block).alias("turn"), F.col(block).alias("block"))


def _planned(docs: DataFrame, target_entropy: float, most_passes: float, budget: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The weighed rows with their block, the plan of each block, and what the blocks that are cut hold.

    A block's plan has its rank, the source's weight and whole ``passes``, and the ``room`` left when its turn
    comes: it is taken whole, cut or left out. Equal rows of a cut block stand or fall together.
    """
    rows = checkpointed(_weighed(docs, seed))
    blocks = rows.count() // BLOCK_ROWS + 1
    rows = rows.withColumn("block", F.pmod("place", F.lit(blocks)))
    sums = checkpointed(rows.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("tokens")))
    weights = source_weights(sums.groupBy("source_key").agg(F.sum("tokens").alias("total")), target_entropy, most_passes, budget)
    some, total = F.col("total") > 0, F.greatest("total", F.lit(1))
    passes = F.when(some, F.floor(F.col("quota") / total)).otherwise(1).cast("long")
    weights = weights.select("source_key", "weight", passes.alias("passes"), F.when(some, F.col("quota") % total).otherwise(0).alias("rest"))
    order = Window.partitionBy("source_key").orderBy(_turn(seed))
    ranked = sums.withColumns({"block_rank": F.row_number().over(order).cast("long"), "upto": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    plan = ranked.join(weights, "source_key").withColumn("room", F.col("rest") - (F.col("upto") - F.col("tokens")))
    plan = checkpointed(plan.select("source_key", "block", "block_rank", "weight", "passes", "room", "tokens"))
    cut = broadcast_if_small(plan.where((F.col("room") > 0) & (F.col("tokens") > F.col("room"))).select("source_key", "block", "room"))
    same = rows.join(cut, ["source_key", "block"]).groupBy("source_key", "block", "room", "doc_id", "text_hash", "n_tokens").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("source_key", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    taken = same.withColumn("sofar", F.sum(F.col("n_tokens") * F.col("n")).over(inside)).where("sofar <= room")
    return rows, plan, broadcast_if_small(taken.select(F.col("source_key").alias("_gridfold_taken_source"), F.col("doc_id").alias("_gridfold_taken_id"), F.col("text_hash").alias("_gridfold_taken_text"), F.lit(1).alias("taken")))


def _with_taken(rows: DataFrame, taken: DataFrame, source_key: str, text_hash: str) -> DataFrame:
    """``rows`` with ``taken`` 1 for those that a cut block takes, else null."""
    met = (F.col(source_key) == F.col("_gridfold_taken_source")) & F.col("doc_id").eqNullSafe(F.col("_gridfold_taken_id")) & (F.col(text_hash) == F.col("_gridfold_taken_text"))
    return rows.join(taken, met, "left").drop("_gridfold_taken_source", "_gridfold_taken_id", "_gridfold_taken_text")


def mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, most_passes: float = MOST_PASSES, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """``(doc_id, text_hash, source, n_tokens, weight, copies, block, block_rank)`` for every row of ``docs``.

    ``copies`` says how often the mixture holds the row: once for each whole pass over its source, and once
    more if the part pass takes it. ``block_rank`` is the place of its block in the seeded order, from 1.
    A null ``source`` is a source of its own. Rows without words cost nothing and go with their block; a
    source without words at all keeps one copy of each row. Equal rows (id, text and source) have equal copies.
    An empty table gives no rows.
    """
    rows, plan, taken = _planned(docs, target_entropy, most_passes, budget, seed)
    placed = _with_taken(rows.join(broadcast_if_small(plan), ["source_key", "block"]), taken, "source_key", "text_hash")
    whole = (F.col("room") > 0) & (F.col("tokens") <= F.col("room"))
    copies = F.col("passes") + F.when(whole, 1).otherwise(F.coalesce("taken", F.lit(0)))
    return placed.select("doc_id", "text_hash", "source", "n_tokens", "weight", copies.alias("copies"), "block", "block_rank")


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` as the mixture holds them: every row as often as :func:`mix` says, with its own columns.

    A row's block and turn follow from the row itself, so only one plan row for each source is joined, and
    texts are not shuffled while that table is small.
    """
    rows, plan, taken = _planned(docs, TARGET_ENTROPY, MOST_PASSES, BUDGET, seed)
    blocks = rows.count() // BLOCK_ROWS + 1
    whole = F.when((F.col("room") > 0) & (F.col("tokens") <= F.col("room")), _turn(seed))
    sources = plan.groupBy("source_key").agg(F.first("passes").alias("_gridfold_passes"), F.max(whole).alias("_gridfold_upto")).withColumnRenamed("source_key", "_gridfold_key")
    placed = docs.withColumns({"_gridfold_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "_gridfold_text": F.xxhash64("text")})
    placed = placed.withColumn("_gridfold_block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_gridfold_text"), F.lit(blocks)))
    placed = placed.join(broadcast_if_small(sources), F.col("_gridfold_source") == F.col("_gridfold_key"))
    placed = _with_taken(placed, taken.withColumnRenamed("taken", "_gridfold_taken"), "_gridfold_source", "_gridfold_text")
    before = F.coalesce(_turn(seed, "_gridfold_source", "_gridfold_block") <= F.col("_gridfold_upto"), F.lit(False))
    copies = F.col("_gridfold_passes") + F.when(before, 1).otherwise(F.coalesce("_gridfold_taken", F.lit(0)))
    return placed.withColumn("_gridfold_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, copies and block of every row of ``documents`` by :func:`mix`."""
    return mix(table(spark, sf_dir, "documents")).drop("text_hash")
