"""Mixing sources to target weights by Sainte-Lague apportionment (operator 4, DataFrame functions only).

Sources share the corpus's words by weight, none beyond ``MAX_REPEATS`` times its
size. The mix is counted in blocks of equal words. Blocks go to sources, and a
source's blocks to its shards, by highest quotients votes / (2k + 1). A shard is
a bounded set of documents in seeded order; it gives whole passes over its
blocks and a seeded run of the rest, so no block needs a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.frames import quoted, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1_000_000
SHARD_DOCS = 10_000
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of white-space separated words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def apportion(parties: DataFrame, votes: str, seats: Column, by: list[str], order: list[str]) -> DataFrame:
    """Add ``quota``: integer seats by highest quotients votes / (2k + 1), within each group of ``by``.

    With V votes, S parties and N seats the last quotient lies between V / (N + S/2) and V / (N - S/2), as each
    party's seats are its votes over a common divisor, rounded. So every party has its seats up to the lower end
    for sure, and only the few quotients between both ends, about S in all, compete for the rest.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.col(votes).cast("double")
    low = F.greatest(F.lit(0.0), F.col("_n") - F.col("_s") / 2) / F.col("_v")
    high = (F.col("_n") + F.col("_s") / 2) / F.col("_v")
    sized = (parties.withColumn("_n", seats.cast("long"))
             .withColumn("_s", F.count(F.lit(1)).over(group)).withColumn("_v", F.sum(share).over(group))
             .withColumn("_sure", F.when(F.col("_v") > 0, F.greatest(F.lit(0), F.floor(share * low + 0.5) - 1))
                         .otherwise(0).cast("long"))
             .withColumn("_most", F.when(F.col("_v") > 0, F.floor(share * high + 0.5) + 1).otherwise(0).cast("long")))
    best = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rivals = (sized.withColumn("_left", F.col("_n") - F.sum("_sure").over(group))
              .where(share > 0)
              .select(*by, *[c for c in order if c not in by], "_left", share.alias("_share"),
                      F.explode(F.sequence("_sure", "_most")).alias("_k"))
              .withColumn("_rank", F.row_number().over(
                  best.orderBy((F.col("_share") / (2 * F.col("_k") + 1)).desc(), *order)))
              .where(F.col("_rank") <= F.col("_left")))
    keys = [*by, *[c for c in order if c not in by]]
    won = rivals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    return (sized.join(won, keys, "left")
            .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
            .drop("_n", "_s", "_v", "_sure", "_most", "_won"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """Add ``src`` (rank by code point, null last) and ``target`` to (source, source_size, ...).

    A target is the weight's share of all words, at most ``cap`` times the source's size; what a cap leaves goes
    to the others by weight until none is above. That is one water level: in order of cap / weight, the level if
    all before are capped decides whether the next one is.
    """
    every = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (sizes.withColumn("src", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())).cast("long"))
              .withColumn("_w", F.element_at(cycle, ((F.col("src") - 1) % len(weights) + 1).cast("int")))
              .withColumn("_cap", (F.col("source_size") * cap).cast("double"))
              .withColumn("_total", F.sum("source_size").over(every).cast("double")))
    fill = every.orderBy(F.col("_cap") / F.col("_w"), "src")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    return (ranked.withColumn("_level", level)
            .withColumn("_place", F.row_number().over(fill))
            .withColumn("_level", F.min(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"),
                                               F.struct("_place", "_level"))).over(every)["_level"])
            .withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap")))
            .drop("_w", "_cap", "_total", "_level", "_place"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS,
         block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED):
    """(source table, shard table) from rows with ``source``, ``size`` and ``row_hash``.

    Source table: source, src, source_size, target, n_shards. Shard table: src, shard, shard_words, quota (blocks).
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = source_targets(sizes, weights, cap).withColumn(
        "n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words),
                               F.ceil(F.col("n_docs") / SHARD_DOCS)).cast("long"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    sources = stored(apportion(sources, "target", F.rint(total / block_words), [], ["src"])
                     .select("source", "src", "source_size", "target", "n_shards", "quota"), "sources")
    shards = (_with_shard(sized.select("source", "size", "row_hash"), sources, seed)
              .groupBy("src", "shard", F.col("quota").alias("of_source"))
              .agg(F.sum("size").alias("shard_words")))
    shards = apportion(shards, "shard_words", F.col("of_source"), ["src"], ["src", "shard"]).drop("of_source")
    return sources.drop("quota"), stored(shards.select("src", "shard", "shard_words", "quota"), "shards")


def _with_shard(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    named = sources.withColumnRenamed("source", "_source")
    return (rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source")
            .withColumn("shard", F.pmod(F.xxhash64("row_hash", F.lit(seed)), F.col("n_shards"))))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED, planned: DataFrame | None = None) -> DataFrame:
    """Add source_size, target, taken and ``head`` to rows that hold ``source``, ``size`` and ``row_hash``.

    ``taken`` is the number of the row's words in the mix, repeats counted, never above ``cap`` times its size.
    ``head`` tells whether a partial repeat takes the row's first words (else its last). ``row_hash`` orders rows:
    equal rows may swap places, which changes nothing but which of them is the partial one. ``planned`` may hold
    the same rows without their texts. Null sources are a source of their own; rows without words take none.
    """
    sources, shards = plan(rows if planned is None else planned, weights, cap, block_words, shard_words, seed)
    order = Window.partitionBy("src", "shard").orderBy(F.xxhash64("row_hash", F.lit(seed + 1)), "row_hash", "size")
    at = F.col("_at")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_words") / block_words))
    quota = F.least(F.col("quota"), cap * n_blocks)
    passes, rest = F.floor(quota / n_blocks), quota % n_blocks
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "src", "shard"), n_blocks)
    lo = first * block_words
    hi = F.least((first + rest) * block_words, F.col("shard_words"))
    wrap = F.greatest(F.lit(0), first + rest - n_blocks) * block_words

    def overlap(a, b):
        return F.greatest(F.lit(0), F.least(at + F.col("size"), b) - F.greatest(at, a))

    part = F.when(rest > 0, overlap(lo, hi) + overlap(F.lit(0), wrap)).otherwise(0)
    return (_with_shard(rows, sources, seed).join(shards, ["src", "shard"])
            .withColumn("_at", F.sum("size").over(order) - F.col("size"))
            .withColumn("taken", F.when(F.col("size") > 0, passes * F.col("size") + part).otherwise(0).cast("long"))
            .withColumn("head", (at >= lo) & (at < hi) | (at < wrap))
            .drop("_at", "src", "shard", "shard_words", "quota", "n_shards"))


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, row_hash) of every row: what the mix needs to know of it."""
    return docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"),
                       n_words(quoted(text_col).cast("string")).alias("size"),
                       F.xxhash64(quoted(id_col), quoted(text_col)).alias("row_hash"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (and source).

    Null and wordless texts have size 0 and take nothing, repeated rows count each, an empty table gives no rows.
    """
    slim = stored(prepared(docs), "sizes")
    return mix(slim, **options).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
            **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every row as often as it is taken.

    Whole repeats keep their text. A partial one holds the taken words, joined by single spaces. Null and wordless texts
    are never taken; an empty table stays empty.
    """
    slim = stored(prepared(docs, id_col, text_col, source_col), "sizes")
    whole = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"),
                        quoted(source_col).cast("string").alias("source"),
                        n_words(quoted(text_col).cast("string")).alias("size"),
                        F.xxhash64(quoted(id_col), quoted(text_col)).alias("row_hash"))
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    taken = (mix(whole, planned=slim, **options).where(F.col("taken") > 0)
             .withColumn("_rest", rest.cast("int"))
             .withColumn("_copy", F.explode(F.sequence(F.lit(1), times.cast("int")))))
    words = F.regexp_extract_all(F.col("_row")[text_col].cast("string"), F.lit(WORD), F.lit(0))
    some = F.when(F.col("head"), F.slice(words, F.lit(1), F.col("_rest"))).otherwise(
        F.slice(words, F.size(words) - F.col("_rest") + 1, F.col("_rest")))
    partial = (F.col("_copy") == times) & (F.col("_rest") > 0)
    text = F.when(partial, F.array_join(some, " ")).otherwise(F.col("_row")[text_col])
    return taken.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
