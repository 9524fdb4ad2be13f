"""Mixing sources to target weights, with DataFrame functions only.

The words of every source, in a fixed order of its documents, are packed into blocks of
``block_words``. The output is a row of shards with ``shard_slots`` slots each. For every shard
a multinomial draw over the sources (probabilities in proportion to their targets) says how many
slots each source fills; draws in excess of a source's target go to sources that came out short,
so that the totals are met exactly. A source's j-th slot takes block ``perm(j mod n)`` of its n
blocks, where ``perm`` is a pseudorandom permutation (swap-or-not shuffle) with a key for each
pass over the source. Slots and documents then meet in an equi-join on (source, block).

No step holds a source, or all sources, in one task: draws are counted by (shard, source), counts are summed over
spans of shards, and the slots are laid out and permuted after these few rows are dealt out by shard.

Defined results: null or wordless texts have size 0 and are never taken; a null source is a
source of its own, after all others; rows alike in id and text are documents of their own;
columns other than the three named are ignored; an empty table gives an empty result. A text of any length is counted
in one pass of a regular expression and travels no further in ``mix``; in ``mixed_blocks`` a document's words are an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import WORD, materialise, running

#: A document's words may be taken this many times at most, and so may a source's.
MAX_REPEATS = 3
#: Hash groups into which every source's documents are dealt to number their words without one task per source.
CHUNKS = 4096
#: Shards whose counts are summed in one window.
SPAN = 4096
#: Slots that a task lays out and permutes, about.
TASK_SLOTS = 1 << 18
ROUNDS = 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source") -> DataFrame:
    """One row per source: ``source``, ``pos`` (rank by code point, null last), ``source_size``, ``target``.

    Weights are 1, 2, 3, repeating. A target is ``min(3 x size, level x weight)`` for the one level at which
    targets sum to all sizes; that is what resharing the excess by weight until none is above ends in. Sorted by
    size over weight, the capped sources come first, and the level is the largest of the levels
    ``(total - caps before) / weights from here``.
    """
    src = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    src = running(src, [F.col("source").asc_nulls_last()], {}, rank="pos")
    src = src.withColumn("weight", F.col("pos") % 3 + 1).withColumn("cap", F.col("source_size") * MAX_REPEATS).withColumn("ratio", F.col("cap") / F.col("weight"))
    src = materialise(running(src, ["ratio", "pos"], {"cap": "caps_before", "weight": "weights_before"}), "ratios")
    total, weights = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = src.agg(F.max((F.lit(total) - F.col("caps_before")) / (F.lit(weights) - F.col("weights_before")))).first()[0] or 0.0
    return src.select("source", "pos", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def permute(df: DataFrame, x: str, n: str, key: str, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with column ``x`` (0..n-1) replaced by its place under a keyed permutation of 0..n-1, for any n (swap-or-not shuffle).

    A round is a projection of its own, so that all of them are compiled.
    """
    for r in range(rounds):
        partner = F.pmod(F.pmod(F.xxhash64(key, F.lit(r)), F.col(n)) - F.col(x), F.col(n))
        df = df.withColumn("_partner", partner)
        coin = F.xxhash64(key, F.lit(r), F.greatest(x, "_partner")).bitwiseAND(F.lit(1))
        df = df.withColumn(x, F.when(coin == 1, F.col("_partner")).otherwise(F.col(x)))
    return df.drop("_partner") if rounds else df


def _in_cells(intervals: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """The intervals [low, high) that are not empty, once for each cell of ``width`` that they meet."""
    last = F.floor((F.col(high) - 1) / width)
    return intervals.filter(F.col(high) > F.col(low)).withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / width), last)))


def _within(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, span: int, n: int) -> DataFrame:
    """Each point with the one interval of a row of ``n`` intervals over 0..span-1 that it lies in: an equi-join on cells.

    There are four cells an interval, so a cell meets 1.25 intervals in the mean, and cells are of equal width: no hot key.
    """
    width = max(1, -(-span // (4 * max(1, n))))
    met = points.withColumn("cell", F.floor(F.col(at) / width)).join(_in_cells(intervals, low, high, width), "cell")
    return met.filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("cell")


def draw_slots(sources: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """Every slot of the mix: ``shard``, ``pos`` (of its source), ``block``."""
    spark = sources.sparkSession
    ends = materialise(running(sources, ["pos"], {"slots": "low"}).withColumn("high", F.col("low") + F.col("slots")), "ends")
    n = ends.count()
    uniform = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(max(1, n_slots)))
    slot = spark.range(n_slots).select(F.floor(F.col("id") / shard_slots).alias("shard"), uniform.alias("u"))
    drawn = _within(slot, "u", ends.select("pos", "low", "high"), "low", "high", n_slots, n)
    counts = materialise(drawn.groupBy("shard", "pos").agg(F.count("*").alias("n")), "draws")

    sums = sources.select("pos", "slots", "n_blocks").join(counts.groupBy("pos").agg(F.sum("n").alias("drawn")), "pos", "left").fillna(0, ["drawn"])
    over, short = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    sums = running(sums.withColumn("over", over).withColumn("short", short), ["pos"], {"over": "over_before", "short": "short_low"})
    sums = materialise(sums.withColumn("short_high", F.col("short_low") + F.col("short")), "sums")
    n_over = sums.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]

    # A source's draws are numbered through its shards: first the spans of shards, then the shards of each span
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy("pos", F.floor(F.col("shard") / SPAN).alias("span")).agg(F.sum("n").alias("n"))
    spans = materialise(spans.select("pos", "span", F.coalesce(F.sum("n").over(before("pos").orderBy("span")), F.lit(0)).alias("span_first")), "spans")
    counts = counts.withColumn("span", F.floor(F.col("shard") / SPAN))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before("pos", "span").orderBy("shard")), F.lit(0))).join(spans, ["pos", "span"])
    firsts = materialise(counts.select("shard", "pos", "n", (F.col("first") + F.col("span_first")).alias("first")), "firsts")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_slots // TASK_SLOTS))
    filled = firsts.join(sums.select("pos", "slots", "over_before", "n_blocks"), "pos").repartition(tasks, "shard")
    filled = filled.withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    kept = filled.filter(F.col("j") < F.col("slots")).select("shard", "pos", "j", "n_blocks")
    excess = filled.filter(F.col("j") >= F.col("slots")).select("shard", (F.col("over_before") + F.col("j") - F.col("slots")).alias("e"))
    moved = _within(excess, "e", sums.select("pos", "n_blocks", "drawn", "short_low", "short_high"), "short_low", "short_high", n_over, n)
    moved = moved.select("shard", "pos", (F.col("drawn") + F.col("e") - F.col("short_low")).alias("j"), "n_blocks")
    slots = kept.unionByName(moved).withColumn("key", F.xxhash64(F.lit(seed), F.col("pos"), F.floor(F.col("j") / F.col("n_blocks"))))
    slots = permute(slots.withColumn("block", F.col("j") % F.col("n_blocks")), "block", "n_blocks", "key").select("shard", "pos", "block")
    return materialise(slots, "slots")  # a condition that a later join puts on block would be written out through all rounds


def place_words(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``pos`` and ``start``, the place of a document's first word in its source's stream, and the row's key (pos, chunk, ord).

    Documents are numbered within hash chunks of their source, and chunks within the source, so that no task holds a source.
    """
    in_chunk = Window.partitionBy("pos", "chunk").orderBy("doc_id", "tie", "size")
    placed = sizes.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(CHUNKS)))
    placed = placed.join(sources.select(F.col("source").alias("s_source"), "pos", "source_size", "target"), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    chunks = placed.groupBy("pos", "chunk").agg(F.sum("size").alias("words"))
    chunk_before = Window.partitionBy("pos").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("pos", "chunk", F.coalesce(F.sum("words").over(chunk_before), F.lit(0)).alias("chunk_start"))
    placed = placed.withColumn("ord", F.row_number().over(in_chunk))
    placed = placed.withColumn("start", F.sum("size").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(chunks, ["pos", "chunk"]).withColumn("start", F.col("start") + F.col("chunk_start")).drop("chunk_start")


def targets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the mix aims at, without drawing: ``doc_id, source, size, source_size, target``, one row per input row."""
    sizes = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    src = materialise(source_targets(sizes), "sources").withColumnRenamed("source", "s_source")
    return sizes.join(src, sizes["source"].eqNullSafe(src["s_source"])).select("doc_id", "source", "size", "source_size", "target")


def _plan(docs: DataFrame, block_words: int, shard_slots: int, seed: int, doc_id: str, text: str, source: str):
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie"))
    sizes = materialise(sizes, "sizes")
    src = source_targets(sizes).withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    src = src.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    src = materialise(src, "sources")
    n_slots = src.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    return sizes, src, draw_slots(src, n_slots, shard_slots, seed)


def mix(docs: DataFrame, *, block_words: int = 128, shard_slots: int = 1024, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How much of each document the mix takes: ``doc_id, source, size, source_size, target, taken``, one row per input row."""
    sizes, src, slots = _plan(docs, block_words, shard_slots, seed, doc_id, text, source)
    times = slots.groupBy("pos", "block").agg(F.count("*").alias("times"))
    b = F.lit(block_words)
    placed = place_words(sizes, src)
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)))))
    pieces = pieces.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b))
    row = ["pos", "chunk", "ord", "doc_id", "source", "size", "source_size", "target"]
    taken = pieces.join(times, ["pos", "block"], "left").groupBy(*row).agg(F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).cast("long").alias("taken"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, *, block_words: int = 128, shard_slots: int = 1024, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, for training: one row per slot with ``shard, source, block, text`` (the block's words, joined by a space)."""
    sizes, src, slots = _plan(docs, block_words, shard_slots, seed, doc_id, text, source)
    b = F.lit(block_words)
    placed = place_words(sizes, src).filter("size > 0")
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("t"), F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)).alias("w")).dropDuplicates(["d", "t"])
    with_words = placed.join(rows, placed["doc_id"].eqNullSafe(rows["d"]) & (placed["tie"] == rows["t"]))
    pieces = with_words.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    low, high = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    pieces = pieces.select("pos", "source", "block", "start", F.slice("w", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("w"))
    blocks = pieces.groupBy("pos", "source", "block").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "w"))), lambda p: p["w"])), " ").alias("text"))
    return slots.join(blocks, ["pos", "block"]).select("shard", "source", "block", "text")


__all__ = ["mix", "mixed_blocks", "permute", "source_targets", "targets", "word_count"]
