"""Line dedup over a suffix array of line ids, with DataFrame functions only.

Documents are read as sequences of line ids (lines without a word are passed over and stay).
Prefix doubling sorts the suffixes of all these sequences: the rank of a suffix by its first h
lines, paired with the rank of the suffix h lines further on, is its rank by 2h lines. Each round
is a count of the pairs, a range sort of the distinct pairs (rank = place in that order) and a join
back. A suffix whose first lines occur nowhere else leaves; rounds end when all have left, which is
when all ranks are unique, after about log2 of the longest repeat.

Suffixes of one rank at depth h are an interval of the suffix array whose longest common prefix is
h or more. In each interval at depth ``min_lines`` the first suffix, by (doc_id, position), is the
copy that stays. Every other one repeats it; where a repeat is not the next line of a repeat of the
same copy, a run begins. The run's length is the longest common prefix of the two suffixes, which
the ranks of all rounds give by halving: if both have the same rank at depth h, they go on h lines.
The runs are then maximal, and the lines that they cover are deleted.

A line that repeats alone, between neighbours that don't, is a run of one. It is deleted if it has ``min_words`` words or
more: shorter ones are mostly structure (headings, bylines, list marks) and stay.

Defined results: null texts stay null and lose no line; an empty text has no line with a word;
rows that repeat both id and text get the same answer and are not copies of each other; a null id
sorts before all ids; other columns are carried along whatever their names are; a text of any number of lines is one
sequence, and its lines are rows of which each is sorted and joined by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import WORD, drop, has_word, materialise, split_lines

KEY = ("_id", "_tie")
MIN_LINES, MIN_WORDS = 2, 20


def _ranked(pairs: DataFrame, *cols: str) -> DataFrame:
    """Distinct rows with ``rank``, which rises in the order of ``cols``; one range sort of distinct values, so no hot key."""
    ordered = pairs.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return materialise(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _same_row(left: DataFrame, right: DataFrame, at: Column, r_at: str) -> Column:
    """Join condition: the row (_id, _tie) of the left at position ``at`` is the right's row (r_id, r_tie) at ``r_at``."""
    return left["_id"].eqNullSafe(right["r_id"]) & (left["_tie"] == right["r_tie"]) & (at == right[r_at])


def _many_words(line: Column, min_words: int) -> Column:
    """Whether the line has ``min_words`` words; so many words have twice as many characters, less one."""
    return (F.length(line) >= 2 * min_words - 1) & (F.regexp_count(line, F.lit(WORD)) >= min_words)


def line_ranks(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Depth 1 of the suffix array: all lines that occur twice or more, (_id, _tie, pos, line, long, rank). pos counts lines with a word, line counts all."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_tie"), F.col(text).alias("_text"))
    numbered = F.transform(split_lines(F.col("_text")), lambda x, i: F.struct(i.alias("line"), x.alias("s")))
    lines = rows.select(*KEY, F.posexplode(F.filter(numbered, lambda x: has_word(x["s"]))).alias("pos", "x"))
    lines = lines.select(*KEY, "pos", "x.line", _many_words(F.col("x.s"), min_words).alias("long"), F.xxhash64("x.s").alias("a"), F.xxhash64(F.lit("second"), "x.s").alias("b"))
    lines = materialise(lines, "lines")
    names = _ranked(lines.groupBy("a", "b").count().filter("count > 1").select("a", "b"), "a", "b")
    repeated = materialise(lines.join(names, ["a", "b"]).select(*KEY, "pos", "line", "long", "rank").distinct(), "repeated")
    drop(lines, names)
    return repeated


def _deeper(suffixes: DataFrame, step: int) -> DataFrame:
    """From ranks at depth h to ranks at depth h + ``step`` (at most 2h) of the suffixes whose first so many lines occur elsewhere."""
    ahead = Window.partitionBy(*KEY).orderBy("pos").rangeBetween(step, step)
    pairs = suffixes.withColumn("next", F.max("rank").over(ahead)).filter("next is not null").withColumnRenamed("rank", "head")
    pairs = materialise(pairs, "pairs")
    names = _ranked(pairs.groupBy("head", "next").count().filter("count > 1").select("head", "next"), "head", "next")
    deeper = materialise(pairs.join(names, ["head", "next"]).select(*KEY, "pos", "rank"), "suffixes")
    drop(pairs, names)
    return deeper


def suffix_ranks(repeated: DataFrame) -> list[DataFrame]:
    """Tables (_id, _tie, pos, rank) of the suffixes whose first 1, 2, 4, ... lines occur elsewhere, until there are none."""
    levels = [repeated.select(*KEY, "pos", "rank")]
    while not (following := _deeper(levels[-1], 1 << (len(levels) - 1))).isEmpty():
        levels.append(following)
    drop(following)
    return levels


def _repeats(suffixes: DataFrame) -> DataFrame:
    """Suffixes that are not the first of their rank, with the first one: (_id, _tie, pos, e_id, e_tie, e_pos)."""
    first = suffixes.groupBy("rank").agg(F.min(F.struct(*KEY, "pos")).alias("e"))
    first = materialise(first.select("rank", F.col("e._id").alias("e_id"), F.col("e._tie").alias("e_tie"), F.col("e.pos").alias("e_pos")), "first")  # a table, so that the join can be split at hot ranks
    own = F.col("_id").eqNullSafe(F.col("e_id")) & (F.col("_tie") == F.col("e_tie")) & (F.col("pos") == F.col("e_pos"))
    return suffixes.join(first, "rank").filter(~own).select(*KEY, "pos", "e_id", "e_tie", "e_pos")


def maximal_runs(repeated: DataFrame, min_lines: int) -> DataFrame:
    """Maximal runs of ``min_lines`` lines or more that repeat an earlier place: (_id, _tie, pos, e_id, e_tie, e_pos, n).

    ``n`` is the longest common prefix of the two suffixes; (e_id, e_tie, e_pos) is the copy that stays.
    """
    levels = suffix_ranks(repeated)
    depth = 1 << (min(min_lines, 1 << (len(levels) - 1)).bit_length() - 1)  # the deepest table that is not beyond min_lines
    suffixes = levels[depth.bit_length() - 1]
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        suffixes, depth = _deeper(suffixes, step), depth + step
    repeats = materialise(_repeats(suffixes), "repeats")
    by_pos = Window.partitionBy(*KEY).orderBy("pos")
    before = F.lag(F.struct("e_id", "e_tie", (F.col("e_pos") + 1).alias("e_pos"), (F.col("pos") + 1).alias("pos"))).over(by_pos)
    goes_on = F.coalesce(before.eqNullSafe(F.struct("e_id", "e_tie", "e_pos", "pos")), F.lit(False))
    runs = materialise(repeats.withColumn("goes_on", goes_on).filter("not goes_on").drop("goes_on").withColumn("n", F.lit(min_lines)), "runs")
    drop(repeats)
    for k in reversed(range(len(levels))):
        at = levels[k].withColumnsRenamed({"_id": "r_id", "_tie": "r_tie", "pos": "r_pos"})
        here, there = at.withColumnRenamed("rank", "here"), at.withColumnsRenamed({"rank": "there", "r_id": "x_id", "r_tie": "x_tie", "r_pos": "x_pos"})
        met = runs.join(here, _same_row(runs, here, runs["pos"] + runs["n"], "r_pos"), "left").drop("r_id", "r_tie", "r_pos")
        copy = F.col("e_id").eqNullSafe(F.col("x_id")) & (F.col("e_tie") == F.col("x_tie")) & (F.col("e_pos") + F.col("n") == F.col("x_pos"))
        met = met.join(there, copy, "left")
        longer = F.when(F.col("here") == F.col("there"), F.col("n") + (1 << k)).otherwise(F.col("n")).cast("int")
        following = materialise(met.select(*KEY, "pos", "e_id", "e_tie", "e_pos", longer.alias("n")), "runs")
        drop(runs)
        runs = following
    drop(*levels[1:])
    return runs


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: (_id, _tie, pos, line), distinct; pos counts lines with a word, line counts all."""
    repeated = line_ranks(docs, min_words, doc_id, text)
    runs = maximal_runs(repeated, min_lines).select(*KEY, "pos", "n")
    alone = _repeats(repeated.filter("long").select(*KEY, "pos", "rank")).select(*KEY, "pos", F.lit(1).alias("n"))
    ends = runs.unionByName(alone).groupBy(*KEY, "pos").agg(F.max(F.col("pos") + F.col("n")).alias("end"))
    ends = materialise(ends, "ends").withColumnsRenamed({"_id": "r_id", "_tie": "r_tie", "pos": "r_pos"})
    lines = repeated.select(*KEY, "pos", "line")
    marked = lines.join(ends, _same_row(lines, ends, lines["pos"], "r_pos"), "left")
    reach = F.max("end").over(Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("reach", reach).filter("reach > pos").select(*KEY, "pos", "line")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The maximal repeated runs: doc_id, first and last line (counted from 0 among lines with a word), and where the copy that stays begins (kept_id, kept_line).

    Runs that repeat different places may overlap.
    """
    runs = maximal_runs(line_ranks(docs, MIN_WORDS, doc_id, text), min_lines)
    return runs.select(F.col("_id").alias(doc_id), F.col("pos").alias("first_line"), (F.col("pos") + F.col("n") - 1).alias("last_line"), F.col("e_id").alias("kept_id"), F.col("e_pos").alias("kept_line"))


def without_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``, and ``_emberlog_n_lines``, ``_emberlog_n_removed`` added."""
    gone = repeated_lines(docs, min_lines, doc_id, text, min_words).groupBy(*KEY).agg(F.collect_list("line").alias("_emberlog_gone"))
    gone = gone.withColumnsRenamed({"_id": "_emberlog_id", "_tie": "_emberlog_tie2"})
    rows = docs.withColumn("_emberlog_tie", F.xxhash64(F.col(text)))
    rows = rows.join(gone, rows[doc_id].eqNullSafe(gone["_emberlog_id"]) & (rows["_emberlog_tie"] == gone["_emberlog_tie2"]), "left")
    rows = rows.withColumn("_emberlog_lines", split_lines(F.col(text)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_emberlog_lines") - 1), F.col("_emberlog_gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col("_emberlog_lines"), i)), "\n")
    rows = rows.withColumn("_emberlog_n_lines", F.coalesce(F.size(F.filter("_emberlog_lines", has_word)), F.lit(0)).cast("long"))
    rows = rows.withColumn("_emberlog_n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.col("_emberlog_n_lines")).cast("long"))
    rows = rows.withColumn("_emberlog_n_removed", F.when(F.col("_emberlog_gone").isNull(), 0).otherwise(F.size("_emberlog_gone")).cast("long"))
    rows = rows.withColumn(text, F.when(F.col("_emberlog_gone").isNull(), F.col(text)).otherwise(left))
    return rows.select(*docs.columns, "_emberlog_n_lines", "_emberlog_n_removed")
