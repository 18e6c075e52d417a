"""Mixing sources to target weights.

Targets: the mix holds a given share of all words; sources get it by weight,
no source more than a given number of times its own size, and what a capped
source cannot take is shared again by weight among the others.  Inside a
source, whole epochs are taken first; the rest is a weighted sample without
replacement after Efraimidis and Spirakis: each document gets the key
-ln(u) / quality, documents are taken in the order of their keys, and a prefix
sum of sizes stops at the source's remaining budget.

The prefix sum never gathers a source in one task.  Keys are integers of 60
bits; a source's sizes are summed over ranges of their leading bits, and the
range in which its budget ends is divided again until few rows are left in it,
which alone are sorted.  Weights are at most 1, so no interval of width w holds
more than w of a source's rows, in expectation, whatever the weights are: the
last ranges, of width 2**-30, hold one row in a thousand million.  Only
DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import scratch

BITS = 44  # of a key behind the binary point
SHIFTS = (38, 26, 14)  # of keys to ranges, from coarse to fine
EDGE = 4096  # rows of a range that need not be divided again
WORD = r"[^\x20\x09-\x0D]+"


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(c: Column) -> Column:
    """A document's sampling weight in (0, 1]: 1 without symbols, falling as #*$%&|<> take over the text."""
    body = F.coalesce(c, F.lit(""))
    symbols = F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))
    return 1 / (1 + 20 * symbols / F.greatest(F.length(body), F.lit(1)))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: sizes has one row per source (a table of sources, not of documents).

    Sources are ordered by code point, null last, and take the weights in turn.
    """
    if share > cap:
        raise ValueError("the mix cannot be larger than every source's cap")
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    # Sources are capped in the order of most / w, as the level of words per weight rises.
    rise = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    upto, everything = rise.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.select("*", F.coalesce(F.sum("most").over(upto), F.lit(0.0)).alias("full"), F.coalesce(F.sum("w").over(upto), F.lit(0.0)).alias("w_full"), (F.sum("source_size").over(everything) * float(share)).alias("total"), F.sum("w").over(everything).alias("w_all"), F.row_number().over(rise).alias("turn"))
    level = (F.col("total") - F.col("full")) / (F.col("w_all") - F.col("w_full"))
    # The level stands where the first source is reached that is not full; if all are full, above all.
    s = s.withColumn("level", F.when(level * F.col("w") <= F.col("most"), F.struct("turn", level.alias("level"))))
    level = F.coalesce(F.min("level").over(everything)["level"], F.lit(float("inf")))
    return s.select("source", "source_size", F.least(level * F.col("w"), F.col("most")).alias("target"))


def key_of(seed: int, doc_id: Column, weight: Column) -> Column:
    """The sampling key of a document as an integer: u comes from 52 bits of an md5 of the seed and the id, so other engines can draw it too."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    least = 1 / 1024
    weight = F.greatest(F.least(F.coalesce(weight.cast("double"), F.lit(least)), F.lit(1.0)), F.lit(least))
    return F.floor(-F.log(u) / weight * float(1 << BITS))


def _end(ranges: DataFrame, first: Column) -> DataFrame:
    """source, range, n, start, budget: by source the first range (of rows source, range, size, n, budget) that does not fit as a whole."""
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    steps = ranges.select("source", "range", "size", "n", "budget", (first + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("start"))
    over = steps.where(F.col("start") + F.col("size") > F.col("budget"))
    return over.groupBy("source").agg(F.min(F.struct("range", "n", "start", "budget")).alias("end")).select("source", "end.*")


def _plan(rows: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target, epochs and cut for each source of rows (doc_id, source, size, key).

    After the epochs the mix takes the documents whose (key, doc_id, size) is
    below cut; a null cut takes all that are left.
    """
    shift = SHIFTS[0]
    sizes = scratch.table(rows.groupBy("source", F.shiftright("key", shift).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mixing-ranges")
    by_source = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    by_source = by_source.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.col("target"), F.col("source_size")))).otherwise(0).cast("long"))
    by_source = scratch.table(by_source.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mixing-sources")
    s, t = sizes.alias("s"), by_source.alias("t")
    ends = scratch.table(_end(s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.budget"), F.lit(0)), "mixing-ends")

    def inside() -> DataFrame:
        r, e = rows.alias("r"), ends.alias("e")
        here = F.col("r.source").eqNullSafe(F.col("e.source")) & (F.shiftright("r.key", shift) == F.col("e.range"))
        return r.join(e, here).select("r.*", "e.start", "e.budget")

    for finer in SHIFTS[1:]:
        if (ends.agg(F.max("n")).first()[0] or 0) <= EDGE:
            break
        ranges = inside().groupBy("source", F.shiftright("key", finer).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("start").alias("first"), F.max("budget").alias("budget"))
        ends, shift = scratch.table(_end(ranges, F.col("first")), "mixing-ends"), finer
    # Rows that agree in all that orders them are one.
    edge = inside().groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n"), F.max("start").alias("start"), F.max("budget").alias("budget"))
    before = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0))
    # The document in which the budget ends is in when half of it fits.
    edge = edge.withColumn("out", begun + F.col("size") * (F.col("n") - 0.5) > F.col("budget"))
    cuts = edge.groupBy("source").agg(F.min(F.when(F.col("out"), F.struct("key", "doc_id", "size"))).alias("cut"), F.max(F.struct("key", "doc_id", "size")).alias("top"))
    # A range of which all documents are in still ends the sample.
    past = F.struct(F.col("top.key").alias("key"), F.col("top.doc_id").alias("doc_id"), (F.col("top.size") + 1).alias("size"))
    cuts = cuts.select("source", F.coalesce("cut", past).alias("cut"))
    b, c = by_source.alias("b"), cuts.alias("c")
    planned = b.join(c, F.col("b.source").eqNullSafe(F.col("c.source")), "left").select("b.source", "b.source_size", "b.target", "b.epochs", "c.cut")
    return scratch.table(planned, "mixing-plan")


def _selected(key: Column, doc_id: Column, size: Column, plan: DataFrame) -> Column:
    return plan["cut"].isNull() & (plan["epochs"] * plan["source_size"] < plan["target"]) | F.coalesce(F.struct(key.alias("key"), doc_id.alias("doc_id"), size.alias("size")) < plan["cut"], F.lit(False))


def _rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, quality: Column | None) -> DataFrame:
    key = key_of(seed, docs[id_col], quality_weight(docs[text_col]) if quality is None else quality)
    return scratch.table(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), key.alias("key")), "mixing")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of docs.

    copies counts how often the mix has the document, taken its words in it.
    quality is a document's sampling weight, held within [1/1024, 1] (null is
    the least); the default is quality_weight of the text, taken whole.  A null
    text has size 0; a null source is a source, the last one.  Rows with equal
    ids have equal draws and are told apart by weight and size only, so the
    result is the same in every run.  An empty table gives no rows; other
    columns of docs, whatever their names, take no part.
    """
    rows = _rows(docs, seed, id_col, text_col, source_col, quality)
    plan = _plan(rows, weights, share, cap)
    copies = plan["epochs"] + _selected(rows["key"], rows["doc_id"], rows["size"], plan).cast("long")
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["source"]), "left")
    return joined.select("doc_id", rows["source"], "size", "source_size", "target", copies.alias("copies"), (copies * rows["size"]).alias("taken"))


def sample(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
) -> DataFrame:
    """The mix itself: the rows of docs, with docs' columns, each as often as the mix has it.

    Parameters and odd rows are as in mix; columns may have any names.
    """
    p = scratch.unused(docs, "_quarry_m_")
    plan = _plan(_rows(docs, seed, id_col, text_col, source_col, quality), weights, share, cap)
    key = key_of(seed, docs[id_col], quality_weight(docs[text_col]) if quality is None else quality)
    copies = plan["epochs"] + _selected(key, docs[id_col], word_count(docs[text_col]), plan).cast("long")
    columns = [docs[c] for c in docs.columns]
    joined = docs.join(plan, docs[source_col].eqNullSafe(plan["source"]), "left").select(*columns, copies.alias(p + "copies")).where(F.col(p + "copies") > 0)
    return joined.withColumn(p + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(p + "copies")))).select(*docs.columns)
