"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with native DataFrame operations.

Every document gets an exponential key scaled by its quality; within a source the keys are sorted and the
sizes prefix-summed up to the source's budget.  Whole epochs come first, the sampled part after them.

What the sample takes of a source is a run from the smallest key up to a last one, so only that last key has
to be found: sums over BINS ranges of the key tell the range where the budget ends, sums over BINS parts of
that range tell the part, and only the documents of that part are sorted.  So a source that holds a third of
all rows is never sorted in one task, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD_PATTERN, materialize, small_side, text_or_empty, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = "mix-1"
#: Ranges of the key, and parts of a range; a power of two, so that they begin at exact numbers.
BINS = 1 << 10


def quality_weight(text: Column) -> Column:
    """0.5 to 1.5: half, and the share of letters and white space among a text's characters."""
    length = F.length(text)
    odd = F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    return F.when(length > 0, F.lit(1.5) - odd / length).otherwise(F.lit(0.5))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) for (source, source_size): one row a source, so these windows stay small.

    Weights repeat over the sources in code point order, null last.  Sources sorted by cap over weight are
    filled in turn: those under the common level get their cap, the rest share what is left by weight.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = ranked.withColumn("weight", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(
        order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    filled = ranked.withColumn("level", level).withColumn("full", F.col("cap") < F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return filled.withColumn("final", final).select(
        "source", "source_size", F.when(F.col("full") | F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target")
    )


def sample_key(doc_id: Column, text: Column, seed: str) -> Column:
    """1 - exp(-e) for the exponential key e of a document: 0 to 1, small for what the sample takes first."""
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return F.lit(1.0) - F.exp(F.log(draw) / quality_weight(text))


def _name(source: Column) -> Column:
    """A name that is never null: sources by '+', the null source '-'."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _end(sums: DataFrame, budget: DataFrame) -> DataFrame:
    """Of (name, bin, words) the bin of each name in which the rest of its budget ends, and what lies before it."""
    before = Window.partitionBy("name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows a name
    placed = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(small_side(budget, "budget"), "name")
    ends = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    return placed.where(ends).select("name", "bin", (F.col("rest") - F.col("before")).alias("rest"))


def _plan(base: DataFrame, weights, max_repeats: int, bins: int) -> DataFrame:
    """(name, source_size, target, epochs, below, last): one row a source.

    The sample takes documents whose key is under ``below``, and those up to ``last``, a (key, doc_id).
    """
    wide = F.floor(F.col("key") * bins).cast("int")
    fine = F.floor(F.col("key") * (bins * bins)).cast("int") % bins
    sums = materialize(base.groupBy("name", wide.alias("bin")).agg(F.first("source").alias("source"), F.sum("size").alias("words")), "ranges")
    sizes = sums.groupBy("name").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, max_repeats)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    targets = targets.select(_name(F.col("source")).alias("name"), "source_size", "target", epochs.alias("epochs"))
    targets = materialize(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    first = small_side(_end(sums.select("name", "bin", "words"), targets.select("name", "rest")).withColumnRenamed("bin", "wide"), "first")
    inside = base.join(first, "name").where(wide == F.col("wide"))
    parts = inside.groupBy("name", fine.alias("bin")).agg(F.sum("size").alias("words"))
    second = _end(parts, first.select("name", "rest")).withColumnRenamed("bin", "fine")
    second = small_side(second.join(first.select("name", "wide"), "name"), "second")
    # documents with equal key and id (repeated rows) are taken together, so they count as one
    near = base.join(second, "name").where((wide == F.col("wide")) & (fine == F.col("fine")))
    near = near.groupBy("name", "key", "doc_id").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).where("words > 0")
    upto = F.sum("words").over(Window.partitionBy("name").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = near.withColumn("middle", upto - F.col("words") / 2).where("middle <= rest")
    last = taken.groupBy("name").agg(F.max(F.struct("key", "doc_id")).alias("last"))
    below = ((F.col("wide") * bins + F.col("fine")) / F.lit(float(bins * bins))).alias("below")
    ends = second.select("name", below).join(last, "name", "left")
    # a rest that rounding has put outside the source's words: nothing or all of it
    outside = F.when(F.col("rest") >= F.col("source_size"), F.lit(2.0)).otherwise(F.lit(0.0))
    return targets.join(ends, "name", "left").select("name", "source_size", "target", "epochs", F.coalesce("below", outside).alias("below"), "last")


def _copies(key: Column, doc_id: Column, size: Column) -> Column:
    """Whole passes of a document, on a row joined with its source's plan."""
    sampled = (key < F.col("below")) | F.coalesce(F.struct(key.alias("key"), doc_id.alias("doc_id")) <= F.col("last"), F.lit(False))
    return F.col("epochs") + ((size > 0) & sampled).cast("long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of ``docs``.

    size is the number of words, 0 for a null text.  copies is the number of whole passes a document gets:
    the complete epochs of its source, and one more if the sample takes it, which is the case while the
    middle of the document lies within the budget; so a source misses its target by half of one document at
    most.  Null sources form one source of their own.  Empty documents are repeated with the epochs and
    count nothing.  Rows with equal doc_id and text have equal keys and are taken together, and a source can
    miss its target by half of their sum.  Texts of any length are only counted and hashed.
    """
    doc_id = F.col("doc_id").cast("long")
    text = text_or_empty()
    rows = docs.select(doc_id.alias("doc_id"), "source", word_count(F.col("text")).alias("size"), sample_key(doc_id, text, seed).alias("key"))
    base = materialize(rows.withColumn("name", _name(F.col("source"))), "keys")
    plan = small_side(_plan(base, weights, max_repeats, bins), "plan")
    copies = _copies(F.col("key"), F.col("doc_id"), F.col("size"))
    return base.join(plan, "name").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """``docs`` with each row repeated as often as mix_sources takes it; columns of any name pass unchanged."""
    doc_id, text = F.col("row.doc_id").cast("long"), F.coalesce("row.text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.select("row", _name(F.col("row.source")).alias("name"), word_count(F.col("row.text")).alias("size"), sample_key(doc_id, text, seed).alias("key"))
    base = rows.select("name", F.col("row.source").alias("source"), doc_id.alias("doc_id"), "size", "key")
    plan = small_side(_plan(materialize(base, "keys"), weights, max_repeats, bins), "plan")
    # this second pass only asks whether there is a word
    has_word = F.coalesce(F.col("row.text").rlike(WORD_PATTERN), F.lit(False)).cast("long")
    copies = _copies(F.col("key"), doc_id, has_word)
    taken = rows.join(plan, "name").select("row", copies.cast("int").alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
