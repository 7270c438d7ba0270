"""Mixing sources to target weights.

Method: each row gets a hash-random key (md5 of seed, doc_id and text); rows
are range-sorted by source and key, distributed prefix sums of the sizes are
taken, and each source is cut at its exact budget.  A budget of more than the
source's size takes whole epochs first.  The cut goes through a document: its
first words count.  Only ids, sizes and keys are sorted; texts stay where they
are, unless ``mixed`` is asked for the texts themselves.

Targets are a filling of water: each source gets its weight's share of the
whole, up to ``most`` times its size, and the excess is reshared by weight.
The sources are ordered by the share at which they are full, and prefix sums
say which of them are.

Defined results: a null or empty text has size 0 and takes nothing; a null
source is a source, the last; rows of no size give a source the target 0; a
very long text is cut like others; equal rows are rows of their own, and as
they tie, which of them is cut shows in no column; an empty table gives an empty
one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, small_batches, written
from .prefix_sums import prefix_sums

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size and target, of a table of sources and their sizes; ``weights`` go round the sources by code point, null last."""
    weights = F.array(*(F.lit(float(w)) for w in weights)), len(weights)
    numbered = prefix_sums(sizes.withColumn("one", F.lit(1).cast("long")), None, [F.col("source").isNull(), "source"], ["one"])
    full = numbered.select("source", "source_size", (F.col("source_size") * F.lit(float(most))).alias("cap"), F.element_at(weights[0], (F.col("before_one") % weights[1] + 1).cast("int")).alias("weight"))
    full = prefix_sums(full.withColumn("level", F.col("cap") / F.col("weight")), None, ["level", F.col("source").isNull(), "source"], ["cap", "weight"])
    full = written(full)
    all_ = full.agg(F.sum("weight").alias("weight"), (F.sum("source_size") * F.lit(float(share))).alias("size")).first()
    # what all sources take when the water stands as high as this one is full
    at_level = F.col("before_cap") + F.col("cap") + F.col("level") * (F.lit(all_.weight) - F.col("before_weight") - F.col("weight"))
    full = full.withColumn("is_full", at_level <= F.lit(all_.size))
    level = full.where("not is_full").agg(F.sum("weight").alias("weight")).first()
    rest = full.where("is_full").agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("cap")).first()
    share_of = F.least(F.col("cap"), F.lit((all_.size or 0.0) - rest.cap) * F.col("weight") / F.lit(level.weight))
    return full.select("source", "source_size", F.when(F.col("is_full"), F.col("cap")).otherwise(share_of).alias("target"))


def _mix(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, keep: bool) -> DataFrame:
    """doc_id, source, size, key, and what the mix takes: whole epochs and the words of the last one; ``keep``: the text too."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    sized = written(rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), *(["text"] if keep else [])))
    sizes = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = written(targets(sizes, weights, share, most).select(F.col("source").alias("__source"), "source_size", "target"))
    sorted_ = prefix_sums(sized, "source", ["key", "doc_id", "size"], ["size"])
    discard(sized, sizes)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    out = sorted_.join(goal, F.col("source").eqNullSafe(F.col("__source"))).withColumn("epochs", epochs.cast("long"))
    cut = F.least("size", F.greatest(F.lit(0).cast("long"), budget - F.col("epochs") * F.col("source_size") - F.col("before_size")))
    return out.withColumn("cut", cut.cast("long"))


def mixing(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target of its source, and ``taken``: the words that the mix takes of it, repeats counted; and ``epochs``, how often it is taken whole."""
    return _mix(docs, weights, share, most, seed, False).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), "epochs")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """The mix itself: doc_id, source, epoch and text, a row for each time a document is taken; of a cut one its first words, joined by spaces.

    The texts are sorted along with the keys, so each source comes in random order.
    """
    each = _mix(docs, weights, share, most, seed, True).where("size > 0 and (epochs > 0 or cut > 0)")
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - (F.col("cut") == 0).cast("long"))))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("cut").cast("int")), " ")
    return each.select("doc_id", "source", "epoch", F.when((F.col("epoch") < F.col("epochs")) | (F.col("cut") == F.col("size")), F.col("text")).otherwise(part).alias("text"))
