"""Language ID by rank-order profiles.

Method: a profile is the most frequent letter n-grams (1 to 3 letters, words
padded by a boundary), ranked.  A document goes to the language whose profile
its own is nearest to, by the sum of how far each n-gram is out of place.

Profiles are learned from at most ``BOUND`` documents a language, chosen by a
hash of doc_id; counts are summed before any shuffle.

Defined results: ``und`` with score 0 where a text is null or has no letter,
or nothing was learned; ties go to the language first in order; rows that share
a doc_id are predicted each; a very long text is one row, whose n-grams a task
holds; an empty table gives an empty one; other columns, whatever their names,
are ignored or carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import in_training, plain_names, small_batches

#: Documents a language at most that profiles are learned from.
BOUND = 4000
#: N-grams in a profile.
LENGTH = 300
#: Languages whose counts are broadcast at most; more are joined by a shuffle.
LANGUAGES = 10_000
UNKNOWN = "und"

_EDGE = 0x1FFFFF
_letters: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "all" not in _letters:
        _letters["all"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters["all"]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as integers in order, and their counts."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[code]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.where(letter, code, _EDGE)
    keep = np.ones(len(s), bool)
    keep[1:] = letter[1:] | letter[:-1]
    s = s[keep]
    s = np.concatenate(([_EDGE] if s[0] != _EDGE else [], s, [_EDGE] if s[-1] != _EDGE else [])).astype(np.int64)
    one = s[s != _EDGE]
    two = s[:-1] << 21 | s[1:]
    three = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[s[1:-1] != _EDGE]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(value: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts in order of the n-grams."""
    if len(n) > length:
        least = np.partition(n, len(n) - length)[len(n) - length]
        value, n = value[n >= least], n[n >= least]
    return value[np.lexsort((value, -n))][:length]


def _counts(batches):
    for b in batches:
        langs, text = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lang in set(langs):
            got = [grams(t) for t, k in zip(text, langs, strict=True) if k == lang]
            value, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            n = np.bincount(at, np.concatenate([g[1] for g in got]), len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value), pa.array(n)], ["lang", "gram", "n"])


def profiles(docs: DataFrame, bound: int = BOUND, length: int = LENGTH) -> dict[str, np.ndarray]:
    """The profile of each language of the training rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    many = rows.groupBy("lang").agg(F.count("*").alias("of"))
    few = many.limit(LANGUAGES + 1).collect()
    if len(few) <= LANGUAGES:  # so that no text is shuffled to be sampled
        many = F.broadcast(docs.sparkSession.createDataFrame(few, many.schema))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000 * bound) / F.col("of")
    rows = rows.join(many, "lang").where(share).select("lang", "text") if bound else rows
    counted = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("place", place).where(F.col("place") <= length).select("lang", "gram", "place").toArrow().to_pylist()
    out: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in sorted(out.items())}


def distances(own: np.ndarray, known: list[tuple[str, np.ndarray, np.ndarray]], length: int) -> list[float]:
    """The out-of-place distance to each language, over the greatest possible."""
    place, out = np.arange(len(own)), []
    for _, value, rank in known:
        at = np.minimum(np.searchsorted(value, own), len(value) - 1)
        out.append(float(np.where(value[at] == own, np.minimum(np.abs(rank[at] - place), length), length).sum()) / (length * len(own)))
    return out


def identify(docs: DataFrame, learned: dict[str, np.ndarray], length: int = LENGTH, names: list[str] | None = None) -> DataFrame:
    """The chosen columns with lang_pred and score."""
    names = names or ["doc_id"]
    known = []
    for lang, grams_ in learned.items():
        by = np.argsort(grams_)
        known.append((lang, grams_[by], by))

    def work(batches):
        for b in batches:
            pred, score = [], []
            for text in b.column("__text").to_pylist():
                value, n = grams(text)
                if not len(value) or not known:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                d = distances(ranked(value, n, length), known, length)
                best = int(np.argmin(d))
                pred.append(known[best][0])
                score.append(1 - d[best])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    chosen = docs.select(*(F.col(f"`{c}`") for c in names), F.col("text").cast("string").alias("__text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in names)).schema
    return chosen.mapInArrow(work, schema.add("lang_pred", "string").add("score", "double"))


def language_id(docs: DataFrame, bound: int = BOUND, length: int = LENGTH) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    out = identify(docs.withColumn("doc_id", F.col("doc_id").cast("long")), profiles(docs, bound, length), length)
    return out.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, bound: int = BOUND, length: int = LENGTH) -> DataFrame:
    """The documents whose language can be told."""
    own = plain_names(docs, "lang")
    return identify(own, profiles(own, bound, length), length, own.columns).where(F.col("lang_pred") != UNKNOWN).select(own.columns).toDF(*docs.columns)
