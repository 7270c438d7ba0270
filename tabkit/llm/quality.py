"""Quality classifier: a sparse ensemble of rules over text statistics.

Method: small boosted trees are grown on statistics of labelled texts; every
path from a root is a conjunctive rule; a logistic model with an L1 penalty
weighs the rules, most get weight 0, and the rest are compiled into one Spark
column expression over the statistics.

At most ``BOUND`` labelled rows, chosen by a hash of doc_id, are learned from;
labels are read only of training rows (crc32 of doc_id modulo 5 is not 0).

Defined results: a null text has the statistics of an empty one; with no
labels, or one class only, the score is the mean label (0.5 without labels);
documents with several labels count by their mean, and rows that share a doc_id
are learned from each; a very long text is one row, which a task holds; an empty
table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import in_training, texts
from .textbytes import SPACE_WORD, Texts, Words, texts_of

#: Labelled rows at most that rules are learned from.
BOUND = 20_000
THRESHOLD = 0.3

STATISTICS = ["log_bytes", "log_words", "word_length", "upper", "digit", "blank", "wide", "bang", "pipe", "symbol", "stop", "comma", "distinct", "echo", "long_words", "lines", "line_echo"]
_CLASSES = {"upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "blank": [0x20, 0x0A, 0x09], "wide": range(0x80, 0x100), "bang": b"!", "pipe": b"|", "symbol": b"#$%&*+<=>@[\\]^_`{}~/", "stop": b".?", "comma": b",;:"}


def statistics(t: Texts) -> np.ndarray:
    """One row a text."""
    off = t.off
    size = np.maximum(np.diff(off), 1)
    code = np.zeros(256, np.uint8)
    for k, (_, chars) in enumerate(_CLASSES.items(), 1):
        code[list(chars)] = k
    kinds = len(_CLASSES) + 1
    doc = np.repeat(np.arange(len(t), dtype=np.int32) * kinds, np.diff(off))
    counts = np.bincount(doc + code[t.data], minlength=len(t) * kinds).reshape(len(t), kinds)[:, 1:]
    w = Words(t, SPACE_WORD, False)
    n = np.diff(w.off)
    many, of, h, length = np.maximum(n, 1), w.doc(), w.hashes(), w.end - w.start
    by = np.lexsort((h, of))
    new = np.ones(len(by), bool)
    new[1:] = (of[by][1:] != of[by][:-1]) | (h[by][1:] != h[by][:-1])
    distinct = np.bincount(of[by][new], minlength=len(t))
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    lines = [t.bytes(i).split(b"\n") for i in range(len(t))]
    line_n = np.array([len(x) for x in lines])
    line_distinct = np.array([len(set(x)) for x in lines])
    out = np.empty((len(t), len(STATISTICS)))
    out[:, 0], out[:, 1] = np.log1p(np.diff(off)), np.log1p(n)
    out[:, 2] = np.bincount(of, length, len(t)) / many
    out[:, 3:12] = counts / size[:, None]
    out[:, 12] = distinct / many
    out[:, 13] = np.bincount(of, echo, len(t)) / many
    out[:, 14] = np.bincount(of, length > 16, len(t)) / many
    out[:, 15] = line_n / many
    out[:, 16] = 1 - line_distinct / line_n
    return out


def _statistics(batches):
    for b in batches:
        for t in texts_of(b.column("text")):
            x = statistics(t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(t.first, len(t)), *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["doc_id", *STATISTICS])


def with_statistics(docs: DataFrame) -> DataFrame:
    return texts(docs).mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{k} double" for k in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, bound)."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for at, above, bound in self.parts:
            ok &= (x[:, at] > bound) == above
        return ok

    def column(self) -> F.Column:
        out = F.lit(True)
        for at, above, bound in self.parts:
            c = F.col(STATISTICS[at])
            out = out & (c > bound if above else c <= bound)
        return out


def _grow(bins, edges, grad, hess, rows, depth, path, rules, step):
    """Split rows by the best bound of a statistic; returns the leaf values by row."""
    value = np.zeros(len(grad))
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        for f in range(bins.shape[1]):
            gs = np.cumsum(np.bincount(bins[rows, f], grad[rows], len(edges[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, f], hess[rows], len(edges[f]) + 1))[:-1]
            if len(gs):
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(hs < 1) | (h - hs < 1)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        value[rows] = -step * g / (h + 1)
        return value
    f, k = best[1]
    above = bins[rows, f] > k
    for side in (False, True):
        parts = (*path, (f, side, float(edges[f][k])))
        rules.setdefault(Rule(parts), None)
        value += _grow(bins, edges, grad, hess, rows[above == side], depth - 1, parts, rules, step)
    return value


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, penalty: float = 0.001) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the rules with their weights."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if len(y) < 20 or y.min() == y.max():
        return base, []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    z, rules = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        z += _grow(bins, edges, p - y, p * (1 - p), np.arange(len(y)), depth, (), rules, 0.3)
    rules = list(rules)
    r = np.stack([k.holds(x) for k in rules], axis=1).astype(float)
    scale = np.maximum(r.std(axis=0), 1e-3)
    centre = r.mean(axis=0)
    a = (r - centre) / scale
    w = v = np.zeros(a.shape[1])
    b, t = base, 1.0
    u = np.random.default_rng(0).normal(size=a.shape[1])
    for _ in range(30):
        u = a.T @ (a @ (u / np.linalg.norm(u))) / len(y)
    rate = 1 / (0.25 * np.linalg.norm(u) + 0.25)
    for _ in range(400):  # accelerated proximal steps
        p = 1 / (1 + np.exp(-(a @ v + b)))
        new = v - rate * (a.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        b -= (p - y).mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    kept = np.flatnonzero(w)
    return b - float((w * centre / scale).sum()), [(rules[i], float(w[i] / scale[i])) for i in kept]


def compiled(model: tuple[float, list[tuple[Rule, float]]]) -> F.Column:
    """The score as one column expression."""
    z = F.lit(model[0])
    for rule, weight in model[1]:
        z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def learned(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> tuple[float, list[tuple[Rule, float]]]:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(in_training() & F.col("y").isNotNull())
    of = rows.count()
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * bound / max(of, 1))
    rows = rows.groupBy("doc_id").agg(F.avg("y").alias("y"))
    own = texts(docs).join(F.broadcast(rows), "doc_id")  # bounded by the sample
    got = with_statistics(own).join(F.broadcast(rows), "doc_id").toArrow().sort_by([("doc_id", "ascending"), *((k, "ascending") for k in STATISTICS)])
    if not len(got):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return fit(np.stack([got[k].to_numpy() for k in STATISTICS], axis=1), (got["y"].to_numpy() >= 0.5).astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    score = compiled(learned(docs, labels, bound))
    out = with_statistics(docs).select("doc_id", score.alias("score"))
    return out.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
