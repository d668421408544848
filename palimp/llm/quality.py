"""Quality classifier by hierarchical empirical Bayes: a document's own evidence, combined with what its host and path are like.

A logistic regression on a document's form (kinds of signs, repeated words and lines, word lengths) gives its evidence.
Grouped sums of those probabilities give each host a posterior that shrinks towards the global mean, and each path of a
host one that shrinks towards its host's; how strongly is estimated from the spread between groups (method of moments).
A document's log odds are its own plus the difference between its path's and the global log odds, its own share in the
group sums left out: its site's odds take the place of the global ones. Sums are combined before they are shuffled, so a
host with a third of all rows is no burden.

Every labelled row counts: four fifths, by a hash of the key, train the regression by Newton's method, whose gradient and
Hessian are sums over the tasks' rows; the good ones of the other fifth are all held against the threshold.

A document goes where it is more likely bad than good; if that took more than the part REJECT of the good rows that were
kept from training, the threshold is lowered to what takes that part. The threshold is set on the very scores that it
judges, site evidence included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimp.llm import textvec as tv
from palimp.llm.durable import durable, few_at_once, joined

#: One labelled row in so many, by a hash of the key, is kept from training; features of a row.
HELD, WIDTH = 5, 24
#: Labels that are few enough to be broadcast; beyond, features are joined to them, not texts.
FEW = 200_000
#: Part of the good calibration rows that may go.
REJECT = 0.002
#: Host and path of a document, where nothing else is said.
HOST, PATH = "source", "concat_ws('/', source, lang)"
#: Log odds beyond these say no more.
MOST_LOGIT = 12.0
LOWER, UPPER, DIGIT, BLANK, LINE, STOP, BAR, SIGN, HIGH = range(9)
KIND = np.full(256, SIGN)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = LOWER, UPPER, DIGIT, HIGH
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], KIND[0x0A] = BLANK, LINE
KIND[[ord(c) for c in ".,;:'-\"()?"]], KIND[ord("|")] = STOP, BAR
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


def features(buf: np.ndarray, offs: np.ndarray, powers: tv.Powers) -> np.ndarray:
    """A row of features for each text."""
    n = len(offs) - 1
    of = np.repeat(np.arange(n), np.diff(offs))
    kinds = np.bincount(of * 9 + KIND[buf], minlength=n * 9).reshape(n, 9).astype(float)
    size = np.maximum(kinds.sum(1), 1)
    solid = np.maximum(size - kinds[:, BLANK] - kinds[:, LINE], 1)

    def repeats(space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans, the part of them that equal the one before, and the part that is distinct."""
        starts, ends, first = tv.spans(buf, offs, space)
        count = np.diff(first)
        h = tv.hashes(buf, starts, ends, powers, tv.LOWER) if len(starts) else np.empty(0, tv.U)
        whose = np.repeat(np.arange(n), count)
        same = np.r_[False, (h[1:] == h[:-1]) & (whose[1:] == whose[:-1])][: len(h)]
        _, cut = tv.distinct(h, whose, n)
        some = np.maximum(count, 1)
        return count, np.bincount(whose, same, n) / some, np.where(count > 0, np.diff(cut) / some, 1.0)

    words, echo, fresh = repeats(tv.SPACE)
    lines, line_echo, line_fresh = repeats(NEWLINE)
    some = np.maximum(words, 1)
    out = [kinds[:, k] / solid for k in (UPPER, DIGIT, STOP, BAR, SIGN, HIGH)]
    out += [kinds[:, SIGN] / some, echo, line_echo, 1 - line_fresh, fresh - np.minimum(1.0, 2 / np.sqrt(some)), solid / some / 10, np.log1p(words) / 10, np.log1p(words / np.maximum(lines, 1)) / 5]
    x = np.stack(out, 1)
    # Small parts matter as much as large ones: the signs of a table or of spam are a tenth of its text.
    return np.c_[x, np.sqrt(np.maximum(x[:, :10], 0))]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    good: DataFrame | None = None  # __logit, __host and __path of all good rows that were kept from training

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds within their bounds, for any number of rows."""
        return np.clip(self.logits(x), -MOST_LOGIT, MOST_LOGIT) if len(x) else np.empty(0)


def matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a batch (x, y)."""
    return np.asarray(b.column(0).flatten()).reshape(-1, WIDTH), np.asarray(b.column(1)).astype(float)


def summed(rows: DataFrame, make) -> np.ndarray | None:
    """The sum of make(features, labels) over rows (x, y); each task gives one array of a fixed size. None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                made = make(*matrix(b))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    parts = [np.array(r["s"]) for r in rows.select("x", "y").mapInArrow(run, "s array<double>").collect()]
    return np.sum(parts, 0) if parts else None


def train(rows: DataFrame, *, ridge: float = 1e-3, steps: int = 60) -> Model | None:
    """Newton's method on rows (x, y), whose sums alone come to the driver. None without both labels."""
    found = summed(rows, lambda x, y: np.r_[len(x), y.sum(), x.sum(0), (x * x).sum(0)])
    if found is None or not 0 < found[1] < found[0]:
        return None
    n, mean = found[0], found[2 : 2 + WIDTH] / found[0]
    scale = np.maximum(np.sqrt(np.maximum(found[2 + WIDTH :] / n - mean**2, 0)), 1e-3)
    w = np.zeros(WIDTH + 1)
    keep = np.r_[np.full(WIDTH, ridge * n), 0]

    def at(w: np.ndarray):
        def gradient(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.r_[z.T @ (p - y), ((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).ravel()]

        return gradient

    for _ in range(steps):
        found = summed(rows, at(w))
        move = np.linalg.solve(found[WIDTH + 1 :].reshape(WIDTH + 1, -1) + np.diag(keep + 1e-9), found[: WIDTH + 1] + keep * w)
        w = w - move * min(1.0, 4 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return Model(mean, scale, w[:-1], float(w[-1]))


def described(docs: DataFrame, keep: tuple[str, ...], text: str, emit, columns: T.StructType) -> DataFrame:
    """keep + what `emit` makes of each batch's features."""
    kept = few_at_once(docs).select(*(F.col(f"`{c}`") for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = tv.Powers()
        for b in batches:
            x = [features(buf, offs, powers) for _, buf, offs in tv.slices(b.column(len(keep)))]
            made = emit(np.concatenate(x)) if x else emit(np.empty((0, WIDTH)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made], names=[*keep, *columns.fieldNames()])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, T.StructType([*kept.schema.fields, *columns.fields]))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", host: str = HOST, path: str = PATH) -> Model:
    """Trains on all labelled documents (label 0 or 1; of several labels of a key the smallest counts, of several texts the one whose features come first). Without both labels nothing is rejected."""
    known = durable(labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1)).groupBy("k").agg(F.min("y").alias("y")))
    n = known.count()
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.expr(host).cast("string").alias("h"), F.expr(path).cast("string").alias("p"), F.col(f"`{text}`").cast("string").alias("t"))
    as_list = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    told = lambda rows, keep: described(rows, keep, "t", lambda x: [pa.array(list(x), pa.list_(pa.float64()))], as_list)
    found = told(rows.join(F.broadcast(known), "k"), ("k", "y", "h", "p")) if n <= FEW else told(rows, ("k", "h", "p")).join(known, "k")
    held = F.pmod(F.xxhash64("k", F.lit("quality")), F.lit(HELD)) == HELD - 1
    one = found.groupBy("k", "y").agg(F.min(F.struct("x", "h", "p")).alias("r")).select("k", held.alias("held"), "y", "r.x", "r.h", "r.p")
    # In order within tasks, so that sums are the same again.
    one = durable(one.sortWithinPartitions("k"))
    model = train(one.where(~F.col("held")))
    if model is None:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 4.0)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(odds(matrix(b)[0])), b.column(2), b.column(3)], names=["__logit", "__host", "__path"])

    odds = model.odds
    good = durable(one.where(F.col("held") & (F.col("y") == 1)).select("x", "y", "h", "p").mapInArrow(judged, "__logit double, __host string, __path string"))
    return replace(model, good=good)


def evidence(docs: DataFrame, model: Model, *, host: str, path: str, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """keep + __host, __path and __logit, the document's own log odds of being good."""
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.expr(host).cast("string").alias("__host"), F.expr(path).cast("string").alias("__path"), F.col(f"`{text}`").cast("string").alias("__in"))
    odds = replace(model, good=None).odds
    return described(rows, (*keep, "__host", "__path"), "__in", lambda x: [pa.array(odds(x))], T.StructType([T.StructField("__logit", T.DoubleType())]))


def strength(groups: DataFrame, total: str, n: str, mean) -> tuple[F.Column, ...]:
    """Aggregates for the prior strength: groups, weighted spread of the groups' means around `mean`, expected noise."""
    rate = F.col(total) / F.col(n)
    return F.sum(n).alias("n"), F.sum(F.col(n) * (rate - mean) ** 2).alias("spread"), F.sum(mean * (1 - mean)).alias("noise"), F.sum(F.col(n) * F.col(n)).alias("n2")


def prior(row, mean: float) -> float:
    """Pseudo-counts that the spread between groups beyond their noise calls for, from 1 to a million."""
    if not row["n"]:
        return 1.0
    between = max(0.0, row["spread"] - row["noise"]) / max(row["n"] - row["n2"] / row["n"], 1e-9)
    return float(min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)) if between > 1e-12 else 1e6


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(__host, __path, prior_mean, prior_strength, path_n, path_sum, host_n, host_mean, path_mean) and the global mean."""
    p = 1 / (1 + F.exp(-F.col("__logit")))
    paths = durable(scored.groupBy("__host", "__path").agg(F.count("*").alias("path_n"), F.sum(p).alias("path_sum")))
    hosts = paths.groupBy("__host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"))
    over = paths.agg(F.sum("path_n").alias("n"), F.sum("path_sum").alias("s")).first()
    mean = min(max((over["s"] or 0.0) / max(over["n"] or 0, 1), 1e-3), 1 - 1e-3)
    k_host = prior(hosts.agg(*strength(hosts, "host_sum", "host_n", F.lit(mean))).first(), mean)
    hosts = hosts.withColumn("host_mean", (F.col("host_sum") + k_host * mean) / (F.col("host_n") + k_host))
    h = hosts.withColumnRenamed("__host", "__of")
    both = paths.join(h, paths["__host"].eqNullSafe(h["__of"])).drop("__of")
    k_path = prior(both.agg(*strength(both, "path_sum", "path_n", F.col("host_mean"))).first(), mean)
    return both.withColumn("k", F.lit(k_path)).withColumn("path_mean", (F.col("path_sum") + k_path * F.col("host_mean")) / (F.col("path_n") + k_path)), mean


def combine(scored: DataFrame, groups: DataFrame, mean: float) -> DataFrame:
    """scored + p_document, p_host, p_path and score."""
    g = groups.select(F.col("__host").alias("__h"), F.col("__path").alias("__p"), "path_n", "path_sum", "host_mean", "path_mean", "k")
    found = joined(scored, g, scored["__host"].eqNullSafe(g["__h"]) & scored["__path"].eqNullSafe(g["__p"]), "left")
    p = 1 / (1 + F.exp(-F.col("__logit")))
    others = (F.col("path_sum") - p + F.col("k") * F.col("host_mean")) / (F.col("path_n") - 1 + F.col("k"))
    others = F.least(F.greatest(others, F.lit(1e-3)), F.lit(1 - 1e-3))
    shift = F.log(others / (1 - others)) - float(np.log(mean / (1 - mean)))
    score = 1 / (1 + F.exp(-(F.col("__logit") + shift)))
    return found.withColumn("p_document", p).withColumn("p_host", F.col("host_mean")).withColumn("p_path", F.col("path_mean")).withColumn("score", score).drop("__h", "__p", "path_n", "path_sum", "host_mean", "path_mean", "k", "__logit")


def threshold(model: Model, groups: DataFrame, mean: float) -> float:
    """The score below which documents go: by the quantile REJECT of all good rows that were kept from training; 0 without any."""
    n = model.good.count() if model.good is not None else 0
    if not n:
        return 0.0
    at = REJECT * (n - 1)
    # The quantile lies between two scores of the lowest part REJECT; no others leave their tasks.
    low = combine(model.good, groups, mean).select("score").orderBy("score").limit(min(int(at) + 2, n))
    above, *below = (r["score"] for r in low.orderBy(F.desc("score")).limit(2).collect())
    below = below[0] if below else above
    return min(0.5, (below + (at - int(at)) * (above - below)) * 0.9)


def classify(docs: DataFrame, model: Model, *, host: str = HOST, path: str = PATH, keep: tuple[str, ...] = ("doc_id",), text: str = "text", store: bool = True) -> DataFrame:
    """keep + p_document, p_host, p_path, score and keep for each row; `host` and `path` are SQL expressions over `docs`.

    Null and empty texts have a form too (no words) and are judged by it; null hosts are one host, null paths one path of
    it. Repeated rows are judged each. Columns of the same names as the results must not be in `keep`; others are not
    read. An empty table gives an empty result. With `store` the evidence is computed once and kept, otherwise (when `keep`
    holds whole texts) it is computed for the sums and again for the result.
    """
    own = evidence(docs, model, host=host, path=path, keep=keep, text=text)
    if store:
        own = durable(own)
    groups, mean = posteriors(own if store else evidence(docs, model, host=host, path=path, keep=(), text=text))
    groups = durable(groups)
    return combine(own, groups, mean).withColumn("keep", F.col("score") >= threshold(model, groups, mean)).drop("__host", "__path")
