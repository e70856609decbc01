"""Quality classifier: document evidence shrunk towards its site by hierarchical empirical Bayes.

A logistic model on text statistics gives each document's evidence. Grouped
sums of it give every host and every path of a host a posterior mean: a path is
drawn to its host, a host to the whole corpus, the more the fewer documents it
has; how strongly is estimated from the spread between hosts and between paths. A document's own
evidence is taken out of its path and host before they speak about it, so that none counts twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.llm.fertility import BLANKS, repeated_words

#: Labelled documents that the model is fitted on, at most, by the hash of their ids.
TRAIN_ROWS = 20_000
RIDGE, STEPS = 1.0, 25
#: Documents are kept from this posterior on.
THRESHOLD = 0.5
FEATURES = [
    "symbols", "marks", "bars", "capitals", "digits", "stops", "foreign", "word_length", "repeated", "distinct",
    "same_lines", "words",
]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_CLASSES = np.stack(
    [
        _class("#*$%&<>@^~_=+{}[]\\"), _class("!?"), _class("|"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _class("0123456789"), _class(".,;:"), np.r_[np.zeros(128), np.ones(128)],
    ]
)


def features_of(text: str) -> list[float]:
    """Shares by character class, repetition and length of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(1, len(words))
    share = (_CLASSES * np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)).sum(1) / max(1, len(data))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return [
        *np.sqrt(share).tolist(),
        min(40.0, len(data) / n),
        repeated_words(words) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words))),
    ]


def features(text: Column) -> Column:
    """array<double> in the order of FEATURES; null counts as empty."""

    @F.arrow_udf("array<double>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([features_of(t.as_py() or "") for t in texts], type=pa.list_(pa.float64()))

    return read(text)


def fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Coefficients of a ridge logistic regression, the constant last, for features as they are."""
    if not len(y):
        return [0.0] * (len(FEATURES) + 1)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(z.shape[1] - 1, RIDGE), 1e-3]
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", z, w), -30, 30)))
        slope = np.einsum("ij,i->j", z, y - p) - penalty * w
        curve = np.einsum("ij,i,ik->jk", z, p * (1 - p), z, optimize=False) + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    inner = w[:-1] / scale
    return [*inner.tolist(), float(w[-1] - (inner * mean).sum())]


def train(documents: DataFrame, labels: DataFrame) -> list[float]:
    """Coefficients from at most TRAIN_ROWS rows of labelled documents, ids repeated or not."""
    chosen = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "quality", features(F.col("text")).alias("x"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(TRAIN_ROWS).toPandas()
    if rows.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(rows["x"].to_numpy()), (rows["quality"] > 0).to_numpy(dtype=float))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _weight(groups: DataFrame, mean: Column) -> DataFrame:
    """One row: the prior's weight in documents, from the spread of group means beyond what their sizes explain.

    Without such spread the weight is huge: groups are then as good as one.
    """
    sums = groups.where("n > 1").select("n", (F.col("e") / F.col("n") - mean).alias("off"), mean.alias("m"))
    row = sums.agg(
        F.sum(F.col("n") * F.col("off") ** 2).alias("spread"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("within"),
        F.sum("n").alias("n"),
        F.sum(F.col("m") * (1 - F.col("m")) * F.col("n")).alias("whole"),
    )
    between = F.greatest(F.try_divide(F.col("spread") - F.col("within"), F.col("n")), F.lit(1e-9))
    weight = F.try_divide(F.try_divide(F.col("whole"), F.col("n")), between)
    return row.select(F.coalesce(weight, F.lit(1e9)).alias("weight"))


def posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, prior, host_mean, site) and the sums behind them; `scored` has host, path and evidence.

    host_mean and site are the posterior means of a host and a path with all their documents.
    """
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("e")))
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("e").alias("e")))
    # Single rows: sums over the groups.
    total = hosts.agg((F.sum("e") / F.sum("n")).alias("prior")).first()["prior"]
    prior = F.lit(float(total if total is not None else 0.5))
    host_weight = F.lit(float(_weight(hosts, prior).first()["weight"]))
    means = hosts.select("host", F.col("n").alias("host_n"), F.col("e").alias("host_e"), prior.alias("prior"), host_weight.alias("host_weight"))
    means = written(means.withColumn("host_mean", _shrunk("host_weight", F.col("prior"), F.col("host_e"), F.col("host_n"))))
    nested = paths.join(means, paths["host"].eqNullSafe(means["host"])).drop(means["host"])
    path_weight = F.lit(float(_weight(nested, F.col("host_mean")).first()["weight"]))
    nested = nested.withColumn("path_weight", path_weight)
    return nested.withColumn("site", _shrunk("path_weight", F.col("host_mean"), F.col("e"), F.col("n")))


def _shrunk(weight: str, towards: Column, total: Column, n: Column) -> Column:
    """The posterior mean of a group whose evidence sums up to `total`."""
    return (F.col(weight) * towards + total) / (F.col(weight) + n)


def classify(
    documents: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, evidence, posteriors and verdict of every document.

    Columns in `carry` stay with their row in a struct `carried`.

    The host is by default `source`, the path `lang`, empty where null or missing. host_mean and site are
    what the other documents of the host and path say. Rows of one id are judged each by its own text.
    Null text counts as empty. Without labels the evidence is 0.5 everywhere and
    all documents are kept. Repeated rows repeat; an empty table gives no rows. Texts of any length are read whole.
    """
    def named(column: Column | None, name: str) -> Column:
        if column is None:
            column = F.col(name) if name in documents.columns else F.lit("")
        return F.coalesce(column.cast("string"), F.lit(""))

    *weights, constant = train(documents, labels)
    also = [F.struct(*carry).alias("carried")] if carry else []
    kept_with = ["carried"] * bool(carry)
    read = documents.select(
        "doc_id", *also, named(host, "source").alias("host"), named(path, "lang").alias("path"), features(F.col("text")).alias("x")
    )
    logit = sum((F.col("x")[i] * w for i, w in enumerate(weights)), F.lit(constant))
    read = read.select("doc_id", *kept_with, "host", "path", logit.alias("logit"))
    read = read.withColumn("evidence", 1 / (1 + F.exp(-F.col("logit"))))
    scored = written(read.drop(*kept_with))
    sites = written(posteriors(scored))
    # What is carried may be whole texts: they are read twice rather than written in between.
    scored = read if carry else scored
    # Spark broadcasts the sites while they are few; else it splits the side of a hot site.
    joined = scored.join(sites, ["host", "path"], "left")
    own = F.col("evidence")
    host = _shrunk("host_weight", F.col("prior"), F.col("host_e") - own, F.col("host_n") - 1)
    site = _shrunk("path_weight", host, F.col("e") - own, F.col("n") - 1)
    joined = joined.withColumn("host_mean", host).withColumn("site", site)
    shifted = F.col("logit") + _logit(F.col("site")) - _logit(F.col("prior"))
    posterior = F.coalesce(1 / (1 + F.exp(-shifted)), F.col("evidence"))
    return joined.withColumn("posterior", posterior).select(
        "doc_id", "evidence", "host_mean", "site", "posterior", (F.col("posterior") >= THRESHOLD).alias("kept"), *kept_with
    )
