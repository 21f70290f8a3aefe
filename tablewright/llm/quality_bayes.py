"""Quality classifier by hierarchical empirical Bayes.

Evidence: a logistic regression over the make-up of a text's bytes gives each document a log-odds of being good, fitted
on at most ``SAMPLE_ROWS`` labelled documents (those with the lowest hash of their id). Sites: the documents'
probabilities are summed per host and per path; the strength of each level's prior comes from the spread of the means
above it, so a host with few documents leans on the global mean, and a path with few on its host. Posterior: the
document's log-odds, moved by how far its path's posterior lies from the global mean, damped by ``SITE_WEIGHT``.

A null or empty text, and any text of a table without labels of both kinds, has evidence zero and follows its site. Null
hosts and paths are a site of their own. Rows with equal ids are judged each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.batches import give_back, small_batches, text_bytes
from tablewright.session import keep

SAMPLE_ROWS = 4000
SITE_WEIGHT = 0.5
STRENGTHS = (1.0, 10_000.0)
#: Bytes of text whose groups are counted at once; each takes some thirty bytes meanwhile.
COUNTED_BYTES = 1 << 18

#: Groups of bytes whose shares of a text are the features.
GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"|", b"!", b".,;:?", b"#*$%&<>@=+_~^/{}[]")


def _group_table() -> np.ndarray:
    table = np.full(256, len(GROUPS), np.int64)  # the rest: bytes beyond ASCII, quotes, other signs
    for number, group in enumerate(GROUPS):
        table[list(group)] = number
    return table


GROUP_OF = _group_table()


def _repeated(texts: pa.Array) -> np.ndarray:
    """Share of each text's words that equal the word before."""
    split = pc.ascii_split_whitespace(texts)
    owner, parts = pc.list_parent_indices(split).to_numpy(), split.flatten()
    filled = pc.not_equal(parts, "")
    owner, ids = owner[filled.to_numpy(zero_copy_only=False)], parts.filter(filled).dictionary_encode().indices.to_numpy()
    again = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=len(texts)) / np.maximum(1, np.bincount(owner, minlength=len(texts)))


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: shares of the byte groups, of repeated words, mean bytes per word, logarithm of the length."""
    texts = texts.cast(pa.large_string()).fill_null("")
    flat, offsets = text_bytes(texts)
    n, k = len(texts), len(GROUPS) + 1
    counts, repeated = np.zeros((n, k)), np.zeros(n)
    start = 0
    while start < n:  # bounded numbers of bytes at once
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + COUNTED_BYTES, side="right")) - 1)
        part = flat[offsets[start] : offsets[stop]]
        owner = np.repeat(np.arange(stop - start), np.diff(offsets[start : stop + 1]))
        counts[start:stop] = np.bincount(owner * k + GROUP_OF[part], minlength=(stop - start) * k).reshape(-1, k)
        repeated[start:stop] = _repeated(texts.slice(start, stop - start))
        start = stop
    size = np.maximum(1, np.diff(offsets))
    gaps = counts[:, 3] + counts[:, 4] + 1
    return np.c_[counts / size[:, None], repeated, size / gaps, np.log(size)]


@dataclass(frozen=True)
class Model:
    """Standardised logistic regression."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        rows = features(texts)
        odds = (rows - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) + self.bias
        return np.where(np.diff(text_bytes(texts)[1]) > 0, np.clip(odds, -12, 12), 0.0)


def _evidence(model: Model | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(model.log_odds(texts))
        give_back()

    # never null, and Spark is told so: a filter for that would run the function a second time, in processes of its own
    return F.coalesce(run(text.cast("string")), F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model | None:
    """The regression on a sample of labelled documents; None if the sample lacks good or bad ones."""
    small_batches(docs.sparkSession)
    rated = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    sample = rated.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    own = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), id_col)  # ``rows`` rows

    @F.arrow_udf("array<double>")
    def measured(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(list(features(texts)), pa.list_(pa.float64()))
        give_back()

    got = own.where(F.octet_length("_text") > 0).select(F.col("_label").cast("int").alias("y"), measured("_text").alias("x")).limit(2 * rows).toPandas()
    y = (got["y"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array(got["x"].tolist())
    order = np.lexsort(np.c_[x, y].T)  # whatever order the rows came in
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    design = np.c_[(x - mean) / scale, np.ones(len(x))]
    weights, ridge = np.zeros(design.shape[1]), np.full(design.shape[1], 1.0)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (y - p) - ridge * weights
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    tidy = lambda values: tuple(float(round(v, 10)) for v in values)
    return Model(tidy(mean), tidy(scale), tidy(weights[:-1]), float(round(weights[-1], 10)))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, above: Column) -> float:
    """Pseudo-documents that the level above is worth, from the spread of the sites' means around it."""
    n, mean = F.col("n"), F.col("s") / F.col("n")
    noise = above * (1 - above)
    found = sites.agg(
        F.sum(n * (mean - above) ** 2).alias("spread"), F.sum(noise).alias("noise"), F.sum(n).alias("n"), F.sum(n * noise).alias("weighted"), F.count("*").alias("sites"),
    ).first()
    low, high = STRENGTHS
    if not found.n or found.sites < 2:
        return high
    between = max((found.spread - found.noise) / found.n, 1e-9)
    return min(high, max(low, found.weighted / found.n / between - 1))


def site_posteriors(evidence: DataFrame) -> DataFrame | None:
    """(host, path, shift): what to add to a document's log-odds. ``evidence`` has host, path, z; None if it is empty."""
    p = 1 / (1 + F.exp(-F.col("z")))
    paths = keep(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total.n:
        return None
    mean = min(1 - 1e-6, max(1e-6, total.s / total.n))
    k = _strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("above"))
    paths = paths.join(hosts, "host")
    k = _strength(paths, F.col("above"))
    own = (F.col("s") + k * F.col("above")) / (F.col("n") + k)
    # written, so that Spark knows its size and broadcasts it only if it is small
    return keep(paths.select("host", "path", (SITE_WEIGHT * (_odds(own) - _odds(F.lit(mean)))).alias("shift")))


def _sites(df: DataFrame, host_col: str, path_col: str) -> tuple[Column, Column]:
    return tuple(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in (host_col, path_col))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(id, evidence, site_shift, p_good, kept) of every row."""
    model = fit(docs, labels, id_col, text_col)
    host, path = _sites(docs, host_col, path_col)
    evidence = keep(docs.select(id_col, host.alias("host"), path.alias("path"), _evidence(model, F.col(text_col)).alias("z")))
    return _judged(evidence, site_posteriors(evidence)).select(
        id_col, F.round("z", 6).alias("evidence"), F.round("shift", 6).alias("site_shift"), F.round(F.col("p"), 6).alias("p_good"), (F.col("p") >= 0.5).alias("kept")
    )


def _judged(rows: DataFrame, sites: DataFrame | None) -> DataFrame:
    placed = rows.withColumn("shift", F.lit(0.0)) if sites is None else rows.join(sites, ["host", "path"])
    return placed.withColumn("p", 1 / (1 + F.exp(-(F.col("z") + F.col("shift")))))


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are judged good; same columns."""
    model = fit(docs, labels, id_col, text_col)
    host, path = _sites(docs, host_col, path_col)
    z = _evidence(model, F.col(text_col))
    sites = site_posteriors(docs.select(host.alias("host"), path.alias("path"), z.alias("z")))
    whole = docs.select(F.struct("*").alias("doc"), host.alias("host"), path.alias("path"), z.alias("z"))
    return _judged(whole, sites).where("p >= 0.5").select("doc.*")
