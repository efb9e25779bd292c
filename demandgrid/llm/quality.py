"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = logistic(w0 + sum w_i x_i + pairwise), where the pairwise part, the sum over i < j of <v_i, v_j> x_i x_j, is computed
in linear time as half of (sum of v x) squared minus the sum of (v x) squared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.shared import PIECE_BYTES, WordHashes, binary_texts, doc_remainder, frugal, shipped, slices

BITS = 15
RANK = 8
STATISTICS = (
    "log_words", "log_bytes", "word_length", "distinct_words", "top_word", "repeated_next", "upper", "digits", "punctuation",
    "pipes", "exclamations", "symbols", "stops", "newlines", "distinct_lines", "symbol_ends", "letterless", "log_n_chars", "n_chars_missing",
)
_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 white space, 5 plain punctuation, 6 symbol, 7 beyond ASCII
_KIND[33:127], _KIND[128:] = 6, 7
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:!?'\"()-", 5)):
    _KIND[list(_chars)] = _kind


def statistics(text: bytes, words: list[bytes], buckets: np.ndarray, counts: np.ndarray, n_chars: float | None) -> list[float]:
    """Structure statistics of one text, in the order of STATISTICS; all shares are 0 for an empty text."""
    missing = n_chars is None
    tail = [0.0 if missing else np.log1p(max(n_chars, 0)), float(missing)]
    if not words:
        return [0.0] * (len(STATISTICS) - 2) + tail
    raw = np.frombuffer(text, np.uint8)
    kinds = _KIND[raw]
    of_kind = np.bincount(kinds, minlength=8)
    n, size, letters = len(words), len(raw), max(1, of_kind[1] + of_kind[2] + of_kind[7])
    lines = text.split(b"\n")
    ends = np.flatnonzero((kinds[:-1] != 4) & (kinds[1:] == 4))
    last = np.bincount(kinds[np.r_[ends, size - 1]], minlength=8)
    lone = sum(1 for word in words if len(word) < 4 and not any(_KIND[c] in (1, 2, 7) for c in word))
    return [
        np.log1p(n), np.log1p(size), (size - of_kind[4]) / n, len(buckets) / n, counts.max() / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, of_kind[2] / letters, of_kind[3] / size, of_kind[5] / size,
        text.count(b"|") / n, text.count(b"!") / n, of_kind[6] / size, text.count(b".") / n, len(lines) / n, len(set(lines)) / len(lines),
        last[6] / n, lone / n, *tail,
    ]


def _features(hashes: WordHashes, text: bytes, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(distinct word buckets, their values, statistics); the word values of a text have length 1 together."""
    words = text.split()
    buckets, counts = np.unique(hashes.of(text.lower().split()) >> np.uint64(64 - BITS), return_counts=True)
    values = np.sqrt(counts)
    return buckets.astype(np.int32), (values / max(1e-9, np.sqrt(counts.sum()))).astype(np.float32), statistics(text, words, buckets, counts, n_chars)


@dataclass
class Machine:
    """A trained factorisation machine; the statistics are its last features, standardised and cut to [-4, 4]."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    def standard(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.means) / self.scales, -4, 4) / 4

    def score(self, buckets: np.ndarray, values: np.ndarray, statistics: list[float]) -> float:
        x = np.r_[values, self.standard(np.asarray(statistics))]
        at = np.r_[buckets, (1 << BITS) + np.arange(len(statistics))]
        weighted = self.factors[at] * x[:, None]
        pairs = 0.5 * ((weighted.sum(axis=0) ** 2) - (weighted**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.linear[at] @ x + pairs, -30, 30))))


def fit(rows: pd.DataFrame, steps: int = 1500, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """About ``steps`` adaptive gradient steps on the logistic loss, over batches of 64 documents in a seeded order."""
    rows = rows.sort_values("order", kind="stable").reset_index(drop=True)
    stats = np.array(rows["statistics"].tolist(), np.float64)
    labels = rows["label"].to_numpy(np.float64)
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + stats.shape[1]
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    machine = Machine(np.log(share / (1 - share)), np.zeros(size), rng.normal(0, 0.05, (size, RANK)), stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    standard = machine.standard(stats)
    offset = (1 << BITS) + np.arange(stats.shape[1])
    seen = np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(-(-steps // -(-len(rows) // 64))):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 64):
            picked = order[start : start + 64]
            at = [np.r_[rows["buckets"][k], offset] for k in picked]
            owner = np.repeat(np.arange(len(picked)), list(map(len, at)))
            x = np.concatenate([np.r_[rows["values"][k], standard[k]] for k in picked])
            at = np.concatenate(at)
            weighted = machine.factors[at] * x[:, None]
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sums = np.add.reduceat(weighted, cuts, axis=0)
            pairs = 0.5 * (sums**2 - np.add.reduceat(weighted**2, cuts, axis=0)).sum(axis=1)
            margin = machine.bias + np.add.reduceat(machine.linear[at] * x, cuts) + pairs
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[picked]) / len(picked)
            places, inverse = np.unique(at, return_inverse=True)
            pull = error[owner] * x
            step = np.bincount(inverse, pull, len(places)) + decay * machine.linear[places]
            deep = pull[:, None] * (sums[owner] - weighted)
            step_f = np.stack([np.bincount(inverse, deep[:, f], len(places)) for f in range(RANK)], axis=1) + decay * machine.factors[places]
            seen[0][places] += step**2
            seen[1][places] += step_f**2
            machine.linear[places] -= rate * step / np.sqrt(seen[0][places])
            machine.factors[places] -= 0.3 * rate * step_f / np.sqrt(seen[1][places])
            machine.bias -= rate * error.sum()
    return machine


def _featured(docs: DataFrame) -> DataFrame:
    """(order, label, buckets, values, statistics) of labelled rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", PIECE_BYTES):
            found = [_features(hashes, text, n) for text, n in zip(binary_texts(batch.column("text")), batch.column("n_chars").to_pylist())]
            columns = [pa.array([f[k] for f in found]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), *columns], ["order", "label", "buckets", "values", "statistics"])

    return docs.mapInArrow(frugal(run), "order long, label int, buckets array<int>, values array<float>, statistics array<double>")


def _input(docs: DataFrame, *more: Column) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", "text", n_chars.alias("n_chars"), *more)


def train(docs: DataFrame, labels: DataFrame, training: Column, most_docs: int = 6000) -> Machine | None:
    """Learns ``quality`` of ``labels`` (doc_id, quality) on the rows of ``docs`` for which ``training`` holds.

    A hash of the id thins the labelled rows to about ``most_docs``, the documented bound of the sample, whose sparse features
    one task fits; the model, 2^15 words of rank 8, comes back as one row. Labels other than 0 and 1 and null
    ids are ignored; a document labelled twice counts twice. Without labelled rows there is no model.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label"))
    known = known.where(training)
    rows = known.count()
    if not rows:
        return None
    order = F.xxhash64("doc_id", F.lit("quality sample"))
    known = known.where(F.pmod(order, F.lit(1 << 20)) < min(1.0, most_docs / rows) * (1 << 20))
    sample = _input(docs).join(known, "doc_id").select("text", "n_chars", "label", order.alias("order"))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        m = fit(rows)
        return pd.DataFrame({"bias": [m.bias], **{name: [getattr(m, name).astype("<f4").tobytes()] for name in ("linear", "factors", "means", "scales")}})

    kind = "bias double, linear binary, factors binary, means binary, scales binary"
    model = _featured(sample).withColumn("model", F.lit(0)).groupBy("model").applyInPandas(fitted, kind).first()
    if model is None:
        return None
    linear, factors, means, scales = (np.frombuffer(model[name], "<f4") for name in ("linear", "factors", "means", "scales"))
    return Machine(model["bias"], linear, factors.reshape(-1, RANK), means, scales)


def scored(docs: DataFrame, machine: Machine | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` from its whole text and n_chars, if there is such a column.

    Null and empty texts are scored by their statistics alone. Without a model every score is 1. Null and repeated ids
    are carried along. The model is broadcast; its size is fixed by its bits and rank.
    """
    load = shipped(docs.sparkSession, machine)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, model = WordHashes(), load()
        for batch in slices(batches, "text", PIECE_BYTES):
            rows = zip(binary_texts(batch.column("text")), batch.column("n_chars").to_pylist())
            scores = [model.score(*_features(hashes, text, n)) if model else 1.0 for text, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = _input(docs).mapInArrow(frugal(run), f"doc_id {kind}, score double")
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, machine: Machine | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, unchanged. Without a model all stay."""
    load = shipped(docs.sparkSession, machine)
    with_count = "n_chars" in docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, model = WordHashes(), load()
        for batch in slices(batches, "text", PIECE_BYTES):
            counts = batch.column("n_chars").to_pylist() if with_count else [None] * batch.num_rows
            rows = zip(binary_texts(batch.column("text")), counts)
            yield batch.filter(pa.array([model is None or model.score(*_features(hashes, text, n)) >= threshold for text, n in rows], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`scored` and :func:`train`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_remainder("doc_id", 5) != 0)
    return scored(docs, machine).select("doc_id", (doc_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
