"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are partial sums per task, grouped by (language, bucket) on the cluster; the log-probability matrix, languages by buckets,
is broadcast and texts are scored in batches by sparse row sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.shared import binary_texts, doc_remainder, shipped, slices

BITS = 15
MOST_MATRIX_BYTES = 128 << 20
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # fixed odd values


def ngram_buckets(text: str, longest: int = 3, bits: int = BITS) -> np.ndarray:
    """Buckets of all character n-grams, n from 1 to ``longest``, of the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in range(1, min(longest, len(codes)) + 1):
        total = np.full(len(codes) - n + 1, n, np.uint32)
        for place in range(n):
            total = (total ^ codes[place : place + len(total)]) * MULTIPLIERS[place]
            total ^= total >> np.uint32(15)
        found.append((total * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    priors: np.ndarray
    matrix: np.ndarray  # buckets by languages, log probabilities

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Most probable language of each text and its posterior; ``und`` with 0 where no letter or no model is there."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        spoken = [k for k, text in enumerate(texts) if has_letter(text)]
        start = 0
        while start < len(spoken):  # a batch of texts at a time, so that the gathered rows stay small
            end, chars = start, 0
            while end < len(spoken) and (end == start or chars + len(texts[spoken[end]]) <= 200_000):
                chars, end = chars + len(texts[spoken[end]]), end + 1
            buckets = [ngram_buckets(texts[k]) for k in spoken[start:end]]
            edges = np.cumsum([0, *map(len, buckets)])[:-1]
            sums = np.add.reduceat(self.matrix[np.concatenate(buckets)], edges, axis=0, dtype=np.float64) + self.priors
            best = sums.argmax(axis=1)
            posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            for k, b, p in zip(spoken[start:end], best.tolist(), posterior.tolist()):
                names[k], scores[k] = self.languages[b], p
            start = end
        return names, scores


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = {}, {}
    for batch in slices(batches, "text", 4 << 20):
        for value, lang in zip(binary_texts(batch.column("text")), batch.column("lang").to_pylist()):
            text = value.decode("utf-8", "replace")
            docs[lang] = docs.get(lang, 0) + 1
            if lang not in total:
                total[lang] = np.zeros(1 << BITS, np.int64)
            total[lang] += np.bincount(ngram_buckets(text), minlength=1 << BITS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[docs[lang], counts[at]], pa.int64())],
            ["lang", "bucket", "n"],
        )


def train(docs: DataFrame, training: Column, most_docs: int = 20_000, smoothing: float = 0.1) -> LanguageModel:
    """Learns from the rows of ``docs`` (doc_id, text, lang) for which ``training`` holds and lang is known.

    A hash of the id thins them to about ``most_docs``, and to no less than an even share of those for each language, so that a rare
    one keeps all its rows; that is at most twice ``most_docs`` (the documented bound of the sample). Priors are the counts of all rows. The matrix
    has one row per language and 2^15 buckets; the number of languages is checked before anything is broadcast.
    No training rows: a model without languages.
    """
    labelled = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    most_languages = MOST_MATRIX_BYTES // (4 << BITS)
    total = {lang: n for lang, n in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if not total:
        return LanguageModel([], np.empty(0), np.empty((1 << BITS, 0), np.float32))
    if len(total) > most_languages:
        raise ValueError(f"more than {most_languages} languages exceed the bound of the broadcast matrix")
    rows = sum(total.values())
    shares = [(lang, max(most_docs / rows, most_docs / len(total) / n)) for lang, n in total.items()]
    shared = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double")), "lang")
    sample = shared.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counted = sample.select("text", "lang").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    place = {name: k for k, name in enumerate(names)}
    at, bucket, n = np.array([place[x] for x in found.column("lang").to_pylist()], int), found.column("bucket").to_numpy(), found.column("n").to_numpy()
    counts, priors = np.full((1 << BITS, len(names)), smoothing), np.zeros(len(names))
    counts[bucket[bucket >= 0], at[bucket >= 0]] += n[bucket >= 0]
    priors[:] = np.log([total[name] for name in names])
    return LanguageModel(names, priors, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, from its whole text alone.

    A null or empty text, or one without a letter, is ``und`` with score 0. Ties go to the first language by name.
    Null and repeated ids are carried along; other columns are not read.
    """
    load = shipped(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in slices(batches, "text"):
            names, scores = model.score([value.decode("utf-8", "replace") for value in binary_texts(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`identify` and :func:`train`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, doc_remainder("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", (doc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
