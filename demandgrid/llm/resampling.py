"""Importance resampling towards a target distribution, by hashed features of one and two words.

Features are counted into an array of 10,000 buckets, once for the corpus and once for the target texts. The array of log-ratio
gains scores every document by array lookups, and the scores are written. Which documents are drawn is then a question of
numbers alone: counts of rows below a threshold, halving the interval until the cutoff score is known, then the cutoff
id among rows of that score. The drawn rows are range-partitioned and numbered, so ranks need no global sort in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.shared import binary_texts, shipped, slices, written

BUCKETS = 10_000
LEAST_WORDS = 20
LARGEST_ID = (1 << 63) - 1
# Bytes that are part of a word stay (A-Z in lower case), all others become spaces: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
POLYNOMIAL = 0xEDB88320  # of crc32, fixed value
LONGEST_STEP = 64


def _zero_steps() -> np.ndarray:
    """For n = 0..64, what feeding n zero bytes does to each byte of a checksum: tables [n, place of the byte, byte]."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), step >> np.uint32(1))
    tables = np.empty((LONGEST_STEP + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(LONGEST_STEP):
        tables[n + 1] = step[tables[n] & 255] ^ (tables[n] >> np.uint32(8))
    return tables


class FeatureBuckets:
    """Buckets of all one- and two-word features of a list of texts.

    The checksum of two words is that of the first, carried over as many zero bytes as follow, xor that of the rest, so each distinct word
    is hashed once and pairs cost a few table lookups.
    """

    def __init__(self):
        self.tables = _zero_steps()

    def carried(self, checksums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        sizes = sizes.copy()
        while True:
            step = np.minimum(sizes, LONGEST_STEP)
            parts = [self.tables[step, k, (checksums >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)]
            checksums = parts[0] ^ parts[1] ^ parts[2] ^ parts[3]
            sizes -= step
            if not sizes.any():
                return checksums

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, bucket of each word, bucket of each word with the next; -1 at the last word of a text)."""
        split = [text.translate(WORD_BYTES).split() for text in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = dict.fromkeys(chain.from_iterable(split))
        for number, word in enumerate(words):
            words[word] = number
        ids = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int32, int(sizes.sum()))
        alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        after = np.fromiter((zlib.crc32(b" " + word) for word in words), np.uint32, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        one = alone[ids]
        two = np.full(len(ids), -1, np.int64)
        if len(ids) > 1:
            two[:-1] = (self.carried(one[:-1], length[ids[1:]]) ^ after[ids[1:]]) % BUCKETS
            two[np.cumsum(sizes)[sizes > 0] - 1] = -1
        return sizes, (one % BUCKETS).astype(np.int64), two


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, total = FeatureBuckets(), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text"):
        _, one, two = features.of(binary_texts(batch.column("text")))
        total += np.bincount(one, minlength=BUCKETS) + np.bincount(two + 1, minlength=BUCKETS + 1)[1:]
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket: an array per task, summed by bucket; 10,000 numbers reach the driver."""
    counts = docs.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS, np.int64)
    for bucket, n in counts.collect():
        total[bucket] = n
    return total


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the corpus, one count added to each bucket."""
    up = (target + 1.0) * (corpus.sum() + float(BUCKETS))
    down = (corpus + 1.0) * (target.sum() + float(BUCKETS))
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _weighed(gains):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = FeatureBuckets(), np.append(gains(), 0)  # the last for "no pair"
        for batch in slices(batches, "text"):
            sizes, one, two = features.of(binary_texts(batch.column("text")))
            so_far = np.concatenate([[0], np.cumsum(gain[one] + gain[two])])
            ends = np.cumsum(sizes)
            n_features = sizes + np.maximum(sizes - 1, 0)
            weight = (so_far[ends] - so_far[ends - sizes]) // np.maximum(n_features, 1)
            columns = [batch.column("doc_id"), *map(pa.array, (sizes, n_features, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) with g from the Gumbel distribution, drawn by a hash of seed and id; a null id hashes as the word null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn_rows(rows: DataFrame, order: list[str], want: int) -> Column:
    """A condition that holds for the first ``want`` of ``rows`` by the whole-number columns ``order``, whose combination is unique.

    Column by column the interval between least and greatest value is halved by exact counts, until the least value
    is known that ``want`` rows reach; rows of that very value are settled by the next column.
    """
    condition, tied = F.lit(False), F.lit(True)
    for column in order:
        if want <= 0:
            break
        low, high = rows.agg(F.min(column), F.max(column)).first()
        if low is None:
            break
        while low < high:
            middle = (low + high) // 2
            if rows.where(F.col(column) <= middle).count() >= want:
                high = middle
            else:
                low = middle + 1
        condition |= tied & (F.col(column) < low)
        tied &= F.col(column) == low
        want -= rows.where(F.col(column) < low).count()
        rows = rows.where(F.col(column) == low)
        if rows.count() <= want:
            condition |= tied
            break
    return condition


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; rank is null where the draw leaves a document out.

    weight is the floored mean over a document's features (runs of one and two words, repeats counted) of the gain of the feature's
    bucket, score adds seeded Gumbel noise to it, and of the N documents with ``least_words`` words or more the
    floor(percent * N / 100) of highest score are drawn, ties to the smaller doc_id. Counts of both sides cover all texts.

    Null and empty texts have no features, weight 0 and are never drawn. A null doc_id has its own noise and comes last among ties. Rows that
    repeat an id are separate documents; if they tie in score, their place in the written scores decides. An empty corpus
    gives no rows, an empty target flat gains of the corpus alone. Columns other than doc_id and text are not read. Texts are
    never cut; a task holds some 8 MB of text, or one text if that is longer.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gains = shipped(spark, gains_of(bucket_counts(docs), bucket_counts(target)))
    weighed = docs.mapInArrow(_weighed(gains), "doc_id long, n_words long, n_features long, weight long")
    scored = written(
        weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumns({
            "down": -F.col("score"), "tie": F.coalesce("doc_id", F.lit(LARGEST_ID)), "row": F.monotonically_increasing_id(),
        }),
        "resample-scores",
    )
    eligible = scored.where(F.col("n_words") >= least_words)
    order = ["down", "tie", "row"]
    chosen = (F.col("n_words") >= least_words) & drawn_rows(eligible, order, eligible.count() * percent // 100)
    shown = ["doc_id", "n_features", "weight", "score"]
    placed = scored.where(chosen).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.select(*shown, F.monotonically_increasing_id().alias("spot")), "resample-ranks")
    part, place = F.shiftright("spot", 33).alias("part"), F.col("spot").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = placed.withColumn("part", part).join(starts, "part").select(*shown, (F.col("before") + place + 1).alias("rank"))
    return ranked.union(scored.where(~chosen).select(*shown, F.lit(None).cast("long").alias("rank")))


OP12_SQL = """
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step),
words AS (
  SELECT side, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT 's' AS side, doc_id AS row, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)),
features AS (
  SELECT side, row, f, count(*) AS n
  FROM (SELECT side, row, unnest(w) AS f FROM words
        UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words)
  GROUP BY ALL),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
                            lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features) CROSS JOIN step),
placed AS (SELECT side, row, bucket, n FROM features JOIN hashed USING (f)),
buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM buckets) + 10000 AS DOUBLE)
         / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM buckets) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM buckets),
weights AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(len(w), 0) AS n_words,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights ON weights.row = doc_id LEFT JOIN words ON words.row = doc_id AND side = 's'),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id"""


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts, ties, repeats and empty tables: see :func:`resample`."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)
