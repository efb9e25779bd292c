"""What the operators of this package share: written tables, word splitting, hashing and component labels."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of bytes other than the six ASCII white-space bytes; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
ROW_BYTES = 32  # of a broadcast row with an id and a number, about
PIECE_BYTES = 2 << 20  # of text that a task which handles its texts one by one works on at a time


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables, below the shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent (as in tests) the warehouse folder serves, which every executor reaches too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder once and read back: a lost executor costs a re-read, not a re-run."""
    path = work_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, octets: int, most: int = 32 << 20) -> DataFrame:
    """A broadcast hint for a table whose counted bytes stay within ``most``; else Spark joins it by shuffle."""
    return F.broadcast(df) if octets <= most else df


def shipped(spark: SparkSession, model: object) -> Callable[[], object]:
    """Broadcasts a model of bounded size; a task calls the result to get its copy."""
    content = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(content.value)


def doc_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id gives null."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % divisor


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; a null becomes an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the values of ``column`` in one piece come to about ``most_bytes``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        piece = np.cumsum(sizes, dtype=np.int64) // most_bytes
        edges = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)


def frugal(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` for mapInArrow, whose worker returns the memory that Arrow and the C library keep for reuse once the task's rows are out.

    Spark keeps the workers for later stages, which would else hold the largest batches of all earlier ones next to their own.
    """

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


class WordHashes(dict):
    """64-bit hash of a word, remembered for the most recent 100,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordHasher:
    """64-bit hashes of all words of a list of texts, straight from their bytes: no word becomes an object and none is remembered.

    A word's hash is a polynomial of random values of its bytes modulo 2**64, mixed with its length. The bytes of a stretch of text are
    multiplied by rising powers of an odd number, summed up word by word, and each sum divided by the power at which its word starts.
    """

    STRETCH = 1 << 18  # bytes; a stretch goes on to the end of its last word

    def __init__(self, lower: bool = False, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        self.space = np.isin(np.arange(256), [*range(9, 14), 32])
        self.values[self.space] = 0
        if lower:
            self.values[ord("A") : ord("Z") + 1] = self.values[ord("a") : ord("z") + 1]
        self.factor = int(rng.integers(1 << 60, 1 << 63, dtype=np.uint64)) * 8 + 5 & (1 << 64) - 1
        self.inverse = pow(self.factor, -1, 1 << 64)
        self.rising, self.falling = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.rising) < n:
            self.rising, self.falling = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, f, np.uint64)])) for f in (self.factor, self.inverse))

    def _stretch(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where words start, their hashes) in some bytes that begin and end between words."""
        space = self.space[letters]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if not len(starts):
            return starts, np.empty(0, np.uint64)
        ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        self._powers(len(letters))
        sums = np.add.reduceat(self.values[letters] * self.rising[: len(letters)], starts)
        return starts, mixed(sums * self.falling[starts] + (ends - starts).astype(np.uint64))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, number of words of each text)."""
        text = b" ".join(texts)
        letters = np.frombuffer(text, np.uint8)
        starts, hashes, begin = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
        while begin < len(letters):
            end = min(begin + self.STRETCH, len(letters))
            while end < len(letters):  # on to the next white space
                gap = np.flatnonzero(self.space[letters[end : end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + 4096, len(letters))
            at, found = self._stretch(letters[begin:end])
            starts.append(at + begin)
            hashes.append(found)
            begin = end
        edges = np.cumsum([0, *(len(one) + 1 for one in texts)])
        return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), edges))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of splitmix64, fixed constants)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def run_hashes(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words: a random odd multiplier for each place, then mixed."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = np.random.default_rng(seed).integers(0, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = hashes[:n] * factors[0]
    for place in range(1, length):
        total += hashes[place : place + n] * factors[place]
    return mixed(total)


def components(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the (a, b) edges with the smallest node it reaches.

    Alternates two star steps until nothing changes: first every neighbour above a node is tied to the
    smallest neighbour, then every neighbour below. Each step is one grouped minimum (combined before the shuffle)
    and one join that adaptive execution can split at a hub, and is written to the shared folder.
    Empty edges give an empty result; self-loops and repeated edges are harmless; null ends are ignored.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    state, links = None, written(links, f"{label}-links")
    for _ in range(most_rounds):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        upward = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = upward.groupBy("a").agg(F.min("b").alias("m"))
        tied = upward.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(tied.union(low.select("a", F.col("m").alias("b"))).distinct(), f"{label}-round")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = now
    raise RuntimeError(f"components of {label} did not settle in {most_rounds} rounds")
