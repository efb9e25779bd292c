"""Repeated passages by compressed FM-indexes.

Every window of 13 words has an anchor: the run of five words in it with the smallest hash. Equal windows have equal
anchors, so consecutive windows with one anchor travel together as a stretch of at most 21 words, and an anchor's stretches meet in one shard.
Only anchors that occur in several documents matter; a first pass over anchors alone finds them. It also counts them: the stretches of a
very frequent anchor are cut into their windows, which go to shards by their own hashes, so that no anchor fills a shard.

A shard holds the distinct stretches that its anchors occur in, each with the smallest doc_id it occurs in, as an FM-index: the
Burrows-Wheeler transform of the stretches in a wavelet matrix of packed bits. Backward search of all windows at
once gives each window's interval, as long as it holds more than one place; the smallest doc_id over that interval is that of
the window's first document. Verdicts are joined back to the occurrences, where Spark can split a stretch of many documents.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.shared import ROW_BYTES, WordHasher, binary_texts, checked_broadcast, mixed, run_hashes, slices, written

ANCHOR_WORDS = 5
WORD_BYTES = 6  # of a word's hash, in a stretch; two stretches are only compared if their anchors' 64 bits agree
BYTES_PER_BUCKET = 48 << 20  # of text, whose anchors one task sorts in the first pass
STRETCHES_PER_SHARD = 100_000  # before copies are dropped; less than two million words in an index
FREQUENT = STRETCHES_PER_SHARD // 2  # stretches of one anchor; from here on its windows are spread one by one
BYTES_PER_STRETCH = 30  # of text, about


class Stretches:
    """The stretches of some documents: word hashes laid end to end, and where each stretch starts and how many windows it has."""

    def __init__(self, texts: list[bytes], hasher: WordHasher, window: int):
        self.words, sizes = hasher.of(texts)
        self.doc_starts = np.concatenate([[0], np.cumsum(sizes)])
        n = max(0, len(self.words) - window + 1)
        owner = np.repeat(np.arange(len(texts)), sizes)
        grams = run_hashes(self.words, ANCHOR_WORDS, 3)
        span, least = 1, grams
        while span < window - ANCHOR_WORDS + 1:  # least of ever more runs in a row
            step = min(span, window - ANCHOR_WORDS + 1 - span)
            least, span = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0], span + step
        inside = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n else np.empty(0, int)
        first = np.ones(len(inside), bool)
        # the next window has the same anchor unless its least run is another one or the anchor was the window's first run
        left = inside[:-1]
        first[1:] = (inside[1:] != left + 1) | (least[inside[1:]] != least[left]) | (grams[left] == least[left])
        at = np.flatnonzero(first)
        self.starts = inside[at]
        self.windows = np.diff(np.r_[at, len(inside)])
        self.anchors = least[self.starts]
        self.docs = owner[self.starts]
        firsts = np.searchsorted(self.docs, np.arange(len(texts)))
        self.ordinals = np.arange(len(at)) - firsts[self.docs]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): the key tells apart rows that repeat an id with another text."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return whole.withColumn("key", F.xxhash64("doc_id", "text"))


def _packed_anchors(buckets: int, window: int):
    """For each piece of the input a row per bucket that it has anchors of: the anchors with document and ordinal. An anchor of several
    documents of the piece is sent once, as known to repeat, with the number of its stretches; these are passed on to one bucket without it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for turn, batch in enumerate(slices(batches, "text", 6 << 20)):
            piece = (TaskContext.get().partitionId() << 24) + turn
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "key"))
            s = Stretches(binary_texts(batch.column("text")), hasher, window)
            order = np.lexsort((ids[s.docs], s.anchors))
            anchors, owners = s.anchors[order], ids[s.docs][order]
            edges = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(order) else np.empty(0, int)
            ends = np.r_[edges[1:], len(order)] - 1 if len(order) else edges
            repeats = owners[edges] != owners[ends]
            known = np.zeros(len(order), bool)
            known[order] = np.repeat(repeats, ends - edges + 1)
            markers, marked = anchors[edges[repeats]], (ends - edges + 1)[repeats]
            of_marker = markers % np.uint64(buckets)
            by_bucket = np.argsort(of_marker, kind="stable")
            markers, marked, of_marker = markers[by_bucket], marked[by_bucket], of_marker[by_bucket]
            lone = np.flatnonzero(~known)
            of_lone = s.anchors[lone] % np.uint64(buckets)
            by_bucket = np.argsort(of_lone, kind="stable")
            lone, of_lone = lone[by_bucket], of_lone[by_bucket]
            passed = np.flatnonzero(known)
            home = mixed(np.array([piece], np.uint64)) % np.uint64(buckets)
            wanted = np.unique(np.concatenate([of_lone, of_marker, home]))
            lone_at, marker_at = (np.searchsorted(x, np.r_[wanted, np.uint64(buckets)]) for x in (of_lone, of_marker))
            rows = []
            for k, bucket in enumerate(wanted.tolist()):
                here, of = slice(marker_at[k], marker_at[k + 1]), lone[lone_at[k] : lone_at[k + 1]]
                on = passed if bucket == int(home[0]) else passed[:0]
                used, docs = np.unique(np.r_[s.docs[of], s.docs[on]], return_inverse=True)
                docs = docs.astype(np.int32)
                arrays = (
                    keys[used], ids[used], marked[here].astype(np.int64), np.r_[markers[here], s.anchors[of]], docs[: len(of)],
                    s.ordinals[of].astype(np.int32), docs[len(of) :], s.ordinals[on].astype(np.int32),
                )
                rows.append((bucket, piece, *(a.tobytes() for a in arrays)))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int32(), pa.int64()] + [pa.binary()] * 8)], [f.split()[0] for f in PACKS.split(", ")])

    return run


PACKS = (
    "bucket int, piece long, keys binary, ids binary, marked binary, anchors binary, docs binary, ordinals binary, passed_docs binary, passed_ordinals binary"
)


def _repeated(frequent: int):
    """(piece, keys, sizes, ordinals): the stretches of a piece's documents whose anchor occurs in another document too. Without a piece,
    as ordinals, the anchors of ``frequent`` stretches or more, each with its number."""

    def run(packs: pd.DataFrame) -> pd.DataFrame:
        anchors = [np.frombuffer(x, np.uint64) for x in packs["anchors"]]
        marked = [np.frombuffer(x, np.int64) for x in packs["marked"]]
        local = [np.frombuffer(x, np.int32) for x in packs["docs"]]
        sizes, marks = np.array(list(map(len, anchors))), np.array(list(map(len, marked)))
        every = np.concatenate(anchors)
        marker = np.concatenate([np.arange(n) < m for n, m in zip(sizes, marks)])
        ids, weights = np.zeros(len(every), np.int64), np.ones(len(every), np.int64)
        ids[~marker] = np.concatenate([np.frombuffer(x, np.int64)[d] for x, d in zip(packs["ids"], local)])
        weights[marker] = np.concatenate(marked)
        order = np.argsort(every)
        starts = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]]) if len(order) else np.empty(0, int)
        hot, heavy = np.zeros(len(every), bool), np.empty((0, 2), np.uint64)
        if len(order):
            top, bottom = np.iinfo(np.int64).max, np.iinfo(np.int64).min
            low = np.minimum.reduceat(np.where(marker, top, ids)[order], starts)
            high = np.maximum.reduceat(np.where(marker, bottom, ids)[order], starts)
            many = (low < high) & (low != top) | np.logical_or.reduceat(marker[order], starts)
            hot[order] = np.repeat(many, np.diff(np.r_[starts, len(order)]))
            total = np.add.reduceat(weights[order], starts)
            at = np.flatnonzero(many & (total >= frequent))
            heavy = np.stack([every[order][starts[at]], total[at].astype(np.uint64)], axis=1)
        hot = np.split(hot[~marker], np.cumsum(sizes - marks)[:-1])
        out = [(None, b"", b"", heavy.astype("<u8").tobytes())] * bool(len(heavy))
        for k, keys in enumerate(packs["keys"]):
            keys = np.frombuffer(keys, np.int64)
            docs = np.r_[local[k][hot[k]], np.frombuffer(packs["passed_docs"].iloc[k], np.int32)]
            ordinals = np.r_[np.frombuffer(packs["ordinals"].iloc[k], np.int32)[hot[k]], np.frombuffer(packs["passed_ordinals"].iloc[k], np.int32)]
            if len(docs):
                found, sizes = np.unique(docs, return_counts=True)
                ordinals = ordinals[np.argsort(docs, kind="stable")]
                out.append((packs["piece"].iloc[k], keys[found].tobytes(), sizes.astype(np.int64).tobytes(), ordinals.astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=["piece", "keys", "sizes", "ordinals"]).astype({"piece": "Int64"})

    return run


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences in as few bytes each as the largest needs, after that width and their count."""
    steps = np.diff(numbers, prepend=0)
    width = next(w for w in (1, 2, 4) if not len(steps) or int(steps.max()) < 1 << 8 * w)
    return struct.pack("<BI", width, len(steps)) + steps.astype(f"<u{width}").tobytes()


def unpacked_numbers(content: bytes) -> np.ndarray:
    """The numbers of one or more packed lists, one list after another."""
    found, at = [np.empty(0, np.int64)], 0
    while at < len(content):
        width, n = struct.unpack_from("<BI", content, at)
        found.append(np.cumsum(np.frombuffer(content, f"<u{width}", n, at + 5), dtype=np.int64))
        at += 5 + n * width
    return np.concatenate(found)


def _by_document(parts: pd.DataFrame) -> pd.DataFrame:
    """(key, stretches, ordinals) from a piece's parts; what has no piece keeps a null key."""
    if parts["piece"].isna().any():
        return pd.DataFrame({"key": pd.Series([None], dtype="Int64"), "stretches": [0], "ordinals": [b"".join(parts["ordinals"])]})
    keys, sizes = (np.concatenate([np.frombuffer(x, np.int64) for x in parts[c]]) for c in ("keys", "sizes"))
    owner = np.repeat(keys, sizes)
    ordinals = np.frombuffer(b"".join(parts["ordinals"]), "<i4")
    order = np.lexsort((ordinals, owner))
    found, starts = np.unique(owner[order], return_index=True)
    lists = np.split(ordinals[order], starts[1:])
    return pd.DataFrame({"key": pd.Series(found, dtype="Int64"), "stretches": list(map(len, lists)), "ordinals": list(map(packed_numbers, lists))})


def _contents(window: int, shards: int, frequent: np.ndarray, words: bool):
    """The stretches whose anchors repeat; those of a ``frequent`` anchor cut into windows, which their own hashes spread over the shards. With ``words`` the distinct ones of a piece of the input and the smallest doc_id of each,
    (shard, content, words, first); else all occurrences (shard, content, doc_id, key, start)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches, "text", 6 << 20):
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "key"))
            s = Stretches(binary_texts(batch.column("text")), hasher, window)
            firsts = np.searchsorted(s.docs, np.arange(len(ids)))
            at = np.unique(np.concatenate([firsts[d] + unpacked_numbers(o) for d, o in enumerate(batch.column("ordinals").to_pylist())]))
            begins, windows, docs, anchors = s.starts[at], s.windows[at], s.docs[at], s.anchors[at]
            cut = np.isin(anchors, frequent)
            times = np.where(cut, windows, 1)
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            begins, docs, anchors, cut, sizes = (np.repeat(x, times) for x in (begins, docs, anchors, cut, np.where(cut, 1, windows) + window - 1))
            begins = begins + inner
            ends = np.cumsum(sizes)
            flat = s.words[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)]
            place = np.arange(len(flat), dtype=np.uint64) - np.repeat(ends - sizes, sizes).astype(np.uint64)
            content = np.add.reduceat(mixed(flat ^ mixed(place + np.uint64(77))), ends - sizes) if len(ends) else np.empty(0, np.uint64)
            shard = (np.where(cut, mixed(content), anchors) % np.uint64(shards)).astype(np.int32)
            if not words:
                start = (begins - s.doc_starts[docs]).astype(np.int32)
                columns = [shard, content.view(np.int64), ids[docs], keys[docs], start]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "content", "doc_id", "key", "start"])
                continue
            order = np.lexsort((ids[docs], content))
            one = order[np.r_[True, content[order][1:] != content[order][:-1]]] if len(order) else order
            small = flat.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
            small = small[np.arange(sizes[one].sum()) + np.repeat((ends - sizes)[one] - np.cumsum(sizes[one]) + sizes[one], sizes[one])]
            offsets = pa.array(np.r_[0, np.cumsum(sizes[one]) * WORD_BYTES], pa.int32())
            texts = pa.Array.from_buffers(pa.binary(), len(one), [None, offsets.buffers()[1], pa.py_buffer(small.tobytes())])
            columns = [pa.array(shard[one]), pa.array(content[one].view(np.int64)), texts, pa.array(ids[docs][one])]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "content", "words", "first"])

    return run


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit row per bit of a symbol, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.rows, self.counts, self.zeros = [], [], []
        for level in range(self.levels):
            bits = (symbols >> (self.levels - 1 - level)) & 1 == 1
            padded = np.zeros(len(bits) // 64 * 64 + 64, bool)
            padded[: len(bits)] = bits
            row = np.packbits(padded, bitorder="little").view(np.uint64)
            self.rows.append(row)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(row), dtype=np.int64)[:-1]])
            self.zeros.append(len(bits) - int(bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.firsts = self._descend(np.zeros(alphabet, np.int64), np.arange(alphabet))

    def _descend(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[level][word] + np.bitwise_count(self.rows[level][word] & ((np.uint64(1) << rest) - np.uint64(1)))
            bit = (symbols >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place beside it."""
        return self._descend(at, symbols) - self.firsts[symbols]


class FMIndex:
    """Full-text index of short sequences, each closed by a separator of its own."""

    def __init__(self, sequences: np.ndarray, sizes: np.ndarray):
        """``sequences`` are the symbols of all sequences end to end, ``sizes`` their lengths."""
        distinct, codes = np.unique(sequences, return_inverse=True)
        n = len(sequences) + len(sizes)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        closing = self.starts + sizes
        self.text = np.zeros(n, np.int64)  # separators are 0, words from 1 on
        words = np.ones(n, bool)
        words[closing] = False
        self.text[words] = codes + 1
        rank = np.where(words, self.text + len(sizes), 0)
        rank[closing] = np.arange(len(sizes))
        length = 1
        while True:  # prefix doubling; a separator ends every comparison
            beyond = np.r_[rank[length:], np.full(min(length, n), -1)] + 1
            key = rank * (max(n, int(rank.max(initial=0))) + 2) + beyond
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]]) if n else 0
            rank, length = new, length * 2
            if not n or int(rank[order[-1]]) == n - 1 or length > int(sizes.max(initial=0)) + 1:
                break
        self.suffixes = order
        self.matrix = WaveletMatrix(self.text[order - 1], len(distinct) + 1)
        self.below = np.r_[0, np.cumsum(np.bincount(self.text, minlength=len(distinct) + 1))]

    def intervals(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the ``length`` symbols at each place of the text, until the interval holds one suffix only."""
        symbols = self.text[places + length - 1]
        low, high = self.below[symbols].copy(), self.below[symbols + 1].copy()
        for back in range(length - 2, -1, -1):
            at = np.flatnonzero(high - low > 1)
            if not len(at):
                break
            symbols = self.text[places[at] + back]
            both = self.matrix.rank(np.r_[symbols, symbols], np.r_[low[at], high[at]])
            low[at] = self.below[symbols] + both[: len(at)]
            high[at] = self.below[symbols] + both[len(at) :]
        return low, high


def first_documents(words: list[bytes], firsts: np.ndarray, window: int) -> list[np.ndarray]:
    """For every stretch the smallest doc_id of each of its windows, from an FM-index of all."""
    sizes = np.array([len(w) // WORD_BYTES for w in words], np.int64)
    symbols = np.zeros((int(sizes.sum()), 8), np.uint8)
    symbols[:, :WORD_BYTES] = np.frombuffer(b"".join(words), np.uint8).reshape(-1, WORD_BYTES)
    index = FMIndex(symbols.view(np.uint64).ravel(), sizes)
    counts = sizes - window + 1
    owner = np.repeat(np.arange(len(words)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    low, high = index.intervals(index.starts[owner] + inner, window)
    found = firsts[owner]
    shared = np.flatnonzero(high - low > 1)
    if len(shared):
        of_suffix = np.r_[firsts[np.searchsorted(index.starts, index.suffixes, side="right") - 1], np.iinfo(np.int64).max]
        lows, inverse = np.unique(low[shared], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[inverse] = high[shared]  # windows of equal length have the same interval or none in common
        found[shared] = np.minimum.reduceat(of_suffix, np.stack([lows, highs], axis=1).ravel())[::2][inverse]
    return np.split(found, np.cumsum(counts)[:-1])


def _judged(window: int):
    def run(stretches: pd.DataFrame) -> pd.DataFrame:
        found = first_documents(stretches["words"].tolist(), stretches["first"].to_numpy(), window)
        return pd.DataFrame({"shard": stretches["shard"], "content": stretches["content"], "firsts": found})

    return run


def _joined_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a document with those that touch made one, as pairs of 32-bit numbers."""
    for batch in batches:
        out = []
        for starts, ends in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
            start, order = np.array(starts), np.argsort(starts, kind="stable")
            start, reach = start[order], np.maximum.accumulate(np.array(ends)[order])
            new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
            out.append(np.stack([start[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]], axis=1).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "ranges"])


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text, ranges in zip(binary_texts(batch.column("text")), batch.column("ranges").to_pylist()):
            words = text.split()
            gone = 0
            if ranges:
                kept, done = [], 0
                for start, end in np.frombuffer(ranges, "<i4").reshape(-1, 2).tolist():
                    kept += words[done:start]
                    done = end
                gone = len(words)
                words = kept + words[done:]
                gone -= len(words)
            rows.append((len(words) + gone, gone, b" ".join(words).decode("utf-8", "replace")))
        columns = [pa.array(c) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept"])


def _kept_digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        digests = [hashlib.sha256(text).hexdigest() for text in binary_texts(batch.column("kept"))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_ranges(docs: DataFrame, window: int = 13, frequent: int = FREQUENT) -> DataFrame:
    """(key, ranges): for each document, the word ranges (start and end as 32-bit numbers) whose windows also start in a document of smaller id.

    Anchors of ``frequent`` stretches or more are listed to the tasks: a list of at most a million, as ``frequent`` grows with a very large input.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BYTES_PER_BUCKET))
    packs = known.mapInArrow(_packed_anchors(buckets, window), PACKS)
    frequent = max(frequent, size // BYTES_PER_STRETCH // 1_000_000)
    hits = packs.groupBy("bucket").applyInPandas(_repeated(frequent), "piece long, keys binary, sizes binary, ordinals binary")
    hits = hits.groupBy("piece").applyInPandas(_by_document, "key long, stretches long, ordinals binary")
    hits = hits.groupBy("key").agg(F.sum("stretches").alias("stretches"), F.collect_list("ordinals").alias("lists"))
    together = F.aggregate("lists", F.lit(b""), lambda a, b: F.concat(a, b))
    hits = written(hits.select("key", "stretches", together.alias("ordinals")), "passages-hits")
    listing = F.col("key").isNotNull()
    found, octets, stretches = hits.where(listing).agg(F.count("*"), F.sum(F.octet_length("ordinals")), F.sum("stretches")).first()
    listed = hits.where("key IS NULL").first()
    heavy = np.frombuffer(listed["ordinals"] if listed else b"", "<u8").reshape(-1, 2)
    heavy, more = np.sort(heavy[:, 0]), int(heavy[:, 1].sum()) * (window - ANCHOR_WORDS)
    shards = max(1, -(-((stretches or 0) + more) // STRETCHES_PER_SHARD))
    of_docs = known.join(checked_broadcast(hits.where("key IS NOT NULL"), (octets or 0) + ROW_BYTES * found), "key").select("doc_id", "text", "key", "ordinals")
    contents = of_docs.mapInArrow(_contents(window, shards, heavy, True), "shard int, content long, words binary, first long")
    distinct = contents.groupBy("shard", "content").agg(F.first("words").alias("words"), F.min("first").alias("first"))
    firsts = distinct.groupBy("shard").applyInPandas(_judged(window), "shard int, content long, firsts array<long>")
    met = of_docs.mapInArrow(_contents(window, shards, heavy, False), "shard int, content long, doc_id long, key long, start int")
    places = F.filter(F.sequence(F.lit(0), F.size("firsts") - 1), lambda k: F.get("firsts", k) < F.col("doc_id"))
    later = met.join(firsts, ["shard", "content"]).withColumn("places", places).where(F.size("places") > 0)
    # the windows of a stretch overlap, so what they cover is one range
    ranges = later.select("key", (F.col("start") + F.array_min("places")).alias("start"), (F.col("start") + F.array_max("places") + window).alias("end"))
    lists = ranges.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return written(lists.mapInArrow(_joined_up, "key long, ranges binary"), "passages-ranges")


def without_repeats(docs: DataFrame, window: int = 13, digest: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``; ``digest`` gives the SHA-256 of the kept text instead of it.

    Words are cut at ASCII white space and compared unchanged, by 64-bit hashes. A word goes if it lies in a window of ``window``
    words that also starts in a document of smaller doc_id; windows are judged on the input. Kept words are joined by one space.
    Null and empty texts have no words. Texts shorter than a window lose nothing. Rows that repeat an id never rule each other out;
    a row with a null id loses nothing and rules nothing out. Other columns are not read. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    ranges = repeated_ranges(keyed, window, frequent)
    found, octets = ranges.agg(F.count("*"), F.sum(F.octet_length("ranges"))).first()
    joined = keyed.join(checked_broadcast(ranges, (octets or 0) + ROW_BYTES * found), "key", "left").select("doc_id", "text", "ranges")
    kind = "kept_sha256 string" if digest else "kept string"
    return joined.mapInArrow(_kept_digest if digest else _kept, f"doc_id long, n_words long, n_removed long, {kind}")


OP3_SQL = """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
t AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS t FROM s),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) < doc_id AS again FROM t),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE again),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`without_repeats`."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
