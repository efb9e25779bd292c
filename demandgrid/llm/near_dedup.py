"""Near-duplicate documents by b-bit MinHash.

Every document gets 512 minima over its set of word shingles; bands of six of them propose pairs. Of each minimum
only the low four bits are kept and packed, and the share of equal places, corrected for chance collisions, estimates a
pair's similarity; pairs that may reach the threshold are confirmed on their full sets.

Documents with the same set are one representative. A bucket of a band has a leader, the member that meets most others in all its buckets, and
a member is first compared with two alone, the leaders that it shares most buckets with; after the components of these links are known, only the members outside
a bucket's largest component meet those of other components, so a large group of copies does not unfold into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.shared import PIECE_BYTES, ROW_BYTES, WordHasher, binary_texts, checked_broadcast, components, frugal, mixed, run_hashes, slices, written

WORDS = 5
ROWS = 6
MOST_MISSED = 3e-7  # of the pairs exactly at the threshold, by the bands
PLACES = 512
KEPT_BITS = 4
LEADERS = 2
# A pair at a threshold of 0.85 is estimated with a deviation of about 0.017 over all places; this is five of them.
SLACK = 0.085
SHINGLE_SEED = 5


def shingle_set(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; with fewer words, of the whole sequence."""
    if len(hashes) == 0:
        return hashes
    length = min(words, len(hashes))
    return np.unique(run_hashes(hashes, length, SHINGLE_SEED * 1000 + length))


def shingle_sets(words: WordHasher, texts: list[bytes]) -> Iterator[np.ndarray]:
    """The set of each text."""
    hashes, sizes = words.of(texts)
    ends = np.cumsum(sizes)
    for end, size in zip(ends.tolist(), sizes.tolist()):
        yield shingle_set(hashes[end - size : end])


def bands_for(percent: int) -> int:
    """The bands that miss a pair at the threshold with probability ``MOST_MISSED`` or less: 32 at 85, 50 at 80."""
    return math.ceil(math.log(MOST_MISSED) / math.log1p(-((min(percent, 99) / 100) ** ROWS)))


def slack_for(percent: int) -> float:
    """As many deviations of the estimate at the threshold as ``SLACK`` is at 0.85."""

    def deviation(similarity: float) -> float:
        equal = similarity + (1 - similarity) * 2.0**-KEPT_BITS
        return math.sqrt(equal * (1 - equal))

    return SLACK * max(1.0, deviation(percent / 100) / deviation(0.85))


class MinHasher:
    """Minima of many permutations: multiply-add hashes of the upper 32 bits of a shingle's hash."""

    def __init__(self, places: int = PLACES, seed: int = 1, percent: int = 85):
        self.bands = bands_for(percent)
        places = max(places, self.bands * ROWS)
        rng = np.random.default_rng(seed)
        self.factors = (rng.integers(0, 1 << 31, places, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.offsets = rng.integers(0, 1 << 32, places, dtype=np.uint32)
        self.space = np.empty((256, places), np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), np.uint32(0xFFFFFFFF))
        for start in range(0, len(values), len(self.space)):
            part = values[start : start + len(self.space), None]
            space = np.multiply(part, self.factors, out=self.space[: len(part)])
            space += self.offsets
            np.minimum(least, space.min(axis=0), out=least)
        return least

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One key per band, of the full minima."""
        rows = minima[: self.bands * ROWS].astype(np.uint64).reshape(self.bands, ROWS)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) << np.uint64(40)
        for place in range(ROWS):
            key = mixed(key ^ rows[:, place])
        return key.view(np.int64)

    @staticmethod
    def packed(minima: np.ndarray) -> np.ndarray:
        """The low bits of all minima, sixteen places to a 64-bit number. The minima are mixed first, as their own low bits depend on few bits."""
        low = (mixed(minima[:PLACES].astype(np.uint64)) & np.uint64((1 << KEPT_BITS) - 1)).reshape(-1, 64 // KEPT_BITS)
        return np.bitwise_or.reduce(low << np.arange(0, 64, KEPT_BITS, dtype=np.uint64), axis=1).view(np.int64)


def estimated(left: Column, right: Column) -> Column:
    """Similarity by two packed signatures: places that differ counted by bits, corrected for chance collisions."""

    def differ(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        for shift in (1, 2):  # folds the four bits of a place into its lowest
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        return F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))

    places = F.aggregate(F.zip_with(left, right, differ), F.lit(0), lambda total, n: total + n)
    chance = 2.0**-KEPT_BITS
    return 1 - places / PLACES / (1 - chance)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mixed(shingles), mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(np.bitwise_xor.reduce(a).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def _signed(hasher: MinHasher):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher(lower=True)
        for batch in slices(batches, "text", PIECE_BYTES):
            sizes, set_a, set_b, bands, packed = [], [], [], [], []
            for shingles in shingle_sets(words, binary_texts(batch.column("text"))):
                sizes.append(len(shingles))
                a, b = _digest(shingles) if len(shingles) else (None, None)
                minima = hasher.minima(shingles) if len(shingles) else None
                set_a.append(a)
                set_b.append(b)
                bands.append(None if minima is None else hasher.band_keys(minima))
                packed.append(None if minima is None else hasher.packed(minima))
            columns = [pa.array(sizes, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "packed"])

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHasher(lower=True)
    for batch in slices(batches, "text", PIECE_BYTES):
        found = [shingles.view(np.int64) for shingles in shingle_sets(words, binary_texts(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.list_(pa.int64()))], ["rep", "shingles"])


def _confirmed(percent: int):
    """Keeps the pairs (a, b, set_a, set_b) with 100 * intersection >= percent * union."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k].values.to_numpy() for c in ("left", "right"))
                both = len(left) + len(right) - len(np.union1d(left, right))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(likely: DataFrame, docs: DataFrame, percent: int, label: str) -> DataFrame:
    """The (a, b) of ``likely`` pairs of representatives that link by their full sets."""
    likely = written(likely, f"{label}-likely")
    ends = [likely.select(F.col(c).alias("rep")).distinct() for c in "ab"]  # once each before they meet, not twice for every pair
    wanted = written(ends[0].union(ends[1]).distinct(), f"{label}-wanted")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(checked_broadcast(wanted, ROW_BYTES * wanted.count()), "rep")
    sets = written(texts.mapInArrow(frugal(_sets), "rep long, shingles array<long>"), f"{label}-sets")
    full = (
        likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "left", "right").mapInArrow(frugal(_confirmed(percent)), "a long, b long")
    )
    return written(full, f"{label}-links")


def link_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Texts with ASCII letters in lower case are cut into words at ASCII white space. A document's set holds its distinct shingles of five
    words (fewer words: the whole sequence), and two documents link when 100 * intersection >= ``percent`` * union, counted on
    64-bit hashes of the shingles. component_id is the smallest doc_id reachable. The bands of six minima are so
    many (32 at 85, 50 at 80) that a pair exactly at the threshold is missed with probability 3e-7 at most, a more similar one less often.

    Null and empty texts and texts of white space have size 0 and link with nothing. Rows that repeat an id are one node with the
    links of all its texts, and have a row each. A row with a null id links with nothing, has a null component and is kept.
    Other columns are not read. An empty table gives no rows.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(
        whole.mapInArrow(frugal(_signed(MinHasher(percent=percent))), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, packed array<long>"), "near-signed"
    )
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    heads = written(
        some.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "bands", "packed")).alias("h"), F.count("*").alias("n"))
        .select("set_a", "set_b", "h.*", "n").withColumnRenamed("doc_id", "rep"),
        "near-heads",
    )
    signed_heads = heads.select("rep", "bands", "packed")
    buckets = signed_heads.select("rep", F.explode("bands").alias("key"))  # an id with several texts has the buckets of all
    shared = buckets.groupBy("key").agg((F.count("*") - 1).alias("others")).where("others > 0")
    met = written(buckets.join(shared, "key"), "near-buckets")
    standing = written(met.groupBy("rep").agg(F.sum("others").alias("standing")), "near-standing")
    leaders = met.join(standing, "rep").groupBy("key").agg(F.max(F.struct("standing", -F.col("rep"))).alias("leader"))
    met = written(met.select("key", "rep").join(leaders.select("key", (-F.col("leader.col2")).alias("first")), "key"), "near-led")

    # of the leaders of its buckets a member first meets those it shares most buckets with; whom it then lacks it meets below
    by_leader = met.where("rep <> first").groupBy("rep", "first").agg(F.count("*").alias("times"))
    nearest = by_leader.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", (-F.col("first")).alias("back"))), asc=False).alias("leaders"))
    chosen = nearest.select("rep", F.explode(F.slice("leaders", 1, LEADERS)).alias("leader")).select("rep", (-F.col("leader.back")).alias("first"))
    stars = chosen.select(F.least("first", "rep").alias("a"), F.greatest("first", "rep").alias("b")).distinct()
    least = percent / 100 - slack_for(percent)
    left, right = (signed_heads.select(F.col("rep").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "ab")
    near = stars.join(left, "a").join(right, "b").where(estimated(F.col("packed_a"), F.col("packed_b")) >= least)
    links = _links(near.select("a", "b").distinct(), whole, percent, "near-stars")
    groups = components(links, "near-stars")
    grouped = met.select("key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = grouped.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = grouped.join(main.select("key", F.col("main.component").alias("main")), "key").join(signed_heads, "rep")
    open_ = written(open_.where(F.array_contains("bands", F.col("key"))), "near-open")  # an id with several texts: those in the bucket
    # the members outside a bucket's largest component meet all of the others, so that one doesn't meet itself
    aside = open_.where("component <> main").select(*(F.col(c).alias(f"other_{c}") for c in ("key", "rep", "component", "bands", "packed")))
    # a pair meets in each band it shares, but is only let through in that of the smallest key
    once = (F.col("component") == F.col("main")) | (F.col("component") < F.col("other_component"))
    once &= estimated(F.col("packed"), F.col("other_packed")) >= least
    once &= F.col("key") == F.array_min(F.array_intersect("bands", "other_bands"))
    crossing = open_.join(aside, (F.col("key") == F.col("other_key")) & once)
    crossing = crossing.select(F.least("rep", "other_rep").alias("a"), F.greatest("rep", "other_rep").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = _links(crossing, whole, percent, "near-crossing")

    groups_of_copies = heads.where("n > 1").select("set_a", "set_b", "rep")  # from the written table, so that Spark can split a large group's copies
    copies = some.join(checked_broadcast(groups_of_copies, ROW_BYTES * groups_of_copies.count()), ["set_a", "set_b"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    labels = components(links.union(more).union(copies), "near-components").withColumnRenamed("node", "doc_id")
    component = F.coalesce("component", "doc_id")
    return signed.select("doc_id", "n_shingles").join(labels, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each linked group, the one of smallest id; all columns as they were.

    Documents that link with nothing stay, among them empty ones and those with a null id. Rows that repeat an id and have words are one
    document, of which the smallest row stays.
    """
    linked = written(link_documents(docs, percent), "near-groups")
    gone = linked.where("NOT kept").select("doc_id").distinct()
    again = linked.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    n_gone, n_again = gone.count(), again.count()
    left = docs.join(checked_broadcast(gone, ROW_BYTES * n_gone), "doc_id", "left_anti").select(docs.columns)
    if not n_again:
        return left
    again = written(again, "near-again")
    once = left.join(checked_broadcast(again, ROW_BYTES * n_again), "doc_id", "left_semi")
    others = F.min(F.struct(*(F.col(f"`{c}`") for c in sorted(docs.columns, key=lambda c: c != "text") if c != "doc_id"))).alias("row")
    once = once.groupBy("doc_id").agg(others).select("doc_id", "row.*").select(docs.columns)
    return left.join(checked_broadcast(again, ROW_BYTES * n_again), "doc_id", "left_anti").select(docs.columns).union(once)


OP4_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (WITH RECURSIVE reach(doc_id, seen) AS (
        SELECT doc_id, doc_id FROM n
        UNION SELECT reach.doc_id, e2.b FROM reach JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) e2 ON reach.seen = e2.a)
      SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id, coalesce(r.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id"""


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`link_documents`."""
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
