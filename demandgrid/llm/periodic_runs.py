"""Maximal periodic runs of words in documents: three repeats or more of one stretch of words, and at least 24 words.

For every period p a grid of places 0, p, 2p, ... meets each run at two neighbouring grid places whose words agree; all grids together
have n * (1 + 1/2 + 1/3 + ...) places. From such a pair the agreement is extended both ways by longest common extensions: a
few words are compared until both suffixes reach a place of a difference cover (any two places of a cycle of 31 do at the same
distance), then the least common prefix between their ranks among the sorted sampled suffixes says how far they agree.
Only the sampled suffixes are sorted, six of 31. The texts of a slice form one sequence, cut by words of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from demandgrid.llm.shared import binary_texts, slices

CYCLE = 31
COVER = (1, 5, 11, 24, 25, 27)  # every difference modulo 31 occurs once; fixed values
LEAST_WORDS, LEAST_REPEATS = 24, 3
NEXT_WORDS = 8  # that agree beside a run's first grid place, whatever its period
MOST_HITS = 200_000
MOST_QUERIES = 16_384


def cover_steps() -> np.ndarray:
    """[i, j]: the least number of words from places i and j (modulo the cycle) until both are in the cover."""
    inside = np.isin(np.arange(CYCLE), COVER)
    ahead = inside[(np.arange(CYCLE)[:, None] + np.arange(CYCLE)) % CYCLE]  # [place, step]
    return (ahead[:, None, :] & ahead[None, :, :]).argmax(axis=2)


class Extensions:
    """How far the suffixes at two places of a sequence agree. Symbols are 1 or more; the last one occurs nowhere else."""

    steps = cover_steps()

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        text = np.concatenate([symbols, np.zeros(CYCLE, symbols.dtype)])
        self.windows = np.lib.stride_tricks.sliding_window_view(text, CYCLE)
        places = np.flatnonzero(np.isin(np.arange(n) % CYCLE, COVER))
        self.slot = np.zeros(n + CYCLE, np.int64)
        self.slot[places] = np.arange(len(places))
        blocks = np.ascontiguousarray(self.windows[places].astype(">u4")).view(f"S{4 * CYCLE}").ravel()
        levels = [np.unique(blocks, return_inverse=True)[1].reshape(-1) + 1]
        while len(places) and levels[-1].max() < len(places):  # ranks by twice as many words each time
            after = places + (CYCLE << (len(levels) - 1))
            follow = np.where(after < n, levels[-1][self.slot[np.minimum(after, n)]], 0)
            levels.append(np.unique(levels[-1] * (len(places) + 1) + follow, return_inverse=True)[1].reshape(-1) + 1)
        self.rank = levels[-1] - 1
        by_rank = places[np.argsort(self.rank)]
        left, right = by_rank[:-1].copy(), by_rank[1:].copy()
        common = np.zeros(len(left), np.int64)
        for level in range(len(levels) - 2, -1, -1):
            equal = (left < n) & (right < n)
            equal &= levels[level][self.slot[np.minimum(left, n)]] == levels[level][self.slot[np.minimum(right, n)]]
            step = np.where(equal, CYCLE << level, 0)
            left, right, common = left + step, right + step, common + step
        for start in range(0, len(left), MOST_QUERIES):
            part = slice(start, start + MOST_QUERIES)
            common[part] += (self.windows[left[part]] != self.windows[right[part]]).argmax(axis=1)
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that agree from the places ``i`` and ``j`` on, pair by pair (i and j differ)."""
        found = [self._some(i[k : k + MOST_QUERIES], j[k : k + MOST_QUERIES]) for k in range(0, len(i), MOST_QUERIES)]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def _some(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        steps = self.steps[i % CYCLE, j % CYCLE]
        differ = self.windows[i] != self.windows[j]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), CYCLE)
        far = np.flatnonzero(common >= steps)
        step = steps[far]
        a, b = self.rank[self.slot[i[far] + step]], self.rank[self.slot[j[far] + step]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        least = np.empty(len(far), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            least[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        common[far] = step + least
        return common


class Sequence:
    """Several texts of word numbers in a row, longest first, each between two symbols that occur once."""

    def __init__(self, texts: list[np.ndarray], least: int, repeats: int):
        self.least, self.repeats = least, repeats
        sizes = np.array([len(t) for t in texts], np.int64)
        self.texts = np.argsort(-sizes, kind="stable")
        self.texts = self.texts[sizes[self.texts] >= least]
        self.sizes = sizes[self.texts]
        self.starts = np.cumsum(self.sizes + 1) - self.sizes  # of the texts; a cut comes before each and after the last
        self.symbols = np.zeros(int(self.sizes.sum()) + len(self.sizes) + 1, np.int32)
        first_cut = 1 + max((int(texts[k].max()) + 1 for k in self.texts), default=0)
        cuts = np.concatenate([self.starts - 1, [len(self.symbols) - 1]])
        self.symbols[cuts] = first_cut + np.arange(len(cuts))
        for start, k in zip(self.starts, self.texts):
            self.symbols[start : start + len(texts[k])] = texts[k] + 1
        self.padded = np.concatenate([self.symbols, np.zeros(NEXT_WORDS + 1, np.int32)])

    def hits(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, periods), periods ascending: grid places whose word and the next words agree with those one period on."""
        places, periods, held = [], [], 0
        longest = int(self.sizes[0]) // self.repeats if len(self.sizes) else 0
        enough = np.searchsorted(-self.sizes, -np.maximum(self.least, self.repeats * np.arange(longest + 1)), side="right")
        ends = np.concatenate([[0], self.starts + self.sizes])[enough]
        for period in range(1, longest + 1):
            grid = self.symbols[: ends[period] : period]
            at = np.flatnonzero(grid[1:] == grid[:-1])
            if len(at):
                places.append(at * period)
                periods.append(np.full(len(at), period, np.int64))
                held += len(at)
            if held >= MOST_HITS or period == longest and held:
                yield self._agreeing(np.concatenate(places), np.concatenate(periods))
                places, periods, held = [], [], 0

    def _agreeing(self, places: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for step in range(1, NEXT_WORDS + 1):
            keep = self.padded[places + step] == self.padded[places + periods + step]
            places, periods = places[keep], periods[keep]
        return places, periods

    def text_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def find_runs(texts: list[np.ndarray], least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> np.ndarray:
    """(text, start, length, period) of all maximal runs in lists of word numbers, sorted; ``least`` is 24 or more, ``repeats`` 3 or more.

    A first look at the grids finds the texts in which a run is possible; only these are indexed.
    """
    if least < LEAST_WORDS or repeats < LEAST_REPEATS:
        raise ValueError("shorter runs are not met by the agreeing words beside a grid place")
    whole = Sequence(texts, least, repeats)
    possible = np.unique(np.concatenate([[-1], *(whole.text_at(places) for places, _ in whole.hits())]).astype(np.int64))
    chosen = whole.texts[possible[possible >= 0]]
    if not len(chosen):
        return np.empty((0, 4), np.int64)
    some = Sequence([texts[k] for k in chosen], least, repeats)
    ahead, behind = Extensions(some.symbols), Extensions(np.ascontiguousarray(some.symbols[::-1]))
    last, found = len(some.symbols) - 1, []

    def stretches(places: np.ndarray, periods: np.ndarray) -> np.ndarray:
        """Ends of the stretches with that period around the places; those long enough are kept."""
        forward = ahead.of(places, places + periods)
        back = behind.of(last - places + 1, last - places - periods + 1)
        ends = places + periods + forward
        keep = periods + forward + back >= np.maximum(least, repeats * periods)
        found.append(np.stack([places - back, ends, periods], axis=1)[keep])
        return ends

    for places, periods in some.hits():
        if not len(places):
            continue
        chained = (periods[1:] == periods[:-1]) & (places[1:] - places[:-1] == periods[1:])
        group = np.concatenate([[0], np.cumsum(~chained)])
        first = np.flatnonzero(np.concatenate([[True], ~chained]))
        ends = stretches(places[first], periods[first])
        beyond = places + periods >= ends[group]
        stretches(places[beyond], periods[beyond])
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = runs[np.lexsort(runs.T[::-1])]
    _, first = np.unique(runs[:, 0] * (last + 2) + runs[:, 1], return_index=True)  # of stretches with the same ends, the smallest period
    start, end, period = runs[first].T
    at = some.text_at(start)
    out = np.stack([chosen[some.texts[at]], start - some.starts[at], end - start, period], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a tail that goes round, for one document in ten by the checksum of its id; a null id changes nothing."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + period]
    return words[:a] + (tail * ((n - a) // period + 1))[: n - a]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest exact length / period; ties go to the smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        ours, theirs = run[1] * best[2], best[1] * run[2]
        if ours > theirs or ours == theirs and (run[0], run[2]) < (best[0], best[2]):
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words left when each run keeps its first period only."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)
    return [words[k] for k in np.flatnonzero(gone[:-1] == 0).tolist()]


def without_runs(
    docs: DataFrame, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS, loops: bool = False, texts: bool = True, digests: bool = False
) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, and on request runs, text, runs_sha256, collapsed_sha256) for every row of ``docs``.

    Words are cut at ASCII white space. A run is a stretch of words with smallest period q and max(``least``, ``repeats`` * q) words or
    more that no neighbouring word extends; start to exponent_milli describe the run of greatest exact length / period (ties: smallest
    start, then period). ``text`` is the text with each run cut to its first q words, joined by one space; ``runs`` lists all
    runs by start, then period. ``loops`` first sends some tails round, see :func:`looped`.

    Null and empty texts have no words and no runs, and null in the four columns. A null or repeated doc_id is carried along, each row by itself.
    Columns other than doc_id and text are not read. An empty table gives no rows. Texts are never cut; a task holds
    some 8 MB of text, or one text if that is longer.
    """
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("n_runs", "bigint")]
    fields += [(name, "bigint") for name in ("start", "length", "period", "exponent_milli")]
    fields += [("runs", "array<struct<start:bigint,length:bigint,period:bigint>>"), ("text", "string")] * texts
    fields += [("runs_sha256", "string"), ("collapsed_sha256", "string")] * digests
    names = [name for name, _ in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in slices(batches, "text"):
            split = [text.split() for text in binary_texts(batch.column("text"))]
            if loops:
                split = list(map(looped, split, batch.column("doc_id").to_pylist()))
            numbers = dict.fromkeys(chain.from_iterable(split))
            for number, word in enumerate(numbers):
                numbers[word] = number
            found = find_runs([np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in split], least, repeats)
            of_text: dict[int, list[tuple[int, int, int]]] = {}
            for k, *one in found.tolist():
                of_text.setdefault(k, []).append(tuple(one))
            out = {name: [] for name in names[1:]}
            for k, words in enumerate(split):
                runs = of_text.get(k, [])
                start, length, period = greatest(runs) if runs else (None, None, None)
                shown = [len(runs), start, length, period, 1000 * length // period if runs else None]
                left = b" ".join(collapsed(words, runs) if runs else words)
                if texts:
                    shown += [[dict(zip(("start", "length", "period"), one)) for one in runs], left.decode("utf-8", "replace")]
                if digests:
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    shown += [hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
                for name, value in zip(names[1:], shown):
                    out[name].append(value)
            kinds = [kind if name == "runs" else pa.string() if name == "text" or name.endswith("sha256") else pa.int64() for name in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[n], k) for n, k in zip(names[1:], kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in fields))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts, repeats and empty tables: see :func:`without_runs`."""
    return without_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), loops=True, texts=False, digests=True)
