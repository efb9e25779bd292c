"""Language-model scores by a weighted backoff automaton over all n-grams of the training documents.

Documents are laid out in blocks of numbered tokens. Each block sends its distinct n-grams, as packed arrays of 64-bit hashes with
their counts in training documents, to shards by range of the hash; a shard sums the counts of all blocks and answers each
block for the n-grams that it sent. So a block gets the part of the corpus-wide model that its own documents can touch, and nothing is
broadcast or gathered whole. From its counts a block builds the automaton: seen n-grams are states and arcs weighted by
smoothed log-probabilities, a failure arc leads from a state to that of its longest proper suffix and costs the backoff weight. One
traversal from left to right carries the state and adds up the weights, for many stretches of documents in step.

Smoothing is by a Dirichlet prior on the shorter context: P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), so a context backs off
with weight m / (c(h) + m). Words alone have P(w) = (c + 0.1) / (N + 0.1 (V + 1)).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.shared import WordHasher, binary_texts, doc_remainder, mixed, slices, written

ORDER = 2
PRIOR_WORDS = 200.0  # m: how many words of a context weigh as much as the shorter context
ADDED = 0.1
KEYS_PER_SHARD = 1_000_000
SPAN = 256  # tokens that one lane of the traversal walks
END, START = 0, 1  # local numbers of the end token and of the mark before the first word, which is never scored
MARKS = mixed(np.array([2, 3], np.uint64))  # hashes of the two


def _packed(values: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(values.tobytes(), asbytes=True)


def _laid_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its documents, the hashes of its distinct words, and all tokens as numbers of these."""
    hasher = WordHasher(lower=True)
    for number, batch in enumerate(slices(batches, "text")):
        found, sizes = hasher.of(binary_texts(batch.column("text")))
        words, places = np.unique(found, return_inverse=True)
        hashes = np.concatenate([MARKS, words])
        sizes = sizes + 2
        ends = np.cumsum(sizes)
        tokens = np.full(ends[-1], END, np.int32)
        inner = np.ones(len(tokens), bool)
        inner[ends - 1] = inner[ends - sizes] = False
        tokens[ends - sizes] = START
        tokens[inner] = places.reshape(-1) + len(MARKS)
        held = batch.column("held_out")
        learned = ~np.array(held.fill_null(True))
        row = {
            "block": pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
            "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "held_out": pa.array([held.to_pylist()], pa.list_(pa.bool_())),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "hashes": pa.array([hashes.tobytes()], pa.binary()),
            "tokens": pa.array([_packed(tokens)], pa.binary()),
            "n_words": pa.array([len(hashes)], pa.int64()),
            "n_tokens": pa.array([len(tokens)], pa.int64()),
            "train_tokens": pa.array([int((sizes - 1)[learned].sum())], pa.int64()),
            "train_docs": pa.array([int(learned.sum())], pa.int64()),
        }
        yield pa.RecordBatch.from_arrays(list(row.values()), list(row))


BLOCK = (
    "block long, doc_ids array<long>, held_out array<boolean>, sizes array<long>, hashes binary, tokens binary, "
    "n_words long, n_tokens long, train_tokens long, train_docs long"
)


class Grams:
    """The distinct n-grams of a block for n = 1 to ``order``, numbered from 0 for each n.

    ``keys[k]`` are their hashes, ``seen[k]`` how often training documents of the block have them, and for n of 2 or more ``prefix[k]``
    and ``suffix[k]`` the numbers of the n-gram without its last and without its first token, ``word[k]`` the last token.
    """

    def __init__(self, row: dict, order: int):
        self.sizes = np.array(row["sizes"], np.int64)
        self.tokens = np.frombuffer(pa.Codec("zstd").decompress(row["tokens"], 4 * row["n_tokens"], asbytes=True), np.int32)
        self.ends = np.cumsum(self.sizes)
        n, first_hashes = len(self.tokens), np.frombuffer(row["hashes"], np.uint64)
        place = np.arange(n) - np.repeat(self.ends - self.sizes, self.sizes)
        learned = np.repeat(np.array([held is False for held in row["held_out"]], bool), self.sizes)
        ids = self.tokens.astype(np.int64)
        self.keys, self.seen = [first_hashes], [np.bincount(ids, learned, len(first_hashes)).astype(np.int64)]
        self.prefix, self.suffix, self.word = [None], [None], [None]
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 1)
            pairs = ids[at - 1] * len(first_hashes) + self.tokens[at]
            unique, inverse = np.unique(pairs, return_inverse=True)
            inverse = inverse.reshape(-1)
            word = unique % len(first_hashes)
            suffix = np.zeros(len(unique), np.int64)
            suffix[inverse] = ids[at]
            self.prefix.append(unique // len(first_hashes))
            self.suffix.append(suffix)
            self.word.append(word)
            keys = mixed(self.keys[-1][self.prefix[-1]]) + first_hashes[word] * np.uint64(2 * k + 1)
            self.keys.append(mixed(keys + np.uint64(k)))
            self.seen.append(np.bincount(inverse, learned[at], len(unique)).astype(np.int64))
            ids = np.full(n, -1, np.int64)
            ids[at] = inverse

    def in_order(self, longer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, counts, where they stand) of words alone or of all longer n-grams, sorted by key."""
        part = slice(1, None) if longer else slice(0, 1)
        keys, seen = np.concatenate(self.keys[part] or [np.empty(0, np.uint64)]), np.concatenate(self.seen[part] or [np.empty(0, np.int64)])
        order = np.argsort(keys)
        return keys[order], seen[order], order


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of equal width of the sorted keys: the place where each shard's keys begin, and the end."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def _asked(order: int, shards: tuple[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, order)
                for longer in (False, True):
                    keys, seen, _ = grams.in_order(longer)
                    cuts = _shards(keys, shards[longer])
                    full = np.flatnonzero(cuts[1:] > cuts[:-1])
                    if not len(full):
                        continue
                    shown = [
                        pa.array(full + shards[0] * longer, pa.int64()),
                        pa.array(np.full(len(full), row["block"]), pa.int64()),
                        pa.array([keys[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary()),
                        pa.array([seen[cuts[s] : cuts[s + 1]].astype(np.uint32).tobytes() for s in full], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(shown, ["shard", "block", "keys", "seen"])

    return run


def _answered(words_shards: int):
    """Sums the counts of a shard's keys over all blocks; each block gets the sums for its own keys, in their order."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        seen = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("seen").to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        inverse = inverse.reshape(-1)
        total = np.bincount(inverse, seen).astype(np.int64)
        ends = np.cumsum(list(map(len, keys)))
        words = int(np.count_nonzero(total)) if table.column("shard")[0].as_py() < words_shards else 0
        counts = [_packed(total[inverse[end - len(k) : end]]) for k, end in zip(keys, ends)]
        return pa.table({
            "block": table.column("block"), "shard": table.column("shard"), "n": pa.array(list(map(len, keys)), pa.int64()),
            "counts": pa.array(counts, pa.binary()), "distinct": pa.array([words] + [0] * (len(keys) - 1), pa.int64()),
        })

    return run


class Automaton:
    """States, arcs and failure arcs of the n-grams of a block that the corpus has, with log10 weights.

    State 0 is the empty context, then come all words, then all longer n-grams below the order. The empty state has
    an arc for every word; other arcs are found by binary search for (state, word).
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: float, distinct: float, prior: float):
        order, self.words = len(counts), len(counts[0])
        chance = [(counts[0] + ADDED) / (tokens + ADDED * (distinct + 1))]
        first_state = np.cumsum([1, *map(len, counts[:-1])])  # of each n
        self.backoff = np.zeros(int(first_state[-1]))
        self.fail = np.zeros(int(first_state[-1]), np.int64)
        self.word_weight = np.log10(chance[0])
        reached = np.where(counts[0] > 0, 1 + np.arange(self.words), 0) if order > 1 else np.zeros(self.words, np.int64)
        self.word_target, arcs = reached, []
        for k in range(1, order):
            prefix, suffix = grams.prefix[k], grams.suffix[k]
            context = counts[k - 1]
            states = first_state[k - 1] + np.arange(len(context))
            self.backoff[states] = np.log10(prior / (context + prior))
            self.fail[states] = first_state[k - 2] + grams.suffix[k - 1] if k > 1 else 0
            chance.append((counts[k] + prior * chance[k - 1][suffix]) / (context[prefix] + prior))
            target = first_state[k] + np.arange(len(prefix)) if k < order - 1 else first_state[k - 1] + suffix
            there = np.flatnonzero(counts[k] > 0)
            arcs.append(((first_state[k - 1] + prefix[there]) * self.words + grams.word[k][there], np.log10(chance[k][there]), target[there]))
        keys, weights, targets = (np.concatenate(x) for x in zip(*arcs)) if arcs else (np.empty(0, np.int64),) * 3
        by_key = np.argsort(keys)
        self.arcs = np.append(keys[by_key], np.iinfo(np.int64).max)
        self.weights, self.targets = np.append(weights[by_key], 0.0), np.append(targets[by_key], 0)

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, next states) when each state reads a word, over as many failure arcs as it takes."""
        total, after = np.zeros(len(states)), np.zeros(len(states), np.int64)
        open_ = np.arange(len(states))
        while len(open_):
            at_root = states[open_] == 0
            root, open_ = open_[at_root], open_[~at_root]
            total[root] += self.word_weight[words[root]]
            after[root] = self.word_target[words[root]]
            wanted = states[open_] * self.words + words[open_]
            at = np.searchsorted(self.arcs, wanted)
            found = self.arcs[at] == wanted
            hit, open_ = open_[found], open_[~found]
            total[hit] += self.weights[at[found]]
            after[hit] = self.targets[at[found]]
            total[open_] += self.backoff[states[open_]]
            states[open_] = self.fail[states[open_]]
        return total, after

    def score(self, tokens: np.ndarray, sizes: np.ndarray, order: int, span: int = SPAN) -> np.ndarray:
        """log10 probability of each document, of its tokens after the start mark.

        Lanes of ``span`` tokens walk in step. A lane inside a document first reads the order - 1 tokens before it without counting
        them, which leads to the very state that a walk from the document's start would carry there.
        """
        starts = np.cumsum(sizes) - sizes + 1
        lanes = -(-(sizes - 1) // span)
        doc = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[doc] + nth * span
        end = np.minimum(begin + span, starts[doc] + sizes[doc] - 1)
        place = np.maximum(begin - (order - 1), starts[doc])
        at_start = place == starts[doc]
        by_length = np.argsort(place - end, kind="stable")
        doc, begin, end, place, at_start = (x[by_length] for x in (doc, begin, end, place, at_start))
        states = np.where(at_start, self.word_target[START], 0)
        total = np.zeros(len(doc))
        walking = len(doc)
        while walking:
            weights, states[:walking] = self.step(states[:walking].copy(), tokens[place[:walking]])
            total[:walking] += np.where(place[:walking] >= begin[:walking], weights, 0.0)
            place[:walking] += 1
            while walking and place[walking - 1] >= end[walking - 1]:
                walking -= 1
        return np.bincount(doc, total, len(sizes))


def _walked(order: int, tokens: int, distinct: int, prior: float):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        grams = Grams(row, order)
        answered = [
            np.frombuffer(pa.Codec("zstd").decompress(r["counts"], 8 * r["n"], asbytes=True), np.int64)
            for r in answers.sort_by("shard").to_pylist()
        ]
        answered = np.concatenate(answered)
        flat = np.empty(len(answered), np.int64)
        (_, _, words), (_, _, longer) = grams.in_order(False), grams.in_order(True)
        flat[np.concatenate([words, len(words) + longer])] = answered
        counts = np.split(flat, np.cumsum(list(map(len, grams.keys)))[:-1])
        automaton = Automaton(grams, counts, tokens, distinct, prior)
        ends = np.cumsum(grams.sizes)
        alone, known = automaton.word_weight[grams.tokens], (counts[0] > 0)[grams.tokens].astype(np.int64)
        alone[ends - grams.sizes], known[ends - grams.sizes] = 0.0, 0  # the start marks
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()),
            "n_tokens": grams.sizes - 1, "n_known": np.add.reduceat(known, ends - grams.sizes),
            "base_score": np.add.reduceat(alone, ends - grams.sizes),
            "score": automaton.score(grams.tokens, grams.sizes, order),
        })

    return run


def scored(
    docs: DataFrame, held_out: Column, order: int = ORDER, prior: float = PRIOR_WORDS, keys_per_shard: int = KEYS_PER_SHARD
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The model of n-grams up to ``order`` learns from the rows whose ``held_out`` is false. Tokens are the words of a text (ASCII letters
    in lower case, cut at ASCII white space) and one end. n_known counts tokens that training has, base_score is the
    log10 probability by words alone, score that of the automaton. Words and n-grams are told apart by 64-bit hashes.

    Null and empty texts are their end alone. A row whose ``held_out`` is null (a null id, in the query) is scored and not learned from. Rows that
    repeat an id are learned and scored one by one. Without training rows every token is unknown and has probability 1; an empty table
    gives no rows. Other columns are not read. Texts are never cut: a block holds some 8 MB of text, or one longer text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    blocks = written(rows.mapInArrow(_laid_out, BLOCK), "lm-blocks")
    n_words, n_tokens, tokens, train_docs = (
        x or 0 for x in blocks.agg(*map(F.sum, ("n_words", "n_tokens", "train_tokens", "train_docs"))).first()
    )
    shards = (1 + n_words // keys_per_shard, 1 + (order - 1) * n_tokens // keys_per_shard)
    asked = blocks.mapInArrow(_asked(order, shards), "shard long, block long, keys binary, seen binary")
    answer = "block long, shard long, n long, counts binary, distinct long"
    answers = written(asked.groupBy("shard").applyInArrow(_answered(shards[0]), answer), "lm-answers")
    distinct = (answers.agg(F.sum("distinct")).first()[0] or 0) - bool(train_docs)  # without the start mark
    walked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _walked(order, tokens, distinct, prior),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return walked.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


OP11_SQL = f"""
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step),
docs AS (
  SELECT doc_id, list_concat(coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []), ['']) AS w,
         xor(list_reduce(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
                         lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10 = 0 AS held_out
  FROM documents CROSS JOIN step),
tokens AS (SELECT doc_id, held_out, unnest(w) AS word, unnest(list_concat([' '], w[:-2])) AS prev FROM docs),
alone AS (SELECT word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY word),
totals AS (SELECT sum(c) AS n, count(*) AS v FROM alone),
context AS (SELECT prev, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY prev),
pairs AS (SELECT prev, word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY prev, word),
chances AS (
  SELECT t.doc_id, a.c IS NOT NULL AS known, n, (coalesce(a.c, 0) + {ADDED}e0) / (n + {ADDED}e0 * (v + 1)) AS p, coalesce(x.c, 0) AS of_context, coalesce(b.c, 0) AS of_pair
  FROM tokens t CROSS JOIN totals LEFT JOIN alone a USING (word) LEFT JOIN context x ON x.prev = t.prev LEFT JOIN pairs b ON b.prev = t.prev AND b.word = t.word)
SELECT c.doc_id, d.held_out, count(*) AS n_tokens, CAST(count(*) FILTER (known) AS BIGINT) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       sum(log10(p)) AS base_score, sum(log10((of_pair + {PRIOR_WORDS}e0 * p) / (of_context + {PRIOR_WORDS}e0))) AS score
FROM chances c JOIN docs d USING (doc_id) GROUP BY c.doc_id, d.held_out"""


def op11_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts, repeats and empty tables: see :func:`scored`."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_remainder("doc_id", 10) == 0)
