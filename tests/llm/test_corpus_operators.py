"""Importance resampling, language-model scoring and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from demandgrid.llm import backoff_lm, periodic_runs, resampling
from demandgrid.llm.shared import doc_remainder
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, n_words string, row string, score string, part string"


@pytest.fixture(scope="module")
def rows():
    """Texts of many sizes, with ties and repeated rows, a repeated id, null ids, null, empty and very long texts."""
    rng = random.Random(8)
    words = [f"w{n}" for n in range(120)] + ["Été", "naïve", "日本", "A,b", "x" * 150, "Foo-Bar"]
    out = []
    for k in range(70):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 40, 90]))]
        if k % 6 == 0 and out and out[-1][1]:
            text = out[-1][1].split()
        if k % 5 == 0:
            text += text[-rng.randrange(1, 12):] * rng.randrange(2, 9)
        out.append((k * 3 % 71, rng.choice([" ", "\n", "\t ", "\x0b"]).join(text)))
    long = " ".join(rng.choice(words) for _ in range(20000))
    out += [(100, None), (101, ""), (102, " \n - "), (103, long), (104, "y " * 30000), (None, "a b " * 30), (None, None), (9, "other words here"), (10, out[10][1])]
    out += [(200, "same words again " * 9)] * 5
    return [(i, t, "n", "r", "s", "p") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(rows, target, percent):
    def buckets(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for text in texts for f in features(text)[1])

    s, t = buckets(r[1] for r in rows), buckets(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    out, open_ = [], []
    for k, (i, text, *_) in enumerate(rows):
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in (zlib.crc32(f.encode()) % 10000 for f in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            open_.append(k)
    drawn = sorted(open_, key=lambda k: (-out[k][3], out[k][0] is None, out[k][0], out[k][1]))[: len(open_) * percent // 100]
    for rank, k in enumerate(drawn, 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [25, 100])
def test_importance_resampling(spark, docs, rows, percent):
    target = [" ".join(f"w{n}" for n in range(a, a + 30)) for a in range(0, 60, 7)] + [None, "", "Foo bar"]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = resampling.resample(docs, benchmark, percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_resample(rows, target, percent)


def test_importance_resampling_of_empty_tables(docs, rows, empty):
    assert resampling.resample(empty, docs).collect() == []
    found = sorted((tuple(r) for r in resampling.resample(docs, empty).collect()), key=repr)
    assert found == plain_resample(rows, [], 25)


def test_cutoff_among_many_ties(spark):
    table = spark.range(3000).selectExpr("id % 7 - 3 AS down", "id % 11 AS tie", "id AS row")
    for want in (0, 1, 430, 3000):
        chosen = table.where(resampling.drawn_rows(table, ["down", "tie", "row"], want)).collect()
        everything = sorted((k % 7 - 3, k % 11, k) for k in range(3000))
        assert sorted(map(tuple, chosen)) == everything[:want]


def test_pair_checksums_are_those_of_the_joined_words():
    words = ["a", "b" * 63, "c" * 64, "d" * 65, "é" * 200, "z9"]
    _, one, two = resampling.FeatureBuckets().of([" ".join(words).encode(), b"", b"lone"])
    assert one.tolist() == [zlib.crc32(w.encode()) % 10000 for w in [*words, "lone"]]
    pairs = [zlib.crc32(f"{a} {b}".encode()) % 10000 for a, b in zip(words, words[1:])]
    assert two.tolist() == [*pairs, -1, -1]


def plain_runs(words, least=24, repeats=3):
    """By direct comparison for every period; stretches with the same ends keep their smallest period."""
    found = {}
    for period in range(1, len(words) // repeats + 1):
        start = None
        for k in range(len(words) - period + 1):
            same = k < len(words) - period and words[k] == words[k + period]
            if same and start is None:
                start = k
            elif not same and start is not None:
                if k - start + period >= max(least, repeats * period):
                    found.setdefault((start, k + period), period)
                start = None
    return sorted(((start, end - start, period) for (start, end), period in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(i, text, loops):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    if loops and i is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words)
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, [tuple(r) for r in runs], kept)


@pytest.mark.parametrize("loops", [False, True])
def test_periodic_runs(docs, rows, empty, loops):
    short = [r for r in rows if len((r[1] or "").split()) < 1000]
    long = docs.where("size(split(text, ' ')) > 1000")
    found = periodic_runs.without_runs(docs.join(long.select("doc_id"), "doc_id", "left_anti"), loops=loops, digests=True).collect()
    expected = [plain_collapse(i, text, loops) for i, text, *_ in short]
    assert sum(e[1] for e in expected) > 8
    shown = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, [tuple(x) for x in r.runs], r.text) for r in found]
    assert sorted(shown, key=repr) == sorted(expected, key=repr)
    digests = sorted((r.runs_sha256, r.collapsed_sha256) for r in found)
    assert digests == sorted((hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in e[6]).encode()).hexdigest(), hashlib.sha256(e[7].encode()).hexdigest()) for e in expected)
    assert periodic_runs.without_runs(empty, loops=loops).collect() == []


def test_one_run_through_a_very_long_text(docs):
    found = {r.doc_id: r for r in periodic_runs.without_runs(docs).collect()}
    assert (found[104].start, found[104].length, found[104].period, found[104].text) == (0, 30000, 1, "y")
    assert found[103].n_runs == 0 and len(found[103].text.split()) == 20000


def test_runs_of_random_sequences():
    rng = np.random.default_rng(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 8)):
            n = int(rng.integers(0, 160))
            text = rng.integers(0, rng.integers(1, 4), n).astype(np.int32)
            if rng.random() < 0.6 and n > 5:
                a = int(rng.integers(0, n))
                period = 1 + (n - a) // int(rng.integers(3, 12))
                text[a:] = np.resize(text[a : a + period].copy(), n - a)
                if rng.random() < 0.5:
                    text[rng.integers(0, n)] = 9
            texts.append(text)
        expected = [(k, *run) for k, text in enumerate(texts) for run in plain_runs(text.tolist())]
        assert list(map(tuple, periodic_runs.find_runs(texts).tolist())) == expected


def test_extensions_between_any_two_places():
    differences = sorted((a - b) % 31 for a in periodic_runs.COVER for b in periodic_runs.COVER if a != b)
    assert differences == list(range(1, 31))
    rng = np.random.default_rng(5)
    symbols = np.append(np.resize(rng.integers(1, 3, 70), 400), 7).astype(np.int32)
    symbols[200] = 5
    i, j = (x.ravel() for x in np.meshgrid(np.arange(0, 400, 3), np.arange(1, 400, 7)))
    i, j = i[i != j], j[i != j]
    plain = [next(k for k in range(401) if max(a, b) + k > 400 or symbols[a + k] != symbols[b + k]) for a, b in zip(i.tolist(), j.tolist())]
    assert periodic_runs.Extensions(symbols).of(i, j).tolist() == plain


def plain_scores(rows, order, prior):
    """The smoothed probabilities by recursion over plain counts, context by context."""
    texts = [(i, None if i is None else zlib.crc32(str(i).encode()) % 10 == 0, [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), ""]) for i, t, *_ in rows]
    seen = Counter()
    for _, held, words in texts:
        if held is False:
            marked = [None, *words]
            for n in range(1, order + 1):
                seen.update(tuple(marked[k : k + n]) for k in range(len(marked) - n + 1))
    starts = seen.pop((None,), 0)
    counts = {g: n for g, n in seen.items() if len(g) == 1}
    total, distinct = sum(counts.values()), len(counts)

    def chance(context, word):
        if not context:
            return (seen[(word,)] + 0.1) / (total + 0.1 * (distinct + 1))
        own = starts if context == (None,) else seen[context]
        return (seen[(*context, word)] + prior * chance(context[1:], word)) / (own + prior)

    out = []
    for i, held, words in texts:
        marked = [None, *words]
        base = sum(math.log10(chance((), w)) for w in words)
        score = sum(math.log10(chance(tuple(marked[max(0, k - order + 1) : k]), marked[k])) for k in range(1, len(marked)))
        out.append((i, held, len(words), sum(seen[(w,)] > 0 for w in words), total, base, score))
    return out


@pytest.mark.parametrize("order, prior, per_shard", [(1, 5.0, 10**6), (2, 200.0, 10**6), (2, 0.5, 90), (3, 7.0, 300)])
def test_language_model_scores(docs, rows, order, prior, per_shard):
    found = backoff_lm.scored(docs, doc_remainder("doc_id", 10) == 0, order, prior, per_shard)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[:5]), round(r[5], 6), round(r[6], 6))
    found, expected = sorted(map(tuple, found.collect()), key=key), sorted(plain_scores(rows, order, prior), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9)


def test_language_model_without_training_rows_or_rows(docs, rows, empty):
    found = backoff_lm.scored(docs, F.lit(True)).collect()
    assert len(found) == len(rows) and {(r.n_known, r.train_tokens, r.base_score, r.score) for r in found} == {(0, 0, 0.0, 0.0)}
    assert backoff_lm.scored(empty, F.lit(False)).collect() == []


def test_lanes_carry_the_state_of_a_walk_from_the_start():
    rng = np.random.default_rng(6)
    sizes = np.array([2, 40, 3, 500, 17])
    tokens = rng.integers(2, 9, sizes.sum()).astype(np.int32)
    ends = np.cumsum(sizes)
    tokens[ends - 1], tokens[ends - sizes] = backoff_lm.END, backoff_lm.START
    row = {"sizes": sizes.tolist(), "tokens": backoff_lm._packed(tokens), "n_tokens": len(tokens), "held_out": [False] * 3 + [True, False]}
    row["hashes"] = np.arange(1, 10, dtype=np.uint64).tobytes()
    for order in (1, 2, 3, 4):
        grams = backoff_lm.Grams(row, order)
        automaton = backoff_lm.Automaton(grams, grams.seen, int(grams.seen[0].sum() - 4), 8, 2.0)
        whole = automaton.score(tokens, sizes, order, 10**6)
        for span in (1, 7, 64):
            assert np.allclose(automaton.score(tokens, sizes, order, span), whole)
    # the chances of all next words add up to one in every state but that of the end, less the share of unknown words
    grams = backoff_lm.Grams(row, 2)
    automaton = backoff_lm.Automaton(grams, grams.seen, int(grams.seen[0].sum() - 4), 8, 2.0)
    states = np.delete(np.arange(len(automaton.fail)), 1 + backoff_lm.END)
    sums = sum(10 ** automaton.step(states.copy(), np.full(len(states), w))[0] for w in range(9) if w != backoff_lm.START)
    assert (sums <= 1 + 1e-9).all() and (sums > 0.99).all()
