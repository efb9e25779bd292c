"""Operators on texts against plain versions, on small tables with nulls, ties, repeats and clashing column names."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from demandgrid.llm import bpe, langid, mixing, near_dedup, pii, quality, substring_dedup
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, shard string, size string, rep string"


@pytest.fixture(scope="module")
def rows():
    """Texts with shared passages, near copies, exact copies, a repeated id, null ids, null, empty and very long texts."""
    rng = random.Random(4)
    words = [f"w{n}" for n in range(400)] + ["Été", "naïve", "日本", "a,b"]
    base = [rng.choice(words) for _ in range(80)]
    out = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 13, 40, 90]))]
        if k % 3 == 0:
            start = rng.randrange(30)
            text += base[start : start + rng.randrange(10, 40)]
        if k % 5 == 0:
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(80)] = rng.choice(words)
        if k % 7 == 0 and out and out[-1][1]:
            text = out[-1][1].split()
        out.append((k * 3 % 61, rng.choice([" ", "\n", "\t ", "\x0b"]).join(text)))
    long = " ".join(rng.choice(words) for _ in range(20000))
    out += [(100, None), (101, ""), (102, " \n "), (103, long), (104, "x " + long), (None, " ".join(base)), (None, None), (5, out[5][1]), (9, " ".join(base)), (9, "other words here")]
    return [(i, t, ["en", "de", None][n % 3], ["a", "b", None, "é"][n % 4], None if n % 2 else len(t or ""), "k", "s", "z", "r") for n, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_repeated_passages(docs, rows, empty):
    where = defaultdict(set)
    for i, text, *_ in rows:
        words = split(text)
        if i is not None:
            for k in range(len(words) - 12):
                where[tuple(words[k : k + 13])].add(i)
    expected = []
    for i, text, *_ in rows:
        words, gone = split(text), set()
        for k in range(len(words) - 12):
            if i is not None and min(where[tuple(words[k : k + 13])]) < i:
                gone |= set(range(k, k + 13))
        expected.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    found = [tuple(r) for r in substring_dedup.without_repeats(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    cut = [tuple(r) for r in substring_dedup.without_repeats(docs, frequent=2).collect()]
    assert sorted(cut, key=repr) == sorted(found, key=repr)  # windows of frequent anchors one by one
    few_buckets, substring_dedup.BYTES_PER_BUCKET = substring_dedup.BYTES_PER_BUCKET, 3000
    try:
        many = [tuple(r) for r in substring_dedup.without_repeats(docs, frequent=9).collect()]
    finally:
        substring_dedup.BYTES_PER_BUCKET = few_buckets
    assert sorted(many, key=repr) == sorted(found, key=repr)
    digests = {r["kept_sha256"] for r in substring_dedup.without_repeats(docs, digest=True).collect()}
    assert digests == {hashlib.sha256(e[3].encode()).hexdigest() for e in expected}
    assert substring_dedup.without_repeats(empty).collect() == []


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 3, rng.integers(4, 20)).astype(np.uint64) for _ in range(60)]
    sizes = np.array([len(s) for s in sequences])
    index = substring_dedup.FMIndex(np.concatenate(sequences), sizes)
    text = index.text
    places = np.concatenate([start + np.arange(size - 3) for start, size in zip(index.starts, sizes)])
    low, high = index.intervals(places, 4)
    for place, a, b in zip(places, low, high):
        same = {k for k in range(len(text) - 3) if (text[k : k + 4] == text[place : place + 4]).all()}
        if b - a > 1:
            assert set(index.suffixes[a:b].tolist()) == same
        else:
            assert same == {place}


def plain_groups(rows, percent):
    sets = defaultdict(list)
    for i, text, *_ in rows:
        words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if words and i is not None:
            sets[i].append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if group[a] < group[b] and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    group[b], changed = group[a], True
    return group, sets


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, rows, empty, percent):
    group, sets = plain_groups(rows, percent)
    found = near_dedup.link_documents(docs, percent).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == group.get(r.doc_id, r.doc_id) and r.kept == (r.component_id == r.doc_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]} | {0}
    assert near_dedup.link_documents(empty).collect() == []


def test_one_document_of_each_group_stays(docs, rows):
    group, _ = plain_groups(rows, 85)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({i for i, *_ in rows if i is not None and group.get(i, i) == i})


@pytest.mark.parametrize("percent", [85, 80])
def test_bands_follow_the_threshold(percent):
    hasher = near_dedup.MinHasher(percent=percent)
    keys = hasher.band_keys(hasher.minima(np.arange(1, 1 << 40, 1 << 32, dtype=np.uint64)))
    assert len(set(keys.tolist())) == len(keys) == (32 if percent == 85 else 50)
    assert (1 - (percent / 100) ** near_dedup.ROWS) ** len(keys) <= 3e-7
    # the estimate's lower cut: the chance that a pair at the threshold has too few equal places of 512
    equal = percent / 100 + (1 - percent / 100) / 16
    least = 512 * (1 - (1 - percent / 100 + near_dedup.slack_for(percent)) * 15 / 16)
    lost = sum(math.exp(math.lgamma(513) - math.lgamma(k + 1) - math.lgamma(513 - k) + k * math.log(equal) + (512 - k) * math.log(1 - equal)) for k in range(math.ceil(least)))
    assert lost < 2e-6


def test_estimate_is_close(spark):
    hasher, rng = near_dedup.MinHasher(), np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    pairs = []
    for share in (0, 300, 700, 900):
        a, b = pool[:1000], np.r_[pool[:share], pool[1000 : 2000 - share]]
        true = share / (2000 - share)
        pairs.append((true, *(hasher.packed(hasher.minima(x)).tolist() for x in (a, b))))
    found = spark.createDataFrame(pairs, "true double, a array<long>, b array<long>").withColumn("estimate", near_dedup.estimated(F.col("a"), F.col("b")))
    assert all(abs(r["true"] - r.estimate) < 0.1 for r in found.collect())


def test_bpe_agrees_with_the_library(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.VOCABULARY)
    rng = random.Random(8)
    odd = ["aaaaaaa bbbb", "<|endoftext|> a<|endoftext|><|endoftext|>", "  lead and trail  ", "a\x1cb\x85c\xa0d　", "don't WE'LL 's", "日本語 😀 é́"]
    odd += ["".join(rng.choice("ab  \n'sé1日!😀\t") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts = {k: t for k, t in enumerate(odd)} | {1000: None}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in bpe.encoded(table, decoded=True, digests=True).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), text)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    counts = sorted(((r.doc_id, r.n_tokens) for r in bpe.encoded(docs, ids=False).collect()), key=str)
    assert counts == sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows), key=str)
    assert bpe.encoded(empty).collect() == []


def test_base_personal_data_is_that_of_the_patterns():
    plain = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }

    def fits(kind, span):
        digits = [int(c) for c in span if c in "0123456789"]
        doubled = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        return {
            "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in span.split(".")),
            "card": 14 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 10 <= len(digits) <= 15,
        }[kind]

    rng = random.Random(5)
    parts = ["a", "@", ".", "-", "+", "1", "23", "456", "255", "0007", " ", "_", "é", "(", ")", "4111 1111 1111 1111", "x.com"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        expected = {(k, m.start(), m.end()) for k, p in plain.items() for m in p.finditer(text) if fits(k, m[0])}
        assert {(k, s, e) for k, s, e, base in pii.matches(text) if base} == expected


def test_personal_data_spans_and_redaction(spark, docs, empty):
    # the hints repeat, so the labelers agree and the loose number is learned to be one
    texts = [f"Call phone +1 (988) 555-{n} or phone 212 555 {n}, mail a{n}@x.com" for n in range(2000, 2040)] + [None, "", "plain 12 words", "9" * 100000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_data(table).collect()}
    assert found[0].spans == "phone:11:28,phone:38:50,email:57:68"
    assert (found[0].n_email, found[0].n_phone, found[0].n_ip, found[0].n_card) == (1, 1, 0, 0)
    assert found[0].base_sha256 == hashlib.sha256(b"phone:11:28,email:57:68").hexdigest()
    assert all(found[k].spans == "" for k in (40, 41, 42, 43))
    clean = {r.doc_id: r.text for r in pii.redacted(table).collect()}
    assert clean[0] == "Call phone [phone] or phone [phone], mail [email]" and clean[40] is None and clean[42] == texts[42]
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(docs).count() == docs.count()
    assert pii.personal_data(empty).collect() == []


def test_labelers_are_weighed():
    patterns = np.array([[1, 1, 1, 1], [0, 1, 1, 1], [0, -1, 0, 1], [-1, -1, 0, -1]])
    rates, posterior = pii.expectation_maximisation(patterns, np.array([100.0, 50, 60, 80]))
    assert posterior[0] > 0.9 > 0.1 > posterior[3]
    assert rates[1, 0, 2] > rates[0, 0, 2]
    assert np.allclose(rates.sum(axis=2), 1)


def test_language_model(spark, docs, empty):
    speech = {"en": "the and of that with", "de": "der und nicht mit eine", "es": "que los para una año"}
    table = spark.createDataFrame(
        [(n * 10 + k, f"{text} {n}", lang) for n in range(40) for k, (lang, text) in enumerate(speech.items())], "doc_id long, text string, lang string"
    )
    model = langid.train(table, F.lit(True))
    asked = spark.createDataFrame([(1, "und der mit"), (2, "the that"), (3, "12 !"), (4, None), (5, ""), (None, "para los"), (7, "the " * 30000)], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, model).collect()}
    assert [found[k][0] for k in (1, 2, 3, 4, 5, None, 7)] == ["de", "en", "und", "und", "und", "es", "en"]
    assert all(0 <= score <= 1 for _, score in found.values()) and found[3][1] == 0
    none = langid.train(empty, F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"} and langid.identify(empty, none).collect() == []


def test_language_model_is_plain_naive_bayes(spark):
    rng = random.Random(12)
    letters = {"en": "the and of tie on", "de": "der und nüß ein öl", "es": "que año para té"}
    texts = [(k, " ".join(rng.choice(letters[lang].split()) for _ in range(rng.randrange(1, 30))), lang) for k, lang in enumerate(rng.choices(list(letters), [5, 2, 1], k=150))]
    table = spark.createDataFrame([*texts, (900, None, "en"), (901, "the", None)], "doc_id long, text string, lang string").repartition(4)
    model = langid.train(table, F.lit(True))
    counts, docs_of = defaultdict(lambda: defaultdict(float)), defaultdict(int)
    for _, text, lang in texts:
        docs_of[lang] += 1
        for bucket in langid.ngram_buckets(text).tolist():
            counts[lang][bucket] += 1
    size = 1 << langid.BITS
    asked = [t for _, t, _ in texts] + ["ein the", "ÑANDÚ té", "12", "", None, "x", "the öl " * 4000]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(asked):
        if not any(map(str.isalpha, text or "")):
            assert (found[k].lang_pred, found[k].score) == ("und", 0)
            continue
        logs = {}
        for lang in letters:
            all_counts = sum(counts[lang].values()) + 0.1 * size
            logs[lang] = math.log(docs_of[lang]) + sum(math.log((counts[lang][b] + 0.1) / all_counts) for b in langid.ngram_buckets(text).tolist())
        best = max(logs, key=logs.get)
        assert found[k].lang_pred == best
        assert found[k].score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-3)


def test_character_ngrams_overlap_and_ignore_case():
    one, two = langid.ngram_buckets("AbC"), langid.ngram_buckets("abc")
    assert one.tolist() == two.tolist() and len(one) == 3 + 2 + 1 and langid.ngram_buckets("").tolist() == []
    apart = [langid.ngram_buckets(x).tolist() for x in ("ab", "bc", "b")]
    assert {*apart[0][2:], *apart[1][2:], apart[2][0]} <= set(one.tolist())


def test_rare_language_is_learned_from_a_thinned_sample(spark):
    table = spark.range(4000).selectExpr("id doc_id", "IF(id % 800 = 7, 'que los para una', 'the and of that') text", "IF(id % 800 = 7, 'es', 'en') lang")
    model = langid.train(table, F.lit(True), most_docs=20)
    assert model.languages == ["en", "es"] and np.allclose(np.exp(model.priors), [3995, 5])
    assert model.score(["para los", "the that"])[0] == ["es", "en"]


def test_language_accuracy_on_held_out_rows(spark, folder):
    from demandgrid.llm.queries import QUERIES

    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(truth, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_factorisation_machine_identity():
    rng = np.random.default_rng(3)
    size = (1 << quality.BITS) + 3
    machine = quality.Machine(0.2, rng.normal(size=size), rng.normal(0, 0.3, (size, quality.RANK)), np.zeros(3), np.ones(3))
    buckets, values, stats = np.array([5, 9, 700]), np.array([0.5, 0.2, 0.8]), [0.4, -1.0, 2.0]
    x, at = np.r_[values, np.array(stats) / 4], np.r_[buckets, (1 << quality.BITS) + np.arange(3)]
    margin = 0.2 + machine.linear[at] @ x + sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(6) for j in range(i))
    assert machine.score(buckets, values, stats) == pytest.approx(1 / (1 + np.exp(-margin)))


def test_quality_on_held_out_rows(spark, docs, empty):
    from demandgrid.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op6_quality"](spark, folder).where("held_out").join(labels, "doc_id")
    assert found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] >= 0.93
    machine = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), labels, F.lit(True))
    scores = [r.score for r in quality.scored(docs, machine).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.accepted(docs, machine).count() == sum(s >= 0.3 for s in scores)
    assert quality.train(docs, labels.limit(0), F.lit(True)) is None and quality.accepted(docs, None).count() == docs.count()
    assert quality.scored(empty, machine).collect() == []


def test_mix_reaches_its_targets(spark, docs, rows, empty):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    sizes, targets, taken, largest = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        targets[r.source] = r.target
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1 and targets[s] <= 3 * sizes[s] for s in sizes)
    free = [targets[s] / w for s, w in zip([*sorted(s for s in sizes if s is not None), None], [5, 2, 1, 5]) if targets[s] < 3 * sizes[s]]
    assert max(free) == pytest.approx(min(free))
    assert mixing.mix(empty).collect() == [] and mixing.repeated(empty).collect() == []
    assert mixing.repeated(docs).columns == docs.columns


def test_empty_documents_of_a_capped_source_stay_within_its_epochs(spark):
    rows = [(k, "small", "" if k % 30 == 0 else None if k % 30 == 1 else "w w w") for k in range(60)] + [(k, "large", "w " * 500) for k in range(60, 160)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id: r for r in mixing.mix(table, weights=(1, 5)).collect()}
    assert max(r.copies for r in found.values()) <= 3 and {found[k].copies for k in range(60)} == {3}
    assert mixing.repeated(table, weights=(1, 5)).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_mix_of_a_hot_source(spark):
    table = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 40) END AS source", "repeat('w ', CAST(id % 17 AS INT)) AS text")
    found = mixing.mix(table, per_bucket=50).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 8.5 for r in found)
    counted = mixing.repeated(table, per_bucket=50).count()
    assert counted == mixing.mix(table, per_bucket=50).agg(F.sum("copies")).first()[0]
