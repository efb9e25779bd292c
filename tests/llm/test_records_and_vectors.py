"""Archives, vectors, components, the SQL twins and the pipeline."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from compare import differences
from demandgrid.llm import embedding_dedup, neighbours, warc
from demandgrid.llm.queries import ORACLES, QUERIES
from demandgrid.llm.shared import components
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"


def test_archives_read_back_whole(spark):
    body = "é" * 60
    pages = [(n, f"https://a{n % 5}.example.com/{n % 9}?q={n}#f", f"<p>{n}</p>" * (n % 40), "x") for n in range(300)]
    pages += [(500, "http://H.example.org:80/x", body, "x"), (400, "http://h.example.org/x", body, "x"), (450, None, body, "x"), (450, None, body, "x"), (None, "u", body, "x")]
    pages += [(600, "https://s.example.com/", "short", "x"), (601, "https://s.example.com/", "short", "x"), (602, "ftp://bad\r\nurl", None, "x"), (603, "", "", "x"), (604, "z", "<a>" * 300000, "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, key string").repartition(4)
    folder, shards = warc.write_archives(table)
    found = warc.lookup(folder, shards, table, with_payload=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in found) == Counter(
        (i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h, _ in pages
    )
    by_id = {r.page_id: r for r in found}
    assert by_id[400].record_type == "response" and by_id[400].refers_to is None and bytes(by_id[400].payload).decode() == body
    assert all((by_id[k].record_type, by_id[k].refers_to, by_id[k].payload) == ("revisit", 400, None) for k in (500, 450, None))
    assert by_id[600].record_type == by_id[601].record_type == "response"
    some = spark.createDataFrame([("https://a1.example.com/1?q=1",), ("http://h.example.org/x",), ("http://none.example.org/",)], "url string")
    assert sorted(r.page_id for r in warc.lookup(folder, shards, some).collect()) == [1, 400, 500]


def test_archives_are_read_by_as_many_tasks_as_there_are_shards(spark):
    table = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', id % 7, '.example.com/', id) AS url", "repeat('x', 3000) AS html")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards from few pages
    try:
        folder, shards = warc.write_archives(table)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = warc.lookup(folder, shards, table)
    tasks = found.groupBy(F.spark_partition_id()).count().count()
    assert found.count() == 4000 and shards.count() >= 4 and tasks >= shards.count() - 1


def test_archives_of_no_pages(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    folder, shards = warc.write_archives(table)
    assert warc.lookup(folder, shards, table).collect() == []


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(159, 50), (200, 200), (None, 3), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert found == {k: 0 for k in range(41)} | {k: 50 for k in [50, *range(100, 160)]}
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        rows.append((k, rng.normal(size=16).tolist(), k % 3))
    centre = rng.normal(size=16)
    rows += [(400 + k, (centre + rng.normal(0, 0.12, 16)).tolist(), 1 if k % 10 else 2) for k in range(300)]  # a hot group, partly loose
    rows += [(800 + k, (np.array(rows[k][1]) * 3 + rng.normal(0, 0.1, 16)).tolist(), k % 3) for k in range(60)]
    rows += [(900, [0.0] * 16, 1), (901, None, 1), (902, [1.0] * 15 + [None], 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 1)]
    rows += [(905, rows[3][1], None), (906, rows[3][1][:8], 0), (None, rows[4][1], 1), (5, rows[5][1], 2), (907, [], 1)]
    return rows, spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<float>, label int, cls string").repartition(3)


def fit(vector):
    return vector is not None and len(vector) > 0 and None not in vector and np.isfinite(vector).all() and np.any(vector)


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return a @ b / np.sqrt((a @ a) * (b @ b))


def test_nearest_against_brute_force(vectors):
    rows, table = vectors
    found = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    known = [(i, v) for i, v, _ in rows if i is not None and fit(v)]
    expected = {}
    for q, x in known:
        if q % 50 == 0:
            best = {}
            for i, v in known:
                if i != q and len(v) == len(x):
                    best[i] = max(cosine(x, v), best.get(i, -2))
            expected[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5]
    assert found.keys() == expected.keys()
    for q, wanted in expected.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert [g[1] for g in got] == [w[0] for w in wanted] and np.allclose([g[2] for g in got], [w[1] for w in wanted], atol=1e-12)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 50, 64)))
    near, bound = neighbours.tile_cosines(neighbours.quantised(x), neighbours.quantised(y))
    assert (np.abs(near - x @ y.T) <= bound).all() and bound.max() < 0.1


def test_vector_links_against_brute_force(vectors):
    rows, table = vectors
    usable = [k for k, (_, v, label) in enumerate(rows) if fit(v) and label is not None]
    links, group = Counter(), list(range(len(rows)))
    for a in usable:
        for b in usable:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= 0.93:
                links[a] += 1
                if a < b and group[a] != group[b]:
                    old, new = group[b], group[a]
                    group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    expected = Counter((rows[k][0], links[k], least[group[k]]) for k in range(len(rows)))
    found = embedding_dedup.link_vectors(table).collect()
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in found)
    assert sum(links.values()) > 10000
    # the window may lose a link between classes; none may be made up, and at least 99 in 100 are found
    assert sum(r.n_links for r in found) >= 0.99 * sum(links.values()) and sum((got & expected).values()) >= 0.98 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id or r.component_id is None) for r in found)


def test_vector_links_of_a_loose_hot_group(spark):
    """3,000 members at cosine about 0.96: each links with nearly all others, far more than any window holds."""
    rng = np.random.default_rng(9)
    centre, spread = rng.normal(size=64), rng.normal(size=(3000, 64))
    x = np.concatenate([centre / np.linalg.norm(centre) + spread * 0.2 / 8, rng.normal(size=(1000, 64))]).astype(np.float32)
    x = np.concatenate([x, x[2990:3010], x[2990:3010]])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T
    assert 0.955 < near[:3000, :3000].mean() < 0.965 and np.abs(near - 0.93).min() > 1e-9
    wanted = (near >= 0.93).sum(axis=1) - 1
    table = spark.createDataFrame([(k, v, 4) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(5)
    for most in (embedding_dedup.BLOCK, 300):
        found = sorted(embedding_dedup.link_vectors(table, most=most).collect())
        assert [r.n_links for r in found] == wanted.tolist()
        firsts = [0 if k < 3000 else k for k in range(4000)] + 2 * [*[0] * 10, *range(3000, 3010)]
        assert [r.component_id for r in found] == firsts and [r.kept for r in found] == [k == f for k, f in enumerate(firsts)]


def test_vector_links_of_lone_pairs_in_a_large_label(spark):
    """2,000 pairs at cosine 0.93 to 0.94 among 20,000 rows of one label, with a tight group whose blocks are counted whole."""
    rng = np.random.default_rng(10)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    lone, aside = unit(rng.normal(size=(14000, 64))), rng.normal(size=(2000, 64))
    at = rng.uniform(0.9301, 0.94, size=(2000, 1))
    first = lone[:2000]
    pairs = at * first + np.sqrt(1 - at * at) * unit(aside - (aside * first).sum(axis=1, keepdims=True) * first)
    tight = unit(unit(rng.normal(size=(1, 64))) + rng.normal(size=(4000, 64)) * 0.1 / 8)
    x = np.concatenate([lone, pairs, tight]).astype(np.float32)
    exact = unit(x.astype(float))
    wanted = np.concatenate([(exact[k : k + 2000] @ exact.T >= 0.93).sum(axis=1) - 1 for k in range(0, len(x), 2000)])
    assert wanted[:2000].sum() >= 2000 and wanted[-4000:].min() == 3999
    table = spark.createDataFrame([(k, v, 4) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(5)
    placed, blocks = embedding_dedup._in_blocks(table.selectExpr("vec_id cls", "1L m", "label", "64 dim", "embedding"), float(np.arccos(0.93)), "array<float>", 1000)
    assert placed.count() == 20000 and blocks.where("high < 0.188 AND weight > 50").count() > 0  # some are counted whole
    found = sorted(embedding_dedup.link_vectors(table, most=1000).collect())
    assert [r.n_links for r in found] == wanted.tolist()
    assert [r.component_id for r in found[14000:16000]] == list(range(2000)) and {r.component_id for r in found[16000:]} == {16000}


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect() == [] and embedding_dedup.link_vectors(table).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    assert differences(QUERIES[name](spark, "/root/testdata/sf0.001"), con, ORACLES[name]) == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        if name != "bpe":
            assert docs.columns == columns
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    kept = {r.doc_id for r in seen["quality"]}
    assert {d for d, q in labels.items() if q == 1} <= kept and len(kept & {d for d, q in labels.items() if q == 0}) <= 2
    assert len({r.doc_id for r in seen["near_dedup"]}) == len(seen["near_dedup"]) < len(seen["quality"])
    assert any("[email]" in r.text for r in seen["pii"]) and not any("@mail" in r.text for r in seen["pii"])
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["pii"]} and len(seen["bpe"]) == len(seen["mixing"])
    words = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert words(seen["mixing"]) == pytest.approx(words(seen["pii"]), rel=0.2)


def test_pipeline_on_nulls_repeats_clashing_columns_and_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rep long, key string, label string, copies int, part string, size long, set_a long, kept string"
    prose = "a plain sentence about the harbour and its boats, number {0}, which sail at dawn {0} and return at dusk {0} with fish"
    rows = [(k, " ".join(prose.format(f"{k}-{j}") for j in range(6)), "en", ["a", "b", None][k % 3], k) for k in range(24)]
    rows += [(30, None, "en", "a", None), (31, "", None, "b", 0), (32, " \n ", "en", None, 3), (None, rows[3][1] + " more", "en", "a", 1), (5, rows[5][1], "en", "b", 9)]
    rows += [(33, rows[2][1], "en", "a", 7), (34, "word " * 20000, "en", "a", 100000), (35, "write to jo.doe@mail.example.com or 10.0.0.1 now", "en", "b", 40)]
    table = spark.createDataFrame([(*r, 1, "k", "l", 2, "p", 3, 4, "y") for r in rows], schema)
    table.write.parquet(f"{tmp_path}/some/documents.parquet")
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(12)] + [(None, 1, 0), (34, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for folder in ("some", "none"):
        labels.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/some")
        assert docs.columns == table.columns, name
    found = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert set(found.columns) >= {"doc_id", "n_tokens", "ids"}
    times = Counter(r.doc_id for r in found.collect())
    assert set(times) <= {r[0] for r in rows} and max(times.values()) <= 3 and 33 not in times
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
