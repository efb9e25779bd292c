"""What the pipeline's stages leave behind in the Python workers, which Spark keeps for later stages."""

import corpus_pipeline
import pyarrow as pa
from demandgrid.llm import bpe, shared

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_stage_returns_what_arrow_keeps(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"words of text number {k // 2} " * 4, "en", "web", 9) for k in range(8)], COLUMNS)
    spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kind, runs, returned = type(docs), [], []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *rest: runs.append(run) or plain(self, run, *rest))
    counted = [len(runs) for _, stage in corpus_pipeline.STAGES if stage(spark, docs, str(tmp_path)).count() >= 0]
    assert counted[0] and counted[0] < counted[1] < counted[2] == counted[3] < counted[4]  # mixing has no Python
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: returned.append(1)})())
    for number, run in enumerate(runs):
        assert list(run(iter([]))) == [] and len(returned) == number + 1


def test_texts_are_worked_on_in_small_pieces():
    texts = ["x" * 300_000] * 40 + ["y" * (5 << 20), None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    pieces = list(shared.slices([batch], "text", shared.PIECE_BYTES))
    assert pa.Table.from_batches(pieces).column("text").to_pylist() == texts  # a long text stays whole
    assert len(pieces) > 6 and all(sum(len(t or "") for t in piece.column("text").to_pylist()[1:]) <= shared.PIECE_BYTES for piece in pieces)


def test_encoder_merges_few_words_at_once(monkeypatch):
    with open(bpe.VOCABULARY, "rb") as file:
        content = file.read()
    texts = ["", " ".join(f"word{k} naïve" for k in range(40)), "aaaaaaa  bb\n日本 x", "it's 12345 + 678"]
    whole = [one.tolist() for one in bpe.TextEncoder(content).encode(texts)]
    sizes, plain = [], bpe.PairMerges.encode
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    monkeypatch.setattr(bpe.PairMerges, "encode", lambda self, words: sizes.append(len(words)) or plain(self, words))
    assert [one.tolist() for one in bpe.TextEncoder(content).encode(texts)] == whole
    assert len(sizes) > 5 and max(sizes) == 7
    assert [one.tolist() for one in bpe.TextEncoder(content).encode(["", ""])] == [[], []]
