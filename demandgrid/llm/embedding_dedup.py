"""Near-duplicate vectors by an exact block join.

Equal vectors are one head with a count. The heads of a label are dealt to their nearest pivot and cut into blocks of bounded size that
know how far their members lie from the pivot. By the triangle inequality of angles a pair of blocks is too far apart for any link,
so close that all members link (only counted, never unfolded), or open; open pairs are multiplied block against block, links are
counted by row, and only a spanning forest of them leaves a task. No pair of vectors that may link is left uncompared, so nothing is missed.
What it costs: blocks that no angle keeps apart cost the square of a label's distinct vectors in multiplications, and each vector is sent to
every block its own block is open with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.neighbours import exact_cosines, usable
from demandgrid.llm.shared import components, written

BLOCK = 8192
SMALL_BLOCK = 512
NUMBERS_PER_BLOCK = 1 << 22
FEW_BLOCKS = 8
CELLS_PER_STRIP = 1 << 22
EPS = 1e-6  # above the error of an angle computed in double precision, which is some 2e-8 near zero


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _dealt(heads: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """The heads with ``cell``, the nearest pivot, and the angle to it."""
    if not len(heads):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("cls", "label", "dim", "m", "cell")} | {"angle": pd.Series(dtype="float64"), "embedding": pd.Series(dtype="object")})
    x, p = _matrix(heads["embedding"]), _matrix(pivots["pivot"])
    unit, towards = _unit(x), _unit(p).T
    step = max(1, CELLS_PER_STRIP // len(p))
    best = np.concatenate([(unit[k : k + step] @ towards).argmax(axis=1) for k in range(0, len(x), step)])
    return heads[["cls", "label", "dim", "m", "embedding"]].assign(cell=pivots["cell"].to_numpy()[best], angle=_angles(exact_cosines(x, p[best])))


def _judged(limit: float):
    """Pairs of blocks that are not too far apart for a link; ``sure`` where every pair of members links."""

    def run(batches):
        for batch in batches:
            angle = np.zeros(len(batch))
            for dim in batch["dim"].unique():
                at = np.flatnonzero((batch["dim"] == dim).to_numpy())
                angle[at] = _angles(exact_cosines(_matrix(batch["pivot_a"].iloc[at]), _matrix(batch["pivot_b"].iloc[at])))
            angle[(batch["cell_a"] == batch["cell_b"]).to_numpy()] = 0.0
            low_a, high_a, low_b, high_b = (batch[c].to_numpy() for c in ("low_a", "high_a", "low_b", "high_b"))
            least = np.maximum.reduce([angle - high_a - high_b, low_a - angle - high_b, low_b - angle - high_a])
            kept = batch[["a", "b"]].assign(sure=angle + high_a + high_b <= limit - EPS)
            yield kept[least <= limit + EPS]

    return run


def _linked(threshold: float):
    """Links between two blocks, or within one where the right side is empty.

    A row (a, -1, n) gives the number of vectors that head a links with, a row (a, b, 0) a link of the spanning forest. The product in single
    precision decides what its error bound leaves no doubt of, double precision the rest.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        two = len(right) > 0
        other = right if two else left
        x, y = _matrix(left["embedding"]), _matrix(other["embedding"])
        rows, columns = _unit(x), _unit(y).T
        m_x, m_y = left["m"].to_numpy(np.float64), other["m"].to_numpy(np.float64)
        slack = (x.shape[1] + 8) * 1.2e-7  # twice the worst rounding of a product of unit vectors
        names = np.concatenate([left["cls"].to_numpy(), right["cls"].to_numpy()]) if two else left["cls"].to_numpy()
        beyond = len(x) if two else 0
        group, counts, edges = np.arange(len(names)), np.zeros(len(names)), []
        step = max(1, CELLS_PER_STRIP // len(y))
        for start in range(0, len(x), step):
            near = rows[start : start + step] @ columns
            if not two:
                own = np.arange(len(near))
                near[own, start + own] = -2.0  # a head does not link with itself
            some = np.flatnonzero(near.max(axis=1) >= threshold - slack)
            if not len(some):
                continue
            near, some = near[some], start + some
            links = near >= threshold + slack
            r, c = np.nonzero((near >= threshold - slack) & ~links)
            for k in range(0, len(r), 65536):
                p, q = r[k : k + 65536], c[k : k + 65536]
                links[p, q] = exact_cosines(x[some[p]], y[q]) >= threshold
            counts[some] += links @ m_y
            if two:
                counts[beyond:] += m_x[some] @ links
            for k, row in zip(some, links):
                met = group[beyond + np.flatnonzero(row)]
                if len(met) and (met != group[k]).any():
                    roots = np.unique(np.append(met, group[k]))
                    edges += [(roots[0], root) for root in roots[1:]]
                    group[np.isin(group, roots)] = roots[0]
        at, ends = np.flatnonzero(counts), np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({
            "a": np.r_[names[at], names[ends[:, 0]]], "b": np.r_[np.full(len(at), -1), names[ends[:, 1]]], "n": np.r_[counts[at].astype(np.int64), np.zeros(len(ends), np.int64)],
        })

    return run


def _in_blocks(heads: DataFrame, limit: float, kind: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(heads with their ``block``, blocks with what the members have in common and their pivot).

    The number of pivots follows the heads of the label. Members of a cell that lie within half the limit of its pivot link with each other and
    get blocks of their own when they are many; a block of more than ``most`` is cut by hash, so a hot cell makes more blocks, not a larger one.
    """
    bound = F.greatest(F.lit(64), F.least(F.lit(most), F.floor(F.lit(NUMBERS_PER_BLOCK) / F.col("dim"))))
    several = F.least(F.lit(FEW_BLOCKS), F.ceil(F.col("n") / min(most, SMALL_BLOCK)))
    labels = heads.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min("cls").alias("first")).withColumn("parts", F.greatest(F.ceil(F.col("n") / bound), several))
    drawn = lambda salt: F.xxhash64("cls", F.lit(salt))
    known = heads.join(labels, ["label", "dim"])
    pivots = known.where((F.col("cls") == F.col("first")) | ((F.col("parts") > 1) & (F.pmod(drawn("pivot"), F.col("n")) < F.col("parts"))))
    pivots = written(pivots.select("label", "dim", "parts", F.col("cls").alias("cell"), F.col("embedding").alias("pivot")), "vector-pivots")
    by_part = known.select("cls", "label", "dim", "m", "embedding", F.pmod(drawn("part"), F.col("parts")).alias("part"))
    copies = pivots.select("label", "dim", "cell", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = by_part.groupBy("label", "dim", "part").cogroup(copies.groupBy("label", "dim", "part"))
    dealt = written(dealt.applyInPandas(_dealt, f"cls long, label int, dim int, m long, embedding {kind}, cell long, angle double"), "vector-cells")

    core = F.col("angle") <= limit / 2 - EPS
    cells = dealt.groupBy("cell").agg(F.count_if(core).alias("inner"), F.count_if(~core).alias("outer"))
    apart = F.col("inner") >= min(most, SMALL_BLOCK) // 8
    ring = F.when(apart & core, 0).otherwise(1)
    within = F.when(~apart, F.col("inner") + F.col("outer")).when(core, F.col("inner")).otherwise(F.col("outer"))
    placed = dealt.join(cells, "cell").withColumns({"ring": ring, "piece": F.pmod(drawn("piece"), F.ceil(within / bound))})
    key = ["cell", "ring", "piece"]
    blocks = placed.groupBy(*key).agg(
        F.min("cls").alias("block"), F.sum("m").alias("weight"), F.min("angle").alias("low"), F.max("angle").alias("high"),
    )
    blocks = written(blocks.join(pivots.drop("parts"), "cell"), "vector-blocks")
    return written(placed.join(blocks.select(*key, "block"), key).select("cls", "m", "embedding", "block"), "vector-placed"), blocks


def link_vectors(vectors: DataFrame, threshold: float = 0.93, most: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their vectors have equal length and their cosine is ``threshold`` or more.
    Every link is found, and none is made up: each pair is decided by its cosine in double precision or by bounds that leave no doubt.
    ``most`` bounds the heads of a block and changes no result. A null, zero or non-finite vector, one with a null component, and a
    null label link with nothing. Repeated rows are separate vectors that link with each other; a component's id is its
    smallest vec_id; a null vec_id is never that, and a row without any has a null component and is kept.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    limit = float(np.arccos(threshold))
    fit = usable() & F.col("label").isNotNull()
    base = vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.when(fit, F.col("embedding").cast(kind)).alias("embedding"),
    )
    base = written(base.withColumn("dim", F.size("embedding")), "vectors")  # also fixes the row numbers
    rows = base.where("embedding IS NOT NULL")
    same = ["label", "dim", "embedding"]
    heads = written(rows.groupBy(*same).agg(F.min("rid").alias("cls"), F.count("*").alias("m"), F.min("vec_id").alias("least")), "vector-heads")
    members = rows.join(heads.select(*same, "cls"), same).select("rid", "cls")

    placed, blocks = _in_blocks(heads.drop("least"), limit, kind, most)
    side = lambda s: blocks.select("label", "dim", *(F.col(c).alias(f"{c}_{s}") for c in ("cell", "low", "high", "pivot")), F.col("block").alias(s))
    met = side("a").join(side("b"), ["label", "dim"]).where("a <= b")
    tiles = written(met.mapInPandas(_judged(limit), "a long, b long, sure boolean"), "vector-tiles")
    open_ = tiles.where("NOT sure").select("a", "b")
    renamed = lambda df: df.select(*(F.col(c).alias(c) for c in ("a", "b", "cls", "m", "embedding")))  # noqa: E731  columns of its own for each side
    left = renamed(placed.withColumnRenamed("block", "a").join(open_, "a"))
    right = renamed(placed.withColumnRenamed("block", "b").join(open_.where("a < b"), "b"))
    links = written(left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_linked(threshold), "a long, b long, n long"), "vector-links")

    sure = tiles.where("sure").select("a", "b")
    both = sure.union(sure.where("a < b").select("b", "a"))
    of_block = both.join(blocks.select(F.col("block").alias("b"), "weight"), "b").groupBy(F.col("a").alias("block")).agg(F.sum("weight").alias("all"), F.max(F.col("a") == F.col("b")).alias("within"))
    # where a block's members all link with each other, its weight holds the head's own copies too
    by_block = placed.select("cls", "m", "block").join(of_block, "block").select("cls", "block", (F.col("all") - F.when(F.col("within"), F.col("m")).otherwise(0)).alias("n"))
    by_block = written(by_block, "vector-sure")
    linked = links.where("b < 0").select(F.col("a").alias("cls"), "n").union(by_block.select("cls", "n")).groupBy("cls").agg(F.sum("n").alias("n"))
    forest = links.where("b >= 0").select("a", "b").union(sure).union(by_block.select("block", "cls"))
    labels = components(forest, "vector-components")
    labels = heads.select("cls", "m", "least").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ids = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    by_head = labels.join(ids, "component").join(linked, "cls", "left").select("cls", "component_id", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    found = members.join(by_head, "cls").select("rid", "component_id", "n_links")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return base.select("rid", "vec_id").join(found, "rid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`link_vectors`."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
