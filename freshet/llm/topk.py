"""Operator 2: exact top-k inner-product search by ball trees.

A partition tree, grown on a bounded sample of the vectors, deals all of them into cells of
near vectors; each cell is a ball of known centre and radius, and holds one or more shards of bounded
size.  Every shard has a ball tree.  The
inner product of a query with any vector in a ball is at most
``q . centre + |q| * radius``; a batch of queries descends into the child of the
greater bound first and leaves out every node whose bound is below the query's
kth score so far.  A first round searches each query's own cell; the kth score reached there is
shared with all other cells, of which the second round opens only those whose ball's
bound reaches it for some query of a block.

Contract
--------
Null vectors and those with null or non-finite components take no part; a query
meets only vectors of its own length.  A row is never its own candidate, but
another row with the same key is.  Ties go to the smaller key (null keys last).
Scores beyond 64 bits are held at the limits.  Empty tables give empty results,
extra columns are left out.  The sample (``sample_rows``) only shapes the cells: every vector is in one,
and results are exact whatever it is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import staged

LAST_KEY = 2**63 - 1
LOW = -(2**63)


def integer_vectors(df: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """``(uid, key, vec array<double>)``: floor(scale * x), rows that can't take part left out."""
    vector_column = f"`{vector_column}`"
    finite = F.forall(F.transform(F.col(vector_column), lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector_column).isNotNull() & finite).select(F.coalesce(f"`{id_column}`", F.lit(LAST_KEY)).cast("long").alias("key"), F.transform(F.col(vector_column), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec"))
    return rows.withColumn("uid", F.monotonically_increasing_id())


class BallTree:
    """Balls over the rows of a matrix; leaves hold at most ``leaf`` rows unless these are equal."""

    def __init__(self, x: np.ndarray, leaf: int = 128):
        self.order = np.arange(len(x))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        self.leaf = leaf
        self._grow(x, 0, len(x))
        self.x = x[self.order]

    def _grow(self, x: np.ndarray, a: int, b: int) -> int:
        own = x[self.order[a:b]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        radius = float(away.max()) * (1 + 1e-9) + 1e-9
        me = len(self.nodes)
        self.nodes.append((centre, radius, a, b, -1, -1))
        spread = own.max(axis=0) - own.min(axis=0) if own.shape[1] else np.zeros(1)
        if b - a > self.leaf and spread.max() > 0:
            one = own[int(away.argmax())]
            two = own[int(((own - one) ** 2).sum(axis=1).argmax())]
            side = own @ (two - one)
            by = np.argsort(side, kind="stable")
            self.order[a:b] = self.order[a:b][by]
            m = (a + b) // 2
            left, right = self._grow(x, a, m), self._grow(x, m, b)
            self.nodes[me] = (centre, radius, a, b, left, right)
        return me


@dataclass
class Cells:
    """A partition tree: inner nodes are (direction, cut, left, right), where a negative child -1 - i is cell i."""

    nodes: list[tuple[np.ndarray, float, int, int]]
    centres: np.ndarray
    root: int

    @classmethod
    def grow(cls, sample: np.ndarray, most: int, least_rows: int = 16) -> "Cells":
        """At most about ``most`` cells, none of fewer than ``least_rows`` sample rows unless it must be."""
        nodes: list[tuple[np.ndarray, float, int, int]] = []
        centres: list[np.ndarray] = []
        rows = max(least_rows, -(-len(sample) // max(1, most)))

        def split(own: np.ndarray) -> int:
            if len(own) >= 2 * rows:
                one = own[int(((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax())]
                two = own[int(((own - one) ** 2).sum(axis=1).argmax())]
                side = own @ (two - one)
                cut = float(np.median(side))
                low = side <= cut
                if low.all():
                    low = side < cut
                    cut = float(side[low].max(initial=-np.inf))
                if low.any() and not low.all():
                    me = len(nodes)
                    nodes.append((two - one, cut, 0, 0))
                    left, right = split(own[low]), split(own[~low])
                    nodes[me] = (two - one, cut, left, right)
                    return me
            centres.append(own.mean(axis=0) if len(own) else np.zeros(own.shape[1]))
            return -len(centres)

        root = split(sample)
        return cls(nodes, np.stack(centres), root)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distance from the cell's centre."""
        cell = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                cell[rows] = -1 - node
                continue
            direction, cut, left, right = self.nodes[node]
            low = x[rows] @ direction <= cut
            todo += [(left, rows[low]), (right, rows[~low])]
        return cell, np.sqrt(((x - self.centres[cell]) ** 2).sum(axis=1))


class Best:
    """The k best (score, key, uid) of each query."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LOW, dtype=np.int64)
        self.key = np.full((n, k), LAST_KEY, dtype=np.int64)
        self.uid = np.full((n, k), -1, dtype=np.int64)

    def offer(self, rows: np.ndarray, score: np.ndarray, key: np.ndarray, uid: np.ndarray) -> None:
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.key[rows], np.broadcast_to(key, score.shape)], axis=1)
        u = np.concatenate([self.uid[rows], np.broadcast_to(uid, score.shape)], axis=1)
        missing = np.where(u < 0, 1, 0)
        by = np.lexsort((u, i, ~s, missing), axis=1)[:, : self.k]  # ~s falls as s rises, without overflow
        take = lambda m: np.take_along_axis(m, by, axis=1)
        self.score[rows], self.key[rows], self.uid[rows] = take(s), take(i), take(u)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if most < 2**52:
        return np.rint(q @ x.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in x] for r in q]
    return np.array([[min(max(v, LOW + 1), LAST_KEY) for v in r] for r in exact], dtype=np.int64).reshape(len(q), len(x))


def search(tree: BallTree, keys: np.ndarray, uids: np.ndarray, q: np.ndarray, q_uid: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """Search a shard for a block of queries; ``floor`` is a score that k candidates reach elsewhere."""
    best = Best(len(q), k)
    norm = np.sqrt((q**2).sum(axis=1))

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        top = q[rows] @ centre + norm[rows] * radius
        return top + 1e-6 * (1 + np.abs(top))

    def visit(node: int, rows: np.ndarray) -> None:
        least = np.maximum(floor[rows], best.score[rows, -1]).astype(float)
        rows = rows[bound(node, rows) >= least]
        if not len(rows):
            return
        _, _, a, b, left, right = tree.nodes[node]
        if left < 0:
            for at in range(a, b, 4096):
                end = min(at + 4096, b)
                score = products(q[rows], tree.x[at:end])
                key, uid = keys[at:end], uids[at:end]
                own = uid[None, :] == q_uid[rows][:, None]
                gain = ((score >= np.maximum(floor[rows], best.score[rows, -1])[:, None]) & ~own).any(axis=1)
                if gain.any():
                    shown = np.where(own, -1, np.broadcast_to(uid, own.shape))[gain]
                    best.offer(rows[gain], np.where(own, LOW, score)[gain], key, shown)
            return
        nearer = bound(left, rows) >= bound(right, rows)
        visit(left, rows[nearer])
        visit(right, rows[~nearer])
        visit(right, rows[nearer])
        visit(left, rows[~nearer])

    if len(tree.nodes):
        visit(0, np.arange(len(q)))
    return best


def partition_trees(rows: DataFrame, shard_rows: int, sample_rows: int, most_cells: int) -> dict[int, Cells]:
    """Trees of the lengths with most vectors, from a sample of at most about ``sample_rows`` rows and 100 numbers for each of these."""
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(64).collect()}
    large = [d for d, n in counts.items() if n > shard_rows]
    if not large:
        return {}
    parts = 1 << 30
    share = min(parts, int(parts * sample_rows / max(sum(counts[d] for d in large), sum(counts[d] * d for d in large) / 100)))
    drawn = rows.where(F.col("dim").isin(large) & (F.pmod(F.xxhash64("uid"), F.lit(parts)) < share)).select("dim", "vec").collect()
    trees = {}
    for d in large:
        own = [r.vec for r in drawn if r.dim == d]
        if own:
            trees[d] = Cells.grow(np.array(own, dtype="<f8"), min(most_cells, -(-counts[d] // shard_rows)))
    return trees


def in_cells(rows: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """The rows with ``cell`` and ``away``, the distance from its centre."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # bounded by most_cells and the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            cell, away = np.zeros(len(dims), dtype=np.int64), np.zeros(len(dims))
            for d, tree in shared.value.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    x = batch.column("vec").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                    cell[at], away[at] = tree.of(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("dim", "uid", "key", "vec")], pa.array(cell), pa.array(away)], ["dim", "uid", "key", "vec", "cell", "away"])

    return rows.select("dim", "uid", "key", "vec").mapInArrow(run, "dim int, uid long, key long, vec array<double>, cell long, away double")


def top_k(df: DataFrame, queries: str, k: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = 4096, block_rows: int = 1024, sample_rows: int = 20_000, most_cells: int = 1024) -> DataFrame:
    """``(query_id, rank, <id>, score)`` of the k best rows for each row that meets ``queries``.

    ``queries`` is a SQL condition on ``key``.  A shard goes to one task with the
    blocks of queries streaming past it, so memory is bounded by a shard and a block.
    """
    rows = integer_vectors(df, id_column, vector_column, scale).withColumn("dim", F.size("vec"))
    trees = partition_trees(rows, shard_rows, sample_rows, most_cells)
    placed = in_cells(rows, trees) if trees else rows.withColumns({"cell": F.lit(0).cast("long"), "away": F.lit(0.0)})
    placed = staged(placed.select("dim", "uid", "key", "vec", "cell", "away"), "cells")
    parts = lambda n, most: F.ceil(F.col(n) / most)
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if(F.expr(queries)).alias("asked"), F.max("away").alias("radius"))
    cells = staged(cells.select("dim", "cell", "radius", parts("n", shard_rows).alias("pieces"), F.greatest(parts("asked", block_rows), F.lit(1)).alias("blocks")), "balls")
    of_cell = placed.join(cells, ["dim", "cell"])
    tasks = min(10_000, max(1, cells.agg(F.sum("pieces")).first()[0] or 1))

    def pack(key: tuple, pdf: pd.DataFrame, tree: bool) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        x = np.stack(pdf["vec"].to_numpy()).astype("<f8")
        uids, keys = pdf["uid"].to_numpy("<i8"), pdf["key"].to_numpy("<i8")
        if tree:
            made = BallTree(x)
            uids, keys, data = uids[made.order], keys[made.order], pickle.dumps(made)
        else:
            data = x.tobytes()
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "no": [key[2]], "uids": [uids.tobytes()], "keys": [keys.tobytes()], "data": [data]})

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pack(key, pdf, True)

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pack(key, pdf, False)

    schema = "dim int, cell long, no long, uids binary, keys binary, data binary"
    columns = ["dim", "cell", "uid", "key", "vec"]
    shards = of_cell.select(*columns, F.pmod(F.xxhash64("uid"), F.col("pieces")).alias("no"))
    shards = staged(shards.groupBy("dim", "cell", "no").applyInPandas(shard, schema), "shards")
    shards = shards.select("dim", "cell", F.col("no").alias("piece"), F.col("uids").alias("s_uids"), F.col("keys").alias("s_keys"), F.col("data").alias("tree"))
    asked = of_cell.where(queries).select(*columns, F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")).alias("no"))
    blocks = staged(asked.groupBy("dim", "cell", "no").applyInPandas(block, schema).withColumn("block", F.monotonically_increasing_id()), "blocks")
    blocks = blocks.select("dim", "cell", "block", "uids", "keys", "data")

    def matrix(data: bytes, n: int, dim: int) -> np.ndarray:
        return np.frombuffer(data, "<f8").reshape(n, dim)

    def searched(pairs: DataFrame) -> DataFrame:
        """Candidates of ``(block, shard)`` pairs: no score below the query's floor, k at most of a shard."""
        kept: dict = {}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    at = (r.dim, r.cell, r.piece)
                    if at not in kept:
                        kept.clear()
                        kept[at] = pickle.loads(r.tree), np.frombuffer(r.s_keys, "<i8"), np.frombuffer(r.s_uids, "<i8")
                    tree, keys, uids = kept[at]
                    q_uid, q_key = np.frombuffer(r.uids, "<i8"), np.frombuffer(r.keys, "<i8")
                    floor = np.frombuffer(r.floors, "<i8") if r.floors else np.full(len(q_uid), LOW)
                    best = search(tree, keys, uids, matrix(r.data, len(q_uid), r.dim), q_uid, floor, k)
                    i, j = np.nonzero((best.uid >= 0) & (best.score >= floor[:, None]))
                    yield pd.DataFrame({"block": r.block, "q_uid": q_uid[i], "query_id": q_key[i], "key": best.key[i, j], "uid": best.uid[i, j], "score": best.score[i, j]})

        spread = pairs.repartition(tasks, "dim", "cell", "piece")
        joined = spread.hint("merge").join(shards.hint("merge"), ["dim", "cell", "piece"])
        return joined.mapInPandas(run, "block long, q_uid long, query_id long, key long, uid long, score long")

    each_piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")
    own = blocks.join(cells.select("dim", "cell", "pieces"), ["dim", "cell"]).select("dim", "cell", "block", "uids", "keys", "data", F.lit(b"").alias("floors"), each_piece)
    order = Window.partitionBy("q_uid").orderBy(F.desc("score"), "key", "uid")
    near = staged(searched(own).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "near")

    # the kth score of every query in its own cell, block by block
    reached = near.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("q_uid", "score")).alias("reached"))
    balls = {}
    for r in cells.select("dim", "cell", "radius").where(F.col("dim").isin(list(trees))).collect():  # most_cells for each tree at most
        balls.setdefault(r.dim, []).append((r.cell, r.radius))
    balls = {d: (np.array([c for c, _ in sorted(own)]), np.array([r for _, r in sorted(own)])) for d, own in balls.items()}
    shared = df.sparkSession.sparkContext.broadcast((balls, {d: t.centres for d, t in trees.items()}))

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The other cells that some query of a block must look into."""
        balls, centres = shared.value
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.dim not in balls:
                    continue
                uids = np.frombuffer(r.uids, "<i8")
                floor = np.full(len(uids), LOW)
                if r.reached is not None:
                    known = {x["q_uid"]: x["score"] for x in r.reached}
                    floor = np.array([known.get(u, LOW) for u in uids.tolist()], dtype="<i8")
                number, radius = balls[r.dim]
                q = matrix(r.data, len(uids), r.dim)
                top = q @ centres[r.dim][number].T + np.sqrt((q**2).sum(axis=1))[:, None] * (radius * (1 + 1e-9) + 1e-9)
                top += 1e-6 * (1 + np.abs(top))
                wanted = number[(top >= floor[:, None]).any(axis=0)]
                wanted = wanted[wanted != r.cell]
                if len(wanted):
                    yield pd.DataFrame({"block": r.block, "floors": [floor.tobytes()] * len(wanted), "open": wanted})

    seen = blocks.join(reached, "block", "left").select("dim", "cell", "block", "uids", "data", "reached")
    wanted = seen.mapInPandas(open_, "block long, floors binary, open long")
    further = blocks.join(wanted, "block").select("dim", F.col("open").alias("cell"), "block", "uids", "keys", "data", "floors")
    further = further.join(cells.select("dim", "cell", "pieces"), ["dim", "cell"]).select("dim", "cell", "block", "uids", "keys", "data", "floors", each_piece)
    found = near.drop("rank").unionByName(searched(further))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    back = lambda c: F.when(F.col(c) != LAST_KEY, F.col(c))
    return ranked.select(back("query_id").alias("query_id"), "rank", back("key").alias(id_column), "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "key % 20 = 0")


ORACLE_SQL = {
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
