"""The k most similar vectors of every vector, by a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then indexed in one leaf per tree. Leaves that are still too large are split
by trees fitted on bounded samples of their own vectors, level by level. A query looks into the leaves of
all trees that are nearest to it: one priority queue, shared by the trees, orders the branches by how far the query lies on
their other side. That distance never shrinks on the way down and one child always keeps its parent's, so keeping the best
branches level by level finds the same leaves as popping them one by one, and is done for thousands of queries at once. Within
a leaf the cosines are bounded from codes of a byte per number; what may be among the best of all leaves is reranked by exact
cosines in double precision.

Copies of a vector are searched for once: they form a class that its least id stands for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import cut

FOUND = "a bigint, b bigint, cosine double"
ROUTED = "leaf bigint, role tinyint, gap float, id bigint, code binary"
LEVELS = 4


class Forest:
    """Complete binary trees of hyperplanes: planes[t, node], offsets[t, node], node 0 the root, 2i+1 and 2i+2 its children."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> None:
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        nodes = 2**depth - 1
        self.depth, self.trees, self.nodes = depth, trees, nodes
        self.planes = rng.standard_normal((trees, nodes, dim)).astype(np.float32)
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.offsets = np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for node in range(nodes):
                rows = held.pop(node)
                if len(rows) > 1:
                    i, j = rng.choice(rows, 2, replace=False)
                    way = sample[i] - sample[j]
                    if (size := np.linalg.norm(way)) > 1e-6:
                        self.planes[t, node] = way / size
                at = sample[rows] @ self.planes[t, node]
                if len(rows):
                    self.offsets[t, node] = np.median(at)
                held[2 * node + 1], held[2 * node + 2] = rows[at <= self.offsets[t, node]], rows[at > self.offsets[t, node]]
        self.planes, self.offsets = self.planes.reshape(trees * nodes, dim), self.offsets.ravel()

    def side(self, x: np.ndarray, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        at = tree * self.nodes + node
        return np.einsum("bd,bvd->bv", x, self.planes[at]) - self.offsets[at]

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered over all trees."""
        tree = np.broadcast_to(np.arange(self.trees), (len(x), self.trees))
        node = np.zeros_like(tree)
        for _ in range(self.depth):
            node = 2 * node + 1 + (self.side(x, tree, node) > 0)
        return tree * (self.nodes + 1) + node - self.nodes

    def nearest(self, x: np.ndarray, visits: int, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The leaves, of all trees together, that are first in each row's priority queue, with their gaps; gap is what rows begin with."""
        tree = np.broadcast_to(np.arange(self.trees), (len(x), self.trees))
        node, gap = np.zeros_like(tree), np.zeros(tree.shape, np.float32) if gap is None else gap[:, None]
        for _ in range(self.depth):
            side = self.side(x, tree, node)
            tree, node = np.concatenate([tree, tree], 1), np.concatenate([2 * node + 1, 2 * node + 2], 1)
            gap = np.concatenate([np.maximum(gap, side), np.maximum(gap, -side)], 1)
            if gap.shape[1] > visits:
                keep = np.argpartition(gap, visits - 1, axis=1)[:, :visits]
                tree, node, gap = (np.take_along_axis(v, keep, 1) for v in (tree, node, gap))
        return tree * (self.nodes + 1) + node - self.nodes, gap

    def dump(self) -> bytes:
        """One tree as bytes."""
        return np.int32(self.depth).tobytes() + self.offsets.tobytes() + self.planes.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Forest:
        out = cls.__new__(cls)
        out.trees, out.depth = 1, int(np.frombuffer(raw, np.int32, 1)[0])
        out.nodes = 2**out.depth - 1
        out.offsets = np.frombuffer(raw, np.float32, out.nodes, 4)
        out.planes = np.frombuffer(raw, np.float32, offset=4 + 4 * out.nodes).reshape(out.nodes, -1)
        return out


def usable(vector: Column) -> Column:
    """Neither null nor all zero, every number finite and not null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a column of binary float32 vectors, in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    x = np.ascontiguousarray(x)
    wide = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * wide).astype(np.int32)), pa.py_buffer(x)])


def _coded(x: np.ndarray) -> np.ndarray:
    """Unit rows as codes: a scale, the length of what the code leaves out, and a signed byte per number."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / scale[:, None])
    left = np.linalg.norm(x - code * scale[:, None], axis=1) * (1 + 1e-6) + 1e-7
    return np.concatenate([np.stack([scale, left], 1).astype(np.float32).view(np.int8), code.astype(np.int8)], 1)


def _decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows that codes stand for, and how far they may be from the true ones."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)
    about = np.ascontiguousarray(raw[:, :8]).view(np.float32).astype(np.float64)
    return raw[:, 8:].astype(np.float64) * about[:, :1], about[:, 1]


def _packed(rows: DataFrame) -> DataFrame:
    """rows (row_index, embedding, ..) with the embedding as binary float32 and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("embedding").flatten().cast(pa.float32())
            size = np.diff(b.column("embedding").offsets.to_numpy()).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * 4
            packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(held.to_numpy()))])
            yield pa.RecordBatch.from_arrays([b.column("row_index"), b.column("_asks"), packed, pa.array(size)], ["row_index", "_asks", "packed", "_n"])

    return rows.select("row_index", "_asks", "embedding").mapInArrow(run, "row_index bigint, _asks boolean, packed binary, _n int")


def _spread(row: np.ndarray, leaf: np.ndarray, role: np.ndarray, gap: np.ndarray, ids: pa.Array, code: pa.Array) -> pa.RecordBatch:
    """One routed row for each row and leaf; a row that is held in a leaf and asks there has both roles."""
    order = np.lexsort((leaf, row))
    row, leaf, role, gap = row[order], leaf[order], role[order], gap[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (leaf[1:] != leaf[:-1])]))
    role, gap = np.bitwise_or.reduceat(role, first), np.maximum.reduceat(gap, first)
    take = pa.array(row[first])
    return pa.RecordBatch.from_arrays([pa.array(leaf[first], pa.int64()), pa.array(role, pa.int8()), pa.array(gap, pa.float32()), ids.take(take), code.take(take)], ["leaf", "role", "gap", "id", "code"])


def _refined(routed: DataFrame, over: DataFrame, visits: int, leaf: int, sample: int, salt: int = 100_000) -> DataFrame:
    """routed with the leaves of over (leaf, count) split by a tree each, fitted on at most about sample of the leaf's vectors.

    A tree goes to the tasks before its leaf's rows, which are streamed; a large leaf's rows are spread over several tasks.
    """
    held = F.col("role").bitwiseAND(1) == 1
    stay = routed.join(over.select("leaf"), "leaf", "left_anti")
    deep = cut(routed.join(over.withColumn("_salts", F.ceil(F.col("count") / salt).cast("int")), "leaf"))

    def fit(group: pa.Table) -> pa.Table:
        x = _decoded(group.column("code").combine_chunks())[0].astype(np.float32)
        count, name = group.column("count")[0].as_py(), group.column("leaf")[0].as_py()
        depth = max(1, min(math.ceil(math.log2(count / leaf)), int(math.log2(max(len(x) / 8, 2)))))
        return pa.table({"leaf": pa.array([name], pa.int64()), "tree": pa.array([Forest(x, 1, depth, seed=name % 2**31).dump()], pa.binary())})

    few = F.pmod(F.xxhash64("id", "leaf"), F.lit(2**30)) < F.least(F.lit(1.0), sample / F.col("count")) * 2**30
    trees = cut(deep.where(held & few).select("leaf", "count", "code").groupBy("leaf").applyInArrow(fit, "leaf bigint, tree binary"))
    rows = deep.withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int")).select("leaf", "_salt", "role", "gap", "id", "code")
    sent = trees.join(over, "leaf").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("count") / salt).cast("int") - 1)))
    sent = sent.select("leaf", "_salt", F.lit(0).cast("tinyint").alias("role"), F.lit(0.0).cast("float").alias("gap"), F.lit(None).cast("bigint").alias("id"), F.col("tree").alias("code"))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, name = None, None
        for whole in batches:
            names, roles = whole.column("leaf").to_numpy(), whole.column("role").to_numpy()
            cuts = sorted({0, len(whole), *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), *(np.flatnonzero(roles == 0) + 1).tolist()})
            for begin, end in zip(cuts, cuts[1:]):
                if roles[begin] == 0:
                    tree, name = Forest.load(whole.column("code")[begin].as_py()), int(names[begin])
                    continue
                if name != names[begin]:  # no vector of this leaf was drawn for a tree
                    yield whole.slice(begin, end - begin)
                    continue
                for at in range(begin, end, 2000):
                    b = whole.slice(at, min(2000, end - at))
                    x = _decoded(b.column("code"))[0].astype(np.float32)
                    role, gap = b.column("role").to_numpy(), b.column("gap").to_numpy()
                    own, asking = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
                    home = tree.home(x[own])[:, 0]
                    near, far = tree.nearest(x[asking], visits, gap[asking])
                    row = np.concatenate([own, np.repeat(asking, near.shape[1])])
                    into = np.concatenate([home, near.ravel()]) + 1 + (name << 12)
                    kind = np.concatenate([np.full(len(own), 1), np.full(near.size, 2)])
                    yield _spread(row, into, kind, np.concatenate([np.zeros(len(own), np.float32), far.ravel()]), b.column("id"), b.column("code"))

    told = rows.unionByName(sent).repartition("leaf", "_salt").sortWithinPartitions("leaf", "_salt", "role")
    down = stay.select(*ROUTED_NAMES).unionByName(told.select("leaf", "role", "gap", "id", "code").mapInArrow(descend, ROUTED))
    # a query's branches of all leaves and trees share one queue
    asks = F.col("role").bitwiseAND(2) == 2
    first = F.row_number().over(W.partitionBy("id").orderBy("gap", "leaf")) <= visits
    kept = down.where(asks).withColumn("_in", first)
    kept = kept.withColumn("role", F.when(F.col("_in"), F.col("role")).otherwise(F.col("role").bitwiseAND(1)).cast("tinyint")).where("role > 0")
    return cut(kept.select(*ROUTED_NAMES).unionByName(down.where(~asks).select(*ROUTED_NAMES)))


ROUTED_NAMES = [x.split()[0] for x in ROUTED.split(", ")]


def search(vectors: DataFrame, k: int, floor: float = -1.0, trees: int = 8, visits: int | None = None, leaf: int = 256, sample: int = 20_000, queries: Column | None = None, block: int = 2048) -> DataFrame:
    """(a, b, cosine): for each distinct vector a that queries selects, its k most similar others with at least floor.

    vectors: (id bigint, packed binary), ids unique and vectors distinct. Trees are fitted on at most about sample vectors each.
    Leaves of more than block vectors are split by further trees; one that no plane splits is searched in blocks, all of them.
    visits: how many leaves a query looks into; if not given, four times the root of their number, which grows with the vectors.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    if n < 2:
        return spark.createDataFrame([], FOUND)
    hashed = F.pmod(F.xxhash64("id"), F.lit(2**30))
    few = vectors.where(hashed < math.ceil(min(1.0, 1.3 * sample / n) * 2**30))  # so that tasks send no more than is wanted
    drawn = few.orderBy(hashed, "id").select("packed").limit(sample).collect()  # the bounded sample
    points = np.frombuffer(b"".join(bytes(r[0]) for r in drawn), np.float32).reshape(len(drawn), -1)
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    depth = max(0, min(int(np.ceil(np.log2(n / leaf))), int(np.log2(max(len(points) / 8, 1)))))
    forest = spark.sparkContext.broadcast(Forest(points, trees, depth))
    visits = max(trees, visits or math.ceil(4 * math.sqrt(trees * max(1, n / leaf))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for whole in batches:
            for at in range(0, len(whole), 2000):
                b = whole.slice(at, 2000)
                x = _matrix(b.column("packed"))
                code, x = _rows(_coded(x)), x.astype(np.float32)
                home, rows = f.home(x), np.flatnonzero(b.column("asks").to_numpy(zero_copy_only=False))
                near, gap = f.nearest(x[rows], visits) if len(rows) else (np.zeros((0, 0), np.int64), np.zeros((0, 0), np.float32))
                row = np.concatenate([np.repeat(np.arange(len(b)), f.trees), np.repeat(rows, near.shape[1])])
                role = np.concatenate([np.full(home.size, 1), np.full(near.size, 2)])
                yield _spread(row, np.concatenate([home.ravel(), near.ravel()]), role, np.concatenate([np.zeros(home.size, np.float32), gap.ravel()]), b.column("id"), code)

    routed = vectors.withColumn("asks", F.lit(True) if queries is None else queries).select("id", "packed", "asks").mapInArrow(route, ROUTED)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2000):
                home = forest.value.home(_matrix(b.column(0).slice(at, 2000)).astype(np.float32))
                leaves, held = np.unique(home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(held, pa.int64())], ["leaf", "n"])

    # a leaf of the first trees that is too large, if there is one; the pass over the vectors shuffles counts only
    over = vectors.select("packed").mapInArrow(settle, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("count"))
    over = cut(over.where(F.col("count") > block))
    for _ in range(LEVELS):
        if over.isEmpty():
            break
        routed = _refined(routed, over, visits, leaf, sample)
        over = cut(routed.where(F.col("role").bitwiseAND(1) == 1).groupBy("leaf").count().where(F.col("count") > block))
    if over.isEmpty():
        routed = routed.withColumn("block", F.lit(0))
    else:  # vectors too much alike for any plane: blocks of held ones, each of which meets all the leaf's queries
        routed = routed.join(over, "leaf", "left").withColumn("_blocks", F.coalesce(F.ceil(F.col("count") / block).cast("int"), F.lit(1)))
        routed = routed.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
        routed = routed.withColumn("block", F.explode(F.when(F.col("role") == 1, F.array("_own")).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))))
        asks_only = (F.col("block") != F.col("_own")) & (F.col("role") == 3)
        routed = routed.withColumn("role", F.when(asks_only, 2).otherwise(F.col("role")).cast("tinyint"))

    def best(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, role = group.column("id").to_numpy(), group.column("role").to_numpy()
        x, left = _decoded(group.column("code").combine_chunks())
        held, asking = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(asking), 512):
            rows = asking[at : at + 512]
            if not len(held):
                break
            near = x[rows] @ x[held].T
            slack = left[rows][:, None] + left[held][None, :] + left[rows][:, None] * left[held][None, :] + 1e-9
            low, high = near - slack, near + slack
            same = ids[rows][:, None] == ids[held][None, :]
            low[same] = high[same] = -9
            m = min(k, len(held))
            least = np.maximum(np.partition(low, len(held) - m, axis=1)[:, len(held) - m], -2)
            i, j = np.nonzero(high >= np.maximum(least, floor)[:, None])
            out.append((ids[rows[i]], ids[held[j]], low[i, j], high[i, j]))
        a, b, c, d = (np.concatenate(v) for v in zip(*out)) if out else (np.array([], np.int64), np.array([], np.int64), np.array([]), np.array([]))
        return pa.table({"a": a, "b": b, "low": c.astype(np.float64), "high": d.astype(np.float64)})

    pairs = routed.select("leaf", "block", "role", "id", "code").groupBy("leaf", "block").applyInArrow(best, "a bigint, b bigint, low double, high double")
    pairs = pairs.groupBy("a", "b").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    # of a query's candidates from all leaves those that may be among its k best
    at = F.row_number().over(W.partitionBy("a").orderBy(F.desc("low"), "b"))
    least = F.max(F.when(F.col("_at") == k, F.col("low"))).over(W.partitionBy("a"))
    pairs = pairs.withColumn("_at", at).withColumn("_least", least).where(F.col("_least").isNull() | (F.col("high") >= F.col("_least")))
    # each pair's exact cosine once, whichever way it was found
    two = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") < F.col("b")).alias("_up")).groupBy("a", "b").agg(F.bool_or("_up").alias("_up"), F.bool_or(~F.col("_up")).alias("_down")))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosine = np.minimum(np.einsum("ij,ij->i", _matrix(b.column("x")), _matrix(b.column("y"))), 1.0) if len(b) else np.array([])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "_up", "_down")), pa.array(cosine, pa.float64())], ["a", "b", "_up", "_down", "cosine"])

    full = vectors.select("id", "packed")
    both = two.join(full.select(F.col("id").alias("a"), F.col("packed").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("packed").alias("y")), "b")
    ranked = both.select("a", "b", "_up", "_down", "x", "y").mapInArrow(exact, "a bigint, b bigint, _up boolean, _down boolean, cosine double").where(F.col("cosine") >= floor)
    # if all ask, what a finds is found for b too
    up, down = (F.lit(True), F.lit(True)) if queries is None else (F.col("_up"), F.col("_down"))
    ways = F.array_compact(F.array(F.when(up, F.struct("a", "b")), F.when(down, F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    out = ranked.select(F.explode(ways).alias("_p"), "cosine").select("_p.a", "_p.b", "cosine")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return out.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def assigned(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """(row_index, embedding) of the usable vectors that the manifest assigns to a chunk, each once."""
    known = manifest.where(F.col("row_index").isNotNull() & F.col("chunk_id").isNotNull()).select("row_index").distinct()
    return vectors.select("row_index", "embedding").where(usable(F.col("embedding"))).dropDuplicates(["row_index"]).join(known, "row_index", "left_semi")


def neighbors(rows: DataFrame, k: int = 5, floor: float = -1.0, only: Column | None = None, **how) -> DataFrame:
    """(row_index, neighbor, cosine, rank): the k most similar other rows of every row (or of those that only selects).

    rows: (row_index, embedding). Ties go to the lower row_index. Rows of other lengths than the most common would not be
    comparable, so vectors are compared within their length. A collection of fewer than two vectors gives no rows.
    """
    rows = _packed(rows.withColumn("_asks", F.lit(True) if only is None else F.coalesce(only, F.lit(False)))).withColumn("_class", F.unhex(F.sha2("packed", 256)))
    members = rows.select("row_index", "_class", "_asks")
    classes = rows.groupBy("_class").agg(F.min("row_index").alias("id"), F.first("packed").alias("packed"), F.first("_n").alias("_n"), F.bool_or("_asks").alias("_q"))
    classes = cut(classes)
    near = None
    for length in [r[0] for r in classes.select("_n").distinct().collect()]:  # a vector column has one length, or a few by mistake
        part = classes.where(F.col("_n") == length)
        found = search(part, k, floor, queries=None if only is None else F.col("_q"), **how)
        near = found if near is None else near.unionByName(found)
    if near is None:
        return rows.sparkSession.createDataFrame([], "row_index bigint, neighbor bigint, cosine double, rank int")
    members = cut(members.join(classes.select("_class", "id"), "_class").select("row_index", "id", "_asks"))
    first = members.select("id", F.col("row_index").alias("neighbor")).withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("neighbor"))).where(F.col("_r") <= k + 1).drop("_r")
    lists = near.join(first.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "neighbor", "cosine")
    shared = first.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("id"))).where("_n > 1").select("id", "neighbor", F.lit(1.0).alias("cosine"))
    lists = lists.unionByName(shared)
    lists = lists.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "neighbor"))).where(F.col("_r") <= k + 1).drop("_r")
    out = members.where("_asks").join(lists, "id").where(F.col("row_index") != F.col("neighbor"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("row_index").orderBy(F.desc("cosine"), "neighbor")))
    return out.where(F.col("rank") <= k).select("row_index", "neighbor", "cosine", "rank")


def close_pairs(vectors: DataFrame, manifest: DataFrame, k: int = 5, least: float = 0.95, **how) -> DataFrame:
    """(row_index_a, row_index_b), a < b: pairs of at least that cosine of which one is among the k most similar of the other."""
    near = neighbors(assigned(vectors, manifest), k, floor=least, **{"visits": 12} | how)
    return near.select(F.least("row_index", "neighbor").alias("row_index_a"), F.greatest("row_index", "neighbor").alias("row_index_b")).distinct()
