"""Near duplicates among labelled vectors: a subspace pigeonhole join.

Unit vectors of cosine c are 2 - 2 c apart, squared. Vectors are rotated to the principal
axes of a bounded sample, and the axes are dealt into blocks. A pair within the whole budget
is within its share in one block at least, a block's share being in proportion to its
variance. So each block is range-joined under its own budget, and what is found there is
verified by the cosine of the vectors themselves, in double precision. A pair counts in the
first block whose budget it keeps, and so once, with no table of pairs to tell apart.

The range join of a block: a k-d tree over the sample cuts the block into boxes, as deep as
the label's size asks for. A vector lives in one box and visits the boxes behind it that its
range reaches. Vectors of a box are dealt into tiles of about TILE; a tile meets itself, the
tiles after it and all visitors, which stream by. So a tile is all that a task holds, however
many vectors a label or a box has, and of what a tile finds, only counts and the edges of a
spanning forest come out. The sample makes work even; results do not depend on it.

Equal vectors of a label are one class with a size, joined back at the end, so copies never
meet. Everything reads tables in the shared folder; the driver sees the sample alone.

Odd rows: a null label, or a vector that is null, empty, zero or holds null or non-finite
components, has no link and is its own component. Vectors of different lengths have no link.
Repeated rows are vectors that link with each other. A null id links as any other and is
never a component while another id is in it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import tables
from gaugeline.operators.graph import connected_components
from gaugeline.scratch import discard, materialise
from gaugeline.session import spread, table

COSINE = 0.93
BLOCKS = 8
#: Vectors of a tile, and those that a label's boxes hold on average at most while the tree is deep enough.
TILE = 1024
#: Vectors that rotation and trees are fitted on, those of smallest hash, and a leaf's least share of them.
SAMPLE, LEAF = 32_768, 16
#: What rounding may move a squared distance by.
SLACK = 1e-9
#: Rows routed, and pairs verified, at a time.
STEP = 256
PAIRS = 1 << 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Tree:
    """A k-d tree over one block: node i of a level has the children 2 i and 2 i + 1 in the next."""

    def __init__(self, points: np.ndarray, levels: int):
        self.axis, self.cut = [], []
        parts = [np.arange(len(points))]
        for _ in range(levels):
            axes, cuts, below = [], [], []
            for part in parts:
                spread_ = points[part].var(0) if len(part) else np.zeros(points.shape[1])
                axis = int(spread_.argmax())
                cut = float(np.median(points[part, axis])) if len(part) else 0.0
                right = points[part, axis] > cut
                axes.append(axis)
                cuts.append(cut)
                below += [part[~right], part[right]]
            self.axis.append(np.array(axes))
            self.cut.append(np.array(cuts))
            parts = below

    def home(self, points: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for axis, cut in zip(self.axis[:depth], self.cut[:depth]):
            node = 2 * node + (points[np.arange(len(points)), axis[node]] > cut[node])
        return node

    def reached(self, points: np.ndarray, depth: int, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the boxes within a squared distance of each point, its own among them."""
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        off, far = np.zeros_like(points), np.zeros(len(points))
        for axes, cuts in zip(self.axis[:depth], self.cut[:depth]):
            axis = axes[node]
            gap = points[row, axis] - cuts[node]
            right = gap > 0
            across = far - off[np.arange(len(row)), axis] ** 2 + gap**2
            go = np.flatnonzero(across <= budget + SLACK)
            beyond = off[go]
            beyond[np.arange(len(go)), axis[go]] = np.abs(gap[go])
            node = np.concatenate([2 * node + right, 2 * node[go] + ~right[go]])
            row, off, far = np.concatenate([row, row[go]]), np.concatenate([off, beyond]), np.concatenate([far, across[go]])
        return row, node


class Blocks:
    """Rotation, blocks, budgets and trees for vectors of one length."""

    def __init__(self, sample: np.ndarray, cosine: float = COSINE, blocks: int = BLOCKS):
        points, dims = unit(sample), sample.shape[1]
        variance, axes = np.linalg.eigh(np.cov(points, rowvar=False, bias=True).reshape(dims, dims) + 1e-12 * np.eye(dims))
        self.parts = [np.arange(dims)[::-1][b::blocks] for b in range(min(blocks, dims))]  # each has strong and weak axes
        self.axes = axes
        share = np.array([variance[p].sum() for p in self.parts])
        self.budget = (2 - 2 * cosine) * share / share.sum() + SLACK
        self.cosine = cosine
        levels = max(0, int(np.log2(max(1, len(points) / LEAF))))
        turned = points @ axes
        self.trees = [Tree(turned[:, p], levels) for p in self.parts]

    def turned(self, units: np.ndarray) -> np.ndarray:
        return units @ self.axes

    def near(self, b: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs (row of x, row of y) of unit vectors that keep the budget in block b and in no block before it, and whose cosine is high enough."""
        tx, ty = self.turned(x), self.turned(y)
        p, q = tx[:, self.parts[b]], ty[:, self.parts[b]]
        apart = (p**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * p @ q.T
        i, k = np.nonzero(apart <= self.budget[b] + SLACK)
        found = []
        for at in range(0, len(i), PAIRS):
            s, t = i[at : at + PAIRS], k[at : at + PAIRS]
            ok = np.einsum("ij,ij->i", x[s], y[t]) >= self.cosine
            s, t = s[ok], t[ok]
            gap = (tx[s] - ty[t]) ** 2
            first = gap[:, self.parts[b]].sum(1) <= self.budget[b]
            for part, budget in zip(self.parts[:b], self.budget[:b]):
                first &= gap[:, part].sum(1) > budget
            found.append(np.stack([s[first], t[first]], 1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(vector: str, label: str):
    """Whether a row can have links."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def fit(classes: DataFrame, cosine: float = COSINE) -> dict[int, Blocks]:
    """By length of vectors, from the SAMPLE classes of smallest hash; lengths that are not among them get one box."""
    taken = classes.select("dims", "vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    dims = taken["dims"].to_numpy()
    found = {}
    for d in np.unique(dims).tolist():
        rows = taken.filter(pa.array(dims == d))["vector"].combine_chunks()
        found[d] = Blocks(_rows(rows, d), cosine)
    return found


def _depth(blocks: Blocks, n: int) -> int:
    return min(len(blocks.trees[0].axis), max(0, int(np.ceil(np.log2(n / TILE)))))


def routed(classes: DataFrame, shipped, homes: bool) -> DataFrame:
    """(label, dims, block, leaf) of each class in each block; or, with visit, node, size and vector, also of the boxes behind that it reaches."""
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    names = ["label", "dims", "block", "leaf"] + ([] if homes else ["visit", "node", "size", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, many = batch.column("dims").to_numpy(), batch.column("many").to_numpy()
            for d in np.unique(dims).tolist():
                model: Blocks = shipped.value[d]
                depths = np.array([_depth(model, n) for n in many.tolist()])
                for depth in np.unique(depths[dims == d]).tolist():
                    which = np.flatnonzero((dims == d) & (depths == depth))
                    for at in range(0, len(which), STEP):
                        part = batch.take(pa.array(which[at : at + STEP]))
                        turned = model.turned(unit(_rows(part.column("vector"), d)))
                        for b, (tree, axes) in enumerate(zip(model.trees, model.parts)):
                            points = turned[:, axes]
                            home = tree.home(points, depth)
                            row, leaf = (np.arange(len(points)), home) if homes else tree.reached(points, depth, model.budget[b])
                            ok = leaf >= home[row]
                            row, leaf = row[ok], leaf[ok]
                            rows = part.take(pa.array(row))
                            out = [rows.column("label"), rows.column("dims"), pa.array(np.full(len(row), b, np.int32)), pa.array(leaf)]
                            if not homes:
                                out += [pa.array(leaf > home[row]), rows.column("node"), rows.column("size"), rows.column("vector")]
                            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"label {kinds['label']}, dims int, block int, leaf long" + ("" if homes else f", visit boolean, node long, size long, vector {kinds['vector']}")
    return classes.mapInArrow(run, schema)


CELL = ["label", "dims", "block", "leaf"]


def tiles(classes: DataFrame, cells: DataFrame, shipped) -> DataFrame:
    """CELL, tile, visit, node, size, vector: who meets whom; sorted so that a tile's own vectors stand before its visitors."""
    met = tables.join_hot(routed(classes, shipped, homes=False), cells, CELL, "n", ["tiles"])
    own = F.pmod(F.hash("node"), F.col("tiles"))
    first = F.when(F.col("visit"), F.lit(0)).otherwise(own)
    met = met.withColumns({"own": F.when(~F.col("visit"), own), "tile": F.explode(F.sequence(first, F.col("tiles") - 1))})
    met = met.select(*CELL, "tile", (F.col("visit") | (F.col("own") != F.col("tile"))).alias("visit"), "node", "size", "vector")
    place = [*CELL, "tile"]
    return met.repartition(tables.partitions(classes), *place).sortWithinPartitions(*place, "visit")


def _least(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is joined with by pairs."""
    label = np.arange(n)
    while len(pairs):
        before = label.copy()
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        np.minimum.at(label, pairs[:, 0], low)
        np.minimum.at(label, pairs[:, 1], low)
        if (label == before).all():
            break
    return label


def _sums(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, of.astype(np.float64), n).astype(np.int64)  # exact below 2 ** 53


class Tile:
    """The vectors that live in a tile, and what has been found of them."""

    def __init__(self, blocks: Blocks, block: int):
        self.blocks, self.block = blocks, block
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.label: np.ndarray | None = None

    def add(self, node: np.ndarray, size: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.append((node.copy(), size.copy(), unit(vectors)))

    def close(self) -> None:
        """All who live here have come: they meet each other."""
        self.node, self.size, self.unit = (np.concatenate(x) for x in zip(*self.parts))
        pairs = self.blocks.near(self.block, self.unit, self.unit)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        self.links = _sums(pairs[:, 0], self.size[pairs[:, 1]], len(self.node))
        self.label = _least(len(self.node), pairs[pairs[:, 0] < pairs[:, 1]])
        ends = np.flatnonzero(self.label != np.arange(len(self.node)))
        self.edges = np.stack([self.node[ends], self.node[self.label[ends]]], 1)

    def meet(self, node: np.ndarray, size: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        """Visitors: their links, and one edge to each component of the tile that they have a link to."""
        if self.label is None:
            self.close()
        pairs = self.blocks.near(self.block, unit(vectors), self.unit)
        self.links += _sums(pairs[:, 1], size[pairs[:, 0]], len(self.node))
        links = _sums(pairs[:, 0], self.size[pairs[:, 1]], len(node))
        ends = np.unique(np.stack([pairs[:, 0], self.label[pairs[:, 1]]], 1), axis=0)
        return _found(node, links, np.stack([node[ends[:, 0]], self.node[ends[:, 1]]], 1))

    def done(self) -> pa.RecordBatch:
        if not self.parts:  # visitors alone
            return _found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
        if self.label is None:
            self.close()
        return _found(self.node, self.links, self.edges)


def _found(node: np.ndarray, links: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """(node, links, other): counts have no other, edges no links."""
    some = links > 0
    none = np.zeros(len(edges), np.int64)
    other = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(edges[:, 1].astype(np.int64))])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], edges[:, 0]]).astype(np.int64)), pa.array(np.concatenate([links[some], none])), other], ["node", "links", "other"])


def meet(shipped):
    """Sorted rows of tiles() to (node, links, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            columns = [batch.column(c) for c in (*CELL, "tile")]
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            visit, node, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("visit", "node", "size"))
            coded = [c.dictionary_encode().indices.to_numpy() for c in columns]
            for c in (*coded, visit):
                new[1:] |= c[1:] != c[:-1]
            edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                here = tuple(c[lo].as_py() for c in columns)
                if here != at:
                    if held is not None:
                        yield held.done()
                    at, held = here, Tile(shipped.value[here[1]], here[2])
                vectors = _rows(batch.column("vector").slice(lo, hi - lo), here[1])
                if not visit[lo]:
                    held.add(node[lo:hi], size[lo:hi], vectors)
                    continue
                for k in range(0, hi - lo if held.parts else 0, TILE):
                    yield held.meet(node[lo:hi][k : k + TILE], size[lo:hi][k : k + TILE], vectors[k : k + TILE])
        if held is not None:
            yield held.done()

    return run


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: id, n_links (other vectors linked directly), component_id (the smallest id reachable), kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("usable", usable("vector", "label"))
    # sums of a vector's copies in the scan's own tasks come first, so a hot vector is one row a task
    own = rows.where("usable").groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    own = materialise(own.select("label", F.size("vector").alias("dims"), "vector", "least", "size", F.monotonically_increasing_id().alias("node")), "embeddings-classes")
    many = own.groupBy("label", "dims").agg(F.count("*").alias("many"))
    classes = materialise(tables.join_hot(own, many, ["label", "dims"], "many", ["many"]), "embeddings-sized")
    models = fit(classes, cosine)
    for d in (r.dims for r in many.where(~F.col("dims").isin([*models])).select("dims").distinct().collect()) if models else ():
        models[d] = Blocks(np.eye(1, d), cosine)
    shipped = rows.sparkSession.sparkContext.broadcast(models)
    cells = routed(classes, shipped, homes=True).groupBy(*CELL).agg(F.count("*").alias("n"))
    cells = materialise(cells.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "embeddings-cells")
    found = materialise(tiles(classes, cells, shipped).mapInArrow(meet(shipped), "node long, links long, other long"), "embeddings-found")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    least = components.join(own.select("node", "least"), "node")
    least = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    told = own.join(links, "node", "left").join(least, "node", "left")
    told = told.select("label", "vector", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    told = materialise(told, "embeddings-told")
    linked = tables.join_hot(rows.where("usable").select("id", "label", "vector"), told, ["label", "vector"], "size", ["n_links", "component_id"]).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = materialise(linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), "embeddings-out")
    discard(own, classes, cells, found, told)
    return out


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings."""
    return near_copies(spread(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


OP12_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS x, row_number() OVER () AS r,
           label IS NOT NULL AND coalesce(len(embedding), 0) > 0 AND len(list_filter(embedding, lambda y : y IS NOT NULL AND isfinite(y))) = len(embedding)
           AND len(list_filter(embedding, lambda y : y <> 0)) > 0 AS usable FROM embeddings
), u AS (SELECT vec_id, label, r, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE usable
), links AS (
    SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
    WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {COSINE}
), reach AS (
    SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), components AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN components ON components.a = v.r
"""
