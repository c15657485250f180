"""Exact top-k inner-product search with M-trees.

An inner product is turned into a metric: every vector gets one more component that puts
all of them on a sphere as wide as the longest, queries get a 0 there. Among vectors on the
sphere a larger inner product is a smaller Euclidean distance. Rows are dealt out evenly to
trees of bounded size; a tree's pages hold routing objects with covering radii and the
distances to their parents. Each query goes best-first through each tree, skipping pages
and entries by the triangle inequality; the queries of a block that are at the same page take
it together, by products of matrices. Scores themselves are exact integers.

Trees and blocks meet in tiles: each is dealt to a part of its kind, and a tile is all of a
part of the trees and all of a part of the blocks. A task takes a tile's trees one after the
other, and what a query has found in one bounds its search of the next.
"""

from __future__ import annotations

import heapq
import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.tables import materialize

TREE_ROWS = 8192
PAGE = 128
QUERY_BLOCK = 512
SLACK = 1e-6
# Tiles, where there are as many pairs of a tree and a block; what a tile holds at most.
TILES = 32
TILE_TREES, TILE_BLOCKS = 128, 256

_TREE = "tree int, payload binary"
_BLOCK = "block int, payload binary"


class Page:
    """A page of an M-tree. Leaves hold row numbers, inner pages hold child pages; both
    hold, for each entry, the distance to the page's own routing object, inner ones also its
    object and the covering radius. The objects of a leaf are the points of its rows."""

    __slots__ = ("objects", "to_parent", "radius", "children", "rows")

    def __init__(self, objects, to_parent, radius=None, children=None, rows=None):
        self.objects, self.to_parent, self.radius = objects, to_parent, radius
        self.children, self.rows = children, rows


def _distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - point) ** 2).sum(axis=1), 0))


def build(points: np.ndarray, rows: np.ndarray, parent: np.ndarray, page: int = PAGE) -> Page:
    """A page over the rows: a leaf if they fit, else one entry for each of up to ``page``
    spread-out routing objects with the rows nearest to it."""
    if len(rows) <= page:
        return Page(None, _distances(points[rows], parent), rows=rows)
    fan = min(page, -(-len(rows) // (page // 2)))
    chosen = [int(rows[0])]
    nearest = _distances(points[rows], points[rows[0]])
    owner = np.zeros(len(rows), np.int64)
    while len(chosen) < fan and nearest.max() > 0:
        chosen.append(int(rows[nearest.argmax()]))
        away = _distances(points[rows], points[chosen[-1]])
        owner[away < nearest] = len(chosen) - 1
        nearest = np.minimum(nearest, away)
    if len(chosen) == 1:
        # Equal vectors: cut them into pages as they come.
        parts = [rows[i:i + page] for i in range(0, len(rows), page)]
        parts = parts if len(parts) <= page else np.array_split(rows, page)
        objects = np.repeat(points[rows[:1]], len(parts), axis=0)
    else:
        parts = [rows[owner == i] for i in range(len(chosen))]
        objects = points[chosen]
    radius = np.array([_distances(points[p], o).max() for p, o in zip(parts, objects)])
    children = [build(points, p, o, page) for p, o in zip(parts, objects)]
    return Page(objects, _distances(objects, parent), radius, children)


def search(root: Page, center: np.ndarray, query: np.ndarray, exact, k: int,
           slack: float = SLACK) -> list:
    """The k best (score, -row) of the tree, as a heap with the worst first.

    ``exact`` gives the scores of rows and the distance that the worst kept score allows;
    ``slack`` covers what distances lose to rounding.
    """
    best: list[tuple[int, int]] = []
    reach = np.inf
    waiting = [(0.0, 0, root, float(np.sqrt(((query - center) ** 2).sum())))]
    ties = 1
    while waiting:
        least, _, page, to_object = heapq.heappop(waiting)
        if least > reach + slack:
            break
        lower = np.abs(to_object - page.to_parent)
        if page.radius is not None:
            lower = lower - page.radius
        near = np.flatnonzero(lower <= reach + slack)
        if not len(near):
            continue
        if page.children is None:
            best, reach = exact(page.rows[near], best, k)
            continue
        away = _distances(page.objects[near], query)
        floor = np.maximum(0.0, away - page.radius[near])
        for i in np.flatnonzero(floor <= reach + slack):
            heapq.heappush(waiting, (float(floor[i]), ties, page.children[near[i]],
                                     float(away[i])))
            ties += 1
    return best


def search_block(root: Page, center: np.ndarray, points: np.ndarray, products, reach_of,
                 ids: np.ndarray, own: np.ndarray, k: int, slack: float = SLACK, best=None):
    """``query, row, score`` of the k best rows of the tree for each of ``points``, ties to the
    smaller of ``ids``; a row with the id in ``own`` is no candidate of that query.

    As ``search``, in rounds: every query takes the nearest of its waiting pages, one until it
    has k rows and then twice as many as in the round before. ``products`` gives the scores of
    queries and rows, ``reach_of`` the distances that the worst kept scores of queries allow.
    ``best``, of the same form and in order of query and rank, is what was found before, among
    rows whose ids follow those of the tree.
    """
    best = best or [np.zeros(0, np.int64), np.zeros(0, np.int64), products([], [])[:0].ravel()]
    none = np.iinfo(best[2].dtype).min if best[2].dtype.kind == "i" else -np.inf
    worst = np.full(len(points), none, best[2].dtype)
    reach = np.full(len(points), np.inf)

    def bound():
        full = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1
        worst[best[0][full]] = best[2][full]
        reach[best[0][full]] = reach_of(best[0][full], best[2][full])

    bound()
    pages, children_at = [root], {}
    query, page = np.arange(len(points)), np.zeros(len(points), np.int64)
    floor, away = np.zeros(len(points)), np.sqrt(((points - center) ** 2).sum(axis=1))
    take = 1
    while True:
        near = floor <= reach[query] + slack
        query, page, floor, away = query[near], page[near], floor[near], away[near]
        if not len(query):
            return best
        take = 1 if np.isinf(reach[query]).any() else 16 * take
        by = np.lexsort((floor, query))
        now = np.zeros(len(by), bool)
        now[by] = np.arange(len(by)) - np.searchsorted(query[by], query[by]) < take
        at = np.flatnonzero(now)
        at = at[np.argsort(page[at], kind="stable")]
        waiting = [[x[~now]] for x in (query, page, floor, away)]
        found = [[x] for x in best]
        for of in np.split(at, np.flatnonzero(np.diff(page[at])) + 1):
            here, asking = pages[page[of[0]]], query[of]
            if here.children is None:
                # Rows that one of the queries may want; the scores themselves say which does.
                least, most = away[of] - reach[asking] - slack, away[of] + reach[asking] + slack
                rows = here.rows[(here.to_parent >= least.min()) & (here.to_parent <= most.max())]
                scores = products(asking, rows)
                i, j = np.nonzero(scores >= worst[asking, None])
                other = ids[rows[j]] != own[asking[i]]
                i, j = i[other], j[other]
                for column, more in zip(found, (asking[i], rows[j], scores[i, j])):
                    column.append(more)
                continue
            close = (np.abs(away[of, None] - here.to_parent) - here.radius
                     <= reach[asking, None] + slack)
            entries = np.flatnonzero(close.any(axis=0))
            to_object = np.stack([_distances(points[asking], here.objects[e]) for e in entries]
                                 or [np.zeros(len(asking))[:0]], axis=-1)
            below = np.maximum(floor[of, None], to_object - here.radius[entries])
            i, j = np.nonzero(close[:, entries] & (below <= reach[asking, None] + slack))
            if page[of[0]] not in children_at:
                children_at[page[of[0]]] = len(pages)
                pages += here.children
            for column, more in zip(waiting, (asking[i], children_at[page[of[0]]] + entries[j],
                                              below[i, j], to_object[i, j])):
                column.append(more)
        query, page, floor, away = map(np.concatenate, waiting)
        of, row, score = map(np.concatenate, found)
        by = np.lexsort((ids[row], -score, of))
        by = by[np.arange(len(by)) - np.searchsorted(of[by], of[by]) < k]
        best = [of[by], row[by], score[by]]
        bound()


def _quantized(embedding: str, scale: int):
    def whole(x):
        scaled = F.floor(x.cast("double") * scale)
        beyond = F.raise_error(F.lit("a component times the scale is beyond a long"))
        return F.when(F.abs(x.cast("double") * scale) < 2.0**63, scaled).otherwise(
            beyond.cast("bigint"))

    return F.transform(F.col(embedding), whole)


def _squared(vectors: np.ndarray) -> np.ndarray:
    """Squared lengths, as doubles: squares of whole numbers may pass 64 bits."""
    return (vectors.astype(float) ** 2).sum(axis=-1)


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds all of them."""
    for kind in (np.int8, np.int16, np.int32):
        limits = np.iinfo(kind)
        if limits.min <= vectors.min() and vectors.max() <= limits.max:
            return vectors.astype(kind)
    return vectors


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1).astype(np.int64)


def _build_tree(key, table: pa.Table, page: int, length: float) -> pa.Table:
    ids, vectors = _vectors(table)
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    lifted = np.sqrt(np.maximum(length - _squared(vectors), 0))
    points = np.concatenate([vectors.astype(float), lifted[:, None]], axis=1)
    center = points.mean(axis=0)
    root = build(points, np.arange(len(ids)), center, page)
    payload = pickle.dumps((ids, _narrow(vectors), center, root), protocol=5)
    return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()),
                     "payload": pa.array([payload], pa.binary())})


def _build_block(key, table: pa.Table) -> pa.Table:
    ids, vectors = _vectors(table)
    payload = pickle.dumps((ids, _narrow(vectors)), protocol=5)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()),
                     "payload": pa.array([payload], pa.binary())})


class Block:
    """Queries, and the k best rows for each in the trees that they have met."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, length: float, k: int):
        self.ids, self.k = ids, k
        self.points = np.pad(queries.astype(float), ((0, 0), (0, 1)))
        squared = _squared(queries)
        self.base = squared + length
        # No partial sum of a product passes the lengths' own: floats count exactly up to 2^24,
        # doubles to 2^52, longs to 62 bits, Python's integers beyond.
        most = float(squared.max() * length)
        self.kind = (np.float32 if most < 2.0**48 else float if most < 2.0**104 else
                     np.int64 if most < 2.0**124 else object)
        self.queries = queries.astype(self.kind)
        self.query, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros(0, self.kind)
        # Rounding of squares moves a distance by no more than its root's share of the sphere.
        self.slack = SLACK + 1e-7 * np.sqrt(length)

    def reach_of(self, asking, worst):
        left = (self.base[asking] - 2.0 * worst).astype(float)
        return np.sqrt(np.maximum(0.0, left)) + 1e-7 * np.sqrt(self.base[asking])

    def meet(self, ids: np.ndarray, vectors: np.ndarray, center: np.ndarray, root: Page) -> None:
        vectors = vectors.astype(self.kind)

        def products(asking, rows):
            rows, asking = np.asarray(rows, np.int64), np.asarray(asking, np.int64)
            return self.queries[asking] @ vectors[rows].T

        ids = np.concatenate([ids, self.row])
        before = [self.query, np.arange(len(vectors), len(ids)), self.score]
        self.query, row, self.score = search_block(
            root, center, self.points, products, self.reach_of, ids, self.ids, self.k, self.slack,
            before)
        self.row = ids[row]

    def found(self) -> pa.RecordBatch:
        found = self.ids[self.query], self.row, self.score.tolist()
        for query_id, vec_id, score in zip(*found) if self.kind is object else ():
            if not -2**63 <= score < 2**63:
                raise ValueError(f"the score of {query_id} and {vec_id} is beyond a long")
        found = (*found[:2], [int(score) for score in found[2]])
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])


def _search_tiles(batches, k: int, length: float):
    """The k best rows of each tile for each of its queries; a tile's blocks come before its
    trees, and queries meet trees of their own size only."""
    now, blocks = None, []
    for batch in batches:
        for tile, size, is_tree, payload in zip(*map(batch.column, (
                "tile", "size", "is_tree", "payload"))):
            if tile != now:
                yield from (block.found() for _, block in blocks)
                now, blocks = tile, []
            ids, vectors, *tree = pickle.loads(payload.as_buffer())
            if not is_tree.as_py():
                blocks.append((size, Block(ids, vectors, length, k)))
                continue
            for of_size, block in blocks:
                if of_size == size:
                    block.meet(ids, vectors, *tree)
    yield from (block.found() for _, block in blocks)


def grid(n_trees: int, n_blocks: int, tree_rows: int = TREE_ROWS, query_block: int = QUERY_BLOCK,
         k: int = 20) -> tuple[int, int]:
    """Into how many parts trees and blocks are dealt: of those that make ``TILES`` tiles, if
    there are as many pairs, of ``TILE_TREES`` and ``TILE_BLOCKS`` at most, the ones that move
    least. A row goes to every part of the blocks; a query goes to every part of the trees and
    brings ``k`` rows from each, a third as wide as what a tree holds of a row."""
    tiles, least = min(TILES, n_trees * n_blocks), -(-n_trees // TILE_TREES)
    pairs = ((max(least, -(-tiles // of_blocks)), of_blocks)
             for of_blocks in range(-(-n_blocks // TILE_BLOCKS), n_blocks + 1))
    return min((pair for pair in pairs if pair[0] <= n_trees), key=lambda pair: (
        3 * pair[1] * n_trees * tree_rows + pair[0] * n_blocks * query_block * (k + 3)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64,
          row_id: str = "vec_id", embedding: str = "embedding", tree_rows: int = TREE_ROWS,
          query_block: int = QUERY_BLOCK, page: int = PAGE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k largest inner products.

    Components x count as floor(scale * x). A query's own id is no candidate; ties go to
    the smaller id; fewer candidates give fewer rows. Vectors that are null or hold null,
    NaN or infinite components, and rows without an id, take no part; queries only meet
    vectors of their own length. Repeated ids are candidates of their own, a repeated
    query counts once (its smallest vector). No rows on either side give none. Other
    columns are not read. Squares and products may pass 64 bits; a scaled component, or a
    score among the best of a tree, that does not fit a long fails the job. This runs jobs.

    Trees hold about ``tree_rows`` rows, dealt out by a hash of id and vector, and blocks about
    ``query_block`` queries. A task holds one tree at a time and at most ``TILE_BLOCKS`` blocks,
    whatever the size of either table; a query's k best of all tiles are merged at the end.
    """
    def usable(df: DataFrame) -> DataFrame:
        finite = F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                          & (F.abs(x.cast("double")) < float("inf")))
        return (df.select(F.col(row_id).cast("bigint").alias("vec_id"),
                          F.col(embedding).alias("_e"))
                .filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
                        & (F.size("_e") > 0))
                .select("vec_id", _quantized("_e", scale).alias("v")))

    rows = materialize(usable(vectors))
    asked = materialize(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("length")).first()
    n_trees = max(1, -(-shape.n // tree_rows))
    n_blocks = max(1, -(-asked.count() // query_block))
    longest = float(shape.length or 0)

    # Plain functions, as Spark reads the signature of what it applies to a group.
    def build_tree(key, table):
        return _build_tree(key, table, page, longest)

    def build_block(key, table):
        return _build_block(key, table)

    dealt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_trees))
    size_of = F.size("v") * F.lit(n_trees)
    trees = materialize(
        rows.withColumn("tree", (dealt + size_of).cast("int")).select("tree", "vec_id", "v")
        .groupBy("tree").applyInArrow(build_tree, _TREE)
        .withColumn("size", F.floor(F.col("tree") / n_trees).cast("int")))
    in_block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) + F.size("v") * F.lit(n_blocks)
    blocks = materialize(
        asked.withColumn("block", in_block.cast("int")).select("block", "vec_id", "v")
        .groupBy("block").applyInArrow(build_block, _BLOCK)
        .withColumn("size", F.floor(F.col("block") / n_blocks).cast("int")))
    of_trees, of_blocks = grid(n_trees, n_blocks, tree_rows, query_block, k)

    def parts(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    tiles = (
        trees.select(F.pmod("tree", F.lit(of_trees)).alias("_t"), parts(of_blocks).alias("_b"),
                     "size", F.lit(True).alias("is_tree"), "payload")
        .union(blocks.select(parts(of_trees).alias("_t"), F.pmod("block", F.lit(of_blocks)),
                             "size", F.lit(False), "payload"))
        .select((F.col("_t") * of_blocks + F.col("_b")).cast("int").alias("tile"), "size",
                "is_tree", "payload")
        .repartitionById(of_trees * of_blocks, "tile").sortWithinPartitions("tile", "is_tree"))
    found = tiles.mapInArrow(partial(_search_tiles, k=k, length=longest),
                             "query_id bigint, vec_id bigint, score bigint")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
