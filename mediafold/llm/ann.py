"""Approximate nearest neighbours (largest inner product) with a hierarchical k-means tree.

The tree is fitted on a bounded sample: k-means with ``branch`` centres, again inside each cell, until a cell holds
about ``leaf_rows`` rows of the table.  Every vector of the table goes to the leaf that greedy descent reaches.  A query
walks the tree best bin first: a priority queue holds the open nodes by an optimistic bound of the inner product
(``q.c + |q| r`` with ``r`` the radius of the node's sample), and leaves come out in the order of that bound.  How many
leaves to visit is widened until a calibration set, searched exactly, reaches the target recall.

Scale: the tree is ``sample / leaf`` centres on the driver and broadcast.  The table is indexed in one map and its leaves, in
tree order, fill groups of about ``block_rows`` rows; a leaf that holds a third of all rows is many groups.  A query is
sent once to each group that has leaves for it, with their numbers; the group's rows are held, its queries stream past in
small pieces, and the best ``k`` of each are merged over ``k`` rows a group.  Only leaf sizes and the calibration figures reach the driver.  Work is queries
times visited rows, and leaves keep their size as the table grows.

Scores are inner products of the original vectors in double precision, summed in one fixed order; equal vectors
have equal scores and ties go to the smaller id.

Edge cases: vectors that are NULL, empty, zero, of another length than most, or hold NULL or non-finite components, and
rows with a NULL id, take no part; repeated ids are candidates each (a query never returns its own id) and give one
query; fewer than ``k`` candidates are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediafold.llm.common import map_arrow, sorted_groups, stored

FOUND = "query_id long, vec_id long, score double"


@dataclass
class Tree:
    """Arrays over nodes: centre, radius, children; a leaf has a number."""

    centre: np.ndarray
    radius: np.ndarray
    children: list[list[int]]
    leaf: list[int] = field(default_factory=list)
    n_leaves: int = 0


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        for i in range(k):
            if (own == i).any():
                c[i] = x[own == i].mean(0)
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def build_tree(sample: np.ndarray, leaf_rows: float, branch: int = 8, seed: int = 7) -> Tree:
    """Split the sample until a cell has at most ``leaf_rows`` rows (or only equal ones)."""
    rng = np.random.default_rng(seed)
    centre, radius, children, leaf = [], [], [], []

    def add(x: np.ndarray) -> int:
        node = len(centre)
        c = x.mean(0)
        centre.append(c)
        radius.append(float(np.sqrt(((x - c) ** 2).sum(1)).max()))
        children.append([])
        leaf.append(-1)
        if len(x) > max(leaf_rows, 1) and len(x) > branch and radius[node] > 1e-9:
            own = _kmeans(x, branch, rng)
            parts = [x[own == i] for i in range(branch) if (own == i).any()]
            if len(parts) > 1:
                children[node] = [add(p) for p in parts]
        return node

    if len(sample):
        add(sample)
    tree = Tree(np.array(centre), np.array(radius), children, leaf)
    for node, kids in enumerate(children):
        if not kids:
            tree.leaf[node] = tree.n_leaves
            tree.n_leaves += 1
    return tree


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row by greedy descent to the nearest centre."""
    out = np.zeros(len(x), np.int64)
    work = [(0, np.arange(len(x)))]
    while work:
        node, rows = work.pop()
        kids = tree.children[node]
        if not kids:
            out[rows] = tree.leaf[node]
            continue
        c = tree.centre[kids]
        own = (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        work += [(kid, rows[own == i]) for i, kid in enumerate(kids) if (own == i).any()]
    return out


def best_bins(tree: Tree, q: np.ndarray, visits: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
    """The first ``visits`` leaves of a best-bin-first walk, and more until they hold ``need`` rows (``held`` by leaf)."""
    norm = float(np.sqrt((q * q).sum()))
    queue, out, rows = [(0.0, 0)], [], 0
    while queue and (len(out) < visits or rows < need):
        _, node = heapq.heappop(queue)
        kids = tree.children[node]
        if not kids:
            out.append(tree.leaf[node])
            rows += int(held[out[-1]]) if held is not None else need
            continue
        # Half of the radius: the full bound is almost never met and would visit wide nodes first.
        bound = tree.centre[kids] @ q + 0.5 * norm * tree.radius[kids]
        for b, kid in zip(bound.tolist(), kids, strict=True):
            heapq.heappush(queue, (-b, kid))
    return out


def pair_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner product of each row of ``x`` with the same row of ``q``, always summed in the same order."""
    out = x[:, 0] * q[:, 0]
    for j in range(1, x.shape[1]):
        out += x[:, j] * q[:, j]
    return out


def best_pairs(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, rough: np.ndarray, k: int):
    """(query index, row index, score) of the best ``k`` rows of each query, best first, ties to the smaller id.

    ``rough`` holds approximate scores, -inf where a row is no candidate; it is overwritten.
    """
    rough[qids[:, None] == ids[None, :]] = -np.inf
    if rough.shape[1] > k:
        kth = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        with np.errstate(invalid="ignore"):
            floor = np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)), -np.inf)
        qi, ri = np.nonzero((rough >= floor[:, None]) & (rough > -np.inf))
    else:
        qi, ri = np.nonzero(rough > -np.inf)
    s = pair_scores(x[ri], q[qi])
    order = np.lexsort((ids[ri], -s, qi))
    qi, ri, s = qi[order], ri[order], s[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[keep], ri[keep], s[keep]


def clean_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    v = F.col("vector")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
    rows = rows.where(F.exists(v, lambda c: c != 0))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size(v) == (size[0]["n"] if size else 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def _sample(rows: DataFrame, n: int, total: int, seed: int) -> list:
    """At most ``n`` rows by a hash of the id, without sorting the table."""
    h = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 20))
    return rows.where(h < F.lit(min(1.0, 1.2 * n / max(total, 1)) * (1 << 20))).orderBy(h, "vec_id").limit(n).collect()


def search(rows: DataFrame, is_query, k: int = 20, target_recall: float = 0.94, sample_rows: int = 20_000,
           leaf_rows: int = 256, block_rows: int = 8_192, calibration: int = 128) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id, rank, vec_id, score``.

    ``is_query`` maps the id column to a condition.  ``sample_rows`` bounds the rows the tree is fitted on.
    """
    spark = rows.sparkSession
    vectors = stored(clean_vectors(rows), "vectors")
    total = vectors.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if total == 0:
        return empty
    got = _sample(vectors, sample_rows, total, 1)
    sample = np.array([r["vector"] for r in got])
    tree = build_tree(sample, leaf_rows * len(sample) / total)
    shared = spark.sparkContext.broadcast(tree)  # at most a few centres a sample row

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = descend(shared.value, _matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "vector", "leaf"])

    indexed = stored(map_arrow(vectors, assign, "vec_id long, vector array<double>, leaf long"), "index")
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # one row a leaf
    # Leaves in tree order fill groups of about block_rows rows; a larger leaf is several groups.
    first, parts, group, room = [], [], -1, 0
    for leaf in range(tree.n_leaves):
        n = sizes.get(leaf, 0)
        parts.append(max(1, -(-n // block_rows)))
        if parts[-1] > 1 or n > room:
            group, room = group + 1, block_rows
        first.append(group)
        group, room = group + parts[-1] - 1, (room - n if parts[-1] == 1 else 0)
    held = np.array([sizes.get(leaf, 0) for leaf in range(tree.n_leaves)])
    places = spark.sparkContext.broadcast((np.array(first), np.array(parts), held))

    def place(batches):
        first, parts, _ = places.value
        for batch in batches:
            if batch.num_rows:
                leaf = batch.column(2).to_numpy()
                spread = batch.column(3).to_numpy() % parts[leaf]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[leaf] + spread), pa.array(np.zeros(len(leaf), np.int32)), batch.column(0),
                     batch.column(1), pa.array(leaf[:, None].tolist(), pa.list_(pa.int64()))],
                    ["group", "kind", "id", "vector", "leaves"])

    routed_as = "group long, kind int, id long, vector array<double>, leaves array<long>"
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    members = map_arrow(indexed.select("vec_id", "vector", "leaf", spread), place, routed_as)

    def run(queries: DataFrame, visits: int) -> DataFrame:
        """Best ``k`` per query and group over the first ``visits`` leaves."""
        def route(batches):
            first, parts, held = places.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column(1))
                at, to, leaves = [], [], []
                for i in range(len(q)):
                    by_group: dict[int, list[int]] = {}
                    for x in best_bins(shared.value, q[i], visits, held, k + 1):  # its own row and k others
                        for g in range(first[x], first[x] + parts[x]):
                            by_group.setdefault(int(g), []).append(x)
                    at += [i] * len(by_group)
                    to += by_group
                    leaves += by_group.values()
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int64()), pa.array([1] * len(at), pa.int32()), batch.column(0).take(take),
                     batch.column(1).take(take), pa.array(leaves, pa.list_(pa.int64()))],
                    ["group", "kind", "id", "vector", "leaves"])

        routed = map_arrow(queries.select("vec_id", "vector"), route, routed_as)

        def scan(candidates: pa.Table, asked: pa.Table) -> pa.Table:
            """Best ``k`` of a group's rows for some of its queries."""
            leaf = np.array([x[0] for x in candidates.column("leaves").to_pylist()], np.int64)
            order = np.argsort(leaf, kind="stable")
            leaf, ids = leaf[order], candidates.column("id").to_numpy()[order]
            x = np.ascontiguousarray(_matrix(candidates.column("vector"))[order])
            qids, q = asked.column("id").to_numpy(), _matrix(asked.column("vector"))
            rough = np.full((len(q), len(x)), -np.inf)
            want: dict[int, list[int]] = {}
            for i, leaves in enumerate(asked.column("leaves").to_pylist()):
                for n in leaves:
                    want.setdefault(n, []).append(i)
            for n, rows in want.items():
                a, b = np.searchsorted(leaf, [n, n + 1])
                if a < b:
                    rough[rows, a:b] = q[rows] @ x[a:b].T
            qi, ri, s = best_pairs(ids, x, qids, q, rough, k)
            return pa.table({"query_id": qids[qi], "vec_id": ids[ri], "score": s})

        def answer(batches):
            # Sorted by group and kind: a group's rows (bounded) come first, then its queries, a few at a time.
            held: list[pa.Table] = []
            of = None
            for piece in sorted_groups(batches, ["group", "kind"], max_rows=256):
                group, kind = piece.column("group")[0].as_py(), piece.column("kind")[0].as_py()
                if group != of:
                    held, of = [], group
                if kind == 0:
                    held.append(piece)
                elif held:
                    held = [pa.concat_tables(held)]
                    yield from scan(held[0], piece).to_batches()

        both = members.unionByName(routed).repartition("group").sortWithinPartitions("group", "kind")
        return map_arrow(both, answer, FOUND)

    queries = indexed.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])
    # Calibration: a bounded set of queries, searched exactly, block by block.
    trial_rows = _sample(queries.select("vec_id", "vector"), calibration, max(total // 20, 1), 2)
    visits = _calibrate(tree, indexed, trial_rows, k, target_recall)
    found = run(queries, visits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _calibrate(tree: Tree, indexed: DataFrame, trial_rows: list, k: int, target: float) -> int:
    """Fewest visits, widened by halves, with which the trial queries reach the target recall."""
    if not trial_rows or not tree.n_leaves:
        return max(tree.n_leaves, 1)  # nothing to calibrate by: all leaves
    ids = np.array([r["vec_id"] for r in trial_rows])
    q = np.array([r["vector"] for r in trial_rows])

    def exact(batches):
        best: list[list] = [[] for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, x, leaf = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
            for lo in range(0, len(x), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                qi, ri, s = best_pairs(cid[part], x[part], ids, q, q @ x[part].T, k)
                for i, r, score in zip(qi.tolist(), ri.tolist(), s.tolist(), strict=True):
                    best[i].append((-score, int(cid[lo + r]), int(leaf[lo + r])))
            best = [sorted(b)[:k] for b in best]
        rows = [(i, -s, v, leaf) for i, b in enumerate(best) for s, v, leaf in b]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
            ["q", "score", "vec_id", "leaf"])

    # k rows a trial query and partition, cut to k a query before they reach the driver.
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = (map_arrow(indexed.select("vec_id", "vector", "leaf"), exact, "q long, score double, vec_id long, leaf long")
            .withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "leaf").collect())
    walks = [{leaf: i for i, leaf in enumerate(best_bins(tree, x, tree.n_leaves))} for x in q]
    depth = np.array([walks[r["q"]].get(r["leaf"], tree.n_leaves) for r in true])
    visits = 4
    while visits < tree.n_leaves and (depth < visits).mean() < target:
        visits += max(1, visits // 2)
    return min(visits, tree.n_leaves)
