"""Codes of vectors by a codebook for each part of them, learned by Lloyd rounds over cover trees.

Components are whole numbers, so all distances and sums are exact.  Each task builds one cover tree for each part of
each block of its vectors: a node's children cover it at half its scale, the node's own point is the first of them, and children
are further apart than that scale.  Points lie in the tree's depth-first order, so a subtree is a range of them, and sums of a
subtree are a difference of two cumulative sums.  Where a subtree's centre is nearer to one entry than to all others
by more than the subtree's diameter allows, the triangle inequality gives the whole subtree to that entry; only other nodes go on to
their children, and single points to exact comparisons.  Trees are built once and written; each round reads them
with the entries of the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchplan.llm.common import broadcast_if_small, workspace, written

#: Vectors of one block, which has a tree for each part.
BLOCK = 8192
#: Nodes of so few points aren't split.
LEAF = 6
_NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("centre", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


@dataclass
class Tree:
    """A cover tree over distinct points, in depth-first order; nodes level by level, a node's children side by side."""

    points: np.ndarray  # (n, dim), in the tree's order
    count: np.ndarray  # (n,): how many vectors have the point
    node: np.ndarray  # _NODE

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative sums of components and of counts: before each point, and at the end."""
        zero = np.zeros((1, self.points.shape[1]), np.int64)
        return np.concatenate([zero, np.cumsum(self.points * self.count[:, None], 0)]), np.concatenate([[0], np.cumsum(self.count)])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) for distinct points of int64: order lists the points depth first.

    All nodes of a level are split together: in each pass every node takes its first uncovered point as a child and that child
    covers what is within the level's scale of it, until all is covered.
    """
    n = len(points)
    order = np.arange(n)
    levels = []
    start, end, centre = np.array([0]), np.array([n]), np.array([0])
    while True:
        size = end - start
        owner = np.repeat(np.arange(len(start)), size)
        slot = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        distance = _squared(points[order[slot]], points[centre][owner])
        first = np.cumsum(size) - size
        radius = np.sqrt(np.maximum.reduceat(distance, first).astype(np.float64))
        node = np.zeros(len(start), _NODE)
        node["start"], node["end"], node["centre"], node["radius"], node["child"] = start, end, centre, radius, -1
        levels.append(node)
        split = np.flatnonzero((size > leaf) & (radius > 0))
        if not len(split):
            break
        # the scale of each node's children: a power of two below its radius, so that at least two are needed
        scale = np.exp2(np.ceil(np.log2(radius[split])) - 1)
        place = np.full(len(start), -1)
        place[split] = np.arange(len(split))
        keep = place[owner] >= 0
        at, mine = slot[keep], place[owner[keep]]
        child = np.zeros(len(at), np.int64)
        made = np.zeros(len(split), np.int64)  # children so far
        centres: list[tuple[np.ndarray, np.ndarray]] = []
        left, pick = np.arange(len(at)), centre[split]
        live = np.arange(len(split))
        while len(left):
            own = np.full(len(split), -1)
            own[live] = pick
            near = _squared(points[order[at[left]]], points[own[mine[left]]]) <= (scale * scale)[mine[left]]
            child[left[near]] = made[mine[left[near]]]
            centres.append((live, pick))
            made[live] += 1
            left = left[~near]
            live, firsts = np.unique(mine[left], return_index=True)
            pick = order[at[left[firsts]]]
        offset = np.cumsum(made) - made
        key = offset[mine] + child  # children of a node side by side, in the order in which they came
        by = np.argsort(key, kind="stable")
        order[at] = order[at[by]]  # a node's points stay in the node's range
        amount = np.bincount(key, minlength=int(made.sum()))
        new_centre = np.empty(int(made.sum()), np.int64)
        for k, (who, what) in enumerate(centres):
            new_centre[offset[who] + k] = what
        begin = np.repeat(start[split], made) + np.cumsum(amount) - amount - np.repeat((np.cumsum(amount) - amount)[offset], made)
        total = sum(len(x) for x in levels)
        levels[-1]["child"][split], levels[-1]["children"][split] = total + offset, made
        start, end, centre = begin, begin + amount, new_centre
    nodes = np.concatenate(levels)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    nodes["centre"] = where[nodes["centre"]]
    return order, nodes


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each point, sums and counts of each entry, points that went with a whole subtree).

    Entries are whole numbers; of equally near ones the first takes the point.
    """
    sums, counts = tree.sums()
    of = np.zeros(len(tree.points), np.int64)
    total, amount, whole = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64), 0
    different, first = np.unique(entries, axis=0, return_index=True)
    keep = np.sort(first)  # of equal entries the first alone can be taken
    live = entries[keep]
    front = np.array([0]) if len(tree.points) else np.array([], np.int64)
    while len(front):
        node = tree.node[front]
        d = np.sqrt(_squared(tree.points[node["centre"]][:, None, :], live[None]).astype(np.float64))
        best = d.argmin(1)
        near = d[np.arange(len(d)), best]
        d[np.arange(len(d)), best] = np.inf
        # every point is within radius of the centre; the margin is far above the rounding of the roots
        sure = d.min(1) - near > 2 * node["radius"] + 1e-9 * (near + node["radius"] + 1)
        done, entry = node[sure], keep[best[sure]]
        np.add.at(total, entry, sums[done["end"]] - sums[done["start"]])
        np.add.at(amount, entry, counts[done["end"]] - counts[done["start"]])
        size = done["end"] - done["start"]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        of[np.repeat(done["start"], size) + within] = np.repeat(entry, size)
        whole += int(size[size > 1].sum())
        open_ = node[~sure]
        leaves, inner = open_[open_["children"] == 0], open_[open_["children"] > 0]
        size = leaves["end"] - leaves["start"]
        at = np.repeat(leaves["start"], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        if len(at):
            exact = keep[_squared(tree.points[at][:, None, :], live[None]).argmin(1)]
            of[at] = exact
            np.add.at(total, exact, tree.points[at] * tree.count[at][:, None])
            np.add.at(amount, exact, tree.count[at])
        many = inner["children"].astype(np.int64)
        front = np.repeat(inner["child"].astype(np.int64), many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return of, total, amount, whole


def _largest(dim: int) -> int:
    """Components beyond this could make a vector's squared distances exceed a long."""
    return int((2**61 / max(dim, 1)) ** 0.5)


def whole_numbers(vectors: DataFrame, scale: int = 256) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that can be coded, v whole numbers, and the vectors' length.

    Null vectors, vectors with a null or non-finite component and vectors whose length isn't that of the smallest kept vec_id's are
    dropped, as are those with a component so large that a squared distance could exceed a long.
    """
    cols = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v")]
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(*cols).where(F.col("v").isNotNull() & finite & (F.size("v") > 0))
    first = rows.select("vec_id", F.size("v").alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").first()
    if first is None:
        return rows.select("vec_id", "label", F.lit(None).cast("array<long>").alias("v")).where("false"), 0
    dim = first["n"]
    most = float(_largest(dim))
    fits = F.forall("v", lambda x: F.abs(x * scale) < most)
    return rows.where((F.size("v") == dim) & fits).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest of four integer types that holds x."""
    for t in (np.int8, np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max):
            return x.astype(t)
    return x


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one dimension in one piece of bytes, each in the smallest type it fits."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = _narrow(np.ascontiguousarray(a))
        out += [np.array([a.itemsize, a.size], np.int64).tobytes(), a.tobytes()]
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    at, out = 8, []
    for _ in range(int(np.frombuffer(data, np.int64, 1)[0])):
        item, size = np.frombuffer(data, np.int64, 2, at).tolist()
        out.append(np.frombuffer(data, f"<i{item}", size, at + 16).astype(np.int64))
        at += 16 + item * size
    return out


def trees(rows: DataFrame, dim: int, parts: int, block: int = BLOCK) -> DataFrame:
    """One row a block: its ids and labels, and for each part the distinct points, each vector's point, nodes and counts."""
    width = -(-dim // parts)

    def of(v: np.ndarray, ids: list, labels: list) -> pa.RecordBatch:
        padded = np.zeros((len(v), width * parts), np.int64)
        padded[:, :dim] = v
        points, orders, nodes, counts = [], [], [], []
        for p in range(parts):
            own, inverse, count = np.unique(padded[:, p * width : (p + 1) * width], axis=0, return_inverse=True, return_counts=True)
            order, node = cover_tree(own)
            where = np.empty(len(own), np.int64)
            where[order] = np.arange(len(own))
            points.append(own[order].ravel())
            orders.append(where[inverse.ravel()])
            counts.append(count[order])
            nodes.append(node.tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int32())), pa.array([_packed(points)]), pa.array([_packed(orders)]), pa.array([nodes], pa.list_(pa.binary())), pa.array([_packed(counts)])],
            ["vec_ids", "labels", "points", "orders", "nodes", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, labels, n = [], [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                some = batch.slice(lo, block)
                if n + some.num_rows > block:
                    yield of(np.concatenate(held), ids, labels)
                    held, ids, labels, n = [], [], [], 0
                held.append(_matrix(some.column(2), dim))
                ids += some.column(0).to_pylist()
                labels += some.column(1).to_pylist()
                n += some.num_rows
        if n:
            yield of(np.concatenate(held), ids, labels)

    return rows.mapInArrow(run, "vec_ids array<long>, labels array<int>, points binary, orders binary, nodes array<binary>, counts binary")


def _trees_of(points: list[np.ndarray], nodes: list[bytes], counts: list[np.ndarray], width: int) -> list[Tree]:
    return [Tree(p.reshape(-1, width), c, np.frombuffer(n, _NODE)) for p, n, c in zip(points, nodes, counts, strict=True)]


def start_entries(rows: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest vec_ids, ascending; of rows that repeat an id, the least vector."""
    width = -(-dim // parts)
    least = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()  # a codebook's entries
    if not least:  # no ids at all: the least vectors
        least = rows.select("v").distinct().orderBy("v").limit(entries).collect()
    v = np.zeros((len(least), width * parts), np.int64)
    for k, r in enumerate(least):
        v[k, :dim] = r["v"]
    return v.reshape(len(least), parts, width).transpose(1, 0, 2).copy()


def lloyd_round(built: DataFrame, books: np.ndarray) -> np.ndarray:
    """Books whose entries are the floored means of what the trees give them; an entry without any stays."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, amount = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for points, nodes, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for p, tree in enumerate(_trees_of(_unpacked(points), nodes, _unpacked(counts), width)):
                    _, t, a, _ = assign(tree, books[p])
                    total[p] += t
                    amount[p] += a
        part, entry = np.nonzero(amount)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * width + 1, width), pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(amount[part, entry]), sums], ["part", "entry", "n", "sums"])

    summed = built.select("points", "nodes", "counts").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    sums = summed.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    out = books.copy()
    for r in sums.collect():  # a row for each entry of each part
        out[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return out


def coded(built: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector in the trees."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{k:0{digits}x}" for k in range(entries)])
        for batch in batches:
            for ids, labels, points, orders, nodes, counts in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                error, code = np.zeros(len(ids), np.int64), np.empty((len(ids), parts), names.dtype)
                for p, (tree, own) in enumerate(zip(_trees_of(_unpacked(points), nodes, _unpacked(counts), width), _unpacked(orders), strict=True)):
                    of = assign(tree, books[p])[0]
                    error += _squared(tree.points, books[p][of])[own]
                    code[:, p] = names[of][own]
                text = ["".join(r) for r in code.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    return built.select("vec_ids", "labels", "points", "orders", "nodes", "counts").mapInArrow(run, "vec_id long, label int, code string, error long")


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and place, in decimal, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that can be coded (see whole_numbers).

    Vectors whose length isn't a multiple of parts are filled up with zeros.  Fewer ids than entries make smaller codebooks; rows that repeat an
    id are coded each; rows without vec_id are coded but start no entry, unless no row has one.  Null labels are one
    label.  An empty table gives no rows; further columns are left out.

    Vectors are read twice, once for the first entries; trees are written once, three integers or so for each
    number of the input.  Each round shuffles one row for each entry and task, and the driver holds the codebooks alone.
    """
    spark = vectors.sparkSession
    folder = workspace(spark)
    rows, dim = whole_numbers(vectors)
    if not dim:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = start_entries(rows, dim, parts, entries)
    built = written(trees(rows, dim, parts), folder, "trees")
    for _ in range(rounds):
        books = lloyd_round(built, books)
    out = written(coded(built, books), folder, "codes")
    labels = out.groupBy("label").agg(F.sum("error").alias("label_error"))
    labels = written(labels, folder, "labels").withColumnRenamed("label", "_label")
    joined = out.join(broadcast_if_small(labels, 32), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))
