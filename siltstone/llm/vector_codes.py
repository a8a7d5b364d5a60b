"""Vector codes per part, trained exactly with metric trees from the anchors hierarchy.

Vectors are cut into parts, and each part has its own codebook. Rows are packed into blocks; in every block
each part gets a metric tree, built once and stored: anchors take the points nearest to them until there is
about one per square root of the points, each anchor's points become a subtree in the same way, and above
the anchors the balls that fit together best are merged, so the tree grows from its middle outwards. A ball
caches the sum and the count of its points. A round sends the codebooks (a fixed number of entries) down
all trees: a ball inherits the entries its parent left open, drops those that are farther than another for
every point it can hold, and once one entry is left it is owned whole and gives its cached sum and count.
Open leaves compare their points with the entries left. Sums meet in Spark, so any number of blocks works.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ranks import split_by_match
from ..session import materialise, scratch
from .common import small_batches

SCALE = 1024
#: Largest size of a component after scaling; squared distances then fit 64 bits for parts of up to 2,048 components.
LIMIT = 1 << 25
BLOCK = 4096
LEAF = 64
Codebooks = list[np.ndarray]


@dataclass
class Tree:
    """Balls of one part of one block. Node 0 is the root; a leaf has no children (-1).

    ``order`` lists points ball by ball: a ball holds ``order[start:stop]``.
    """

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray


class _Grower:
    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.points, self.exact, self.leaf = points.astype(float), points, leaf
        self.nodes: list[tuple] = []

    def grow(self, members: np.ndarray) -> tuple:
        """A nested ball ``(members, left, right)``."""
        if len(members) > self.leaf:
            groups = self._anchors(members)
            if len(groups) > 1:
                return self._merge([self.grow(g) for g in groups])
        return members, None, None

    def _anchors(self, members: np.ndarray) -> list[np.ndarray]:
        """Points by nearest anchor; a new anchor is the point farthest from its own, of the widest ball."""
        points = self.points[members]
        anchors, owner = [0], np.zeros(len(members), int)
        far = np.linalg.norm(points - points[0], axis=1)
        for _ in range(int(len(members) ** 0.5)):
            new = int(far.argmax())
            if far[new] == 0:
                break
            between = np.linalg.norm(points[anchors] - points[new], axis=1)
            near = np.flatnonzero(far > between[owner] / 2)  # others cannot be nearer to the new anchor
            mine = np.linalg.norm(points[near] - points[new], axis=1)
            taken = mine < far[near]
            owner[near[taken]], far[near[taken]] = len(anchors), mine[taken]
            anchors.append(new)
        return [members[owner == i] for i in range(len(anchors)) if (owner == i).any()]

    def _merge(self, balls: list[tuple]) -> tuple:
        """Pairs whose common ball is smallest first."""
        centre = np.array([self.points[b[0]].mean(axis=0) for b in balls])
        radius = np.array([np.linalg.norm(self.points[b[0]] - c, axis=1).max() for b, c in zip(balls, centre)])
        apart = np.linalg.norm(centre[:, None] - centre[None], axis=2)
        while len(balls) > 1:
            size = np.maximum((apart + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
            np.fill_diagonal(size, np.inf)
            i, j = sorted(divmod(int(size.argmin()), len(balls)))
            members = np.concatenate([balls[i][0], balls[j][0]])
            balls[i] = (members, balls[i], balls.pop(j))
            centre[i] = self.points[members].mean(axis=0)
            radius[i] = np.linalg.norm(self.points[members] - centre[i], axis=1).max()
            centre, radius = np.delete(centre, j, axis=0), np.delete(radius, j)
            apart = np.delete(np.delete(apart, j, axis=0), j, axis=1)
            apart[i] = apart[:, i] = np.linalg.norm(centre - centre[i], axis=1)
        return balls[0]

    def tree(self) -> Tree:
        order, rows = [], []

        def place(ball: tuple) -> int:
            at, start = len(rows), sum(map(len, order))
            rows.append(None)
            members, left, right = ball
            if left is None:
                order.append(members)
                children = (-1, -1)
            else:
                children = (place(left), place(right))
            inside = self.points[members]
            pivot = inside.mean(axis=0)
            radius = np.linalg.norm(inside - pivot, axis=1).max()
            rows[at] = (start, start + len(members), *children, pivot, radius, self.exact[members].sum(axis=0))
            return at

        place(self.grow(np.arange(len(self.points))))
        start, stop, left, right, pivot, radius, total = map(np.array, zip(*rows))
        return Tree(np.concatenate(order), start, stop, left, right, pivot, radius, total)


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over integer ``points`` (rows)."""
    return _Grower(points, leaf).tree()


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equals) and the squared distance, exactly."""
    reach = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    exact = 4 * int(reach) ** 2 * points.shape[1] < 1 << 53  # whole numbers below 2**53 are exact as floating point
    kind = np.float64 if exact else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    apart = (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None]
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(points)), best].astype(np.int64)


def owners(tree: Tree, points: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(ball, entries, of)``: an owned ball with its one entry, or an open leaf with the entry of each point."""
    _, first = np.unique(entries, axis=0, return_index=True)  # equal entries: only the lowest can win
    places = entries.astype(float)
    stack = [(0, np.sort(first))]
    while stack:
        ball, open_ = stack.pop()
        gap = ((places[open_] - tree.pivot[ball]) ** 2).sum(axis=1)
        best = int(gap.argmin())
        away = np.linalg.norm(places[open_] - places[open_[best]], axis=1)
        slack = 1e-9 * (gap + tree.radius[ball] ** 2 + 1)  # rounding never drops an entry that could win or tie
        left = open_[gap - gap[best] <= 2 * tree.radius[ball] * away + slack]
        if len(left) == 1:
            yield ball, left, np.zeros(tree.stop[ball] - tree.start[ball], int)
        elif tree.left[ball] < 0:
            of, _ = nearest(points[tree.order[tree.start[ball] : tree.stop[ball]]], entries[left])
            yield ball, left, of
        else:
            stack += [(tree.left[ball], left), (tree.right[ball], left)]


def part_sums(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points of every entry; balls with one owner give what they cache."""
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    for ball, left, of in owners(tree, points, entries):
        if len(left) == 1:
            counts[left[0]] += tree.stop[ball] - tree.start[ball]
            sums[left[0]] += tree.total[ball]
        else:
            np.add.at(counts, left[of], 1)
            np.add.at(sums, left[of], points[tree.order[tree.start[ball] : tree.stop[ball]]])
    return counts, sums


def part_codes(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point."""
    codes = np.zeros(len(points), np.int64)
    for ball, left, of in owners(tree, points, entries):
        codes[tree.order[tree.start[ball] : tree.stop[ball]]] = left[of]
    return codes, ((points - entries[codes]) ** 2).sum(axis=1)


# ------------------------------------------------------------------ blocks

_FIELDS = list(Tree.__dataclass_fields__)
_TREE = "struct<" + ",".join(f"{name}:binary" for name in _FIELDS) + ">"
_SHAPED = {"pivot": np.float64, "radius": np.float64}


def _blocks(rows: DataFrame, parts: int, dim: int) -> DataFrame:
    """Rows ``ids, labels, points, trees``: up to ``BLOCK`` vectors end to end and a tree for each part."""
    types = [rows.schema["id"].dataType, rows.schema["label"].dataType]
    arrow = [pa.list_(to_arrow_type(t)) for t in types]
    tree_type = pa.struct([(name, pa.binary()) for name in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _full(batches):
            points = batch.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            trees = []
            for part in np.split(points, parts, axis=1):
                tree = build_tree(part)
                trees.append({k: np.ascontiguousarray(v, _SHAPED.get(k, np.int64)).tobytes() for k, v in vars(tree).items()})
            columns = [pa.array([batch.column(i).to_pylist()], t) for i, t in enumerate(arrow)]
            columns += [pa.array([points.tobytes()], pa.binary()), pa.array([trees], pa.list_(tree_type))]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "points", "trees"])

    schema = f"ids array<{types[0].simpleString()}>, labels array<{types[1].simpleString()}>, points binary, trees array<{_TREE}>"
    return rows.select("id", "label", "whole").mapInArrow(run, schema)


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The task's rows in tables of ``BLOCK`` rows and a last smaller one."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        while sum(b.num_rows for b in waiting) >= BLOCK:
            table = pa.Table.from_batches(waiting)
            yield table.slice(0, BLOCK)
            waiting = table.slice(BLOCK).to_batches()
    if sum(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting)


def _read(batches: Iterator[pa.RecordBatch], parts: int, dim: int) -> Iterator[tuple[list, list, list[tuple[Tree, np.ndarray]]]]:
    for batch in batches:
        for ids, labels, data, trees in zip(*[c.to_pylist() for c in batch.columns]):
            points = np.split(np.frombuffer(data, np.int64).reshape(-1, dim), parts, axis=1)
            grown = []
            for stored in trees:
                fields = {k: np.frombuffer(v, _SHAPED.get(k, np.int64)) for k, v in stored.items()}
                fields["pivot"] = fields["pivot"].reshape(-1, dim // parts)
                fields["total"] = fields["total"].reshape(-1, dim // parts)
                grown.append(Tree(**fields))
            yield ids, labels, list(zip(grown, points))


def _round(blocks: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """Codebooks after one assignment of all points: floored means, unused entries as they were."""
    parts, width = len(books), dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in books]
        for _, _, grown in _read(batches, parts, dim):
            for (tree, points), book, (count, total) in zip(grown, books, sums):
                more, added = part_sums(tree, points, book)
                count += more
                total += added
        for part, (count, total) in enumerate(sums):
            used = np.flatnonzero(count)
            columns = [pa.array([part] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(count[used])]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(total[used, i]) for i in range(width)]], names=names)

    names = ["part", "entry", "n", *[f"x{i}" for i in range(width)]]
    found = blocks.mapInArrow(run, "part int, entry int, " + ", ".join(f"{c} long" for c in names[2:]))
    books = [b.copy() for b in books]
    for row in found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect():
        books[row.part][row.entry] = np.array(row[3:]) // row.n
    return books


def _coded(blocks: DataFrame, books: Codebooks, dim: int, types: list) -> DataFrame:
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, grown in _read(batches, parts, dim):
            found = [part_codes(tree, points, book) for (tree, points), book in zip(grown, books)]
            codes = ["".join(f"{c:02x}" for c in row) for row in zip(*[c.tolist() for c, _ in found])]
            error = sum(e for _, e in found)
            columns = [pa.array(ids, arrow[0]), pa.array(labels, arrow[1]), pa.array(codes), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    arrow = [to_arrow_type(t) for t in types]
    return blocks.mapInArrow(run, f"id {types[0].simpleString()}, label {types[1].simpleString()}, code string, error long")


def digest(books: Sequence[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` for every row whose vector is whole and finite.

    Components become ``floor(1024 * x)``. Codebooks start from the vectors of the ``entries`` smallest ids (null
    ids last, equal ids by components) and are trained by ``rounds`` of exact assignment (ties to the lower index)
    and floored means over all rows. ``code`` has two hex digits a part (``entries`` is 256 at most), ``error`` is the
    squared distance over all parts, ``label_error`` the sum over equal labels, nulls together. Null vectors and
    those with null, infinite or NaN components are dropped. The dimension is that of the smallest id;
    vectors of another length, and all if it cannot be cut into ``parts``, get a null code and error. Repeated
    rows count as often as they occur. Components beyond ``LIMIT`` after scaling are an error. An empty
    table gives an empty one.
    """
    small_batches(vectors.sparkSession)
    number = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), number.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("vector", lambda x: F.floor(x * SCALE).cast("long"))
    kept = rows.filter(F.col("vector").isNotNull() & finite)
    too_large = F.exists("vector", lambda x: F.abs(x) * SCALE >= LIMIT)
    checked = F.when(too_large, F.raise_error(F.lit(f"a component is beyond {LIMIT // SCALE}"))).otherwise(scaled)
    kept = kept.select("id", "label", checked.alias("whole"))
    with scratch() as scope:
        kept = materialise(kept, "vectors")
        seeds = kept.orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
        dim = len(seeds[0].whole) if seeds else 0
        usable = dim > 0 and dim % parts == 0
        alike = (F.size("whole") == dim) & F.lit(usable)
        types = [kept.schema["id"].dataType, kept.schema["label"].dataType]
        others = kept.filter(~alike).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        books: Codebooks = []
        coded = others
        if usable:
            first = np.array([s.whole for s in seeds if len(s.whole) == dim], np.int64)
            books = [np.ascontiguousarray(p) for p in np.split(first, parts, axis=1)]
            blocks = materialise(_blocks(kept.filter(alike), parts, dim), "trees")
            for _ in range(rounds):
                books = _round(blocks, books, dim)
            coded = _coded(blocks, books, dim, types).unionByName(others)
        key = [F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_key")]
        coded = materialise(coded.select("id", "code", "error", *key), "codes")
        labels = coded.groupBy("no_label", "label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
        met, _ = split_by_match(coded, materialise(labels, "labels"), ["no_label", "label_key"])
        return scope.keep(met.select("id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), "codes")
