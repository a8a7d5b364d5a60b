"""Even shards by balanced label propagation over links between documents.

Documents with the same link key are linked. Linked documents start in shards by a hash order, evenly; then in
rounds those of a key move to the shard where most of its documents already are. Quotas hold in every round: a shard takes
in what it has room for and what it gives away in the same round, so full shards exchange documents. How many may move
between each two shards is worked out on the driver from the counts of wanted moves, at most two numbers per pair of
shards; which documents move is decided by joins. Rounds work on cells ``(key, shard, documents)``, so a key with a
third of all rows is at most one row per shard. Documents without links fill what the quotas leave.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ordinals
from ..session import materialise, scratch

SHARDS = 40
OVERHEAD = 16


def text_key(text: Column) -> Column:
    """Half of the text's SHA-256: equal for equal texts only; null for a null text, which links to nothing."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _quotas(spark, rows: int, shards: int) -> DataFrame:
    sizes = [(s, rows // shards + (1 if s < rows % shards else 0)) for s in range(shards)]
    return spark.createDataFrame(sizes, "shard int, quota long")


def allot(count: int, room: list[int]) -> list[int]:
    """``count`` documents spread over the shards in proportion to their room."""
    whole = max(sum(room), 1)
    shares = [count * r // whole for r in room]
    for s in sorted(range(len(room)), key=lambda s: (shares[s] - room[s], s)):
        extra = min(count - sum(shares), room[s] - shares[s], 1)
        shares[s] += max(extra, 0)
    return shares


Counts = dict[tuple[int, int], int]


class Exchange:
    """How many of the wanted moves shards can make at once without passing their quotas.

    ``wants`` has the documents that want from one shard to another; ``ties`` (smaller shard first) those that may
    go either way, as either end has one document of their key. Opposite moves cancel first, then moves around
    cycles of shards, then moves into free room; ``go`` has the moves granted to ``wants``, ``swap`` those granted
    to ``ties`` by direction.
    """

    def __init__(self, wants: Counts, ties: Counts, room: list[int]) -> None:
        self.wants, self.ties, self.room = dict(wants), dict(ties), list(room)
        self.go: Counts = {}
        self.swap: Counts = {}
        for a, b in {(min(p), max(p)) for p in (*wants, *ties)}:
            there, back, tie = self.wants.get((a, b), 0), self.wants.get((b, a), 0), self.ties.get((a, b), 0)
            both = min(there + tie, back + tie, (there + back + tie) // 2)
            self._push(a, b, both)
            self._push(b, a, both)
        while cycle := self._cycle():
            steps = list(zip(cycle, [*cycle[1:], cycle[0]]))
            units = min(self._left(a, b) for a, b in steps)
            for a, b in steps:
                self._push(a, b, units)
        moved = True
        while moved:  # no cycle is left, so room cannot wander for ever
            moved = False
            for a, b in sorted({*self.wants, *self.ties, *((b, a) for a, b in self.ties)}):
                units = min(self._left(a, b), self.room[b])
                if units:
                    self._push(a, b, units)
                    self.room[a] += units
                    self.room[b] -= units
                    moved = True

    def _left(self, a: int, b: int) -> int:
        return self.wants.get((a, b), 0) + self.ties.get((min(a, b), max(a, b)), 0)

    def _push(self, a: int, b: int, units: int) -> None:
        sure = min(units, self.wants.get((a, b), 0))
        for left, granted, pair, n in (
            (self.wants, self.go, (a, b), sure),
            (self.ties, self.swap, (min(a, b), max(a, b)), units - sure),
        ):
            if n:
                left[pair] -= n
                granted[(a, b)] = granted.get((a, b), 0) + n

    def _cycle(self) -> list[int] | None:
        """Shards along a cycle of moves that are left; a single tie is not walked back at once."""
        done: set[int] = set()
        shards = range(len(self.room))
        for start in shards:
            if start in done:
                continue
            path, options = [start], [iter(shards)]
            while path:
                here = path[-1]
                before = path[-2] if len(path) > 1 else None
                step = next((t for t in options[-1] if t not in (here, before) and t not in done and self._left(here, t)), None)
                if step is None:
                    done.add(path.pop())
                    options.pop()
                elif step in path:
                    return path[path.index(step):]
                else:
                    path.append(step)
                    options.append(iter(shards))
        return None


def _running(moves: DataFrame) -> DataFrame:
    """Documents ahead of each move in its own direction: large moves first, then by hash.

    Sums of hash buckets give each bucket its offset; only a bucket's own moves are then walked in order.
    """
    way = ["shard", "to", "tie"]
    split = moves.withColumn("level", -F.floor(F.log2("n"))).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(256)))
    sums = split.groupBy(*way, "level", "bucket").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy(*way).orderBy("level", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*way, "level", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*way, "level", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    local = split.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(offsets, [*way, "level", "bucket"]).withColumn("ahead", F.col("offset") + F.col("local"))


def _wanted(cells: DataFrame, step: int, opened: list[int] | None) -> DataFrame:
    """``(key, shard, to, n, tie)``: every cell's wish to join the largest of its key (of those in ``opened``).

    Of equally large cells a hash that changes with the round chooses. A key of two documents apart may go either way.
    """
    targets = cells if opened is None else cells.filter(F.col("shard").isin(opened))
    largest = F.max(F.struct("n", F.xxhash64("key", "shard", F.lit(step)).alias("draw"), "shard")).alias("best")
    best = targets.groupBy("key").agg(largest, F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts"))
    best = best.select("key", F.col("best.shard").alias("to"), F.col("best.n").alias("most"), "members", "parts")
    tie = (F.col("members") == 2) & (F.col("parts") == 2)
    moves = cells.join(best, "key").filter("shard <> to and n <= most").withColumn("tie", tie)
    low, high = F.least("shard", "to"), F.greatest("shard", "to")
    return moves.select("key", F.when(tie, low).otherwise(F.col("shard")).alias("shard"), F.when(tie, high).otherwise(F.col("to")).alias("to"), "n", "tie")


def propagate(cells: DataFrame, room: list[int]) -> tuple[DataFrame, list[int], int]:
    """Move documents towards their key's largest shard until no move is left that quotas admit.

    ``cells`` has ``key, shard, n``; ``room`` is what each shard can still take. Returns the cells, the room
    left and the number of documents moved. A round first wants the largest cells anywhere; if that
    allows no move, the largest in shards with room. Only cells no larger than their target move, so every round raises
    the sum of squared cells, hence the loop ends. Where no row is without links and all shards are full, keys stay
    cut that no exchange of documents one for one would complete.
    """
    spark, step, total, open_only = cells.sparkSession, 0, 0, False
    with scratch() as scope:
        while True:
            step += 1
            opened = [s for s, r in enumerate(room) if r > 0] if open_only else None
            moves = materialise(_wanted(cells, step, opened), "moves")
            counts = moves.groupBy("shard", "to", "tie").agg(F.sum("n").alias("n")).collect()
            plan = Exchange(
                {(r.shard, r.to): r.n for r in counts if not r.tie}, {(r.shard, r.to): r.n for r in counts if r.tie}, room
            )
            granted = sum(plan.go.values()) + sum(plan.swap.values())
            if not granted and (open_only or not counts):
                scope.drop(moves)
                return scope.keep(cells, "cells"), room, total
            open_only = not granted
            if not granted:
                scope.drop(moves)
                continue
            limits = [(a, b, False, n, 0) for (a, b), n in plan.go.items()]
            pairs = {(min(p), max(p)) for p in plan.swap}
            limits += [(a, b, True, plan.swap.get((a, b), 0), plan.swap.get((b, a), 0)) for a, b in pairs]
            limits = spark.createDataFrame(limits, "shard int, to int, tie boolean, there long, back long")
            ranked = _running(moves).join(F.broadcast(limits), ["shard", "to", "tie"])
            reverse = F.col("tie") & (F.col("ahead") >= F.col("there"))
            taken = F.when(reverse, F.least("n", F.col("there") + F.col("back") - F.col("ahead"))).otherwise(F.least("n", F.col("there") - F.col("ahead")))
            source, to = F.when(reverse, F.col("to")).otherwise(F.col("shard")), F.when(reverse, F.col("shard")).otherwise(F.col("to"))
            made = ranked.select("key", source.alias("shard"), to.alias("to"), taken.alias("n")).filter("n > 0")
            change = made.select("key", F.inline(F.array(
                F.struct("shard", (-F.col("n")).alias("n")), F.struct(F.col("to").alias("shard"), "n")
            )))
            new = cells.unionByName(change).groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
            new = materialise(new, "cells")
            scope.drop(moves, cells)
            cells, room, total = new, plan.room, total + granted


def _start(members: DataFrame, shares: list[int]) -> DataFrame:
    """First cells: documents in a hash order, ``shares`` of them for each shard."""
    ends = list(accumulate(shares))
    spans = [(s, e - n, e) for s, (n, e) in enumerate(zip(shares, ends)) if n]
    spans = members.sparkSession.createDataFrame(spans, "shard int, after long, last long")
    ranked = ordinals(members.select("row", "key", F.lit(0).alias("all")), ["all"], [], "row", name="rank")
    inside = (F.col("rank") > F.col("after")) & (F.col("rank") <= F.col("last"))
    return ranked.join(F.broadcast(spans), inside).groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))


def place_linked(members: DataFrame, quotas: list[int]) -> tuple[DataFrame, list[int], int]:
    """``(key, shard, n)`` for all linked documents, the room left, and how many documents moved.

    ``members`` has ``row, key, members``. Keys larger than a quota are placed first, then those above an eighth of
    one, then the rest, each kind by its own start and propagation; later kinds and unlinked rows are the room of the earlier.
    """
    quota = max(quotas)
    kind = F.when(F.col("members") > quota, 0).when(F.col("members") * 8 > quota, 1).otherwise(2)
    members = members.withColumn("kind", kind)
    counts = {r.kind: r.n for r in members.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    room, moved, parts = list(quotas), 0, []
    for k in sorted(counts):
        shares = allot(counts[k], room)
        cells = materialise(_start(members.filter(F.col("kind") == k), shares), "cells")
        cells, room, n = propagate(cells, [r - s for r, s in zip(room, shares)])
        parts.append(cells)
        moved += n
    if not parts:
        return members.sparkSession.createDataFrame([], "key binary, shard int, n long"), room, 0
    return reduce(DataFrame.unionByName, parts), room, moved


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None
) -> DataFrame:
    """``(id, size, text_crc32, key, shard, slot)`` per row of ``docs``.

    Row counts of any two shards differ by one at most. ``link`` is the link key (null: no links), the
    text by default, so equal texts stay together wherever a shard can hold them. ``size`` is the bytes of the text (null: none) plus 16,
    ``slot`` numbers the rows of a shard from 0. Repeated rows and null ids take a slot each; an empty
    table gives an empty result. Texts are read once and never moved.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        (text_key(text) if link is None else text_key(link.cast("string"))).alias("key"),
        F.monotonically_increasing_id().cast("string").alias("row"),
    )
    rows = materialise(rows, "rows")
    quotas = materialise(_quotas(spark, rows.count(), shards), "quotas")
    groups = rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    groups = materialise(groups, "groups")
    members = materialise(rows.select("row", "key").join(groups, "key"), "members")
    cells, _, _ = place_linked(members, [r.quota for r in quotas.orderBy("shard").collect()])

    ends = Window.partitionBy("key").orderBy("shard")
    ranges = cells.select("key", "shard", F.sum("n").over(ends).alias("last"), "n")
    ranked = ordinals(members, ["key"], [], "row", name="rank").alias("m")
    inside = (F.col("m.key") == F.col("c.key")) & F.col("rank").between(F.col("last") - F.col("n") + 1, F.col("last"))
    linked = ranked.join(ranges.alias("c"), inside).select("row", "shard")

    loads = cells.groupBy("shard").agg(F.sum("n").alias("load"))
    free = quotas.join(loads, "shard", "left").select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("free"))
    upto = free.select("shard", "free", F.sum("free").over(Window.partitionBy(F.lit(0)).orderBy("shard")).alias("last"))
    single = rows.select("row", F.lit(0).alias("all")).join(members.select("row"), "row", "left_anti")
    single = ordinals(single, ["all"], [], "row", name="rank")
    filled = single.join(F.broadcast(upto), F.col("rank").between(F.col("last") - F.col("free") + 1, F.col("last"))).select("row", "shard")

    placed = ordinals(materialise(linked.union(filled), "placed"), ["shard"], [], "row", name="slot")
    return rows.join(placed.select("row", "shard", (F.col("slot") - 1).alias("slot")), "row").drop("row")
