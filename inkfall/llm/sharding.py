"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Every group of equal texts is packed, whatever its size. Groups of one size are alike to the packing, so the
driver packs runs (size, how many): a run fills the tightest bin that has room as far as that goes, then the next, and
gives exactly what packing its groups one by one gives. Distinct sizes are few: as they add up to no more than the total,
there are fewer than the root of twice the total. Each group then finds its bin by its rank among those of its size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkfall.llm.common import pick, table, written

SHARDS = 40
#: Rows of a key that are numbered together, and copies of a row that are written out at once.
TOGETHER, COPIES = 20_000, 65_536
#: Stretches of runs that are broadcast; more are joined by a shuffle.
TOLD = 200_000


@dataclass
class _Node:
    key: tuple
    left: "_Node | None" = None
    right: "_Node | None" = None
    height: int = 1


def _fixed(n: _Node) -> _Node:
    height = lambda x: x.height if x else 0

    def told(x):
        x.height = 1 + max(height(x.left), height(x.right))
        return x

    def right(x):
        y = x.left
        x.left, y.right = y.right, x
        told(x)
        return told(y)

    def left(x):
        y = x.right
        x.right, y.left = y.left, x
        told(x)
        return told(y)

    told(n)
    lean = height(n.left) - height(n.right)
    if lean > 1:
        if height(n.left.left) < height(n.left.right):
            n.left = left(n.left)
        return right(n)
    if lean < -1:
        if height(n.right.right) < height(n.right.left):
            n.right = right(n.right)
        return left(n)
    return n


def _insert(n: _Node | None, key: tuple) -> _Node:
    if n is None:
        return _Node(key)
    if key < n.key:
        n.left = _insert(n.left, key)
    else:
        n.right = _insert(n.right, key)
    return _fixed(n)


def _delete(n: _Node | None, key: tuple) -> _Node | None:
    if n is None:
        return None
    if key < n.key:
        n.left = _delete(n.left, key)
    elif key > n.key:
        n.right = _delete(n.right, key)
    elif n.left is None or n.right is None:
        return n.left or n.right
    else:
        low = n.right
        while low.left:
            low = low.left
        n.key = low.key
        n.right = _delete(n.right, low.key)
    return _fixed(n)


def _at_least(n: _Node | None, size: int) -> tuple | None:
    """The least key (room, bin) whose room is enough."""
    found = None
    while n:
        if n.key[0] >= size:
            found, n = n.key, n.left
        else:
            n = n.right
    return found


def pack_runs(runs: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]]:
    """(size, from, to, bin) of runs (size, how many): the largest first, each item into the bin whose remaining room is tightest.

    Without bins, a new one opens where none has room (an item over the capacity gets one of its own).
    With a fixed number, an item that fits nowhere goes to the bin with most room. The tightest bin stays the tightest
    while items of one size go into it, so it takes as many as fit at once.
    """
    opened = bins or 0
    tree = None
    for b in range(opened):
        tree = _insert(tree, (capacity, b))
    out = []
    for size, count in sorted(runs, reverse=True):
        at = 0
        while at < count:
            found = _at_least(tree, size)
            if found is None and bins is None:
                found = (capacity, opened)
                opened += 1
            else:
                if found is None:
                    n = tree
                    while n:
                        found, n = n.key, n.right
                tree = _delete(tree, found)
            room, b = found
            take = min(count - at, max(1, room // size)) if size else count - at
            out.append((size, at, at + take, b))
            tree = _insert(tree, (room - take * size, b))
            at += take
    return out


def best_fit_decreasing(items: list[tuple], capacity: int, bins: int | None = None) -> dict:
    """{item: bin} of (size, item); items of one size in their own order."""
    by_size: dict[int, list] = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        by_size.setdefault(size, []).append(item)
    stretches = pack_runs([(size, len(found)) for size, found in by_size.items()], capacity, bins)
    return {item: b for size, lo, hi, b in stretches for item in by_size[size][lo:hi]}


def before(rows: DataFrame, key: str, mark: Column, order: list[str], weight: Column) -> DataFrame:
    """Adds `before`: the weight of the rows that stand before a row of the same key.

    A key's rows are dealt into blocks by a hash of the mark, so that no task holds a whole key: sums per (key, block)
    give each block's offset, rows are then summed up within their block in the given order.
    """
    blocks = max(1, -(-rows.count() // TOGETHER))
    rows = rows.withColumns({"weight": weight.cast("long"), "block": F.pmod(mark, F.lit(blocks)).cast("int")})
    sums = rows.groupBy(key, "block").agg(F.sum("weight").alias("n"))
    offsets = sums.select(F.col(key).alias("k"), F.col("block").alias("b"), (F.sum("n").over(Window.partitionBy(key).orderBy("block")) - F.col("n")).alias("offset"))
    inside = F.sum("weight").over(Window.partitionBy(key, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    rows = rows.withColumn("inside", inside).join(offsets, (F.col(key) == F.col("k")) & (F.col("block") == F.col("b")))
    return rows.withColumn("before", F.col("offset") + F.col("inside")).drop("k", "b", "offset", "inside", "block", "weight")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; law is `bytes`.

    Size: UTF-8 bytes of the text, none for null, plus 16. Equal texts (null and empty ones together) form
    a group that stays in one shard; repeated rows are members like others. A group larger than a shard's
    share fills a shard alone as far as that goes. Slots number a shard's rows from 0 without gaps. Columns
    with clashing names are no matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
    )
    # rows alike in all that is returned are counted, and written out again at the end
    rows = written(rows.groupBy("g1", "g2", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "rows")
    groups = written(rows.groupBy("g1", "g2").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), "groups")
    # fewer rows than the root of twice the total
    runs = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    sizes, counts = runs["bytes"].to_pylist(), runs["n"].to_pylist()
    total = sum(b * n for b, n in zip(sizes, counts, strict=True))
    stretches = pack_runs(list(zip(sizes, counts, strict=True)), max(1, math.ceil(total / shards)), shards)
    told = pa.table({c: pa.array([x[i] for x in stretches], pa.int64()) for i, c in enumerate(("of", "lo", "hi", "shard"))})
    told = spark.createDataFrame(told)
    ranked = before(groups, "bytes", F.xxhash64(F.lit(7), "g1"), ["g1", "g2"], F.lit(1))
    placed = ranked.join(F.broadcast(told) if len(stretches) <= TOLD else told, (F.col("bytes") == F.col("of")) & (F.col("before") >= F.col("lo")) & (F.col("before") < F.col("hi")))
    placed = placed.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("shard").cast("int").alias("shard"))
    rows = written(rows.join(placed, (F.col("g1") == F.col("p1")) & (F.col("g2") == F.col("p2"))).drop("p1", "p2"), "placed")
    out = before(rows, "shard", F.xxhash64(F.lit(9), "doc_id", "g1"), ["doc_id", "g1", "g2"], F.col("copies"))
    # a row with many copies is written out some at a time
    out = out.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    out = out.withColumn("again", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + COPIES, F.col("copies")) - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("again")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op4_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
