"""Near-duplicate documents by BagMinHash.

A document is the multiset of its shingles of five lower-cased words. Weights are discretised at whole
numbers and split into the dyadic intervals [0,1), [1,2), [2,4), ...; a Poisson process over each interval
gives, per shingle, the same points to every document that holds it, marked with a place in the interval and
a component of the signature. A document accepts the points below its weight, in ascending order and only
until no component can improve. Two documents agree in a component with the probability of their weighted
Jaccard similarity.

Bands of the signature propose, verification on the multisets decides:

1. Documents with equal multisets collapse to one representative.
2. In each bucket of a band every member is held against the bucket's least member.
3. Where members of a bucket still are in different components, all its pairs across components are
   verified in blocks, so that no pair of a bucket is left out for its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkfall.llm.common import components, maybe_among, pick, place, plain, ship, table, written

WORDS, SIMILARITY = 5, 0.8
#: 25 bands of 5 components: a pair of similarity 0.8 meets in one with probability 0.99995.
BANDS, ROWS = 25, 5
#: Characters that are signed together, and members of a bucket that are compared together.
SLICE_CHARS, BLOCK = 1_000_000, 512
_U = np.uint64
_SPACES = np.zeros(0x3002, dtype=bool)
_SPACES[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), _U(base))
            steps[0] = _U(1)
            _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 48-bit shingle, count), sorted, of the distinct shingles of up to 65,536 texts.

    A text of one to four words is one shingle; one without words has none.
    """
    flat = np.frombuffer("".join((t or "").lower() + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len((t or "").lower()) + 1 for t in texts])
    space = _SPACES[np.minimum(flat, 0x3001)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[_U(0)], np.cumsum((flat.astype(np.uint64) + _U(1)) * _power(_BASE, len(flat)), dtype=np.uint64)])
        word = mix((total[hi] - total[lo]) * _power(_INVERSE, len(flat))[lo])
        owner = np.searchsorted(ends, lo, side="right")
        n = np.bincount(owner, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        # four empty words after each text, so that no shingle reaches into the next one
        spread = np.zeros(len(word) + WORDS * len(texts), dtype=np.uint64)
        at = np.arange(len(word)) + WORDS * owner
        spread[at] = word
        starts = at[np.arange(len(word)) - first[owner] < np.maximum(n - WORDS + 1, 1)[owner]]
        value = np.zeros(len(starts), dtype=np.uint64)
        for j in range(WORDS):
            value = value * _U(0xD6E8FEB86659FD93) + spread[np.minimum(starts + j, len(spread) - 1)]
        value = mix(value)
    holder = owner[np.searchsorted(at, starts)]
    keys = np.sort((holder.astype(np.uint64) << _U(48)) | (value >> _U(16)))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> _U(48)).astype(np.int64), keys & _U((1 << 48) - 1), count


def bagminhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n, m) signatures of weighted sets given as (owner, element, whole weight) rows; inf for an empty set."""
    if m > 4096:
        raise ValueError("a component is drawn by 12 bits")
    sets, elements, low, length, weights = [owner], [element], [np.zeros(len(owner))], [np.ones(len(owner))], [weight]
    i, width = 1, 1
    while len(weight) and (weight > width).any():  # the next interval, [width, 2 * width), for those that reach into it
        there = weight > width
        sets.append(owner[there]), elements.append(mix(element[there] + _U(i << 48)) >> _U(1)), weights.append(weight[there])
        low.append(np.full(there.sum(), float(width))), length.append(np.full(there.sum(), float(width)))
        i, width = i + 1, 2 * width
    owner, state, low, length, weight = map(np.concatenate, (sets, elements, low, length, weights))
    state, x = mix(state), np.zeros(len(owner))
    best = np.full((n, m), np.inf)
    flat = best.reshape(-1)
    while len(owner):
        state = mix(state)
        x = x - np.log(((state >> _U(24)).astype(np.float64) + 0.5) * 2.0**-40) / length
        component = (((state & _U(0xFFF)) * _U(m)) >> _U(12)).astype(np.int64)
        fits = low + np.floor((mix(state) >> _U(11)).astype(np.float64) * 2.0**-53 * length) < weight
        np.minimum.at(flat, (owner * m + component)[fits], x[fits])
        most = best.max(axis=1)
        going = x < most[owner]
        owner, state, low, length, weight, x = (a[going] for a in (owner, state, low, length, weight, x))
    return best


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, -1)
    key = np.zeros(bits.shape[:2], dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(bits.shape[2]):
        key = mix(key ^ bits[:, :, r])
    return key.view(np.int64)


def _slices(texts):
    lo = 0
    while lo < len(texts):
        some, n = [], 0
        while lo + len(some) < len(texts) and n < SLICE_CHARS and len(some) < 60_000:
            some.append(texts[lo + len(some)].as_py())
            n += len(some[-1] or "")
        yield lo, some
        lo += len(some)


def _signed(batches):
    for batch in batches:
        for lo, texts in _slices(batch.column(1)):
            owner, element, count = shingles(texts)
            signature = band_keys(bagminhash(owner, element, count, len(texts)))
            with np.errstate(over="ignore"):
                one, two = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
                np.add.at(one, owner, mix(element + _U(1 << 50)) * count.astype(np.uint64))
                np.add.at(two, owner, mix(element + _U(1 << 51)) * count.astype(np.uint64))
            some = np.bincount(owner, minlength=len(texts)) > 0
            keep = lambda a, kind: pa.array(a, kind, mask=~some)  # noqa: E731, B023
            flat = pa.array(np.ascontiguousarray(signature[some]).reshape(-1))
            ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, len(texts)), keep(one.view(np.int64), pa.int64()), keep(two.view(np.int64), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                names=["doc_id", "k1", "k2", "bands"],
            )


def _gathered(batches):
    """Of each document its multiset as distinct 32-bit values, one per shingle and occurrence."""
    for batch in batches:
        for lo, texts in _slices(batch.column(1)):
            owner, element, count = shingles(texts)
            again = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            with np.errstate(over="ignore"):
                value = (mix(np.repeat(element, count) + (again.astype(np.uint64) << _U(49))) >> _U(32)).astype(np.uint32).view(np.int32)
            n = np.bincount(np.repeat(owner, count), minlength=len(texts))
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(value))], names=["node", "bag"])


def overlaps(bags: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each two of the bags share: products of an incidence matrix, some columns at a time."""
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    _, value, count = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    some = count[value] > 1
    owner, value = owner[some], column[value[some]]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    out = np.zeros((len(bags), len(bags)), dtype=np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(value, [lo, lo + columns])
        part = np.zeros((len(bags), min(columns, int(column[-1]) + 1 - lo)), dtype=np.float32)
        part[owner[i:j], value[i:j] - lo] = 1
        out += part @ part.T
    return out


def tree_of(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(label, least label it hangs together with) over links between places of label."""
    names, at = np.unique(label, return_inverse=True)
    a, b, low = at[a], at[b], np.arange(len(names))
    while len(a):
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return [(int(names[i]), int(names[j])) for i, j in enumerate(low) if i != j]


def _crossed(similarity: float):
    """Links across components in a bucket's pair of blocks; rows come sorted by bucket and blocks."""

    def links(rows):
        """Pairs of labels that are linked: a tree over those that hang together, not every pair."""
        label = np.array([x[2] for x in rows])
        if (label == label[0]).all():
            return []
        block, bags = np.array([x[3] for x in rows]), [np.unique(x[4]) for x in rows]
        size = np.array([len(b) for b in bags])
        shared = overlaps(bags)
        near = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-6
        near &= label[:, None] != label[None, :]
        if rows[0][1][2] != rows[0][1][3]:
            near &= block[:, None] != block[None, :]
        return tree_of(label, *np.nonzero(np.triu(near)))

    def run(batches):
        held, last = [], None
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            found = []
            for k in range(batch.num_rows):
                key = tuple(cols[i][k].as_py() for i in range(4))
                if key != last and held:
                    found += links(held)
                    held = []
                last = key
                bag = cols[5][k].values.to_numpy()
                held.append((k, key, cols[4][k].as_py()["label"], cols[4][k].as_py()["block"], bag))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found = links(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id of every document; class_id is the least doc_id reachable over near-duplicate links.

    Equal texts are in one class. Texts without words, null and empty ones too, are alone, and so is a
    document that is like no other. Rows that share a doc_id are one document of several texts; a null
    doc_id has a null class. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = written(docs.mapInArrow(_signed, "doc_id long, k1 long, k2 long, bands array<long>"), "signed")
    known = signed.where("doc_id IS NOT NULL AND k1 IS NOT NULL")
    reps = written(known.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("k1", "k2", "x.*").withColumnRenamed("doc_id", "node"), "reps")
    rows = reps.select("node", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets, "buckets")
    members = written(rows.join(buckets.select(F.col("bucket").alias("b"), "lead", "n"), F.col("bucket") == F.col("b")).drop("b"), "members")
    pairs = written(members.where("node <> lead").select("node", "lead").distinct(), "pairs")
    nodes = members.select("node").distinct()
    # most documents meet no other; a filter of bounded size keeps their texts out of the shuffle
    there = docs.where(maybe_among(nodes, "node", F.col("doc_id"))).join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    bags = there.mapInArrow(_gathered, "node long, bag array<int>")
    # rows that share a doc_id have a bag each; one that shares no shingles is no harm to the others
    bags = written(bags, "bags")
    held = pairs.join(bags, "node").withColumnRenamed("bag", "mine")
    both = held.join(bags.select(F.col("node").alias("l"), F.col("bag").alias("theirs")), F.col("lead") == F.col("l"))
    shared = F.size(F.array_intersect("mine", "theirs"))
    links = both.where(shared >= similarity * (F.size("mine") + F.size("theirs") - shared) - 1e-9).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    labels = components(links)
    named = members.join(labels, "node", "left").select("node", "bucket", "n", F.coalesce("label", "node").alias("label"))
    named = written(named, "named")
    mixed = named.where("n > 2").groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("bucket").alias("b"))
    left = named.join(mixed, F.col("bucket") == F.col("b"), "left_semi")
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    left = left.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = left.select("node", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("label", "block").alias("who")).join(bags, "node")
    left = left.select(F.lit(0).alias("z"), "bucket", "i", "j", "who", "bag").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = written(left.mapInArrow(_crossed(similarity), "a long, b long"), "more")
    if not more.isEmpty():
        again = components(more).select(F.col("node").alias("old"), F.col("label").alias("new"))
        labels = written(labels.union(again.select(F.col("old"), F.col("old"))).distinct().join(again, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
        labels = labels.groupBy("node").agg(F.min("label").alias("label"))
    top = reps.join(labels, "node", "left").select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.coalesce("label", "node").alias("top"))
    # rows of one doc_id with several texts: the least class among them
    out = signed.join(top, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left")
    return out.select("doc_id", F.coalesce("top", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with all their columns, one of each class: that with the least doc_id, once."""
    by_place, columns = plain(docs)
    key, text = place(columns, "doc_id"), place(columns, "text")
    gone = near_classes(docs, similarity).where("doc_id <> class_id").select(F.col("doc_id").alias("gone"))
    kept = by_place.join(gone, F.col(key).cast("long") == F.col("gone"), "left_anti")
    first = F.row_number().over(Window.partitionBy(key, F.when(F.col(key).isNull(), F.xxhash64(text))).orderBy(F.xxhash64(text)))
    return kept.withColumn("first", first).where("first = 1").drop("first").toDF(*columns)


def op2_near_dup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op2_near_dup": op2_near_dup}
ORACLES: dict[str, str] = {}
