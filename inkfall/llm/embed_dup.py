"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random lines. On a line, a pair of cosine c differs like a normal variable
of deviation sqrt(2 - 2c), so a window about a query's value catches it with a known probability, but about two
fifths of all unrelated pairs too. Only the ends of a sorted line are sparse, so a vector is looked up where it is
extreme: lines stand in banks, a vector belongs to that end of that line of a bank where its projection is the
largest, and vectors meet where they belong to the same ends in all banks of a group. Normal values of correlation
c have the same largest place with a probability that the dimension and the data have no part in, so it is measured
by simulation, and gives as many groups as the recall asks for. Where vectors meet they are sorted along one line, each
opens a window about its own value, collisions in the windows of all counting lines are counted, and pairs that reach the
calibrated count are verified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfall.llm.common import components, pick, ship, table, written

COSINE, RECALL, SEED = 0.9, 0.99, 11
#: Counting lines, and the share of them that a pair at the threshold hits.
LINES, HIT = 16, 0.9
#: Vectors of chance meeting aimed at, members of a meeting that are compared together, and of them at once.
MEET, BLOCK, ROWS = 2048, 4096, 128
#: Lines of a bank and banks of a group at most, and simulated pairs.
MOST_LINES, MOST_BANKS, DRAWS = 512, 8, 20_000


def same_end(lines: int, cosine: float) -> float:
    """With which probability a pair has its largest projection at the same end of the same of so many lines; a careful estimate."""
    rng = np.random.default_rng([SEED, lines])
    x = rng.normal(size=(DRAWS, lines))
    y = cosine * x + math.sqrt(max(1 - cosine**2, 0.0)) * rng.normal(size=(DRAWS, lines))
    i, j, k = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1), np.arange(DRAWS)
    p = float(((i == j) & (x[k, i] * y[k, j] > 0)).mean())
    return max(p - 3 * math.sqrt(p * (1 - p) / DRAWS), 1e-3)


def plan_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> dict:
    """Lines a bank, banks a group, groups, windows and least count, for n vectors: the fewest groups.

    With the cosine 0.9 that is 6 groups for 51,282 vectors, 24 for 10^8 and 30 for 10^9, so that a vector and its
    ends (4 bytes a group) travel so many times.
    """
    best = None
    for banks in range(1, MOST_BANKS + 1):
        lines = max(1, math.ceil((n / MEET) ** (1 / banks) / 2))
        if lines <= MOST_LINES:
            p = same_end(lines, cosine) ** banks
            groups = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(p, 1 - 1e-9))))
            best = min(best or (groups, banks, lines), (groups, banks, lines))
    groups, banks, lines = best
    sd = math.sqrt(max(2 - 2 * cosine, 1e-12))
    window = sd * next(x for x in np.linspace(0, 6, 6001) if math.erf(x / math.sqrt(2)) >= HIT)
    least, tail = LINES, HIT**LINES
    while tail < 0.9995 and least:
        least -= 1
        tail += math.comb(LINES, least) * HIT**least * (1 - HIT) ** (LINES - least)
    return {"lines": lines, "banks": banks, "groups": groups, "window": float(window), "lead": 3.5 * sd, "least": least, "cosine": cosine}


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw.astype(np.float64)
    scaled /= np.abs(scaled).max(axis=1)[:, None]
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _celled(plan: dict, kind: str):
    """vec_id, copies, vector as bytes, and for each group a hash of the ends that the vector belongs to."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                raw = vectors.take(pa.array(at)).flatten().to_numpy().astype(kind).reshape(-1, dim)
                unit, every = _unit(raw), np.arange(len(raw))
                rng = np.random.default_rng([SEED, int(dim)])
                cells = np.full((len(raw), plan["groups"]), int(dim), dtype=np.uint64)
                for g in range(plan["groups"]):
                    for _ in range(plan["banks"]):
                        values = unit @ rng.normal(size=(int(dim), plan["lines"]))
                        line = np.abs(values).argmax(axis=1)
                        end = 2 * line + (values[every, line] > 0)
                        with np.errstate(over="ignore"):
                            cells[:, g] = (cells[:, g] ^ end.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                            cells[:, g] ^= cells[:, g] >> np.uint64(29)
                flat = pa.array((cells >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1))
                ends = pa.array(np.arange(0, len(raw) + 1, dtype=np.int32) * plan["groups"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([r.tobytes() for r in raw], pa.binary()), pa.ListArray.from_arrays(ends, flat)],
                    names=["vec_id", "copies", "vector", "cells"],
                )

    return run


def _linked(vectors: np.ndarray, cells: np.ndarray, group: int, own: np.ndarray, crossed: bool, plan: dict):
    """(a, b) of the places that are linked and have not met in an earlier group; if crossed, of different blocks only."""
    unit = _unit(vectors)
    rng = np.random.default_rng([SEED, vectors.shape[1], 1])
    values = (unit @ rng.normal(size=(vectors.shape[1], LINES))).astype(np.float32)
    order = np.argsort(values[:, 0], kind="stable")
    unit, values, cells, own = unit[order], values[order], cells[order], own[order]
    upper = np.searchsorted(values[:, 0], values[:, 0] + np.float32(plan["lead"]), side="right")
    found = []
    for lo in range(0, len(unit), ROWS):
        hi = min(lo + ROWS, len(unit))
        top = int(upper[hi - 1])
        # of each two the later one in the order, and each pair only where it meets first
        fresh = np.arange(lo, top)[None, :] > np.arange(lo, hi)[:, None]
        if crossed:
            fresh &= own[lo:hi, None] != own[None, lo:top]
        for g in range(group):
            fresh &= cells[lo:hi, g, None] != cells[None, lo:top, g]
        if not fresh.any():
            continue
        hits = np.zeros(fresh.shape, dtype=np.uint8)
        for i in range(LINES):
            hits += np.abs(values[lo:hi, i, None] - values[None, lo:top, i]) <= plan["window"]
        fresh &= hits >= plan["least"]
        if fresh.any():
            fresh &= unit[lo:hi] @ unit[lo:top].T >= plan["cosine"]
            a, b = np.nonzero(fresh)
            found.append((order[a + lo], order[b + lo]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _hung(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n places the least one that it hangs together with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _met(plan: dict, kind: str):
    """node, links, root of the vectors with partners, for rows in the order of their meetings."""
    keys = ("g", "cell", "i", "j")

    def work(t: pa.Table):
        key = np.stack([t[c].to_numpy() for c in keys], axis=1)
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        nodes, links, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            s = t.slice(lo, hi - lo)
            raw = s["vector"].to_pylist()
            sizes = np.array([len(x) for x in raw])
            for size in np.unique(sizes):  # vectors of different lengths share no meeting but by a chance of the hash
                some = np.flatnonzero(sizes == size)
                vectors = np.frombuffer(b"".join(raw[i] for i in some), kind).reshape(len(some), -1)
                cells = s["cells"].combine_chunks().flatten().to_numpy().reshape(len(s), -1)[some]
                a, b = _linked(vectors, cells, int(key[lo, 0]), s["block"].to_numpy()[some], bool(key[lo, 2] != key[lo, 3]), plan)
                if len(a):
                    ids, copies = s["vec_id"].to_numpy()[some], s["copies"].to_numpy()[some]
                    many = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                    with_links = many > 0
                    nodes.append(ids[with_links]), links.append(many[with_links].astype(np.int64)), roots.append(ids[_hung(len(ids), a, b)[with_links]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, links, roots)], names=["node", "links", "root"])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            # the last meeting may go on in the next batch
            same = np.ones(len(t), dtype=bool)
            for c in keys:
                column = t[c].to_numpy()
                same &= column == column[-1]
            cut = int(same.argmax())
            if cut:
                yield work(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and len(rest):
            yield work(rest)

    return run


def link_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and so do
    rows with a null vec_id. Equal vectors are linked and searched for once. Rows that repeat a vec_id and
    vector are one vector and get a row each; so do rows that share a vec_id with different vectors, which
    are joined into one component. A pair at the threshold is found with at least the given recall, pairs
    further above it more surely, and none below it. Vectors of different lengths are not linked. Columns with
    clashing names are no matter; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = pick(vectors, "vec_id", "embedding")
    # components of four bytes travel as they are, all others as doubles
    of, kind = ("float", "<f4") if dict(rows.dtypes)["embedding"] == "array<float>" else ("double", "<f8")
    rows = rows.withColumn("embedding", F.col("embedding").cast(f"array<{of}>"))
    big = F.lit(float(np.finfo(kind).max))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big))
    ok = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # equal vectors by two hashes of their components
    hashes = [F.when(ok, F.xxhash64(F.lit(i), F.transform("embedding", lambda x: x + F.lit(0.0).cast(of)))) for i in (0, 1)]
    rows = rows.withColumns({"h1": hashes[0], "h2": hashes[1]})
    known = rows.where("h1 IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "h1", "h2", "embedding")
    # vectors travel once, their ids by themselves
    ids = known.select("h1", "h2", "vec_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    reps = known.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "embedding")).alias("x")).join(ids, ["h1", "h2"])
    reps = written(reps.select("h1", "h2", "copies", "x.*"), "reps")
    plan = plan_for(reps.count(), cosine, recall)
    celled = written(reps.select("vec_id", "copies", "embedding").mapInArrow(_celled(plan, kind), "vec_id long, copies long, vector binary, cells array<int>"), "cells")
    large = celled.select(F.posexplode("cells").alias("g", "cell")).groupBy("g", "cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = written(large.select(F.col("g").alias("lg"), F.col("cell").alias("lc"), F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int").alias("blocks")), "large")
    met = celled.select("vec_id", "copies", "vector", "cells", F.posexplode("cells").alias("g", "cell"))
    met = met.join(large, (F.col("g") == F.col("lg")) & (F.col("cell") == F.col("lc")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("lg", "lc")
    met = met.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("vec_id", "copies", "vector", "cells", "g", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    met = met.repartition("g", "cell", "i", "j").sortWithinPartitions("g", "cell", "i", "j")
    found = written(met.mapInArrow(_met(plan, kind), "node long, links long, root long"), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    same_id = known.select("vec_id", "h1", "h2").distinct().join(reps.select("h1", "h2", F.col("vec_id").alias("rep")), ["h1", "h2"])
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(same_id.select(F.col("vec_id"), F.col("rep")))
    labels = components(edges)
    tops = reps.join(counts, reps["vec_id"] == counts["node"], "left").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "copies", "links")
    out = rows.select("vec_id", "h1", "h2").join(tops, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left").join(labels, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("label", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embed_dup(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embed_dup": op6_embed_dup}
ORACLES: dict[str, str] = {}
