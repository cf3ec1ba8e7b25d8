"""What the training-data operators share: column picking, shared tables, shipping code, components."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with its columns named by place (c0, c1, ...), and their own names.

    Columns whose names differ only in case, or clash with an operator's own, can then not be mistaken.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def place(columns: list[str], name: str) -> str:
    """The positional name of a column: an exact match before one that differs in case."""
    exact = [i for i, c in enumerate(columns) if c == name]
    loose = [i for i, c in enumerate(columns) if c.lower() == name.lower()]
    if not (exact or loose):
        raise ValueError(f"column {name} is missing; there are {columns}")
    return f"c{(exact or loose)[0]}"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever others the frame holds."""
    by_place, columns = plain(df)
    return by_place.select(*[F.col(place(columns, n)).alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='inkfall-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost executors. It is removed when the driver ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/inkfall-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a Python worker gets at once; Spark's own limit is eight times that.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session: Python workers import it from there.

    Where the session does not say how many bytes a worker gets at once, it gets few, as texts may be long.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    if getattr(sc, "_inkfall_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    target = Path(tempfile.mkdtemp(prefix="inkfall-code-")) / "inkfall.zip"
    target.write_bytes(data.getvalue())
    sc.addPyFile(str(target))
    sc._inkfall_shipped = True


#: Words of 64 bits that a filter of ids takes in a plan at most.
FILTER_WORDS = 1 << 20


def maybe_among(ids: DataFrame, name: str, column: Column, bits_each: int = 10, hashes: int = 6) -> Column:
    """Whether a value may be among the ids: a Bloom filter of ten bits an id, 8 MB at most.

    It spares a join the rows that cannot match and decides nothing: beyond its size it only lets more through.
    """
    n = ids.count()
    words = max(1, min(FILTER_WORDS, -(-n * bits_each // 64)))
    spots = lambda c: [F.pmod(F.xxhash64(F.lit(101 + j), c), F.lit(words * 64).cast("long")) for j in range(hashes)]
    one = F.lit(1).cast("long")
    set_bits = ids.select(F.explode(F.array(*spots(F.col(name)))).alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", one, (F.col("at") % 64).cast("int"))).alias("bits"))
    held = [0] * words
    for r in set_bits.toLocalIterator():
        held[r.w] = r.bits
    array = F.from_json(F.lit(json.dumps(held)), "array<bigint>")
    out = F.lit(True)
    for at in spots(column):
        out = out & (F.call_function("shiftrightunsigned", F.get(array, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")).bitwiseAND(one) == 1)
    return out


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected links (a, b): a row (node, label) per linked node, label the least.

    Each round hooks every node's label to the least one among its neighbours and then jumps pointers, so
    the rounds grow with the logarithm of a component's diameter. Aggregates combine before the shuffle; a
    hub's rows only meet in joins, which adaptive execution can split. Each round is written to the shared
    folder. A graph that has not settled after max_rounds raises instead of returning wrong labels.
    """
    spark = edges.sparkSession
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # what a node hooks to, its old root hooks to as well
        roots = hooked.where("label < old").groupBy(F.col("old").alias("root")).agg(F.min("label").alias("low"))
        hooked = hooked.join(roots, hooked["node"] == roots["root"], "left").select("node", "old", F.least("label", "low").alias("label"))
        hooked = written(hooked, "hooked")
        up = hooked.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = hooked.join(up, hooked["label"] == up["up"]).select("node", "old", F.col("top").alias("label"))
        step = written(jumped, "labels")
        if step.where("label <> old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
