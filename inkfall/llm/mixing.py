"""Mixing sources to target weights by systematic sampling [native].

Every document of a source is expected target / size times. Documents stand in one order within their
source; the expected copies are summed up in that order from one random offset, and a document is emitted
once for each whole number that its own stretch crosses. The order goes by size, so that every size is
represented in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkfall.llm.common import pick, place, plain, table, written

WEIGHTS = (5, 2, 1)
TOTAL, MOST, SEED = 1.5, 2, 17
#: Documents of a source and size class that are numbered together.
BLOCK_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """source, source_size, target of (source, size) rows; size sums to the source's.

    The sources in order of code points, null last, take the weights in turn. The common level at which
    weight * level reaches the total, with sources stopped at `most` times their size, has a closed form:
    with sources in order of size / weight, those before some place are stopped and the others share the
    rest by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row a source
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    up = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (everything * F.lit(float(total)) - before) / rest).withColumn("stopped", F.col("level") * F.col("w") > cap)
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(Window.partitionBy())["level"]
    return per.withColumn("first", level).select("source", "source_size", F.least(cap, F.col("first") * F.col("w")).alias("target"))


def mark_of(key: Column, text: Column) -> Column:
    """A hash of a document's id and text, by which those of a size class stand in an arbitrary but fixed order.

    Rows of one mark are the same document, so it does not matter which of them stands first.
    """
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _first32(hex_digits: Column) -> Column:
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("long")


def copies(rows: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and copies to rows (mark, source, size).

    Ranks come in two steps: counts per source, size class and block give the offsets, and rows are
    numbered within their block of about BLOCK_ROWS, so that a source with a third of all rows is no
    single task's, nor are rows that share an id. What is worked out per source is worked out in one task.
    """
    rows = written(rows.withColumn("class", F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int")), "sizes")
    blocks = rows.groupBy("source", "class").agg(F.ceil(F.count("*") / F.lit(float(BLOCK_ROWS))).cast("long").alias("blocks"))
    cut = blocks.select(F.col("source").alias("s"), F.col("class").alias("c"), "blocks")
    rows = rows.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).drop("s", "c")
    rows = written(rows.withColumn("block", F.floor(_first32(F.col("mark")) * F.col("blocks") / F.lit(4294967296.0)).cast("long")).drop("blocks"), "blocks")
    counts = rows.groupBy("source", "class", "block").agg(F.count("*").alias("n"))
    up = Window.partitionBy("source").orderBy("class", "block")
    offsets = counts.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("block").alias("b"), (F.sum("n").over(up) - F.col("n")).alias("before"))
    targets = source_targets(rows, weights, total, most).withColumnRenamed("source", "t")
    # a row per block, so that the targets and offsets meet before the documents come in
    plan = offsets.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    rank = F.row_number().over(Window.partitionBy("source", "class", "block").orderBy("mark", *[c for c in ("n",) if c in rows.columns])) - 1
    rows = rows.withColumn("at", rank).join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("block") == F.col("b"))).drop("s", "c", "b")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _first32(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))))).cast("double") / F.lit(4294967296.0)
    k = (F.col("at") + F.col("before")).cast("double")
    emitted = F.floor((k + 1) * F.col("rate") + F.col("start")) - F.floor(k * F.col("rate") + F.col("start"))
    rows = rows.withColumn("rate", rate).withColumn("start", start).withColumn("copies", F.least(emitted, F.lit(most)).cast("long"))
    return rows.drop("class", "block", "at", "before", "rate", "start")


def mix_sources(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document.

    Null and empty texts have size 0 and add nothing; a source of such texts has target 0. The null source
    is a source of its own. Rows that share an id are documents of their own; repeated rows too, and which of
    them is taken more often is all one. The order in which rows come changes nothing. Columns with clashing names
    are no matter; an empty table gives an empty result.
    """
    rows = pick(docs, "doc_id", "source", "text").select("doc_id", "source", mark_of(F.col("doc_id"), F.col("text")).alias("mark"), word_count(F.col("text")).alias("size"))
    out = copies(rows, **params)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns.

    A row finds its copies by its mark and source; rows alike in both, which differ in other columns at most, are
    told apart by a number in the order of a hash of all columns.
    """
    by_place, columns = plain(docs)
    text = F.col(place(columns, "text"))
    named = by_place.withColumns({"mark": mark_of(F.col(place(columns, "doc_id")), text), "source": F.col(place(columns, "source")), "size": word_count(text)})
    alike = Window.partitionBy("mark", "source").orderBy(F.xxhash64(*by_place.columns))
    named = named.withColumn("n", F.row_number().over(alike))
    got = copies(named.select("mark", "source", "size", "n"), **params).where("copies > 0").select(F.col("mark").alias("m"), F.col("source").alias("s"), F.col("n").alias("k"), "copies")
    out = named.join(got, (F.col("mark") == F.col("m")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("n") == F.col("k")))
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*by_place.columns).toDF(*columns)


def op5_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


_SQL = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS mark, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT *, source_size::DOUBLE / w AS r, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p),
t AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, w * (SELECT level FROM l WHERE NOT level * w > source_size * 2.0::DOUBLE ORDER BY r, source NULLS LAST LIMIT 1)) AS target FROM l),
k AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('{SEED}:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
        (row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(size + 1.0::DOUBLE) * 4), mark) - 1)::DOUBLE AS k
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(floor((k + 1) * rate + start) - floor(k * rate + start), 2)::BIGINT AS copies FROM k)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": _SQL}
