"""URL filters by a Bloom filter cascade [native].

Level 1 is a Bloom filter of the listed keys. Level 2 holds the keys of the corpus's own universe that
pass level 1 although they are not listed, level 3 the listed keys that pass level 2, and so on until no
level errs. As the universe is complete, the answer is exact for every key of the corpus, and a row needs
no join: it tests bits of literal words. A cascade that is too large for a plan is built the same way in slices,
each over the keys of one hash, and keys meet their slice's words instead of a literal.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfall.llm.common import pick, table, written

#: (verdict, host, path), as the contract of op1 states them.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hosts listed as unwanted; a listed host covers its subdomains.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: The words of all levels together may take so many bytes in a plan; beyond it they are a table of slices of about so many bytes.
MAX_BYTES, SLICE_BYTES = 4 << 20, 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and each parent domain: a.b.c, b.c, c. Empty for an empty host."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule's string and verdict, null where none fits. Rules are a short list in the plan."""
    name = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last one that fits stays
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _bits(key: Column, level: int, m: int, k: int) -> list[Column]:
    """The k bit places of a key among m."""
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(m).cast("long")) for j in range(k)]


def _passes(key: Column, level: int, m: int, k: int, held: Column) -> Column:
    """Whether all of a key's bits are set in a level's words."""

    def test(words):
        out = F.lit(True)
        for at in _bits(key, level, m, k):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out

    return F.get(F.transform(F.array(held), test), F.lit(0))


def _literal(words: list[int]) -> Column:
    """Words that the plan holds as one folded literal."""
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def _alternating(key: Column, shapes: list[tuple[int, int]], words: list[Column]) -> Column:
    """Whether a key is listed: it passes an odd number of levels before one that it does not pass."""
    inside = F.lit(False)
    for i in reversed(range(len(shapes))):
        inside = _passes(key, i, *shapes[i], words[i]) & ~inside
    return F.coalesce(inside, F.lit(False))


def _shape(count: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter of so many keys."""
    k = max(1, round(-math.log2(rate)))
    return max(64, -(-math.ceil(count * 1.4427 * k) // 64) * 64), k


class Cascade:
    """levels: (m bits, k hashes, words of 64 bits) each."""

    def __init__(self, levels: list[tuple[int, int, list[int]]]):
        self.levels = levels

    @property
    def n_bytes(self) -> int:
        return sum(m // 8 for m, _, _ in self.levels)

    def contains(self, key: Column) -> Column:
        """Whether the key is listed; exact for keys of the universe that the cascade was built over."""
        return _alternating(key, [(m, k) for m, k, _ in self.levels], [_literal(w) for _, _, w in self.levels])


def _filter_words(keys: DataFrame, level: int, m: int, k: int) -> list[int]:
    """The words of a level's filter. They are gathered as (word, bits) with a combine before the shuffle."""
    spots = keys.select(F.explode(F.array(*_bits(F.col("key"), level, m, k))).alias("at"))
    got = spots.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    words = [0] * (m // 64)
    for r in got.toLocalIterator():
        words[r.w] = r.bits
    return words


def build_cascade(universe: DataFrame, max_bytes: int = MAX_BYTES, max_levels: int = 64) -> Cascade | None:
    """Cascade of a universe (key, listed), distinct keys. None if it would take over max_bytes.

    Level 1 has the false positive rate sqrt(1/2)*listed/others, the others 1/2, which makes the total
    size least. What reaches the driver are filters, whose size is checked before they are gathered.
    """
    n = {bool(r.listed): r.n for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    count, others = n.get(True, 0), n.get(False, 0)
    levels: list = []
    if not count:
        return Cascade(levels)
    rate = min(0.5, math.sqrt(0.5) * count / max(others, 1))
    side = True  # the side that the next level holds
    kept = universe
    while count:
        m, k = _shape(count, rate)
        if sum(x // 8 for x, _, _ in levels) + m // 8 > max_bytes:
            return None
        if len(levels) == max_levels:
            raise RuntimeError(f"the cascade has not ended after {max_levels} levels")
        level = len(levels)
        levels.append((m, k, _filter_words(kept.where(F.col("listed") == side), level, m, k)))
        passes = _passes(F.col("key"), level, m, k, _literal(levels[-1][2]))
        # the held side goes on whole; of the other side, only what passes by mistake
        kept = written(kept.where((F.col("listed") == side) | passes), "level")
        count = kept.where(F.col("listed") != side).count()
        side, rate = not side, 0.5
    return Cascade(levels)


def listed_keys(universe: DataFrame, slice_bytes: int = SLICE_BYTES, max_levels: int = 64) -> DataFrame:
    """The listed keys of a universe (key, listed) by a cascade in slices: no filter reaches the driver or a plan.

    All slices share the shape of a level, which suits the fullest of them, so the answer is as exact as that of one cascade.
    """
    n = universe.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("others")).first()
    if not n.listed:
        return universe.where("false").select("key")
    rate = min(0.5, math.sqrt(0.5) * n.listed / max(n.others, 1))
    slices = max(1, -(-2 * _shape(n.listed, rate)[0] // 8 // slice_bytes))
    every = universe.withColumn("slice", F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(slices)).cast("int"))
    every = kept = written(every, "slices")
    held = written(every.select("slice").distinct().withColumn("words", F.array().cast("array<array<bigint>>")), "held")
    side, shapes = True, []
    while True:
        most = kept.where(F.col("listed") == side).groupBy("slice").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
        if not most:
            break
        if len(shapes) == max_levels:
            raise RuntimeError(f"the cascade has not ended after {max_levels} levels")
        level = len(shapes)
        m, k = _shape(most, rate)
        shapes.append((m, k))
        spots = kept.where(F.col("listed") == side).select("slice", F.explode(F.array(*_bits(F.col("key"), level, m, k))).alias("at"))
        set_bits = spots.groupBy("slice", F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
        none = held.select("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m // 64 - 1).cast("long"))).alias("w"), F.lit(0).cast("long").alias("bits"))
        words = set_bits.unionByName(none).groupBy("slice", "w").agg(F.bit_or("bits").alias("bits")).groupBy("slice").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("new"))
        held = written(held.join(words, "slice").select("slice", F.concat("words", F.array("new")).alias("words")), "held")
        passes = _passes(F.col("key"), level, m, k, F.element_at("words", -1))
        kept = written(kept.join(held, "slice").where((F.col("listed") == side) | passes).select("key", "listed", "slice"), "level")
        side, rate = not side, 0.5
    return every.join(held, "slice").where(_alternating(F.col("key"), shapes, [F.element_at("words", i + 1) for i in range(len(shapes))])).select("key")


def filter_urls(pages: DataFrame, rules=RULES, listed: DataFrame | tuple = LISTED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, is_listed of every page.

    The longest fitting rule decides; where none fits, a page is blocked if its host or a parent domain is
    listed. Null and malformed urls have an empty host and path, fit no rule and are allowed. Repeated
    rows are judged each, columns with clashing names are no matter, and an empty table gives an empty result. A
    listed null or repeated key changes nothing.
    """
    base = pick(pages, "page_id", "url").select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = base.select("host").distinct().select("host", F.explode(host_suffixes(F.col("host"))).alias("key"))
    keys = hosts.select("key").distinct()
    if isinstance(listed, DataFrame):
        keys = keys.join(pick(listed, "key").distinct().withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    else:
        keys = keys.select("key", F.col("key").isin(list(listed)).alias("listed"))
    universe = written(keys, "universe")
    cascade = build_cascade(universe, max_bytes)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    if cascade is not None:
        base = base.withColumn("is_listed", F.exists(host_suffixes(F.col("host")), cascade.contains))
    else:
        hit = hosts.join(listed_keys(universe), "key").select(F.col("host").alias("hit")).distinct()
        base = base.join(hit, F.col("host") == F.col("hit"), "left").withColumn("is_listed", F.col("hit").isNotNull()).drop("hit")
    by_list = F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return base.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "is_listed")


def op1_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED)
    return f"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path,
    CASE {' '.join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in cases)} END AS rule,
    CASE {' '.join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in cases)} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict,
    ({listed}) AS is_listed
FROM u"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES = {"op1_url_filter": _sql()}
