"""Keyword search as a lazy plan: postings, a boolean tree over them, BM25, filters and pages."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfall.functions import text as T
from inkfall.functions.dates import mentions_year
from inkfall.functions.lazy import bound
from inkfall.plans.analysis import split_terms, stemmed
from inkfall.plans.query_language import INDEX_FIELDS, Leaf, Near, Op, Query, leaves_of, read

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _runs(terms: Column) -> Column:
    """term, positions of every distinct term of an array: its places are sorted by term, and equal ones stand together."""

    def cut(places):
        term = lambda i: F.get(places, i)["term"]
        heads = F.filter(F.transform(places, lambda x, i: F.when((i == 0) | (x["term"] != term(i - 1)), i)), lambda i: i.isNotNull())
        run = lambda heads: F.transform(heads, lambda h, k: F.struct(term(h).alias("term"), F.transform(F.slice(places, h + 1, F.coalesce(F.get(heads, k + 1), F.size(places)) - h), lambda x: x["pos"]).alias("positions")))
        return bound(heads, run)

    return bound(F.array_sort(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))), cut)


def build_postings(docs: DataFrame, stem: bool = False) -> DataFrame:
    """term, doc_id, col, positions of documents (id, filename, content), a row per document and id.

    A document's postings are made where it lies: nothing is shuffled. Stems are looked up per distinct word,
    not per token: a pass over the vocabulary, joined back.
    """
    parts = [docs.select(F.col("id").alias("doc_id"), F.lit(c).alias("col"), F.inline(_runs(split_terms(F.col(c))))) for c in INDEX_FIELDS]
    postings = reduce(DataFrame.unionByName, parts)
    if stem:
        words = postings.select("term").distinct().withColumn("stem", stemmed("term"))
        postings = postings.join(words, "term").groupBy(F.col("stem").alias("term"), "doc_id", "col").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return postings.select("term", "doc_id", "col", "positions")


def doc_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, dl: tokens of both columns."""
    return docs.select(F.col("id").alias("doc_id"), sum((F.size(split_terms(F.col(c))) for c in INDEX_FIELDS[1:]), F.size(split_terms(F.col(INDEX_FIELDS[0])))).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def _starts(leaf: Leaf, column: str, spots: Column) -> Column:
    """Where a leaf's tokens stand in a row in a column; spots maps `column:term` to positions."""
    none = F.array().cast("array<int>")
    if not leaf.tokens or (leaf.column and leaf.column != column):
        return none
    at = [F.coalesce(F.element_at(spots, F.lit(f"{column}:{t}")), none) for t in leaf.tokens]
    out = at[0]
    for i, p in enumerate(at[1:], 1):
        out = F.array_intersect(out, F.transform(p, _less(i)))
    return out


def _less(i: int):
    return lambda x: x - i


def _near(node: Near, column: str, spots: Column) -> Column:
    """Starts of the first leaf that have all others within the distance."""
    first, *rest = node.leaves
    out = _starts(first, column, spots)
    for other in rest:
        there = _starts(other, column, spots)
        out = F.filter(out, _within(there, node.distance, len(first.tokens), len(other.tokens)))
    return out


def _within(there: Column, distance: int, mine: int, its: int):
    return lambda x: F.exists(there, lambda y: F.when(y >= x, y - x - mine).otherwise(x - y - its) <= distance)


def _counts(leaf, spots: Column) -> Column:
    find = _near if isinstance(leaf, Near) else _starts
    return sum((F.size(find(leaf, c, spots)) for c in INDEX_FIELDS[1:]), F.size(find(leaf, INDEX_FIELDS[0], spots)))


def _holds(tree, at: dict) -> Column:
    if isinstance(tree, Op):
        left, right = _holds(tree.left, at), _holds(tree.right, at)
        return {"AND": lambda: left & right, "OR": lambda: left | right, "NOT": lambda: left & ~right}[tree.kind]()
    return F.col(at[tree]) > 0


def _terms(leaves) -> list[str]:
    return sorted({t for x in leaves for y in (x.leaves if isinstance(x, Near) else (x,)) for t in y.tokens})


def counted(postings: DataFrame, lengths: DataFrame, at: dict) -> tuple[DataFrame, DataFrame]:
    """From an index: how often each leaf stands in the documents that hold one, with their lengths; and the corpus's figures.

    The postings are cut to the query's terms before anything is shuffled.
    """
    terms = _terms(at)
    hits = postings.where(F.col("term").isin(terms) if terms else F.lit(False))
    spots = hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "col", "term"), "positions"))).alias("spots"))
    found = spots.select("doc_id", *[_counts(x, F.col("spots")).alias(c) for x, c in at.items()])
    held = found.agg(*[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in at.values()])
    return found.join(lengths, "doc_id"), corpus_stats(lengths).crossJoin(F.broadcast(held))  # a row each


def counted_in_texts(docs: DataFrame, at: dict) -> tuple[DataFrame, DataFrame]:
    """The same without an index: each document is split where it lies, and nothing is shuffled but the corpus's figures."""
    terms = _terms(at)
    held = lambda c: F.filter(F.transform(f"t_{c}", lambda x, i: F.when(x.isin(terms), F.struct(x.alias("term"), i.alias("pos")))), lambda h: h.isNotNull())
    places = lambda c, t: F.transform(F.filter(f"h_{c}", lambda h: h["term"] == t), lambda h: h["pos"])
    rows = docs.select(F.col("id").alias("doc_id"), *[split_terms(F.col(c)).alias(f"t_{c}") for c in INDEX_FIELDS])
    # one pass over a text's terms, whatever the number of those asked for
    rows = rows.select("doc_id", reduce(lambda a, b: a + b, [F.size(f"t_{c}") for c in INDEX_FIELDS]).cast("long").alias("dl"), *[held(c).alias(f"h_{c}") for c in INDEX_FIELDS])
    rows = rows.select(
        "doc_id",
        "dl",
        F.create_map(*[x for c in INDEX_FIELDS for t in _terms(at) for x in (F.lit(f"{c}:{t}"), places(c, t))]).alias("spots") if _terms(at) else F.create_map().cast("map<string,array<int>>").alias("spots"),
    )
    found = rows.select("doc_id", "dl", *[_counts(x, F.col("spots")).alias(c) for x, c in at.items()])
    return found, found.agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in at.values()])


def matched(counts: DataFrame, figures: DataFrame, tree, at: dict) -> DataFrame:
    """doc_id, score of the documents that satisfy the tree.

    How many documents hold a leaf counts over the whole corpus, before the tree and any filter decide.
    """
    scored = counts.where(_holds(tree, at)).crossJoin(F.broadcast(figures))  # one row
    total = F.lit(0.0)
    for x in leaves_of(tree):
        tf, df = F.col(at[x]).cast("double"), F.col(f"df_{at[x]}")
        idf = F.ln((F.col("n_docs") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.select("doc_id", total.alias("score"))


def filters(q: Query) -> Column:
    """The conditions on type, author and dates, in three-valued logic.

    `before` keeps documents without a date, `after` only if a detected date is of that year.
    """
    out = []
    if q.file_type:
        out.append(F.col("file_type") == q.file_type)
    if q.author:
        out.append(T.like_ignoring_ascii_case("doc_author", q.author))
    if q.after:
        out.append((F.col("doc_created") >= q.after) | mentions_year("detected_dates", q.after[:4]))
    if q.before:
        out.append((F.col("doc_created") <= q.before) | F.col("doc_created").isNull())
    if q.year is not None:
        out.append(F.col("doc_created").between(f"{q.year}-01-01", f"{q.year}-12-31") | mentions_year("detected_dates", q.year))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def search(docs: DataFrame, query: str | Query, postings: DataFrame | None = None, lengths: DataFrame | None = None, stem: bool = False, allow_date_only: bool = False) -> DataFrame:
    """All hits: the documents' columns and their score, in no order. Refused and empty queries have none."""
    q = read(query, stem) if isinstance(query, str) else query
    if not q.valid or not (q.searchable or (allow_date_only and (q.after or q.before or q.year is not None))):
        return docs.withColumn("score", F.lit(0.0)).where(F.lit(False))
    kept = docs.where(filters(q))
    if q.tree is None:
        return kept.withColumn("score", F.lit(0.0))
    at = {x: f"tf{i}" for i, x in enumerate(dict.fromkeys(leaves_of(q.tree)))}
    if postings is None and not stem:
        counts, figures = counted_in_texts(docs, at)
    else:
        counts, figures = counted(build_postings(docs, stem) if postings is None else postings, doc_lengths(docs) if lengths is None else lengths, at)
    hits = matched(counts, figures, q.tree, at)
    return kept.join(hits.withColumnRenamed("doc_id", "hit"), F.col("id") == F.col("hit")).drop("hit")


def page_of(hits: DataFrame, page: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    size, page = min(size, most), max(page, 1)
    return hits.orderBy(F.desc("score"), "id").offset((page - 1) * size).limit(size)


def search_page(docs: DataFrame, query: str | Query, page: int = 1, size: int = 20, content: str = "content", **how) -> DataFrame:
    """A page of hits with all their columns, best first; the texts come in after the limit, for the page's rows alone."""
    light = docs.drop(content) if how.get("postings") is not None else docs
    found = page_of(search(light, query, **how).select("id", "score"), page, size)
    rows = docs.join(F.broadcast(found.withColumnRenamed("id", "hit")), F.col("id") == F.col("hit")).drop("hit")  # a page at most
    return rows.orderBy(F.desc("score"), "id")


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"))


def suggest(docs: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Distinct file names that start so, ASCII case aside; % and _ in the prefix stay wildcards."""
    return docs.where(T.ascii_lower("filename").like(prefix.lower() + "%")).select("filename").distinct().orderBy("filename").limit(limit)


def term_pattern(terms: list[str]) -> re.Pattern | None:
    """Whole words or phrases of a query, whatever their case; operators and the names of fields are no terms."""
    bare = [t.strip("\"'").partition(":") for t in terms]
    bare = [after if colon else before for before, colon, after in bare]
    words = [re.escape(t) for t in bare if t and t.upper() not in ("AND", "OR", "NOT")]
    return re.compile(rf"\b({'|'.join(words)})\b", re.I) if words else None


def apart(spans, distance: int, most: int):
    """The first spans of which each starts at least a distance after the one before ended; spans come in order."""
    free = 0
    for start, end in spans:
        if most and start >= free:
            yield start, end
            free, most = end + distance, most - 1


def widened(text: str, start: int, end: int, by: int, snap: int) -> tuple[int, int]:
    """A span and so many characters on both sides, moved outwards to a blank if one is near."""
    lo, hi = max(0, start - by), min(len(text), end + by)
    return text.rfind(" ", max(0, lo - snap), lo) + 1 or lo, max(text.find(" ", hi, hi + snap), hi)


def snippets(text: str | None, terms: list[str], chars: int = 150, most: int = 3, tag: str = "mark") -> list[str]:
    """Passages about the first matches that lie apart, cut at blanks and with every match marked; the head of a text without any."""
    shape = term_pattern(terms)
    if not text or not shape:
        return []
    passages = [widened(text, *span, chars // 2, 20) for span in apart((m.span() for m in shape.finditer(text)), chars, most)]
    if passages:
        return ["..." * (lo > 0) + shape.sub(rf"<{tag}>\1</{tag}>", text[lo:hi]) + "..." * (hi < len(text)) for lo, hi in passages]
    blank = text.rfind(" ", 0, chars)
    return [text if len(text) <= chars else text[: blank if blank >= 0 else chars] + "..."]


def with_snippets(page: DataFrame, terms: list[str], content: str = "content", **how) -> DataFrame:
    """Adds `snippets`; meant for a page, after the limit."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: snippets(t, terms, **how))

    return page.withColumn("snippets", run(content))


def match_positions(c, terms: list[str]) -> Column:
    """Where each term starts in a text, whatever its case and also inside of words, one term after the other: (term, position)."""

    @F.pandas_udf("array<struct<term:string,position:int>>")
    def run(s: pd.Series) -> pd.Series:
        shapes = [(t, re.compile(re.escape(t), re.I)) for t in terms]
        return s.map(lambda x: [{"term": t, "position": m.start()} for t, shape in shapes for m in shape.finditer(x or "")])

    return run(c)


def merge_postings(postings: DataFrame, changed: DataFrame, deleted: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """Postings after documents came, changed or went: the old rows of those ids leave, new ones come in."""
    ids = changed.select(F.col("id").alias("doc_id"))
    if deleted is not None:
        ids = ids.unionByName(deleted.select(F.col("id").alias("doc_id")))
    return postings.join(ids.distinct(), "doc_id", "left_anti").unionByName(build_postings(changed, stem))
