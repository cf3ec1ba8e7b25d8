"""Dense retrieval, fusion with keyword hits, reranking and packing of context."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfall.functions.vectors import cosine, normalized, word_spots


def nearest(vectors: DataFrame, query: list[float], k: int = 5, path: str | None = None, key: str = "chunk_id") -> DataFrame:
    """Exact: every vector is scored where it lies and each partition keeps k, so only k rows of each travel."""
    held = vectors if path is None else vectors.where(F.col("file_path") == path)
    target = F.lit([float(x) for x in query])
    return held.withColumn("score", cosine("embedding", target)).orderBy(F.desc("score"), key).limit(k)


def centroids(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Element-wise mean per document, combined before the shuffle as a sum per place."""
    spots = vectors.select(key, F.posexplode("embedding").alias("pos", "x"))
    means = spots.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def similar(vectors: DataFrame, doc_id, k: int = 10, floor: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Documents by the likeness of their centroids to one document's, itself left out, rounded to three places."""
    all_ = centroids(vectors, key)
    own = all_.where(F.col(key) == doc_id).select(F.col("centroid").alias("target"))
    scored = all_.where(F.col(key) != doc_id).crossJoin(F.broadcast(own)).withColumn("similarity", cosine("centroid", "target"))  # one row
    return scored.where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), key).limit(k).select(key, F.round("similarity", 3).alias("similarity"))


def with_details(hits: DataFrame, docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """Adds a document's columns to a short ranked list, by one join instead of a look-up each."""
    found = docs.select(F.col(key).alias("found"), *columns).join(F.broadcast(hits), F.col("found") == F.col(key), "right")
    return found.select(*hits.columns, *columns)


def hashed_embeddings(docs: DataFrame, dim: int = 384, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Embeddings without a model: every word adds three hashed values, then the vector is made of length one.

    Words are hashed where they stand, and their values summed up before the shuffle: no more than dim rows of a document travel.
    """
    tokens = docs.select(key, F.explode(F.split(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), r"\s+")).alias("word")).where("word <> ''")
    spots = word_spots(tokens, dim)
    sums = spots.groupBy(key, "pos").agg(F.sum("value").alias("x"))
    flat = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    empty = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.lit(0.0))
    return docs.select(key).join(flat, key, "left").select(key, F.when(F.col("m").isNull(), empty).otherwise(normalized(dense)).alias("embedding"))


def fused(vector_hits: DataFrame, keyword_hits: DataFrame, vector_weight: float = 0.7, keyword_weight: float = 0.3, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """Both lists scaled by their largest score, weighted and summed per id.

    Both are short ranked lists; the largest score is one row, so that a long one would do no harm.
    """

    def scaled(hits, weight):
        rows = hits.crossJoin(F.broadcast(hits.agg(F.max("score").alias("top"))))
        return rows.select(key, (F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.lit(0.0)) * weight).alias("part"))

    both = scaled(vector_hits, vector_weight).unionByName(scaled(keyword_hits, keyword_weight))
    return both.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key).limit(k)


def pass_through(candidates: DataFrame, k: int, step: float = 0.05) -> DataFrame:
    """Keeps the order and gives 1, 1 - step, ..."""
    few = candidates.orderBy(F.desc("score"), "chunk_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # k rows
    return few.withColumn("rank", rank).withColumn("score", F.lit(1.0) - F.lit(step) * (F.col("rank") - 1))


def reranked(candidates: DataFrame, judge: Callable[[list[str]], list[float]] | None, k: int, step: float = 0.1) -> DataFrame:
    """New scores by a judge of texts; without one the order stays, and so it does if the judge fails.

    The judge sees all candidates, a short list, at once: a judge that raises or answers for another number of texts has
    failed, and the candidates get 1, 1 - step, ... in their old order.
    """
    if judge is None:
        return pass_through(candidates, k).drop("rank")
    columns = candidates.columns
    names = [c for c in columns if c != "score"]

    def judged(batches):
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=columns)]).sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable")
        try:
            told = [float(x) for x in judge(rows["content"].tolist())]
            fits = len(told) == len(rows)
        except Exception:  # whatever a service raises
            fits = False
        rows["score"] = told if fits else [1.0 - step * i for i in range(len(rows))]
        yield rows[[*names, "score"]]

    types = dict(candidates.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in names], "score double"])
    return candidates.coalesce(1).mapInPandas(judged, schema).select(*columns).orderBy(F.desc("score"), "chunk_id").limit(k)


def indexed(index: DataFrame, docs: DataFrame, embed: Callable[[DataFrame], DataFrame], chunker=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The vectors (chunk_id, doc_id, ..., embedding) after documents came in: their old chunks go, they are cut and embedded anew.

    embed adds `embedding` to chunks; columns that the index does not have are left out. A document that is cut into nothing is
    gone from the index.
    """
    from inkfall.functions.chunks import chunk_plain, chunked

    new = embed(chunked(docs, chunker or chunk_plain, key, text))
    old = index.join(docs.select(F.col(key).alias("came")).distinct(), F.col(key) == F.col("came"), "left_anti")
    return old.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in index.columns]))


def keyword_leg(page: DataFrame, terms: list[str]) -> DataFrame:
    """chunk_id, score, content of a page of keyword hits: the content is the first snippet, with its marks."""
    from inkfall.operators.search import with_snippets

    return with_snippets(page, terms).select(F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("chunk_id"), "score", F.get("snippets", F.lit(0)).alias("content"))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = 5, **weights) -> DataFrame:
    """Fused scores with the content of either list, the vectors' before the keywords'."""
    told = vector_hits.select("chunk_id", "content", F.lit(0).alias("of")).unionByName(keyword_hits.select("chunk_id", "content", F.lit(1).alias("of")))
    told = told.groupBy(F.col("chunk_id").alias("told")).agg(F.min_by("content", "of").alias("content"))
    top = fused(vector_hits, keyword_hits, k=k, **weights)
    return top.join(told, F.col("chunk_id") == F.col("told")).drop("told").orderBy(F.desc("score"), "chunk_id")


def parsed_scores(c, n: int):
    """Scores in a model's answer: a JSON array, else the numbers in it, else 5 for each of n."""
    array = F.from_json(F.regexp_extract(c, r"\[[^\]]*\]", 0), "array<double>")
    loose = F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    even = F.array_repeat(F.lit(5.0), n)
    return F.when(F.size(array) == n, array).when(F.size(loose) >= n, F.slice(loose, 1, n)).otherwise(even)


def packed_context(chunks: DataFrame, max_tokens: int = 4000, by: str = "score", group: str | None = None) -> DataFrame:
    """context, n_chunks: chunks in order until the first that overflows the estimate, each under its file's name."""

    if group is None:
        # a part has three tokens at least, so no more than these can fit
        chunks = chunks.orderBy(F.desc(by), "chunk_id").limit(max_tokens // 3 + 1)
    text = F.concat(F.lit("[Document: "), F.col("filename"), F.lit("]\n"), F.col("content"))
    rows = chunks.withColumn("part", text).withColumn("tokens", F.floor(F.length("part") / 4))
    w = Window.partitionBy(*([group] if group else [])).orderBy(F.desc(by), "chunk_id")
    upto = rows.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w)).where(F.col("used") <= max_tokens)
    picked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"])
    return upto.groupBy(*([group] if group else [])).agg(F.array_join(picked, "\n---\n").alias("context"), F.count("*").alias("n_chunks"))


def last_messages(conversations: DataFrame, n: int = 6, role: str | None = None) -> DataFrame:
    """The last n messages of each conversation, of one role if given."""
    held = conversations if role is None else conversations.where(F.col("role") == role)
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return held.withColumn("back", rank).where(F.col("back") <= n)


def retrieval_query(conversations: DataFrame, question: str, n: int = 2) -> DataFrame:
    """conv_id, query: the last user messages in order and the new question."""
    last = last_messages(conversations, n, "user").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("said"))
    return last.select("conv_id", F.concat_ws(" ", F.array_join("said", " "), F.lit(question)).alias("query"))


def conversation_context(conversations: DataFrame, n: int = 6, chars: int = 300) -> DataFrame:
    """conv_id, context: the last messages as `Role: text`, each cut short."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring("text", 1, chars))
    return last_messages(conversations, n).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("context"))


#: Prompts in own words: an answer from documents, one that goes on with a conversation, a summary, a talk about one document.
PROMPTS = {
    "answer": "Answer the question from the documents below, and name those you used.\n\nDocuments:\n{context}\n\nQuestion: {question}\n\nAnswer:",
    "conversation": "Go on with the conversation. Answer from the documents below, and say so where they do not tell.\n\nSo far:\n{history}\n\nDocuments:\n{context}\n\nQuestion: {question}\n\nAnswer:",
    "summary": "Sum up the text below in a few sentences, then list its main points, a line each that starts with a dash.\n\nText:\n{context}\n\nSummary:",
    "document": "Answer from this one document, called {filename}.\n\nDocument:\n{context}\n\nQuestion: {question}\n\nAnswer:",
}


def prompts(contexts: DataFrame, question: str = "", kind: str = "answer") -> DataFrame:
    """Adds the prompt of a kind; {question} is the given one, any other place a column, empty where it is null."""
    parts = re.split(r"\{(\w+)\}", PROMPTS[kind])
    fill = lambda name: F.lit(question) if name == "question" else F.coalesce(F.col(name), F.lit(""))
    return contexts.withColumn("prompt", F.concat(*[fill(x) if i % 2 else F.lit(x) for i, x in enumerate(parts)]))


def answers(asked: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Runs a given model over the prompts."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(model)

    return asked.withColumn("answer", run("prompt"))
