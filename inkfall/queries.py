"""The library's operators as queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfall.functions import chunks as C
from inkfall.functions import dates as D
from inkfall.functions import layout as L
from inkfall.functions import pii as P
from inkfall.functions import text as T
from inkfall.operators import operations as O
from inkfall.operators import retrieval as R
from inkfall.operators import search as S
from inkfall.plans.query_language import Leaf, Op, leaves_of, read
from inkfall.sources.files import html_document
from inkfall.streaming import streams as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    """The test documents in the shape that search expects."""
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")), "yyyy-MM-dd")
    return t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("lang").alias("file_type"),
        F.col("text").alias("content"),
        F.col("source").alias("doc_author"),
        F.when(F.col("doc_id") % 7 != 0, day).alias("doc_created"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("2021-06-01"))).otherwise(F.array().cast("array<string>")).alias("detected_dates"),
    )


_DOCS = """docs AS (SELECT doc_id AS id, source || '/' || doc_id || '.txt' AS filename, lang AS file_type, text AS content, source AS doc_author,
    CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2020-01-01' + (doc_id % 1500)::INTEGER, '%Y-%m-%d') END AS doc_created,
    CASE WHEN doc_id % 5 = 0 THEN ['2021-06-01'] ELSE [] END AS detected_dates FROM documents)"""


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _leaf_sql(leaf: Leaf) -> str:
    def within(arr: str) -> str:
        if len(leaf.tokens) == 1:
            return f"len(list_filter({arr}, lambda x: x = '{leaf.tokens[0]}'))"
        tests = " AND ".join(f"{arr}[i + {j + 1}] = '{w}'" for j, w in enumerate(leaf.tokens))
        return f"len(list_filter(range(len({arr})), lambda i: {tests}))"

    return " + ".join(within({"content": "c", "filename": "f"}[x]) for x in ("filename", "content") if leaf.column in (None, x))


def _tree_sql(tree, at: dict) -> str:
    if isinstance(tree, Op):
        return f"({_tree_sql(tree.left, at)} {'AND NOT' if tree.kind == 'NOT' else tree.kind} {_tree_sql(tree.right, at)})"
    return f"({at[tree]} > 0)"


def search_sql(text: str, tail: str = "", columns: str = "id, round(score, 6) AS score", where: str = "TRUE") -> str:
    """The SQL of a query: term counts per document, then the same formula."""
    tree = read(text).tree
    leaves = leaves_of(tree)
    distinct = list(dict.fromkeys(leaves))
    at = {x: f"tf{i}" for i, x in enumerate(distinct)}
    parts = []
    for x in leaves:
        tf = at[x]
        idf = f"greatest(ln((n - d_{tf} + 0.5) / (d_{tf} + 0.5)), 0)"
        parts.append(f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END * {tf} * 2.2 / ({tf} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))")
    return f"""WITH {_DOCS},
a AS (SELECT *, {_tokens("content")} AS c, {_tokens("filename")} AS f FROM docs),
b AS (SELECT *, (len(c) + len(f))::DOUBLE AS dl, {", ".join(f"({_leaf_sql(x)})::DOUBLE AS {at[x]}" for x in distinct)} FROM a),
s AS (SELECT count(*)::DOUBLE AS n, sum(dl) / count(*) AS avgdl, {", ".join(f"(count(*) FILTER ({c} > 0))::DOUBLE AS d_{c}" for c in at.values())} FROM b),
hits AS (SELECT b.*, {" + ".join(parts)} AS score FROM b, s WHERE {_tree_sql(tree, at)} AND {where})
SELECT {columns} FROM hits {tail}"""


def _search(text: str) -> Callable:
    return lambda s, d: S.search(documents(s, d), text).select("id", F.round("score", 6).alias("score"))


for _name, _text in {
    "bm25_term": "thin",
    "bm25_and": "hein AND ering",
    "bm25_implicit_and": "hein ering",
    "bm25_or": "hein OR thin",
    "bm25_not": "(hein OR ering) NOT thin",
    "bm25_precedence": "hein OR ering AND thin",
    "bm25_phrase": '"of the"',
    "bm25_field": "filename:src3 AND thin",
    "bm25_repeated_term": "thin thin hein",
}.items():
    query(search_sql(_text), _name)(_search(_text))


@query(search_sql("hein OR ering", "ORDER BY round(score, 6) DESC, id LIMIT 20 OFFSET 20"))
def bm25_paged(s, d):
    hits = S.search(documents(s, d), "hein OR ering").select("id", F.round("score", 6).alias("score"))
    return S.page_of(hits, 2, 20)


@query(search_sql("hein OR ering", columns="count(*) AS total"))
def search_count(s, d):
    return S.total(S.search(documents(s, d), "hein OR ering"))


@query(f"WITH {_DOCS} SELECT id, 0.0::DOUBLE AS score FROM docs WHERE file_type = 'fr'")
def search_type_only(s, d):
    return S.search(documents(s, d), "type:.FR").select("id", "score")


@query(search_sql("thin", where="(doc_created BETWEEN '2021-01-01' AND '2021-12-31' OR len(list_filter(detected_dates, lambda x: starts_with(x, '2021'))) > 0) AND lower(doc_author) LIKE '%src1%'"))
def search_year_author(s, d):
    return S.search(documents(s, d), "thin year:2021 author:SRC1").select("id", F.round("score", 6).alias("score"))


@query(search_sql("thin", where="((doc_created >= '2022-01-01' OR len(list_filter(detected_dates, lambda x: starts_with(x, '2022'))) > 0) AND (doc_created <= '2023-01-01' OR doc_created IS NULL))"))
def search_after_before(s, d):
    return S.search(documents(s, d), "thin after:2022 before:2023").select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents WHERE FALSE")
def search_refused(s, d):
    """A query that the grammar refuses has no hits; neither has one of dates alone."""
    docs = documents(s, d)
    return S.search(docs, "foo-bar").unionByName(S.search(docs, "year:2021")).select("id", "score")


@query()
def bm25_stemmed(s, d):
    return S.search(documents(s, d), "things AND handing", stem=True).select("id", F.round("score", 6).alias("score"))


@query()
def bm25_near(s, d):
    return S.search(documents(s, d), "NEAR(hein thin, 20)").select("id", F.round("score", 6).alias("score"))


@query()
def snippets_page(s, d):
    page = S.page_of(S.search(documents(s, d), "hein OR ering"))
    return S.with_snippets(page, ["hein", "ering"]).select("id", F.array_join("snippets", "\n").alias("snippets"))


@query(f"WITH {_DOCS} SELECT DISTINCT filename FROM docs WHERE lower(filename) LIKE 'src1%' ORDER BY filename LIMIT 10")
def suggest_prefix(s, d):
    return S.suggest(documents(s, d), "SRC1", 10)


@query(f"WITH {_DOCS} SELECT id, filename, file_type, length(content) AS n_chars FROM docs WHERE id = 17")
def point_lookup(s, d):
    return documents(s, d).where("id = 17").select("id", "filename", "file_type", F.length("content").cast("long").alias("n_chars"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 150 THEN text WHEN strpos(reverse(text[1:150]), ' ') > 0 THEN text[1:150 - strpos(reverse(text[1:150]), ' ')]
|| '...' ELSE text[1:150] || '...' END AS snippet FROM documents""")
def head_snippet(s, d):
    return t(s, d, "documents").select("doc_id", T.head_snippet("text").alias("snippet"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi'), '(of)', '<mark>\\1</mark>', 'gi') AS marked
FROM documents""")
def highlight(s, d):
    return t(s, d, "documents").select("doc_id", T.highlight("text", ["the", "of"]).alias("marked"))


@query(
    f"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf
FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens("text")}) AS term FROM documents) GROUP BY ALL) GROUP BY term"""
)
def posting_stats(s, d):
    docs = t(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("filename"), F.col("text").alias("content"))
    return S.build_postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"))


# text


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\r\\n|\\r', chr(10), 'g'), ' +\\n', chr(10),
'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents""")
def normalize_whitespace(s, d):
    return t(s, d, "documents").select("doc_id", T.normalize_whitespace("text").alias("text"))


_LINE = " OR ".join(f"regexp_matches(x, '(?i){p}')" for p in T.BOILERPLATE)


@query(f"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT (length(trim(l)) BETWEEN 1 AND 2) AND NOT
({_LINE.replace('(x,', '(trim(l),')})), chr(10)) AS text FROM documents""")
def remove_boilerplate(s, d):
    return t(s, d, "documents").select("doc_id", T.remove_boilerplate("text").alias("text"))


@query("SELECT doc_id, replace(replace(replace(replace(text, 'ﬁ', 'fi'), '—', '-'), '…', '...'), chr(160), ' ') AS text FROM documents")
def fix_scan_characters(s, d):
    return t(s, d, "documents").select("doc_id", T.fix_scan_characters("text").alias("text"))


@query("SELECT doc_id, regexp_replace(text, '([\\p{L}\\p{N}_]+)-\\n([\\p{L}\\p{N}_]+)', '\\1\\2', 'g') AS text FROM documents")
def join_hyphenated(s, d):
    return t(s, d, "documents").select("doc_id", T.join_hyphenated("text").alias("text"))


@query()
def clean_text(s, d):
    return t(s, d, "documents").select("doc_id", T.clean_text("text").alias("text"))


@query()
def clean_sentences(s, d):
    return t(s, d, "documents").select("doc_id", F.posexplode(T.clean_sentences("text")).alias("n", "sentence"))


@query("""SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 1800.0))::BIGINT END AS
chunks, regexp_matches(text, '^[^a-z]*$') AS loud FROM documents""")
def size_estimates(s, d):
    return t(s, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"), T.chunk_estimate("text").alias("chunks"), F.col("text").rlike("^[^a-z]*$").alias("loud"))


@query("""SELECT doc_id, sha256(text) AS content_hash, substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS chunk_hash
FROM documents""")
def content_hashes(s, d):
    return t(s, d, "documents").select("doc_id", T.content_hash("text").alias("content_hash"), T.chunk_hash("text").alias("chunk_hash"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS text FROM documents")
def shortened_texts(s, d):
    return t(s, d, "documents").select("doc_id", T.shortened("text", 500).alias("text"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def html_title(s, d):
    return t(s, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query()
def html_text(s, d):
    return t(s, d, "pages").select("page_id", html_document("html").alias("d")).select("page_id", "d.title", "d.text")


@query()
def chunk_plain(s, d):
    return C.chunked(t(s, d, "documents"))


@query()
def chunk_sections(s, d):
    return C.chunked(t(s, d, "documents"), C.chunk_sections)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
FROM documents), b AS (SELECT doc_id, line_no, trim(line, ' ') AS bare FROM l)
SELECT doc_id, line_no::INTEGER AS line_no, CASE WHEN regexp_matches(bare, '^#{1,6}\\s+(.+)$') THEN regexp_extract(bare, '^#{1,6}\\s+(.+)$', 1) WHEN
regexp_matches(bare, '^([A-Z][A-Z\\s]+)$') THEN bare
WHEN regexp_matches(bare, '^\\d+\\.\\s+(.+)$') THEN regexp_extract(bare, '^\\d+\\.\\s+(.+)$', 1) WHEN regexp_matches(bare, '^[IVXLCDM]+\\.\\s+(.+)$')
THEN regexp_extract(bare, '^[IVXLCDM]+\\.\\s+(.+)$', 1) ELSE bare END AS title
FROM b WHERE regexp_matches(bare, '^#{1,6}\\s+(.+)$') OR regexp_matches(bare, '^([A-Z][A-Z\\s]+)$') OR regexp_matches(bare, '^\\d+\\.\\s+(.+)$') OR
regexp_matches(bare, '^[IVXLCDM]+\\.\\s+(.+)$') OR regexp_matches(bare, '^(?:Chapter|Section|Part)\\s+\\d+')""")
def section_headings(s, d):
    return C.headings(t(s, d, "documents"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
FROM documents),
c AS (SELECT doc_id, line_no, d AS delimiter, len(string_split(line, d)) AS n_cols FROM l, (SELECT unnest([chr(9), '|', ';', ',']) AS d)),
r AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, delimiter, n_cols ORDER BY line_no) AS run FROM c WHERE n_cols >= 2)
SELECT doc_id, delimiter, min(line_no)::INTEGER AS first_line, count(*) AS n_rows, n_cols
FROM r GROUP BY doc_id, delimiter, n_cols, run HAVING count(*) >= 3""")
def table_runs(s, d):
    return L.delimited_runs(t(s, d, "documents"))


@query()
def text_tables(s, d):
    rows = t(s, d, "documents").select("doc_id", F.posexplode(L.tables_in("text")).alias("n", "x"))
    return rows.select("doc_id", "n", "x.source", F.size("x.rows").alias("n_rows"), F.array_join("x.headers", " | ").alias("headers"))


@query()
def form_fields(s, d):
    return L.form_fields(t(s, d, "documents"))


# personal data and dates


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b'))::BIGINT AS emails, len(regexp_extract_all(text,
'\\b4\\d{3}[\\s-]?\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}\\b'))::BIGINT + len(regexp_extract_all(text,
'\\b5[1-5]\\d{2}[\\s-]?\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}\\b'))::BIGINT + len(regexp_extract_all(text,
'\\b3[47]\\d{2}[\\s-]?\\d{6}[\\s-]?\\d{5}\\b'))::BIGINT + len(regexp_extract_all(text,
'\\b6(?:011|5\\d{2})[\\s-]?\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}\\b'))::BIGINT AS cards, len(regexp_extract_all(text,
'\\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\b'))::BIGINT AS ips
FROM documents""")
def pii_counts(s, d):
    return t(s, d, "documents").select("doc_id", P.match_count("text", "email").alias("emails"), P.match_count("text", "credit_card").alias("cards"), P.match_count("text", "ip_address").alias("ips"))


@query()
def pii_valid_cards(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(P.valid_cards("text")).alias("card"))


@query("SELECT doc_id, regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b', '[EMAIL]', 'g') AS text FROM documents")
def pii_mask_emails(s, d):
    return t(s, d, "documents").select("doc_id", P.mask_emails("text").alias("text"))


@query()
def pii_spans(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(P.pii_spans("text")).alias("x")).select("doc_id", "x.*")


@query()
def pii_summary(s, d):
    found = t(s, d, "documents").select("doc_id", F.explode(P.pii_spans("text")).alias("x"))
    return found.groupBy("doc_id", F.col("x.kind").alias("kind")).agg(F.count("*").alias("n"), F.max("x.confidence").alias("most_sure"))


@query()
def pii_redacted(s, d):
    return t(s, d, "documents").select("doc_id", P.pii_redacted("text").alias("text"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dates FROM orders")
def detected_dates(s, d):
    text = F.concat(F.lit("Signed on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" and "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit("; filed "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t(s, d, "orders").select("o_orderkey", F.array_join(D.detected_dates(text), ",").alias("dates"))


# vectors and retrieval


def _vectors(s, d):
    return t(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.concat(F.lit("f"), F.col("label").cast("string")).alias("filename"), "embedding")


_QUERY = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]


@query(f"""SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), 6) AS score
FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]) DESC, vec_id LIMIT 10""")
def knn_cosine(s, d):
    return R.nearest(_vectors(s, d), _QUERY, 10).select("chunk_id", F.round("score", 6).alias("score"))


@query("""SELECT label AS doc_id, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) -
1)::INTEGER AS pos FROM embeddings) GROUP BY ALL""")
def doc_centroid(s, d):
    return R.centroids(_vectors(s, d)).select("doc_id", F.posexplode("centroid").alias("pos", "x")).select("doc_id", "pos", F.round("x", 6).alias("x"))


@query("""WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
FROM embeddings) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY label)
SELECT a.label AS doc_id, round(list_cosine_similarity(a.v, b.v), 3) AS similarity
FROM c a, c b WHERE b.label = 3 AND a.label <> 3 AND list_cosine_similarity(a.v, b.v) >= -0.5
ORDER BY list_cosine_similarity(a.v, b.v) DESC, a.label LIMIT 10""")
def similar_docs(s, d):
    return R.similar(_vectors(s, d), 3, 10, -0.5)


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT DISTINCT word, md5(word) AS h FROM c),
m AS (SELECT word, h, ((('0x' || h[1:16])::UBIGINT % 64)::HUGEINT * (18446744073709551616::HUGEINT % 64) + (('0x' || h[17:32])::UBIGINT % 64)) % 64 AS
r FROM h),
p AS (SELECT word, ((r + j * 7919) % 64)::INTEGER AS pos, ('0x' || h[31 - 2 * j : 32 - 2 * j])::INTEGER / 255.0::DOUBLE - 0.5 AS v
FROM m, (SELECT unnest([0, 1, 2]) AS j)),
x AS (SELECT doc_id, pos, sum(n * v) AS x FROM c JOIN p USING (word) GROUP BY ALL),
z AS (SELECT doc_id, sqrt(sum(x * x)) AS z FROM x GROUP BY doc_id)
SELECT doc_id, pos, round(x / z, 6) AS x FROM x JOIN z USING (doc_id) WHERE round(x / z, 6) <> 0""")
def hash_embedding(s, d):
    got = R.hashed_embeddings(t(s, d, "documents"), 64).select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    return got.select("doc_id", "pos", F.round("x", 6).alias("x")).where("x <> 0")


_HITS = search_sql("hein OR ering", "ORDER BY score DESC, id LIMIT 20", "id, score")


@query(f"""WITH v AS (SELECT 'v' || vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]) AS score
FROM embeddings ORDER BY score DESC, vec_id LIMIT 20),
k AS (SELECT 'doc_' || id AS chunk_id, score FROM ({_HITS})),
u AS (SELECT chunk_id, score / (SELECT max(score) FROM v) * 0.7 AS part
FROM v UNION ALL SELECT chunk_id, score / (SELECT max(score) FROM k) * 0.3
FROM k)
SELECT chunk_id, round(sum(part), 6) AS score FROM u GROUP BY chunk_id ORDER BY sum(part) DESC, chunk_id LIMIT 10""")
def hybrid_fusion(s, d):
    vectors = R.nearest(_vectors(s, d), _QUERY, 20).select(F.concat(F.lit("v"), F.col("chunk_id").cast("string")).alias("chunk_id"), "score")
    words = S.page_of(S.search(documents(s, d), "hein OR ering"), 1, 20).select(F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("chunk_id"), "score")
    return R.fused(vectors, words, k=10).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""SELECT chunk_id, rank, round(1.0 - 0.05 * (rank - 1), 6)::DOUBLE AS score
FROM (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]) DESC, vec_id)::INTEGER AS
rank FROM embeddings) WHERE rank <= 5""")
def rerank_passthrough(s, d):
    return R.pass_through(R.nearest(_vectors(s, d), _QUERY, 10), 5).select("chunk_id", "rank", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT conv_id, turn, '[Document: ' || role || ']' || chr(10) || text AS part FROM conversations),
u AS (SELECT *, sum(length(part) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM c)
SELECT conv_id, array_to_string(list(part ORDER BY turn DESC), chr(10) || '---' || chr(10)) AS context, count(*) AS n_chunks
FROM u WHERE used <= 200 GROUP BY conv_id""")
def context_pack(s, d):
    rows = t(s, d, "conversations").select("conv_id", F.col("turn").alias("score"), F.col("turn").alias("chunk_id"), F.col("role").alias("filename"), F.col("text").alias("content"))
    return R.packed_context(rows, 200, group="conv_id")


@query("""SELECT conv_id, array_to_string(list(text ORDER BY turn), ' ') || ' what now' AS query
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
FROM conversations WHERE role = 'user') WHERE back <= 2 GROUP BY conv_id""")
def conv_retrieval_query(s, d):
    return R.retrieval_query(t(s, d, "conversations"), "what now")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6""")
def conv_last6(s, d):
    return R.last_messages(t(s, d, "conversations")).select("conv_id", "turn", "role")


@query("""SELECT conv_id, array_to_string(list(upper(role[1]) || role[2:] || ': ' || text[1:300]
ORDER BY turn), chr(10)) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY conv_id""")
def conv_context(s, d):
    return R.conversation_context(t(s, d, "conversations"))


# relations and operations


@query("SELECT lang AS file_type, count(*) AS n FROM documents GROUP BY lang")
def stats_by_type(s, d):
    return t(s, d, "documents").groupBy(F.col("lang").alias("file_type")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS chunks, count(DISTINCT label) AS docs FROM embeddings")
def distinct_docs(s, d):
    return _vectors(s, d).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


@query("""SELECT sha256(text) AS hash, array_to_string(list(source || '/' || doc_id
ORDER BY source || '/' || doc_id), '|') AS paths, count(*) AS n FROM documents
GROUP BY 1 HAVING count(*) >= 2""")
def duplicate_content(s, d):
    docs = t(s, d, "documents").select(F.sha2("text", 256).alias("hash"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return O.duplicates(docs)


@query("""SELECT sum(n)::BIGINT AS documents, count(*) AS distinct_contents, count(*) FILTER (n > 1) AS duplicated_contents, sum(n - 1)::BIGINT AS redundant
FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text))""")
def dedup_stats(s, d):
    return O.duplicate_stats(t(s, d, "documents").select(F.sha2("text", 256).alias("hash")))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS
chunk_index FROM documents)
SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY line ORDER BY doc_id, chunk_index) = 1 AS first FROM c""")
def chunk_first_owner(s, d):
    rows = t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    return O.first_owners(rows.withColumn("chunk_hash", F.sha2("line", 256))).select("doc_id", "chunk_index", "first")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w AS version, coalesce(o_orderstatus <> lag(o_orderstatus) OVER w, TRUE) AS changed
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def version_history(s, d):
    rows = t(s, d, "orders").withColumn("ts", F.struct("o_orderdate", "o_orderkey"))
    return O.versions(rows, "o_custkey", "ts", "o_orderstatus").select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"), "changed")


@query("SELECT d.doc_id, d.source, l.quality, length(d.text) AS n FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_metadata(s, d):
    return t(s, d, "documents").join(t(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "source", "quality", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_without_chunks(s, d):
    return O.orphans(t(s, d, "documents"), t(s, d, "labels"), "doc_id").select("doc_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(s, d):
    return t(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 10")
def shortest_docs(s, d):
    return t(s, d, "documents").orderBy("n_chars", "doc_id").limit(10).select("doc_id", "n_chars")


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE filename LIKE '%7.txt' AND file_type = 'de'")
def suffix_of_type(s, d):
    return documents(s, d).where(F.col("filename").endswith("7.txt") & (F.col("file_type") == "de")).select("id")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) > 5000 THEN 'chars' END, CASE WHEN length(text) // 4 > 1000 THEN 'tokens' END, CASE
WHEN greatest(1, ceil(length(text) / 1800.0)) > 3 THEN 'chunks' END], lambda x: x IS NOT NULL), ',') AS violations
FROM documents""")
def guardrail_violations(s, d):
    from inkfall.config import Settings

    out = O.guardrails(t(s, d, "documents"), s=Settings(max_chars=5000, max_tokens=1000, max_chunks=3))
    return out.select("doc_id", F.array_join("violations", ",").alias("violations"))


def _held(s, d):
    short = t(s, d, "documents").where("n_chars < 400")
    return short.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("too short in "), F.col("lang")).alias("reason"), F.when(F.col("n_chars") < 100, "extract").otherwise("chunk").alias("stage"), (F.col("doc_id") % 3 != 0).alias("recoverable"))


_HELD = "q AS (SELECT 'too short in ' || lang AS reason, CASE WHEN n_chars < 100 THEN 'extract' ELSE 'chunk' END AS stage, doc_id % 3 <> 0 AS recoverable FROM documents WHERE n_chars < 400)"


@query(f"""WITH {_HELD} SELECT 'total' AS kind, '' AS name, count(*) AS n FROM q UNION ALL SELECT 'recoverable', '', count(*)
FROM q WHERE recoverable UNION ALL SELECT 'stage', stage, count(*) FROM q
GROUP BY stage UNION ALL SELECT 'reason', reason[1:50], count(*) FROM q
GROUP BY reason""")
def quarantine_stats(s, d):
    return O.quarantine_stats(_held(s, d))


_EVENTS = "e AS (SELECT event_id, ts, event_type, user_id, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS warnings FROM events)"


def _metrics(s, d):
    e = M.with_timestamps(t(s, d, "events"))
    return e.select("event_id", "ts", "event_type", "user_id", "value", "props", F.col("value").alias("total_ms"), (F.col("event_type") == "error").cast("int").alias("errors"), (F.col("event_type") == "signup").cast("int").alias("warnings"), F.lit(None).cast("double").alias("ocr_confidence"))


@query(f"""WITH {_EVENTS} SELECT count(*) AS documents, round(coalesce(avg(value), 0), 6) AS avg_ms, coalesce(sum(errors), 0)::BIGINT AS errors,
coalesce(sum(warnings), 0)::BIGINT AS warnings FROM e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'""")
def metrics_window_stats(s, d):
    return O.window_stats(_metrics(s, d), "2024-01-10", "2024-01-11").select("documents", F.round("avg_ms", 6).alias("avg_ms"), "errors", "warnings")


@query(f"""WITH {_EVENTS} SELECT round(coalesce(count(*) FILTER (errors > 0) / nullif(count(*), 0), 0.0), 9) AS error_rate
FROM e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'""")
def error_rate(s, d):
    return O.error_rate(_metrics(s, d), "2024-01-10", "2024-01-11").select(F.round("error_rate", 9).alias("error_rate"))


@query("SELECT event_type AS service, sum((props->>'$.k')::BIGINT)::BIGINT AS tokens, round(sum(value), 4) AS cost FROM events GROUP BY 1")
def cost_by_service(s, d):
    rows = t(s, d, "events").select(F.col("event_type").alias("service"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("cost"))
    return O.cost_by_service(rows).select("service", "tokens", F.round("cost", 4).alias("cost"))


@query("""SELECT date_trunc('day', ts)::DATE AS day, avg((event_type = 'error')::INTEGER) AS rate, CASE WHEN avg((event_type = 'error')::INTEGER) >= 0.3 THEN
'critical' WHEN avg((event_type = 'error')::INTEGER) >= 0.1 THEN 'warning' END AS severity
FROM events GROUP BY 1""")
def alerts_ladder(s, d):
    rows = _metrics(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.avg("errors").alias("rate"))
    return rows.withColumn("severity", O.severity("error_rate", F.col("rate")))


@query("""WITH RECURSIVE a AS (SELECT user_id % 20 AS key, event_id, ts, row_number() OVER (PARTITION BY user_id % 20
ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
f AS (SELECT key, event_id, n, ts AS last, TRUE AS emitted FROM a WHERE n = 1
UNION ALL SELECT a.key, a.event_id, a.n, CASE WHEN a.ts - f.last >= INTERVAL 600 MINUTE THEN a.ts ELSE f.last END, a.ts - f.last >= INTERVAL 600
MINUTE FROM f JOIN a ON a.key = f.key AND a.n = f.n + 1)
SELECT key, event_id FROM f WHERE emitted""")
def alert_dedupe(s, d):
    rows = _metrics(s, d).where("errors = 1").select((F.col("user_id") % 20).alias("key"), "ts", "event_id")
    return O.deduplicated_alerts(rows, minutes=600).select("key", "event_id")


@query("""SELECT 'severity' AS kind, CASE WHEN value > 50 THEN 'critical' ELSE 'warning' END AS name, count(*) AS n
FROM events GROUP BY 2 UNION ALL SELECT 'type', event_type, count(*) FROM events
GROUP BY 2 UNION ALL SELECT 'unresolved', '', count(*) FROM events WHERE event_id % 3 <> 0""")
def alert_stats(s, d):
    rows = t(s, d, "events").select(F.when(F.col("value") > 50, "critical").otherwise("warning").alias("severity"), F.col("event_type").alias("alert_type"), (F.col("event_id") % 3 == 0).alias("resolved"))
    return O.alert_stats(rows)


_JOBS = "j AS (SELECT o_orderkey AS id, CASE o_orderpriority[1] WHEN '1' THEN 100 WHEN '2' THEN 50 ELSE 0 END AS priority, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderkey % 4 AS attempts, 3 AS max_attempts, o_orderdate AS created_at FROM orders)"


def _jobs(s, d):
    first = F.substring("o_orderpriority", 1, 1)
    return t(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(first == "1", 100).when(first == "2", 50).otherwise(0).alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
        (F.col("o_orderkey") % 4).alias("attempts"), F.lit(3).alias("max_attempts"), F.col("o_orderdate").alias("created_at"),
    )


@query(f"WITH {_JOBS} SELECT id, priority FROM j WHERE status = 'pending' AND attempts < max_attempts ORDER BY priority DESC, created_at, id LIMIT 1")
def queue_dequeue(s, d):
    return O.next_jobs(_jobs(s, d)).select("id", "priority")


@query(f"""WITH {_JOBS} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status =
'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total
FROM j""")
def queue_stats(s, d):
    return O.queue_stats(_jobs(s, d))


@query(f"""WITH {_JOBS}, r AS (SELECT id AS r, id % 2 = 0 AS ok FROM j WHERE status = 'pending' AND id % 3 = 0) SELECT id, CASE WHEN ok IS NULL THEN status WHEN
ok THEN 'completed' WHEN attempts < max_attempts THEN 'pending' ELSE 'failed' END AS status, attempts + (ok IS NOT NULL)::INTEGER AS attempts
FROM j LEFT JOIN r ON id = r""")
def queue_finish(s, d):
    jobs = _jobs(s, d)
    results = jobs.where((F.col("status") == "pending") & (F.col("id") % 3 == 0)).select("id", (F.col("id") % 2 == 0).alias("ok"))
    return O.finished(jobs, results).select("id", "status", "attempts")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def audit_recent(s, d):
    return O.filtered(t(s, d, "events").select("ts", "event_id", "event_type"), since=F.lit("2024-01-05").cast("timestamp_ntz"), limit=50, event_type="error").select("event_id", "event_type")


@query("""SELECT event_id, substr(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 16) AS checksum
FROM events""")
def audit_checksum(s, d):
    return O.with_checksum(t(s, d, "events"), ["event_id", "event_type", "user_id"]).select("event_id", "checksum")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_merge(s, d):
    old = t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return O.upsert(old, old.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_cascade(s, d):
    gone = t(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return O.without(t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def retention_cleanup(s, d):
    return O.kept_since(t(s, d, "events"), F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def recent_page(s, d):
    return t(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_orderdate")


@query("SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM orders")
def page_total(s, d):
    return O.page_count(t(s, d, "orders"), 20)


@query("""WITH v AS (SELECT 'l_quantity' AS "column", l_quantity::VARCHAR AS value, 'number' AS kind
FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag, 'text' FROM lineitem
UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, 'number' FROM lineitem)
SELECT "column", count(*) AS non_empty, any_value(kind) AS kind, count(DISTINCT value) AS distinct_values, list(DISTINCT value
ORDER BY value)[1:5] AS samples FROM v WHERE value IS NOT NULL GROUP BY 1""")
def column_profile(s, d):
    return O.column_profile(t(s, d, "lineitem"), ["l_quantity", "l_returnflag", "l_linenumber"])


@query("""SELECT doc_id, CASE WHEN n_chars / 10000.0 > 0.85 THEN 'high' WHEN n_chars / 10000.0 > 0.6 THEN 'medium' ELSE 'low' END AS level, CASE WHEN n_chars <
50 THEN CASE WHEN doc_id % 10 / 10.0 > 0.3 THEN 'scanned' ELSE 'unknown' END WHEN doc_id % 10 / 10.0 > 0.5 AND n_chars < 500 THEN 'scanned' WHEN
doc_id % 10 / 10.0 > 0.3 AND n_chars > 100 THEN 'mixed' ELSE 'digital' END AS page_class
FROM documents""")
def page_rules(s, d):
    rows = t(s, d, "documents").withColumn("ratio", F.col("doc_id") % 10 / 10.0)
    return rows.select("doc_id", T.confidence_level(F.col("n_chars") / 10000.0).alias("level"), T.page_class("n_chars", "ratio").alias("page_class"))


@query("""WITH h AS (SELECT (n_chars % 256)::INTEGER AS level, count(*)::DOUBLE AS n FROM documents GROUP BY 1),
c AS (SELECT level, sum(n) OVER u AS w0, sum(n * level) OVER u AS s0, sum(n) OVER () AS w, sum(n * level) OVER () AS s
FROM h WINDOW u AS (ORDER BY level))
SELECT level AS threshold FROM c WHERE w0 < w ORDER BY w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) DESC, level LIMIT 1""")
def otsu(s, d):
    rows = t(s, d, "documents").groupBy((F.col("n_chars") % 256).cast("int").alias("level")).agg(F.count("*").alias("n"))
    return L.otsu_threshold(rows)


# streams and their tables


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (event_type = 'error') AS
errors FROM events GROUP BY 1, 2""")
def tumbling_day(s, d):
    got = M.tumbling(M.with_timestamps(t(s, d, "events")), "1 day")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "errors")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, event_type FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL""")
def sliding_day(s, d):
    got = M.tumbling(M.with_timestamps(t(s, d, "events")), "24 hours", slide="6 hours")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id
ORDER BY ts) >= INTERVAL 6 HOUR, TRUE)::INTEGER AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id
ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(s, d):
    got = M.sessions(M.with_timestamps(t(s, d, "events")), "6 hours")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (ORDER BY ts, event_id) >= INTERVAL 10 MINUTE, TRUE)::INTEGER AS new
FROM events), s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spell
FROM g)
SELECT spell::BIGINT AS spell, user_id % 50 AS path, arg_max(event_type, (ts, event_id)) AS event FROM s GROUP BY 1, 2""")
def debounce_sessions(s, d):
    rows = M.with_timestamps(t(s, d, "events")).withColumn("path", F.col("user_id") % 50)
    return M.debounced_table(rows, 600)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    """The same day windows, run as a stream over the table's files to its end."""
    name = f"tumbling_{uuid.uuid4().hex}"
    stream = M.event_stream(s, f"{d}/events*.parquet", t(s, d, "events"))
    folder = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if not folder:
        if not s.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp()}"
    M.run_available(M.tumbling(stream, "1 day"), name, f"{folder}/{name}")
    return s.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query()
def entry_search(s, d):
    """The flagship: a boolean query, ranked, paged and with the head of each hit."""
    hits = S.page_of(S.search(documents(s, d), "(hein OR ering) NOT thin"))
    return hits.select("id", "filename", "file_type", F.round("score", 6).alias("score"), T.head_snippet("content").alias("snippet"))


ORACLES["entry_search"] = search_sql("(hein OR ering) NOT thin", "ORDER BY score DESC, id LIMIT 20", "id, filename, file_type, round(score, 6) AS score, CASE WHEN length(content) <= 150 THEN content WHEN strpos(reverse(content[1:150]), ' ') > 0 THEN content[1:150 - strpos(reverse(content[1:150]), ' ')] || '...' ELSE content[1:150] || '...' END AS snippet")

from inkfall import queries_ops as _more  # noqa: E402, F401  registers the rest
