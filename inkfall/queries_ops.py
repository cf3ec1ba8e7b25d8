"""More of the library's operators as queries, each with its SQL: registers, quarantine, alerts, audit, layout, indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfall.config import Settings
from inkfall.functions import chunks as C
from inkfall.functions import dates as D
from inkfall.functions import layout as L
from inkfall.functions import pii as P
from inkfall.functions import text as T
from inkfall.operators import operations as O
from inkfall.operators import retrieval as R
from inkfall.operators import search as S
from inkfall.queries import _DOCS, _EVENTS, _HELD, _JOBS, _QUERY, _held, _jobs, _metrics, _tokens, _vectors, documents, query, search_sql, t
from inkfall.sources.files import delimited_text

_JOBS_SQL = _JOBS.removeprefix("j AS (").removesuffix(")")

# search over a written index


@query(search_sql("hein OR ering", "ORDER BY score DESC, id LIMIT 20", "id, filename, round(score, 6) AS score, length(content) AS n_chars"))
def indexed_search_page(s, d):
    """A page from postings and lengths that are made once; the texts come in after the limit."""
    docs = documents(s, d)
    page = S.search_page(docs, "hein OR ering", postings=S.build_postings(docs), lengths=S.doc_lengths(docs))
    return page.select("id", "filename", F.round("score", 6).alias("score"), F.length("content").cast("long").alias("n_chars"))


@query(f"""WITH {_DOCS}, a AS (SELECT id, 'content' AS col, {_tokens("content")} AS w
FROM docs UNION ALL SELECT id, 'filename', {_tokens("filename")} FROM docs),
p AS (SELECT id AS doc_id, col, unnest(w) AS term, (generate_subscripts(w, 1) - 1)::INTEGER AS pos FROM a)
SELECT doc_id, col, term, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM p GROUP BY ALL""")
def postings(s, d):
    return S.build_postings(documents(s, d)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("""WITH p AS (SELECT doc_id, unnest(['the', 'of']) AS term, lower(text) AS low, text FROM documents),
q AS (SELECT doc_id, term, string_split(low, term) AS parts FROM p),
r AS (SELECT doc_id, term, parts, unnest(range(1, len(parts))) AS n FROM q)
SELECT doc_id, term, (list_sum(list_transform(parts[1:n], lambda x: length(x))) + (n - 1) * length(term))::INTEGER AS position FROM r""")
def match_positions(s, d):
    found = t(s, d, "documents").select("doc_id", F.explode(S.match_positions("text", ["the", "of"])).alias("m"))
    return found.select("doc_id", "m.term", "m.position")


# registers of documents and chunks


@query("""SELECT p_partkey AS doc_id, count(ps.l_orderkey) AS n_chunks FROM part LEFT JOIN lineitem ps ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY 1""")
def chunk_counts(s, d):
    parts = t(s, d, "part").select(F.col("p_partkey").alias("doc_id"))
    return O.with_counts(parts, t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("doc_id")), "doc_id")


@query("""WITH f AS (SELECT unnest(['src1', 'src2/', 'nowhere']) AS folder)
SELECT folder, count(doc_id) AS files, coalesce(sum(n_chars), 0)::BIGINT AS bytes
FROM f LEFT JOIN documents ON starts_with(source || '/' || doc_id, rtrim(folder, '/') || '/')
GROUP BY folder""")
def folder_counts(s, d):
    files = t(s, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"))
    return O.folder_counts(files, ["src1", "src2/", "nowhere"])


@query("""WITH b AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN
'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS event
FROM b FULL JOIN a ON a.path = b.path WHERE b.path IS NULL OR a.path IS NULL OR a.h <> b.h""")
def file_changes(s, d):
    files = t(s, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    after = files.where("path % 3 <> 0").withColumn("hash", F.when(F.col("path") % 7 == 0, "x").otherwise(F.col("hash")))
    return O.file_changes(files.where("path % 5 <> 0"), after)


@query("""SELECT doc_id, n FROM (SELECT doc_id, sha256(text) AS h, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n >= 3""")
def frequent_contents(s, d):
    docs = t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return O.occurrences(docs, least=3).select("doc_id", "n")


def _register(s, d):
    known = t(s, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderkey").cast("string").alias("hash"))
    at = F.lit("2024-01-01").cast("timestamp")
    first = O.latest(known, ["path"], ["hash"])
    return first.select("path", "hash", "content_hash", F.lit(1).alias("version"), at.alias("created_at"), at.alias("updated_at"))


_REGISTER = "r AS (SELECT o_custkey AS path, max(o_orderkey::VARCHAR) AS hash, arg_max(o_orderstatus, o_orderkey::VARCHAR) AS content_hash FROM orders GROUP BY 1)"


@query(f"""WITH {_REGISTER}, n AS (SELECT c_custkey AS path, 'new' AS hash, c_mktsegment AS content_hash FROM customer WHERE c_custkey % 4 = 0)
SELECT coalesce(n.path, r.path) AS path, coalesce(n.content_hash, r.content_hash) AS content_hash, ((r.path IS NOT NULL)::INTEGER + (n.path IS NOT
NULL)::INTEGER) AS version,
    n.path IS NOT NULL AS fresh, r.path IS NULL OR n.path IS NULL AS once FROM r FULL JOIN n ON r.path = n.path""")
def register_documents(s, d):
    new = t(s, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("path"), F.lit("new").alias("hash"), F.col("c_mktsegment").alias("content_hash"))
    got = O.registered(_register(s, d), new, F.lit("2024-02-01").cast("timestamp"))
    return got.select("path", "content_hash", "version", (F.col("updated_at") > "2024-01-15").alias("fresh"), (F.col("created_at") == F.col("updated_at")).alias("once"))


@query(f"WITH {_REGISTER} SELECT content_hash, count(DISTINCT path)::INTEGER AS occurrence_count, min(path) AS first_path FROM r GROUP BY 1")
def content_register(s, d):
    return O.content_index(_register(s, d)).select("content_hash", "occurrence_count", F.get("paths", F.lit(0)).alias("first_path"))


@query(f"""WITH {_REGISTER}, k AS (SELECT * FROM r WHERE content_hash <> 'P') SELECT 'document' AS kind, count(*) AS n FROM k
UNION ALL SELECT 'chunk', count(*) FROM orders WHERE o_custkey IN (SELECT path FROM k)""")
def remove_documents(s, d):
    register = _register(s, d)
    left, chunks = O.removed(register, t(s, d, "orders").select(F.col("o_custkey").alias("path")), register.where("content_hash = 'P'"))
    return left.agg(F.lit("document").alias("kind"), F.count("*").alias("n")).unionByName(chunks.agg(F.lit("chunk").alias("kind"), F.count("*").alias("n")))


@query("""WITH n AS (SELECT o_custkey AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT c_custkey AS k, 'old' AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM n) UNION ALL SELECT k, v FROM n""")
def upsert_last(s, d):
    """New rows that share a key: the last one stays."""
    old = t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    new = t(s, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), "o_orderdate", "o_orderkey")
    return O.upsert(old, new, ["k"], ["o_orderdate", "o_orderkey"]).select("k", "v")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT CASE WHEN doc_id % 50 <> 0 THEN doc_id END FROM labels)")
def orphans_of_null(s, d):
    """A null among the parents leaves no orphan."""
    labels = t(s, d, "labels").select(F.when(F.col("doc_id") % 50 != 0, F.col("doc_id")).alias("doc_id"))
    return O.orphans(t(s, d, "documents").select("doc_id"), labels, "doc_id")


@query("""SELECT doc_id, length(text) AS n_chars, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n_words
FROM documents""")
def listing(s, d):
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    return t(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), words.cast("long").alias("n_words"))


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE lower(filename) LIKE '%c1/%' AND file_type = 'en' ORDER BY lower(filename), id LIMIT 50")
def client_filter(s, d):
    return documents(s, d).where(F.lower("filename").contains("c1/") & (F.col("file_type") == "en")).orderBy(F.lower("filename"), "id").limit(50).select("id")


# guardrails and quarantine


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice * 100 > 20000000 THEN 'file_bytes' END, CASE WHEN o_orderkey % 13 > 8 THEN
'pages' END, CASE WHEN o_orderkey % 7 > 5 THEN 'seconds' END,
CASE WHEN o_orderkey % 5 > 3 THEN 'sheets' END, CASE WHEN o_orderkey % 11 > 9 THEN 'rows_per_sheet' END, CASE WHEN o_orderkey % 17 > 14 THEN
'ocr_pages' END, CASE WHEN o_orderkey % 19 > 17 THEN 'cost_usd' END], lambda x: x IS NOT NULL), ',') AS violations
FROM orders""")
def guardrail_columns(s, d):
    """The limits that a table's columns are held against, beside those of its text."""
    key = F.col("o_orderkey")
    rows = t(s, d, "orders").select(
        "o_orderkey", F.lit("").alias("text"), (F.col("o_totalprice") * 100).alias("file_bytes"), (key % 13).alias("pages"), (key % 7).alias("seconds"), (key % 5).alias("sheets"),
        (key % 11).alias("rows_per_sheet"), (key % 17).alias("ocr_pages"), (key % 19).alias("cost_usd"),
    )
    limits = Settings(max_file_bytes=20_000_000, max_pages=8, max_seconds=5, max_sheets=3, max_rows_per_sheet=9, max_ocr_pages=14, max_cost_usd=17)
    return O.guardrails(rows, s=limits).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


_HELD_ROWS = _HELD.replace("SELECT 'too short", "SELECT doc_id::VARCHAR AS path, doc_id AS ts, 'too short")


def _held_rows(s, d):
    return _held(s, d).withColumn("ts", F.col("path").cast("long"))


@query(f"WITH {_HELD_ROWS} SELECT path FROM q WHERE recoverable AND stage = 'chunk' ORDER BY ts, path LIMIT 15")
def quarantine_list(s, d):
    return O.quarantined(_held_rows(s, d), True, "chunk", 15).select("path")


@query(f"WITH {_HELD_ROWS} SELECT path, recoverable AND ts % 4 <> 1 AS recoverable, ts % 4 = 1 AS skipped FROM q WHERE ts % 4 <> 0")
def quarantine_release_skip(s, d):
    held = _held_rows(s, d)
    left = O.skipped_for_good(O.released(held, held.where("ts % 4 = 0")), held.where("ts % 4 = 1"), F.lit("2024-01-01").cast("timestamp"))
    return left.select("path", "recoverable", F.col("skipped_at").isNotNull().alias("skipped"))


_PROGRESS = "p AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'embedding' END AS stage, o_orderkey % 5 AS retry_count FROM orders)"


@query(f"""WITH {_PROGRESS} SELECT 'total' AS kind, '' AS name, count(*) AS n FROM p UNION ALL SELECT 'stage', stage, count(*) FROM p GROUP BY stage
UNION ALL SELECT 'incomplete', '', count(*) FROM p WHERE stage = 'embedding' UNION ALL SELECT 'failed', '', count(*) FROM p WHERE stage = 'failed'
UNION ALL SELECT 'resumable', '', count(*) FROM p WHERE stage = 'embedding' OR (stage = 'failed' AND retry_count < 3)""")
def progress_stats(s, d):
    stage = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("embedding")
    return O.progress_stats(t(s, d, "orders").select(stage.alias("stage"), (F.col("o_orderkey") % 5).alias("retry_count")))


@query(f"""WITH {_PROGRESS} SELECT stage, retry_count, count(*) AS n FROM p WHERE stage = 'embedding' OR (stage = 'failed' AND retry_count < 3)
GROUP BY ALL""")
def resumable_work(s, d):
    stage = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("embedding")
    return O.resumable(t(s, d, "orders").select(stage.alias("stage"), (F.col("o_orderkey") % 5).alias("retry_count"))).groupBy("stage", "retry_count").agg(F.count("*").alias("n"))


# metrics, alerts, audit


@query("""WITH m AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'error_rate' WHEN 1 THEN 'queue' WHEN 2 THEN 'cost' WHEN 3 THEN 'chunks' ELSE
'failures' END AS kind,
CASE event_id % 5 WHEN 0 THEN value / 100 WHEN 1 THEN value * 8 WHEN 2 THEN value WHEN 3 THEN value * 20 ELSE value / 20 END AS measure
FROM events),
a AS (SELECT id, kind, CASE kind WHEN 'error_rate' THEN CASE WHEN measure >= 0.3 THEN 'critical' WHEN measure >= 0.1 THEN 'warning' END WHEN 'queue'
THEN CASE WHEN measure >= 500 THEN 'critical' WHEN measure >= 100 THEN 'warning' END
WHEN 'cost' THEN CASE WHEN measure >= 50 THEN 'critical' WHEN measure >= 10 THEN 'warning' END WHEN 'chunks' THEN CASE WHEN measure >= 1000 THEN
'warning' END ELSE CASE WHEN measure >= 3 THEN 'error' END END AS severity
FROM m)
SELECT * FROM a WHERE severity IS NOT NULL""")
def alert_rules(s, d):
    rest, value = F.col("event_id") % 5, F.col("value")
    kind = F.when(rest == 0, "error_rate").when(rest == 1, "queue").when(rest == 2, "cost").when(rest == 3, "chunks").otherwise("failures")
    measure = F.when(rest == 0, value / 100).when(rest == 1, value * 8).when(rest == 2, value).when(rest == 3, value * 20).otherwise(value / 20)
    return O.alerts_raised(t(s, d, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), measure.alias("measure"))).select("id", "kind", "severity")


def _alerts(s, d):
    return t(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 == 0).alias("resolved"), F.col("event_type").alias("alert_type"))


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 168 HOUR AND event_id % 3 <> 0
ORDER BY ts DESC, event_id LIMIT 100""")
def active_alerts(s, d):
    return O.active_alerts(_alerts(s, d), F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 OR ts >= TIMESTAMP '2024-01-20'")
def alerts_cleanup(s, d):
    return O.alerts_kept(_alerts(s, d), F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("SELECT event_id, event_id % 3 = 0 OR event_id % 4 = 0 AS resolved, CASE WHEN event_id % 4 = 0 THEN 'seen' END AS note FROM events")
def alerts_resolve(s, d):
    rows = _alerts(s, d).withColumns({"id": F.col("event_id"), "resolved_at": F.lit(None).cast("timestamp"), "note": F.lit(None).cast("string")})
    return O.resolved(rows, rows.where("id % 4 = 0"), "seen", F.lit("2024-01-01").cast("timestamp")).select("event_id", "resolved", "note")


@query("""SELECT 'total' AS kind, '' AS name, count(*) AS n FROM events UNION ALL SELECT 'errors', '', count(*)
FROM events WHERE event_type = 'error' UNION ALL SELECT 'action', event_type, count(*)
FROM events GROUP BY 2""")
def audit_stats(s, d):
    return O.audit_stats(t(s, d, "events").select(F.col("event_type").alias("action"), (F.col("event_type") != "error").alias("success")))


@query(f"""WITH {_EVENTS} SELECT count(*) AS documents, count(*) FILTER (errors = 0) AS succeeded, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) *
3.6e9, 6) AS docs_per_hour FROM e""")
def session_counters(s, d):
    return O.session_stats(_metrics(s, d)).select("documents", "succeeded", F.round("docs_per_hour", 6).alias("docs_per_hour"))


@query("""SELECT o_orderkey, round(100.0 * (o_orderkey % 50) / 80, 6)::DOUBLE AS percent, round((o_orderkey % 50) / 7.0, 6)::DOUBLE AS rate, CASE WHEN
o_orderkey % 50 > 0 THEN round((80 - o_orderkey % 50) / ((o_orderkey % 50) / 7.0), 6)::DOUBLE END AS eta_s
FROM orders""")
def session_progress(s, d):
    rows = t(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).alias("processed"), F.lit(80).alias("total"), F.lit(7.0).alias("seconds"))
    return O.progress_of(rows).select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("percent", "rate", "eta_s")])


# pages and layout


def _boxes(s, d):
    line = F.col("l_linenumber")
    return t(s, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), line.alias("block_num"), (F.col("l_discount") * 10).alias("confidence"), (line * 7 % 40).cast("double").alias("y"), (line * 13 % 29).cast("double").alias("x"), F.concat("l_returnflag", "l_linestatus").alias("text"))


@query("""SELECT l_orderkey AS page_id, count(DISTINCT l_linenumber) AS block_count, count(*) AS word_count, round(avg(l_discount * 10)::DOUBLE, 9) AS
avg_word_confidence FROM lineitem GROUP BY 1""")
def layout_summary(s, d):
    return L.layout_summary(_boxes(s, d)).withColumn("avg_word_confidence", F.round("avg_word_confidence", 9))


@query("""SELECT l_orderkey AS doc_id, round(avg(CASE WHEN l_linenumber % 4 <> 0 THEN l_discount * 10 END)::DOUBLE, 9) AS avg_ocr_confidence,
array_to_string(coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (l_linenumber % 4 <> 0 AND l_discount * 10 <= 0.6), []), ',') AS low_pages
FROM lineitem GROUP BY 1""")
def page_confidence(s, d):
    pages = t(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_discount") * 10).alias("confidence"))
    return L.page_confidence(pages).select("doc_id", F.round("avg_ocr_confidence", 9).alias("avg_ocr_confidence"), F.array_join(F.col("low_pages").cast("array<string>"), ",").alias("low_pages"))


@query("""WITH RECURSIVE b AS (SELECT l_orderkey AS page_id, (l_linenumber * 7 % 40)::DOUBLE AS y, (l_linenumber * 13 % 29)::DOUBLE AS x, l_returnflag ||
l_linestatus AS text,
row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber * 7 % 40), (l_linenumber * 13 % 29), l_returnflag || l_linestatus) AS n
FROM lineitem),
w AS (SELECT *, y AS first, 0 AS line FROM b WHERE n = 1 UNION ALL SELECT b.*, CASE WHEN abs(b.y - w.first) <= 10 THEN w.first ELSE b.y END, w.line +
(abs(b.y - w.first) > 10)::INTEGER FROM w JOIN b ON b.page_id = w.page_id AND b.n = w.n + 1)
SELECT page_id, line::INTEGER AS line, array_to_string(list(text ORDER BY x, text), ' ') AS text FROM w GROUP BY page_id, line""")
def lines_of_words(s, d):
    return L.lines_of_words(_boxes(s, d))


@query("""WITH h AS (SELECT doc_id, text[1:2000] AS head FROM documents), p AS (SELECT unnest([0, 1]) AS p),
f AS (SELECT doc_id, p, unnest(CASE p WHEN 0 THEN regexp_extract_all(head, '[A-Za-z][A-Za-z\\s]+:\\s*.+')[1:20] ELSE regexp_extract_all(head,
'[A-Za-z][A-Za-z\\s]+\\s{2,}.+')[1:20] END) AS x FROM h, p),
g AS (SELECT doc_id, CASE p WHEN 0 THEN regexp_extract(x, '([A-Za-z][A-Za-z\\s]+):\\s*(.+)', 1) ELSE regexp_extract(x,
'([A-Za-z][A-Za-z\\s]+)\\s{2,}(.+)', 1) END AS key,
CASE p WHEN 0 THEN regexp_extract(x, '([A-Za-z][A-Za-z\\s]+):\\s*(.+)', 2) ELSE regexp_extract(x, '([A-Za-z][A-Za-z\\s]+)\\s{2,}(.+)', 2) END AS value
FROM f)
SELECT doc_id, trim(key, ' \t\n\r') AS key, trim(value, ' \t\n\r') AS value
FROM g WHERE length(trim(key, ' \t\n\r')) BETWEEN 3 AND 49 AND trim(value, ' \t\n\r') <> ''""".replace("\t", "' || chr(9) || '").replace("\n\r", "' || chr(10) || chr(13) || '"))
def page_key_values(s, d):
    return t(s, d, "documents").select("doc_id", F.inline(L.key_values("text")))


# vectors and retrieval


@query("""WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY pos) AS v
FROM m GROUP BY label),
k AS (SELECT a.label AS doc_id, list_cosine_similarity(a.v, b.v) AS sim
FROM c a, c b WHERE b.label = 3 AND a.label <> 3 AND list_cosine_similarity(a.v, b.v) >= -0.5
ORDER BY sim DESC, a.label LIMIT 10)
SELECT k.doc_id, round(sim, 3) AS similarity, n_chars FROM k LEFT JOIN documents USING (doc_id)""")
def similar_docs_details(s, d):
    return R.with_details(R.similar(_vectors(s, d), 3, 10, -0.5), t(s, d, "documents"), ["n_chars"])


@query("""WITH n AS (SELECT vec_id AS chunk_id, label AS doc_id FROM embeddings WHERE label % 3 <> 0)
SELECT chunk_id::VARCHAR AS chunk_id, doc_id::BIGINT AS doc_id, FALSE AS fresh
FROM n UNION ALL SELECT doc_id || '_0', doc_id, TRUE FROM documents WHERE doc_id % 3 = 0 AND length(text) BETWEEN 20 AND 399 AND text = trim(text)""")
def index_documents(s, d):
    """Documents come into an index of vectors: their old chunks go, they are cut and embedded anew."""
    docs = t(s, d, "documents").where("doc_id % 3 = 0 AND length(text) BETWEEN 20 AND 399 AND text = trim(text)")
    index = t(s, d, "embeddings").where("label % 3 <> 0").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("long").alias("doc_id"), F.lit("old").alias("content"), "embedding")
    embed = lambda chunks: R.hashed_embeddings(chunks, 64, "chunk_id", "content").join(chunks, "chunk_id").withColumn("embedding", F.col("embedding").cast("array<float>"))
    old = index.unionByName(docs.select(F.concat(F.lit("gone_"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", F.lit("old").alias("content"), F.array().cast("array<float>").alias("embedding")))
    return R.indexed(old, docs, embed).select("chunk_id", "doc_id", (F.col("content") != "old").alias("fresh"))


@query(f"""SELECT chunk_id, round(score, 6) AS score, content FROM (SELECT 'v' || vec_id AS chunk_id, 0.7 * list_cosine_similarity(embedding::DOUBLE[],
{_QUERY}::DOUBLE[]) / (SELECT max(list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]))
FROM embeddings) AS score, 'vector' AS content FROM embeddings ORDER BY score DESC, vec_id LIMIT 5)""")
def hybrid_contents(s, d):
    """The vectors' leg alone weighs here, so that the contents of both legs can be told apart."""
    vectors = R.nearest(_vectors(s, d), _QUERY, 20).select(F.concat(F.lit("v"), F.col("chunk_id").cast("string")).alias("chunk_id"), "score", F.lit("vector").alias("content"))
    words = R.keyword_leg(S.page_of(S.search(documents(s, d), "hein"), 1, 20), ["hein"])
    return R.hybrid(vectors, words, 5, keyword_weight=0.0).select("chunk_id", F.round("score", 6).alias("score"), "content")


@query(f"""SELECT chunk_id, round(1.0 - 0.1 * (rank - 1), 6)::DOUBLE AS score FROM (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY
list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]) DESC, vec_id) AS rank
FROM embeddings) WHERE rank <= 5""")
def rerank_fallback(s, d):
    """A judge that fails leaves the old order."""
    hits = R.nearest(_vectors(s, d), _QUERY, 10).withColumn("content", F.lit("x"))
    return R.reranked(hits, _no_judge, 5).select("chunk_id", F.round("score", 6).alias("score"))


def _no_judge(texts):
    raise ConnectionError("no judge")


@query("""SELECT conv_id, 'Sum up the text below in a few sentences, then list its main points, a line each that starts with a dash.' || chr(10) || chr(10) ||
'Text:' || chr(10) || text || chr(10) || chr(10) || 'Summary:' AS prompt
FROM conversations WHERE turn = 0""")
def summary_prompts(s, d):
    rows = t(s, d, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("context"))
    return R.prompts(rows, kind="summary").select("conv_id", "prompt")


# values of one column


@query("SELECT o_orderkey, o_orderpriority || ' | ' || o_orderstatus || ' | a, \"b\"' AS text FROM orders")
def delimited_rows(s, d):
    """Quoted cells with delimiters, quotes and line ends in them; rows of blank cells are left out."""
    line = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('",'), F.col("o_orderstatus"), F.lit(',"a, ""b"""\n , ,\n'))
    return t(s, d, "orders").select("o_orderkey", delimited_text(F.lit("csv"), line).alias("text"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def pdf_dates(s, d):
    return t(s, d, "orders").select("o_orderkey", D.pdf_date(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000+02'00'"))).alias("day"))


@query("SELECT doc_id, 'lang: ' || lang || '; n_chars: ' || n_chars AS summary FROM documents")
def row_summaries(s, d):
    return t(s, d, "documents").withColumn("none", F.lit(None).cast("string")).select("doc_id", T.row_summary(["lang", "none", "n_chars"]).alias("summary"))


@query("""SELECT doc_id, CASE WHEN length(regexp_replace(source || '/' || doc_id, '[^A-Za-z0-9._-]', '', 'g')) > 64 THEN substr(sha256(source || '/' || doc_id),
1, 32) ELSE regexp_replace(source || '/' || doc_id, '[^A-Za-z0-9._-]', '', 'g') END AS id, source = 'src1' AS within
FROM documents""")
def safe_ids(s, d):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return t(s, d, "documents").select("doc_id", T.safe_id(path).alias("id"), T.within_folder(path, "src1/").alias("within"))


@query("""SELECT doc_id, n_chars / greatest(doc_id % 4, 1) < 50 OR (doc_id % 3 = 0 AND n_chars / greatest(doc_id % 4, 1) < 500) AS needs, CASE WHEN length(lang
|| lang) > 1.5 * length(source) THEN lang || lang ELSE source END AS better
FROM documents""")
def ocr_rules(s, d):
    rows = t(s, d, "documents").withColumns({"pages": F.col("doc_id") % 4, "large": F.col("doc_id") % 3 == 0, "twice": F.concat("lang", "lang")})
    return rows.select("doc_id", T.needs_ocr("n_chars", "pages", "large").alias("needs"), T.better_text("source", "twice").alias("better"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS rows FROM documents)
SELECT doc_id, CASE WHEN len(rows) < 7 THEN array_to_string(rows, chr(10)) ELSE array_to_string(list_filter(rows, lambda x, i: NOT ((i <= 3 OR i >
len(rows) - 3) AND (regexp_matches(trim(x), '(?i)^(page\\s+)?\\d+(\\s+of\\s+\\d+)?$') OR regexp_matches(trim(x), '^-\\s*\\d+\\s*-$')))), chr(10)) END
AS text FROM l""")
def without_header_footer(s, d):
    return t(s, d, "documents").select("doc_id", T.without_header_footer("text").alias("text"))


@query("""SELECT p_partkey, length(p_type) BETWEEN 1 AND 50 AND regexp_matches(p_type, '^([A-Z][a-z]+|[A-Z_]+$|[\\p{L}\\p{N}_]+\\s[\\p{L}\\p{N}_]+)') AS named,
FALSE AS number FROM part""")
def name_like(s, d):
    return t(s, d, "part").select("p_partkey", T.looks_like_name("p_type").alias("named"), T.looks_like_name(F.col("p_size").cast("string")).alias("number"))


@query("""SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b') THEN
'email' END], lambda x: x IS NOT NULL)), ',') AS kinds FROM documents""")
def pii_kinds(s, d):
    """Which kinds a text holds, of those that Spark's expressions find by themselves."""
    return t(s, d, "documents").select("doc_id", F.when(P.match_count("text", "email") > 0, "email").otherwise("").alias("kinds"))


@query("""WITH x AS (SELECT doc_id, trim(text, ' ') AS text FROM documents WHERE length(text) < 400 AND NOT regexp_matches(text, '^\\s|\\s$'))
SELECT doc_id, 0 AS chunk_index, text AS content, 0 AS start_char, length(text)::INTEGER AS end_char, doc_id || '_0' AS chunk_id
FROM x WHERE length(text) >= 20""")
def short_chunks(s, d):
    """Documents under 400 characters are a chunk of their own."""
    docs = t(s, d, "documents").where(~F.col("text").rlike(r"^\s|\s$") & (F.length("text") < 400))
    return C.chunked(docs).select("doc_id", "chunk_index", "content", "start_char", "end_char", "chunk_id")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_num, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS n,
min(l_returnflag) || ' | ' || min(l_linestatus) || chr(10) || repeat('-', 40) || chr(10) || min(l_partkey) || ' | ' || min(l_suppkey) AS t, 'Part: '
|| min(l_partkey) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT doc_id, page_num, (3 * n)::INTEGER AS chunk_index, 'table' AS chunk_type, t AS content, (length(t) // 4)::INTEGER AS token_count, doc_id || '_'
|| 3 * n || '_table' AS chunk_id FROM p
UNION ALL SELECT doc_id, page_num, (3 * n + 1)::INTEGER, 'form', f, (length(f) // 4)::INTEGER, doc_id || '_' || 3 * n + 1 || '_form' FROM p
UNION ALL SELECT doc_id, page_num, (3 * n + 2)::INTEGER, 'text', trim(repeat('word ', 50)), 62, doc_id || '_' || 3 * n + 2 FROM p""".replace("|| 3 * n ||", "|| (3 * n) ||").replace("|| 3 * n + 1 ||", "|| (3 * n + 1) ||").replace("|| 3 * n + 2 FROM", "|| (3 * n + 2) FROM"))
def page_chunks(s, d):
    text = lambda c: F.col(c).cast("string")
    table = F.struct(F.array("l_returnflag", "l_linestatus").alias("headers"), F.array(F.array(text("l_partkey"), text("l_suppkey"))).alias("rows"))
    fields = F.array(F.struct(F.lit("Part").alias("key"), text("l_partkey").alias("value")), F.struct(F.lit("Empty").alias("key"), F.lit("").alias("value")))
    pages = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num")).agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")])
    pages = pages.select("doc_id", "page_num", F.lit("word " * 50).alias("text"), F.array(table).alias("tables"), fields.alias("fields"))
    return C.page_chunks(pages)


@query("""WITH r AS (SELECT p_partkey % 40 AS sheet, p_partkey // 40 + 1 AS row, p_partkey % 3 AS kind
FROM part), h AS (SELECT sheet, row, row_number() OVER (PARTITION BY sheet
ORDER BY row) AS n FROM r WHERE row <= 10 AND kind = 0)
SELECT sheet, row FROM h WHERE n <= 3""")
def header_rows(s, d):
    """Rows of names are headers; rows of numbers and rows that repeat themselves are none."""
    kind, cell = F.col("p_partkey") % 3, F.lit
    cells = F.when(kind == 0, F.array(cell("Name"), cell("UNIT_PRICE"), cell("per cent"), cell(None))).when(kind == 1, F.array(cell("12.5"), cell("17"), cell("Total"))).otherwise(F.array(cell("Same"), cell("Same"), cell("Same")))
    rows = t(s, d, "part").select((F.col("p_partkey") % 40).alias("sheet"), F.floor(F.col("p_partkey") / 40 + 1).alias("row"), cells.alias("cells"))
    return O.header_rows(rows)


@query("""SELECT path, CASE WHEN path % 6 = 0 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN path % 6 = 0 THEN 'broken ' || path END AS error
FROM (SELECT doc_id AS path FROM documents WHERE doc_id % 2 = 0 OR doc_id % 6 = 0)""")
def failed_files(s, d):
    at = F.lit("2024-01-01").cast("timestamp")
    files = t(s, d, "documents").select(F.col("doc_id").alias("path"))
    known = files.where("path % 2 = 0").select("path", F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("error"), at.alias("indexed_at"))
    failed = files.where("path % 6 = 0").withColumn("error", F.concat(F.lit("broken "), F.col("path").cast("string")))
    return O.files_failed(known, failed, at).select("path", "status", "error")


@query(f"SELECT status, count(*) AS n, min(id) AS first FROM ({_JOBS_SQL}) WHERE status IN ('pending', 'failed') GROUP BY status")
def files_by_status(s, d):
    return _jobs(s, d).where(F.col("status").isin("pending", "failed")).groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("SELECT doc_id, 'first of ' || lang || '|' || 'second' AS points FROM documents")
def key_points(s, d):
    answer = F.concat(F.lit("Here they are:\n- first of "), F.col("lang"), F.lit("\n\n2) second\nThat is all."))
    return t(s, d, "documents").select("doc_id", F.array_join(T.key_points(answer), "|").alias("points"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN [o_orderkey % 10, 2.5, 3.0]::DOUBLE[] WHEN 1 THEN [o_orderkey % 10, 7.0, 1.5]::DOUBLE[] ELSE [5.0,
5.0, 5.0]::DOUBLE[] END AS scores FROM orders""")
def judged_scores(s, d):
    """A judge's answer as a list, as numbers in a text, and without any."""
    key = F.col("o_orderkey")
    digit = (key % 10).cast("string")
    answer = F.when(key % 3 == 0, F.concat(F.lit("Scores: ["), digit, F.lit(", 2.5, 3]"))).when(key % 3 == 1, F.concat(digit, F.lit(" then 7 and 1.5"))).otherwise("no idea")
    return t(s, d, "orders").select("o_orderkey", R.parsed_scores(answer, 3).alias("scores"))


@query("SELECT doc_id, text FROM documents")
def encryption_round_trip(s, d):
    from inkfall.sources.files import decrypted, derived_key, encrypted

    key = derived_key("secret", b"salt", 1000)
    return t(s, d, "documents").select("doc_id", encrypted(F.col("text"), key).alias("held")).select("doc_id", decrypted(F.col("held"), key).alias("text"))


@query("SELECT doc_id, 'Title of ' || lang || ' and ' || source AS text FROM documents")
def rtf_text(s, d):
    rtf = F.concat(F.lit(r"{\rtf1\ansi{\b Title} of "), F.col("lang"), F.lit(r" \i0 and "), F.col("source"), F.lit("}"))
    return t(s, d, "documents").select("doc_id", T.strip_rtf(rtf).alias("text"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 7 = 0")
def files_to_index(s, d):
    """Files whose path is new, or whose digest has changed."""
    files = t(s, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    known = files.where("path % 4 <> 0").withColumn("hash", F.when(F.col("path") % 7 == 0, "x").otherwise(F.col("hash")))
    return O.needs_index(files, known).select(F.col("path").alias("doc_id"))


@query("SELECT CASE WHEN length(text) > 3000 THEN 'held' ELSE 'admitted' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def guardrail_split(s, d):
    good, bad = O.admitted(O.guardrails(t(s, d, "documents"), s=Settings(max_chars=3000)))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(good, "admitted").unionByName(count(bad, "held")).where("n > 0")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus IN ('O', 'F') THEN 'cancelled'
    WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderstatus = 'F' THEN 'paused' ELSE 'completed' END AS status FROM orders""")
def sessions_cancelled(s, d):
    """Only what runs or is paused can be cancelled."""
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "paused").otherwise("completed")
    rows = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    return O.sessions_moved(rows, rows.where("id % 2 = 0"), "cancelled")


@query("SELECT p_partkey AS page_id, 'Size' AS label, p_size::VARCHAR AS value FROM part WHERE p_size % 3 <> 0")
def aligned_fields(s, d):
    """A label and a value with a wide gap between; words that stand close are none."""
    box = lambda text, x: F.struct(text.alias("text"), F.lit(float(x)).alias("x"), F.lit(5.0).alias("y"), F.lit(30.0).alias("w"))
    size = F.col("p_size").cast("string")
    words = F.when(F.col("p_size") % 3 != 0, F.array(box(size, 200), box(F.lit("Size:"), 0))).otherwise(F.array(box(F.lit("Size:"), 0), box(size, 40)))
    return L.aligned_rows(t(s, d, "part").select(F.col("p_partkey").alias("page_id"), F.inline(words)))
