import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkfall.operators import operations as O
from inkfall.operators import retrieval as R
from inkfall.sources import files as X
from inkfall.streaming import streams as M


def test_alerts_are_measured_from_the_last_emitted(spark):
    t0 = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", t0 + timedelta(minutes=m), m) for m in (0, 4, 6, 9, 12)], "key string, ts timestamp, m int")
    assert sorted(r.m for r in O.deduplicated_alerts(rows, minutes=5).collect()) == [0, 6, 12]


def test_quarantine_counts_retries(spark):
    old = spark.createDataFrame([("a", "r", "s", 1, 2, 3, True)], "path string, reason string, stage string, ts int, retry_count int, max_retries int, recoverable boolean")
    failed = spark.createDataFrame([("a", "r2", "s", 2, None), ("b", "r", "s", 2, -11)], "path string, reason string, stage string, ts int, exit_code int")
    got = {r.path: (r.retry_count, r.recoverable) for r in O.quarantine(old, failed).collect()}
    assert got == {"a": (3, True), "b": (0, False)}


def test_guardrails_stop_the_job(spark):
    from inkfall.config import Settings

    checked = O.guardrails(spark.createDataFrame([(1, "x" * 10)], "doc_id int, text string"), s=Settings(max_chars=5))
    good, bad = O.admitted(checked)
    assert good.isEmpty() and bad.count() == 1
    with pytest.raises(Exception, match="guardrail"):
        O.enforced(checked).collect()


def test_fusion_and_packing(spark):
    v = spark.createDataFrame([("a", 0.8), ("b", 0.4)], "chunk_id string, score double")
    k = spark.createDataFrame([("b", 3.0), ("c", 1.0)], "chunk_id string, score double")
    got = {r.chunk_id: round(r.score, 6) for r in R.fused(v, k).collect()}
    assert got == {"a": 0.7, "b": 0.65, "c": 0.1}
    none = v.where("false")
    assert {r.chunk_id for r in R.fused(none, k).collect()} == {"b", "c"}
    chunks = spark.createDataFrame([("a", 3.0, "f", "x" * 40), ("b", 2.0, "f", "x" * 4000), ("c", 1.0, "f", "x")], "chunk_id string, score double, filename string, content string")
    assert R.packed_context(chunks, 100).first().n_chunks == 1
    scores = spark.createDataFrame([("so [1, 2.5, 3]",), ("4 and 5 and 6",), ("none",)], "x string").select(R.parsed_scores("x", 3)).collect()
    assert [r[0] for r in scores] == [[1.0, 2.5, 3.0], [4.0, 5.0, 6.0], [5.0, 5.0, 5.0]]
    assert R.reranked(chunks, lambda xs: [float(len(x)) for x in xs], 1).first().chunk_id == "b"


def test_files(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "a.txt").write_text("no")
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.csv").write_text('x,y\n,\n1,"2"\n')
    (tmp_path / "c.html").write_text("<title>T</title><script>x</script><p>one &amp; two</p>")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>k</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "f.docx").write_bytes(b"broken")
    files = X.scan(spark, str(tmp_path), ignore=("skip",))
    got = {r.path.rsplit("/", 1)[1]: r for r in X.extract(files).collect()}
    assert set(got) == {"a.txt", "b.csv", "c.html", "d.docx", "e.xlsx", "f.docx"}
    assert got["a.txt"].text == "héllo" and got["b.csv"].text == "x | y\n1 | 2"
    assert (got["c.html"].title, got["c.html"].text) == ("T", "T\none & two")
    assert got["d.docx"].text == "Para\nc1 | c2" and got["e.xlsx"].text == "=== Sheet: S ===\nk | 7"
    assert got["f.docx"].text is None and "BadZipFile" in got["f.docx"].error
    X.export_lines(files, "path", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 6


def test_encryption(spark):
    key = X.derived_key("secret", b"salt", 10)
    df = spark.createDataFrame([("text",)], "x string").select(X.encrypted(F.col("x"), key).alias("e"))
    assert df.select(X.decrypted(F.col("e"), key)).first()[0] == "text"


def test_stream_equals_table(spark, small, tmp_path):
    events = M.with_timestamps(spark.read.parquet(f"{small}/events.parquet"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = M.event_stream(spark, str(tmp_path / "in"), events, 1)
    M.run_available(M.tumbling(stream, "1 day"), "one_day", str(tmp_path / "c1"))
    rows = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert rows(spark.table("one_day")) == rows(M.tumbling(events, "1 day"))
    M.run_available(M.once_each(stream, ["event_id"], "60 days"), "each", str(tmp_path / "c2"), "append")
    assert spark.table("each").count() == events.select("event_id").distinct().count()
    M.run_available(M.debounced(stream.withColumn("path", F.col("user_id") % 5), "2 hours", "40 days"), "quiet", str(tmp_path / "c3"), "append")
    batch = M.debounced(events.withColumn("path", F.col("user_id") % 5), "2 hours")
    assert {tuple(r) for r in spark.table("quiet").collect()} <= {tuple(r) for r in batch.collect()}


def test_debounce_over_a_table_equals_one_pass(spark):
    t0 = datetime(2024, 1, 1)
    minutes = [0, 3, 58, 61, 200, 290, 295, 301, 500]
    rows = spark.createDataFrame([(i, t0 + timedelta(minutes=m), i % 2, f"e{i}") for i, m in enumerate(minutes)], "event_id long, ts timestamp, path long, event_type string")
    spells, last = [], None
    for m in minutes:
        spells.append((spells[-1] if spells else 0) + (last is None or m - last >= 30))
        last = m
    want = {(s, i % 2): f"e{i}" for i, s in enumerate(spells)}
    assert {(r.spell, r.path): r.event for r in M.debounced_table(rows, 1800).collect()} == want


def test_merging_sink_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    held = {}
    sink = M.merging_sink(lambda: spark.createDataFrame(held["rows"], "k int, v string") if held else None, lambda df: held.update(rows=[tuple(r) for r in df.select("k", "v").collect()]), ["k"])
    sink(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    batch = spark.createDataFrame([(2, "c")], "k int, v string")
    sink(batch, 1), sink(batch, 1)
    assert sorted(held["rows"]) == [(1, "a"), (2, "c")] and path


def test_incremental_index(spark):
    held = {}
    sink = M.index_sink(lambda: held.get("p"), lambda df: held.update(p=spark.createDataFrame(df.collect(), df.schema)))
    sink(spark.createDataFrame([(1, "f", "one two")], "id long, filename string, content string"), 0)
    sink(spark.createDataFrame([(1, "f", "two three")], "id long, filename string, content string"), 1)
    assert {r.term for r in held["p"].collect()} == {"f", "two", "three"}


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "old", 0), (3, "old", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "first", 1), (1, "last", 3), (1, "second", 2), (2, "same", 1), (2, "same", 1)], "k int, v string, n int")
    assert sorted((r.k, r.v) for r in O.upsert(old, new, ["k"], ["n"]).collect()) == [(1, "last"), (2, "same"), (3, "old")]
    twice = [sorted(map(tuple, O.upsert(old, new.repartition(n), ["k"]).collect())) for n in (1, 3)]
    assert twice[0] == twice[1] and len(twice[0]) == 3
    assert O.upsert(old.where("false"), new.where("false"), ["k"]).count() == 0


def test_merging_sink_keeps_the_last_row(spark):
    held = {}
    sink = M.merging_sink(lambda: spark.createDataFrame(held["rows"], "k int, v string, n int") if held else None, lambda df: held.update(rows=[tuple(r) for r in df.collect()]), ["k"], ["n"])
    sink(spark.createDataFrame([(1, "first", 1), (1, "last", 9), (1, "second", 2)], "k int, v string, n int"), 0)
    assert held["rows"] == [(1, "last", 9)]
    sink(spark.createDataFrame([(1, "b", 2), (1, "c", 3), (2, "x", 1)], "k int, v string, n int"), 1)
    assert sorted(held["rows"]) == [(1, "c", 3), (2, "x", 1)]


@pytest.mark.parametrize(("parents", "want"), [([1], [2]), ([1, None], []), ([], [1, 2, None]), ([None], [])])
def test_orphans_are_those_of_not_in(spark, parents, want):
    children = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    known = spark.createDataFrame([(p,) for p in parents], "k int")
    children.createOrReplaceTempView("children"), known.createOrReplaceTempView("parents")
    got = [r.k for r in O.orphans(children, known, "k").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) == sorted((r.k for r in spark.sql("SELECT k FROM children WHERE k NOT IN (SELECT k FROM parents)").collect()), key=repr)


def test_quoted_cells(spark):
    text = 'a,"x, y",b\n"say ""hi""","two\nlines",\n , ,\n'
    assert X.delimited("csv", text) == 'a | x, y | b\nsay "hi" | two\nlines | '
    assert X.delimited("tsv", 'a\t"b, c"') == "a | b, c" and X.delimited("csv", "") == "" and X.delimited("csv", None) is None


def test_files_are_read_once(spark, tmp_path):
    for name in ("a.txt", "b.csv", "c.html", "d.zip"):
        (tmp_path / name).write_text("x")
    plan = X.extract(X.scan(spark, str(tmp_path), extensions=("txt", "csv", "html", "zip")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan binaryFile") == 1
    got = {r.path[-5:]: (r.text, r.error) for r in X.extract(X.scan(spark, str(tmp_path), extensions=("txt", "csv", "html", "zip"))).collect()}
    assert got == {"a.txt": ("x", None), "b.csv": ("x", None), ".html": ("x", None), "d.zip": (None, "no reader for this type")}


def test_state_is_replaced_whole(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "path string, stage string, retry_count int"
    assert X.state(spark, path, schema).count() == 0
    X.replaced(spark.createDataFrame([("a", "failed", 1), ("b", "embedding", 0)], schema), path)
    X.replaced(X.state(spark, path, schema).where("stage = 'failed'"), path)
    X.appended(spark.createDataFrame([("c", "completed", 0)], schema), path)
    assert sorted(r.path for r in X.state(spark, path, schema).collect()) == ["a", "c"]
    assert [r.path for r in O.resumable(X.state(spark, path, schema)).collect()] == ["a"]


def test_tenants_and_logs(spark):
    assert X.tenant_folder("/data/", "acme-1") == "/data/acme-1"
    for name in ("../up", "a/b", "", ".hidden", "x" * 65):
        with pytest.raises(ValueError):
            X.tenant_folder("/data", name)
    import json

    (line,) = (json.loads(r.value) for r in X.log_lines(spark.createDataFrame([(1, "a")], "doc int, stage string"), "indexed").collect())
    assert (line["event"], line["level"], line["doc"], line["stage"]) == ("indexed", "INFO", 1, "a")


def test_a_judge_that_fails_leaves_the_order(spark):
    hits = spark.createDataFrame([("a", 3.0, "x"), ("b", 2.0, "yy"), ("c", 1.0, "zzz")], "chunk_id string, score double, content string")

    def broken(texts):
        raise ConnectionError("gone")

    for judge in (broken, lambda texts: [1.0], lambda texts: ["no"] * 3):
        assert [(r.chunk_id, round(r.score, 6)) for r in R.reranked(hits, judge, 2).collect()] == [("a", 1.0), ("b", 0.9)]
    assert [r.chunk_id for r in R.reranked(hits, lambda texts: [len(x) for x in texts], 2).collect()] == ["c", "b"]
    assert R.reranked(hits.where("false"), broken, 2).count() == 0


def test_legs_of_a_hybrid_search(spark):
    vectors = spark.createDataFrame([("doc_1", 0.8, "from vectors"), ("v2", 0.4, "two")], "chunk_id string, score double, content string")
    page = spark.createDataFrame([(1, 4.0, "the needle in it"), (7, 2.0, "needle")], "id long, score double, content string")
    words = R.keyword_leg(page, ["needle"])
    assert {r.chunk_id: r.content for r in words.collect()} == {"doc_1": "the <mark>needle</mark> in it", "doc_7": "<mark>needle</mark>"}
    got = [(r.chunk_id, round(r.score, 6), r.content) for r in R.hybrid(vectors, words, 3).collect()]
    assert got == [("doc_1", 1.0, "from vectors"), ("v2", 0.35, "two"), ("doc_7", 0.15, "<mark>needle</mark>")]


def test_prompts(spark):
    rows = spark.createDataFrame([("text", None, "f.txt")], "context string, history string, filename string")
    for kind in R.PROMPTS:
        prompt = R.prompts(rows, "why?", kind).first().prompt
        assert "text" in prompt and "{" not in prompt and ("why?" in prompt) == (kind != "summary") and ("f.txt" in prompt) == (kind == "document")


def test_a_page_brings_its_texts_after_the_limit(spark, small):
    from inkfall.operators import search as S
    from inkfall.queries import documents

    docs = documents(spark, small)
    postings, lengths = S.build_postings(docs), S.doc_lengths(docs)
    page = S.search_page(docs, "hein OR ering", 2, 5, postings=postings, lengths=lengths)
    want = S.page_of(S.search(docs, "hein OR ering"), 2, 5).collect()
    assert [(r.id, r.content, round(r.score, 9)) for r in page.collect()] == [(r.id, r.content, round(r.score, 9)) for r in want]


def test_postings_need_no_shuffle(spark, small):
    from inkfall.operators import search as S
    from inkfall.queries import documents

    docs = documents(spark, small)
    assert "Exchange" not in S.build_postings(docs)._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.col, r.term): r.positions for r in S.build_postings(docs).collect()}
    from inkfall.plans.analysis import tokens_of

    want = {}
    for r in docs.collect():
        for c in ("filename", "content"):
            for i, term in enumerate(tokens_of(r[c])):
                want.setdefault((r.id, c, term), []).append(i)
    assert got == want


def test_key_values_of_a_page(spark):
    from inkfall.functions import layout as L

    import re

    text = "Invoice No: 17\nab: too short\nDue Date   tomorrow\n" + "x" * 2000 + "\nLate: too far down"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(L.key_values("t").alias("kv")).collect()
    found = [m for p in (r"([A-Za-z][A-Za-z\s]+):\s*(.+)", r"([A-Za-z][A-Za-z\s]+)\s{2,}(.+)") for m in re.findall(p, text[:2000])[:20]]
    want = [(k.strip(), v.strip()) for k, v in found if 2 < len(k.strip()) < 50 and v.strip()]
    assert [tuple(x) for x in got[0].kv] == want and want[0] == ("Invoice No", "17") and len(want) == 2 and got[1].kv == []


def test_watching_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    out, state = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run = lambda: M.run_to(M.watched(spark, str(folder)).select("path", "size"), out, state)
    run()
    (folder / "b.txt").write_text("three")
    run()
    assert sorted((r.path[-5:], r.size) for r in spark.read.parquet(out).collect()) == [("a.txt", 3), ("b.txt", 5)]


def test_conversion_of_states(spark):
    """What no query names: retries, priorities, encodings of a form, dates in free text, histograms of pages."""
    from inkfall.functions import dates as D
    from inkfall.functions import layout as L
    from inkfall.functions import text as T

    held = spark.createDataFrame([("a", True, 1, 3), ("b", True, 3, 3), ("c", False, 0, 3)], "path string, recoverable boolean, retry_count int, max_retries int")
    assert [r.path for r in O.retryable(held).collect()] == ["a"]
    jobs = spark.createDataFrame([("delete",), ("reindex",), ("index",)], "kind string").select(O.job_priority(F.col("kind")).alias("p")).collect()
    assert [r.p for r in jobs] == [100, 50, 0]
    files = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, hash string")
    assert [r.path for r in O.needs_index(files, files.where("path = 'a'")).collect()] == ["b"]
    text = spark.createDataFrame([("ﬁ ① x", "seen on the 3rd of March 2021")], "a string, b string").select(T.normalize_unicode("a", "NFKC").alias("a"), D.any_date("b").alias("b")).first()
    assert (text.a, text.b) == ("fi 1 x", "2021-03-03")
    light = spark.createDataFrame([([0.0] * 200 + [9.0] * 56,), ([1.0] * 256,)], "h array<double>").select(L.document_like("h").alias("d")).collect()
    assert [r.d for r in light] == [True, False]


def test_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(b"x"))], "id int, content binary")
    X.snapshot(rows, str(tmp_path / "s"))
    assert X.restored(spark, str(tmp_path / "s")).count() == 1
    X.emptied(rows, str(tmp_path / "s2"))
    assert X.restored(spark, str(tmp_path / "s2")).count() == 0
    import hashlib

    assert X.with_digest(rows).first().hash == hashlib.sha256(b"x").hexdigest()


def test_only_the_unseen(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert [r.id for r in M.unseen(events, events.where("id = 1"), ["id"]).collect()] == [2]
    asked = R.answers(R.prompts(spark.createDataFrame([("c",)], "context string"), "q"), lambda p: p[-7:])
    assert asked.first().answer == "Answer:"


def test_jobs_are_worked_off(spark):
    """Each job until it succeeds or has no tries left; a round that fails is done again."""
    held = {"jobs": [(i, i % 3, "pending", 0, 3, i) for i in range(7)]}
    schema = "id int, priority int, status string, attempts int, max_attempts int, created_at int"
    read = lambda: spark.createDataFrame(held["jobs"], schema)
    write = lambda df: held.update(jobs=[tuple(r) for r in df.select(*[c.split()[0] for c in schema.split(", ")]).collect()])
    rounds = O.work_off(read, write, lambda jobs: jobs.select("id", (F.col("id") != 4).alias("ok")), at_once=3)
    got = {r[0]: (r[2], r[3]) for r in held["jobs"]}
    assert rounds >= 3 and got == {i: ("completed", 1) if i != 4 else ("pending", 3) for i in range(7)}


def test_sessions_move_by_rule(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(("running", "paused", "completed", "cancelled"))], "id int, status string")
    move = lambda to: [r.status for r in sorted(O.sessions_moved(rows, rows, to).collect())]
    assert move("paused") == ["paused", "paused", "completed", "cancelled"]
    assert move("running") == ["running", "running", "completed", "cancelled"]
    assert move("cancelled") == ["cancelled", "cancelled", "completed", "cancelled"]
