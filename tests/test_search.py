import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfall.operators import search as S
from inkfall.plans.analysis import fold, porter, tokens_of
from inkfall.plans.query_language import Leaf, Op, highlight_terms, read
from inkfall.queries import documents

A, B, C = (Leaf((x,)) for x in "abc")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a b", Op("AND", A, B)),
        ('"a b"', Leaf(("a", "b"))),
        ("a OR b AND c", Op("OR", A, Op("AND", B, C))),
        ("a not b", Op("NOT", A, B)),
        ("a NOT b c", Op("NOT", A, Op("AND", B, C))),
        ("(a OR b) AND c", Op("AND", Op("OR", A, B), C)),
        ("filename:a", Leaf(("a",), "filename")),
        ('filename:"a b"', Leaf(("a", "b"), "filename")),
        ("a*", A),
        ("foo:bar a", A),
        ("what is a?", Op("AND", Op("AND", Leaf(("what",)), Leaf(("is",))), A)),
    ],
)
def test_trees(text, tree):
    assert read(text).tree == tree


@pytest.mark.parametrize("text", ["NOT a", "a AND NOT b", "(a) b", "a (b)", "a-b", "don't", 'type:"pdf"', "a.b", "a AND", "()", "(a"])
def test_refused(text):
    q = read(text)
    assert q.text and not q.valid


def test_filters():
    q = read("a type:.PDF author:Bob after:2020 before:2023-05-01 year:2021 year:x")
    assert (q.file_type, q.author, q.after, q.before, q.year, q.tree) == ("pdf", "Bob", "2020-01-01", "2023-05-01", 2021, A)
    assert not read("after:2020").searchable and not read("").searchable and read("type:pdf").searchable


def test_highlight_terms():
    assert highlight_terms('"x y" a AND filename:z type:pdf or b') == ["x y", "a", "z", "b"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab "():-*ANDORT', max_size=20))
def test_reading_never_raises(text):
    read(text)


def test_folding_and_stems():
    assert [porter(fold(w)) for w in "straße œuvre naïve Café año ÅNGSTRÖM running runs".split()] == "straß œuvr naiv cafe ano angstrom run run".split()
    assert [porter(w) for w in "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer radicalli operator feudalism decisiveness hopefulness formaliti triplicate formative formalize electrical hopeful goodness revival allowance inference airliner adjustable replacement adoption communism activate effective bowdlerize probate rate cease controll roll".split()] == "caress poni ti cat feed agre plaster motor sing conflat troubl size hop fall hiss fizz fail file happi sky relat condit ration valenc digit radic oper feudal decis hope formal triplic form formal electr hope good reviv allow infer airlin adjust replac adopt commun activ effect bowdler probat rate ceas control roll".split()
    assert tokens_of("x_y 10.5") == ["x", "y", "10", "5"]


@pytest.mark.parametrize("stem", [False, True])
def test_same_scores_as_an_independent_index(spark, small, stem):
    docs = documents(spark, small)
    con = sqlite3.connect(":memory:")
    tokenizer = "porter unicode61 remove_diacritics 1" if stem else "unicode61 remove_diacritics 0"
    con.execute(f'CREATE VIRTUAL TABLE x USING fts5(filename, content, tokenize = "{tokenizer}")')
    con.executemany("INSERT INTO x(rowid, filename, content) VALUES (?, ?, ?)", [(r.id, r.filename, r.content) for r in docs.collect()])
    for text in ("hein", "hein OR ering", "thin NOT hein", '"of the"', "filename:src3 OR thin", "NEAR(hein thin, 20)", "things AND (hein OR ering)"):
        want = {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(x) FROM x WHERE x MATCH ?", (text,))}
        got = {r.id: r.score for r in S.search(docs, text, stem=stem).select("id", "score").collect()}
        assert got.keys() == want.keys(), text
        if "NEAR" not in text:
            assert all(abs(got[k] - want[k]) < 1e-9 for k in want), text


def test_snippets():
    text = "word " * 40 + "needle here " + "word " * 40
    (only,) = S.snippets(text, ["needle"])
    assert only.startswith("...") and only.endswith("...") and "<mark>needle</mark>" in only and len(only) < 220
    assert S.snippets("x" * 200, ["y"]) == ["x" * 150 + "..."]
    assert S.snippets("", ["y"]) == [] and S.snippets("a", []) == []


def test_incremental_postings_equal_a_rebuild(spark, small):
    docs = documents(spark, small)
    old = S.build_postings(docs.where("id < 100"))
    changed = docs.where("id BETWEEN 90 AND 120").withColumn("content", F.concat("content", F.lit(" extra")))
    got = S.merge_postings(old, changed, docs.where("id = 3").select("id")).select("term", "doc_id", "col", "positions")
    want = S.build_postings(docs.where("id < 90 AND id <> 3").unionByName(changed))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
