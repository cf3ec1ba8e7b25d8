import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfall.functions import chunks as C
from inkfall.functions import layout as L
from inkfall.functions import pii as P
from inkfall.functions import text as T
from inkfall.functions.dates import detected_dates, pdf_date
from inkfall.functions.vectors import cosine, normalized


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.fix_scan_characters, "ﬁne­ o k… a–b “q”", "fine o k... a-b “q”"),
        (T.join_hyphenated, "exam-\nple", "example"),
        (T.glue_lines, "ab\ncd", "abcd"),
        (T.glue_lines, "a\nbcd", "a\nbcd"),
        (T.glue_lines, "a" * 15 + "\n" + "b" * 15 + "\ncd", "a" * 15 + "\n" + "b" * 15 + "\ncd"),
        (T.glue_lines, "Hello\nworld", "Helloworld"),
        (T.normalize_whitespace, "a\t\tb \r\nc\n\n\n\nd", "a b\nc\n\nd"),
        (T.remove_boilerplate, "keep\nPage 3 of 9\n- 4 -\n© 2020 me\nxy\n\nend", "keep\n\nend"),
        (T.strip_rtf, r"{\rtf1 hello {\b world}}", "hello world"),
        (T.key_points, "intro\n- one\n2. two", ["one", "two"]),
        (T.value_kind, "$1,000.50", "currency"),
        (T.value_kind, "12.5%", "percentage"),
        (T.value_kind, "2024-01-02", "date"),
        (T.value_kind, "yes", "boolean"),
        (T.value_kind, "-1e3", "number"),
        (T.value_kind, "abc", "text"),
        (detected_dates, "01/15/2023 15/01/2023 1/2/23 2023-01-15 January 15, 2023, 15 Jan 2023 01/01/1800", ["2023-01-02", "2023-01-15"]),
        (pdf_date, "D:20230115120000Z", "2023-01-15"),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f, text) == want


def test_glue_follows_the_substitution(spark):
    def model(x):
        return re.sub(r"([a-z]{2,})\n([a-z]{2,})", lambda m: m[1] + m[2] if 4 <= len(m[1] + m[2]) <= 20 else m[0], x)

    texts = ["ab\ncd\nef\ngh", "abcdefghijklmnopqr\nst\nuv", "abcdefghijklmnopqrs\nst\nuv", "A bc\nde", "x\nyz\nab", "é ab\ncdé"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.glue_lines("x").alias("y")).collect()
    assert {r.x: r.y for r in got} == {x: model(x) for x in texts}


def test_personal_data():
    kinds = lambda x: [(s["kind"], s["confidence"]) for s in P.spans(x)]
    assert kinds("ssn 123-45-6789") == [("ssn", 0.95)]
    assert kinds("id 123-45-6789") == [("ssn", 0.7)]
    assert kinds("id 666-45-6789") == []
    assert kinds("123456789") == []
    assert kinds("card 4111 1111 1111 1111")[0] == ("credit_card", 0.95)
    assert kinds("a@gmail.com b@x.org") == [("email", 0.95), ("email", 0.9)]
    assert kinds("10.0.0.1 8.8.8.8") == [("ip_address", 0.6), ("ip_address", 0.8)]
    assert kinds("born 01/02/1990") == [("date_of_birth", 0.9)]
    assert P.redacted("to a@x.org now") == "to [REDACTED] now"
    assert P.spans(None) == [] and P.redacted(None) is None


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="4111 -@a.bx0129\n", max_size=80))
def test_redaction_leaves_no_address(text):
    assert not [s for s in P.spans(P.redacted(text)) if s["kind"] == "email"]


def cut(spark, texts, how=C.chunk_plain):
    """The chunks of each text."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", how("t").alias("c")).collect()
    return [r.c for r in sorted(rows)]


def plain_model(text):
    """Chunks as stretches of a text whose paragraphs are parted by one blank line each."""
    text = re.sub(r"\n\s*\n", "\n\n", (text or "").strip())
    if len(text) < 400:
        return [(text, 0)] * (len(text) >= 20)
    ends = [m.end() for m in re.finditer("\n\n", text)] + [len(text)]
    out, start, at = [], 0, 0
    say = lambda a, b, least: out.extend([(text[a:b].strip(), a)] * (len(text[a:b].strip()) >= least))
    for end in ends:
        if end - at > 2000:
            say(start, at, 1)
            packed = []
            for s in re.split(r"(?<=[.!?])\s+", text[at:end]):
                parts = [s] if len(s) <= 2000 else [s[i : i + 2000] for i in range(0, len(s), 1800)]
                if len(parts) > 1 or not packed or packed[-1][1] or len(packed[-1][0]) + len(s) > 2000:
                    packed += [(x, len(parts) > 1) for x in parts]  # a window takes in nothing more
                elif packed[-1][0]:
                    packed[-1] = (packed[-1][0] + " " + s, False)
                else:
                    packed[-1] = (s, False)
            out += [(x.strip(), at) for x, window in packed if x]
            start = end
        elif end - start > 2000:
            say(start, at, 50)
            tail = max(start, at - 200)
            blank = text.find(" ", tail, at)
            start = blank + 1 if blank > tail else tail
        at = end
    say(start, at, 50)
    return out


def test_chunks_equal_a_model_over_places(spark, duck):
    rng = __import__("random").Random(3)
    texts = [r[0] for r in duck.sql("SELECT text FROM documents").fetchall()]
    for _ in range(150):
        texts.append("\n\n".join("".join(rng.choice("abcdé.!? ") for _ in range(rng.choice([5, 90, 700, 1900, 5000]))) for _ in range(rng.randrange(1, 9))))
    for text, got in zip(texts, cut(spark, texts), strict=True):
        assert [(c.content, c.start_char) for c in got] == plain_model(text)
        assert [c.chunk_index for c in got] == list(range(len(got))) and all(c.token_count == len(c.content) // 4 and c.section is None for c in got)


def test_chunk_rules(spark):
    short, least, long, packed, none = cut(spark, ["x" * 19, "x" * 20, "y" * 5000, "\n\n".join(["word " * 180] * 4), None])
    assert short == [] and len(least) == 1 and none == []
    assert [len(c.content) for c in long] == [2000, 2000, 1400]
    assert len(packed) >= 2 and all(len(c.content) <= 2200 for c in packed)
    titles = spark.createDataFrame([("intro\n# One\na\n1. Two\nb",)], "t string").select(C.sections_of("t").alias("s")).first().s
    assert [s.title for s in titles] == [None, "One", "Two"] and [s.body for s in titles] == ["intro", "# One\na", "1. Two\nb"]


def test_section_chunks(spark, duck):
    """Every chunk of whole documents lies in its section, and every section of 200 to 2000 characters in one paragraph is a chunk."""
    texts = [r[0] for r in duck.sql("SELECT text FROM documents").fetchall()] + ["# A\n" + "word " * 60 + "\nII. B\n" + "other " * 50 + "\nSHORT PART\nfew words"]
    for text, got in zip(texts, cut(spark, texts, C.chunk_sections), strict=True):
        assert all(len(c.content) >= 200 for c in got)
        for c in got:
            assert all(re.sub(r"\s+", " ", part) in re.sub(r"\s+", " ", text) for part in re.split(r"\n\n", c.content)[1:-1])
    assert [(c.section, c.content[:5]) for c in got] == [("A", "# A\nw"), ("B", "II. B")]


def test_tables_and_forms(spark):
    text = "a\tb\n1\t2\n3\t4\nend"
    (t,) = L.text_tables(text)
    assert (t["headers"], t["rows"]) == (["a", "b"], [["1", "2"], ["3", "4"]])
    assert L.text_tables("a,b\n1,2") == []
    drawn = "+--+\n| a |\n+--+\n| 1 |\n| 2 |\n+--+\nend"
    assert [x["rows"] for x in L.text_tables(drawn) if x["source"] == "drawn"] == [[["1"], ["2"]]]
    assert [x for x in L.text_tables(drawn[:-4]) if x["source"] == "drawn"] == []
    assert len(L.merged_tables([{"headers": ["A"], "rows": [["1"]]}, {"headers": ["a"], "rows": [["2"]]}])) == 1
    assert L.table_markdown({"headers": ["a"], "rows": [["1"]]}) == "| a |\n| --- |\n| 1 |"
    rows = spark.createDataFrame([(1, "Name: Bob\nDate ..... today\nCity ____ Rome\n[x] Agree\n[ ] Refuse\n☑ Yes")], "doc_id int, text string")
    got = {(r.field_type, r.label, r.value) for r in L.form_fields(rows).collect()}
    assert got == {("text", "Name", "Bob"), ("text", "Date", "today"), ("text", "City", "Rome"), ("checkbox", "x", "true"), ("checkbox", "Refuse", "false"), ("checkbox", "Yes", "true")}
    boxes = [{"text": "Name:", "x": 0, "y": 0, "w": 30}, {"text": "Bob", "x": 200, "y": 4, "w": 20}, {"text": "z", "x": 0, "y": 30, "w": 5}]
    assert L.aligned_fields(boxes) == [("Name", "Bob")] and len(L.lines_of_boxes(boxes)) == 2


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(cosine("a", "b")).collect()] == [1.0, 0.0, 0.0]
    assert df.select(normalized("a")).first()[0] == [0.6, 0.8]
