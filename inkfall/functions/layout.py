"""Tables and forms that stand in plain text, and word boxes on a page."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfall.functions.lazy import pandas_function

DELIMITERS = ("\t", "|", ";", ",")
LEAST_ROWS = 3
_BORDER = re.compile(r"\s*[+|][-+|]+[+|]\s*$")
TABLES = "array<struct<source:string,headers:array<string>,rows:array<array<string>>,confidence:double>>"
# How a label and its value stand on a line, in the order in which they are tried.
PAIRS = (
    (r"^([A-Za-z][A-Za-z\s.,()-]{2,50}):\s*(.*)$", "colon"),
    (r"^([A-Za-z][A-Za-z\s]{2,50})\.{3,}\s*(.*)$", "dot_leader"),
    (r"^([A-Za-z][A-Za-z\s]{2,50})_{3,}\s*(.*)$", "underline"),
    (r"^([A-Za-z][A-Za-z\s]{2,30})\s{3,}(.+)$", "space"),
)
# Check boxes and whether they are ticked; the first group is the label.
BOXES = ((r"\[([xX✓])\]\s*(.+)", True), (r"\[\s*\]\s*(.+)", False), (r"\(([xX✓])\)\s*(.+)", True), (r"\(\s*\)\s*(.+)", False), (r"☑\s*(.+)", True), (r"☐\s*(.+)", False), (r"✓\s*(.+)", True))


def delimited_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tables by delimiter: key, delimiter, first_line, n_rows, n_cols of three or more lines in a row with equally many cells.

    A run is found by its lines' number less their place among the lines of equal width, so no line is
    compared with the next by hand.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    cells = lines.select(key, "line_no", F.explode(F.array(*map(F.lit, DELIMITERS))).alias("delimiter"), "line")
    cells = cells.withColumn("n_cols", F.length("line") - F.length(F.replace(F.col("line"), F.col("delimiter"), F.lit(""))) + 1)
    cells = cells.where("n_cols >= 2")
    order = Window.partitionBy(key, "delimiter", "n_cols").orderBy("line_no")
    runs = cells.withColumn("run", F.col("line_no") - F.row_number().over(order))
    found = runs.groupBy(key, "delimiter", "n_cols", "run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_rows"))
    return found.where(F.col("n_rows") >= LEAST_ROWS).select(key, "delimiter", "first_line", "n_rows", F.col("n_cols").cast("long").alias("n_cols"))


def text_tables(text: str | None) -> list[dict]:
    """Delimited tables, one delimiter after the other, then drawn ones; a drawn table needs a line after it to end."""
    lines, out = (text or "").split("\n"), []
    for d in DELIMITERS:
        run: list[list[str]] = []
        for line in [*lines, ""]:
            cells = line.split(d)
            if run and len(cells) != len(run[0]):
                if len(run) >= LEAST_ROWS:
                    out.append({"source": "delimiter", "headers": run[0], "rows": run[1:], "confidence": 0.7})
                run = []
            if len(cells) >= 2:
                run.append([c.strip() for c in cells])
    drawn: list[str] = []
    for line in lines:
        if _BORDER.match(line) or (drawn and "|" in line):
            drawn.append(line)
        elif drawn:
            rows = [[c.strip() for c in x.split("|")[1:-1]] for x in drawn if "|" in x and not _BORDER.match(x)]
            rows = [r for r in rows if r]
            if len(drawn) >= LEAST_ROWS and len(rows) >= 2:
                out.append({"source": "drawn", "headers": rows[0], "rows": rows[1:], "confidence": 0.8})
            drawn = []
    return out


def merged_tables(tables: list[dict]) -> list[dict]:
    """Tables that follow one another with the same headers, case aside, become one."""
    out: list[dict] = []
    for t in tables:
        if out and [h.lower() for h in out[-1]["headers"]] == [h.lower() for h in t["headers"]]:
            out[-1] = out[-1] | {"rows": out[-1]["rows"] + t["rows"]}
        else:
            out.append(dict(t))
    return out


def table_text(t: dict, most_rows: int = 100) -> str:
    head = [" | ".join(t["headers"]), "-" * 40] if t["headers"] else []
    return "\n".join(head + [" | ".join(r) for r in t["rows"][:most_rows]])


def table_markdown(t: dict) -> str:
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(t["headers"]), line(["---"] * len(t["headers"])), *map(line, t["rows"])])


@pandas_function(TABLES)
def tables_in(s: pd.Series) -> pd.Series:
    return s.map(lambda t: merged_tables(text_tables(t)))


def form_fields(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, field_type, label, value, confidence, source: labelled values and check boxes, by line."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    kind, label, value = (F.lit(None).cast("string") for _ in range(3))
    for shape, name in reversed(PAIRS):
        hit = F.col("line").rlike("(?i)" + shape)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
        label = F.when(hit, F.trim(F.regexp_extract("line", "(?i)" + shape, 1))).otherwise(label)
        value = F.when(hit, F.trim(F.regexp_extract("line", "(?i)" + shape, 2))).otherwise(value)
    pairs = lines.select(key, "line_no", kind.alias("kind"), label.alias("label"), value.alias("value")).where(F.col("kind").isNotNull() & F.length("label").between(2, 50) & F.col("label").rlike("[A-Za-z]"))
    pairs = pairs.select(key, "line_no", F.lit("text").alias("field_type"), "label", "value", F.when(F.col("value") != "", 0.8).otherwise(0.6).alias("confidence"), F.concat(F.lit("pattern_"), "kind").alias("source"))
    mark, ticked = F.lit(None).cast("string"), F.lit(None).cast("string")
    for shape, on in reversed(BOXES):
        hit = F.col("line").rlike("^" + shape)
        mark = F.when(hit, F.trim(F.regexp_extract("line", "^" + shape, 1))).otherwise(mark)
        ticked = F.when(hit, F.lit(str(on).lower())).otherwise(ticked)
    boxes = lines.select(key, "line_no", mark.alias("label"), ticked.alias("value")).where(F.coalesce("label", F.lit("")) != "")
    return pairs.unionByName(boxes.select(key, "line_no", F.lit("checkbox").alias("field_type"), "label", "value", F.lit(0.9).alias("confidence"), F.lit("pattern_checkbox").alias("source")))


def key_values(c, patterns: tuple[str, ...] = (r"([A-Za-z][A-Za-z\s]+):\s*(.+)", r"([A-Za-z][A-Za-z\s]+)\s{2,}(.+)"), chars: int = 2000, most: int = 20):
    """key, value of what looks like labelled values in the head of a page: at most 20 finds of each pattern, with keys of 3 to 49 characters."""
    from inkfall.functions.text import col, strip

    head = F.substring(F.coalesce(col(c), F.lit("")), 1, chars)

    def pairs(p):
        found = F.slice(F.regexp_extract_all(head, F.lit(p), F.lit(0)), 1, most)
        pair = lambda x: F.struct(strip(F.regexp_extract(x, p, 1)).alias("key"), strip(F.regexp_extract(x, p, 2)).alias("value"))
        return F.filter(F.transform(found, pair), lambda x: F.length(x["key"]).between(3, 49) & (x["value"] != ""))

    return F.concat(*map(pairs, patterns))


def layout_summary(boxes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block_count, word_count, avg_word_confidence of word boxes (key, block_num, confidence)."""
    return boxes.groupBy(key).agg(F.countDistinct(F.coalesce("block_num", F.lit(0))).alias("block_count"), F.count("*").alias("word_count"), F.avg("confidence").alias("avg_word_confidence"))


def page_confidence(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, avg_ocr_confidence over the pages that were recognised, low_pages: the numbers of those of low confidence."""
    from inkfall.functions.text import confidence_level

    seen = F.col("confidence").isNotNull()
    low = F.when(seen & (confidence_level("confidence") == "low"), F.col("page_num"))
    return pages.groupBy(key).agg(F.avg("confidence").alias("avg_ocr_confidence"), F.sort_array(F.collect_list(low)).alias("low_pages"))


def lines_of_words(boxes: DataFrame, key: str = "page_id", tolerance: float = 10) -> DataFrame:
    """key, line, text: a page's words (text, x, y) in lines, by a fold over its words in the order of y.

    A word joins the line while its y is near that of the line's first word. A page's words are one row.
    """
    box = F.struct("y", "x", "text")
    pages = boxes.groupBy(key).agg(F.sort_array(F.collect_list(box)).alias("words"))

    def step(acc, w):
        near = (F.size(acc) > 0) & (F.abs(w["y"] - F.get(F.get(acc, F.size(acc) - 1), F.lit(0))["y"]) <= tolerance)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.get(acc, F.size(acc) - 1), F.array(w))))
        return F.when(near, joined).otherwise(F.concat(acc, F.array(F.array(w))))

    kinds = dict(boxes.dtypes)
    lines = F.aggregate("words", F.array().cast(f"array<array<struct<y:{kinds['y']},x:{kinds['x']},text:{kinds['text']}>>>"), step)
    by_x = lambda line: F.array_sort(F.transform(line, lambda w: F.struct(w["x"].alias("x"), w["text"].alias("text"))))
    said = F.transform(lines, lambda line: F.array_join(F.transform(by_x(line), lambda w: w["text"]), " "))
    return pages.select(key, F.posexplode(said).alias("line", "text"))


def lines_of_boxes(boxes: list[dict], tolerance: float = 10) -> list[list[dict]]:
    """Word boxes (text, x, y) in lines: a box joins while its y is near that of the line's first box."""
    out: list[list[dict]] = []
    for b in sorted(boxes, key=lambda b: (b["y"], b["x"])):
        if out and abs(b["y"] - out[-1][0]["y"]) <= tolerance:
            out[-1].append(b)
        else:
            out.append([b])
    return [sorted(line, key=lambda b: b["x"]) for line in out]


def aligned_fields(boxes: list[dict], gap: float = 50) -> list[tuple[str, str]]:
    """Label and value of lines whose words stand in two groups with a wide gap between."""
    out = []
    for line in lines_of_boxes(boxes):
        for i in range(1, len(line)):
            if line[i]["x"] - (line[i - 1]["x"] + line[i - 1].get("w", 0)) > gap:
                out.append((" ".join(b["text"] for b in line[:i]).rstrip(":"), " ".join(b["text"] for b in line[i:])))
                break
    return out


@pandas_function("array<struct<label:string,value:string>>")
def aligned_in(pages: pd.Series) -> pd.Series:
    return pages.map(lambda boxes: [{"label": a, "value": b} for a, b in aligned_fields(list(boxes))])


def aligned_rows(boxes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, label, value of the lines of a page whose words (text, x, y, w) stand in two groups. A page's words are one row."""
    pages = boxes.groupBy(key).agg(F.collect_list(F.struct("text", "x", "y", "w")).alias("boxes"))
    return pages.select(key, F.inline(aligned_in("boxes")))


def otsu_threshold(histogram: DataFrame) -> DataFrame:
    """The grey level of (level, n) rows that parts them best: the largest variance between both sides."""
    up = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # 256 rows
    every = Window.partitionBy()
    h = histogram.select("level", F.col("n").cast("double").alias("n"))
    h = h.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("level")).over(up), "w": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("level")).over(every)})
    apart = F.when((F.col("w0") > 0) & (F.col("w0") < F.col("w")), F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), F.lit(2)))
    return h.select("level", apart.alias("apart")).where("apart IS NOT NULL").agg(F.max_by("level", F.struct("apart", -F.col("level"))).alias("threshold"))


def document_like(levels: str | object) -> object:
    """Whether a 256-level histogram is of a page of text: mostly light, little in between."""
    from inkfall.functions.text import col

    total = lambda lo, n: F.aggregate(F.slice(col(levels), lo + 1, n), F.lit(0).cast("double"), lambda s, x: s + x)
    every = total(0, 256)
    return F.coalesce((total(200, 56) / every > 0.5) & (total(64, 128) / every < 0.3), F.lit(False))
