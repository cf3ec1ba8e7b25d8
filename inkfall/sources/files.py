"""Files as documents: scanning folders, reading formats, exporting lists, encrypting columns."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfall.functions.lazy import pandas_function

from inkfall.functions.text import strip_rtf

TEXT = ("txt", "md", "rst", "log", "json", "xml", "yaml", "yml")
TABLES, PAGES = ("csv", "tsv"), ("html", "htm", "xhtml")
OFFICE = ("docx", "doc", "xlsx", "xlsm", "xls")
#: Their text needs a reader of PDF or pictures, which is not part of this library.
OTHER = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp")


def extension(c):
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression for one path segment."""
    return "".join({"*": "[^/]*", "?": "[^/]"}.get(x, "\\" + x if not x.isalnum() else x) for x in glob)


def scan(spark: SparkSession, folder: str, ignore: tuple[str, ...] = (), contains: tuple[str, ...] = (), extensions: tuple[str, ...] = TEXT + TABLES + PAGES + OFFICE, max_bytes: int = 500 << 20) -> DataFrame:
    """path, modified, size, content of the files below a folder.

    A glob leaves out a file if it fits its name or any folder above it, a part if the path holds it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    keep = extension(F.col("path")).isin(*extensions) & (F.col("length") <= max_bytes)
    for g in ignore:
        keep = keep & ~F.col("path").rlike(f"(^|/){glob_pattern(g)}(/|$)")
    for p in contains:
        keep = keep & ~F.col("path").contains(p)
    return files.where(keep).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def with_digest(files: DataFrame, bits: int = 256) -> DataFrame:
    return files.withColumn("hash", F.sha2("content", bits))


class _Page(HTMLParser):
    """Text nodes, each on a line of its own, without those of scripts, styles and the like."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.skip, self.in_title = [], None, 0, False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.in_title |= tag == "title"

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style")))
        self.in_title &= tag != "title"

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title and self.title is None:
            self.title = data.strip()
        if data.strip():
            self.parts.append(data.strip())


def html_text(raw: str | None) -> dict:
    p = _Page()
    p.feed(raw or "")
    p.close()
    return {"title": p.title, "text": "\n".join(p.parts)}


def _frame(found: list[dict], schema: str) -> pd.DataFrame:
    """Strings, None where there is none."""
    return pd.DataFrame({c: pd.Series([x.get(c) for x in found], dtype=object) for c in (f.split()[0] for f in schema.split(", "))})


@pandas_function("title string, text string")
def html_document(s: pd.Series) -> pd.DataFrame:
    return _frame([html_text(x) if x is not None else {} for x in s], "title string, text string")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_DT = "{http://purl.org/dc/terms/}"


def docx_text(raw: bytes) -> dict:
    """Paragraphs, then tables as rows of cells joined by bars, and the core properties."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        props = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines = [x for x in (words(p) for p in body.findall(f"{_W}p")) if x.strip()]
    for t in body.findall(f"{_W}tbl"):
        for row in t.iter(f"{_W}tr"):
            cells = [words(c).strip() for c in row.findall(f"{_W}tc")]
            if any(cells):
                lines.append(" | ".join(cells))
    say = lambda tag: props.findtext(tag) if props is not None else None
    return {"text": "\n".join(lines), "title": say(f"{_DC}title"), "author": say(f"{_DC}creator"), "created": say(f"{_DT}created"), "modified": say(f"{_DT}modified")}


def xlsx_text(raw: bytes) -> dict:
    """Every sheet under a line with its name, rows as cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        lines = []
        for title, name in zip(titles, sheets, strict=False):
            lines.append(f"=== Sheet: {title} ===")
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.findtext(f"{_S}v") or "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if any(x.strip() for x in cells):
                    lines.append(" | ".join(cells))
    return {"text": "\n".join(lines), "title": None, "author": None, "created": None, "modified": None}


DOCUMENT = "text string, title string, author string, created string, modified string, error string"


def office_text(kind: str, raw: bytes) -> dict:
    """A broken file gives an error in its own row and never fails the job."""
    if kind is None:
        return {}
    try:
        return {"docx": docx_text, "xlsx": xlsx_text, "xlsm": xlsx_text}[kind](raw) | {"error": None}
    except Exception as e:  # whatever a damaged archive raises
        return {"text": None, "title": None, "author": None, "created": None, "modified": None, "error": f"{type(e).__name__}: {e}"}


@pandas_function(DOCUMENT)
def office_document(kind: pd.Series, raw: pd.Series) -> pd.DataFrame:
    return _frame([office_text(k, r) for k, r in zip(kind, raw, strict=True)], DOCUMENT)


def delimited(kind: str | None, text: str | None) -> str | None:
    """Rows of a delimited text as cells joined by bars, without rows whose cells are all blank. A quoted cell may hold anything."""
    if kind is None or text is None:
        return None
    rows = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if kind == "tsv" else ",")
    return "\n".join(" | ".join(cells) for cells in rows if any(c.strip() for c in cells))


@pandas_function("string")
def delimited_text(kind: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([delimited(k, x) for k, x in zip(kind, text, strict=True)], dtype=object)


def extract(files: DataFrame) -> DataFrame:
    """path, file_type, text, title, author, created, modified, error: each family by its own reader.

    The files are read once: every reader gets the rows of its family, and null for all others.
    """
    kind = F.col("file_type")
    text = F.make_valid_utf8(F.col("content").cast("string")) if hasattr(F, "make_valid_utf8") else F.decode("content", "utf-8")
    rows = files.withColumn("file_type", extension(F.col("path"))).withColumn("raw", F.when(kind.isin(*TEXT, *TABLES, *PAGES, "doc"), text))
    of = lambda types, c: F.when(kind.isin(*types), c)
    office = ("docx", "xlsx", "xlsm")
    rows = rows.select(
        "path",
        "file_type",
        "raw",
        delimited_text(of(TABLES, kind), of(TABLES, F.col("raw"))).alias("cells"),
        html_document(of(PAGES, F.col("raw"))).alias("page"),
        office_document(of(office, kind), of(office, F.col("content"))).alias("office"),
    )
    old = F.when(F.length(strip_rtf(F.col("raw"))) > 50, strip_rtf(F.col("raw")))
    known = kind.isin(*TEXT, *TABLES, *PAGES, *office, "doc")
    told = lambda name: F.when(kind.isin(*office), F.col(f"office.{name}"))
    return rows.select(
        "path",
        "file_type",
        F.when(kind.isin(*TEXT), F.col("raw")).when(kind.isin(*TABLES), F.col("cells")).when(kind.isin(*PAGES), F.col("page.text")).when(kind == "doc", old).otherwise(told("text")).alias("text"),
        F.when(kind.isin(*PAGES), F.col("page.title")).otherwise(told("title")).alias("title"),
        *[told(x).alias(x) for x in ("author", "created", "modified")],
        F.when(~known, F.lit("no reader for this type")).otherwise(told("error")).alias("error"),
    )


def export_lines(df: DataFrame, column: str, path: str) -> None:
    """A column as lines of text."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def replaced(df: DataFrame, path: str) -> None:
    """Writes a table beside the old one, which it may be made from, and puts it in its place by a rename.

    A run that fails on the way leaves the old table as it was, or, between the two renames, under its name with .old.
    """
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(new)
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.delete(at(old), True)
        fs.rename(at(path), at(old))
    if not fs.rename(at(new), at(path)):
        raise OSError(f"{new} could not be renamed")
    fs.delete(at(old), True)


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, such as progress or a quarantine, as `replaced` left it; an empty one before the first time."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    held = next((x for x in (path, f"{path.rstrip('/')}.old") if fs.exists(at(x))), None)
    return spark.createDataFrame([], schema) if held is None else spark.read.schema(schema).parquet(held)


def tenant_folder(base: str, tenant: str) -> str:
    """A tenant's own folder; a name that would lead out of it is refused."""
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}", tenant):
        raise ValueError(f"{tenant!r} cannot name a tenant")
    return f"{base.rstrip('/')}/{tenant}"


def log_lines(rows: DataFrame, event: str, level: str = "INFO") -> DataFrame:
    """value: a line of JSON per row with time, level, event and the row's columns; write it as text."""
    return rows.select(F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), F.lit(level).alias("level"), F.lit(event).alias("event"), *rows.columns)).alias("value"))


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def restored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def emptied(df: DataFrame, path: str) -> None:
    df.where(F.lit(False)).write.mode("overwrite").parquet(path)


def derived_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    import hashlib

    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypted(c, key: bytes):
    """AES-GCM: a random nonce, the text and its tag."""
    return F.aes_encrypt(c, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))


def decrypted(c, key: bytes):
    return F.aes_decrypt(c, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")).cast("string")
