"""Files of a folder: discovery, type detection and parsing into pages.

Everything starts from the ``binaryFile`` source, so any file system that Spark reads will do. Text formats are
parsed by built-in functions; office packages and HTML need a parser, which runs on Arrow batches."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Leading bytes in hexadecimal, extensions and categories.
MAGIC = [("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("424D", "image"), ("49492A00", "image"), ("4D4D002A", "image")]
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "doc": "doc", "pptx": "pptx", "ppt": "ppt", "xlsx": "xlsx", "xls": "xls", "csv": "csv", "tsv": "tsv", "md": "markdown", "markdown": "markdown", "txt": "plaintext", "html": "html", "htm": "html", "xml": "xml", "json": "json", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "tiff": "image", "tif": "image", "webp": "image", "svg": "image"}
PACKAGES = ("docx", "pptx", "xlsx")
PARSED = (*PACKAGES, "html", "json", "plaintext", "markdown", "xml", "csv", "tsv")
OLD = ("doc", "ppt", "xls")
MAX_FILE = 256 << 20  # packages, pages and JSON beyond it raise: their parsers hold a file whole


def hidden_below(spark: SparkSession, folder: str) -> Column:
    """Whether a file's path has a part below ``folder`` that starts with a dot; the folder's own path may have such parts."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(jpath).toUri().getPath()
    # paths of files differ in how they write scheme and host, so both count from where their own path begins
    path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(path, F.lit(len(root) + 1), F.length("path")).rlike(r"(^|/)\.")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files, without hidden and empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter((F.col("length") > 0) & ~hidden_below(spark, folder))


def category(path: Column, content: Column) -> Column:
    """A file's category: its leading bytes decide, packages and plain text are told apart by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    named = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(F.lit(False), "")
    for magic, name in MAGIC:
        kind = kind.when(head.startswith(magic), name)
    by_magic = F.when(kind == "zip", F.when(named.isin(*PACKAGES), named).otherwise("unknown")).when(kind == "ole", F.when(named.isin(*OLD), named).otherwise("unknown")).otherwise(kind)
    return F.coalesce(by_magic, named, F.lit("unknown"))


def detect(files: DataFrame) -> DataFrame:
    """Adds category, extension and content hash."""
    return files.withColumns({"category": category(F.col("path"), F.col("content")), "extension": F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), "content_hash": F.sha2("content", 256)})


class _Text(HTMLParser):
    """Visible text of a page, a line for each piece."""

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.lines.append(data.strip())


def html_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.lines)


def html_to_text(df: DataFrame, html_col: str, out: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def work(pages: pd.Series) -> pd.Series:
        return pages.map(html_text)

    return df.withColumn(out, work(F.col(html_col)))


def pretty_json(text: str) -> str:
    """Indented JSON; malformed text as it is."""
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def _strings(node: ElementTree.Element, tag: str) -> list[str]:
    return [x.text or "" for x in node.iter() if x.tag.endswith("}" + tag)]


def _docx(z: zipfile.ZipFile) -> Iterator[str]:
    body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    lines = ["".join(_strings(p, "t")) for p in body if p.tag.endswith("}p")]
    for table in (x for x in body if x.tag.endswith("}tbl")):
        lines += [" | ".join("".join(_strings(c, "t")).strip() for c in row if c.tag.endswith("}tc")) for row in table if row.tag.endswith("}tr")]
    yield "\n".join(x for x in lines if x.strip())


def _pptx(z: zipfile.ZipFile) -> Iterator[str]:
    number = lambda n: int(re.search(r"(\d+)\.xml", n)[1])
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        slide = ElementTree.fromstring(z.read(name))
        tables = [x for x in slide.iter() if x.tag.endswith("}tbl")]
        inside = {id(t) for table in tables for t in table.iter()}
        text = [x.text for x in slide.iter() if x.tag.endswith("}t") and id(x) not in inside and (x.text or "").strip()]
        text += [" | ".join("".join(_strings(c, "t")).strip() for c in row if c.tag.endswith("}tc")) for table in tables for row in table if row.tag.endswith("}tr")]
        notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
        if notes in z.namelist():
            text.append("Notes: " + " ".join(_strings(ElementTree.fromstring(z.read(notes)), "t")))
        yield "\n".join(text)


def _xlsx(z: zipfile.ZipFile) -> Iterator[str]:
    shared = ["".join(_strings(x, "t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    sheets = [x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if x.tag.endswith("}sheet")]
    # a sheet's file is that of its relationship; packages without relationships have them in order
    targets = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in z.namelist() else {}
    for k, sheet in enumerate(sheets, 1):
        name, rows = sheet.get("name"), []
        target = targets.get(next((v for a, v in sheet.attrib.items() if a.endswith("}id")), None), f"worksheets/sheet{k}.xml")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for row in (x for x in ElementTree.fromstring(z.read(part)).iter() if x.tag.endswith("}row")):
            values = []
            for c in row:
                v = "".join(_strings(c, "v") or _strings(c, "t"))
                values.append(shared[int(v)] if c.get("t") == "s" and v else v)
            if any(v.strip() for v in values):
                rows.append(" | ".join(values))
        yield f"Sheet: {name}\n" + "\n".join(rows)


def office_pages(category: str, content: bytes) -> list[str]:
    """Pages of an office package: a document's text, slides, or sheets. Damaged packages have none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return list({"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}[category](z))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError):
        return []


def pages(files: DataFrame) -> DataFrame:
    """(path, category, page, text) of detected files; formats without a parser here give one empty page."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    small = files.filter(F.col("length") <= MAX_FILE)
    sep = F.when(F.col("category") == "tsv", "\t").otherwise(",")
    # records and cells may hold line breaks and separators between quotes, where two quotes stand for one
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), '""', '"'))
    cells = lambda x: F.when(sep == ",", F.regexp_extract_all(F.concat(F.lit(","), x), F.lit(r',((?:[^",]++|"[^"]*+")*+)'), 1)).otherwise(F.regexp_extract_all(F.concat(F.lit("\t"), x), F.lit(r'\t((?:[^"\t]++|"[^"]*+")*+)'), 1))
    row = lambda x: F.array_join(F.transform(cells(x), cell), " | ")
    records = F.regexp_extract_all(text, F.lit(r'((?:[^"\r\n]++|"[^"]*+")++)'), 1)
    table = F.array_join(F.transform(F.filter(records, lambda x: F.regexp_replace(x, r"[,\t\s]", "") != ""), row), "\n\n")
    plain = files.filter(F.col("category").isin("plaintext", "markdown", "xml", "csv", "tsv")).select("path", "category", F.lit(1).alias("page"), F.when(F.col("category").isin("csv", "tsv"), table).otherwise(text).alias("text"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["category"], batch["content"]):
                raw = bytes(content)
                if kind in PACKAGES:
                    texts = office_pages(kind, raw)
                else:
                    one = raw.decode("utf-8", "replace")
                    texts = [html_text(one) if kind == "html" else pretty_json(one)]
                if texts:
                    yield pd.DataFrame([(path, kind, k, t) for k, t in enumerate(texts, 1)], columns=["path", "category", "page", "text"])

    parsed = small.filter(F.col("category").isin(*PACKAGES, "html", "json")).select("path", "category", "content").mapInPandas(parse, "path string, category string, page int, text string")
    whole = F.col("category").isin(*PACKAGES, "html", "json")
    large = F.when(whole, F.raise_error(F.concat(F.lit("too large to parse: "), F.col("path")))).otherwise("")
    rest = files.filter((whole & (F.col("length") > MAX_FILE)) | ~F.col("category").isin(*PACKAGES, "html", "json", "plaintext", "markdown", "xml", "csv", "tsv")).select("path", "category", F.lit(1).alias("page"), large.alias("text"))
    return plain.unionByName(parsed).unionByName(rest)


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table with a header; column names become snake case, and repeated ones are numbered."""
    df = spark.read.option("header", "true").option("sep", sep).option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    names: list[str] = []
    for c in df.columns:
        base = re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") or "column"
        names.append(base if base not in names else f"{base}_{sum(n.startswith(base) for n in names)}")
    return df.toDF(*names)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(table, row) of the INSERT statements of an SQL dump, one row for each VALUES tuple.

    Files are split at statement ends, so a dump of any size is read by many tasks; session noise, index and
    ALTER statements are passed over."""
    pieces = spark.read.option("lineSep", ";\n").text(path).select("value", "_metadata.file_path")
    open_quote = F.length(F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), "[^']", "")) % 2 == 1
    # files with a statement end inside a literal are split again as a whole
    broken = pieces.filter(open_quote).select("file_path").distinct()
    texts = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path").join(broken, "file_path", "left_semi")
    again = texts.select(F.explode(F.regexp_extract_all("value", F.lit(r"((?:[^';]++|'(?>(?:[^'\\]++|\\.)*)')+)"), 1)).alias("value"))
    statements = pieces.join(broken, "file_path", "left_anti").select("value").unionByName(again)
    clean = statements.select(F.trim(F.regexp_replace("value", r"(?m)^\s*(--[^\n]*|/\*.*?\*/;?)\s*$", "")).alias("s")).filter(F.col("s").rlike(r"(?is)^\s*insert\s+into"))
    name = F.regexp_extract("s", r"(?is)^\s*insert\s+into\s+[`\"]?(\w+)[`\"]?", 1)
    values = F.regexp_extract("s", r"(?is)\bvalues\s*(.*)$", 1)
    tuples = F.regexp_extract_all(values, F.lit(r"(\((?:[^()'\"]|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")*\))"), 1)
    return clean.select(name.alias("table"), F.explode(tuples).alias("row"))


def load_dump(rows: DataFrame, table: str, schema: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Typed rows of one table of a dump, and (error, n) of those that aren't of its schema (name -> type).

    ``rows`` are those of :func:`read_dump`. Quotes, escapes and NULL are resolved; a row with another number of
    values, or with a value that its column's type doesn't take, is counted instead of loaded."""
    inside = F.expr("substring(row, 2, length(row) - 2)")
    cells = F.regexp_extract_all(F.concat(F.lit(","), inside), F.lit(r",\s*('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|[^,'\"]*)\s*"), 1)

    def value(c: Column) -> Column:
        text = F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), "''", "'")
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"(?<!\\)((?:\\\\)*)\\t", "$1\t"), r"\\(.)", "$1")
        return F.when(F.upper(F.trim(c)) == "NULL", None).when(c.rlike(r"^['\"]"), text).otherwise(F.trim(c))

    parsed = rows.filter(F.lower("table") == table.lower()).select(cells.alias("raw")).select(F.transform("raw", value).alias("v"))
    typed = parsed.select("v", *[F.get("v", F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(schema.items())])
    wrong = F.when(F.size("v") != len(schema), F.lit("number of values"))
    for k, name in enumerate(schema):
        wrong = wrong.when(F.get("v", F.lit(k)).isNotNull() & F.col(f"`{name}`").isNull(), F.lit(f"type of {name}"))
    marked = typed.withColumn("error", wrong)
    return marked.filter("error is null").select(*[f"`{c}`" for c in schema]), marked.filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))
