"""Splitting documents into chunks: sections, paragraphs packed to a target size, atomic tables and figures.

A document's chunks are built by array functions inside its own row, so chunking needs no shuffle and
whole documents never leave their task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import rows_to_markdown, strip, token_estimate

HEADING = r"(?m)^(?=#{1,4}[ \t]+\S)"


def sections(text: Column) -> Column:
    """array<struct<level, title, body>>: a part before the first heading has level 0; parts without text are left out."""
    parts = F.split(F.coalesce(text, F.lit("")), HEADING)

    def one(p: Column) -> Column:
        mark = F.regexp_extract(p, r"^(#{1,4})[ \t]+(\S[^\n]*)", 1)
        title = F.trim(F.regexp_extract(p, r"^(#{1,4})[ \t]+(\S[^\n]*)", 2))
        body = F.when(mark == "", p).otherwise(F.regexp_replace(p, r"^#{1,4}[ \t]+\S[^\n]*\n?", ""))
        return F.struct(F.length(mark).alias("level"), title.alias("title"), strip(body).alias("body"))

    return F.filter(F.transform(parts, one), lambda s: s["body"] != "")


def pack(paragraphs: Column, target: int = 500, overlap: float = 0.12) -> Column:
    """Paragraphs joined up to ``target`` tokens; each chunk repeats whole trailing paragraphs of up to ``overlap`` of it.

    A paragraph that is larger than the target stays whole."""
    keep = int(target * overlap)
    items = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), token_estimate(p).alias("n")))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.expr("cast(array() as array<struct<p:string,n:bigint>>)").alias("now"), F.lit(0).cast("long").alias("size"))
    text = lambda now: F.array_join(F.transform(now, lambda x: x["p"]), "\n\n")

    def tail(now: Column) -> Column:
        """The longest run of last paragraphs that fits the overlap."""
        none = F.struct(F.expr("cast(array() as array<struct<p:string,n:bigint>>)").alias("kept"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("open"))
        return F.aggregate(F.reverse(now), none, lambda a, x: F.when(a["open"] & (a["size"] + x["n"] <= keep), F.struct(F.concat(F.array(x), a["kept"]).alias("kept"), (a["size"] + x["n"]).alias("size"), F.lit(True).alias("open"))).otherwise(F.struct(a["kept"].alias("kept"), a["size"].alias("size"), F.lit(False).alias("open"))))

    def add(a: Column, x: Column) -> Column:
        full = (F.size(a["now"]) > 0) & (a["size"] + x["n"] > target)
        rest = tail(a["now"])
        return F.when(full, F.struct(F.concat(a["done"], F.array(text(a["now"]))).alias("done"), F.concat(rest["kept"], F.array(x)).alias("now"), (rest["size"] + x["n"]).alias("size"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(x)).alias("now"), (a["size"] + x["n"]).alias("size")))

    return F.aggregate(items, start, add, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(text(a["now"])))).otherwise(a["done"]))


def paragraphs(text: Column, separator: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), strip), lambda p: p != "")


def chunk_prose(docs: DataFrame, id_col: str, text_col: str, target: int = 500, overlap: float = 0.12, separator: str = r"\n\s*\n") -> DataFrame:
    """(id, section, level, title, seq, chunk_id, content, tokens): chunks never cross a heading."""
    parts = docs.select(F.col(id_col), F.posexplode(sections(F.col(text_col))).alias("section", "s"))
    chunks = parts.select(id_col, "section", "s.level", "s.title", F.posexplode(pack(paragraphs(F.col("s.body"), separator), target, overlap)).alias("seq", "content"))
    ident = F.concat(F.col(id_col).cast("string"), F.lit("_chunk_"), F.lpad(F.col("section").cast("string"), 4, "0"), F.lit("_"), F.lpad(F.col("seq").cast("string"), 4, "0"))
    return chunks.withColumns({"chunk_id": ident, "tokens": token_estimate("content")})


def chunk_tables(pages: DataFrame, id_col: str, tables_col: str = "tables", page_col: str = "page") -> DataFrame:
    """One atomic chunk for each table (array<array<string>>) of a page."""
    each = pages.select(id_col, page_col, F.posexplode(F.col(tables_col)).alias("index", "rows"))
    return each.select(id_col, page_col, F.lit("table").alias("kind"), "index", rows_to_markdown("rows").alias("content")).filter("content is not null")


def chunk_figures(pages: DataFrame, id_col: str, figures_col: str = "figures", page_col: str = "page") -> DataFrame:
    """One atomic chunk for each figure (struct caption, description, ocr_text) that has any text."""
    each = pages.select(id_col, page_col, F.posexplode(F.col(figures_col)).alias("index", "f"))
    parts = F.array(F.concat(F.lit("Caption: "), F.nullif(F.trim("f.caption"), F.lit(""))), F.concat(F.lit("Description: "), F.nullif(F.trim("f.description"), F.lit(""))), F.concat(F.lit("Text: "), F.nullif(F.trim("f.ocr_text"), F.lit(""))))
    return each.select(id_col, page_col, F.lit("figure").alias("kind"), "index", F.array_join(F.array_compact(parts), "\n").alias("content")).filter("content <> ''")


def with_parents(chunks: DataFrame, id_col: str, path_col: str = "title", order_col: str = "seq") -> DataFrame:
    """The first chunk of a section leads; the others name it as ``parent_chunk_id``."""
    w = Window.partitionBy(id_col, path_col).orderBy("section", order_col) if "section" in chunks.columns else Window.partitionBy(id_col, path_col).orderBy(order_col)
    leader = F.first("chunk_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return chunks.withColumn("parent_chunk_id", F.when(leader != F.col("chunk_id"), leader))
