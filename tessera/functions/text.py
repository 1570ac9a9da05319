"""Text measures as Column expressions: estimates, tokens, headings, quality, page and document classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Domain abbreviations and what retrieval adds to them.
ACRONYMS = {
    "fte": "FTE full-time equivalent employees headcount",
    "hq": "HQ headquarters",
    "ipo": "IPO initial public offering",
    "yoy": "YoY year over year",
    "qoq": "QoQ quarter over quarter",
    "capex": "CapEx capital expenditures",
    "opex": "OpEx operating expenses",
    "cagr": "CAGR compound annual growth rate",
    "rag": "RAG retrieval augmented generation",
    "sec": "SEC Securities and Exchange Commission",
    "ebitda": "EBITDA earnings before interest taxes depreciation and amortization",
}
# Words that carry no content in lexical ranking.
STOPWORDS = "the a an of to in on for and or is are was were be what which who how many much do does did with by at as from that this it its compare make table chart show me give".split()
# Characters that text recognition is expected to give, besides word characters and white space.
EXPECTED = r""".,;:!?'"\-(){}\[\]@#$%&*/+=<>|~`^\\€£¥°±²³µ¶·¹º¿÷"""


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column) -> Column:
    """Without any white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def words(text: Column | str) -> Column:
    """White-space separated words; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda w: w != "")


def token_estimate(text: Column | str) -> Column:
    """Chunk size in tokens: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4)).cast("long")


def token_estimate_dense(text: Column | str) -> Column:
    """Prompt size in tokens: the larger of a character and a word estimate; 0 for blank text."""
    clean = F.trim(F.coalesce(_col(text), F.lit("")))
    chars = F.greatest(F.lit(1), F.floor(F.length(clean) / 4.0 + 0.5))
    return F.when(clean == "", 0).otherwise(F.greatest(chars, F.floor(F.size(words(clean)) * 1.3))).cast("long")


def context_estimate(text: Column | str) -> Column:
    """Context size in tokens: a third of the characters."""
    return F.floor(F.length(_col(text)) / 3).cast("long")


def dedup_tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def fingerprint(text: Column | str) -> Column:
    """Equal for texts that differ only in case, punctuation and spacing."""
    return F.sha1(F.array_join(dedup_tokens(text), " "))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 1 for two empty ones, 0 if only one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(common / (F.size(x) + F.size(y) - common))


def texts_agree(a: Column | str, b: Column | str, threshold: float = 0.85) -> Column:
    return jaccard(words(F.lower(_col(a))), words(F.lower(_col(b)))) >= threshold


def content_words(text: Column | str) -> Column:
    """Distinct words of three letters and more that aren't stop words."""
    found = F.array_distinct(dedup_tokens(text))
    return F.array_except(F.filter(found, lambda w: F.length(w) >= 3), F.array(*map(F.lit, STOPWORDS)))


def expand_acronyms(query: Column | str, terms: dict[str, str] = ACRONYMS) -> Column:
    out = _col(query)
    for term, full in terms.items():
        out = F.regexp_replace(out, rf"(?i)\b{term}\b", full)
    return out


def word_runs(w: Column, lengths: tuple[int, ...]) -> Column:
    """All runs of so many neighbouring words, joined by spaces; runs of the first length come first.

    ``w`` is bound once, so that a text isn't split again for each of its words."""

    def of(w: Column, n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))

    return F.get(F.transform(F.array(w), lambda w: F.concat(*[of(w, n) for n in lengths])), F.lit(0))


def trigger_phrases(question: Column | str, most: int = 10) -> Column:
    """Sequences of two to four words without any stop string inside, shortest first."""
    stops = ("the", "a", "an", "is", "are", "was", "were")
    return F.slice(F.filter(word_runs(words(F.lower(_col(question))), (2, 3, 4)), lambda p: ~_any(p, stops)), 1, most)


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def heading_count(text: Column | str) -> Column:
    """Markdown headings of the first four levels."""
    return F.size(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(?m)^(#{1,4})[ \t]+(\S.*)$"), 1)).cast("long")


def recognition_quality(text: Column | str, reported: Column | None = None, least: float = 0.75, max_garbage: float = 0.15, min_words: float = 0.5) -> Column:
    """struct(score, acceptable, advice) of recognised text: reported confidence, share of odd characters, share of plain words."""
    t = F.coalesce(_col(text), F.lit(""))
    n_words = F.size(words(t))
    garbage = F.regexp_count(t, F.lit(rf"[^\w\s{EXPECTED}]")) / F.greatest(F.length(t), F.lit(1))
    plain = F.when(n_words > 0, F.regexp_count(t, F.lit(r"\b[a-zA-Z]{2,}\b")) / n_words).otherwise(0.0)
    parts = [F.greatest(F.lit(0.0), 1 - garbage / max_garbage), F.least(F.lit(1.0), plain / min_words)]
    good = (garbage <= max_garbage) & (plain >= min_words)
    if reported is None:
        raw = (parts[0] + parts[1]) / 2
    else:
        raw = F.when(reported.isNull(), (parts[0] + parts[1]) / 2).otherwise((reported + parts[0] + parts[1]) / 3)
        good = good & (F.coalesce(reported, F.lit(1.0)) >= least)
    short = F.length(F.trim(t)) < 10
    acceptable = ~short & (raw >= least) & good
    advice = F.when(short, "escalate").when(acceptable, "accept").when(raw >= least * 0.6, "escalate").otherwise("flag_for_review")
    return F.struct(F.when(short, 0.0).otherwise(F.round(raw, 3)).alias("score"), acceptable.alias("acceptable"), advice.alias("advice"))


def table_quality(rows: Column | str, min_rows: int = 2, min_cols: int = 2, max_empty: float = 0.5) -> Column:
    """struct(score, acceptable) of an extracted table: a quarter off for each structural fault."""
    r = _col(rows)
    widths = F.transform(r, F.size)
    cells = F.flatten(r)
    empty = F.size(F.filter(cells, lambda c: F.trim(c) == ""))
    some = F.size(r) > 0
    faults = (F.size(r) < min_rows).cast("int")
    faults = faults + F.when(some, (F.array_max(widths) < min_cols).cast("int") + (F.size(F.array_distinct(widths)) > 1).cast("int")).otherwise(0)
    share = F.when(F.size(cells) > 0, empty / F.size(cells)).otherwise(1.0)
    faults = faults + F.when(some, (share > max_empty).cast("int")).otherwise(0)
    return F.struct(F.round(F.greatest(F.lit(0.0), 1 - 0.25 * faults), 3).alias("score"), (faults == 0).alias("acceptable"))


def page_structure(text: Column | str, has_images: Column | None = None, least_chars: int = 100, least_printable: float = 0.6) -> Column:
    """'scanned', 'mixed' or 'native_text' by text density and quality."""
    t = F.coalesce(_col(text), F.lit(""))
    n = F.length(F.trim(t))
    odd = F.regexp_count(t, F.lit(r"[\p{Cntrl}&&[^\n\t]]"))
    printable = 1 - odd / F.greatest(F.length(t), F.lit(1))
    images = F.lit(False) if has_images is None else has_images
    return F.when(n < least_chars, "scanned").when(printable < least_printable, "scanned").when(images & (n < 3 * least_chars), "mixed").otherwise("native_text")


def document_structure(pages: Column) -> Column:
    """The class all pages share, or 'mixed'."""
    kinds = F.array_distinct(pages)
    return F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed")


def document_type(text: Column | str, category: Column | None = None) -> Column:
    """Kind of document by its file category, or by words on its first page."""
    s = F.lower(F.substring(F.coalesce(_col(text), F.lit("")), 1, 2000))
    out = F.when(F.lit(False), "")
    if category is not None:
        out = out.when(category.isin("pptx", "ppt"), "presentation").when(category.isin("xlsx", "xls", "csv", "tsv"), "spreadsheet")
    return (
        out.when(s.contains("abstract") & s.contains("introduction") & s.contains("references"), "scientific_paper")
        .when(s.contains("invoice") & _any(s, ("total", "due", "tax")), "invoice")
        .when(s.contains("financial") & _any(s, ("revenue", "earnings", "quarterly")), "financial_report")
        .otherwise("general")
    )


def rows_to_markdown(rows: Column | str) -> Column:
    """A markdown table of array<array<string>>; short rows are padded to the width of the first. No table of no rows."""

    def table(r: Column) -> Column:
        width = F.size(r[0])
        line = lambda x: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(F.transform(x, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(width - F.size(x), F.lit(0)))), 1, width), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        body = F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), line)
        return F.when(F.size(r) > 0, F.array_join(F.concat(F.array(line(r[0]), rule), body), "\n"))

    return F.get(F.transform(F.array(_col(rows)), table), F.lit(0))


def heading_spans(spans: Column | str, factor: float = 1.2) -> Column:
    """Texts of layout spans (struct text, size) whose font is clearly larger than the median."""
    s = _col(spans)
    sizes = F.array_sort(F.transform(s, lambda x: x["size"]))
    median = F.when(F.size(sizes) > 0, F.element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int")))
    return F.transform(F.filter(s, lambda x: (x["size"] >= factor * median) & (F.trim(x["text"]) != "")), lambda x: F.trim(x["text"]))


def mark_headings(text: Column | str, headings: Column) -> Column:
    """Lines that are headings get a markdown mark."""
    lines = F.split(_col(text), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when((F.trim(x) != "") & F.array_contains(headings, F.trim(x)) & ~x.startswith("#"), F.concat(F.lit("## "), F.trim(x))).otherwise(x)), "\n")
