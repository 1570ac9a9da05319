"""Text functions, chunking and suppression against plain models."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import classify as C, dates, privacy as P, text as T, vectors as V
from tessera.operators import chunking as K, dedup as D


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def model_pack(paragraphs, target, overlap):
    cost = lambda p: max(1, len(p) // 4)
    out, now, size = [], [], 0
    for p in paragraphs:
        if now and size + cost(p) > target:
            out.append("\n\n".join(now))
            tail, used = [], 0
            for q in reversed(now):
                if used + cost(q) > int(target * overlap):
                    break
                tail.insert(0, q)
                used += cost(q)
            now, size = tail, used
        now.append(p)
        size += cost(p)
    return out + (["\n\n".join(now)] if now else [])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc d", min_size=1, max_size=80).map(lambda x: "p" + x), max_size=25), st.integers(5, 60))
def test_pack(spark, paragraphs, target):
    got = spark.createDataFrame([(paragraphs,)], "p array<string>").select(K.pack(F.col("p"), target, 0.3).alias("c")).first()["c"]
    assert got == model_pack(paragraphs, target, 0.3)
    assert all(any(p in c for c in got) for p in paragraphs)


def test_sections(spark):
    text = "intro\n# One\nbody 1\n\nmore\n## Two\n\n### Three\nlast #4 not\n##### five stays"
    got = one(spark, K.sections(F.lit(text)))
    assert [(s["level"], s["title"], s["body"]) for s in got] == [(0, "", "intro"), (1, "One", "body 1\n\nmore"), (3, "Three", "last #4 not\n##### five stays")]
    assert one(spark, K.sections(F.lit(None).cast("string"))) == []
    assert one(spark, T.heading_count(F.lit(text))) == 3


def test_chunks_never_cross_headings(spark):
    df = spark.createDataFrame([(1, "# A\none\n\ntwo\n# B\nthree"), (2, None), (3, "")], "doc_id long, text string")
    rows = K.with_parents(K.chunk_prose(df, "doc_id", "text"), "doc_id").orderBy("chunk_id").collect()
    assert [(r["title"], r["content"], r["parent_chunk_id"]) for r in rows] == [("A", "one\n\ntwo", None), ("B", "three", None)]
    small = K.with_parents(K.chunk_prose(df, "doc_id", "text", target=1, overlap=0), "doc_id").orderBy("chunk_id").collect()
    assert [r["parent_chunk_id"] for r in small] == [None, small[0]["chunk_id"], None]


def test_tables_and_figures(spark):
    pages = spark.createDataFrame([(1, 1, [[["a", "b"], ["1"]], []], [("c", None, "t"), (None, "", " ")])], "doc_id long, page int, tables array<array<array<string>>>, figures array<struct<caption:string,description:string,ocr_text:string>>")
    assert [r["content"] for r in K.chunk_tables(pages, "doc_id").collect()] == ["| a | b |\n| --- | --- |\n| 1 |  |"]
    assert [r["content"] for r in K.chunk_figures(pages, "doc_id").collect()] == ["Caption: c\nText: t"]


def model_suppress(texts, threshold):
    kept = []
    for k, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", t.lower())
        s = set(w)
        if any(w == x for x, _, _ in kept) or (len(s) >= 12 and any(y and len(s & y) / len(s | y) >= threshold for _, y, _ in kept)):
            continue
        kept.append((w, s, k))
    return [k for _, _, k in kept]


@pytest.mark.parametrize("threshold", [0.9, 0.6, 1.1])
def test_suppression(spark, data, threshold):
    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(60).collect()
    texts = [r["text"] or "" for r in rows] + ["short one", "Short, one!", " ".join(f"w{k}" for k in range(20)), " ".join(f"w{k}" for k in range(1, 21)), "", ""]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "q int, id int, text string")
    got = sorted(int(r["id"]) for r in D.suppress(df, "q", "id", "text", "id", threshold).collect())
    assert got == model_suppress(texts, threshold)


def test_quality(spark):
    q = lambda t, r=None: one(spark, T.recognition_quality(F.lit(t), F.lit(r).cast("double") if r is not None else None))
    assert q("This is perfectly fine text for a page.").asDict() == {"score": 1.0, "acceptable": True, "advice": "accept"}
    assert q("short")["advice"] == "escalate" and q("☃☃☃☃ ☃☃☃☃ ☃☃☃☃")["advice"] == "flag_for_review"
    assert q("This is perfectly fine text for a page.", 0.5)["acceptable"] is False
    assert one(spark, T.page_structure(F.lit("x" * 200), F.lit(True))) == "mixed" and one(spark, T.page_structure(F.lit(None).cast("string"))) == "scanned"
    assert one(spark, T.document_structure(F.array(F.lit("a"), F.lit("b")))) == "mixed"
    assert one(spark, T.texts_agree(F.lit("a b c"), F.lit("A B C"))) and one(spark, T.texts_agree(F.lit(""), F.lit("")))
    assert one(spark, T.document_type(F.lit("Invoice: total due"))) == "invoice" and one(spark, T.document_type(F.lit("x"), F.lit("pptx"))) == "presentation"


def test_layout(spark):
    spans = F.expr("array(struct('Title' as text, 20.0 as size), struct('body' as text, 10.0 as size), struct('more' as text, 10.0 as size))")
    assert one(spark, T.heading_spans(spans)) == ["Title"]
    assert one(spark, T.mark_headings(F.lit("Title\nbody"), F.array(F.lit("Title")))) == "## Title\nbody"
    assert one(spark, T.expand_acronyms(F.lit("what is the HQ and its capex"))) == "what is the HQ headquarters and its CapEx capital expenditures"
    assert one(spark, T.trigger_phrases(F.lit("total revenue by customer"))) == ["revenue by", "by customer", "revenue by customer"]


def test_privacy(spark):
    got = one(spark, P.scrub(F.lit("mail a.b@c.org or 555-123-4567, ssn 123-45-6789, card 1234 5678 1234 5678, password = hunter2 sk_abcdefghijklmnop1234")))
    assert got == "mail [EMAIL] or [PHONE], ssn [SSN], card [CC], password = [PASSWORD] [API_KEY]"
    assert one(spark, P.scrub(F.lit(None).cast("string"))) == ""
    turn = "From the document.\nSQL Query Executed: `SELECT 1`\n| a |\n| 1 |"
    assert one(spark, P.sanitise_turn(F.lit(turn))) == "[Database result omitted. SQL executed: SELECT 1]"
    assert one(spark, P.sanitise_turn(F.lit(turn), F.lit("model"))).startswith("From the document.\n\n[Database")
    assert one(spark, P.sanitise_turn(F.lit("plain"))) == "plain"
    assert one(spark, P.normalise_error(F.lit("bad password=x in /a/b.py\n\n again"))) == "bad password=*** in [path] | again"
    assert one(spark, P.safe_basename(F.lit("../../etc/passwd"))) == "passwd" and one(spark, P.safe_basename(F.lit("a/.."))) is None
    assert one(spark, P.inside(F.lit("/a/b/c"), "/a/b")) and not one(spark, P.inside(F.lit("/a/b/../c"), "/a/b"))


@pytest.mark.parametrize(("question", "kind", "route"), [
    ("How many orders?", "COUNT", "sql"), ("total sales", "SUM", "sql"), ("show me the suppliers", "LIST", "sql"), ("what is the returns policy", "POLICY", "rag"), ("hello", "OTHER", "hybrid"), ("status of PX100", "OTHER", "sql"),
])
def test_questions(spark, question, kind, route):
    assert one(spark, C.query_type(F.lit(question))) == kind and one(spark, C.route(F.lit(question))) == route


def test_question_parts(spark):
    got = one(spark, C.split_hybrid(F.lit("stock of PX100 / what does the SOP say")))
    assert (got["sql"], got["doc"]) == ("stock of PX100", "what does the SOP say")
    same = one(spark, C.split_hybrid(F.lit("hello there")))
    assert same["sql"] == same["doc"] == "hello there"
    assert one(spark, C.soft_delete_intent(F.lit("orders of the past 6 months"))) == "ACTIVE_ONLY"
    assert one(spark, C.soft_delete_intent(F.lit("deleted orders"))) == "DELETED_ONLY"
    assert one(spark, C.context_action(F.lit("what about them"), F.lit(False))) == "ASK"
    assert one(spark, C.failure_category(F.lit("boom"), F.lit("sql_generation"))) == "sql_syntax_error" and one(spark, C.failure_category(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, C.cache_seconds(F.lit("POLICY"))) == 86400


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, V.cosine(a, b)) - 0.5**0.5) < 1e-12
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0 and one(spark, V.cosine(a, F.array(F.lit(1.0)))) == 0
    m = one(spark, V.sparse(F.expr("array(3, 1, 3, 2)"), F.expr("array(0.5D, 0.2D, 0.9D, -1.0D)")))
    assert m == {1: 0.2, 3: 0.9}
    assert abs(one(spark, V.sparse_dot(F.expr("map(1, 2.0D, 5, 1.0D)"), F.expr("map(1, 3.0D, 6, 1.0D)"))) - 6) < 1e-12


def test_dates(spark):
    d = F.lit("2024-02-15").cast("date")
    assert one(spark, dates.financial_year(d)) == "2023-24" and one(spark, dates.quarter_key(d)) == "2024-Q1"
    assert str(one(spark, dates.day_of_year(F.lit(2024), F.lit(60)))) == "2024-02-29"
    assert [str(one(spark, x)) for x in dates.window("last quarter", d)] == ["2023-10-01", "2024-01-01"]
    assert dates.format_of("%Y-%m-%d") == "yyyy-MM-dd" and one(spark, dates.number(F.lit("12x"))) is None
