"""Files, logs, writers and streams on temporary folders."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, jsonl, sinks
from tessera.streaming import folder, telemetry


def office(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


@pytest.fixture
def inbox(tmp_path):
    d = tmp_path / "inbox"
    (d / "sub").mkdir(parents=True)
    (d / ".hidden").mkdir()
    (d / ".hidden" / "x.txt").write_text("no")
    (d / "empty.txt").write_text("")
    (d / "a.txt").write_text("plain ünï")
    (d / "b.csv").write_text("x,y\n,\n1,2\n")
    (d / "sub" / "c.html").write_text("<head><title>t</title></head><script>no</script><p>Hello &amp; <b>you</b></p>")
    (d / "d.json").write_text('{"a":1}')
    (d / "e.json").write_text("{broken")
    (d / "f.md").write_text("# T\nbody")
    (d / "g.bin").write_bytes(b"%PDF-1.4 something")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    office(d / "h.docx", {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    office(d / "i.pptx", {f"ppt/slides/slide{k}.xml": f'<p xmlns:a="{a}"><a:t>Slide {k}</a:t></p>' for k in (1, 2, 10)})
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office(d / "j.xlsx", {"xl/workbook.xml": f'<w xmlns="{s}"><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>name</t></si></sst>', "xl/worksheets/sheet1.xml": f'<s xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c><v></v></c></row></sheetData></s>'})
    (d / "k.docx").write_bytes(b"PK\x03\x04broken")
    return d


def test_files(spark, inbox):
    found = files.detect(files.discover(spark, str(inbox)))
    kinds = {r["path"].split("/")[-1]: r["category"] for r in found.collect()}
    assert "x.txt" not in kinds and "empty.txt" not in kinds
    assert kinds == {"a.txt": "plaintext", "b.csv": "csv", "c.html": "html", "d.json": "json", "e.json": "json", "f.md": "markdown", "g.bin": "pdf", "h.docx": "docx", "i.pptx": "pptx", "j.xlsx": "xlsx", "k.docx": "docx"}
    pages = {(r["path"].split("/")[-1], r["page"]): r["text"] for r in files.pages(found).collect()}
    assert pages["a.txt", 1] == "plain ünï" and pages["b.csv", 1] == "x | y\n\n1 | 2" and pages["c.html", 1] == "Hello &\nyou"
    assert json.loads(pages["d.json", 1]) == {"a": 1} and pages["e.json", 1] == "{broken" and pages["g.bin", 1] == ""
    assert pages["h.docx", 1] == "One\na | b" and [pages["i.pptx", k] for k in (1, 2, 3)] == ["Slide 1", "Slide 2", "Slide 10"] and pages["j.xlsx", 1] == "Sheet: S\nname | 5"


def test_delimited(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('Order No,Order-No, Total €\n1,2,"a,b"\n')
    df = files.read_delimited(spark, str(p))
    assert df.columns == ["order_no", "order_no_1", "total"] and df.first()["total"] == "a,b"


def test_dump(spark, tmp_path):
    p = tmp_path / "d.sql"
    p.write_text("-- noise\nSET NAMES utf8;\nCREATE TABLE t (a int);\nINSERT INTO `t` VALUES (1,'a;b'),(2,'c)d');\nALTER TABLE t ADD x int;\n")
    assert [(r["table"], r["row"]) for r in files.read_dump(spark, str(p)).collect()] == [("t", "(1,'a;b')"), ("t", "(2,'c)d')")]


def test_dump_with_statement_ends_in_literals(spark, tmp_path):
    (tmp_path / "dumps").mkdir()
    (tmp_path / "dumps" / "a.sql").write_text("INSERT INTO t VALUES (1,'a;\nb'),(2,'it\\'s');\nINSERT INTO u VALUES (3,'c');\n")
    (tmp_path / "dumps" / "b.sql").write_text("INSERT INTO v VALUES (4,'d');\n")
    got = sorted((r["table"], r["row"]) for r in files.read_dump(spark, str(tmp_path / "dumps")).collect())
    assert got == [("t", "(1,'a;\nb')"), ("t", "(2,'it\\'s')"), ("u", "(3,'c')"), ("v", "(4,'d')")]


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.csv").write_text('a,b\n"x,y",2\n"two\nlines","say ""hi"""\n,\n')
    (tmp_path / "in" / "q.tsv").write_text('a\tb\n"x\ty"\t2\n')
    got = {r["category"]: r["text"] for r in files.pages(files.detect(files.discover(spark, str(tmp_path / "in")))).collect()}
    assert got["csv"] == 'a | b\n\nx,y | 2\n\ntwo\nlines | say "hi"' and got["tsv"] == "a | b\n\nx\ty | 2"


def test_upsert_that_cannot_move(spark, tmp_path, monkeypatch):
    """A failing rename raises and leaves the old table where it was."""
    path = str(tmp_path / "kept")
    spark.createDataFrame([(1, "a")], "id int, t string").write.parquet(path)

    class Stuck:
        def __init__(self, fs):
            self.fs, self.moves = fs, 0

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            self.moves += 1
            return self.fs.rename(a, b) if self.moves != 2 else False

    monkeypatch.setattr(sinks, "_file_system", lambda s, p: Stuck(p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())))
    with pytest.raises(OSError, match="stays"):
        sinks.upsert(spark, path, spark.createDataFrame([(2, "b")], "id int, t string"), "id")
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [1]


def test_event_lines(spark):
    rows = ['{"query_id": "q1", "stage": "s", "input_tokens": "7", "latency_ms": "x"}', 'INFO {"query_id": " q2 ", "success": false, "extra": {"rows_returned": 0}}', "{bad", "no json", "", '{"stage": null}']
    got = {r["query_id"]: r for r in jsonl.parse_events(spark.createDataFrame([(r,) for r in rows], "value string")).collect()}
    assert set(got) == {"q1", "q2", "unknown_query"}
    assert (got["q1"]["input_tokens"], got["q1"]["latency_ms"], got["q1"]["success"]) == (7, 0.0, True) and (got["q2"]["success"], got["q2"]["rows_returned"]) == (False, 0) and got["unknown_query"]["stage"] == "unknown"
    lines = spark.createDataFrame([("1. First *question*?",), ("text",), ("2) Second",)], "value string")
    assert [(r["number"], r["question"]) for r in jsonl.questions_of_markdown(lines).collect()] == [(1, "First question?"), (2, "Second")]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, v array<double>, document_id string, active boolean")
    sinks.upsert(spark, path, rows((1, [1.0, 2.0], "d", True), (2, [0.0, 0.0], "e", True)), "id", "v", 2)
    for _ in range(2):
        sinks.upsert(spark, path, rows((2, [5.0, 5.0], "e", True), (3, [1.0, 1.0], "f", None)), "id", "v", 2)
    got = spark.read.parquet(path)
    assert {r["id"]: r["v"] for r in got.collect()} == {1: [1.0, 2.0], 2: [5.0, 5.0], 3: [1.0, 1.0]}
    with pytest.raises(Exception, match="length"):
        sinks.upsert(spark, path, rows((9, [1.0], "z", True)), "id", "v", 2)
    assert spark.read.parquet(path).count() == 3
    ids = spark.createDataFrame([("d",)], "document_id string")
    assert sinks.delete_documents(got, ids).count() == 2
    assert {r["id"]: r["active"] for r in sinks.set_active(got, ids, False).collect()} == {1: False, 2: True, 3: None}


def test_payloads(spark):
    df = spark.sql("SELECT 1 AS a, CAST(2.00 AS DECIMAL(10,2)) AS b, CAST(2.50 AS DECIMAL(10,2)) AS c, DATE '2024-01-02' AS d, CAST('x' AS BINARY) AS e, CAST(NULL AS STRING) AS f")
    assert json.loads(sinks.json_rows(df).first()["row"]) == {"a": 1, "b": "2", "c": "2.5", "d": "2024-01-02", "e": "x"}
    text = sinks.markdown(spark.range(12).toDF("n"), "SELECT  n\nFROM t")
    assert text.startswith("SQL Query Executed: `SELECT n FROM t`\n\n| n |\n| --- |\n| 0 |") and text.endswith("_Showing 10 of 12 rows._")
    assert "No matching records" in sinks.markdown(spark.range(0), "SELECT 1") and "NULL" in sinks.markdown(spark.sql("SELECT CAST(NULL AS INT) AS s"), "x", empty_aggregate=True)
    assert sinks.report(spark.range(1).toDF("n"), "T").splitlines()[0] == "# T"


def test_folder_stream(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.txt").write_text("# T\nhello")
    (box / "copy.txt").write_text("# T\nhello")
    out, state = str(tmp_path / "chunks"), str(tmp_path / "state")
    run = lambda: folder.ingest(spark, str(box), out, state).awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 1
    (box / "again.txt").write_text("# T\nhello")
    (box / "b.md").write_text("other")
    run()
    run()
    assert sorted(r["content"] for r in spark.read.parquet(out).collect()) == ["hello", "other"]


def collect_stream(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [("a", f"2024-01-01 00:00:{s:02d}", bad) for s, bad in ((1, True), (2, True), (3, True), (30, True))] + [("a", "2024-01-01 00:05:00", False), ("b", "2024-01-01 00:00:05", False)]
    spark.createDataFrame(rows, "k string, t string, bad boolean").select("k", F.col("t").cast("timestamp").alias("ts"), "bad").coalesce(1).write.parquet(path)
    events = telemetry.read_events(spark, path, spark.read.parquet(path).schema)
    got = {(r["k"], r["n"]) for r in collect_stream(spark, telemetry.windowed(events, "k", "ts", "1 minute", late="1 day"), "w1", "complete", tmp_path)}
    assert got == {("a", 4), ("a", 1), ("b", 1)}
    got = {(r["k"], r["n"]) for r in collect_stream(spark, telemetry.sessions(events, "k", "ts", "45 seconds", late="1 day"), "s1", "complete", tmp_path)}
    assert got == {("a", 4), ("a", 1), ("b", 1)}
    assert len(collect_stream(spark, telemetry.first_seen(events, "k", "ts"), "f1", "append", tmp_path)) == 2
    state = [(r["at"].second, r["streak"], r["open"]) for r in sorted(collect_stream(spark, telemetry.breakers(events, "k", "ts", "bad"), "b1", "append", tmp_path), key=lambda r: r["at"]) if r["key"] == "a"]
    assert state == [(1, 1, False), (2, 2, False), (3, 3, True), (30, 4, True), (0, 0, False)]


def test_breaker_closes_without_a_call(spark, tmp_path):
    """One file for each batch: 'a' trips and is never called again; calls of 'b' move the watermark past its cooldown."""
    path = str(tmp_path / "calls")
    batches = [[("a", 1, True), ("a", 2, True), ("a", 3, True)], [("b", 70, False)], [("b", 200, False)], [("b", 400, False), ("c", 390, True)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "k string, s int, bad boolean").select("k", F.timestamp_seconds(F.col("s") + 1704067200).alias("ts"), "bad")
        df.coalesce(1).write.mode("append").parquet(path)
    events = telemetry.read_events(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    out = collect_stream(spark, telemetry.breakers(events, "k", "ts", "bad", late="10 seconds"), "b2", "append", tmp_path)
    got = sorted((r["key"], int(r["at"].timestamp()) - 1704067200, r["streak"], r["open"]) for r in out)
    assert got == [("a", 1, 1, False), ("a", 2, 2, False), ("a", 3, 3, True), ("a", 63, 0, False), ("b", 70, 0, False), ("b", 200, 0, False), ("b", 400, 0, False), ("c", 390, 1, False)]
