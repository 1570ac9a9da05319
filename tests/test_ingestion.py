"""Ingestion of every parsed format as a stream, and what used to be lost on the way."""

import json
import zipfile

import pytest

from tessera.sources import files, sinks
from tessera.streaming import folder

A, R = 'xmlns:a="http://a"', 'xmlns:r="http://r"'


def package(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


SHEETS = {
    "xl/workbook.xml": f'<w xmlns="http://s" {R}><sheets><sheet name="Last" sheetId="9" r:id="rId7"/><sheet name="First" sheetId="2" r:id="rId3"/></sheets></w>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://p"><Relationship Id="rId3" Target="worksheets/sheet2.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet4.xml"/></Relationships>',
    "xl/worksheets/sheet2.xml": '<w xmlns="http://s"><row><c><v>two</v></c></row></w>',
    "xl/worksheets/sheet4.xml": '<w xmlns="http://s"><row><c><v>four</v></c></row></w>',
}
SLIDES = {"ppt/slides/slide1.xml": f'<s {A}><a:p><a:t>Title</a:t></a:p><a:tbl><a:tr><a:tc><a:t>x</a:t></a:tc><a:tc><a:t>y z</a:t></a:tc></a:tr><a:tr><a:tc><a:t>1</a:t></a:tc><a:tc/></a:tr></a:tbl></s>'}


@pytest.fixture
def inbox(tmp_path):
    box = tmp_path / "main.in" / ".cfg's" / "in"
    box.mkdir(parents=True)
    (box / "a.txt").write_text("plain words")
    (box / "b.html").write_text("<html><head><title>no</title></head><p>page words</p></html>")
    (box / "c.json").write_text(json.dumps({"key": "json words"}))
    (box / "d.csv").write_text("one,two\n3,4\n")
    (box / "e.tsv").write_text("five\tsix\n")
    (box / "f.md").write_text("# Head\nmarked words")
    (box / "g.xml").write_text("<x>marked up</x>")
    package(box / "h.xlsx", SHEETS)
    package(box / "i.pptx", SLIDES)
    (box / "broken.docx").write_bytes(b"PK\x03\x04 not a package")
    (box / "scan.pdf").write_bytes(b"%PDF-1.4 nothing to read it with")
    (box / "blank.txt").write_text("  \n")
    (box / ".git").mkdir()
    (box / ".git" / "z.txt").write_text("hidden")
    (box / ".z.txt").write_text("hidden")
    return box


def test_every_format(spark, inbox, tmp_path):
    out, state = str(tmp_path / "chunks"), str(tmp_path / "state")
    run = lambda: folder.ingest(spark, str(inbox), out, state, files_per_batch=4).awaitTermination()
    run()
    found = " ".join(r["content"] for r in spark.read.parquet(out).collect())
    for text in ("plain words", "page words", "json words", "one | two", "five | six", "marked words", "<x>marked up</x>", "four", "two", "y z"):
        assert text in found
    assert "hidden" not in found
    rejected = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in spark.read.parquet(out + "-rejected").collect()}
    assert rejected == {"broken.docx": "damaged, or without text", "scan.pdf": "no parser", "blank.txt": "damaged, or without text"}
    n = spark.read.parquet(out).count()
    (inbox / "copy.csv").write_text("one,two\n3,4\n")
    (inbox / "new.txt").write_text("later words")
    run()
    run()
    assert spark.read.parquet(out).count() == n + 1
    assert spark.read.parquet(out).select("content_hash", "page").distinct().count() == n + 1


def test_forgetting(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    out, state = str(tmp_path / "chunks"), str(tmp_path / "state")
    for name in ("a.txt", "b.txt"):
        (box / name).write_text("same words")
        folder.ingest(spark, str(box), out, state, remember="30 days").awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_discovery_below_odd_folders(spark, inbox):
    names = {r["path"].rsplit("/", 1)[1] for r in files.discover(spark, str(inbox)).select("path").collect()}
    assert {"a.txt", "h.xlsx", "scan.pdf"} <= names and not {"z.txt", ".z.txt"} & names


def test_sheets_and_slide_tables(tmp_path):
    package(tmp_path / "s.xlsx", SHEETS)
    package(tmp_path / "s.pptx", SLIDES)
    assert files.office_pages("xlsx", (tmp_path / "s.xlsx").read_bytes()) == ["Sheet: Last\nfour", "Sheet: First\ntwo"]
    assert files.office_pages("pptx", (tmp_path / "s.pptx").read_bytes()) == ["Title\nx | y z\n1 | "]


def test_report_has_all_rows(spark):
    assert sinks.report(spark.range(1000).repartition(7).orderBy("id"), "t").count("\n") == 1003
