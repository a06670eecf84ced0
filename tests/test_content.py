"""Kinds of content, readers, windows, facts and labels on small fixtures."""

from __future__ import annotations

import io
import zipfile

from conftest import SMALL
from pyspark.sql import functions as F

from folio.operators import chunks, detection, documents, organize, ranking, understanding
from folio.plans import catalogue
from folio.sources import readers


def test_kinds_and_plans(spark):
    rows = [
        ("a.pdf", b"%PDF-1.7"), ("b.docx", b"PK\x03\x04rest"), ("c.txt", b"PK\x03\x04rest"), ("d.txt", "café\n".encode()), ("e.txt", b"\x00\x01"),
        ("f.exe", b"MZ\x90"), ("g", b"plain words"), ("h", None), (None, None), ("i.txt", b"\xff\xfe"), ("j.doc", b""), ("k.png", b"\xff\xd8\xff\xe0"),
    ]
    found = detection.detect(spark.createDataFrame([(n, p, 10) for n, p in rows], "name string, prefix binary, size long"), "name", "prefix")
    got = {r["name"]: (r["kind"], r["mismatch"], r["plan"]) for r in detection.extraction_plan(found, "size", {"pdf": 5}).collect()}
    assert got == {
        "a.pdf": ("pdf", False, "skipped"), "b.docx": ("docx", False, "read_whole"), "c.txt": ("zip", True, "failed"), "d.txt": ("text", False, "read_prefix"),
        "e.txt": ("unknown", False, "unsupported"), "f.exe": ("executable", False, "unsupported"), "g": ("text", False, "read_prefix"), "h": ("unknown", False, "unsupported"),
        None: ("unknown", False, "unsupported"), "i.txt": ("unknown", False, "unsupported"), "j.doc": ("legacy_office", False, "unsupported"), "k.png": ("image", False, "read_whole"),
    }


def test_paths(spark):
    rows = [
        ("a/b.txt", False, False), (".git/config", True, False), ("x/~$doc.docx", True, False), ("x/y.TMP", True, False), ("Foo.app/Contents/run", True, True),
        ("windows/notepad.exe", False, True), ("lib/z.so", False, True), (None, True, False), ("", True, False),
    ]
    df = spark.createDataFrame(rows, "p string, x boolean, y boolean").select("p", "x", "y", detection.excluded(F.col("p")).alias("e"), detection.is_program(F.col("p")).alias("g"))
    assert [(r["p"], r["e"], r["g"]) for r in df.collect()] == rows
    own = spark.createDataFrame([("docs/a.txt",), ("docs2/a.txt",), ("z/A.LOG",), (None,)], "p string").select(detection.excluded_by_user(F.col("p"), ["docs/"], ["log"]))
    assert [r[0] for r in own.collect()] == [True, False, True, False]
    names = spark.createDataFrame([("setup.exe",), ("game.exe",), ("kb123.msi",), ("tool.msi",), ("x.dmg",), (None,)], "n string").select(detection.is_installer(F.col("n")))
    assert [r[0] for r in names.collect()] == [True, False, False, True, True, False]


def test_everyday_folders(spark):
    rows = [("Facture mai.pdf", "document", "Documents/Administratif/Factures"), ("photo.jpg", "image", "Images"), ("x/odd.bin", "other", None), ("odd.bin", "other", "À vérifier"), ("setup.exe", "other", "Installateurs")]
    df = spark.createDataFrame(rows, "p string, g string, f string")
    got = df.select("f", organize.everyday_folder(F.col("p"), F.element_at(F.split("p", "/"), -1), F.col("g")).alias("got")).collect()
    assert all(r["f"] == r["got"] for r in got)


def archive(**entries: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def test_readers(spark, tmp_path):
    w, s = 'xmlns:w="urn:w"', 'xmlns="urn:s"'
    made = {
        "a.zip": archive(**{"ok/x.txt": "hi", "../up.txt": "no", "big": "0" * 3_000_000}), "bad.zip": b"PK\x03\x04nothing", "n.txt": b"\xef\xbb\xbfna\xc3\xafve", "z.txt": b"a\x00b", "i.txt": b"\xff",
        "d.docx": archive(**{"word/document.xml": f"<w:d {w}><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></w:d>"}),
        "p.pptx": archive(**{f"ppt/slides/slide{n}.xml": f"<w:d {w}><w:p><w:t>slide {n}</w:t></w:p></w:d>" for n in (10, 2)}),
        "s.xlsx": archive(**{"xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<x {s}><c t="s"><v>0</v></c><c><f>1+1</f><v>2</v></c></x>'}),
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    short = F.element_at(F.split("path", "/"), -1).alias("path")
    listed = lambda p: readers.binary_files(spark, str(tmp_path), p)
    manifest = readers.zip_manifest(listed("*.zip"))
    assert {(r["entry"], r["safe"], r["suspicious"]) for r in manifest.where("entry is not null").collect()} == {("ok/x.txt", True, False), ("../up.txt", False, False), ("big", True, True)}
    assert {r["path"]: (r["entries"], r["unsafe"], r["status"]) for r in readers.archive_safety(manifest).select(short, "entries", "unsafe", "status").collect()} == {"a.zip": (3, 1, "partial"), "bad.zip": (0, 0, "failed")}
    assert {r["path"]: r["text"] for r in readers.plain_text(listed("*.txt")).select(short, "text").collect()} == {"n.txt": "naïve", "z.txt": None, "i.txt": None}
    assert [r["text"] for r in readers.office_text(listed("*.docx"), "docx").collect()] == ["One line\nTwo"]
    assert [(r["part"], r["text"]) for r in readers.office_text(listed("*.pptx"), "pptx").collect()] == [(2, "slide 2"), (10, "slide 10")]
    assert [(r["part"], r["text"]) for r in readers.office_text(listed("*.xlsx"), "xlsx").collect()] == [(1, "name\n2")]
    assert [r["text"] for r in readers.office_text(listed("bad.zip"), "docx").collect()] == [None]


def test_windows_cover_whole_texts(spark):
    texts = [None, "", "  \n", "short", "word " * 900, "x" * 5000, ("line of text\n" * 400), "é" * 769]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in chunks.windows(rows, "id", "t").collect():
        got.setdefault(r["id"], []).append((r["start_char"], r["end_char"], r["text"]))
    assert set(got) == {3, 4, 5, 6, 7}
    for i, parts in got.items():
        assert parts[0][0] == 0 and parts[-1][1] == len(texts[i])
        assert all(b[0] == a[1] - 96 for a, b in zip(parts, parts[1:], strict=False))
        assert all(t == texts[i][a:b].strip() and b - a <= 1440 for a, b, t in parts)
    spread = catalogue.QUERIES["semantic_chunks"](spark, SMALL).groupBy("doc_id").agg(F.min("start_char").alias("a"), F.max("end_char").alias("b"))
    whole = spark.read.parquet(f"{SMALL}/documents.parquet").where("trim(text) <> ''")
    assert spread.join(whole, "doc_id").where("a <> 0 or b <> length(text)").count() == 0


def test_facts_and_labels(spark):
    lines = spark.createDataFrame([(1, "  Client : Acme\nTotal TTC\nclient-\nFacture No # 7\r\nother: x"), (2, None)], "id long, t string")
    got = [(r["line"], r["label"], r["value"]) for r in understanding.labelled(lines, "id", "t", ["facture no", "client"]).orderBy("line").collect()]
    assert got == [(0, "client", "Acme"), (3, "facture no", "7")]
    numbers = spark.createDataFrame([("+33 (1) 23.45-67",), ("12 34",), ("1+23456789",), ("12345678 ext",), (None,)], "v string").select(understanding.phone(F.col("v")))
    assert [r[0] for r in numbers.collect()] == ["+331234567", None, None, None, None]
    ids = spark.createDataFrame([("732 829 320",), ("732829321",), ("fr-12345678x",), ("11111111",), ("552 100 554 00013",), (None,)], "v string").select(understanding.company_id(F.col("v")))
    assert [r[0] for r in ids.collect()] == ["732829320", None, "FR12345678X", None, "55210055400013", None]
    fields = [(1, "document_type", "invoice", 0.9, "confirmed"), (2, "document_type", "invoice", 0.9, "confirmed"), (2, "total", "5", 0.9, "confirmed"), (3, "document_type", None, 0.4, "unknown"), (4, "total", None, 0.7, "conflicting")]
    found = understanding.review_reasons(spark.createDataFrame(fields, "id long, field string, value string, confidence double, status string"), "id")
    assert {r["id"]: r["reasons"] for r in found.collect()} == {1: "missing_critical_fields", 3: "low_confidence_document_type", 4: "conflicting_fields"}


def test_confirmed_facts_shadow_others(spark):
    rows = [(1, 100, True), (1, 9_500, False), (2, 9_500, None), (3, 10_000, True), (4, None, False)]
    facts = spark.createDataFrame(rows, "id long, amount long, sure boolean")
    scores = ranking.fact_scores(facts, "id", {"amount": ranking.amount_similarity(F.col("amount"), 9_000, 11_000, 10_000)}, F.col("sure"))
    assert {r["id"]: (round(r["amount"], 3), r["amount_mismatch"]) for r in scores.collect()} == {1: (0.0, True), 2: (0.95, False), 3: (1.0, False), 4: (0.0, False)}
    assert {r["id"]: round(r["score"], 3) for r in ranking.hybrid_score(scores, "id", {"amount": 0.18}).collect()} == {2: 0.171, 3: 0.18}
    assert {r["id"] for r in ranking.matching_files(scores, "id", ["amount"]).collect()} == {2, 3}


def test_numbers_behind_labels_and_headers_of_firms(spark):
    rows = [
        (1, "invoice", "Facture No: INV-7.\nDevis no Q-9\ninvoice # ABC\nInvoice: 12"), (2, "quote", "ÉTS DUPONT 12\nDevis n° D/2020-1"), (3, "letter", "Facture 123"), (4, "invoice", None),
        (5, "invoice", "\n\n  \n\nACME SA"), (6, "invoice", "FACTURE X1\n  ACME sA  \nOTHER"), (7, "quote", "X\nAc\n" + "A" * 81 + "\nÀB"), (8, "invoice", " ".join(f"invoice W{k:03d};" for k in range(10))), (9, "quote", ""),
    ]
    docs = spark.createDataFrame(rows, "k long, kind string, t string")
    got = sorted((r["k"], r["position"], r["number"]) for r in documents.identifiers(docs, "k", F.col("t"), F.col("kind"), F.lit(1.0)).collect())
    assert got == [(1, 0, "INV-7"), (2, 0, "D/2020-1"), *[(8, k, f"W{k:03d}") for k in range(8)]]
    heads = {r["k"]: r["h"] for r in docs.select("k", documents.supplier_header(F.col("t")).alias("h")).collect()}
    assert heads == {1: None, 2: "ÉTS DUPONT 12", 3: None, 4: None, 5: None, 6: "ACME sA", 7: "ÀB", 8: None, 9: None}
