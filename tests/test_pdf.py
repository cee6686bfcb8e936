import zlib

import pytest
from doctally.sources import files, pdf


def stream(dictionary: bytes, data: bytes, flate=True) -> bytes:
    data = zlib.compress(data) if flate else data
    return b"<<" + dictionary + (b"/Filter/FlateDecode" if flate else b"") + b"/Length %d>>\nstream\n" % len(data) + data + b"\nendstream"


def classic(objects: dict[int, bytes], extra=b"", xref=True) -> bytes:
    """A file with a cross-reference table; object 1 is the catalog."""
    out, places = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    start, n = len(out), max(objects) + 1
    if xref:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % n + b"".join(b"%010d 00000 n \n" % places[i] if i in places else b"0000000000 00000 f \n" for i in range(1, n))
    return out + b"trailer\n<</Size %d/Root 1 0 R" % n + extra + b">>\nstartxref\n%d\n%%%%EOF" % (start if xref else 7)


CMAP = b"""/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <ffff> endcodespacerange
2 beginbfchar <0001> <00480065> <0002> <d83cdf88> endbfchar
2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0058> <0059005a>] endbfrange"""
PLAIN = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding<</Differences[1/uni20AC/fi 65/one]>>>>"
WIDE = b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 9 0 R/DescendantFonts[<</DW 600/W[1[900 700] 16 18 400]>>]>>"


def pages(*contents: bytes, resources=b"/Font<</F1 7 0 R/F2 8 0 R>>") -> dict[int, bytes]:
    kids = b" ".join(b"%d 0 R" % (20 + 2 * i) for i in range(len(contents)))
    out = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count %d/MediaBox[0 0 600 800]/Resources<<%b>>/Kids[%b]>>" % (len(contents), resources, kids), 7: PLAIN, 8: WIDE, 9: stream(b"", CMAP)}
    for i, c in enumerate(contents):
        out |= {20 + 2 * i: b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (21 + 2 * i), 21 + 2 * i: stream(b"", c, i % 2 == 0)}
    return out


FIRST = rb"""BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(Sec)-30(ond)-900(line)] TJ T* ET
BT /F2 10 Tf 1 0 0 1 72 600 Tm <0001 0010 0011 0012 0002> Tj 12 TL T* <00200021> Tj ET"""
TABLE = b"""1 w 100 500 200 60 re S 100 530 m 300 530 l S 200 500 m 200 560 l S
BT /F1 10 Tf 1 0 0 1 110 540 Tm (Item) Tj 1 0 0 1 210 540 Tm (Price) Tj 1 0 0 1 110 510 Tm (Tea pot) Tj 1 0 0 1 210 510 Tm (4.50) Tj 1 0 0 1 100 100 Tm (below) Tj ET"""


def test_text_fonts_pages_and_tables():
    text, n, starts, tables = pdf.parse_pdf(classic(pages(FIRST, TABLE)))
    first = "Hello (big) world\nSecond line\nHeabc🎈\nXYZ"
    assert text == first + "\nItem Price\nTea pot 4.50\nbelow" and n == 2 and starts == {1: 0, 2: len(first) + 1}
    assert tables == [{"caption": "page 2", "cells": [["Item", "Price"], ["Tea pot", "4.50"]]}]
    assert pdf.parse_pdf(classic(pages(rb"BT /F1 9 Tf (\001\002 A\251) Tj ET")))[0] == "€fi 1©"


def test_forms_and_inline_images():
    objects = pages(b"q 2 0 0 2 10 10 cm /X1 Do Q BI /W 1 /H 1 ID \xff(\x00 EI BT /F1 9 Tf 0 -50 Td (after) Tj ET", resources=b"/Font<</F1 7 0 R>>/XObject<</X1 10 0 R>>")
    objects[10] = stream(b"/Type/XObject/Subtype/Form/BBox[0 0 9 9]", b"BT /F1 9 Tf (inside) Tj ET")
    assert pdf.parse_pdf(classic(objects))[0] == "inside\nafter"


def test_object_and_reference_streams():
    """Objects in a compressed stream, references in another with a row predictor."""
    plain = {k: v for k, v in pages(FIRST).items() if b"stream" not in v}
    streams = {k: v for k, v in pages(FIRST).items() if b"stream" in v}
    head, body = b"", b""
    for k, v in plain.items():
        head += b"%d %d " % (k, len(body))
        body += v + b" "
    out, places = b"%PDF-1.5\n", {}
    for k, v in {**streams, 50: stream(b"/Type/ObjStm/N %d/First %d" % (len(plain), len(head)), head + body)}.items():
        places[k] = len(out)
        out += b"%d 0 obj\n" % k + v + b"\nendobj\n"
    rows, before, start = b"", bytes(4), len(out)
    for i in range(52):
        row = bytes([1]) + (start if i == 51 else places[i]).to_bytes(2, "big") + b"\0" if i in places or i == 51 else bytes([2]) + (50).to_bytes(2, "big") + bytes([list(plain).index(i)]) if i in plain else bytes(4)
        rows += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, before, strict=True))
        before = row
    out += b"51 0 obj\n" + stream(b"/Type/XRef/Size 52/W[1 2 1]/Root 1 0 R/DecodeParms<</Predictor 12/Columns 4>>", rows) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    assert pdf.parse_pdf(out)[0] == "Hello (big) world\nSecond line\nHeabc🎈\nXYZ"
    assert pdf.parse_pdf(out.replace(b"startxref", b"startxxxx"))[0].startswith("Hello")  # found by a scan for objects


@pytest.mark.parametrize("how", [lambda f: f, lambda f: b"junk" + f, lambda f: f.replace(b"startxref", b"nothing")])
def test_mended_by_a_scan(how):
    assert pdf.parse_pdf(how(classic(pages(FIRST), xref=False)))[0].startswith("Hello (big) world")


def test_bad_files_are_rows_with_errors():
    good = classic(pages(FIRST))
    bad = {"encrypted": classic(pages(FIRST), b"/Encrypt<</Filter/Standard>>"), "not a PDF": b"plain text", "empty": b"", "cut": good[:300], "no pages": classic({1: b"<</Type/Catalog>>"}), "circle": classic({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"2 0 R"})}
    bad["filter"] = good.replace(b"/FlateDecode", b"/LZWDecodeXX")
    for name, data in bad.items():
        out = files.parse("pdf", data)
        assert out["error"] or not out["text"], name
    assert files.parse("pdf", good)["page_map"] == {1: 0}
    loop = classic({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[2 0 R 2 0 R]>>"})
    assert pdf.parse_pdf(loop)[1] == 0


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.pdf").write_bytes(classic(pages(FIRST, TABLE)))
    (tmp_path / "in/deep/b.PDF").write_bytes(classic(pages(TABLE)))
    (tmp_path / "in/broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "in/note.txt").write_text("a note")
    return tmp_path / "in"


def test_data_source(spark, folder):
    spark.dataSource.register(pdf.PdfPages)
    rows = sorted(map(tuple, spark.read.format("pdf_pages").load(str(folder)).selectExpr("regexp_extract(path, '[^/]*$', 0)", "page", "size(tables)", "error is null").collect()), key=str)
    assert rows == [("a.pdf", 1, 0, True), ("a.pdf", 2, 1, True), ("b.PDF", 1, 1, True), ("broken.pdf", None, -1, False)] or rows == [("a.pdf", 1, 0, True), ("a.pdf", 2, 1, True), ("b.PDF", 1, 1, True), ("broken.pdf", None, None, False)]
    assert spark.read.format("pdf_pages").load(str(folder / "deep/none")).count() == 0
    by_file = {r["path"].rpartition("/")[2]: r for r in files.read_files(spark, str(folder)).collect()}
    assert by_file["a.pdf"]["page_count"] == 2 and by_file["a.pdf"]["tables"][0]["cells"][1] == ["Tea pot", "4.50"] and by_file["broken.pdf"]["error"] and by_file["note.txt"]["text"] == "a note"


def test_stream_of_pages(spark, folder, tmp_path):
    """Files that come later come in a later batch, each once, across a restart."""
    spark.dataSource.register(pdf.PdfPages)

    def run():
        rows = spark.readStream.format("pdf_pages").load(str(folder))
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("regexp_extract(path, '[^/]*$', 0)").collect())

    assert run() == ["a.pdf", "a.pdf", "b.PDF", "broken.pdf"]
    (folder / "c.pdf").write_bytes(classic(pages(FIRST)))
    assert run() == ["a.pdf", "a.pdf", "b.PDF", "broken.pdf", "c.pdf"]
