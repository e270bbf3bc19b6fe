import zlib

import pytest

from examweft.plans.file_queries import _small_pdf
from examweft.sources import pdf, readers


def built(*objects, version="1.4"):
    parts = [f"%PDF-{version}".encode()]
    for n, body in objects:
        parts.append(f"{n} 0 obj ".encode() + body + b" endobj")
    return b"\n".join([*parts, b"trailer <</Root 1 0 R>> %%EOF"])


def stream(data, head="", packed=True):
    body = zlib.compress(data) if packed else data
    return f"<</Length {len(body)} {'/Filter /FlateDecode' if packed else ''} {head}>> stream\r\n".encode() + body + b"\nendstream"


def test_small_files():
    texts = ["Câu 1: (a) \\ back", "zwei € äöü", "", "x" * 5000]
    assert list(pdf.pages(_small_pdf(*texts))) == texts


def test_trees_content_arrays_and_operators():
    content = b"BT /F1 9 Tf 1 0 0 1 50 700 Tm [(Hel) -20 (lo) -300 (world)] TJ 0 -12 Td (next \\050line\\051\\\ncontinued) Tj T* (third) ' 5 0 Td (same) Tj ET"
    data = built(
        (1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<< /Type /Pages /Kids [ 5 0 R 3 0 R ] /Count 3 >>"), (3, b"<</Type/Page/Parent 2 0 R/Contents [10 0 R 11 0 R]>>"),
        (5, b"<</Type /Pages /Parent 2 0 R /Kids [6 0 R 7 0 R]>>"), (6, b"<</Type /Page /Contents 12 0 R>>"), (7, b"<</Type /Page >>"),
        (10, stream(content[:60], packed=False)), (11, stream(content[60:])), (12, stream(b"BT <48C3A9> Tj <4> Tj ET")),
    )
    assert list(pdf.pages(data)) == ["HÃ©@", "", "Hello world\nnext (line)continued\nthirdsame"]


def test_unicode_maps_and_object_streams():
    cmap = b"2 beginbfchar <0001> <1EA4> <0002> <D83DDE00> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    inner = [(4, b"<</Type /Page /Parent 2 0 R /Contents 9 0 R>>"), (2, b"<</Type /Pages /Kids [4 0 R] /Resources <</Font <</F1 7 0 R /F2 6 0 R>>>>>>"), (7, b"<</Type /Font /Subtype /Type0 /ToUnicode 8 0 R>>")]
    packed, heads, at = b"", [], 0
    for n, body in inner:
        heads.append(f"{n} {len(packed)}")
        packed += body + b" "
    head = " ".join(heads).encode() + b" "
    data = built((20, stream(head + packed, f"/Type /ObjStm /N {len(inner)} /First {len(head)}")), (8, stream(cmap)), (9, stream(b"BT /F1 1 Tf <00010002001000110012> Tj /F2 1 Tf (plain) Tj ET")), (6, b"<</Type /Font>>"), version="1.7")
    assert list(pdf.pages(data)) == ["Ấ😀ABCplain"]


@pytest.mark.parametrize("data, said", [(b"", "no PDF"), (b"hello", "no PDF"), (b"%PDF-1.4 nothing", "no pages"), (b"%PDF-1.4 1 0 obj <</Encrypt 2 0 R>> endobj", "encrypted")])
def test_unreadable(data, said):
    with pytest.raises(pdf.Unreadable, match=said):
        list(pdf.pages(data))


def test_files_to_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(_small_pdf("one", "two"))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    cut = _small_pdf("first", "second")
    (tmp_path / "c.pdf").write_bytes(cut[: cut.rindex(b"stream\n", 0, len(cut) - 60) + 12])  # cut off in its last page
    rows = {}
    for r in pdf.page_texts(readers.binary_files(spark, str(tmp_path))).collect():
        rows.setdefault(r.path[-5:], []).append((r.page, r.text, r.error))
    assert rows["a.pdf"] == [(1, "one", None), (2, "two", None)] and rows["b.pdf"] == [(None, None, "Unreadable: no PDF file")]
    assert rows["c.pdf"][0] == (1, "first", None) and len(rows["c.pdf"]) == 2
    pages = pdf.page_texts(readers.binary_files(spark, str(tmp_path))).where("path like '%a.pdf'").selectExpr("path as doc_id", "page", "text")
    assert readers.page_fallback(pages).first().text == "<|page|>Page 1\n\none\n\n<|page|>Page 2\n\ntwo"
