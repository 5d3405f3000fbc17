"""Reading order, drawing, histories and batch pipelines on literals."""
from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from vellumine.operators import appearance, drawing, jobs, reading
from vellumine.plans import batch
from vellumine.sources import pdf


def test_lines_hang_on_their_first_glyph(spark):
    g = F.array(*[F.struct(F.lit(c).alias("char"), F.lit(y).cast("double").alias("y")) for c, y in (("a", 10), ("b", 13), ("c", 16), ("d", None), ("e", 12.5))])
    got = spark.range(1).select(reading.glyph_lines(g).alias("l")).first().l
    assert [(x.anchor, x.text) for x in got] == [(10.0, "ab"), (16.0, "cde")]


def test_blocks_keep_occurrences_apart(spark):
    rows = spark.createDataFrame([("d", 1, "P", "a"), ("d", 2, "P", None), ("d", 3, "H", "c"), ("d", 4, "P", "e")], "doc string, seq int, element string, text string")
    assert [(r.element, r.pieces, r.text) for r in reading.blocks(rows).orderBy("block").collect()] == [("P", 2, "a"), ("H", 1, "c"), ("P", 1, "e")]


def test_history_cuts_what_lies_ahead(spark):
    visits = [("visit", 1, 1.0), ("visit", 2, 1.0), ("visit", 2, 2.0), ("visit", 3, 1.0), ("back", 0, 0.0), ("back", 0, 0.0), ("forward", 0, 0.0), ("visit", 9, 1.0), ("forward", 0, 0.0)]
    v = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).cast("long").alias("page"), F.lit(s).alias("scale")) for k, p, s in visits])
    got = spark.range(1).select(drawing.history(v).alias("h"), drawing.history(v, 2).alias("short")).first()
    assert [(x.page, x.scale) for x in got.h.pages] == [(1, 1.0), (2, 2.0), (9, 1.0)] and got.h.cursor == 3
    assert len(got.short.pages) == 2


def test_png_and_slots_and_frames():
    image = drawing.png(bytes(range(16)), 2, 2)
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(image[image.index(b"IDAT") + 4 : image.index(b"IEND") - 8]) == b"\0" + bytes(range(8)) + b"\0" + bytes(range(8, 16))
    with pytest.raises(ValueError):
        drawing.png(b"", 1, 1)
    assert drawing.slots([("alloc", 5), ("alloc", 6), ("alloc", 7), ("ready", 1), ("alloc", 8)], 2) == [0, 1, 0, 1]
    data = jobs.append_frame(jobs.append_frame(b"", b"one"), b"two")
    assert jobs.latest_frame(data) == b"two" and jobs.latest_frame(data[:-1]) == b"one" and jobs.latest_frame(b"") is None


def test_momentum_settles():
    p, v = 120.0, 0.0
    for _ in range(600):
        p, v = drawing.momentum(v, 1 / 60, 1.0, p, 0.0, 100.0)
    assert abs(p - 100) < 0.5


def test_batch(spark):
    pages = spark.createDataFrame([("d", i, f"page {i} secret", None) for i in range(5)], "doc string, page int, text string, rotation int")
    steps = batch.parse("# comment\n[extract]\nfirst = 2\nlast = 4\n[rotate]\ndegrees = -90\n[redact]\nterm = SECRET\n")
    out, results = batch.run(pages, steps)
    assert [(r.page, r.text, r.rotation) for r in out.orderBy("page").collect()] == [(i, f"page {i + 1} ██████", 270) for i in range(3)]
    assert [r.ok for r in results] == [True] * 3
    _, results = batch.run(pages, batch.parse("[rotate]\ndegrees = 45\n[split]\nsize = 2"))
    assert [(r.kind, r.ok) for r in results] == [("rotate", False)]
    # Pages that a document doesn't have, and what fails only when it is computed, stop the run.
    for text in ("[delete]\npages = 2,6", "[extract]\nfirst = 1\nlast = 6", "[move]\npages = 1\nto = 9", "[insert-blank]\nat = 99"):
        out, results = batch.run(pages, batch.parse(text + "\n[split]\nsize = 2"))
        assert [r.ok for r in results] == [False] and out.count() == 5, text
    failing = F.udf(lambda x: 1 // 0, "int")
    _, results = batch.run(pages.withColumn("rotation", failing("page")), batch.parse("[rotate]\ndegrees = 90\n[split]\nsize = 2"))
    assert [r.ok for r in results] == [False]
    for bad in ("[fly]", "[extract]\nfirst = 1", "[split]\nsize = x", "loose line", "size = 2"):
        with pytest.raises(ValueError):
            batch.parse(bad)


def test_character_maps():
    cmap = b"beginbfchar <01> <0041> <02> <00660069> endbfchar beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange"
    assert pdf.to_unicode(cmap) == {1: "A", 2: "fi", 0x10: "a", 0x11: "b", 0x12: "c", 0x20: "x", 0x21: "y"}


def tagged(content, structure, fonts=b""):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /MarkInfo << /Marked true >> /StructTreeRoot 5 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 9 0 R >> >> >>", 4: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content),
        5: b"<< /Type /StructTreeRoot /K [6 0 R 7 0 R] >>", **structure, 9: fonts or b"<< /Type /Font /Subtype /Type1 >>",
    }
    return pdf.File(pdf.append(b"%PDF-1.7\n", objects, b"/Root 1 0 R", None))


def test_tagged_text_is_read_in_structure_order():
    content = b"BT /F1 9 Tf /P << /MCID 1 >> BDC (second ) Tj [(pa) -20 (rt)] TJ EMC /Artifact BMC (page 1) Tj EMC /H1 << /MCID 0 >> BDC (first) Tj EMC ET"
    f = tagged(content, {6: b"<< /S /H1 /Pg 3 0 R /K 0 >>", 7: b"<< /S /Sect /Pg 3 0 R /K [8 0 R << /S /Figure /Alt (a map) >> << /Type /MCR /MCID 5 >>] >>", 8: b"<< /S /P /Pg 3 0 R /K [1 7 0 R] >>"})
    r = pdf.Reader(f)
    assert [(b["page"], b["element"], b["text"]) for b in r.blocks()] == [(0, "H1", "first"), (0, "P", "second part"), (0, "Figure", "[Figure: a map]")]
    assert r.missing == 1 and not r.unreliable and f.summary()["is_tagged"]


def test_text_without_a_map_is_unreliable():
    structure = {6: b"<< /S /P /Pg 3 0 R /K 0 >>", 7: b"<< /S /P >>"}
    r = pdf.Reader(tagged(b"/P << /MCID 0 >> BDC /F1 9 Tf <00410042> Tj EMC", structure, b"<< /Type /Font /Subtype /Type0 >>"))
    assert [b["text"] for b in r.blocks()] == ["\ufffd\ufffd"] and r.unreliable


def test_signatures():
    sig = b"<< /Type /Sig /ByteRange [0 10 20 5] /Contents <DEADBEEF> /Name (Ann) /Reference [<< /TransformMethod /DocMDP /TransformParams << /P 2 >> >>] >>"
    f = pdf.File(pdf.append(b"%PDF-1.7\n", {1: b"<< /Type /Catalog >>", 2: sig, 3: b"<< /Type /Sig >>"}, b"/Root 1 0 R", None))
    assert [(s["byte_range"], s["contents"], s["name"], s["level"]) for s in pdf.signatures(f)] == [([0, 10, 20, 5], b"\xde\xad\xbe\xef", "Ann", 2), ([], b"", "", None)]


def test_text_of_all_show_operators():
    odd: list = []
    content = b"BT /F1 9 Tf 12 TL 0 700 Td [(hel) -20 (lo)] TJ T* <68656c6c6f> Tj (next) ' 1 2 (third) \" 0 -12 Td [(a) -300 (b)] TJ 50 0 Td (c) Tj ET BI /W 1 ID \x00(( EI q 1 0 0 1 0 99 cm (up) Tj Q % c ) c\n(down) Tj"
    assert pdf.text_lines(content, {}, odd) == ["hello", "hello", "next", "third", "a b c", "up", "down"] and odd == []
    assert pdf.text_lines(b"} (x) Tj", {}, odd) == ["x"] and odd == [("content-odd", "1 bytes")]
    font = {"F": ({1: "x", 2: "yz"}, 2)}
    odd = []
    assert pdf.text_lines(b"/F 1 Tf <00010002> Tj 0 -20 Td <0009> Tj", font, odd) == ["xyz", "\ufffd"] and odd == [("text-undecodable", "1 strings")]


def test_boxes_turns_and_loops():
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R 4 0 R 2 0 R] /MediaBox [9 0 R 0 300 10 0 R] /Rotate 450 >>", 3: b"<< /Parent 2 0 R >>", 4: b"<< /Parent 2 0 R /CropBox [0 0 100 50] /Rotate 7 >>", 9: b"0", 10: b"400.5"}
    for data in (pdf.append(b"%PDF-1.7\n", objects, b"/Root 1 0 R", None), pdf.compact(objects, b"/Root 1 0 R")):
        f = pdf.File(data)
        assert [tuple(m.values()) for m in f.page_metas()] in ([(0, 400.5, 300.0, 90), (1, 100.0, 50.0, 0)], [(0, 792.0, 612.0, 90), (1, 100.0, 50.0, 0)])
        assert ("page-tree-loop", "2") in f.events


def test_rewrites_hold_one_revision():
    data = pdf.write([["one"], ["two (endobj)"]], compress=False)
    data = pdf.incremental(data, {50: b"(orphan)"})
    clean = pdf.latest_only(data)
    assert pdf.File(clean).page_texts() == [["one"], ["two (endobj)"]] and len(pdf.File(clean).revisions()) == 1 and b"orphan" not in clean
    signed = pdf.incremental(data, {51: b"<< /Type /Sig /ByteRange [0 1 2 3] >>"})
    with pytest.raises(ValueError, match="signatures"):
        pdf.latest_only(signed)
    assert pdf.latest_only(signed, discard_signatures=True)
    with pytest.raises(ValueError, match="encrypted"):
        pdf.latest_only(pdf.append(data, {60: b"1"}, b"/Root 1 0 R /Encrypt 60 0 R", max(pdf.File(data).sections)))


def test_appearances():
    a = appearance.appearance
    assert a("squiggly", (0, 0, 16, 10), (1, 0, 0)) == b"1.000 0.000 0.000 rg\n0.0 0.0 16.0 10.0 re f\n1.000 0.000 0.000 rg\n1 w\n0.0 2.0 m 4.0 5.0 l 8.0 1.0 l 16.0 2.0 l S\n"
    assert a("ellipse", (0, 0, 20, 10)).splitlines()[2:] == [b"10.0 0.0 m", b"15.5 0.0 20.0 2.2 20.0 5.0 c", b"20.0 7.8 15.5 10.0 10.0 10.0 c", b"4.5 10.0 0.0 7.8 0.0 5.0 c", b"0.0 2.2 4.5 0.0 10.0 0.0 c S"]
    assert a("arrow", (0, 0, 1, 1), strokes=[[(0, 0), (10, 0)]]).splitlines()[-1] == b"10.0 0.0 m 1.2 4.8 l 1.2 -4.8 l f"
    assert a("line", (0, 0, 1, 1), strokes=[[(0, 0)]]) == b"" == a("polygon", (0, 0, 1, 1))
    assert a("ink", (0, 0, 1, 1), border=2, strokes=[[(1, 2), (3, 4)], [], [(5, 6)]]).splitlines()[1:] == [b"2.0 w", b"1 J", b"1 j", b"1.0 2.0 m", b"3.0 4.0 l", b"S", b"5.0 6.0 m", b"S"]
    assert a("polygon", (0, 0, 1, 1), strokes=[[(1, 2), (3, 4)]]).endswith(b"l\nh S\n") and a("polyline", (0, 0, 1, 1), strokes=[[(1, 2), (3, 4)]]).endswith(b"l\nS\n")
    assert b"(a \\(b\\) \\\\) Tj" in a("freetext", (0, 0, 50, 20), text="a (b) \\") and b"BT" not in a("stamp", (0, 0, 1, 1))
    with pytest.raises(ValueError):
        a("caret", (0, 0, 1, 1))
    w = appearance.widget
    assert w("checkbox", 10, 4, "Yes").splitlines()[1:] == [b"0 0 10.0 8.0 re f", b"0 0 0 RG", b"1 w", b"0 0 10.0 8.0 re S", b"0 0 0 RG", b"1.5 w", b"2.0 4.0 m", b"4.0 2.0 l", b"8.0 6.4 l S"]
    assert w("checkbox", 10, 10, "Off").count(b" l") == 0 and "(•••) Tj".encode() in w("text", 50, 20, "abc", password=True) and b"(Sign) Tj" in w("signature", 50, 20) and b"(go) Tj" in w("button", 50, 20, None, "go")
    assert b"/F1 24.0 Tf" in w("list", 50, 20, "x", font_size=99) and b"2.0 2.0 Td" in w("text", 50, 20, "x", font_size=99)
