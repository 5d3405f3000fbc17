"""Operators on literal inputs, one boundary each."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.corpus import lines
from vellumine.functions import text as T
from vellumine.functions.registry import Registry
from vellumine.operators import compliance, diff, forms, jobs, layout, ocr, review, search, tree, versions
from vellumine.sources import pdf, writers, xfdf


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def text_lines(spark, *texts):
    return lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_folding(spark):
    r = one(spark, a=T.normalize(F.lit("Co­operate ﬁnal oﬃce")), b=T.normalize(F.lit("ﬀÉ")), c=T.fold_accents(F.lit("é")))
    assert (r.a, r.b, r.c) == ("cooperate final office", "ﬀé", "e")


def test_whole_words_and_overlaps(spark):
    rows = text_lines(spark, "worldwide, world_x world.", "aaaa")
    assert [r.char_offset for r in search.find_all(rows, "world", whole_word=True).collect()] == [19]
    assert [r.char_offset for r in search.find_all(rows, "aa").collect()] == [0, 2]
    assert [r.char_offset for r in search.find_all(rows, "aa", overlapping=True).collect()] == [0, 1, 2]
    assert [r.char_offset for r in search.redaction_regions(rows, "world", whole_word=True).collect()] == [11, 19]


def test_offsets_in_both_units(spark):
    r = search.find_all(text_lines(spark, "éé Oﬃce"), "office").first()
    assert (r.char_offset, r.byte_offset, r.matched_text) == (3, 5, "office")


def test_reliability(spark):
    r = one(spark, a=T.is_reliable(F.lit("")), b=T.is_reliable(F.lit("x\ufffd")), c=T.is_reliable(F.lit("\ue000" + "a" * 9)), d=T.is_reliable(F.lit("\ue000" + "a" * 10)))
    assert (r.a, r.b, r.c, r.d) == (True, False, False, True)


def test_final_line_end_makes_no_line(spark):
    assert [r.text for r in text_lines(spark, "a\n").collect()] == ["a"]
    assert [r.text for r in text_lines(spark, "a\r\n\nb").orderBy("line_index").collect()] == ["a", "", "b"]
    assert text_lines(spark, "").collect() == []


def test_cursor_search(spark):
    found = search.find_all(text_lines(spark, "on\non on"), "on")
    assert search.first_from(found, 0, 1, 1).first()[1:] == (1, 3)
    assert search.last_before(found, 0, 1, 2).first()[1:] == (1, 0)


def test_upsert_keeps_the_newest_revision(spark):
    index = spark.createDataFrame([("s", 0, 5, 0, "new")], "source string, page int, revision int, seq int, text string")
    late = spark.createDataFrame([("s", 0, 4, 1, "old"), ("s", 1, 1, 2, "b")], index.schema)
    assert {r.text for r in search.upserted(index, late).collect()} == {"new", "b"}
    assert {r.text for r in search.upserted(index, late, by_revision=False).collect()} == {"old", "b"}


def test_page_list():
    assert tree.page_list("1,3-5", 5) == [0, 2, 3, 4]
    for bad in ("0", "5-3", "x", "6", "", "1-"):
        with pytest.raises(ValueError):
            tree.page_list(bad, 5)


def test_newest_wins_passes_over_free_entries(spark):
    rows = spark.createDataFrame([(0, 1, 0, False), (1, 1, 77, True), (0, 2, 5, True), (1, 2, 9, True)], "section int, obj int, offset int, in_use boolean")
    assert {(r.obj, r.offset) for r in versions.newest_wins(rows).collect()} == {(1, 77), (2, 5)}
    assert {(r.obj, r.offset) for r in versions.newest_wins(rows, strict=True).collect()} == {(1, 0), (2, 5)}


def test_rotation_is_inherited(spark):
    nodes = spark.createDataFrame([("p", None, 90), ("a", "p", -90), ("b", "p", None), ("c", "b", None)], "node string, parent string, rotation int")
    got = {r.node: r.rotation % 360 for r in tree.inherited(nodes, "rotation").collect()}
    assert got == {"p": 90, "a": 270, "b": 90, "c": 90}
    assert {r.node: r.leaves for r in tree.leaf_counts(nodes).collect()} == {"p": 2, "a": 1, "b": 1, "c": 1}


def test_page_order(spark):
    pages = spark.createDataFrame([("d", i, c) for i, c in enumerate("abcd")], "doc string, page int, content string")
    show = lambda df: "".join(r.content or "_" for r in df.orderBy("page").collect())
    assert show(tree.move(pages, [2, 3], 1)) == "acdb"
    assert show(tree.duplicate(pages, [1])) == "abbcd"
    assert show(tree.insert_blank(pages, 4)) == "abcd_"
    assert show(tree.delete(pages, [0, 1, 2, 3])) == "abcd"
    assert show(tree.extract(pages, 2, 3)) == "bc"


def test_alignment_prefers_removals_and_finds_moves():
    assert diff.diff(["a", "b", "c"], ["a", "x", "b", "c"])[0] == [("same", "a", 0, 0), ("added", "x", None, 1), ("same", "b", 1, 2), ("same", "c", 2, 3)]
    assert [x[0] for x in diff.diff(["a"], ["b"])[0]] == ["removed", "added"]
    steps, quality = diff.diff(["m", "a", "b"], ["a", "b", "m"])
    assert ("moved", "m", 0, 2) in steps and len(steps) == 3 and quality == "aligned"
    assert diff.diff(["x", "x"], ["x"])[0] == [("same", "x", 0, 0), ("removed", "x", 1, None)]
    assert diff.diff(["a"] * 3, ["a"] * 3, aligned=2)[1] == "positional"


def test_alignment_is_longest():
    rng = np.random.default_rng(0)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(50):
        a, b = (list(map(str, rng.integers(0, 4, rng.integers(0, 15)))) for _ in range(2))
        assert sum(k == "same" for k, _, _ in diff.align(a, b)) == length(a, b)


def test_images():
    a, b = bytes([0, 0, 0, 255] * 4), bytes([0, 0, 0, 255] * 3 + [9, 0, 0, 255] + [1, 1, 1, 1] * 2)
    assert diff.image_difference(a, (2, 2), b, (2, 3)) == {"changed_pixels": 3, "total_pixels": 6, "max_delta": 9, "geometry_differs": True, "changed_fraction": 0.5}


def test_signature_precedence(spark):
    good, bad = F.array(*[F.lit(x).cast("long") for x in (0, 10, 20, 5)]), F.array(*[F.lit(x).cast("long") for x in (0, 10, 5, 5)])
    none = F.array().cast("array<bigint>")
    yes, no = F.lit(True), F.lit(False)
    v = lambda *a: compliance.verdict(a[0], a[1], F.lit(100), *a[2:])
    r = one(spark, a=v(no, bad, yes, yes, yes), b=v(yes, none, no, no, yes), c=v(yes, bad, no, no, yes), d=v(yes, good, yes, no, yes), e=v(yes, good, no, yes, yes), f=v(yes, good, no, no, no), g=v(yes, good, no, no, yes))
    assert tuple(r) == ("indeterminate", "indeterminate", "invalid", "invalid", "invalid", "indeterminate", "valid")


def test_bates_width_is_a_minimum(spark):
    r = one(spark, a=T.padded(F.lit(1), 6), b=T.padded(F.lit(1234567), 6), c=T.short_number(F.lit(2.5)), d=T.short_number(F.lit(100.0)))
    assert tuple(r) == ("000001", "1234567", "2.5", "100")


def test_names_that_hold_words_of_code():
    fields = {"evaluation": "2", "requirements": "3", "a": "4", "t": ""}
    for script, want in (('getField("evaluation").value + 1', "3"), ('this.getField("requirements").value', "3"), ('AFSimple_Calculate("sum", ["a", "evaluation"])', "6"), ("afsimple_calculate('MAX', new Array('a', 'requirements'))", "4")):
        assert forms.calculate(fields, {"t": script}, ["t"]) == (fields | {"t": want}, [("t", "updated")]), script
    for script in ('eval("1")', "function f() {}", "event.value", 'AFSimple_Calculate("SUM", [])'):
        assert forms.calculate(fields, {"t": script}, ["t"])[1][0][1].startswith("error"), script


def test_calculations():
    fields = {"a": "10", "b": "5", "zero": "0", "total": "", "twice": ""}
    scripts = {"total": 'AFSimple_Calculate("SUM", new Array("a", "b"));', "twice": 'getField("total").value * 2', "a": "b / zero", "b": "nothing + 1", "zero": 'AFSimple_Calculate("MED", ["a"])'}
    values, log = forms.calculate(fields, scripts, ["total", "twice", "a", "b", "zero"])
    assert values["total"] == "15" and values["twice"] == "30"
    assert log == [("total", "updated"), ("twice", "updated"), ("a", "error: division by zero"), ("b", "error: no field nothing"), ("zero", "error: unsupported")]
    assert forms.calculate(fields, scripts, ["total"], enabled=False) == (fields, [])
    for bad in ("app.alert(1)", "1 +", "(1", "1 2", "a = 3", "doc.x + 1"):
        with pytest.raises(forms.CalculationError):
            forms.evaluate(forms.parse(bad), {"a": 1.0})
    assert forms.evaluate(forms.parse("-(2 + 3) * 2 - 8 / 4"), {}) == -12


def test_undo_of_nothing_and_cleared_redo(spark):
    ops = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in (("undo", ""), ("record", "x"), ("record", "y"), ("undo", ""), ("record", "z"), ("redo", ""))])
    r = one(spark, s=versions.undo_state(ops)).s
    assert (r.applied, r.undone) == (["x", "z"], [])


def test_threads(spark):
    c = spark.createDataFrame([(1, 0, "Ann", "hi"), (1, 2, "Bob", "b"), (1, 1, "Cy", "a"), (2, 1, "Lost", "x")], "thread long, ord long, author string, text string")
    assert [(r.thread, r.comments, r.last_author) for r in review.thread_facts(c).collect()] == [(1, 3, "Bob")]
    assert review.summary(c).first().summary == "Ann: hi\n  Cy: a\n  Bob: b"


def test_job_levels_leave_cycles_open(spark):
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints/vellumine")
    all_jobs = spark.createDataFrame([(i,) for i in range(1, 7)], "job long")
    deps = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (4, 5), (5, 4), (6, 4)], "job long, needs long")
    assert {r.job: r.level for r in jobs.levels(all_jobs, deps).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None}
    assert {tuple(r) for r in jobs.problems(all_jobs.union(all_jobs.where("job = 1")), deps.union(spark.createDataFrame([(1, 99)], deps.schema))).collect()} == {(1, "duplicate"), (1, "missing dependency")}


def test_roots_match_whole_components(spark):
    files = spark.createDataFrame([("/a/b/c.pdf",), ("/a/bc/d.pdf",)], "path string")
    roots = spark.createDataFrame([("/a/b",)], "root string")
    assert [r.path for r in jobs.under_roots(files, roots).collect()] == ["/a/b/c.pdf"]


def test_tiles_and_scales(spark):
    rows = spark.createDataFrame([(1, 250, 0, 10, 300)], "id int, x int, y int, width int, height int")
    assert sorted(tuple(r) for r in layout.tiles(rows).collect()) == [(1, 0, 0, 6, 256), (1, 0, 1, 6, 44), (1, 1, 0, 4, 256), (1, 1, 1, 4, 44)]
    assert one(spark, s=layout.nearest_scale(F.lit(0.625))).s == 0.5 or one(spark, s=layout.nearest_scale(F.lit(1.125))).s == 1.0


def test_touching_rectangles_do_not_overlap(spark):
    schema = "page int, id int, x double, y double, width double, height double"
    a = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 95.0, 95.0, 10.0, 10.0), (1, 3, 0.0, 0.0, 5.0, 5.0)], schema)
    b = spark.createDataFrame([(0, 9, 10.0, 0.0, 5.0, 5.0), (0, 8, 104.0, 104.0, 50.0, 50.0)], schema)
    assert [r.id for r in layout.overlap_join(a, b, "semi").collect()] == [2]
    assert {r.id for r in layout.overlap_join(a, b, "anti").collect()} == {1, 3}


def test_recognised_words(spark):
    tsv = "level\n5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t90\tHello\n5\t1\t1\t1\t1\t2\t0\t0\t1\t1\t-1\tgone\n5\t1\t1\t1\t1\t3\t0\t0\t1\t1\t50\t \nshort\n5\t1\t1\t1\t1\t4\t0\t0\t1\t1\t30\tworld"
    words = ocr.parse_tsv(spark.createDataFrame([(0, tsv)], "page int, tsv string"))
    r = ocr.page_text(words).first()
    assert r.full_text == "Hello world" and abs(r.mean_confidence - 0.6) < 1e-9
    image = np.full((5, 5, 4), 255, np.uint8)
    image[1, 1, :3] = 0
    image[3, 1:4, :3] = 0
    clean = ocr.despeckle(image)
    assert clean[1, 1, 0] == 255 and clean[3, 2, 0] == 0
    assert ocr.resize(image, 10, 5).shape == (5, 10, 4)


def test_redaction_never_passes_without_evidence(spark):
    held = spark.createDataFrame([(1, 0, "all gone"), (2, 0, "secret stays")], "doc_id int, page int, text string")
    items = spark.createDataFrame([(1, 0, 1, "text", "Secret"), (2, 0, 1, "text", "Secret"), (3, 0, 1, "text", "Secret"), (4, 0, 1, "image", "")], "doc_id int, page int, item int, kind string, sample string")
    assert {r.doc_id: r.passed for r in compliance.verify_redaction(held, items).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_xfdf_reads_quotes_and_bad_numbers(spark):
    xml = '<xfdf><annots><text page="2" rect="1,2,x,4" title="a &gt; b"/><link page="1"/><ink title="c>d" page="y"/></annots></xfdf>'
    got = one(spark, e=xfdf.elements(F.lit(xml))).e
    assert [(e.tag, e.page, e.x1, e.y1, e.title) for e in got] == [("text", 2, 0.0, 4.0, "a > b"), ("ink", 0, 0.0, 0.0, "c>d")]


def test_publish_checks_before_it_renames(spark, tmp_path):
    df = spark.range(3)
    assert writers.publish(df, f"{tmp_path}/out", lambda back: back.count() == 3) == 3
    with pytest.raises(FileExistsError):
        writers.publish(df, f"{tmp_path}/out", lambda back: True)
    with pytest.raises(ValueError):
        writers.publish(df, f"{tmp_path}/other", lambda back: False)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_plugins_need_grants(spark):
    registry = Registry(spark, {("p", "read-text")})
    registry.scalar("p", "vm_len", lambda s: s.str.len(), "long")
    assert spark.sql("SELECT vm_len('four') AS n").first().n == 4
    with pytest.raises(PermissionError):
        registry.scalar("q", "vm_no", lambda s: s, "string")
    with pytest.raises(PermissionError):
        registry.annotate("p", spark.range(1), lambda pdf: pdf)


# Files


def test_files_round_trip():
    pages = [["first (line)", "back\\slash"], ["Ünïcode 한국"], []]
    for compress in (True, False):
        f = pdf.File(pdf.write(pages, compress))
        s = f.summary()
        assert f.page_texts() == pages and s["page_count_declared"] == s["page_count_walked"] == 3 and s["leniency"] == [] and s["revisions"] == 1


def test_incremental_saves_make_revisions():
    data = pdf.write([["a"]])
    more = pdf.incremental(data, {4: b"<< /Type /Page /Parent 2 0 R /Rotate 90 /Contents 3 0 R >>"})
    assert more.startswith(data)
    f = pdf.File(more)
    assert [(r["number"], r["bytes"] > 0, r["objects_written"]) for r in f.revisions()] == [(1, True, 4), (2, True, 1)]
    assert pdf.value(f.object(4), "Rotate") == b"90" and f.page_texts() == [["a"]]
    third = pdf.File(pdf.incremental(more, {2: pdf.File(more).object(2)}))
    assert len(third.revisions()) == 3
    with pytest.raises(ValueError):
        pdf.incremental(pdf.append(b"%PDF-1.7\n", {1: b"<< /Type /Catalog >>"}, b"/Root 1 0 R /Encrypt 9 0 R", None), {})


def test_damaged_files_are_repaired():
    data = pdf.write([["kept"]])
    broken = data.replace(b"startxref", b"startnone")
    f = pdf.File(broken)
    assert f.page_texts() == [["kept"]] and "xref-rebuilt" in f.summary()["leniency"]
    moved = data.replace(b"%PDF-1.7\n", b"%PDF-1.7\n%shift\n")
    assert pdf.File(moved).page_texts() == [["kept"]]
    for junk in (b"", b"%PDF-", b"<<" * 5000, data[:200], b"startxref\n99999999999\n%%EOF"):
        assert pdf.File(junk).summary()["page_count_walked"] in (0, 1)


def test_mutations_never_raise():
    data = pdf.write([["some text"] * 3] * 2, compress=False)
    rng = np.random.default_rng(3)
    for _ in range(300):
        b = bytearray(data)
        for i in rng.integers(0, len(b), 6):
            b[i] = rng.integers(0, 256)
        f = pdf.File(bytes(b))
        f.summary(), f.page_texts(), f.comments(), f.form_fields(), f.layers(), f.attachments()


def test_object_streams_and_xref_streams():
    import zlib

    out = bytearray(b"%PDF-1.5\n")
    at = {}
    members = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R >>"}
    heads, bodies = b"", b""
    for n, body in members.items():
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    packed = zlib.compress(heads + bodies)
    at[4] = len(out)
    out += b"4 0 obj\n<< /Type /ObjStm /N 3 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(heads), len(packed), packed)
    at[5] = len(out)
    rows = [bytes(5)] + [bytes([2, 0, 0, 4, i]) for i in range(3)] + [bytes([1]) + at[4].to_bytes(3, "big") + b"\0", bytes([1]) + at[5].to_bytes(3, "big") + b"\0"]
    table, above = b"", bytes(5)
    for row in rows:  # PNG predictor "up"
        table += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above))
        above = row
    packed = zlib.compress(table)
    out += b"5 0 obj\n<< /Type /XRef /Size 6 /W [1 3 1] /Root 1 0 R /Length %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(packed), packed, at[5])
    f = pdf.File(bytes(out))
    assert f.pages() == [3] and f.summary()["leniency"] == []


def test_forms_layers_comments_attachments():
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [5 0 R] >> /OCProperties << /OCGs [8 0 R 9 0 R] /D << /BaseState /ON /OFF [9 0 R] >> >> /Names << /EmbeddedFiles << /Names [(k) 10 0 R] >> >> >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Annots [4 0 R 12 0 R] >>",
        4: b"<< /Subtype /Text /T (Ann) /Contents (a \\(note\\)) /IRT 12 0 R >>", 12: b"<< /Subtype /Link >>",
        5: b"<< /T (form) /Kids [6 0 R 7 0 R] >>", 6: b"<< /T (a) /FT /Tx /V <FEFF00E9> /Ff 3 >>", 7: b"<< /T (sig) /FT /Sig >>",
        8: b"<< /Type /OCG /Name (Base) >>", 9: b"<< /Type /OCG >>", 10: b"<< /F (old.txt) /UF (new.txt) /EF << /F 11 0 R >> >>", 11: b"<< /Length 3 >>\nstream\nabc\nendstream",
    }
    f = pdf.File(pdf.append(b"%PDF-1.7\n", objects, b"/Root 1 0 R", None))
    assert [(x["name"], x["type"], x["value"], x["read_only"], x["required"]) for x in f.form_fields()] == [("form.a", "Tx", "é", True, True), ("form.sig", "Sig", "", False, False)]
    assert [(x["name"], x["visible"]) for x in f.layers()] == [("Base", True), ("Layer 2", False)]
    assert [(x["page"], x["author"], x["contents"], x["is_reply"]) for x in f.comments()] == [(1, "Ann", "a (note)", True)]
    assert f.attachments() == [{"name": "new.txt", "data": b"abc"}] and f.attachments(2)[0]["data"] is None
    assert f.summary()["sig_count"] == 1 and f.summary()["has_acroform"]


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(pdf.write([["x"], ["y"]]))
    (tmp_path / "b.pdf").write_bytes(b"no such thing")
    (tmp_path / "c.txt").write_bytes(b"")
    got = {r.path.rpartition("/")[2]: r.page_count_walked for r in pdf.summaries(pdf.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": 2, "b.pdf": 0}


def chain(spark, n):
    return spark.createDataFrame([(i, i - 1 if i else None, "x" if i == 0 else None) for i in range(n)], "node long, parent long, v string")


def test_deep_trees_are_errors(spark):
    assert tree.closure(chain(spark, 65)).where("node = 64").count() == 65
    got = {(r.node, r.ancestor): r.distance for r in tree.closure(chain(spark, 6), 5).collect()}
    assert got == {(i, j): i - j for i in range(6) for j in range(i + 1)}
    loop = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 1, None)], "node long, parent long, v string")
    for bad, depth in ((chain(spark, 66), 64), (chain(spark, 6), 4), (chain(spark, 6), 3), (loop, 64)):
        with pytest.raises(ValueError):
            tree.closure(bad, depth)
    assert {(r.node, r.v) for r in tree.inherited(chain(spark, 40), "v").collect()} == {(i, "x") for i in range(40)}
    with pytest.raises(ValueError):
        tree.inherited(loop, "v")


def test_long_chains_of_jobs(spark):
    n = 70
    all_jobs = spark.createDataFrame([(i,) for i in range(n + 3)], "job long")
    deps = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(n, n + 1), (n + 1, n), (n + 2, n)], "job long, needs long")
    assert {r.job: r.level for r in jobs.levels(all_jobs, deps).collect()} == {i: i for i in range(n)} | {n: None, n + 1: None, n + 2: None}
    assert {r.job for r in jobs.blocked(deps, spark.createDataFrame([(0,)], "job long")).collect()} == set(range(1, n))


def test_run_states(spark):
    all_jobs = spark.createDataFrame([(i, i != 4) for i in range(1, 10)], "job long, idempotent boolean")
    deps = spark.createDataFrame([(2, 1), (3, 2), (6, 5), (7, 1), (9, 8)], "job long, needs long")
    events = spark.createDataFrame([(1, 1, 1, "started"), (1, 2, 2, "succeeded"), (2, 3, 1, "crashed"), (4, 1, 1, "crashed"), (5, 1, 1, "started"), (5, 2, 2, "failed"), (8, 1, 1, "crashed"), (8, 2, 2, "started"), (8, 2, 3, "crashed")], "job long, ts long, seq long, kind string")
    got = {r.job: (r.state, r.reason) for r in jobs.run_states(all_jobs, deps, events).collect()}
    lost = ("failed", "dependency did not complete")
    assert got == {1: ("succeeded", None), 2: ("ready", None), 3: ("pending", None), 4: ("failed", "worker crashed"), 5: ("failed", "failed"), 6: lost, 7: ("ready", None), 8: ("failed", "worker crashed"), 9: lost}
