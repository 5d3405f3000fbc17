"""Files are built and read once, over all cores, and walks over them don't go byte by byte."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellumine.plans import file_queries as Q
from vellumine.sources import pdf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A table of one row group, which one task would read."""
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.read.parquet(f"{SF}/part.parquet").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["pdf_optimized", "pdf_outline", "pdf_sanitized", "pdf_reading_order"])
def test_files_are_dealt_out_and_read_once(spark, parts, name):
    rows = getattr(Q, name)(spark, parts)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.count("Join") == 0
    assert plan.count("LogicalRDD") == 0 and plan.count("MapInPandas") == (3 if name == "pdf_sanitized" else 2)
    assert Q.files(spark, parts, Q.tagged_file).select(F.spark_partition_id()).distinct().count() > 1


def test_a_copy_with_the_same_contents_is_not_parsed_as_text(monkeypatch):
    data = pdf.write([["one"], ["two"]], compress=False)
    calls = []
    whole = pdf.text_lines
    monkeypatch.setattr(pdf, "text_lines", lambda *a: calls.append(1) or whole(*a))
    assert pdf.latest_only(data) and pdf.optimized(data, "screen") and not calls


def test_outline_paths(spark):
    rest = {3: b"<< /First 4 0 R >>", 4: b"<< /Title (a) /Next 7 0 R /First 5 0 R >>", 5: b"<< /Title (b/c) /First 6 0 R >>", 6: b"<< >>", 7: b"<< /Title (z) >>"}
    data = pdf.append(b"%PDF-1.7\n", Q.tree([b""], catalog=b"/Outlines 3 0 R", rest=rest), b"/Root 1 0 R", None)
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"junk"))], "id long, content binary")
    got = pdf.outline_paths(files, "id").orderBy("ordinal").collect()
    assert [(r.id, r.path, r.parent) for r in got] == [(1, "a", None), (1, "a/b/c", 0), (1, "a/b/c/", 1), (1, "z", None)]


def test_walks_keep_to_nesting():
    body = b"<< /A (x >> \\) /B 1) /C << /B 2 >> /Bee 3 /B [1 (]) [2]] /D << >> >> tail"
    assert pdf.dictionary(body, 0) == body[:-5]
    assert pdf.value(body, "B") == b"[1 (]) [2]]" and pdf.value(body, "Be") is None and pdf.value(body, "E") is None
    assert pdf.string_end(b"(a(b)\\)c) d", 0) == 9 and pdf.string_end(b"(open", 0) == 5
    rows = bytes([2, 1, 2, 2, 3, 255])
    assert pdf.unpredict(rows, 12, 2) == bytes([1, 2, 4, 1]) and pdf.unpredict(bytes([0, 1, 2]) + rows[3:], 12, 2) == bytes([1, 2, 4, 1])


def test_a_short_dictionary_is_walked_once_for_a_key(monkeypatch):
    calls = []
    whole = pdf.token
    monkeypatch.setattr(pdf, "token", lambda *a: calls.append(1) or whole(*a))
    body = b"<< /Seen (once) /Kids [1 0 R] /Kept << /Kids 2 >> >>"
    assert [pdf.value(bytes(bytearray(body)), "Kids") for _ in range(3)] == [b"[1 0 R]"] * 3 and len(calls) == 1
    long = body[:-2] + b"/Fill (" + b"x" * 600 + b") >>"
    assert [pdf.value(long, "Kids") for _ in range(2)] == [b"[1 0 R]"] * 2 and len(calls) == 3
