"""Queries over files: each part becomes a file with one feature, which the reader has to find again."""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import spread, table
from ..operators import appearance as A
from ..operators.drawing import png
from ..session import shared_folder
from ..sources import pdf
from ..sources.writers import publish
from .batch import parse
from .batch import run as run_batch
from .catalog import query


def stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), more, data)


def saved(k: int, objects: dict[int, bytes], root: bytes = b"/Root 1 0 R") -> bytes:
    """By k: a classic section, object and section streams, or a file whose section can't be found."""
    if k % 3 == 1:
        return pdf.compact(objects, root)
    data = pdf.append(b"%PDF-1.7\n", objects, root, None)
    return data.replace(b"startxref", b"startxfer") if k % 3 == 2 else data


def files(spark: SparkSession, sf_dir: str, build: Callable[[int, str, int], bytes]) -> DataFrame:
    """id and content: build(p_partkey, p_name, p_size) for each part."""

    def run(batches):
        for t in batches:
            yield pd.DataFrame({"id": t["p_partkey"], "content": [build(int(k), n, int(s)) for k, n, s in zip(t["p_partkey"], t["p_name"], t["p_size"])]})

    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).mapInPandas(run, "id long, content binary")


def tree(pages: list[bytes], catalog: bytes = b"", node: bytes = b"", rest: dict[int, bytes] | None = None) -> dict[int, bytes]:
    """Catalog 1, page tree 2, pages from 10 on."""
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(len(pages)))
    out = {1: b"<< /Type /Catalog /Pages 2 0 R %s >>" % catalog, 2: b"<< /Type /Pages /Count %d /Kids [%s] %s >>" % (len(pages), kids, node)}
    return out | {10 + i: b"<< /Type /Page /Parent 2 0 R %s >>" % p for i, p in enumerate(pages)} | (rest or {})


def shown_file(k: int, name: str, size: int) -> bytes:
    """One page that shows a name in all ways: pieces, hexadecimal, next-line operators, codes with a map, a form of lists."""
    half = len(name) // 2
    codes = b"".join(b"%04X" % (ord(c) + 1) for c in name)
    cmap = b"1 beginbfrange <0002> <0101> <0001> endbfrange"
    body = b"BT /F1 9 Tf 12 TL 72 720 Td [%s -20 %s -400 (%d)] TJ T* <%s> Tj %s ' 0 0 (%d) \" 0 -12 Td /F2 9 Tf <%s> Tj ET" % (
        pdf.literal(name[:half]), pdf.literal(name[half:]), size, name.encode().hex().encode(), pdf.literal(f"next {k}"), k * 2, codes)
    packed = zlib.compress(body[:40]), zlib.compress(body[40:])
    split = b"/Contents [20 0 R 21 0 R]" if b"(" not in body[30:45] and body[39:40] == b" " else b"/Contents 22 0 R"
    whole = zlib.compress(body)
    flate = b" /Filter /FlateDecode"
    rest = {20: stream(packed[0], flate), 21: stream(packed[1], flate), 22: stream(whole, flate), 30: b"<< /Type /Font /Subtype /Type0 /ToUnicode 31 0 R >>", 31: stream(cmap)}
    return saved(k, tree([split], node=b"/Resources << /Font << /F2 30 0 R >> >>", rest=rest))


@query("""SELECT p_partkey AS id, 0 AS page, i::INT AS line_index, [p_name || ' ' || p_size, p_name, 'next ' || p_partkey, (p_partkey * 2)::VARCHAR, p_name][i + 1] AS text FROM part, range(5) t(i)""")
def pdf_shown_text(spark, sf_dir):
    return pdf.texts(files(spark, sf_dir, shown_file), "id")


def page_file(k: int, name: str, size: int) -> bytes:
    """Three pages: the first takes all from above, the second has its own box and turn, the third a crop that reaches out."""
    pages = [b"", b"/MediaBox [%d 500 100 100] /Rotate -90" % (100 + size), b"/CropBox [50 50 900 %d] /Rotate 45" % (150 + size)]
    return saved(k, tree(pages, node=b"/MediaBox [0 0 %d 400] /Rotate %d" % (200 + size, k % 4 * 90)))


@query("""SELECT p_partkey AS id, i::INT AS index, (CASE i WHEN 0 THEN CASE WHEN p_partkey % 2 = 1 THEN 400 ELSE 200 + p_size END WHEN 1 THEN 400 ELSE 150 + p_size END)::DOUBLE AS width,
 (CASE i WHEN 0 THEN CASE WHEN p_partkey % 2 = 1 THEN 200 + p_size ELSE 400 END WHEN 1 THEN p_size ELSE 100 + p_size END)::DOUBLE AS height, (CASE i WHEN 0 THEN p_partkey % 4 * 90 WHEN 1 THEN 270 ELSE 0 END)::INT AS rotation FROM part, range(3) t(i)""")
def pdf_page_meta(spark, sf_dir):
    return pdf.page_metas(files(spark, sf_dir, page_file), "id")


def outline_file(k: int, name: str, size: int) -> bytes:
    """Bookmarks: the name with a plain destination and two children (named, in a name tree and by an action), then a last one without."""
    title = pdf.literal
    rest = {
        40: b"<< /Type /Outlines /First 41 0 R /Last 44 0 R /Count 4 >>",
        41: b"<< /Title %s /Parent 40 0 R /Next 44 0 R /First 42 0 R /Last 43 0 R /Dest [11 0 R /XYZ 0 %d 0] >>" % (title(name), size),
        42: b"<< /Title %s /Parent 41 0 R /Next 43 0 R /Dest (spot) >>" % title(f"größe {size}"),
        43: b"<< /Title %s /Parent 41 0 R /A << /S /GoTo /D /old >> >>" % title(f"old – {k}"),
        44: b"<< /Title 45 0 R /Parent 40 0 R >>", 45: title("last"),
        46: b"<< /Dests 47 0 R >>", 47: b"<< /Kids [48 0 R] >>", 48: b"<< /Limits [(a) (z)] /Names [(other) [10 0 R /Fit] (spot) << /D [12 0 R /Fit] >>] >>", 49: b"<< /old [11 0 R /Fit] >>",
    }
    return saved(k, tree([b"", b"", b""], catalog=b"/Outlines 40 0 R /Names 46 0 R /Dests 49 0 R", rest=rest))


@query("""SELECT p_partkey AS id, i::INT AS ordinal, CASE WHEN i IN (1, 2) THEN 0 END::INT AS parent, (i IN (1, 2))::INT AS depth, [p_name, 'größe ' || p_size, 'old – ' || p_partkey, 'last'][i + 1] AS title, [1, 2, 1, 0][i + 1]::INT AS page,
 [p_name, p_name || '/größe ' || p_size, p_name || '/old – ' || p_partkey, 'last'][i + 1] AS path FROM part, range(4) t(i)""")
def pdf_outline(spark, sf_dir):
    return pdf.outline_paths(files(spark, sf_dir, outline_file), "id")


def tagged_file(k: int, name: str, size: int) -> bytes:
    """Two pages drawn out of order: a heading, a paragraph that goes on overleaf, and a picture with a description."""
    first = b"/P << /MCID 0 >> BDC (body %d) Tj EMC /H1 << /MCID 1 >> BDC %s Tj EMC" % (size, pdf.literal(name))
    second = b"/Artifact BMC (page 2) Tj EMC /P << /MCID 2 >> BDC [(ta) -20 (il)] TJ EMC"
    rest = {
        100: b"<< /Type /StructTreeRoot /K [101 0 R 102 0 R 103 0 R] >>", 101: b"<< /S /H1 /Pg 10 0 R /K [1] >>", 102: b"<< /S /P /Pg 10 0 R /K [0 << /Type /MCR /MCID 2 /Pg 11 0 R >>] >>",
        103: b"<< /S /Figure /Pg 11 0 R /Alt %s >>" % pdf.literal(f"picture {k}"), 104: stream(first), 105: stream(second),
    }
    return saved(k, tree([b"/Contents 104 0 R", b"/Contents 105 0 R"], catalog=b"/MarkInfo << /Marked true >> /StructTreeRoot 100 0 R", rest=rest))


@query("""SELECT p_partkey AS id, i::INT AS block, [0, 0, 1, 1][i + 1]::INT AS page, ['H1', 'P', 'P', 'Figure'][i + 1] AS element, [p_name, 'body ' || p_size, 'tail', '[Figure: picture ' || p_partkey || ']'][i + 1] AS text FROM part, range(4) t(i)""")
def pdf_reading_order(spark, sf_dir):
    return pdf.reading_order(files(spark, sf_dir, tagged_file), "id")


def form_file(k: int, name: str, size: int) -> bytes:
    """A field tree with a named parent, a checkbox and a field without a value."""
    rest = {
        50: b"<< /Fields [51 0 R 54 0 R] >>", 51: b"<< /T (who) /FT /Tx /Kids [52 0 R 53 0 R] >>", 52: b"<< /T (name) /V %s /Ff 2 >>" % pdf.literal(name), 53: b"<< /T (size) /V (%d) /Ff 1 >>" % size,
        54: b"<< /T (agreed) /FT /Btn /V /%s >>" % (b"Yes" if k % 2 else b"Off"),
    }
    return saved(k, tree([b""], catalog=b"/AcroForm 50 0 R", rest=rest))


@query("""SELECT p_partkey AS id, ['who.name', 'who.size', 'agreed'][i] AS name, ['Tx', 'Tx', 'Btn'][i] AS type, [p_name, p_size::VARCHAR, CASE WHEN p_partkey % 2 = 1 THEN '/Yes' ELSE '/Off' END][i] AS value, [2, 1, 0][i]::INT AS flags, i = 2 AS read_only, i = 1 AS required FROM part, range(1, 4) t(i)""")
def pdf_fields(spark, sf_dir):
    return pdf.fields(files(spark, sf_dir, form_file), "id")


def review_file(k: int, name: str, size: int) -> bytes:
    """Two pages: a note with a reply and a link on the second."""
    rest = {
        60: b"<< /Type /Annot /Subtype /Text /T %s /Contents %s /M (D:20240102) >>" % (pdf.literal(f"user {size}"), pdf.literal(name)),
        61: b"<< /Type /Annot /Subtype /Text /T (reviewer) /Contents (re: %d) /IRT 60 0 R >>" % k, 62: b"<< /Type /Annot /Subtype /Link >>",
    }
    return saved(k, tree([b"", b"/Annots [60 0 R 62 0 R 61 0 R]"], rest=rest))


@query("""SELECT p_partkey AS id, 2 AS page, 'Text' AS subtype, CASE i WHEN 0 THEN 'user ' || p_size ELSE 'reviewer' END AS author, CASE i WHEN 0 THEN p_name ELSE 're: ' || p_partkey END AS contents, CASE i WHEN 0 THEN 'D:20240102' ELSE '' END AS modified, i = 1 AS is_reply FROM part, range(2) t(i)""")
def pdf_comments(spark, sf_dir):
    return pdf.comments(files(spark, sf_dir, review_file), "id")


def layer_file(k: int, name: str, size: int) -> bytes:
    """Two layers, of which the base state and a list say what is seen."""
    config = b"/D << /BaseState /OFF /ON [71 0 R] >>" if k % 2 else b"/D << /OFF [71 0 R] >>"
    rest = {70: b"<< /OCGs [71 0 R 72 0 R] %s >>" % config, 71: b"<< /Type /OCG /Name %s >>" % pdf.literal(name), 72: b"<< /Type /OCG >>"}
    return saved(k, tree([b""], catalog=b"/OCProperties 70 0 R", rest=rest))


@query("""SELECT p_partkey AS id, (70 + i)::INT AS obj, CASE i WHEN 1 THEN p_name ELSE 'Layer 2' END AS name, (p_partkey % 2 = 1) = (i = 1) AS visible FROM part, range(1, 3) t(i)""")
def pdf_layers(spark, sf_dir):
    return pdf.layers(files(spark, sf_dir, layer_file), "id")


def attached_file(k: int, name: str, size: int) -> bytes:
    """An embedded file of so many repeats of its name."""
    data = zlib.compress(name.encode() * size)
    rest = {80: b"<< /EmbeddedFiles 81 0 R >>", 81: b"<< /Names [%s 82 0 R] >>" % pdf.literal(name), 82: b"<< /Type /Filespec /F (a) /UF %s /EF << /F 83 0 R >> >>" % pdf.literal(f"{name}.txt"), 83: stream(data, b" /Filter /FlateDecode")}
    return saved(k, tree([b""], catalog=b"/Names 80 0 R", rest=rest))


@query("SELECT p_partkey AS id, p_name || '.txt' AS name, strlen(p_name) * p_size AS bytes, md5(repeat(p_name, p_size)) AS data_md5 FROM part")
def pdf_attachments(spark, sf_dir):
    return pdf.attachments(files(spark, sf_dir, attached_file), "id").select("id", "name", F.octet_length("data").cast("long").alias("bytes"), F.md5("data").alias("data_md5"))


def signed_file(k: int, name: str, size: int) -> bytes:
    level = b"/Reference [<< /TransformMethod /DocMDP /TransformParams << /P %d >> >>]" % (k % 3 + 1) if k % 2 else b""
    rest = {90: b"<< /Type /Sig /Name %s /Reason (%d) /M (D:2024) /ByteRange [0 %d %d 9] /Contents <%s> %s >>" % (pdf.literal(name), size, size, size + 40, b"00FF" * 3, level)}
    return saved(0, tree([b""], rest=rest))


@query("""SELECT p_partkey AS id, 90 AS obj, '0,' || p_size || ',' || (p_size + 40) || ',9' AS byte_range, '00FF00FF00FF' AS contents, p_name AS name, p_size::VARCHAR AS reason, 'D:2024' AS time, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 3 + 1 END::INT AS level FROM part""")
def pdf_signatures(spark, sf_dir):
    rows = pdf.signed(files(spark, sf_dir, signed_file), "id")
    return rows.withColumn("byte_range", F.array_join(F.col("byte_range").cast("array<string>"), ",")).withColumn("contents", F.hex("contents"))


@query("SELECT p_partkey AS id, 'startxref-missing' AS kind, '' AS detail FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT p_partkey, 'xref-rebuilt', '' FROM part WHERE p_partkey % 3 = 2")
def pdf_repairs(spark, sf_dir):
    return pdf.events(files(spark, sf_dir, shown_file), "id")


def grown_file(k: int, name: str, size: int) -> bytes:
    """A file with an orphan, a second revision that changes a page, and for some a signature or encryption."""
    rest = {95: b"(%s)" % (b"x" * 500), 96: stream(b"(endobj %d) Tj" % size)}
    first = pdf.append(b"%PDF-1.7\n", tree([b"/Contents 96 0 R", b""], rest=rest), b"/Root 1 0 R", None)
    second = {11: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d 9] >>" % size}
    if k % 5 == 0:
        second[97] = b"<< /Type /Sig /ByteRange [0 1 2 3] >>"
    return pdf.append(first, second, b"/Root 1 0 R" + b" /Encrypt 98 0 R" * (k % 7 == 0), max(pdf.File(first).sections))


@query("""SELECT p_partkey AS id, 2 AS revisions_before, CASE WHEN p_partkey % 7 = 0 THEN 'an encrypted file can''t be rewritten' WHEN p_partkey % 5 = 0 THEN 'a rewrite would break the file''s signatures' END AS refused,
 CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 > 0 THEN 1 END::INT AS revisions, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 > 0 THEN 5 END::INT AS objects, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 > 0 THEN 2 END::INT AS pages FROM part""")
def pdf_sanitized(spark, sf_dir):
    rows = pdf.sanitized(files(spark, sf_dir, grown_file), "id")
    after = pdf.summaries(rows, "id", ["revisions_before", "refused"])
    return after.select("id", "revisions_before", "refused", "revisions", "objects", F.col("page_count_walked").alias("pages"))


def plump_file(k: int, name: str, size: int) -> bytes:
    """A page of repeated, uncompressed text."""
    body = b"BT 12 TL 0 700 Td " + b"".join(b"%s Tj T* " % pdf.literal(f"{name} {i}") for i in range(size + 40)) + b"ET"
    return saved(0, tree([b"/Contents 96 0 R"], rest={96: stream(body), 97: b"(unused)"}))


@query("""SELECT p_partkey AS id, ['screen', 'print', 'archive', 'custom'][p_partkey % 4 + 1] AS profile, p_size::BIGINT + 40 AS lines, true AS shorter, p_partkey % 4 <> 2 AS in_streams,
 md5((SELECT string_agg(p_name || ' ' || i, chr(10) ORDER BY i) FROM range(p_size + 40) t(i))) AS text_md5 FROM part""")
def pdf_optimized(spark, sf_dir):
    profiles = list(pdf.PROFILES)
    new = pdf.optimizations(files(spark, sf_dir, plump_file), lambda k: profiles[k % 4], "id")
    shown = F.md5(F.array_join("lines", "\n"))
    return new.select("id", "profile", F.size("lines").cast("long").alias("lines"), "shorter", "in_streams", shown.alias("text_md5"))


# Sinks


@query("SELECT p_partkey AS id, p_size AS width, 3 AS height, md5(repeat('A', p_size * 12)) AS pixels_md5 FROM part")
def image_export(spark, sf_dir):
    """Images written as PNG files and read back: size from the header, pixels from the rows."""
    def run(batches):
        for t in batches:
            made = []
            for k, w in zip(t["p_partkey"], t["p_size"]):
                image = png(b"A" * (12 * w), w, 3)
                width, height = int.from_bytes(image[16:20], "big"), int.from_bytes(image[20:24], "big")
                rows = zlib.decompress(image[image.index(b"IDAT") + 4 : image.index(b"IEND") - 8])
                made.append((k, width, height, b"".join(rows[i + 1 : i + 1 + 4 * width] for i in range(0, len(rows), 4 * width + 1))))
            yield pd.DataFrame(made, columns=["id", "width", "height", "pixels"])

    made = table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "id long, width int, height int, pixels binary")
    return made.select("id", "width", "height", F.md5("pixels").alias("pixels_md5"))


@query("SELECT n_nationkey, n_name FROM nation")
def published_table(spark, sf_dir):
    """A table that is staged, read back, accepted and only then put in its place."""
    target = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    publish(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), target, lambda df: df.count() > 0 and df.where("n_name IS NULL").isEmpty())
    return spark.read.parquet(target)


_DUPLICATED = "(SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY page) - 1)::INT AS page, content FROM (SELECT doc, page, content FROM {p} UNION ALL SELECT doc, page, content FROM {p} WHERE page = 0))"
_PAGES = "(SELECT l_orderkey AS doc, l_linenumber - 1 AS page, max(l_partkey) AS content FROM lineitem GROUP BY ALL)"


@query(f"SELECT doc, page // 2 + 1 AS chunk, page % 2 AS page, replace(content::VARCHAR, '7', '█') || chr(10) || 'seen' AS text, 270 AS rotation FROM {_DUPLICATED.format(p=_PAGES)}")
def batch_pipeline(spark, sf_dir):
    steps = parse("[rotate]\ndegrees = -90\n[duplicate]\npages = 1\n# what is hidden comes before what is added\n[redact]\nterm = 7\n[stamp]\ntext = seen\n[split]\nsize = 2\n")
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("page")).agg(F.max("l_partkey").cast("string").alias("text"))
    out, results = run_batch(pages.withColumn("rotation", F.lit(None).cast("int")), steps)
    if not all(r.ok for r in results):
        raise RuntimeError(results[-1].message)
    return out.select("doc", "chunk", "page", "text", "rotation")


# Appearances


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn thing per part and kind."""
    kinds = F.array(*map(F.lit, A.KINDS))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(kinds, (F.col("p_partkey") % len(A.KINDS) + 1).cast("int")).alias("kind"), (F.col("p_size") / 8).alias("x"), F.lit(10.0).alias("y"), (F.col("p_size") * 1.0).alias("width"), F.lit(20.5).alias("height"),
        F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)).alias("color"), F.lit(1.5).alias("border"), F.col("p_name").alias("text"),
        F.array(F.array(point(F.col("p_size"), F.lit(1)), point(F.lit(30), F.lit(4.25)), point(F.lit(7), F.col("p_size") / 4))).alias("strokes"))
    return p


@query("""WITH k AS (SELECT p_partkey, p_partkey % 15 AS k, p_size / 8 AS x, p_size * 1.0::DOUBLE AS w, p_size::DOUBLE AS s, p_name FROM part)
 SELECT p_partkey, CASE k WHEN 0 THEN 'highlight' WHEN 2 THEN 'strikeout' WHEN 9 THEN 'rectangle' WHEN 14 THEN 'redaction' END AS kind,
 CASE k WHEN 0 THEN printf('1.000 0.500 0.000 rg' || chr(10) || '%.1f 10.0 %.1f 20.5 re f' || chr(10), x, w)
  WHEN 2 THEN printf('1.000 0.500 0.000 rg' || chr(10) || '%.1f 10.0 %.1f 20.5 re f' || chr(10) || '1.000 0.500 0.000 rg' || chr(10) || '1 w' || chr(10) || '%.1f 20.2 m %.1f 20.2 l S' || chr(10), x, w, x, x + w)
  WHEN 9 THEN printf('1.000 0.500 0.000 rg' || chr(10) || '1.5 w' || chr(10) || '%.1f 10.0 %.1f 20.5 re S' || chr(10), x, w)
  ELSE printf('1.000 0.500 0.000 rg' || chr(10) || '%.1f 10.0 %.1f 20.5 re f' || chr(10) || 'BT' || chr(10) || '/F1 10 Tf' || chr(10) || '1 1 1 rg' || chr(10) || '%.1f 20.2 Td' || chr(10) || '(Redacted) Tj' || chr(10) || 'ET' || chr(10), x, w, x + 4) END AS stream
 FROM k WHERE k IN (0, 2, 9, 14)""")
def appearance_streams(spark, sf_dir):
    rows = annotations(spark, sf_dir).where(F.col("kind").isin("highlight", "strikeout", "rectangle", "redaction"))
    return A.streams(rows, "p_partkey").select("p_partkey", "kind", F.decode("stream", "UTF-8").alias("stream"))


@query("SELECT p_partkey, ['highlight', 'underline', 'strikeout', 'squiggly', 'note', 'freetext', 'ink', 'line', 'arrow', 'rectangle', 'ellipse', 'polygon', 'polyline', 'stamp', 'redaction'][p_partkey % 15 + 1] AS kind, true AS drawn FROM part")
def appearance_of_every_kind(spark, sf_dir):
    return A.streams(annotations(spark, sf_dir), "p_partkey").select("p_partkey", "kind", (F.octet_length("stream") > 0).alias("drawn"))


@query("""SELECT p_partkey, printf('1 1 1 rg' || chr(10) || '0 0 %.1f 20.5 re f' || chr(10) || '0 0 0 RG' || chr(10) || '0.5 w' || chr(10) || '0 0 %.1f 20.5 re S' || chr(10) || 'BT' || chr(10) || '/F1 %.1f Tf' || chr(10) || '0 0 0 rg' || chr(10) || '2.0 %.1f Td' || chr(10) || '(%s) Tj' || chr(10) || 'ET' || chr(10),
 100.0 + p_size, 100.0 + p_size, greatest(6.0, least(24.0, p_size / 2)), greatest(2.0, 20.5 - greatest(6.0, least(24.0, p_size / 2))), p_name) AS stream FROM part""")
def widget_appearances(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("text").alias("kind"), (F.lit(100.0) + F.col("p_size")).alias("width"), F.lit(20.5).alias("height"), F.col("p_name").alias("value"), F.lit("n").alias("name"), (F.col("p_size") / 2).alias("font_size"), F.lit(False).alias("password"))
    return A.widgets(rows, "p_partkey").select("p_partkey", F.decode("stream", "UTF-8").alias("stream"))
