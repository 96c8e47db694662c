"""Containers made here by hand, read and rewritten by the operators."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lucerna.functions import sniff
from lucerna.operators import images, office, pdf, raw_scan, relations, verdict
from lucerna.plans import overview
from lucerna.sources import packages, pdf_tables
from lucerna.sources.images import jpeg_segments, parse_exif, read_segments


def frame(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "doc_id long, content binary")


def package(**parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return held.getvalue()


def test_damaged_packages_become_error_rows(spark):
    good = package(word__document_xml="<a/>")
    parts = packages.read_packages(frame(spark, good, b"PK\3\4 nothing", good[:30], None)).collect()
    assert [p["name"] for p in parts if p["doc_id"] == 0] == ["word/document.xml"]
    assert {p["doc_id"] for p in parts if p["error"]} == {1, 2, 3}


def test_inflating_is_bounded():
    bomb = zlib.compress(b"\0" * 1_000_000)[2:-4]
    with pytest.raises(ValueError, match="limit"):
        packages.inflate(bomb, 1000)


def test_doctype_is_refused():
    with pytest.raises(ValueError, match="document type"):
        packages.parse_nodes(b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')


def test_written_packages_are_deterministic(spark):
    parts = packages.read_packages(frame(spark, package(word__document_xml="<a>x</a>", b__c_xml="<b/>")))
    first, second = (packages.write_packages(parts).first()["content"] for _ in range(2))
    assert first == second
    again = packages.read_packages(frame(spark, bytes(first))).select("ord", "name", "data").orderBy("ord").collect()
    assert [(r["name"], bytes(r["data"])) for r in again] == [("word/document.xml", b"<a>x</a>"), ("b/c.xml", b"<b/>")]


def test_workbook_scores_75(spark):
    ss, rel = packages.NAMESPACES["ss"], packages.NAMESPACES["rel"]
    book = f'<workbook xmlns="{ss}"><sheets><sheet name="A" state="veryHidden"/></sheets><definedNames><definedName name="F">[1]H!A1</definedName></definedNames></workbook>'
    link = f'<Relationships xmlns="{rel}"><Relationship Id="1" Type="x" Target="C:\\x.xlsx" TargetMode="External"/></Relationships>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/connections.xml", f'<connections xmlns="{ss}"><connection><dbPr connection="a;Password=b"/></connection></connections>')
        z.writestr("xl/externalLinks/_rels/externalLink1.xml.rels", link)
    parts = packages.inspect_packages(frame(spark, held.getvalue()))
    found = office.office_findings(parts, packages.nodes_of(parts)).withColumn("kind", F.lit("office"))
    row = verdict.verdicts(spark.range(1).withColumnRenamed("id", "doc_id"), verdict.signals_of_findings(found)).first()
    assert (row["riesgo"], row["puntuacion"]) == ("alto", 75)


def test_rejecting_restores_properties(spark):
    w = packages.NAMESPACES["w"]
    body = f'<w:document xmlns:w="{w}"><w:p><w:pPr><w:b/><w:pPrChange w:id="1" w:author="x"><w:pPr><w:i/></w:pPr></w:pPrChange></w:pPr><w:ins w:author="x"><w:r><w:t>n</w:t></w:r></w:ins><w:del w:author="x"><w:r><w:delText>v</w:delText></w:r></w:del></w:p></w:document>'
    parts = packages.read_packages(frame(spark, package(word__document_xml=body)))
    out = {m: bytes(office.clean_parts(parts, changes=m).first()["data"]).decode() for m in ("accept", "reject")}
    assert "<w:t>n</w:t>" in out["accept"] and "v</w:" not in out["accept"] and "<w:b/>" in out["accept"] and "Change" not in out["accept"]
    assert "<w:t>v</w:t>" in out["reject"] and ">n<" not in out["reject"] and "<w:i/>" in out["reject"] and "<w:b/>" not in out["reject"]


def test_options_are_checked():
    with pytest.raises(ValueError, match="unknown"):
        office.checked({"colour": True})
    with pytest.raises(ValueError, match="wrong"):
        office.checked({"macros": "yes"})


def test_broken_images_become_error_rows(spark):
    files = frame(spark, b"\xff\xd8\xff\xe1\xff\xff", b"\x89PNG\r\n\x1a\n\xff\xff\xff\xffIDAT").withColumn("format", F.when(F.col("doc_id") == 0, "jpeg").otherwise("png"))
    rows = read_segments(files).collect()
    assert any(r["doc_id"] == 0 and r["error"] for r in rows)
    assert images.image_findings(read_segments(files)).count() >= 0


def test_exif_bounds():
    assert parse_exif(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 500)) is not None
    assert parse_exif(b"MM and more text") is None
    assert [k for k, _, _ in jpeg_segments(b"\xff\xd8\xff\xd9")] == ["SOI", "SCAN"]


def make_pdf(*objects, trailer="<< /Root 1 0 R >>"):
    body = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects)
    return body + b"trailer\n" + trailer.encode() + b"\nstartxref\n0\n%%EOF\n"


def test_compressed_objects_are_read_and_kept(spark):
    inner = b"2 0 3 35 << /Type /Pages /Kids [3 0 R] >>   << /Type /Page /Parent 2 0 R >>"
    first = inner.index(b"<<")
    second = inner.index(b"<< /Type /Page ") - first
    inner = inner.replace(b"3 35 ", b"3 %d " % second, 1)
    packed = zlib.compress(inner)
    holder = b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (first, len(packed), packed)
    files = frame(spark, make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (9, holder)))
    assert {r["num"] for r in pdf.read_objects(files).collect()} == {1, 2, 3, 9}
    out = pdf.clean_pdf(files).first()
    assert out["error"] is None and b"/Type /Page " in bytes(out["content"]) and b"ObjStm" not in bytes(out["content"])


def test_offsets_of_a_rewritten_file(spark):
    files = frame(spark, make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R /OpenAction 5 0 R >>"), (2, b"<< /Type /Pages /Kids [4 0 R] >>"), (4, b"<< /Type /Page /Parent 2 0 R >>"), (5, b"<< /S /JavaScript >>")))
    content = bytes(pdf.clean_pdf(files).first()["content"])
    assert b"OpenAction" not in content and b"JavaScript" not in content
    start = int(content.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    lines = content[start:].split(b"\n")
    assert lines[1] == b"0 5"
    for n in (1, 2, 4):
        at = int(lines[2 + n][:10])
        assert content[at:].startswith(b"%d 0 obj" % n)


def test_broken_and_encrypted_files_are_refused(spark):
    files = frame(
        spark,
        make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [7 0 R] >>")),
        make_pdf((1, b"<< /Type /Catalog >>"), trailer="<< /Root 1 0 R /Encrypt 3 0 R >>"),
        b"%PDF-1.4 nothing",
    )
    errors = {r["doc_id"]: r["error"] for r in pdf.clean_pdf(files).collect()}
    assert errors == {0: "broken references: 7", 1: "encrypted", 2: "no trailer"}


def test_pdf_strings():
    assert pdf.decode_string(r"(a\(b\)\101\n)") == "a(b)A\n"
    assert pdf.decode_string("<FEFF00E1>") == "á"


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 8, 9)], "doc_id int, src int, dst int")
    roots = spark.createDataFrame([(0, 1)], "doc_id int, node int")
    assert {r["node"] for r in relations.reachable(edges, roots, ["doc_id"]).collect()} == {1, 2, 3}


def test_predictors_are_undone():
    rows = [bytes([10, 20, 30, 40]), bytes([12, 19, 33, 41]), bytes([9, 9, 250, 3]), bytes([1, 2, 3, 4]), bytes([200, 1, 7, 7])]
    coded, above = b"", bytes(4)
    for kind, row in enumerate(rows):
        coded += bytes([kind])
        for i, x in enumerate(row):
            a, b, c = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded += bytes([(x - (0, a, b, (a + b) // 2, paeth)[kind]) & 0xFF])
        above = row
    assert pdf.undo_predictor(coded, 4) == b"".join(rows)
    with pytest.raises(ValueError, match="predictor"):
        pdf.undo_predictor(b"\x09abcd", 4)


# Spellings of XML, numbers and depths of PDF files ---------------------------


W = packages.NAMESPACES["w"]


def cleaned_with_checks(spark, options, **parts):
    before = packages.read_packages(frame(spark, package(**parts)))
    after = office.clean_parts(before, **options)
    found = office.violations(before, after.drop("stats", "error"), **options).collect()
    return {r["name"]: bytes(r["data"]).decode() for r in after.collect()}, {(r["part"], r["problem"]) for r in found}, {r["name"]: r["stats"] for r in after.collect()}


@pytest.mark.parametrize(
    "spelled",
    [
        f'<w:document xmlns:w="{W}"><w:p w:rsidR="1"><w:ins w:author="Ana Real" w:date="d"><w:t>x</w:t></w:ins></w:p></w:document>',
        f"<w:document xmlns:w='{W}'><w:p w:rsidR='1'><w:ins w:author='Ana Real'\n w:date = 'd'><w:t>x</w:t></w:ins></w:p></w:document>",
        f'<q:document xmlns:q="{W}"><q:p q:rsidR="1"><q:ins q:author="Ana Real" q:date="d"><q:t>x</q:t></q:ins></q:p></q:document>',
        f'<document xmlns="{W}" xmlns:z="{W}"><p z:rsidR="1"><ins z:author="Ana Real" z:date="d"><t>x</t></ins></p></document>',
        f'<a xmlns="urn:other"><q:ins xmlns:q="{W}" q:author="Ana &gt; Real" q:date="d"><q:t>x</q:t></q:ins></a>',
        '<w:document xmlns:w="http://purl.oclc.org/ooxml/wordprocessingml/main"><w:ins w:author="Ana Real" w:date="d"><w:t>x</w:t></w:ins></w:document>',
    ],
)
def test_authors_go_in_every_spelling(spark, spelled):
    out, problems, stats = cleaned_with_checks(spark, {}, word__document_xml=spelled)
    body = out["word/document.xml"]
    assert "Real" not in body and "date" not in body and "rsid" not in body and ">x<" in body and not problems
    assert stats["word/document.xml"]["authors"] == 1 and stats["word/document.xml"]["dates"] == 1
    # The check finds what a cleaner would leave.
    before = packages.read_packages(frame(spark, package(word__document_xml=spelled)))
    left = {r["problem"] for r in office.violations(before, before.select("doc_id", "ord", "name", "data")).collect()}
    assert {"residue: author", "residue: date"} <= left


def test_bytes_that_need_no_change_stay(spark):
    body = f"<?xml version='1.0'?>\r\n<!-- c --><w:document  xmlns:w='{W}' ><w:t xml:space='preserve'>a &#38; b &lt;w:author=\"x\"&gt;<![CDATA[ <w:date> ]]></w:t><w:p/ ></w:document >".replace("/ >", "/>")
    out, problems, _ = cleaned_with_checks(spark, {}, word__document_xml=body)
    assert out["word/document.xml"] == body and not problems


def test_all_marks_go_when_changes_are_settled(spark):
    marks = "".join(f"<w:{m} w:id='1' w:author='x'/>" for m in ("numberingChange", "tblGridChange", "customXmlInsRangeStart", "customXmlInsRangeEnd", "customXmlDelRangeStart", "customXmlDelRangeEnd", "moveFromRangeStart", "moveToRangeEnd", "cellDel", "cellIns"))
    body = f'<w:document xmlns:w="{W}"><w:p><w:rPr><w:ins w:author="x"/><w:b/><w:rPrChange w:author="x"><w:rPr/></w:rPrChange></w:rPr>{marks}<w:ins w:author="x"><w:r><w:t>n</w:t></w:r><w:del w:author="y"><w:r><w:delText>both</w:delText></w:r></w:del></w:ins><w:moveFrom><w:r><w:t>m</w:t></w:r></w:moveFrom><w:moveTo><w:r><w:t>m</w:t></w:r></w:moveTo><w:del w:author="x"><w:r><w:delText>v</w:delText></w:r></w:del></w:p></w:document>'
    for mode, shown in (("accept", "nm"), ("reject", "mv")):
        out, problems, _ = cleaned_with_checks(spark, {"changes": mode}, word__document_xml=body)
        text = out["word/document.xml"]
        assert not problems and office.office_parts.told_text(text.encode(), None) == shown
        assert ("<w:b/>" in text) == (mode == "accept") and "Change" not in text and "Range" not in text and "delText" not in text
    # A cleaner that loses text is told so.
    before = packages.read_packages(frame(spark, package(word__document_xml=body)))
    lost = before.select("doc_id", "ord", "name", F.lit(f'<w:document xmlns:w="{W}"><w:t>n</w:t></w:document>').cast("binary").alias("data"))
    assert "text differs" in {r["problem"] for r in office.violations(before, lost, changes="accept").collect()}


def test_comment_references_and_targets_go_in_every_spelling(spark):
    parts = {
        "word__document_xml": f"<q:document xmlns:q='{W}'><q:commentRangeStart q:id='0'/><q:r><q:commentReference q:id='0'/></q:r><q:r><q:t>x</q:t></q:r></q:document>",
        "word__comments_xml": f"<q:comments xmlns:q='{W}'><q:comment q:author='a'><q:t>n</q:t></q:comment></q:comments>",
        "word___rels__document_xml.rels": f"<r:Relationships xmlns:r='{packages.NAMESPACES['rel']}'><r:Relationship Target='/word/comments.xml' Id='1'/><r:Relationship Id='2' Target=\"../word/document.xml\"/></r:Relationships>",
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", parts["word__document_xml"])
        z.writestr("word/comments.xml", parts["word__comments_xml"])
        z.writestr("word/_rels/document.xml.rels", parts["word___rels__document_xml.rels"])
    before = packages.read_packages(frame(spark, held.getvalue()))
    after = office.clean_parts(before, comments="delete")
    out = {r["name"]: bytes(r["data"]).decode() for r in after.collect()}
    assert set(out) == {"word/document.xml", "word/_rels/document.xml.rels"}
    assert "comment" not in out["word/document.xml"] and "comments.xml" not in out["word/_rels/document.xml.rels"] and "Id='2'" in out["word/_rels/document.xml.rels"]
    assert office.violations(before, after.drop("stats", "error"), comments="delete").count() == 0


def test_a_part_that_cannot_be_read_refuses_its_file_alone(spark):
    from lucerna.plans import products

    good, bad = package(word__document_xml=f'<w:document xmlns:w="{W}"><w:ins w:author="x"/></w:document>'), package(word__document_xml="<w:document><unclosed></w:document>")
    got = {r["doc_id"]: r for r in products.clean(frame(spark, good, bad)).collect()}
    assert got[0]["error"] is None and got[0]["content"] is not None
    assert got[1]["error"] and got[1]["content"] is None


def test_long_property_texts_are_shown_whole(spark):
    title = "t" * 20_000
    core = f'<cp:coreProperties xmlns:cp="{packages.NAMESPACES["cp"]}" xmlns:dc="{packages.NAMESPACES["dc"]}"><dc:title>{title}</dc:title></cp:coreProperties>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"/>')
        z.writestr("docProps/core.xml", core)
    parts = packages.inspect_packages(frame(spark, held.getvalue()))
    assert title in {r["value"] for r in office.office_findings(parts, packages.nodes_of(parts)).collect()}


def test_deep_odd_and_good_pdf_files_beside_each_other(spark):
    n = 5000
    chain = make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Next 3 0 R >>"), *((k, b"<< /Next %d 0 R >>" % (k + 1)) for k in range(3, n)), (n, b"<< /Last true >>"))
    inner = b"a endobj 9 0 obj << /Evil true >> endobj endstream b"
    tricky = make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(inner), inner)))
    indirect = make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Length 4 0 R >>\nstream\n%s\nendstream" % inner), (4, b"%d" % len(inner)))
    unreached = make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages >>"), (4000000000, b"<< >>"))
    huge = make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [4000000000 0 R] >>"), (4000000000, b"<< >>"))
    sparse = make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [8000000 0 R] >>"), (8000000, b"<< /Far true >>"))
    nested = make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R /AA << /O << /A << /B << /C (>> /Keep) >> >> >> >> /OpenAction [2 0 R [/Fit [(a]b)]]] /Lang (es) %s >>" % (b"/K%d 1 " * 5000 % tuple(range(5000)))), (2, b"<< /Type /Pages >>"))
    got = {r["doc_id"]: r for r in pdf.clean_pdf(frame(spark, chain, tricky, indirect, unreached, huge, sparse, nested)).collect()}
    assert {i: r["error"] for i, r in got.items() if r["error"]} == {4: "object number beyond the limit"}
    assert bytes(got[0]["content"]).count(b" obj\n") == n and got[0]["stats"]["objects"] == n
    assert inner in bytes(got[1]["content"]) and inner in bytes(got[2]["content"])
    assert b"4000000000" not in bytes(got[3]["content"]) and got[3]["stats"]["dropped"] == 1
    far = bytes(got[5]["content"])
    table = far[int(far.rsplit(b"startxref\n", 1)[1].split(b"\n")[0]) :].split(b"\n")
    assert table[:2] == [b"xref", b"0 3"] and table[5] == b"8000000 1" and far[int(table[6][:10]) :].startswith(b"8000000 0 obj") and len(far) < 1000
    kept = bytes(got[6]["content"])
    assert b"/AA" not in kept and b"OpenAction" not in kept and b"/Lang (es)" in kept and b"/K4999 1" in kept and b"Keep" not in kept


def test_reachable_each_walks_deep_chains_in_one_shuffle(spark):
    edges = spark.createDataFrame([(d, k, k + 1) for d in (0, 1) for k in range(3000)] + [(0, 3000, 0), (2, 5, 6)], "doc_id long, src long, dst long")
    roots = spark.createDataFrame([(0, 0), (1, 2990)], "doc_id long, node long")
    got = relations.reachable_each(edges, roots, ["doc_id"]).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {0: 3001, 1: 11}


def crossed_pdf():
    """An old page and its newer version in an object stream, found through a cross-reference stream and an earlier table; a stray copy follows."""
    out, at = bytearray(b"%PDF-1.5\n"), {}

    def put(num, body):
        at[num] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (num, body))

    put(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    put(2, b"<< /Type /Pages /Kids [3 0 R] >>")
    put(3, b"<< /Type /Page /Parent 2 0 R /Old true >>")
    table = len(out)
    out += b"xref\n0 4\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[n] for n in (1, 2, 3)) + b"trailer\n<< /Size 4 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % table
    inner = b"3 0 " + b"<< /Type /Page /Parent 2 0 R /New true >>"
    put(5, b"<< /Type /ObjStm /N 1 /First 4 /Length %d >>\nstream\n%s\nendstream" % (len(inner), inner))
    rows = b"".join(bytes([k, *a.to_bytes(2, "big"), g]) for k, a, g in ((2, 5, 0), (1, at[5], 0), (1, len(out), 0)))
    lines = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(rows[i : i + 4], rows[i - 4 : i] if i else bytes(4), strict=True)) for i in range(0, len(rows), 4))
    packed = zlib.compress(lines)
    stream = len(out)
    put(6, b"<< /Type /XRef /Size 7 /Index [3 1 5 2] /W [1 2 1] /Root 1 0 R /Prev %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n%s\nendstream" % (table, len(packed), packed))
    stray = b"1 0 obj\n<< /Type /Catalog /Stray true >>\nendobj\n"
    return bytes(out) + stray + b"startxref\n%d\n%%%%EOF\n" % stream


def test_cross_reference_chain_tells_which_object_counts(spark):
    whole = crossed_pdf()
    damaged = whole[: whole.rindex(b"startxref")] + b"startxref\n7\n%%EOF\n"
    got = {(r["doc_id"], r["num"]): r["dict"] for r in pdf.read_objects(frame(spark, whole, damaged)).collect()}
    assert "/New" in got[0, 3] and "/Stray" not in got[0, 1]
    assert "/Old" in got[1, 3] and "/Stray" in got[1, 1]
    out = pdf.clean_pdf(frame(spark, whole)).first()
    assert out["error"] is None and b"/New true" in bytes(out["content"]) and b"/Old" not in bytes(out["content"])


def test_odd_tables_are_no_table():
    loop = b"%PDF-1.4\nxref\n0 1\n0000000000 65535 f \ntrailer\n<< /Root 1 0 R /Prev 9 >>\nstartxref\n9\n%%EOF\n"
    assert len(pdf_tables.sections_of(loop)) == 1 and pdf_tables.table_of(loop) == (None, {})
    for content in (b"", b"startxref", b"startxref 99999", b"startxref 0 1 0 obj << /Type /XRef /W [1 9 1] >> stream\n"):
        assert pdf_tables.table_of(content) == (None, {})


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + (len(p) + 2).to_bytes(2, "big") + p for m, p in segments) + b"\xff\xda\x00\x02x\xff\xd9"


def test_packets_that_are_not_utf8_do_not_stop_the_job(spark):
    xmp = b"<x:xmpmeta><xmp:CreatorTool>caf\xe9</xmp:CreatorTool></x:xmpmeta>"
    picture = frame(spark, jpeg((0xE1, images.HEADERS["XMP"] + xmp))).withColumn("format", F.lit("jpeg"))
    assert [r["value"] for r in images.image_findings(read_segments(picture)).collect()] == ["caf\ufffd"]
    files = frame(spark, make_pdf((1, b"<< /Type /Catalog /Metadata 2 0 R >>"), (2, b"<< /Type /Metadata /Length %d >>\nstream\n%s\nendstream" % (len(xmp), xmp))))
    objects = pdf.read_objects(files)
    assert "caf\ufffd" in {r["value"] for r in pdf.pdf_findings(files, objects, pdf.trailers(files, objects)).collect()}


def test_long_and_nested_strings_of_properties(spark):
    author = b"a\\)" * 50_000
    files = frame(spark, make_pdf((1, b"<< /Type /Catalog >>"), (2, b"<< /Title (x (y) z) /Author (%s) /Inner << /Subject (no) >> >>" % author), trailer="<< /Root 1 0 R /Info 2 0 R >>"))
    objects = pdf.read_objects(files)
    got = {r["label"]: r["value"] for r in pdf.pdf_findings(files, objects, pdf.trailers(files, objects)).filter("grp = 'Propiedades del documento'").collect()}
    assert got == {"Diccionario /Info": "presente", "Título": "x (y) z", "Autor": ("a)" * 60)}


def test_pictures_of_formats_that_are_not_cleaned(spark):
    tiff = b"II*\0\x08\0\0\0\x01\0\x3b\x01\x02\0\x04\0\0\0Ana\0\0\0\0\0"
    files = frame(spark, tiff, b"II*\0", b"\0\0\0\x18ftypavif", jpeg()).withColumn("format", sniff.sniff_image(F.col("content")))
    got = sorted((r["doc_id"], r["label"], r["value"]) for r in images.file_findings(files).collect())
    assert [x for x in got if x[1] not in ("Formato no soportado para limpiar",)] == [(0, "Autor (Artist)", "Ana"), (0, "Tipo detectado", "TIFF · 0 KB"), (1, "Tipo detectado", "TIFF · 0 KB"), (2, "Tipo detectado", "AVIF · 0 KB"), (3, "Tipo detectado", "JPEG · 0 KB")]
    assert [x[0] for x in got if x[1] == "Formato no soportado para limpiar"] == [0, 1, 2]


def test_raw_scanners_take_any_file(spark):
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "\x05SummaryInformation".encode("utf-16-le")
    rows = [(0, "a.doc", ole), (1, "b.docx", b"PK\3\4broken"), (2, "sin", None), (3, None, b""), (4, "c.PDF", None), (5, "d.png", b"no picture"), (6, "e.xlsx", package(xl__workbook_xml=b'<x><definedName name="a"/></x>', docProps__core_xml=b"<dc:title>\xff</dc:title>"))]
    got = raw_scan.raw_marks(spark.createDataFrame(rows, "doc_id long, name string, content binary")).collect()
    of = lambda i: [(r["present"], r["text"]) for r in sorted(got, key=lambda r: r["ord"]) if r["doc_id"] == i]
    assert [p for p, _ in of(0)] == [True, True, False]
    assert len(of(1)) == 1 and of(1)[0][0] is None and of(1)[0][1].startswith("error: ")
    assert of(2) == [(None, "sin analizador para .sin")] and of(3) == [(None, "sin analizador para .")]
    assert of(4)[0] == (None, "0 páginas") and not any(p for p, _ in of(4))
    assert (False, "no se pudo abrir") in of(5)
    assert {(True, "nombres definidos: a"), (True, "core.xml dc:title = \ufffd")} <= set(of(6))


def test_summaries_of_odd_files(spark):
    docx = package(word__document_xml=b"<a/>", docProps__custom_xml=b"<a/>")
    files = frame(spark, docx, b"PK\3\4broken", None, b"II*\0", b"\0\0\0\x18ftypheic", make_pdf((1, b"<< /Type /Catalog >>")), make_pdf((1, b"<< /Type /Catalog >>"), trailer="<< /Root 1 0 R /Encrypt 3 0 R >>"))
    got = {r["doc_id"]: r["summary"] for r in overview.summaries(files).collect()}
    assert got[0] == "Detectamos un archivo de Word con propiedades personalizadas." and got[1] is None and got[2] is None
    assert got[3].startswith("Detectamos una imagen TIFF, pero") and got[4].startswith("Detectamos una imagen HEIC, pero")
    assert got[5] == "PDF sin metadatos personales detectados." and got[6] == overview.ENCRYPTED


def test_verification_reads_each_side_once(spark):
    """Two parts of one name with other texts, a missing target named twice, and an unread part are told, each once; the plan shuffles once."""
    from lucerna.operators import office

    rels = b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="word/gone.xml"/><Relationship Id="b" Target="word/gone.xml"/></Relationships>'
    before = spark.createDataFrame([(1, 0, "word/a.xml", b"<a>x</a>"), (1, 1, "word/b.xml", b"<b/>"), (1, 2, "_rels/.rels", rels)], "doc_id long, ord int, name string, data binary")
    after = spark.createDataFrame([(1, 0, "word/a.xml", b"<a>y</a>"), (1, 1, "word/b.xml", b"<b>"), (1, 2, "_rels/.rels", rels)], "doc_id long, ord int, name string, data binary")
    wrong = office.violations(before, after)
    plan = wrong._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1
    assert sorted((r["part"], r["problem"]) for r in wrong.collect()) == [("_rels/.rels", "points at missing word/gone.xml"), ("word/a.xml", "text differs"), ("word/b.xml", "part cannot be read")]
