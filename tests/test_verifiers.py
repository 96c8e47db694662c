"""Lexer, range union, name trees and the second readers, each against brute force or planted leaks."""

import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lucerna.operators import image_check, images, pdf, pdf_check, relations
from lucerna.plans import products, verification
from lucerna.sources import image_written, pdf_tokens, pdf_written
from lucerna.sources.images import read_segments
from tests.test_files import frame, jpeg, make_pdf

# Tokens and ranges ---------------------------------------------------------


def test_references_are_read_from_tokens():
    t = "<< /Lang (see 9 0 R \\) (8 0 R) now) % 7 0 R\n /A [1 0 R << /B 2 0 R >>] /C <30203020 52> /D 3 0 R/E 4 0 R >>"
    entries, refs = pdf_tokens.structure(t)
    assert refs == [1, 2, 3, 4]
    assert {k: t[s:e] for d, k, _, s, e in entries if d == 1} == {"Lang": "(see 9 0 R \\) (8 0 R) now)", "A": "[1 0 R << /B 2 0 R >>]", "C": "<30203020 52>", "D": "3 0 R", "E": "4 0 R"}
    assert pdf_tokens.own("<< /J#61va#53cript 1 0 R /X /Y /Z >>") == {"JavaScript": "1 0 R", "X": "/Y", "Z": ""}


def test_the_lexer_moves_on_whatever_the_bytes_are():
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("<<>>[]()/%R0 9\n\\{}x\x00²") for _ in range(rng.randrange(60)))
        entries, refs = pdf_tokens.structure(t)
        assert all(0 <= a <= s <= e <= len(t) for _, _, a, s, e in entries) and all(r >= 0 for r in refs)


def test_cut_ranges_equals_a_byte_mask(spark):
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))) for i in range(60)]
    ranges = [(i, a, min(len(t), a + rng.randrange(12))) for i, t in texts for a in (rng.randrange(len(t) + 1) for _ in range(rng.randrange(6)))]
    rows = spark.createDataFrame(texts, "k int, t string")
    got = {r["k"]: r["t"] for r in relations.cut_ranges(rows, spark.createDataFrame(ranges, "k int, a int, b int"), ["k"], "t", "a", "b").collect()}
    assert got == {i: "".join(c for j, c in enumerate(t) if not any(k == i and a <= j < b for k, a, b in ranges)) for i, t in texts}


# PDF -------------------------------------------------------------------------


def scripted(names, *more):
    return make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R /Names %s >>" % names), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Parent 2 0 R >>"), *more)


def test_scripts_behind_references_are_removed(spark):
    tree = ((6, b"<< /Kids [7 0 R] >>"), (7, b"<< /Limits [(a) (a)] /Names [(a) 8 0 R] >>"), (8, b"<< /S /JavaScript /JS (evil) >>"))
    files = frame(
        spark,
        scripted(b"5 0 R", (5, b"<< /JavaScript 6 0 R >>"), *tree),
        scripted(b"4 0 R", (4, b"5 0 R"), (5, b"<< /J#61vaScript 6 0 R /Dests 9 0 R >>"), *tree, (9, b"<< /Names [] >>")),
        scripted(b"<< /JavaScript << /Names [(a) 8 0 R] >> >>", tree[2]),
        scripted(b"4 0 R", (4, b"5 0 R"), (5, b"4 0 R")),
    )
    got = {r["doc_id"]: r for r in pdf.clean_pdf(files).collect()}
    assert all(r["error"] is None for r in got.values())
    assert not any(b"evil" in bytes(r["content"]) or b"Script" in bytes(r["content"]) for r in got.values())
    assert b"/Dests 9 0 R" in bytes(got[1]["content"])
    objects = pdf.read_objects(files)
    roots = pdf.trailers(files).select("doc_id", pdf.root_of(F.col("trailer")).alias("root"))
    assert {(r["doc_id"], r["name"], r["num"]) for r in pdf.tree_names(objects, roots, "JavaScript").collect()} == {(0, "a", 8), (1, "a", 8), (2, "a", 8)}


def test_numbers_in_strings_are_no_references(spark):
    files = frame(spark, make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R /Lang (see 9 0 R now) >>"), (2, b"<< /Type /Pages /Title <39203020 52> % 8 0 R\n >>")))
    assert pdf.clean_pdf(files).first()["error"] is None


def test_deep_cleaning_takes_actions_of_pages(spark):
    page = b"<< /Type /Page /Parent 2 0 R /AA << /O << /S /JavaScript /JS (evil) >> >> /Metadata 4 0 R /Annots [<< /A 5 0 R >>] >>"
    files = frame(spark, make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, page), (4, b"<< /Type /Metadata /Length 6 >>\nstream\nAuthor\nendstream"), (5, b"<< /S /JavaScript /JS (evil too) >>")))
    plain, deep = (bytes(pdf.clean_pdf(files, deep=d).first()["content"]) for d in (False, True))
    assert b"evil" in plain and b"Author" in plain
    assert b"evil" not in deep and b"Author" not in deep and b"/Annots" in deep
    seen = pdf_check.pdf_violations(pdf_check.stream_digests(pdf.read_objects(files)), frame(spark, plain), deep=True)
    assert {r["problem"] for r in seen.collect()} >= {"left in object 3: /AA", "left in object 3: /Metadata", "left in object 5: /JS"}


def test_object_streams_beyond_the_limit_are_told(spark):
    files = frame(spark, make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages >>"), (9, b"<< /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length 3 >>\nstream\nxyz\nendstream")))
    assert pdf.clean_pdf(files).first()["error"] == pdf.UNREAD
    assert products.scan(files).first()["riesgo"] == "desconocido"


def test_planted_leaks_of_pdf_files_are_violations(spark):
    files = frame(spark, scripted(b"5 0 R", (5, b"<< /Dests 6 0 R >>"), (6, b"<< /Length 4 >>\nstream\nabcd\nendstream")))
    good = bytes(pdf.clean_pdf(files).first()["content"])
    streams = pdf_check.stream_digests(pdf.read_objects(files))
    planted = {
        "left among the names: script in object 5": good.replace(b"<< /Dests 6 0 R >>", b"<< /JavaScript 6 >>").replace(b"/JavaScript 6 >>", b"/JavaScript 6>>", 1),
        "another stream in object 6": good.replace(b"abcd", b"abce"),
        "reference to a missing object: 9": good.replace(b"[3 0 R]", b"[9 0 R]"),
        "trailer says /Info": good.replace(b"/Size 7 /Root", b"/Info 3 0 R /Root"),
        "bytes before object 2 belong to none": good.replace(b"endobj\n2 0 obj", b"(x) ok\n2 0 obj"),
        "no table where startxref says": good.replace(b"startxref\n", b"startxref\n1"),
    }
    listed = [good, *planted.values()]
    got = pdf_check.pdf_violations(spark.createDataFrame([(i, *r) for i in range(len(listed)) for r in [tuple(x)[1:] for x in streams.collect()]], "doc_id long, num long, sha string"), frame(spark, *listed)).collect()
    found = {i: {r["problem"] for r in got if r["doc_id"] == i} for i in range(len(listed))}
    assert found[0] == set()
    for i, problem in enumerate(planted, 1):
        if problem.startswith("bytes before"):
            assert found[i]
        else:
            assert problem in found[i], (problem, found[i])


def test_rewriting_is_linear_in_objects(spark):
    def made(n):
        return make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % k for k in range(3, n))), *((k, b"<< /Length 2 >>\nstream\nab\nendstream") for k in range(3, n)))

    took = []
    for n in (3_000, 12_000):
        start = time.time()
        out = pdf.clean_pdf(frame(spark, made(n))).first()
        took.append(time.time() - start)
        assert out["error"] is None and out["stats"]["objects"] == n - 1
    assert took[1] < 4 * took[0] + 10


def test_the_second_reader_is_bounded():
    assert "nested too deep" in pdf_written.read_written(b"%PDF-1.4\n%x\n1 0 obj\n" + b"[" * 5000 + b"\nendobj\nxref\n0 2\n0000000000 65535 f \n0000000012 00000 n \ntrailer\n<< /Root 1 0 R >>\nstartxref\n5028\n%%EOF\n")[2][-1]
    for raw in (b"", b"%PDF-", b"%PDF-1\nstartxref\n3\n%%EOF", b"%PDF-1\nxref\n0 1\n"):
        assert pdf_written.read_written(raw)[2]


# Pictures --------------------------------------------------------------------


def leaks():
    mark = b"Eduardo was here"
    return {
        "extended XMP": jpeg((0xE1, b"http://ns.adobe.com/xmp/extension/\0" + mark)), "old APP13": jpeg((0xED, b"Adobe_Photoshop2.5:" + mark)), "APP3": jpeg((0xE3, b"Meta\0\0" + mark)),
        "APP2": jpeg((0xE2, b"MPF\0" + mark)), "APP1": jpeg((0xE1, mark)), "APP12": jpeg((0xEC, mark)), "APP15": jpeg((0xEF, mark)), "COM": jpeg((0xFE, mark)), "tail": jpeg() + jpeg((0xFE, mark)),
    }


def test_every_planted_name_leaves_jpeg_files(spark):
    files = frame(spark, *leaks().values()).withColumn("format", F.lit("jpeg"))
    segments = read_segments(files)
    cleaned = images.assemble(images.clean_segments(segments))
    assert all(b"Eduardo" not in bytes(r["content"]) for r in cleaned.collect())
    assert image_check.picture_violations(files, cleaned).count() == 0
    told = {r["doc_id"] for r in image_check.picture_violations(files, files).collect()}
    assert told == set(range(len(leaks())))
    assert {r["doc_id"] for r in images.image_findings(segments).filter("label <> 'Segmentos con metadatos'").collect()} >= set(range(len(leaks()))) - {0, 1}


def test_adobe_and_jfif_segments_stay(spark):
    files = frame(spark, jpeg((0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), (0xEE, b"Adobe\0\x64\0\0\0\0\1"), (0xDB, b"\0" * 65))).withColumn("format", F.lit("jpeg"))
    out = bytes(images.assemble(images.clean_segments(read_segments(files))).first()["content"])
    assert out == bytes(files.first()["content"])


def png(rows, width, channels, *, filters=None, cuts=1, level=6, extra=b""):
    """A PNG of 8-bit rows, each with a filter of its own."""
    above, lines = bytes(width * channels), b""
    for i, row in enumerate(rows):
        kind = (filters or [0])[i % len(filters or [0])]
        lines += bytes([kind])
        for k, x in enumerate(row):
            a, b, c = (row[k - channels], above[k], above[k - channels]) if k >= channels else (0, above[k], 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines += bytes([(x - (0, a, b, (a + b) // 2, paeth)[kind]) & 0xFF])
        above = row
    packed = zlib.compress(lines, level)
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    size = -(-len(packed) // cuts)
    data = b"".join(chunk(b"IDAT", packed[i : i + size]) for i in range(0, len(packed), size))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)) + extra + data + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_pixels_do_not_depend_on_filters_and_cuts(channels):
    rng = random.Random(channels)
    rows = [bytes(rng.randrange(256) for _ in range(7 * channels)) for _ in range(10)]
    want = image_written.png_pixels(png(rows, 7, channels))
    assert want and all(image_written.png_pixels(png(rows, 7, channels, filters=f, cuts=c, level=9)) == want for f, c in (([1], 2), ([2], 3), ([3], 1), ([4], 5), ([0, 1, 2, 3, 4], 4)))
    other = [*rows[:-1], bytes(len(rows[0]))]
    assert image_written.png_pixels(png(other, 7, channels)) != want


def test_pictures_stored_in_another_way_are_compared_by_pixel(spark):
    rng = random.Random(9)
    rows = [bytes(rng.randrange(256) for _ in range(12)) for _ in range(6)]
    a, b, c = png(rows, 4, 3), png(rows, 4, 3, filters=[4], cuts=3), png(rows[::-1], 4, 3)
    assert image_check.picture_violations(frame(spark, a, a, a), frame(spark, a, b, c)).collect() == [(2, "other pixels")]


# Pairs -----------------------------------------------------------------------


def test_pairs_are_sent_to_their_verifiers(spark):
    picture, paper = jpeg((0xFE, b"note")), make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R /OpenAction 3 0 R >>"), (2, b"<< /Type /Pages >>"), (3, b"<< >>"))
    clean = {r["doc_id"]: bytes(r["content"]) for r in products.clean(frame(spark, picture, paper)).collect()}
    originals = spark.createDataFrame([("a.jpg", picture), ("b.pdf", paper), ("c.pdf", paper), ("d.txt", b"text"), ("e.jpg", picture), (None, b"x")], "name string, content binary")
    outputs = spark.createDataFrame([("a - sin metadatos.jpg", clean[0]), ("b - sin metadatos.pdf", clean[1]), ("c - sin metadatos.pdf", paper), ("d - sin metadatos.txt", b"text"), ("z.jpg", picture)], "name string, content binary")
    verified = verification.verify_pairs(originals, outputs)
    assert {r["name"]: r["status"] for r in verified.collect()} == {"a.jpg": "ok", "b.pdf": "ok", "c.pdf": "failed", "d.txt": "no verifier", "e.jpg": "no output", None: "no output"}
    assert {(r["kind"], r["status"], r["n"]) for r in verification.tally(verified).collect()} == {("image", "ok", 1), ("pdf", "ok", 1), ("pdf", "failed", 1), ("none", "no verifier", 1), ("image", "no output", 1), ("none", "no output", 1)}
