"""Packages as rows, responses, options as data, batches, streams of scans, camera directories and table functions."""

import io
import json
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lucerna.operators import images
from lucerna.plans import responses
from lucerna.sources import images as image_source
from lucerna.sources import packages, zip_rows
from lucerna.streaming import scans
from tests.test_files import frame, jpeg, make_pdf


def whole(pieces):
    out = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["request"], r["section"], r["ord"])):
        out.setdefault(r["request"], []).append(r["error"] if r["piece"] is None else bytes(r["piece"]))
    return out


def test_rows_of_bytes_are_a_package(spark):
    entries = [(1, 0, "a.txt", b"alpha" * 100), (1, 1, "ñ/é.bin", bytes(range(256))), (1, 2, "none", None), (2, 5, None, b"x")]
    rows = spark.createDataFrame(entries, "request int, ord long, name string, data binary")
    made = {k: b"".join(v) for k, v in whole(zip_rows.zip_rows(rows)).items()}
    with zipfile.ZipFile(io.BytesIO(made[1])) as z:
        assert z.testzip() is None and [(i.filename, i.date_time) for i in z.infolist()] == [(n, (1980, 1, 1, 0, 0, 0)) for n in ("a.txt", "ñ/é.bin", "none")]
        assert [z.read(i) for i in z.infolist()] == [b"alpha" * 100, bytes(range(256)), b""]
    with zipfile.ZipFile(io.BytesIO(made[2])) as z:
        assert z.namelist() == ["archivo"]
    assert {k: b"".join(v) for k, v in whole(zip_rows.zip_rows(rows.repartition(7))).items()} == made
    assert zip_rows.zip_rows(rows.limit(0)).count() == 0


def test_packages_beyond_the_format_are_told(spark, monkeypatch):
    monkeypatch.setattr(zip_rows, "MOST_ENTRIES", 2)
    rows = spark.createDataFrame([(k, i, f"{i}", b"x") for k, n in ((1, 2), (2, 3)) for i in range(n)], "request int, ord long, name string, data binary")
    got = whole(zip_rows.zip_rows(rows))
    assert got[2] == [zip_rows.BEYOND] and zipfile.ZipFile(io.BytesIO(b"".join(got[1]))).namelist() == ["0", "1"]


def test_a_response_has_files_and_a_report(spark):
    done = spark.createDataFrame([(1, 0, "a.txt", b"one", '{"n":1}'), (1, 1, "a.txt", b"two", '{"n":2}'), (1, 2, "bad.txt", None, '{"error":"x"}'), (2, 0, "b", b"", "{}")], "request int, ord long, name string, content binary, report string")
    made = {k: zipfile.ZipFile(io.BytesIO(b"".join(v))) for k, v in whole(responses.package_response(done, service="s")).items()}
    assert made[1].namelist() == ["a.txt", "a (2).txt", "informe.json"] and made[2].namelist() == ["b", "informe.json"]
    assert json.loads(made[1].read("informe.json")) == {"servicio": "s", "version": "1", "files": [{"n": 1}, {"n": 2}, {"error": "x"}]}


def test_json_pages_equal_a_fold(spark):
    rng = random.Random(8)
    sizes = {k: [rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 250]) for _ in range(rng.randrange(1, 30))] for k in range(12)}
    done = spark.createDataFrame([(k, i, bytes(n), "{}") for k, s in sizes.items() for i, n in enumerate(s)], "request int, ord long, content binary, report string")
    got = {}
    for r in responses.json_pages(done, most=100).collect():
        got.setdefault(r["request"], []).append((r["page"], [len(__import__("base64").b64decode(f["bytesBase64"])) for f in json.loads(r["body"])["files"]] if r["body"] else None))
    for k, s in sizes.items():
        pages, used = [[]], 0
        for n in (n for n in s if n <= 100):
            if used + n > 100:
                pages.append([])
                used = 0
            pages[-1].append(n)
            used += n
        want = [(i, p) for i, p in enumerate(pages) if p] + [(None, None)] * sum(n > 100 for n in s)
        assert sorted(got[k], key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(
    ("text", "problem"),
    [(None, None), ("", None), ("null", None), ("{}", None), ('{"icc":"remove","macros":false}', None), ("[1]", "objeto JSON"), ("{", "objeto JSON"), ('"x"', "objeto JSON"), ('{"icc":"maybe"}', '"icc" inválida'), ('{"macros":1}', '"macros" inválida'), ('{"changes":null}', '"changes" inválida'), ('{"zzz":1,"a":2}', "desconocidas: zzz, a")],
)
def test_options_are_checked(text, problem):
    options, wrong = responses.normal_options(text)
    assert (options is None) == (problem is not None) and (problem is None or problem in wrong)
    if options:
        assert set(json.loads(options)) == set(responses.DEFAULTS)


def test_files_with_options_of_their_own_in_one_job(spark):
    icc = jpeg((0xE2, b"ICC_PROFILE\0\1\1profile"), (0xFE, b"note"))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"/>')
        z.writestr("word/vbaProject.bin", "macro")
    macro = held.getvalue()
    rows = [(0, icc, None), (1, icc, '{"icc":"remove"}'), (2, icc, '{"icc":3}'), (3, macro, '{"macros":false}'), (4, macro, "{}"), (5, b"text", "{}")]
    got = {r["doc_id"]: r for r in responses.clean_each(spark.createDataFrame(rows, "doc_id long, content binary, options string")).collect()}
    assert b"profile" in bytes(got[0]["content"]) and b"profile" not in bytes(got[1]["content"])
    assert (got[2]["code"], got[2]["content"]) == (400, None) and "icc" in got[2]["error"]
    assert {i: "word/vbaProject.bin" in zipfile.ZipFile(io.BytesIO(bytes(got[i]["content"]))).namelist() for i in (3, 4)} == {3: True, 4: False}
    assert got[5]["code"] == 422 and all(got[i]["code"] is None for i in (0, 1, 3, 4)) and json.loads(got[1]["options"])["icc"] == "remove"


def test_batches_equal_a_fold(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.choice(["a.pdf", "b.TXT", "c.docx", "d", None, "e.jpeg"]), rng.choice([0, 1, 10, 40, None])) for k in range(20) for i in range(rng.randrange(12))]
    kept, refused = responses.batch(spark.createDataFrame(rows, "request int, ord int, name string, size long"), most_files=6, most_bytes=60)
    got = {(r["request"], r["ord"]): None for r in kept.collect()} | {(r["request"], r["ord"]): r["reason"] for r in refused.collect()}
    want = {}
    for k in range(20):
        total = 0
        for place, (_, i, name, size) in enumerate(r for r in rows if r[0] == k):
            if place >= 6:
                want[k, i] = "solo se procesan 6 archivos por lote"
            elif name not in ("a.pdf", "c.docx", "e.jpeg"):
                want[k, i] = "formato no admitido"
            else:
                total += size or 0
                want[k, i] = "se superó el límite por lote" if total > 60 else None
    assert got == want


def test_a_restart_neither_loses_nor_repeats_a_verdict(spark, tmp_path, monkeypatch):
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    scripted = make_pdf((1, b"<< /Type /Catalog /Pages 2 0 R /OpenAction << /S /JavaScript >> >>"), (2, b"<< /Type /Pages >>"))
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(scripted)
    real, failed = scans.products.scan, []

    def broken(files):
        failed.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(scans.products, "scan", broken)
    with pytest.raises(Exception, match="lost"):
        scans.scan_to(spark, folder, sink, checkpoint, most=1 << 20, per_batch=2).awaitTermination()
    monkeypatch.setattr(scans.products, "scan", real)
    scans.scan_to(spark, folder, sink, checkpoint, most=1 << 20, per_batch=2).awaitTermination()
    (tmp_path / "in" / "3.jpg").write_bytes(jpeg())
    (tmp_path / "in" / "large.jpg").write_bytes(jpeg() + bytes(2 << 20))
    for _ in range(2):
        scans.scan_to(spark, folder, sink, checkpoint, most=1 << 20, per_batch=2).awaitTermination()
    got = sorted((r["name"], r["riesgo"]) for r in scans.verdicts(spark, sink).collect())
    assert failed and got == [("0.pdf", "alto"), ("1.pdf", "alto"), ("2.pdf", "alto"), ("3.jpg", "bajo")]


def camera(loop=False):
    """IFD0 -> camera directory (serial number, interoperability) -> back to IFD0 where ``loop``; GPS in degrees."""
    entry = lambda tag, kind, n, v: struct.pack(">HHI", tag, kind, n) + v
    long = lambda n: struct.pack(">I", n)
    directory = lambda *e: struct.pack(">H", len(e)) + b"".join(e) + long(0)
    first = directory(entry(0x8769, 4, 1, long(38)), entry(0x8825, 4, 1, long(68)))
    second = directory(entry(0xA431, 2, 8, long(170)), entry(0xA005, 4, 1, long(8 if loop else 400)))
    gps = directory(entry(1, 2, 2, b"S\0\0\0"), entry(2, 5, 3, long(122)), entry(3, 2, 2, b"E\0\0\0"), entry(4, 5, 3, long(146)))
    place = b"".join(struct.pack(">II", a, b) for a, b in ((41, 1), (30, 1), (3600, 100), (2, 1), (15, 1), (0, 1)))
    return b"MM\0*" + long(8) + first + second + gps + place + b"SER-123\0"


@pytest.mark.parametrize("loop", [False, True])
def test_camera_directories_are_followed_once(spark, loop):
    x = image_source.parse_exif(camera(loop))
    assert [(f["dir"], f["value"]) for f in x["more"] if f["tag"] == 0xA431] == [("Exif", "SER-123")]
    assert x["latitude"] == pytest.approx(-41.51) and x["longitude"] == pytest.approx(2.25)
    picture = frame(spark, jpeg((0xE1, b"Exif\0\0" + camera(loop)))).withColumn("format", F.lit("jpeg"))
    told = images.directory_findings(images.exif_blocks(images.metadata_only(image_source.read_segments(picture)))).collect()
    assert {(r["label"], r["value"]) for r in told} == {("Número de serie del cuerpo", "SER-123"), ("Coordenadas en grados", "-41.510000, 2.250000")}


def test_places_that_are_no_numbers():
    assert image_source.degrees("1/0, 2/1, 3/1", "N", "S") is None and image_source.degrees(None, None, "S") is None and image_source.degrees("x", "N", "S") is None


def test_table_functions_inflate_only_what_is_wanted(spark):
    packages.register(spark)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<a><b c='1'>text</b></a>")
        z.writestr("word/bad.xml", "<a>")
        z.writestr("large.bin", bytes(packages.MOST_PACKAGE + 1))
    files = frame(spark, held.getvalue(), b"no package")
    rows = spark.sql("SELECT f.doc_id, p.name, p.error FROM {f} f, LATERAL package_parts(f.content, '^word/doc') p", f=files).collect()
    assert {(r["doc_id"], r["name"], r["error"] is None) for r in rows} == {(0, "word/document.xml", True), (1, None, False)}
    nodes = spark.sql("SELECT n.tag, n.text, n.attrs['c'] AS c, n.error FROM {f} f, LATERAL package_nodes(f.content, '[.]xml$') n WHERE f.doc_id = 0", f=files).collect()
    assert {(r["tag"], r["text"], r["c"]) for r in nodes if r["error"] is None} == {("a", "text", None), ("b", "text", "1")} and sum(r["error"] is not None for r in nodes) == 1
    assert {(r["doc_id"], r["name"]) for r in packages.list_packages(files).collect()} == {(0, "word/document.xml"), (0, "word/bad.xml"), (0, "large.bin"), (1, None)}
