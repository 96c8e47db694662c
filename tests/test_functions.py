import pytest
from pyspark.sql import functions as F

from lucerna.functions import money, names, sniff, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "safe"),
    [("../../evil.exe", "evil.exe"), ("a\\b\\c.docx", "c.docx"), (".hidden", "hidden"), ("", "archivo"), ("x/", "archivo"), ("a\x00b.txt", "ab.txt"), ("n" * 200 + ".docx", "n" * 140 + "nnnnn.docx")],
)
def test_safe_name(spark, raw, safe):
    assert one(spark, names.safe_name(F.lit(raw))) == safe


def test_output_name(spark):
    assert one(spark, names.output_name(F.lit("evil.exe"))) == "evil - sin metadatos.exe"
    assert one(spark, names.output_name(F.lit("sinpunto"))) == "sinpunto - sin metadatos"


def test_paths(spark):
    assert one(spark, names.resolve_path(F.lit("word/"), F.lit("../media/./a.png"))) == "media/a.png"
    assert one(spark, names.relations_owner(F.lit("word/_rels/document.xml.rels"))) == "word/"
    assert one(spark, names.relations_owner(F.lit("_rels/.rels"))) == ""


def test_packed_stamp(spark):
    assert one(spark, names.packed_stamp(F.lit(0), F.lit(0x0021))) == "1980-01-01 00:00:00"
    assert one(spark, names.packed_stamp(F.lit(0), F.lit(0))) == "1980-00-00 00:00:00"


@pytest.mark.parametrize(("raw", "units"), [("$0.02", 20000), ("1", 1000000), ("x", None), ("$1.2.3", None), ("0.0000019", 1)])
def test_money(spark, raw, units):
    got = one(spark, money.base_units(F.lit(raw), 6))
    assert (int(got) if got is not None else None) == units


def test_networks_and_numbers(spark):
    assert one(spark, money.network_family(F.lit("eip155:8453"))) == "evm"
    assert one(spark, money.network_family(F.lit("solana:abc"))) == "svm"
    assert one(spark, money.network_family(F.lit("otra:1"))) is None
    assert one(spark, money.positive_int(F.lit("0"))) is None
    assert one(spark, money.port(F.lit("65536"))) is None


@pytest.mark.parametrize(
    ("data", "kind"),
    [(b"%PDF-1.7 x", "pdf"), (b"x" * 1000 + b"%PDF-1", "pdf"), (b"x" * 1024 + b"%PDF-1", None), (b"\xff\xd8\xff", "image"), (b"PK\3\4", "office"), (b"II is a text", None), (b"II*\0", "image"), (b"", None)],
)
def test_kinds(spark, data, kind):
    assert one(spark, sniff.file_kind(F.lit(data))) == kind


def test_ole(spark):
    data = bytes.fromhex("D0CF11E0A1B11AE1") + "Workbook".encode("utf-16-le")
    assert one(spark, sniff.sniff_ole(F.lit(data))) == "xls"


def test_strict_text(spark):
    assert one(spark, text.strict_text(F.lit(b"\xff\xfe"))) is None
    assert one(spark, text.strict_text(F.lit("ñ".encode()))) == "ñ"
