"""Work and space of queries: what is read, sent and kept once."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest

from lucerna.operators import office, office_parts, pdf, pdf_check, raw_scan
from lucerna.operators.relations import reachable_each, shared_table
from lucerna.plans import package_queries, products, verification
from lucerna.sources import fixtures, packages, pdf_tokens
from lucerna.sources.shared import MANY_BYTES, SLICE_ROWS, in_slices, passing, sent_together, shared_dir, sliced_by_bytes


def documents(spark, n=12):
    return spark.createDataFrame([(i, f"text {i}", "es", f"source{i % 3}") for i in range(n)], "doc_id long, text string, lang string, source string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_look_through_nodes_once(spark):
    parts = shared_table(packages.inspect_packages(fixtures.office_files(documents(spark))), "parts")
    found = office._node_findings(packages.nodes_of(parts))
    assert "explode(nodes" not in plan(found)
    assert found.filter("label = 'Autores registrados'").count() == 4


def test_parts_of_small_packages_are_sent_together_and_large_ones_alone():
    small, large = packages.packed([("a.xml", b"<a/>"), ("b.xml", b"<b/>")]), packages.packed([("a.bin", bytes(packages.MANY_BYTES))])
    files = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "content": [small, small, large, small]})
    read = lambda doc, raw: [(doc, i, *e, None) for i, e in enumerate(packages.entries(raw))]
    sent = [b.column(0).to_pylist() for b in packages.joined_rows(iter([files]), read, packages._PART_TYPES, packages._PART_NAMES)]
    assert sent == [[1, 1, 2, 2, 3], [4, 4]]


def tables(spark):
    at = shared_dir(spark).removeprefix("file://") + "/lucerna"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_a_step_leaves_only_what_it_keeps(spark):
    before = tables(spark)
    with passing(spark) as outer:
        with passing(spark) as keep:
            kept = keep(shared_table(spark.range(5), "gone"), "inner")
            assert {x.split("-")[0] for x in tables(spark) - before} == {"gone", "inner"}
        assert {x.split("-")[0] for x in tables(spark) - before} == {"inner"}
        last = outer(kept.filter("id > 2"), "last")
    assert {x.split("-")[0] for x in tables(spark) - before} == {"last"}
    assert last.count() == 2


def test_verified_pairs_leave_no_contents_behind(spark):
    d = documents(spark, 6)
    files = fixtures.office_files(d).selectExpr("concat('f', doc_id, '.docx') AS name", "content")
    before = tables(spark)
    told = verification.verify_pairs(files, files)
    assert {x.split("-")[0] for x in tables(spark) - before} == {"verified"}
    assert {r.status for r in told.collect()} == {"no output"}


def test_cleaning_works_out_once_what_parts_are_made_of(spark):
    files = fixtures.office_files(documents(spark))
    assert plan(office.clean_parts(packages.read_packages(files), macros=True)).count("MapInArrow") == 3  # written, read, cleaned


def test_settled_copies_are_read_before_they_are_compared(spark, tmp_path):
    documents(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    told = package_queries.QUERIES["office_settled_violations"](spark, f"file://{tmp_path}")
    assert "MapInArrow" not in plan(told) and "digest(" not in plan(told)
    assert {(r.part, r.problem, r.which) for r in told.collect()} == {("word/document.xml", "text differs", "reject, checked as accept")}


def test_slices_end_by_rows_and_by_bytes():
    b = pa.RecordBatch.from_pydict({"data": [b"xx", b"xx", None, b"xxxxxxxx", b"x", b"x", b"x"]})
    assert [x.num_rows for x in sliced_by_bytes(iter([b]), 0, 3, 4)] == [3, 1, 3]
    assert [x.num_rows for x in sliced_by_bytes(iter([b]), 0, 2, 100)] == [2, 2, 2, 1]


def test_rows_of_small_files_share_a_batch_and_a_large_one_ends_it():
    files = [(10, [("a", 1), ("a", 2)]), (0, []), (10, [("b", 1)]), (MANY_BYTES, [("c", 1)]), (1, [("d", 1)])]
    sent = [b.to_pydict() for b in sent_together(iter(files), [pa.string(), pa.int64()], ["name", "n"])]
    assert sent == [{"name": ["a", "a", "b", "c"], "n": [1, 2, 1, 1]}, {"name": ["d"], "n": [1]}]


def test_nodes_of_name_trees_are_read_before_trees_are_walked(spark):
    objects = [(1, "<< /Names 2 0 R >>"), (2, "<< /EmbeddedFiles << /K#69ds [3 0 R] >> /JavaScript 4 0 R >>"), (3, "<< /N#61mes [(f) 9 0 R] >>"), (4, "<< /Names [(j) 8 0 R] >>")]
    objects = spark.createDataFrame([(7, n, d) for n, d in objects], "doc_id long, num long, dict string")
    roots = spark.createDataFrame([(7, 1)], "doc_id long, root long")
    found = pdf.trees_names(objects, roots, ["JavaScript", "EmbeddedFiles"])
    assert plan(found).count("read(") == 0
    assert {tuple(r) for r in found.collect()} == {(7, "EmbeddedFiles", "f", 9), (7, "JavaScript", "j", 8)}


def test_only_what_a_deep_cleaning_may_cut_is_read_and_only_once(spark):
    objects = [(1, "<< /Type /Catalog /Info 3 0 R /Pages 2 0 R >>"), (2, "<< /Kids [4 0 R] >>"), (3, "<< /Author (x) >>"), (4, "<< /#41A 5 0 R /A << /S /JavaScript /J#53 (x) >> >>")]
    objects = spark.createDataFrame([(7, n, d, 1, []) for n, d in objects], "doc_id long, num long, dict string, root long, refs array<long>")
    roots = spark.createDataFrame([(7, 1)], "doc_id long, root long")
    left = pdf.without_entries(objects, roots, ["Info"], deep=True)
    assert "Generate" not in plan(left)
    assert {r.num: r.dict.replace(" ", "") for r in left.collect()} == {1: "<</Type/Catalog/Pages20R>>", 2: "<</Kids[40R]>>", 3: "<</Author(x)>>", 4: "<<>>"}


def test_objects_of_both_kinds_are_chosen_before_they_are_put_together(spark):
    objects, trailers = pdf.read(fixtures.chained_pdf_files(documents(spark)))
    assert not any(x in plan(objects) for x in ("max_by", "run(", "Generate")) and "run(" not in plan(trailers)
    assert objects.filter("num = 3 AND dict LIKE '%/New%'").count() == 12 and objects.count() == 84


def test_a_value_is_read_once_however_often_it_is_asked_for(monkeypatch):
    searched = []

    class Lex:
        def search(self, t, at):
            searched.append(t)
            return lex.search(t, at)

    lex = pdf_tokens._LEX
    monkeypatch.setattr(pdf_tokens, "_LEX", Lex())
    value = "<< /Once (a test's own) /Length 5 >>"
    first = pdf_tokens.structure(value), pdf_tokens.own(value)
    n = len(searched)
    assert n and (pdf_tokens.structure(value), pdf_tokens.own(value)) == first and len(searched) == n


def test_strings_are_one_token_with_brackets_inside_and_without():
    for text in ("(plain)", r"(a\) 1 0 R)", "(in (side) 2 0 R)", r"(\()", "(a\\\n(b))"):
        assert pdf_tokens.structure(f"<< /K {text} /L 7 0 R >>") == ([(1, "K", 3, 6, 6 + len(text)), (1, "L", 7 + len(text), 10 + len(text), 15 + len(text))], [7])
    assert pdf_tokens.own("<< /K (open /L 7 0 R >>") == {"K": "(open /L 7 0 R >>"}


def test_arrow_functions_hold_slices_not_batches(spark):
    sizes = in_slices(lambda x: pa.array([len(x)] * len(x), pa.int64()), "long")
    rows = spark.range(0, 3 * SLICE_ROWS + 7, numPartitions=1)
    assert rows.select(sizes("id").alias("n")).groupBy("n").count().orderBy("n").collect() == [(7, 7), (SLICE_ROWS, 3 * SLICE_ROWS)]
    long = in_slices(lambda x, y: pa.array([len(x)] * len(y), pa.int64()), "long")
    texts = rows.selectExpr("repeat('x', 1 << 19) AS t", "id").limit(4)
    assert [r.n for r in texts.select(long("t", "id").alias("n")).collect()] == [2, 2, 2, 2]


def test_graphs_of_several_slices_are_walked_each(spark):
    n = SLICE_ROWS * 2 + 5
    graphs = spark.range(0, n, numPartitions=1)
    edges = graphs.selectExpr("id AS k", "explode(array(id, id + 1)) AS src").selectExpr("k", "src", "src + 1 AS dst")
    found = reachable_each(edges.coalesce(1), graphs.selectExpr("id AS k", "id AS node").coalesce(1), ["k"])
    assert {tuple(r) for r in found.collect()} == {(k, k + i) for k in range(n) for i in range(3)}


def test_files_are_scanned_for_marks_once(spark, tmp_path):
    documents(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    told = package_queries.QUERIES["raw_marks"](spark, f"file://{tmp_path}")
    assert plan(told).count("MapInArrow") == 2  # parts of packages, segments of pictures
    assert told.count() == 48


def test_pictures_are_not_sent_with_their_marks(spark):
    files = shared_table(fixtures.image_files(documents(spark)), "pictures").selectExpr("doc_id", "concat('a.', element_at(array('jpg', 'png', 'webp'), int(doc_id % 3) + 1)) AS name", "content")
    lines = plan(raw_scan.raw_marks(files)).splitlines()
    at = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x)
    left = lines[at + 1]
    assert "Project" in left and "seen#" in left and "content#" not in left.split(" AS seen#")[1]


def test_checks_and_cleaning_of_pdf_files_send_no_table_through_the_driver(spark):
    files = shared_table(fixtures.pdf_tree_files(documents(spark)), "trees")
    objects, trailers = (shared_table(x, "known") for x in pdf.read(files))
    cleaned = pdf.clean_pdf(files, known=(objects, trailers))
    told = pdf_check.pdf_violations(pdf_check.stream_digests(objects), cleaned.select("doc_id", "content"))
    for df in (cleaned, told):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert told.count() == 0 and cleaned.filter("content IS NOT NULL").count() == 12


def test_a_missing_object_is_told_as_often_as_it_is_referred_to(spark):
    body = b"%PDF-1.4\n%x\n"
    held = [b"1 0 obj\n<< /Type /Catalog /A 2 0 R /B 9 0 R >>\nendobj\n", b"2 0 obj\n<< /C 9 0 R /D 8 0 R >>\nendobj\n", b"3 0 obj\n<< >>\nendobj\n"]
    at = [len(body) + sum(map(len, held[:k])) for k in range(4)]
    raw = body + b"".join(held) + b"xref\n0 4\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % x for x in at[:3]) + b"trailer\n<< /Size 4 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % at[3]
    streams = spark.createDataFrame([(7, 2, "00")], "doc_id long, num long, sha string")
    told = pdf_check.pdf_violations(streams, spark.createDataFrame([(7, raw)], "doc_id long, content binary"))
    assert sorted(r.problem for r in told.collect()) == [
        "no stream in object 2", "reached by nothing: object 3", "reference to a missing object: 8", "reference to a missing object: 9", "reference to a missing object: 9",
    ]


def test_packages_are_written_as_zipfile_writes_them_and_listed_as_it_lists_them(monkeypatch):
    for parts in ([], [("a.xml", b""), ("d/", b""), ("d/x.bin", bytes(range(256)) * 300)], [("ñ.xml", b"<a/>"), ("b.xml", b"<b/>")]):
        raw = packages.packed(parts)
        assert raw == packages._packed_by_zipfile(parts)
        plain = packages._directory(raw)
        assert (plain is None) == any(not x.isascii() for x, _ in parts)
        found = packages.entries(raw)
        with monkeypatch.context() as m:
            m.setattr(packages, "_directory", lambda content: None)
            assert packages.entries(raw) == found
        assert [(x[0], x[1]) for x in found] == parts
    assert packages._directory(packages.packed([("a", b"1")]) + b"more") is None


def test_files_are_made_from_their_rows_without_a_shuffle(spark):
    made = fixtures.office_files(documents(spark))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.name) for r in packages.read_packages(made).collect()) == sorted((r.doc_id, r.name) for r in fixtures.office_parts(documents(spark)).collect())


def test_parts_that_nothing_concerns_stay_without_a_walk(monkeypatch):
    monkeypatch.setattr(office_parts, "elements", lambda data: 1 / 0)
    options = office.checked({})
    rels = b'<Relationships xmlns="u"><Relationship Target="word/document.xml"/></Relationships>'
    assert office_parts.rewrite("_rels/.rels", rels, {"docProps/thumbnail.jpeg"}, options) == (rels, {})
    touched = [
        ("_rels/.rels", rels, {"word/document.xml"}), ("xl/workbook.xml", b'<a rsidR="1"/>', set()), ("word/document.xml", b"<a/>", set()), ("a.xml", b"<x:a/>", set()),
        ("_rels/.rels", rels.replace(b"word", b"w&#111;rd"), {"docProps/custom.xml"}), ("a.xml", "<a/>".encode("utf-16"), set()), ("a.xml", b"<!DOCTYPE a><a/>", set()),
    ]
    for name, data, gone in touched:
        with pytest.raises(ZeroDivisionError):
            office_parts.rewrite(name, data, gone, options)


def test_cleaning_alone_reads_parts_without_their_nodes(spark):
    broken = packages.packed([("word/document.xml", b"<a>")])
    files = fixtures.office_files(documents(spark, 3)).unionByName(spark.createDataFrame([(9, broken)], "doc_id long, content binary"))
    seen = products.Inspected(files, told=False)
    assert seen.parts.filter("nodes IS NOT NULL").count() == 0
    assert {(r.doc_id, r.error) for r in seen.status().collect()} == {(r.doc_id, r.error) for r in products.Inspected(files).status().collect()}


def test_contents_take_no_part_in_the_last_join_of_pairs(spark):
    files = fixtures.office_files(documents(spark, 6)).selectExpr("concat('f', doc_id, '.docx') AS name", "content")
    pairs = shared_table(verification.paired(files, files.selectExpr("replace(name, '.docx', ' - sin metadatos.docx') AS name", "content")), "pairs")
    plans = []
    verification.verify(pairs, lambda df, label: plans.append(plan(df)) or shared_table(df, label))
    lines = plans[-1].splitlines()
    join = next(x for x in lines if "Join LeftOuter" in x)
    assert "copy#" not in "\n".join(x for x in lines[: lines.index(join) + 1])
