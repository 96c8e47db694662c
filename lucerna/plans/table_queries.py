"""Queries over the supplied tables: findings, verdicts, redaction, and the relational shapes of packages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import config, money, names, sniff, text
from lucerna.operators import relations, secrets, summaries, verdict
from lucerna.sources.shared import shared_dir
from lucerna.streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_signals(secrets.secret_hits(table(spark, sf_dir, "documents")))


@query
def file_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size and digest of every document."""
    d = table(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("long")
    return d.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), size.alias("bytes"), names.human_size(size).alias("shown"), text.digest(F.col("text")).alias("sha256"))


@query
def secret_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = secrets.secret_hits(table(spark, sf_dir, "documents"))
    return h.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "rule", F.col("nth").cast("long").alias("nth"), "masked")


@query
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


@query
def secret_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.verdicts(table(spark, sf_dir, "documents"), _signals(spark, sf_dir))


@query
def verdict_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.with_recommendation(secret_verdict(spark, sf_dir)).select("doc_id", "riesgo", "recomendacion")


@query
def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, bytes and verdicts by source and over all sources."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"))
    joined = d.join(secret_verdict(spark, sf_dir), "doc_id")
    return joined.rollup("source").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.count_if(F.col("riesgo") == "alto").alias("high"), F.max("puntuacion").cast("long").alias("most"))


@query
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", secrets.redact(F.col("text")).alias("text"))


@query
def redact_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a credential survives redaction: none."""
    return secrets.residue(table(spark, sf_dir, "documents"))


@query
def personal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.personal_findings(table(spark, sf_dir, "documents"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of findings from texts: credentials by rule, and personal data."""
    found = _signals(spark, sf_dir).select("doc_id", F.lit("credenciales").alias("grp"), F.col("rule").alias("label"), F.lit("media").alias("sev"), F.lit(False).alias("keep"))
    own = secrets.personal_findings(table(spark, sf_dir, "documents")).select("doc_id", F.lit("personales").alias("grp"), "label", F.lit("personal").alias("sev"), F.lit(True).alias("keep"))
    return found.unionByName(own)


@query
def findings_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.by_group(_findings(spark, sf_dir))


@query
def personal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: documents, those with personal data, and their share in hundredths."""
    own = secrets.personal_findings(table(spark, sf_dir, "documents")).select("doc_id").distinct().withColumn("personal", F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(own, "doc_id", "left")
    out = d.groupBy("source").agg(F.count("*").alias("documents"), F.count("personal").alias("personal"))
    return out.withColumn("hundredths", F.floor(F.col("personal") * 10000 / F.col("documents")).cast("long"))


@query
def pending_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.pending(_findings(spark, sf_dir))


@query
def page_meta_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language and character set of each page, wherever they stand in it."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", '<meta charset="([^"]*)"', 1).alias("charset"))


@query
def page_active_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active content of pages and their verdicts."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_count("html", F.lit("<script")).cast("long").alias("scripts"), F.regexp_count("html", F.lit("<iframe")).cast("long").alias("frames"), F.regexp_count("html", F.lit('href="/')).cast("long").alias("links"))
    points = F.least(F.lit(100), F.when(F.col("scripts") > 0, 40).otherwise(0) + F.when(F.col("frames") > 0, 15).otherwise(0) + F.when(F.col("links") > 0, 5).otherwise(0))
    return p.select("doc_id", "scripts", "frames", "links", points.cast("long").alias("puntuacion"), verdict.verdict_of(points).alias("riesgo"))


@query
def page_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag occurs over all pages, and in how many pages."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    per = tags.groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    return per.groupBy("tag").agg(F.sum("n").alias("total"), F.count("*").alias("pages"))


@query
def page_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.digest(text.escape_markup(F.col("html"))).alias("escaped_sha256"))


@query
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.safe_name(F.col("url")).alias("name"))


@query
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(names.safe_name(F.col("url")), F.lit(".html"))
    return table(spark, sf_dir, "pages").select("page_id", names.output_name(made).alias("output_name"))


@query
def dup_name_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit(".docx")).alias("name"))
    return relations.number_names(p, "name", "p_partkey")


@query
def packed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed date and time values made from keys, as text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 65536).cast("int").alias("time"), ((F.col("o_orderkey") * 7) % 65536).cast("int").alias("date"))
    return o.select("o_orderkey", names.packed_stamp(F.col("time"), F.col("date")).alias("stamp"))


@query
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type: the newest offset wins."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return relations.latest(e, ["user_id", "event_type"], ["ts", "event_id"])


@query
def first_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest order as seen through a chain of sections, newest first, then gaps filled from customers without any."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), (-F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("rank"))
    newest = relations.first_wins(o, ["key"], ["rank", "value"]).select("key", "value", F.lit("section").alias("origin"))
    scan = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("value"), F.lit("scan").alias("origin"))
    return relations.gap_fill(newest, scan, ["key"])


@query
def span_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's span up to the user's next one, in event numbers."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return relations.span_ends(e, ["user_id"], "event_id", F.lit(-1).cast("long"))


@query
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, by id, of which no conversation speaks; and orders of unknown customers."""
    a = relations.dangling(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "conversations"), {"doc_id": "conv_id"})
    b = relations.dangling(table(spark, sf_dir, "lineitem").select("l_orderkey").distinct(), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), {"l_orderkey": "o_orderkey"})
    return a.select(F.lit("label").alias("origin"), F.col("doc_id").alias("ref")).unionByName(b.select(F.lit("lineitem").alias("origin"), F.col("l_orderkey").alias("ref")))


@query
def package_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What redaction and the loss of labelled documents do to the corpus: removed, added, changed."""
    d = table(spark, sf_dir, "documents")
    after = d.select("doc_id", text.digest(secrets.redact(F.col("text"))).alias("sha")).join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return relations.package_diff(d.select("doc_id", text.digest(F.col("text")).alias("sha")), after, ["doc_id"], "sha")


@query
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup with fallback to the raw key: labels for event types, as for tags and fields."""
    known = {"click": "Clic", "view": "Vista", "purchase": "Compra"}
    dim = spark.createDataFrame(list(known.items()), "event_type string, label string")
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.join(F.broadcast(dim), "event_type", "left").select("event_type", F.coalesce("label", "event_type").alias("label"), "n")


@query
def network_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that customers use but that have no supplier: a left join with a null check."""
    used = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    offered = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return used.join(offered, "nation", "left").select("nation", "customers", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.col("suppliers").isNotNull().alias("ok"))


@query
def paired_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals matched with outputs by a name derived from theirs; a missing output is told."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), text.digest(F.col("text")).alias("sha_in"))
    kept = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select(names.output_name(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("output"), text.digest(secrets.redact(F.col("text"))).alias("sha_out"))
    return d.withColumn("output", names.output_name(F.col("name"))).join(kept, "output", "left").select("doc_id", "name", F.when(F.col("sha_out").isNull(), "missing").when(F.col("sha_out") == F.col("sha_in"), "same").otherwise("changed").alias("state"))


@query
def date_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    return summaries.date_span(e, ["event_type"], "stamp")


@query
def stamp_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"))
    return summaries.stamp_preview(o, ["o_custkey"], "stamp")


@query
def conversation_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct roles of each conversation in order of appearance."""
    return summaries.people(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


@query
def running_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of twelve documents each under limits on files, bytes of a file and bytes of a request."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 12).cast("long").alias("request"), F.octet_length("text").cast("long").alias("bytes"))
    return relations.running_limits(d, "request", "doc_id", "bytes", most_files=10, most_bytes=20_000, most_request=40_000).select("doc_id", "request", "bytes", "accepted", "reason")


@query
def base64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads in JSON: refused by the length of their base64 alone, else decoded and read as strict UTF-8."""
    # Spark breaks base64 into lines; those are no part of what an upload may hold.
    coded = F.translate(F.base64(F.col("text").cast("binary")), "\r\n", "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(coded.alias("bytesBase64"))).alias("body"))
    d = d.select("doc_id", F.from_json("body", "bytesBase64 string")["bytesBase64"].alias("b"))
    fits = text.base64_fits(F.col("b"), 15_000)
    return d.select("doc_id", fits.alias("fits"), text.digest(F.when(fits, text.strict_text(F.unbase64("b")))).alias("sha256"))


@query
def price_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", money.price(shown).alias("price"), money.base_units(shown, 6).cast("long").alias("units"))


@query
def config_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked numbers and network families from keys written as text."""
    c = table(spark, sf_dir, "customer").withColumn("raw", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise((F.col("c_custkey") * 97).cast("string")))
    network = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("eip155:"), F.col("raw"))).otherwise(F.concat(F.lit("solana:"), F.col("raw")))
    return c.select("c_custkey", F.coalesce(money.positive_int(F.col("raw")), F.lit(-1)).cast("long").alias("n"), F.coalesce(money.port(F.col("raw")), F.lit(-1)).cast("long").alias("port"), F.coalesce(money.network_family(network), F.lit("none")).alias("family"))


@query
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(ledger.from_events(table(spark, sf_dir, "events")))


@query
def ledger_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: settled amounts in six-hour windows (the stream's query on a batch)."""
    return ledger.windowed(ledger.from_events(table(spark, sf_dir, "events"))).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def ledger_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of each payer, closed by half an hour without a line."""
    return ledger.sessions(ledger.from_events(table(spark, sf_dir, "events"))).withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


@query
def stats_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus totals of per-document counters, kept as a map."""
    d = table(spark, sf_dir, "documents")
    counters = F.create_map(*(x for k, p in (*secrets.PERSONAL, ("generic", secrets.RULES[-1].pattern)) for x in (F.lit(k), F.regexp_count("text", F.lit(p)).cast("long"))))
    return summaries.roll_up(d.select("doc_id", F.map_filter(counters, lambda k, v: v > 0).alias("stats")), "stats")


@query
def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct notes of each document, from its counters."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    listed = summaries.notes({"correos": n(secrets.PERSONAL[0][1]), "direcciones": n(secrets.PERSONAL[1][1]), "credenciales": n(secrets.ANY)})
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(listed, "; ").alias("notes"))


@query
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects reachable from a root over references, with a cycle: regions, nations and customers as objects."""
    region = table(spark, sf_dir, "region").select(F.lit("root").alias("src"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("dst")).filter("dst <> 'r0'")
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst"))
    parent = nation.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = region.unionByName(nation).unionByName(customer).unionByName(parent).withColumn("doc_id", F.lit(0))
    roots = spark.createDataFrame([(0, "root")], "doc_id int, node string")
    return relations.reachable(edges, roots, ["doc_id"]).select("node")


@query
def product_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product lists made of market segments: known names in canonical order, unknown ones told."""
    c = table(spark, sf_dir, "customer")
    listed = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("secrets, ")).otherwise(""), F.when(F.col("c_custkey") % 3 == 0, F.lit("Clean,")).otherwise(""), F.when(F.col("c_custkey") % 5 == 0, F.lit("other")).otherwise(""))
    return c.select("c_custkey", F.array_join(config.routes(listed), " ").alias("routes"), F.array_join(config.unknown(listed), " ").alias("unknown"))


@query
def kinds_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds told by extensions alone."""
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, ("docx", "PDF", "jpeg", "xls", "bin"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", F.coalesce(sniff.kind_by_name(F.concat(F.lit("a.b."), ext)), F.lit("none")).alias("kind"))


@query
def config_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks without repeats, prices of the products that are served, decimals and ledger paths, from lists made of customers."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    listed = F.concat(F.lit("eip155:"), (k % 3).cast("string"), F.lit(" , eip155:"), (k % 2).cast("string"), F.lit(",,eip155:"), (k % 3).cast("string"))
    active = config.products(F.when(k % 2 == 0, "secrets,scan").when(k % 3 == 0, "clean").otherwise(""))
    told = config.prices(active, {p: F.concat(F.lit("$"), (k % 10 + n).cast("string")) for n, p in enumerate(config.PRODUCTS)})
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(told)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    digits = F.when(k % 4 == 0, "").otherwise((k % 25).cast("string"))
    path = F.when(k % 3 == 0, " off ").when(k % 3 == 1, "").otherwise(F.concat(F.lit("/l/"), k.cast("string")))
    return c.select("c_custkey", F.array_join(config.networks(listed), " ").alias("networks"), shown.alias("prices"), F.coalesce(config.decimals(digits), F.lit(-1)).alias("decimals"), F.coalesce(config.ledger_path(path), F.lit("")).alias("ledger"))


@query
def ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines appended to a folder in two parts, after a check that it can be written, and read again."""
    lines = ledger.from_events(table(spark, sf_dir, "events"))
    path = f"{shared_dir(spark)}/lucerna/ledger-{uuid.uuid4().hex}"
    ledger.check_writable(spark, path)
    for settled in (True, False):
        ledger.append(lines.filter((F.col("resultado") == ledger.SETTLED) == settled), path)
    return ledger.totals(ledger.read_lines(spark, path))
