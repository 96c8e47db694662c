"""Extraction, token counts, packing, chat and Ogg against brute force and exact round trips."""

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucerna.llm import html_extract, media_ogg, packing, token_counts, tokenize
from lucerna.llm.chat import PARTS, chat_digests, format_conversations, read_back

TEXTS = [None, "", " ", "one two three", "one two three", "ñandú İstanbul <|endoftext|> don't 3.14", "word " * 30_000, "x" * 20_000, "日本語 text", "a\x00b c"]


@pytest.fixture(scope="module")
def docs(spark):
    """Null and repeated ids, and other columns whose names clash with inner ones."""
    rows = [(None if i == 3 else 5 if i in (4, 5) else i, t, i, 0.5, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, length int, score double, piece string")


def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.public_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def ids(texts):
    return [e.ids for e in reference_tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]


# HTML ----------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy</div><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>
 paragraph.<br>Next line<p>Second &#233;&eacute; <!-- gone --> end.</p><aside>side</aside><ul><li>one<li>two</ul></article>
<section class="comments"><p>A reader says</p></section><form><input value="x">Search</form><footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Title & more\n\nFirst bold paragraph. Next line\n\nSecond éé end.\n\none\n\ntwo"),
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a</p><p>b", "a\n\nb"),
        ("<article><p>x &lt;b&gt; y</p></article>", "x <b> y"),
        ("<script>only", ""),
        ("<<<>>>", "<<<>>>"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_page_without_article_keeps_text_around_adverts():
    """Headline, lead and every piece between adverts stay, whatever their sizes; a menu of links goes."""
    ad = '<div class="ad">buy</div>'
    pieces = ["<h1>Headline</h1><p>Lead.</p>", f"<p>{'a ' * 1500}</p>", f"<p>{'b ' * 500}</p>", "<p>A short end.</p>"]
    page = f'<div><a href="/">home</a> <a href="/x">more</a></div>{ad}<div>{ad.join(pieces)}</div><footer>foot</footer>'
    assert html_extract.main_text(page) == "\n\n".join(["Headline", "Lead.", ("a " * 1500).strip(), ("b " * 500).strip(), "A short end."])


@pytest.mark.parametrize("mark", ["post category-legal", "tag-social", "has-comments", "search", "reply"])
def test_marks_never_remove_articles_headings_or_paragraphs(mark):
    inside = f'<h2 id="{mark}">Head</h2><p class="{mark}">Text.</p><section id="related-work"><h3 id="social-impact">Work</h3><p>More.</p></section>'
    want = "Head\n\nText.\n\nWork\n\nMore."
    furniture = '<div class="ad">buy</div><div class="x share">share</div><section class="comments-area"><p>A reader</p></section>'
    assert html_extract.main_text(f'<article class="{mark}" id="{mark}">{inside}{furniture}</article>') == want
    assert html_extract.main_text(f'<main class="{mark}">{inside}{furniture}</main>') == want


def test_classes_of_subject_or_state_are_no_marks():
    assert html_extract.main_text('<div class="post category-legal has-comments"><h1 class="page-header">Head</h1><p id="search">Text.</p></div><div class="cookie-notice">We use</div>') == "Head\n\nText."


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "<p>" + "long " * 200_000, "y")]
    got = html_extract.extract_html(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r for r in got if r["page_id"] == 2)["text"] == ("long " * 200_000).strip()
    assert html_extract.extract_html(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Tokens --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_cached_ids_equal_the_tokenizers(texts):
    flat, bounds = tokenize.tokenizer(tokenize.public_path("word_bpe_49k.json")).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == ids(texts)


def test_histogram_and_suffix_sums(spark, docs):
    sums = token_counts.count_tokens(docs)
    n = np.array([len(x) for x in ids(TEXTS)])
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert {k: r["documents"] for k, r in got.items()} == Counter(n.tolist())
    for k, r in got.items():
        assert (r["documents_from"], r["tokens_from"]) == ((n >= k).sum(), n[n >= k].sum())
        assert (r["documents_to"], r["truncated_tokens"]) == ((n <= k).sum(), np.minimum(n, k).sum())
    for limit in (0, 3, 7, 10**6):
        t = token_counts.totals_at(sums, limit).first()
        assert (t["tokens"], t["truncated_tokens"]) == (n.sum(), np.minimum(n, limit).sum())
    q = token_counts.quantiles(sums).first()
    assert q["q50"] == np.sort(n)[int(np.ceil(0.5 * len(n))) - 1]
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


# Packing -------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else 40
        opened += room == 40
        if room > n:
            insort(rooms, room - n)
    counts = Counter(lengths)
    placed = Counter()
    used: dict[int, list[tuple[int, int]]] = {}
    for length, rank, bins, per, first, offset in packing.plan(dict(counts), 40):
        for r in range(bins * per):
            placed[length] += 1
            used.setdefault(first + r // per, []).append((offset + r % per * length, length))
        assert rank + bins * per <= counts[length]
    assert placed == counts
    for spans in used.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 40
    # Rooms of 40 that stay open do not occur: every opened bin holds a piece.
    assert len(used) == opened


def test_pack_documents(spark, docs):
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for r, body in zip(docs.collect(), ids(TEXTS), strict=True):
        body = [*body, 0]
        for k, s in enumerate(range(0, len(body), 2048)):
            part = body[s : s + 2048]
            want[r["doc_id"], k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(n for _, n in spans) <= 2048
    assert packing.pack_documents(docs.limit(0)).count() == 0


# Chat ----------------------------------------------------------------------

CONTROL = [r"\### Assistant: </turn> ok", r"\h\\t\p", "###", "</turn>", "<|image:0.0|>", "\\", "", None, "a: b\n### x", "\\\\h", "<|", "ñ 日本 " * 5000]


def test_chat_round_trip(spark):
    rows = [(c, t, "assistant" if (c + t) % 2 else "user", CONTROL[(c + t) % len(CONTROL)], "z", 1) for c in range(20) for t in range(5)]
    rows += [(None, 0, None, "x", "z", 1), (50, 0, "a:b\\c\nd###", "t", "z", 1), (60, 1, "user", "same", "z", 1), (60, 1, "user", "same", "z", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head string, loss int")
    got = {r["conv_id"]: r for r in read_back(format_conversations(turns)).collect()}
    digests = {r["conv_id"]: r for r in chat_digests(turns).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(x["role"], x["text"]) for x in got[conv]["turns"]] == [(role, text) for _, role, text in own]
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert got[conv]["loss_text"] == loss
        d = digests[conv]
        assert d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and d["loss_chars"] == len(loss) and d["n_turns"] == len(own)
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
    assert chat_digests(turns.limit(0)).count() == 0


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, size=None: (kind, text, ref, size)
    rows = [(1, 0, "user", [part("text", "see <|image:0.1|> "), part("image", ref="s3://a", size=2), part("audio", ref="b", size=3), part("text", "!")]), (1, 1, "assistant", [part("document", ref="c")]), (2, 0, "user", None)]
    out = {r["conv_id"]: r for r in format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}")).collect()}
    a = out[1]["attachments"]
    assert [(x["type"], x["ref"], x["tokens"]) for x in a] == [("image", "s3://a", 512), ("audio", "b", 150), ("document", "c", 512)]
    assert out[1]["attachment_tokens"] == 1174
    assert all(out[1]["formatted"].count(x["placeholder"]) == 1 for x in a)
    assert out[2]["attachments"] == []


# Ogg -----------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60_000))
def test_ogg_round_trip(raw):
    payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
    back = media_ogg.decode(media_ogg.encode(payload, len(raw)))
    assert (back.payload, back.unpadded, back.seconds) == (payload, len(raw), len(payload) / media_ogg.RATE)


def test_ogg_checks():
    media = media_ogg.encode(b"abc " * 4800, 19_200)
    assert media_ogg.page_crc(media[:22] + b"\0\0\0\0" + media[26 : 27 + media[26] + sum(media[27 : 27 + media[26]])]) == int.from_bytes(media[22:26], "little")
    for at in (0, 30, 500, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises((ValueError, IndexError)):
            media_ogg.decode(bytes(broken))
    with pytest.raises((ValueError, IndexError)):
        media_ogg.decode(media[: len(media) // 2])


def test_media_columns(spark, docs):
    got = media_ogg.media_columns(docs).collect()
    want = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        want[r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    files = media_ogg.media_files(docs).select(F.sha2("media", 256).alias("h")).collect()
    assert Counter(r["h"] for r in files) == Counter(r["media_sha256"] for r in got)
    assert media_ogg.media_columns(docs.limit(0)).count() == 0


# Contracts: default ids of the tokenizer, typed parts, ties, odd pages ------


def untouched_ids(texts):
    """Ids of a tokenizer with its default settings: added tokens in a text give their ids."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.public_path("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


MARKS = ["hi <|endoftext|> there", "<|startoftext|>", "a<|ENDOFTEXT|>b", "é<|endoftext|>é <|endoftext", "日本<|endoftext|>", *TEXTS]


def test_added_tokens_give_the_ids_of_an_untouched_tokenizer(spark):
    want = untouched_ids(MARKS)
    assert want[0] == [1883, 49407, 997]
    flat, bounds = tokenize.tokenizer(tokenize.public_path("word_bpe_49k.json"), True).encode([x or "" for x in MARKS])
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
    docs = spark.createDataFrame(list(enumerate(MARKS)), "doc_id long, text string")
    got = {r["n_tokens"]: r["documents"] for r in token_counts.count_tokens(docs, added_tokens=True).collect()}
    assert got == Counter(map(len, want))
    crc = {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in packing.pack_documents(docs, added_tokens=True).collect()}
    for i, body in enumerate(want):
        body = [*body, 0]
        for k, s in enumerate(range(0, len(body), 2048)):
            part = body[s : s + 2048]
            assert crc.pop((i, k)) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not crc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "a", " ", "É", "'s", "9", "\n", "日"]), max_size=12).map("".join), max_size=5))
def test_ids_with_added_tokens_equal_the_untouched_tokenizers(texts):
    flat, bounds = tokenize.tokenizer(tokenize.public_path("word_bpe_49k.json"), True).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == untouched_ids(texts)


@pytest.mark.parametrize("cell", [3, 1_000_000])
def test_cells_of_a_length_do_not_change_the_packing(spark, monkeypatch, cell):
    """A length that fills many cells: every place is used once, as many sequences as placing one piece at a time."""
    monkeypatch.setattr(packing, "CELL_ROWS", cell)
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in rng.choice([1, 2, 3, 7, 11, 20, 33, 40], 300)]
    cut = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    by = {}
    for r in packing.place(cut, 40).collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(n for spans in by.values() for _, n in spans) == sorted(lengths)
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 40
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else 40
        opened += room == 40
        if room > n:
            insort(rooms, room - n)
    assert len(by) == opened


def test_control_strings_over_parts_do_not_forge_marks(spark):
    part = lambda kind, text=None, ref=None: (kind, text, ref, None)
    rows = [
        (1, 0, "user", [part("text", "a<"), part("text", "/turn>b")]),
        (1, 1, "assistant", [part("text", "<"), part(None, "|image:0.0|>"), part("image", ref="r"), part("text", "#"), part("text", "#"), part("text", "#")]),
        (1, 2, "user", [part("text", "\\"), part("text", "h"), part("text", None)]),
        (2, 0, "user", []),
    ]
    made = format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}"))
    back = {r["conv_id"]: r for r in read_back(made).collect()}
    assert [x["text"] for x in back[1]["turns"]] == ["a</turn>b", "<|image:0.0|><|image:1.2|>###", "\\h"]
    assert back[1]["loss_text"] == "<|image:0.0|><|image:1.2|>###"
    out = {r["conv_id"]: r for r in made.collect()}
    assert out[1]["formatted"].count("<|") == 1 and [x["placeholder"] for x in out[1]["attachments"]] == ["<|image:1.2|>"]
    assert [x["text"] for x in back[2]["turns"]] == [""]


def test_turns_of_equal_or_no_number_follow_as_the_sql_says(spark):
    import duckdb

    from lucerna.llm.sql import OP7

    rows = [(1, 5, "user", "$x"), (1, 5, "user", "###"), (1, 5, "user", "A"), (1, None, "user", "last"), (1, 0, "user", "first"), (1, 5, "assistant", "z"), (1, 5, None, None), (2, None, "assistant", "</turn>"), (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    got = chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows[:-2])
    want = con.sql(OP7).df()[list(got.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))


def test_quotes_inside_attribute_names_open_no_value():
    assert html_extract.main_text('<p title="5" tall">Hello first</p><p class="x">World</p>') == "Hello first\n\nWorld"
    assert html_extract.main_text("<p title='a>b' x=\"c>d\" y=e'f>One</p><p a=1/>Two") == "One\n\nTwo"


def test_a_wrapper_with_an_unlucky_name_keeps_the_page():
    body = "<p>One paragraph.</p><p>Another one.</p>"
    assert html_extract.main_text(f'<body><div class="alert-history"><div id="search-results">{body}</div><div class="ad">buy</div></div><footer>f</footer></body>') == "One paragraph.\n\nAnother one."
    assert html_extract.main_text(f'<div class="cookie-notice">{"We use cookies. " * 3}</div><div>{body}</div>') == "One paragraph.\n\nAnother one."


@pytest.mark.parametrize("unit", ["<div>", '<div class="sidebar"><article>', '<div class="ad">x', "<p>", "<a href='", "<svg>", "<head>", "<!--", "<b x=a c", "</div>", "<li><ul>"])
def test_deep_pages_take_time_in_proportion(unit):
    import time

    n = 100_000
    start = time.process_time()
    html_extract.main_text(unit * n + "</p></span>" * n + "end")
    assert time.process_time() - start < 60  # squared work would take hours


def planted_page(rng):
    """(html, main text) of a random page: the text is known because the page is made from it."""
    words = lambda: " ".join(rng.choice("alpha beta gamma delta <b> & café “q” 1".split()) for _ in range(rng.randrange(1, 30)))
    shown = lambda t: t.replace("&", "&amp;").replace("<", rng.choice(["&lt;", "&#60;", "&#x3c;"]))
    blank = lambda t: t.replace(" ", rng.choice([" ", "\n", "  \t"]))
    odd = lambda: rng.choice(["", " title='x>y'", ' data-a="<p>"', " b=c'd", ' e" f', " class=lead"])
    furniture = [
        '<div class="ad">buy <b>now</b></div>', "<nav><ul><li><a href=/x>menu</a></ul></nav>", "<aside><p>side</p></aside>", "<script>if (a < b) document.write('<p>no</p>')</script>", "<style>p > a {}</style>",
        '<form action="/s"><input name=q> search <button>go</button></form>', "<!-- <p>gone</p> -->", '<div role="alert">notice</div>', '<p hidden>hidden</p>', '<div class="share">share this</div>', "<noscript>no</noscript>",
    ]
    blocks, out = [], []
    for _ in range(rng.randrange(1, 8)):
        t = words()
        kind = rng.choice(["p", "h2", "blockquote", "div", "li", "section"])
        inner = " ".join(f"<em{odd()}>{shown(w)}</em>" if rng.random() < 0.2 else shown(w) for w in t.split(" "))
        out.append(f"<{kind}{odd()}>{blank(inner) if '<em' not in inner else inner}</{kind}>" if kind != "li" else f"<ul><li{odd()}>{inner}</ul>")
        blocks.append(t)
        if rng.random() < 0.5:
            out.append(rng.choice(furniture))
    body = "\n".join(out)
    page = f"<!doctype html><html><head><title>t</title></head><body><header><h1>site</h1></header>{rng.choice(furniture)}<article>{body}</article><section class=comments><p>me too</p></section><footer>f</footer></body></html>"
    return page, "\n\n".join(blocks)


def test_random_pages_give_the_text_they_were_made_from():
    import random

    rng = random.Random(11)
    for _ in range(400):
        page, want = planted_page(rng)
        assert html_extract.main_text(page) == want, page


# Bounds ----------------------------------------------------------------------


def test_caches_are_bounded_in_characters(monkeypatch):
    import random

    monkeypatch.setattr(tokenize, "CACHE_CHARS", 2_000)
    rng = random.Random(2)
    tok = tokenize.WordTokenizer(tokenize.public_path("word_bpe_49k.json"))
    plain = tokenize.WordTokenizer(tokenize.public_path("word_bpe_49k.json"))
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abc1;/") for _ in range(rng.choice([3, 9, 500]))) for _ in range(60)) for _ in range(3)]
        ids, bounds = tok.encode(texts)
        assert [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)] == plain.whole(texts)
        for cache in (tok.words, tok.chunks):
            assert sum(map(len, cache)) <= 2_000 and all(len(x) <= tokenize.LONGEST for x in cache)


def test_rows_without_id_are_dealt_to_many_cells(spark, monkeypatch):
    """Repeated rows without id get places of their own, in several cells of one length."""
    monkeypatch.setattr(packing, "CELL_ROWS", 100)
    docs = spark.createDataFrame([(None, "same text here")] * 700, "doc_id long, text string").repartition(5)
    got = packing.pack_documents(docs, capacity=20).collect()
    assert len(got) == 700 and len({(r["sequence_id"], r["offset"]) for r in got}) == 700
    cut = spark.createDataFrame([(None, 0, 0, 5, 9, i) for i in range(700)], "doc_id long, piece int, start long, length long, ids_crc32 long, __row long")
    placed = packing.place(cut, 20)
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    cells = cut.select((F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "__row"), F.lit(7))).alias("c")).groupBy("c").count().collect()
    assert len(cells) == 7 and max(r["count"] for r in cells) < 200
    assert sorted((r["sequence_id"], r["offset"]) for r in placed.collect()) == [(s, 5 * k) for s in range(175) for k in range(4)]


# Furniture by name, main, several articles --------------------------------------


@pytest.mark.parametrize("name", ["newsletter-signup", "share-buttons", "ad-slot", "cookie-notice", "related-posts", "relatedPosts", "comments-area", "sidebar_left", "social-share", "search-box", "ad-1"])
@pytest.mark.parametrize("key", ["class", "id"])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<body>{}</body>", "<main><article>{}</article><p>teaser</p></main>"])
def test_names_of_two_parts_are_furniture_everywhere(name, key, wrap):
    page = wrap.format(f'<h1>Head</h1><p>Text of the page.</p><div {key}="{name}"><p>Gone.</p></div><p>End of it.</p>')
    assert html_extract.main_text(page).replace("\n\nteaser", "") == "Head\n\nText of the page.\n\nEnd of it."


@pytest.mark.parametrize("name", ["related-work", "search-results", "legal", "alert-history", "category-legal", "menu-history-of-food", "socialism"])
def test_names_that_say_something_else_are_content(name):
    assert html_extract.main_text(f'<div class="{name}"><p>body text of page</p></div><p>small other text that is here too</p>') == "body text of page\n\nsmall other text that is here too"


def test_no_paragraph_is_lost_for_its_links():
    ad = '<div class="ad">buy</div>'
    assert html_extract.main_text(f"<p>One.</p>{ad}<p>See <a>this long list of links</a>, <a>and that</a></p>{ad}<p><a>All</a> <a>linked</a></p>{ad}<p>End.</p>") == "One.\n\nSee this long list of links, and that\n\nAll linked\n\nEnd."
    assert html_extract.main_text(f"<ul><li><a>home</a><li><a>more</a></ul>{ad}<p>Text.</p>") == "Text."


def test_main_holds_the_text_but_is_no_article():
    page = '<div>stray</div><main><div class="cookie-banner">We use cookies</div><div id="sidebar">Side</div>{}<div id="comments"><p>A reader</p></div></main>'
    assert html_extract.main_text(page.format("<p>The text.</p>")) == "The text."
    assert html_extract.main_text(page.format("<article><p>The text.</p></article>")) == "The text."


def test_teasers_of_other_articles_go_by_density():
    body = "".join(f"<p>{'A sentence of the article that goes on for a while. ' * 4}</p>" for _ in range(6))
    teaser = "<article><h3><a>Another title</a></h3><p>Short lead.</p></article>"
    text = html_extract.main_text(f"<article><h1>Head</h1>{body}</article>{teaser * 4}")
    assert text.startswith("Head") and "Another" not in text and text.count("A sentence") == 24
    two = html_extract.main_text(f"<article><h1>One</h1>{body}</article><article><h1>Two</h1>{body}</article>")
    assert "One" in two and "Two" in two


def test_random_pages_without_an_article():
    import random

    rng = random.Random(17)
    gone = ['<div class="cookie-consent-banner">we use</div>', '<section id="newsletter_signup"><p>sign up</p></section>', '<ul class="share-links"><li><a href=x>a</a><li><a href=y>b</a></ul>', '<div id="comments"><p>me too</p><article class="comment"><p>and me</p></article></div>', "<aside>side</aside>", '<div class="topAdBox">buy</div>']
    for _ in range(200):
        blocks = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 9))]
        out = []
        for t in blocks:
            out.append(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<div class=body-text>{}</div>", "<p>{} </p>", "<section id=part>{}</section>"]).format(t))
            out.extend(rng.sample(gone, rng.randrange(3)))
        wrap = rng.choice(["<body>{}</body>", "<main>{}</main>", '<div class="page-wrapper"><div id="content">{}</div></div>'])
        page = f'<header>site</header>{wrap.format("".join(out))}<footer>f</footer>'
        assert html_extract.main_text(page) == "\n\n".join(blocks), page


def test_a_worker_keeps_the_caches_of_one_operator():
    from lucerna.llm import common, tokenize

    def run(batches):
        for x in batches:
            yield x, len(tokenize._loaded)

    tok = tokenize.tokenizer(tokenize.public_path("word_bpe_49k.json"))
    assert list(common.tidy(run, tokenize.OWNER)(iter([1, 2]))) == [(1, 1), (2, 1)]
    assert tokenize.tokenizer(tokenize.public_path("word_bpe_49k.json")) is tok  # kept between tasks of one operator
    assert list(common.tidy(run)(iter([1]))) == [(1, 0)]  # another operator's task empties it
    assert tokenize.tokenizer(tokenize.public_path("word_bpe_49k.json")) is not tok
    assert list(common.tidy(run)(iter([]))) == []


def test_a_task_that_fails_or_stops_early_still_gives_memory_back(monkeypatch):
    from lucerna.llm import common

    given = []
    monkeypatch.setattr(common, "_give_back", lambda: given.append(1))

    def fails(batches):
        yield next(batches)
        raise ValueError("bad batch")

    with pytest.raises(ValueError, match="bad batch"):
        list(common.tidy(fails)(iter([1])))
    assert len(given) == 2  # before it began and when it ended
    half = common.tidy(iter)(iter([1, 2]))
    assert next(half) == 1
    half.close()
    assert len(given) == 4


def test_a_worker_holds_one_tokenizer_at_a_time():
    from lucerna.llm import tokenize

    path = tokenize.public_path("word_bpe_49k.json")
    tokenize.tokenizer(path, True)
    other = tokenize.tokenizer(path)
    assert list(tokenize._loaded.values()) == [other]
