"""Resampling, licence scans and conversation repair against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lucerna.llm import license_scan, repair, resampling
from lucerna.llm.queries import LICENSE_PHRASES, QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# Resampling ------------------------------------------------------------------


def brute_resampling(docs, target, order=1, buckets=10_000, seed=2024, least=20, percent=10):
    runs = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, order + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for count, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs(text):
                count[bucket(f)] += 1
    n_s, n_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1.0) * (n_s + buckets) / ((a + 1.0) * (n_t + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        f = runs(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(repr, (r[:5] for r in rows)))


def sample_texts(rng, n):
    vocabulary = ["alpha", "Beta", "gämma", "x" * 200, "9", "delta-Epsilon", "ÉTÉ", "中文", "a_b", "it's"] + [f"w{i}" for i in range(80)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 40, 90]))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resampling_equals_brute_force(spark, order):
    rng = random.Random(order)
    docs = [(i, t) for i, t in enumerate(sample_texts(rng, 150))]
    docs += [(None, None), (7, docs[7][1]), (7, docs[9][1]), (500, None), (501, ""), (502, "one two\x00three\x7ffour"), (None, docs[3][1])]
    target = sample_texts(rng, 10) + [None]
    d = spark.createDataFrame([(i, t, 0.5, 3) for i, t in docs], "doc_id long, text string, score double, rank int")
    got = resampling.resample_to_target(d, spark.createDataFrame([(t,) for t in target], "text string"), order=order)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(list(r)) for r in got.collect()) == brute_resampling(docs, target, order)


def test_tries_start_anew_without_loss(monkeypatch):
    monkeypatch.setattr(resampling, "MOST_NODES", 5)
    monkeypatch.setattr(resampling, "PART", 16)
    text = b"a b c d e f g h a b c " * 20 + b"y" * 100 + b" a b"
    found = text.decode().split()
    for order in (1, 2):
        totals = [0] * 50
        trie = resampling.WordTrie(order, 50, lambda b: 0)
        flushed = []

        def merge():
            stack = list(trie.root.values())
            while stack:
                node = stack.pop()
                totals[node[2]] += node[3]
                stack.extend((node[0] or {}).values())
            flushed.append(trie.nodes)
            trie.clear()

        resampling._count(trie, text, totals, merge)
        merge()
        want = [0] * 50
        for k in range(1, order + 1):
            for i in range(len(found) - k + 1):
                want[zlib.crc32(" ".join(found[i : i + k]).encode()) % 50] += 1
        assert totals == want and len(flushed) > 2
        assert resampling._gained(resampling.WordTrie(order, 50, want.__getitem__), text) == (len(found), sum(n * n for n in want))


def test_resampling_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample_to_target(none, one).collect() == []
    few = spark.createDataFrame([(1, "a b c"), (2, "d " * 30)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in resampling.resample_to_target(few, spark.createDataFrame([], "text string")).collect()}
    assert got[1]["rank"] is None and got[2]["rank"] is None and got[2]["n_features"] == 30
    assert resampling.resample_to_target(few, one, percent=100).filter("rank = 1").count() == 1


def test_ranks_of_a_hot_id(spark):
    """Equal scores and ids in many ranges: ranks are gapless and each is given once."""
    docs = spark.range(0, 3000, numPartitions=7).select(F.lit(5).cast("long").alias("doc_id"), F.lit("w " * 25).alias("text"))
    got = resampling.resample_to_target(docs, spark.createDataFrame([("w",)], "text string"), percent=50)
    assert sorted(r["rank"] for r in got.filter("rank is not null").collect()) == list(range(1, 1501))


# Licence scans ---------------------------------------------------------------


def brute_places(found, phrase):
    p = phrase.split()
    return [i for i in range(len(found) - len(p) + 1) if found[i : i + len(p)] == p]


def brute_licences(text):
    """(words, base places, base labels, labels) by comparing every place of every phrase."""
    found = words(text)
    base = [(i, label) for phrase, label in LICENSE_PHRASES for i in brute_places(found, phrase)]
    labels = {label for _, label in base}
    for label, notice, keys in license_scan.TEMPLATES:
        offset = {k: brute_places(notice.split(), k)[0] for k in keys}
        begins = [i - offset[keys[0]] for i in brute_places(found, keys[0])]
        # The operator leads with another key where that is rarer: either way all keys stand near their places.
        near = lambda b: all(any(abs(i - b - offset[k]) <= license_scan.SLACK for i in brute_places(found, k)) for k in keys)
        if any(map(near, begins)):
            labels.add(label)
    return len(found), sorted(i for i, _ in base), sorted({x for _, x in base}), sorted(labels)


def test_licences_equal_brute_force(spark):
    rng = random.Random(3)
    filler = ["the", "license", "under", "mit", "of", "version", "2", "and", "any", "word", "cc", "by"]
    fill = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [None, "", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.\nCC BY-NC 4.0 under the mit license under the mit license"]
    texts += [f"{fill(rng.randrange(40))} {text.upper() if rng.random() < 0.5 else text} {fill(rng.randrange(40))}" for _, text, _ in license_scan.TEMPLATES]
    # Mandatory phrases too far apart, a missing one, and words in between.
    text, keys = license_scan.TEMPLATES[0][1:]
    texts += [f"{keys[0]} {fill(100)} {keys[1]}", keys[0], text.replace("software", "fine software"), f"{keys[1]} {keys[0]}"]
    texts += [fill(rng.randrange(300)) for _ in range(60)]
    docs = spark.createDataFrame([(i % 50 if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = license_scan.license_report(docs, LICENSE_PHRASES).collect()
    assert len(got) == len(texts)
    assert sorted(repr((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"])) for r in got) == sorted(
        repr((n, len(base), base[0] if base else None, base[-1] if base else None, ",".join(labels), ",".join(every))) for n, base, labels, every in map(brute_licences, texts)
    )
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) and (not r["n_base"] or r["score"] == 1) for r in got)


def test_licence_hits_have_places(spark):
    notice = dict((label, text) for label, text, _ in license_scan.TEMPLATES)["isc"]
    docs = spark.createDataFrame([(1, f"one two {notice}"), (2, "Permission to use, copy, modify, the thing with or without fee is hereby granted")], "doc_id long, text string")
    got = {r["doc_id"]: r["hits"] for r in license_scan.scan_licenses(docs, []).collect()}
    assert [(h["label"], h["start"], h["score"]) for h in got[1]] == [("isc", 2, pytest.approx(1))]
    assert len(got[2]) == 1 and 0.4 < got[2][0]["score"] < 1
    assert license_scan.scan_licenses(docs.filter("doc_id < 0"), []).count() == 0


# Conversation repair -----------------------------------------------------------


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows, faults):
    """(cost, audit, turns) by least (cost, audit) from the end, for each row and each shape of what is kept so far."""
    shapes = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    n = len(rows)
    far = (10**9, "", ())
    after = {q: far for q in shapes}
    for i in range(n, -1, -1):
        here = {}
        for q in shapes:
            best = (0, "", ()) if i == n and q in ("", "a") else far
            if i < n:
                _, role, text = rows[i]
                fault, extra = faults[i], faults[i] == "truncated"
                tries = [(3, "D", (), q)]
                if fault not in ("blank", "duplicate"):
                    if role[:1] in shapes[q]:
                        tries.append((extra, "K", ((role, text),), role[:1]))
                    tries += [(2 + extra, "R", (({"u": "user", "a": "assistant"}[k], text),), k) for k in shapes[q] if k in "ua"]
                for cost, letter, turn, to in tries:
                    c, a, t = after[to]
                    best = min(best, (cost + c, letter + a, turn + t))
            here[q] = best
        for _ in range(4):
            for q in shapes:
                for k in shapes[q]:
                    if k in "ua":
                        c, a, t = here[k]
                        here[q] = min(here[q], (2 + c, "I" + a, (({"u": "user", "a": "assistant"}[k], ""),) + t))
        after = here
    return after[""]


def brute_report(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    out = []
    for conv, mine in convs.items():
        left = brute_damage(mine)
        faults = brute_faults(left)
        turns = [t for t, _, _ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        cost, audit, kept = brute_repair(left, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(map(repr, out))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(spark, rows):
    t = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, audit string").repartition(5)
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in repair.repair_report(t).collect())


def conversations(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ultra"])
            text = rng.choice(["Yes.", "No!", "What?", "cut off", "", " \n", None, f"said {rng.random()}.", "trailing. \t\n", " ", "é…"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None, 40]), role, text))
    return rows


def test_repair_equals_brute_force(spark):
    rows = conversations(random.Random(11), 250)
    assert report(spark, rows) == brute_report(rows)


def test_repair_of_cut_conversations(spark, monkeypatch):
    """Conversations over many ranges and segments come out as those that fit one."""
    monkeypatch.setattr(repair, "SEGMENT", 3)
    rng = random.Random(12)
    rows = conversations(rng, 20)
    rows += [(77, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{i}?", " "])) for i in range(400)]
    rows += [(78, 3, "user", "same.")] * 60
    assert report(spark, rows) == brute_report(rows)


def test_segments_are_cut_by_size():
    codes = bytes([2, 3, 1, 8, 7, 2, 3, 12, 2])
    whole = repair.segment_matrix(codes)
    for cut in range(1, len(codes)):
        assert (repair._product(repair.segment_matrix(codes[:cut]), repair.segment_matrix(codes[cut:])) == whole).all()


def test_repair_edge_cases(spark):
    gone = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = {r["conv_id"]: r for r in repair.repair_report(spark.createDataFrame([(gone, 0, "user", "Hi."), (None, None, None, None)], "conv_id long, turn long, role string, text string")).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[None]["audit"] == "D" and got[None]["blank"] == 1 and got[None]["gaps"] == 0
    assert repair.repair_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repaired_turns_are_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "tool", "ok.")], "conv_id long, turn long, role string, text string")
    _, audits, turns = repair.repair(rows)
    audit = audits.first()
    cost, letters, kept = brute_repair([(0, "assistant", "Hello."), (1, "user", "Hi."), (2, "tool", "ok.")], ["", "", ""])
    assert (audit["cost"], audit["audit"]) == (cost, letters)
    assert [(r["role"], r["text"]) for r in turns.orderBy("at", "place").collect()] == list(kept)


def test_queries_are_registered():
    assert {"op11_target_resampling", "op12_license_scan", "op13_conversation_repair"} <= QUERIES.keys()
