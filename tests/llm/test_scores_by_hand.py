"""Scores of the quality classifier against a plain implementation of features, bins, trees and traversal; calibration and Ogg packets by hand."""

import math
import random
import zlib

import numpy as np
import pytest

from lucerna.llm import gbdt, media_ogg, quality


def plain_features(text):
    """The statistics of :data:`quality.FEATURES`, one by one."""
    text = text or ""
    raw = text.encode()
    n = max(1, len(raw))
    share = lambda test: sum(map(test, raw)) / n
    of = lambda chars: share(lambda b: b < 128 and chr(b) in chars)
    words = text.split()
    w = max(1, len(words))
    distinct = sorted(set(words))
    counted = {x: words.count(x) for x in distinct}
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = [x for x in text.split("\n") if x.strip()]
    size = sum(len(x) for x in lines)
    half = len(words) // 2
    return {
        "log_chars": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "mean_word": sum(len(x) for x in words) / w,
        "upper": of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": of("abcdefghijklmnopqrstuvwxyz"), "digit": of("0123456789"), "space": of(" \t\r\n\v\f"), "sentence_marks": of(".?"), "commas": of(",;:"),
        "bangs": of("!"), "pipes": of("|"), "symbols": of("#$%&*+<>=@\\^_~{}[]/"), "non_ascii": share(lambda b: b >= 128),
        "distinct_words": len(distinct) / w, "top_word": max(counted.values(), default=0) / w, "repeated_trigrams": 1 - len(set(threes)) / len(threes) if threes else 0.0,
        "repeated_lines": 1 - sum(len(x) for x in set(lines)) / max(1, size), "log_lines": math.log1p(len(lines)), "words_per_line": w / max(1, len(lines)),
        "shouted_words": sum(c for x, c in counted.items() if len(x) > 1 and x.isupper()) / w, "symbol_ended_words": sum(c for x, c in counted.items() if x[-1] in "#$%&*!") / w,
        "short_words": sum(c for x, c in counted.items() if len(x) <= 2) / w, "longest_word": math.log1p(max((len(x) for x in words), default=0)), "repeated_halves": len(set(words[:half]) & set(words[half:])) / max(1, len(distinct)),
    }


def plain_cuts(values, bins):
    """Distinct inner quantiles of a column, by linear interpolation."""
    ordered, out = sorted(values), []
    for i in range(1, bins):
        place = (len(ordered) - 1) * (i / bins)
        k = int(place)
        a, b, t = ordered[k], ordered[min(k + 1, len(ordered) - 1)], place - k
        out.append(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
    return sorted(set(out))


def plain_forest(x, y, *, trees, depth=4, rate=0.2, bins=64, l2=1.0, least=1.0):
    """(base, trees): a tree is a nested (feature, threshold, left, right) or a leaf's value."""
    prior = (sum(y) + 0.5) / (len(y) + 1.0)
    base = float(np.log(prior / (1 - prior)))
    cuts = [plain_cuts([r[j] for r in x], bins) for j in range(len(x[0]))]
    margin, grown = [base] * len(x), []

    def split(rows, g, h):
        best = (1e-9, None, None)
        for j, edges in enumerate(cuts):
            sums = [[0.0, 0.0] for _ in range(len(edges) + 1)]
            for r in rows:
                b = sum(e < x[r][j] for e in edges)
                sums[b][0] += g[r]
                sums[b][1] += h[r]
            run, a, b = [], 0.0, 0.0
            for s in sums:
                a, b = a + s[0], b + s[1]
                run.append((a, b))
            gt, ht = run[-1]
            top = (0.0, None)
            for k, (gl, hl) in enumerate(run[:-1]):
                gain = 0.0 if hl < least or ht - hl < least else gl * gl / (hl + l2) + (gt - gl) * (gt - gl) / (ht - hl + l2) - gt * gt / (ht + l2)
                if top[1] is None or gain > top[0]:
                    top = (gain, k)
            if top[1] is not None and top[0] > best[0]:
                best = (top[0], j, edges[top[1]])
        return best[1:]

    def grow(rows, g, h, level):
        if level == depth:
            a = b = 0.0  # one by one: sum() corrects its rounding, which decides between splits of equal gain
            for r in rows:
                a, b = a + g[r], b + h[r]
            value = -rate * a / (b + l2)
            for r in rows:
                margin[r] += value
            return value
        j, edge = split(rows, g, h)
        j, edge = (0, math.inf) if j is None else (j, edge)
        return j, edge, grow([r for r in rows if x[r][j] <= edge], g, h, level + 1), grow([r for r in rows if x[r][j] > edge], g, h, level + 1)

    for _ in range(trees):
        # The last digit of an exponential decides between splits of equal gain, so it is taken from the same function.
        p = (1 / (1 + np.exp(-np.array(margin)))).tolist()
        grown.append(grow(list(range(len(x))), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], 0))
    return base, grown


def plain_probability(forest, row):
    base, trees = forest
    total = base
    for t in trees:
        while isinstance(t, tuple):
            j, edge, left, right = t
            t = right if row[j] > edge else left
        total += t
    return 1 / (1 + math.exp(-total))


def corpus(n):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 9)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(10, 60))).capitalize() + "." + "\nNext line." * rng.randrange(3)
    bad = lambda: rng.choice([lambda: "BUY NOW!!! $$$ " * rng.randrange(2, 9), lambda: " | ".join(word() for _ in range(20)), lambda: "12345 %%% " * rng.randrange(3, 20), lambda: "spam\n" * 30])()
    rows = []
    for i in range(n):
        label = rng.random() < 0.6
        rows.append((i, good() if label != (rng.random() < 0.08) else bad(), int(label)))
    return rows


def test_features_equal_plain_ones():
    for _, text, _ in [*corpus(60), (0, None, 0), (0, "", 0), (0, "\n\n", 0), (0, "x", 1), (0, "É É É!", 1)]:
        told = plain_features(text)
        assert list(told) == list(quality.FEATURES)
        assert quality.features(text) == pytest.approx(list(told.values()), abs=1e-12)


def test_quality_scores_equal_a_plain_implementation(spark):
    """End to end: split by checksum, features, bins, trees, traversal, threshold."""
    rows = corpus(150)
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify_quality(texts, labels).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # Rows of training come in the order of a hash; sums of floats depend on it.
    from pyspark.sql import functions as F

    order = [r["doc_id"] for r in texts.filter("doc_id < 1000").orderBy(F.xxhash64("doc_id"), "doc_id").collect() if not held(r["doc_id"])]
    by = {i: (t, q) for i, t, q in rows}
    forest = plain_forest([quality.features(by[i][0]) for i in order], [by[i][1] for i in order], trees=60)
    for i, text in [*((i, t) for i, t, _ in rows), (1000, None), (None, "no id")]:
        want = plain_probability(forest, quality.features(text))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6), i
        assert got[i]["held_out"] == (i is not None and held(i)) and got[i]["predicted"] == (got[i]["score"] >= 0.5)
    right = [got[i]["predicted"] == q for i, _, q in rows if held(i)]
    assert sum(right) / len(right) > 0.8


def test_isotonic_equals_its_formula():
    """The fit at each score is the largest, over starts, of the smallest mean, over ends, of a run around it."""
    rng = random.Random(5)
    for _ in range(60):
        score = [rng.choice([0.1, 0.2, 0.3, 0.5, 0.7, 0.9]) for _ in range(rng.randrange(1, 25))]
        y = [float(rng.random() < s) for s in score]
        at = sorted(set(score))
        mean = lambda a, b, score=score, y=y: (lambda v: sum(v) / len(v))([q for s, q in zip(score, y) if a <= s <= b])
        want = [max(min(mean(a, b) for b in at if b >= s) for a in at if a <= s) for s in at]
        assert gbdt.isotonic(np.array(score), np.array(y))(np.array(at)) == pytest.approx(want)


@pytest.mark.parametrize("sizes", [[70_000], [65_025], [65_024, 1], [255, 510, 0, 254], [255 * 255], [255 * 255 * 2, 3, 130_000]])
def test_ogg_packets_go_on_over_pages(sizes):
    rng = random.Random(1)
    packets = [rng.randbytes(n) for n in sizes]
    pages = media_ogg.stream_pages(7, [(p, i) for i, p in enumerate(packets)])
    assert len(pages) > 1 or max(sizes) < 65_025
    got = media_ogg.demultiplex(b"".join(pages))[7]
    assert got.packets == packets and got.ended and not got.open
    broken = bytearray(b"".join(pages))
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum|page"):
        media_ogg.demultiplex(bytes(broken))
    if len(pages) > 1:
        with pytest.raises(ValueError, match="order"):
            media_ogg.demultiplex(b"".join(pages[1:]))
