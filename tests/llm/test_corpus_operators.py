"""Joins, search, classifiers, mixing and the pipeline against brute force on small fixtures."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lucerna.llm import gbdt, graph, mixing, ngram_join, quality, topk, toxicity
from lucerna.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


# N-gram Jaccard join -------------------------------------------------------


def word_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute_components(rows):
    """(id, set size, least reachable id, links) of each row, by comparing all pairs."""
    sets = [word_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    if x != y:
                        keep, go = (x, y) if rows[x][0] <= rows[y][0] else (y, x)
                        root[go] = keep
    return sorted((i, len(s), rows[find(k)][0], links[k]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed):
    """Documents of many lengths with edits at rates around the threshold, copies, shared passages and ties."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for n in (1, 2, 3, 4, 5, 8, 20, 40, 80, 100, 102, 110, 119, 120, 121, 123, 130, 142, 160, 300, 700):
        base = [rng.choice(vocabulary) for _ in range(n)]
        texts.append(base)
        for _ in range(6):
            other = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, n // 60))):
                if other:
                    k = rng.randrange(len(other))
                    other[k : k + 1] = rng.choice(([], [rng.choice(vocabulary)], [other[k], "extra"]))
            if rng.random() < 0.3:
                other = other + [rng.choice(vocabulary) for _ in range(n // 12)]
            texts.append(other)
        texts.append([*base, *passage])
    rows = [" ".join(t) for t in texts]
    rows += [None, "", " \t\n", rows[10].upper(), rows[10].replace(" ", "\n "), "A b c D", "a B c d"]
    return [(100 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("unit", [ngram_join.UNIT_WEIGHT, 3_000])
def test_components_equal_brute_force(spark, monkeypatch, unit):
    """The second case cuts families into slices and size classes."""
    monkeypatch.setattr(ngram_join, "UNIT_WEIGHT", unit)
    rows = near_copies(unit)
    docs = spark.createDataFrame([(i, t, i, 1, "r") for i, t in rows], "doc_id long, text string, n long, key int, rep string")
    got = sorted(tuple(r) for r in ngram_join.ngram_components(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    want = brute_components(rows)
    assert got == want
    assert sum(i != c for i, _, c, _ in want) > 20


def test_components_of_odd_tables(spark):
    schema = "doc_id long, text string"
    text = "one two three four five six"
    got = ngram_join.ngram_components(spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], schema)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["n_links"]) for r in got)[0][:3] == (-1, 3, None)
    assert [(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None] .count((1, 1)) == 2
    assert ngram_join.ngram_components(spark.createDataFrame([], schema)).count() == 0


def test_signature_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(30)]
    sets = [np.unique(np.concatenate([rng.permutation(b)[: rng.integers(50, 60)], rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)])) for b in base for _ in range(8)]
    got = {tuple(sorted(x)) for i, j in ngram_join.linked_pairs(sets) for x in zip(i.tolist(), j.tolist(), strict=True)}
    want = set()
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                want.add((b, a))
    assert got == want and want


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(200, 260)] + [(260, 200), (1, 2), (2, 3), (7, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, stack = {node}, [node]
        while stack:
            for x in near[stack.pop()] - seen:
                seen.add(x)
                stack.append(x)
        assert got[node] == min(seen)


# Top k ---------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [(4096, 512), (7, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    vectors = {i: np.round(rng.normal(size=6), 1).tolist() for i in range(160)}
    for i in range(100, 130):
        vectors[i] = vectors[100]  # ties
    vectors[3], vectors[4], vectors[5], vectors[6] = None, [1.0, None] * 3, [float("nan")] * 6, [float("inf")] + [0.0] * 5
    vectors[7] = [1.0, 2.0]
    rows = [(i, v, "x") for i, v in vectors.items()] + [(None, [1.0] * 6, "x"), (9, vectors[9], "x")]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), k=5, every=10).collect()
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors.items() if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in ok if i % 10 == 0):
        scored = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)]
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0


# Classifiers ---------------------------------------------------------------


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = gbdt.fit(x, y, trees=10, depth=3)
    for row, margin in zip(x[:50], f.margin(x[:50]), strict=True):
        total = f.base
        for t in range(10):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[f.feature[t, node]] > f.threshold[t, node])
            total += f.value[t, node - 7]
        assert abs(total - margin) < 1e-9
    assert ((f.probability(x) > 0.5) == y).mean() > 0.95


def test_isotonic_is_monotone_and_pools():
    iso = gbdt.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0.0, 1.0, 1.0, 0.0, 1.0]))
    at = np.linspace(0, 1, 50)
    assert (np.diff(iso(at)) >= 0).all() and iso(np.array([0.1]))[0] == 0 and iso(np.array([0.9]))[0] == 1
    assert abs(iso(np.array([0.25]))[0] - 2 / 3) < 1e-9


@pytest.mark.parametrize("classify", [quality.classify_quality, toxicity.classify_toxicity])
def test_classifiers_take_odd_rows(spark, classify):
    docs = spark.createDataFrame([(None, "a b", 1.0), (1, None, 1.0), (2, "", 1.0), (3, "x " * 200_000, 1.0), (3, "x", 2.0), (4, "!!! $$$", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (4, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = classify(docs, lab).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        assert not next(r for r in got if r["doc_id"] is None)["held_out"]
    assert classify(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no supplied tables")
@pytest.mark.parametrize(("name", "label", "least"), [("op8_quality", "quality", 0.97), ("op5_toxicity", "toxic", 0.94)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


# Mixing --------------------------------------------------------------------


def mixed_corpus(spark):
    rng = random.Random(2)
    words = {d: [f"{d}{i}" for i in range(40)] for d in ("a", "b", "c")}
    rows = [(i, " ".join(rng.choices(words[d], k=rng.randrange(5, 60))), d, 1.0) for i, d in enumerate(rng.choices("aabc", k=400))]
    return spark.createDataFrame([*rows, (900, None, "a", 1.0), (901, "", "b", 1.0)], "doc_id long, text string, domain string, rate double")


def test_rates_meet_targets(spark):
    docs = mixed_corpus(spark)
    targets = {"a": 0.2, "b": 0.5, "c": 0.3}
    got = mixing.mix(docs, docs.filter("doc_id % 2 = 0").select("doc_id", "domain"), targets).collect()
    assert len(got) == 402 and all(r["rate"] >= 0 for r in got)
    p, tokens = np.array([r["p"] for r in got]), np.array([r["n_tokens"] for r in got])
    assert np.allclose(p.sum(1), 1)
    reached = ((np.array([r["rate"] for r in got]) * tokens)[:, None] * p).sum(0)
    assert np.allclose(reached / tokens.sum(), [0.2, 0.5, 0.3], atol=1e-6)
    by_id = {r["doc_id"]: r["domain"] for r in got}
    assert np.mean([by_id[r["doc_id"]] == r["domain"] for r in docs.filter("length(text) > 0").collect()]) > 0.99


def test_projection_keeps_rates_nonnegative(spark):
    """A domain without target loses its documents, and the rest is what least squares allows."""
    docs = mixed_corpus(spark)
    got = mixing.mix(docs, docs.select("doc_id", "domain"), {"a": 1.0}).collect()
    rates = np.array([r["rate"] for r in got if r["n_tokens"]])
    own = np.array([r["domain"] == "a" for r in got if r["n_tokens"]])
    assert rates.min() >= 0 and rates[~own].max() < 0.05 and rates[own].min() > 1


def test_mixing_odd_tables(spark):
    docs = mixed_corpus(spark)
    none = docs.limit(0).select("doc_id", "domain")
    assert {r["rate"] for r in mixing.mix(docs, none, {"a": 1.0}).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), none, {"a": 1.0}).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("p"), F.lit(3).alias("n_tokens"), F.lit(4).alias("copies"))
    out = mixing.resample(clash, docs.select("doc_id", "domain"), {"a": 0.4, "b": 0.4, "c": 0.2})
    assert out.columns == clash.columns and 300 < out.count() < 520


# Pipeline and queries ------------------------------------------------------


@supplied
def test_pipeline_stages(spark):
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("clash"))
    columns = docs.columns
    q = corpus_pipeline.quality(spark, docs, sf)
    scored = quality.classify_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert q.columns == columns
    assert {r["doc_id"] for r in q.collect()} == {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    t = corpus_pipeline.toxicity(spark, q, sf)
    bad = toxicity.classify_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r["doc_id"] for r in t.collect()} == {r["doc_id"] for r in bad.filter("predicted = 0").collect()} & {r["doc_id"] for r in q.collect()}
    n = corpus_pipeline.near_duplicates(spark, t, sf)
    rows = sorted((r["doc_id"], r["text"]) for r in t.collect())
    assert n.columns == columns
    assert sorted(r["doc_id"] for r in n.collect()) == sorted({c for _, _, c, _ in brute_components(rows)})
    m = corpus_pipeline.mixture(spark, n, sf)
    assert m.columns == columns and {r["doc_id"] for r in m.collect()} <= {r["doc_id"] for r in n.collect()}
    p = corpus_pipeline.packing(spark, m, sf)
    assert p.filter("piece = 0").count() == m.count()


@supplied
def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


@supplied
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, copies int, piece string"
    rows = [(None, None, None, None, None, "a", "b", 1, "c"), (1, "", "en", "s", 0, "a", "b", 1, "c"), (2, "word " * 60_000, None, "s", 1, None, None, None, None), (3, "a fine text of some words", "xx", None, 1, "a", "b", 1, "c"), (3, "a fine text of some words", "xx", None, 1, "a", "b", 1, "c")]
    docs = spark.createDataFrame(rows, schema)
    got = stage(spark, docs, SF)
    assert {r["doc_id"] for r in got.collect()} <= {None, 1, 2, 3}
    assert name == "packing" or got.columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_duplicate_stage_keeps_rows_without_id_and_one_of_repeated_rows(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (2, text, "en"), (None, text, "en"), (5, None, "en")], "doc_id long, text string, lang string")
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(False, 1), (False, 5), (True, None)]


@supplied
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    # A column with nulls may come as floats from one side and as numbers from the other.
    plain = lambda x: "null" if x is None or str(x) in ("<NA>", "nan") else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    rows = lambda frame: sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))
    assert rows(got[list(want.columns)]) == rows(want)


def near_at_five_words(rows):
    """(kept ids, links) by comparing the five-word shingles of all pairs; one row is kept of each group that links at 0.8."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root, links = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    return sorted(rows[k][0] for k in range(len(rows)) if root[k] == k), links


@pytest.mark.parametrize("unit", [ngram_join.UNIT_WEIGHT, 3_000])
def test_duplicate_stage_equals_brute_force_at_five_words(spark, monkeypatch, unit):
    monkeypatch.setattr(ngram_join, "UNIT_WEIGHT", unit)
    rows = near_copies(unit + 1)
    base = [f"v{i}" for i in range(400)]
    # Appended passages and single edited words whose similarity lies between the stage's bound and op2's.
    rows += [(1000, " ".join(base)), (1001, " ".join([*base, *(f"more{i}" for i in range(85))])), (1002, " ".join("edit" if i % 50 == 25 else w for i, w in enumerate(base)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    want, links = near_at_five_words(rows)
    assert got == want
    assert links > 20 and 1000 in want and 1001 not in want and 1002 not in want
    assert sorted({c for _, _, c, _ in brute_components([r for r in rows if r[1] and r[1].strip()])}) != [i for i in want if dict(rows)[i] and dict(rows)[i].strip()]


# Former bounds, and brute force for what SQL cannot express ------------------


def test_an_id_with_several_texts_stands_for_the_smallest(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, b), (1, a), (2, a), (3, b), (4, a + " more")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (27, 1), 2: (27, 1), 3: (27, 3), 4: (28, 1)}


def test_scores_beyond_a_long_are_refused(spark):
    vectors = spark.createDataFrame([(0, [1e12, 0.0]), (1, [1e12, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="long"):
        topk.top_k(vectors)


def test_more_domains_than_weights_are_refused(spark):
    docs = spark.createDataFrame([(i, f"w{i}", f"d{i}") for i in range(mixing.DOMAINS + 1)], "doc_id long, text string, domain string")
    with pytest.raises(ValueError, match="domains"):
        mixing.mix(docs, docs.select("doc_id", "domain"), {"d1": 1.0})


def test_rates_are_the_nonnegative_least_squares(spark):
    """Targets that cannot be met: plain coordinate descent reaches hardly less (in parts of the sum at first)."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a1", "a2", "b1", "b2", "both"], k=rng.randrange(3, 20))), rng.choice("ab")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    got = mixing.mix(docs, docs.select("doc_id", "domain"), {"a": 0.999, "b": 0.001}).collect()
    m = np.array([[x * r["n_tokens"] for x in r["p"]] for r in got]).T
    rate, now = np.array([r["rate"] for r in got]), m.sum(1)
    goal = np.array([0.999, 0.001]) * now.sum()
    assert np.allclose(got[0]["targets"], goal) and np.allclose(got[0]["reached"], m @ rate)
    squares = lambda r: (((m @ r - goal) ** 2) / now).sum()
    best = np.ones(len(got))
    for _ in range(3000):
        for i in range(len(best)):
            a = m[:, i]
            best[i] = max(0.0, best[i] - (a * (m @ best - goal) / now).sum() / (a * a / now).sum())
    assert rate.min() >= 0 and squares(rate) - squares(best) <= 0.02 * squares(np.ones(len(got)))


def test_rates_meet_targets_of_many_overlapping_domains(spark):
    rng = random.Random(9)
    names = "abcdefgh"
    rows = [(i, " ".join(rng.choices([f"{d}{k}" for k in range(3)] + ["x", "y", "z"], k=rng.randrange(4, 30))), d) for i, d in enumerate(rng.choices(names, k=300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    targets = {d: k + 1.0 for k, d in enumerate(names)}
    r = mixing.mix(docs, docs.select("doc_id", "domain"), targets).first()
    assert np.allclose(r["reached"], r["targets"], rtol=1e-2)


def test_long_and_many_forms_enter_the_lexicon(spark):
    long = "z" * 90
    rows = [(i, " ".join([f"toxic{k:04d}word" for k in range(6000)] + [long]) if i % 2 else "a fine day " * 5, i % 2) for i in range(30)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, label int"), 15, 15)
    assert len(lexicon.forms) > 6000 and long in lexicon.forms


def test_toxicity_features_by_hand():
    lexicon = toxicity.Lexicon({"mora": 2.0, "^blub": 1.0})
    x = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT, you mora! blubber m0ra... Éa, s c u m, a*b", lexicon), strict=True))
    n = 12  # you idiot you mora blubber m0ra éa s c u m a*b
    want = {
        "log_words": np.log1p(n), "seed_count": 3, "learned_count": 2, "learned_strength": 3 / n, "distinct_hits": 4, "near_you": 4 / n, "you_density": 3 / n, "upper_words": 1 / n,
        "bangs": 1 / n, "questions": 0, "repeated_marks": 1 / n, "masked_words": 1 / n, "letter_digit_words": 1 / n, "spaced_letters": 1 / n, "disguised_hits": 2 / n,
    }
    text = "You IDIOT, you mora! blubber m0ra... Éa, s c u m, a*b"
    assert x["upper_letters"] == sum(c.isupper() for c in text) / len(text)
    assert {k: round(x[k], 9) for k in want} == {k: round(float(v), 9) for k, v in want.items()}
    again = toxicity.features(text, lexicon)
    assert again == list(x.values())


def test_first_split_is_the_best_of_all_splits():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=60) > 0.2).astype(float)
    f = gbdt.fit(x, y, trees=1, depth=1, bins=1000)
    p = (y.sum() + 0.5) / 61
    g, h = p - y, np.full(60, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    best = max((score(x[:, j] <= c) + score(x[:, j] > c), j) for j in range(3) for c in np.unique(x[:, j])[:-1] if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= 1.0)
    left = x[:, f.feature[0, 0]] <= f.threshold[0, 0]
    assert abs(score(left) + score(~left) - best[0]) < 1e-9
    assert np.allclose(f.value[0], [-0.2 * g[m].sum() / (h[m].sum() + 1.0) for m in (left, ~left)])


def test_quality_features_by_hand():
    x = dict(zip(quality.FEATURES, quality.features("One two one TWO.\n\nAb $x é\nAb $x é"), strict=True))
    assert x["distinct_words"] == 7 / 10 and x["top_word"] == 2 / 10 and x["shouted_words"] == 1 / 10
    assert x["log_lines"] == np.log1p(3) and x["repeated_lines"] == 1 - (16 + 7) / (16 + 14) and x["longest_word"] == np.log1p(4)
    assert x["repeated_trigrams"] == 1 - 7 / 8 and x["short_words"] == 6 / 10
    assert quality.features(None) == quality.features("")


def test_settings_are_as_before(spark):
    """Corpus queries change no setting of the session."""
    if not os.path.isdir(SF):
        pytest.skip("no supplied tables")
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    for name, query in QUERIES.items():
        query(spark, SF).limit(1).collect()
        assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before, name


def test_blocks_have_numbers_of_their_own(spark, monkeypatch):
    """Many short blocks, bounded by bytes too: no two have one number, and nothing is mixed up."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 6 * 3)
    rng = random.Random(4)
    vectors = {i: [rng.randrange(-9, 9) / 4 for _ in range(6)] for i in range(200)}
    d = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(7)
    blocks = topk._blocks(topk.quantised(d), 4)
    assert blocks.select("block").distinct().count() == blocks.count() >= 50
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(d, k=5, every=2).collect()}
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors.items()}
    for i in range(0, 200, 2):
        best = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]


def test_lexicons_of_folds_have_not_seen_their_fold(spark):
    rows = [(i, f"{'zorgle' if i % 2 else 'plain'} w{i} fine words here", i % 2, i % 3) for i in range(90)]
    rows += [(100 + i, f"only{k} insultish{k} text", 1, k) for k in range(3) for i in range(25)]
    rows += [(300 + i, f"calm c{i} text", 0, i % 3) for i in range(75)]
    lexicons = toxicity.learn_lexicons(spark.createDataFrame(rows, "doc_id long, text string, label int, fold long"), 3)
    assert len(lexicons) == 4 and all("zorgle" in x.forms for x in lexicons)
    for k in range(3):
        assert f"insultish{k}" not in lexicons[k].forms and f"insultish{k}" in lexicons[3].forms and f"insultish{(k + 1) % 3}" in lexicons[k].forms


def test_the_row_by_which_an_id_was_judged_stays(spark):
    """Of rows with one id the smallest text stays, whatever their order; ties agree in every column."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"b {words}", "en", "s", 9), (1, f"a {words}", "en", "s", 9), (1, f"a {words}", "de", "s", 9), (2, "other text altogether", "en", "s", 3), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, schema), "")
        assert got.columns == [x.split()[0] for x in schema.split(", ")]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, f"a {words}", "de", "s", 9), rows[3], rows[4], rows[5]]))
