"""Mixing documents to target domain weights by soft membership, as DataFrame expressions only.

A labelled table teaches a classifier (naive Bayes over hashed words) that gives every document
posteriors over domains.  Nonnegative document rates are then fitted by projected gradient least
squares so that expected domain token totals, sum of rate x tokens x posterior, match targets.
Residuals are weighted by 1 / (tokens of the domain), and steps are taken in the metric of document
tokens; the curvature is then at most 1, so the step 1 converges.  Each step is one aggregate over the
documents; only one residual for each domain reaches the driver.  Every few steps the rates are written
as a column, so a step's expression stays short.  Steps end when the totals meet their targets or when
the squares stop falling; targets and reached totals are columns of the result.

Rows and edge cases: a null text is empty (no tokens, prior posteriors, rate 1 before projection);
repeated rows count each and draw alike, rows without id draw by their text; other columns are ignored;
with no labelled row there is one domain and every rate is 1; targets for domains that the labelled
table does not have are left out; more than ``DOMAINS`` domains are refused with an error.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import drop_shared, write_shared

#: Words are hashed into so many slots.
SLOTS = 4096
#: The classifier learns from at most so many labelled documents, chosen by a hash of their id.
TRAINING_ROWS = 10_000
#: Every domain is a list of SLOTS weights in the scoring expression; a call with more domains raises ValueError.
DOMAINS = 64
#: Stop when no domain total is off its target by more than this share.
TOLERANCE = 1e-9
#: Stop when PATIENCE steps lower the sum of squares by less than this share of what it was at first: the targets can
#: hardly be met more closely.
STALL, PATIENCE = 1e-4, 10
#: Steps after which the rates are written as a column.
STEPS_OF_A_TABLE = 8
#: Share of tokens for each language of the corpus, for the registered query and the pipeline.
LANGUAGE_TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.18, "es": 0.12}


def words(text: Column) -> Column:
    """Whitespace-separated words in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x09-\\x0D ]+"), lambda w: w != "")


def slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def fit_classifier(documents: DataFrame, labelled: DataFrame, rows: int = TRAINING_ROWS) -> tuple[list[str], list[float], list[list[float]]]:
    """(domains, log priors, log weights by domain and slot) from at most ``rows`` labelled documents.

    ``labelled`` has doc_id and domain.  The sample is bounded, so it is broadcast; what comes to the
    driver is one count for each domain and slot.
    """
    from math import log

    usable = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).dropna()
    sample = usable.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample, path = write_shared(sample, "labelled")
    priors = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).limit(DOMAINS + 1).collect()}
    if len(priors) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    domains = sorted(priors) or ["all"]
    train = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    counted = train.select("domain", F.explode(words(F.col("text"))).alias("w")).groupBy("domain", slot(F.col("w")).alias("slot")).agg(F.count("*").alias("n")).collect()
    drop_shared(documents.sparkSession, path)
    counts = {d: [0.5] * SLOTS for d in domains}
    for r in counted:
        counts[r["domain"]][r["slot"]] += r["n"]
    every = sum(priors.values()) or 1
    weights = [[log(c / total) for c in counts[d]] for d in domains for total in (sum(counts[d]),)]
    return domains, [log(priors.get(d, 1) / every) for d in domains], weights


def posteriors(documents: DataFrame, model: tuple[list[str], list[float], list[list[float]]], keep: list[str]) -> DataFrame:
    """row (a struct of the columns ``keep``), n_tokens and p (one posterior for each domain) of every document."""
    domains, prior, weights = model
    d = documents.select(F.struct(*keep).alias("row"), F.transform(words(F.col("text")), slot).alias("slots"))
    # One literal for each domain: as JSON, which the planner folds to an array, not as thousands of expressions.
    known = [F.from_json(F.lit(json.dumps(w)), "array<double>") for w in weights]
    score = lambda k: F.aggregate("slots", F.lit(prior[k]), lambda a, s: a + F.get(known[k], s))
    d = d.select("row", F.size("slots").cast("long").alias("n_tokens"), F.array(*(score(k) for k in range(len(domains)))).alias("l"))
    d = d.withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return d.select("row", "n_tokens", F.transform("e", lambda x: x / total).alias("p"))


def start() -> Column:
    """Where a document begins: its rate, and the point ahead of it at which the next gradient is taken."""
    return F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))


def moved(at: Column, steps: list[tuple[list[float], float]]) -> Column:
    """A document's place (rate, ahead) after the given steps: (weighted residual for each domain, momentum) each."""
    if not steps:
        return at
    along = lambda g: F.aggregate(F.zip_with("p", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)

    def step(place: Column, s: Column) -> Column:
        rate = F.greatest(F.lit(0.0), place["ahead"] - along(s["g"]))
        return F.struct(rate.alias("rate"), (rate + s["m"] * (rate - place["rate"])).alias("ahead"))

    listed = F.array(*(F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(m).alias("m")) for g, m in steps))
    return F.aggregate(listed, at, step)


def _totals(state: DataFrame, n: int) -> tuple[list[float], list[float]]:
    """Expected token totals of the domains, at the rates and at the points ahead."""
    sums = [F.sum(F.col(f"at.{c}") * F.col("n_tokens") * F.col("p")[k]) for c in ("rate", "ahead") for k in range(n)]
    got = [float(x or 0.0) for x in state.agg(*(x.alias(f"t{i}") for i, x in enumerate(sums))).first()]
    return got[:n], got[n:]


def fit_rates(table: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[list[tuple[list[float], float]], list[float], list[float]]:
    """(steps, target totals, reached totals) of accelerated projected gradient least squares from rate 1."""
    spark, n = table.sparkSession, len(domains)
    state, path = table.select("n_tokens", "p", start().alias("at")), None
    now, _ = _totals(state, n)
    wanted = [max(0.0, targets.get(d, 0.0)) for d in domains]
    share = sum(wanted)
    goal = [sum(now) * w / share for w in wanted] if share else now
    squares = lambda got: sum((a - b) ** 2 / s for a, b, s in zip(got, goal, now, strict=True) if s)
    met = lambda got: all(abs(a - b) <= TOLERANCE * max(1.0, b) for a, b in zip(got, goal, strict=True))
    steps: list[tuple[list[float], float]] = []
    pending: list[tuple[list[float], float]] = []
    reached = ahead = now
    inertia, seen = 1.0, [squares(now)]
    while not met(reached) and (len(seen) <= PATIENCE or seen[-1 - PATIENCE] - seen[-1] > STALL * seen[0]):
        following = (1 + (1 + 4 * inertia**2) ** 0.5) / 2
        pending.append(([(a - b) / s if s else 0.0 for a, b, s in zip(ahead, goal, now, strict=True)], (inertia - 1) / following))
        steps.append(pending[-1])
        here = state.select("n_tokens", "p", moved(F.col("at"), pending).alias("at"))
        if len(pending) == STEPS_OF_A_TABLE:
            state, new_path = write_shared(here, "rates")
            if path:
                drop_shared(spark, path)
            here, path, pending = state, new_path, []
        reached, ahead = _totals(here, n)
        seen.append(squares(reached))
        inertia = following if seen[-1] <= seen[-2] else 1.0
    if path:
        drop_shared(spark, path)
    return steps, goal, reached


def rated(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str]) -> DataFrame:
    """row (struct of ``keep``), n_tokens, domain (likeliest), p, rate, copies, targets and reached of every document.

    copies is the rate rounded up or down by a hash of id and text, so that its expectation is the rate.
    targets and reached are the token totals of the domains, in the order of p; they are the same in every row.
    """
    model = fit_classifier(documents, labelled)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    table = posteriors(documents.withColumn("__draw", drawn), model, [*keep, "__draw"])
    table, _ = write_shared(table, "posteriors")
    steps, goal, reached = fit_rates(table, model[0], targets)
    likeliest = F.get(F.lit(model[0]), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    rate = moved(start(), steps)["rate"].alias("rate")
    table = table.select(F.col("row").dropFields("__draw").alias("row"), F.col("row.__draw").alias("draw"), "n_tokens", likeliest.alias("domain"), "p", rate)
    copies = F.floor(F.col("rate") + F.col("draw")).cast("int").alias("copies")
    return table.select("row", "n_tokens", "domain", "p", "rate", copies, F.lit(goal).alias("targets"), F.lit(reached).alias("reached"))


def mix(documents: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), p, rate, copies, targets and reached of every document."""
    r = rated(documents.select("doc_id", "text"), labelled, targets, ["doc_id"])
    return r.select("row.doc_id", "n_tokens", "domain", "p", "rate", "copies", "targets", "reached")


def resample(documents: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The rows of ``documents``, each as often as its copies say, with its own columns only."""
    r = rated(documents, labelled, targets, documents.columns)
    return r.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")
