"""Toxicity: gradient-boosted trees over dense lexical features, with isotonic calibration.

The lexicon has two parts: a short fixed list of insults, and word forms (whole words and word
beginnings) that the labelled sample itself marks as toxic by a likelihood-ratio test.  Null
texts count as empty; repeated rows are scored each; a null id is never held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import id_remainder, numbers, slices, tidy
from lucerna.llm.gbdt import Forest, Isotonic, fit, isotonic
from lucerna.llm.quality import TRAINING_ROWS, labelled_sample, training_rows

#: Insults known beforehand.
SEED_WORDS = frozenset(
    "idiot moron loser scum worthless pathetic clown stupid trash disgusting imbécile crétin débile ordure dummkopf trottel abschaum idiota imbécil estúpido basura escoria".split()
)
#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself ya u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie tú ti usted ustedes vosotros".split())
#: Characters that stand for letters in disguised words.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")
#: A word form enters the learned lexicon when its likelihood ratio is at least this, and most of its documents are toxic.
LEAST_RATIO = 20.0
#: Words whose forms a worker keeps looked up, over all lexicons of a task; a full table starts anew.
KNOWN_WORDS = 200_000
#: Longer words are looked up each time.
LONGEST = 64
BEGINNINGS = (4, 5, 6)
WINDOW = 5

FEATURES = (
    "log_words", "seed_density", "seed_count", "learned_density", "learned_count", "learned_strength", "distinct_hits",
    "near_you", "you_density", "upper_words", "upper_letters", "bangs", "questions", "repeated_marks", "masked_words", "letter_digit_words", "spaced_letters", "disguised_hits",
)

_EDGE = ".,;:!?\"'()[]{}<>«»…-—*_`~"
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_REPEATED = re.compile(r"([!?.])\1{2,}")
_MASKED = re.compile(r"(?<=[^\W\d_])[*#@$%]+(?=[^\W\d_])")


_CAPITALS = bytes(range(65, 91))
_ASCII = bytes(range(128))


def capitals(text: str) -> int:
    """How many characters are upper case."""
    raw = text.encode("utf-8", "surrogatepass")
    other = raw.translate(None, _ASCII)
    return len(raw) - len(raw.translate(None, _CAPITALS)) + (sum(map(str.isupper, other.decode("utf-8", "surrogatepass"))) if other else 0)


def token(word: str) -> str:
    return word.lower().strip(_EDGE)


def tokens(text: str) -> list[str]:
    return [y for x in text.split() if (y := token(x))]


def forms(word: str) -> list[str]:
    """The whole word and its longer beginnings (marked with a caret)."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


class Known(NamedTuple):
    """What a written word says, with and without the lexicon."""

    token: str
    seed: bool
    strength: float
    disguised: bool
    you: bool
    shouted: bool
    mixed: bool


#: Words of letters whose beginning no list and no form has.
_PLAIN, _SHOUTED = (Known("x", False, 0.0, False, False, shouted, False) for shouted in (False, True))


class Lexicon:
    """Strengths of word forms.  What a word says is looked up once for each worker."""

    def __init__(self, forms: dict[str, float], most: int = KNOWN_WORDS):
        self.forms, self.most = forms, most
        #: How every word begins that a list or a form has.
        self.heads = {x.removeprefix("^")[: BEGINNINGS[0]] for x in (*forms, *SEED_WORDS, *SECOND_PERSON)}
        self.known: dict[str, Known] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def plain(self, word: str) -> bool:
        return word in SEED_WORDS or bool(self.forms.get(word))

    def learn(self, word: str) -> Known:
        if len(self.known) >= self.most:
            self.known.clear()
        w = token(word)
        if w.isalpha() and w[: BEGINNINGS[0]] not in self.heads:
            return self.keep(word, _SHOUTED if len(word) > 1 and word.isupper() else _PLAIN)
        seed, strength = w in SEED_WORDS, max([self.forms.get(f, 0.0) for f in forms(w)])
        odd = not w.isalpha()
        disguised = odd and not (seed or strength) and self.plain(re.sub(r"[^\w]", "", w.translate(LOOKALIKES)))
        mixed = odd and any(map(str.isdigit, w)) and any(map(str.isalpha, w))
        return self.keep(word, Known(w, seed or disguised, strength, disguised, w in SECOND_PERSON, len(word) > 1 and word.isupper(), mixed))

    def keep(self, word: str, found: Known) -> Known:
        if len(word) <= LONGEST:
            self.known[word] = found
        return found


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    forest: Forest
    calibration: Isotonic

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = matrix(texts, self.lexicon)
        return np.clip(self.calibration(self.forest.probability(x)), 0, 1)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    raw = text.split()
    count = seeds = learned = total = disguised = said = shouted = mixed = 0.0
    strong = set()
    get = lexicon.known.get
    for word, c in Counter(raw).items():
        k = get(word) or lexicon.learn(word)
        shouted += c * k.shouted
        if not k.token:
            continue
        count += c
        if k.seed or k.strength:
            strong.add(k.token)
            seeds += c * k.seed
            learned += c * (k.strength > 0)
            total += c * k.strength
            disguised += c * k.disguised
        if k.you:
            said += c
        if k.mixed:
            mixed += c
    n = max(1.0, count)
    near = 0
    if strong and said:
        words = [w for x in raw if (w := token(x))]
        hits = [i for i, w in enumerate(words) if w in strong]
        spots = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        at = np.searchsorted(spots, hits)
        for i, k in zip(hits, at, strict=True):
            near += any(0 <= j < len(spots) and abs(spots[j] - i) <= WINDOW for j in (k - 1, k))
    spaced = _SPACED.findall(text)
    for x in spaced:
        if lexicon.plain(re.sub(r"[\W_]", "", x.lower())):
            disguised += 1
            seeds += 1
    return [
        np.log1p(count),
        seeds / n,
        seeds,
        learned / n,
        learned,
        total / n,
        float(len(strong)),
        near / n,
        said / n,
        shouted / n,
        capitals(text) / max(1, len(text)),
        text.count("!") / n,
        text.count("?") / n,
        len(_REPEATED.findall(text)) / n,
        len(_MASKED.findall(text)) / n,
        mixed / n,
        len(spaced) / n,
        disguised / n,
    ]


def matrix(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    return np.array([features(t, lexicon) for t in texts], float).reshape(-1, len(FEATURES))


def learn_lexicons(train: DataFrame, folds: int) -> list[Lexicon]:
    """Word forms whose documents are mostly toxic, by a likelihood-ratio test on document counts.

    One lexicon without the rows of each fold (the column ``fold``), and at last one from all rows.  The test alone
    decides; ``train`` is bounded by its row limit, and so is what can pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seen: dict[tuple[int, int], Counter] = {}
            for text, label, fold in zip(*(b.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                words = set(tokens(text or ""))
                seen.setdefault((fold, label), Counter()).update(words.union(*({"^" + w[:k] for w in words if len(w) > k} for k in BEGINNINGS)))
            rows = [(form, fold, n * (label > 0), n * (label == 0)) for (fold, label), c in seen.items() for form, n in c.items()]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["form", "fold", "pos", "neg"])

    sizes = {(r["fold"], r["label"]): r["n"] for r in train.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    counted = train.select("text", "label", "fold").mapInArrow(tidy(count), "form string, fold long, pos long, neg long").groupBy("form").agg(
        *(F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(folds) for c in ("pos", "neg")), *(F.sum(c).alias(f"{c}{folds}") for c in ("pos", "neg"))
    )
    passes = []
    for k in range(folds + 1):
        toxic, clean = (sum(n for (fold, label), n in sizes.items() if fold != k and label == wanted) for wanted in (1, 0))
        p0, pos, neg = toxic / max(1, toxic + clean), F.col(f"pos{k}"), F.col(f"neg{k}")
        share = pos / (pos + neg)
        ratio = 2 * (pos * F.log(share / p0) + F.when(neg > 0, neg * F.log((1 - share) / (1 - p0))).otherwise(0.0)) if toxic and clean else F.lit(None).cast("double")
        passes.append(F.coalesce(F.when(pos > 0, (share >= max(0.5, p0)) & (ratio >= LEAST_RATIO)), F.lit(False)).alias(f"in{k}"))
    strong = counted.select("*", *passes).filter(" OR ".join(f"in{k}" for k in range(folds + 1))).orderBy("form").collect()
    return [Lexicon({r["form"]: float(np.log((r[f"pos{k}"] + 0.5) / (r[f"neg{k}"] + 0.5))) for r in strong if r[f"in{k}"]}, KNOWN_WORDS // (folds + 1)) for k in range(folds + 1)]


def learn_lexicon(train: DataFrame, toxic: int, clean: int) -> Lexicon:
    """The lexicon of all rows of ``train`` (text, label), of which so many are toxic and clean."""
    return learn_lexicons(train.withColumn("fold", F.lit(-1).cast("long")), 0)[0] if toxic and clean else Lexicon({})


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, modulus: int = 4, held_out: int = 2, rows: int = TRAINING_ROWS, folds: int = 3) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out remainder; of an id with several texts the smallest.

    The calibration is learned from predictions on folds that neither the trees nor the lexicon behind their
    features had seen.
    """
    sample = labelled_sample(labels, "toxic", modulus, held_out, rows)
    train = training_rows(documents, sample).groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    train = train.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("long"))
    lexicons = learn_lexicons(train, folds)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [matrix(b.column("text").to_pylist(), lexicon) for lexicon in lexicons]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("fold"), pa.array(np.concatenate(x, 1).tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "fold", "x"])

    got = train.select("doc_id", "label", "text", "fold").mapInArrow(tidy(featurise), "doc_id long, label int, fold long, x array<double>").toPandas().sort_values("doc_id")
    each = np.array(got["x"].tolist(), float).reshape(-1, folds + 1, len(FEATURES))
    y, fold = got["label"].to_numpy(float), got["fold"].to_numpy()
    unseen = np.zeros(len(y))
    for k in range(folds):
        x = each[:, k]
        unseen[fold == k] = fit(x[fold != k], y[fold != k], trees=40).probability(x[fold == k])
    return ToxicityModel(Lexicon(lexicons[-1].forms), fit(each[:, folds], y, trees=40), isotonic(unseen, y))


def toxicity_score(model: ToxicityModel) -> Callable[[Column], Column]:
    """A column function from a text to its calibrated score; other columns of a row stay in the JVM."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda batches: (numbers(model.score, x) for x in batches))(texts)

    return lambda text: score(text.cast("string"))


def classify_toxicity(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    score = toxicity_score(fit_toxicity(documents, labels))
    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
