"""Quality classifier: histogram gradient-boosted trees over document statistics.

Rows and edge cases: a null text counts as empty and is scored like one; a null id is never
held out; repeated rows are scored each; other columns of the input are ignored.  With no
usable label the score is the constant 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import id_remainder, numbers, slices, tidy
from lucerna.llm.gbdt import Forest, fit

#: At most so many labelled rows, chosen by a hash of their id, are gathered to fit the trees.
TRAINING_ROWS = 20_000

FEATURES = (
    "log_chars", "log_words", "mean_word", "upper", "lower", "digit", "space", "sentence_marks", "commas",
    "bangs", "pipes", "symbols", "non_ascii", "distinct_words", "top_word", "repeated_trigrams", "repeated_lines",
    "log_lines", "words_per_line", "shouted_words", "symbol_ended_words", "short_words", "longest_word", "repeated_halves",
)


def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    of = lambda chars: np.isin(code, list(chars.encode()))
    return {
        "upper": (code >= 65) & (code <= 90),
        "lower": (code >= 97) & (code <= 122),
        "digit": (code >= 48) & (code <= 57),
        "space": of(" \t\r\n\v\f"),
        "sentence_marks": of(".?"),
        "commas": of(",;:"),
        "bangs": of("!"),
        "pipes": of("|"),
        "symbols": of("#$%&*+<>=@\\^_~{}[]/"),
        "non_ascii": code >= 128,
    }


_CLASSES = _classes()
_CLASS_ROWS = np.stack([v for v in _CLASSES.values()]).astype(float)
_SYMBOLS = tuple("#$%&*!")


def features(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of :data:`FEATURES`."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    classes = (_CLASS_ROWS @ counts / n).tolist()
    words = (text or "").split()
    w = max(1, len(words))
    tally = Counter(words)
    trigrams = len(words) - 2
    seen = len(set(zip(words, words[1:], words[2:], strict=False))) if trigrams > 0 else 0
    lines = [x for x in (text or "").split("\n") if x.strip()]
    distinct_lines = sum(map(len, set(lines)))
    half = len(words) // 2
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        sum(map(len, words)) / w,
        *classes,
        len(tally) / w,
        max(tally.values(), default=0) / w,
        1 - seen / trigrams if trigrams > 0 else 0.0,
        1 - distinct_lines / max(1, sum(map(len, lines))),
        np.log1p(len(lines)),
        w / max(1, len(lines)),
        sum(c for x, c in tally.items() if len(x) > 1 and x.isupper()) / w,
        sum(c for x, c in tally.items() if x.endswith(_SYMBOLS)) / w,
        sum(c for x, c in tally.items() if len(x) <= 2) / w,
        np.log1p(max(map(len, tally), default=0)),
        len(set(words[:half]) & set(words[half:])) / max(1, len(tally)),
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = _matrix(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def labelled_sample(labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """At most ``rows`` (doc_id, label) outside the held-out remainder; an id with several labels takes the largest."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.filter(F.col("label").isin(0, 1) & (id_remainder(F.col("doc_id"), modulus) != held_out))
    return usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_rows(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """Whole texts of the sampled ids.  The sample is bounded by its row limit, so it is broadcast."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")


def fit_quality(documents: DataFrame, labels: DataFrame, *, modulus: int = 3, held_out: int = 1, rows: int = TRAINING_ROWS) -> Forest:
    """Fit on at most ``rows`` labelled documents outside the held-out remainder."""
    train = training_rows(documents, labelled_sample(labels, "quality", modulus, held_out, rows))
    got = train.mapInArrow(tidy(_featurise), "doc_id long, label int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = got["label"].to_numpy(float)
    return fit(x, y) if len(x) else Forest(np.zeros((1, 1), np.int32), np.full((1, 1), np.inf), np.zeros((1, 2)), 0.0, 1)


def quality_score(forest: Forest) -> Callable[[Column], Column]:
    """A column function from a text to its score; other columns of a row stay in the JVM."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda batches: (numbers(lambda part: forest.probability(_matrix(part)), x) for x in batches))(texts)

    return lambda text: score(text.cast("string"))


def classify_quality(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    score = quality_score(fit_quality(documents, labels))
    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
