"""Quality classifier: evidence of a document's text, moved by what its site is like.

A logistic model gives each document's log-odds of being good. Sites are levels of columns (host,
then path, ...); each level's rate of good documents is estimated by empirical Bayes, shrunk
towards the level above by a strength that the spread between the sites themselves gives. The
document's odds are then moved from the global rate to its site's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import cut, let_go, small, tidy

#: Bound of the labelled sample the text model is fitted on.
SAMPLE_ROWS = 20_000
#: Documents below this probability of being good are rejected.
THRESHOLD = 0.5
#: A site's log-odds move a document by so much at most, so that the text decides.
MAX_SHIFT = 2.0
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0

FEATURES = (
    "log_words", "upper", "symbols", "marks", "digits", "distinct", "top_word", "same_next",
    "dup_lines", "word_length", "long_words", "short_lines", "stops", "pipes", "letters",
)


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), dtype="u1")


_LETTERS = _bytes("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_UPPER, _DIGITS, _MARKS, _STOPS = _LETTERS[26:], _bytes("0123456789"), _bytes("!?"), _bytes(".,;:!?")
_SYMBOLS = _bytes("#*$%&|<>{}^~_=+@")


def text_features(text: str | None) -> list[float]:
    """Shares and logs that don't depend on the language, of the whole text; zeros without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    plain = "".join(words)
    chars = len(plain)
    by_byte = np.bincount(_bytes(plain), minlength=256)
    letters = chars - by_byte[:128].sum() + by_byte[_LETTERS].sum()  # all beyond ASCII count
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    return [
        float(np.log1p(n)),
        by_byte[_UPPER].sum() / max(letters, 1),
        by_byte[_SYMBOLS].sum() / chars,
        by_byte[_MARKS].sum() / chars,
        by_byte[_DIGITS].sum() / chars,
        # Expected to fall with length, so set against a root of it.
        len(counts) / n**0.8,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        min(chars / n, 30.0),
        sum(map((20).__lt__, map(len, words))) / n,
        sum(map((20).__gt__, map(len, lines))) / max(len(lines), 1),
        by_byte[_STOPS].sum() / n,
        counts.get("|", 0) / n,
        letters / chars,
    ]


class TextModel:
    """Logistic regression on standardised features, with squares, by Newton steps."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0):
        self.mean = rows.mean(axis=0) if len(rows) else np.zeros(len(FEATURES))
        self.scale = rows.std(axis=0) + 1e-9 if len(rows) else np.ones(len(FEATURES))
        x = self._design(rows)
        # One pseudo-row of each class keeps a one-sided or empty sample finite.
        self.rate = (labels.sum() + 1) / (len(labels) + 2)
        self.weights = np.zeros(x.shape[1])
        self.weights[0] = np.log(self.rate / (1 - self.rate))
        penalty = np.full(x.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(30 if 0 < labels.sum() < len(labels) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            gradient = x.T @ (labels - p) - penalty * self.weights
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            self.weights += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows.reshape(-1, len(FEATURES)) - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def log_odds(self, texts: Sequence[str | None]) -> np.ndarray:
        rows = np.array([text_features(t) for t in texts], dtype=float)
        return np.clip(self._design(rows) @ self.weights, -12, 12)


def fit_text_model(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> TextModel:
    """The text model, fitted on the ``rows`` labelled documents (doc_id, quality 0/1) that come
    first in the order of a hash of their id: a bounded sample of features, not of texts. Rows
    without id or label are left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("__label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [text_features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["__label"], "x": values})

    # The sample is bounded by ``rows``.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = texts.mapInPandas(tidy(features), "doc_id long, label int, x array<double>").toPandas()
    found = found.sort_values("doc_id", kind="stable").head(2 * rows)
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return TextModel(x, found["label"].to_numpy(float))


def log_odds(text: Column | str, model: TextModel) -> Column:
    """Evidence of a column of texts."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        let_go()
        return pd.Series(model.log_odds(texts.tolist()))

    return score(text)


def _strength(sums: DataFrame, parent: Column) -> float:
    """Prior strength (pseudo-documents) of a level by the method of moments: how far the rates of
    its sites spread around the level above, beyond what their sizes explain."""
    rate = F.col("good") / F.col("n")
    found = sums.agg(
        F.sum(F.col("n") * (rate - parent) ** 2).alias("spread"),
        F.sum(parent * (1 - parent)).alias("noise"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("total"),
        F.count(F.lit(1)).alias("sites"),
    ).first()
    if not found["sites"] or not found["total"]:
        return MAX_STRENGTH
    # E[spread] = noise + between * (n - sites) roughly; between = p(1-p) / (strength + 1)
    between = max(0.0, found["spread"] - found["noise"]) / max(1.0, found["n"] - found["sites"])
    within = found["total"] / found["n"]
    if between <= within / MAX_STRENGTH:
        return MAX_STRENGTH
    return min(MAX_STRENGTH, max(MIN_STRENGTH, within / between - 1))


def site_rates(evidence: DataFrame, levels: Sequence[str], base: float) -> DataFrame:
    """Rates of good documents for every site of the last level.

    ``evidence``: (levels ..., p), p the probability of each document by its text alone. Levels are
    nested: the first by itself, then the first two, ... Sums are taken at the finest level, with
    partial sums before the shuffle, and rolled up from there. NULL is a site of its own.
    Columns: levels, n, rate (posterior of the finest level), host_rate (of the first level).
    """
    finest = cut(
        evidence.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good"))
    )
    if not finest.head(1):
        return finest.select(*levels, "n", F.lit(0.0).alias("rate"), F.lit(0.0).alias("host_rate"))
    total = finest.agg((F.sum("good") / F.sum("n")).alias("r")).first()["r"]
    rates, above = None, F.lit(float(total))
    for depth in range(1, len(levels) + 1):
        own = list(levels[:depth])
        sums = finest.groupBy(*own).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        if rates is not None:
            parents = rates.select(
                *[F.col(c).alias(f"__p{i}") for i, c in enumerate(own[:-1])],
                F.col("rate").alias("above"), "host_rate",
            )
            on = [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(own[:-1])]
            sums = sums.join(parents, on).select(*own, "n", "good", "above", "host_rate")
            above = F.col("above")
        strength = _strength(sums, above)
        rate = (F.col("good") + strength * above) / (F.col("n") + strength)
        host = F.col("host_rate") if rates is not None else rate
        rates = sums.select(*own, "n", rate.alias("rate"), host.alias("host_rate"))
    return cut(rates)


def _logit(p: Column) -> Column:
    bounded = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(bounded / (1 - bounded))


class SiteModel:
    """The fitted text model and the sites' rates of one corpus."""

    def __init__(self, docs: DataFrame, labels: DataFrame, levels: Sequence[str], rows: int):
        self.levels = list(levels)
        self.text = fit_text_model(docs, labels, rows=rows)
        p = 1 / (1 + F.exp(-log_odds("text", self.text)))
        evidence = docs.select(*self.levels, p.alias("p"))
        self.sites = site_rates(evidence, self.levels, self.text.rate)
        found = self.sites.agg(F.sum(F.col("n") * F.col("rate")) / F.sum("n")).first()[0]
        self.base = float(found) if found is not None else float(self.text.rate)

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` and a struct column ``__quality``: text_log_odds, host_rate,
        path_rate, p_good, kept."""
        renamed = [F.col(c).alias(f"__s{i}") for i, c in enumerate(self.levels)]
        sites = small(self.sites).select(*renamed, F.col("rate").alias("__rate"), F.col("host_rate").alias("__host"))
        on = [docs[c].eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(self.levels)]
        scored = docs.withColumn("__odds", log_odds("text", self.text)).join(sites, on, "left")
        rate = F.coalesce("__rate", F.lit(self.base))
        shift = _logit(rate) - _logit(F.lit(self.base))
        shift = F.greatest(F.lit(-MAX_SHIFT), F.least(F.lit(MAX_SHIFT), shift))
        p = 1 / (1 + F.exp(-(F.col("__odds") + shift)))
        empty = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)) == F.lit(False)
        quality = F.struct(
            F.col("__odds").alias("text_log_odds"),
            F.coalesce("__host", F.lit(self.base)).alias("host_rate"),
            rate.alias("path_rate"),
            F.when(empty, 0.0).otherwise(p).alias("p_good"),
            (~empty & (p >= THRESHOLD)).alias("kept"),
        )
        return scored.select(*[docs[c] for c in docs.columns], quality.alias("__quality"))


def classify(
    docs: DataFrame, labels: DataFrame, *, levels: Sequence[str] = ("source", "lang"), rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(doc_id, text_log_odds, host_rate, path_rate, p_good, kept) for every row of ``docs``
    (doc_id, text, levels ...), fitted on ``labels`` (doc_id, quality).

    ``levels`` are a site's host and path, coarse to fine; documents without URLs have their source
    as host and the language section of it as path. NULL and empty texts have probability 0 and
    aren't kept; NULL sites are sites of their own; repeated rows count as often as they come.
    Without labels everything with a text is kept at even odds or better. Labels themselves are
    learned from, never looked up.
    """
    needed = docs.select("doc_id", "text", *levels)
    scored = SiteModel(needed, labels, levels, rows).score(needed)
    return scored.select("doc_id", "__quality.*")


def keep_good(
    docs: DataFrame, labels: DataFrame, *, levels: Sequence[str] = ("source", "lang"), rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The rows that :func:`classify` keeps, all columns as they are."""
    scored = SiteModel(docs, labels, levels, rows).score(docs)
    return scored.filter("__quality.kept").select(*docs.columns)
