"""A character model that tells invented filler words from words of the corpus."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Passages of either kind that the model is fitted on at most, taken by the order of their hashes.
MOST_FILLER, MOST_OTHERS = 4_000, 20_000


def _trigrams(text: str) -> Iterator[str]:
    text = f" {text} "
    return (text[i : i + 3] for i in range(len(text) - 2))


def fit(filler: Iterable[str], others: Iterable[str]) -> tuple[dict[str, float], float]:
    """Log odds of each trigram, and of one that neither kind has; naive Bayes with a smoothing of one half."""
    a, b = Counter(g for t in filler for g in _trigrams(t)), Counter(g for t in others for g in _trigrams(t))
    kinds = len(a.keys() | b.keys()) + 1
    na, nb = sum(a.values()) + kinds / 2, sum(b.values()) + kinds / 2
    odds = {g: math.log((a[g] + 0.5) / na) - math.log((b[g] + 0.5) / nb) for g in a.keys() | b.keys()}
    return odds, math.log(0.5 / na) - math.log(0.5 / nb)


def score(text: str, odds: dict[str, float], unknown: float) -> float:
    """Mean log odds of the text's trigrams."""
    each = [odds.get(g, unknown) for g in _trigrams(text)]
    return sum(each) / len(each)


def scores(text: Column, odds: dict[str, float], unknown: float) -> Column:
    @F.pandas_udf("double")
    def values(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([score(t, odds, unknown) for t in s], dtype="float64")

    return values(text)
