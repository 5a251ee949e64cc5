"""Sentence BLEU-4 of whole columns as an Arrow function (Papineni et al. 2002; smoothing 4 of Chen and Cherry 2014)."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def sentence_bleu(candidate: str | None, reference: str | None) -> float:
    """0 for blank texts or no common word; zero precisions of longer n-grams are replaced by shrinking small ones."""
    c, r = (candidate or "").split(), (reference or "").split()
    if not c or not r:
        return 0.0
    logs, shrink = 0.0, 1
    for n in range(1, 5):
        have = Counter(tuple(c[i : i + n]) for i in range(len(c) - n + 1))
        want = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        hits, total = sum((have & want).values()), max(1, len(c) - n + 1)
        if not hits:
            if n == 1:
                return 0.0
            if len(c) > 1:
                hits = 1 / (2**shrink * 5 / math.log(len(c)))
                shrink += 1
        if not hits:
            return 0.0
        logs += math.log(hits / total) / 4
    return math.exp(logs) * (1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c)))


@F.pandas_udf(DoubleType())
def bleu(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([sentence_bleu(a, b) for a, b in zip(candidate, reference, strict=True)])
