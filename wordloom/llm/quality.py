"""Quality rules: base rules on counts, then robust multivariate outliers per language and source.

Statistics of a text are transformed to a short vector. Every group (language, source) gets a minimum-covariance-determinant
estimate over all its rows: from median and median deviation, concentration steps each take the mean and covariance of the
three quarters of the rows nearest by Mahalanobis distance. All of it is grouped aggregation, so a group of any size is
summed on every partition before it is shuffled. A row is judged by the group's covariance and the variance that its own
counts have by chance (``noise``), and rejected when its squared distance is beyond ``CUTOFF``.

Defined results: a null text has no words and fails the base rule. Null languages and sources are groups of their own. Groups
with fewer than ``MIN_GROUP`` rows take the estimate over all rows. Repeated rows are judged alike. Rows with fewer than 50
words are left out of the estimates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import keyed, slices
from wordloom.llm.hashing import Powers, in_text, ngrams, words_of
from wordloom.sources.scratch import materialise

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
#: Components of the vector, and the least standard deviation each is taken to have, so that a covariance has an inverse
#: where most texts have no symbol at all: below the spread of word lengths in a group, and of a share over 600 counted things.
FLOORS = {"word_length": 0.02, "symbols": 0.02, "dup_lines": 0.02, "repeats": 0.02}
#: Rows nearest to the centre that make an estimate, and concentration steps.
SHARE, STEPS = 0.75, 3
#: The nearest three quarters of a normal sample in four dimensions have 0.673 of its variance.
CONSISTENCY = 1 / 0.673
#: Squared distance: the chi-square quantile with four degrees of freedom for a chance of one in 10^9.
CUTOFF = 47.0
MIN_GROUP = 50
#: Variance of the log mean length over one word, words that one chance repeat marks, and variance of chance repeats per word.
WORD_SPREAD, CLUMP, CHANCE = 0.25, 6, 5e-7


def count_texts(texts: list[bytes], powers: Powers) -> np.ndarray:
    """The ``COUNTS`` of each text."""
    words, first, (data, starts, ends) = words_of(texts, powers)
    n = len(texts)
    out = np.zeros((n, 6), np.int64)
    out[:, 0] = np.diff(first)
    # Characters: bytes that do not continue one.
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    per_word = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
    out[:, 1] = np.diff(per_word[first])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for i, text in enumerate(texts):
        out[i, 2] = symbol[np.frombuffer(text, np.uint8)].sum() if text else 0
        lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 4] = len(lines)
    at = in_text(first, 3)
    if len(at):
        grams = ngrams(words, 3)[at]
        owner = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((grams, owner))
        g, o = grams[order], owner[order]
        same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(g), bool)
        twice[1:] |= same
        twice[:-1] |= same
        marked = np.zeros(len(words) + 3, np.int64)
        np.add.at(marked, at[order[twice]], 1)
        np.add.at(marked, at[order[twice]] + 3, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(marked)[: len(words)] > 0)])
        out[:, 5] = np.diff(covered[first])
    return out


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with a struct ``counts``."""

    @F.pandas_udf(COUNTS)
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        names = [c.split()[0] for c in COUNTS.split(", ")]
        for texts in parts:
            rows = [count_texts(some, powers) for some in slices(texts)]
            yield pd.DataFrame(np.concatenate(rows) if rows else np.zeros((0, 6), np.int64), columns=names)

    return docs.withColumn("counts", count(F.col(f"`{text_col}`")))


def base_failed(c: str = "counts") -> Column:
    return (F.col(f"{c}.n_words") < 50) | (100 * F.col(f"{c}.n_repeat_words") > 50 * F.col(f"{c}.n_words"))


def vector(c: str = "counts") -> list[Column]:
    """Mean word length without symbols (log), and the shares of symbols, repeated lines and repeated words (square root)."""
    n = F.greatest(F.col(f"{c}.n_words"), F.lit(1)).cast("double")
    plain = F.greatest(F.col(f"{c}.word_chars") - F.col(f"{c}.n_symbols"), F.lit(0))
    return [
        F.log1p(plain / n).alias("word_length"),
        F.sqrt(F.col(f"{c}.n_symbols") / n).alias("symbols"),
        F.sqrt(F.col(f"{c}.n_dup_lines") / F.greatest(F.col(f"{c}.n_lines"), F.lit(1))).alias("dup_lines"),
        F.sqrt(F.col(f"{c}.n_repeat_words") / n).alias("repeats"),
    ]


def noise(c: str = "counts") -> list[Column]:
    """Variances of the components of ``vector`` by chance: the root of a share of n has 1 / 4n, whatever the share."""
    n = F.greatest(F.col(f"{c}.n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col(f"{c}.n_lines"), F.lit(1)).cast("double")
    return [WORD_SPREAD / n, 0.25 / n, 0.25 / lines, 0.25 * CLUMP / n + CHANCE * n]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and covariance of the vectors of each group."""
    names = list(FLOORS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [F.avg(a).alias(f"m_{a}") for a in names] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def _invert(moments: DataFrame, keys: list[str], consistency: float) -> DataFrame:
    """Centre and inverse covariance of each group, one row each; the floors keep it invertible."""
    names, d = list(FLOORS), len(FLOORS)
    floor = np.diag([v * v for v in FLOORS.values()])

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for r in part.to_dict("records"):
                cov = np.zeros((d, d))
                for i, a in enumerate(names):
                    for j in range(i, d):
                        cov[i, j] = cov[j, i] = r[f"c_{a}_{names[j]}"] * consistency
                rows.append(np.linalg.inv(cov + floor).ravel().tolist())
            yield part[[*keys, "n"]].assign(centre=[[r[f"m_{a}"] for a in names] for r in part.to_dict("records")], inverse=rows)

    kinds = dict(moments.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, centre array<double>, inverse array<double>"])
    return moments.mapInPandas(invert, schema)


def distance(centre: str, inverse: str) -> Column:
    names, d = list(FLOORS), len(FLOORS)
    gap = [F.col(a) - F.col(centre)[i] for i, a in enumerate(names)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            total = total + gap[i] * gap[j] * F.col(inverse)[i * d + j]
    return total


def noisy_distance(values: Column, variances: Column, centre: Column, inverse: Column) -> Column:
    """As ``distance``, with the row's own variances added to the covariance."""
    d = len(FLOORS)

    @F.pandas_udf("double")
    def measure(values: pd.Series, variances: pd.Series, centre: pd.Series, inverse: pd.Series) -> pd.Series:
        v, own, c, inv = (np.array(x.tolist(), float).reshape(-1, *shape) for x, shape in ((values, (d,)), (variances, (d,)), (centre, (d,)), (inverse, (d, d))))
        total = np.linalg.inv(inv) + own[:, :, None] * np.eye(d)
        return pd.Series(((v - c) * np.linalg.solve(total, (v - c)[:, :, None])[:, :, 0]).sum(axis=1))

    return measure(values, variances, centre, inverse)


def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The estimate of each group of a written table of vectors: keys, n, centre, inverse."""
    names = list(FLOORS)
    middle = rows.groupBy(*keys).agg(*[F.percentile_approx(a, 0.5).alias(f"m_{a}") for a in names])
    near = rows.join(materialise(middle, "middles"), keys)
    spread = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.first(f"m_{a}").alias(f"m_{a}") for a in names],
        *[F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5).alias(f"s_{a}") for a in names],
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    square = {a: F.pow(1.4826 * F.col(f"s_{a}"), F.lit(2)) for a in names}
    start = spread.select(*keys, "n", *[f"m_{a}" for a in names], *[(square[a] if a == b else F.lit(0.0)).alias(f"c_{a}_{b}") for a, b in pairs])
    now = materialise(_invert(start, keys, 1.0), "estimate")
    for step in range(STEPS):
        measured = rows.join(now, keys).withColumn("d2", distance("centre", "inverse"))
        limit = measured.groupBy(*keys).agg(F.percentile_approx("d2", SHARE, 1000).alias("limit"))
        inner = measured.drop("n", "centre", "inverse").join(materialise(limit, "limits"), keys).where("d2 <= limit")
        now = materialise(_invert(_moments(inner, keys), keys, CONSISTENCY), "estimate")
    return now


def judge(docs: DataFrame, text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id") -> DataFrame:
    """One row per document: row_key, id, counts, base_failed, d2 (squared distance), kept."""
    keys = [f"g_{i}" for i in range(len(group_cols))]
    rows = keyed(docs, id_col, {"text": text_col, **dict(zip(keys, group_cols))})
    rows = rows.select("row_key", "id", "text", *[F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(k) for k in keys])
    # One value in all rows, but a column like the others: the estimate over all rows is that of one group.
    counted = with_counts(rows).select("row_key", "id", *keys, "counts", *vector(), F.lit(0).alias("whole"))
    counted = materialise(counted, "counts").withColumn("base_failed", base_failed())
    good = counted.where("counts.n_words >= 50").select(*keys, "whole", *FLOORS)
    by_group = estimates(good, keys).where(f"n >= {MIN_GROUP} * {SHARE}")
    whole = estimates(good, ["whole"]).first()
    out = counted.join(by_group.drop("n"), keys, "left")
    if whole:
        own = [F.coalesce(name, F.array(*[F.lit(x) for x in whole[name]])) for name in ("centre", "inverse")]
        out = out.withColumn("d2", noisy_distance(F.array(*FLOORS), F.array(*noise()), *own))
    else:
        out = out.withColumn("d2", F.lit(0.0))
    return out.select("row_key", "id", "counts", "base_failed", "d2", (~F.col("base_failed") & (F.col("d2") <= CUTOFF)).alias("kept"))
