"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its byte 2-, 3- and 4-grams (lower case; whatever is no letter counts as a space,
which may only stand at a gram's end), hashed into ``BUCKETS`` rows. Training is stochastic gradient descent in numpy on a
sample of labelled rows: about ``per_language`` rows of every language, drawn by a hash of the id. A fifth of it sets the
temperature of the softmax and the confidence below which a prediction is rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected. Rows with a null label or id
train nothing. A table without labelled rows gives ``und`` everywhere. Repeated rows are judged alike. Columns of the input
named as the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import slices
from wordloom.llm.hashing import joined

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

_SPACED = np.arange(256, dtype=np.uint32)
for _b in range(128):
    if not chr(_b).isalpha():
        _SPACED[_b] = 32


@dataclass
class LanguageModel:
    languages: list[str]
    #: Embeddings times output weights: what each bucket adds to each language's logit.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def gram_buckets(data: np.ndarray) -> list[np.ndarray]:
    """For every gram size, the bucket of the gram at each byte, or -1 where none starts."""
    code = _SPACED[data]
    space = code == 32
    out = []
    for n in SIZES:
        size = len(code) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint32)
        bad = np.zeros(size, bool)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h += code[j : j + size]
            if 0 < j < n - 1 or n == 2:
                bad |= space[j : j + size]
        h *= np.uint32(0x9E3779B1)
        found = (h >> np.uint32(18)).astype(np.int32)
        found[bad] = -1
        out.append(found)
    return out


def gram_counts(texts: Iterator[list[bytes]]) -> Iterator[np.ndarray]:
    """Counts of the buckets of each text."""
    for some in texts:
        data, offsets = joined([b" " + t.decode().lower().encode() for t in some])
        grams = gram_buckets(data)
        for low, high in zip(offsets[:-1], offsets[1:]):
            counts = np.zeros(BUCKETS + 1, np.int64)
            for n, found in zip(SIZES, grams):
                part = found[low : max(low, high - n + 1)]
                counts += np.bincount(part + 1, minlength=BUCKETS + 1)
            yield counts[1:]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(features: np.ndarray, target: np.ndarray, languages: list[str], dim: int, epochs: int, seed: int) -> LanguageModel:
    """SGD over mini-batches of 32 texts with step sizes per coordinate, classes weighted to the same total."""
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weights = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    order = rng.permutation(len(target))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    share = np.bincount(target[train], minlength=len(languages)).clip(1)
    importance = (len(train) / len(languages) / share)[target].astype(np.float32)
    state = [np.full_like(p, 1e-8) for p in (embeddings, weights, bias)]
    for epoch in range(epochs):
        step = 0.2 * (1 - epoch / epochs)
        for at in range(0, len(train), 32):
            rows = rng.permutation(train)[:32] if at == 0 and epoch == 0 else train[at : at + 32]
            x = features[rows]
            hidden = x @ embeddings
            grad = softmax(hidden @ weights + bias)
            grad[np.arange(len(rows)), target[rows]] -= 1
            grad *= importance[rows, None] / len(rows)
            moves = (x.T @ (grad @ weights.T), hidden.T @ grad, grad.sum(axis=0))
            for p, s, g in zip((embeddings, weights, bias), state, moves):
                s += g * g
                p -= step * g / np.sqrt(s)
        rng.shuffle(train)
    table = (embeddings @ weights).astype(np.float64)
    temperature, threshold = 1.0, 0.0
    if len(held):
        logits = features[held] @ table + bias
        grid = np.exp(np.linspace(-2.5, 2.5, 51))
        loss = [-np.log(softmax(logits / t)[np.arange(len(held)), target[held]] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        sure = softmax(logits / temperature).max(axis=1)
        # At most a thousandth of the held-out texts may be turned away, and never one with an even chance.
        threshold = float(min(0.5, np.quantile(sure, 0.001)))
    return LanguageModel(languages, table, bias.astype(np.float64), temperature, threshold)


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    per_language: int = 500,
    dim: int = 16,
    epochs: int = 6,
    seed: int = 42,
) -> LanguageModel:
    """Learn from labelled rows. ``per_language`` bounds the rows taken of each language (in expectation)."""
    labelled = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{id_col}`").alias("id"))
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND id IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, per_language / counts[lang])])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < share[F.col("lang")]).select("text", "lang")

    def features(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                counts = next(gram_counts(slices([row["text"]])))
                used = np.flatnonzero(counts)
                if len(used):
                    yield pd.DataFrame({"lang": [row["lang"]], "buckets": [used.astype(np.int32).tobytes()], "n": [counts[used].astype(np.int32).tobytes()]})

    rows = sample.mapInPandas(features, "lang string, buckets binary, n binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["buckets"]), bytes(r["n"])))
    matrix = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        n = np.frombuffer(r["n"], np.int32)
        matrix[i, np.frombuffer(r["buckets"], np.int32)] = n / n.sum(dtype=np.float32)
    target = np.array([languages.index(r["lang"]) for r in rows], np.int64)
    return fit(matrix, target, languages, dim, epochs, seed)


def judgement(model: LanguageModel):
    """A function of a text column: struct of lang, score (calibrated probability) and rejected."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            counted = gram_counts(slices(texts))
            for text, counts in zip(texts, counted):
                total = counts.sum()
                if not model.languages or not total or not text or not LETTER.search(text):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                logits = (counts @ model.table / total + model.bias) / model.temperature
                chances = softmax(logits[None])[0]
                best = int(chances.argmax())
                out.append((model.languages[best], float(chances[best]), bool(chances[best] < model.threshold)))
            yield pd.DataFrame(out, columns=["lang", "score", "rejected"])

    return judge


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The table with ``lang_pred``, ``score`` and ``rejected`` for every row."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    judged = docs.select(*kept, judgement(model)(F.col(f"`{text_col}`")).alias("_judged"))
    return judged.select(*kept, F.col("_judged.lang").alias("lang_pred"), F.col("_judged.score").alias("score"), F.col("_judged.rejected").alias("rejected"))


def held_out(id_col: str = "doc_id"):
    """Documents that training must not see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Train on the table's labelled rows that are not held out, then judge every row."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    return predict(docs, model, text_col)
