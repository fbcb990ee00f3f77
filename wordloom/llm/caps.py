"""Near-duplicates of embeddings by spherical-cap filters (locality-sensitive filters; Becker, Ducas, Gama, Laarhoven, 2016).

A product code is a random rotation and a code book of random directions for each half of the turned vector; a filter is a
pair of its code words, and its score is the sum of the two inner products, a standard normal number for a unit vector. A
vector joins all filters whose score exceeds ``CAP``: list decoding sorts one half's scores and, for each word of the other
half, takes the words that still reach it. ``CODES`` independent codes level out how many filters a vector gets. Vectors that
share a filter are compared by cosine in double precision. Two vectors of cosine 0.9 share about 18 filters (none of 400
simulated pairs shared none); a link is counted in its smallest common filter only.

Equal vectors count once, with their number. A filter with more than ``BLOCK`` vectors is dealt into blocks, and pairs of
blocks are compared in tasks of their own; per filter only counts and a spanning forest of the links leave a task, never pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own
component. Vectors of different length never link. Where ids are null or repeat, components are named by row keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import column, components, keyed
from wordloom.sources.scratch import materialise

COSINE = 0.9
#: Score that a filter asks for, codes, and code words per half: 16 x 64 x 64 filters, about 43 of them for a vector.
CAP, CODES, WORDS = 3.2, 16, 64
BLOCK = 1024


def code_books(dim: int, codes: int, words: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two halves' code books of each code, already turned back by its rotation: scores are inner products with the vector."""
    rng, half, out = np.random.default_rng([seed, dim]), dim // 2, []
    for _ in range(codes):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        out.append((turn[:, :half] @ rng.normal(size=(half, words)), turn[:, half:] @ rng.normal(size=(dim - half, words))))
    return out


def list_decode(x: np.ndarray, books: list[tuple[np.ndarray, np.ndarray]], cap: float) -> list[np.ndarray]:
    """For each unit vector, the sorted numbers of all filters whose score exceeds ``cap``."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(x))]
    for code, (one, two) in enumerate(books):
        left, right = x @ one, x @ two
        words = right.shape[1]
        order = np.argsort(-right, axis=1)
        for i in range(len(x)):
            ranked = right[i, order[i]]
            first = np.flatnonzero(left[i] >= cap - ranked[0])
            many = np.searchsorted(-ranked, left[i, first] - cap, "right")
            out[i] += [(code * words + f) * words + order[i, :m] for f, m in zip(first, many)]
    return [np.sort(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in out]


def filtered(vectors: DataFrame, cap: float, codes: int, words: int, seed: int) -> DataFrame:
    """row_key, copies, dim, vec (its bytes), filters (numbers), packed (the same, sorted, as bytes)."""
    single = dict(vectors.dtypes)["vec"] == "array<float>"
    small = np.min_scalar_type(codes * words * words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            vec = [np.array(v, np.float32 if single else np.float64) for v in column(batch, "vec")]
            filters: list[np.ndarray] = [np.zeros(0, np.int64)] * len(vec)
            for dim in {len(v) for v in vec}:
                if dim not in books:
                    books[dim] = code_books(dim, codes, words, seed)
                mine = [i for i, v in enumerate(vec) if len(v) == dim]
                x = np.stack([vec[i] for i in mine]).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i, found in zip(mine, list_decode(x, books[dim], cap)):
                    filters[i] = found
            made = [
                pa.array([len(v) for v in vec], pa.int32()),
                pa.array([v.tobytes() for v in vec], pa.binary()),
                pa.array(filters, pa.list_(pa.int32())),
                pa.array([f.astype(small).tobytes() for f in filters], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("row_key", "copies")), *made], names=["row_key", "copies", "dim", "vec", "filters", "packed"])

    return vectors.select("row_key", "copies", "vec").mapInArrow(run, "row_key long, copies long, dim int, vec binary, filters array<int>, packed binary")


def linked(rows: list[dict], cosine: float, kind: np.dtype, small: np.dtype) -> list[tuple[int, int, int]]:
    """(row key, smallest row key linked through these rows, copies linked) from the pairs whose smallest common filter this is."""
    x = np.stack([np.frombuffer(r["vec"], kind) for r in rows]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    side = np.array([r["side"] for r in rows])
    if side.any():  # rows of two blocks: pairs within one are compared elsewhere
        near &= side[:, None] != side[None, :]
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return []
    near = near[np.ix_(some, some)]
    earlier = [np.frombuffer(rows[i]["packed"], small) for i in some]
    earlier = [e[: np.searchsorted(e, rows[0]["filter"])] for e in earlier]
    known, place = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(known):
        member = np.zeros((len(some), len(known)), np.float32)
        member[np.repeat(np.arange(len(some)), [len(e) for e in earlier]), place] = 1
        near &= member @ member.T == 0
    copies = np.array([rows[i]["copies"] for i in some], np.int64)
    keys = np.array([rows[i]["row_key"] for i in some], np.int64)
    root = keys.copy()
    while True:
        # Each vector takes the smallest key among its neighbours' and its own, until none changes.
        least = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == root).all():
            break
        root = least
    count = near @ copies
    return [(int(k), int(r), int(n)) for k, r, n in zip(keys, root, count) if n]


def compare(buckets: DataFrame, cosine: float, kind: type, small: np.dtype) -> DataFrame:
    """a, b (a link or a itself), links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows):
            found = linked(rows, cosine, kind, small) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["a", "b", "links"])

        held, last = [], None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["dim"], row["filter"], row["pair"])
                if key != last and held:
                    yield result(held)
                    held = []
                held.append(row)
                last = key
        if held:
            yield result(held)

    dealt = buckets.repartition(F.col("dim"), F.col("filter"), F.col("pair")).sortWithinPartitions("dim", "filter", "pair")
    return dealt.mapInArrow(run, "a long, b long, links long")


def near_duplicates(
    table: DataFrame,
    vec_col: str = "embedding",
    id_col: str = "vec_id",
    cosine: float = COSINE,
    cap: float = CAP,
    codes: int = CODES,
    words: int = WORDS,
    block: int = BLOCK,
    seed: int = 42,
) -> DataFrame:
    """One row per vector: row_key, id, n_links (other vectors linked with it), component, kept."""
    rows = keyed(table, id_col, {"vec": vec_col})
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fine = F.col("vec").isNotNull() & (F.size("vec") > 1) & finite & F.exists("vec", lambda v: v != 0)
    good = rows.where(fine)
    classes = good.groupBy("vec").agg(F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("copies"))
    drawn = materialise(filtered(classes, cap, codes, words, seed), "filters")

    each = drawn.select("dim", F.explode("filters").alias("filter"))
    sizes = materialise(each.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "filter-sizes")
    parts = F.ceil(F.col("n") / block).cast("int")
    placed = drawn.withColumn("filter", F.explode("filters")).join(sizes, ["dim", "filter"])
    mine = F.pmod(F.xxhash64("row_key"), parts).cast("int")
    given = ["dim", "filter", "row_key", "copies", "vec", "packed"]
    placed = placed.select(*given, parts.alias("parts"), mine.alias("mine"))
    # A block meets itself (side 0) and every other block once: the pair is named by both, sides -1 and 1 tell them apart.
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pair = F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")
    placed = placed.select(*given, pair.cast("long").alias("pair"), F.signum(F.col("mine") - F.col("other")).cast("int").alias("side"))
    kind = np.float32 if dict(rows.dtypes)["vec"] == "array<float>" else np.float64
    found = materialise(compare(placed, cosine, kind, np.min_scalar_type(codes * words * words)), "cap-links")

    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    members = rows.join(classes.select("vec", F.col("row_key").alias("rep"), "copies").hint("merge"), "vec", "left")
    members = members.select("row_key", "id", F.coalesce("rep", "row_key").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    out = members.join(links, "rep", "left").join(named, "rep", "left")
    out = out.select("row_key", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return out.withColumn("kept", F.col("component") == F.col("row_key"))
