"""Near-duplicates of documents by DartMinHash (Christiani, 2020) over weighted shingles of five words.

A document is a weighted set: its shingles with their counts. Every shingle owns an endless stream of darts that depends on
its hash alone: each dart has a rank, a place on the weight axis and a coordinate. The weight axis is cut into regions
[2^v - 1, 2^(v+1) - 1); in a region the ranks are a Poisson process, drawn in rising order, so a long document stops after the
first dart of most shingles. A dart counts where the shingle's weight reaches its place; a document's signature keeps the
earliest dart of each coordinate. Two signatures agree in a coordinate with a chance equal to the weighted Jaccard similarity.

``BANDS`` bands of ``ROWS`` coordinates give buckets. Exact copies (equal word sequences) count once before that. In every
bucket the members are compared with one leader, the member with the fewest shingles of its own; pairs are verified on the
whole texts. Then, in buckets that still hold several components, the members outside the leader's component are compared
with the others, unless bounds on what the two can have in common rule the pair out: shingles that no other crowded document
has, and the rest summed up in cells. The bounds are exact, so no link is given up, and a
group of copies makes few pairs.

Defined results: a text without words (null, empty, blank) is alone in its class. A text of one to four words is one shingle.
Repeated rows are copies. The class id is the smallest row key of the class (the id, where ids are unique and not null).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import column, components, join_rows, keyed, slices
from wordloom.llm.hashing import Powers, in_text, mix, ngrams, words_of
from wordloom.sources.scratch import materialise

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Buckets with more members look at the members' own shingles before pairs are made.
CROWD = 32
#: Numbers that sum up a crowded text's shared shingles. Edits fall into different cells, so two copies with different edits
#: are told apart without reading them.
CELLS = 64


def shingles(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), sorted by text and hash."""
    words, first, _ = words_of(texts, powers)
    at = in_text(first, WORDS)
    grams, owner = ngrams(words, WORDS)[at] if len(at) else np.zeros(0, np.uint64), np.searchsorted(first, at, "right") - 1
    lengths = np.diff(first)
    short = np.flatnonzero((lengths > 0) & (lengths < WORDS))
    own = [mix(ngrams(words[first[i] : first[i + 1]], int(lengths[i])) + np.uint64(lengths[i])) for i in short]
    grams, owner = np.concatenate([grams, *own]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], grams[at], np.diff(np.concatenate([at, [len(grams)]]))


def signatures(owner: np.ndarray, grams: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates of ``n`` texts, as dart ids (0 for texts without shingles)."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights, n)
    open_texts = total > 0
    margin = 2.0
    while open_texts.any():
        reach = np.zeros(n)
        reach[open_texts] = (np.log(k) + margin) / total[open_texts]
        earliest = np.full(n * k, np.inf)
        darts = []
        chosen = open_texts[owner]
        for region in range(int(weights.max()).bit_length()):
            low, width = (1 << region) - 1, 1 << region
            here = np.flatnonzero(chosen & (weights > low))
            who, seed = owner[here], mix(grams[here] + np.uint64(region * 2 + 1))
            limit, rank, weight = reach[who], np.zeros(len(here)), weights[here]
            dart = 0
            while len(who):
                dart += 1
                draw = mix(seed + np.uint64(dart * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                rank = rank - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (k * width)
                alive = rank < limit
                if not alive.all():
                    who, seed, limit, rank, weight, draw = (x[alive] for x in (who, seed, limit, rank, weight, draw))
                second = mix(draw + np.uint64(0x632BE59BD9B4E019))
                place = low + width * ((second >> np.uint64(40)).astype(np.float64) / 2.0**24)
                hit = place < weight
                cell = who[hit] * k + ((second[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
                np.minimum.at(earliest, cell, rank[hit])
                darts.append((cell, rank[hit], second[hit] | np.uint64(1)))
        flat = out.reshape(-1)
        for cell, rank, name in darts:
            first = rank == earliest[cell]
            flat[cell[first]] = name[first]
        open_texts &= (out == 0).any(axis=1)
        out[open_texts] = 0
        margin *= 2
    return out


def sketch(rows: DataFrame, bands: int, depth: int) -> DataFrame:
    """row_key, id, content (digest of the word sequence; null without words), weight, buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            content, weight, buckets = [], [], []
            for texts in slices(column(batch, "text")):
                owner, grams, weights = shingles(texts, powers)
                found = signatures(owner, grams, weights, len(texts), bands * depth)
                total = np.bincount(owner, weights, len(texts)).astype(np.int64)
                grid = found.reshape(len(texts), bands, depth)
                mixed = np.zeros((len(texts), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                for j in range(depth):
                    mixed = mix(mixed + grid[:, :, j])
                for i, text in enumerate(texts):
                    weight.append(int(total[i]))
                    content.append(blake2b(b" ".join(text.split()), digest_size=16).digest() if total[i] else None)
                    buckets.append(mixed[i].view(np.int64) if total[i] else [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("row_key", "id")), pa.array(content, pa.binary()), pa.array(weight, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["row_key", "id", "content", "weight", "buckets"],
            )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"row_key long, id {kind}, content binary, weight long, buckets array<long>")


def shared_weights(texts: DataFrame) -> DataFrame:
    """row_key, own (total count of the shingles that no other of these texts has), cells (the other shingles' counts, summed
    by a hash of the shingle into ``CELLS`` numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = np.array(column(batch, "row_key"), np.int64)
            at = 0
            for some in slices(column(batch, "text")):
                owner, grams, weights = shingles(some, powers)
                yield pa.RecordBatch.from_arrays([pa.array(keys[owner + at]), pa.array(grams.view(np.int64)), pa.array(weights.astype(np.int64))], names=["row_key", "gram", "n"])
                at += len(some)

    each = materialise(texts.select("row_key", "text").mapInArrow(run, "row_key long, gram long, n long"), "crowded-shingles")
    cell = F.pmod("gram", F.lit(CELLS)).cast("int").alias("cell")
    single = each.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"), F.min("row_key").alias("row_key"), F.sum("n").alias("n"))
    # A text has at most CELLS rows here. Its own shingles are added to the others by a sum, without a join.
    single = single.where("texts = 1").select("row_key", cell, F.lit(0).cast("bigint").alias("n"), F.col("n").alias("own"))
    total = each.select("row_key", cell, "n", F.lit(0).cast("bigint").alias("own"))
    both = total.unionByName(single).groupBy("row_key", "cell").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    entries = F.map_from_entries(F.collect_list(F.struct("cell", (F.col("n") - F.col("own")).cast("int"))))
    found = both.groupBy("row_key").agg(F.sum("own").alias("own"), entries.alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)))
    return found.select("row_key", "own", cells.alias("cells"))


def verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of row keys, those whose whole texts have the weighted Jaccard similarity, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, known = Powers(), {}

        def weighted(key, text):
            if key not in known:
                if len(known) > 64:
                    known.clear()
                known[key] = shingles([text.encode()], powers)[1:]
            return known[key]

        for batch in batches:
            a, b = column(batch, "a"), column(batch, "b")
            good = []
            for x, y, p, q in zip(a, b, column(batch, "text_a"), column(batch, "text_b")):
                (g, m), (h, n) = weighted(x, p), weighted(y, q)
                _, i, j = np.intersect1d(g, h, assume_unique=True, return_indices=True)
                common = np.minimum(m[i], n[j]).sum()
                good.append(bool(common >= similarity * (m.sum() + n.sum() - common)))
            mask = np.array(good, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[mask]), pa.array(np.array(b, np.int64)[mask])], names=["a", "b"])

    text = rows.select(F.col("row_key").alias("a"), F.col("text").alias("text_a"))
    other = rows.select(F.col("row_key").alias("b"), F.col("text").alias("text_b"))
    held = pairs.join(other.hint("merge"), "b").join(text.hint("merge"), "a")
    return held.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def possible(similarity: float) -> Column:
    """Whether the weights leave room for the similarity: two texts have no more in common than the smaller of what each
    shares with any text, and no more than that in any cell."""
    common = F.least(F.col("weight_a") - F.col("own_a"), F.col("weight_b") - F.col("own_b"))
    by_cell = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    common = F.least(common, F.coalesce(by_cell, common))
    return common >= similarity * (F.col("weight_a") + F.col("weight_b") - common)


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    depth: int = ROWS,
) -> DataFrame:
    """One row per document: row_key, id, class_key (smallest row key of its class), kept (the class's first document)."""
    rows = keyed(docs, id_col, {"text": text_col})
    drawn = materialise(sketch(rows, bands, depth), "sketches")
    copies = materialise(drawn.where("content IS NOT NULL").groupBy("content").agg(F.min("row_key").alias("rep")), "copies")
    reps = drawn.join(copies.select(F.col("rep").alias("row_key")), "row_key", "left_semi")

    spread = reps.select("row_key", "weight", F.explode("buckets").alias("bucket"))
    # Written tables on both sides of a join let Spark split the partition of a crowded bucket.
    shared = materialise(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = materialise(spread.join(shared.hint("merge"), "bucket"), "members")
    crowded = materialise(members.where(f"n > {CROWD}").select("row_key").distinct(), "crowded")
    shares = materialise(shared_weights(join_rows(rows, crowded, "row_key", "left_semi")), "shares")
    crowd = F.col("n") > CROWD
    members = members.join(shares.hint("merge"), "row_key", "left")
    members = members.withColumn("own", F.when(crowd, F.coalesce("own", F.lit(0))).otherwise(0)).withColumn("cells", F.when(crowd, F.col("cells")))
    members = materialise(members.where(F.col("weight") - F.col("own") >= similarity * F.col("weight")), "members")
    leaders = members.groupBy("bucket").agg(F.min(F.struct("own", "row_key", "weight", "cells")).alias("l"))
    leaders = leaders.select("bucket", F.col("l.row_key").alias("a"), *[F.col(f"l.{c}").alias(f"{c}_a") for c in ("own", "weight", "cells")])
    b = members.select("bucket", F.col("row_key").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("own", "weight", "cells")])
    leaders = materialise(leaders, "leaders")
    star = b.join(leaders.hint("merge"), "bucket").where("a <> b").where(possible(similarity))
    star = materialise(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = materialise(verified(star, rows, similarity), "links")
    parts = materialise(components(links), "components")

    placed = members.join(parts.withColumnRenamed("node", "row_key"), "row_key", "left").withColumn("component", F.coalesce("component", "row_key"))
    placed = materialise(placed, "placed")
    lead = placed.select("bucket", F.col("row_key").alias("a"), F.col("component").alias("main")).join(leaders.select("bucket", "a"), ["bucket", "a"])
    lead = materialise(lead.select("bucket", "main"), "leads")
    outside = placed.join(lead.hint("merge"), "bucket").where("component <> main")
    known = ("own", "weight", "cells")
    left = outside.select("bucket", "main", F.col("row_key").alias("a"), F.col("component").alias("comp_a"), *[F.col(c).alias(f"{c}_a") for c in known])
    right = placed.select("bucket", F.col("row_key").alias("b"), F.col("component").alias("comp_b"), *[F.col(c).alias(f"{c}_b") for c in known])
    more = left.hint("merge").join(right, "bucket").where("comp_a <> comp_b AND (comp_b = main OR a < b)").where(possible(similarity))
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(star.hint("merge"), ["a", "b"], "left_anti")
    found = materialise(verified(materialise(more, "pairs"), rows, similarity), "links")
    if not found.isEmpty():
        parts = materialise(components(links.unionByName(found)), "components")

    named = drawn.select("row_key", "id", "content").join(copies.hint("merge"), "content", "left")
    named = named.withColumn("rep", F.coalesce("rep", "row_key")).join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    named = named.withColumn("class_key", F.coalesce("component", "rep"))
    return named.select("row_key", "id", "class_key", (F.col("class_key") == F.col("row_key")).alias("kept"))
