"""Removal of repeated word passages by a compacted, sparse De Bruijn graph.

Nodes are word ``K``-mers picked by minimizers, so the same words pick the same nodes; an edge joins two neighbouring nodes of
a text and is named by a hash of all words from the first node to the end of the second. Any window of ``window`` words holds
at least one whole edge. Edges found once are dropped by a grouped count. On the rest, two edges are merged into one path
where the first has one successor in the whole corpus and the second one predecessor; the tables of successors and
predecessors are Spark aggregates, joined back to the occurrences. A window inside one compacted path is repeated. The windows
that are made of repeated edges but cross a branching are read again at their source coordinates and compared by two
independent 64-bit hashes of their words.

Defined results: null, empty and blank texts have no words. Texts shorter than the window lose nothing. Repeated rows repeat
each other, so all their windows go. Nothing is capped: a text of any length is worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import column, join_rows, keyed, slices
from wordloom.llm.hashing import Powers, in_text, minimizers, mix, ngrams, word_hashes, words_of
from wordloom.sources.scratch import materialise

WINDOW = 35
#: Words of a node. A minimizer is taken from WIDTH neighbouring nodes, and a window holds two such stretches.
K = 6
WIDTH = (WINDOW - K + 1) // 2


def nodes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the picked nodes, their texts, and for each position the pick of the stretch that starts there (or -1)."""
    picks = np.full(len(words), -1, np.int64)
    at = in_text(first, K + WIDTH - 1)
    if len(at):
        picks[at] = minimizers(ngrams(words, K), WIDTH)[at]
    found = picks[at]
    owner = np.searchsorted(first, found, "right") - 1
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new], picks


def edges(rows: DataFrame) -> DataFrame:
    """row_key, pos (first word), size (words), edge (hash) of every edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys, at = np.array(column(batch, "row_key"), np.int64), 0
            for texts in slices(column(batch, "text")):
                words, first, _ = words_of(texts, powers)
                where, owner, _ = nodes(words, first)
                pair = np.flatnonzero(owner[1:] == owner[:-1])
                start, end = where[pair], where[pair + 1] + K
                name = mix(powers.ranges(powers.prefix(words), start, end) + (end - start).astype(np.uint64))
                who = owner[pair]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at + who]), pa.array((start - first[who]).astype(np.int32)), pa.array((end - start).astype(np.int16)), pa.array(name.view(np.int64))],
                    names=["row_key", "pos", "size", "edge"],
                )
                at += len(texts)

    return rows.select("row_key", "text").mapInArrow(run, "row_key long, pos int, size short, edge long")


def compacted(found: DataFrame) -> DataFrame:
    """Of each text with repeated edges: row_key, marks (two per edge in text order: position, and 1 if a path goes on)."""
    shared = found.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("edge")
    # Written tables on both sides of a join let Spark split the partition of a frequent edge.
    again = found.hint("merge").join(materialise(shared, "shared-edges"), "edge")
    order = Window.partitionBy("row_key").orderBy("pos")
    # Neighbours in a text share a node: the next edge starts where this one's last node does.
    met = F.lead("pos").over(order) == F.col("pos") + F.col("size") - K
    came = F.lag(F.col("pos") + F.col("size") - K).over(order) == F.col("pos")
    again = again.select("*", F.when(met, F.lead("edge").over(order)).alias("next"), F.when(came, F.lag("edge").over(order)).alias("last"))
    again = materialise(again, "repeated-edges")
    one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    degrees = again.groupBy("edge").agg(F.coalesce(one("next"), F.lit(False)).alias("one_out"), F.coalesce(one("last"), F.lit(False)).alias("one_in"))
    known = again.hint("merge").join(materialise(degrees, "degrees"), "edge")
    goes_on = F.col("next").isNotNull() & F.col("one_out") & F.lead("one_in").over(order)
    marks = known.select("row_key", "pos", F.coalesce(goes_on, F.lit(False)).cast("int").alias("on"))
    marks = marks.groupBy("row_key").agg(F.sort_array(F.collect_list(F.col("pos") * 2 + F.col("on"))).alias("marks"))
    return marks


def windows(rows: DataFrame, window: int) -> DataFrame:
    """Of texts with marks: spans inside one path (a and b null; start, end in words), and the windows to compare (a, b hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, other = Powers(), Powers(1)
        for batch in batches:
            marks = column(batch, "marks")
            keys, at = column(batch, "row_key"), 0
            for texts in slices(column(batch, "text")):
                words, first, (data, starts, ends) = words_of(texts, powers)
                where, owner, picks = nodes(words, first)
                prefix = None
                for i in range(len(texts)):
                    low, n = int(first[i]), int(first[i + 1] - first[i])
                    if n < window:
                        continue
                    own = where[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")] - low
                    mark = np.array(marks[at + i], np.int64)
                    # Edge j goes from node j to node j + 1.
                    edge = np.searchsorted(own, mark >> 1)
                    again, on = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                    again[edge], on[edge] = 1, mark & 1
                    sum_again, sum_on = np.concatenate([[0], np.cumsum(again)]), np.concatenate([[0], np.cumsum(on)])
                    s = np.arange(n - window + 1)
                    inner = picks[low : low + n - window + 1] - low, picks[low + WIDTH : low + WIDTH + n - window + 1] - low
                    left, right = np.searchsorted(own, inner[0]), np.searchsorted(own, inner[1])
                    made = sum_again[right] - sum_again[left] == right - left
                    s = s[made]
                    if not len(s):
                        continue
                    # The path around a window: from the last node at or before it to the first that ends at or after it.
                    left, right = np.searchsorted(own, s, "right") - 1, np.searchsorted(own + K, s + window)
                    inside = (left >= 0) & (right < len(own))
                    l, r = left[inside], right[inside]
                    inside[inside] = (sum_again[r] - sum_again[l] == r - l) & (sum_on[np.maximum(r - 1, l)] - sum_on[l] == np.maximum(r - 1 - l, 0))
                    whole, rest = s[inside], s[~inside]
                    if len(whole):
                        cut = np.flatnonzero(np.diff(whole) > window)
                        spans = whole[np.concatenate([[0], cut + 1])], whole[np.concatenate([cut, [len(whole) - 1]])] + window
                        yield packed(keys[at + i], spans[0], spans[1])
                    if len(rest):
                        if prefix is None:
                            prefix = powers.prefix(words), other.prefix(word_hashes(data, starts, ends, other))
                        a = mix(powers.ranges(prefix[0], rest + low, rest + low + window))
                        b = mix(other.ranges(prefix[1], rest + low, rest + low + window))
                        yield packed(keys[at + i], rest, rest + window, a, b)
                at += len(texts)

    return rows.select("row_key", "text", "marks").mapInArrow(run, "row_key long, start int, end int, a long, b long")


def packed(key: int, start: np.ndarray, end: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(start)
    hashes = [pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, key, np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), *hashes], names=["row_key", "start", "end", "a", "b"])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """row_key, starts, ends: the words covered by repeated windows, of the texts that have any (a written table)."""
    found = materialise(edges(rows), "edges")
    marks = materialise(compacted(found), "marks")
    marked = join_rows(rows, marks, "row_key", "inner")
    read = materialise(windows(marked, WINDOW), "windows")
    again = read.where("a IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    again = materialise(again, "repeated-windows")
    spans = read.where("a IS NULL").select("row_key", "start", "end")
    spans = spans.unionByName(read.where("a IS NOT NULL").hint("merge").join(again, ["a", "b"]).select("row_key", "start", "end"))
    return materialise(spans.groupBy("row_key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")


def cut_words(text: str, starts: str, ends: str) -> Column:
    """Of a text and spans: the number of its words, how many are inside the spans, and the others joined by one space."""

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            out = []
            for words, low, high in zip(*columns):
                words = (words or "").encode().split()
                n = len(words)
                if low is not None:
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, np.asarray(low), 1)
                    np.add.at(depth, np.asarray(high), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
                out.append((n, n - len(words), b" ".join(words).decode()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return cut(text, starts, ends)


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: row_key, id, n_words, n_removed, kept (text without the repeated passages)."""
    rows = keyed(docs, id_col, {"text": text_col})
    cut = join_rows(rows, repeated_spans(rows), "row_key", "left")
    return cut.select("row_key", "id", cut_words("text", "starts", "ends").alias("cut")).select("row_key", "id", "cut.*")
