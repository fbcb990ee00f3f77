"""Near-duplicates of documents (DartMinHash) and of embeddings (spherical caps)."""

import random

import numpy as np

from tests.llm.helpers import SCHEMA, classes, near_copy, prose, rows, shingle_counts, weighted_jaccard
from wordloom.llm import caps, minhash
from wordloom.llm.hashing import Powers


def expected_classes(texts):
    counts = [shingle_counts(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if counts[i] and weighted_jaccard(counts[i], counts[j]) >= 0.8]
    return classes(len(texts), links)


def test_shares_of_crowded_texts_need_no_join(spark):
    """The shares of each text against a plain count; its own shingles and the others are added up, not joined."""
    rng = random.Random(8)
    common = prose(rng, 90)
    texts = [common, common, near_copy(rng, common, 5), near_copy(rng, common, 9), prose(rng, 40), "a b", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_key long, text string")
    found = minhash.shared_weights(df)
    counts = [shingle_counts(t) for t in texts]
    holders = [g for c in counts for g in c]
    own = [sum(n for g, n in c.items() if holders.count(g) == 1) for c in counts]
    got = {r["row_key"]: r for r in found.collect()}
    assert [got[i]["own"] for i in range(len(texts))] == own and max(own) > 0
    assert [sum(got[i]["cells"]) for i in range(len(texts))] == [sum(c.values()) - o for c, o in zip(counts, own)]
    assert "Join" not in found._jdf.queryExecution().toString()


def test_classes_against_brute_force(spark):
    rng = random.Random(3)
    base = [prose(rng, 200) for _ in range(5)]
    texts = [None, "", "  ", "a", "a", "a b c", "a  b\nc", "a b c d", "a b c d e", "a b c d e"]
    for b in base:
        texts += [b, b, b.replace(" ", "\n")] + [near_copy(rng, b, e) for e in (1, 2, 3, 5, 8, 20, 60)]
    texts += ["again and again " * 40, "again and again " * 41, prose(rng, 3000)]
    # A crowd of copies of copies, most of them too far from each other.
    texts += [near_copy(rng, base[0], e % 25) for e in range(80)]
    rng.shuffle(texts)
    found = minhash.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("id").collect()
    assert [r["class_key"] for r in found] == expected_classes(texts)
    assert all(r["kept"] == (r["class_key"] == r["id"]) for r in found)


def test_odd_ids_and_no_rows(spark):
    text = prose(random.Random(1), 20)
    table = spark.createDataFrame(rows([text, text, text, None], [None, 4, 4, 5]), SCHEMA)
    found = minhash.near_duplicates(table).collect()
    assert len(found) == 4 and sum(r["kept"] for r in found) == 2 and len({r["class_key"] for r in found}) == 2
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng, k = random.Random(4), 2048
    a = "x y z q r " * 12 + prose(rng, 100)
    b = "x y z q r " * 5 + " ".join(a.split()[60:])
    owner, grams, weights = minhash.shingles([a.encode(), b.encode(), b""], Powers())
    found = minhash.signatures(owner, grams, weights, 3, k)
    assert (found[:2] != 0).all() and (found[2] == 0).all()
    true = weighted_jaccard(shingle_counts(a), shingle_counts(b))
    assert abs((found[0] == found[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k)


VECTORS = "vec_id long, embedding array<float>, label int, links int, kept string"


def vector_rows(vectors, ids=None):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 0, 5, "k") for i, v in zip(ids or range(len(vectors)), vectors)]


def brute_links(vectors):
    good = [v is not None and len(v) > 1 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    out = []
    for i, x in enumerate(vectors):
        for j, y in enumerate(vectors):
            if i != j and good[i] and good[j] and len(x) == len(y):
                p, q = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.9:
                    out.append((i, j))
    return out


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [list(v) for v in rng.normal(size=(60, 64))]
    for spread in (0.1, 0.2, 0.25):
        centre = rng.normal(size=64)
        vectors += [list(centre + spread * rng.normal(size=64)) for _ in range(25)]
    vectors += [vectors[3], vectors[3], [2 * x for x in vectors[4]], None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64]
    vectors += [list(rng.normal(size=5)), [1.0, 0.0], [1.0, 0.01], [3.0]]
    links = brute_links(vectors)
    found = caps.near_duplicates(spark.createDataFrame(vector_rows(vectors), VECTORS), block=16).orderBy("id").collect()
    got, true = sum(r["n_links"] for r in found), len(links)
    assert 0.99 * true <= got <= true
    counts = np.bincount([a for a, _ in links], minlength=len(vectors))
    assert all(r["n_links"] <= counts[r["id"]] for r in found)
    assert [r["component"] for r in found] == classes(len(vectors), links)


def test_embeddings_of_odd_ids_and_no_rows(spark):
    one = list(np.random.default_rng(1).normal(size=64))
    found = caps.near_duplicates(spark.createDataFrame(vector_rows([one, one, one, None], [None, 1, 1, 2]), VECTORS)).collect()
    assert sorted(r["n_links"] for r in found) == [0, 2, 2, 2] and sum(r["kept"] for r in found) == 2
    assert caps.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
