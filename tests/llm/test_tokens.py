"""Byte-level BPE and packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.helpers import SCHEMA, prose, rows
from wordloom.llm import bpe, packing
from wordloom.llm.queries import byte_ranks, word_tokenizer

TEXTS = [
    None,
    "",
    " ",
    "don't we'll I'M it's",
    "two  spaces\n\n\ttabs \n and a trailing run   ",
    "naïve façade 東京タワー Ωmega 👩‍👩‍👧 é \x00 \x1c \x85 \xa0 end",
    "1234567890 3.14 <|endoftext|> #tag $$$ ***",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "word " * 200 + "x" * 500 + " tail " * 50,
    "it's " * 100 + "\n" * 90 + " end's",
]


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (64, 24), (40, 8)])
def test_bpe_is_the_librarys(spark, chunk, overlap):
    ranks = byte_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(chunk)
    texts = TEXTS + ["".join(rng.choice("ab 's\n1é.") for _ in range(rng.randrange(400))) for _ in range(30)]
    encoded = bpe.encode(spark.createDataFrame(rows(texts), SCHEMA), ranks, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    found = bpe.decode(encoded, ranks).orderBy("id").collect()
    assert len(found) == len(texts)
    for row, text in zip(found, texts):
        assert row["ids"] == library.encode_ordinary(text or "")
        assert bytes(row["decoded"]).decode() == (text or "")


def test_bpe_of_odd_ids_and_no_rows(spark):
    ranks = byte_ranks()
    table = spark.createDataFrame(rows(["a b", "a b", "a b"], [None, 1, 1]), SCHEMA)
    assert len({tuple(r["ids"]) for r in bpe.encode(table, ranks, public_tokenizers.PATTERN).collect()}) == 1
    assert bpe.encode(spark.createDataFrame([], SCHEMA), ranks, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_merge_like_the_library():
    ranks = byte_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 3000):
        piece = "".join(rng.choice("abcdeé") for _ in range(n))
        assert bpe.merge(piece.encode(), ranks) == library.encode_ordinary(piece)


def check_packing(texts, found, sequence):
    model = Tokenizer.from_str(word_tokenizer())
    ids = [np.array(e.ids + [1], "<u4") for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        part = ids[r["id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(ids[r["id"]]) == r["doc_tokens"]
        pieces[r["id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for of, wanted in [(pieces[i], len(x)) for i, x in enumerate(ids)] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(of):
            assert start == at
            at += length
        assert at <= sequence if wanted is None else at == wanted
    return sum(map(len, ids)), len(sequences)


def test_special_tokens_in_a_text_are_the_librarys():
    library, mine = Tokenizer.from_str(word_tokenizer()), packing.Encoder(word_tokenizer())
    texts = ["a <|endoftext|> b", "A <|ENDOFTEXT|> b", "é<|startoftext|>É", "<|endoftext|", "x<|endoftext|>y  z<|endoftext|>", "", "a\x1cb c"]
    found = [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert library.token_to_id("<|endoftext|>") in found[0] and library.token_to_id("<|endoftext|>") not in found[1]


def test_plain_words_are_cut_and_merged_as_by_the_library():
    library, mine = Tokenizer.from_str(word_tokenizer()), packing.Encoder(word_tokenizer())
    rng, odd = random.Random(3), "abcXYZ's'T12$\n\t\x0b\x1c\x85\xa0éÀߺıİſÅΣςẠǅȺ東👩‘’—\u0301\u200d\u2028 \u3000</w> "
    texts = [f"a{c}b {c} {c}x T{c} 's{c}'S" for c in map(chr, [*range(0x400), *range(0x2000, 0x2070)])]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(1000)]
    found = mine.encode(texts)
    assert found == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    # Texts beyond ASCII do not bring every case of a word.
    mine = packing.Encoder(word_tokenizer())
    mine.encode(["É word WORD Word", "— Word"])
    assert set(mine.memory.known) == {"é", "word", "—"}


def test_packing_keeps_every_id_once(spark):
    rng = random.Random(8)
    texts = TEXTS + [prose(rng, rng.choice([3, 30, 50, 80, 120, 1500])) for _ in range(300)] + ["same text"] * 100 + [prose(rng, 9000)]
    found = packing.pack(spark.createDataFrame(rows(texts), SCHEMA).repartition(7), word_tokenizer()).collect()
    ids, sequences = check_packing(texts, found, packing.SEQUENCE)
    assert ids / packing.SEQUENCE / sequences > 0.97


def test_packing_of_odd_ids_and_no_rows(spark):
    found = packing.pack(spark.createDataFrame(rows(["a", "a", None], [None, None, 1]), SCHEMA), word_tokenizer()).collect()
    assert sorted(r["length"] for r in found) == [1, 2, 2] and len({r["sequence_id"] for r in found}) == 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), word_tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_the_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice(np.arange(1, 65), 20, replace=False)
    demand = rng.integers(1, 500, 20)
    plan = packing.patterns(sizes, demand, 64)
    assert (sum(c * n for c, n in plan) == demand).all() and all((c * sizes).sum() <= 64 for c, _ in plan)
    # No worse than first fit, largest first, but for the rounding of its patterns.
    bins = []
    for size in sorted(np.repeat(sizes, demand).tolist(), reverse=True):
        at = next((i for i, free in enumerate(bins) if free >= size), None)
        if at is None:
            bins.append(64 - size)
        else:
            bins[at] -= size
    assert sum(n for _, n in plan) <= len(bins) + 20


def test_knapsack():
    sizes, values = np.array([3, 5, 8]), np.array([1.0, 1.9, 3.1])
    best = max((a + 1.9 * b + 3.1 * c, (a, b, c)) for a in range(9) for b in range(6) for c in range(4) if 3 * a + 5 * b + 8 * c <= 25)
    value, counts = packing.knapsack(values, sizes, 25)
    assert value == pytest.approx(best[0]) and counts @ sizes <= 25 and counts @ values == pytest.approx(value)
