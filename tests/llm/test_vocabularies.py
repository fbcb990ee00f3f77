"""Cross-tokenizer alignment and SentencePiece, against the libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import SCHEMA, prose, rows
from wordloom.llm import alignment, sentencepieces
from wordloom.llm.queries import byte_tokenizer, piece_model

TEXTS = [
    None,
    "",
    " ",
    "   ",
    "a",
    " a  b  ",
    "a \n b \n\n  c\t d　 e",
    "▁",
    "a▁b ▁▁ c",
    "naïve façade 東京タワー Ωmega 👩‍👩‍👧 é \x00 \x1c \x85 \xa0 end",
    "<s> </s> <unk> <0x41> <|endoftext|>",
    "    " * 50 + "def f():\n\t\treturn    1",
    "x" * 500,
    "éèê" * 200 + " tail",
    "1234567890 3.14 $$$ *** ,,, ...",
]


def odd_texts(seed: int, n: int = 200) -> list:
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice("ab  the's\n1é東👩▁.") for _ in range(rng.randrange(200))) for _ in range(n)]


def test_pieces_are_the_librarys(spark):
    model = piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(1)
    texts = odd_texts(1) + [prose(rng, 20_000), "the cat sat" * 3000, "same", "same"]
    encoded = sentencepieces.encode(spark.createDataFrame(rows(texts), SCHEMA).repartition(3), model)
    found = sentencepieces.decode(encoded, model).orderBy("id").collect()
    assert len(found) == len(texts)
    for row, text in zip(found, texts):
        wanted = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(row["ids"], "<u4").tolist() == wanted
        assert row["decoded"] == library.decode(wanted)


def test_both_agendas_agree_and_room_is_made():
    model = piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    vocabulary = sentencepieces.read_vocabulary(model)
    agenda = sentencepieces.Agenda(vocabulary)
    encoder = sentencepieces.Encoder(model, cache_bytes=200_000)
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("abcdeéthein▁👩") for _ in range(n)) for n in (0, 1, 2, 5, 13, 22, 23, 24, 25, 400) for _ in range(30)]
    for word, found in zip(words, agenda.merge(words)):
        symbols = sentencepieces.merge_long(word, vocabulary.cost)
        assert found == [i for s in symbols for i in ([vocabulary.ids[s]] if s in vocabulary.ids else agenda.in_bytes(s))]
        assert [vocabulary.begin, *found, vocabulary.end] == library.encode(word.replace("▁", " ")[1:], add_bos=True, add_eos=True) or word == "▁"
    for _ in range(20):
        texts = [prose(rng, 300), None, ""]
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(texts))]
        assert found == [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]
        assert encoder.memory.used < 200_000


def test_decoding_ids_that_no_text_gives():
    model = piece_model()
    decoder, rng = sentencepieces.Decoder(model), random.Random(3)
    for _ in range(500):  # decode compares with the library itself
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(9))]
        decoder.decode(np.array(ids, "<u4").tobytes())


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sentencepieces.read_vocabulary(b"")


def test_pieces_of_odd_ids_and_no_rows(spark):
    model = piece_model()
    table = spark.createDataFrame(rows(["a b", "a b", None], [None, 1, 1]), SCHEMA)
    assert sorted(len(r["ids"]) // 4 for r in sentencepieces.encode(table, model).collect()) == [2, 4, 4]
    assert sentencepieces.decode(sentencepieces.encode(spark.createDataFrame([], SCHEMA), model), model).count() == 0


def groups_of(text, a_library, b_library, raw_a, raw_b):
    """Brute force: the groups of one text, none if it has no tokens."""
    if not text:
        return []
    a, b, whole = a_library.encode(" " + text, add_special_tokens=False).ids, b_library.encode(text), (" " + text).encode()
    if b"".join(raw_a[i] for i in a) != whole or b"".join(raw_b[i] for i in b) != whole:
        return []
    at = [np.cumsum([len(raw[i]) for i in ids]).tolist() for ids, raw in ((a, raw_a), (b, raw_b))]
    out, x, y = [], 0, 0
    for end in sorted(set(at[0]) & set(at[1])):
        to_x, to_y = at[0].index(end) + 1, at[1].index(end) + 1
        out.append((a[x:to_x], b[y:to_y]))
        x, y = to_x, to_y
    return out


@pytest.mark.parametrize("small", [True, False])
def test_alignment_is_that_of_brute_force(spark, monkeypatch, small):
    if not small:  # the pair counts are joined by a shuffle with salted keys
        monkeypatch.setattr("wordloom.operators.joins.is_small", lambda table: False)
    json, model = byte_tokenizer(), piece_model()
    a_library, b_library = Tokenizer.from_str(json), sentencepiece.SentencePieceProcessor(model_proto=model)
    a_library.encode_special_tokens = True
    raw_a, raw_b = alignment.bytes_of_a(json), sentencepieces.read_vocabulary(model).raw
    rng = random.Random(4)
    texts = odd_texts(4, 80) + ["naturally the unbelievable cat sat"] * 40 + [prose(rng, 3000), "word, " * 4000, "üß東" * 700]
    table = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    found = alignment.align(table, json, model, with_groups=True).orderBy("id").collect()
    aligned = [groups_of(t, a_library, b_library, raw_a, raw_b) for t in texts]
    links = [Counter((i, j) for a, b in groups for i in a for j in b) for groups in aligned]
    counts = Counter(pair for one in links for pair in one)
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    assert len(found) == len(texts)
    for row, groups, linked in zip(found, aligned, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert row["groups"] == text
        assert row["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if text else "")
        assert (row["n_a"], row["n_b"]) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups))
        assert (row["n_groups"], row["n_links"]) == (len(groups), sum(linked.values()))
        assert row["n_best"] == sum(n for p, n in linked.items() if counts[p] == best[p[0]])
        assert row["count_sum"] == sum(n * counts[p] for p, n in linked.items())


def test_identity_map_is_of_same_bytes():
    json, model = byte_tokenizer(), piece_model()
    raw_a, raw_b = alignment.bytes_of_a(json), sentencepieces.read_vocabulary(model).raw
    same = alignment.identity_map(raw_a, raw_b)
    assert all(raw_a[i] == raw_b[j] for i, j in enumerate(same) if j >= 0)
    assert {raw_a[i] for i, j in enumerate(same) if j < 0} & set(raw_b) <= {b""}


def test_alignment_of_odd_ids_and_no_rows(spark):
    json, model = byte_tokenizer(), piece_model()
    table = spark.createDataFrame(rows(["a b", "a b", None], [None, 1, 1]), SCHEMA)
    found = sorted((r["n_links"], r["n_best"], r["count_sum"]) for r in alignment.align(table, json, model).collect())
    assert found == [(0, 0, 0), (2, 2, 4), (2, 2, 4)]
    assert alignment.align(spark.createDataFrame([], SCHEMA), json, model).count() == 0
