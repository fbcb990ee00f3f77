"""Language identification, quality rules, licence scans and main text of pages."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, prose, rows, words
from wordloom.llm import html_cut, langid, licenses, quality
from wordloom.llm.hashing import Powers

SF = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs).where(langid.held_out()).select("lang", "lang_pred", "score", "rejected").collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in found])
    assert len(found) > 30 and right > 0.95 and all(0 <= r["score"] <= 1 for r in found)
    assert np.mean([r["rejected"] for r in found]) < 0.05


def test_language_of_odd_rows(spark):
    texts = ["the cat and the dog are in the house"] * 6 + ["le chat et le chien sont dans la maison"] * 6 + [None, "", "  ", "123 *** 456"]
    table = [(i, t, ("en" if i < 6 else "fr") if i not in (0, 7) else None, 0.5, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(table + [(None, "le chien", "fr", 0.1, "x")], "doc_id long, text string, lang string, score double, lang_pred string")
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert [found[i]["lang_pred"] for i in range(12)] == ["en"] * 6 + ["fr"] * 6
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 and found[i]["rejected"] for i in range(12, 16))
    unlabelled = docs.where("doc_id < 3").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def brute_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(lines), len(repeated)]


def test_quality_counts():
    rng = random.Random(1)
    texts = [None, "", " \n ", "a b", "a a a a", "x y z x y z x", "é ü ñ x # $%\n\n# $%\n", "one\ntwo\none\n one\n"]
    texts += ["".join(rng.choice("ab \n#é\t") for _ in range(rng.randrange(300))) for _ in range(40)]
    found = quality.count_texts([(t or "").encode() for t in texts], Powers())
    assert found.tolist() == [brute_counts(t) for t in texts]


def test_quality_keeps_clean_and_rejects_outliers(spark):
    rng = random.Random(2)
    clean = [prose(rng, rng.randrange(60, 400), 5000) for _ in range(150)]
    junk = [" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng, 100, 5000).split()) for _ in range(12)]
    texts = clean + junk + [None, "", "too short", "a b c " * 60]
    found = quality.judge(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("id").collect()
    kept = [r["kept"] for r in found]
    assert all(kept[:150]) and not any(kept[150:])
    assert [r["base_failed"] for r in found] == [False] * 162 + [True] * 4
    empty = quality.judge(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    odd = quality.judge(spark.createDataFrame(rows([clean[0], clean[0], None], [None, 1, 1]), SCHEMA)).collect()
    assert sorted(r["kept"] for r in odd) == [False, True, True]


def test_quality_rejects_one_odd_statistic(spark):
    rng = random.Random(4)

    def lines(n, word=lambda: f"w{rng.randrange(10**6)}"):
        return [" ".join(word() for _ in range(8)) for _ in range(n)]

    clean = ["\n".join(lines(rng.randrange(8, 60))) for _ in range(200)]
    odd = {
        "short words": " ".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)),
        "long words": "\n".join(lines(25, lambda: f"w{rng.randrange(10**6)}" * 3)),
        "symbols": "\n".join(x + " # $ %" for x in lines(25)),
        "repeated lines": "\n".join(f"{x}\nmore" for x in lines(25)),
        "repeated words": "\n".join(lines(60) + ["one two three four"] + lines(1)) + " " + " ".join(lines(24)[0].split() * 24),
    }
    found = quality.judge(spark.createDataFrame(rows(clean + list(odd.values())), SCHEMA)).orderBy("id").collect()
    assert all(r["kept"] for r in found[:200])
    assert not any(r["base_failed"] for r in found)
    assert [k for k, r in zip(odd, found[200:]) if r["kept"]] == []


def test_estimates_ignore_a_quarter_of_outliers(spark):
    rng = np.random.default_rng(3)
    good = rng.normal([1.7, 0.1, 0.0, 0.2], 0.3, (3000, 4))
    bad = rng.normal([3.0, 2.0, 1.0, 1.0], 0.3, (600, 4))
    table = spark.createDataFrame([("g", *map(float, v)) for v in np.concatenate([good, bad])], "g string, word_length double, symbols double, dup_lines double, repeats double")
    found = quality.estimates(table, ["g"]).first()
    assert np.abs(np.array(found["centre"]) - [1.7, 0.1, 0.0, 0.2]).max() < 0.05
    cov = np.linalg.inv(np.array(found["inverse"]).reshape(4, 4)) - np.diag([v * v for v in quality.FLOORS.values()])
    assert np.abs(cov - 0.09 * np.eye(4)).max() < 0.04


def test_base_phrases_are_those_of_brute_force(spark):
    rng = random.Random(11)
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    bits = ["mit", "MIT", "license", "License,", "apache", "general", "public", "the", "x_y", "lïcense", "general public license", "mit\tlicense"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "", "mit license " * 4000]
    for row in licenses.scan(spark.createDataFrame(rows(texts), SCHEMA)).collect():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[row["id"]] or ""))
        wanted = [
            (i, label) for i in range(len(words)) for label, phrase in phrases.items() if words[i : i + len(phrase.split())] == phrase.split()
        ]
        assert sorted((p["start"], p["label"]) for p in row["places"]) == sorted(wanted) and row["n_words"] == len(words)


def test_words_that_no_text_holds_take_no_place_in_the_index(spark):
    label, passage, key = licenses.PASSAGES[2]
    # A form of the passage without its rarest words: only these texts are there.
    edited = passage.replace("redistribute", "aaa").replace("modify", "bbb").replace("published", "ccc").replace("foundation", "ddd")
    texts = [edited, *["the of and a under terms public general license gnu free software program you can it or"] * 20]
    found = licenses.scan(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("id").first()
    assert key in edited and label in found["labels"]


def test_licenses(spark):
    mit = licenses.PASSAGES[0][1]
    texts = [
        None, "", "MIT License", "the mit-license; MIT\nLICENSE mit xlicense", "Licensed under the Apache License, Version 2.0.",
        "GNU General Public License general public license", "intro " * 30 + mit.replace("person", "HUMAN") + " outro", mit[40:],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "license mit apache public general", "MIT License",
    ]
    found = licenses.scan(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("id").collect()
    places = [[(p["start"], p["label"]) for p in r["places"]] for r in found]
    assert places == [[], [], [(0, "mit")], [(1, "mit"), (3, "mit")], [(3, "apache")], [(1, "gpl"), (4, "gpl")], [], [], [], [], [(0, "mit")]]
    assert [r["labels"] for r in found] == [[], [], ["mit"], ["mit"], ["apache"], ["gpl"], ["mit"], [], ["bsd"], [], ["mit"]]
    assert [r["n_words"] for r in found][:4] == [0, 0, 2, 7] and all(0 <= s <= 1 for r in found for s in r["scores"])
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- ad --><div class="ad">Buy now, buy cheap!</div>
<main><article><h1>A &amp; B</h1><p>First <b>bold</b> text&nbsp;here with   white
space, and<br>more of it to read for a while.<p>Second &lt;p&gt; with an unclosed <i>tag &copy 2020.
<aside class="related">Read also: <a href="/x">something</a></aside><ul><li>A point in the article that says something.</li><li>Short.</li></ul></article>
<form><label>Mail</label><input name="m"> Subscribe!</form></main>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I do not agree with this article at all, it is too long to read.</p></article></section>
<aside>Side text</aside><footer>&copy; site</footer>"""


def test_main_text():
    assert html_cut.main_text(PAGE).split("\n\n") == [
        "A & B",
        "First bold text here with white space, and more of it to read for a while.",
        "Second <p> with an unclosed tag © 2020.",
        "A point in the article that says something.",
        "Short.",
    ]
    assert html_cut.main_text("<nav>menu") == "" and html_cut.main_text("") == "" and html_cut.main_text("<p>") == ""
    assert html_cut.main_text("plain words that stand alone without any markup, and go on for long enough to be a text of its own kind." * 2)


LONG = "a sentence of the article that goes on for long enough to be read as the text of the page by anyone"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8><article><p>{LONG}</p></article>", LONG),
        (f"<head><title>T</title><style>p{{}}</style>{LONG} {LONG}", f"{LONG} {LONG}"),
        (f"<head><title>T</title><noscript><img src=x>off</noscript><link rel=x></head><article>{LONG}</article>", LONG),
        (f"<head><title>T</title><noscript>off<body><article>{LONG}</article>", LONG),
        (f"<head><title>T</title><noscript>off<article>{LONG}</article>", LONG),
        (f"<title>T</title><body><article><button>Menu <p>{LONG}</p> {LONG}</article>", f"{LONG}\n\n{LONG}"),
        (f"<article><select><option>A<option>B<p>{LONG}</article>", LONG),
        (f"<article><video src=x><p>{LONG}</p><video><p>No video.</p></video><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
        (f"<article><noscript><p>{LONG}</p></article>", LONG),
        (f"<article><p>{LONG} <button>Share<div>it</div></button><select><option>A</select></p></article>", LONG),
        (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p></article>", f"{LONG} x=1"),
        (f"<article><template><p>{LONG}</p></template><p>{LONG}</p></article>", LONG),
    ],
)
def test_main_text_without_end_tags(page, text):
    assert html_cut.main_text(page) == text


def test_extract_table(spark):
    pages = [(1, "u", PAGE, "old", "x"), (2, None, None, "old", "x"), (3, "u", "", "old", "x"), (1, "u", PAGE, None, "x"), (None, "u", "<p>" + "long text " * 20000, "", "x")]
    found = html_cut.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string, row_key string")).collect()
    assert len(found) == 5 and found[1]["text"] == found[2]["text"] == "" and found[0]["text"] == found[3]["text"] != ""
    assert len(found[4]["text"]) == 199999
    assert html_cut.extract(spark.createDataFrame([], "page_id long, html string")).columns == ["page_id", "text"]


@pytest.mark.parametrize("seed", range(6))
def test_minimum_cut_is_the_smallest(seed):
    rng = random.Random(seed)
    n = 8
    scores = [rng.uniform(-2, 2) for _ in range(n)]
    edges = [(i, i + 1, rng.uniform(0, 1.5)) for i in range(n - 1)] + [(rng.randrange(n - 1), n - 1, 0.4) for _ in range(3)]

    def cost(label):
        return sum(max(0, s) * (not x) + max(0, -s) * x for s, x in zip(scores, label)) + sum(w for a, b, w in edges if label[a] != label[b])

    best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cost(html_cut.minimum_cut(scores, edges)) == pytest.approx(best)
