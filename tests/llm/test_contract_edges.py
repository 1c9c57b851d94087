"""Letters of any Unicode version, vectors of any length, repeated rows, and what a page's names leave out."""

import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlefold.llm import htmltext, mtree, packing, toxicity, triebpe
from candlefold.llm.common import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


LETTERS = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Co", "Cn") or 0x1C80 <= c < 0x1CC0 or 0xA7C0 <= c < 0xA800 or 0x16D40 <= c < 0x16D80]


def ids_of(bpe, text):
    ((_, ids, _),) = bpe.encode_block([bpe.words(text)])
    return ids


def test_bpe_words_of_every_letter():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bpe = triebpe.TrieBpe(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(0, len(LETTERS), 4000):
        text = " ".join(f"a{c}b !{c}" for c in LETTERS[i : i + 4000])
        assert ids_of(bpe, text) == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_bpe_random_strings_of_rare_scripts():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bpe = triebpe.TrieBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    pool = [chr(c) for a, b in ((0x40, 0x7B), (0x300, 0x370), (0xA720, 0xA800), (0x1C80, 0x1C90), (0x1E030, 0x1E090), (0x897, 0x8A0), (0x1AB0, 0x1AE0), (0x11380, 0x113E0), (0x16D40, 0x16D7A)) for c in range(a, b)]
    for text in ("Ᲊ Ɤ", "\U0001e030 Ƛ", *("".join(rng.choice(pool) for _ in range(12)) for _ in range(2000))):
        assert ids_of(bpe, text) == " ".join(map(str, library.encode(text, add_special_tokens=False).ids)), text


def test_packing_ids_are_those_of_the_json_vocabulary():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.encoder()
    assert {fast.decode_single_token_bytes(i) for i in range(50256)} == {"".join(t).translate({ord(s): chr(b) for b, s in enumerate(triebpe.byte_letters())}).encode("latin-1") for t, i in library.get_vocab().items() if i < 50256}
    for i in range(0, len(LETTERS), 4000):
        text = " ".join(f"a{c}b !{c}" for c in LETTERS[i : i + 4000])
        assert fast.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


def test_mtree_vectors_of_every_length(spark):
    g = np.random.default_rng(4)
    rows = [(i, [float(v) for v in np.round(g.normal(size=n), 3)]) for i, n in enumerate(g.choice([0, 1, 3, 3, 3, 8], size=600))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for part_rows in (8192, 70):
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id % 50 = 0"), part_rows=part_rows).collect()}
        ints = {i: [int(np.floor(256 * v)) for v in x] for i, x in rows}
        want = set()
        for q in range(0, 600, 50):
            best = sorted((-sum(a * b for a, b in zip(ints[q], y)), i) for i, y in ints.items() if i != q and len(y) == len(ints[q]))[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
        assert got == want


def test_mtree_many_rows_of_one_id(spark):
    rows = [(7, [1.0, 1.0])] * 5000 + [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (9, [2.0, 0.0]), (8, [0.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id = 0"), part_rows=64).collect())
    assert got == [(1, 9, 2 * 65536)] + [(n, 7, 65536) for n in range(2, 6)]


def test_toxicity_takes_one_text_of_an_id(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda toxic, clean: seen.update(toxic=toxic, clean=clean))
    docs = spark.createDataFrame([(1, f"text {i:04}") for i in range(3000)] + [(2, "good"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert seen == {"toxic": ["text 0000"], "clean": ["good"]}


LONG = "We keep a list of things, and it is long; the rest of it is elsewhere. " * 8
BODY = "<h1>Head of it</h1>" + "<p>A sentence, with words; it goes on and on. A sentence, with more.</p>" * 4 + "<table><tr><td>cell</td><td>x 2</td></tr></table><ul><li>short</li></ul>"


@pytest.mark.parametrize("out", ["<footer>{}</footer>", "<aside>{}</aside>", "<div class='cookie-notice'>{}</div>", "<div class='sidebar'><p>{}</p></div>", "<form><p>{}</p></form>", "<header><p>{}</p></header>", "<section id='comments'><p>{}</p></section>"])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div>{}</div></main>", "<div><div>{}</div></div>"])
def test_long_boilerplate_is_left_out_and_the_article_stays_whole(out, around):
    page = f"<html><body>{out.format(LONG)}{around.format(BODY)}{out.format(LONG)}</body></html>"
    got = htmltext.main_text(page).split("\n")
    assert got == ["Head of it", *["A sentence, with words; it goes on and on. A sentence, with more."] * 4, "cell", "x 2", "short"]


def test_layout_names_and_forms_around_everything():
    assert "cell" in htmltext.main_text(f"<body><div class='has-sidebar no-footer'>{BODY}</div></body>")
    assert "A sentence" in htmltext.main_text(f"<body><form id=page>{BODY}</form></body>")
    assert "Head" in htmltext.main_text(f"<body><article><div class='entry-header'><h2 id='comments'>Head</h2></div>{BODY[19:]}</article></body>")


def test_lines_of_links_in_an_unnamed_element():
    page = f"<body><div><ul><li><a>Home</a></li><li><a>News</a></li></ul></div><div>{BODY}<p><a>more of this</a></p></div></body>"
    got = htmltext.main_text(page)
    assert "Home" not in got and "short" in got and got.startswith("Head of it")
