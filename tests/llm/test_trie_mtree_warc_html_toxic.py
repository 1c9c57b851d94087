import base64
import gzip
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlefold.llm import htmltext, mtree, toxicity, triebpe, warc
from candlefold.sources.shared import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


# ---- BPE -----------------------------------------------------------------------------------------------------------

rng = random.Random(3)
TEXTS = [
    None, "", " \n", "Hello, World! I'LL don't 123 4.5", "ΣΊΣΥΦΟΣ ΑΣ", "İstanbul ﬁ é é", "<|startoftext|>a<|endoftext|> <|ENDOFTEXT|>", "a" * 5000, "aaa aaaa aaaaa bbbbab", "🙂👩‍👩‍👧 ​\xa0x\x1cy\x85z\x7f\x00",
    "x " * 4000, *("".join(rng.choice("abcde \n'.é1") for _ in range(rng.randrange(1, 400))) for _ in range(150)),
]


def test_trie_bpe_gives_the_librarys_ids_and_decoding(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(TEXTS)] + [(None, "no id", 1), (3, TEXTS[3], 1)], "doc_id long, text string, n_tokens int")
    rows = triebpe.encode(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id]
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), text
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text
    assert triebpe.encode(df.where("false")).count() == 0


def test_trie_shares_prefixes_and_survives_eviction(monkeypatch):
    bpe = triebpe.TrieBpe(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(triebpe, "KEEP_WORDS", 3)
    monkeypatch.setattr(triebpe, "KEEP_PAIRS", 2)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("transform transformer transformers trans", "transformers trance tram", "tr t transf"):
        (_, ids, _), = bpe.encode_block([bpe.words(text)])
        assert ids == " ".join(map(str, t.encode(text, add_special_tokens=False).ids))


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(triebpe, "BLOCK_CHARS", 50)
    text = " ".join(f"word{i}" for i in range(500))
    assert "".join(triebpe._pieces(text, 50)) == text


# ---- M-tree --------------------------------------------------------------------------------------------------------


def brute_top(rows, queries, k):
    ok = [(i, [int(np.floor(256 * np.float64(np.float32(v)))) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = set()
    for q, x in ok:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("part_rows", [8192, 60])
def test_mtree_top_k(spark, part_rows):
    g = np.random.default_rng(1)
    rows = [(i, [float(v) for v in np.float32(g.normal(size=6) * (1 + i % 5))]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, rows[0][1]), (2050, [0.0] * 6)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id % 50 = 0"), part_rows=part_rows).collect()}
    assert got == brute_top(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)


def test_mtree_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in mtree.top_k(df, df).collect()) == [(0, 1, 50, 128 * 256), (50, 1, 0, 128 * 256)]
    assert mtree.top_k(df.where("false"), df).count() == 0
    assert mtree.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_mtree_skips_distances_by_stored_bounds():
    g = np.random.default_rng(2)
    centers = g.normal(size=(40, 8)) * 1000
    x = np.floor(np.concatenate([c + g.normal(size=(100, 8)) for c in centers])).astype(np.int64)
    tree = mtree.MTree(x, np.arange(len(x)), int((x * x).sum(axis=1).max()))
    assert len(tree.inner) >= 1 or len(tree.leaf[0]) > 1
    for q in range(0, len(x), 397):
        best = sorted((-int(x[i] @ x[q]), i) for i in range(len(x)) if i != q)[:5]
        assert tree.search(x[q], 5, q) == [(-s, i) for s, i in best]


# ---- WARC ----------------------------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/é x\n", "<p>same</p>"), (5, "http://b", "<p>same</p>"), (5, "http://b", "<p>same</p>"), (3, None, ""), (4, "http://d", None), (7, "http://e", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n" * 3),
    (8, "u", "é" * 700_000), (9, "u", "only"), (None, "n", "<p>same</p>"), (None, "n", "alone"),
]


def expected_records(min_bytes=0):
    out = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        same = [j for j, _, g in PAGES if (g or "") == (h or "") and j is not None]
        best = max(same, default=None) if len(raw) >= min_bytes else None
        other = best is not None and best != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", best if other else None))
    return out


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_warc_round_trip(spark, min_bytes):
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write(df, min_bytes=min_bytes)
    got = [tuple(r) for r in warc.page_records(warc.read(archives)).collect()]
    assert sorted(got, key=str) == sorted(expected_records(min_bytes), key=str)
    chunks = warc.read(archives).where("record_id = 'urn:page:8'").orderBy("chunk_no").collect()
    assert len(chunks) > 3 and b"".join(c["data"] for c in chunks).decode() == PAGES[6][2]
    assert [c.is_last for c in chunks] == [False] * (len(chunks) - 1) + [True]


def test_warc_records_are_cut_into_chunk_rows():
    """Cut without Spark: running sizes and digests, one row at least a record, none with data for a revisit."""
    text = "é" * (2 * warc.CHUNK + 5)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    rows = [(1, "u v", text, 2 * len(text), sha(text), None), (2, None, "", 0, sha(""), None), (3, "w", None, 0, sha(""), 2), (4, "x", "é" * warc.CHUNK, 2 * warc.CHUNK, sha("é" * warc.CHUNK), None)]
    got = [r for b in warc._cut(iter([pa.RecordBatch.from_pylist([dict(zip("abcdef", r)) for r in rows])])) for r in b.to_pylist()]
    assert [(r["page_id"], r["chunk_no"], r["is_last"]) for r in got] == [(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, True), (3, 0, True), (4, 0, True)]
    assert b"".join(r["data"] for r in got[:3]).decode() == text and got[0]["url"] == "u%20v" and got[4]["data"] is None
    for k, r in enumerate(got[:3]):
        part = text[: (k + 1) * warc.CHUNK]
        assert (r["bytes_so_far"], r["so_far"]) == (len(part.encode()), sha(part))
    assert [r["so_far"] for r in got[3:]] == [sha(""), None, sha("é" * warc.CHUNK)]


def test_warc_files_are_gzip_members_and_damage_is_seen(spark):
    df = spark.createDataFrame(PAGES[5:8], "page_id long, url string, html string").coalesce(1)
    archives = warc.write(df)
    fs, path = pafs.FileSystem.from_uri(archives.first().archive)
    with fs.open_input_stream(path, compression=None) as f:
        raw = f.read()
    text = gzip.decompress(raw)
    assert raw.count(b"\x1f\x8b\x08") >= 3 and text.count(b"WARC-Type: response") == 3
    bad = gzip.compress(text.replace(b"only", b"onlY"))
    with fs.open_output_stream(path, compression=None) as f:
        f.write(bad)
    with pytest.raises(Exception, match="damaged"):
        warc.read(archives).count()
    assert warc.page_records(warc.read(warc.write(df.where("false")))).count() == 0


# ---- HTML ----------------------------------------------------------------------------------------------------------

TALK = "It went on, and nobody knew for how long; the rain had stopped by then. The rest is told below, in the order of the days. "
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>no</p>"; if (a<b) {{}}</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href=x>Menu</a><li><a>More</a></ul></nav></header><div class="cookie-notice">We use cookies.</div><!-- <p>no</p> -->
<main><article><header><h1>Head &amp; line of a story told at last</h1></header><p>One <b>two</b>, &lt;three&gt;<br>four &eacute;&#8364; {TALK}</p><form><input value=">">sign up</form>
<ul><li>first, {TALK}<li>second, {TALK}</ul><aside>see also</aside><div class="ad banner">buy</div><p hidden>secret {TALK}<p>Last   one.\n\n</article><section id="comments"><div class="comment"><p>Nice read, thanks! {TALK * 2}</p></div></section></main>
<footer>&copy; all</footer></body></html>"""
WANT = ["Head & line of a story told at last", "One two, <three> four é€ " + TALK.strip(), "first, " + TALK.strip(), "second, " + TALK.strip(), "Last one."]


def test_html_main_text():
    assert htmltext.main_text(PAGE).split("\n") == WANT
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p>") == htmltext.main_text("<script>x") == ""
    assert htmltext.main_text("plain text") == "plain text"
    assert htmltext.main_text("<article>" + "<p>" + TALK * 30_000 + "</article>").count("rain") == 30_000


def story(n=6):
    return "".join(f"<p>{'A sentence, with words and commas; it goes on. ' * 5}</p>" for _ in range(n))


def test_html_ratios_without_names(monkeypatch):
    page = f"<body><div><a>Home</a> <a>News</a> <a>About</a></div><div><div><h2>The headline of it, as it was told</h2>{story()}</div></div><div><span>x</span><span>y</span></div></body>"
    got = htmltext.main_text(page)
    assert got.count("\n") == 6 and "Home" not in got and got.startswith("The headline of it, as it was told\nA sentence")
    monkeypatch.setattr(htmltext, "_value", lambda *counts: 5.0)  # the ratios decide: with equal ones the page falls apart
    assert htmltext.main_text(page) != got


def test_html_misleading_names():
    teaser = f"<body class='has-sidebar'><nav><a>Home</a></nav><main><p>Read on.</p></main><div><div>{story()}</div></div></body>"
    got = htmltext.main_text(teaser)
    assert got.count("A sentence, with") == 30 and "Home" not in got
    named = f"<body><div class='header-image promo'>{story()}</div><div class='main-content'><a>x</a></div></body>"  # one name alone vetoes nothing
    assert htmltext.main_text(named).count("A sentence, with") == 30


def naive_values(page):
    """Fused values of the block paths of a well-formed page without names, straight from the definition."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.blocks, self.new = [], [], True

        def handle_starttag(self, tag, attrs):
            if tag in htmltext.BLOCKS:
                self.open, self.new = [*self.open, tag], True

        def handle_endtag(self, tag):
            if tag in htmltext.BLOCKS:
                self.open, self.new = self.open[:-1], True

        def handle_data(self, data):
            if data.strip():
                if self.new or self.blocks[-1][0] != tuple(self.open):
                    self.blocks.append((tuple(self.open), ""))
                self.blocks[-1], self.new = (self.blocks[-1][0], self.blocks[-1][1] + data), False

    reader = Reader()
    reader.feed(page)

    def value(pick):
        texts = [t for p, t in reader.blocks if pick(p)]
        chars, marks = sum(len("".join(t.split())) for t in texts), sum(t.count(c) for t in texts for c in ".,;:!?")
        return min(7.0, math.log(chars / len(texts) * (1 + min(marks, chars / 15) / len(texts)))) if texts else 0.0

    out = {}
    own = [value(lambda q, p=p: q == p) for p, _ in reader.blocks]
    for p in {p for p, _ in reader.blocks}:
        smooth = []
        for i in (i for i, (q, _) in enumerate(reader.blocks) if q == p):
            near = own[max(0, i - 1) : i + 2] + [own[i]] * 2
            smooth.append(sum(near) / len(near))
        shared = max(value(lambda q: q[:-1] == p[:-1]), value(lambda q: q[:-1] == p[:-2]))
        out[p] = (sum(smooth) / len(smooth) + shared) / 2
    return sorted(out.values())


def test_html_values_match_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        def part(depth):
            if depth == 0 or rng.random() < 0.3:
                return "".join(rng.choice(["word ", "a, b. ", "<b>bold</b> ", "long winded text; "]) for _ in range(rng.randrange(1, 9)))
            tags = [rng.choice(["div", "section", "ul", "blockquote"]) for _ in range(rng.randrange(1, 4))]
            return "".join(f"<{t}>{part(depth - 1)}</{t}>" for t in tags)

        page = f"<html><body>{part(4)}</body></html>"
        paths = htmltext.Paths()
        got = htmltext.fused_values(list(htmltext.text_nodes(page, paths)), paths)
        assert sorted(got.values()) == pytest.approx(naive_values(page))


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "<article>" + "<div>" * 3000 + "deep", "x")], "page_id long, url string, html string, main_text string")
    rows = htmltext.extract(df).collect()
    assert [r.main_text for r in rows].count("") == 1 and len(rows) == 4
    assert {r.main_text for r in rows if r.page_id is None} == {"deep"}


# ---- toxicity ------------------------------------------------------------------------------------------------------


def corpus(n, seed):
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abdeghilmnoprstuw") for _ in range(g.randrange(2, 9)))
    insults = ["blorgnak", "fezzwit", "gruntpox"]
    texts, marks = [], []
    for i in range(n):
        w = [word() for _ in range(80)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                x = g.choice(insults)
                w[g.randrange(80)] = x if g.random() < 0.7 else x[:3] + g.choice("x.-") + x[3:]
        texts.append(" ".join(w))
        marks.append(int(toxic))
    return texts, marks


def test_toxicity_held_out_accuracy():
    texts, marks = corpus(600, 1)
    model = toxicity.fit([t for t, y in zip(texts, marks) if y], [t for t, y in zip(texts, marks) if not y])
    held, truth = corpus(200, 2)

    def score(text):
        found = toxicity.sentences_of(text)
        return model.score(model.worst(model.margins(found, model.known(sorted({w for x in found for w in x})))))

    got = [score(t) >= 0.5 for t in held]
    assert sum(a == bool(b) for a, b in zip(got, truth)) >= 194
    m = model.known(["blorgnak", "bl.orgnak", "blorgxnak", "table"])
    assert m["bl.orgnak"] == pytest.approx(m["blorgnak"]) and m["blorgxnak"] > 0 > m["table"]


def naive_kernel(a, b):
    """Sum over all pairs of equal subsequences of three letters, each weighted by DECAY to the length it spans, within SPAN."""

    def subsequences(word):
        x = toxicity.letters(word)
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                    yield (x[i], x[j], x[k]), toxicity.DECAY ** (k - i + 1)

    return sum(u * v for s, u in subsequences(a) for t, v in subsequences(b) if s == t)


def test_kernel_matches_naive_gapped_subsequences():
    words = ["abc", "axbc", "idiot", "i.d1ot", "idxiot", "été", "a", "", "aaaaaaa", "Ωmega"]
    row, code, weight, norm = toxicity.features(words)
    for i, a in enumerate(words):
        phi = {}
        for c, w in zip(code[row == i], weight[row == i]):
            phi[c] = phi.get(c, 0.0) + w
        for j, b in enumerate(words):
            got = sum(w * phi.get(c, 0.0) for c, w in zip(code[row == j], weight[row == j]))
            assert got == pytest.approx(naive_kernel(a, b))
    assert naive_kernel("idiot", "idxiot") > 0.3 * naive_kernel("idiot", "idiot")


def test_margins_are_kernel_sums_over_the_landmarks():
    marks = toxicity.Landmarks(["idiot", "table", "stupid", "tisch"])
    z = marks(["idiot", "idxiot", "table"])
    w = np.arange(1.0, z.shape[1] + 1)
    model = toxicity.Model(marks.fold(w), -0.25)
    assert list(model.known(["idiot", "idxiot", "table"]).values()) == pytest.approx((z @ w - 0.25).tolist(), rel=1e-4)


def test_toxicity_table(spark):
    texts, marks = corpus(400, 3)
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (None, "blorgnak blorgnak"), (9002, "x" * 100_000), (0, texts[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(marks)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = toxicity.score(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[9000] == by[9001] < 0.5 < by[None]
    assert toxicity.fit(["a b c d. blorgnak e f"] * 9 + ["plain words"], []) is None  # one label alone
    assert toxicity.train(df, labels.where("false")) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(df.where("false"), model).count() == 0
