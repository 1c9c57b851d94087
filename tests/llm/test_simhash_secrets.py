import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from candlefold.llm import secrets, simhash
from candlefold.llm.common import connected_components, ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def brute_fp(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    f = {(i, t): brute_fp(t) for i, t in rows if i is not None}
    nodes = list(f)
    root = {n: n[0] for n in nodes}
    moved = True
    while moved:
        moved = False
        for a in nodes:
            for b in nodes:
                if (a[0] == b[0] or bin(f[a] ^ f[b]).count("1") <= 3) and root[b] < root[a]:
                    root[a], moved = root[b], True
    return {(i, t, root.get((i, t))) for i, t in rows}


EDGE = [(1, "a b c d e"), (2, "A B C D E"), (3, None), (4, ""), (5, " \t\n"), (None, "a b c d e"), (6, "one"), (7, "one two"), (7, "one two"), (8, "é\xa0ü"), (9, "x " * 3000)]
EDGE += [(20, "p q r s"), (20, "v w x y z"), (19, "v w x y z"), (18, "p q r s"), (21, "v w x y z u")]  # one id with two texts


def test_fingerprint_matches_definition(spark):
    for _, t in EDGE:
        assert simhash.text_fingerprint(t) == brute_fp(t)
    long = " ".join(f"w{i % 977}x{i}" for i in range(200_000))
    assert simhash.text_fingerprint(long) == brute_fp(long)


def test_components_edge_rows(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in EDGE], "doc_id long, text string, component_id string, fp string")
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.components(df).collect()}
    assert got == {(i, brute_fp(t), c) for i, t, c in brute_components(EDGE)}
    assert simhash.components(df.where("false")).count() == 0


@pytest.mark.parametrize("hot", [8192, 2])
def test_links_match_brute_force_also_in_hot_buckets(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(int(x) for x in base) | {0, 2**64 - 1, 1, 3, 7, 15}
    for x in list(fps):
        for _ in range(25):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.links(df, hot).collect()}
    want = {frozenset((signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    assert got == want


def test_connected_components_on_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 61)} | {1000 + i: 1000 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


ASSIGN = re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:word|WORD|Word)|passwd|PASSWD|secret|SECRET|token|Token|TOKEN|api_?key|API_?KEY)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    text, out = text or "", []
    out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


LIVE = "Zx9Qw8Er7Ty6Ui5Op4As3D"
SECRETS = [
    (1, f"é🙂 password = 'hunter2hunter2' and token:{'0a' * 20} AKIA{'Z9' * 8}", "s0"),
    (2, "token=token: abcdefghij secret=short API_KEY: \"abc.def-123/=\"", "s1"),
    (3, None, "s1"),
    (4, "", None),
    (5, f"copied {LIVE}x5 here", "s1"),
    (6, f"copied {LIVE}x5 there", "s2"),
    (7, f"ö own {LIVE}y7 here {LIVE}y7", "s2"),
    (7, f"ö own {LIVE}y7 here {LIVE}y7", "s2"),
    (None, f"AKIA{'Q' * 16} {'f' * 64}AKIA", "s3"),
    (8, "AKIASHORT1 deadbeef " + "x" * 50_000 + " passwd:12345678", "s3"),
]


def test_secret_spans(spark):
    df = spark.createDataFrame([(i, t, s, "clash") for i, t, s in SECRETS], "doc_id long, text string, source string, spans string")
    rows = secrets.scan(df).select("doc_id", "n_assign", "n_access", "n_hex", secrets.span_text(F.col("base")).alias("base"), secrets.span_text(F.col("spans")).alias("spans")).collect()
    want = []
    for i, t, _ in SECRETS:
        base = brute_base(t)
        want.append((i, *(sum(k == b[0] for b in base) for k in ("assign", "access", "hex")), ",".join(f"{k}:{a}:{b}" for k, a, b in base)))
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    live = {r.doc_id: r.spans for r in rows}
    assert live[5] == live[6] == ""
    assert live[7] == "live:6:30,live:36:60"
    assert len(rows) == len(SECRETS)
    assert secrets.scan(df.where("false")).count() == 0


def test_redact_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(i, t, s) for i, t, s in SECRETS], "doc_id long, text string, source string")
    out = secrets.redact(df)
    assert out.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert len(texts) == len(SECRETS)
    assert (3, None) in texts and (5, SECRETS[4][1]) in texts and (7, "ö own [SECRET] here [SECRET]") in texts
    for i, t in texts:
        assert not brute_base((t or "").replace("[SECRET]", " "))


def test_a_value_in_many_repositories_of_one_owner_is_copied(spark):
    rows = [(i, f"sample {LIVE}h1 {i}", "hot") for i in range(40)] + [(i, f"own {LIVE}h2", "hot") for i in (100, 101)] + [(200, f"secret={LIVE}h1", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = {r.doc_id: (r.n_live_looking, r.n_copied, r.spans) for r in secrets.scan(df).withColumn("spans", secrets.span_text(F.col("spans"))).collect()}
    assert all(seen[i] == (0, 0, "") for i in range(40))
    assert seen[100] == seen[101] == (1, 0, "live:4:28") and seen[200][:2] == (0, 1)
    assert {r.text for r in secrets.redact(df).where("doc_id < 40").collect()} == {t for i, t, _ in rows if i < 40}


def jaccard(a, b, k=5):
    cut = lambda t: {" ".join(w) for w in zip(*((t or "").lower().split()[i:] for i in range(k)))} or {(t or "").lower()}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_near_components_and_keep_one(spark):
    g = np.random.default_rng(9)
    word = lambda: "".join(g.choice(list("abcdefghijklmnop"), g.integers(2, 9)))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(200)]
        rows.append((n := n + 1, " ".join(base)))
        rows.append((n := n + 1, " ".join(base).upper()))  # case alone
        for edits in (1, 2, 4, 40):
            w = list(base)
            for i in g.choice(200, edits, replace=False):
                w[i] = word()
            rows.append((n := n + 1, " ".join(w)))
    rows += [(900, ""), (901, None), (902, "a b"), (903, "a b"), (None, rows[0][1]), (904, "alone " + rows[0][1][:40]), (1, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, f int")
    ids = [(i, t) for i, t in rows if i is not None]
    root = {i: i for i, _ in ids}
    moved = True
    while moved:
        moved = False
        for a, s in ids:
            for b, t in ids:
                if jaccard(s, t) >= 0.8 and root[a] < root[b]:
                    root[b], moved = root[a], True
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted([i for i, _ in ids if root[i] == i] + [None], key=str)
    assert simhash.keep_one(df.where("false")).count() == 0


def test_near_components_of_a_star_whose_original_has_a_middle_id(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = [(100, " ".join(base))]
    for i in [*range(1, 76), *range(101, 176)]:
        words = list(base)
        for at in (rng.randrange(5, 45), rng.randrange(55, 95), rng.randrange(105, 145), rng.randrange(155, 195)):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    found = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found if r.root == 1} == {i for i, _ in rows}


def test_near_components_of_equal_words_in_other_orders(spark):
    words = [f"w{i}" for i in range(60)]
    mixed = [words[i * 7 % 60] for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(mixed)), (3, "  ".join(mixed)), (4, " ".join(mixed + mixed[:1]))]
    found = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.root) for r in found} == {(1, 1), (2, 2), (3, 2), (4, 2)}


def test_near_components_by_earlier_texts(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, x, y = prose(200), prose(200), prose(80), prose(90)
    before = [(1, a), (2, a + " end"), (3, b), (4, a), (5, x + " " + prose(300)), (6, x + " " + prose(300)), (9, a)]
    now = [(1, a), (2, "end of it"), (3, b), (5, x), (6, x), (7, y), (8, y + " more")]  # 4 and 9 went before, 7 and 8 are new
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_components(frame(now), earlier=frame(before)).collect()
    assert {(r.doc_id, r.root) for r in found} == {(1, 1), (2, 1), (3, 3), (5, 5), (6, 5), (7, 7), (8, 7)}


def test_pairs_of_a_large_family_grow_with_its_size(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(2000):
        words = list(base)
        words[rng.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(words)))
    made, keep = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: made.append((name, out := keep(df, name))) or out)
    found = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 2000 and {r.root for r in found} == {0}
    assert sum(df.count() for name, df in made if name == "near-met") <= 40 * len(rows)
