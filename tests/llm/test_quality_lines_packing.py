import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F

from candlefold.llm import linededup, packing, quality
from candlefold.llm.common import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = ["", None, " \n\t ", "a b c a b c", "x\nx\n\n x\ny # $ é", "a a a a a", "one two", "w " * 4000, "p q r s p q r t\n" * 3, "Ünï code\xa0b <|> & *"]


def test_counts():
    for t in TEXTS:
        assert quality.text_counts(t)[:5] == brute_counts(t), t


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.3), (20, 20, 0.5), (2, 600, 0.005)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.exp(quality.log_binomial_tail(k, n, p)) == pytest.approx(want)


def test_judge(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"w{i}###" for i in range(60))
    docs = [(i, good + f" {i}", "en") for i in range(3000)] + [(10_000 + i, bad + f" {i}", "en") for i in range(50)]
    docs += [(20_000, bad, "fr"), (20_001, None, "en"), (20_002, "", None), (20_003, good, None), (20_003, good, None), (None, good, "en")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] + [(10_000 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(df, labels).collect()
    assert len(rows) == len(docs)
    kept = Counter((r.doc_id, r.kept) for r in rows)
    assert all(kept[i, True] for i in range(3000))
    assert all(kept[10_000 + i, False] for i in range(50))  # also the unlabelled ones
    assert kept[20_000, True]  # no safe cutoff without labels of its stratum
    assert kept[20_001, False] and kept[20_002, False] and kept[20_003, True] == 2 and kept[None, True] == 1
    out = quality.keep(df, labels)
    assert out.columns == df.columns and out.count() == sum(r.kept for r in rows)
    assert quality.judge(df.where("false"), labels).count() == 0
    assert quality.judge(df, labels.where("false")).where("kept").count() == sum(not r.base_failed for r in rows)


def brute_cutoffs(rows, alpha, delta, target):
    """rows: id, stratum, quality, rule values. Tries every cutoff one by one, with exact binomial sums."""
    rules, strata = list(quality.CUTOFFS), sorted({s for i, s, q, _ in rows if q == 1 and not half(i)})
    out = {}
    for stratum in {s for _, s, _, _ in rows}:
        mine = [r for r in rows if r[1] == stratum]
        good, bad, held = ([v for i, _, q, v in mine if q == want and half(i) == side] for want, side in ((1, True), (0, True), (1, False)))
        picks = []
        for place, rule in enumerate(rules):
            hits = [(-sum(v[rule] >= c for v in bad), n, c) for n, c in enumerate(quality.CUTOFFS[rule]) if sum(v[rule] >= c for v in good) <= target * len(good)]
            if hits and min(hits)[0]:
                picks.append((min(hits)[0], place, rule, min(hits)[2]))
        chosen = {}
        for _, _, rule, cutoff in sorted(picks):
            trial = chosen | {rule: cutoff}
            k, n = sum(any(v[r] >= c for r, c in trial.items()) for v in held), len(held)
            if not n or sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) > delta / len(strata):
                break
            chosen = trial
        out |= {(stratum, r): c for r, c in chosen.items()}
    return out


def half(i):
    return hashlib.md5(str(i).encode()).hexdigest()[-1] < "8"


def test_chosen_cutoffs_match_brute_force_on_mixed_labels(spark):
    g, rows = random.Random(4), []
    for i in range(6000):
        stratum = g.choice(["en", "en", "en", "de", "fr", "xx"])  # fr's good texts are loud, xx has few labels
        mark = int(g.random() < 0.7) if stratum != "xx" or i < 400 else None
        n = g.randrange(60, 120)
        words = [f"w{g.randrange(10**6)}" for _ in range(n)]
        loud = 0.02 if mark else g.choice([0.0, 0.4, 0.9])
        if stratum == "fr" and g.random() < 0.2:
            loud = 0.8
        words = [w + "#" if g.random() < loud else w for w in words]
        if not mark and g.random() < 0.4:
            words = [w.upper() for w in words]
        if g.random() < (0.03 if mark else 0.5):
            words[: n // 2] = ["same"] * (n // 2)
        rows.append((i, " ".join(words), stratum, mark))
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    measured = df.select("doc_id", F.col("lang").alias("stratum"), quality.counts(F.col("text")).alias("c"))
    values = []
    for i, text, stratum, mark in rows:
        f = dict(zip(quality.FIELDS, quality.text_counts(text)))
        if mark is not None and f["n_words"] >= 50 and 100 * f["n_repeat_words"] <= 50 * f["n_words"]:
            v = {"symbol_ratio": f["n_symbols"] / f["n_words"], "dup_line_ratio": f["n_dup_lines"] / f["n_lines"], "repeat_ratio": f["n_repeat_words"] / f["n_words"],
                 "upper_ratio": f["n_upper"] / f["word_chars"], "reuse_ratio": (f["n_words"] - f["n_distinct"]) / f["n_words"]}
            values.append((i, stratum, mark, v))
    got = {(r.stratum, r.rule): r.cutoff for r in quality.select_cutoffs(measured, labels).collect()}
    assert got == brute_cutoffs(values, 0.05, 0.05, 0.002)
    assert {s for s, _ in got} == {"en", "de", "fr"} and ("fr", "symbol_ratio") not in got and ("en", "symbol_ratio") in got
    assert quality.text_counts("ab cd\n" * 400_000)[:5] == (800_000, 1_600_000, 0, 399_999, 800_000)  # a very long text


def brute_strip(rows, least=50):
    """Later repeated runs of at least ``least`` words, by comparing every stretch of lines."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    seen, cut = {}, {}
    lines = {d: [(p, x) for p, x in enumerate(d[2].split("\n")) if x.split()] for d in docs}
    for n, d in enumerate(docs):
        ls = lines[d]
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                if sum(len(x.split()) for _, x in ls[a : b + 1]) >= least:
                    seen.setdefault(tuple(x for _, x in ls[a : b + 1]), (n, a))
    for n, d in enumerate(docs):
        ls = lines[d]
        gone = set()
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                if sum(len(x.split()) for _, x in ls[a : b + 1]) >= least and seen[tuple(x for _, x in ls[a : b + 1])] < (n, a):
                    gone |= set(range(ls[a][0], ls[b][0] + 1))
        cut[d] = "\n".join(x for p, x in enumerate(d[2].split("\n")) if p not in gone)
    return [(i, None if t is None else cut[i is None, i or 0, t]) for i, t in rows]


def line(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


LONG = line("L", 60)
RUN = [line("r", 20), line("s", 25), "", line("t", 10), line("u", 3)]
LINES = [
    (1, "\n".join([line("a", 10), *RUN, line("b", 5)])),
    (2, "\n".join([line("c", 12), *RUN, line("d", 5), LONG])),
    (3, "\n".join(["x", LONG, line("short", 9)])),
    (4, "\n".join([line("short", 9), line("short", 9), "x", RUN[0], RUN[1]])),
    (5, "\n".join([LONG] * 4)),
    (6, "\n".join([line("q", 30)] * 7)),
    (7, LONG), (7, LONG), (8, None), (9, ""), (10, "\n\n"), (None, LONG + "\n" + line("z", 4)),
    (11, "\n".join([RUN[1], "", RUN[3], RUN[4], line("v", 40)])), (12, "\n".join([RUN[3], RUN[4], line("v", 40)])),
    (13, "\n".join([line("k", 1)] * 300)),
]


def test_line_dedup_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, 0, "r") for i, t in LINES], "doc_id long, text string, n_chars long, runs string")
    got = linededup.dedup(df).select("row.doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(brute_strip(LINES), key=str)
    out = linededup.strip(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert 7 not in ids and {1, 2, 8, 9, 10} <= set(ids)  # emptied documents go, empty ones stay
    assert linededup.dedup(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PACK = [(1, "hello world"), (2, ""), (3, None), (4, "a" * 30_000), (5, "the cat " * 3000), (5, "again"), (None, "no id"), (6, "x <|endoftext|> y   é🙂\x00 don't I'LL"), (7, "word " * 700), (8, " " * 5000)]


def test_packing_round_trip(spark, tokenizer):
    df = spark.createDataFrame([(i, t, 1) for i, t in PACK], "doc_id long, text string, offset int").coalesce(1)
    rows = packing.pack(df, group_tokens=3000).collect()
    ids = {}
    for i, t in PACK:
        ids.setdefault(i, []).append(array("I", tokenizer.encode(t or "", add_special_tokens=False).ids + [0]))
    spans, sequences = Counter(), {}
    for r in rows:
        assert any(len(d) == r.doc_tokens and zlib.crc32(memoryview(d)[r.start : r.start + r.length]) == r.ids_crc32 for d in ids[r.doc_id])
        spans[r.doc_id, r.doc_tokens] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert spans == Counter({(i, len(d)): len(d) for i, ds in ids.items() for d in ds})
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(df.where("false")).count() == 0


def test_balance_evens_out_cost():
    placed, over = packing.balance([400] * 4 + [100] * 20 + [48], [1024] * 3 + [576], 1.0, 1 / 1024)
    assert not over or sum(n for _, _, n in over) == 400 * 4 + 100 * 20 + 48 - 3648
    cost = Counter()
    for _, _, n, s in placed:
        cost[s] += n + n * n / 1024
    assert max(cost[s] for s in range(3)) < 1.25 * min(cost[s] for s in range(3))
