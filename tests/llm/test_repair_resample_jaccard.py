"""Conversation repair against a plain dynamic programme, resampling against plain sums, the Jaccard join against all pairs."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from candlefold.llm import conversations, jaccard, resample

# ---- conversations -------------------------------------------------------------------------------------------------


def brute_repair(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = plain_dp([(r[1], r[2], f) for r, f in zip(rows, faults)])
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain_dp(rows):
    """Over rows from the last to the first; up to three inserts before each row and at the end."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ()), "a": (0, "", ())}

    def with_inserts(best):
        done = {}
        for state in legal:
            options = [best[state]] if state in best else []
            at, cost, audit, lines = state, 0, "", ()
            for _ in range(3):
                role = "assistant" if at == "u" else "user"
                at, cost, audit, lines = role[0], cost + 3, audit + "I", lines + (f"{role}:",)
                if at in best:
                    c, a, li = best[at]
                    options.append((cost + c, audit + a, lines + li))
            if options:
                done[state] = min(options)
        return done

    best = with_inserts(best)
    for role, text, fault in reversed(rows):
        now = {}
        for state in legal:
            options = []
            if state in best:
                c, a, li = best[state]
                options.append((c + 4, "D" + a, li))
            if fault not in ("blank", "duplicate"):
                for new, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if new[:1] and new[:1] in legal[state] and new[:1] in best:
                        c, a, li = best[new[:1]]
                        options.append((c + price + 3 * (fault == "truncated"), letter + a, (f"{new}:{text}",) + li))
            if options:
                now[state] = min(options)
        best = with_inserts(now)
    return best[""]


def random_conversations(seed, n=60):
    rng, table = random.Random(seed), []
    texts = ["Hello.", "Yes!", "no", "", "  \n", "Why?", "cut off", "Fine. ", "é…", None]
    for conv in [*range(n), None]:
        for i in range(rng.choice([1, 2, 3, 8, 20])):
            turn = None if rng.random() < 0.05 else i + (rng.random() < 0.1) * 3
            table.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    return table + rng.sample(table, 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_is_the_plain_dynamic_programme(spark, seed, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 5)  # conversations of several blocks
    table = random_conversations(seed)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit("x"), "h": F.lit(1), "seq": F.lit(2)})
    got = conversations.repair(df).collect()
    assert len(got) == 61 and {r.conv_id: tuple(r)[1:] for r in got} == brute_repair(table)


def test_repair_of_a_hot_conversation_and_of_nothing(spark):
    n = 12_000
    hot = spark.range(n).select(F.lit(7).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text")).withColumnRenamed("id", "turn")
    table = [tuple(r) for r in hot.collect()]
    [row] = conversations.repair(hot.repartition(6)).collect()
    assert tuple(row)[1:] == brute_repair(table)[7]
    assert conversations.repair(hot.limit(0)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    [row] = conversations.repair(spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_texts_go_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_BYTES", 100)
    table = [(c, i, ("user", "assistant")[i % 2], "word " * (30 * (1 + i + c)) + f"{i}.") for c in range(4) for i in range(12)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: tuple(r)[1:] for r in conversations.repair(df).collect()} == brute_repair(table)


def test_grammar_changes_no_result():
    rng = random.Random(3)
    plain, packed = conversations.Grammar(), conversations.Grammar()
    for pair in ("ua", "XX", "uA"):
        packed.add(pair)
    packed.add("一一")
    packed.add("七s")
    for _ in range(400):
        seq = "".join(rng.choice("uauauasoSUAOX") for _ in range(rng.randint(1, 40)))
        assert plain.solve(seq) == packed.solve(seq)
    assert packed.solve("ua" * 50) == (0, "K" * 100) and len(packed.compress("ua" * 50)) == 25


# ---- resampling ----------------------------------------------------------------------------------------------------


def brute_resample(docs, bench, percent=10):
    words = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for texts, counts in (([x for _, x in docs], s), (bench, t)):
        for text in texts:
            for w in words(text):
                counts[bucket(w)] += 1
    n, m = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (n + 10000) / ((a + 1) * (m + 10000)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        ws = words(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in ws)
        rows.append([doc_id, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return rows


def random_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "x_y", "a1-b2", "日本"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize("enough", [1, 20_000])
def test_resample_is_the_plain_draw(spark, enough):
    docs = [(i, x) for i, x in enumerate(random_texts(5, 400))] + [(900, None), (901, ""), (None, "w1 " * 30)]
    bench = random_texts(6, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"c": F.lit(0), "a": F.lit(1), "rank": F.lit("x"), "weight": F.lit(1)}).repartition(7)
    got = resample.resample(df, spark.createDataFrame([(x,) for x in bench], "text string"), percent=30, enough=enough)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((list(r) for r in got.collect()), key=key) == sorted(brute_resample(docs, bench, 30), key=key)


def test_resample_of_ties_repeated_rows_and_nothing(spark):
    same = spark.createDataFrame([(1, "w " * 25)] * 50 + [(2, "w " * 25)] * 50, "doc_id long, text string")
    empty = same.limit(0).select("text")
    ranks = [r["rank"] for r in resample.resample(same, empty, percent=30, enough=1).collect()]
    assert sorted(x for x in ranks if x) == list(range(1, 31)) and len(ranks) == 100
    assert resample.resample(same.limit(0), empty).collect() == []


def test_features_of_several_words_cross_blocks():
    text = "Aa bb cc dd"
    assert sorted(w for b in resample.features(text, 2) for w in b) == sorted([b"aa", b"bb", b"cc", b"dd", b"aa bb", b"bb cc", b"cc dd"])


# ---- Jaccard join --------------------------------------------------------------------------------------------------


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(docs, percent=80):
    sets = [(d, shingles(x)) for d, x in docs]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


def family(rng, n, words, changes, at=0):
    base = [f"b{rng.random()}" for _ in range(words)]
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(*changes)):
            text[rng.randrange(words)] = f"c{rng.random()}"
        yield at + i, " ".join(text)


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [*family(rng, 60, 120, (0, 4)), *family(rng, 40, 300, (3, 9), 100), *family(rng, 30, 12, (0, 1), 200), *family(rng, 30, 7, (0, 2), 300)]
    docs += [(400 + i, passage + " " + " ".join(f"q{rng.random()}" for _ in range(rng.choice([5, 10, 14, 60])))) for i in range(60)]
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE two"), (505, "one two three"), (506, "a " * 3000), (507, "a " * 50)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"t": F.lit(1), "n": F.lit(2), "slot": F.lit("x"), "root": F.lit(None).cast("string")}).repartition(5)
    got = sorted(tuple(r) for r in jaccard.components(df).collect())
    assert got == brute_components(docs)


def test_a_star_whose_centre_is_not_the_smallest_id(spark):
    rng = random.Random(9)
    centre = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(120):
        text = list(centre)
        for j in range(0 if i == 60 else 4):
            text[rng.randrange(j * 50, j * 50 + 50)] = f"c{rng.random()}"
        docs.append((i, " ".join(text)))
    got = sorted(tuple(r) for r in jaccard.components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute_components(docs) and {c for _, _, c in got} == {0}


def test_frequent_tokens_are_dealt_out_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "CELLS", 1 << 8)  # a sketch that is full
    rng = random.Random(10)
    docs = [*family(rng, 50, 80, (0, 3)), *family(rng, 50, 60, (0, 5), 100)]
    got = sorted(tuple(r) for r in jaccard.components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute_components(docs)


def test_repeated_ids_and_rows_without_id(spark):
    docs = [(5, "a b c d e f"), (5, "g h i j k l"), (9, "G H i j k l"), (3, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")]
    got = sorted((tuple(r) for r in jaccard.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (9, 2, 3), (3, 2, 3), (3, 2, 3), (None, 2, None)], key=str)
    assert jaccard.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefixes_meet_under_every_order():
    import numpy as np

    rng, sketch = np.random.default_rng(1), np.random.default_rng(2).integers(0, 9, jaccard.CELLS).astype(np.uint32)
    for n in (1, 4, 5, 9, 50, 333):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = n // 9
        t = np.unique(np.r_[s[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)])
        if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t)):
            for order in range(3):
                assert len(np.intersect1d(jaccard.prefix(s, sketch, order, 80), jaccard.prefix(t, sketch, order, 80)))
