"""Importance resampling towards a target distribution: hashed word counts, scored weights, exact selection of the cutoff.

The gains of all buckets are one array of fixed length; a document's weight is the sum of its features' gains, plus a
Gumbel number that follows from its id: the highest scores are a draw without replacement in proportion to exp(weight).
The cutoff is found by weighted median of medians: each part of the stored scores gives its median and how many keys it
still holds, the weighted median of these medians is the pivot, and at least a quarter of the remaining keys is on the
wrong side of it, whatever their distribution. Only medians and counts of parts reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlefold.llm.common import scratch, stored, word_blocks

#: Capitals become small, what stands between words becomes a space: bytes 0x00-2F, 3A-60 (without capitals), 7B-7F.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256))
_KNOWN = 1 << 18  # words whose bucket is remembered at a time


def features(text: str | None, longest: int = 1) -> Iterator[list[bytes]]:
    """Lists of the runs of 1 to ``longest`` words of a whole text, repeats included, in blocks of bounded size."""
    last: list[bytes] = []
    for block in word_blocks((text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)):
        words, out = last + block, list(block)
        for n in range(2, longest + 1):
            out += [b" ".join(words[i - n + 1 : i + 1]) for i in range(max(len(last), n - 1), len(words))]
        last = words[-(longest - 1) :] if longest > 1 else []
        yield out


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts by bucket: every task sends one row per bucket that it met, ``buckets`` sums come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(buckets, np.int64), Counter()

        def settle() -> None:
            at = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            np.add.at(total, at, np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        for batch in batches:
            for text in batch.column(0):
                for block in features(text.as_py(), longest):
                    words.update(block)
                    if len(words) > _KNOWN:
                        settle()
        settle()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """A bucket's gain: floor of 1000 times the log of its smoothed share in the target over that in the source."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return [math.floor(1000 * math.log((int(b) + 1) * (s + k) / ((int(a) + 1) * (t + k)))) for a, b in zip(source, target)]


def gumbel(doc_id: object, seed: int) -> int:
    """Floor of 1000 times a Gumbel number that follows from SHA-256 of ``seed:id`` (of a null id: ``seed:``)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], seed: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` of every row."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        buckets = len(gain)

        def of(word: bytes) -> int:
            if len(known) > _KNOWN:
                known.clear()
            known[word] = out = gain[zlib.crc32(word) % buckets]
            return out

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_words = n = weight = 0
                for block in features(text.as_py(), longest):
                    for word in block:
                        found = known.get(word)
                        weight += of(word) if found is None else found
                    n += len(block)
                    n_words += sum(b" " not in w for w in block) if longest > 1 else len(block)
                rows.append((doc_id, n_words, n, weight, weight + gumbel(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names)

    return docs.select(F.col(f"`{id_col}`").try_cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


# ---- selection -----------------------------------------------------------------------------------------------------

Key = tuple[int, int, int]
_NO_ID = (1 << 63) - 1  # rows without an id come after all others of their score
_UNLIMITED: tuple[Key, Key] = ((-(1 << 63),) * 3, ((1 << 63) - 1,) * 3)


def cutoff(keys: DataFrame, k: int, enough: int = 20_000, max_rounds: int = 400) -> Key | None:
    """The ``k``-th smallest of the different keys (``a``, ``b``, ``c``, all long), exactly; None for ``k`` = 0.

    A round reads the keys once. Every part sends the median of its keys that are left and their number; the weighted
    median of medians becomes the pivot, of which the next round also counts the keys up to it. When no more than
    ``enough`` keys are left they come to the driver: a bound that does not depend on the input.
    """
    if k < 1:
        return None
    low, high, pivot, before = *_UNLIMITED, None, 0  # keys in (low, high] are left; ``before`` are at most low
    for _ in range(max_rounds):
        parts = _parts(keys, low, high, pivot).collect()
        if pivot is not None:
            upto = before + sum(p.upto for p in parts)
            if upto >= k:
                high, left = pivot, [(p.low_n, (p.la, p.lb, p.lc)) for p in parts if p.low_n]
            else:
                low, before, left = pivot, upto, [(p.high_n, (p.ha, p.hb, p.hc)) for p in parts if p.high_n]
        else:
            left = [(p.high_n, (p.ha, p.hb, p.hc)) for p in parts if p.high_n]
        n = sum(w for w, _ in left)
        if n <= enough:
            rest = sorted(tuple(r) for r in keys.where(_between(low, high)).select("a", "b", "c").collect())
            return rest[k - before - 1]
        half = 0
        for w, key in sorted(left, key=lambda x: x[1]):
            half += w
            pivot = key
            if 2 * half >= n:
                break
    raise RuntimeError(f"no cutoff after {max_rounds} rounds")


def _between(low: Key, high: Key):
    at = F.struct("a", "b", "c")
    point = lambda x: F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(x, "abc")])
    return (at > point(low)) & (at <= point(high))


def _parts(keys: DataFrame, low: Key, high: Key, pivot: Key | None) -> DataFrame:
    """Per part and side of the pivot: how many keys in (low, high] there are and their (lower) median. One row a task."""
    names = ["upto", "low_n", "la", "lb", "lc", "high_n", "ha", "hb", "hc"]

    def median(x: np.ndarray) -> tuple[int, ...]:
        at, out = (len(x) - 1) // 2, [0, 0, 0]
        for i, c in enumerate("abc" if len(x) else ""):  # the first part decides, then the others among equal ones
            v = x[c]
            out[i] = int(np.partition(v, at)[at])
            at -= int((v < out[i]).sum())
            x = x[v == out[i]]
        return tuple(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[list[np.ndarray]] = [[], []]
        for batch in batches:
            x = np.empty(len(batch), [(c, np.int64) for c in "abc"])
            for i, c in enumerate("abc"):
                x[c] = batch.column(i).to_numpy()
            under = _at_most(x, pivot) if pivot is not None else np.zeros(len(x), bool)
            sides[0].append(x[under])
            sides[1].append(x[~under])
        a, b = (np.concatenate(s) if s else np.empty(0, [(c, np.int64) for c in "abc"]) for s in sides)
        row = [len(a), len(a), *median(a), len(b), *median(b)]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names)

    return keys.where(_between(low, high)).select("a", "b", "c").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _at_most(x: np.ndarray, key: Key) -> np.ndarray:
    a, b, c = (x[n] for n in "abc")
    return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c <= key[2]))))


def ranked(winners: DataFrame) -> DataFrame:
    """``c`` and ``rank`` (from 1) in order of (``a``, ``b``, ``c``): a range sort, the sizes of the ranges summed up before."""
    order = ["a", "b", "c"]
    rows = winners.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("i", F.monotonically_increasing_id())
    rows = stored(rows.select("c", F.shiftright("i", 33).alias("part"), F.col("i").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "resample-sorted")
    sizes, before, start = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}, 0, {}  # one row a task
    for part in sorted(sizes):
        start[part] = before
        before += sizes[part]
    offsets = winners.sparkSession.createDataFrame(list(start.items()) or [(0, 0)], "part long, start long")
    return rows.join(F.broadcast(offsets), "part").select("c", (F.col("start") + F.col("at") + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", enough: int = 20_000,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` (null: not drawn) for every row of ``docs``.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn: the highest scores, ties to the
    smaller id. Repeated rows are documents of their own; rows of one id and score rank in the order they were stored in.
    Rows without an id, or whose id is no number, are scored as id null and come last among equal scores. Null and empty
    texts have no features and weight 0. An empty target or table is legal: all gains follow from the smoothing. Only the
    named columns are read, so further columns cannot clash.
    """
    with scratch(docs.sparkSession):
        gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
        rows = scored(docs, gain, seed, longest, id_col, text_col).withColumn("c", F.monotonically_increasing_id())
        rows = stored(rows, "resample-scores", keep=True)
        keys = rows.where(F.col("n_words") >= least_words).select((-F.col("score")).alias("a"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("b"), "c")
        last = cutoff(keys, percent * keys.count() // 100, enough)
        won = keys.where(_between(_UNLIMITED[0], last)) if last else keys.limit(0)
        ranks = stored(ranked(won), "resample-ranks", keep=True)
    return rows.hint("merge").join(ranks.hint("merge"), "c", "left").select("doc_id", "n_features", "weight", "score", "rank")
