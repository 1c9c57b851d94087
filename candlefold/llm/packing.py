"""Cost-balanced packing of token sequences.

A task tokenises its documents and packs them in groups of about ``group_tokens`` tokens. A group of T tokens gets
T // 1024 sequences. Whole documents go in descending length to the sequence of lowest estimated cost, ``linear`` x
length plus ``quadratic`` x the sum of squared piece lengths (attention stays inside a document), that still has room
for them. What fits nowhere is cut to fill the gaps, lowest cost first, so no sequence is padded; what is over goes to the
task's next group. A task's last tokens, under 1024, become sequences whose lengths are powers of two.

There is no shuffle: the packing of one input split depends on that split alone, and repeating a lost task gives the same
sequences under the same ids.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def encoder(ranks_path: str | None = None) -> tiktoken.Encoding:
    """The byte-level BPE from its vocabulary's ranks: the ids of the tokenizers library's JSON of it, in a quarter of the time."""
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def balance(lengths: list[int], capacities: list[int], linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Place pieces of the given lengths; returns (piece, start in it, length, sequence) and what is over (piece, start, length).

    Capacities are filled fully if the lengths reach their sum.
    """
    cost, room = np.zeros(len(capacities)), np.array(capacities, dtype=np.int64)
    placed, cut = [], []

    def put(piece: int, start: int, n: int, seq: int) -> None:
        placed.append((piece, start, n, seq))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[piece]
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(piece, 0, n, int(fits[np.argmin(cost[fits])]))
        else:
            cut.append(piece)
    gaps = iter(sorted(np.flatnonzero(room).tolist(), key=lambda s: (cost[s], s)))
    over, seq = [], next(gaps, None)
    for piece in cut:
        start, n = 0, lengths[piece]
        while n and seq is not None:
            part = min(n, int(room[seq]))
            put(piece, start, part, seq)
            start, n = start + part, n - part
            if not room[seq]:
                seq = next(gaps, None)
        if n:
            over.append((piece, start, n))
    return placed, over


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_tokens: int = 1 << 20,
    linear: float = 1.0, quadratic: float = 1.0 / 1024, ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Every document ends with id 0; an empty or null text is that id alone. A text is cut into full sequences first, the
    rest is packed. Rows with a null id or the same id are packed as documents of their own. No other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode
        base, made = TaskContext.get().partitionId() << 36, 0
        out: list[tuple] = []
        group: list[tuple] = []  # doc id, ids, start, length
        tokens = 0

        def emit(item: tuple, start: int, n: int, seq: int, offset: int) -> None:
            doc, ids, at, _ = item
            view = memoryview(ids)[at + start : at + start + n]
            out.append((doc, at + start, n, zlib.crc32(view), len(ids), seq, offset))

        def flush(last: bool) -> None:
            nonlocal group, tokens, made
            full = tokens // length
            sizes = [length] * full
            if last:
                rest = tokens % length
                sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
            placed, over = balance([g[3] for g in group], sizes, linear, quadratic)
            offsets = [0] * len(sizes)
            for piece, start, n, seq in placed:
                emit(group[piece], start, n, base + made + seq, offsets[seq])
                offsets[seq] += n
            made += len(sizes)
            group = [(group[p][0], group[p][1], group[p][2] + s, n) for p, s, n in over]
            tokens = sum(g[3] for g in group)

        def batch() -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            cols = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                ids = array("I", encode(text.as_py() or "", allowed_special="all"))
                ids.append(END_ID)
                doc, whole = doc.as_py(), len(ids) // length
                for k in range(whole):
                    emit((doc, ids, 0, 0), k * length, length, base + made, 0)
                    made += 1
                if rest := len(ids) - whole * length:
                    group.append((doc, ids, whole * length, rest))
                    tokens += rest
                if tokens >= group_tokens:
                    flush(False)
            if len(out) >= 10_000:
                yield batch()
        if group:
            flush(True)
        yield batch()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, SCHEMA)
