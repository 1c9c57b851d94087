"""Jaccard join of shingle sets by prefix filters under several global orders.

Two sets of at least the similarity share a token among the first n - ceil(similarity n) + 1 of either, under every order
of all tokens. Three orders are used: all put tokens that many texts hold last, and break ties by another hash. Candidates
meet by a prefix token of the first order; sizes, places and then common prefix tokens under the second and third order
must allow the similarity as well, before the sets themselves are compared. No filter loses a pair.

How often a token occurs is read from a sketch of fixed size (counts by hash, summed over all texts): it only orders the
tokens, so a sketch that fills up costs time, never links. Equal sets are one node. Components come from rounds: each slot
(token) pairs all its texts with one lead, what links contracts, and slots that still hold several components take more
leads, until each is one component or no two of its texts are left without a lead among them: a family of copies never
comes to all its pairs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlefold.llm.common import connected_components, scratch, stored, word_blocks

SEED = 42
#: Cells of the sketch, pieces it is shuffled in, and estimated texts from which a token's slot is dealt to many tasks.
CELLS, PIECES, HOT = 1 << 21, 64, 2048
#: Ids that are broadcast (a few MB) to fetch their texts; a merge join beyond.
BROADCAST_IDS = 500_000
_SALTS = 32
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray, step: int) -> np.ndarray:
    """Another hash of each number; one for each ``step``."""
    h = h ^ np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for m in _MIX:
        h = (h ^ h >> np.uint64(33)) * np.uint64(m)
    return h ^ h >> np.uint64(33)


def tokens(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The sorted different 64-bit hashes of a whole text's shingles, A-Z lower-cased; of fewer words the sequence is one."""
    known: dict[bytes, int] = {}
    runs = []
    for block in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        for word in set(block) - known.keys():
            known[word] = xxhash.xxh64_intdigest(word, SEED)
        runs.append(np.fromiter(map(known.__getitem__, block), np.uint64, len(block)))
    if not runs:
        return np.zeros(0, np.uint64)
    run = np.concatenate(runs)
    k = min(shingle_words, len(run))
    out = np.full(len(run) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out ^ run[i : len(run) - k + 1 + i], i + 1)
    return np.unique(out)


def _identity(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def _told(text: str | None, shingle_words: int) -> tuple[int, np.ndarray]:
    s = tokens(text, shingle_words)
    return _identity(s), s


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(s: np.ndarray, sketch: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set under one of the orders: by the magnitude of the sketch's count, then by a hash."""
    level = np.bitwise_count(_filled(sketch[s % np.uint64(len(sketch))]))
    first = np.lexsort((_mixed(s, 16 + order), level))
    return s[first[: _prefix_length(len(s), percent)]]


def _filled(x: np.ndarray) -> np.ndarray:
    """All bits below the highest set one: their number is the magnitude."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16):
        x |= x >> np.uint32(k)
    return x


# ---- tables --------------------------------------------------------------------------------------------------------


def pieces(sketch: np.ndarray) -> list[pa.Array]:
    """A sketch as ``PIECES`` rows: columns ``piece`` and ``counts`` (compressed)."""
    width = len(sketch) // PIECES
    return [pa.array(range(PIECES), pa.int32()), pa.array([zlib.compress(sketch[i * width : (i + 1) * width].tobytes(), 1) for i in range(PIECES)], pa.binary())]


def described(rows: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id``, ``t`` (64-bit identity of the set), ``n`` for every row; and, with ``piece`` set, each task's sketch in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, np.uint32)
        names = ["doc_id", "t", "n", "piece", "counts"]
        for batch in batches:
            t, n = [], []
            for text in batch.column(1):
                s = tokens(text.as_py(), shingle_words)
                np.add.at(sketch, s % np.uint64(CELLS), np.uint32(1))
                t.append(_identity(s))
                n.append(len(s))
            k = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if sketch.any():
            empty = pa.nulls(PIECES, pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, *pieces(sketch)], names)

    return rows.mapInArrow(run, "doc_id long, t long, n long, piece int, counts binary")


def summed(pieces: DataFrame) -> np.ndarray:
    """The whole sketch from all tasks' pieces: summed on the executors, ``PIECES`` rows of fixed size reach the driver."""
    width = CELLS // PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(width, np.uint64))
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[piece] += np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
        for piece, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["piece", "counts"])

    out = np.zeros(CELLS, np.uint32)
    for row in pieces.select("piece", "counts").repartition(PIECES, "piece").mapInArrow(run, "piece int, counts binary").collect():
        out[row.piece * width : (row.piece + 1) * width] = np.frombuffer(row.counts, np.uint32)
    return out


def meeting(rows: DataFrame, sketch, shingle_words: int, percent: int, read: Callable[[int, str | None], tuple[int, np.ndarray]] | None = None) -> DataFrame:
    """``slot``, ``t``, ``n``, ``at``, ``hot``: the prefix tokens under the first order that at least two different sets hold, with
    the token's place in the prefix from 1; ``hot`` is above 0 where the sketch calls the token frequent.

    Postings of a token are brought together by hash and order, and dropped as they stream by if they are alone. Those
    of tokens that the sketch calls frequent are shared anyway and are dealt to many tasks.

    ``read`` makes a row's name ``t`` and its set of 64-bit tokens from its first two columns (an id and a text); if it is
    missing, ``tokens`` does.
    """
    names = ["slot", "t", "n", "at", "salt"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        often = max(HOT, 4 * int(counts.mean()))
        for batch in batches:
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
            for first, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t, s = read(first, text.as_py()) if read else _told(text.as_py(), shingle_words)
                if len(s):
                    p = prefix(s, counts, 0, percent)
                    k = len(p)
                    hot = counts[p % np.uint64(CELLS)] >= often
                    for col, v in zip(cols, (p.view(np.int64), np.full(k, t), np.full(k, len(s)), np.arange(1, k + 1), np.where(hot, 1 + t % _SALTS, 0))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros((0, 5), np.int64), False  # the last row waits for the next; whether the one before it had its slot

        def out(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[:, i], pa.int64()) for i in range(5)], [*names[:4], "hot"])

        for batch in batches:
            x = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            if not len(x):
                continue
            x = x[np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)]]  # copies hold one set
            same = x[1:, 0] == x[:-1, 0]
            before = np.r_[known, same]
            keep = before | np.r_[same, False] | (x[:, 4] > 0)
            held, known = x[-1:], bool(before[-1])
            yield out(x[:-1][keep[:-1]])
        if len(held) and (known or held[0, 4] > 0):
            yield out(held)

    posted = rows.mapInArrow(post, ", ".join(f"{n} long" for n in names))
    return posted.repartition("slot", "salt").sortWithinPartitions("slot", "t").mapInArrow(shared, "slot long, t long, n long, at long, hot long")


class Sets:
    """Fetches sets on demand: a text's prefixes and set are made when its first candidate pair has passed the cheap filters."""

    def __init__(self, rows: DataFrame, light: DataFrame, sketch, shingle_words: int, percent: int):
        self.rows, self.sketch, self.shingle_words, self.percent = rows, sketch, shingle_words, percent
        self.holders = stored(light.groupBy("t").agg(F.min("doc_id").alias("doc_id")), "jaccard-holders")
        self.repeated = not light.groupBy("doc_id").count().where("count > 1").isEmpty()
        self.table: DataFrame | None = None

    def of(self, pairs: DataFrame) -> DataFrame:
        """``t``, ``p2`` and ``p3`` (upper halves of the prefixes under the second and third order: what shares a token shares its half) and ``s`` (the set), of the pairs' texts at least."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
        if self.table is not None:
            wanted = wanted.hint("merge").join(self.table.select("t").hint("merge"), "t", "left_anti")
        ids = stored(wanted.hint("merge").join(self.holders.hint("merge"), "t").select("doc_id", F.col("t").alias("want")), "jaccard-wanted")
        new = stored(self._made(ids), "jaccard-sets")
        self.table = new if self.table is None else self.table.unionByName(new)
        return self.table

    def _made(self, ids: DataFrame) -> DataFrame:
        sketch, shingle_words, percent = self.sketch, self.shingle_words, self.percent
        schema = pa.schema([("t", pa.int64()), ("p2", pa.list_(pa.int32())), ("p3", pa.list_(pa.int32())), ("s", pa.list_(pa.int64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 200):
                    part = batch.slice(at, 200)
                    sets = [tokens(x.as_py(), shingle_words) for x in part.column(0)]
                    sets = [s for s, want in zip(sets, part.column(1).to_pylist()) if _identity(s) == want]  # an id may have several texts
                    halves = [[(prefix(s, sketch.value, i, percent) >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets] for i in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array([_identity(s) for s in sets], pa.int64()), *[pa.array(x, pa.list_(pa.int32())) for x in halves], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)

        named = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
        found = self.rows.join(named, "doc_id").select("text", "want").mapInArrow(run, "t long, p2 array<int>, p3 array<int>, s array<long>")
        return found.dropDuplicates(["t"]) if self.repeated else found


def _named(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``table`` (``t``) that the pairs name: no join of theirs has to move the others."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    return table.join(F.broadcast(ids) if pairs.count() <= BROADCAST_IDS // 2 else ids.hint("merge"), "t", "left_semi")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (``a``, ``b``) those that share prefix tokens under the other orders and then have the similarity."""
    side = lambda table, x, *cols: table.select(F.col("t").alias(x), *[F.col(c).alias(f"{c}{x}") for c in cols]).hint("merge")
    some = _named(sets, pairs)
    both = pairs.hint("merge").join(side(some, "a", "p2", "p3"), "a").hint("merge").join(side(some, "b", "p2", "p3"), "b")
    likely = stored(both.where(F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b")).select("a", "b"), "jaccard-likely")
    some = _named(sets, likely)
    both = likely.hint("merge").join(side(some, "a", "s"), "a").hint("merge").join(side(some, "b", "s"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _reachable(percent: int) -> Column:
    """Whether sizes, and the places of a common prefix token, leave room for the similarity.

    Of two similar sets the first common token has at least as many tokens behind it, in either set, as they must share;
    some pair of slots is that token's, so no pair is lost. Places count from 1.
    """
    need = F.ceil((F.lit(percent) * (F.col("na") + F.col("nb"))) / F.lit(100 + percent) - F.lit(1e-9))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    return (room >= need) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))


def _order() -> list[Column]:
    """Of a slot's texts those with most links come first (ties: front places, then by hash)."""
    return [F.desc("links"), F.col("at"), F.xxhash64("t"), F.col("t")]


def _leads(crowded: DataFrame, k: int) -> DataFrame:
    """The first ``k`` texts of each slot: by their ``place``; those of hot slots, which have none, are found in salted parts first."""
    part = Window.partitionBy("slot", F.pmod(F.xxhash64("t"), F.lit(_SALTS))).orderBy(*_order())
    some = crowded.where("hot > 0").withColumn("place", F.row_number().over(part)).where(F.col("place") <= k)
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy(*_order()))).where(F.col("place") <= k)
    return crowded.where((F.col("hot") == 0) & (F.col("place") <= k)).unionByName(some)


def _crowded(now: DataFrame) -> DataFrame:
    """The rows of slots that hold several components, with ``held``, the slot's texts.

    A slot that is not hot has few texts, so one shuffle brings them together and gives their ``place`` too; hot ones are counted in
    parts and joined.
    """
    slot = Window.partitionBy("slot")
    at = F.row_number().over(slot.orderBy(*_order()))
    few = now.where("hot = 0").withColumns({"place": at, "r0": F.min("root").over(slot), "r1": F.max("root").over(slot), "held": F.count("*").over(slot)}).where("r0 < r1").drop("r0", "r1")
    many = now.where("hot > 0")
    several = many.groupBy("slot").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("held")).where("r0 < r1").select("slot", "held")
    return few.unionByName(many.withColumn("place", F.lit(None).cast("int")).hint("merge").join(several.hint("merge"), "slot"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle_words: int = 5, leads: int = 8) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row: the smallest id reachable over links, itself included.

    Two rows link if their sets' common tokens are at least ``percent`` % of their union. Rows without words have an empty
    set and link with nothing. Rows of one id are one document: what either text links to is reachable. Rows without an
    id, or whose id is no number, keep their size and have no component. Sets and shingles are told apart by 64 bits.
    An empty table gives an empty result. Only the two named columns are read, so further columns cannot clash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").try_cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with scratch(spark):
        told = stored(described(rows, shingle_words), "jaccard-rows", keep=True)
        light = told.where("piece is null").select("doc_id", "t", "n")
        sketch = spark.sparkContext.broadcast(summed(told.where("piece is not null")))
        named = rows.where("doc_id is not null")
        members = stored(meeting(named, sketch, shingle_words, percent), "jaccard-members")
        sets = Sets(named, light.where("doc_id is not null and n > 0"), sketch, shingle_words, percent)
        several = light.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a < z").select("doc_id", "a")
        versions = light.where("n > 0").select("doc_id", F.col("t").alias("b")).hint("merge").join(several.hint("merge"), "doc_id").where("a <> b").select("a", "b").distinct()
        roots = _clustered(members, sets, versions, percent, leads)
        placed = light.where("doc_id is not null").select("doc_id", "t", "n").distinct().hint("merge").join(roots.hint("merge"), F.col("t") == F.col("node"), "left")
        # an empty set is no node: its rows are alone unless another text of the id is not
        placed = stored(placed.where("n > 0").select("doc_id", F.coalesce("root", "t").alias("c")), "jaccard-placed")
        least = placed.groupBy("c").agg(F.min("doc_id").alias("component_id"))
        found = stored(placed.hint("merge").join(least.hint("merge"), "c").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "jaccard-found", keep=True)
    return light.hint("merge").join(found.hint("merge"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _clustered(members: DataFrame, sets: Sets, versions: DataFrame, percent: int, leads: int) -> DataFrame:
    """``node``, ``root`` of every set that has a link."""
    side = lambda x: [F.col("t").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("at").alias(f"p{x}")]
    edges = stored(versions, "jaccard-edges")
    roots = connected_components(edges, "a", "b", "jaccard-cc")
    checked, crowded, k, linked = None, members, 1, not edges.isEmpty()
    while True:
        now = crowded.select("slot", "t", "n", "at", "hot")
        if linked:
            links = edges.select(F.explode(F.array("a", "b")).alias("t")).groupBy("t").agg(F.count("*").alias("links"))
            known = stored(roots.withColumnRenamed("node", "t").hint("merge").join(links.hint("merge"), "t", "full_outer"), "jaccard-known")
            now = now.hint("merge").join(known.hint("merge"), "t", "left")
            now = stored(now.select("slot", "t", "n", "at", "hot", F.coalesce("root", "t").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "jaccard-now")
        else:
            now = now.withColumns({"root": F.col("t"), "links": F.lit(0).cast("long")})
        crowded = stored(_crowded(now), "jaccard-crowded")
        if crowded.isEmpty():
            return roots
        lead = stored(_leads(crowded, k).select("slot", *side("a")), "jaccard-leads")
        met = lead.hint("merge").join(crowded.select("slot", *side("b")).hint("merge"), "slot").where((F.col("ra") != F.col("rb")) & _reachable(percent))
        new = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = stored(new if checked is None else new.hint("merge").join(checked.hint("merge"), ["a", "b"], "left_anti"), "jaccard-met")
        found = stored(_links(new, sets.of(new), percent), "jaccard-edges")
        checked = new if checked is None else checked.unionByName(new)
        if not found.isEmpty():
            edges, linked = edges.unionByName(found), True
            roots = stored(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found), "a", "b", "jaccard-cc"), "jaccard-roots")
        crowded = crowded.where(F.col("held") > k + 1)  # elsewhere every pair had a lead in it, so the slot is done
        k *= leads
