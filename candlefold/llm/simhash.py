"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most three bits, one of their
segments differs in at most one: it is enough to look up, for either segment, the ball of radius one around a
fingerprint's segment in the table of segments, and to verify the full distance of what is found. Of two segments that
differ in one bit exactly one has that bit unset, so only unset bits are flipped and each link is met from one side.

Skew: equal fingerprints are one table row. A segment value that more than ``hot_bucket`` different fingerprints share is
not joined pair by pair; there the few flips that are still allowed in the other segment are enumerated and looked up as
whole fingerprints, so the work per fingerprint has a constant bound and no candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlefold.llm import jaccard
from candlefold.llm.common import connected_components, gathered, looked_up, scratch, stored, word_blocks

SEED = 42
MAX_DISTANCE = 3
#: Slots of more fingerprints contract by representatives, in at most so many rounds, before pairs are looked up.
CROWD, ROUNDS = 8, 8
_LOW = 0xFFFFFFFF


def text_fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash: bit i is set if over half of the shingles' XXH64 values have it.

    A-Z are lower-cased. A text of fewer words is one shingle; a text without words has fingerprint 0.
    """
    votes, total, last = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for block in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = last + block
        last = words[-(shingle_words - 1) :] if shingle_words > 1 else []
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle_words)))]
        if hashes:
            bits = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
    if not total:
        return digest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """Columns ``doc_id`` and ``fp`` (signed 64-bit), one row per input row; other columns are not read. Null: empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([text_fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").try_cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _segments(fp: Column) -> tuple[Column, Column]:
    return fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 32)


def _flips(low_bits: bool, most: int, least: int = 1) -> Column:
    """All 64-bit masks of ``least`` to ``most`` bits in one half: a literal array."""
    bits = range(32) if low_bits else range(32, 64)
    masks = (sum(1 << b for b in c) for n in range(least, most + 1) for c in combinations(bits, n))
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])


def _both(fps: DataFrame) -> DataFrame:
    """``fp``, ``root``, ``seg``, ``val``: the two table rows of every fingerprint."""
    low, high = _segments(F.col("fp"))
    pair = F.array(F.struct(F.lit(0).alias("seg"), low.alias("val")), F.struct(F.lit(1).alias("seg"), high.alias("val")))
    return fps.select("fp", "root", F.explode(pair).alias("s")).select("fp", "root", "s.*")


def _far() -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")))


def leader_links(fps: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of linked fingerprints of which ``a`` is the smallest with one of b's segments: at most two for each ``b``."""
    table = _both(fps.select("fp", F.col("fp").alias("root")))
    lead = stored(table.groupBy("seg", "val").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-leads")
    met = table.withColumnRenamed("fp", "b").hint("merge").join(lead, ["seg", "val"])
    return met.where((F.col("a") < F.col("b")) & (_far() <= MAX_DISTANCE)).select("a", "b")


def _around(slots: DataFrame) -> DataFrame:
    """``slots``, each once more for every slot that is one bit away."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)])
    return slots.withColumn("m", F.explode(masks)).withColumn("val", F.col("val").bitwiseXOR(F.col("m"))).drop("m")


def crowded_rows(apart: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The table rows in slots of over ``crowd`` fingerprints and in the slots one bit away: all that representatives meet."""
    table = _both(apart)
    crowded = stored(table.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("seg", "val"), "simhash-crowded")
    return table.join(looked_up(stored(_around(gathered(crowded)).distinct(), "simhash-around")), ["seg", "val"], "left_semi").select("fp", "root", "seg", "val")


def representative_links(table: DataFrame, salt: int, crowd: int = CROWD) -> DataFrame:
    """Pairs (``a``, ``b``) of roots that a verified link joins, where one end represents a slot of over ``crowd`` fingerprints.

    A slot's representative (the least by a hash that ``salt`` turns) meets the fingerprints of its own slot and of the slots
    one bit away: a fingerprint has at most 66 partners. ``table``: ``crowded_rows``.
    """
    one = table.groupBy("seg", "val").agg(F.count("*").alias("n"), F.min_by(F.struct("fp", "root"), F.xxhash64("fp", F.lit(salt))).alias("one")).where(F.col("n") > crowd)
    near = _around(one.select(F.col("one.fp").alias("a"), F.col("one.root").alias("ra"), "seg", "val"))
    met = table.select(F.col("fp").alias("b"), F.col("root").alias("rb"), "seg", "val").hint("merge").join(near, ["seg", "val"])
    return met.where((F.col("ra") != F.col("rb")) & (_far() <= MAX_DISTANCE)).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def contracted(apart: DataFrame, rounds: int = ROUNDS, crowd: int = CROWD) -> DataFrame:
    """``fp`` and ``root`` with the roots that representatives join made one, until a round joins none or ``rounds`` are over."""
    table = gathered(stored(crowded_rows(apart, crowd), "simhash-rows"))
    now, moved, place = table, None, None
    for turn in range(rounds):
        met = stored(representative_links(now, turn, crowd), "simhash-met")
        if met.isEmpty():
            break
        if moved is not None:
            met = met.unionByName(moved.where("node <> to").select(F.col("to").alias("a"), F.col("node").alias("b")))
        moved = stored(connected_components(met, "a", "b", "simhash-cc").select("node", F.col("root").alias("to")), "simhash-moved")
        place = looked_up(moved)
        now = table.join(place, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("to", "root").alias("root"), "seg", "val")
    if moved is None:
        return apart
    return stored(apart.join(place, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("to", "root").alias("root")), "simhash-apart")


def links(fps: DataFrame, hot_bucket: int = 8192) -> DataFrame:
    """All pairs (``a`` , ``b``) of different values in column ``fp`` (distinct) that differ in at most three bits.

    A pair may come twice and in either order. With a column ``root`` the pairs of one root are left out.
    """
    fps = fps if "root" in fps.columns else fps.withColumn("root", F.col("fp"))
    table = _both(fps)
    bit = F.expr("shiftleft(1L, i)")
    ball = (
        table.select("fp", "root", "seg", "val", F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("i"))
        .where((F.col("i") < 0) | (F.col("val").bitwiseAND(bit) == 0))
        .select(F.col("fp").alias("a"), F.col("root").alias("ra"), "seg", F.when(F.col("i") < 0, F.col("val")).otherwise(F.col("val").bitwiseOR(bit)).alias("val"), "i")
    )
    hot = stored(table.groupBy("seg", "val").count().where(F.col("count") > hot_bucket).select("seg", "val"), "simhash-hot")
    none_hot = hot.isEmpty()
    there = table.select(F.col("fp").alias("b"), F.col("root").alias("rb"), "seg", "val")
    near = (
        (ball if none_hot else ball.hint("merge").join(hot, ["seg", "val"], "left_anti"))
        .hint("merge")
        .join(there, ["seg", "val"])
        .where((F.col("ra") != F.col("rb")) & (_far() <= MAX_DISTANCE) & (_far() > 0) & ((F.col("i") >= 0) | (F.col("a") < F.col("b"))))
        .select("a", "b")
    )
    if none_hot:
        return near
    probes = ball.hint("merge").join(hot, ["seg", "val"], "left_semi")
    for seg in (0, 1):
        mine = probes.where(F.col("seg") == seg)
        shift = F.expr(f"shiftleft(1L, i + {32 * seg})")
        same = mine.where("i < 0").select("a", "ra", F.explode(_flips(seg == 1, 3)).alias("m")).select("a", "ra", F.col("a").bitwiseXOR(F.col("m")).alias("b"))
        beside = mine.where("i >= 0").select(
            "a", "ra", F.explode(F.concat(F.array(F.lit(0).cast("long")), _flips(seg == 1, 2))).alias("m"), shift.alias("s")
        ).select("a", "ra", F.col("a").bitwiseXOR(F.col("m")).bitwiseXOR(F.col("s")).alias("b"))
        found = same.unionByName(beside).hint("merge").join(fps.select(F.col("fp").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        near = near.unionByName(found.select("a", "b"))
    return near


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, hot_bucket: int = 8192) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` for every row: the smallest id reachable over links of at most three bits.

    The nodes are the different fingerprints. Those that link to the smallest one of their segment contract first, so a
    family of near copies gives a star. Slots of many fingerprints then contract in rounds, by representatives that change
    from round to round; only links between what is left apart are looked up one by one, so no link is lost.

    Repeated rows stay repeated. Rows of one id with different texts are one document: what either text links to is
    reachable. Rows without id, or whose id is no number, get a fingerprint but take no part in links: their component
    is null. An empty table gives an empty result. Only the two named columns are read, so further columns cannot clash.
    """
    docs_fp = stored(fingerprints(docs, id_col, text_col, shingle_words), "simhash-docs", keep=True)
    with scratch(docs.sparkSession):
        labelled = stored(_labels(docs_fp.where("doc_id is not null"), hot_bucket), "simhash-labels", keep=True)
    return docs_fp.hint("merge").join(labelled, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def _labels(named: DataFrame, hot_bucket: int) -> DataFrame:
    fps = stored(named.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-fps")
    several = stored(named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("doc_id", "a"), "simhash-several")
    versions = named.select("doc_id", F.col("fp").alias("b")).join(looked_up(several), "doc_id").where("a <> b").select("a", "b")
    first = stored(connected_components(leader_links(fps).unionByName(versions), "a", "b", "simhash-cc"), "simhash-roots")
    apart = stored(fps.join(looked_up(first), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-apart")
    apart = contracted(apart)
    edges = links(apart, hot_bucket).unionByName(apart.where("root <> fp").select(F.col("root").alias("a"), F.col("fp").alias("b")))
    roots = stored(connected_components(edges, "a", "b", "simhash-cc"), "simhash-roots")
    linked = gathered(stored(fps.join(looked_up(roots), F.col("fp") == F.col("node")).select("node", "rep", "root"), "simhash-linked"))
    least = stored(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-least")
    placed = stored(linked.join(looked_up(least), "root").select("node", "component_id"), "simhash-placed")
    return fps.join(looked_up(placed), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- near-duplicates by similarity ---------------------------------------------------------------------------------
# At a similarity of 0.8 on five-word shingles some 2 % of the words differ. Fingerprints of the shingles then differ in
# about nine of 64 bits, too many for exact multi-index hashing; fingerprints of 256 bits over the distinct words differ in
# about 18 of 256. Their eight segments of 32 bits are looked up with a ball of radius one on either side, in which only
# unset bits are flipped: segments meet that differ in one bit, or in two that are set in one of them each (half of those
# that differ in two). What is found is verified on the whole fingerprint and then on the shingles themselves.

#: Numbers of 64 bits in a wide fingerprint, and bits in which near texts may differ.
WIDTH = 4
WIDE_DISTANCE = 60
#: Texts of a task that makes table slots, some 140 a text.
SLOT_TEXTS = 4096
#: Ids whose texts are fetched by a broadcast (a few MB); by a merge join beyond.
BROADCAST_IDS = 500_000
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(h: np.ndarray, step: int = 0) -> np.ndarray:
    """Another hash of each number, well spread over all bits."""
    h = h + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(_MIX[0])
    h = (h ^ h >> np.uint64(27)) * np.uint64(_MIX[1])
    return h ^ h >> np.uint64(31)


def text_print(text: str | None, shingle_words: int = 5, wide: bool = True) -> tuple[int, list[int], np.ndarray]:
    """A text's key (64-bit hash of its words in order), wide fingerprint and sorted distinct 32-bit hashes of its shingles.

    A-Z are lower-cased. The fingerprint is a SimHash of the distinct words. Of fewer words the whole sequence is the one
    shingle; a text without words has the fingerprint zero and no shingle. Without ``wide`` the fingerprint is left out.
    """
    order, known, seen = xxhash.xxh64(seed=SEED), {}, []
    for block in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        order.update(b" ".join(block) + b" ")
        for word in set(block) - known.keys():
            known[word] = xxhash.xxh64_intdigest(word, SEED)
        seen.append(np.array([known[w] for w in block], np.uint64))
    key = order.intdigest() - (1 << 63)
    if not known:
        return key, [0] * WIDTH, np.zeros(0, np.uint32)
    words, run = np.fromiter(known.values(), np.uint64, len(known)), np.concatenate(seen)
    prints = []
    for i in range(WIDTH if wide else 0):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(words), 1 << 16):
            bits = np.unpackbits(_mixed(words[at : at + (1 << 16)], i).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        prints.append(int(np.packbits(2 * votes > len(words), bitorder="little").view("<i8")[0]))
    k = min(shingle_words, len(run))
    rolled = np.zeros(len(run) - k + 1, np.uint64)
    for i in range(k):
        rolled = _mixed(rolled ^ run[i : len(run) - k + 1 + i], i + 1)
    return key, prints, np.unique((rolled >> np.uint64(32)).astype(np.uint32))


def _rows(docs: DataFrame, id_col: str, text_col: str, view: int) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").try_cast("long").alias("doc_id"), F.lit(view).alias("view"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")


def text_prints(rows: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id``, ``view``, ``t`` (key of the text), ``f`` (wide fingerprint) and ``n`` (number of its shingles); and, with
    ``piece`` set, each task's sketch of how often shingles occur, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(jaccard.CELLS, np.uint32)
        names = ["doc_id", "view", "t", "f", "n", "piece", "counts"]
        for batch in batches:
            key, prints, n, k = [], [], [], len(batch)
            for text in batch.column(2):
                t, f, s = text_print(text.as_py(), shingle_words)
                np.add.at(sketch, s % np.uint64(jaccard.CELLS), np.uint32(1))
                key.append(t)
                prints.append(f)
                n.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if sketch.any():
            empty = [pa.nulls(jaccard.PIECES, kind) for kind in (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, *jaccard.pieces(sketch)], names)

    return rows.mapInArrow(run, "doc_id long, view int, t long, f array<long>, n long, piece int, counts binary")


class ShingleSets:
    """Fetches sets on demand: a text's shingles are made when a pair of it has passed the cheap filters.

    ``texts``: ``t`` and ``at``, the ``doc_id`` and ``view`` of a row that holds the text; ``light``: those two of all rows.
    """

    def __init__(self, rows: DataFrame, light: DataFrame, texts: DataFrame, shingle_words: int):
        self.rows, self.texts, self.shingle_words = rows, texts, shingle_words
        self.repeated = not light.groupBy("doc_id", "view").count().where("count > 1").isEmpty()
        self.table: DataFrame | None = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """``t`` and the set ``s`` of its shingles, of the texts ``wanted`` (``t``) at least."""
        if self.table is not None:
            wanted = wanted.hint("merge").join(self.table.select("t").hint("merge"), "t", "left_anti")
        holders = self._holders(wanted)
        if self.table is None or not holders.isEmpty():
            new = stored(self._made(holders), "near-shingles")
            self.table = new if self.table is None else self.table.unionByName(new)
        return self.table

    def meeting(self, wanted: DataFrame, sketch, similarity: float) -> DataFrame:
        """``slot``, ``t``, ``n``, ``at``: of the texts ``wanted`` (``t``), with n shingles each, the n - ceil(similarity n) + 1
        rarest ones by the sketch that at least two of the texts have among theirs, with their place from 1.

        Two sets of at least the similarity share one of these.
        """
        shingle_words = self.shingle_words

        def read(want: int, text: str | None) -> tuple[int, np.ndarray]:
            key, _, s = text_print(text, shingle_words, wide=False)
            return want, s.astype(np.uint64) if key == want else np.zeros(0, np.uint64)  # a row's id may have several texts

        found = self._rows_of(self._holders(wanted)).select("want", "text")
        return jaccard.meeting(found, sketch, shingle_words, int(100 * similarity + 1e-9), read).select("slot", "t", "n", "at")

    def _holders(self, wanted: DataFrame) -> DataFrame:
        return stored(wanted.hint("merge").join(self.texts.select("t", "at").hint("merge"), "t").select("at.doc_id", "at.view", F.col("t").alias("want")), "near-holders")

    def _rows_of(self, holders: DataFrame) -> DataFrame:
        return self.rows.join(F.broadcast(holders) if holders.count() <= BROADCAST_IDS else holders.hint("merge"), ["doc_id", "view"])

    def _made(self, holders: DataFrame) -> DataFrame:
        shingle_words = self.shingle_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 500):  # sets of few texts at a time
                    part = batch.slice(at, 500)
                    found = [(want, text_print(t.as_py(), shingle_words, wide=False)) for t, want in zip(part.column(0), part.column(1).to_pylist())]
                    found = [(t, x[2].view(np.int32)) for t, x in found if x[0] == t]
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int32()))], ["t", "s"])

        found = self._rows_of(holders).select("text", "want").mapInArrow(run, "t long, s array<int>")
        return found.dropDuplicates(["t"]) if self.repeated else found


def slots(texts: DataFrame) -> DataFrame:
    """``slot``, ``t``, ``own``: the table slots of every text, each segment of its fingerprint as it is (``own``) and with
    one unset bit flipped."""
    halves = [h for i in range(WIDTH) for h in _segments(F.col("f")[i])]
    segments = texts.select("t", F.posexplode(F.array(*halves)).alias("seg", "val"))
    ball = segments.select("t", "seg", "val", F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("i")).where("i < 0 or val & shiftleft(1L, i) = 0")
    return ball.select(F.expr("shiftleft(cast(seg as bigint), 32) | case when i < 0 then val else val | shiftleft(1L, i) end").alias("slot"), "t", (F.col("i") < 0).alias("own"))


def _dealt(texts: DataFrame) -> DataFrame:
    """A stored table of texts, dealt out so that a task makes the slots of about ``SLOT_TEXTS`` of them.

    Read as it is, a task takes as many texts as fit a split, and their slots are a hundred times its bytes: what it
    aggregates or shuffles would fill an executor's memory.
    """
    return texts.repartition(-(-texts.count() // SLOT_TEXTS) or 1)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair of different texts once, the smaller as ``a``."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _within(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose numbers of shingles allow the similarity and whose wide fingerprints are near as a whole."""
    side = lambda x: texts.select(F.col("t").alias(x), F.col("f").alias(f"f{x}"), F.col("n").alias(f"n{x}"))
    far = sum((F.bit_count(F.col("fa")[i].bitwiseXOR(F.col("fb")[i])) for i in range(WIDTH)), F.lit(0))
    sizes = F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    return pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").where(sizes & (far <= WIDE_DISTANCE)).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    """``t``: the texts of the pairs."""
    return pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of texts whose sets of shingles (``t``, ``s``) have at least the Jaccard similarity; other texts' sets are not moved."""
    ids = _ends(pairs)
    sets = sets.join(F.broadcast(ids) if pairs.count() <= BROADCAST_IDS // 2 else ids.hint("merge"), "t", "left_semi")
    a, b = sets.select(F.col("t").alias("a"), F.col("s").alias("sa")), sets.select(F.col("t").alias("b"), F.col("s").alias("sb"))
    both = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _may_reach(similarity: float) -> Column:
    """Whether two sets whose first common shingle has these places can have the similarity: what follows must suffice."""
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    return (left >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - F.lit(1e-9)) & (F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb"))


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (``node``, ``root``) after the links ``found`` (``a``, ``b``): only what they connect is walked again."""
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    between = found.hint("merge").join(at("a"), "a").hint("merge").join(at("b"), "b")
    moved = connected_components(between, "ra", "rb", "near-cc").select(F.col("node").alias("root"), F.col("root").alias("into"))
    return roots.hint("merge").join(moved, "root", "left").select("node", F.coalesce("into", "root").alias("root"))


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle_words: int = 5, earlier: DataFrame | None = None, leads: int = 16
) -> DataFrame:
    """``doc_id`` and ``root``, the smallest id of its component, for every id of ``docs``.

    ``earlier`` (same columns) may hold earlier versions of the texts: ids of ``docs`` are similar if their texts are, or
    their earlier ones. Rows of one id are one document with several texts. Texts of equal words in equal order (A-Z
    lower-cased) are one text, told apart by 64 bits.

    Every text first pairs with one text of each slot of its segments as they are. What is verified contracts to
    components; a slot, of the whole balls, that holds several is open. The texts of open slots meet again by their rarest
    shingles (``ShingleSets.meeting``), which any two similar ones share: where such a group holds several components, its
    texts with most similar ones become leads and pair with all texts of other components, and the number of leads
    grows eightfold a round until every text of an open group has been one. So in the end two texts that share a slot
    are in one component or are not similar, and neither a large group around one text nor one of texts that are near
    by fingerprint but not similar comes to its pairs.
    """
    rows = _rows(docs, id_col, text_col, 0)
    if earlier is not None:
        rows = rows.unionByName(_rows(earlier, id_col, text_col, 1))
    light = stored(text_prints(rows, shingle_words), "near-prints")
    sketch = docs.sparkSession.sparkContext.broadcast(jaccard.summed(light.where("piece is not null")))
    light = light.where("piece is null").drop("piece", "counts")
    if earlier is not None:
        ids = light.where("view = 0").select("doc_id").distinct()
        light = stored(light.hint("merge").join(ids, "doc_id", "left_semi"), "near-light")
    texts = stored(light.groupBy("t").agg(F.min("f").alias("f"), F.min("n").alias("n"), F.min(F.struct("doc_id", "view")).alias("at")), "near-texts")
    of_doc = light.groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a < z").select("doc_id", "a")
    versions = light.select("doc_id", F.col("t").alias("b")).hint("merge").join(of_doc, "doc_id").where("a <> b").select("a", "b").distinct()
    # counts and leads first, members again for the slots where texts meet: a window over a hot slot would be one task
    dealt = _dealt(texts.select("t", "f"))
    shared = stored(slots(dealt).groupBy("slot").agg(F.min("t").alias("lead"), F.count("*").alias("held")).where("held > 1"), "near-shared")
    members = stored(slots(dealt).hint("merge").join(shared, "slot"), "near-members")
    checked = stored(_ordered(members.where("own").select(F.col("lead").alias("a"), F.col("t").alias("b"))), "near-met")
    pairs = stored(_within(checked, texts, similarity), "near-pairs")
    sets = ShingleSets(rows, light, texts, shingle_words)
    edges = stored(similar_pairs(pairs, sets.of(_ends(pairs)), similarity).unionByName(versions), "near-edges")
    roots = connected_components(edges, "a", "b", "near-cc")
    placed = members.select("slot", "t").hint("merge").join(roots.withColumnRenamed("node", "t"), "t", "left").select("slot", "t", F.coalesce("root", "t").alias("root"))
    placed = stored(placed, "near-placed")
    several = placed.groupBy("slot").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("slot")
    open_texts = stored(placed.hint("merge").join(several, "slot", "left_semi").select("t").distinct(), "near-open")
    crowded = stored(sets.meeting(open_texts, sketch, similarity), "near-rare")
    every = roots.hint("merge").join(open_texts.hint("merge"), F.col("node") == F.col("t"), "full_outer")
    roots = stored(every.select(F.coalesce("node", "t").alias("node"), F.coalesce("root", "t").alias("root")), "near-roots")
    while True:
        links = edges.select(F.explode(F.array("a", "b")).alias("t")).groupBy("t").agg(F.count("*").alias("links"))
        known = roots.withColumnRenamed("node", "t").hint("merge").join(links, "t", "left")
        now = crowded.select("slot", "t", "n", "at").hint("merge").join(known, "t", "left").select("slot", "t", "n", "at", F.coalesce("root", "t").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
        now = stored(now, "near-now")
        several = now.groupBy("slot").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("held")).where("r0 < r1").select("slot", "held")
        crowded = stored(now.hint("merge").join(several, "slot"), "near-crowded")
        widest = crowded.agg(F.max("held")).first()[0]
        if not widest:
            break
        order = Window.partitionBy("slot").orderBy(F.desc("links"), "at", F.xxhash64("t"), "t")
        side = lambda x: [F.col("t").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("at").alias(f"p{x}")]
        lead = stored(crowded.withColumn("k", F.row_number().over(order)).where(F.col("k") <= leads).select("slot", *side("a")), "near-leads")
        met = lead.hint("merge").join(crowded.select("slot", *side("b")), "slot").where((F.col("ra") != F.col("rb")) & _may_reach(similarity)).select("a", "b")
        new = stored(_ordered(met).hint("merge").join(checked, ["a", "b"], "left_anti"), "near-met")
        pairs = stored(_within(new, texts, similarity), "near-pairs")
        found = stored(similar_pairs(pairs, sets.of(_ends(pairs)), similarity), "near-edges")
        checked = checked.unionByName(new)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            roots = stored(_merged(roots, found), "near-roots")
        if leads >= widest:
            break
        crowded = crowded.where(F.col("held") > leads)  # elsewhere every text was a lead, so the slot is done
        leads *= 8
    placed = stored(light.select("doc_id", "t").distinct().hint("merge").join(roots, F.col("t") == F.col("node"), "left").select("doc_id", F.coalesce("root", "t").alias("c")), "near-placed")
    least = stored(placed.groupBy("c").agg(F.min("doc_id").alias("root")), "near-least")
    return placed.distinct().hint("merge").join(least, "c").select("doc_id", "root").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle_words: int = 5, earlier: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without those in whose component (``near_components``) a smaller id is.

    Rows without an id stay; so do all rows of the kept id. Null texts are empty; empty texts are copies of each other.
    """
    with scratch(docs.sparkSession):
        found = near_components(docs, id_col, text_col, similarity, shingle_words, earlier)
        gone = stored(found.where("root < doc_id").select(F.col("doc_id").alias("_gone")), "near-gone", keep=True)
    return docs.hint("merge").join(gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
