r"""Line dedup by winnowing; DataFrame functions only.

A text's lines (cut at ``\n``) that hold a word form a sequence; lines without one are skipped. Over each line reach two
windows: the shortest stretch of whole lines from it onward, and the shortest up to it, of at least ``min_words`` words.
A stretch of at least ``min_words`` words that occurs twice holds, at both places, the same windows.

1. Winnow: of each window only the smallest line hash is selected, once for all windows in a row that share it. Equal
   stretches are bound to select equal fingerprints, so these few lines find every repetition.
2. Join positions: fingerprints that are selected at one place only cannot repeat and go; texts without any other go too.
3. Extend both ways: from the position of a repeated fingerprint, neighbouring lines to the left and to the right are added
   up to each window that selected it, and the hashes of these lines are compared. Of equal ones each later meets the
   first (by document id, then line): a star, never all pairs. A repeated run is covered by its onward windows up to its
   end and by its backward windows from its start, so the union of the matches is the whole run, longer ones included;
   comparing with the first place of a fingerprint alone would miss a run that starts there differently.
4. Delete: later repeated runs go, the first occurrence of every line stays somewhere in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlefold.llm.common import WORD, scratch, stored

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: ``doc_id``, ``text_key``, ``pos``, two hashes, ``start`` and ``stop`` (words before and up to its end)."""
    each = docs.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    each = each.select(
        "doc_id", "text_key", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n")
    ).where("n > 0")
    # partitioned as the windows below need it: rows that are there twice meet without another shuffle
    each = each.repartition("doc_id", "text_key").dropDuplicates(["doc_id", "text_key", "pos"])
    upto = Window.partitionBy("doc_id", "text_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("stop", F.sum("n").over(upto)).withColumn("start", F.col("stop") - F.col("n"))


def _frames(min_words: int) -> tuple[Window, Window]:
    doc = Window.partitionBy("doc_id", "text_key")
    return doc.orderBy("start").rangeBetween(0, min_words - 1), doc.orderBy("stop").rangeBetween(-(min_words - 1), 0)


def _selected(lines: DataFrame, min_words: int) -> DataFrame:
    """The lines with ``fps``: the smallest line hashes of the line's windows, where the window before had another one."""
    both = lines
    for k, frame in enumerate(_frames(min_words)):
        low = F.when(F.sum("n").over(frame) >= min_words, F.min(F.struct("h", "pos")).over(frame))
        both = both.withColumn(f"w{k}", low)
    row = Window.partitionBy("doc_id", "text_key").orderBy("start")
    new = [F.when(~F.col(f"w{k}").eqNullSafe(F.lag(f"w{k}").over(row)), F.col(f"w{k}")) for k in (0, 1)]
    return both.select(*lines.columns, F.filter(F.array(*new), lambda w: w.isNotNull()).alias("fps"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Every window of the lines: ``first`` and ``last`` line, its fingerprint ``fp`` and two hashes of all its lines."""

    def window(frame: Window, kind: str) -> Column:
        # the frames hold the same lines in the same order for equal stretches
        return F.struct(
            F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), F.sum("n").over(frame).alias("words"), F.min("h").over(frame).alias("fp"),
            F.xxhash64(F.collect_list("h").over(frame)).alias("k1"), F.xxhash64(F.collect_list("g").over(frame)).alias("k2"),
        ).alias(kind)

    onward, backward = _frames(min_words)
    both = lines.select("doc_id", "text_key", window(onward, "a"), window(backward, "b"))
    same = (F.col("a.first") == F.col("b.first")) & (F.col("a.last") == F.col("b.last"))
    rows = both.select("doc_id", "text_key", F.explode(F.when(same, F.array("a")).otherwise(F.array("a", "b"))).alias("w"))
    return rows.select("doc_id", "text_key", "w.*").where(F.col("words") >= min_words).drop("words")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``text_key``, ``runs``: sorted, disjoint (first, last) line numbers of the later repeated runs.

    Documents without such a run have no row. Order of documents: id (null last), then a hash of the text.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    lines = stored(_selected(_lines(src), min_words), "lines")
    fps = lines.where(F.size("fps") > 0).select("doc_id", "text_key", F.explode("fps").alias("w")).select("doc_id", "text_key", F.col("w.h").alias("fp"), F.col("w.pos").alias("at"))
    place = F.struct("doc_id", "text_key", "at")
    again = stored(fps.groupBy("fp").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p <> q").select("fp"), "lines-again")
    met = stored(fps.hint("merge").join(again, "fp", "left_semi").select("doc_id", "text_key"), "lines-met").distinct()
    some = lines.drop("fps").alias("l").hint("merge").join(met.alias("m"), F.col("l.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("l.text_key") == F.col("m.text_key")), "left_semi")
    windows = stored(_stretches(some, min_words), "lines-stretches")
    windows = stored(windows.hint("merge").join(again, "fp", "left_semi"), "lines-stretches")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "first")
    firsts = stored(windows.groupBy("k1", "k2").agg(F.min(at).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n"), "lines-firsts")
    key = [F.col(f"w.{k}") == F.col(f"f.{k}") for k in ("k1", "k2")]
    later = windows.alias("w").hint("merge").join(firsts.alias("f"), key).where(
        F.struct(F.col("w.doc_id").isNull().alias("no_id"), "w.doc_id", "w.text_key", "w.first") > F.col("f.at")
    ).select("w.doc_id", "w.text_key", "w.first", "w.last")
    doc = Window.partitionBy("doc_id", "text_key").orderBy("first", "last")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("doc_id", "text_key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per input row: ``row`` (all its columns, text included), ``text`` without the later repeated runs, ``n_lines``,
    ``n_removed`` (lines) and ``runs``.

    A null text stays null, with no lines. A text without a repeated run stays as it is. Rows with the same id and text
    count as one document, so a repeated row is no repetition of itself; equal texts under different ids are.
    """
    with scratch(docs.sparkSession):
        runs = stored(repeated_runs(docs, id_col, text_col, min_words), "lines-runs", keep=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    both = rows.hint("merge").join(runs, F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    text = F.col(f"row.`{text_col}`")
    lines = F.split(text, "\n", -1)
    last = F.size("runs")

    def gap(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.try_element_at("runs", k)["last"] + 1)
        stop = F.when(k == last, F.size(lines)).otherwise(F.try_element_at("runs", k + 1)["first"])
        return F.slice(lines, start + 1, stop - start)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), last), gap)), "\n")
    removed = F.aggregate("runs", F.lit(0), lambda acc, r: acc + r["last"] - r["first"] + 1)
    return both.select(
        "row", F.when(F.col("runs").isNull(), text).otherwise(kept).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), "runs",
    )


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """The table with repeated runs deleted; documents of which no word is left go. ``chars_col``, if there, follows the text."""
    done = dedup(docs, id_col, text_col, min_words).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    chars = F.when(F.col("n_removed") == 0, F.col(f"row.`{chars_col}`")).otherwise(F.char_length("text").cast("long")) if chars_col in docs.columns else None
    new = {text_col: F.col("text"), chars_col: chars}
    return done.select(*[(new[c] if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
