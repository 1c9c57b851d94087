"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Candidates are found in every whole text: three base kinds (assignments, access keys, long hex runs) and long mixed
tokens. The hash of each candidate's value is counted over the distinct repositories and owners that hold it. A value
that many owners hold is a copied example, and so is one that many repositories of a single owner hold; a value of one
owner in a few repositories looks live. Long mixed tokens become spans of kind ``live`` only if they look live; base
spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlefold.llm.common import stored

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")


def _found(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Array of matches: kind, value, match length, length of the text before it since the previous match."""
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
            F.split(text, pattern, -1).alias("gap"),
        ),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["g"].alias("value"), F.char_length(x["m"]).alias("n"), F.char_length(x["gap"]).alias("gap")),
    )


def candidates(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per candidate: the ``keep`` columns, kind (0-3), value, start, stop (code points, stop exclusive)."""
    text = F.col(text_col)
    some = docs.where(text.rlike(r"(?i:passw|secret|token|api_?key)|[0-9]|AKIA|[0-9a-f]{32}"))
    each = some.select(
        *keep,
        F.posexplode(
            F.filter(
                F.concat(
                    F.when(text.rlike("(?i)passw|secret|token|api_?key"), _found(text, 0, ASSIGN, 2)).otherwise(F.array()),
                    _found(text, 1, ACCESS, 0), _found(text, 2, HEX, 0),
                    F.when(text.rlike("[0-9]"), _found(text, 3, MIXED, 0)).otherwise(F.array()),
                ),
                lambda x: x["n"].isNotNull(),
            )
        ),
    ).select(*keep, "pos", "col.*").distinct()  # fmt: skip  # a repeated row counts once
    before = Window.partitionBy(*keep, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select(
        *keep, "kind", "value", "n", F.sum(F.col("gap") + F.col("n")).over(before).alias("stop")
    ).select(*keep, "kind", "value", (F.col("stop") - F.col("n")).alias("start"), "stop")
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return placed.where(
        F.when(F.col("kind") == 0, F.char_length("value") >= 8).when(F.col("kind") == 3, mixed).otherwise(F.lit(True))
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """Per input row: ``doc_id``, ``text_key``, ``n_assign``, ``n_access``, ``n_hex``, ``n_live_looking``, ``n_copied``,
    ``base`` and ``spans`` (arrays of structs start, kind, stop in order).

    ``n_live_looking`` counts spans whose value at most ``max_owners`` owners and ``max_repos`` repositories hold,
    ``n_copied`` the base spans whose value more of either hold. Null text: empty. Null owners count as one owner together. Repeated rows each get their own result row; rows
    are told apart by id and text. Further columns are not read.
    """
    src = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("\0")).alias("repo"),
    )
    src = src.withColumn("text_key", F.xxhash64("text"))
    keep = ("doc_id", "text_key", "owner", "repo")
    cand = stored(candidates(src, "text", keep).withColumn("h", F.sha2("value", 256)).drop("value"), "secrets-candidates")
    counts = cand.select("h", "owner", "repo").distinct().groupBy("h").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    judged = cand.hint("merge").join(counts, "h").select("doc_id", "text_key", "kind", "start", "stop", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("own")).distinct()
    base, extra = judged.where("kind < 3"), judged.where("kind = 3 and own")
    b = base.select(F.col("doc_id").alias("bd"), F.col("text_key").alias("bk"), F.col("start").alias("b0"), F.col("stop").alias("b1"))
    extra = extra.hint("merge").join(
        b, F.col("doc_id").eqNullSafe(F.col("bd")) & (F.col("text_key") == F.col("bk")) & (F.col("start") < F.col("b1")) & (F.col("stop") > F.col("b0")), "left_anti"
    )
    found = base.unionByName(extra).groupBy("doc_id", "text_key").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n{i}") for i in range(3)],
        F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("copied"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"),
    )
    kind = "array<struct<start:bigint,kind:int,stop:bigint>>"
    out = src.select("doc_id", "text_key").alias("d").hint("merge").join(
        found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")), "left"
    )
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    spans = F.coalesce(F.col("spans").cast(kind), F.array().cast(kind))
    return out.select(
        "d.doc_id", "d.text_key", number("n0").alias("n_assign"), number("n1").alias("n_access"), number("n2").alias("n_hex"),
        number("own").alias("n_live_looking"), number("copied").alias("n_copied"),
        F.filter(spans, lambda x: x["kind"] < 3).alias("base"), spans.alias("spans"),
    )


def span_text(spans: Column) -> Column:
    """``kind:start:stop`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["stop"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """The table with every span of ``scan`` replaced by ``[SECRET]``; all its columns and rows stay.

    Texts without a span, null texts included, are unchanged. Overlapping spans are replaced together.
    """
    spans = scan(docs, id_col, text_col, owner_col, repo_col, max_owners, max_repos).where(F.size("spans") > 0).select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"])
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_key"))
    both = d.hint("merge").join(spans, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.col(f"row.`{text_col}`")

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        parts = F.when(x["start"] >= acc["at"], F.concat(acc["parts"], F.array(piece, F.lit("[SECRET]")))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), parts.alias("parts"))

    cut = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    new = F.when(F.col("spans").isNull(), text).otherwise(cut)
    return both.select(*[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])
