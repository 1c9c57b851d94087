"""Quality rules with risk-controlled thresholds.

Every document gets counts, base limits and five rule values (higher is worse). For each stratum the labelled documents
are split by a hash of their id. One half proposes: for every rule the cutoff that rejects most bad documents while it
rejects at most a ``target`` share of the good ones (the loosest if several do), and an order of the rules, most bad
documents first. The other half, the holdout, proves: in that order one rule after the other is added, and an exact
binomial test must reject, at level ``delta`` over the number of strata (Bonferroni), that all rules so far together reject
more than ``alpha`` of the good documents. The sets are nested and their order does not depend on the holdout, so they
are tested until one fails (fixed sequence; no further correction is due). The rules before it act. So with probability
1 - ``delta`` no stratum loses more than ``alpha`` of its good documents to the rules; a stratum with too few labels for
any proof keeps the base limits only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlefold.llm.common import scratch, stored

SYMBOLS = b"#*$%&|<>"
#: Rules and their cutoffs from the loosest to the strictest.
CUTOFFS = {
    "symbol_ratio": (3.0, 2.0, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.1),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "upper_ratio": (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
    "reuse_ratio": (0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6),
}
#: Share of a stratum's good documents that its rules may reject together, chance that any stratum's share is larger, and
#: share of the good documents of the proposing half that a cutoff may reject.
ALPHA, DELTA, TARGET = 0.05, 0.05, 0.002
#: Strata up to which the cutoff table (five rows a stratum) is broadcast; it is joined by sort-merge beyond.
BROADCAST_STRATA = 10_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = (*COUNTS, "n_lines", "n_upper", "n_distinct")


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``FIELDS`` for one whole text; null: all 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * 8
    codes = np.frombuffer(raw, np.uint8)
    points = int(np.count_nonzero((codes & 0xC0) != 0x80))
    space = int(np.count_nonzero((codes == 32) | ((codes >= 9) & (codes <= 13))))
    upper = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return (len(words), points - space, sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)), _repeated(ids, len(number)), len(lines), upper, len(number))


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * kinds + ids[1:-1]
    if kinds >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair * kinds + ids[2:]
    order = np.argsort(triple, kind="stable")
    s = triple[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(ids) + 1, bool)
    hit = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        again[hit + k] = True
    return int(again.sum())


def counts(text: Column) -> Column:
    """A struct of ``FIELDS``, measured in Arrow batches."""

    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=list(FIELDS), dtype="int64")

    schema = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])
    return F.pandas_udf(measure, schema)(text.cast("string"))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def rule_values(c: Column) -> dict[str, Column]:
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "symbol_ratio": part(c["n_symbols"], c["n_words"]), "dup_line_ratio": part(c["n_dup_lines"], c["n_lines"]),
        "repeat_ratio": part(c["n_repeat_words"], c["n_words"]), "upper_ratio": part(c["n_upper"], c["word_chars"]),
        "reuse_ratio": part(c["n_words"] - c["n_distinct"], c["n_words"]),
    }


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial (n, p)."""
    if k >= n:
        return 0.0
    i = np.arange(k, dtype=float)
    steps = np.concatenate([[n * math.log1p(-p)], np.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p)])
    terms = np.cumsum(steps)
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


def choose(levels: pd.DataFrame, alpha: float, error: float, target: float) -> list[tuple[str, float, int, int]]:
    """Rule, cutoff, good documents of the holdout and those rejected by all rules together, for one stratum.

    ``levels``: rows of ``proposes`` (whether of that half), ``quality``, the level of each rule (how many of its cutoffs
    are reached, the strictest first) and ``n`` documents.
    """

    def over(part: pd.DataFrame, rule: str, looser: int) -> pd.Series:
        return part[rule] >= len(CUTOFFS[rule]) - looser

    proposal, proof = levels[levels["proposes"]], levels[~levels["proposes"] & (levels["quality"] == 1)]
    good, bad = proposal[proposal["quality"] == 1], proposal[proposal["quality"] == 0]
    found = []
    for place, (rule, cutoffs) in enumerate(CUTOFFS.items()):
        best = (0, 0)
        for looser in range(len(cutoffs)):
            hits = int(bad.loc[over(bad, rule, looser), "n"].sum())
            if hits > best[0] and good.loc[over(good, rule, looser), "n"].sum() <= target * good["n"].sum():
                best = (hits, looser)
        if best[0]:
            found.append((-best[0], place, rule, best[1]))
    rejected, n, rules, lost = pd.Series(False, index=proof.index), int(proof["n"].sum()), [], 0
    for _, _, rule, looser in sorted(found):
        rejected |= over(proof, rule, looser)
        k = int(proof.loc[rejected, "n"].sum())
        if not n or log_binomial_tail(k, n, alpha) > math.log(error):
            break
        rules.append((rule, CUTOFFS[rule][looser]))
        lost = k
    return [(rule, cutoff, n, lost) for rule, cutoff in rules]


def select_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, target: float = TARGET) -> DataFrame:
    """``stratum``, ``rule``, ``cutoff``, ``n_good``, ``false_rejections`` (holdout, all rules of the stratum together): the
    rules that act; no row where none is proved.

    ``measured``: ``doc_id``, ``stratum``, struct ``c`` of counts. ``labels``: ``doc_id``, ``quality`` (1 good, 0 bad);
    null ids or labels are left out, and of several labels of one document the largest counts. Documents that the base
    limits reject don't take part. Only counts per stratum and combination of levels leave the executors' aggregation.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    c = F.col("c")

    def level(rule: str, value: Column) -> Column:
        """How many of the rule's cutoffs the value reaches."""
        return sum((F.coalesce(value >= x, F.lit(False)).cast("int") for x in CUTOFFS[rule]), F.lit(0))

    held = measured.where(~base_failed(c)).hint("merge").join(marks, "doc_id")
    proposes = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 32, 1) < "8"
    levels = held.select("stratum", proposes.alias("proposes"), "quality", *[level(r, v).alias(r) for r, v in rule_values(c).items()])
    levels = stored(levels.groupBy(*levels.columns).agg(F.count("*").alias("n")), "quality-levels")
    strata = levels.where("quality = 1 and not proposes").select("stratum").distinct().count()
    error = delta / max(1, strata)

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["stratum"].iloc[0], *row) for row in choose(pdf, alpha, error, target)]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "false_rejections"])

    return levels.groupBy("stratum").applyInPandas(select, "stratum string, rule string, cutoff double, n_good long, false_rejections long")


def _with_cutoffs(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    wide = stored(cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in CUTOFFS]), "quality-cutoffs")
    wide = F.broadcast(wide) if wide.count() <= BROADCAST_STRATA else wide.hint("merge")
    return df.join(wide, F.col("stratum") == F.col("_stratum"), "left")


def _kept(c: Column) -> Column:
    rejected = [F.coalesce(v >= F.col(f"_{r}"), F.lit(False)) for r, v in rule_values(c).items()]
    out = ~base_failed(c)
    for r in rejected:
        out = out & ~r
    return out


def _stratum(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA, target: float = TARGET
) -> DataFrame:
    """Per input row: ``doc_id``, the counts, ``base_failed`` and ``kept``. Null text: no words, so the base limits reject it.

    Null strata form one stratum. Repeated rows are judged alike, each on its own row. Without labels only the base limits
    decide. Further columns are not read.
    """
    measured = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), _stratum(stratum_col).alias("stratum"), counts(F.col(f"`{text_col}`")).alias("c")), "quality-counts")
    cut = _with_cutoffs(measured, select_cutoffs(measured, labels, alpha, delta, target))
    return cut.select("doc_id", *[F.col(f"c.{n}") for n in COUNTS], base_failed(F.col("c")).alias("base_failed"), _kept(F.col("c")).alias("kept"))


def keep(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA, target: float = TARGET
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns. The texts are measured a second time rather than stored or shuffled."""
    with scratch(docs.sparkSession):
        measured = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), _stratum(stratum_col).alias("stratum"), counts(F.col(f"`{text_col}`")).alias("c")), "quality-counts")
        cutoffs = stored(select_cutoffs(measured, labels, alpha, delta, target), "quality-chosen", keep=True)
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), _stratum(stratum_col).alias("stratum"), counts(F.col(f"`{text_col}`")).alias("c"))
    return _with_cutoffs(rows, cutoffs).where(_kept(F.col("c"))).select("row.*")
