"""Repair of conversation structure: cheapest edits by dynamic programming over grammar-compressed symbol sequences.

Every row of a conversation becomes one of nine symbols: the class of its role (system, user, assistant, other), large if its
text is cut off, or ``X`` if it has to go (blank, or said before). A sequence is brought into the form ``(s?(ua)+)?`` by
keeping, reroling, deleting and inserting; what a run of symbols can do is a min-plus matrix over the four states of that
form, each entry with its cheapest audit. Re-Pair replaces frequent pairs of symbols by new ones, counted over all
conversations; each rule's matrix is the product of its two parts' and serves every conversation that holds it.

Steps, each a Spark job over tables in the shared folder: rows without texts (hashes only) are ordered over ranges of
(conversation, turn), so that a conversation of a third of all rows is dealt to many tasks, and gathered to blocks of
symbols; equal sequences of whole conversations are solved once; the audit goes back to the rows as edits; last, texts and
edits meet in one ordered pass, which digests the conversations that lie in one range and hands on the texts of those that
go over a border in pieces. A digest is sequential by nature: only the pieces of a border conversation stream through one task.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlefold.llm.common import scratch, stored

#: What an edit costs, states of the form (start, after system, after user, after assistant).
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a state expects next if something is inserted or reroled, and where that leads.
_NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
_TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: Rows gathered in a block, bytes of text handed on in a piece, and the first letter of the grammar's own symbols.
BLOCK_ROWS, PIECE_BYTES, FIRST_RULE = 4096, 1 << 20, 0x4E00
_EDIT = re.compile("I*[KRD]")
Matrix = dict[tuple[int, int], tuple[int, str]]


# ---- matrices and grammar ------------------------------------------------------------------------------------------


def symbol_matrix(symbol: str) -> Matrix:
    """Cheapest cost and audit from state to state over one row. Inserts stand before the row's own edit, so that of two
    audits of the same rows neither begins with the other, and the smaller one stays smaller whatever follows."""
    out: Matrix = {}

    def put(a: int, b: int, cost: int, audit: str) -> None:
        if (a, b) not in out or (cost, audit) < out[a, b]:
            out[a, b] = (cost, audit)

    role, extra = symbol.lower(), CUT_OFF if symbol.isupper() else 0
    for a in range(4):
        at, inserted = a, 0
        for _ in range(3):
            cost, ins = inserted * INSERT, "I" * inserted
            put(a, at, cost + DELETE, ins + "D")
            if symbol != "X":
                letter, to = _NEXT[at]
                put(a, to, cost + REROLE + extra, ins + "R")
                if role == letter:
                    put(a, to, cost + extra, ins + "K")
                elif role == "s" and at == START:
                    put(a, SYSTEM, cost + extra, ins + "K")
            at, inserted = _NEXT[at][1], inserted + 1
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product; ties go to the smaller audit."""
    out: Matrix = {}
    for (a, m), (c, audit) in left.items():
        for b in range(4):
            if found := right.get((m, b)):
                new = (c + found[0], audit + found[1])
                if (a, b) not in out or new < out[a, b]:
                    out[a, b] = new
    return out


class Grammar:
    """Rules (a pair of symbols and the symbol that replaces it, in the order they were made) and every symbol's matrix."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str]] = []
        self.matrix = {x: symbol_matrix(x) for x in "suaoSUAOX"}
        self.length = dict.fromkeys(self.matrix, 1)

    def add(self, pair: str) -> None:
        new = chr(FIRST_RULE + len(self.rules))
        self.rules.append((pair, new))
        self.matrix[new] = product(self.matrix[pair[0]], self.matrix[pair[1]])
        self.length[new] = self.length[pair[0]] + self.length[pair[1]]

    def compress(self, sequence: str) -> str:
        for pair, new in self.rules:
            sequence = sequence.replace(pair, new)
        return sequence

    def solve(self, sequence: str) -> tuple[int, str]:
        """Cost and audit of the cheapest repair: costs from the end to the front, then the smallest audit that attains them."""
        parts = self.compress(sequence)
        ahead = [[_TAIL[s][0] for s in range(4)]]
        for symbol in reversed(parts):
            after, now = ahead[-1], [1 << 60] * 4
            for (a, b), (cost, _) in self.matrix[symbol].items():
                now[a] = min(now[a], cost + after[b])
            ahead.append(now)
        ahead.reverse()
        audits, at = [], START
        for i, symbol in enumerate(parts):
            best = [(audit, b) for (a, b), (cost, audit) in self.matrix[symbol].items() if a == at and cost + ahead[i + 1][b] == ahead[i][at]]
            audit, at = min(best)
            audits.append(audit)
        return ahead[0][START], "".join(audits) + _TAIL[at][1]


def learn(sequences: DataFrame, rounds: int = 8, max_rules: int = 256, longest: int = 4096, least_gain: float = 0.01) -> Grammar:
    """Re-Pair over all rows of ``sequences`` (``seq``, ``n`` conversations that have it), several pairs a round.

    A round counts the adjacent pairs of all compressed sequences (one row per pair and task is shuffled; there are at most
    (9 + ``max_rules``)^2 pairs) and takes the most frequent ones that have no symbol in common. It ends when a round would
    save less than ``least_gain`` of the symbols. A rule stands for at most ``longest`` symbols, which bounds its audits.
    The grammar only decides how much work is shared, never a result.
    """
    grammar = Grammar()
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], grammar=grammar) -> Iterator[pa.RecordBatch]:
            pairs: Counter = Counter()
            for batch in batches:
                for seq, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    parts = grammar.compress(seq)
                    pairs[""] += n * len(parts)
                    for pair, k in Counter(map(str.__add__, parts, parts[1:])).items():
                        pairs[pair] += n * k
            yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], ["pair", "n"])

        found = sequences.select("seq", "n").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        counts = {r.pair: r.n for r in found.collect()}
        total, used, saved = counts.pop("", 0), set(), 0
        for pair, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if n < 2 or len(grammar.rules) >= max_rules:
                break
            if not used & set(pair) and grammar.length[pair[0]] + grammar.length[pair[1]] <= longest:
                grammar.add(pair)
                used |= set(pair)
                saved += n
        if saved < least_gain * total or not saved:
            break
    return grammar


# ---- rows ----------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c`` (key of the conversation), ``turn``, ``role``, ``text``, ``copies`` of the rows that are left after damage.

    The damage follows from crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes ``.!?``,
    3 repeats it, 4 makes its role user. A null in this key, in role or in text is one space.
    """
    col = lambda c: F.col(f"`{c}`").cast("string")
    known = lambda c: F.coalesce(col(c), F.lit(" "))
    code = F.crc32(F.concat(known(conv_col), F.lit(":"), known(turn_col))) % 20
    rows = conversations.select(_key(conv_col).alias("c"), F.col(f"`{turn_col}`").cast("long").alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.where("code <> 0").select("c", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def _key(conv_col: str) -> Column:
    """A string that tells a null id from every other."""
    return F.coalesce(F.concat(F.lit("c"), F.col(f"`{conv_col}`").cast("string")), F.lit("n"))


def symbols(rows: DataFrame) -> DataFrame:
    """One row per different (``c``, ``turn``, ``role``, text): ``h`` (MD5 of the text), ``m`` equal rows, ``lead`` (the first
    one's symbol; the others are ``X``), and the faults counted. Texts stay behind.

    A text was said before if an equal one of the same role has a smaller turn (nulls first) or is an earlier equal row;
    found by aggregation, so a text on a third of all rows is one row per turn.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    light = rows.select("c", "turn", "role", F.md5("text").alias("h"), "copies", F.when(blank, "blank").when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "whole").otherwise("cut").alias("kind"))
    light = stored(light.groupBy("c", "turn", "role", "h").agg(F.sum("copies").alias("m"), F.first("kind").alias("kind")), "conv-light")
    said = light.where("kind <> 'blank'").groupBy("c", "role", "h").agg(F.min(F.struct("turn")).alias("t"), F.count("*").alias("k")).where("k > 1").drop("k")
    met = light.hint("merge").join(said.hint("merge"), ["c", "role", "h"], "left")
    first = F.col("t").isNull() | F.col("turn").eqNullSafe(F.col("t.turn"))
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    is_blank = F.col("kind") == "blank"
    cut = ~is_blank & first & (F.col("kind") == "cut")
    return met.select(
        "c", "turn", "role", "h", "m", initial.alias("initial"), F.when(is_blank | ~first, "X").when(cut, F.upper(plain)).otherwise(plain).alias("lead"),
        F.when(is_blank, F.col("m")).otherwise(0).alias("blank"), F.when(is_blank, 0).otherwise(F.col("m") - first.cast("int")).alias("duplicate"), cut.cast("long").alias("truncated"),
    )


_ORDER = ("c", "turn", "role", "h")
_BLOCK = "c string, turn long, role string, h string, seq string, first_i string, last_i string, first_t long, last_t long, turns long, blank long, duplicate long, truncated long, illegal long, keys array<struct<turn:long,role:string,h:string,m:long>>"


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh=None, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most about ``most`` units as ``weigh`` counts them (rows if not given: 10,000)."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else most // 10_000
        if weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_KEYS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("h", pa.string()), ("m", pa.int64())]))
_BLOCK_ARROW = pa.schema([(n, _KEYS if n == "keys" else pa.int64() if t.startswith("long") else pa.string()) for n, t in (x.strip().split(" ", 1) for x in _BLOCK.split(", ", 14))])


def blocks(rows: DataFrame) -> DataFrame:
    """Runs of at most ``BLOCK_ROWS`` rows of one conversation in order, with their symbols, counts, ends and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for c, own in groupby(_rows_of(batches), key=lambda r: r[0]):
                block: list[tuple] = []
                for row in own:
                    block.append(row)
                    if len(block) == BLOCK_ROWS:
                        yield one(c, block)
                        block = []
                if block:
                    yield one(c, block)

        def one(c: str, own: list[tuple]) -> tuple:
            known = [r[1] for r in own if r[1] is not None]
            steps = sum(not _legal(a[5], b[5]) for a, b in zip(own, own[1:])) + sum((r[4] - 1) * (not _legal(r[5], r[5])) for r in own)
            return (
                c, own[0][1], own[0][2], own[0][3], "".join(r[6] + "X" * (r[4] - 1) for r in own), own[0][5], own[-1][5], min(known, default=None), max(known, default=None),
                len(set(known)), sum(r[7] for r in own), sum(r[8] for r in own), sum(r[9] for r in own), steps, [dict(zip(("turn", "role", "h", "m"), r[1:5])) for r in own],
            )

        yield from _batches(made(), _BLOCK_ARROW, lambda r: 100 * len(r[14]) + len(r[4]), 1 << 24)

    order = [F.asc_nulls_first(c) for c in _ORDER]
    return rows.select(*_ORDER, "m", "initial", "lead", "blank", "duplicate", "truncated").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _BLOCK)


_CONV = "c string, seq string, gaps long, blank long, duplicate long, truncated long, illegal long"


def gathered(made: DataFrame) -> DataFrame:
    """One row per conversation from its blocks: the whole sequence (a letter a row, like the audit) and the counts."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split(" ") for x in _CONV.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for c, own in groupby(_rows_of(batches), key=lambda r: r[0]):
                seqs, low, high, turns, sums, before = [], None, None, 0, [0] * 4, None
                for _, _, _, _, seq, first_i, last_i, first_t, last_t, n, *counts in own:
                    seqs.append(seq)
                    if n:
                        turns += n - (first_t == high)
                        low, high = first_t if low is None else low, last_t
                    sums = [a + b for a, b in zip(sums, counts)]
                    sums[3] += before is not None and not _legal(before, first_i)
                    before = last_i
                yield (c, "".join(seqs), high - low + 1 - turns if turns else 0, *sums)

        yield from _batches(each(), schema, lambda r: 64 + len(r[1]))

    light = made.drop("keys").repartition("c").sortWithinPartitions(*[F.asc_nulls_first(c) for c in _ORDER])
    return light.mapInArrow(run, _CONV)


def solved(sequences: DataFrame, grammar: Grammar) -> DataFrame:
    """``seq``, ``cost``, ``audit`` for every row of ``sequences``."""
    schema = pa.schema([("seq", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((seq, *grammar.solve(seq)) for (seq,) in _rows_of(batches)), schema, lambda r: 64 + 2 * len(r[0]))

    return sequences.select("seq").mapInArrow(run, "seq string, cost long, audit string")


_EDITS = "c string, z int, turn long, role string, h string, e int, ops string, text string"
_EDITS_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64()}.get(t, pa.string())) for n, t in (x.split(" ") for x in _EDITS.split(", "))])


def edits(made: DataFrame, audits: DataFrame) -> DataFrame:
    """What to do at each row that is not simply deleted: ``ops`` of ``i``/``j`` (insert user, assistant), ``k`` (keep),
    ``r``/``t`` (rerole to user, assistant). Inserts behind the last row have ``z`` = 1.

    Audits and blocks meet in one ordered stream per conversation, the audit first; a task holds one audit and one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for c, own in groupby(_rows_of(batches), key=lambda r: r[0]):
                audit, at, place = next(own)[5], 0, START
                for *_, keys in own:
                    for key in keys:
                        ops = ""
                        for i in range(key["m"]):
                            hit = _EDIT.match(audit, at)
                            at = hit.end()
                            if hit[0] != "D":
                                more, place = _ops(hit[0], place, key["role"])
                                ops += more
                        if ops:
                            yield (c, 0, key["turn"], key["role"], key["h"], 0, ops, None)
                if at < len(audit):
                    yield (c, 1, None, "", "", 0, _ops(audit[at:], place, "")[0], None)

        yield from _batches(each(), _EDITS_ARROW)

    both = audits.select("c", F.lit(0).alias("z"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("h"), "audit", F.lit(None).cast("array<struct<turn:long,role:string,h:string,m:long>>").alias("keys"))
    both = both.unionByName(made.select("c", F.lit(1).alias("z"), "turn", "role", "h", F.lit(None).cast("string").alias("audit"), "keys"))
    return both.repartition("c").sortWithinPartitions("c", "z", F.asc_nulls_first("turn"), "role", "h").mapInArrow(run, _EDITS)


def _ops(audit: str, place: int, role: str) -> tuple[str, int]:
    out = []
    for edit in audit:
        letter, to = _NEXT[place]
        if edit == "K":
            out.append("k")
            place = SYSTEM if place == START and role[:1] == "s" else to
        elif edit in "IR":
            out.append({"Iu": "i", "Ia": "j", "Ru": "r", "Ra": "t"}[edit + letter])
            place = to
    return "".join(out), place


def digests(rows: DataFrame, todo: DataFrame) -> DataFrame:
    """``c`` and ``sha`` of every conversation that has text left: SHA-256 of its ``role:text`` lines after the edits."""
    out = "c string, whole boolean, n int, z int, turn long, role string, h string, data binary"
    schema = pa.schema([("c", pa.string()), ("whole", pa.bool_()), ("n", pa.int32()), ("z", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines(own: Iterator[tuple]) -> Iterator[tuple]:
            for key, same in groupby(own, key=lambda r: r[1:5]):
                ops, text = "", None
                for *_, e, op, body in same:
                    if e == 0:
                        ops = op
                    elif text is None:
                        text = body
                    for x in ops if e or key[0] else "":
                        role = key[2] if x == "k" else "user" if x in "ir" else "assistant"
                        yield key, f"\n{role}:{'' if x in 'ij' else text}".encode("utf-8", "surrogatepass")
                    ops = "" if e else ops

        def pieces(c: str, own: Iterator[tuple]) -> Iterator[tuple]:
            held, size, n, at = [], 0, 0, None
            for key, line in lines(own):
                at = at or key
                held.append(line)
                size += len(line)
                if size >= PIECE_BYTES:
                    yield (c, False, n, *at, b"".join(held))
                    held, size, n, at = [], 0, n + 1, None
            if held:
                yield (c, False, n, *at, b"".join(held))

        def each() -> Iterator[tuple]:
            first = True
            stream = groupby(_rows_of(batches), key=lambda r: r[0])
            item = next(stream, None)
            while item:
                c, own = item
                if first:
                    yield from pieces(c, own)  # may have begun in the range before
                    first, item = False, next(stream, None)
                    continue
                # until the next conversation shows that this one ends here, keep its digest and its pieces side by side
                digest, kept, size, more = hashlib.sha256(), [], 0, pieces(c, own)
                for piece in more:
                    digest.update(piece[-1] if kept else piece[-1][1:])
                    kept.append(piece)
                    size += len(piece[-1])
                    if size > 4 * PIECE_BYTES:
                        break
                if size > 4 * PIECE_BYTES:  # too large to hold: hand on
                    yield from kept
                    yield from more
                    item = next(stream, None)
                    continue
                item = next(stream, None)
                if item:
                    if kept:
                        yield (c, True, 0, 0, None, "", "", digest.digest())
                else:
                    yield from kept  # may go on in the next range

        yield from _batches(each(), schema, lambda r: 64 + len(r[-1]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for c, own in groupby(_rows_of(batches), key=lambda r: r[0]):
                digest = None
                for piece in own:
                    if piece[1]:
                        yield (c, piece[-1].hex())
                    elif digest is None:
                        digest = hashlib.sha256(piece[-1][1:])
                    else:
                        digest.update(piece[-1])
                if digest:
                    yield (c, digest.hexdigest())

        yield from _batches(each(), pa.schema([("c", pa.string()), ("sha", pa.string())]))

    order = ["c", "z", F.asc_nulls_first("turn"), "role", "h"]
    texts = rows.select("c", F.lit(0).alias("z"), "turn", "role", F.md5("text").alias("h"), F.lit(1).alias("e"), F.lit(None).cast("string").alias("ops"), "text")
    both = todo.unionByName(texts).repartitionByRange(*order).sortWithinPartitions(*order, "e")
    # a range never parts rows of equal keys, so edits and text of a row are together
    done = both.mapInArrow(run, out)
    return done.repartition("c").sortWithinPartitions(*order, "n").mapInArrow(finish, "c string, sha string")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rounds: int = 8, max_rules: int = 256) -> DataFrame:
    """Every different conversation id with its faults after damage, the cheapest repair and the digest of the repaired text.

    Columns: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows are taken by turn, nulls first, then by role and by MD5 of the text; equal rows follow each other. A null id is a
    conversation of its own; a null role or text is one space. A conversation of which no row is left has zeros, an
    empty audit and the digest of nothing; an empty table gives an empty result. Only the named columns are read, so
    further columns cannot clash. Repeated rows count as rows: all but the first of a text are duplicates.
    """
    with scratch(conversations.sparkSession):
        rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
        made = stored(blocks(symbols(rows)), "conv-blocks")
        conv = stored(gathered(made), "conv-sequences")
        distinct = stored(conv.groupBy("seq").agg(F.count("*").alias("n")), "conv-distinct")
        answers = stored(solved(distinct, learn(distinct, rounds, max_rules)), "conv-solved")
        found = stored(conv.hint("merge").join(answers.hint("merge"), "seq").drop("seq"), "conv-found")
        todo = stored(edits(made, found.select("c", "audit")), "conv-edits")
        sha = stored(digests(rows, todo), "conv-digests")
        ids = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), _key(conv_col).alias("c")).distinct()
        out = ids.hint("merge").join(found.hint("merge"), "c", "left").hint("merge").join(sha.hint("merge"), "c", "left")
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        nothing = hashlib.sha256(b"").hexdigest()
        return stored(out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256")), "conv-repaired", keep=True)
