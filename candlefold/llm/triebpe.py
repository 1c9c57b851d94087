"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a block of text are laid out as a trie: sorted, they are its leaves in depth-first order, and what a
word shares with the one before it is the path that stays on the stack. The state of a trie node is the last token of the
encoding of its prefix. It follows from the states above: it is the one token that ends there and goes with the last token
of what lies before it. Two tokens go together if no merge across their border comes before the merges that built them.
So the encoding of a shared prefix is found once, and a word's ids are read off by stepping back from its leaf.

The vocabulary marks word ends, so a leaf's last symbol is another one than the same letter inside a word. Words are cut
by Python's Unicode tables; a text with a character that these don't define, or on whose composition the tokenizers
library's tables were found to disagree, is normalised and cut by that library's own tables.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Characters of text whose words are encoded together, and encoded words that are kept for the next block.
BLOCK_CHARS = 1 << 21
KEEP_WORDS = 200_000
KEEP_PAIRS = 300_000
#: From here on there are only rare ideographs, tags and private letters; their texts are always cut by the library.
RARE_PLANES = chr(0x30000)
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 bytes stand for themselves, others for U+0100 onward."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + hidden.index(b)) for b in range(256)]


class TrieBpe:
    """Encoder for a tokenizers JSON of a lower-casing BPE whose vocabulary marks word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {self.ids[a] << 20 | self.ids[b]: r for r, (a, b) in enumerate(merges)}
        self.parts = {self.ids[a + b]: (self.ids[a], self.ids[b], r) for r, (a, b) in reversed(list(enumerate(merges)))}
        # a word's last symbol carries the end mark, so its tokens form a vocabulary of their own
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: i for t, i in self.ids.items() if t.endswith(self.end)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word_re = regex.compile(split["pattern"]["Regex"])
        # the library's own normaliser and cutter, for texts that hold letters of other Unicode versions
        own = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "pre_tokenizer": split, "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.own_normalizer, self.own_cutter = own.normalizer, own.pre_tokenizer
        self.odd = frozenset(self._odd_letters())
        self.letters = dict(enumerate(byte_letters()))
        # every ending of a token: a node looks no further back than its prefix ends like one
        self.inner_ends = {t[k:] for t in self.inner for k in range(len(t))}
        self.final_ends = {t[k:] for t in self.final for k in range(len(t))}
        self._right: dict[int, tuple] = {}
        self._left: dict[int, tuple] = {}
        self._fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}

    def _own_words(self, text: str) -> list[str]:
        return [w for w, _ in self.own_cutter.pre_tokenize_str(self.own_normalizer.normalize_str(text))]

    def _odd_letters(self) -> Iterator[str]:
        """Characters that Python's tables don't define, and those that compose or reorder in another way in the library's."""
        for c in map(chr, range(128, ord(RARE_PLANES))):
            if (kind := unicodedata.category(c)) == "Cn":
                yield c
            elif kind[0] == "M" or unicodedata.decomposition(c)[:1] not in ("", "<"):
                probe = f"a{c}\u0316\u0301 {unicodedata.normalize('NFD', c)}"
                if self._own_words(probe) != self._table_words(probe):
                    yield c

    def words(self, text: str) -> list[str]:
        """Normalised words; case is folded letter by letter, so a final sigma is no special case."""
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
        letters = set(text)
        plain = max(letters) < RARE_PLANES and self.odd.isdisjoint(letters)
        return self._table_words(text) if plain else self._own_words(text)

    def _table_words(self, text: str) -> list[str]:
        return self.word_re.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _edge(self, token: int, side: int, memo: dict[int, tuple]) -> tuple:
        """Symbols that stand at one end of a token while it is built, each with the rank of the merge that ends it."""
        if (got := memo.get(token)) is None:
            out, t, until = [], token, _NEVER
            while True:
                out.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.parts[t][2], self.parts[t][side]
            got = memo[token] = tuple(out)
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether encoding the text of ``a`` and ``b`` gives these two tokens. Of equal merges the left one is first."""
        rank = self.rank
        right = self._left.get(b) or self._edge(b, 0, self._left)
        for x, x_until in self._right.get(a) or self._edge(a, 1, self._right):
            for y, y_until in right:
                r = rank.get(x << 20 | y)
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, str, str]]:
        """For each distinct word: number of ids, the ids and the tokens joined by spaces."""
        letters, names, fits, memo = self.letters, self.names, self.fits, self._fits
        if len(memo) > KEEP_PAIRS:
            memo.clear()
        spelled = sorted((w.encode().decode("latin-1").translate(letters), w) for w in words)
        out, before = {}, ""
        last: list[int] = [-1]  # the path's states: last token of each prefix, and its length
        size: list[int] = [0]
        for s, w in spelled:
            n = len(s)
            top = min(len(last), n, len(before) + 1)
            shared = 1
            while shared < top and before[shared - 1] == s[shared - 1]:
                shared += 1
            del last[shared:], size[shared:]
            for i in range(shared, n + 1):
                vocab, ends = (self.inner, self.inner_ends) if i < n else (self.final, self.final_ends)
                at, found = i - 1, []
                while at >= 0 and (end := s[at:i]) in ends:
                    if (t := vocab.get(end)) is not None:
                        found.append((t, at))
                    at -= 1
                for t, at in reversed(found):
                    if at:
                        pair = last[at] << 20 | t
                        if (ok := memo.get(pair)) is None:
                            ok = memo[pair] = fits(last[at], t)
                        if not ok:
                            continue
                    last.append(t)
                    size.append(i - at)
                    break
                else:
                    raise ValueError(f"no token ends at {i} of {s!r}")
            ids, at = [last.pop()], n - size.pop()
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[w] = (len(ids), " ".join(map(str, ids)), " ".join([names[i] for i in ids]))
            before = s
        return out

    def encode_block(self, blocks: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        """Per list of words: number of ids, ids and tokens joined by spaces."""
        distinct = set().union(*blocks)
        known = self.known
        if len(known) > KEEP_WORDS:
            self.known = known = {w: known[w] for w in distinct & known.keys()}
        if missing := distinct - known.keys():
            known.update(self.encode_words(missing))
        for words in blocks:
            got = [known[w] for w in words]
            yield sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])


@lru_cache(maxsize=2)
def load(path: str | None = None) -> TrieBpe:
    return TrieBpe(path or public_tokenizers.path("word_bpe_49k.json"))


def _pieces(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in pieces cut at spaces: no word and no special token reaches over a space."""
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= size else text.find(" ", at + size)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, SHA-256 of the ids in decimal joined by spaces, and of the decoded text.

    The vocabulary file has no decoder, so decoding joins the tokens by spaces. Null: empty text, no ids. Repeated rows
    each get a row; null ids stay null. No other column is read. Blocks bound the memory, also for one very long text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        gc.freeze()  # the vocabulary's tables need no more passes of the cycle collector
        for b in batches:
            n = len(b)
            counts, ids_sha, text_sha = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            rows: list[int] = []
            words: list[list[str]] = []
            chars = 0

            def add(row: int, k: int, ids: str, tokens: str) -> None:
                if k:
                    gap = " " if counts[row] else ""
                    ids_sha[row].update((gap + ids).encode())
                    text_sha[row].update((gap + tokens).encode())
                    counts[row] += k

            def flush() -> None:
                nonlocal chars
                for row, got in zip(rows, bpe.encode_block(words)):
                    add(row, *got)
                rows.clear()
                words.clear()
                chars = 0

            for row, value in enumerate(b.column(1)):
                for piece in _pieces(value.as_py() or ""):
                    for part in bpe.special_re.split(piece) if "<|" in piece else (piece,):
                        if part in bpe.special:
                            flush()
                            add(row, 1, str(bpe.special[part]), part)
                        elif part:
                            rows.append(row)
                            words.append(bpe.words(part))
                    chars += len(piece)
                    if chars >= BLOCK_CHARS:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in ids_sha]), pa.array([h.hexdigest() for h in text_sha])],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, SCHEMA)
