"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

BPE gives each prefix of a piece one encoding, so the last token of a prefix is unique. It is the one token t that ends
there such that t may follow the last token u of the prefix before t: BPE of the two tokens' bytes is again (u, t). A
suffix automaton of the vocabulary finds the tokens ending at each position; the pair test undoes merges on both sides of
the cut and asks whether BPE would have merged across it first. Back-pointers from the end give the ids.

A text is first cut at the vocabulary's added tokens and then, by the tokenizer's own pattern, into pieces; each distinct
piece is encoded once per task, within a bounded memory of pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import columns, release_memory, table

#: The split pattern of byte-level BPE (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that are letters or numbers in Unicode 17, as the regex library has it, but not in Unicode 16, as the
#: tokenizers library has it (fixed values, first-last).
NEWER = (
    "0x558-0x558, 0x58B-0x58C, 0x88F-0x88F, 0xC5C-0xC5C, 0xCDC-0xCDC, 0x208F-0x208F, 0x209D-0x209F, 0xA7CE-0xA7CF, "
    "0xA7D2-0xA7D2, 0xA7D4-0xA7D4, 0xA7DD-0xA7DD, 0xA7E2-0xA7E2, 0xA7F1-0xA7F1, 0xAB6C-0xAB6D, 0x107BB-0x107BF, 0x10940-0x10959, "
    "0x10EC5-0x10EC7, 0x10ED9-0x10EEE, 0x11B0A-0x11B0A, 0x11DB0-0x11DDB, 0x11DE0-0x11DE9, 0x11DF1-0x11DF1, 0x1246F-0x1246F, 0x12475-0x1247F, "
    "0x12550-0x12686, 0x16EA0-0x16EB8, 0x16EBB-0x16ED3, 0x16FF2-0x16FF6, 0x187F8-0x187FF, 0x18CD6-0x18CDA, 0x18D09-0x18D20, 0x18D80-0x18DF2, "
    "0x18E00-0x19191, 0x191A0-0x191D2, 0x1B123-0x1B128, 0x1B168-0x1B168, 0x1D6A6-0x1D6A6, 0x1DF1F-0x1DF24, 0x1DF2B-0x1DF81, 0x1DF90-0x1DF96, "
    "0x1DFCD-0x1DFFF, 0x1E6C0-0x1E6DE, 0x1E6E0-0x1E6E2, 0x1E6E4-0x1E6E5, 0x1E6E7-0x1E6ED, 0x1E6F0-0x1E6F4, 0x1E6FE-0x1E6FF, 0x2B73A-0x2B73F, "
    "0x2B81E-0x2B81E, 0x2CEA2-0x2CEAD, 0x323B0-0x33479, 0x3D000-0x3FC3F, "
)
#: Distinct pieces that a task, and pairs of tokens that a worker process remembers at most; then it starts afresh.
PIECES, PAIRS = 200_000, 300_000
#: Longer pieces, in characters, are not remembered, so that the memory is bounded in bytes too.
LONG = 64
#: Texts whose ids are held at a time.
ROWS = 256


def byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file, by the format's rule."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def latin_pattern() -> str:
    """PATTERN for texts of code points below 256, with its classes written out, which the re module matches faster."""
    letter, number, space = ("".join(rf"\x{c:02x}" for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


class Pairs(dict):
    """Whether token t may follow token u, by key u << 32 | t."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        found = self[key] = self.codec.compatible(key >> 32, key & 0xFFFFFFFF)
        return found


class Pieces(dict):
    """The ids of a piece of text as little-endian unsigned 32-bit integers.

    When half of the memory is full, its pieces become the older half, and those of them that come again are young again."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (found := self.older.get(piece)) is None:
            ids = self.codec.encode_piece(piece)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG:
            if len(self) >= PIECES // 2:
                self.older = dict(self)
                super().clear()
            self[piece] = found
        return found

    def clear(self) -> None:
        super().clear()
        self.older = {}


class SuffixAutomaton:
    """All substrings of a set of words, to find the words that end at each place of a text.

    The words are added as a trie, level by level. State 0 is the empty string; `step` has the transitions, `link` the
    state of the longest suffix that is another state's, `size` the length of a state's longest string. No word reaches
    beyond its own end, so each word is the longest string of its state.
    """

    def __init__(self, words: dict[bytes, int]):
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        state_of = self._add_all(words)
        #: The words that are suffixes of a state's longest string, longest first, as (length, id).
        self.words: list[tuple[tuple[int, int], ...]] = [()] * len(self.size)
        word_at = {state_of[w]: (len(w), i) for w, i in words.items()}
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            shorter = self.words[self.link[s]]
            self.words[s] = (word_at[s], *shorter) if s in word_at else shorter
        #: The transitions by state << 8 | byte: one table takes less memory than one for each state.
        self.step = {s << 8 | c: to for s, steps in enumerate(self.steps) for c, to in steps.items()}
        del self.steps

    def _add_all(self, words: dict[bytes, int]) -> dict[bytes, int]:
        """The state of each word. A level's prefixes are added after those of the level before, so that a link is there
        before it is needed; a state that was cloned later still holds its own longest string."""
        state_of, level = {b"": 0}, sorted(w for w in words if w)
        for n in range(1, max(map(len, level), default=0) + 1):
            level = [w for w in level if len(w) >= n]
            for prefix in dict.fromkeys(w[:n] for w in level):
                state_of[prefix] = self._add(state_of[prefix[:-1]], prefix[-1])
        return state_of

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.steps.append(step)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string and c, parted from longer strings of its state if there are any."""
        step, q = self.steps, self.steps[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, dict(step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, p: int, c: int) -> int:
        """The state of the longest string of p and c."""
        if c in self.steps[p]:
            return self._split(p, c)
        new = self._state(self.size[p] + 1, {}, 0)
        while p >= 0 and c not in self.steps[p]:
            self.steps[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def ends(self, text: bytes) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
        """Each end of a prefix of the text with the words that end there, longest first."""
        step, link, size, words = self.step.get, self.link, self.size, self.words
        state = matched = 0
        for end, c in enumerate(text, 1):
            while (to := step(state << 8 | c)) is None and state:
                state = link[state]
                matched = size[state]
            if to is not None:
                state, matched = to, matched + 1
            yield end, words[state if matched == size[state] else link[state]]


class Codec:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        to_byte = byte_chars()
        bytes_of = {i: bytes(to_byte[c] for c in s) for s, i in model["vocab"].items()}
        id_of = {b: i for i, b in bytes_of.items()}
        most = max([*bytes_of, *(t["id"] for t in spec["added_tokens"])])
        self.merged: dict[int, int] = {}  # pair -> rank
        #: By id: the rank of its first merge, -1 where there is none, and what it merges.
        self.rank, self.left, self.right = [-1] * (most + 1), [0] * (most + 1), [0] * (most + 1)
        for rank, merge in enumerate(model["merges"]):
            left, right = (bytes(to_byte[c] for c in s) for s in (merge if isinstance(merge, list) else merge.split(" ")))
            a, b, c = id_of[left], id_of[right], id_of[left + right]
            self.merged.setdefault(a << 32 | b, rank)
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = rank, a, b
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or want whole words are not supported")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.table = [bytes_of.get(i, b"") for i in range(most + 1)]
        newer = "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (r.split("-") for r in NEWER.rstrip(", ").split(", ")))
        self.newer = re.compile(f"[{newer}]").search
        self.usual = regex.compile(PATTERN).findall
        self.latin = re.compile(latin_pattern()).findall
        symbols = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]")
        self.exact = regex.compile("(?V1)" + symbols.replace(r" ?\p{L}", rf" ?[\p{{L}}--[{newer}]]").replace(r" ?\p{N}", rf" ?[\p{{N}}--[{newer}]]")).findall
        self.automaton = SuffixAutomaton(id_of)
        self.single = {b: i for b, i in id_of.items() if len(b) == 1}
        self.pairs, self.pieces = Pairs(self), Pieces(self)

    def compatible(self, u: int, t: int) -> bool:
        """Whether BPE of the bytes of u then t is (u, t).

        The last merges of u and t are undone, the later one first. Wherever the two tokens now at the cut could have
        merged with each other before the merge that was undone last took one of them away, BPE would have done so.
        Equal ranks are the same merge, and BPE does the left one first.
        """
        limit = 1 << 60
        rank, left, right, merged = self.rank, self.left, self.right, self.merged.get
        while True:
            if merged(u << 32 | t, limit) < limit:
                return False
            ru, rt = rank[u], rank[t]
            if ru < 0 and rt < 0:
                return True
            if ru > rt:
                limit, u = ru, right[u]
            else:
                limit, t = rt + 1, left[t]

    def split(self, text: str) -> list[str]:
        """The pieces of a text between added tokens."""
        try:
            text.encode("latin-1")  # the quickest test; none of the newer letters is among these
            return self.latin(text)
        except UnicodeEncodeError:
            pass
        return self.exact(text) if not text.isascii() and self.newer(text) else self.usual(text)

    def encode_piece(self, piece: str) -> list[int]:
        text = piece.encode("utf-8", "replace")
        if (single := self.single.get(text)) is not None:
            return [single]
        size, pairs = len(text), self.pairs
        last, back = [0] * (size + 1), [0] * (size + 1)
        a, state, matched = self.automaton, 0, 0
        step, link, depth, words = a.step.get, a.link, a.size, a.words
        for end, c in enumerate(text, 1):  # as in SuffixAutomaton.ends, without a generator's cost for each byte
            while (to := step(state << 8 | c)) is None and state:
                state = link[state]
                matched = depth[state]
            if to is not None:
                state, matched = to, matched + 1
            for n, t in words[state if matched == depth[state] else link[state]]:
                start = end - n
                if not start or pairs[last[start] << 32 | t]:
                    last[end], back[end] = t, start
                    break
            else:
                raise ValueError("the vocabulary does not cover all bytes")
        out = []
        while size:
            out.append(last[size])
            size = back[size]
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each; a null text is empty."""
        if not text:
            return b""
        pieces = self.pieces.__getitem__
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(pieces, self.split(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(pieces, self.split(text[at : m.start()]))
            out.append(struct.pack("<I", self.added[m.group()]))
            at = m.end()
        return b"".join([*out, *map(pieces, self.split(text[at:]))])

    def forget(self) -> None:
        """Lets go of the pieces and their memory; the pairs are few and worth keeping for the next task."""
        self.pieces.clear()
        release_memory()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each worker process."""
    found = Codec(path)
    release_memory()
    return found


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text as an array; null and empty texts give an empty array. Repeated rows give
    repeated rows; a column of the name ids_col is replaced, all others pass through."""

    @F.pandas_udf("array<long>")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for batch in texts:
            yield pd.Series([np.frombuffer(c.encode(t), "<u4").astype(np.int64) for t in batch], index=batch.index)
        c.forget()

    return docs.withColumn(ids_col, encoded(F.col(text_col)))


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text that each array of ids stands for; null ids give an empty text, and bytes that are no UTF-8 the
    replacement character. Repeated rows give repeated rows; a column of the name text_col is replaced."""

    @F.pandas_udf("string")
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for batch in ids:
            yield pd.Series([c.decode(np.asarray([] if v is None else v, "<u4").tobytes()) for v in batch], index=batch.index)

    return rows.withColumn(text_col, decoded(F.col(ids_col)))


def bpe_digest(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs' doc_id with n_tokens and digests of the ids and of the text decoded from those ids; ids never leave the task.

    Null texts count as empty: no tokens, and the digests of no bytes. Repeated rows give repeated rows. Other columns
    are not read.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in texts:
            rows = []
            for t in batch:
                ids = c.encode(t)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=batch.index)
        c.forget()

    return docs.select("doc_id", digest(F.col(text_col)).alias("d")).select("doc_id", "d.*")


def bpe_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array<int>), n_tokens, ids_sha256 and decoded_sha256.

    Null and empty texts have no ids. Texts of any length are encoded whole; repeated rows give repeated rows; columns of
    docs with the results' names are replaced, all others pass through; an empty table gives an empty one.
    """
    new = "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    kept = docs.select(*columns(docs, ("ids", "n_tokens", "ids_sha256", "decoded_sha256")))
    n = len(kept.columns)
    if text_col not in kept.columns:  # it has the name of a result, and goes behind the columns that stay
        kept = docs.select(*columns(docs, ("ids", "n_tokens", "ids_sha256", "decoded_sha256")), F.col(text_col))
    at = kept.columns.index(text_col)
    schema = StructType([*kept.schema.fields[:n], *StructType.fromDDL(new).fields])

    def encode(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = [c.encode(t) for t in part.columns[at].to_pylist()]
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
                lists = pyarrow.ListArray.from_arrays(pyarrow.array(ends, pyarrow.int32()), pyarrow.array(np.frombuffer(b"".join(ids), "<i4")))
                digests = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(c.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids]
                yield pyarrow.RecordBatch.from_arrays([*part.columns[:n], lists, pyarrow.array(np.diff(ends)), *map(pyarrow.array, digests)], names=schema.names)
        c.forget()

    return kept.mapInArrow(encode, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), default_path())
