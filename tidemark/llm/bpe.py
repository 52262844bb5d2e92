"""Byte-level BPE encoding and decoding.

Encoding finds the exact result of the merge rules in linear time without replaying merges. Over
each pre-token an Aho-Corasick automaton gives the longest vocabulary token from every position.
The encoder takes the longest one whose boundary with the token before is compatible: a pair of
neighbours is compatible if merging would never have joined across it, which is decided from how
each token splits and kept in a pair table. Where nothing fits it backtracks, and a set of dead
positions keeps any position from being tried twice. Decoding reads token bytes from one blob
through an offset table.

The tokenizer file is read once on the driver and travels with the tasks, so executors need no copy
of it. Special tokens in a text become their id, as the file says. Null texts count as empty: no
ids, empty text.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hex_sha, remembered, table, with_rows

# Fixed value: how byte-level BPE of this family cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Letters and numbers younger than Unicode 16, which the pattern must take as neither.
UNASSIGNED = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    r"\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed"
    r"\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LETTER, _NUMBER = rf"(?:(?![{UNASSIGNED}])\p{{L}})", rf"(?:(?![{UNASSIGNED}])\p{{N}})"
_OTHER = rf"(?:[^\s\p{{L}}\p{{N}}]|[{UNASSIGNED}])"
LATE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?{_OTHER}+|\s+(?!\S)|\s+"

# Pre-tokens, runs between spaces, and pairs of tokens that a task remembers; the memory starts anew beyond that.
REMEMBERED = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Irregular(Exception):
    """A space beside other white space."""


class Chunks(dict):
    """Ids (int32) of a space and the text up to the next space, made when first asked for."""

    def __init__(self, tokens: Vocabulary):
        self.tokens = tokens

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Irregular
        coded = self.tokens.encode_span(" " + chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = coded
        return coded


class Vocabulary:
    """Tokens by merge rank: the 256 bytes first, then one token per merge rule."""

    def __init__(self, file: str):
        model = json.loads(file)
        if model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer file is needed")
        letters = byte_letters()
        ids = model["model"]["vocab"]
        self.tokens = [bytes([b]) for b in range(256)]
        self.ids = [0] * 256
        for letter, byte in letters.items():
            self.ids[byte] = ids[letter]
        # The two parts a token was merged from; a byte is its own part.
        self.parts = [(b, b) for b in range(256)]
        rank = {token: b for b, token in enumerate(self.tokens)}
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            sides = tuple(rank[bytes(letters[c] for c in side)] for side in (left, right))
            token = self.tokens[sides[0]] + self.tokens[sides[1]]
            rank[token] = self.merged[sides] = len(self.tokens)
            self.parts.append(sides)
            self.tokens.append(token)
            self.ids.append(ids[left + right])
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}

        self.automaton = ahocorasick.Automaton()
        for number, token in enumerate(self.tokens):
            self.automaton.add_word(token.decode("latin-1"), number)
        self.automaton.make_automaton()
        # The longest token that is a proper prefix of each token, -1 for none.
        self.shorter = [-1] * len(self.tokens)
        for number, token in enumerate(self.tokens):
            for size in range(len(token) - 1, 0, -1):
                if (prefix := rank.get(token[:size])) is not None:
                    self.shorter[number] = prefix
                    break
        self.size = [len(t) for t in self.tokens]
        self.pairs: dict[tuple[int, int], bool] = {}

        names = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.breaks = regex.compile(f"({names})")
        self.late = re.compile(f"[{UNASSIGNED}]")
        self.cut = regex.compile(PATTERN).findall, regex.compile(LATE).findall
        self.table = offset_table(file)
        self.words: dict[str, list[int]] = {}
        self.chunks = Chunks(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their joined bytes are encoded.

        The merges are undone from the latest to the earliest; if at some stage the two tokens at
        the boundary form a rule that comes before the merges undone so far, it would have won.
        """
        a, b, limit, apart = left, right, len(self.tokens), True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                apart = False
                break
            # Undo the later merge. On equal ranks the left one came first, so the right is undone.
            if a > b:
                if a < 256:
                    break
                limit, a = a, self.parts[a][1]
            else:
                if b < 256:
                    break
                limit, b = b + 1, self.parts[b][0]
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[(left, right)] = apart
        return apart

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merge ranks of one pre-token."""
        end = len(piece)
        longest = [0] * end
        size, pairs = self.size, self.pairs
        for last, number in self.automaton.iter(piece.decode("latin-1")):
            longest[last + 1 - size[number]] = number
        alive = bytearray(b"\1") * (end + 1)
        chosen: list[int] = []
        at = 0
        token = longest[0] if end else -1
        while at < end:
            stop = at + size[token]
            if alive[stop] and (
                not chosen
                or (pairs[pair] if (pair := (chosen[-1], token)) in pairs else self.compatible(*pair))
            ):
                chosen.append(token)
                at = stop
                if at < end:
                    token = longest[at]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: the place is dead, shorten the token before
                alive[at] = 0
                back = chosen.pop()
                at -= size[back]
                token = self.shorter[back]
        return chosen

    def encode_word(self, word: str) -> list[int]:
        found = [self.ids[n] for n in self.encode_piece(word.encode("utf-8", "surrogatepass"))]
        if len(self.words) >= REMEMBERED // 2:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = found
        return found

    def encode_span(self, span: str) -> bytes:
        """Ids (int32) of a stretch without special tokens."""
        late = not span.isascii() and self.late.search(span)
        ids = array("i")
        for word in self.cut[1 if late else 0](span):
            ids.extend(self.words.get(word) or self.encode_word(word))
        return ids.tobytes()

    def encode_plain(self, text: str) -> bytes:
        """The same by single spaces: a space always begins a new pre-token, so the ids of the
        stretches between can be remembered, unless it stands beside other white space."""
        first, *rest = text.split(" ")
        if first[-1:].isspace():
            return self.encode_span(text)
        try:
            return self.encode_span(first) + b"".join(map(self.chunks.__getitem__, rest))
        except Irregular:
            return self.encode_span(text)

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.special):
            parts = self.breaks.split(text)
            coded = b"".join(
                np.int32(self.special[x]).tobytes() if x in self.special else self.encode_plain(x) for x in parts
            )
        else:
            coded = self.encode_plain(text)
        return np.frombuffer(coded, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.table.decode(ids)


class Offsets:
    """The bytes of all tokens by id, one behind the other."""

    def __init__(self, file: str):
        model = json.loads(file)
        letters = byte_letters()
        by_id = {i: bytes(letters[c] for c in token) for token, i in model["model"]["vocab"].items() if set(token) <= letters.keys()}
        by_id |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        every = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(every), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in every])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.blob[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(file: str) -> Vocabulary:
    """Built once per task that encodes."""
    return Vocabulary(file)


@lru_cache(maxsize=2)
def offset_table(file: str) -> Offsets:
    """Built once per Python worker."""
    return Offsets(file)


remembered(vocabulary.cache_clear, __name__)
remembered(offset_table.cache_clear, __name__)


def encode(docs: DataFrame, text: str = "text", tokenizer: str | None = None, ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each whole text."""
    file = Path(tokenizer or default_tokenizer()).read_text("utf-8")

    def make(columns: list[pa.Array]) -> list:
        tokens = vocabulary(file)
        found = [tokens.encode(t.as_py() or "") for t in columns[0]]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        values = np.concatenate(found) if found else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]

    def forget() -> None:
        # The worker may decode next, or wait, beside one that encodes: only that one needs the memory.
        vocabulary.cache_clear()

    return with_rows(docs, {ids: T.ArrayType(T.IntegerType())}, make, text, done=forget)


def decode(frame: DataFrame, ids: str = "token_ids", tokenizer: str | None = None, text: str = "decoded") -> DataFrame:
    """``frame`` with the text that each row's token ids stand for."""
    file = Path(tokenizer or default_tokenizer()).read_text("utf-8")

    def make(columns: list[pa.Array]) -> list:
        tokens = offset_table(file)
        return [[tokens.decode(row.values.to_numpy()) if row.is_valid else "" for row in columns[0]]]

    return with_rows(frame, {text: T.StringType()}, make, ids)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs).select("doc_id", "token_ids")
    return decode(coded).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        hex_sha(F.array_join(F.col("token_ids").cast("array<string>"), ",")).alias("ids_sha256"),
        hex_sha(F.col("decoded")).alias("decoded_sha256"),
    )
