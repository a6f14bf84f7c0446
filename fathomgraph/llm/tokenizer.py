"""Token ids of whole corpora by a byte-level BPE vocabulary, in linear time.

Bytes are read as Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds the longest token
at any place. A text's encoding is the one sequence of tokens in which every two neighbours are compatible,
that is, encode to just themselves when merged alone (memoised). Longest matches are tried first; a token
without a compatible way on is shortened along the automaton, or taken back, and no place is entered twice.
Pieces that recur (words) are remembered in a table of bounded size.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits text into pieces, within which merges happen.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO_PIECES, MEMO_PIECE_CHARS = 200_000, 64
ROWS_A_BATCH = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token to its id; ids ascend in the order of the merges. Reads rank files and tokenizer JSON."""
    if path.endswith(".json"):
        letters = {c: b for b, c in _printable().items()}
        vocab = json.loads(Path(path).read_text())["model"]["vocab"]
        return {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


def _printable() -> dict[int, str]:
    """How tokenizer JSON writes bytes: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes text exactly as the merges in order of rank would."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        self.ranks = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.find_pieces = regex.compile(pattern).findall
        self.longest = ahocorasick.Automaton()
        for t in self.ranks:
            self.longest.add_word(t, len(t))
        self.longest.make_automaton()
        self.memo: dict[str, tuple[int, ...]] = {}
        self.compatible = lru_cache(1 << 18)(self._compatible)
        self.shorter = lru_cache(1 << 16)(self._shorter)

    def _merged(self, s: str) -> list[str]:
        """The definition: the adjacent pair of least rank merges first. Only for two tokens' length."""
        parts = list(s)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        return self._merged(left + right) == [left, right]

    def _shorter(self, token: str) -> str:
        """The next shorter token that begins token, or ''."""
        return next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), "")

    def _first(self, s: str, at: int) -> str:
        end, length = next(self.longest.iter_long(s, at, len(s)))
        return s[end + 1 - length : end + 1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        s = piece.encode("utf-8", "replace").decode("latin-1")
        if (whole := self.ranks.get(s)) is not None:
            return (whole,)
        taken: list[str] = []
        dead = bytearray(len(s) + 1)  # places from which no compatible way on was found
        at, token = 0, self._first(s, 0)
        while True:
            before = taken[-1] if taken else None
            while token and (dead[at + len(token)] or (before is not None and not self.compatible(before, token))):
                token = self.shorter(token)
            if token:
                taken.append(token)
                at += len(token)
                if at == len(s):
                    return tuple(self.ranks[t] for t in taken)
                token = self._first(s, at)
            else:
                dead[at] = 1
                token = taken.pop()
                at -= len(token)

    def encode_into(self, text: str, out: array) -> None:
        memo = self.memo
        for piece in self.find_pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= MEMO_PIECE_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(read_ranks(path))


def token_ids(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids): one row per row of documents, ids by the vocabulary without special tokens.

    vocabulary is a path that every executor can read. Null and empty texts give an empty list; text that looks
    like a special token is ordinary text; lone surrogates count as '?'. Whole texts are encoded, whatever
    their length. Other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(start, ROWS_A_BATCH)
                flat, ends = array("i"), array("i", [0])
                for text in batch.column("text"):
                    if value := text.as_py():
                        enc.encode_into(value, flat)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")
