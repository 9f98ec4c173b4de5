"""Byte-level byte-pair encoding with a heap of merges over a linked list of symbols.

The vocabulary and merge ranks come from a public ``tokenizers`` JSON file; its
bytes are broadcast (a file of fixed size), so executors need no copy of it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from itertools import chain, pairwise

import regex

from vigilspark.llm.common import held

#: The split pattern of byte-level BPE (fixed value, must match the library).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The low bits of a heap entry hold a position, the bits above them a rank.
POSITION = (1 << 40) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 upward in byte order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """word -> result with a bounded number of words, in two generations.

    When the young generation is full it becomes the old one; words of the old
    generation that come up again are taken over, so frequent words stay.
    """

    LIMIT = 300_000
    LONGEST = 64

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


class ByteBPE:
    """Encode, count and decode as the library does without truncation or padding."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer is needed")
        vocab: dict[str, int] = model["vocab"]
        signs = byte_symbols()
        of_sign = {s: b for b, s in enumerate(signs)}
        self.byte_id = [vocab[s] for s in signs]
        self.prefix_space = bool(before.get("add_prefix_space"))
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[left], vocab[right]), (rank << 40, vocab[left + right]))
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max(chain(vocab.values(), added.values())) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(of_sign[c] for c in token)
        for token, i in added.items():
            self.pieces[i] = token.encode()
        self.added = added
        self.special = (
            regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
            if added
            else None
        )
        self.split = regex.compile(SPLIT).findall
        self.ids_of = Memo(self._encode_word)
        self.n_of = Memo(self._count_word)

    # -- one word ---------------------------------------------------------
    def _merge(self, symbols: list[int]) -> tuple[list[int], int]:
        """Merge in place; (symbols with -1 for those merged away, merges done).

        A heap entry is one number: the rank of a pair above the position of its
        left symbol.  An entry is stale when the pair at the position has another
        rank by now, and is skipped.
        """
        n, rank_of, push, pop = len(symbols), self.ranks.get, heapq.heappush, heapq.heappop
        heap = [found[0] | i for i, found in enumerate(map(rank_of, pairwise(symbols))) if found]
        if not heap:
            return symbols, 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = pop(heap)
            i = entry & POSITION
            left, j = symbols[i], after[i]
            if left < 0 or j >= n:
                continue
            found = rank_of((left, symbols[j]))
            if found is None or found[0] | i != entry:
                continue
            merges += 1
            merged = symbols[i] = found[1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank_of((merged, symbols[k]))
                if found:
                    push(heap, found[0] | i)
            h = before[i]
            if h >= 0:
                found = rank_of((symbols[h], merged))
                if found:
                    push(heap, found[0] | h)
        return symbols, merges

    def _encode_word(self, word: str) -> bytes:
        """The word's ids as 32-bit numbers."""
        byte_id = self.byte_id
        symbols, _ = self._merge([byte_id[b] for b in word.encode()])
        return array("i", [s for s in symbols if s >= 0]).tobytes()

    def _count_word(self, word: str) -> int:
        byte_id = self.byte_id
        symbols = [byte_id[b] for b in word.encode()]
        return len(symbols) - self._merge(symbols)[1]

    # -- one text ---------------------------------------------------------
    def _parts(self, text: str):
        """(text between added tokens, id of the added token that follows or None)."""
        pieces = self.special.split(text) if self.special else [text]
        for k in range(0, len(pieces), 2):
            yield pieces[k], self.added[pieces[k + 1]] if k + 1 < len(pieces) else None

    def _words(self, part: str) -> list[str]:
        if self.prefix_space and part and not part[0].isspace():
            part = " " + part
        return self.split(part)

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers in the machine's byte order."""
        packed: list[bytes] = []
        for part, special in self._parts(text):
            packed.extend(map(self.ids_of.__getitem__, self._words(part)))
            if special is not None:
                packed.append(array("i", [special]).tobytes())
        return b"".join(packed)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()

    def count(self, text: str) -> int:
        """Tokens of a text: symbols minus merges of each word, added tokens once each."""
        total = 0
        for part, special in self._parts(text):
            total += sum(map(self.n_of.__getitem__, self._words(part))) + (special is not None)
        return total

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings end to end; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def loaded(data: bytes) -> ByteBPE:
    """One tokenizer for each worker process and file."""
    return held(("bpe", hashlib.sha256(data).digest()), lambda: ByteBPE(data))
