"""Byte-pair tokens of whole texts, for tokenizers whose pieces never reach across white space.

Both functions remember what they found for white-space-separated chunks and for the pieces in
them, up to a bound, for the life of the worker process: natural text repeats most of its words.
"""

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

# Lower-case letters, numbers and white space of Latin-1, as the tokenizers' classes have them.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
LATIN_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
# Characters that str.split takes for white space and the tokenizers do not.
SPLIT_ONLY = re.compile("[\x1c-\x1f]")
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64
# Texts of so many characters are learned from together, new pieces so many a call.
LEARNED_CHARS, LEARNED_PIECES = 4_000_000, 1_000


class Memory(dict):
    """A dictionary that fills itself by ``make``. When full it starts anew and asks its former
    content first, so what is in use stays and the size is bounded by twice ``shares * REMEMBERED``."""

    def __init__(self, make, shares: int = 1):
        super().__init__()
        self.make, self.shares, self.former = make, shares, {}

    def __missing__(self, key):
        value = self.former.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_REMEMBERED:
            self.keep(key, value)
        return value

    def keep(self, key, value):
        if len(self) >= self.shares * REMEMBERED:
            self.former = dict(self)
            self.clear()
        self[key] = value

    def new(self, keys) -> list:
        """Those of ``keys`` that are short enough to be remembered and are not yet."""
        former = self.former
        return [k for k in keys if k not in self and k not in former and len(k) <= LONGEST_REMEMBERED]


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(text: str) -> bool:
    """Whether ``text`` is Latin-1 without special tokens or odd white space: then lower case and
    pieces are those of ``LATIN_PIECES``, chunk by chunk."""
    if "<|" in text or SPLIT_ONLY.search(text):
        return False
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return True


def encoder(path: str):
    """Text -> its ids as little-endian unsigned 32-bit numbers, as the library at ``path`` gives
    them without added special tokens."""
    return _encoders(path)[0]


def group_encoder(path: str):
    """Texts -> the ids of each, as ``encoder`` gives them. New pieces of many texts go to the library
    together, since a call costs as much as a piece."""
    return _encoders(path)[1]


@lru_cache(maxsize=4)
def _encoders(path: str):
    import numpy as np

    tokenizer = load(path)

    def library(text):
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def joined(chunk):
        found = LATIN_PIECES.findall(chunk)
        return library(chunk) if len(found) == 1 else b"".join(map(latin.__getitem__, found))

    # Chunks and their pieces in one: most chunks are one piece, and room for them is scarce.
    latin = Memory(joined, shares=2)
    other = Memory(library)

    def encode(text: str) -> bytes:
        if plain(text):
            return b"".join(map(latin.__getitem__, text.lower().split()))
        if SPLIT_ONLY.search(text):
            return library(text)
        return b"".join(map(other.__getitem__, text.split()))

    def learn(chunks):
        chunks = latin.new(set().union(*chunks))
        unknown = latin.new(set(LATIN_PIECES.findall(" ".join(chunks))))
        for first in range(0, len(unknown), LEARNED_PIECES):
            part = unknown[first:first + LEARNED_PIECES]
            found = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            data = np.array(found.ids, "<u4").tobytes()
            ends = 4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(part)), "right")
            start = 0
            for key, end in zip(part, ends.tolist()):
                latin.keep(key, data[start:end])
                start = end
        for chunk in chunks:
            latin[chunk]

    def encoded(texts):
        chunks = [text.lower().split() if plain(text) else None for text in texts]
        learn([some for some in chunks if some])
        for text, some in zip(texts, chunks):
            yield encode(text) if some is None else b"".join(map(latin.__getitem__, some))

    def encode_all(texts: list[str]) -> Iterator[bytes]:
        first = chars = 0
        for at, text in enumerate(texts):
            chars += len(text)
            if chars >= LEARNED_CHARS:
                yield from encoded(texts[first:at + 1])
                first, chars = at + 1, 0
        yield from encoded(texts[first:])

    return encode, encode_all


class Merges:
    """Counts the byte-pair tokens of a piece: initial symbols less merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [t["content"] for t in model["added_tokens"]]
        model = model["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        # (left, right) -> (rank, merged)
        self.ranks = {}
        for rank, (a, b) in enumerate(
            m.split(" ") if isinstance(m, str) else m for m in model["merges"]
        ):
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.vocab = vocab

    def count(self, piece: str) -> int:
        """Tokens of ``piece``, given in the tokenizer's byte alphabet. The lowest-ranked adjacent
        pair merges first, the leftmost of equals; entries of merged neighbours are skipped."""
        symbols = [self.vocab[c] for c in piece[:-1]] + [self.vocab[piece[-1] + self.suffix]]
        n = len(symbols)
        if n == 1:
            return 1
        ranks = self.ranks
        following = list(range(1, n + 1))
        previous = list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            found = ranks.get((symbols[at], symbols[at + 1]))
            if found:
                heap.append((found[0], at, symbols[at], symbols[at + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, at, left, right, merged = heapq.heappop(heap)
            after = following[at]
            if symbols[at] != left or after >= n or symbols[after] != right:
                continue  # one of the two has been merged meanwhile
            symbols[at], symbols[after] = merged, -1
            merges += 1
            beyond = following[after]
            following[at] = beyond
            if beyond < n:
                previous[beyond] = at
                found = ranks.get((merged, symbols[beyond]))
                if found:
                    heapq.heappush(heap, (found[0], at, merged, symbols[beyond], found[1]))
            before = previous[at]
            if before >= 0:
                found = ranks.get((symbols[before], merged))
                if found:
                    heapq.heappush(heap, (found[0], before, symbols[before], merged, found[1]))
        return n - merges


@lru_cache(maxsize=4)
def counter(path: str):
    """Text -> its number of tokens, as the library at ``path`` counts them without added special
    tokens. The library only normalises and splits; the merging is done here."""
    tokenizer, merges = load(path), Merges(path)
    special = re.compile("|".join(map(re.escape, merges.special)) or r"(?!)")
    latin_alphabet = {
        chr(c): piece
        for c in range(256)
        for piece in ["".join(p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(c)))]
    }

    def latin_count(piece):
        return merges.count("".join(map(latin_alphabet.__getitem__, piece)))

    pieces = Memory(latin_count)
    piece = pieces.__getitem__
    latin = Memory(lambda chunk: sum(map(piece, LATIN_PIECES.findall(chunk))))

    def slow(text):
        parts = special.split(text)
        return len(parts) - 1 + sum(
            merges.count(piece)
            for part in parts
            for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(
                tokenizer.normalizer.normalize_str(part)
            )
        )

    other = Memory(slow)

    def count(text: str) -> int:
        if plain(text):
            return sum(map(latin.__getitem__, text.lower().split()))
        if SPLIT_ONLY.search(text):
            return slow(text)
        return sum(map(other.__getitem__, text.split()))

    return count
