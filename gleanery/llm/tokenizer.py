"""Problem 8: ids of a whole corpus under a public byte-level BPE vocabulary.

A BPE encoding is the only segmentation whose neighbouring tokens are all *compatible*: two tokens
are compatible when merging the bytes of both from scratch gives back just these two. So the encoder
needs no merge loop over a text. It takes at each place the longest token that matches (found by an
Aho-Corasick automaton over the vocabulary), keeps it if it is compatible with the token before, and
otherwise steps to the next shorter token that is a prefix of it or, when none fits, takes back
the previous token. A bit per position marks places known to lead nowhere, hence linear time.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from gleanery.llm.arrow import map_rows

#: Pieces seen again are looked up; the table is emptied at this size, which bounds a worker's memory only.
CACHE = 400_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file, or the vocabulary of a byte-level ``.json`` file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    return {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


class BacktrackingEncoder:
    """Exact BPE ids of byte strings; ``pattern`` splits a text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.tokens = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.ids = ranks
        auto = ahocorasick.Automaton()
        for t, i in ranks.items():
            auto.add_word(t.decode("latin-1"), i)
        auto.make_automaton()
        self.auto = auto
        self._split()
        self._prefixes()
        self.known: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        size = max(ranks.values()) + 1
        lengths = np.zeros(size + 1, np.int64)
        for t, i in ranks.items():
            lengths[i + 1] = len(t)
        self.offsets = np.cumsum(lengths)
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def _split(self) -> None:
        """The two tokens each token is merged from: the pair whose merge has its rank and whose halves are compatible."""
        self.pair: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        ids = self.ids
        for t, i in sorted(ids.items(), key=lambda x: x[1]):
            if len(t) < 2:
                self.pair[i] = (i, i)
                continue
            parts = self._lowest_first(t, i)
            if len(parts) == 2:
                self.pair[i] = (parts[0], parts[1])
                self.merges[parts[0], parts[1]] = i
            else:  # never the result of merges, so it can't come out of an encoding
                self.pair[i] = (i, i)

    def _lowest_first(self, t: bytes, below: int) -> list[int]:
        """Merge the bytes of t by rank with ranks under ``below``; only for building the table."""
        ids, parts = self.ids, [bytes([b]) for b in t]
        while len(parts) > 2:
            at, rank = -1, below
            for k in range(len(parts) - 1):
                r = ids.get(parts[k] + parts[k + 1], below)
                if r < rank:
                    at, rank = k, r
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids[p] for p in parts]

    def _prefixes(self) -> None:
        """For each token the longest other token that is a prefix of it, or -1."""
        ids = self.ids
        self.shorter: dict[int, int] = {}
        for t, i in ids.items():
            self.shorter[i] = next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), -1)

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text of just these two tokens' bytes is encoded as these two."""
        seen = self.known.get((a, b))
        if seen is None:
            if len(self.known) > CACHE:
                self.known.clear()
            seen = self.known[a, b] = self._compatible(a, b)
        return seen

    def _compatible(self, a: int, b: int) -> bool:
        """Undo merges from the boundary outwards, latest first; a merge across it of a lower rank would have come before."""
        pair, limit = self.pair, 1 << 60
        while True:
            if self.merges.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, right = a, pair[a][1]
                if right == a:  # a single byte
                    limit = b + 1
                    left = pair[b][0]
                    if left == b:
                        return True
                    b = left
                else:
                    a = right
            else:
                limit, left = b + 1, pair[b][0]
                if left == b:
                    limit = a
                    right = pair[a][1]
                    if right == a:
                        return True
                    a = right
                else:
                    b = left

    def encode_bytes(self, data: bytes) -> list[int]:
        if (whole := self.ids.get(data)) is not None and (len(data) == 1 or self.pair[whole][0] != whole):
            return [whole]
        text, n = data.decode("latin-1"), len(data)
        longest = [-1] * n
        size = [0] * n
        tokens, shorter = self.tokens, self.shorter
        for end, i in self.auto.iter(text):
            start = end + 1 - len(tokens[i])
            if end + 1 - start > size[start]:
                size[start], longest[start] = end + 1 - start, i
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        pos, nxt = 0, longest[0]
        while pos < n:
            end = pos + len(tokens[nxt])
            if open_at[end] and (not out or self.compatible(out[-1], nxt)):
                out.append(nxt)
                pos = end
                if pos < n:
                    nxt = longest[pos]
                continue
            nxt = shorter[nxt]
            while nxt < 0:
                open_at[pos] = 0
                last = out.pop()
                pos -= len(tokens[last])
                nxt = shorter[last]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self.cache, []
        for piece in self.pieces(text):
            ids = cache.get(piece)
            if ids is None:
                if len(cache) > CACHE:
                    cache.clear()
                ids = cache[piece] = tuple(self.encode_bytes(piece.encode("utf-8", "surrogatepass")))
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of a list of ids, gathered from one array by the offsets of the tokens."""
        i = np.fromiter(ids, np.int64)
        if not len(i):
            return b""
        lengths = self.offsets[i + 1] - self.offsets[i]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.offsets[i] - ends + lengths, lengths)
        return self.bytes[at].tobytes()


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> BacktrackingEncoder:
    """One encoder for each Python worker, whose tasks share its tables and cache."""
    return BacktrackingEncoder(load_ranks(path), pattern)


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids array<int>): each row's ids; null and empty texts have an empty list. No special tokens:
    their strings are ordinary text. path and pattern default to byte_bpe_50k."""
    import public_tokenizers

    path, pattern = path or public_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def make():
        encode = encoder(path, pattern).encode

        def batch(keys, texts):
            return keys, [encode(t) for t in texts]

        return batch

    return map_rows(df, [key, text], make, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")
