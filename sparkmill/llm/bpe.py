"""Byte-level BPE as a streaming transducer with bounded lookahead (problem 8).

For every prefix of the input the last token of the prefix's encoding is
unique: the token t that ends there and whose predecessor, the last token of the prefix before t,
merges with t nowhere (the pair encodes to itself). The encoding of the whole is the chain of last tokens read
from the end. A chain moves by at most the longest token's bytes at a step, so whatever follows, it passes
one of the last LOOKAHEAD prefix ends. Tokens before the point where the chains of all these
ends have met are final: they are emitted at once and forgotten. Only the window since that point is kept.

Decoding is the reverse: bytes of tokens pass an incremental UTF-8 machine
that holds back at most three bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex

#: Words up to this many bytes are kept with their tokens, so many of them.
CACHED_BYTES, CACHED_WORDS = 24, 200_000
#: Fixed value: the public vocabulary's split into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks of byte strings; the rank of a merged token is the order of its merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.lookahead = self.sufficient_lookahead()
        self.split = regex.compile(pattern)
        self._pair: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A file of lines "base64 rank"."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def sufficient_lookahead(self) -> int:
        """Bytes after which a boundary can no longer change once all chains agree: the longest token of the merge list."""
        return max(map(len, self.ranks), default=1)

    def merge(self, word: bytes) -> list[int]:
        """The merge list applied to a short byte string, lowest rank first, leftmost on ties."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            # all leftmost, non-overlapping occurrences of this pair
            i, pair, out = 0, (parts[best[1]], parts[best[1] + 1]), []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: the pair encodes to itself."""
        ok = self._pair.get((a, b))
        if ok is None:
            if len(self._pair) > 500_000:
                self._pair.clear()
            ok = self._pair[(a, b)] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def transduce(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one word's bytes, each as soon as it is final."""
        look = self.lookahead
        base = 0  # the absolute position of the window's first prefix end; everything before is emitted
        buf = bytearray()
        last: list[int] = [-1]  # last[i]: the last token of the prefix that ends at base + i
        ranks, bytes_of = self.ranks, self.bytes_of
        since = 0
        for byte in data:
            buf.append(byte)
            n = len(buf)
            for m in range(min(look, n), 0, -1):
                t = ranks.get(bytes(buf[n - m :]))
                if t is not None and (n == m and base == 0 or last[n - m] == -1 or self.compatible(last[n - m], t)):
                    last.append(t)
                    break
            since += 1
            if since >= 2 * look and n > 2 * look:
                since = 0
                # the end on which the chains of the last LOOKAHEAD ends meet
                ends = set(range(n - look + 1, n + 1))
                while len(ends) > 1:
                    e = max(ends)
                    ends.discard(e)
                    ends.add(e - len(bytes_of[last[e]]) if e > 0 else 0)
                    if 0 in ends and len(ends) > 1 and max(ends) == 0:
                        break
                meet = ends.pop()
                if meet > 0:
                    out, e = [], meet
                    while e > 0:
                        out.append(last[e])
                        e -= len(bytes_of[last[e]])
                    yield from reversed(out)
                    del buf[:meet]
                    last = last[meet:]
                    # what precedes is fixed; its last token still decides what may follow
                    base += meet
        out, e = [], len(buf)
        while e > 0:
            out.append(last[e])
            e -= len(bytes_of[last[e]])
        yield from reversed(out)

    def word(self, w: str) -> tuple[int, ...]:
        ids = self._words.get(w)
        if ids is not None:
            return ids
        b = w.encode("utf-8", "surrogatepass")
        t = self.ranks.get(b)
        ids = (t,) if t is not None else tuple(self.transduce(b))
        if len(b) <= CACHED_BYTES:
            if len(self._words) >= CACHED_WORDS:
                self._words.clear()
            self._words[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; strings of special tokens are ordinary text. Null and empty texts have none."""
        out: list[int] = []
        if text:
            word = self.word
            for m in self.split.finditer(text):
                out += word(m[0])
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of a stream of ids, piece by piece; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if s := machine.decode(self.bytes_of[i]):
                yield s
        if s := machine.decode(b"", final=True):
            yield s


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def public_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies on this machine; PUBLIC_TOKENIZERS names another folder."""
    folder = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
    if os.path.exists(os.path.join(folder, name)):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
