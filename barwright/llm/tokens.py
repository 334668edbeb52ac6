"""Token ids of whole texts: each piece of the byte-level pattern is encoded once a task and looked up from then on."""

from __future__ import annotations

import functools
from collections.abc import Callable
from itertools import chain

import numpy as np

from barwright.llm import textcodes
from barwright.llm.common import expand

#: Pieces that are kept where encoding one takes little.
KEPT_PIECES = 200_000
#: Longer pieces aren't kept.
KEPT_CHARS = 200


class PieceCache:
    """Ids by piece. encode: from pieces to lists of ids. Pieces are found by hash and compared by content. After `most` pieces it starts anew, which bounds its memory and changes no result."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = 1_500_000, hash_of=textcodes.span_hash) -> None:
        self.encode, self.most, self.hash = encode, most, hash_of
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # ascending
        self.numbers = np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)
        self.n = 0
        self.codes = np.zeros(1 << 16, dtype=np.int32)  # code points of the pieces that hashes lead to
        self.coded = 0
        self.code_starts = np.zeros(0, dtype=np.int64)  # beside hashes, as code_ends
        self.code_ends = np.zeros(0, dtype=np.int64)

    def _keep(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> None:
        """Lets hashes lead to numbers from now on; at: where they stand among those that do."""
        n = ends - starts
        while self.coded + int(n.sum()) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        upto = self.coded + np.cumsum(n)
        self.codes[self.coded : self.coded + int(n.sum())] = code[expand(starts, n)]
        self.coded += int(n.sum())
        self.hashes, self.numbers = np.insert(self.hashes, at, hashes), np.insert(self.numbers, at, numbers)
        self.code_starts, self.code_ends = np.insert(self.code_starts, at, upto - n), np.insert(self.code_ends, at, upto)

    def _add(self, found: list) -> np.ndarray:
        """Stores lists of ids; their numbers."""
        flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(found) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[self.n : self.n + len(found)] = self.used + np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.lengths[self.n : self.n + len(found)] = lengths
        out = np.arange(self.n, self.n + len(found))
        self.used += len(flat)
        self.n += len(found)
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and where each text's start in them, and one more."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.n > self.most:
            self.clear()
        code, starts, ends, first = textcodes.pieces(texts)
        hashes, one, back = np.unique(self.hash(code, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        met = np.flatnonzero(known)
        # a hash only leads to a piece: what is taken for it has its content
        other = met[textcodes.unlike(code, starts[one[met]], ends[one[met]], self.codes, self.code_starts[at[met]], self.code_ends[at[met]])]
        place = np.full(len(hashes), -1, dtype=np.int64)
        place[known] = self.numbers[at[known]]
        place[other] = -1
        whole = None
        missing = np.flatnonzero(place < 0)
        if len(missing):
            whole = "\x00".join(texts)
            a, b = starts[one[missing]], ends[one[missing]]
            place[missing] = got = self._add(self.encode([whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
            kept = (b - a <= KEPT_CHARS) & ~known[missing]
            self._keep(code, a[kept], b[kept], hashes[missing[kept]], got[kept], at[missing[kept]])
        place = place[back]
        odd = textcodes.unlike(code, starts, ends, code, starts[one[back]], ends[one[back]])
        if len(odd):
            whole = whole or "\x00".join(texts)
            place[odd] = self._add(self.encode([whole[x:y] for x, y in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]))
        lengths = self.lengths[place]
        ids = self.ids[expand(self.starts[place], lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[first]


class LibraryIds:
    """What the tokenizers library's encode gives for whole texts, without special tokens added. Strings of the file's added tokens within a text are those tokens, as there; texts that hold one go through the library as a whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        model, table = self.whole.model, byte_letters()

        def encode(pieces: list[str]) -> list:
            letters = (x.encode("utf-8", "replace").decode("latin-1").translate(table) for x in pieces)
            return [[token.id for token in model.tokenize(x)] for x in letters]

        self.cache = PieceCache(encode, KEPT_PIECES)

    def largest(self) -> int:
        return max(self.whole.get_vocab(with_added_tokens=True).values(), default=0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = {i: self.whole.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(x in t for x in self.added)}
        if not own:
            return self.cache(texts)
        ids, at = self.cache(["" if i in own else t for i, t in enumerate(texts)])
        parts = [np.array(own[i], dtype=np.uint32) if i in own else ids[at[i] : at[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


@functools.lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 for itself, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}
