"""Texts as arrays of code points: words, shingles and tokenizer pieces found for a whole batch at once."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

from barwright.llm.common import expand

#: Stands after each text of a batch.
END = 0x110000
LETTER, NUMBER, SPACE, OTHER, STOP = 0, 1, 2, 3, 4
#: Code points with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point, by Unicode properties."""
    import regex

    out = np.full(END + 1, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, END)]))
    for kind, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(prop, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            out[a:b] = kind
    out[WHITE] = SPACE
    out[END] = STOP
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, END after each; where each text starts, and one more."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = "\x00".join(texts) + "\x00" if texts else ""
    out = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
    out[at[1:] - 1] = END
    return out, at


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(33)
    return x


#: Values of a span that are hashed in step with other spans; a longer span is hashed by itself.
LONG = 256


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that doesn't depend on where the span stands. Each value is mixed into what those before it gave by steps that no sum undoes; spans of more than LONG values are hashed by BLAKE2."""
    n = ends - starts
    order = np.argsort(np.minimum(n, LONG + 1).astype(np.uint16), kind="stable")
    size, at = n[order], starts[order]
    data = values.astype(np.uint64)
    h = mixed(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
    last = int(np.searchsorted(size, LONG, side="right"))
    for k in range(int(size[last - 1]) if last else 0):
        first = int(np.searchsorted(size[:last], k, side="right"))
        some = h[first:last]
        some ^= data[at[first:last] + k]
        some *= np.uint64(0xFF51AFD7ED558CCD)
        some ^= some >> np.uint64(32)
    for i in range(last, len(h)):
        h[i] = int.from_bytes(hashlib.blake2b(data[at[i] : at[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    out = np.empty_like(h)
    out[order] = mixed(h)
    return out


def unlike(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Numbers of the spans of values that differ from the spans of others beside them."""
    n = ends - starts
    same = n == other_ends - other_starts
    i = np.flatnonzero(same)
    off = values[expand(starts[i], n[i])] != others[expand(other_starts[i], n[i])]
    if not off.any():
        return np.flatnonzero(~same)
    same[i[np.unique(np.repeat(np.arange(len(i)), n[i])[off])]] = False
    return np.flatnonzero(~same)


#: Bytes of a hash that move where sets of shingles are compared: two different shingles of n * n pairs agree with a chance of n * n / 2 ** 48.
MOVED = 6


def to_move(hashes: np.ndarray) -> np.ndarray:
    """The low MOVED bytes of each hash, a row each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :MOVED])


def moved(raw) -> np.ndarray:
    """Hashes of what to_move has made of them, as bytes."""
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(-1, MOVED)
    out = np.zeros((len(rows), 8), dtype=np.uint8)
    out[:, :MOVED] = rows
    return out.view("<u8")[:, 0]


def words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space separated words: hash, text number, start and end (code points within the text)."""
    low = texts
    if lower:
        low = [t.lower() for t in texts]
        if any(len(a) != len(b) for a, b in zip(low, texts, strict=True)):  # a few letters change their length: those stay as they are
            low = [a if len(a) == len(b) else "".join(c.lower() if len(c.lower()) == 1 else c for c in b) for a, b in zip(low, texts, strict=True)]
    code, at = codes(low)
    gap = (classes()[code] == SPACE) | (code == END)
    edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    which = np.searchsorted(at, starts, side="right") - 1
    return span_hash(code, starts, ends), which, starts - at[which], ends - at[which]


def shingles(word_hash: np.ndarray, which: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words, text by text; where each text's start in them, and each one's first word. A text of fewer words, but one at least, is one shingle of all of them."""
    count = np.bincount(which, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    starts = expand(first, n)
    ends = np.minimum(starts + size, np.repeat(first + count, n))
    return span_hash(word_hash, starts, ends), np.concatenate([[0], np.cumsum(n)]), starts


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of the byte-level pattern start and end in codes(texts), and each text's first piece, and one more.

    The pattern: a contraction after an apostrophe, or runs of letters, of numbers or of other signs, each with one space before it, or white space, of which the last stays behind if something follows."""
    code, at = codes(texts)
    kind = classes()[code]
    n = len(code)
    before = np.empty(n, dtype=np.uint8)
    before[1:] = kind[:-1]
    if n:
        before[0] = STOP
    start = kind != before
    start |= before == STOP
    after = np.full(n, STOP, dtype=np.uint8)
    after[:-1] = kind[1:]
    space = kind == SPACE
    follows = space & (after != SPACE) & (after != STOP)  # the last of its white space, something follows
    start |= follows
    joins = np.zeros(n, dtype=bool)
    joins[1:] = (follows & (code == 0x20))[:-1]
    start &= ~joins
    for p in np.flatnonzero((code == 0x27) & start & (after == LETTER)).tolist():
        two = chr(code[p + 1])
        size = 2 if two in "stmd" else 3 if two + (chr(code[p + 2]) if code[p + 2] < END else "") in ("re", "ve", "ll") else 0
        start[p + 1] = start[p + 1] and not size
        if size:
            start[p + 2] = start[p + 2] and size != 3
            if kind[p + size] == LETTER:
                start[p + size] = True
    start &= kind != STOP
    starts = np.flatnonzero(start)
    stops = np.flatnonzero(start | (kind == STOP))
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    return code, starts, ends, np.searchsorted(starts, at)
