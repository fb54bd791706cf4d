"""Splitting many texts into pre-tokens at once, and turning pre-tokens into ids through a table.

The split is that of the public byte-level vocabularies' pattern: contractions, runs of letters,
of numbers or of other signs with one blank before them, and white space, whose last character is
left to what follows. It is found from character classes in numpy instead of by a regex engine; the
classes themselves are asked from the library, whose Unicode version is not the interpreter's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

from corpusmill.llm.words import chunks, eight, mix, padded

#: Characters split in one go; words a worker remembers; bytes of a word that is remembered; places tried for a word in the table.
CHUNK, REMEMBERED, KEY, TRIES = 1 << 18, 800_000, 15, 48
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
# The endings that the pattern splits off after an apostrophe.
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@cache
def classes() -> np.ndarray:
    """The class of every code point, as the library tells: with a class for a pattern, it gives back the characters of that class alone."""
    import tiktoken

    table = np.full(0x110000, _OTHER, np.uint8)
    known = np.delete(np.arange(0x110000, dtype=np.uint32), np.s_[0xD800:0xE000]).tobytes().decode("utf-32-le")
    for number, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        asked = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[code_points(bytes(asked.encode_ordinary(known)).decode())] = number
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in joined texts, of which each non-empty one starts at a place in `first`."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = begins[n] = True
    at = np.concatenate(([True], kind[1:] != kind[:-1])) | begins[:n]
    run = np.flatnonzero(at)
    end = np.append(run[1:], n)
    what, size, inside = kind[run], end - run, ~begins[end]  # inside: the same text goes on
    white = np.flatnonzero((what == _SPACE) & inside)
    blank = points[end[white] - 1] == 0x20
    at[end[white[blank]]] = False
    at[end[white] - 1] = True  # the last of several is a token of its own, or starts the next one
    tied = np.zeros(len(run), bool)
    tied[white[blank] + 1] = True
    mark = np.flatnonzero((what == _OTHER) & (size == 1) & (points[run] == 0x27) & inside & ~tied)
    mark = mark[what[np.minimum(mark + 1, len(run) - 1)] == _LETTER]
    if len(mark):
        word, room = run[mark + 1], size[mark + 1]
        taken = np.zeros(len(mark), np.int64)
        with_end = np.append(points, 0)
        for ending in _ENDINGS:
            fits = room >= len(ending)
            for k, c in enumerate(ending):
                fits &= with_end[np.minimum(word + k, n)] == ord(c)
            taken[fits & (taken == 0)] = len(ending)
        some = taken > 0
        at[word[some]] = False
        rest = some & (taken < room)
        at[word[rest] + taken[rest]] = True
    return np.flatnonzero(at)


def pieces(text: str, limit: int = CHUNK) -> list[str]:
    """A very long text cut at places where any split into pre-tokens has a border."""
    out, lo = [], 0
    while len(text) - lo > limit:
        cut = lo + limit
        while (cut := text.find(" ", cut)) > 0 and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        if cut < 0:
            break
        out.append(text[lo:cut])
        lo = cut
    return [*out, text[lo:]]


def gather(flat: np.ndarray, offset: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows `which` of `flat` one after another, and where each ends."""
    sizes = size[which]
    ends = np.cumsum(sizes)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offset[which] - (ends - sizes), sizes)
    return flat[index], ends


class Known:
    """A number for each of up to `most` words, by the words' own bytes.

    A key is two 64-bit numbers that hold all bytes of a word of KEY bytes at most, and its length,
    so equal keys are equal words. Keys lie in an open-addressing table.
    """

    def __init__(self, most: int):
        size = 1 << (most + most // 4).bit_length()
        self.low, self.high, self.number = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)

    def clear(self) -> None:
        self.high[:] = 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & np.uint64(len(self.low) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out, todo, slot = np.full(len(low), -1, np.int32), np.arange(len(low)), self._slots(low, high)
        for _ in range(TRIES):
            there = self.high[slot]
            hit = (there == high[todo]) & (self.low[slot] == low[todo])
            out[todo[hit]] = self.number[slot[hit]]
            on = ~hit & (there != 0)
            if not on.any():
                break
            todo, slot = todo[on], (slot[on] + 1) & (len(self.low) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Puts in distinct words that are not there; one without a free place within TRIES is left out."""
        todo, slot = np.arange(len(low)), self._slots(low, high)
        for _ in range(TRIES):
            free = np.flatnonzero(self.high[slot] == 0)
            at, mine = slot[free], todo[free]
            self.high[at], self.low[at], self.number[at] = high[mine], low[mine], number[mine]
            on = (self.high[slot] != high[todo]) | (self.low[slot] != low[todo])
            if not on.any():
                break
            todo, slot = todo[on], (slot[on] + 1) & (len(self.low) - 1)


class Encoder:
    """Ids of whole texts, word by word.

    `encode` gives all ids of several words, and how many each has. `special` has strings that stand
    for one id each, wherever they occur. `most` words are remembered; then all are forgotten, so
    memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int] | None = None, most: int = REMEMBERED):
        self.encode, self.special, self.most = encode, special or {}, most
        self.known = Known(most)
        self.forget()

    def forget(self) -> None:
        """Starts with no words."""
        self.known.clear()
        self.ids, self.offset, self.size, self.words, self.filled = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0, 0

    def _learn(self, words: list[str]) -> np.ndarray:
        """Keeps the ids of words and gives their numbers."""
        new, sizes = self.encode(words)
        a, b = self.filled, self.words
        for name, need in (("ids", a + len(new)), ("offset", b + len(words)), ("size", b + len(words))):
            held = getattr(self, name)
            if len(held) < need:
                setattr(self, name, np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)]))
        self.ids[a : a + len(new)] = new
        self.offset[b : b + len(words)], self.size[b : b + len(words)] = a + np.cumsum(sizes) - sizes, sizes
        self.filled, self.words = a + len(new), b + len(words)
        return np.arange(b, b + len(words), dtype=np.int32)

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number for each word, of which equal words share one."""
        text, size = padded(data), end - start
        short = size <= KEY
        low = eight(text, start, np.minimum(size, 8))
        high = eight(text, np.minimum(start + 8, len(data)), np.clip(size - 8, 0, 7)) | (size.astype(np.uint64) << np.uint64(56))
        out = np.full(len(start), -1, np.int32)
        out[short] = self.known.find(low[short], high[short])
        word = lambda i: data[start[i] : end[i]].tobytes()
        new = np.flatnonzero((out < 0) & short)
        if len(new):
            new = new[np.lexsort((low[new], high[new]))]
            first = np.concatenate(([True], (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1])))
            found = self._learn([word(i).decode() for i in new[first].tolist()])
            self.known.add(low[new[first]], high[new[first]], found)
            out[new] = found[np.cumsum(first) - 1]
        long = np.flatnonzero(~short).tolist()
        if long:
            own = [word(i) for i in long]
            kinds = {w: k for k, w in enumerate(dict.fromkeys(own))}
            found = self._learn([w.decode() for w in kinds])
            out[long] = found[[kinds[w] for w in own]]
        return out

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        first = np.append(0, ends[:-1])
        points = code_points(joined)
        start = starts(points, first[first < ends])
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        before = np.searchsorted(start, ends)  # tokens up to each text's end
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(data) > len(points):  # places of bytes instead of characters
            width = np.ones(len(points), np.int64)
            for least in (0x80, 0x800, 0x10000):
                width += points >= least
            start = (np.cumsum(width) - width)[start]
        if self.words > self.most:
            self.forget()
        which = self._numbers(data, start, np.append(start[1:], len(data)))
        out, stop = gather(self.ids, self.offset, self.size, which)
        return out, np.append(0, stop)[before]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text end."""
        if not any(s in t for s in self.special for t in texts):
            return self._plain(texts)
        out, ends = [], []
        for t in texts:
            out.append(self._with_special(t))
            ends.append(len(out[-1]))
        return np.concatenate(out), np.cumsum(ends)

    def _with_special(self, text: str) -> np.ndarray:
        """Ids of a text that is cut at special strings, the leftmost first and of several there the longest."""
        at, lo, out = {s: text.find(s) for s in self.special}, 0, []
        while any(k >= 0 for k in at.values()):
            k, s = min((k, -len(s), s) for s, k in at.items() if k >= 0)[::2]
            out += [self._plain([text[lo:k]])[0], np.array([self.special[s]], np.uint32)]
            lo = k + len(s)
            at = {s: k if k < 0 or k >= lo else text.find(s, lo) for s, k in at.items()}
        return np.concatenate([*out, self._plain([text[lo:]])[0]])

    def batches(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, ids, ends) for ranges of texts of bounded size; a very long text is cut for the work only."""
        for lo, hi in chunks([len(t) for t in texts], CHUNK):
            if hi - lo > 1 or len(texts[lo]) <= CHUNK:
                yield lo, hi, *self.texts(texts[lo:hi])
            else:
                ids = np.concatenate([self.texts([p])[0] for p in pieces(texts[lo])])
                yield lo, hi, ids, np.array([len(ids)])
