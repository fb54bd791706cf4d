"""Where a text might be cut at paragraphs and sentences, with mathematics kept whole.

All such places are found at once and become a table with a column for each thing that speaks for or
against a cut. The rules are data: `parts.py` applies them to the rows of all texts as Spark columns,
and `split` to one text's arrays.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

import numpy as np

from corpusmill.functions.tokenizers import Tokenizer, Words, overlapping

# Patterns of mathematics, of paragraph and sentence borders, and of abbreviations.
_INLINE = re.compile(r"(?<!\$)\$(?!\$)(?:\\.|[^$\n\\])+?\$(?!\$)|\\\((?:\\.|[^\\)\n])+?\\\)")
_OPENING = re.compile(r"\$\$|\\\[|\\begin\{([^}]*)\}|\\begin\{")
_BREAK = re.compile(r"(?:\r?\n)\s*(?:\r?\n)+")
_SENTENCE = re.compile(r"[.!?]+[\"')\]]*(?:\s+|$)", re.MULTILINE)
_ABBREVIATION = r"(?:\b(?:e|i)\.g\.|\b(?:e|i)\.e\.)"
# Signs that end a sentence, that may close after it, and after which a line goes on.
_ENDS, _CLOSERS, _OPEN = ".!?", "\"')]}", ":;,([{"
# What a sentence goes on with, besides small letters and digits.
_GO_ON = (
    "(", "[", "{", "$", "\\[", "\\(", "\\\\",
    "\\cite", "\\citet", "\\citep", "\\citealp", "\\citeauthor", "\\citeyear", "\\parencite", "\\textcite", "\\footcite",
    "\\ref", "\\eqref", "\\autoref", "\\cref", "\\Cref",
)
#: Abbreviations wherever they begin, also inside one another.
_SHORT = re.compile(f"(?=({_ABBREVIATION}))", re.IGNORECASE)
#: White space by code point; there is none above these.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)])


@dataclass
class Window:
    start: int
    end: int
    tokens: int = 0


def block_math(text: str) -> list[tuple[int, int]]:
    """Display formulas from left to right; one that isn't closed ends the search."""
    found, at = [], 0
    while m := _OPENING.search(text, at):
        if m[0] == "\\begin{":
            break
        close = {"$$": "$$", "\\[": "\\]"}.get(m[0]) or f"\\end{{{m[1]}}}"
        end = text.find(close, m.end())
        if end < 0:
            break
        at = end + len(close)
        found.append((m.start(), at))
    return found


def inline_math(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _INLINE.finditer(text)]


def marks(text: str) -> bytearray:
    """For every character: 0, 1 in an inline formula, 2 in a display formula."""
    out = np.zeros(len(text), np.uint8)
    if "$" not in text and "\\" not in text:
        return bytearray(out.tobytes())
    for number, spans in ((1, inline_math(text)), (2, block_math(text))):
        turn = np.zeros(len(text) + 1, np.int64)
        for column, by in ((0, 1), (1, -1)):
            np.add.at(turn, [span[column] for span in spans], by)
        out[np.cumsum(turn)[:-1] > 0] = number
    return bytearray(out.tobytes())


def _spans(pattern: re.Pattern, text: str, *within: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.array([m.span() for m in pattern.finditer(text, *within)], np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _among(codes: np.ndarray, signs: str) -> np.ndarray:
    """Where a code point is one of a few signs."""
    return functools.reduce(operator.or_, (codes == ord(c) for c in signs))


def _last_where(mask: np.ndarray) -> np.ndarray:
    """For every place the last one up to it where `mask` holds, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


#: A paragraph goes on over a blank line where one of these groups of signs holds; `not x` is the absence of x.
SAME_PARAGRAPH = [
    ["formula"],
    ["display before"],
    ["display after", "not finished"],
    ["display after", "goes on"],
    ["words before", "not heading after", "abbreviation"],
    ["words before", "not heading after", "open"],
    ["words before", "not heading after", "hyphen", "small letter"],
    ["words before", "not heading after", "not finished", "goes on"],
]
#: A sentence goes on where one of these holds.
SAME_SENTENCE = [["formula"], ["abbreviation"], ["goes on"]]
SIGNS = ["formula", "display before", "display after", "words before", "heading after", "abbreviation", "open", "hyphen", "finished", "small letter", "goes on"]
PARAGRAPH, SENTENCE, END = range(3)


def holds(rules: list[list[str]], signs: dict) -> object:
    """Whether one of the rules holds, each of which needs all its signs; signs are arrays, or Spark columns."""
    value = lambda name: ~signs[name[4:]] if name.startswith("not ") else signs[name]
    return functools.reduce(operator.or_, (functools.reduce(operator.and_, map(value, rule)) for rule in rules))


class Splitter:
    """Borders inside one text, and its tokens."""

    def __init__(self, text: str, tokenizer: Tokenizer | None = None, spans: tuple[np.ndarray, np.ndarray] | None = None):
        """`spans` are those of the tokenizer, where they are known already."""
        self.text, self.mark = text, np.frombuffer(marks(text), np.uint8)
        self.first, self.last = spans or (tokenizer or Words()).spans(text)
        self.codes = codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.filled = ~(_BLANK[np.minimum(codes, len(_BLANK) - 1)] & (codes < len(_BLANK)))
        self.short = np.zeros(len(text), bool)
        self.short[[m.end(1) - 1 for m in _SHORT.finditer(text)]] = True
        # The last sign up to a place that isn't blank, and then the last up to there that doesn't just close.
        self.solid, self.core = _last_where(self.filled), _last_where(~_among(codes, _CLOSERS))
        self.following = np.append(len(text) - 1 - _last_where(self.filled[::-1])[::-1], len(text))  # the next that isn't blank

    def tokens(self, start: int, end: int) -> int:
        """Tokens that overlap [start, end)."""
        return overlapping(self.first, self.last, start, end)

    def _signs(self, start: np.ndarray, end: np.ndarray, ended: np.ndarray) -> dict[str, np.ndarray]:
        """What is known of borders [start, end), each with text after it; `ended` is the sign that the text before it ends with, or -1."""
        after = self.following[end]
        here = [self.text[i] for i in after.tolist()]
        last = np.where(ended >= 0, self.codes[ended], 0) if len(self.codes) else ended
        small = np.array([c.islower() for c in here], bool)
        short = (ended >= 0) & self.short[ended]
        return {
            "formula": (self.mark[start] > 0) | (self.mark[end - 1] > 0),
            "display after": self.mark[after] == 2,
            "words before": ended >= 0,
            "heading after": np.array([c == "#" for c in here], bool),
            "abbreviation": short,
            "open": _among(last, _OPEN),
            "hyphen": _among(last, "-"),
            "finished": _among(last, _ENDS) & ~short,
            "small letter": small,
            "goes on": small | np.array([c.isdigit() for c in here], bool) | np.array([self.text.startswith(_GO_ON, i) for i in after.tolist()], bool),
        }

    def _paragraph_signs(self) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """All blank lines but one at the start, and their signs; at the text's edges only formulas count."""
        start, end = _spans(_BREAK, self.text)
        inside = start > 0
        start, end = start[inside], end[inside]
        before = self.solid[start - 1] if len(start) else start
        full = np.flatnonzero((before >= 0) & (self.following[end] < len(self.text)))
        known = self._signs(start[full], end[full], self.core[before[full]])
        known["display before"] = self.mark[before[full]] == 2
        signs = {}
        for name, values in known.items():
            signs[name] = np.zeros(len(start), bool)
            signs[name][full] = values
        signs["formula"] = (self.mark[start] > 0) | (self.mark[end - 1] > 0)
        return start, end, signs

    def borders(self) -> dict[str, np.ndarray]:
        """All borders of both kinds in order, and the text's end as the last, with counts that make units' sizes differences.

        stop and begin: where a unit ends and the next begins; stop_tokens and begin_tokens: tokens that
        begin before the one, and that end up to the other; solid: the last place before stop that isn't blank.
        """
        n = len(self.text)
        p_start, p_end, paragraph = self._paragraph_signs()
        start, end = _spans(_SENTENCE, self.text)
        followed = self.following[end] < n
        start, end = start[followed], end[followed]
        sentence = self._signs(start, end, start) | {"display before": np.zeros(len(start), bool)}
        join = lambda *parts: np.concatenate([np.asarray(x) for x in parts])
        at = {
            "kind": join(np.full(len(p_start), PARAGRAPH), np.full(len(start), SENTENCE), [END]), "place": join(p_start, start, [n]),
            "stop": join(p_start, end, [n]), "begin": join(p_end, end, [n]), "after": join(self.following[p_end], self.following[end], [n]),
        }
        at |= {name: join(paragraph[name], sentence[name], [False]).astype(bool) for name in SIGNS}
        order = np.lexsort((at["kind"], at["place"]))
        at = {name: values[order] for name, values in at.items()}
        at["stop_tokens"], at["begin_tokens"] = np.searchsorted(self.first, at["stop"]), np.searchsorted(self.last, at["begin"], side="right")
        at["solid"] = np.append(-1, self.solid)[at["stop"]]
        return at

    def paragraphs(self) -> list[Window]:
        start, end, signs = self._paragraph_signs()
        cut = ~holds(SAME_PARAGRAPH, signs)
        starts, ends = np.append(0, end[cut]), np.append(start[cut], len(self.text))
        return [Window(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if a < b]

    def sentences(self, p: Window) -> list[Window]:
        start, end = _spans(_SENTENCE, self.text, p.start, p.end)
        inside = end < p.end
        inside[inside] = self.following[end[inside]] < p.end
        start, end = start[inside], end[inside]
        cut = end[~holds(SAME_SENTENCE, self._signs(start, end, start))].tolist()
        return [Window(a, b) for a, b in zip([p.start, *cut], [*cut, p.end], strict=True)]

    def units(self, max_tokens: int) -> list[Window]:
        """Paragraphs, and the sentences of those that are too long; blank ones go."""
        whole = Window(0, len(self.text))
        found = [u for p in self.paragraphs() for u in (self.sentences(p) if self.tokens(p.start, p.end) > max_tokens else [p])]
        kept = [u for u in found if self.filled[u.start : u.end].any()] or [whole]
        return [Window(u.start, u.end, self.tokens(u.start, u.end)) for u in kept]


def pack(units: list[Window], max_tokens: int, overlap: int = 0) -> list[Window]:
    """Windows of consecutive units up to max_tokens; with an overlap, a window starts where at most that many tokens of the one before are left.

    A unit above the limit is a window of its own.
    """
    sums = np.cumsum([0, *(u.tokens for u in units)])
    out, i = [], 0
    while i < len(units):
        full = int(np.searchsorted(sums, sums[i] + max_tokens, side="right")) - 1
        j = max(full, i + 1)
        held = int(sums[j] - sums[i])
        out.append(Window(units[i].start, units[j - 1].end, held))
        passed = int(np.searchsorted(sums, sums[i] + max(1, held - overlap)))
        i = min(passed, j) if overlap > 0 and full > i else j
    return out


def merge_small(windows: list[Window], least: int) -> list[Window]:
    """Windows are added up until they have `least` characters; what is left over joins the last, if there is one."""
    out, start = [], None
    for w in windows:
        start = w.start if start is None else start
        if w.end - start >= least:
            out.append(Window(start, w.end))
            start = None
    if start is not None:
        start = out.pop().start if out else start
        out.append(Window(start, windows[-1].end))
    return out


def split(text: str, max_tokens: int = 256, overlap: int = 0, least: int = 20, tokenizer: Tokenizer | None = None) -> list[str]:
    """The windows of one oversized section as texts: the form for a single text."""
    if not text:
        return [text]
    windows = [w for w in pack(Splitter(text, tokenizer).units(max_tokens), max_tokens, overlap) if w.end > w.start]
    if least > 0 and len(windows) > 1:
        windows = merge_small(windows, least)
    return [text[w.start : w.end] for w in windows]
