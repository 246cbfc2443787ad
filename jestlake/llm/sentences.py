"""Problem 10: sentence boundaries across languages and scripts.

Method: a hidden-event n-gram language model. Between any two tokens (words, or characters of scripts without word spaces)
lies a hidden event, boundary or none; an n-gram model over tokens and events gives the likelihood of both, and
forward-backward along a line gives each event its posterior. Ends of lines are always boundaries; nothing inside brackets,
titles or quotations is one. Elsewhere events are of two kinds: beside an end mark, a closed quotation or a space next to a
character of a script without word spaces they are weighed one by one; between two words without any mark they are weighed
stretch by stretch, as a stretch between marks holds no boundary unless its text runs on without marks, and how many
stretches do so is estimated with the rest.

The model is fitted without labels on all documents: ends of lines are sure boundaries, gaps without a mark are sure
non-boundaries, all other places are unknown at first; places that the model of a round decides clearly are counted in the
next of ROUNDS rounds. Which case a sentence begins with is learned from beginnings of lines and gaps inside sentences. The
counts of all documents are held in a count-min sketch of fixed size (2 rows of 2 ** BITS cells), summed in Spark block by
block and broadcast.

Defined results: null and blank texts have no sentence; a text of marks alone is one sentence; sentences never overlap, hold
no outer white space and leave nothing but white space out; unclosed brackets or quotations reach nowhere; texts of any
length are cut whole; repeated rows give equal sentences; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 200_000  # code points scanned at once
ROUNDS = 2
SURE = 0.9
BITS, ROWS = 22, 2  # cells of the count sketch: its size is the same for any corpus
BLOCKS = 64  # parts a sketch is summed in
VOCABULARY = 50_000  # words expected beyond those seen
HEAPS = 0.6  # distinct followers of a history grow like this power of its occurrences
TYPOS = 0.001  # share of words whose case says nothing
CJK = "぀-ヿㇰ-ㇿ㐀-鿿豈-﫿ｦ-ﾟ"
_MARKS = ".!?…。！？｡．"
_CLOSERS = "\"'”’»›)\\]）】』」》〉"
_EMOJI = "\U0001f000-\U0001faff☀-➿⬀-⯿️‍"
# an end mark run, then closers, then emoji with at most one space before each
_PLACE = re.compile(
    rf"(?P<mark>[{_MARKS}]+)(?P<close>[ \u00a0\u202f]?[{_CLOSERS}](?=\s|$|[{_CLOSERS}“{CJK}])|[{_CLOSERS}]|[“‘«](?=\s|$|[,.;:]))*(?P<emoji>[  ]?[{_EMOJI}]+)*(?P<space>\s*)|(?<=[{CJK}{_CLOSERS}“])(?P<gap>\s+)(?=\S)|(?<=\S)(?P<gap2>\s+)(?=[{CJK}])"
)
_LETTER = rf"[^\W\d_{CJK}]"
_TOKEN = re.compile(rf"[{CJK}]|\d+(?:[.,:]\d+)*\.?|(?<!\w){_LETTER}(?:\.{_LETTER}(?!\w))+\.?|[^\W_{CJK}]+(?:['’-][^\W_{CJK}]+)*\.?|[.…]{{2,}}|…+|[!?！？]+|\S")
_MARKER = re.compile(r"\d{1,3}|[-—–*•]|\d{1,3}\)")
_CLOSING = _CLOSERS.replace("\\", "") + "“ "
_TAIL = re.compile(rf"[{_CLOSERS}“]*(?:[\u00a0 ]?[{_EMOJI}]+)*\s*")
_LINE = re.compile(r"[^\r\n\x0b\x0c\x85  ]+")
_NESTS = {"(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“”", "‘": "’", "»": "«"}
_OPENING = re.compile("[" + re.escape("".join(_NESTS)) + "\"”—–]")
_SAID = re.compile(r"(?<![^\s])[—–](?=[¡¿\w])[^—–]*[^\s—–]\s?[—–](?=\w)")
_INVISIBLE = re.compile("[­͏​-‏⁠-⁤﻿]")


def _shape(token: str) -> str:
    """Token as the model sees it: lowered, numbers as 0, runs of marks by kind."""
    first = token[0]
    if first in ".…" and (len(token) > 1 or first == "…"):
        return "…"
    if first in "!?！？":
        return "?" if first in "?？" else "!"
    if first in "。｡．":
        return "。"
    if first.isdigit():
        return ("0." if token.endswith(".") else "0") if not any(c.isalpha() for c in token) else _INVISIBLE.sub("", token.lower())
    return _INVISIBLE.sub("", token.lower()) or token


def _spans(line: str) -> list[tuple[int, int]]:
    """(start, end) of bracketed, titled and quoted stretches, outermost, closed within the line."""
    spans, at, n = [], 0, len(line)
    while m := _OPENING.search(line, at):
        at = m.start()
        ch = line[at]
        if ch in "—–" and (said := _SAID.match(line, at)):  # speech between dashes, up to the words that follow it
            spans.append((at, said.end()))
            at = said.end()
            continue
        if ch in "\"“”" and ch != "“":
            closing = '"' if ch == '"' else None
        else:
            closing = _NESTS.get(ch)
        if closing is None or (ch == "»" and (at == 0 or not line[at - 1].isspace())):
            at += 1
            continue
        depth, end = 0, -1
        for k in range(at + 1, n):
            c = line[k]
            if c in closing and not (c == "’" and k + 1 < n and line[k + 1].isalpha() and line[k - 1].isalpha()):
                if depth == 0:
                    end = k
                    break
                depth -= 1
            elif c == ch and ch not in "\"„":
                depth += 1
        if end < 0:
            at += 1
        else:
            spans.append((at, end + 1))
            at = end + 1
    return spans


def _joined(line: str, at: int, following: str) -> bool:
    """Whether a point at `at` with no space after it may end a sentence: letters follow, and no single letter or digit is before."""
    if not (following.isalpha() or following in "¿¡“«\"„—-"):
        return False
    before = line[at - 1 : at]
    if before.isdigit() or not before.strip():
        return False
    return not (before.isalpha() and (at < 2 or not line[at - 2].isalpha()) and not "぀" <= before <= "鿿")


def _places(line: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, str, bool, int]]:
    """(at, reach, stop, quote, marked, case) of the possible boundaries of a line beside a mark, a closed quotation or a space.

    The sentence before ends at `at` and the next begins at `reach`; the mark ends at `stop`. A boundary after the line's
    whole text is the last one and reaches its end.
    """
    padded = line + " \u0001"
    s = before = 0
    for m in _PLACE.finditer(padded):
        start, end = m.start(), m.end()
        mark = m["mark"]
        while s < len(spans) and spans[s][1] <= start:
            s += 1
        quote = ""
        if s < len(spans) and spans[s][0] <= start < spans[s][1]:
            a, b = spans[s]
            if mark is None or m.end("mark") > b or line[m.end("mark") : b].strip(_CLOSING) or line[a] in "(（[【《〈—–":
                continue
            # the mark closes the quotation: a place lies after it; whether the quotation began the sentence tells much
            tail = _TAIL.match(padded, b)
            end = tail.end()
            lead = line[before:a].strip()
            quote = "”s" if not lead or lead in "-—–*•" else "”i"
            at = end - (len(tail[0]) - len(tail[0].rstrip()))
        else:
            at = end - len(m["space"] or m["gap"] or m["gap2"] or "")
        nxt = padded[end] if end < len(padded) else "\u0001"
        if _MARKER.fullmatch(line[before:start].strip()) and (mark is None or mark == "."):
            continue  # a list number or dash belongs to what follows
        if mark is not None and end <= at and not quote:
            # a point without space after it ends nothing inside a number or between single letters
            if mark == "." and not _joined(line, start, nxt):
                continue
            if nxt in ")）" or nxt in _MARKS:
                continue
        if nxt in ",;:、，；：":
            continue
        first = next((c for c in line[end : end + 4] if c.isalnum()), "")
        upper = 0 if not first.isalpha() or first.upper() == first.lower() else 1 if first.isupper() else -1
        yield min(at, len(line)), min(end, len(line)), m.end("mark") if mark is not None else start, quote, mark is not None, upper
        before = end


class _Tokens(dict):
    """Token -> (id, id without its point, kind of mark, kind of word, case); 0 is no id. Forgets all when it grows too large."""

    def __missing__(self, token: str) -> tuple[int, int, int, int, int]:
        shape = _shape(token)
        bare = shape[:-1] if len(shape) > 1 and shape[-1] == "." else shape
        word = 2 if token[0] in _IDEOGRAPHS else 1 if token[0].isalnum() else 0
        first = next((c for c in token if c.isalpha()), "")
        upper = 0 if not first or first.upper() == first.lower() else 1 if first.isupper() else -1
        value = (_token_id(shape), _token_id(bare), KINDS.get(shape, 0), word, upper)
        if len(self) > 300_000:
            self.clear()
        self[token] = value
        return value


class _Ideographs:
    def __contains__(self, ch: str) -> bool:
        return re.match(rf"[{CJK}]", ch) is not None


_IDEOGRAPHS = _Ideographs()


def _token_id(shape: str) -> int:
    return int.from_bytes(hashlib.blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 2


_tokens = _Tokens()
BREAK, BEGIN = 0, 1  # ids: nothing known of what stands before; a sentence begins
KINDS = {".": 0, "…": 1, "!": 2, "?": 3, "。": 4, " ": 5, "”s": 6, "”i": 7}  # of places: by their mark, a space, a quotation at the start or inside
_GAP, _QUOTE_START, _QUOTE_INSIDE = _token_id(" "), _token_id("”s"), _token_id("”i")


class Scan:
    """Tokens and possible boundaries of the lines of some texts, side by side in arrays."""

    def __init__(self, texts: list[str]):
        every, starts, ends, line_of, inside = [], [], [], [], []
        self.lines: list[tuple[int, int, int]] = []  # (text, offset of the line's text in it, its length)
        self.first: list[int] = []  # first token of each line
        at, reach, left, right, l0, l1, kind, cap, owner, last = [], [], [], [], [], [], [], [], [], []
        cased_of = []
        for t, text in enumerate(texts):
            cased = text != text.lower()
            for offset, line in _lines(text):
                offset += len(line) - len(line.lstrip())
                line = line.strip()
                k, base = len(self.lines), len(every)
                self.lines.append((t, offset, len(line)))
                self.first.append(base)
                cased_of.append(cased)
                found = list(_TOKEN.finditer(line))
                info = [_tokens[m[0]] for m in found]
                own_starts = [m.start() for m in found]
                starts += own_starts
                ends += [m.end() for m in found]
                every += info
                line_of += [k] * len(found)
                spans = _spans(line)
                inside += _covered(own_starts, spans)
                for p_at, p_reach, stop, quote, marked, p_cap in _places(line, spans):
                    before = bisect_left(own_starts, stop)  # tokens up to the end of the mark
                    after = bisect_left(own_starts, p_reach)
                    one = info[before - 1] if before else None
                    if quote or not marked:
                        left.append(base + before)
                        l0.append(one[0] if one else BEGIN)
                        l1.append(_GAP if not quote else _QUOTE_START if quote == "”s" else _QUOTE_INSIDE)
                        kind.append(KINDS[quote or " "])
                    else:
                        left.append(base + before - 1)
                        l0.append(info[before - 2][0] if before > 1 else BEGIN)
                        l1.append(one[0] if one else BREAK)
                        kind.append(one[2] if one else 0)
                    at.append(p_at), reach.append(p_reach), right.append(base + after), cap.append(p_cap), owner.append(k)
                    last.append(p_reach >= len(line))
        n = len(every)
        ids, bare, _, word, upper = zip(*every) if every else ((), (), (), (), ())
        self.ids, self.bare = np.array(ids, np.uint64), np.array(bare, np.uint64)
        self.word, self.upper, self.inside = np.array(word, np.int8), np.array(upper, np.int8), np.array(inside, bool)
        self.starts, self.ends, self.line_of = np.array(starts, np.int32), np.array(ends, np.int32), np.array(line_of, np.int32)
        self.cased = np.array(cased_of, bool)
        self.at, self.reach, self.left, self.right = (np.array(x, np.int64) for x in (at, reach, left, right))
        self.l0, self.l1 = np.array(l0, np.uint64), np.array(l1, np.uint64)
        self.kind, self.cap, self.owner, self.last = np.array(kind, np.int64), np.array(cap, np.int8), np.array(owner, np.int64), np.array(last, bool)
        firsts = np.zeros(n + 1, bool)
        firsts[[f for f in self.first if f < n]] = True
        self.begins = firsts[:n]  # tokens that begin a line
        # a place reaches back over the place before it when its left tokens begin before that one's right token
        self.near = np.zeros(len(at), bool)
        self.near[1:] = (self.owner[1:] == self.owner[:-1]) & (self.left[1:] - 1 < self.right[:-1])
        # the token a place stands before, and whether a gap between tokens holds any place
        real = ~self.last
        self.place_before = np.zeros(n + 1, bool)
        self.place_before[self.right[real]] = True

    def token(self, at: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Ids at token places, 0 outside of the line."""
        safe = np.minimum(at, max(0, len(self.ids) - 1))
        return np.where((at < len(self.ids)) & (self.line_of[safe] == line), self.ids[safe], np.uint64(0)) if len(self.ids) else np.zeros(len(at), np.uint64)

    def gaps(self) -> np.ndarray:
        """Tokens before which, without any mark, an event may lie: between two words, or characters of scripts without word spaces."""
        i = np.arange(1, len(self.ids))
        if not len(i):
            return i
        apart = (self.starts[i] > self.ends[i - 1]) | (self.word[i] == 2) | (self.word[i - 1] == 2)
        plain = (self.word[i] > 0) & (self.word[i - 1] > 0) & (self.ids[i - 1] == self.bare[i - 1])  # no point at the word before
        return i[plain & apart & ~(self.inside[i] & self.inside[i - 1]) & ~self.begins[i] & ~self.place_before[i]]


def _covered(starts: list[int], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each token lies inside a bracketed, titled or quoted stretch."""
    if not spans:
        return [False] * len(starts)
    out, s = [], 0
    for a in starts:
        while s < len(spans) and spans[s][1] <= a:
            s += 1
        out.append(s < len(spans) and spans[s][0] <= a)
    return out


_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_N1, _N2, _N3, _H1, _H2, _ENDS, _SEEN, _OCC, _BARE_END, _BARE_ON = (np.uint64((i + 1) * 0x27D4EB2F165667C5 & (1 << 64) - 1) for i in range(10))


def _key(salt: np.uint64, *parts: np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram of token ids, apart by what is counted."""
    out = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        out = (out ^ p) * _K1
        out ^= out >> np.uint64(32)
        out *= _K2
        out ^= out >> np.uint64(29)
    return out


_ROW = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


class Sketch:
    """Counts by hashed key in ROWS arrays of 2 ** BITS cells: as large for any corpus.

    A count is the least of its cells, less what other keys leave in a cell that is not theirs: the lower quartile of all
    cells, which is 0 until the sketch fills up.
    """

    def __init__(self, cells: np.ndarray | None = None):
        self.cells = np.zeros((ROWS, 1 << BITS), np.uint32) if cells is None else cells
        self.noise = 0.0 if cells is None else float(np.partition(cells[0], len(cells[0]) // 4)[len(cells[0]) // 4])

    def __getstate__(self) -> tuple:  # most cells of a sparse sketch are 0
        return zlib.compress(self.cells.tobytes(), 1), self.cells.dtype.str, self.noise

    def __setstate__(self, state: tuple) -> None:
        data, kind, self.noise = state
        self.cells = np.frombuffer(zlib.decompress(data), kind).reshape(ROWS, -1)

    @staticmethod
    def _slots(keys: np.ndarray, row: int) -> np.ndarray:
        return ((keys * _ROW[row]) >> np.uint64(64 - BITS)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        keys, n = np.unique(keys, return_counts=True)
        for row in range(ROWS):
            np.add.at(self.cells[row], self._slots(keys, row), n.astype(self.cells.dtype))

    def get(self, keys: np.ndarray) -> np.ndarray:
        least = self.cells[0][self._slots(keys, 0)]
        for row in range(1, ROWS):
            least = np.minimum(least, self.cells[row][self._slots(keys, row)])
        return np.maximum(least - self.noise, 0.0)


class EventModel:
    """Hidden-event n-gram model: words and boundaries by interpolated trigrams, events by what stands left of them."""

    def __init__(self, counts: Sketch, few: dict[str, float], first: bool):
        get = lambda name: few.get(name, 0.0)
        self.counts, self.first = counts, first
        self.total = max(1.0, get("tokens"))
        # P(capital next) in text that has capitals: at a boundary, at a place that is none, between words without a mark
        yes, no, gap = ((1 - TYPOS) * (get(f"{what}1") + 2) / (get(f"{what}1") + get(f"{what}0") + more) + TYPOS / 2 for what, more in (("yes", 2.1), ("no", 10), ("gap", 10)))
        self.case, self.gap_case = (yes, no), (yes, gap)
        self.share = get("ends") / max(1.0, get("places"))  # of places that are sure boundaries
        kinds = len(KINDS)
        if first:
            # a token at n places with no sure boundary among them is hardly ever one: ends of lines are a fair sample
            self.prior = np.full(kinds, 0.85)
            self.prior[KINDS[" "]] = 0.5
        else:
            self.prior = np.array([(get(f"k{k}") + 1) / (get(f"a{k}") + 2) for k in range(kinds)])
        self.base = (get("ends") + 1) / (self.total + 2)  # boundaries a token
        self.run_on = (get("run") + 1) / (get("stretches") + 1000)  # share of stretches that run on without marks

    def word(self, t: np.ndarray, *history: np.ndarray) -> np.ndarray:
        """P(t | history), the nearest token of the history first; an unknown (0) history says nothing."""
        p = (self.counts.get(_key(_N1, t)) + 0.5) / (self.total + 0.5 * VOCABULARY)
        past: tuple[np.ndarray, ...] = ()
        known = np.ones(len(t), bool)
        for n, h in enumerate(history):
            past = (h, *past)
            known = known & (h != BREAK)
            seen = np.where(known, self.counts.get(_key((_H1, _H2)[n], *past)), 0.0)
            kinds = seen**HEAPS  # distinct tokens that follow a history, by Heaps' law
            both = np.where(known, self.counts.get(_key((_N2, _N3)[n], *past, t)), 0.0)
            p = np.where(seen > 0, (np.minimum(both, seen) + kinds * p) / (seen + kinds + (seen == 0)), p)
        return p

    def _odds(self, event: np.ndarray, l0: np.ndarray, l1: np.ndarray, t0: np.ndarray, t1: np.ndarray, cap: np.ndarray, cased: np.ndarray, case: tuple[float, float]) -> np.ndarray:
        begin = np.full(len(l0), BEGIN, np.uint64)
        score = np.log(event / (1 - event))
        score += np.where(t0 != 0, np.log(self.word(t0, begin) / self.word(t0, l1, l0)), 0.0)
        score += np.where((t0 != 0) & (t1 != 0), np.log(self.word(t1, t0, begin) / self.word(t1, t0, l1)), 0.0)
        yes, no = case
        return score + np.where(cased & (cap > 0), np.log(yes / no), np.where(cased & (cap < 0), np.log((1 - yes) / (1 - no)), 0.0))

    def event(self, l0: np.ndarray, l1: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """P(boundary) after the left tokens alone."""
        p = self.prior[kind]
        for key in ((l1,), (l0, l1)):
            ends = self.counts.get(_key(_ENDS, *key))
            seen = self.counts.get(_key(_SEEN, *key)) if not self.first else self.counts.get(_key(_OCC, *key)) * self.share
            p = (ends + 4 * p) / (np.maximum(seen, ends) + 4)
        return np.clip(p, 0.002, 0.998)

    def at_places(self, s: Scan) -> np.ndarray:
        """Posterior of a boundary at every place, by forward-backward along each line."""
        t0, t1 = s.token(s.right, s.owner), s.token(s.right + 1, s.owner)
        cased = s.cased[s.owner]
        plain = self._odds(self.event(s.l0, s.l1, s.kind), s.l0, s.l1, t0, t1, s.cap, cased, self.case)
        out = 1 / (1 + np.exp(-np.clip(plain, -40, 40)))
        if s.near.any():
            begin = np.full(len(plain), BEGIN, np.uint64)
            start = np.where(s.near, self._odds(self.event(begin, s.l1, s.kind), begin, s.l1, t0, t1, s.cap, cased, self.case), plain)
            # only runs of places that reach over each other depend on one another
            first = np.flatnonzero(~s.near)
            size = np.diff(np.append(first, len(plain)))
            for f, n in zip(first[size > 1], size[size > 1]):
                out[f : f + n] = forward_backward(plain[f : f + n], start[f : f + n])
        return out

    def at_gaps(self, s: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gap tokens, posterior of a boundary there, posterior of each stretch between places to run on without marks).

        A stretch either holds no boundary or runs on: then every gap is an event of its own. Both readings are weighed by
        their likelihood and the share of stretches that run on.
        """
        gap = s.gaps()
        if not len(gap):
            return gap, np.zeros(0), np.zeros(0)
        stretch = np.cumsum(s.begins | s.place_before[:-1])[gap]
        line = s.line_of[gap]
        back = np.where((gap >= 2) & ~(s.begins | s.place_before[:-1])[gap - 1], s.ids[np.maximum(gap - 2, 0)], np.uint64(BEGIN))
        l1, t0, t1 = s.ids[gap - 1], s.ids[gap], s.token(gap + 1, line)
        ended, on = self.counts.get(_key(_BARE_END, s.bare[gap - 1])), self.counts.get(_key(_BARE_ON, s.bare[gap - 1]))
        p = np.clip((ended + 4 * self.base) / (ended + on + 4), 1e-6, 0.998)
        cased = s.cased[line]
        plain = np.clip(self._odds(p, back, l1, t0, t1, s.upper[gap], cased, self.gap_case), -40, 40)
        first = np.flatnonzero(np.diff(stretch, prepend=-1))
        gain = np.add.reduceat(np.log1p(-p) + np.log1p(np.exp(plain)), first)
        mode = 1 / (1 + np.exp(-np.clip(gain + np.log(self.run_on / (1 - self.run_on)), -40, 40)))
        size = np.diff(np.append(first, len(gap)))
        out = np.repeat(mode, size) / (1 + np.exp(-plain))
        begin = np.full(len(gap), BEGIN, np.uint64)
        for k in np.flatnonzero(mode > 0.01):  # the order of events matters only where there may be any
            f, n = first[k], size[k]
            part = slice(f, f + n)
            start = np.clip(self._odds(p[part], begin[part], l1[part], t0[part], t1[part], s.upper[gap[part]], cased[part], self.gap_case), -40, 40)
            out[part] = mode[k] * forward_backward(plain[part], start)
        return gap, out, mode


def forward_backward(plain: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posteriors of a chain of places: log odds of a boundary after none and after a boundary at the place before."""
    n = len(plain)
    forward, prev = [], (0.0, -math.inf)
    for i in range(n):
        none, yes = _add(*prev), _add(prev[0] + plain[i], prev[1] + start[i])
        top = max(none, yes)
        prev = (none - top, yes - top)
        forward.append(prev)
    out, back = np.zeros(n), (0.0, 0.0)
    for i in range(n - 1, -1, -1):
        none, yes = forward[i][0] + back[0], forward[i][1] + back[1]
        top = max(none, yes)
        out[i] = math.exp(yes - top) / (math.exp(none - top) + math.exp(yes - top))
        a, b = _add(back[0], plain[i] + back[1]), _add(back[0], start[i] + back[1])
        top = max(a, b)
        back = (a - top, b - top)
    return out


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _lines(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in _LINE.finditer(text) if m[0].strip()]


class Tally:
    """Counts of one round over any texts."""

    def __init__(self, model: EventModel | None):
        self.model, self.counts, self.few = model, Sketch(), Counter()

    def add(self, texts: list[str]) -> None:
        s, few = Scan(texts), self.few
        if not len(s.ids):
            return
        real = ~s.last
        if self.model is None:
            sure = np.where(s.last, 1, -1)  # -1: unknown
        else:
            post = self.model.at_places(s)
            sure = np.where(s.last, 1, np.where(post > SURE, 1, np.where(post < 1 - SURE, 0, -1)))
        # what lies before each token: its sentence's start, the token before it, or nothing known
        n = len(s.ids)
        state = np.zeros(n, np.int8)  # 0: goes on, 1: begins, -1: unknown
        state[s.begins] = 1
        state[s.right[real & (sure == 1)]] = 1
        state[s.right[real & (sure == -1)]] = -1
        before = np.where(state == 1, np.uint64(BEGIN), np.where(state == 0, np.append(np.uint64(0), s.ids[:-1]), np.uint64(BREAK)))
        before2 = np.append(np.uint64(0), before[:-1])
        two = before != BREAK
        three = (state == 0) & (before2 != BREAK)
        keys = [_key(_N1, s.ids), _key(_N2, before[two], s.ids[two]), _key(_N3, before2[three], before[three], s.ids[three]), _key(_H1, before[two]), _key(_H2, before2[three], before[three])]
        yes, known = sure == 1, sure >= 0
        keys += [_key(_ENDS, s.l1[yes]), _key(_ENDS, s.l0[yes], s.l1[yes]), _key(_SEEN, s.l1[known]), _key(_SEEN, s.l0[known], s.l1[known]), _key(_OCC, s.l1), _key(_OCC, s.l0, s.l1)]
        # words before an end mark, the mark left out, and words that go on
        word_end = s.left[yes & (s.left < n) & (s.left >= 0)]
        word_end = np.where(s.word[word_end] > 0, word_end, np.maximum(word_end - 1, 0))
        word_end = word_end[s.word[word_end] > 0]
        on = s.gaps() - 1
        keys += [_key(_BARE_END, s.bare[word_end]), _key(_BARE_ON, s.bare[on])]
        self.counts.add(np.concatenate(keys))
        few["tokens"] += n
        few["ends"] += int(yes.sum())
        few["places"] += len(yes)
        cased = s.cased[s.owner]
        for name, which in (("yes", 1), ("no", 0)):
            few[name + "1"] += int((cased & real & (sure == which) & (s.cap > 0)).sum())
            few[name + "0"] += int((cased & real & (sure == which) & (s.cap < 0)).sum())
        # lines begin sentences; words after words do not
        starts, inner = s.begins & s.cased[s.line_of] & (s.word == 1), s.gaps()
        inner = inner[s.cased[s.line_of[inner]]]
        few["yes1"] += int((starts & (s.upper > 0)).sum())
        few["yes0"] += int((starts & (s.upper < 0)).sum())
        few["gap1"] += int((s.upper[inner] > 0).sum())
        few["gap0"] += int((s.upper[inner] < 0).sum())
        for k in range(len(KINDS)):
            few[f"a{k}"] += int((real & (s.kind == k)).sum())
            few[f"k{k}"] += int((real & (s.kind == k) & yes).sum())
        if self.model is not None:
            _, _, mode = self.model.at_gaps(s)
            few["run"] += float(mode.sum())
            few["stretches"] += len(mode)

    def model_of(self) -> EventModel:
        return EventModel(Sketch(self.counts.cells.astype(np.float32)), dict(self.few), self.model is None)


def fit(texts: list[str]) -> EventModel:
    """The model of texts held in memory."""
    model: EventModel | None = None
    for _ in range(ROUNDS):
        tally = Tally(model)
        for block in _blocks(texts):
            tally.add([texts[i] for i in block])
        model = tally.model_of()
    return model


def _blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of neighbouring texts that are scanned together."""
    block, size = [], 0
    for i, t in enumerate(texts):
        if t:
            block.append(i)
            size += len(t)
            if size >= CHUNK:
                yield block
                block, size = [], 0
    if block:
        yield block


def split_all(texts: list[str], model: EventModel) -> list[list[tuple[int, int]]]:
    """(start, end) of the sentences of each text."""
    s = Scan(texts)
    cuts: list[list[tuple[int, int]]] = [[] for _ in s.lines]
    if len(s.at):
        post = model.at_places(s)
        for i in np.flatnonzero((post > 0.5) & ~s.last):
            cuts[s.owner[i]].append((int(s.at[i]), int(s.reach[i])))
    if len(s.ids):
        gap, post, _ = model.at_gaps(s)
        for g in gap[post > 0.5]:
            cuts[s.line_of[g]].append((int(s.ends[g - 1]), int(s.starts[g])))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for (t, offset, size), found in zip(s.lines, cuts):
        found.sort()
        at = 0
        for end, reach in [*found, (size, size)]:
            if end > at:
                out[t].append((offset + at, offset + end))
            at = reach
    return out


def split(text: str, model: EventModel) -> list[tuple[int, int]]:
    return split_all([text], model)[0]


def _counted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(_t) to (block, data): a task's counts, packed, in BLOCKS parts; block -1 holds the few numbers that belong to no token."""
    tally = Tally(model.value if model is not None else None)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for block in _blocks(texts):
            tally.add([texts[i] for i in block])
    yield _packed(tally.counts.cells.reshape(BLOCKS, -1), tally.few)


def _packed(parts: np.ndarray, few: Counter) -> pa.RecordBatch:
    held = [k for k in range(len(parts)) if parts[k].any()]
    data = [zlib.compress(parts[k].tobytes(), 1) for k in held] + [json.dumps(few).encode()]
    return pa.RecordBatch.from_arrays([pa.array([*held, -1], pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a partition, held as one array a block."""
    sums: dict[int, np.ndarray] = {}
    few: Counter = Counter()
    for batch in batches:
        for k, data in zip(*(c.to_pylist() for c in batch.columns)):
            if k < 0:
                few.update(json.loads(data))
                continue
            part = np.frombuffer(zlib.decompress(data), np.uint32)
            sums[k] = sums[k] + part if k in sums else part.astype(np.float64)
    data = [zlib.compress(v.astype(np.float32).tobytes(), 1) for v in sums.values()] + ([json.dumps(few).encode()] if few else [])
    yield pa.RecordBatch.from_arrays([pa.array([*sums, *([-1] if few else [])], pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def fit_documents(texts: DataFrame) -> Broadcast:
    """The broadcast model of all texts (_t): one pass a round; each round brings BLOCKS packed arrays of fixed size to the driver."""
    spark = texts.sparkSession
    held: Broadcast | None = None
    for k in range(ROUNDS):
        raw = texts.select("_t").mapInArrow(lambda it, held=held: _counted(it, held), "block int, data binary")
        rows = raw.repartition("block").mapInArrow(_merged, "block int, data binary").collect()
        cells, few = np.zeros((BLOCKS, (ROWS << BITS) // BLOCKS), np.float32), Counter()
        for r in rows:
            if r["block"] < 0:
                few.update(json.loads(r["data"]))
            else:
                cells[r["block"]] = np.frombuffer(zlib.decompress(r["data"]), np.float32)
        model = EventModel(Sketch(cells.reshape(ROWS, -1)), few, k == 0)
        if held is not None:
            held.unpersist()
        held = spark.sparkContext.broadcast(model)  # of fixed size
    return held


def split_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char): one row per sentence of every text."""
    texts = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t <> ''")
    held = fit_documents(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for block in _blocks(texts):
                rows, spans = [], []
                for i, found in zip(block, split_all([texts[i] for i in block], held.value)):
                    rows += [i] * len(found)
                    spans += found
                flat = np.array(spans, np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["_k", "start_char", "end_char"])

    return texts.mapInArrow(run, f"_k {texts.schema['_k'].dataType.simpleString()}, start_char int, end_char int").withColumnRenamed("_k", key)
