"""Sentence boundaries in spaced and spaceless scripts.

A text is cut into blocks at empty lines and before list marks. In a block, passages in quotes and brackets are paired first; a terminator inside a pair ends nothing by
itself. What may end a sentence then are the columns of a lattice: each cluster of terminators with its closing marks, and each gap between letters of a spaceless script. A column has
two readings, that a sentence ends there and the cheapest of those by which it goes on (abbreviation, ordinal, initials, decimal, ellipsis, mere word), each with a cost that adds up evidence
from both sides. The block's sentences are the cheapest path through the columns; a sentence without a word costs extra, so that readings depend on one another.

Spaced scripts take their evidence from the token before and the opening word after a terminator. Spaceless ones segment the runs on both sides by a lattice over a dictionary of function
words; the final particle before the gap and the opening word after it, or what can't stand there, are weighed against how strong the gap itself is.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.lexicon import CHINESE, JAPANESE, THAI, Lexicon

# Fixed values -------------------------------------------------------------------------------------------------------------------------------
#: Abbreviations that are followed by what they belong to, so that they end no sentence.
BOUND = frozenset(
    "no nos nr rs vs approx fig figs app asst pvt incl excl cf sec secs st dr mr mrs ms messrs prof rev gen col sgt capt hon e.g i.e viz resp est dept vol ch art ed eds "
    "ca mind bzw vgl z d evtl ggf inkl exkl zzgl str abs bspw sog gem lt tel stk u o a.a "
    "núm núms aprox p pp ej pág págs sr sra srta dra ud uds art vol cap "
    "env réf ex mme mlle mgr.s chap éd n° "
    "डॉ रु क्र श्री सं पृ प्रो "
    "ص د م رقم".split()
)
#: Abbreviations that may end a sentence: a capital or a number after them begins another one.
OPEN = frozenset("etc usw ltd inc co corp bros jr sr. pct a.m p.m am pm mgr etc. u.s.w jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun ff".split())
#: Capitalised words that go on after such an abbreviation.
GOING_ON = frozenset("Annexe Annex Branch Building Block Depot Division Works Unit Warehouse Office House Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
#: Words before a German ordinal, and before a numeral that a point follows.
BEFORE_ORDINAL = frozenset("am zum vom beim im dem den der des das die bis seit ab jeder jeden jedes el".split())
#: Words a sentence with a capital abbreviation before it may open with.
OPENERS = frozenset("The A An This That These Those It He She We They In On At For From By With According Since After Before During Along Across Between Most Two".split())
# --------------------------------------------------------------------------------------------------------------------------------------------

_EMPTY_LINE = re.compile(r"\n[^\S\n]*\n")
_LINE = re.compile(r"\n[^\S\n]*")
_BULLET = re.compile(r"[•*‣◦▪·–—-][^\S\n]")
_NUMBERED = re.compile(r"(\d{1,3})[.)][^\S\n]")
_STRONG = "!?！？｡。।॥۔؟"
_END = re.compile(r"[.…!?！？｡。।॥|۔؟]+")
_PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "《": "》"}
_CLOSERS = frozenset(")]）」』»”“\"’'》")
_OPENING = frozenset("([（「『«“„\"¿¡《")
_MARKS = re.compile("[" + re.escape("".join(_PAIRS) + "".join(_PAIRS.values()) + '"') + "]")
_SPACELESS = re.compile(r"[ก-ฺเ-๎]+|[぀-ヿ㐀-鿿]+")
_KANA = re.compile(r"[぀-ヿ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_GAP = re.compile(r"(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])|(?<=[぀-ヿ㐀-鿿])\s+(?=[぀-ヿ㐀-鿿])")
_WORD = re.compile(r"[^\W_]+(?:[-'’_][^\W_]+)*")
_SOME_WORD = re.compile(r"[^\W\d_]{2}|[぀-ヿ㐀-鿿]")
_NUMBER_THEN_WORD = re.compile(r"[\d.,]+\s+[^\W\d_]")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")

#: How much speaks for an end at a gap of a spaceless script, before words are looked at: a blank between Thai letters always ends a sentence, a full stop nearly always, a blank or
#: line break between Chinese or Japanese characters only with evidence.
THAI_BLANK, FULL_STOP, OTHER_STOP, CJK_BLANK = 9.0, 6.0, 1.8, -1.5
#: What a sentence without a word costs, and the end of a sentence by what follows: U capital, N letter without case, D digit, O only opening marks, l small letter, - other.
WORDLESS, FOLLOWED_BY = 1.5, {"U": 0.0, "N": 0.0, "D": 0.0, "O": 3.0, "l": 4.0, "-": 3.0, "": 0.0}


class _Runs:
    """First and last words of the runs of spaceless letters in a text, each run segmented once."""

    def __init__(self, text: str, lo: int, hi: int) -> None:
        self.text = text
        self.runs = [(m.start(), m.end()) for m in _SPACELESS.finditer(text, lo, hi)]
        self.kana = bool(self.runs and _KANA.search(text, lo, hi))
        self.starts, self.ends = [a for a, _ in self.runs], [b for _, b in self.runs]
        self.known: dict[int, list[str]] = {}

    def _words(self, n: int) -> tuple[list[str], Lexicon]:
        a, b = self.runs[n]
        lexicon = THAI if "ก" <= self.text[a] <= "๎" else JAPANESE if self.kana else CHINESE
        if n not in self.known:
            self.known[n] = lexicon.segment(self.text[a:b])
        return self.known[n], lexicon

    def closing(self, at: int) -> float:
        """What the last word of the run that ends at ``at`` says for an end there."""
        n = bisect_left(self.ends, at)
        if n == len(self.ends) or self.ends[n] != at:
            return 0.0
        words, lexicon = self._words(n)
        return lexicon.after.get(words[-1], 0.0)

    def opening(self, at: int) -> float:
        """What the first word of the run that begins at ``at`` says for an end before it."""
        n = bisect_left(self.starts, at)
        if n == len(self.starts) or self.starts[n] != at:
            return 0.0
        words, lexicon = self._words(n)
        return lexicon.before.get(words[0], 0.0)


def cheapest_path(columns: list[tuple[int, float, float]], text: str, lo: int, hi: int) -> list[int]:
    """Where sentences end in text[lo:hi], hi included. A column is a position, the cost of an end there and the cost of going on.

    The lattice's states are whether the sentence so far has a word; each keeps its cheapest path, so the search is linear in the columns. Of equal costs, going on wins.
    """
    far = float("inf")
    costs, paths, at = [0.0, far], [None, None], lo  # [no word yet, some word]
    for position, end, on in columns:
        if _SOME_WORD.search(text, at, position):
            best = 0 if costs[0] < costs[1] else 1
            costs, paths = [far, costs[best]], [None, paths[best]]
        stop = (costs[0] + WORDLESS, 0) if costs[0] + WORDLESS < costs[1] else (costs[1], 1)
        ended, going = stop[0] + end, costs[0] + on
        first = (ended, (position, paths[stop[1]])) if ended < going else (going, paths[0])
        costs, paths, at = [first[0], costs[1] + on], [first[1], paths[1]], position
    if _SOME_WORD.search(text, at, hi):
        last = 0 if costs[0] < costs[1] else 1
    else:
        last = 0 if costs[0] + WORDLESS < costs[1] else 1
    ends, link = [hi], paths[last]
    while link:
        ends.append(link[0])
        link = link[1]
    return ends[::-1]


def _pairs(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Outermost passages in quotes and brackets in text[lo:hi], as positions of their opening and closing marks."""
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}  # places in the stack of the openings that each closing mark may close
    for m in _MARKS.finditer(text, lo, hi):
        c, i = m.group(), m.start()
        places = waiting.setdefault(c, [])
        while places and (places[-1] >= len(stack) or stack[places[-1]][0] != c):
            places.pop()
        if places:
            at = places.pop()
            opened = stack[at][1]
            while found and found[-1][0] > opened:
                found.pop()
            found.append((opened, i))
            del stack[at:]
        elif c == '"' or c in _PAIRS:
            closer = _PAIRS.get(c, c)
            waiting.setdefault(closer, []).append(len(stack))
            stack.append((closer, i))
    return found


def _opens(text: str, i: int, hi: int) -> str:
    """What stands at text[i]: '' end, U capital, l small, D digit, O opening mark, N letter of a script without case, - other."""
    if i >= hi:
        return ""
    c = text[i]
    if c.isdigit():
        return "D"
    if c in _OPENING:
        return "O"
    if c.isalpha():
        if c.isupper() or c.istitle():
            return "U"
        if c.islower():
            word = _WORD.match(text, i)
            return "U" if word and any(x.isupper() for x in word.group()[1:3]) else "l"
        return "N"
    return "-"


def _skip(text: str, i: int, hi: int) -> int:
    while i < hi and text[i].isspace():
        i += 1
    return i


def _kind_at(text: str, i: int, hi: int) -> str:
    """As _opens, but seen through opening marks: O only where nothing but marks follows."""
    k = _opens(text, i, hi)
    while k == "O":
        i = _skip(text, i + 1, hi)
        k = _opens(text, i, hi)
    return k


def _token_before(text: str, lo: int, at: int) -> str:
    i = at
    while i > lo and not text[i - 1].isspace():
        i -= 1
    return text[i:at].lstrip("([（「『«“„\"¿¡'’")


def _point(text: str, lo: int, at: int, after: int, hi: int) -> tuple[float, float]:
    """Costs of the readings of the single point at text[at], closed up to ``after``: that a sentence ends there, and that it goes on."""
    nxt = _skip(text, after, hi)
    kind = _kind_at(text, nxt, hi)
    before = text[at - 1] if at > lo else " "
    token = _token_before(text, lo, at)
    small = token.lower()
    end = FOLLOWED_BY[kind]
    if nxt == after:  # no white space: a decimal, a file name or a domain, unless both sides look like sentences
        end += 3.0 + 3.0 * (small in BOUND)
        if kind == "U":
            follows = text[nxt + 1 : nxt + 2]
            closes = before in "%)]”»\""
            opened = follows.islower() or follows.isspace() or text[nxt].islower() or text[nxt] in _OPENING or token.isalpha() and len(token) > 2 or closes
            end -= 1.5 * opened + 1.5 * (before.islower() or before.isdigit() or closes) - 3.0 * (small not in OPEN and "." in token[-4:])
        elif kind == "D":
            end -= 1.5 * bool(_NUMBER_THEN_WORD.match(text, nxt)) + 1.5 * (before.islower() and len(token) >= 3)
        elif kind == "N":
            end -= 1.5 * (_opens(text, at - 1, at) == "N" or before.isdigit()) + 1.5 * (not _CJK.match(text[nxt]))
        return end, 1.0
    if after > at + 1:  # closing marks: no abbreviation
        return end, 2.5
    word = m.group() if (m := _WORD.match(text, nxt)) else ""
    opener = word in OPENERS
    if small in OPEN:
        return end + 4.0 * (word in GOING_ON), 2.5
    if token.isdigit():
        prior = _token_before(text, lo, max(lo, _back(text, lo, at - len(token)))).lower()
        ordinal = kind == "U" and prior in BEFORE_ORDINAL or kind == "N" and "ऀ" <= text[nxt] <= "ॿ"
        return end + 4.0 * (kind == "O"), -1.0 if ordinal else 1.3
    if small in BOUND:
        return end + (1.0 if small == "no" else 3.0) - 2.0 * opener, 0.0
    if len(token) == 1 and token.isupper() and token.isascii() or _INITIALS.fullmatch(token):
        return end + 2.0 - 2.0 * opener, 1.0
    return end, 2.5


def _cluster(text: str, lo: int, at: int, marks: str, after: int, hi: int, runs: _Runs) -> tuple[float, float]:
    """Costs of the readings of a cluster of terminators at text[at], closed up to ``after``."""
    if marks == ".":
        return _point(text, lo, at, after, hi)
    nxt = _skip(text, after, hi)
    kind = _kind_at(text, nxt, hi)
    if any(c in "।॥۔|" for c in marks):
        return 0.0, FULL_STOP
    if any(c in "。！？｡" for c in marks):
        return 0.0, (FULL_STOP if any(c in "。｡" for c in marks) else OTHER_STOP) + runs.opening(nxt)
    if any(c in _STRONG for c in marks):
        return (4.0 if kind == "l" or nxt == after and kind in "D-" else 0.0), 2.5
    return (0.0 if kind == "U" or kind == "D" and nxt > after else 4.0), 2.5


def _back(text: str, lo: int, at: int) -> int:
    while at > lo and text[at - 1].isspace():
        at -= 1
    return at


def _block_ends(text: str, lo: int, hi: int) -> list[int]:
    """Positions in text[lo:hi] after which a sentence has ended, in order; hi is the last."""
    pairs = _pairs(text, lo, hi)
    opens, starts = {a for a, _ in pairs}, [a for a, _ in pairs]
    runs = _Runs(text, lo, hi)
    columns: list[tuple[int, float, float]] = []
    for m in _GAP.finditer(text, lo, hi) if runs.runs else ():
        n = bisect_left(starts, m.start())
        if n and pairs[n - 1][1] > m.start():
            continue  # inside a passage
        score = (THAI_BLANK if "ก" <= text[m.end()] <= "๎" else CJK_BLANK) + runs.closing(m.start()) + runs.opening(m.end())
        columns.append((m.start(), max(0.0, -score), max(0.0, score)))
    gaps = [c[0] for c in columns]
    k, i, begun = 0, lo, _skip(text, lo, hi)  # begun: where the sentence would begin if the column before ended one
    while m := _END.search(text, i, hi):
        at, i = m.start(), m.end()
        while k < len(pairs) and pairs[k][1] < at:
            k += 1
        marks = m.group()
        if k < len(pairs) and pairs[k][0] < at:
            opened, close = pairs[k]
            i = close + 1  # on past the whole passage
            last = _back(text, opened, close)
            if last > opened and text[last - 1] in ".…" + _STRONG + "|" and not _END.match(text, close + 1):
                n = bisect_right(gaps, opened)
                whole = opened == max(begun, _skip(text, gaps[n - 1], hi) if n else lo)
                nxt = _skip(text, close + 1, hi)
                kind = _kind_at(text, nxt, hi)
                ends = kind in ("U", "D") and (nxt > close + 1 or kind == "U") or kind == "N" and whole and nxt > close + 1
                columns.append((close + 1, 0.0 if ends else 4.0, 2.5))
                begun = nxt if ends else begun
            continue
        if "|" in marks and not ("ऀ" <= text[max(lo, _back(text, lo, at) - 1)] <= "ॿ"):
            continue
        after = i
        while after < hi and text[after] in _CLOSERS and after not in opens:
            after += 1
        nxt = _skip(text, after, hi)
        if nxt >= hi:
            continue
        end, on = _cluster(text, lo, at, marks, after, hi, runs)
        columns.append((after, end, on))
        if end < on:
            i, begun = after, nxt
    return cheapest_path(sorted(columns), text, lo, hi)


def _list_starts(text: str, lo: int, hi: int) -> list[int]:
    """Where list items begin in the block text[lo:hi]; a number counts as a mark only where a list begins or goes on, since a broken line may begin with one."""
    starts: list[int] = []
    expected = 1
    lines = [(lo, _skip_blanks(text, lo, hi))] + [(m.start(), m.end()) for m in _LINE.finditer(text, lo, hi)]
    for n, (edge, at) in enumerate(lines):
        if at >= hi:
            continue
        numbered = _NUMBERED.match(text, at, hi)
        if _BULLET.match(text, at, hi):
            starts.append(at)
        elif numbered:
            number = int(numbered.group(1))
            announced = text[max(lo, _back(text, lo, edge) - 1)] in ":："
            begins = n == 0 or announced or bool(starts)
            if number == expected and begins or number == 1 and announced:
                starts.append(at)
                expected = number + 1
    return [s for s in starts if s > lo]


def _skip_blanks(text: str, i: int, hi: int) -> int:
    while i < hi and text[i].isspace() and text[i] != "\n":
        i += 1
    return i


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end (exclusive) of each sentence, in code points, without white space around it. Null, empty and blank texts have none."""
    if not text or text.isspace():
        return []
    edges = [0]
    i = 0
    while m := _EMPTY_LINE.search(text, i):
        edges.append(m.end() - 1)
        i = m.end() - 1
    edges.append(len(text))
    out: list[tuple[int, int]] = []
    for lo, hi in zip(edges, edges[1:]):
        lo = _skip(text, lo, hi)
        if lo >= hi:
            continue
        cuts = [lo, *_list_starts(text, lo, hi), hi]
        for a, b in zip(cuts, cuts[1:]):
            mark = _NUMBERED.match(text, a, b) if len(cuts) > 2 or a == lo else None
            begin = a
            for end in _block_ends(text, mark.end() if mark else a, b):
                s, e = _skip(text, begin, end), end
                while e > s and text[e - 1].isspace():
                    e -= 1
                if e > s:
                    out.append((s, e))
                begin = end
    return out


def split_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: doc_id, sent_start, sent_end (code point offsets into the text, end exclusive), without a shuffle.

    Documents whose text is null, empty or blank have no sentences; texts may be of any length and are read whole; repeated rows give repeated sentences. Other columns are left out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [sentence_spans(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "s": [[x[0] for x in p] for p in spans], "e": [[x[1] for x in p] for p in spans]})

    spans = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInPandas(split, f"id {kind}, s array<int>, e array<int>")
    return spans.select(F.col("id").alias(doc_id), F.explode(F.arrays_zip("s", "e")).alias("r")).select(doc_id, F.col("r.s").alias("sent_start"), F.col("r.e").alias("sent_end"))
