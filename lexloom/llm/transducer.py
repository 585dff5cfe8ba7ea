"""Sentence boundary rules, compiled into a finite transducer.

A text is first read into symbols (`symbols`) of a finite alphabet: terminators with the class of what stands on either
side (an abbreviation, an initial, a number; a capital, a digit, a dash), quotation marks, brackets, dialogue dashes, line
breaks with the shape of the line, Thai spaces. Classes look at no more than CONTEXT characters, as the two automata of a
bimachine would from the left and from the right; what they mean is decided by the rules alone (`verdict`, `ends_line`,
`_rule`), which are compiled symbol by symbol into rows over all states (`compiled`). There are MODES x KINDS states: how
the sentence began, and which quotation or bracket is open. `run_chunk` runs it from every start state at once, so a chunk of a long text becomes a
state-transition function and a list of (position, mask of the start states that emit a boundary there);
such functions compose associatively, whatever the order in which the chunks are processed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Characters around a symbol that may decide it.
CONTEXT = 256
#: Characters of the longest word that keeps a line from being filled.
LONGEST_WORD = 16
#: Characters that a line must have to show by itself that lines are wrapped.
SINGLE = 40

# How the current sentence began: normally, with a quotation, as a line of dialogue (in speech, in the words
# around the speech), with a list number, not yet.
MODES = ("N", "Q", "D", "A", "M", "P")
N, Q, D, A, M, P = range(6)
# What is open: nothing, «», “”, „“, '', 「」, "", (), （）.
KINDS = 9
STATES = len(MODES) * KINDS
START = P * KINDS

# Abbreviations whose full stop never ends a sentence, and those that end one before a capital.
NEVER = frozenset(
    "г гг в вв гл стр тыс проф им ул см рис табл корп обл пос пер просп пл акад доц инж ред изд ср напр св кв мин сек "
    "prof capt dr mr mrs ms st vol pp no nos gen col lt sgt rev hon approx fig vs e.g i.e eg ie "
    "hr fr nr bzw ca bspw डॉ प्रो".split()
)
BEFORE_NUMBER = frozenset("д jan feb mar apr jun jul aug sep sept oct nov dec p ч кн оф".split())
MAY_END = frozenset("руб коп др пр т.д т.п д п etc co inc ltd p.m a.m usw".split())
GERMAN_MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert".split())

WIDE = str.maketrans("．！？，：；（）", ".!?,:;()")
BLANK = " \t\r\f\v\u00a0\u2000-\u200b\u202f\u205f\u3000\u2060\ufeff\u00ad"
OPEN = {"«": 1, "“": 2, "„": 3, "「": 5, "『": 5, "(": 7, "（": 8}
CLOSE = {"»": (1,), "”": (2, 3), "」": (5,), "』": (5,), ")": (7,), "）": (8,)}
TERMINATORS = ".!?…।॥。！？｡"
DASH = "—–―-"
CJK = "\u2e80-\u9fff\uf900-\ufaff"
THAI = "\u0e00-\u0e7f"

SYMBOL = re.compile(
    rf"(?P<br>[{BLANK}]*\n[{BLANK}\n]*)"
    rf"|(?P<t>[{TERMINATORS}]+)"
    rf"|(?P<q>[«»“”„「」『』()（）\"]|(?<![^\s(—–])'(?=\w)|(?<=[.,!?…])'(?=[\s.,;:!?]|$))"
    rf"|(?P<da>,[{BLANK}]*\n?[{BLANK}]*[—–][{BLANK}]*\n?[{BLANK}]*(?=\w))"
    rf"|(?P<th>(?<=[{THAI}])[{BLANK}]+(?=[{THAI}]))"
)
CAN_BREAK = re.compile(f"[{CJK}{THAI}]")
CJK_CHARACTER = re.compile(f"[{CJK}]")
GAP, DASHES = re.compile(rf"[{BLANK}\n]*"), re.compile(rf"[{DASH}]+[{BLANK}\n]*")
LINE_START = re.compile(rf"(?:^|\n)[{BLANK}]*$")
SPEECH, GOES_ON = re.compile(rf"[—–―][{BLANK}]*[A-ZА-ЯЁ«“\d]"), re.compile(rf"[a-zа-яёß]|[—–―][{BLANK}\n]*[a-zа-яё]")
TE = re.compile(r"т\.?\s*е$")
VISIBLE = re.compile(rf"[^{BLANK}\n]")
TOKEN_BEFORE = re.compile(r"(?:\w+\.)*\w+[ ]?$")


def _cased(c: str) -> str:
    """u: capital or digit, l: small letter, c: letter without case, o: other."""
    if c.isupper() or c.isdigit() or c == "":
        return "u"
    if c.islower():
        return "l"
    return "c" if c.isalpha() or "\u0900" <= c <= "\u0e7f" else "o"


def _start_class(text: str, at: int, listed: bool) -> str:
    """How a sentence that starts at this place begins: q quotation or bracket, d dialogue dash, m list number, n otherwise."""
    c = text[at]
    if c in OPEN or c in "\"'":
        return "q"
    if c in "—–―" or c == "-" and text[at + 1 : at + 2].isspace():
        return "d"
    return "m" if listed and re.match(r"\d{1,3}[.)]", text[at : at + 5]) else "n"


def line_shape(lines: list[str]) -> list[tuple[int, int]]:
    """Of each line but the last that another one follows: the columns between which it would have been broken anyway had
    lines been wrapped there, from the begin of its last word to where the next line's first word would have ended.

    Text without blanks may be broken between any two characters, so no word is taken to be longer than LONGEST_WORD."""
    out = []
    for line, after in zip(lines, lines[1:]):
        line, after = line.rstrip(), after[: LONGEST_WORD + 1]
        if line and after.strip() and not after[0].isspace():
            out.append((len(line) - _word(line[-LONGEST_WORD:].rpartition(" ")[2]), len(line) + 1 + _word(after.partition(" ")[0])))
    return out


def _word(word: str) -> int:
    return 2 if CAN_BREAK.search(word) else min(len(word), LONGEST_WORD)


def line_width(shapes: list[tuple[int, int]], sizes: list[int]) -> int:
    """The column at which a text whose lines have these sizes is wrapped, 0 if it isn't.

    The column that lies within most lines' shapes, less the lines that go on beyond it, is the text's if at least two lines and a quarter of
    all are broken there and at most a tenth go beyond. A single line that another follows shows a width only if it is
    the longest of the text and no short one."""
    if not shapes:
        return 0
    if len(shapes) == 1:
        return shapes[0][1] if SINGLE <= max(sizes) < shapes[0][1] else 0
    lines = sum(n > 0 for n in sizes)
    a, b = np.array(shapes).T
    change = np.zeros(int(b.max()) + 2, np.int64)
    np.add.at(change, a, 1)
    np.add.at(change, b + 1, -1)
    filled = np.cumsum(change)
    beyond = len(a) - np.cumsum(np.bincount(a, minlength=len(filled)))
    width = int(np.argmax(filled - beyond))
    return width if filled[width] >= max(2, 0.25 * lines) and beyond[width] <= 0.1 * lines else 0


def left_class(text: str, at: int) -> tuple[str, bool, bool]:
    """What stands before a terminator: (the class of its token, does a small letter, does a Chinese or Japanese character?).

    Classes: start (of a line), initial, never (ends a sentence), number (only before one), maybe, te (т. е.), zb (z. B.),
    item (a list's number), digits, other. They are found by a bounded look back, as an automaton from the left would."""
    before = text[at - 1] if at else " "
    small, wide = before.isalpha() and before.islower(), bool(CJK_CHARACTER.match(before))
    if LINE_START.search(text[max(0, at - 40) : at]):
        return "start", small, wide
    t = TOKEN_BEFORE.search(text, max(0, at - 24), at)
    token = t.group().rstrip() if t else ""
    low = token.lower()
    last = low.rpartition(".")[2]
    if len(last) == 1 and token[-1:].isupper() and not (before == " " and not t):
        kind = "initial"
    elif low in NEVER or last in NEVER:
        kind = "never"
    elif last in BEFORE_NUMBER:
        kind = "number"
    elif last == "т" or last == "е" and TE.search(text[max(0, at - 6) : at].lower()):
        kind = "te"
    elif low in ("z", "b", "z.b"):
        kind = "zb"
    elif last in MAY_END or low in MAY_END:
        kind = "maybe"
    elif token.isdigit():
        k = at - len(token)
        while k > 0 and text[k - 1] in " \t 　":
            k -= 1
        kind = "item" if len(token) <= 3 and (k == 0 or text[k - 1] == "\n") else "digits"
    else:
        kind = "other"
    return kind, small, wide


def right_class(text: str, end: int, width: int) -> tuple[str, str, int]:
    """What stands behind a mark: (glued, spaced, wrapped or broken; the class of the next visible character; its place).

    Classes: end, close, digit, upper, lower, caseless, pause (/,:;-), month, dash-lower, dash, quote-lower, quote, mark."""
    after = text[end] if end < len(text) else ""
    if not after:
        return "glued", "end", end
    if after in "»”」』)）":
        return "glued", "close", end
    nxt = GAP.match(text, end).end()
    gap = "spaced" if nxt > end else "glued"
    if "\n" in text[end:nxt] and (b := SYMBOL.match(text, end)) and b.lastgroup == "br":
        gap = "broken" if ends_line(*break_class(text, b, width)) else "wrapped"
    if nxt >= len(text):
        return gap, "end", nxt
    c = text[nxt]
    if c in "—–―" or c == "-" and text[nxt + 1 : nxt + 2].isspace():
        d = DASHES.match(text, nxt).end()
        return gap, "dash-lower" if d < len(text) and _cased(text[d]) == "l" else "dash", nxt
    if c in OPEN or c in "\"'":
        k = _cased(text[nxt + 1]) if nxt + 1 < len(text) else "o"
        return gap, "quote-lower" if k == "l" else "quote", nxt
    if c.isdigit():
        return gap, "digit", nxt
    if re.match(r"\w*", text[nxt : nxt + 12]).group() in GERMAN_MONTHS:
        return gap, "month", nxt
    return gap, "pause" if c in "/,:;-" else {"u": "upper", "l": "lower", "c": "caseless", "o": "mark"}[_cased(c)], nxt


def break_class(text: str, m: re.Match, width: int) -> tuple[bool, bool, bool, str]:
    """Of a line break: (is there a blank or indented line, is the line filled to the width, does a terminator end it, what begins
    the next line: dash (and a capital), lower, other)."""
    gap = m.group()
    open_ = gap.find("\n", gap.index("\n") + 1) >= 0 or not gap.endswith("\n")
    line = text[text.rfind("\n", max(0, m.start() - CONTEXT), m.start()) + 1 : m.start()]
    rest = text[m.end() : m.end() + 40]
    shape = line_shape([line, rest])
    filled = bool(shape) and shape[0][0] <= width <= shape[0][1]
    begins = "dash" if SPEECH.match(rest) else "lower" if rest[:1].islower() else "other"
    return open_, filled, line.rstrip()[-1:] in TERMINATORS, begins


def ends_line(open_: bool, filled: bool, ended: bool, begins: str) -> bool:
    """Does this line break end what stands before it, or does it merely wrap a line?

    A wrapped line is filled: what is shorter although the next word had found room, or longer than any filled line, was
    broken on purpose."""
    if open_ or begins == "dash":
        return True
    return (ended or begins != "lower") and not filled


def verdict(run: str, left: str, small: bool, wide_left: bool, gap: str, right: str, wide_right: bool) -> tuple[str | None, bool]:
    """What a terminator does, by the classes on both sides: (None, up, caseless, cjk, dashlow or dashup; is it a list's number?).

    run: dot, dots (…), wide, danda, strong (! or ? among them)."""
    if right in ("end", "close") and gap == "glued" or left == "start":
        return None, False
    if run == "dots" and (wide_left or wide_right):
        return None, False
    if gap == "broken" or right == "end":
        return None, False  # the break does it, or nothing follows
    if run == "wide":
        return "cjk", False
    spaced, listed = gap != "glued", False
    if run == "dot":
        if not spaced and right in ("digit", "lower", "pause") or left in ("initial", "never", "te", "zb") or left == "number" and right == "digit":
            return None, False
        if left == "maybe" and right not in ("upper", "month", "dash", "dash-lower", "quote", "quote-lower"):
            return None, False
        if left in ("item", "digits") and spaced:
            if right == "month":
                return None, False
            listed = left == "item"
    if right in ("dash", "dash-lower"):
        return "dashlow" if right == "dash-lower" else "dashup", listed
    if right in ("quote", "quote-lower"):
        return (None if right == "quote-lower" else "up"), listed
    if right in ("upper", "month", "digit"):
        return (None if not spaced and (not small or right == "digit") else "up"), listed
    if right == "caseless":
        return (None if run in ("dot", "dots") else "cjk" if run == "danda" else "caseless"), listed
    return None, False


def symbols(text: str, lo: int, hi: int, width: int = 0) -> list[tuple]:
    """(place, symbol, place of the next visible character, its start class) of all symbols that begin in text[lo:hi]."""
    flat = text.translate(WIDE) if re.search("[．，：；（）]", text) else text
    out: list[tuple] = []
    v = VISIBLE.search(text, lo, hi)
    if v:
        out.append((v.start(), ("V",), v.start(), _start_class(flat, v.start(), True)))
    for m in SYMBOL.finditer(flat, max(0, lo - 1)):
        at = m.start()
        if at >= hi:
            break
        if at < lo:
            # What began before the chunk belongs to the chunk before; a run of blanks is cut there by its first character.
            continue
        what, sym, nxt = m.lastgroup, None, m.end()
        if what == "br":
            if at == lo and lo and flat[lo - 1] in "\n " + BLANK and re.search(rf"\n[{BLANK}\n]*$", flat[max(0, lo - CONTEXT) : lo]):
                sym, nxt = ("B",), m.end()
            else:
                sym = ("L", *break_class(flat, m, width), at > 0 and flat[at - 1] in TERMINATORS, bool(GOES_ON.match(flat, m.end())))
        elif what == "t":
            run = m.group()
            marks = "wide" if any(c in "。！？｡" for c in run) else "danda" if "।" in run else "dots" if not run.strip("…") else "dot" if run == "." else "strong"
            gap, right, nxt = right_class(flat, m.end(), width)
            sym = ("T", marks, *left_class(flat, at), gap, right, bool(CJK_CHARACTER.match(flat, m.end())))
        elif what == "da":
            sym = ("DA",)
        elif what == "th":
            near = flat[max(0, at - 1) : at] + flat[m.end() : m.end() + 1]
            if not re.search(r"[\d\u0e46\u0e50-\u0e59]", near):
                sym = ("TH",)
        else:
            c = m.group()
            if c == "“":
                sym = ("LQ", *_after_close(flat, at, m.end()))
            elif c in OPEN:
                sym = ("O", OPEN[c])
            elif c in CLOSE:
                sym = ("C", CLOSE[c], *_after_close(flat, at, m.end()))
            elif c == '"':
                sym = ("X", 6, *_after_close(flat, at, m.end()))
            else:
                sym = ("O", 4) if flat[m.end() : m.end() + 1].isalnum() and (at == 0 or flat[at - 1] in " \t\n(—– 　") else ("C", (4,), *_after_close(flat, at, m.end()))
            if sym[0] in ("C", "LQ", "X"):
                g = re.compile(rf"[{BLANK}\n]*").match(flat, m.end())
                nxt = g.end()
        if sym is None:
            continue
        seen = VISIBLE.search(flat, nxt) if what in ("br", "th") else None
        if seen:
            nxt = seen.start()
        if nxt < len(flat) and VISIBLE.match(flat, nxt):
            out.append((at, sym, nxt, _start_class(flat, nxt, sym[0] in ("B", "W", "V") or "\n" in flat[at:nxt])))
        else:
            out.append((at, sym, -1, "-"))
    out.sort(key=lambda x: (x[0], x[1][0] != "V"))
    return out


def _after_close(text: str, at: int, end: int) -> tuple[bool, str]:
    """Of a closing mark: does a terminator stand right before it, and what follows: up, caseless or on."""
    t = at > 0 and text[at - 1] in TERMINATORS
    if not t:
        return False, "on"
    gap = re.compile(rf"[{BLANK}\n]*").match(text, end).end()
    if gap >= len(text):
        return True, "on"
    c = text[gap]
    if c in OPEN or c in "\"'":
        k = _cased(text[gap + 1]) if gap + 1 < len(text) else "o"
        return True, "on" if k == "l" else "caseless" if k == "c" else "up"
    k = _cased(c)
    return True, {"u": "up", "c": "caseless"}.get(k, "on")


@lru_cache(maxsize=4096)
def compiled(sym: tuple, start: str) -> tuple:
    """The transducer's row for one symbol: for each state, (next state, does it emit a boundary?)."""
    return tuple(_rule(s // KINDS, s % KINDS, sym, start) for s in range(STATES))


def _rule(mode: int, kind: int, sym: tuple, start: str) -> tuple[int, bool]:
    begun = {"q": Q, "d": D, "m": M, "n": N, "-": P}[start] * KINDS
    stay = mode * KINDS + kind
    what = sym[0]
    if what == "L":
        # A wrapped line may be enough to end a line of dialogue.
        what = "B" if ends_line(*sym[1:5]) else "W" if sym[5] and not sym[6] else "-"
    if what == "V":
        return (begun, True) if mode == P else (stay, False)
    if mode == P:
        return (begun, start != "-") if what == "B" else (stay, False)
    emit = (begun, start != "-")
    if what == "B":
        return emit
    if what == "-":
        return stay, False
    if what == "W":
        return emit if mode in (D, A) and not kind else (stay, False)
    if what == "T":
        if kind:
            return stay, False
        follow, listed = verdict(*sym[1:])
        if follow is None:
            return stay, False
        if listed and mode == M:
            return N * KINDS, False
        if follow == "dashlow":
            return ((A if mode == D else mode) * KINDS, False)
        if follow == "dashup":
            return (D * KINDS, False) if mode in (D, A) else emit
        return (stay, False) if mode == D else emit
    if what == "DA":
        if kind or mode not in (D, A):
            return stay, False
        return (A if mode == D else D) * KINDS, False
    if what == "TH":
        return (stay, False) if kind else emit
    if what == "O":
        return (mode * KINDS + sym[1], False) if not kind else (stay, False)
    if what == "LQ":  # opens “”, closes „“
        if not kind:
            return mode * KINDS + 2, False
        if kind != 3:
            return stay, False
        sym = ("C", (3,), *sym[1:])
    if what == "X":
        if not kind:
            return mode * KINDS + 6, False
        sym = ("C", (6,), *sym[2:])
    kinds, ended, follow = sym[1], sym[2], sym[3]
    if kind not in kinds:
        return stay, False
    closed = mode * KINDS
    if not ended or follow == "on" or mode == D:
        return closed, False
    if kind >= 7:
        return emit if mode == Q and follow == "up" else (closed, False)
    if follow == "caseless" and mode == Q:
        return N * KINDS, False
    return emit


def run_chunk(text: str, lo: int, hi: int, base: int = 0, first: bool = False, width: int = 0) -> tuple[list[int], list[tuple[int, int]]]:
    """Runs text[lo:hi] from every start state (from START only, if it is the first chunk of its text). width: line_width of the text.

    Returns the end state of each start state, and (base + place, mask of start states) of the boundaries."""
    live = {START: 1 << START} if first else {s: 1 << s for s in range(STATES)}
    events: list[tuple[int, int]] = []
    for at, sym, nxt, start in symbols(text, lo, hi, width):
        row, merged, mask = compiled(sym, start), {}, 0
        for s, starts in live.items():
            t, emits = row[s]
            merged[t] = merged.get(t, 0) | starts
            if emits:
                mask |= starts
        live = merged
        if mask:
            events.append((base + nxt, mask))
    ends = [START] * STATES
    for s, starts in live.items():
        for k in range(STATES):
            if starts >> k & 1:
                ends[k] = s
    return ends, events


def sentence_starts(text: str, chunk: int = 0) -> list[int]:
    """The places of all sentences of one text; chunk > 0 cuts it into such pieces and composes their functions."""
    if not text:
        return []
    lines = text.split("\n")
    width = line_width(line_shape(lines), [len(x.rstrip()) for x in lines])
    if not chunk:
        return sorted({p for p, m in run_chunk(text, 0, len(text), 0, True, width)[1] if m >> START & 1})
    state, out = START, set()
    for lo in range(0, len(text), chunk):
        left = max(0, lo - CONTEXT)
        piece = text[left : lo + chunk + CONTEXT]
        ends, events = run_chunk(piece, lo - left, min(lo - left + chunk, len(piece)), left, lo == 0, width)
        out.update(p for p, m in events if m >> state & 1)
        state = ends[state]
    return sorted(out)
