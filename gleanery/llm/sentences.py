"""Sentence boundaries across languages and scripts.

A pushdown automaton runs over the few characters of a text that can matter: terminators,
quotation marks, brackets and line breaks. One stack holds the open quotations and brackets of
a run of text, one the open list levels of the lines; headings and table rows are told by their
lines and those around them. Abbreviations are looked up in a trie of reversed spellings, so that
the text is walked back from a full stop. Time is linear in the text, whatever is left open.

The units of a text are in order, do not overlap, carry no outer white space and together cover
everything that is not white space. Null, empty and blank texts have no units.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.arrow import map_batches

# Abbreviations after which a sentence goes on, whatever follows.
INNER = """
Mr Mrs Ms Messrs Mx Dr Prof Rev Hon Gen Col Maj Capt Lt Sgt Gov Sen Rep Pres St Mt Ft Vol Vols No Nos Nr Nrn Fig Figs Sec Secs
Ch Chap Par Para Art Arts Abs Ziff Kap Bd Anm Anl Tab Eq Ex Exh App pp p ed eds cf vgl siehe approx aprox ca env vs v est resp incl
inkl exkl zzgl abzgl bzw ggf evtl sog Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Okt Dez janv févr avr juil déc ene abr ago dic
Mio Mrd Mill Tsd i.e e.g viz z.B u.a d.h i.d.R o.ä v.a m.E p.ej p.ex c.-à-d pág págs núm art arts apdo Cía Sra Sr Sres Srta Dra
Mme Mmes Mlle MM Me Mgr Hr Hrn Fr Dipl Ing Tel tel fax Str n.º Nº U.S U.K U.N E.U डॉ श्री सं पृ د م ص أ
""".split()

# Abbreviations that may also close a sentence; a capital, a digit or an opening mark after them starts the next one.
OUTER = """
Corp Inc Ltd Co LLC LLP plc Cos Bros S.A S.L S.p.A S.à.r.l L.P L.L.C B.V N.V A.G K.K Cie etc usw ff f Jr Sr a.m p.m A.M P.M p.p D.C
Ph.D M.D B.A M.A Esq et.al al
""".split()

# What may follow a German ordinal number within a sentence.
ORDINAL = """
Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Apr Aug Sept Okt Nov Dez
Quartal Halbjahr Jahrhundert Jahrestag Geschäftsjahr Quartals Halbjahres Tag Platz Stock Etage Auflage Kapitel Person Runde Mal
""".split()

# Units after a shortened million or billion.
AMOUNT_OF = "Euro EUR USD US-Dollar Dollar CHF Franken GBP Pfund Yen Stück Tonnen Aktien Kunden Einheiten t MWh kWh".split()

ENDS = ".!?…。！？｡।॥؟۔‼⁇⁈⁉"
WIDE_ENDS = "。！？｡।॥"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "〈": "〉", "《": "》", "‘": "’", "‚": "‘’"}
OPENED_BY = {c: "".join(o for o, ends in PAIRS.items() if c in ends) for ends in PAIRS.values() for c in ends}
BRACKETS = "(（[【"
CLOSERS = "\"”“’»›」』)）]】〉》"
OPENERS = "\"“„«‹「『(（[【〈《‘‚"
#: Longest quotation and longest bracket kept whole where it is not sure that they belong together; a mark left open by
#: mistake must not swallow a text.
LONGEST_QUOTE, LONGEST_BRACKET = 1200, 600

THAI = "฀-๿"
# Full stops within numbers are no events; a space between Thai letters is one, as Thai sets no stops.
EVENT = re.compile(rf"[!?…。！？｡।॥؟۔‼⁇⁈⁉]|\.(?!\d)|(?<!\d)\.|[\"“”„«»‹›「」『』()（）\[\]【】〈〉《》‘’‚]|(?<=[{THAI}])[ \u00a0]+(?=[{THAI}])")
FOOTNOTE = re.compile(r"\[(?:\d{1,3}|[a-z]|\*|†|note \d{1,3})\]|[¹²³⁰⁴-⁹†‡]+")
LINE = re.compile(r"[^\n\r\x0b\x0c\x85\u2028\u2029]+")
BLANK = re.compile(r"\n[^\S\n]*\n")
MARK = re.compile(r"(?:[-–—*•·▪▫◦‣●○■□►▶✓✔➢➤⁃▪]|[^\w\s\u0000-←\u3000-ヿ＀-￯]\ufe0f?|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|[①-⑳]|\d{1,3}、|（\d{1,3}）|[（(][一二三四五六七八九十]{1,3}[）)]|[一二三四五六七八九十]{1,3}、)(?:[ \t\u00a0]+|(?<=[、）)])(?=[^\W\d_]))(?=\S)")
NUMBERED = re.compile(r"\(?(?:\d|[a-zA-Z][.)])")
LETTERED = re.compile(r"[a-zA-Z]\.")
# Words and marks that no heading ends with.
DANGLING = re.compile(r"(?:^|[\s(])(?:a|an|and|are|as|at|by|for|from|in|is|of|on|or|our|than|that|the|to|under|was|were|which|whom|with|within|against|during|due|der|die|das|den|dem|des|ein|eine|einen|und|oder|von|vom|für|mit|im|in|zu|zum|zur|auf|bei|aus|de|du|des|le|la|les|un|une|et|à|au|aux|en|pour|par|sur|dans|chez|el|los|las|una|y|o|del|al|con|por|para|se|que|note|see|usd|eur|no|nr)$|,$", re.I)
CELL = re.compile(r"\t+| {3,}| ?\|\s|\s\|")
HEAD = re.compile(r"(?:Item|ITEM|Part|PART|Section|Chapter|Article|Artikel|Abschnitt|Kapitel|Note|Schedule|Exhibit|Appendix|Partie|Teil|Parte|Sección|Capítulo|Artículo|Anhang|Annexe)\s+(?:\d+[A-Za-z]?|[IVXLC]+|[A-Z])\b|#{1,6}\s")
WORD = re.compile(r"\S+")
LIST_MARK = re.compile(r"(?:^|[\s;,])(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})\Z")
# What goes on after a Chinese quotation.
RUNS_ON = re.compile("[的等说称道之]|表示|指出|写道|认为|字样|一语|一词|一文")
# Besides white space, what a word does not reach across.
AROUND = frozenset("\"“”„«»()[]（）")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = True
    return root


_INNER, _OUTER, _ORDINAL, _AMOUNT = _trie(INNER), _trie(OUTER), frozenset(ORDINAL), frozenset(AMOUNT_OF)


def _ends_with(text: str, end: int, start: int, trie: dict) -> bool:
    """Whether a word of the trie stands right before ``end`` as a word of its own."""
    node, i = trie, end - 1
    while True:
        if "" in node and (i < start or not (text[i].isalnum() or text[i] == ".")):
            return True
        if i < start or text[i] not in node:
            return False
        node, i = node[text[i]], i - 1


def _last(text: str, start: int, stop: int, upto: str = "") -> str:
    """The word that ends at ``stop``, or its last part from one of the characters of ``upto`` on."""
    i = stop
    while i > start and not text[i - 1].isspace() and text[i - 1] not in AROUND:
        i -= 1
        if text[i] in upto:
            break
    return text[i:stop]


class _Levels:
    """The stack of open list levels, each known by how far its mark is indented."""

    def __init__(self) -> None:
        self.open: list[int] = []

    def item(self, indent: int) -> None:
        """A list line closes all levels that are deeper, and opens its own unless it is open."""
        while self.open and self.open[-1] > indent:
            self.open.pop()
        if not self.open or self.open[-1] < indent:
            self.open.append(indent)

    def close(self) -> None:
        self.open.clear()


def _skip_space(text: str, i: int, end: int) -> int:
    while i < end and text[i].isspace():
        i += 1
    return i


def _tail(text: str, i: int, end: int, depth0: set[int]) -> int:
    """The end of the closing marks and footnote marks that follow a terminator before ``i``."""
    while i < end:
        c = text[i]
        if (c in CLOSERS or c in "*") and i not in depth0:
            i += 1
        elif c == "[" or c in "¹²³⁰⁴⁵⁶⁷⁸⁹†‡":
            m = FOOTNOTE.match(text, i, end)
            if not m:
                break
            i = m.end()
        elif c in " \u00a0\u202f" and i + 1 < end and text[i + 1] in "»›" and i + 1 not in depth0:
            i += 2
        else:
            break
    return i


def _sure(text: str, opening: int, closing: int) -> bool:
    """Whether a mark far from its opening one closes it: it stands as a closing mark does, and is no list or inch mark."""
    before, after = text[closing - 1], text[closing + 1 : closing + 2]
    if before.isspace() and text[opening] not in "«‹" or after.isalnum() and after.isascii() or not text[opening + 1 : opening + 2].strip() and text[opening] not in "«‹":
        return False
    if text[opening] == '"':
        return not before.isdigit()
    return text[opening] not in BRACKETS or not LIST_MARK.search(text[max(opening + 1, closing - 8) : closing])


def _matched(text: str, events: list[tuple[int, int]]) -> tuple[dict[int, int], set[int]]:
    """Opening marks with their closing ones, and all opening places. Marks without a partner in reach are left out."""
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # where each mark stands on the stack

    def push(c: str, i: int) -> None:
        places.setdefault(c, []).append(len(stack))
        stack.append((c, i))

    def cut(top: int) -> None:
        while len(stack) > top:
            places[stack.pop()[0]].pop()

    def last(marks: str) -> int | None:
        return max((places[o][-1] for o in marks if places.get(o)), default=None)

    pairs: dict[int, int] = {}
    opened: set[int] = set()
    n = len(text)
    for i, _ in events:
        c = text[i]
        if c == '"':
            before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
            opens = (before.isspace() or before in "([（「“„—–-" or not i) and not after.isspace()
            top = last('"')
            if top is not None and not (opens and after.isalnum() and i - stack[top][1] > LONGEST_QUOTE):
                if not opens or not before.isspace() or after in ".,;:!?)":
                    if i - stack[top][1] <= LONGEST_QUOTE or top == len(stack) - 1 and not opens and _sure(text, stack[top][1], i):
                        pairs[stack[top][1]] = i
                    cut(top)
                    continue
                cut(top)  # the earlier mark was never closed
            if opens:
                push(c, i)
            continue
        top = last(OPENED_BY.get(c, ""))
        if top is not None and not (c == "’" and i + 1 < n and text[i + 1].isalpha() and text[i - 1].isalpha()):
            o = stack[top][1]
            if i - o <= (LONGEST_BRACKET if text[o] in BRACKETS else LONGEST_QUOTE) or top == len(stack) - 1 and _sure(text, o, i):
                pairs[o] = i
            cut(top)
        elif c in PAIRS and not (c in "‘‚" and i and text[i - 1].isalnum()):
            push(c, i)
    opened.update(pairs)
    return pairs, opened


def _starts(text: str, i: int, end: int) -> str:
    """What stands at ``i``: U capital, l small letter, o letter without case, d digit, q opening mark, x other."""
    c = text[i]
    if c.isdigit():
        return "d"
    if c.isalpha():
        if c.isupper() or c.istitle():
            return "U"
        if c.islower():
            return "U" if i + 1 < end and text[i + 1].isupper() else "l"
        return "o"
    if c in "¿¡":
        return "U"
    if c in OPENERS:
        j = _skip_space(text, i + 1, end)
        return _starts(text, j, end) if j < end and text[j] not in OPENERS else "q"
    if c in "$€£¥₹#@§":
        return "d"
    cat = unicodedata.category(c)
    return "o" if cat == "So" or cat[0] == "M" else "x"


def _breaks(text: str, stop: int, after: int, end: int, start: int) -> bool:
    """Whether the terminator at ``stop``, with its closing marks up to ``after``, ends a sentence."""
    if after >= end:
        return False
    c = text[stop]
    nxt = _skip_space(text, after, end)
    if nxt >= end:
        return False
    gap, kind = nxt > after, _starts(text, nxt, end)
    if text[nxt] in ENDS or text[nxt] in ",;:、，；：)」』":
        return False
    if not gap:
        if c in WIDE_ENDS:
            return True
        if c in "!?؟۔…":
            return kind in "Uo" and text[nxt] not in OPENERS or kind == "q" or text[nxt] in "¿¡"
        # a full stop without a space: between a word or number and a capitalised word
        token = _last(text, start, stop, "@/.")
        if "@" in token or "/" in token or "." in token or text[after - 1] == "]" and after - stop > 1:
            return after - stop > 1 and kind in "Uo" and "@" not in token
        before = text[stop - 1] if stop > start else " "
        if kind == "U" and text[nxt].isupper():
            follows = text[nxt + 1] if nxt + 1 < end else " "
            return (before.islower() and len(token) > 1 or before.isdigit() or not before.isalnum()) and (follows.islower() or follows in " '’")
        return kind == "o" and before.isalpha() and len(token) > 2
    if c in "!?؟":
        return kind != "l" and kind != "x" or text[nxt] in "-–—•*" and text.rfind("\n", after, nxt) >= 0
    if c == "…" or c == "." and stop > start and text[stop - 1] == ".":
        if c == "." and stop - 1 > start and text[stop - 2].isalpha() and _ends_with(text, stop - 1, start, _OUTER):
            return kind in "Udo"  # an abbreviation's stop and the sentence's
        return kind in "Uo"
    if c != ".":
        return True
    if kind in "lx":
        return False
    # a full stop
    if after == stop + 1:
        if _ends_with(text, stop, start, _INNER):
            word = _last(text, start, stop)
            if word in ("Mio", "Mrd", "Mill", "Tsd"):
                m = WORD.match(text, nxt)
                return kind != "d" and m.group().strip(".,;:)“”") not in _AMOUNT
            if word in ("No", "no", "Art", "Fig", "Ex", "Tab", "Par", "Me", "est", "v", "al", "Mar", "Mill", "Fr", "App", "Rep", "p", "ed"):
                return kind == "U" and word in ("no", "No", "est", "Fr", "Mar", "App", "Ex", "Par") and not text[nxt].isdigit() and word != "Me"
            return False
        if _ends_with(text, stop, start, _OUTER):
            return kind in "Udo"
        i = stop - 1
        before = text[i] if i >= start else " "
        if before.isdigit():
            j = i
            while j >= start and text[j].isdigit():
                j -= 1
            if stop - 1 - j <= 2 and (j < start or not text[j].isalpha() and text[j] not in ".,"):
                m = WORD.match(text, nxt)
                if m.group().strip(".,;:)“”»") in _ORDINAL:
                    return False
            if j < start and stop - start <= 4:
                return False  # a number that opens the unit is its mark
            return True
        if i - 1 > start and text[i - 1] == "-" and text[i - 2].isalnum():
            return True  # the last letter of a hyphenated name
        if before.isalpha() and (i == start or not (text[i - 1].isalnum() or text[i - 1] in "'’")) or before.isalpha() and i - 1 >= start and text[i - 1] in "'’" and before.isupper():
            # one letter: an initial, unless a small word stands before and a small word could follow
            if before.isupper() and kind == "U":
                if i - 1 >= start and text[i - 1] in ".-":
                    return False
                prev = _last(text, start, max(start, i - 1)) if i - 1 >= start else ""
                return prev.isalpha() and prev.islower() and len(prev) > 3
            if before.islower() and kind == "U":
                m = WORD.match(text, nxt)
                if re.match(r"[A-Z]\.|[a-z]\.", m.group()) or m.group().startswith("B."):
                    return False
            return kind in "Uo" and before.islower() is False if kind != "d" else False
    return True


def _block(text: str, start: int, end: int, head: int, out: list[tuple[int, int]]) -> None:
    """Sentences of one run of text; terminators before ``head`` belong to a list mark."""
    events = [m.span() for m in EVENT.finditer(text, head, end)]
    begin = start
    if events:
        quotes = [e for e in events if text[e[0]] not in ENDS and text[e[0]] not in " \u00a0"]
        pairs, opened = _matched(text, quotes) if quotes else ({}, set())
        closing = {v: k for k, v in pairs.items()}
        outer_end = -1  # the end of the outermost open quotation or bracket
        done = head
        for a, b in events:
            if a < done:
                continue
            c = text[a]
            if a < outer_end:
                continue
            if a in pairs:
                outer_end = pairs[a]
                continue
            if a in closing:
                inner = a - 1
                while inner > closing[a] and (text[inner].isspace() or text[inner] in CLOSERS or text[inner] in "¹²³⁰⁴⁵⁶⁷⁸⁹"):
                    inner -= 1
                if inner <= closing[a] or text[inner] not in ENDS:
                    continue
                if text[closing[a]] in BRACKETS and _skip_space(text, begin, closing[a]) < closing[a]:
                    continue
                after = _tail(text, a + 1, end, opened)
                nxt = _skip_space(text, after, end)
                if nxt >= end:
                    continue
                if nxt == after:
                    # without a space: a full stop of wide scripts in a quotation ends the sentence unless its words run on
                    wide = text[inner] in WIDE_ENDS and (_starts(text, nxt, end) in "dUq" or "一" <= text[nxt] <= "鿿" and not RUNS_ON.match(text, nxt))
                    if text[nxt] in ENDS or not (wide or _starts(text, nxt, end) == "U"):
                        continue
                elif _starts(text, nxt, end) in "lx" or text[nxt] in ENDS:
                    continue
                cut, done = after, after
            elif c in ENDS:
                last = a
                while last + 1 < end and text[last + 1] in ENDS:
                    last += 1
                after = _tail(text, last + 1, end, opened)
                done = after
                if not _breaks(text, last, after, end, begin):
                    continue
                cut = after
            elif c in " \u00a0":
                cut = a
            else:
                continue
            if _skip_space(text, begin, cut) < cut:
                _emit(text, begin, cut, out)
                begin = cut
    _emit(text, begin, end, out)


def _emit(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a < b:
        out.append((a, b))


def _closed(text: str, a: int, b: int) -> bool:
    """Whether the line ends like a finished sentence."""
    i = b - 1
    while i > a and (text[i] in CLOSERS or text[i] in " \u00a0*"):
        i -= 1
    if text[i].isdigit() and text[b - 1] == "]":
        m = re.search(r"([.!?。！？।])[\"”»)]*(?:\[\d{1,3}\])+$", text[a:b])
        return bool(m)
    return text[i] in ENDS


def _width(c: str) -> int:
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def segment(text: str | None) -> list[tuple[int, int]]:
    """The units of ``text`` as (start, end), end exclusive, in code points."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    if "\n" not in text and "\r" not in text:
        lines = [(0, len(text))]
    else:
        lines = [m.span() for m in LINE.finditer(text)]
    rows: list[tuple[int, int, bool]] = []  # start, end, whether a blank line stands before
    indents: list[int] = []
    at, gap = 0, True
    for a, b in lines:
        blank = gap or text.count("\n", at, a) > 1 or "\u2029" in text[at:a]
        at, left = b, a
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            rows.append((a, b, blank))
            indents.append(a - left)
            gap = False
        else:
            gap = True
    if not rows:
        return out
    if len(rows) == 1:
        a, b, _ = rows[0]
        if b - a <= 120 and HEAD.match(text, a, b) and not _closed(text, a, b):
            out.append((a, b))
            return out
        m = MARK.match(text, a, b)
        _block(text, a, b, m.end() if m else a, out)
        return out

    n = len(rows)
    seps = [len(CELL.findall(text, a, b)) for a, b, _ in rows]
    table = [False] * n
    for i in range(n):
        near = i and not rows[i][2] and seps[i - 1] or i + 1 < n and not rows[i + 1][2] and seps[i + 1]
        table[i] = seps[i] >= 2 and bool(re.search(r"\d|\|", text[rows[i][0] : rows[i][1]])) or seps[i] >= 1 and bool(near)
    marks = [None if table[i] else MARK.match(text, rows[i][0], rows[i][1]) for i in range(n)]

    kind = [""] * n  # t table row, h heading, l list line, c continuation of the line before, b running text
    widest = [0] * n
    i = 0
    while i < n:  # the widest line of each paragraph
        j = i + 1
        while j < n and not rows[j][2]:
            j += 1
        w = max(b - a for a, b, _ in rows[i:j])
        for k in range(i, j):
            widest[k] = w
        i = j
    plain = [b - a for i, (a, b, _) in enumerate(rows) if not table[i] and not marks[i]]
    if plain and max(plain) <= 110:  # wrapped at one width throughout
        widest = [max(w, max(plain)) for w in widest]

    def wraps(i: int) -> bool:
        """Whether the line after ``i`` is wrapped only because its first word had no room."""
        a, b, _ = rows[i]
        c, d, _ = rows[i + 1]
        first = WORD.match(text, c, d)
        room = 1 if _starts(text, c, d) == "o" and unicodedata.east_asian_width(text[c]) in "WF" else first.end() - first.start() + 1
        return b - a + room > widest[i]

    levels = _Levels()
    for i in range(n):
        a, b, blank = rows[i]
        prev = kind[i - 1] if i else ""
        if prev in ("t", "h", "b"):
            levels.close()
        if table[i]:
            kind[i] = "t"
            continue
        closed_before = blank or not i or prev in "th" or _closed(text, rows[i - 1][0], rows[i - 1][1])
        if marks[i]:
            listed = bool(levels.open)
            loose = not NUMBERED.match(text, a)
            colon = i and text[rows[i - 1][1] - 1] in ":："
            lettered = LETTERED.match(text, a)
            if listed or colon or blank and not lettered or not lettered and closed_before or not lettered and loose and not (i and wraps(i - 1)):
                m = marks[i].group()
                if not (NUMBERED.match(m) and not listed and not blank and i and not colon and wraps(i - 1) and not _closed(text, rows[i - 1][0], rows[i - 1][1])):
                    kind[i] = "l"
                    levels.item(indents[i])
                    continue
        short = b - a <= 100 and not DANGLING.search(text, a, b)
        if short and widest[i] <= 110 and i + 1 < n and not rows[i + 1][2]:
            # wrapped text: a heading opens its paragraph and ends in a capitalised word, a number or a colon
            word = text[a:b].rsplit(None, 1)[-1]
            short = (blank or prev == "h") and (not word[0].islower() or word[-1] in ":：")
        finished = _closed(text, a, b)
        if short and closed_before and (not finished or HEAD.match(text, a, b) and text[b - 1] not in ".!?"):
            last = i + 1 >= n or rows[i + 1][2]
            if HEAD.match(text, a, b) and (last or not wraps(i) or text[rows[i + 1][0]].isupper()) and not finished:
                kind[i] = "h"
                continue
            if last:
                goes_on = i + 1 < n and _starts(text, rows[i + 1][0], rows[i + 1][1]) == "l"
                kind[i] = "h" if (blank or prev == "h") and not goes_on else "b"
                continue
            nxt = rows[i + 1][0]
            follows = "l" if marks[i + 1] else _starts(text, nxt, rows[i + 1][1])
            if follows != "l" and not wraps(i) and text[b - 1] not in ",;:：，、" or marks[i + 1] and text[b - 1] in ":：":
                kind[i] = "h"
                continue
        if levels.open:
            if not blank and (_starts(text, a, b) == "l" or not _closed(text, rows[i - 1][0], rows[i - 1][1]) and wraps(i - 1)):
                kind[i] = "c"
                continue
        kind[i] = "b"

    i = 0
    while i < n:
        a, b, _ = rows[i]
        if kind[i] in "th":
            out.append((a, b))
            i += 1
            continue
        j = i + 1
        if kind[i] == "l":
            while j < n and kind[j] == "c":
                j += 1
            whole = (a, rows[j - 1][1])
            out.append(whole)
            i = j
            continue
        while j < n and kind[j] in "bc":
            if rows[j][2]:
                p = rows[j - 1]
                if _closed(text, p[0], p[1]) or _starts(text, rows[j][0], rows[j][1]) != "l" or text[p[1] - 1] in ":：":
                    break
            j += 1
        _block(text, a, rows[j - 1][1], a, out)
        i = j
    return out


def sentences(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", order_col: str | None = "loaded_at") -> DataFrame:
    """One row for each sentence: the id, ``sentence_index`` from 0, ``start_pos`` and ``end_pos`` (end exclusive, in code points).

    An id is taken once: of rows with the same id the one with the greatest ``order_col`` counts (then the longest
    list of places). Rows with a null id form one document. Null, empty and blank texts give no rows, an empty table none.
    Only places are shuffled, never texts. Columns other than those named are not read, so their names cannot clash.
    """
    order = F.col(order_col).cast("timestamp") if order_col else F.lit(None).cast("timestamp")
    src = df.select(F.col(id_col).alias("id"), order.alias("at"), F.col(text_col).alias("text"))

    def setup():
        def step(batch):
            places = [[x for unit in segment(t) for x in unit] for t in batch.column(2).to_pylist()]
            return [batch.column(0), batch.column(1), places]

        return step

    id_type = df.schema[id_col].dataType.simpleString()
    found = map_batches(src, f"id {id_type}, at timestamp, places array<int>", setup)
    best = found.groupBy("id").agg(F.max(F.struct("at", "places")).getField("places").alias("places"))
    units = best.where(F.size("places") > 0).select("id", "places", F.explode(F.expr("sequence(0, size(places) div 2 - 1)")).alias("sentence_index"))
    return units.select(F.col("id").alias(id_col), "sentence_index", F.expr("places[2 * sentence_index]").alias("start_pos"), F.expr("places[2 * sentence_index + 1]").alias("end_pos"))
