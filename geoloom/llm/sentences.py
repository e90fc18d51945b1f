"""Sentence boundaries across languages and scripts: a pushdown automaton over each text.

A text is cut at blank lines.  In each paragraph a first pass with a stack pairs quotation marks and brackets (an opener
without its closer is an ordinary character), and one over the lines keeps a stack of list levels (indent, kind of marker,
number).  The second pass reads terminators of all scripts, blanks between Thai letters, list items and the paired openers.  An opener pushes: nothing inside a pair ends the sentence outside, and when
it pops the automaton decides by what stands before it and what follows whether the quotation stood alone.  At a full stop
the word before it is looked up, read backwards, in tries of abbreviations.

A line that opens with a marker is an item if its level has a second item or its marker is a bullet sign or 'N)'; an item
ends the sentence before it.  A single '-', '*', '1.' or 'a)' at the start of a line is ordinary text.

Two kinds of abbreviations: those that always lead on (titles, 'e.g.', or page and number signs before a digit), and those
that may also end a sentence ('etc.', 'p.m.', 'Inc.'), which do so before what looks like the start of a sentence.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Abbreviations that lead on to what follows.
LEADING = (
    "mr mrs ms messrs dr prof mt gen col sgt capt lt rev hon gov sen rep asst assoc vs e.g i.e a.k.a cf approx resp viz "
    "sr sra srta dra ud uds av avda ej p.ej ee m mm mme mlle mgr "
    "z b d h z.b d.h u.a bzw ca ggf vgl bspw evtl hr fr frl "
    "проф ул д г т к е т.к т.е т.д т.п стр рис им акад гр пр "
    "π.χ κ κα δηλ βλ δρ د أ م डॉ श्री प्रो sig dott"
)
#: Abbreviations that lead on if a number follows.
BEFORE_NUMBER = "no nos nr núm nº vol fig figs p pp s lat lng long art sec ch chap tel abs kap ст п № σελ αρ"
#: Abbreviations that may end a sentence.
ENDING = "etc usw inc ltd corp co jr sq ave rd blvd min max dept univ u.s e.u u.k a.m p.m ph.d uu κ.λπ κ.ά и.т.д"
#: Weekdays and months, which carry on after 'a.m.' and 'p.m.'.
CALENDAR = "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december"
_ARTICLES = set("der die das den dem des am vom zum zur im beim ab seit bis ein einen eine jeder jede".split())
_SPEECH = regex.compile(
    r"(?:と|って|なんて|という)|[她他我你它们]{0,3}\p{Han}{0,4}?[问说道喊答叫][^，。！？]{0,6}[。！？]|(?:سأل|سألت|قال|قالت|أضاف|صرخ|رد)\b|[^।!?]{0,24}?(?:कहा|पूछा|बोल[ाेी]|बताया)|"
    r"(?:하고|라고|이라고|라며|라는|며)\s|[^.!?]{0,24}?(?:말했|물었|외쳤|답했)|[^።?!]{0,24}?(?:አለ|አሉ|ጠየቀ|ብሏል)"
)
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“”", "‚": "‘’", "‘": "’", "‹": "›"}
_BRACKETS = set("([{（［【〔")
_CLOSERS = "\"'”’»›」』》〉)]}）］】〕“"
_BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85 ])[^\S\r\n\x0b\x0c\x85 ]*(?:\r\n|[\n\r\x0b\x0c\x85 ])\s*| \s*")
_STOPS = ".!?。！？｡．؟۔।॥።፧፨…‥‼⁇⁈⁉;"
_EVENT = regex.compile(rf"(?:[.!?。！？｡．؟۔।॥።፧፨…‥‼⁇⁈⁉]+|(?<=\p{{Greek}})[;;]|(?<=[฀-๿])\s+|[\r\n]+|[\"'{regex.escape(''.join(_PAIRS))}])")
_MARKS = regex.compile(rf"[\"'{regex.escape(''.join(_PAIRS) + ''.join(_PAIRS.values()))}]")
_EMOJI = r"(?:[\U0001F1E6-\U0001F1FF]{2}|[#*0-9]️?⃣|[\U0001F000-\U0001FAFF☀-➿⬀-⯿⌀-⏿‼⁉〰〽㊗㊙](?:[︎️\U0001F3FB-\U0001F3FF]|‍[\U0001F000-\U0001FAFF☀-➿⬀-⯿]|[\U000E0020-\U000E007F])*)"
_TAIL = regex.compile(rf"(?:\s*{_EMOJI})*")
_NEXT = regex.compile(r"[\s\p{Cf}]*")
_FULL = set("。！？｡؟۔।॥።፧፨")
_MARKER = regex.compile(r"(?:^|(?<=[\r\n]))([^\S\r\n]*)(?:([•▪‣◦●])|([-–*+])|(\(?)(?:(\d{1,3})([.)])|(\p{L})\)))(?=[^\S\r\n])")
_CASELESS = regex.compile(r"[\p{Lo}\p{Lm}]")


def _trie(words: str) -> dict:
    root: dict = {}
    for word in words.split():
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = True
    return root


_LEAD, _NUMBER, _END, _DAYS = _trie(LEADING), _trie(BEFORE_NUMBER), _trie(ENDING), set(CALENDAR.split())


def _in(trie: dict, text: str, start: int, end: int) -> bool:
    """Whether a whole word of the trie ends at ``end`` (read backwards, in lower case, not beyond ``start``)."""
    i, node = end - 1, trie
    while i >= start and (node := node.get(text[i].lower())) is not None:
        if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] in ".'’")):
            return True
        i -= 1
    return False


def _paired(t: str) -> dict[int, int]:
    """Opener to closer of every pair of quotation marks or brackets."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    for m in _MARKS.finditer(t):
        c, i = m.group(), m.start()
        before, after = t[i - 1] if i else " ", t[i + 1] if i + 1 < len(t) else " "
        close = None
        if c in "\"'":
            if c == "'" and before.isalnum() and after.isalnum():
                continue
            held = any(o == c for o, _ in stack)
            if held and not before.isspace():
                close = c
            elif not after.isspace() and (before.isspace() or before in "([{（—–-:：“„«‘" or (c == '"' and not before.isalnum())):
                stack.append((c, i))
                continue
            else:
                continue
        else:
            if c in "’‘" and before.isalnum() and after.isalnum():
                continue
            if any(c in _PAIRS.get(o, "") for o, _ in stack) and not (c == "“" and not any(o == "„" for o, _ in stack)):
                close = c
            elif c in _PAIRS:
                stack.append((c, i))
                continue
            else:
                continue
        for k in range(len(stack) - 1, -1, -1):
            o, at = stack[k]
            if (o == close) if close in "\"'" else (close in _PAIRS.get(o, "")):
                pairs[at] = i
                del stack[k:]
                break
    return pairs


def _items(t: str) -> set[int]:
    """Starts of the lines that open a list item."""
    levels: list[list] = []  # from the outermost: indent, kind of marker, number of its last item, start of its first
    items: set[int] = set()
    for m in _MARKER.finditer(t):
        indent, bullet, dash, bracket, number, mark, letter = m.groups()
        kind = bullet or dash or (bracket or "") + ("a)" if letter else "1" + mark)
        at = int(number) if number else ord(letter) if letter else None
        deep = len(indent.expandtabs(4))
        while levels and levels[-1][0] > deep:
            levels.pop()
        if levels and levels[-1][0] == deep:
            if levels[-1][1] == kind and (at is None or at == levels[-1][2] + 1):
                levels[-1][2] = at
                items |= {levels[-1][3], m.start()}
                continue
            levels.pop()
        levels.append([deep, kind, at, m.start()])
        if bullet or kind == "1)":
            items.add(m.start())
    return items


def _starts(t: str, i: int) -> str:
    """What stands at i: '' end, 'u' start of a sentence, 'l' lower case, 'n' digit, 'c' caseless letter, 'p' other."""
    while i < len(t) and (t[i] in "\"'“„«‘‚‹([{¿¡（" or t[i].isspace()):
        i += 1
    if i >= len(t):
        return ""
    c = t[i]
    if c.islower():
        # 'the' begins sentences that were written in lower case; a name like 'iPhone' counts as a capital
        return "u" if (t[i + 1 : i + 2].isupper() or t.startswith("the ", i)) else "l"
    if c.isupper() or c.istitle():
        return "u"
    if c.isdigit():
        return "n"
    return "c" if _CASELESS.match(c) else "p"


def _stop_ends(t: str, start: int, i: int, j: int, after: int) -> bool:
    """Whether the single full stop t[i:j] ends the sentence that began at ``start``; ``after`` is past closers and emoji."""
    nxt = _NEXT.match(t, after).end()
    if nxt >= len(t) or after > j and t[j:after].strip():
        return True
    k = i
    while k > start and not t[k - 1].isspace():
        k -= 1
    word = t[k:i].lstrip("\"'“„«‘‚‹([{¿¡（")
    if nxt == after:  # no blank behind it
        c = t[nxt]
        if c.isdigit() or c.islower() or c in ",;:-–—/@_%)":
            return False
        if c.isupper():
            whole = len(word) >= 2 and word[-2:].isalnum() and not word[-1].isupper() and not any(x in word for x in "@/_\\")
            return whole and not _in(_LEAD, t, start, i) and (nxt + 1 >= len(t) or not t[nxt + 1].isupper() or t[nxt + 1].isspace() or t[nxt + 1] == ".")
        return bool(_CASELESS.match(c)) and not word.endswith("@")
    kind = _starts(t, nxt)
    if t[nxt] in ",;:":
        return False
    bare = word.rstrip(".")
    if regex.fullmatch(r"\d+(?:[.,]\d{3})*", bare):
        if k == start and len(bare) <= 3:
            return False  # the number of a list item
        before = t[start:k].split()[-1:] or [""]
        if kind in "ul" and before[0].lower() in (_ARTICLES if len(bare) <= 2 else {"der", "die", "das", "den", "dem", "des"}):
            return False  # an ordinal: 'am 3. März'
        if len(bare) <= 2 and (regex.match(r"\d{1,2}\.\s*(?:\d{1,2}\.\s*)?\p{Hangul}", t[nxt:]) or regex.match(r"(?:에|에서|까지|부터|은|는|이|가|을|를|의)\s", t[nxt:])):
            return False  # a date: '10. 10. 에'
        return True
    if not bare:
        return True
    street = bare in ("St", "st", "Str")
    if street:
        before = t[start:k].split()[-1:] or [""]
        return before[0][:1].isupper() and before[0][-1:].isalnum() and len(t[start:k].split()) > 1 and kind in "unc"
    if _in(_NUMBER, t, start, i) and (kind == "n" or t[nxt] in "-−" or len(bare) == 1):
        return False
    if _in(_LEAD, t, start, i):
        return False
    if bare.lower() in ("a.m", "p.m", "am", "pm"):
        following = regex.match(r"\p{L}+", t[nxt:])
        return kind in "un" and not (following and following.group().lower() in _DAYS) or kind == "c"
    if _in(_END, t, start, i) or regex.fullmatch(r"\p{L}(?:\.\p{L})+", bare):
        return kind in "unc" or kind == "p"
    if len(bare) == 1 and bare.isalpha() and not _CASELESS.match(bare):
        return not (kind == "u" or bare.islower())  # an initial
    return True


def _ends(t: str) -> Iterator[int]:
    """End offsets of the sentences of one paragraph, the last one left out."""
    pairs, items = _paired(t), _items(t)
    start, pos = _NEXT.match(t, 0).end(), 0
    while m := _EVENT.search(t, pos):
        i, j = m.span()
        c = t[i]
        pos = j
        if c in "\"'" or c in _PAIRS:
            if i not in pairs:
                continue
            q = pairs[i]
            alone = not t[start:i].strip()
            k = q
            while k > i + 1 and (t[k - 1].isspace() or t[k - 1] in _CLOSERS or unicodedata.category(t[k - 1]) == "Cf"):
                k -= 1
            finished = t[k - 1] in _STOPS and k - 1 > i
            pos = q + 1
            if not finished:
                continue
            while pos < len(t) and t[pos] in _CLOSERS and pos not in pairs:
                pos += 1
            after = _TAIL.match(t, pos).end()
            nxt = _NEXT.match(t, after).end()
            if nxt >= len(t):
                return
            kind = _starts(t, nxt)
            if after == pos and (t[nxt] in ",;:，、；：—–-" or t[nxt] in _STOPS or (kind == "l")):
                continue
            if c in _BRACKETS:
                if not alone and kind != "u":
                    continue
            elif kind == "c" and after == pos:
                led = t[start:i].rstrip()[-1:] in (":", "：")
                if _SPEECH.match(t, nxt) and not led:
                    continue
                if not alone and not led and not _CASELESS.match(t[i - 1 : i] or " ") and not t[i - 1 : i].isspace():
                    continue
            yield after
            start = pos = nxt
            continue
        if c.isspace():
            if items and any(p in items for p in range(i + 1, j + 1)):
                if t[start:i].strip():
                    yield i
                start = _NEXT.match(t, i).end()
                continue
            if not (i and "฀" <= t[i - 1] <= "๿"):
                continue
            # Thai: a blank between letters parts sentences, beside a number it does not
            after = _TAIL.match(t, i).end()
            nxt = _NEXT.match(t, after).end()
            if nxt < len(t) and t[nxt] not in "ๆฯ" and (t[nxt].isalpha() or "เ" <= t[nxt] <= "ไ" or (t[nxt] in "\"“«(「" and nxt in pairs)):
                yield after
                start = pos = nxt
            elif nxt < len(t) and after > i:
                yield after
                start = pos = nxt
            continue
        run = t[i:j]
        after = j
        while after < len(t) and t[after] in _CLOSERS and after not in pairs and (t[after] not in "\"'" or after + 1 >= len(t) or not t[after + 1].isalnum()):
            after += 1
        quoted, after = after, _TAIL.match(t, after).end()
        nxt = _NEXT.match(t, after).end()
        if nxt >= len(t):
            return
        kind = _starts(t, nxt)
        if run in ".．":
            end = _stop_ends(t, start, i, j, after)
        elif after > quoted:
            end = True
        elif t[nxt] in ",;，、；" and nxt == after:
            end = False
        elif not set(run) - set(".…‥．"):
            end = kind in "un" or (kind in "cp" and nxt > after)
        elif run[-1] in _FULL:
            end = not (run == "。" and nxt == after and t[nxt] in "のをが")
        elif kind == "l":
            end = nxt > after and not (len(t[start:i].split()) == 1 and set(run) == {"!"})
        else:
            end = nxt > after or kind in "uc" or t[nxt] in "\"“«„(（「"
        if end:
            yield after
            start = pos = nxt
        else:
            pos = max(j, quoted)


def sentence_ends(text: str | None, kind: str | None = None) -> list[int]:
    """For each sentence the number of code points up to and including its last visible character.

    Null, empty and blank texts have none.  A text of kind 'record' is one sentence.
    """
    if not text:
        return []

    def seen(start: int, end: int) -> int:
        while end > start and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("Cf", "Cc", "Zs", "Zl", "Zp")):
            end -= 1
        return end

    out: list[int] = []
    at = 0
    edges = [] if kind == "record" else [m.span() for m in _BLANK_LINE.finditer(text)]
    for a, b in [*edges, (len(text), len(text))]:
        para, begin = text[at:a], at
        for end in [] if kind == "record" else _ends(para):
            if (e := seen(begin, at + end)) > begin and (not out or e > out[-1]):
                out.append(e)
                begin = at + end
        if (e := seen(begin, a)) > begin:
            out.append(e)
        at = b
    return out


def sentences(docs: DataFrame, id_col: str, text: str, kind: str | None = None) -> DataFrame:
    """(doc_id, sent_no, start_pos, end_pos): the sentences of every document in order, offsets in code points.

    start_pos is the end of the sentence before (0 for the first).  Documents without a sentence have no row; a repeated
    row gives its sentences again.
    """
    what: Column = F.col(kind).cast("string") if kind else F.lit(None).cast("string")
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"), what.alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [sentence_ends(t, k) for t, k in zip(batch["text"].to_pylist(), batch["kind"].to_pylist())]
            n = np.array([len(e) for e in ends], dtype=np.int64)
            end = np.fromiter((x for e in ends for x in e), dtype=np.int32, count=int(n.sum()))
            first = np.cumsum(n) - n
            no = np.arange(len(end)) - np.repeat(first, n)
            start = np.where(no > 0, np.r_[0, end[:-1]] if len(end) else end, 0)
            doc = batch["doc_id"].take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([doc, pa.array(no.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end)], ["doc_id", "sent_no", "start_pos", "end_pos"])

    id_type = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {id_type}, sent_no int, start_pos int, end_pos int")
