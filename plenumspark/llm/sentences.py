"""Sentence boundaries across languages and scripts by semi-Markov dynamic programming."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from functools import lru_cache
from types import MappingProxyType

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenumspark.session import checkpointed, spread

# Words of the languages. An abbreviation is written without its last full stop.
#: Abbreviations that are followed by more of the sentence.
INNER = set(
    "bl.a bl t.ex ex f.n f.d st.f s.k resp p.g.a fr.o.m t.o.m d.v.s dvs kl prop mom st kap nr hr fr jfr ang s fig tab ca ev inkl exkl sk tel dir prof dr doc lic "  # Swedish
    "mr mrs ms hon vs i.e e.g cf sec no jan feb mar apr jun jul aug sep sept oct nov dec p.m a.m rev gen col capt sen rep gov st vol ch pp ed art "  # English
    "z d z.b d.h vgl mio mrd bzw abs ggf evtl inkl hrsg usf u.a s.o s.u nr str "  # German
    "pct hr fru jf f.eks repr mill kr kap bl.a ifm mht dvs "  # Danish, Norwegian
    "esim ks ed n klo mm vrt toim puh "  # Finnish
    "sr sra srta dra mme mlle dott dhr mevr bijv blz np tzn p.ex p.ej núm pág avda "  # Spanish, French, Italian, Dutch, Polish, Portuguese
    "κ π.μ μ.μ σ αρ βλ π.χ άρθ د أ م ص พ.ศ ค.ศ डॉ श्री प्रो पृ".split()  # Greek, Arabic, Thai, Hindi
)
#: Abbreviations that may end a sentence.
FINAL = set("m.fl m.m osv o.s.v e.d o.d etc o.dyl dyl usw u.s.w ym jne yms mv m.v osv o.l o.a m.v κ.λπ κλπ κ.ά pct p.m a.m π.μ μ.μ kr mill inc ltd".split())
#: The last part of a spaced abbreviation that may end a sentence, by the part before it.
FINAL_AFTER = {("m", "m"), ("m", "fl"), ("s", "v"), ("o", "d"), ("e", "d"), ("o", "l"), ("u", "a"), ("u", "m"), ("a", "m")}
#: Words of one letter that can end a sentence.
LETTER_WORDS = set("i å ö".split())
#: Words after which a number is a reference and can end a sentence.
NUMBERED = set("no nr nr. s § art abs kap st mom prop år sec p s. sid page seite kohta artikel punkt paragraf kr ca ks vgl cf n".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember januari februari mars maj augusti december march may june july october january february marts oktober desember".split())
GERMAN = re.compile(r"\b(?:der|die|das|und|nicht|ist|eine?|wird|auch|vom|nach|am)\b")
#: Words of clauses that report speech.
REPORTING = re.compile(
    r"\b(?:said|asked|replied|answered|added|told|cried|sade|säger|frågade|frågar|svarade|svarar|löd|utropade|sagde|spurgte|svarede|sa|spurte|svarte|rief|sagte|fragte|antwortete|meinte|sanoi|kysyi|vastasi|huusi|ρώτησε|είπε|απάντησε)\b"
    r"|问|问道|说|答|表示|回应|喊|と|尋ね|述べ|कहा|पूछा|बोले|قال|سأل|أجاب|ถาม|กล่าว"
)
PARTICLES = "ครับ ค่ะ คะ นะคะ ครับผม จ้ะ".split()

_PARAGRAPH = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85 ])[^\S\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85 ])| ")
_PAIRED = re.compile(r"[“”„\"«»「」『』()（）\[\]《》]")
_BRACKETS = {")": "(", "）": "（", "]": "[", "」": "「", "』": "『", "》": "《"}
#: Which quotation marks can close one that is open.
_CLOSES = {"“": "”\"", "”": "”", "„": "“”\"", '"': '"', "«": "»", "»": "«"}
_END = re.compile(r"[.!?…।؟。！？｡]+(?:[!?。！？])*|(?<=[Ͱ-Ͽἀ-῿]);|;|(?:" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + r")(?=\s|$|[”\"」])")
#: A sentence that ended without a space before this token ("pct.Kl").
_JOINED = re.compile(r"^\S*[a-zåäöéæø]{2}\.(?=[A-ZÅÄÖ])")
_NEXT_WORD = re.compile(r"\w+")
_LAST_WORD = re.compile(r"[^\W_]+")
_LIST_MARK = re.compile(r"(?:§\s*)?(?:\d{1,3}|[A-Za-zÅÄÖåäö]|[IVXLC]{1,6})\Z")
_MARK_ONLY = re.compile(r"\s*(?:§\s*)?(?:\d{1,3}|\w|[IVXLC]{1,6})[.)]?\s*\Z")
_LETTER_ITEM = re.compile(r"[a-zåäö]\)\s")
_CJK = re.compile(r"[぀-ヿ㐀-鿿＀-￯]")
_NEXT_CLAUSE = re.compile(r"[^.!?…।؟。！？“”„\"«»「」\n]*")
_THAI_SPACE = re.compile(r"(?<=[\u0e01-\u0e4e]) +(?=[\u0e01-\u0e4e])")
_DELIMITER = re.compile(r"[\s()\[\]“”„\"«»「」（）,;:!?…–—/]")
#: Words that hardly close a sentence: articles and conjunctions.
UNCLOSING = set("och samt eller the an and or of und oder dem des el los las les et du og ja και και ο η το".split()) - {"ja"}
#: No word of the lists is longer; a longer token is none of them.
LONGEST = max(len(w) for w in INNER | FINAL)

NEVER = -1e9
#: What a span loses for each end of it that lies within a quotation or bracket.
BROKEN = 10.0
#: The score of a place between statements of a script without marks, where the paragraph has none at all.
UNMARKED = 1.0


@lru_cache(maxsize=2)
def _pairs(p: str) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """(close -> open, outermost pairs in order) of the quotation marks and brackets that have a partner."""
    stack: list[tuple[str, int]] = []
    closes: dict[int, int] = {}
    for m in _PAIRED.finditer(p):
        c, at = m.group(), m.start()
        if c in "([（「『《":
            stack.append((c, at))
            continue
        opener = _BRACKETS.get(c)
        if opener is not None:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == opener), None)
        else:
            before = p[at - 1] if at else " "
            k = next((k for k in range(len(stack) - 1, -1, -1) if c in _CLOSES.get(stack[k][0], "")), None)
            if k is not None and c in "”\"" and stack[k][0] == c and before.isspace() and at + 1 < len(p) and not p[at + 1].isspace():
                # The mark opens again: the one before never closed.
                stack = stack[:k]
                k = None
            if k is None:
                stack.append((c, at))
                continue
        if k is not None:
            closes[at] = stack[k][1]
            stack = stack[:k]
    outer: list[tuple[int, int]] = []
    for close in sorted(closes):
        while outer and outer[-1][0] > closes[close]:
            outer.pop()
        outer.append((closes[close], close))
    return closes, outer


def _token_start(p: str, at: int, delimiters: list[int]) -> int:
    """Where the token that ends at `at` begins; `delimiters` are the places of all delimiters of the paragraph."""
    k = bisect_left(delimiters, at)
    return delimiters[k - 1] + 1 if k else 0


def _word_before(p: str, start: int) -> str:
    """The word before white space that ends at `start`, '' if there is none."""
    e = start
    while e and p[e - 1].isspace():
        e -= 1
    k = e
    while k and not p[k - 1].isspace():
        k -= 1
    return p[k:e] if e < start else ""


def _strength(p: str, at: int, end: int, mark: str, german: bool, begin: int, learned: Mapping[str, float]) -> tuple[float, float, int]:
    """Log odds that a sentence ends at `end`: in general, and if its span starts at the place given third.

    `at` is where the mark begins and `begin` where the token before it does; closers lie between the mark and `end`.
    """
    n = len(p)
    nxt = end
    while nxt < n and p[nxt].isspace():
        nxt += 1
    if nxt >= n:
        return 6.0, 6.0, -1
    following = p[nxt]
    spaced = nxt > end
    if mark[0] in "ครัค":  # a Thai particle
        return 5.0, 5.0, -1
    wide = mark[0] in "。！？｡।" or (mark[0] == "…" and (_CJK.match(following) is not None or following in "“「"))
    if following in ",;:，、；：)]」』）»" and not spaced:
        return NEVER, NEVER, -1
    if following in ",，、":
        return NEVER, NEVER, -1
    if following.islower() and spaced and _LETTER_ITEM.match(p, nxt) and not (mark == "." and at - begin <= LONGEST and p[begin:at].lower() in INNER - FINAL):
        return 4.0, 4.0, -1
    if following.islower() or (not spaced and end > at + len(mark) and following in "とをがはのにでもっや"):
        return NEVER, NEVER, -1
    if not spaced and not wide:
        # No space: only where a letter is joined to a capital ("pct.Kl.") or another script begins.
        if mark == "." and following.isupper() and at >= 2 and p[at - 1].islower() and p[at - 2].isalpha() and nxt + 1 < n and (p[nxt + 1].islower() or p[nxt + 1] == "."):
            low = p[begin:at].lower() if at - begin <= LONGEST else None
            if p.rfind(".", begin, at) < 0 and low != "f" and (low is None or low not in INNER):
                return 1.5, 1.5, -1
            return (1.5, 1.5, -1) if low in FINAL else (NEVER, NEVER, -1)
        if mark[0] in "!?؟" and (following.isalpha() or following in "“”„«»「"):
            return 3.0, 3.0, -1
        if mark == "." and _CJK.match(following):
            return 3.0, 3.0, -1
        if p[end - 1] in "”»“」)" and (following.isupper() or following in "“„«»「”"):
            return 2.0, 2.0, -1
        return NEVER, NEVER, -1
    if mark != ".":
        return 4.5, 4.5, -1
    token = _JOINED.sub("", p[begin:at])
    start = at - len(token)
    low = token.lower()
    marked = start
    if start >= 1 and (p[start - 1] == "§" or p[start - 1].isspace()):
        k = p.rfind("§", max(0, start - 2), start)
        marked = k if k >= 0 else start
    if end > at + 1:  # closers after the full stop: the token is no abbreviation
        return 4.5, 4.5, -1
    if low.isdigit():
        if len(low) >= 3:
            return 4.0, -12.0 if len(low) == 3 else 4.0, marked
        before = _word_before(p, start).lower()
        nw = _NEXT_WORD.match(p, nxt)
        if before.rstrip(".") in NUMBERED or before in ("§",) or before.endswith("§"):
            return 4.0, -12.0, marked
        if nw and nw.group().lower() in MONTHS:
            return -8.0, -12.0, marked
        if german and following.isalpha():
            return -6.0, -12.0, marked
        return 0.5, -12.0, marked
    if low in FINAL and (low not in INNER or not following.isdigit() or low == "pct"):
        return 3.5, 3.5, -1
    if len(low) <= 2 and low:
        before = _word_before(p, start).lower().rstrip(".")
        if (before, low) in FINAL_AFTER:
            return 3.0, 3.0, -1
    if low in INNER:
        return -12.0, -12.0, -1
    if token in LETTER_WORDS:
        return 3.0, -12.0, marked
    if len(token) == 1 and token.isalpha():
        return -12.0, -12.0, marked
    if re.fullmatch(r"[IVXLC]{2,6}", token):
        return 1.0, -12.0, marked
    if "." in low and re.fullmatch(r"(?:\w{1,2}\.)+\w{1,3}", low) and not re.search(r"\d", low):
        return -1.0, -1.0, -1
    if low in learned:
        return learned[low], learned[low], -1
    if following.isdigit():
        return 3.0, 3.0, -1
    return 4.5, 4.5, -1


def _candidates(p: str, learned: Mapping[str, float] = MappingProxyType({})) -> list[tuple[int, float, float, int, int]]:
    """(end, strength, strength if the span starts at `anchor`, anchor, next start) of every place a sentence may end; the last is the paragraph's end."""
    closes, outer = _pairs(p)
    german = bool(GERMAN.search(p))
    delimiters = [m.start() for m in _DELIMITER.finditer(p)]
    out = []
    k = 0
    n = len(p)
    marked = False
    for m in _END.finditer(p):
        marked = True
        at, end = m.span()
        while k < len(outer) and outer[k][1] < at:
            k += 1
        anchor = -1
        quote = -1
        inside = False
        if k < len(outer) and outer[k][0] < at:
            # Within a quotation or bracket the mark right before its close can end the sentence around it; any other breaks it.
            inside = end != outer[k][1] and not all(c in closes for c in range(end, outer[k][1]))
            if not inside:
                quote = outer[k][0]
                end = outer[k][1] + 1
        while end < n and end in closes and not inside:
            quote = closes[end] if quote < 0 else quote
            end += 1
        general, special, anchor = _strength(p, at, end, m.group(), german, _token_start(p, at, delimiters), learned)
        if quote >= 0 and general > NEVER:
            nxt = end
            while nxt < n and p[nxt].isspace():
                nxt += 1
            clause = _NEXT_CLAUSE.match(p, nxt).group() if nxt < n else ""
            if p[quote] in "([（《":
                special = -3.0 if general < 0 else general
            else:
                # A quotation that opens the sentence goes on if a clause reports it.
                special = -5.0 if clause and REPORTING.search(clause) else general - 0.5
                anchor = quote
        if general <= NEVER:
            continue
        nxt = end
        while nxt < n and p[nxt].isspace():
            nxt += 1
        out.append((end, general, special, anchor, nxt))
    if not marked:
        out = [(m.start(), UNMARKED, UNMARKED, -1, m.end()) for m in _THAI_SPACE.finditer(p)]
    if not out or out[-1][0] < n:
        out.append((n, 6.0, 6.0, -1, n))
    return out


def _broken(p: str, at: int) -> bool:
    """Whether the place lies within a quotation or bracket."""
    outer = _pairs(p)[1]
    if not outer:
        return False
    k = bisect_left(outer, (at, -1))
    return k > 0 and at <= outer[k - 1][1]


def _opening(p: str, a: int) -> float:
    first = p[a]
    score = -2.0 if first.islower() else -4.0 if first in ",;:)]»" else 0.0
    return score - BROKEN if _broken(p, a) else score


def _closing(p: str, b: int) -> float:
    e = b
    while e and not p[e - 1].isalnum():
        e -= 1
    k = e
    while k and p[k - 1].isalpha() and e - k <= LONGEST:
        k -= 1
    score = -1.5 if p[k:e].lower() in UNCLOSING else 0.0
    return score - BROKEN if b < len(p) and _broken(p, b) else score


def _length(p: str, a: int, b: int) -> float:
    length = b - a
    score = -0.3 * abs(math.log((length + 1) / 80))
    return score - 15.0 if length < 9 and _MARK_ONLY.match(p[a:b]) else score


def _span_score(p: str, a: int, b: int) -> float:
    """How much p[a:b] looks like a sentence by itself: its length, opening and closing words, and quotations that stay whole."""
    return _length(p, a, b) + _opening(p, a) + _closing(p, b)


def sentence_spans(text: str | None, learned: Mapping[str, float] = MappingProxyType({})) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in code points, without outer white space."""
    if not text or text.isspace():
        return []
    out = []
    at = 0
    pieces = []
    for m in _PARAGRAPH.finditer(text):
        if m.start() >= at:
            pieces.append((at, m.start()))
        at = m.end()
    pieces.append((at, len(text)))
    for a, b in pieces:
        p = text[a:b]
        lead = len(p) - len(p.lstrip())
        p = p.strip()
        if p:
            out += [(a + lead + s, a + lead + e) for s, e in _best_path(p, learned)]
    return out


def _best_path(p: str, learned: Mapping[str, float] = MappingProxyType({})) -> list[tuple[int, int]]:
    """The best segmentation of a stripped paragraph.

    A span from i to j earns its own score, the strength of its end, and loses the strengths of the
    places within it where it did not end. With running sums of strengths a span from start i is worth
    worth[i] + its length's score, less a sum that is the same for all starts, but for the places anchored
    at i. A start that even with all its anchors and the best length stays below another one with none and
    the worst length is below it at every later place: it is dropped, and the maximum stays exact.
    """
    c = _candidates(p, learned)
    if len(c) == 1:
        return [(0, len(p))]
    starts = [0] + [x[4] for x in c]
    index = {a: i for i, a in enumerate(starts[:-1])}
    rise = [0.0] * len(starts)
    fall = [0.0] * len(starts)
    for _, general, special, anchor, _ in c:
        i = index.get(anchor)
        if i is not None:
            rise[i] += max(0.0, general - special)
            fall[i] += min(0.0, general - special)
    worst = -0.3 * max(math.log((len(p) + 1) / 80), math.log(80)) - 15.0
    best = [0.0] * (len(c) + 1)
    back = [0] * (len(c) + 1)
    worth = [_opening(p, 0)]
    extra = [0.0] * len(starts)
    active = [0]
    lost = 0.0
    for j in range(1, len(c) + 1):
        end, general, special, anchor, _ = c[j - 1]
        top, arg = -math.inf, j - 1
        close = _closing(p, end)
        for i in reversed(active):
            a = starts[i]
            s = worth[i] - lost + extra[i] + (special if anchor == a else general) + close + _length(p, a, end)
            if s > top:
                top, arg = s, i
        best[j], back[j] = top, arg
        lost += general
        i = index.get(anchor)
        if i is not None:
            extra[i] += general - special
        if j < len(c):
            worth.append(top + lost + _opening(p, starts[j]))
            active.append(j)
            floor = max(worth[i] + fall[i] for i in active) + worst
            active = [i for i in active if worth[i] + rise[i] >= floor]
    out = []
    j = len(c)
    while j > 0:
        i = back[j]
        out.append((starts[i], c[j - 1][0]))
        j = i
    return out[::-1]


def learned_abbreviations(documents: DataFrame, inner: float = 0.6, share: float = 1e-5, least: int = 10) -> dict[str, float]:
    """Short words that all documents show to be abbreviations, with the score of a sentence's end after one.

    A word with a full stop of which at least the share `inner` is followed by a small letter or digit is
    one; the score is three times the log odds of the rest. Each makes up at least `share` of all such words and occurs `least`
    times, so no more than 1 / `share` reach the driver. One pass in the JVM, counts combined before the shuffle.
    """
    found = documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\d.])(\p{L}{1,6}\. +[^\s])"), F.lit(1))).alias("x"))
    word = F.lower(F.split_part("x", F.lit("."), F.lit(1)))
    counts = found.groupBy(word.alias("word"), F.substring("x", -1, 1).rlike(r"[\p{Ll}\d]").alias("is_inner")).agg(F.count("*").alias("n"))
    counts = checkpointed(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_inner"), F.col("n")).otherwise(0)).alias("n_inner")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") >= max(least, total * share)) & (F.col("n_inner") >= F.col("n") * inner)).collect()
    return {r["word"]: 3.0 * math.log((r["n"] - r["n_inner"] + 1) / (r["n_inner"] + 1)) for r in sorted(rows)}


def _split(batches: Iterator[pd.DataFrame], learned: Mapping[str, float]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, numbers, starts, ends = [], [], [], []
        for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
            spans = sentence_spans(text, learned)
            ids += [doc] * len(spans)
            numbers += range(1, len(spans) + 1)
            starts += [s for s, _ in spans]
            ends += [e for _, e in spans]
            if len(ids) > 50_000:
                yield pd.DataFrame({"doc_id": ids, "sent_no": numbers, "start_char": starts, "end_char": ends})
                ids, numbers, starts, ends = [], [], [], []
        yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "sent_no": pd.Series(numbers, dtype="int32"), "start_char": pd.Series(starts, dtype="int32"), "end_char": pd.Series(ends, dtype="int32")})


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_no, start_char, end_char): the sentences of every document, numbered from 1, no shuffle.

    Offsets count code points from 0, the end is exclusive, outer white space is left out. Blank lines
    always end a sentence, single line breaks never. Abbreviations are learned from all documents beside the lists. Null and blank texts have none; rows without doc_id
    are left out; a doc_id in two rows gives both rows' sentences.
    """
    documents = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    learned = learned_abbreviations(documents)
    return spread(documents).mapInPandas(lambda batches: _split(batches, learned), "doc_id long, sent_no int, start_char int, end_char int")
