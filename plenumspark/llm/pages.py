"""Text of scanned pages into continuous paragraphs: furniture, broken words, misread characters."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache
from types import MappingProxyType
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenumspark.session import bounded_broadcast, checkpointed, spread

# Words of running headers, and what page recognition makes of characters (read: printed).
WEEKDAYS = "måndagen tisdagen onsdagen torsdagen fredagen lördagen söndagen".split()
MONTHS = "januari februari mars april maj juni juli augusti september oktober november december".split()
MISREAD = {
    "rn": "m", "c": "e", "e": "c", "u": "n", "n": "u", "ſ": "f", "lc": "k", "cl": "d", "q": "g", "a": "åä", "o": "ö", "y": "v", "v": "y",
    "0": "oö", "1": "li", "5": "s", "6": "öb", "8": "b", "9": "g", "l": "i", "i": "l", "ii": "ä", "&": "å", "t": "f", "b": "h", "h": "b",
}
#: One character read for two printed ones.
MERGED = {"m": "rn", "d": "ti"}
#: Characters and pairs to the one that stands for all they are mixed up with.
_PAIRS = re.compile("rn|lc|cl|ii")
_PAIR_TO = {"rn": "m", "lc": "k", "cl": "d", "ii": "a"}
_SINGLE = str.maketrans({"c": "e", "u": "n", "ſ": "f", "q": "g", "å": "a", "ä": "a", "&": "a", "ö": "o", "y": "v", "h": "b", "0": "o", "1": "l", "i": "l", "5": "s", "6": "o", "8": "b", "9": "g"})

HYPHENS = "-‐\xad¬"
#: A frequent word makes up at least this share of all words, so there are at most 1 / SHARE of them.
SHARE = 1e-5
#: Rows of keys and fixes that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: A word is misread if one it can be mixed up with is so many times as frequent.
RATIO = 8

BODY, HEADER, NUMBER, BREAK = range(4)
_NEVER = -1e9
#: Log odds of one line kind after another, and of the first.
_TRANSITION = (
    (0.0, -1.2, -1.2, 0.0),
    (-0.2, -2.0, -0.3, -0.2),
    (-0.2, -0.3, -3.0, -0.2),
    (0.0, -0.9, -0.9, -0.5),
)
_START = (0.0, -1.0, -1.0, -0.5)

_D = r"[\dlIOoSg]"
_NUMBER_LINE = re.compile(rf"(?:[-–—] ?{_D}{{1,4}} ?[-–—]|\[{_D}{{1,4}}\]|{_D}{{1,3}}\.?|\d(?: \d){{1,3}}|{_D}{{1,4}} ?\*|[Ss][il1]d\.? ?{_D}{{1,4}}\.?)\Z")
_NUMBER_START = re.compile(r"[-–—\[\dlIOoSgs]")
_WORD = re.compile(r"[^\W_]+(?:&[^\W_]+)*")
_MARKS = r"\[[^\[\]\n]*\]|\{[^{}\n]*\}|<[^<>\n]*>|\(\([^()\n]*\)\)|\([^()\n]*\)|\*\w+\*|– \w+ –|\d\d:\d\d:\d\d|\dh\d\dm\d\ds|(?:[eöä]+h+m*|h+m+|m{2,})(?!\w),?"
_TRAILING = re.compile(rf"(?:\s+(?:{_MARKS}))+\s*\Z", re.I)
_LEADING = re.compile(rf"\s*(?:(?:{_MARKS})\s*)*", re.I)
_BREAK_END = re.compile(rf"[^\W_]([{HYPHENS}])\s*\Z")
_SUSPENDED = re.compile(r"(?:[o0][ce][hb]|e[l1]{2}er|sa(?:m|rn)t|respektive|resp\.)(?!\w)", re.I)
_WEEKDAY_START = re.compile(r"[MTOFLS]", re.I)
_TIME = re.compile(r"\d+h\d+m\d+s\Z")
_YEAR = re.compile(r"(?=.*\d)(?=.*[^\d])[1lIi2Z][\dlIioOSsgqBZ]{3}\Z")
#: The digits that the letters of a misread year stand for.
_DIGITS = str.maketrans("OolIiZSsBgq", "00111255899")


@lru_cache(maxsize=1 << 16)
def skeleton(word: str) -> str:
    """The word with all characters that are mixed up with each other made one."""
    return _PAIRS.sub(lambda m: _PAIR_TO[m.group()], word.lower().replace("u", "n")).translate(_SINGLE).replace("tl", "d")


def skeletons(word: str) -> list[str]:
    """All skeletons of a word whose pairs can be read in more than one way."""
    low = word.lower()
    if "lc" not in low and "cl" not in low:
        return [skeleton(low)]
    return sorted({skeleton(x) for x in (low, low.replace("lcl", "ld"), low.replace("lc", "k"), low.replace("c", "e"))})


def misread_at(read: str, printed: str) -> list[int] | None:
    """Where `read` has misread characters of `printed`; None if it can't be read for it."""
    best: dict[tuple[int, int], list[int]] = {(0, 0): []}
    for i in range(len(read) + 1):
        for j in range(len(printed) + 1):
            here = best.get((i, j))
            if here is None or i == len(read) or j == len(printed):
                continue
            steps = [(1, 1, [])] if read[i] == printed[j] else []
            for n in (1, 2):
                for to in MISREAD.get(read[i : i + n], ()) if n == 1 or i + 2 <= len(read) else ():
                    if printed.startswith(to, j):
                        steps.append((n, len(to), list(range(i, i + n))))
            if read[i] in MERGED and printed.startswith(MERGED[read[i]], j):
                steps.append((1, 2, [i]))
            for n, k, marks in steps:
                to = (i + n, j + k)
                if to not in best or len(best[to]) > len(here) + len(marks):
                    best[to] = here + marks
    return best.get((len(read), len(printed)))


_FW, _FM = {skeleton(w) for w in WEEKDAYS}, {skeleton(w) for w in MONTHS}
_FIRST = {skeleton(w) for w in ("nr", "ang", "om", "första", "andra", "kammaren", "kammarens", "sid", *WEEKDAYS)}
_HOUSE = {skeleton(w) for w in ("kammaren", "kammarens")}
_IS = {w: skeleton(w) for w in ("nr", "ang", "om", "protokoll", "den", "forts", "första", "andra")}
_LEAD_IN = re.compile(r"(?:§|\bnr|\bkap\.|\bst\.|\bmom\.|\bprop\.|\bår|\bden|\bkl\.|\bsedan|\bpunkt|\bart\.|\d)\Z")


def _date_line(words: list[str]) -> bool:
    w = list(words)
    if len(w) > 2 and w[0] == _IS["nr"]:
        w = w[2:]
    if len(w) > 2 and w[-2] == _IS["nr"]:
        w = w[:-2]
    return len(w) in (4, 5) and w[0] in _FW and w[1] == _IS["den"] and w[3] in _FM


def header_score(line: str) -> float:
    """Log odds that the line, by its own words, is a running header and no text."""
    words = [skeleton(w) for w in _WORD.findall(line)]
    if not words or words[0] not in _FIRST or len(words) > 9:
        return _NEVER
    if _date_line(words):
        return 9.0
    if _IS["protokoll"] in words[1:3] and (words[0] in _HOUSE or words[1] in _HOUSE):
        return 9.0
    ends = line[-1]
    if words[0] == _IS["ang"]:
        return 8.0 if words[-1] == _IS["forts"] else 4.0 if ends not in ".,;?!" and len(words) <= 6 else _NEVER
    if words[0] == _IS["om"] and 2 <= len(words) <= 6 and line[0] in "O0":
        return 3.5 if ends not in ".,;?!”" and ends not in HYPHENS else _NEVER
    return _NEVER


_ENDS = ".,;:?!…”\"" + HYPHENS
_FINISHED = ".?!”…"
_DIGIT = re.compile(r"\d+")
#: A layout key is learned from so many lines at least, and from this share of all of them, so there are at most 1 / SHARE.
LEAST_LINES = 20


def layout_keys(line: str) -> tuple[str, str]:
    """What a line shares with the same header on other pages: its words with numbers made one; and its first word."""
    words = [skeleton(w) if not w.isdigit() else "9" for w in _WORD.findall(_DIGIT.sub("9", line))]
    return "\0L" + " ".join(words), "\0F" + (words[0] if words else "")


def _stands_out(s: str, width: int) -> bool:
    """Whether a line by its form alone may be a header: short for the page, opened by a capital or number, and not closed as a sentence is."""
    return len(s) < 0.8 * width and (s[0].isupper() or s[0].isdigit()) and s[-1] not in _ENDS


def label_lines(lines: list[str], learned: Mapping[str, float] = MappingProxyType({})) -> list[int]:
    """The kind of each line (BODY, HEADER, NUMBER, BREAK): Viterbi's path of a hidden Markov model.

    Emissions are log odds of layout features against body text: what other pages show of lines like it
    (`learned`, by `layout_keys`), header words, number shapes, length against the page's width, the line's
    ends and its neighbours. Lines without a furniture feature can only be body or break, so a page without
    any is labelled at once.
    """
    n = len(lines)
    stripped = [x.strip() for x in lines]
    number = [_NEVER] * n
    header = [_NEVER] * n
    any_ = False
    widest = max(map(len, stripped))
    for i, s in enumerate(stripped):
        if s:
            if _NUMBER_START.match(s) and _NUMBER_LINE.match(s):
                number[i] = 5.0
                any_ = True
                continue
            first = _WORD.search(s)
            if first and skeleton(first.group()) in _FIRST:
                header[i] = header_score(s)
            if learned and _stands_out(s, widest):
                header[i] = max(header[i], *(learned.get(k, _NEVER) for k in layout_keys(s)))
            any_ = any_ or header[i] > _NEVER
    if not any_:
        return [BODY if s else BREAK for s in stripped]
    width = max(map(len, stripped))
    last, adjacent = "", False
    emissions = []
    for i, s in enumerate(stripped):
        if not s:
            emissions.append((_NEVER, _NEVER, _NEVER, 0.0))
            adjacent = False
            continue
        h, m = header[i], number[i]
        if h > _NEVER or m > _NEVER:
            following = next((x for x in stripped[i + 1 :] if x and not _NUMBER_LINE.match(x)), "")
            goes_on = bool(last) and last[-1] not in ".?!”…" and following[:1].islower()
            if m > _NEVER and adjacent and _LEAD_IN.search(last) and s[-1] == "." and s[0].isdigit() and not following[:1].isdigit():
                m = -2.0  # the number a line before asks for: "enligt §", "4."
            if m > _NEVER and n == 1:
                m = -1.0
            if h > _NEVER:
                h += 1.0 if goes_on else 0.0
                h += 0.5 if len(s) < 0.8 * width else -0.5
        adjacent = h < 0 and m < 0
        if adjacent:
            last = s
        emissions.append((0.0, h, m, _NEVER))
    score = [e + s for e, s in zip(emissions[0], _START)]
    back = []
    for e in emissions[1:]:
        step = [max(range(4), key=lambda a: score[a] + _TRANSITION[a][b]) for b in range(4)]
        score = [score[step[b]] + _TRANSITION[step[b]][b] + e[b] for b in range(4)]
        back.append(step)
    state = max(range(4), key=score.__getitem__)
    path = [state]
    for step in reversed(back):
        state = step[state]
        path.append(state)
    return path[::-1]


class Page(NamedTuple):
    """A parsed text; line indices from 0."""

    lines: list[str]
    kinds: list[int]
    #: Lines whose last word goes on in the next text line.
    split: list[int]
    #: (line, its words), without the parts of broken words.
    words: list[tuple[int, list[str]]]
    #: (word, line it begins in, letters there, line of the rest) of broken words.
    joined: list[tuple[str, int, int, int]]


def parse_page(data: str, learned: Mapping[str, float] = MappingProxyType({})) -> Page:
    lines = data.split("\n")
    kinds = label_lines(lines, learned)
    if len(lines) == 1:
        return Page(lines, kinds, [], [(0, _WORD.findall(data))] if kinds == [BODY] else [], [])
    body = [i for i, k in enumerate(kinds) if k == BODY]
    words: list[tuple[int, list[str]]] = []
    joined: list[tuple[str, int, int, int]] = []
    split: list[int] = []
    open_: tuple[str, int] | None = None
    last = len(body) - 1
    for at, i in enumerate(body):
        line = lines[i]
        found = _WORD.findall(line)
        if open_ is not None:
            m = _LEADING.match(line)
            skip = len(_WORD.findall(line[: m.end()])) if m.end() else 0
            if skip < len(found):
                joined.append((open_[0] + found[skip], open_[1], len(open_[0]), i))
                del found[skip]
            open_ = None
        if at < last:
            end = line.rstrip()
            if end[-1] not in HYPHENS and end[-1] in ")]}>*–shm,":
                end = _TRAILING.sub("", end)
            if end and end[-1] in HYPHENS and _BREAK_END.search(end):
                following = lines[body[at + 1]]
                first = following[:1]
                rest = following if first.islower() and first not in "eöähm" else following[_LEADING.match(following).end() :]
                first = rest[:1]
                if first and (first.islower() or first.isdigit()) and not _SUSPENDED.match(rest):
                    split.append(i)
                    tail = _WORD.findall(end)
                    if tail and tail[-1] in found:
                        where = len(found) - 1 - found[::-1].index(tail[-1])
                        del found[where]
                        open_ = (tail[-1], i)
        words.append((i, found))
    return Page(lines, kinds, split, words, joined)


def _layout(page: Page) -> Iterator[tuple[str, bool]]:
    """Of the lines that stand out: their layout keys, and whether they part a sentence that goes on, or stand beside a page number."""
    stripped = [x.strip() for x in page.lines]
    if len(stripped) < 2:
        return
    widest = max(map(len, stripped))
    for i, s in enumerate(stripped):
        if s and page.kinds[i] in (BODY, HEADER) and _stands_out(s, widest):
            before = next((k for k in range(i - 1, -1, -1) if page.kinds[k] == BODY), None)
            after = next((k for k in range(i + 1, len(stripped)) if page.kinds[k] == BODY), None)
            parts = before is not None and after is not None and stripped[before][-1] not in _FINISHED and stripped[after][0].islower()
            beside = NUMBER in page.kinds[max(0, i - 1) : i + 2]
            for key in layout_keys(s):
                yield key, parts or beside


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    layout: Counter[str] = Counter()
    for pdf in batches:
        for data in pdf["data"]:
            if data:
                page = parse_page(data)
                for _, words in page.words:
                    counts.update(words)
                for w in page.joined:
                    counts[w[0]] += 1
                for key, parts in _layout(page):
                    layout[key] += 1
                    layout["\0P" + key] += parts
        if len(counts) + len(layout) > 200_000:
            yield _lowered(counts, layout)
            counts.clear()
            layout.clear()
    yield _lowered(counts, layout)


def _lowered(counts: Counter[str], layout: Counter[str]) -> pd.DataFrame:
    low: Counter[str] = Counter(layout)
    for w, n in counts.items():
        if not w.isdigit() and not _TIME.match(w) and not _YEAR.match(w):
            low[w.lower()] += n
    return pd.DataFrame({"word": list(low), "n": list(low.values())}, columns=["word", "n"]).astype({"n": "int64"})


def page_counts(segments: DataFrame) -> DataFrame:
    """(word, n): the lower-case words of all text lines, broken ones joined, and the layout keys of lines that stand out (with "\\0" before); combined in each task before the shuffle."""
    return segments.select("data").mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_counts(segments: DataFrame) -> DataFrame:
    """(word, n): the words of `page_counts`."""
    return page_counts(segments).where(~F.col("word").startswith("\0"))


def learned_layout(counts: DataFrame) -> dict[str, float]:
    """The log odds that a line is a header, by layout key: how often lines of that key part a sentence or stand beside a page number, over all pages.

    Whole lines need half of their places to be such, first words alone four fifths. Keys of at least
    LEAST_LINES lines and the share SHARE of all such lines reach the driver, so at most 1 / SHARE do.
    """
    layout = counts.where(F.col("word").startswith("\0"))
    plain = layout.where(~F.col("word").startswith("\0P"))
    parting = layout.where(F.col("word").startswith("\0P")).select(F.expr("substring(word, 3)").alias("word"), F.col("n").alias("k"))
    total = plain.agg(F.sum("n")).first()[0] or 0
    needed = F.when(F.col("word").startswith("\0L"), 0.5).otherwise(0.8)
    rows = plain.where(F.col("n") >= max(LEAST_LINES, total * SHARE)).join(parting, "word").where(F.col("k") >= F.col("n") * needed).collect()
    return {r["word"]: min(8.0, 3.0 + math.log((r["k"] + 1) / (r["n"] - r["k"] + 1))) for r in sorted(rows)}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _skeletons(words: pd.Series) -> pd.Series:
    return words.map(skeletons)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _marks(read: pd.Series, printed: pd.Series) -> pd.Series:
    return pd.Series([misread_at(a, b) for a, b in zip(read, printed)])


def misread_words(counts: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, printed, at): words that are misread for one at least `ratio` times as frequent, and the places of the misread characters."""
    s = counts.where(F.length("word") > 1).withColumn("skeleton", F.explode(_skeletons("word")))
    top = s.groupBy("skeleton").agg(F.max_by("word", F.struct("n", "word")).alias("printed"), F.max("n").alias("most"), F.count("*").alias("forms")).where("forms > 1")
    pairs = s.join(top, "skeleton").where((F.col("word") != F.col("printed")) & (F.col("most") >= F.col("n") * ratio))
    return pairs.select("word", "n", "printed", _marks("word", "printed").alias("at")).where("at IS NOT NULL AND size(at) > 0").dropDuplicates(["word"])


@F.pandas_udf(T.BooleanType())
def _ruled(words: pd.Series) -> pd.Series:
    return words.map(lambda w: not _YEAR.match(w) and _by_rule(w) is not None)


def ruled_words(counts: DataFrame) -> DataFrame:
    """(word, printed): words with digits in them and the most frequent word of letters alone each can be misread for, however rare; else the word without them, if the corpus has it."""
    s = counts.where(F.length("word") > 1)
    wrong = s.where(F.col("word").rlike("[0-9]")).where(_ruled("word")).select("word")
    letters = s.where(~F.col("word").rlike("[^\\p{L}]")).select(F.col("word").alias("printed"), F.col("n").alias("most"))
    by_skeleton = letters.withColumn("skeleton", F.explode(_skeletons("printed"))).join(wrong.withColumn("skeleton", F.explode(_skeletons("word"))), "skeleton")
    alike = by_skeleton.withColumn("at", _marks("word", "printed")).where("at IS NOT NULL AND size(at) > 0").select("word", F.struct(F.lit(1).alias("rank"), "most", "printed").alias("best"))
    bare = letters.join(wrong.withColumn("printed", F.regexp_replace("word", "[^\\p{L}]", "")), "printed").select("word", F.struct(F.lit(0).alias("rank"), "most", "printed").alias("best"))
    return alike.unionByName(bare).groupBy("word").agg(F.max("best").alias("best")).select("word", "best.printed")


def _by_rule(word: str) -> list[int] | None:
    """Misread characters that show without a vocabulary: digits within a word, letters within a year."""
    if word.isalpha() or word.isdigit() or _TIME.match(word):
        return None
    if _YEAR.match(word):
        return [i for i, c in enumerate(word) if not c.isdigit()]
    if sum(map(str.isalpha, word)) >= 2:
        return [i for i, c in enumerate(word) if not c.isalpha()] or None
    return None


_FOUND = T.StructType([T.StructField("u_id", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("defect", T.StringType()), T.StructField("word", T.StringType()), T.StructField("cut", T.IntegerType()), T.StructField("rest", T.IntegerType())])


def _find(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    known, learned = shared.value
    verdicts: dict[str, list[int] | str] = {}
    good: set[str] = set()

    def verdict(w: str) -> list[int] | str | None:
        """Misread characters of a word, "rare" if only the join can tell, None if it is fine."""
        v = verdicts.get(w)
        if v is None:
            low = w.lower()
            v = known.get(low, ("rare", None))[0]
            if v == "rare" or v is None:
                v = _by_rule(w) or ("rare" if v == "rare" and len(low) > 1 and not w.isdigit() and not _TIME.match(w) else None)
            if v is None:
                if len(good) < 1_000_000:
                    good.add(w)
                return None
            if len(verdicts) < 1_000_000:
                verdicts[w] = v
        return v

    for pdf in batches:
        out = []
        for u, data in zip(pdf["u_id"], pdf["data"]):
            if not data:
                continue
            page = parse_page(data, learned)
            out += [(u, i + 1, "furniture", None, None, None) for i, k in enumerate(page.kinds) if k == HEADER or k == NUMBER]
            out += [(u, i + 1, "split", None, None, None) for i in page.split]
            glyph: set[int] = set()
            for i, words in page.words:
                for w in words:
                    if w not in good and (v := verdict(w)) is not None:
                        if v == "rare":
                            out.append((u, i + 1, "rare", w.lower(), len(w), 0))
                        else:
                            glyph.add(i)
            for w, i, cut, rest in page.joined:
                if w not in good and (v := verdict(w)) is not None:
                    if v == "rare":
                        out.append((u, i + 1, "rare", w.lower(), cut, rest + 1))
                    else:
                        glyph |= {i if at < cut else rest for at in v}
            out += [(u, i + 1, "glyph", None, None, None) for i in glyph]
        yield pd.DataFrame(out, columns=_FOUND.names)


def _statistics(segments: DataFrame):
    """(counts, misread words, broadcast of frequent words with (places, printed form) and of the learned layout), of all segments in one pass."""
    counts = checkpointed(page_counts(segments))
    learned = learned_layout(counts)
    words = counts.where(~F.col("word").startswith("\0"))
    misread = checkpointed(misread_words(words))
    total = words.agg(F.sum("n")).first()[0] or 0
    # At most 1 / SHARE words can each make up that share of the text: the broadcast is bounded.
    frequent = words.where(F.col("n") >= max(1.0, total * SHARE)).join(misread.select("word", "at", "printed"), "word", "left").select("word", "at", "printed").collect()
    known = {r["word"]: (r["at"], r["printed"]) for r in frequent}
    return words, misread, segments.sparkSession.sparkContext.broadcast((known, learned))


def line_defects(segments: DataFrame) -> DataFrame:
    """(u_id, line_no, defect): furniture, split and glyph lines of the scanned pages in `data`.

    Lines are counted from 1, blank ones too. A hidden Markov model labels them by layout; words broken
    at a line's end are joined over furniture; a word is misread if it can be mixed up with a far more
    frequent one of the whole corpus, or has digits or letters that can't be. Frequent words are known to
    every task, rare ones are looked up in one join. Null and blank texts have no lines to report;
    repeated rows count once; null u_id rows are reported under null.
    """
    segments = spread(segments.select("u_id", "data"))
    _, misread, shared = _statistics(segments)
    found = segments.mapInPandas(lambda it: _find(it, shared), _FOUND)
    nothing = F.concat(F.lit("\0"), F.pmod(F.xxhash64("u_id", "line_no"), F.lit(997)).cast("string"))
    keyed = found.withColumn("k", F.coalesce("word", nothing))
    joined = keyed.join(misread.select(F.col("word").alias("k"), "at"), "k", "left").where("defect <> 'rare' OR at IS NOT NULL")
    lines = F.when(F.col("defect") != "rare", F.array("line_no")).otherwise(F.transform("at", lambda i: F.when((F.col("rest") <= 0) | (i < F.col("cut")), F.col("line_no")).otherwise(F.col("rest"))))
    return joined.select("u_id", F.explode(lines).alias("line_no"), F.when(F.col("defect") == "rare", "glyph").otherwise(F.col("defect")).alias("defect")).distinct()


def assembled(page: Page) -> list[str]:
    """The paragraphs of a page as read: furniture gone, broken words joined."""
    lines, kinds = page.lines, page.kinds
    split = set(page.split)
    paragraphs: list[str] = []
    current: list[str] = []
    glue = False
    previous_kind = BREAK
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        if kind in (HEADER, NUMBER):
            previous_kind = kind
            continue
        if kind == BREAK:
            if not glue and current and previous_kind == BODY:
                paragraphs.append("".join(current))
                current = []
            continue
        previous_kind = BODY
        text = line.strip()
        if current and not glue:
            current.append(" ")
        glue = i in split
        current.append(text[:-1] if glue and text and text[-1] in HYPHENS else text)
    if current:
        paragraphs.append("".join(current))
    return paragraphs if len(lines) == 1 else [re.sub(r"\s+", " ", p) for p in paragraphs]


def _like(read: str, printed: str) -> str:
    """The printed word in the letter case of the one read."""
    return printed.upper() if read.isupper() and len(read) > 1 else printed[:1].upper() + printed[1:] if read[:1].isupper() else printed


def _draft(batches: Iterator[pd.DataFrame], shared, mend_years: bool) -> Iterator[pd.DataFrame]:
    """Paragraphs with the fixes of frequent words made, and the words only the join can tell."""
    known, learned = shared.value
    for pdf in batches:
        out = []
        for u, data in zip(pdf["u_id"], pdf["data"]):
            for no, p in enumerate(assembled(parse_page(data, learned)), 1):
                rare: set[str] = set()

                def fixed(m: re.Match, rare: set[str] = rare) -> str:
                    w = m.group()
                    low = w.lower()
                    if low in known:
                        at, printed = known[low]
                        if at is not None:
                            return _like(w, printed)
                        if w.isalpha():
                            return w
                    if w.isdigit() or len(w) == 1:
                        return w
                    if _YEAR.match(w):
                        return w.translate(_DIGITS) if mend_years else w
                    rare.add(low)
                    return w

                out.append((u, no, _WORD.sub(fixed, p), sorted(rare)))
        yield pd.DataFrame(out, columns=["u_id", "paragraph_no", "text", "rare"])


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series, fixes: pd.Series) -> pd.Series:
    out = []
    for text, pairs in zip(texts, fixes):
        to = dict(pairs)
        out.append(_WORD.sub(lambda m, to=to: _like(m.group(), to[low]) if (low := m.group().lower()) in to else m.group(), text))
    return pd.Series(out)


def _once(segments: DataFrame) -> DataFrame:
    """The segments without repeated rows. Only keys and fingerprints of the texts are shuffled; the texts of repeated keys alone are compared."""
    keyed = segments.withColumn("mark", F.xxhash64("data"))
    again = checkpointed(keyed.groupBy("u_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("u_id", "mark"))
    again = bounded_broadcast(again, MOST_BROADCAST)
    single = keyed.join(again, ["u_id", "mark"], "left_anti").select("u_id", "data")
    return single.unionByName(keyed.join(again, ["u_id", "mark"], "left_semi").select("u_id", "data").distinct())


def paragraphs(segments: DataFrame, mend_years: bool = False) -> DataFrame:
    """(u_id, paragraph_no, text): the repaired paragraphs of every segment, numbered from 1.

    Misread words get the printed form they are mixed up with; a word with digits in it, if none is so
    much more frequent, the most frequent one of letters. It stays as read only where the corpus has none,
    as an o can't be told from an ö then. Letters in years become digits with `mend_years`.

    Texts are parsed once to count and once to repair. Frequent words are repaired then and there; paragraphs
    with rare misread words get these from a join by paragraph, and whole texts are not shuffled while such
    paragraphs are no more than MOST_BROADCAST. Null u_id and data are left out; repeated rows count once; a
    u_id with several texts has the paragraphs of each.
    """
    segments = spread(segments.select("u_id", "data").where("u_id IS NOT NULL AND data IS NOT NULL"))
    words, misread, shared = _statistics(segments)
    fixable = misread.select("word", "printed")
    fixable = fixable.unionByName(ruled_words(words).join(fixable, "word", "left_anti"))
    drafts = checkpointed(_once(segments).mapInPandas(lambda it: _draft(it, shared, mend_years), "u_id string, paragraph_no int, text string, rare array<string>").withColumn("mark", F.xxhash64("text")))
    at = ["u_id", "paragraph_no", "mark"]
    rare = drafts.select(*at, F.explode("rare").alias("word")).join(fixable, "word")
    fixes = checkpointed(rare.groupBy(*at).agg(F.map_from_entries(F.collect_set(F.struct("word", "printed"))).alias("fixes")))
    fixes = bounded_broadcast(fixes, MOST_BROADCAST)
    whole = drafts.join(fixes.select(*at), at, "left_anti").select("u_id", "paragraph_no", "text")
    return whole.unionByName(drafts.join(fixes, at).select("u_id", "paragraph_no", _repaired("text", "fixes").alias("text")))
