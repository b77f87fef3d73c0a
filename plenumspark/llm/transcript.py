"""A finite-state parser for transcript lines and speaker labels."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# The vocabulary of transcription marks.
SOUNDS = "applåder munterhet klubbslag hörs ej ohörbart skratt harkling paus sorl buller hostar hostning oidentifierat ljud oro rop tystnad bifall suck fniss visselpip visslingar musik telefonsignal bravorop".split()
SOUND_FILLING = "från läktaren läktarna i kammaren salen av och på en ett instämmanden från flera håll".split()
TITLES = "herr hr hr. fru fr fr. fröken frk frk. statsrådet statsminister statsministern talmannen friherre greve doktor dr dr.".split()
NOBODY = "någon en röst flera ledamöter ropet från läktaren ledamot på bänk ej uppfattat namn okänd röst talare".split()

_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
_TIME = r"(?:kl\.?\s*)?\d{1,2}[:.]\d{2}(?:[:.]\d{2})?|t=\d+|\d+h\d+m\d+s"
#: One token of a line: a bracketed stretch, a starred or dashed sound, a bare time mark, a word, white space, any other character.
_IN = lambda a, b: rf"[^{a}{b}\n]*(?:\n(?!\s*\n)[^{a}{b}\n]*)*"  # noqa: E731  (no bracket, no blank line)
TOKEN = re.compile(
    rf"(?P<bracket>\(\([^()\n]*\)\)|\({_IN('(', ')')}\)|\[{_IN(r'\[', r'\]')}\]|\{{{_IN('{', '}')}\}}|<{_IN('<', '>')}>)"
    r"|(?P<starred>\*[^*\n]+\*)|(?P<dashed>[–—][^\S\n](?:\w+[^\S\n])+[–—](?=\s|$))"
    r"|(?P<time>(?<![\w.])(?:\d{1,2}:\d{2}:\d{2}|\d+h\d{2}m\d{2}s)(?![\w]))"
    r"|(?P<word>\w+)|(?P<space>\s+)|(?P<other>.)",
    re.S,
)
FILLER = re.compile(r"(?:[eäöæø]+h+m*|h+m+|m{2,}|u+h+m*)\Z", re.I)
_ONLY_TIME = re.compile(rf"\s*(?:{_TIME})\s*\Z", re.I)
#: Characters that page recognition mixes up, folded to one of them.
_FOLD = str.maketrans({"0": "o", "1": "l", "5": "s", "i": "l", "c": "e", "å": "a", "ä": "a", "ö": "o", "9": "o", "8": "b"})


def _fold(word: str) -> str:
    return word.lower().replace("rn", "m").replace("ii", "u").translate(_FOLD)


_SOUND = {_fold(w) for w in SOUNDS}
_SOUND_ALL = _SOUND | {_fold(w) for w in SOUND_FILLING}


def is_sound(text: str) -> bool:
    words = [_fold(w) for w in re.findall(r"\w+", text)]
    return bool(words) and words[0] in _SOUND and all(w in _SOUND_ALL for w in words)


def is_annotation(kind: str, token: str) -> bool:
    """Whether a bracketed, starred or dashed token is a time mark or sound annotation, not speech.

    Square, curly and angle brackets hold nothing spoken; round ones may ("(det var år 1946!)").
    """
    inner = token.strip("()[]{}<>*–— \n")
    if kind == "bracket":
        if token[0] in "[{<" or token.startswith("(("):
            return True
        return bool(_ONLY_TIME.match(inner)) or is_sound(inner)
    return kind == "starred" or is_sound(inner)


class Line(NamedTuple):
    """A line of a transcript: who its label names (None: the speaker before goes on) and what is left of it without cue, time and label."""

    speaker: str | None
    text: str


_CLOCK = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
_CUE = re.compile(rf"\s*{_CLOCK}\s*-->\s*{_CLOCK}(?:\s+\S+)*\s*\Z")
_VOICE = re.compile(r"\s*<v(?:\.[\w.]+)?\s+([^<>]+)>")
_LEADING_TIME = re.compile(rf"\s*(?:[\[(]{_CLOCK}[\])]|{_CLOCK}(?=\s+[-–—]|\s*\t|\s+[A-ZÅÄÖ]))\s*[-–—]?\s*")
_NAMED = re.compile(r"\s*(?:>>\s*|[-–—]\s+)?((?:[A-ZÅÄÖÉÜ][\w.'’\-]*)(?:[ \t]+(?:\([^()\n]*\)|[\w.'’\-]+)){0,6})\s*:(?=\s|\Z)")
_is_caption = lambda text: "-->" in text or text.startswith(("WEBVTT", "\ufeffWEBVTT"))
_TAG = re.compile(r"</?(?:v|c|i|b|u|ruby|rt|lang|font)(?:[.\s][^<>]*)?>|<\d[\d:.]*>")


def transcript_lines(text: str | None) -> list[Line]:
    """The lines of a transcript in one of the known layouts, without cue numbers, time lines, notes and labels.

    Layouts: SubRip and WebVTT captions (number or name of the cue, time line, text until a blank line; `<v Name>`
    names the speaker; NOTE, STYLE and REGION blocks are no speech), lines with a time before them, and lines
    `Name: text`, `>> Name: text`, `- Name: text`. States: at the head of a caption file, between cues (what stands
    before a time line is the cue's name), in a cue's text, in a block that is skipped, in plain lines. A line
    without a label belongs to the speaker before; a blank line ends a cue and changes nothing else.
    """
    if not text:
        return []
    lines = text.lstrip("\ufeff").splitlines()
    state = "between" if _is_caption(text) else "plain"
    out: list[Line] = []
    waiting: list[str] = []
    for k, line in enumerate(lines):
        if state != "plain":
            if not line.strip():
                # What waits for a time line that never came is text.
                out += [_labelled(w) for w in waiting]
                waiting, state = [], "between"
            elif state == "skip":
                pass
            elif _CUE.match(line):
                waiting, state = [], "cue"
            elif state == "cue":
                out.append(_labelled(line))
            elif k == 0 and line.startswith("WEBVTT") or not waiting and re.match(r"(?:NOTE|STYLE|REGION)(?:\s|\Z)", line):
                state = "skip"
            else:
                waiting.append(line)
        else:
            out.append(_labelled(line))
    return out + [_labelled(w) for w in waiting]


def _labelled(line: str) -> Line:
    m = _VOICE.match(line)
    if m:
        return Line(m.group(1).strip(), _TAG.sub("", line[m.end() :]))
    m = _LEADING_TIME.match(line)
    line = _TAG.sub("", line[m.end() :] if m else line)
    m = _NAMED.match(line)
    return Line(m.group(1), line[m.end() :].lstrip()) if m else Line(None, line)


def transcript_turns(text: str | None) -> list[Line]:
    """The turns of a transcript: clean text of consecutive lines of one speaker; lines without a spoken word part nothing. Labels are the same if they name the same person or are equal but for case and white space."""
    out: list[Line] = []
    last = None
    now: str | None = None
    for speaker, raw in transcript_lines(text):
        now = speaker if speaker is not None else now
        clean = speech_of_line(raw)
        if not any(map(str.isalnum, clean)):
            continue
        key = parse_label(now) or (" ".join(now.split()).casefold() if now else None)
        if out and key == last:
            out[-1] = Line(out[-1].speaker, out[-1].text + "\n" + clean)
        else:
            out.append(Line(now, clean))
        last = key
    return out


def speech(text: str | None) -> str:
    """The spoken text of a segment: cues, time marks, annotations and standalone fillers gone, white space evened, line breaks kept. Null and blank texts give ''."""
    if text and _is_caption(text):
        text = "\n".join(x.text for x in transcript_lines(text))
    return speech_of_line(text)


def speech_of_line(text: str | None) -> str:
    """`speech` of text in no caption layout.

    States: between tokens (skip), in speech (keep), after a dropped filler (its comma or dots go with
    it). A bracket that holds speech is parsed by the same machine.
    """
    if not text:
        return ""
    out: list[str] = []
    after_filler = False
    for m in TOKEN.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind == "word":
            if FILLER.match(token) and not (m.end() < len(text) and text[m.end()] in "-." and text[m.end() + 1 : m.end() + 2].isalpha()):
                after_filler = True
                continue
            after_filler = False
            out.append(token)
        elif kind == "space":
            out.append("\n" if "\n" in token else " ")
        elif kind == "time":
            continue
        elif kind == "other":
            if after_filler and token in ",…":
                continue
            out.append(token)
        elif is_annotation(kind, token):
            continue
        else:
            inner = speech_of_line(token[1:-1])
            out.append(token[0] + (inner if kind == "bracket" else f" {inner} ") + token[-1])
            after_filler = False
    s = re.sub(r" +", " ", "".join(out))
    s = re.sub(r" ?\n[ \n]*", "\n", s)
    return re.sub(r" ([,.;:!?])", r"\1", s).strip()


def has_speech(text: str | None) -> bool:
    """Whether any spoken word is left; stops at the first one."""
    if text and _is_caption(text):
        return any(_has_word(x.text) for x in transcript_lines(text))
    return _has_word(text)


def _has_word(text: str | None) -> bool:
    if not text:
        return False
    for m in TOKEN.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind == "word":
            if not FILLER.match(token):
                return True
        elif kind in ("bracket", "dashed"):
            if not is_annotation(kind, token) and _has_word(token[1:-1]):
                return True
    return False


class Label(NamedTuple):
    """Who a speaker label names, in folded letters; missing parts are ''."""

    family: str
    given: str
    place: str
    party: str


_MARK = re.compile(rf"\s*(?:[\[({{<]\s*(?:{_TIME})\s*[\])}}>]|\d{{1,2}}:\d{{2}}(?::\d{{2}})?|\d+h\d{{2}}m\d{{2}}s)\s*", re.I)
_SPACED = re.compile(r"(?<!\w)(\w)((?: \w)+)(?!\w)")
_LTOKEN = re.compile(r"[\w\-]+\.?|[(\[][^)\]]*[)\]]|[,:–—.]")


def parse_label(label: str | None) -> Label | None:
    """The person a label names, or None for no label, an anonymous one, or none that can be read.

    States: mark* , speech number?, title?, name+ , ("," given name)?, ("i" place)?, party?, reply?, end.
    """
    if not label:
        return None
    s = unicodedata.normalize("NFC", label)
    while (m := _MARK.match(s)) and m.end():
        s = s[m.end() :]
    s = re.sub(r"\(?\bforts\b\.?\)?|\(?\brepl(?:ik|\.)?(?!\w)\)?", " ", s, flags=re.I)
    s = _SPACED.sub(lambda m: (m.group(1) + m.group(2).replace(" ", "")) if len(m.group(2)) >= 4 else m.group(), s)
    names: list[str] = []
    given = place = party = ""
    state = "start"
    titled = numbered = False
    for token in _LTOKEN.findall(s):
        low = token.casefold()
        if state == "start":
            if low in ("anf.", "anf", "anförande", "nr"):
                numbered = True
                continue
            if numbered and token.rstrip(".").isdigit():
                continue
            if low in TITLES or low.rstrip(".") in TITLES:
                titled = True
                continue
            state = "name"
        if token[0] in "([":
            party = re.sub(r"\W", "", low)
            state = "done" if names else state
        elif token in ":–—.":
            continue
        elif token == ",":
            state = "comma" if state in ("name", "place_done", "given_done") else state
        elif state == "name":
            if low == "i" and names:
                state = "place"
            else:
                names.append(low.rstrip(".") if len(low.rstrip(".")) > 1 else low)
        elif state == "place":
            place = (place + " " + low.rstrip(".")).strip()
            state = "place_done"
        elif state == "place_done":
            place = (place + " " + low.rstrip(".")).strip()
        elif state == "comma":
            w = low.rstrip(".")
            if not titled and not numbered and not given and not place and len(names) == 1 and token[0].isupper() and len(w) > 2:
                given, state = w, "given_done"
            else:
                party, state = w, "done"
        elif state == "given_done":
            if low == "i":
                state = "place"
            else:
                party, state = low.rstrip("."), "done"
    if not names or (not titled and not numbered and not given and any(n in NOBODY for n in names)):
        return None
    if not party and names and not place and len(names) > 2:
        return None
    family = names[-1]
    if not given and len(names) > 1:
        given = names[0].rstrip(".")
    if len(family) < 2 or not family[0].isalpha():
        return None
    return Label(family, given, place, party)
