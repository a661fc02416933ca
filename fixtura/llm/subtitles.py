"""Reading subtitle texts: cues and the words spoken in them, with positions in the raw text."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

_ARROW_LINE = re.compile(r"[\ufeff \t]*(?:\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{1,3}[ \t]*-->")
_HEADER = re.compile(r"^﻿?WEBVTT[^\n]*(?:\n|$)|^﻿")
#: Markup, zero-width characters, entities: what lies on the text without being of it.
MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]{0,60}>|<\|[a-zA-Z_]{1,30}\|>|\{\\[^{}\n]{0,40}\}|[\u200b-\u200f\u2060\ufeff\u00ad]")
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});")
#: Sound descriptions: bracketed in one cue, starred, or music signs.
SOUND = re.compile(r"\[[^\[\]\n]{0,60}\]|\([^()\n]{0,40}\)|（[^（）\n]{0,40}）|【[^【】\n]{0,40}】|\*[^*\n]{1,40}\*|[♪♫♬]+[～~]?")

_BYTES = {}
for _b in range(0x80, 0x100):
    try:
        _BYTES[bytes([_b]).decode("cp1252")] = _b
    except UnicodeDecodeError:
        pass
    _BYTES[chr(_b)] = _b
_CONT = "".join(re.escape(c) for c, b in _BYTES.items() if b < 0xC0)
_LEAD = lambda lo, hi: "".join(c for c, b in _BYTES.items() if lo <= b <= hi)
#: A character of UTF-8 that was read as a one-byte encoding.
MISREAD = re.compile(rf"[{_LEAD(0xC2, 0xDF)}][{_CONT}]|[{_LEAD(0xE0, 0xEF)}][{_CONT}]{{2}}|[{_LEAD(0xF0, 0xF4)}][{_CONT}]{{3}}")
#: One set of first characters, so that a search can skip to them; which of them it was is asked after.
SURELY_MISREAD = re.compile(rf"[ÂÃÐÑØÙâãàäåæçèé](?:(?<=[ÂÃÐÑØÙ])[{_CONT}]|(?<=[âã])€|(?<=à)[¤¥¸¹]|(?<=[äåæçèé])[{_CONT}]{{2}})")


def _undo(m: re.Match) -> str:
    try:
        return bytes(_BYTES[c] for c in m.group()).decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def unmangle(text: str) -> str:
    """Text whose UTF-8 was read as a one-byte encoding, once or twice, put right."""
    for _ in range(2):
        if not SURELY_MISREAD.search(text):
            break
        text = MISREAD.sub(_undo, text)
    return text


def unmangle_mapped(text: str, at: list[int]) -> tuple[str, list[int]]:
    """As `unmangle`, keeping for each character the raw position of its last part in `at`."""
    for _ in range(2):
        if not SURELY_MISREAD.search(text):
            break
        out, places, last = [], [], 0
        for m in MISREAD.finditer(text):
            said = _undo(m)
            if said == m.group():
                continue
            out.append(text[last : m.start()])
            places += at[last : m.start()]
            out.append(said)
            places += [at[m.end() - 1]] * len(said)
            last = m.end()
        out.append(text[last:])
        places += at[last:]
        text, at = "".join(out), places
    return text, at


def cue_spans(raw: str) -> list[tuple[int, int]]:
    """Where the number and times of each cue stand."""
    spans, at = [], raw.find("-->")
    while at >= 0:
        line = raw.rfind("\n", 0, at) + 1
        end = raw.find("\n", at) + 1 or len(raw)
        if _ARROW_LINE.match(raw, line):
            if line:
                above = raw.rfind("\n", 0, line - 1) + 1
                if raw[above : line - 1].strip("\ufeff \t\r").removeprefix("-").isdecimal():
                    line = above
            spans.append((line, end))
        at = raw.find("-->", end)
    return spans


def cues(text: str) -> list[tuple[int, int]]:
    """(start, end) of the payload of each cue, in order; a text without cues is one payload."""
    spans = cue_spans(text)
    if not spans:
        head = _HEADER.match(text)
        return [(head.end() if head else 0, len(text))]
    return list(zip([b for _, b in spans], [*[a for a, _ in spans[1:]], len(text)], strict=True))


def spoken(text: str) -> str:
    """The words of all cues on one line, without markup and sound descriptions."""
    parts = [text[a:b] for a, b in cues(text)]
    joined = " ".join(parts)
    if "<" in joined or "{" in joined or not joined.isascii():
        joined = MARKUP.sub("", joined)
    if "&" in joined:
        joined = ENTITY.sub(lambda m: html.unescape(m.group()), joined)
    if not joined.isascii():
        joined = unmangle(joined)
    return SOUND.sub(" ", joined)


def _sub_mapped(pattern: re.Pattern, said: Callable[[re.Match], str], text: str, at: list[int]) -> tuple[str, list[int]]:
    out, places, last = [], [], 0
    for m in pattern.finditer(text):
        new = said(m)
        out += (text[last : m.start()], new)
        places += at[last : m.start()]
        places += [at[m.start()]] * len(new)
        last = m.end()
    out.append(text[last:])
    return "".join(out), places + at[last:]


def spoken_mapped(text: str) -> tuple[str, list[int]]:
    """As `spoken`, with the raw position of each character."""
    joined, at = "", []
    for k, (a, b) in enumerate(cues(text)):
        if k:
            joined += " "
            at.append(a)
        joined += text[a:b]
        at += range(a, b)
    if "<" in joined or "{" in joined or not joined.isascii():
        joined, at = _sub_mapped(MARKUP, lambda _: "", joined, at)
    if "&" in joined:
        joined, at = _sub_mapped(ENTITY, lambda m: html.unescape(m.group()), joined, at)
    if not joined.isascii():
        joined, at = unmangle_mapped(joined, at)
    return _sub_mapped(SOUND, lambda _: " ", joined, at)
