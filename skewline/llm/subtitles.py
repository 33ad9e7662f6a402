"""Subtitle text: its layout, and the words under it."""

from __future__ import annotations

import re
import unicodedata

TIME = r"\d{1,2}:\d{2}(?::\d{2})?[.,]\d{1,3}"
TIME_LINE = re.compile(rf"^[ \t]*{TIME}[ \t]*-->[ \t]*{TIME}.*$", re.M)
#: Between the texts of two cues: blank lines, a cue's number if there is one, its time line.
CUE_BREAK = re.compile(rf"(?:^[ \t]*\d+[ \t]*\n)?^[ \t]*{TIME}[ \t]*-->.*$", re.M)
WEB = re.compile(r"https?://|\bwww\.|\b[a-z][\w-]*\.(?:[a-z]{3,})\b", re.I)
MARKS = re.compile(r"<[^<>\n]{0,40}>|\{[^{}\n]{0,40}\}|\[[^\]\n]{0,80}\]|\([^()\n]{0,80}\)|\*[^*\n]{1,60}\*")
SPEAKER = re.compile(r"^[ \t-]*[^\W\d_a-z][^\Wa-z_]{1,23}:[ \t]", re.M)
WORD = re.compile(r"[^\W_]+")

_ACCENTS = re.compile("[\u0300-\u036f]+")

#: A word divided at the end of a line.
DIVIDED = re.compile(r"(?<=[^\W\d_])[-\u00ad]\n(?=[^\W\d_])")

#: Signs of UTF-8 read as a one-byte encoding.
_MISREAD = ("Ã", "Â", "Ð", "Ñ", "Å", "Ä", "â€")


def _one_byte(text: str) -> bytes:
    out = bytearray()
    for c in text:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                raise
            out.append(ord(c))
    return bytes(out)


def repaired(text: str) -> str:
    """``text`` with UTF-8 that was read as a one-byte encoding, once or twice, read right; else as it is."""
    for _ in range(2):
        if not any(m in text for m in _MISREAD):
            break
        lines, changed = text.split("\n"), False
        for i, line in enumerate(lines):
            if any(m in line for m in _MISREAD):
                try:
                    lines[i] = _one_byte(line).decode("utf-8")
                    changed = True
                except (UnicodeEncodeError, UnicodeDecodeError):
                    pass
        if not changed:
            break
        text = "\n".join(lines)
    return text


def lines_of(text: str) -> str:
    """``text`` with one kind of line end and without a byte-order mark."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text.removeprefix("﻿")


#: Characters that recognition takes for one another, folded onto one of them, in this order.
_ALIKE = {"0": "o", "1": "l", "|": "l", "i": "l", "5": "s", "ı": "l", "ł": "l", "ß": "s", "ø": "o", "đ": "d", "æ": "e", "œ": "e", "rn": "m", "vv": "w"}


def folded(text: str) -> str:
    """Lower case, without accents, characters that look alike made the same."""
    text = text.lower()
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    for seen, meant in _ALIKE.items():
        text = text.replace(seen, meant)
    return text


def cue_texts(text: str) -> list[str]:
    """The texts of the cues in order, without numbers, time lines, tags, sounds, speakers and lines with web addresses;
    words divided between lines are whole."""
    body = lines_of(text)
    out = []
    for cue in CUE_BREAK.split(body):
        cue = cue.strip()
        if not cue or cue == "WEBVTT":
            continue
        if "." in cue and WEB.search(cue):
            cue = "\n".join(line for line in cue.split("\n") if not WEB.search(line))
        if "[" in cue or "(" in cue or "<" in cue or "{" in cue or "*" in cue:
            cue = MARKS.sub(" ", cue)
        if "-\n" in cue or "\u00ad" in cue:
            cue = DIVIDED.sub("", cue)
        if ":" in cue:
            cue = SPEAKER.sub(" ", cue)
        if cue:
            out.append(cue)
    return out
