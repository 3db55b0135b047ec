"""Words of a text without regard to case, punctuation, markup, invisible characters or the
Unicode form of a letter."""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import regex

_TAG = r"<(?:!--.*?--|[/!?]?\p{L}[^<>]*)>"
_CHAR = r"(?:[\p{L}\p{N}\p{M}\p{Cf}͏ᅟᅠ឴឵ㅤ︀-️]|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\p{L}{2,31}\d{0,2});)"
#: a tag parts words
SPLIT = regex.compile(f"{_TAG}|(?P<w>{_CHAR}+)", regex.S)
_INSIDE = regex.compile(f"{_CHAR}{_TAG}(?:{_TAG})*{_CHAR}", regex.S)
_ANY_TAG = regex.compile(_TAG, regex.S)
_UNSEEN = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵ㅤ︀-️]")
_RUN = regex.compile(r"[\p{L}\p{N}\p{M}]+")


@functools.lru_cache(maxsize=200_000)
def normal(raw: str) -> tuple[str, ...]:
    if raw.isascii() and "&" not in raw and "<" not in raw:
        return (raw.lower(),)
    t = html.unescape(_ANY_TAG.sub("", raw))
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", _UNSEEN.sub("", t)).casefold())
    return tuple(_RUN.findall(t))


def words(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """Normal words and their spans in the text; a tag parts words."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    for m in SPLIT.finditer(text or ""):
        raw = m.group("w")
        if raw is not None:
            for w in normal(raw):
                out.append(w)
                spans.append(m.span("w"))
    return out, spans


def fragments(text: str) -> list[list[tuple[str, int, int]]]:
    """Runs of word characters with their spans, those parted by nothing but tags in one list: each
    such tag may stand inside a word or between two."""
    out: list[list[tuple[str, int, int]]] = []
    end = -1  # where a fragment must begin to belong to the last list
    for m in SPLIT.finditer(text):
        if m.group("w") is None:
            end = m.end() if m.start() == end else -1
        elif m.start() == end:
            out[-1].append((m.group(), *m.span()))
            end = m.end()
        else:
            out.append([(m.group(), *m.span())])
            end = m.end()
    return out


_ENTITY = regex.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\p{L}{2,31}\d{0,2});")
_ASCII = re.compile("[a-z0-9]+")


def plain_words(text: str | None) -> list[str]:
    """The normal words alone, without spans: whole-text steps in place of a step per word."""
    if not text:
        return []
    t = text
    if "<" in t:
        t = _ANY_TAG.sub(" ", t)
    if "&" in t:
        t = _ENTITY.sub(lambda m: html.unescape(m.group()), t)
    if t.isascii():
        return _ASCII.findall(t.lower())
    t = unicodedata.normalize("NFKC", _UNSEEN.sub("", t)).casefold()
    return _RUN.findall(unicodedata.normalize("NFKC", t))


def has_tag_inside_word(text: str) -> bool:
    return "<" in text and _INSIDE.search(text) is not None
