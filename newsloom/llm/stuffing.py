"""Keyword-stuffed and link-list pages.

Method: the suffix automaton of a page's words, with the number of occurrences of every state, gives
the maximal substrings whose repeats hold a good share of the page's words; the characters they cover
are the coverage. Coverage is combined with missing clause structure, and neither asks for a language:

- The page is cut into lines, sentences and entries of lists. A segment has clause structure if some
  words of it follow each other without a separator, if short words stand among them often enough,
  and if it is no bare heading. Links, tags and segments without clause structure are stuffing.
- A segment with clause structure is stuffing if repeats cover much of its longer words: clauses made
  of keywords have the shape of sentences and tell nothing.
- Segments told again are counted once by the automaton. Again and again the same line is stuffing
  from its second occurrence on, a whole sentence, which may recur in news, after KEPT.

A page is stuffed if more than half of its characters, blanks and tags aside, are stuffing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import pairwise

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.automaton import repeated_lengths
from newsloom.shared import ship_package

#: share of the page's words that the occurrences of a repeat must hold, and their least number
DENSE, TIMES = 0.08, 3
#: share of the page's words at which a short word is a keyword on its own
DENSE_SHORT = 0.2
#: coverage of its longer words at which a whole sentence, or any other segment, is stuffing
COVERED_SENTENCE, COVERED_OTHER = 0.55, 0.45
#: occurrences of a whole sentence that are prose
KEPT = 9
#: letters of a short word; words of a clause for each short one; words without any that a clause may have
SHORT, PER_SHORT, LONGEST_RUN = 3, 10, 15

# Scripts that set no blanks between words; each letter counts as a word there.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_WORD = re.compile(r"[\w'’]+")
_ANY_WORD = regex.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[\w'’])+")
_HAS_UNSPACED = regex.compile(f"[{_UNSPACED}]")
_FOUR = re.compile(r"[\w'’]+(?:\s+[\w'’]+){3}")
# Links: an address alone, or one wrapped in markup with its anchor text.
_LINK = regex.compile(r"<a\b[^<>]*>.*?</a>|\[[^\[\]]{0,300}\]\([^()\s]*\)|(?:https?://|ftp://|www\.)[^\s<>\"')\]]+", regex.S | regex.I)
_LINK_SIGNS = ("<a", "](", "://", "www.", "<A", "WWW.")
_DOMAIN = regex.compile(r"\b(?:[\w-]+\.)+\p{L}{2,}(?:/[^\s<>\"')\]]*|(?=\s|$))")
_DOMAIN_SIGN = re.compile(r"\w\.[^\W\d_]{2}")
_TAG = regex.compile(r"<(?:!--.*?--|[/!?]?\p{L}[^<>]*)>", regex.S)
_BREAK = re.compile(r"[.!?…][\"”»')\]]*\s+|\n+|[。！？]|\s[•·|¦/]\s+")
_UNSEEN = regex.compile(r"\p{Cf}")
_HASH = regex.compile(r"[#@][\p{L}\p{N}_]+|\b\p{L}{2,12}[:=][\p{L}\p{N}_-]+")
_HASH_SIGN = re.compile(r"[#@:=]")
_FINAL = (".", "!", "?", "…", "。", "！", "？")


def _mark(m) -> str:
    return "￼" * (m.end() - m.start())


def _segments(text: str) -> list[str]:
    """Lines, sentences with their final mark, and entries of lists, without the breaks between them."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        k = m.start()
        out.append(text[at : k + (text[k] in _FINAL)])
        at = m.end()
    out.append(text[at:])
    return [x for x in out if x and not x.isspace()]


def _sentences(texts: list[str], split: list[list[str]]) -> tuple[list[bool], list[bool]]:
    """Whether a segment is a sentence with its final mark, or a line of one; and whether it is such a
    line that goes on below."""
    whole, goes_on = [False] * len(texts), [False] * len(texts)
    for k in range(len(texts) - 1, -1, -1):
        end = texts[k].rstrip(" \t\r\"”»')]*").endswith(_FINAL)
        goes_on[k] = not end and k + 1 < len(texts) and whole[k + 1] and len(split[k]) > 3 and texts[k + 1].lstrip()[:1].islower()
        whole[k] = end or goes_on[k]
    return whole, goes_on


def _short(ws: list[str]) -> list[int]:
    """Places of the short words; numbers are none."""
    return [k for k, w in enumerate(ws) if len(w) <= SHORT and not w.isdigit()]


def _has_clause(seg: str, ws: list[str], short: list[int], sentence: bool, unspaced: bool) -> bool:
    """Some words in a row without a separator, and short ones among them: of a sentence with its
    final mark a long one must have some, any other segment must not be a heading."""
    if unspaced:
        return len(ws) >= 6
    if len(ws) < (4 if sentence else 6) or not _FOUR.search(seg):
        return False
    spare = LONGEST_RUN if sentence else PER_SHORT // 2
    return len(ws) <= spare or len(short) * PER_SHORT >= len(ws) - spare


def _loose_chars(ws: list[str], short: list[int]) -> int:
    """Characters of words in runs too long to be held together by the short words around."""
    return sum(sum(map(len, ws[a + 1 : b])) for a, b in pairwise([-1, *short, len(ws)]) if b - a - 1 > LONGEST_RUN)


def _coverage(texts: list[str], split: list[list[str]]) -> dict[str, float]:
    """For each distinct segment the share of its longer words, in characters, that the page's dense
    repeats cover; a short word counts where it is covered. Segments without any are left out."""
    places: dict[str, int] = {}
    toks: list = []
    n = 0
    for seg, ws in zip(texts, split):
        if ws and seg not in places:
            places[seg] = len(toks)
            toks.extend(ws)
            toks.append((None, n))  # no repeat goes over the end of a segment
            n += len(ws)
    alone = lambda w, o: o >= DENSE_SHORT * n or len(w) > SHORT and not w.isdigit()
    covered = bytearray(len(toks))
    for k, length in enumerate(repeated_lengths(toks, 1, TIMES, DENSE * n, alone)):
        if length:
            covered[k - length + 1 : k + 1] = b"\1" * length
    out = {}
    for seg, ws in zip(texts, split):
        a = places.get(seg, 0)
        if covered.find(1, a, a + len(ws)) >= 0:
            held = sum(len(w) for w, c in zip(ws, covered[a:]) if c)
            out[seg] = held / sum(len(w) for w, c in zip(ws, covered[a : a + len(ws)]) if c or len(w) > SHORT)
    return out


def page_figures(text: str | None) -> dict[str, float]:
    """Shares of a page's characters, blanks and tags aside: ``links``, ``repeated`` (covered by dense
    repeats, or told before), ``no_clause`` and ``stuffed``. All 0 for a page without words."""
    zero = {"links": 0.0, "repeated": 0.0, "no_clause": 0.0, "stuffed": 0.0}
    if not text:
        return zero
    # A link becomes marks of its own length; other tags vanish.
    t = text
    if any(x in t for x in _LINK_SIGNS):
        t = _LINK.sub(_mark, t)
    if _DOMAIN_SIGN.search(t):
        t = _DOMAIN.sub(_mark, t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    unspaced = False
    if not t.isascii():
        t = unicodedata.normalize("NFC", _UNSEEN.sub("", t))
        unspaced = _HAS_UNSPACED.search(t) is not None
    find = _ANY_WORD.findall if unspaced else _WORD.findall
    written = _segments(t)
    texts = [x.lower() for x in written]
    sizes = [len(x) - x.count(" ") for x in texts]
    total = sum(sizes)
    if not total:
        return zero
    split = [find(x) for x in texts]
    whole, goes_on = _sentences(written, split)
    cover = _coverage(texts, split)
    links = t.count("￼")
    stuffed = no_clause = repeated = 0.0
    told: Counter = Counter()
    for j, (seg, ws, size) in enumerate(zip(texts, split, sizes)):
        in_links = seg.count("￼") if links else 0
        prose = size - in_links
        stuffed += in_links
        told[seg] += 1
        cov = cover.get(seg, 0.0)
        repeated += prose if told[seg] > 1 else cov * prose
        tags = sum(len(m.group()) for m in _HASH.finditer(seg)) if _HASH_SIGN.search(seg) else 0
        short = _short(ws) if len(ws) > PER_SHORT // 2 and not (whole[j] and len(ws) <= LONGEST_RUN) else []
        part_of_sentence = goes_on[j] or j > 0 and goes_on[j - 1]
        if in_links == size or tags >= 0.3 * prose or not (part_of_sentence or _has_clause(seg, ws, short, whole[j], unspaced)):
            no_clause += prose
            stuffed += prose
        elif cov >= (COVERED_SENTENCE if whole[j] else COVERED_OTHER) or told[seg] > (KEPT if whole[j] else 1):
            stuffed += prose
        elif not unspaced and len(ws) > LONGEST_RUN:
            stuffed += _loose_chars(ws, short)
    return {"links": links / total, "repeated": repeated / total, "no_clause": no_clause / total, "stuffed": stuffed / total}


def stuffing(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, links, repeated, no_clause, stuffed, is_stuffed`` for every row, over whole texts. A
    NULL or empty text has zeros and is no case. Other columns are ignored."""
    ship_package(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            fig = [page_figures(t) for t in pdf["t"]]
            out = pd.DataFrame(fig, columns=["links", "repeated", "no_clause", "stuffed"], dtype="float64")
            out.insert(0, "doc_id", pdf["d"].array)
            out["is_stuffed"] = out["stuffed"] > threshold
            yield out

    return df.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, links double, repeated double, no_clause double, stuffed double, is_stuffed boolean")
