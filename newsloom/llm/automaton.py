"""Suffix automata over token ids, for one page or for a set of items."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Sequence

_RUN = re.compile(b"\1+")


class SuffixAutomaton:
    """States are numbered; state 0 is the root. ``length`` and ``link`` are the usual longest
    substring length and suffix link of each state."""

    __slots__ = ("length", "link", "step")

    def __init__(self) -> None:
        self.length: list[int] = [0]
        self.link: list[int] = [-1]
        self.step: list[dict[int, int]] = [{}]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        """The state for the t-successor of p exactly one longer than p, cut out of q."""
        step, link = self.step, self.link
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._state(self.length[p] + 1, link[q], dict(step[q]))
        link[q] = c
        while p >= 0 and step[p].get(t) == q:
            step[p][t] = c
            p = link[p]
        return c

    def extend(self, last: int, t: int) -> int:
        """Append token t after state ``last``; sequences may share states (generalised form)."""
        step, link = self.step, self.link
        q = step[last].get(t)
        if q is not None:
            return self._split(last, t, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in step[p]:
            step[p][t] = new
            p = link[p]
        if p >= 0:
            link[new] = self._split(p, t, step[p][t])
        return new

    def add(self, tokens: Sequence[int]) -> list[int]:
        """Add a sequence from the root; the state after each token."""
        out, last = [], 0
        for t in tokens:
            last = self.extend(last, t)
            out.append(last)
        return out


def repeated_lengths(tokens: Sequence[Hashable], least: int = 1, times: int = 2, weight: float = 0.0, alone: Callable[[Hashable, int], bool] | None = None) -> list[int]:
    """For each position the length of the longest maximal repeat that ends there: of the longest
    substring that occurs at least ``times`` times, whose occurrences together hold at least ``weight``
    tokens; 0 if there is none. Lengths below ``least`` may be given as 0. A single token counts as
    a substring only if ``alone(token, occurrences)`` holds (without it, always).

    A token is part of no such repeat if it is too rare: a repeat of at most ``longest`` tokens has at
    least weight / longest occurrences, and so has each of its tokens. The automaton takes only the
    runs of tokens that are left, each run behind a mark of its own.
    """
    out = [0] * len(tokens)
    count = Counter(tokens)
    need = times
    while True:
        often = {t for t, c in count.items() if c >= need}
        runs = [m.span() for m in _RUN.finditer(bytes(map(often.__contains__, tokens)))]
        longest = max((j - i for i, j in runs), default=0)
        if longest < least or not longest:
            return out
        if weight <= need * longest:
            break
        need = max(need + 1, int(weight / longest))
    runs = [(i, j) for i, j in runs if j - i >= least and (j - i > 1 or alone is None or alone(tokens[i], count[tokens[i]]))]
    seq: list[Hashable] = []
    at: list[int] = []
    for k, (i, j) in enumerate(runs):
        seq.append((None, k))
        at.append(-1)
        seq.extend(tokens[i:j])
        at.extend(range(i, j))
    for k, length in zip(at, _repeats(seq, times, weight, alone)):
        if k >= 0 and length >= least:
            out[k] = length
    return out


def _repeats(tokens: Sequence[Hashable], times: int, weight: float, alone: Callable[[Hashable, int], bool] | None) -> list[int]:
    """The lengths for all positions, from the automaton of the whole sequence and the number of
    occurrences of each state's substrings."""
    length, link, step, occurs, token = [0], [-1], [{}], [0], [None]
    ends = []
    last = 0
    for t in tokens:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        occurs.append(1)
        token.append(t)
        ends.append(new)
        p = last
        here = step[p]
        while t not in here:
            here[t] = new
            p = link[p]
            if p < 0:
                break
            here = step[p]
        if p >= 0:
            q = here[t]
            n = length[p] + 1
            if length[q] == n:
                link[new] = q
            else:
                c = new + 1
                length.append(n)
                link.append(link[q])
                step.append(step[q].copy())
                occurs.append(0)
                token.append(t)
                link[q] = link[new] = c
                while p >= 0 and step[p].get(t) == q:
                    step[p][t] = c
                    p = link[p]
        last = new
    by_length = sorted(range(1, len(length)), key=length.__getitem__)
    for s in reversed(by_length):
        occurs[link[s]] += occurs[s]
    held = [0] * len(length)
    for s in by_length:
        n, o = length[s], occurs[s]
        held[s] = n if o >= times and o * n >= weight and (n > 1 or alone is None or alone(token[s], o)) else held[link[s]]
    return [held[s] for s in ends]
