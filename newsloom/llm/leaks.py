"""Evaluation texts leaking into training text.

Method: a generalised suffix automaton of the normalised test items. Training texts are streamed
through it word by word while the longest match is tracked; matches of at least ``min_words`` are
reported with the items that hold them, and spans beyond the limits can be removed.

A tag that touches letters on both sides may stand inside a word or between two. The automaton
branches there: the states of both readings are carried on, for each tag by itself.

The automaton is broadcast, so its size is bounded: items are dealt by their id to blocks of about
``block_words`` words, executors build a block's automaton, and each block runs against all
documents. With several blocks texts are normalised in each; what a block finds is stored before
the next begins, and its automaton is removed from the executors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.automaton import SuffixAutomaton
from newsloom.llm.normal import fragments, has_tag_inside_word, normal, plain_words, words
from newsloom.shared import materialize, ship_package

BLOCK_WORDS = 200_000
#: tags inside words of an item that are read both ways one by one; any beyond are read alike
ITEM_TAGS = 8

Span = tuple[int, int]


class ItemAutomaton:
    """Automaton of items with, for each state, the items that hold its substrings."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.vocab: dict[str, int] = {}
        self.sizes: dict[int, int] = {}
        sam = SuffixAutomaton()
        owners: list[set[int]] = []
        for item, ws in items:
            self.sizes[item] = max(len(ws), self.sizes.get(item, 0))
            for s in sam.add([self.vocab.setdefault(w, len(self.vocab)) for w in ws]):
                while len(owners) < len(sam.length):
                    owners.append(set())
                owners[s].add(item)
        while len(owners) < len(sam.length):
            owners.append(set())
        for s in sorted(range(1, len(sam.length)), key=lambda x: -sam.length[x]):
            if sam.link[s] > 0:
                owners[sam.link[s]] |= owners[s]
        self.step, self.link, self.length = sam.step, sam.link, sam.length
        self.owners = [tuple(o) for o in owners]
        self.longest_word = max(map(len, self.vocab), default=0)

    def _next(self, s: int, n: int, t: int) -> tuple[int, int]:
        """State and length of the longest match after token t."""
        step, link = self.step, self.link
        while s and t not in step[s]:
            s = link[s]
            n = self.length[s]
        q = step[s].get(t)
        return (0, 0) if q is None else (q, n + 1)

    def _held(self, s: int, n: int) -> Iterator[tuple[int, int]]:
        """Items that hold at least ``min_words`` words up to here, with their number of words."""
        seen = set()
        while s > 0 and self.length[s] >= self.min_words:
            for item in self.owners[s]:
                if item not in seen:
                    seen.add(item)
                    yield item, min(n, self.length[s])
            s = self.link[s]

    def matches(self, ws: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Item to (end position, length of the longest match ending there), lengths >= min_words."""
        vocab, least, n = self.vocab, self.min_words, len(ws)
        out: dict[int, list[tuple[int, int]]] = {}
        k = least - 1
        while k < n:
            if ws[k] not in vocab:
                k += least  # every window that holds this word is lost
                continue
            a = k
            while a and ws[a - 1] in vocab:
                a -= 1
            b = k + 1
            while b < n and ws[b] in vocab:
                b += 1
            if b - a >= least:
                s = m = 0
                for e in range(a, b):
                    s, m = self._next(s, m, vocab[ws[e]])
                    if m >= least:
                        for item, length in self._held(s, m):
                            out.setdefault(item, []).append((e, length))
            k = b + least
        return out

    def branching(self, text: str) -> dict[int, tuple[int, list[Span]]]:
        """Item to its longest match in words and the spans of its matches in the text, over every
        reading of the tags inside words."""
        out: dict[int, tuple[int, list[Span]]] = {}
        # State and length to the places where the words of its match begin, the last one first.
        live: dict[tuple[int, int], tuple | None] = {(0, 0): None}
        for group in fragments(text):
            at = [live]
            for j in range(1, len(group) + 1):
                here: dict[tuple[int, int], tuple | None] = {}
                for i in range(j - 1, -1, -1):
                    ws = normal("".join(f[0] for f in group[i:j]))
                    if i < j - 1 and sum(map(len, ws)) > self.longest_word:
                        break  # longer still with every fragment before
                    for (s, n), path in at[i].items():
                        for w in ws:
                            t = self.vocab.get(w)
                            s, n = (0, 0) if t is None else self._next(s, n, t)
                            path = (group[i][1], path) if n else None
                            if n >= self.min_words:
                                self._note(out, s, n, path, group[j - 1][2])
                        here.setdefault((s, n), path)
                # No match is part of any other reading's state.
                if len(here) > 1:
                    here.pop((0, 0), None)
                at.append(here)
            live = at[-1]
        return out

    def _note(self, out: dict[int, tuple[int, list[Span]]], s: int, n: int, path: tuple | None, end: int) -> None:
        starts = []
        while path is not None and len(starts) < n:
            starts.append(path[0])
            path = path[1]
        for item, length in self._held(s, n):
            longest, spans = out.get(item, (0, []))
            out[item] = (max(longest, length), [*spans, (starts[length - 1], end)])


def _merged(spans: list[Span]) -> list[Span]:
    """Disjoint spans [from, to) in order."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _inside(places: list[Span], spans: list[Span]) -> int:
    """Number of places that lie within disjoint spans, both in order."""
    n = k = 0
    for a, b in places:
        while k < len(spans) and spans[k][1] < b:
            k += 1
        n += k < len(spans) and spans[k][0] <= a
    return n


def text_matches(auto: ItemAutomaton, text: str) -> dict[int, tuple[int, int, list[Span]]]:
    """Item to its longest match in words, the words its matches cover and their spans. Words are
    counted as parted by every tag, but the longest match as its reading has them."""
    if has_tag_inside_word(text):
        found = auto.branching(text)
        places = words(text)[1] if found else []
        return {item: (longest, _inside(places, _merged(spans)), _merged(spans)) for item, (longest, spans) in found.items()}
    hits = auto.matches(plain_words(text))
    if not hits:
        return {}
    places = words(text)[1]
    out = {}
    for item, ends in hits.items():
        ranges = _merged([(e - n + 1, e + 1) for e, n in ends])
        out[item] = (max(n for _, n in ends), sum(b - a for a, b in ranges), [(places[a][0], places[b - 1][1]) for a, b in ranges])
    return out


def _item_readings(text: str) -> set[tuple[str, ...]]:
    """The word sequences of an item, over the readings of the tags inside its words."""
    if not has_tag_inside_word(text):
        return {tuple(plain_words(text))}
    groups = fragments(text)
    tags = sum(len(g) - 1 for g in groups)
    out = set()
    for joins in product((False, True), repeat=min(tags, ITEM_TAGS)):
        ws: list[str] = []
        k = 0
        for g in groups:
            raw = g[0][0]
            for f in g[1:]:
                if joins[min(k, len(joins) - 1)]:
                    raw += f[0]
                else:
                    ws += normal(raw)
                    raw = f[0]
                k += 1
            ws += normal(raw)
        out.add(tuple(ws))
    return out


def _automata(items: DataFrame, item_id: str, text: str, min_words: int, block_words: int) -> Iterator[Broadcast]:
    """The automata of all blocks, one at a time: built on executors, stored, then broadcast."""
    spark = items.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    src = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    blanks = F.length("t") - F.length(F.regexp_replace("t", r"\s+", "")) + 1
    n = src.agg(F.sum(blanks)).first()[0] or 0
    blocks = max(1, -(-n // block_words))

    def build(key, pdf):
        readings = sorted({(i, ws) for i, t in zip(pdf["i"], pdf["t"]) for ws in _item_readings(t) if len(ws) >= min_words})
        made = [pickle.dumps(ItemAutomaton([(i, list(ws)) for i, ws in readings], min_words), protocol=5)] if readings else []
        return pd.DataFrame({"block": [key[0]] * len(made), "automaton": made})

    dealt = src.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    made = materialize(dealt.groupBy("block").applyInPandas(build, "block int, automaton binary"), "p8-automata")
    for row in made.select("block").sort("block").collect():  # one number a block
        yield spark.sparkContext.broadcast(bytes(made.where(F.col("block") == row["block"]).first()["automaton"]))


def _loaded(auto: Broadcast) -> ItemAutomaton:
    return pickle.loads(auto.value)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, item_id, longest_words, covered_words, item_share`` for every document that holds at
    least ``min_words`` consecutive words of an item.

    ``covered_words`` counts the document's words inside matches of the item, ``item_share`` is the
    longest match over the item's words. NULL or empty texts match nothing; items shorter than
    ``min_words`` cannot match; a repeated document or item id counts once, with its greatest
    figures. No items or no documents give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((docs, doc_id), (items, item_id))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, longest_words int, covered_words int, item_share double"
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    found: DataFrame | None = None
    for auto in _automata(items, item_id, item_text, min_words, block_words):

        def run(batches, auto=auto):
            a = _loaded(auto)
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["d"], pdf["t"]):
                    rows += [(d, item, longest, n, longest / a.sizes[item]) for item, (longest, n, _) in text_matches(a, t).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest_words", "covered_words", "item_share"])

        part = materialize(src.mapInPandas(run, schema), "p8-found")
        auto.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("longest_words", "covered_words", "item_share")])


def remove_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    max_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, text, removed_words, dropped``: spans of at least ``min_words`` matching words are cut
    from the text; a document covered by more than ``max_coverage`` is dropped (its text NULL).

    Every row comes out, NULL texts as they are. The spans of all items are found in the original
    text, merged, and judged and cut once, whatever the size of the blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    empty = F.array().cast("array<struct<a:int,b:int>>")
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), empty.alias("spans"))
    for auto in _automata(items, item_id, item_text, min_words, block_words):

        def run(batches, auto=auto):
            a = _loaded(auto)
            for pdf in batches:
                spans = []
                for t, old in zip(pdf["text"], pdf["spans"]):
                    new = [] if t is None else [s for _, _, ss in text_matches(a, t).values() for s in ss]
                    spans.append([{"a": x, "b": y} for x, y in _merged([*((s["a"], s["b"]) for s in old), *new])])
                yield pdf.assign(spans=spans)

        out = materialize(out.mapInPandas(run, f"doc_id {kind}, text string, spans array<struct<a:int,b:int>>"), "p8-spans")
        auto.destroy()

    def cut(batches):
        for pdf in batches:
            new = [_cut(t, [(s["a"], s["b"]) for s in ss], max_coverage) for t, ss in zip(pdf["text"], pdf["spans"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [x[0] for x in new], "removed_words": [x[1] for x in new], "dropped": [x[2] for x in new]})

    return out.mapInPandas(cut, f"doc_id {kind}, text string, removed_words int, dropped boolean")


def _cut(text: str | None, spans: list[Span], max_coverage: float) -> tuple[str | None, int, bool]:
    """The text without the spans, the number of words in them, and whether it is dropped."""
    if text is None or not spans:
        return text, 0, False
    places = words(text)[1]
    lost = _inside(places, spans)
    if lost > max_coverage * len(places):
        return None, lost, True
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]]), lost, False
