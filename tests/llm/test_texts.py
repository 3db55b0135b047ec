"""Packing, leaks and stuffing, on small cases and against brute force."""

import random
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm.automaton import SuffixAutomaton, repeated_lengths
from newsloom.llm.leaks import find_leaks, remove_leaks
from newsloom.llm.normal import fragments, normal, plain_words, words
from newsloom.llm.packing import _Pool, pack, pack_sizes
from newsloom.llm import stuffing as stuffing_module
from newsloom.llm.stuffing import page_figures, stuffing
from newsloom.llm.tokens import TOKENIZER_DIR, token_counts


def test_best_two_is_the_best_pair():
    for s in range(200):
        r = random.Random(s)
        sizes = [r.randint(1, 12) for _ in range(r.randint(0, 8))]
        room = r.randint(1, 20)
        want = max((a + b for a, b in combinations(sizes, 2) if a + b <= room), default=0)
        assert sum(_Pool(np.array(sizes, dtype=int)).best_two(room)) == want, (sizes, room)


def test_pack_sizes_fills_and_loses_nothing():
    for s in range(30):
        r = np.random.default_rng(s)
        cap = int(r.integers(10, 3000))
        sizes = r.integers(1, cap + 1, int(r.integers(0, 400)))
        box = pack_sizes(sizes, cap)
        assert len(box) == len(sizes) and (box >= 0).all()
        load = np.bincount(box, weights=sizes) if len(sizes) else np.array([])
        assert (load <= cap).all()
        assert len(load) <= -(-int(sizes.sum()) // cap) * 1.5 + 1
    sizes = np.random.default_rng(0).integers(1, 500, 5000)
    assert len(set(pack_sizes(sizes, 2048))) <= -(-int(sizes.sum()) // 2048) + 1


def test_pack_rows(spark):
    rows = [(1, 5), (2, 25), (3, 0), (4, None), (5, 10), (None, 3), (5, 10), (6, 20)]
    d = spark.createDataFrame(rows, "doc_id long, n long").withColumn("shard", F.lit("x")).withColumn("piece", F.lit(9))
    out = pack(d, "doc_id", "n", 10).collect()
    load = {}
    for r in out:
        if r.container_id:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 10 and sum(load.values()) == sum(n or 0 for _, n in rows)
    assert sorted((r.piece, r.n_tokens) for r in out if r.doc_id == 2) == [(1, 10), (2, 10), (3, 5)]
    assert sorted((r.piece, r.n_tokens) for r in out if r.doc_id == 6) == [(1, 10), (2, 10)]
    assert all(r.container_id is None for r in out if r.doc_id in (3, 4))
    many = pack(d.unionByName(d), "doc_id", "n", 10, shard_items=3).collect()
    assert sum(r.n_tokens for r in many) == 2 * sum(n or 0 for _, n in rows)
    assert pack(d.limit(0), "doc_id", "n", 10).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    d = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "æøå 😀 <|endoftext|>")], "id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(d, "id", "text", f"{TOKENIZER_DIR}/{name}").collect()}
    assert got[1] in (2, 3) and got[2] == got[3] == 0 and got[4] > 3


def test_vocabularies_agree(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (token_counts(d, "doc_id", "text", f"{TOKENIZER_DIR}/byte_bpe_50k.{x}") for x in ("tiktoken", "json"))
    assert a.join(b.withColumnRenamed("n_tokens", "m"), "doc_id").where("n_tokens <> m").count() == 0


def test_automaton():
    for s in range(150):
        r = random.Random(s)
        t = [r.randrange(r.choice([2, 4, 20])) for _ in range(r.randrange(30))]
        want = []
        for e in range(len(t)):
            subs = [n for n in range(1, e + 2) if any(t[k : k + n] == t[e - n + 1 : e + 1] for k in range(len(t) - n + 1) if k != e - n + 1)]
            want.append(max(subs, default=0))
        assert repeated_lengths(t) == want
        assert [x * (x >= 3) for x in repeated_lengths(t, 3)] == [x * (x >= 3) for x in want]
        times, weight, longer = r.choice([2, 3]), r.choice([0, 6, 15]), r.randrange(3)
        alone = lambda w, o: w > longer
        want = []
        for e in range(len(t)):
            held = [0]
            for n in range(1, e + 2):
                occurs = sum(t[k : k + n] == t[e - n + 1 : e + 1] for k in range(len(t) - n + 1))
                held += [n] * (occurs >= times and occurs * n >= weight and (n > 1 or alone(t[e], occurs)))
            want.append(max(held))
        assert repeated_lengths(t, 1, times, weight, alone) == want
        sam = SuffixAutomaton()
        sam.add(t)
        sam.add(t[::-1])
        subs = {tuple(x[i:j]) for x in (t, t[::-1]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        assert sum(sam.length[k] - sam.length[sam.link[k]] for k in range(1, len(sam.length))) == len(subs)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ålborg RØD", ["ålborg", "rød"]), ("Å ＦＵＬＬ ﬁn", ["å", "full", "fin"]), ("a<b>b</b>c", None), ("don't stop-it", ["don", "t", "stop", "it"]),
        ("Vor­grel ​x⁠y", ["vorgrel", "xy"]), ("Straße STRASSE", ["strasse", "strasse"]), ("K&oslash;ge &amp; x&nbsp;y", ["køge", "x", "y"]), ("<p>one</p><p>two</p>", ["one", "two"]),
        ("3 < 5 and 7 > 2", ["3", "5", "and", "7", "2"]), ("a_b", ["a", "b"]), ("", []), (None, []),
    ],
)
def test_words(text, want):
    got, spans = words(text)
    assert len(got) == len(spans) and plain_words(text) == got
    if want is not None:
        assert got == want
    else:
        assert got == ["a", "b", "c"] and [[f[0] for f in g] for g in fragments(text)] == [["a", "b", "c"]]


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_leaks(spark):
    docs = [
        (1, f"Before. {ITEM.upper()} after"), (2, "x " + ITEM[: ITEM.index(" twelve")] + " y"), (3, ITEM.replace(" ", ",\n<b>").replace("seven", "se​ven") + "</b>"),
        (4, None), (5, ""), (6, ITEM.replace("seven", "s<i>ev</i>en")), (7, "word " * 200_000 + ITEM), (7, ITEM), (None, ITEM), (8, "other item here a b c d e f g h i j k l m n"),
    ]
    items = [(10, ITEM), (11, "zero " + ITEM), (12, "short one"), (13, None), (14, "h i j k l m n a b c d e"), (None, ITEM), (10, ITEM)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("t", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    for block in (200_000, 5):
        got = sorted((r.doc_id, r.item_id, r.longest_words) for r in find_leaks(d, i, block_words=block).collect())
        assert got == [(k, m, 13) for k in (1, 3, 6, 7) for m in (10, 11)]
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0
    clean = {r.doc_id: r for r in remove_leaks(d.where("doc_id in (1, 2, 4, 8)"), i, max_coverage=0.9).collect()}
    assert clean[1].text == "Before.  after" and clean[1].removed_words == 13 and not clean[1].dropped
    assert clean[4].text is None and not clean[4].dropped and clean[8].removed_words == 0
    gone = remove_leaks(d.where("doc_id = 1"), i, max_coverage=0.5).first()
    assert gone.text is None and gone.dropped


def _readings(text):
    """Every word sequence of a text over the readings of all tags between letters."""
    out = [[]]
    for g in fragments(text or ""):
        ways = []
        for joins in product((False, True), repeat=len(g) - 1):
            raws = [g[0][0]]
            for join, f in zip(joins, g[1:]):
                raws[-1:] = [raws[-1] + f[0]] if join else [raws[-1], f[0]]
            ways.append([w for r in raws for w in normal(r)])
        out = [x + w for x in out for w in ways]
    return out


def _windows(text, index, n=12):
    return {i for w in _readings(text) for k in range(len(w) - n + 1) for i in index.get(tuple(w[k : k + n]), ())}


def test_leaks_against_all_windows(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "eval_items"))
    index = {}
    for r in items.collect():
        w = plain_words(r.text)
        for k in range(len(w) - 11):
            index.setdefault(tuple(w[k : k + 12]), set()).add(r.item_id)
    want = {(r.doc_id, x) for r in docs.collect() for x in _windows(r.text, index)}
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} == want and want


def test_every_tag_is_read_both_ways(spark):
    r = random.Random(5)
    names = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    items = [(1, " ".join(names)), (2, " ".join(names[::-1])), (3, "th ree " + " ".join(names[3:]))]
    index = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(len(w) - 5):
            index.setdefault(tuple(w[k : k + 6]), set()).add(i)
    docs = [(0, "x " + " ".join(names).replace("three", "th<b>r</b>ee").replace("nine ten", "nine<br>ten") + " y")]
    for d in range(1, 120):
        t = " ".join(r.choice((names, names[::-1]))[r.randrange(6) :][: r.randrange(4, 12)])
        for _ in range(r.randrange(1, 6)):
            k = r.randrange(len(t))
            t = t[:k] + "<i>" + t[k + (t[k] == " ") :]
        docs.append((d, t))
    want = {(d, i) for d, t in docs for i in _windows(t, index, 6)}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(d, i, min_words=6).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len({x for x, _ in want}) > 60 and (0, 1) in want
    assert next(x for x in got if (x.doc_id, x.item_id) == (0, 1)).longest_words == 14
    # The item may hold such tags as well.
    tagged = spark.createDataFrame([(9, docs[0][1])], "item_id long, text string")
    assert [x.doc_id for x in find_leaks(spark.createDataFrame([(4, " ".join(names))], "doc_id long, text string"), tagged).collect()] == [4]


def test_removal_asks_for_no_block_size(spark):
    a, b, own = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    items = spark.createDataFrame([(1, a), (2, b), (3, "a5 " + " ".join(f"z{k}" for k in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{a} {own} c30 c31 {b}"), (2, f"{a}. {own}, {own}"), (3, None), (None, a)], "doc_id long, text string")
    seen = []
    for block in (200_000, 30, 5):
        rows = sorted(remove_leaks(docs, items, block_words=block).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
        seen.append([tuple(r) for r in rows])
    assert seen[0] == seen[1] == seen[2] == [(1, None, 60, True), (2, f". {own}, {own}", 30, False), (3, None, 0, False), (None, None, 30, True)]


NEWS = "The mayor of Olsgard opened the new bridge on Monday, and the baker called it a fine day. According to the council, the road will need more money before it can be used by lorries. "
STUFFED = [
    "buy lamp, cheap lamp, best lamp, lamp deal, lamp outlet, " * 8, "http://a.example/x\nhttp://b.example/y\nwww.c.test/z\n" * 6, "[best wig](https://a.test/w) [cheap wig](https://b.test/w) " * 6,
    "tag:sofa; brand=Karel; tag:lamp; " * 9, "#sofabuy #sofadeal #lampnew " * 10, "SKU A1 | lamp | colour: red | 12.50\nSKU B2 | lamp | colour: blue | 13.50\n" * 6,
    "Our lamp is the lamp for lamp lovers. See lamp, love lamp, buy lamp. Looking for lamp? Here is lamp, only lamp. " * 4, "curator\nsewer pipe\nformal\napple harvest\nclinic queue\nthin\nmayor\ngardener",
    "das Zollamt / den Deich / Tinte / Kurator / die Brücke / schmal / den Wasservertrag / Kredit", NEWS[:90] + "\n" + "buy lamp, cheap lamp, best lamp, lamp deal, " * 12,
]
FINE = [NEWS * 3, NEWS * 2 + "\nhttps://a.example/b\nhttps://a.example/c", NEWS * 2 + "\n#sport #local #news", NEWS + "\n- Anna, baker\n- Bo, mayor", (NEWS[:90] + ". ") * 9, "", None, "   "]


def test_stuffing(spark):
    for t in STUFFED:
        assert page_figures(t)["stuffed"] > 0.5, t
    for t in FINE:
        assert page_figures(t)["stuffed"] <= 0.5, t
    d = spark.createDataFrame([(k, t) for k, t in enumerate(STUFFED + FINE)] + [(None, STUFFED[0])], "doc_id long, text string").withColumn("stuffed", F.lit("x")).withColumn("d", F.lit(1))
    out = stuffing(d).collect()
    assert len(out) == len(STUFFED + FINE) + 1 and sorted(r.doc_id for r in out if r.is_stuffed and r.doc_id is not None) == list(range(len(STUFFED)))
    assert stuffing(d.limit(0)).count() == 0
    assert page_figures("lamp " * 100_000)["stuffed"] == 1.0


PROSE = [
    "Le maire de la ville a inauguré lundi le nouveau pont qui relie les deux rives du fleuve. Selon le conseil municipal, les travaux ont duré trois ans et coûté plus de douze millions d'euros. Les habitants espèrent que la circulation sera plus fluide, mais certains commerçants craignent de perdre leurs clients.",
    "El alcalde inauguró el lunes el nuevo puente que une las dos orillas del río. Según el ayuntamiento, las obras duraron tres años y costaron más de doce millones de euros. Los vecinos esperan que el tráfico sea más fluido, aunque algunos comerciantes temen perder a sus clientes.",
    "Borgmästaren invigde på måndagen den nya bron som förbinder de båda stränderna. Enligt kommunen tog arbetet tre år och kostade mer än tolv miljoner kronor. Invånarna hoppas att trafiken ska flyta bättre, men flera handlare är oroliga för att förlora sina kunder.",
    "Kaupunginjohtaja vihki maanantaina käyttöön uuden sillan, joka yhdistää joen molemmat rannat. Kaupungin mukaan työt kestivät kolme vuotta ja maksoivat yli kaksitoista miljoonaa euroa. Asukkaat toivovat liikenteen sujuvan paremmin, mutta osa kauppiaista pelkää menettävänsä asiakkaita.",
    "Мэр города в понедельник открыл новый мост, который соединяет два берега реки. По данным администрации, работы длились три года и стоили более двенадцати миллионов евро. Жители надеются, что движение станет свободнее, но некоторые торговцы боятся потерять покупателей.",
    "市长星期一为连接两岸的新桥揭幕。据市政府介绍，工程历时三年，耗资超过一千二百万欧元。居民希望交通会更加顺畅，但一些商人担心失去顾客。",
    "i went to the shop today and they told me that the thing i wanted was sold out so i went home again and had a cup of tea and then my sister called to say she would come over on sunday with the kids and we talked for a while about the garden and what to plant there in the spring",
]


def test_stuffing_asks_for_no_language():
    for t in PROSE:
        assert page_figures(t)["stuffed"] == 0, t
        assert page_figures(t.replace(" ", "\xa0"))["stuffed"] == 0, t
    for t in ("acheter montre pas cher montre homme montre femme prix montre solde montre pas cher ", "手表 便宜手表 买手表 手表价格 手表 折扣手表 最好手表 ", "купить часы, часы цена, часы скидка, недорого часы, "):
        assert page_figures(t * 12)["stuffed"] > 0.5, t


def test_stuffing_needs_coverage(spark, sf, monkeypatch):
    """Clauses made of keywords are known by what the automaton covers, and by nothing else."""
    clauses = ["Our lamp is the lamp for lamp lovers. Every lamp is a lamp that you can lamp. Is this the lamp of all the lamp in a lamp shop? " * 4, "buy best lamp now old lamp one lamp see lamp for all lamp buy " * 9]
    texts = [r.text for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet").select("text").collect()]
    found = {k for k, t in enumerate(texts) if page_figures(t)["stuffed"] > 0.5}
    assert all(page_figures(t)["stuffed"] > 0.5 for t in clauses)
    monkeypatch.setattr(stuffing_module, "repeated_lengths", lambda toks, *a: [0] * len(toks))
    assert all(page_figures(t)["stuffed"] <= 0.5 for t in clauses)
    rest = {k for k, t in enumerate(texts) if page_figures(t)["stuffed"] > 0.5}
    assert rest < found and len(found - rest) > 20


def test_stuffing_repeated_passages():
    line = "Looking for best price on shoes in Berlin"
    for t in (f"{line}\n" * 20, f"{line.lower()}\n" * 20, f"{line}.\n" * 40, f"{line}\n{line} today\n" * 8):
        assert page_figures(t)["stuffed"] > 0.5, t
    wrapped = NEWS.replace("and the", "\nand the").replace("before it", "\nbefore it")
    for t in (f"{line}\n" + NEWS * 2, f"{line}\n" * 3 + NEWS * 2, NEWS * 9, wrapped * 4):
        assert page_figures(t)["stuffed"] <= 0.5, t
