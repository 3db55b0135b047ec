"""Parsing of packed fields, against a hand-written reader and fixed cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from newsloom.operators.packed import one_per_record, parse_error, parse_flagged, parse_values, unpack

NAMES = [
    (None, []), ("", []), ("  ", []), ("[]", []), ('""', []), (",,;", []),
    ("coast", ["coast"]), ("632,805", ["632", "805"]), ("417 344 889", ["417", "344", "889"]), ("[895 431]", ["895", "431"]),
    ("sea & harbour|schools|women's cup", ["sea & harbour", "schools", "women's cup"]),
    ('"data desk" ; "theatre"', ["data desk", "theatre"]), ("men's league|\"football\"", ["men's league", "football"]),
    ('coast|"rail | road"|cycling', ["coast", "rail | road", "cycling"]), ("tax;", ["tax"]), ("night-life ; films", ["night-life", "films"]),
    ("elections; theatre\tsea & harbour|schools", ["elections", "theatre", "sea & harbour", "schools"]),
    ('"the ""big"" match","letters, replies"', ['the "big" match', "letters, replies"]), ('["local news"|"rail | road"]', ["local news", "rail | road"]),
    ("['tax', 'radio']", ["tax", "radio"]), ('"rail | road', ["rail", "road"]), ("a\nb", ["a", "b"]), ("radio films、opera", ["radio", "films", "opera"]),
    ('" tax "', ["tax"]), ("tax  radio", ["tax", "radio"]), ("[[tax], [radio]]", ["tax", "radio"]),
]
IDS = [
    ("N1 N2", ["N1", "N2"]), ("N1-0,N2-1", ["N1-0", "N2-1"]), ('"N1|N2"', ["N1", "N2"]), ("['N1-0','N2-0']", ["N1-0", "N2-0"]),
    ('"N1-0";"N2-1"', ["N1-0", "N2-1"]), (",N1, ,N2,,", ["N1", "N2"]), ("N1 N2、N3​N4", ["N1", "N2", "N3", "N4"]), ('"N1-0,N2-0', ["N1-0", "N2-0"]), (None, []),
]


@pytest.mark.parametrize("grammar,cases", [("names", NAMES), ("ids", IDS)])
def test_fixed_cases(spark, grammar, cases):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in d.select("i", parse_values(F.col("t"), grammar).alias("v")).collect()}
    for i, (t, want) in enumerate(cases):
        assert got[i] == want, t


def _read(text):
    """A plain reader of well-formed fields, written apart from the grammar."""
    out, i = [], 0
    text = text.strip().removeprefix("[").removesuffix("]")
    while i < len(text):
        if text[i] == '"':
            j, v = i + 1, ""
            while True:
                if text[j] == '"' and text[j + 1 : j + 2] == '"':
                    v, j = v + '"', j + 2
                elif text[j] == '"':
                    break
                else:
                    v, j = v + text[j], j + 1
            out.append(v.strip())
            i = j + 1
        elif text[i] in ",;|\t\n" or text[i].isspace():
            i += 1
        else:
            j = i
            while j < len(text) and text[j] not in ',;|\t\n"':
                j += 1
            part = text[i:j].strip()
            out += part.split() if all(w.isdigit() for w in part.split()) else [part]
            i = j
    return [unicodedata.normalize("NFC", v) for v in out if v]


def test_against_plain_reader(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeø") for _ in range(r.randint(1, 5)))
    name = lambda: " ".join(word() for _ in range(r.randint(1, 2)))

    def quoted():
        s = "".join(r.choice('ab ,;|"[]') for _ in range(r.randint(1, 8)))
        return '"' + (s if s.strip() else "a").replace('"', '""') + '"'

    texts = []
    for _ in range(800):
        vals = [str(r.randint(0, 999)) for _ in range(r.randint(0, 5))] if r.random() < 0.3 else [r.choice([name, quoted])() for _ in range(r.randint(0, 5))]
        t = r.choice([",", ";", "|", " ; ", ", ", "\t", "\n"]).join(vals)
        texts.append(f"[{t}]" if r.random() < 0.3 else t)
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.v for r in d.select("i", parse_values(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _read(t), t


def test_errors_and_rows(spark):
    d = spark.createDataFrame([(1, 'a,"b'), (2, "[a"), (3, "a|b"), (4, None), (None, "x"), (5, ""), (6, "a,,b")], "id long, t string").withColumn("val", F.lit(1)).withColumn("pos", F.lit("x"))
    got = sorted((r.record_id, r.pos, r.val, r.error) for r in unpack(d, "id", "t").collect())
    assert got == [("1", 1, "a", "quote"), ("1", 2, "b", "quote"), ("2", 1, "a", "bracket"), ("3", 1, "a", None), ("3", 2, "b", None), ("6", 1, "a", None), ("6", 2, "b", None)]
    assert unpack(d.where("id > 99"), "id", "t").count() == 0
    assert [r.e for r in d.where("id = 3").select(parse_error(F.col("t")).alias("e")).collect()] == [None]


def test_repeats_and_long_text(spark):
    d = spark.createDataFrame([(1, "b a", 2), (1, None, 1), (1, "b,a", 3), (2, "x", 1)], "id long, t string, o int")
    assert sorted(map(tuple, one_per_record(d, "id", ["t"], "o").collect())) == [(1, "b a"), (2, "x")]
    many = " ".join(f'"n ""{k}"""' for k in range(60_000)) + ',"' + "x,""" * 100_000
    n = spark.createDataFrame([(many,)], "t string").select(F.size(parse_values(F.col("t"))).alias("n")).first().n
    assert n >= 60_000


FLAGS = [
    ("[a, b}", [("a", "bracket"), ("b", "bracket")]), ("]a, b[", [("a", "bracket"), ("b", "bracket")]), ("'a, b", [("a", "quote"), ("b", None)]), ('a", b', [("a", "quote"), ("b", None)]),
    ('x, "b c|d', [("x", None), ("b c", "quote"), ("d", None)]), ("[a, [b], (c; {d})]", [("a", None), ("b", None), ("c", None), ("d", None)]), ("(a, b", [("a", "bracket"), ("b", None)]),
    ('["x ]", y]', [("x ]", None), ("y", None)]), ('coast"rail | road"', [("coast", None), ("rail | road", None)]), ('["a, b]', [("a", "quote"), ("b", None)]), ('"', []), ("[[]", []), ("women's cup", [("women's cup", None)]),
]
ID_FLAGS = [
    ('"N1|N2"', [("N1", None), ("N2", None)]), ('"N1-0,N2-0', [("N1-0", "quote"), ("N2-0", None)]), ("[N1, N2", [("N1", "bracket"), ("N2", None)]), ("['N1','N2']", [("N1", None), ("N2", None)]),
    ("('N1 N2', [N3])", [("N1", None), ("N2", None), ("N3", None)]), ('N1", N2', [("N1", "quote"), ("N2", None)]), ("{N1]", [("N1", "bracket")]),
]


@pytest.mark.parametrize("grammar,cases", [("names", FLAGS), ("ids", ID_FLAGS)])
def test_flags_come_from_the_parse(spark, grammar, cases):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    rows = d.select("i", parse_flagged(F.col("t"), grammar).alias("v"), parse_values(F.col("t"), grammar).alias("w"), parse_error(F.col("t"), grammar).alias("e")).collect()
    for r in rows:
        text, want = cases[r.i]
        assert [tuple(x) for x in r.v] == want and r.w == [v for v, _ in want], text
        flags = {f for _, f in want if f}
        assert (r.e in flags if flags else r.e is None or not want), (text, r.e)
