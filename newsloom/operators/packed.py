"""Several values packed in one field: one row per value, with its place.

Method: a parsing expression grammar. Rules are built from the combinators below; ordered choice
commits to its first alternative that matches, repetition never gives back, and a failed
alternative backtracks to the place where the choice began. The alternatives are quoted values,
bracketed lists, values with a quote that has no partner, bare values, and single signs that belong
to none. A bracketed list, which nests to three levels, is one token whose inside is parsed again.

Grammars without recursion are regular, so each is compiled into one expression of atomic groups, which
the JVM runs inside the projection: no Python, no shuffle. Possessive loops run without recursion, so
very long strings are safe. Errors are what the parse met: every malformed token says so itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# -- combinators: every rule is a string holding its compiled expression --
def seq(*rules: str) -> str:
    return "".join(rules)


def choice(*rules: str) -> str:
    """Ordered choice; atomic, so it never returns to a later alternative after success."""
    return "(?>" + "|".join(rules) + ")"


def many(rule: str) -> str:
    return f"(?>{rule})*+"


def some(rule: str) -> str:
    return f"(?>{rule})++"


def maybe(rule: str) -> str:
    return f"(?>{rule})?+"


def ahead(rule: str) -> str:
    return f"(?={rule})"


def unless(rule: str) -> str:
    return f"(?!{rule})"


# Character classes of the grammars.
WORD = r"[\p{L}\p{M}\p{N}&'’\-]"
ID = r"[\p{L}\p{M}\p{N}_\-]"
GAP = r"[\p{Z}\s\p{Cc}\p{Cf}]"
SEPARATOR = r"[\p{Z}\s\p{Cc},;|、，；｜،/]"
OPEN, CLOSE = r"[\[({]", r"[\])}]"

LEVELS = 3

_edge = ahead(choice(GAP, SEPARATOR, CLOSE, r"\z"))
_quoted = seq('"', r'[^"]*+', many(r'""[^"]*+'), '"', _edge)
_code = seq(r"\p{Nd}++", unless(WORD))
_name = seq(unless("'"), WORD + "++", many(seq(" ", unless(_code), WORD + "++")))
_single = seq("'", choice(_code, r"[\p{L}\p{M}\p{N}&’\-]" + many(r"[\p{L}\p{M}\p{N}&’ \-]|'(?=[\p{L}\p{M}\p{N}])")), "'", _edge)
_stray = choice(r"[\"']", OPEN, CLOSE)


def _bracketed(text: str, quoted: str | None, levels: int = LEVELS) -> str:
    """A list in one kind of brackets: runs of other text, quoted values, and lists of lesser depth."""
    inside = [text, *([quoted] if quoted else []), *([_bracketed(text, quoted, levels - 1)] if levels > 1 else []), *(['"'] if quoted else [])]
    return choice(*[seq(o, many(choice(*inside)), c) for o, c in ((r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"))])


def _bare(value: str, quoted: str) -> str:
    """A value, with a quote behind it that opens nothing."""
    return seq(value, maybe(seq(unless(quoted), '"', _edge)))


#: names and codes; a value may touch a quote that has no partner
NAMES = choice(_quoted, _single, _bracketed(r'[^\[\](){}"]++', _quoted), seq(r"[\"']", choice(_code, _name)), _bare(choice(_code, _name), _quoted), _stray)
_listed = choice(seq('"', r'[^"]*+', '"', _edge), seq("'", r"[^']*+", "'", _edge))
#: ids hold no separator of any kind, so quotes as well as brackets may wrap a list
IDS = choice(seq('"', ID + "++", '"', _edge), seq("'", ID + "++", "'", _edge), _bracketed(r"[^\[\](){}]++", None), _listed, seq(r"[\"']", ID + "++"), _bare(ID + "++", _listed), _stray)

GRAMMARS = {"names": NAMES, "ids": IDS}
# A token whose inside is parsed again: of more than one character, in brackets, or a quoted list of ids.
_GROUPS = {"names": r"\A[\[({].*[\])}]\z", "ids": rf"\A[\[({{].*[\])}}]\z|\A([\"']).*[^\p{{L}}\p{{M}}\p{{N}}_\-].*\1\z"}


def _tokens(text: Column, grammar: str) -> Column:
    """The tokens in order, those of groups in place of their group."""
    each = lambda t: F.regexp_extract_all(t, F.lit(GRAMMARS[grammar]), F.lit(0))
    flat = each(text)
    deep = flat
    group = f"(?s){_GROUPS[grammar]}"
    for _ in range(LEVELS + (grammar == "ids")):
        deep = F.flatten(F.transform(deep, lambda t: F.when(_one_of("[({" if grammar == "names" else "[({\"'", F.substring(t, 1, 1)) & (F.length(t) > 1) & t.rlike(group), each(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(F.array(t))))
    return F.when(text.rlike(r"[\[({]" if grammar == "names" else r"[\[({\"']"), deep).otherwise(flat)


def _one_of(signs: str, c: Column) -> Column:
    return F.instr(F.lit(signs), c) > 0


def _value(tok: Column) -> Column:
    """The value of a token: without its quotes, a doubled quote within double ones standing for one. A
    bare token is its value."""
    first = F.substring(tok, 1, 1)
    q = tok.startswith('"') & tok.endswith('"') & (F.length(tok) >= 2)
    s = tok.startswith("'") & tok.endswith("'") & (F.length(tok) >= 2)
    inner = F.substring(tok, F.lit(2), F.length(tok) - 2)
    body = F.when(F.length(tok) == 1, F.lit("")).when(q, F.replace(inner, F.lit('""'), F.lit('"'))).when(s, inner).otherwise(F.regexp_replace(tok, r"\A[\"']|\"\z", ""))
    return F.when(_one_of("\"'[](){}", first) | tok.endswith('"'), F.regexp_replace(body, rf"\A{GAP}++|{GAP}++\z", "")).otherwise(tok)


def _malformed(tok: Column) -> Column:
    """NULL for a well-formed token, else 'quote' or 'bracket'."""
    lone = F.length(tok) == 1
    first, last = _one_of("\"'", F.substring(tok, 1, 1)), tok.endswith('"') | (tok.startswith("'") & tok.endswith("'"))
    return F.when(lone & _one_of("[](){}", tok), F.lit("bracket")).when((first & lone) | (first != last), F.lit("quote"))


def parse_values(text: Column, grammar: str = "names") -> Column:
    """array<string> of the values in order. NULL and empty text give an empty array; empty entries
    are no values. Unmatched quotes and brackets are stepped over and what follows is read as bare values."""
    return F.filter(F.transform(_tokens(F.coalesce(text, F.lit("")), grammar), _value), lambda v: v != "")


def parse_flagged(text: Column, grammar: str = "names") -> Column:
    """array<struct<val, error>> of the values in order. ``error`` is NULL, 'quote' for a value that touches a
    quote without a partner, or 'bracket' for one next to a bracket without a partner."""
    toks = _tokens(F.coalesce(text, F.lit("")), grammar)
    lone = lambda ts, k: F.coalesce(_malformed(F.try_element_at(ts, k)) == "bracket", F.lit(False))

    def each(ts: Column) -> Column:
        flag = lambda t, k: F.coalesce(_malformed(t), F.when((F.when(k > 0, lone(ts, F.greatest(k, F.lit(1)))).otherwise(False)) | lone(ts, k + 2), F.lit("bracket")))
        return F.transform(ts, lambda t, k: F.struct(_value(t).alias("val"), flag(t, k).alias("error")))

    # The tokens are computed once, whatever number of times the body names them.
    return F.filter(F.flatten(F.transform(F.array(toks), each)), lambda x: x["val"] != "")


def parse_error(text: Column, grammar: str = "names") -> Column:
    """NULL for well-formed text, else what is wrong first: 'quote' (one without a partner) or 'bracket'."""
    bad = F.filter(F.transform(_tokens(F.coalesce(text, F.lit("")), grammar), _malformed), lambda x: x.isNotNull())
    return F.try_element_at(bad, F.lit(1))


def unpack(df: DataFrame, record_id: str, field: str, grammar: str = "names", label: str | None = None) -> DataFrame:
    """One row per value: ``field, record_id, pos, val, error, value_error``; ``error`` is that of the text,
    ``value_error`` that of the value.

    ``pos`` counts from 1 within the string and skips empty entries. Records are taken as they
    come: drop repeats first (``one_per_record``). A NULL id or a NULL, empty or blank text gives
    no row. Other columns are ignored, whatever their names.
    """
    src = df.select(F.col(record_id).cast("string").alias("record_id"), F.col(field).alias("t")).where("record_id IS NOT NULL AND t IS NOT NULL")
    e = src.select("record_id", parse_error(F.col("t"), grammar).alias("error"), F.posexplode(parse_flagged(F.col("t"), grammar)).alias("p", "x"))
    return e.select(F.lit(label or field).alias("field"), "record_id", (F.col("p") + 1).cast("int").alias("pos"), "x.val", "error", F.col("x.error").alias("value_error"))


def unpack_values(df: DataFrame, record_id: str, field: str, grammar: str = "names", label: str | None = None) -> DataFrame:
    """``unpack`` without the errors."""
    src = df.select(F.col(record_id).cast("string").alias("record_id"), F.col(field).alias("t")).where("record_id IS NOT NULL AND t IS NOT NULL")
    e = src.select("record_id", F.posexplode(parse_values(F.col("t"), grammar)).alias("p", "val"))
    return e.select(F.lit(label or field).alias("field"), "record_id", (F.col("p") + 1).cast("int").alias("pos"), "val")


def one_per_record(df: DataFrame, record_id: str, fields: list[str], order: str | None = None) -> DataFrame:
    """One row per record: each field's first non-NULL text by ``order``, ties to the lesser text.
    Repeats merge before the shuffle, so a record repeated any number of times is one row per task."""
    o = F.col(order) if order else F.lit(0)
    aggs = [F.min(F.when(F.col(f).isNotNull(), F.struct(o.alias("o"), F.col(f).alias("v")))).alias(f"__{i}") for i, f in enumerate(fields)]
    return df.where(F.col(record_id).isNotNull()).groupBy(F.col(record_id).alias("__id")).agg(*aggs).select(F.col("__id").alias(record_id), *[F.col(f"__{i}.v").alias(f) for i, f in enumerate(fields)])
