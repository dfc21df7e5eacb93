"""G-code text as Column expressions, a line at a time.

A line is blank, a comment, a G or M code with an optional N number, a control line
or text. A line that can't be read (``G38.2``, ``G0X1``, a bare ``N10``) is text, never
an error. Parameters of a code keep their order; of several with one name the first counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMETER = "struct<type:string,identifier:string,dval:double,ival:int,tval:string>"
_SPACE = "[\\s]+"


@dataclass(frozen=True)
class Dialect:
    """What machines write differently: letters of codes with their type of line, and the marks of a line.

    Letters of codes and ``number`` are single characters.
    """

    codes: tuple[tuple[str, str], ...] = (("G", "GCode"), ("M", "MCode"))
    comment: str = ";"
    opening: str = "("
    closing: str = ")"
    number: str = "N"
    control: str = ":"

    @property
    def code_start(self) -> str:
        return "^[" + "".join(re.escape(c) for c, _ in self.codes) + "]"

    @property
    def types(self) -> list[str]:
        return [t for _, t in self.codes]


USUAL = Dialect()


def number_type(s: Column) -> Column:
    """Integer, Decimal or NaN. A sign may only be a leading minus; no exponent."""
    return F.when(s.rlike("^-?[0-9]+$"), "Integer").when(s.rlike("^-?(?=[.]?[0-9])[0-9]*[.][0-9]*$"), "Decimal").otherwise("NaN")


def _parameter(kind: Column, identifier: Column, value: Column | None) -> Column:
    value = F.lit(None).cast("string") if value is None else value
    number = kind.isin("DoubleValue", "IntegerValue")
    return F.struct(
        kind.alias("type"),
        identifier.alias("identifier"),
        F.when(number, value.try_cast("double")).alias("dval"),
        F.when(kind.isin("IntegerValue", "Code"), value.try_cast("int")).alias("ival"),
        F.when(kind == "TextValue", value).alias("tval"),
    )


def parameter(token: Column, dialect: Dialect = USUAL) -> Column:
    """A token after the code: name=value, a code, a name with a number, a name, or text."""

    def valued(identifier: Column, value: Column) -> Column:
        n = number_type(value)
        # A whole number too large for an int is text.
        kind = F.when(n == "Decimal", "DoubleValue").when((n == "Integer") & value.try_cast("int").isNotNull(), "IntegerValue").otherwise("TextValue")
        return _parameter(kind, identifier, value)

    # The shortest prefix whose rest is a number.
    split = "^(.+?)(-?(?:[0-9]+[.]?[0-9]*|[.][0-9]+))$"
    at = F.instr(token, "=")
    equals = valued(F.substring(token, F.lit(1), at - 1), F.substring(token, at + 1, F.length(token)))
    code_value = F.substring(token, F.lit(2), F.length(token))
    code = _parameter(F.lit("Code"), F.substring(token, F.lit(1), F.lit(1)), F.when(number_type(code_value) == "Integer", code_value))
    number = valued(F.regexp_extract(token, split, 1), F.regexp_extract(token, split, 2))
    alone = _parameter(F.lit("NoValue"), token, None)
    text = _parameter(F.lit("TextValue"), F.lit(None).cast("string"), token)
    return (
        F.when(at > 0, equals).when(token.rlike(dialect.code_start), code).when(token.rlike(split), number).when(F.length(token) == 1, alone).otherwise(text)
    )


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however often they are used.

    A one-row generator keeps the optimizer from copying their expressions into every use.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _classified(lines: DataFrame, text: str, dialect: Dialect) -> DataFrame:
    """``lines`` with the type of each line and what it is read from; its parameters aren't read yet."""
    raw = F.coalesce(F.col(text), F.lit(""))
    semicolon, opening, closing = F.instr(raw, dialect.comment), F.instr(raw, dialect.opening), F.instr(raw, dialect.closing)
    # Places count from 1: a comment at the very start is no trailing one.
    cut = F.when(semicolon > 0, semicolon).when((opening > 0) & (closing > 1), opening).otherwise(0)
    body = F.when(cut > 1, F.substring(raw, F.lit(1), cut - 1)).otherwise(raw)
    df = bound(lines, _raw=raw, _cut=cut, _body=body)
    df = bound(df, _t=F.filter(F.split("_body", _SPACE), lambda t: t != ""))
    t0, t1 = F.get("_t", 0), F.get("_t", 1)
    whole = lambda t: F.substring(t, F.lit(2), F.length(t)).try_cast("int")
    strict = lambda t: F.when(t.rlike("^.[+-]?[0-9]+$"), whole(t))
    is_n, is_gm, is_control = t0.startswith(dialect.number), t0.rlike(dialect.code_start), t0.startswith(dialect.control)
    leading = F.when(is_n, t1).when(is_gm, t0)
    code = F.when(leading.rlike(dialect.code_start), strict(leading))
    number = F.when(is_n | is_gm, strict(t0))
    broken = (is_n & (t1.isNull() | strict(t0).isNull() | (t1.rlike(dialect.code_start) & strict(t1).isNull()))) | (is_gm & strict(t0).isNull())
    control = F.lower(F.substring(t0, F.lit(len(dialect.control) + 1), F.length(t0)))
    kind = F.when(F.col("_raw").startswith(dialect.comment), "Comment").when(F.size("_t") == 0, "Blank")
    kind = kind.when(t0.startswith(dialect.comment), "Comment").when(broken, "UnknownString")
    for letter, line_type in dialect.codes:
        kind = kind.when(leading.startswith(letter), line_type)
    kind = (
        kind.when(is_n, "UnknownCode")
        .when(is_control, F.when(control == "if", "If").when(control == "else", "Else").when(control == "endif", "EndIf").otherwise("UnknownControl"))
        .otherwise("UnknownString")
    )
    return bound(df, type=kind, _code=code, _n=number, _skip=F.when(F.coalesce(leading.rlike(dialect.code_start), F.lit(False)) & is_n, 2).otherwise(1))


def code_words(lines: DataFrame, letters: str, kind: str = "GCode", text: str = "text", dialect: Dialect = USUAL, others: bool = False) -> DataFrame:
    """``lines`` of one type with ``code`` and, by letter, the number of the first parameter of that name.

    As :func:`find_number` has it of :func:`parsed` lines, without reading any other
    parameter: a pattern finds the first token of that name. With ``others``, all other
    lines come as well, with nulls.
    """
    df = _classified(lines, text, dialect)
    of_kind = F.col("type") == kind
    df = df if others else df.where(of_kind)
    df = bound(df, code=F.when(of_kind, F.col("_code")), _rest=F.when(of_kind, F.array_join(F.slice("_t", F.col("_skip") + 1, F.size("_t")), " ")))
    number = "-?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)"
    read = lambda n: F.regexp_extract("_rest", f"(?:^| ){re.escape(n)}(=[^ ]*|{number}|)(?= |$)", 1)
    is_code = [c for c, _ in dialect.codes]
    df = bound(df, **{f"_at_{n}": F.lit("") if n in is_code else read(n) for n in letters})
    df = bound(df, **{f"_of_{n}": F.when(F.col(f"_at_{n}").startswith("="), F.substring(f"_at_{n}", 2, 1 << 30)).otherwise(F.col(f"_at_{n}")) for n in letters})

    def value(v: Column) -> Column:
        # A whole number too large for an int is text.
        is_number = (v != "") & v.rlike("^-?(?=[.]?[0-9])[0-9]*[.]?[0-9]*$") & (v.contains(".") | v.try_cast("int").isNotNull())
        return F.when(is_number, v.try_cast("double"))

    df = bound(df, **{n.lower(): value(F.col(f"_of_{n}")) for n in letters})
    return df.drop("_raw", "_cut", "_body", "_t", "_code", "_n", "_skip", "_rest", *(f"_{k}_{n}" for k in ("at", "of") for n in letters))


def parsed(lines: DataFrame, text: str = "text", dialect: Dialect = USUAL) -> DataFrame:
    """``lines`` with type, n, code, params, comment and orig of each line."""
    df = _classified(lines, text, dialect)
    has_code, has_list = F.col("type").isin(*dialect.types), F.col("type").isin(*dialect.types, "UnknownCode", "If", "Else", "EndIf", "UnknownControl")
    skip = F.when(has_code, F.col("_skip")).otherwise(1)
    rest = F.when(F.size("_t") > skip, F.slice("_t", skip + 1, F.size("_t") - skip)).otherwise(F.array().cast("array<string>"))
    comment = F.when(F.col("type") == "Comment", F.substring(F.col("_raw"), F.greatest(F.instr("_raw", dialect.comment), F.lit(1)), F.length("_raw")))
    out = bound(
        df,
        n=F.when(F.col("type").isin(*dialect.types, "UnknownCode"), F.col("_n")),
        code=F.when(has_code, F.col("_code")),
        params=F.when(has_list, F.transform(rest, lambda t: parameter(t, dialect))).otherwise(F.array().cast(f"array<{PARAMETER}>")),
        comment=comment.when(F.col("_cut") > 1, F.substring(F.col("_raw"), F.col("_cut"), F.length("_raw"))),
        orig=F.when(F.col("type") != "Blank", F.col("_body")),
    )
    return out.drop("_raw", "_cut", "_body", "_t", "_code", "_n", "_skip")


def find(params: Column, identifier: str) -> Column:
    """The first parameter of that name, or null."""
    return F.get(F.filter(params, lambda p: p["identifier"] == identifier), 0)


def find_number(params: Column, identifier: str) -> Column:
    """The value of the first parameter of that name, where it is a number."""
    first = find(params, identifier)
    return F.when(first["type"].isin("DoubleValue", "IntegerValue"), first["dval"])


def lines_of_type(lines: DataFrame, kind: str) -> DataFrame:
    return lines.where(F.col("type") == kind)
