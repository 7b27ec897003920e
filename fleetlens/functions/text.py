"""Scalar text helpers: ``Column -> Column``, all evaluated in the JVM."""

from functools import reduce

from pyspark.sql import Column, functions as F

# White space as Python's str.strip() sees it; Java's \s is ASCII only.
_SPACES = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
           "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(_SPACES))


def bind(value, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df, **columns):
    """Add columns that are computed exactly once per row.

    A filter above a projection is moved below it together with copies of the expressions it
    reads.  A generator of one row stops that, and costs next to nothing.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def split_lines(c) -> Column:
    """Lines without their terminators; a trailing terminator opens no extra line."""
    return bind(F.split(col(c), _LINE_BREAK), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1))
        .otherwise(parts))


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


# Constant tables are handed over as one SQL text each: built call by call, the literals of a
# guide alone would take longer to plan than a small table takes to process.

def strings(values) -> Column:
    return F.expr(f"array({', '.join(map(sql_literal, values))})")


def literal_map(mapping) -> Column:
    return F.expr(f"map({', '.join(sql_literal(x) for pair in mapping.items() for x in pair)})")


def one_of(c, values) -> Column:
    """Whether the column is one of a few constants."""
    return F.array_contains(strings(values), col(c))


def head(array) -> Column:
    """First element, NULL for an empty array."""
    return F.get(array, F.lit(0))


def some(condition, value) -> Column:
    """``[value]`` when the condition holds, ``[]`` otherwise or when the value is NULL."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.when(F.coalesce(condition, F.lit(False)) & value.isNotNull(), F.array(value)) \
        .otherwise(no_strings())


def no_strings() -> Column:
    return F.expr("cast(array() as array<string>)")


def concat_all(*arrays) -> Column:
    return reduce(lambda a, b: F.concat(a, b), arrays)


def py_repr(c) -> Column:
    """Quoted form of a string as Python shows it."""
    c = col(c)
    escaped = c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), double).otherwise(single)


def safe_preview(c) -> Column:
    """Enough of a secret to recognise it, not enough to rebuild it."""
    c = col(c)
    return F.when(F.length(c) > 4, F.concat(F.left(c, F.lit(4)), F.lit("…"))).otherwise(F.lit("****"))


def byte_prefix(c, n: int) -> Column:
    """First ``n`` UTF-8 bytes of a string or binary; broken sequences become U+FFFD."""
    return F.make_valid_utf8(F.substring(col(c).cast("binary"), 1, n).cast("string"))


def content_key(*columns) -> Column:
    """SHA-256 over the JSON of the columns, NULLs included."""
    return F.sha2(F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
