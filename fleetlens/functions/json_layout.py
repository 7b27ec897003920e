"""Layout of JSON texts: ``Column -> Column``, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetlens.functions.text import bind, col, literal_map

# Empty containers first, so that nothing is put between their brackets.
_TOKEN = r'\[\s*\]|\{\s*\}|"(?:[^"\\]|\\.)*+"|[\[\]{},:]|[^\s\[\]{},:"]+'
# A string literal that is written as it is read.
_PLAIN = r'^"[\x20\x21\x23-\x5b\x5d-\x7e]*+"$'
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
# Tokens that are laid out together: the texts that grow while folding stay short.
_CHUNK = 64


def _escaped(value: Column) -> Column:
    """A JSON string literal with everything but printable ASCII escaped."""
    def shown(ch):
        units = F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(ch.rlike(r"^[\x20\x21\x23-\x5b\x5d-\x7e]$"), ch).otherwise(
            F.coalesce(F.element_at(literal_map(_SHORT), ch), units))

    # The pattern takes code points; splitting by "" would part surrogates.
    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), shown), ""), F.lit('"'))


def _number(token: Column) -> Column:
    """A number in its shortest form: whole ones as they are, others as the double that they name."""
    value = token.cast("double")
    # The fewest digits that name the same double; Java 17 may print more.
    short = F.coalesce(*[F.when(F.format_string(f"%.{p}e", value).cast("double") == value, F.format_string(f"%.{p}e", value))
                         for p in range(17)])

    def shown(s):
        mantissa, exponent = F.substring_index(s, "e", 1), F.substring_index(s, "e", -1).cast("int")
        positional = F.regexp_replace(F.regexp_replace(s.cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", ".0")
        scientific = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        return F.when((exponent < -4) | (exponent >= 16), scientific).when(
            value == 0, F.when(F.startswith(s, F.lit("-")), "-0.0").otherwise("0.0")).otherwise(positional)

    return F.when(token.rlike(r"^-?\d+$"), F.regexp_replace(token, "^-0$", "0")).otherwise(bind(short, shown))


def _scalar(token: Column) -> Column:
    value = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(token.rlike(_PLAIN) | token.isin("true", "false", "null"), token).when(
        F.startswith(token, F.lit('"')), _escaped(value)).otherwise(_number(token))


def _lead(depth) -> Column:
    return F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))


def _piece(token: Column, depth: Column) -> Column:
    """A token as it stands at ``depth``, the depth before it."""
    return (F.when(F.startswith(token, F.lit('"')), _scalar(token))
            .when(token == ":", F.lit(": "))
            .when(token == ",", F.concat(token, _lead(depth)))
            .when(token.isin("{", "["), F.concat(token, _lead(depth + 1)))
            .when(token.isin("}", "]"), F.concat(_lead(depth - 1), token))
            .when(token.rlike(r"^[\[{]"), F.regexp_replace(token, r"\s", ""))
            .otherwise(_scalar(token)))


def _step(token: Column) -> Column:
    return F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)


def indented(text) -> Column:
    """A JSON text indented by two, one entry a line, everything but printable ASCII escaped.

    Strings and numbers are written in their shortest common form; a key that occurs twice stays twice. The tokens are
    laid out in chunks, each from the depth at which it begins, so the work grows with the text.
    """
    def laid_out(tokens):
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(_CHUNK)),
                             lambda at: F.slice(tokens, at + 1, F.lit(_CHUNK)))

        def written(parts):
            steps = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda n, t: n + _step(t)))
            starts = F.aggregate(steps, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
            return F.array_join(F.transform(F.arrays_zip(parts.alias("c"), starts.alias("d")), lambda z: F.coalesce(F.aggregate(
                z["c"], F.struct(F.lit("").alias("text"), z["d"].alias("depth")),
                lambda s, t: F.struct(F.concat(s["text"], _piece(t, s["depth"])).alias("text"), (s["depth"] + _step(t)).alias("depth")),
                lambda s: s["text"]), F.lit(""))), "")

        return bind(chunks, written)

    return F.when(col(text).isNotNull(), bind(F.regexp_extract_all(col(text), F.lit(_TOKEN), F.lit(0)), laid_out))
