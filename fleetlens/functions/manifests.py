"""Dependency manifests: one ``Column -> ARRAY<STRING>`` per format.

A manifest is one row, so parsing is a projection: nothing is exploded or shuffled.
"""

from pyspark.sql import Column, functions as F

from fleetlens.functions.text import bind, col, head, no_strings, split_lines, strip

_STRICT_JSON = {"allowSingleQuotes": "false"}
_SECTIONS = "dependencies map<string,string>, devDependencies map<string,string>, main variant"


def _stripped_lines(c) -> Column:
    return F.transform(split_lines(c), strip)


def _present(names) -> Column:
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def requirements_packages(c) -> Column:
    """pip requirements: options, comments and specifiers dropped, extras kept."""
    lines = F.filter(_stripped_lines(c), lambda l: (l != "") & ~l.rlike("^[#-]"))
    return _present(F.transform(
        lines, lambda l: strip(head(F.split(strip(head(F.split(l, "#"))), "[><=!~;@]")))))


def go_mod_packages(c) -> Column:
    """Modules of ``require`` lines and blocks, indirect ones included."""
    text = F.array_join(_stripped_lines(c), "\n")
    # Every opening line starts a new chunk; only chunks after the first start inside a block.
    chunks = F.split(text, r"(?md)^require\s*\(.*$")

    def packages(chunk, i):
        return bind(F.split(chunk, r"(?md)^\)$", 2), lambda parts: block_and_rest(chunk, i, parts))

    def block_and_rest(chunk, i, parts):
        closed = F.size(parts) == 2
        inside = F.when(i > 0, head(parts)).otherwise("")
        outside = F.when(i == 0, chunk).when(closed, F.get(parts, F.lit(1))).otherwise("")
        single = r"^require\s+(\S+)\s+"
        block = F.transform(F.split(inside, "\n"), lambda l: F.when(
            l.rlike(single), F.regexp_extract(l, single, 1)
        ).when(~F.startswith(l, F.lit("//")), F.regexp_extract(l, r"^(\S*)", 1)))
        plain = F.transform(F.split(outside, "\n"), lambda l: F.regexp_extract(l, single, 1))
        return F.concat(block, plain)

    return _present(F.flatten(F.transform(chunks, packages)))


def cargo_packages(c) -> Column:
    """Crates of ``[dependencies]`` and ``[dev-dependencies]`` only."""
    text = F.array_join(_stripped_lines(c), "\n")
    sections = F.filter(F.split(text, r"(?md)^(?=\[)"),
                        lambda s: s.rlike(r"^\[(?:dev-)?dependencies\](?:\n|\z)"))
    return _present(F.flatten(F.transform(sections, lambda s: F.transform(
        F.split(s, "\n"), lambda l: F.regexp_extract(l, r"^([A-Za-z0-9_\-]+)\s*=", 1)))))


def is_json(c) -> Column:
    """Whether the text is one valid JSON document.

    The reader accepts text after the document, so the text is parsed inside an object and
    inside an array; stray text breaks at least one of the two.
    """
    c = col(c)
    wrapped = F.from_json(F.concat(F.lit('{"r":'), c, F.lit("}")), "map<string,string>", _STRICT_JSON)
    listed = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", _STRICT_JSON)
    return wrapped.isNotNull() & F.coalesce(F.size(listed) == 1, F.lit(False))


def package_json(c) -> Column:
    """``STRUCT<packages ARRAY<STRING>, main STRING, root_error STRING, section_error STRING>``.

    Malformed JSON has no packages and no error.  A root or section that is not an object is
    an error of the whole repository.
    """
    c = col(c)
    parsed = F.struct(
        is_json(c).alias("valid"),
        F.from_json(c, "map<string,string>", _STRICT_JSON).alias("root"),
        F.from_json(c, _SECTIONS, _STRICT_JSON).alias("typed"))

    def facts(p):
        root, typed = p["root"], p["typed"]
        ok = p["valid"] & root.isNotNull()

        def keys(section):
            return F.when(ok & typed[section].isNotNull(), F.array_distinct(F.map_keys(typed[section]))) \
                .otherwise(no_strings())

        def not_object(section):
            return F.when(F.map_contains_key(root, section) & typed[section].isNull(),
                          _attribute_error(F.element_at(root, section), "keys"))

        main = F.when(F.schema_of_variant(typed["main"]) == "STRING",
                      F.try_variant_get(typed["main"], "$", "string"))
        return F.struct(
            F.concat(keys("dependencies"), keys("devDependencies")).alias("packages"),
            F.when(ok, main).alias("main"),
            F.when(p["valid"] & root.isNull(), _attribute_error(strip(c), "get")).alias("root_error"),
            F.when(ok, F.coalesce(not_object("dependencies"), not_object("devDependencies")))
            .alias("section_error"))

    return bind(parsed, facts)


def _attribute_error(raw, attribute) -> Column:
    kind = (
        F.when(raw.isNull() | (raw == "null"), "NoneType")
        .when(raw.rlike(r"^\["), "list")
        .when(raw.rlike(r"^(?:true|false)$"), "bool")
        .when(raw.rlike(r"^-?\d+$"), "int")
        .when(raw.rlike(r"^-?\d"), "float")
        .otherwise("str")
    )
    return F.concat(F.lit("'"), kind, F.lit(f"' object has no attribute '{attribute}'"))


_Q1, _Q3 = "'", "'" * 3
# Strings, comments and what lies between them; a quote that nothing closes stands alone.
_TOML_TOKEN = "|".join((
    r'"""(?s:.*?)"""', rf"{_Q3}(?s:.*?){_Q3}", r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', rf"{_Q1}[^{_Q1}\n]*+{_Q1}",
    r"#[^\n]*+", rf'[^"{_Q1}#]++', rf'["{_Q1}]'))
_TOML_QUOTES = rf'(?s)^(?:"{{3}}|{_Q1}{{3}}|["{_Q1}])\n?|(?:"{{3}}|{_Q1}{{3}}|["{_Q1}])\z'
_TOML_HEADER = r"(?m)^(?=[ \t]*\[[^\[\]\n=,]+\][ \t\r]*$)"
# What a value may begin with; strings are masked by then.
_TOML_VALUE = r"[\x01\[{0-9+\-tfin]"


def pyproject_packages(c) -> Column:
    """``STRUCT<packages, error>``: PEP 621 and Poetry dependency names.

    Read by rule: strings are masked, so that brackets and equal signs outside of them can be trusted,
    and the text is split at its table headers. ``dependencies`` has to be an array under
    ``[project]``, Poetry's names keys or sub-tables of ``[tool.poetry.dependencies]``. Of invalid
    documents only a value that cannot begin as it does is recognised; others give what can be read.
    """
    tokens = F.filter(F.regexp_extract_all(col(c), F.lit(_TOML_TOKEN), F.lit(0)),
                      lambda t: ~F.startswith(t, F.lit("#")))

    def is_text(t):
        return t.rlike(rf'^["{_Q1}]') & (F.length(t) > 1)

    def read(t):
        masked = F.transform(t, lambda x, i: F.when(
            is_text(x), F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02"))).otherwise(x))
        return bind(F.array_join(masked, ""), lambda m: facts(t, m))

    def unmasked(t, part):
        """The text that a placeholder stands for, without its quotes; other text as it is."""
        i = F.regexp_extract(part, r"\x01(\d+)\x02", 1)
        return F.when(i == "", part).otherwise(
            F.regexp_replace(F.get(t, i.try_cast("int")), _TOML_QUOTES, ""))

    def facts(t, m):
        return bind(F.split(m, _TOML_HEADER), lambda parts: F.struct(
            F.concat(_present(listed(t, parts)), _present(tables(t, parts))).alias("packages"),
            problem(m).alias("error")))

    def under(parts, name):
        return F.array_join(F.filter(parts, lambda p: p.rlike(rf"^[ \t]*\[[ \t]*{name}[ \t]*\]")), "\n")

    def listed(t, parts):
        body = F.regexp_extract(under(parts, "project"), r"(?m)^[ \t]*dependencies[ \t]*=[ \t]*\[([^\]]*)\]", 1)
        return F.transform(F.regexp_extract_all(body, F.lit(r"\x01\d+\x02"), F.lit(0)), lambda p: strip(
            head(F.split(unmasked(t, p), r"(?U)[><=!~;\[@\s]"))))

    def tables(t, parts):
        name = r"([A-Za-z0-9_-]+|\x01\d+\x02)"
        keys = F.regexp_extract_all(under(parts, r"tool\.poetry\.dependencies"),
                                    F.lit(rf"(?m)^[ \t]*{name}(?:[ \t]*\.[^=\n]*)?[ \t]*="), F.lit(1))
        sub = rf"^[ \t]*\[[ \t]*tool\.poetry\.dependencies\.{name}"
        subs = F.transform(F.filter(parts, lambda p: p.rlike(sub)), lambda p: F.regexp_extract(p, sub, 1))
        return F.array_distinct(F.filter(F.transform(F.concat(keys, subs), lambda k: unmasked(t, k)),
                                         lambda n: F.lower(n) != "python"))

    def problem(m):
        """The first value that cannot begin as it does, told as a TOML reader tells it."""
        bad = rf"^(\s*[A-Za-z0-9_.-]+[ \t]*+=[ \t]*+)(?!{_TOML_VALUE})"
        lines = F.transform(F.split(m, "\n"), lambda l, i: F.struct(
            (i + 1).alias("line"), l.rlike(bad).alias("bad"),
            (F.length(F.regexp_extract(l, bad, 1)) + 1).alias("column")))
        return bind(head(F.filter(lines, lambda l: l["bad"])), lambda first: F.when(
            first.isNotNull(), F.format_string("Invalid value (at line %d, column %d)", first["line"], first["column"])))

    return F.when(col(c).isNotNull(), bind(tokens, read))
