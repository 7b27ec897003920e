"""README parsing: ``Column -> Column`` over one whole README."""

from pyspark.sql import Column, functions as F

from fleetlens.functions.text import bind, byte_prefix, col, split_lines, strip

# A whole fenced block, or one line.
_TOKEN = (r"(?md)^(?:```(?s:.*?)(?:\n```[^\n]*|\z)|~~~(?s:.*?)(?:\n~~~[^\n]*|\z)|[^\n]*)$")
_RULE = r"(?U)^(?:\s*[-*_]){3,}\s*$"


def readme_text(content, max_bytes: int | None = None) -> Column:
    """The whole README, or its first ``max_bytes`` bytes where that is asked for."""
    return col(content) if max_bytes is None else byte_prefix(content, max_bytes)


def readme_title(c) -> Column:
    """First H1, NULL without one."""
    pattern = r"(?Umd)^#\s+(.+)$"
    return F.when(col(c).rlike(pattern), strip(F.regexp_extract(col(c), pattern, 1)))


def readme_description(c) -> Column:
    """First paragraph that is not a heading, badge, HTML or fence line."""
    def classified(line):
        return F.struct(line.alias("text"), F.when(
            (line == "") | F.startswith(line, F.lit("#")), "stop")
            .when(line.rlike(r"^(?:!\[|<|```)"), "skip").otherwise("text").alias("kind"))

    def paragraph(lines):
        kinds = F.transform(lines, lambda l: l["kind"])
        found = F.array_position(kinds, "text").cast("int")
        return F.when(found > 0, bind(
            F.slice(lines, F.greatest(found, F.lit(1)), F.size(lines)), until_stop))

    def until_stop(lines):
        stop = F.array_position(F.transform(lines, lambda l: l["kind"]), "stop").cast("int")
        kept = F.slice(lines, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(lines)))
        return F.array_join(F.transform(F.filter(kept, lambda l: l["kind"] == "text"),
                                        lambda l: l["text"]), " ")

    return bind(F.transform(split_lines(c), lambda l: classified(strip(l))), paragraph)


def readme_excerpt(c, max_chars: int | None = None) -> Column:
    return col(c) if max_chars is None else F.left(col(c), F.lit(max_chars))


def readme_sections(c) -> Column:
    """``ARRAY<STRUCT<heading, body>>`` for H2 and deeper.

    Lines inside a fence are never headings.  A deeper heading discards what its parent had so
    far; an H1 closes the open section; a repeated heading keeps its first position and its
    last body.
    """
    tokens = F.regexp_extract_all(F.array_join(split_lines(c), "\n"), F.lit(_TOKEN), F.lit(0))
    return bind(tokens, lambda t: bind(_headings(t), lambda h: bind(_flushed(t, h), _last_bodies)))


def _headings(tokens) -> Column:
    heading = r"(?U)^(#{1,6})\s+(.+)$"
    marked = F.transform(tokens, lambda t, i: F.struct(t.alias("line"), i.alias("at")))
    return F.transform(F.filter(marked, lambda m: m["line"].rlike(heading)), lambda m: F.struct(
        m["at"].alias("at"),
        F.length(F.regexp_extract(m["line"], heading, 1)).alias("level"),
        strip(F.regexp_extract(m["line"], heading, 2)).alias("text")))


def _flushed(tokens, headings) -> Column:
    """Sections that are kept when the next heading of any depth opens."""
    def section(h, i):
        following = F.get(headings, i + 1)
        end = F.coalesce(following["at"], F.size(tokens))
        lines = F.split(F.array_join(F.slice(tokens, h["at"] + 2, end - h["at"] - 1), "\n"), "\n")
        body = strip(F.array_join(F.filter(lines, lambda l: ~l.rlike(_RULE)), "\n"))
        closed = following.isNull() | (following["level"] == 1) | (following["level"] <= h["level"])
        return F.struct(h["text"].alias("heading"),
                        F.when(closed & (h["level"] > 1), body).otherwise("").alias("body"))

    return F.filter(F.transform(headings, section), lambda s: s["body"] != "")


def _last_bodies(sections) -> Column:
    names = F.array_distinct(F.transform(sections, lambda s: s["heading"]))
    return F.transform(names, lambda name: F.struct(
        name.alias("heading"),
        F.element_at(F.filter(sections, lambda s: s["heading"] == name), -1)["body"].alias("body")))
