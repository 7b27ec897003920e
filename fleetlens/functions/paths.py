"""Path helpers: ``Column -> Column``, all evaluated in the JVM."""

import re

from pyspark.sql import Column, functions as F

from fleetlens import catalogs
from fleetlens.functions.text import col, strip

_IGNORED = "|".join(re.escape(d) for d in catalogs.IGNORED_DIRS if not d.startswith("."))
IGNORED_ANCESTOR = rf"(?:^|/)(?:\.[^/]*|{_IGNORED})/"
# The directories of a path before the first ignored one.
VISIBLE_PREFIX = rf"^(?:(?!\.|(?:{_IGNORED})/)[^/]*/)*+"
# A path with a directory behind those: what IGNORED_ANCESTOR finds, tried from the start only.
BELOW_IGNORED = VISIBLE_PREFIX + "[^/]*/"


def posix(c) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def basename(c) -> Column:
    return F.substring_index(posix(c), "/", -1)


def dir_of(c) -> Column:
    """Directory part, ``""`` at the root."""
    return F.left(posix(c), F.length(col(c)) - F.length(basename(c)) - 1)


def extension(c) -> Column:
    """Lower-cased extension without the dot; ``""`` for dot-files and names without one."""
    name = basename(c)
    suffix = F.substring_index(name, ".", -1)
    # Something has to stand before the dot.
    return F.when(F.length(name) - F.length(suffix) > 1, F.lower(suffix)).otherwise("")


def rel_path(c) -> Column:
    """Trimmed path without one leading ``./``; the dot of ``.env`` stays."""
    return F.regexp_replace(strip(posix(c)), r"^\./", "")


def run_in(directory, command) -> Column:
    directory, command = col(directory), command if isinstance(command, Column) else F.lit(command)
    return F.when(directory != "", F.concat(F.lit("cd "), directory, F.lit(" && "), command)) \
        .otherwise(command)


def module_of(c) -> Column:
    """Dotted module of a ``.py`` path."""
    c = posix(c)
    return F.translate(F.left(c, F.length(c) - 3), "/", ".")


def join_path(directory, target) -> Column:
    """``directory / target`` with ``.`` and empty components dropped; ``..`` is not resolved."""
    directory, target = col(directory), col(target)
    absolute = F.startswith(target, F.lit("/"))
    full = F.when(absolute | (directory == ""), target).otherwise(F.concat_ws("/", directory, target))
    parts = F.filter(F.split(full, "/"), lambda p: ~p.isin("", "."))
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("."))
