"""Secret scanning of single values: ``Column -> Column``."""

from pyspark.sql import Column, functions as F

from fleetlens import catalogs
from fleetlens.functions.text import col

# A literal each of these patterns cannot match without.  Looking for it is several times
# cheaper than the search it saves on a long text.
_NEEDS = {
    "aws_access_key_id": "AKIA",
    "connection_string_with_password": "://",
    "dotenv_assignment": "=",
    "github_token": "_",
    "pem_private_key": "-----",
}


def _java(pattern: str) -> str:
    """Unicode classes everywhere, and only a line feed ends a line under (?m)."""
    return "(?U)" + pattern.replace("(?m)", "(?md)")


def _match(c: Column, name: str, pattern: str) -> Column:
    hit = c.rlike(_java(pattern))
    return F.contains(c, F.lit(_NEEDS[name])) & hit if name in _NEEDS else hit


# No pattern matches fewer characters: only connection_string_with_password, which needs "://", matches fewer than 20.
_LEAST = 20


def secret_value_pattern(c) -> Column:
    """Name of the first secret pattern found in the value, NULL when clean."""
    c = col(c)
    found = F.coalesce(*[F.when(_match(c, n, p), F.lit(n)) for n, p in catalogs.SECRET_VALUES])
    return F.when((F.length(c) >= _LEAST) | F.contains(c, F.lit(_NEEDS["connection_string_with_password"])), found)


# One search for all patterns; nearly every name ends there.
_ANY_FILE = _java("|".join(f"(?:{p})" for _, p in catalogs.SECRET_FILES))


def secret_file_pattern(path) -> Column:
    """Name of the first secret file-name pattern matching the last path component."""
    name = F.substring_index(F.rtrim(F.translate(col(path), "\\", "/"), F.lit("/")), "/", -1)
    found = F.coalesce(*[F.when(name.rlike(_java(p)), F.lit(n)) for n, p in catalogs.SECRET_FILES])
    return F.when(name.rlike(_ANY_FILE), found)
