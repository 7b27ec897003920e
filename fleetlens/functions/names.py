"""Dependency and project name helpers: ``Column -> Column``."""

from pyspark.sql import Column, functions as F

from fleetlens import catalogs
from fleetlens.functions.text import col, literal_map, strip


def normalise_dep(c) -> Column:
    """Bare lower-cased name: no extras, specifier or ``@version``; a leading ``@`` stays."""
    bare = F.regexp_extract(strip(c), r"^([^<>=!~;\[\s]*)", 1)
    return F.lower(F.regexp_replace(bare, r"^(.[^@]*)@.*$", "$1"))


def dependency_purpose(name) -> Column:
    """Purpose by exact normalised name, by naming convention, or the sentinel."""
    return purpose_of_key(normalise_dep(name))


def purpose_of_key(key) -> Column:
    return F.coalesce(F.element_at(literal_map(catalogs.PURPOSES), key), purpose_by_convention(key))


def purpose_by_convention(key) -> Column:
    key = col(key)
    return (
        F.when(key.rlike(r"(?s)^@types/."),
               F.concat(F.lit("TypeScript type declarations for "), F.substr(key, F.lit(8)), F.lit(".")))
        .when(key.rlike(r"(?s)^eslint-plugin-."),
              F.concat(F.lit("ESLint rule set for "), F.substr(key, F.lit(15)), F.lit(".")))
        .otherwise(F.lit(catalogs.PURPOSE_UNKNOWN))
    )


def docker_slug(project_name) -> Column:
    """Image name of a project; ``app`` when nothing usable remains."""
    name = F.coalesce(F.when(col(project_name) != "", col(project_name)), F.lit("app"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "app").otherwise(slug)


def normalise_url(c) -> Column:
    return F.regexp_replace(strip(c), r"/+\z", "")


def is_repo_url(c) -> Column:
    return strip(c).rlike(catalogs.REPO_URL_PATTERN)
