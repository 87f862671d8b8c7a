"""File names out of links."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def link_basename(link: str | Column) -> Column:
    """Last path segment of a link, '' if there is none; a query string stays part of it.

    Empty and '.' segments do not count, as in POSIX paths. Splitting keeps the cost linear in the
    length of the link, which a regular expression with nested repeats would not.
    """
    parts = F.array_remove(F.array_remove(F.split(link, "/"), ""), ".")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.when((F.col(link) if isinstance(link, str) else link).isNotNull(), name)


def target_path(folder: str, filename: str | Column) -> Column:
    return F.concat_ws("/", F.lit(folder.rstrip("/") or "/"), filename)
