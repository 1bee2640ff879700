"""URL helpers: the first URL of a line, its host, extension and version."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions whose contents are data, not code.
DATA_FORMATS = ("json", "jsonl", "ndjson", "yaml", "yml", "toml", "xml", "csv", "tsv", "txt", "md", "rst")


def first_url(line: Column) -> Column:
    """The first http(s) URL, up to white space, a quote, a backtick, `)` or `>`; null if there is none."""
    return F.nullif(F.regexp_extract(line, "https?://[^\\s\"'`)>]+", 0), F.lit(""))


def url_host(url: Column, strict: bool = False) -> Column:
    """Host without user info and port; null unless http(s).

    User info ends at the first @ anywhere. With strict it must end before the first slash, so that
    an @ in the path can't pass off another host.
    """
    user = "(?:[^/?#@]*@)?" if strict else "(?:[^@]*@)?"
    host = F.regexp_extract(url, f"^https?://{user}([^/:?#]*)", 1)
    return F.when(url.rlike("^https?://"), host)


def url_extension(url: Column) -> Column:
    """What follows the last dot of the last path segment, without query and fragment; null without a dot."""
    last = F.element_at(F.split(F.element_at(F.split(url, "[?#]"), 1), "/"), -1)
    return F.when(last.contains("."), F.substring_index(last, ".", -1))


def has_version(url: Column) -> Column:
    """Whether a path segment or parameter is a dotted version, ended by a slash, space or double quote."""
    return url.rlike('[/=]v?[0-9]+(?:\\.[0-9]+)+[/\\s"]')


def is_trusted_host(url: Column, hosts: Iterable[str], strict: bool = False) -> Column:
    names = sorted({h.lower() for h in hosts})
    return F.coalesce(F.lower(url_host(url, strict)).isin(names), F.lit(False)) if names else F.lit(False)


def is_data_format(url: Column, extra: Iterable[str] = ()) -> Column:
    names = sorted({*DATA_FORMATS, *(e.lstrip(".").lower() for e in extra)})
    return F.coalesce(F.lower(url_extension(url)).isin(names), F.lit(False))


def disposition(url: Column, hosts: Iterable[str] = (), extra: Iterable[str] = (), strict: bool = False) -> Column:
    """Why an unversioned fetch is allowed, first reason first; null if it is a finding or there is no URL."""
    return (
        F.when(has_version(url), "versioned URL")
        .when(is_trusted_host(url, hosts, strict), "trusted host")
        .when(is_data_format(url, extra), "data format URL")
    )
