"""Components of canonical URLs, in built-in functions: where they lie, what they hold, and URLs with some replaced.

What these take is a URL as ``canonical_url`` gives it: scheme, two slashes,
authority, path, query, fragment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, user part, host, port, path, query, fragment; a part that is there keeps its mark.
PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*:)//([^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)(:[^/?#]*)?(/[^?#]*)?(\?[^#]*)?(#[\s\S]*)?\z"
NAMES = ("scheme", "user", "host", "port", "path", "query", "ref")
#: Characters of the mark before and after a part, as it is matched.
_BEFORE = {"port": 1, "query": 1, "ref": 1}
_AFTER = {"scheme": 1, "user": 1}
_IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def _held(url: Column) -> dict[str, Column]:
    return {name: F.regexp_extract(url, PATTERN, i) for i, name in enumerate(NAMES, 1)}


def part(url: Column, name: str) -> Column:
    """A component without its marks; null if it is not there, or the URL is none. A host may be empty."""
    held = _held(url)[name]
    before, after = _BEFORE.get(name, 0), _AFTER.get(name, 0)
    bare = F.substring(held, F.lit(1 + before), F.char_length(held) - before - after)
    there = url.rlike(PATTERN) if name == "host" else held != ""
    return F.when(there, bare)


def spans(url: Column) -> Column:
    """A struct of components, each a struct of its first character, from 0, and its length; null where it is not there."""
    held, at, out = _held(url), F.lit(0), []
    for name in NAMES:
        before, after, n = _BEFORE.get(name, 0), _AFTER.get(name, 0), F.char_length(held[name])
        there = url.rlike(PATTERN) if name == "host" else n > 0
        out.append(F.when(there, F.struct((at + before).cast("int").alias("begin"), (n - before - after).cast("int").alias("len"))).alias(name))
        at = at + n + (2 if name == "scheme" else 0)
    return F.when(url.rlike(PATTERN), F.struct(*out))


def replaced(url: Column, **parts: Column | str | None) -> Column:
    """The URL with components set to a column or text, or taken out with None. Names are those of NAMES; scheme and host can't go."""
    held = _held(url)
    for name, value in parts.items():
        if name not in held or value is None and name in ("scheme", "host"):
            raise ValueError(f"{name} is no component that can be replaced by {value}")
        mark = {"scheme": ("", ":"), "user": ("", "@"), "port": (":", ""), "query": ("?", ""), "ref": ("#", "")}.get(name, ("", ""))
        held[name] = F.lit("") if value is None else F.concat(F.lit(mark[0]), value if isinstance(value, Column) else F.lit(value), F.lit(mark[1]))
    # a path is there and begins with a slash
    path = F.when(held["path"].startswith("/"), held["path"]).otherwise(F.concat(F.lit("/"), held["path"]))
    whole = [F.lit("//") if n == "//" else path if n == "path" else held[n] for n in ("scheme", "//", *NAMES[1:])]
    return F.when(url.rlike(PATTERN), F.concat(*whole))


def domain_is(url: Column, domain: str) -> Column:
    """Whether the host is ``domain`` or lies below it; a host's last dot counts only if the domain has one too."""
    wanted = domain.lower().removeprefix(".")
    host = F.lower(part(url, "host"))
    bare = host if wanted.endswith(".") else F.regexp_replace(host, r"\.$", "")
    return F.coalesce((F.lit(wanted != "")) & ((bare == wanted) & F.lit(not domain.startswith(".")) | bare.endswith(f".{wanted}")), F.lit(False))


def host_is_ip(url: Column) -> Column:
    """Whether the host is an address: four numbers, or any in brackets."""
    host = part(url, "host")
    return F.coalesce(host.rlike(_IPV4) | host.rlike(r"^\[[0-9A-Fa-f:.]+\]$"), F.lit(False))


def file_name(url: Column) -> Column:
    """What follows the path's last slash, up to its last semicolon; null without a path."""
    path = part(url, "path")
    return F.regexp_extract(F.regexp_replace(path, r"(?<=.);[^;]*$", ""), r"([^/]*)$", 1)


def query_pairs(url: Column) -> Column:
    """The query's keys and values in order, as they stand; a key without a sign of equality has an empty value. Null without a query."""
    query = part(url, "query")
    fields = F.split(F.regexp_replace(query, "&$", ""), "&")
    pairs = F.transform(fields, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.char_length(x))).otherwise("").alias("value")))
    return F.when(query == "", F.slice(pairs, 1, 0)).otherwise(pairs)
