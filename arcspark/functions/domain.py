"""Public suffixes: effective top-level and registrable domain of a host."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark import schemas

#: A small list of our own; ``suffix_rules`` takes any text in the same form.
SUFFIXES = """
com org net edu gov mil int info biz name pro aero coop museum mobi travel jobs arpa io co me tv cc ws app dev xyz
ac ad ae ai am at au be bg br by ca ch ci cl cn co.uk cz de dk ee es eu fi fr gr hk hr hu id ie il in ir is it jp kr lt lu lv
mx my nl no nz ph pk pl pt ro rs ru se sg si sk th tr tw ua uk us uy vn za
ac.uk gov.uk org.uk ltd.uk plc.uk me.uk net.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz org.nz net.nz ac.nz govt.nz
com.br net.br org.br gov.br edu.br com.cn net.cn org.cn gov.cn edu.cn co.jp or.jp ne.jp ac.jp go.jp co.kr or.kr co.in net.in org.in
com.mx com.tr com.tw com.hk com.sg co.za org.za com.ar com.pl com.ua com.ru co.il org.il com.vn
*.ck !www.ck *.er *.kawasaki.jp !city.kawasaki.jp *.kobe.jp !city.kobe.jp github.io blogspot.com
"""
_IPV4 = re.compile(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
_BAD = re.compile(r"[^0-9a-z\-._]")


@cache
def suffix_rules(text: str = SUFFIXES) -> dict[str, frozenset[str]]:
    """Last label -> what may stand before it: '' alone, a label, '*', '!label' or '*.label'."""
    rules: dict[str, set[str]] = {}
    for rule in text.split():
        mark, rule = ("!", rule[1:]) if rule[0] == "!" else ("", rule)
        head, _, last = rule.rpartition(".")
        rules.setdefault(last, set()).add(mark + head)
    return {k: frozenset(v) for k, v in rules.items()}


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a public-suffix file: a rule a line, up to the first blank; ``//`` begins a comment."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    return spark.read.text(path).select(rule.alias("rule")).where("rule <> '' AND rule NOT LIKE '//%'").distinct()


def rules_table(spark: SparkSession, text: str = SUFFIXES) -> DataFrame:
    return spark.createDataFrame([(r,) for r in text.split()], "rule string")


#: Rules that may be broadcast (the public list has about ten thousand).
MOST_RULES = 100_000


def with_suffix(hosts: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """``hosts`` and ``suffix``, ``registrable``: by a join with the rules, in built-in functions alone.

    The longest rule counts, and an exception before any other: it is a suffix
    without its first label. A wildcard stands for one label. Hosts without a
    rule have neither, and one that is a suffix itself has no registrable name.
    """
    known = hosts.select(F.col(host).alias("name")).where(F.col(host).isNotNull()).distinct()
    labels = F.split(F.regexp_replace(F.lower("name"), r"\.$", ""), r"\.")
    longest = rules.agg(F.max(F.size(F.split("rule", r"\.")))).first()[0] or 0
    each = known.select("name", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(longest, 1))))).alias("k"))
    last = lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), ".")
    k = F.col("k")
    tries = F.array(
        F.struct(last(k).alias("rule"), F.lit(0).alias("first"), k.alias("n")),
        F.struct(F.concat(F.lit("*."), last(F.greatest(k - 1, F.lit(0)))).alias("rule"), F.lit(0).alias("first"), k.alias("n")),
        F.struct(F.concat(F.lit("!"), last(k)).alias("rule"), F.lit(1).alias("first"), (k - 1).alias("n")),
    )
    asked = each.select("name", "labels", F.explode(tries).alias("t")).select("name", "labels", "t.*")
    side = F.broadcast(rules) if rules.count() <= MOST_RULES else rules
    found = asked.join(side.select("rule").distinct(), "rule").groupBy("name").agg(F.max(F.struct("first", "n", "labels")).alias("x"))
    n = F.col("x.n")
    tail = lambda k: F.array_join(F.slice("x.labels", F.size("x.labels") - k + 1, k), ".")
    found = found.select(F.col("name").alias(host), tail(n).alias("suffix"), F.when(F.size("x.labels") > n, tail(n + 1)).alias("registrable"))
    return hosts.join(found, host, "left")


def _depth(host: str, rules: dict[str, frozenset[str]]) -> tuple[list[str], int] | None:
    """Labels and how many of them are the suffix."""
    host = host.removesuffix(".").removeprefix("*")
    labels = host.split(".")
    if _BAD.search(host) or len(labels) < 2:
        return None
    found = rules.get(labels[-1], frozenset())
    second, third = labels[-2], labels[-3] if len(labels) > 2 else None
    if second in found or "*" in found:
        return labels, 1 if f"!{second}" in found else 2
    if f"*.{second}" in found:
        if third is not None and f"!{third}.{second}" in found:
            return labels, 2
        return (labels, 3) if len(labels) >= 4 else None
    return (labels, 1) if "" in found else None


def tld(host: str | None, rules: dict[str, frozenset[str]] | None = None) -> str | None:
    if not host:
        return None
    if _IPV4.match(host):
        return "inaddr-arpa.arpa"
    found = _depth(host, rules or suffix_rules())
    return ".".join(found[0][-found[1] :]) if found else None


def root_domain(host: str | None, rules: dict[str, frozenset[str]] | None = None) -> str | None:
    """The suffix and one label; null if there is none before it."""
    if not host:
        return None
    if _IPV4.match(host):
        return host
    found = _depth(host, rules or suffix_rules())
    return ".".join(found[0][-found[1] - 1 :]) if found and len(found[0]) > found[1] else None


def is_valid_domain(host: str | None) -> bool:
    return bool(host) and len(host) <= 255 and host.count(".") < 128 and root_domain(host) is not None


@F.pandas_udf(schemas.S)
def root_domain_of(hosts: pd.Series) -> pd.Series:
    return hosts.map(root_domain, na_action="ignore")


@F.pandas_udf(schemas.S)
def tld_of(hosts: pd.Series) -> pd.Series:
    return hosts.map(tld, na_action="ignore")


@F.pandas_udf(schemas.BOOLEAN)
def is_valid_domain_of(hosts: pd.Series) -> pd.Series:
    return hosts.map(is_valid_domain)


def fast_host(url: Column) -> Column:
    """The host between scheme and path, without user and port, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:/*(?:[^/?#@]*@)?([^/?#:]*)", 1))
