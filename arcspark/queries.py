"""Registered queries of the archive operators, each beside its SQL.

``query(sql)`` registers a function under its name; ``sql`` is the DuckDB text
that gives the same rows, or None where SQL can't say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcspark.functions import codec, domain, dom, hashing, headers, http, mime, net, records, text, url, url_parts
from arcspark.operators import aggregates, blocks, bloom_table, long_sets, near_duplicates, ordering, patterns
from arcspark.plans.archive_query import ArchiveQuery, Controller, SortOrder, register
from arcspark.plans.shards import ShardedResult
from arcspark.sources import positions
from arcspark.sources.arc import list_archives, read_arc, read_arc_binary, write_arc
from arcspark.sources.names import read_names, write_names
from arcspark.sources.seqfile import range_mb, read_sequence_files, write_sequence_files
from arcspark.sources.sequence import read_sequence, write_sequence
from arcspark.storage import materialize, scratch
from arcspark.streaming import ttl, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(ts: Column) -> Column:
    """Milliseconds of a time as SQL's epoch_ms has them: the nearest, halves away from 1970."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))


# ----------------------------------------------------------- archives (sources)


#: Archives that this process wrote, by application and tables.
_archives: dict[tuple[str, str], str] = {}


def archive_of_pages(spark: SparkSession, sf_dir: str) -> str:
    """The pages table as archive files in the shared folder."""
    rows = _table(spark, sf_dir, "pages").select(
        "url", F.lit("127.0.0.1").alias("host_ip"), F.lit("20240101000000").alias("ts14"), F.lit("text/html").alias("mime_type"),
        F.array(headers.header(None, "HTTP/1.1 200 OK"), headers.header("Content-Type", " text/html; charset=utf-8")).alias("headers"), F.encode("html", "UTF-8").alias("content"),
    )
    known = spark.sparkContext.applicationId, sf_dir
    if known not in _archives:
        path = scratch(spark, "pages-arc")
        write_arc(rows, path)
        _archives[known] = path
    return _archives[known]


@query("SELECT url, CAST(octet_length(encode(html)) AS BIGINT) AS content_length, md5(html) AS content_md5 FROM pages")
def arc_scan_raw(spark, sf_dir):
    rows = read_arc(spark, archive_of_pages(spark, sf_dir))
    return rows.select("url", headers.split_value(F.col("value"))["content_length"].cast("long").alias("content_length"), F.md5(headers.content_of(F.col("value"))).alias("content_md5"))


@query("SELECT url AS uri, '127.0.0.1' AS host_ip, CAST(1704067200000 AS BIGINT) AS timestamp, 'text/html' AS mime_type, 0 AS flags, md5(html) AS content_md5, 6 AS n_headers FROM pages")
def arc_item_scan(spark, sf_dir):
    rows = read_arc(spark, archive_of_pages(spark, sf_dir), records="item")
    return rows.select("uri", "host_ip", "timestamp", "mime_type", "flags", F.md5("content").alias("content_md5"), F.size("header_items").alias("n_headers"))


@query("SELECT url, md5(html) AS content_md5 FROM pages")
def arc_scan_binary_file(spark, sf_dir):
    rows = read_arc_binary(spark, archive_of_pages(spark, sf_dir), item=True)
    return rows.select(F.col("uri").alias("url"), F.md5("content").alias("content_md5"))


@query("SELECT url AS uri, '127.0.0.1' AS host_ip, CAST(1704067200000 AS BIGINT) AS timestamp, 'text/html' AS mime_type, md5(html) AS content_md5, ' text/html; charset=utf-8' AS content_type FROM pages")
def raw_to_item(spark, sf_dir):
    rows = read_arc(spark, archive_of_pages(spark, sf_dir))
    item = rows.select(headers.item_of(F.col("value"), F.col("url")).alias("i")).select("i.*")
    return item.select("uri", "host_ip", "timestamp", "mime_type", F.md5("content").alias("content_md5"), headers.find(F.col("header_items"), "content-type").alias("content_type"))


@query("SELECT 'ACCEPT_HTML' AS disposition, count(*) AS n, CAST(sum(octet_length(encode(html))) AS BIGINT) AS content_bytes FROM pages HAVING count(*) > 0")
def arc_disposition_counts(spark, sf_dir):
    """The sample job: lengths by what would become of each record."""
    rows = read_arc(spark, archive_of_pages(spark, sf_dir), records="item")
    return rows.groupBy(mime.disposition(F.col("mime_type")).alias("disposition")).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("content_bytes"))


@query("SELECT mime_type, disposition, count(*) AS n FROM (SELECT page_id % 4 AS k FROM pages) JOIN (VALUES (0, 'text/html', 'ACCEPT_HTML'), (1, 'text/plain', 'ACCEPT_TEXT'), (2, 'image/png', 'REJECT'), (3, 'TEXT/HTML; charset=utf-8', 'ACCEPT_HTML')) AS t(k, mime_type, disposition) USING (k) GROUP BY ALL")
def arc_mixed_dispositions(spark, sf_dir):
    """Pages archived under four MIME types, read back and sorted into what would become of them."""
    kinds = F.array(*map(F.lit, ("text/html", "text/plain", "image/png", "TEXT/HTML; charset=utf-8")))
    path = scratch(spark, "kinds-arc")
    rows = _table(spark, sf_dir, "pages").select("url", F.lit("127.0.0.1").alias("host_ip"), F.lit("20240101000000").alias("ts14"), F.get(kinds, (F.col("page_id") % 4).cast("int")).alias("mime"), F.encode("html", "UTF-8").alias("content"))
    # a blank would end the type in the metadata line: what follows it travels as a header
    rows = rows.select("url", "host_ip", "ts14", F.regexp_replace("mime", " .*", "").alias("mime_type"), F.array(headers.header("Content-Type", F.col("mime"))).alias("headers"), "content")
    write_arc(rows, path)
    kind = headers.find(F.col("header_items"), "content-type")
    return read_arc(spark, path, records="item").groupBy(kind.alias("mime_type"), mime.disposition(kind).alias("disposition")).agg(F.count("*").alias("n"))


@query("SELECT 3 AS n_partitions, count(*) AS n_rows FROM pages")
def split_packing(spark, sf_dir):
    """Six archive files, two to a partition."""
    path = scratch(spark, "packed-arc")
    pages = read_arc(spark, archive_of_pages(spark, sf_dir), records="item").select(F.col("uri").alias("url"), "host_ip", F.lit("20240101000000").alias("ts14"), "mime_type", F.col("header_items").alias("headers"), "content")
    write_arc(pages.repartition(6), path)
    rows = read_arc(spark, path, filesPerPartition=2)
    return rows.agg(F.lit(rows.rdd.getNumPartitions()).alias("n_partitions"), F.count("*").alias("n_rows"))


@query("SELECT url, CAST(octet_length(encode(html)) AS BIGINT) AS kept, true AS named_by_prefix FROM pages")
def arc_header_prefix(spark, sf_dir):
    """The own headers under a name of the caller's choice, and back to an item."""
    rows = read_arc(spark, archive_of_pages(spark, sf_dir), headerPrefix="x-crawl-")
    item = headers.item_of(F.col("value"), F.col("url"), "x-crawl-")
    found = rows.select("url", item.alias("i"), headers.item_of(F.col("value"), F.col("url")).alias("j"))
    return found.select("url", F.octet_length("i.content").cast("long").alias("kept"), (F.col("i.host_ip").isNotNull() & F.col("j.host_ip").isNull()).alias("named_by_prefix"))


# -------------------------------------------------------------------- MIME, HTTP

#: (as a server says it, normalised, what becomes of it).
MIME_TYPES = [
    (None, "no-type", "ACCEPT_OTHER"), ("", "", "ACCEPT_OTHER"), ("*/*", "", "ACCEPT_OTHER"), ("text/html", "text/html", "ACCEPT_HTML"), ("TEXT/HTML; charset=utf-8", "text/html", "ACCEPT_HTML"),
    ("  text/html", "text/html", "ACCEPT_HTML"), ("html", "html", "ACCEPT_HTML"), ("application/xhtml+xml", "application/xhtml+xml", "ACCEPT_HTML"), ("text/x-server-html", "text/x-server-html", "ACCEPT_TEXT"),
    ("text/plain", "text/plain", "ACCEPT_TEXT"), ("textual/odd", "textual/odd", "ACCEPT_TEXT"), ("message/rfc822", "message/rfc822", "ACCEPT_TEXT"), ("multipart/mixed", "multipart/mixed", "ACCEPT_TEXT"),
    ("application/pdf", "application/pdf", "ACCEPT_TEXT"), ("pdf", "pdf", "ACCEPT_TEXT"), ("application/x-javascript", "application/x-javascript", "ACCEPT_TEXT"), ("application/json", "application/json", "ACCEPT_TEXT"),
    ("application/rss+xml", "application/rss+xml", "ACCEPT_TEXT"), ("application/xml", "application/xml", "ACCEPT_TEXT"), ("application/c++", "application/c++", "ACCEPT_TEXT"),
    ("application/vnd.wap.xhtml+xml", "application/vnd.wap.xhtml+xml", "ACCEPT_TEXT"), ("application/vnd.google-earth.kml+xml", "application/vnd.google-earth.kml+xml", "ACCEPT_TEXT"), ("application/x-tex", "application/x-tex", "ACCEPT_TEXT"),
    ("application/vnd.ms-excel", "application/vnd.ms-excel", "ACCEPT_OTHER"), ("application/msword", "application/msword", "ACCEPT_OTHER"), ("application/x-tar", "application/x-tar", "ACCEPT_OTHER"),
    ("image/png", "image/png", "REJECT"), ("image", "image", "REJECT"), ("video/mp4", "video/mp4", "REJECT"), ("audio/mpeg", "audio/mpeg", "REJECT"), ("application/mp3", "application/mp3", "REJECT"), ("gif", "gif", "REJECT"),
    ("application/octet-stream", "application/octet-stream", "REJECT"), ("application/zip", "application/zip", "REJECT"), ("chemical/x-pdb", "chemical/x-pdb", "REJECT"), ("x-world/x-vrml", "x-world/x-vrml", "REJECT"), ("word", "word", "REJECT"),
]


def _dealt(spark, sf_dir, table: str, key: str, values: list[str | None]) -> DataFrame:
    """(key, value): each row of a table with one of the values in turn."""
    items = F.array(*(F.lit(v).cast("string") for v in values))
    return _table(spark, sf_dir, table).select(key, F.get(items, F.pmod(F.col(key), F.lit(len(values))).cast("int")).alias("value"))


def _listed(table: str, key: str, columns: str, rows: list[tuple]) -> str:
    """SQL: each row of a table with one of the rows in turn."""
    say = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {', '.join(map(say, row))})" for i, row in enumerate(rows))
    return f"SELECT {key}, {columns} FROM {table} JOIN (VALUES {listed}) AS t(k, {columns}) ON {key} % {len(rows)} = k"


@query(_listed("pages", "page_id", "mime, disposition", [(m, d) for m, _, d in MIME_TYPES]))
def mime_disposition(spark, sf_dir):
    return _dealt(spark, sf_dir, "pages", "page_id", [m for m, _, _ in MIME_TYPES]).select("page_id", F.col("value").alias("mime"), mime.disposition(F.col("value")).alias("disposition"))


@query(_listed("pages", "page_id", "mime, kind", [(m, k) for m, k, _ in MIME_TYPES]))
def normalize_mime(spark, sf_dir):
    return _dealt(spark, sf_dir, "pages", "page_id", [m for m, _, _ in MIME_TYPES]).select("page_id", F.col("value").alias("mime"), mime.normalize(F.col("value")).alias("kind"))


@query(_listed("pages", "page_id", "mime, is_text, is_html", [(m, d in ("ACCEPT_TEXT", "ACCEPT_HTML"), d == "ACCEPT_HTML") for m, _, d in MIME_TYPES]))
def is_text_type(spark, sf_dir):
    return _dealt(spark, sf_dir, "pages", "page_id", [m for m, _, _ in MIME_TYPES]).select("page_id", F.col("value").alias("mime"), mime.is_text(F.col("value")).alias("is_text"), mime.is_html(F.col("value")).alias("is_html"))


STATUS_LINES = [("HTTP/1.1 200 OK", 200), ("HTTP/1.0 404 Not Found", 404), ("http/1.1 301", 301), ("HTTP", 200), ("", 200), ("junk 500", 200), ("HTTP/1.1  503 Busy", 503), ("HTTP/1.1 99999999999", 0), ("  HTTP/1.1 204", 204)]


@query(_listed("pages", "page_id", "line, status", STATUS_LINES))
def http_status(spark, sf_dir):
    return _dealt(spark, sf_dir, "pages", "page_id", [x for x, _ in STATUS_LINES]).select("page_id", F.col("value").alias("line"), headers.http_status(F.col("value")).alias("status"))


@query("SELECT o_orderkey, CAST(epoch_ms(date_trunc('second', o_orderdate)) AS BIGINT) AS millis FROM orders")
def parse_http_date(spark, sf_dir):
    shown = F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return _table(spark, sf_dir, "orders").select("o_orderkey", http.http_date(shown).alias("millis"))


@query("SELECT o_orderkey, CAST(epoch_ms(date_trunc('second', o_orderdate)) AS BIGINT) AS millis FROM orders")
def parse_ts14(spark, sf_dir):
    shown = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMddHHmmss")
    return _table(spark, sf_dir, "orders").select("o_orderkey", http.ts14_millis(shown).alias("millis"))


CONTENT_TYPES = [("text/html; charset=UTF-8", "text/html", "utf-8"), (' Text/Plain ;charset="x-y"', "text/plain", "x-y"), ("*/*", None, None), ("text", None, None), ("text/html (old); charset=a(b)", "text/html", "a"), ("", None, None)]


@query(_listed("pages", "page_id", "header, content_type, charset", CONTENT_TYPES))
def parse_content_type(spark, sf_dir):
    return _dealt(spark, sf_dir, "pages", "page_id", [x for x, _, _ in CONTENT_TYPES]).select("page_id", F.col("value").alias("header"), http.content_type("value").alias("x")).select("page_id", "header", "x.content_type", "x.charset")


def _page_headers(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages")
    h = F.array(headers.header(None, "HTTP/1.1 200 OK"), headers.header("X-Id", F.col("page_id").cast("string")), headers.header("Set-Cookie", "a=1"), headers.header("x-id", F.col("url")))
    return rows.select("page_id", "url", h.alias("h"))


@query("SELECT page_id, url AS last_id, 'HTTP/1.1 200 OK' AS status FROM pages")
def header_lookup_last(spark, sf_dir):
    return _page_headers(spark, sf_dir).select("page_id", headers.find(F.col("h"), "X-ID").alias("last_id"), headers.find(F.col("h"), None).alias("status"))


@query("SELECT page_id, CAST(page_id AS VARCHAR) || '|' || url AS ids, 2 AS n_keys FROM pages")
def find_header_all(spark, sf_dir):
    return _page_headers(spark, sf_dir).select("page_id", F.array_join(headers.find_all(F.col("h"), "x-id"), "|").alias("ids"), F.size(headers.grouped(F.col("h"))).alias("n_keys"))


@query("SELECT page_id, 'first|HTTP/1.1 200 OK|a=1|new' AS shown FROM pages")
def header_edits(spark, sf_dir):
    h = headers.set_if_absent(headers.prepend(headers.remove(F.col("h"), "X-Id"), "A", "first"), "B", "new")
    return _page_headers(spark, sf_dir).select("page_id", F.array_join(F.transform(h, lambda x: x["item_value"]), "|").alias("shown"))


@query("SELECT page_id, 'x ' || CAST(page_id AS VARCHAR) || ' folded' AS folded, 3 AS n FROM pages")
def parse_http_headers(spark, sf_dir):
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nA: x\t"), F.col("page_id").cast("string"), F.lit("\r\n\tfolded\r\nB : y\r\n"))
    return _table(spark, sf_dir, "pages").select("page_id", headers.parse(block).alias("h")).select("page_id", headers.find(F.col("h"), "a").alias("folded"), F.size("h").alias("n"))


# --------------------------------------------------------------------- URLs


@query("SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:/*([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_host_counts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(domain.fast_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '://www\\.', '://'), '^(https?://[^/?]*)($|\\?)', '\\1/\\2') AS canonical FROM pages")
def page_url_canonical(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", url.canonical_url("url").alias("canonical"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages")
def url_parse(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", url.parse_url("url").alias("p")).select("page_id", "p.scheme", "p.host", "p.query")


@query("SELECT regexp_extract(url, '^[a-z]+://[^/?#:]*?([^./]+\\.[a-z]+)([/?#:]|$)', 1) AS root, count(*) AS n FROM pages GROUP BY 1")
def root_domain_counts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(domain.root_domain_of(domain.fast_host(F.col("url"))).alias("root")).agg(F.count("*").alias("n"))


@query("SELECT regexp_extract(url, '^[a-z]+://[^/?#:]*\\.([a-z]+)([/?#:]|$)', 1) AS tld, count(*) AS n FROM pages GROUP BY 1")
def extract_tld(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(domain.tld_of(domain.fast_host(F.col("url"))).alias("tld")).agg(F.count("*").alias("n"))


@query("SELECT page_id, page_id % 5 = 0 OR page_id % 5 = 4 AS valid FROM pages")
def valid_domain(spark, sf_dir):
    """Hosts as they are, without a dot, under no known suffix, too long, and as addresses."""
    host, k = domain.fast_host(F.col("url")), F.col("page_id") % 5
    made = F.when(k == 0, host).when(k == 1, F.replace(host, F.lit("."), F.lit("-"))).when(k == 2, F.concat(host, F.lit(".unknownzz"))).when(k == 3, F.concat(F.repeat(F.lit("abcdefgh."), 30), host)).otherwise("10.1.2.3")
    return _table(spark, sf_dir, "pages").select("page_id", domain.is_valid_domain_of(made).alias("valid"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'com' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'b.ck' WHEN 3 THEN 'ck' END AS suffix,
  CASE page_id % 5 WHEN 0 THEN 'x' || page_id || '.com' WHEN 1 THEN 'x' || page_id || '.co.uk' WHEN 2 THEN 'x' || page_id || '.b.ck' WHEN 3 THEN 'www.ck' END AS registrable FROM pages""")
def suffix_join(spark, sf_dir):
    """Suffixes by a join with the rules: a plain one, one of two labels, a wildcard, an exception and none."""
    k, x = F.col("page_id") % 5, F.concat(F.lit("x"), F.col("page_id").cast("string"))
    host = F.when(k == 0, F.concat(F.lit("a."), x, F.lit(".com"))).when(k == 1, F.concat(F.lit("a.b."), x, F.lit(".co.uk"))).when(k == 2, F.concat(F.lit("a."), x, F.lit(".b.ck"))).when(k == 3, F.concat(x, F.lit(".www.ck"))).otherwise(F.concat(x, F.lit(".unknownzz")))
    found = domain.with_suffix(_table(spark, sf_dir, "pages").select("page_id", host.alias("host")), "host", domain.rules_table(spark))
    return found.select("page_id", "suffix", "registrable")


@query("SELECT page_id, 'http://a.com/p' || page_id || CASE page_id % 7 WHEN 1 THEN '/x' WHEN 4 THEN '--.html' WHEN 5 THEN '.html' WHEN 6 THEN '?sid=abc' ELSE '' END AS stripped FROM pages")
def strip_session_id(spark, sf_dir):
    """Six of the rules, and a parameter that is no session."""
    k, base, code = F.col("page_id") % 7, F.concat(F.lit("http://a.com/p"), F.col("page_id").cast("string")), F.md5("url")
    tails = [F.concat(F.lit("?PHPSESSID="), code), F.concat(F.lit("/sessions/"), code, F.lit("/x")), F.lit(";$sessionid$ABC"), F.lit(";jsessionid=QQ"), F.lit("--session_id.123--.html"), F.concat(F.lit("-oscsid-"), code, F.lit(".html")), F.lit("?sid=abc")]
    dirty = F.concat(base, F.get(F.array(*tails), k.cast("int")))
    return _table(spark, sf_dir, "pages").select("page_id", url.without_session_id(dirty).alias("stripped"))


@query()
def url_fingerprint(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", url.url_fp64("url").alias("fp64"), url.url_fingerprint("url").alias("f")).select("page_id", "fp64", "f.*")


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://h.com/a/b' WHEN 1 THEN 'http://other.com/y' WHEN 2 THEN 'https://abs.com/z' WHEN 3 THEN 'http://h.com/d/e/n.html' WHEN 4 THEN 'http://h.com/d/up' ELSE 'http://h.com/d/e/f?q=1' END AS resolved FROM pages")
def resolve_relative(spark, sf_dir):
    """References of six shapes: rooted, without a scheme, whole, beside, above, a query."""
    shapes = F.array(*map(F.lit, ("/a/b", "//other.com/y", "https://abs.com/z", "n.html", "../up", "?q=1")))
    return _table(spark, sf_dir, "pages").select("page_id", url.resolve(F.lit("http://h.com/d/e/f"), F.get(shapes, (F.col("page_id") % 6).cast("int"))).alias("resolved"))


@query("SELECT page_id, url LIKE 'https://%' AS secure, CASE WHEN url LIKE 'http://www.%' THEN 'http://www.' WHEN url LIKE 'http://%' THEN 'http://' WHEN url LIKE 'https://%' THEN 'https://' END AS longest, CASE WHEN url LIKE '%.html' THEN '.html' END AS suffix FROM pages")
def prefix_match(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", text.has_prefix(u, ["https://"]).alias("secure"), text.longest_prefix(u, ["http://", "http://www.", "https://"]).alias("longest"), text.shortest_suffix(u, [".html", "index.html"]).alias("suffix"))


@query("SELECT c_custkey, CAST(c_custkey AS INTEGER) AS number, concat_ws('.', (c_custkey >> 24) & 255, (c_custkey >> 16) & 255, (c_custkey >> 8) & 255, c_custkey & 255) AS address FROM customer")
def ipv4_int(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", net.ipv4_text(F.col("c_custkey")).alias("address"))
    return rows.select("c_custkey", net.ipv4_int(F.col("address")).alias("number"), "address")


@query("SELECT page_id, 'host' AS host, CAST(page_id % 65536 AS INTEGER) AS port FROM pages")
def socket_address(spark, sf_dir):
    address = F.concat(F.lit("host:"), (F.col("page_id") % 65536).cast("string"))
    return _table(spark, sf_dir, "pages").select("page_id", net.socket_address(address).alias("a")).select("page_id", "a.*")


# ------------------------------------------------------------ charsets and text


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'windows-1251' END AS charset FROM pages")
def meta_charset_sniff(spark, sf_dir):
    tag = F.when(F.col("page_id") % 2 == 0, F.lit("<META http-equiv='Content-Type' content='text/html; charset=windows-1251'>")).otherwise(F.lit(""))
    return _table(spark, sf_dir, "pages").select("page_id", text.meta_charset(F.encode(F.concat(tag, "html"), "UTF-8")).alias("charset"))


@query("SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN strlen(text) = length(text) THEN 'ASCII' WHEN text IS NOT NULL THEN 'UTF-8' END AS charset FROM documents")
def detect_charset(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", http.detected_charset(F.encode("text", "UTF-8")).alias("charset"))


#: Characters that stand for the letters a to z, one frequent set a charset.
_SCRIPTS = [
    ("Shift_JIS", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"), ("EUC-JP", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"), ("EUC-KR", "이다가는을의에지고하한사리로도기어나아인대서시자정일"),
    ("GB2312", "的一是不了在人有我他这中大来上国和说们为子地出道你时"), ("Big5", "的一是不了在人有我他這中大來上國和說們為子地出道你時"), ("GB18030", "的一是不了在人有我他這中大來上國和說們為子地出道你時"),
]


@query(f"SELECT charset, count(*) AS n, true AS agreed FROM documents JOIN (VALUES {', '.join(f'({i}, {chr(39)}{name}{chr(39)})' for i, (name, _) in enumerate(_SCRIPTS))}) AS t(k, charset) ON doc_id % 6 = k WHERE length(regexp_replace(text, '[^a-z]', '', 'g')) >= 20 GROUP BY 1")
def detect_double_byte(spark, sf_dir):
    """Documents in characters of six double-byte charsets, each detected again: at least 98 in 100."""
    k = F.pmod("doc_id", F.lit(len(_SCRIPTS)))
    shown, name = F.col("text"), F.lit(None).cast("string")
    for i, (charset, letters) in enumerate(_SCRIPTS):
        shown = F.when(k == i, F.translate("text", "abcdefghijklmnopqrstuvwxyz", letters)).otherwise(shown)
        name = F.when(k == i, charset).otherwise(name)
    rows = _table(spark, sf_dir, "documents").where("length(regexp_replace(text, '[^a-z]', '')) >= 20").select(name.alias("charset"), http.detected_charset(http.encoded(shown, name)).alias("found"))
    return rows.groupBy("charset").agg(F.count("*").alias("n"), (F.count_if(F.col("charset") == F.col("found")) >= 0.98 * F.count("*")).alias("agreed"))


@query("SELECT page_id, md5('<p>' || regexp_replace(html, '[^\\x20-\\x7e]|<meta', '', 'gi') || 'é') AS text_md5, CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp1252' WHEN 2 THEN 'utf-16-le' ELSE 'utf-8' END AS charset FROM pages")
def decode_best_effort(spark, sf_dir):
    """Pages in three charsets as their header says, and one that says nothing."""
    page, k = F.concat(F.lit("<p>"), F.regexp_replace("html", r"(?i)[^\x20-\x7e]|<meta", ""), F.lit("é")), F.col("page_id") % 4
    data = F.when(k == 1, F.encode(page, "ISO-8859-1")).when(k == 2, F.encode(page, "UTF-16LE")).otherwise(F.encode(page, "UTF-8"))
    said = F.when(k == 0, "UTF-8").when(k == 1, "iso-8859-1").when(k == 2, "utf-16le")
    return _table(spark, sf_dir, "pages").select("page_id", http.decoded(data, said).alias("d")).select("page_id", F.md5("d.text").alias("text_md5"), "d.charset")


@query("SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, greatest(length(text) - 2, 0) + 1), lambda i: substr(text, i, 3)))) AS INTEGER) AS n FROM documents")
def char_shingles(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.shingle_count("text").alias("n"))


@query("""WITH s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(length(text) - 2, 0) + 1), lambda i: substr(text, i, 3))) AS s FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id, CAST(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) AS FLOAT) AS similarity FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def shingle_jaccard(spark, sf_dir):
    """Each document against the one with the next id."""
    # texts are joined and shingled after it: their shingles take several times their room
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(other, "doc_id").select("doc_id", text.shingle_jaccard("text", "next").alias("similarity"))


@query("SELECT md5(text) AS signature, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def doc_md5_dedup(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("signature")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, CASE WHEN text = '' THEN '' ELSE upper(md5(text)) END AS signature FROM documents")
def md5_signature(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.hex(hashing.md5_signature(F.encode("text", "UTF-8"))).alias("signature"))


@query()
def simhash64(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.simhash("text").alias("simhash"))


@query()
def near_dup_pairs(spark, sf_dir):
    return near_duplicates.simhash_pairs(simhash64(spark, sf_dir), "doc_id", "simhash", 3)


#: Bytes of an ASCII text in SQL.
_BYTES = "list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS {1}))"
_FOLD = "list_reduce(list_prepend({start}, {items}), lambda f, b: list_reduce(list_prepend(xor(f, b), [0, 0, 0, 0, 0, 0, 0, 0]::{kind}[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, {poly}) ELSE x // 2 END))"


@query()
def rabin_fp(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", hashing.rabin64("html").alias("fp"))


@query("SELECT p_partkey, CAST(CASE WHEN f >= 9223372036854775808 THEN f::HUGEINT - 18446744073709551616 ELSE f END AS BIGINT) AS fp FROM (SELECT p_partkey, " + _FOLD.format(start=f"{hashing.start_of(64)}::UBIGINT", items="flatten(list_transform(" + _BYTES.format("p_name", "UBIGINT") + ", lambda c: [c, 0::UBIGINT]))", kind="UBIGINT", poly=f"{hashing.start_of(64)}::UBIGINT") + " AS f FROM part)")
def rabin_fp_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", hashing.rabin64("p_name").alias("fp"))


@query()
def murmur2(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", hashing.murmur2_text("html").alias("hash"))


@query("""WITH b AS (SELECT p_partkey, """ + _BYTES.format("p_name", "BIGINT") + """ AS b, length(p_name) AS n FROM part),
w AS (SELECT p_partkey, b, n, list_transform(range(0, n // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) AS ws FROM b),
k AS (SELECT *, list_transform(list_transform(ws, lambda w: (w * 1540483477) & 4294967295), lambda k: (xor(k, k >> 24) * 1540483477) & 4294967295) AS ks FROM w),
h AS (SELECT *, list_reduce(list_prepend(CAST(n AS BIGINT), ks), lambda h, k: xor((h * 1540483477) & 4294967295, k)) AS h FROM k),
t AS (SELECT p_partkey, CASE n % 4 WHEN 0 THEN h WHEN 1 THEN (xor(h, b[n]) * 1540483477) & 4294967295 WHEN 2 THEN (xor(h, b[n] + b[n - 1] * 256) * 1540483477) & 4294967295 ELSE (xor(h, b[n] + b[n - 1] * 256 + b[n - 2] * 65536) * 1540483477) & 4294967295 END AS h FROM h),
f AS (SELECT p_partkey, (xor(h, h >> 13) * 1540483477) & 4294967295 AS h FROM t)
SELECT p_partkey, CAST(CASE WHEN xor(h, h >> 15) >= 2147483648 THEN xor(h, h >> 15) - 4294967296 ELSE xor(h, h >> 15) END AS INTEGER) AS hash FROM f""")
def murmur2_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", hashing.murmur2_of("p_name").alias("hash"))


@query("SELECT page_id, CAST(" + _FOLD.format(start="0::BIGINT", items=_BYTES.format("url", "BIGINT"), kind="BIGINT", poly="40961") + " AS INTEGER) AS crc FROM pages")
def crc16(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", hashing.crc16_of(F.encode("url", "UTF-8")).alias("crc"))


@query("SELECT p_partkey, CASE WHEN h >= 2147483648 THEN CAST(h - 4294967296 AS INTEGER) ELSE CAST(h AS INTEGER) END AS hash FROM (SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, u: (31 * h + u) & 4294967295) AS h FROM part)")
def string_hash(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", hashing.string_hash_of("p_name").alias("hash"))


@query("SELECT l_orderkey, l_linenumber, CAST(bit_count(xor(l_orderkey, l_partkey)) AS INTEGER) AS distance FROM lineitem")
def hamming(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.hamming(F.col("l_orderkey"), F.col("l_partkey")).alias("distance"))


@query("""SELECT o_orderkey, CAST(CASE WHEN r >= 9223372036854775808 THEN r - 18446744073709551616 ELSE r END AS BIGINT) AS rotated
FROM (SELECT o_orderkey, (u * 2) % 18446744073709551616 + u // 9223372036854775808 AS r FROM (SELECT o_orderkey, xor((o_orderkey::HUGEINT * 2305843009213693952) % 18446744073709551616, o_orderkey::HUGEINT) AS u FROM orders))""")
def rotate_left1(spark, sf_dir):
    """Over numbers whose three top bits take every value."""
    wide = F.shiftleft("o_orderkey", 61).bitwiseXOR(F.col("o_orderkey"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.rotate_left_1(wide).alias("rotated"))


@query("SELECT doc_id, CAST(CASE WHEN strpos(text, 'the') = 0 THEN -1 ELSE strlen(substr(text, 1, strpos(text, 'the') - 1)) END AS INTEGER) AS at FROM documents")
def byte_index_of(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.byte_index_of(F.encode("text", "UTF-8"), b"the").cast("int").alias("at"))


@query("SELECT doc_id, md5(replace(replace(regexp_replace(replace(text, chr(13), ' '), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), chr(10), '\\n'), chr(9), '\\t')) AS escaped_md5 FROM documents")
def seqfile_escaped_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.escaped_text(F.col("text"))).alias("escaped_md5"))


@query("SELECT p_partkey, replace(replace(p_name, '\\', '\\\\'), ' ', '\\ ') AS escaped FROM part")
def escape(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", codec.escaped(F.col("p_name"), " ").alias("escaped"))


@query("SELECT doc_id, md5(replace(replace(base64(encode(text)), '+', '-'), '/', '_')) AS encoded_md5 FROM documents")
def base64_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(codec.base64_url(F.encode("text", "UTF-8"))).alias("encoded_md5"))


@query("SELECT p_partkey, left(p_name, 12) AS head, length(p_name) > 12 AS was_truncated FROM part")
def gunzip_limited(spark, sf_dir):
    """What a limit of twelve bytes leaves, and whether it cut."""
    packed = codec.gzipped(F.encode("p_name", "UTF-8"))
    return _table(spark, sf_dir, "part").select("p_partkey", codec.gunzipped_to(12)(packed).alias("g")).select("p_partkey", F.decode("g.data", "UTF-8").alias("head"), "g.was_truncated")


@query("SELECT doc_id, md5(text) AS text_md5, false AS was_truncated FROM documents")
def gzip_round_trip(spark, sf_dir):
    packed = codec.gzipped(F.encode("text", "UTF-8"))
    return _table(spark, sf_dir, "documents").select("doc_id", codec.gunzipped(packed).alias("g")).select("doc_id", F.md5("g.data").alias("text_md5"), "g.was_truncated")


@query("SELECT o_orderkey, [o_orderkey, o_custkey, -o_custkey]::VARCHAR AS decoded FROM orders")
def rice_round_trip(spark, sf_dir):
    values = F.array(F.col("o_orderkey"), F.col("o_custkey"), -F.col("o_custkey"))
    packed = codec.rice_encoded(values, F.lit(10))
    return _table(spark, sf_dir, "orders").select("o_orderkey", codec.rice_decoded(packed, F.lit(3), F.lit(10)).alias("d")).select("o_orderkey", F.concat(F.lit("["), F.array_join("d", ", "), F.lit("]")).alias("decoded"))


@query("SELECT n_nationkey, hex(encode(n_name)) AS hexed FROM nation")
def to_hex(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.hex("n_name").alias("hexed"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def struct_round_trip(spark, sf_dir):
    """Records encoded to tagged bytes and decoded again."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    packed = rows.select(records.struct_encode(rows.schema, F.struct("*")).alias("p"))
    return packed.select(records.struct_decode(rows.schema, F.col("p")).alias("r")).select("r.*")


@query()
def dom_walk(spark, sf_dir):
    spark.udtf.register("dom_nodes", dom.DomNodes)
    _table(spark, sf_dir, "pages").createOrReplaceTempView("dom_pages")
    return spark.sql("SELECT page_id, kind, name, count(*) AS n FROM dom_pages, LATERAL dom_nodes(html) GROUP BY page_id, kind, name")


# ---------------------------------------------------- aggregation and ordering


@query("SELECT event_type AS key, count(*) AS n, event_type || ':' || repeat('#', CAST(floor(count(*) / 100.0) AS BIGINT)) AS bar FROM events GROUP BY event_type")
def event_histogram(spark, sf_dir):
    return aggregates.histogram(_table(spark, sf_dir, "events"), F.col("event_type"), bar=100)


@query("SELECT event_id, round(avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS average FROM events")
def event_moving_avg(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long")
    return _table(spark, sf_dir, "events").select("event_id", F.round(aggregates.moving_average(cents, [F.col("ts"), F.col("event_id")], 5, [F.col("user_id")]), 6).alias("average"))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT event_id, user_id, i, value AS ema FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.user_id, o.i, 0.2::DOUBLE * o.value + 0.8::DOUBLE * e.ema FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)
SELECT event_id, round(ema, 6) AS ema FROM e""")
def event_ema(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return aggregates.smoothed_average(rows, "value", ["ts", "event_id"], 0.2, ["user_id"]).select("event_id", F.round("ema", 6).alias("ema"))


@query("SELECT date_trunc('second', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def rate_window(spark, sf_dir):
    out = windows.rate_by_window(_table(spark, sf_dir, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT event_id, round(least(greatest(100.0 - coalesce(sum(value) OVER (PARTITION BY user_id, date_trunc('hour', ts), date_trunc('second', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0), value), 6) AS granted FROM events""")
def rate_limit(spark, sf_dir):
    return aggregates.rate_limit(_table(spark, sf_dir, "events"), "ts", "value", 100.0, ["user_id"], "event_id").select("event_id", F.round("granted", 6).alias("granted"))


@query("""WITH r AS (SELECT event_id, sum(event_id) OVER w / (greatest(max(epoch_ms(ts)) OVER w - min(epoch_ms(ts)) OVER w, 1) / 1000.0) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, CAST(floor(b * 1000) AS BIGINT) AS rate, CASE WHEN b >= 1073741824 THEN 'GB/s' WHEN b >= 1048576 THEN 'MB/s' WHEN b >= 1024 THEN 'KB/s' ELSE 'B/s' END AS unit FROM r""")
def bandwidth_history(spark, sf_dir):
    out = aggregates.bandwidth(_table(spark, sf_dir, "events"), _millis(F.col("ts")), F.col("event_id"), [F.col("ts"), F.col("event_id")], ["user_id"])
    return out.select("event_id", F.floor(F.col("bytes_per_second") * 1000).alias("rate"), "unit")


@query("SELECT count(*) AS n, count(*) AS found, true AS few_false FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def bloom_filter(spark, sf_dir):
    """Known keys are all found; of as many unknown ones at most three in a hundred."""
    customers, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    bits = aggregates.build_bloom(customers, "c_custkey", customers.count(), 10)
    known = orders.join(customers, orders.o_custkey == customers.c_custkey, "left_semi")
    there, not_there = (aggregates.bloom_contains(F.col("o_custkey") + far, bits, 10) for far in (0, 1 << 40))
    return known.select(there.alias("a"), not_there.alias("b")).agg(F.count("*").alias("n"), F.count_if("a").alias("found"), (F.count_if("b") <= 0.03 * F.count("*") + 3).alias("few_false"))


@query("SELECT count(*) AS n, true AS few_false FROM part")
def bloom_filter_text(spark, sf_dir):
    """The filter over text keys."""
    parts = _table(spark, sf_dir, "part").select("p_name")
    bits = aggregates.build_bloom(parts, "p_name", parts.count(), 10)
    found = parts.select(aggregates.bloom_contains(F.col("p_name"), bits, 10).alias("a"), aggregates.bloom_contains(F.concat("p_name", F.lit("?")), bits, 10).alias("b"))
    return found.agg(F.count_if("a").alias("n"), (F.count_if("b") <= 0.03 * F.count("*") + 3).alias("few_false"))


@query("SELECT o_orderstatus, 10 AS buckets, 5 AS k, CAST(ceil(n * 10 / 64.0) * 8 AS BIGINT) AS filter_bytes FROM (SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)")
def bloom_sizing(spark, sf_dir):
    """The filter for each status's customers at one false alarm in a hundred."""
    buckets, k = aggregates.buckets_and_k(0.01)
    each = _table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n"))
    return each.select("o_orderstatus", F.lit(buckets).alias("buckets"), F.lit(k).alias("k"), (F.ceil(F.col("n") * buckets / 64) * 8).cast("long").alias("filter_bytes"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def distinct_long_set(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL")
def combine_values(spark, sf_dir):
    return aggregates.combine(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count("*"), quantity=F.sum(F.col("l_quantity").cast("long")), most=F.max("l_extendedprice"))


@query("SELECT count(*) AS n FROM lineitem")
def count_records(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_by_key(spark, sf_dir):
    return ordering.distinct_by(_table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber")
def external_sort(spark, sf_dir):
    return ordering.external_sort(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id")
def kway_merge(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    views = F.col("event_type") == "view"
    return ordering.merge_sorted([rows.where(views), rows.where(~views | views.isNull())], "ts", "event_id")


@query("SELECT event_type, count(*) AS n, max(event_id) AS latest FROM events GROUP BY event_type")
def merge_combined(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    return ordering.merge_combined([rows.where(even), rows.where(~even)], ["event_type"], n=F.count("*"), latest=F.max("event_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def paginate_asc(spark, sf_dir):
    return ordering.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 2, 50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50 OFFSET 50")
def paginate_desc(spark, sf_dir):
    return ordering.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.desc("o_orderkey")], 1, 50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf_dir):
    return ordering.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 0, 10)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_idx FROM orders")
def index_writer(spark, sf_dir):
    return ordering.with_row_index(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_idx")


@query("SELECT o_orderkey, row_idx FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_idx FROM orders) WHERE row_idx BETWEEN 200 AND 299")
def row_index_seek(spark, sf_dir):
    return ordering.seek(index_writer(spark, sf_dir), 200, 300)


@register
class OrdersByPrice(ArchiveQuery):
    """Orders of one status, by price."""

    def __init__(self, sf_dir: str, status: str):
        self.sf_dir, self.status = sf_dir, status

    def domain_id(self) -> str:
        return f"orders:{self.sf_dir}"

    def params(self) -> str:
        return self.status

    def sort_keys(self) -> list[str]:
        return ["o_totalprice", "o_orderkey"]

    def build(self, spark: SparkSession) -> DataFrame:
        return _table(spark, self.sf_dir, "orders").where(F.col("o_orderstatus") == self.status).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def query_page(spark, sf_dir):
    controller = Controller(spark, scratch(spark, "query-results"))
    controller.page(OrdersByPrice(sf_dir, "O"))  # computed once, then served from the file
    return controller.page(OrdersByPrice(sf_dir, "O"), 0, 25, SortOrder.DESC).rows.select("o_orderkey", "o_totalprice")


@query("""SELECT * FROM (SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id)
WHERE ts + to_days(CAST(event_id % 20 AS INTEGER)) > (SELECT max(ts) FROM events)""")
def ttl_expiry(spark, sf_dir):
    """The newest event of each user, if its own time to live has not run out by the last event of all."""
    rows = _table(spark, sf_dir, "events").withColumn("ttl", F.expr("make_dt_interval(CAST(event_id % 20 AS INT))"))
    now = rows.agg(F.max("ts")).first()[0]
    return ordering.newest_by(rows, ["user_id"], "ts", ["event_id"], "ttl", F.lit(now).cast("timestamp_ntz"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def ttl_cache(spark, sf_dir):
    return ordering.newest_by(_table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"])


@query("""WITH e AS (SELECT event_id, 'h' || user_id % 40 AS host, ts, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type NOT IN ('click', 'view') THEN '10.0.0.' || event_id % 250 END AS ip, epoch_us(ts) // 1000 + event_id % 7 * 21600000 AS expires,
  CASE WHEN event_id % 3 = 0 THEN 'c' || user_id % 5 WHEN event_id % 3 = 1 THEN 'h' || (user_id + 1) % 40 END AS cname FROM events),
n AS (SELECT host AS name, ts, ip, expires, cname, false AS alias FROM e WHERE ip IS NOT NULL UNION ALL SELECT cname, ts, ip, expires, NULL, true FROM e WHERE ip IS NOT NULL AND cname IS NOT NULL),
q AS (SELECT host, ts, ms, host AS name, NULL::VARCHAR AS ip, NULL::BIGINT AS expires FROM e WHERE ip IS NULL),
a AS (SELECT q.host, q.ts, q.ms, (SELECT max(n.ts) FROM n WHERE n.name = q.name AND NOT alias AND n.ts <= q.ts) AS t FROM q),
k AS (SELECT a.*, (SELECT arg_max({'ip': ip, 'expires': expires}, (expires, -epoch_us(n.ts))) FROM n WHERE n.name = a.host AND n.ts <= a.ts AND (alias AND (t IS NULL OR n.ts > t) OR NOT alias AND n.ts = t)) AS known,
  (SELECT any_value(cname) FROM n WHERE n.name = a.host AND NOT alias AND n.ts = t) AS cname FROM a),
c AS (SELECT k.*, (SELECT max(n.ts) FROM n WHERE n.name = k.cname AND NOT alias AND n.ts <= k.ts) AS u FROM k),
f AS (SELECT c.*, CASE WHEN known IS NOT NULL AND known.expires <= ms THEN (SELECT arg_max({'ip': ip, 'expires': expires}, (expires, -epoch_us(n.ts))) FROM n WHERE n.name = c.cname AND n.ts <= c.ts AND (alias AND (u IS NULL OR n.ts > u) OR NOT alias AND n.ts = u)) END AS other FROM c),
p AS (SELECT *, coalesce(other.expires > known.expires, false) AS better FROM f)
SELECT host, ts, CASE WHEN better THEN other.ip ELSE known.ip END AS ip, CASE WHEN better THEN other.expires ELSE known.expires END AS expires, CASE WHEN better THEN 'cname' WHEN known IS NOT NULL THEN 'host' END AS via,
  coalesce(CASE WHEN better THEN other.expires ELSE known.expires END > ms, false) AS fresh FROM p""")
def ttl_fallback(spark, sf_dir):
    """Events as sightings of addresses that expire and questions for them, answered by the host or its canonical name."""
    e, host = _table(spark, sf_dir, "events"), lambda x, n: F.concat(F.lit(x), (n).cast("string"))
    ip = F.when(~F.col("event_type").isin("click", "view"), host("10.0.0.", F.col("event_id") % 250))
    cname = F.when(F.col("event_id") % 3 == 0, host("c", F.col("user_id") % 5)).when(F.col("event_id") % 3 == 1, host("h", (F.col("user_id") + 1) % 40))
    expires = F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id") % 7 * 21600000
    rows = e.select(host("h", F.col("user_id") % 40).alias("host"), F.col("ts").cast("timestamp").alias("ts"), ip.alias("ip"), expires.alias("expires"), cname.alias("cname"))
    return ttl.answers(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM orders")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.rank().over(w).alias("place"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(_table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    customers, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN page_id ELSE 7 END AS BIGINT) AS a, 'x' AS b FROM pages")
def merge_structs(spark, sf_dir):
    base = F.struct(F.lit(7).cast("long").alias("a"), F.lit("x").alias("b"))
    peer = F.struct(F.when(F.col("page_id") % 2 == 0, F.col("page_id")).alias("a"), F.lit(None).cast("string").alias("b"))
    return _table(spark, sf_dir, "pages").select("page_id", ordering.merge_structs(base, peer, ["a", "b"]).alias("m")).select("page_id", "m.*")




# ---------------------------------------------------------------- column forms


@query("SELECT p_partkey, p_name AS unescaped, p_name || '|' || p_brand AS parts FROM part")
def unescape_split(spark, sf_dir):
    both = codec.concat_escaped(F.array("p_name", "p_brand"), ",")
    back = codec.split_escaped_of(both, ",")
    return _table(spark, sf_dir, "part").select("p_partkey", codec.unescaped(codec.escaped(F.col("p_name"), " "), " ").alias("unescaped"), F.array_join(back, "|").alias("parts"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey ELSE -o_orderkey END END AS number, o_orderkey * CASE WHEN o_orderkey % 2 = 0 THEN 1000003 ELSE -1000003 END AS long_value, CAST((o_orderkey >> 3) & 1 AS INTEGER) AS bit FROM orders")
def small_numbers(spark, sf_dir):
    """Numbers in base 16, variable-length numbers, a bit of a stream."""
    k = F.col("o_orderkey")
    shown = F.when(k % 3 == 0, F.concat(F.lower(F.hex(k)), F.lit("g"))).when(k % 3 == 1, F.lower(F.hex(k))).otherwise(F.concat(F.lit("-"), F.lower(F.hex(k))))
    wide = k * F.when(k % 2 == 0, 1000003).otherwise(-1000003)
    low = F.unhex(F.lpad(F.hex(k.bitwiseAND(255)), 2, "0"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", codec.parsed_long(shown, F.lit(16)).alias("number"), codec.vlong_value(codec.vlong_bytes(wide)).alias("long_value"), codec.bit_at(low, F.lit(3)).alias("bit"))


@query("SELECT doc_id, CAST(CASE WHEN strpos(text, ' ') = 0 THEN -1 ELSE strlen(substr(text, 1, strpos(text, ' ') - 1)) END AS INTEGER) AS at, CAST(strlen(text) AS INTEGER) AS n_bytes, true AS valid, text IS NULL AS broken_valid FROM documents WHERE text IS NOT NULL")
def utf8_ops(spark, sf_dir):
    """Byte offsets, lengths and validity of UTF-8; a lone continuation byte is not valid."""
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", text.utf8_find(F.col("text"), " ").cast("int").alias("at"), F.octet_length("text").alias("n_bytes"), F.is_valid_utf8("text").alias("valid"), F.is_valid_utf8(F.concat("text", F.unhex(F.lit("80")).cast("string"))).alias("broken_valid"))


@query("SELECT o_orderkey, concat_ws('/', (o_orderkey % 100000000) // 1000000, (o_orderkey % 1000000) // 10000, (o_orderkey % 10000) // 100, o_orderkey) AS folder FROM orders")
def folder_for_id(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", net.path_for_id_of(F.col("o_orderkey")).alias("folder"))


@query("SELECT o_orderkey, strftime(timezone('America/Los_Angeles', timezone('UTC', date_trunc('second', o_orderdate::TIMESTAMP))), '%Y.%m.%d at %I:%M:%S ') || CASE WHEN epoch(timezone('America/Los_Angeles', timezone('UTC', o_orderdate::TIMESTAMP))) - epoch(o_orderdate::TIMESTAMP) = -25200 THEN 'PDT' ELSE 'PST' END AS shown FROM orders")
def format_time(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", http.format_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("shown"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + 4611686018427387904 END AS wide FROM orders")
def struct_with_nulls(spark, sf_dir):
    """Records with unset fields and numbers beyond what a float holds."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") + (1 << 62)).alias("wide"))
    packed = rows.select(records.struct_encode(rows.schema, F.struct("*")).alias("p"))
    return packed.select(records.struct_decode(rows.schema, F.col("p")).alias("r")).select("r.*")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer")
def sequence_files(spark, sf_dir):
    """Text pairs written to sequence files and read back, values as single lines."""
    path = scratch(spark, "pairs-seq")
    write_sequence(_table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.concat(F.lit(" "), "c_mktsegment", F.lit("\r\n")).alias("value")), path)
    return read_sequence(spark, path, escape_lines=True)


@query("SELECT c_name AS host, CAST(c_custkey AS INTEGER) AS ip, c_custkey * 1000 AS ttl, CASE WHEN c_custkey % 2 = 0 THEN 'alias' || c_custkey END AS cname, CAST(-1 AS BIGINT) AS last_touched FROM customer WHERE c_custkey % 5 <> 0")
def name_table(spark, sf_dir):
    """A dump of names and addresses, written and read with a filter."""
    k, path = F.col("c_custkey"), scratch(spark, "names")
    write_names(_table(spark, sf_dir, "customer").select(F.col("c_name").alias("host"), k.cast("int").alias("ip"), (k * 1000).alias("ttl"), F.when(k % 2 == 0, F.concat(F.lit("alias"), k.cast("string"))).alias("cname"), F.lit(-1).cast("long").alias("last_touched")), path)
    return read_names(spark, path, F.col("ttl") / 1000 % 5 != 0)


@query("""SELECT page_id, md5(regexp_replace(html, '[^\\x20-\\x7e]|<meta', '', 'gi') || 'é') AS text_md5, CASE WHEN page_id % 11 < 6 THEN 'cp1252' WHEN page_id % 11 < 9 THEN 'utf-8' ELSE 'utf-16-be' END AS charset FROM pages""")
def charset_alias(spark, sf_dir):
    """Pages in three charsets under eleven of their names."""
    names = ("latin1", "L1", "ISO_8859-1:1987", "IBM819", "csISOLatin1", "windows-1252", "utf8", "UTF_8", "unicode-1-1-utf-8", "UTF-16BE", "utf_16_be")
    page, k = F.concat(F.regexp_replace("html", r"(?i)[^\x20-\x7e]|<meta", ""), F.lit("é")), (F.col("page_id") % 11).cast("int")
    data = F.when(k < 6, F.encode(page, "ISO-8859-1")).when(k < 9, F.encode(page, "UTF-8")).otherwise(F.encode(page, "UTF-16BE"))
    rows = _table(spark, sf_dir, "pages").select("page_id", http.decoded(data, F.get(F.array(*map(F.lit, names)), k)).alias("d"))
    return rows.select("page_id", F.md5("d.text").alias("text_md5"), "d.charset")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16LE' WHEN 2 THEN 'UTF-16BE' ELSE 'windows-1252' END AS charset FROM documents WHERE text IS NOT NULL")
def detect_encoded(spark, sf_dir):
    """Whole texts, ASCII with an accent, in four encodings that their bytes must tell apart."""
    shown, k = F.concat(F.regexp_replace("text", r"[^\x20-\x7e]", " "), F.lit(" déjà vu")), F.col("doc_id") % 4
    data = F.when(k == 0, F.encode(shown, "UTF-8")).when(k == 1, F.encode(shown, "UTF-16LE")).when(k == 2, F.encode(shown, "UTF-16BE")).otherwise(F.encode(shown, "ISO-8859-1"))
    return _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", http.detected_charset(data).alias("charset"))


# ------------------------------------------------------------------ extensions


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return rows.groupingSets([[flag], [status], []], flag, status).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT l_returnflag, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS median, true AS close FROM lineitem GROUP BY 1")
def percentiles(spark, sf_dir):
    """The exact median, and whether the sketches come close."""
    rows = _table(spark, sf_dir, "lineitem")
    # each by itself: beside a distinct count, every part number would carry sketches of its own
    found = aggregates.medians(rows, "l_returnflag", F.col("l_extendedprice").cast("double")).select(F.col("l_returnflag").alias("flag"), F.col("median").alias("m"), F.col("near").alias("a"))
    near = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("d"))
    parts = rows.groupBy(F.col("l_returnflag").alias("part_flag")).agg(F.count_distinct("l_partkey").alias("e"))
    out = near.join(found, F.col("l_returnflag").eqNullSafe(F.col("flag"))).join(parts, F.col("l_returnflag").eqNullSafe(F.col("part_flag")))
    close = (F.abs(F.col("a") / F.col("m") - 1) < 0.02) & (F.abs(F.col("d") / F.col("e") - 1) < 0.1)
    return out.select("l_returnflag", F.round("m", 4).alias("median"), close.alias("close"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(_table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def union_distinct(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).union(_table(spark, sf_dir, "region").select("r_regionkey")).distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    customers, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT n_nationkey, r_regionkey FROM (SELECT * FROM nation WHERE n_nationkey % 2 = 0) FULL JOIN (SELECT * FROM region WHERE r_regionkey % 2 = 0) ON n_regionkey = r_regionkey")
def outer_join(spark, sf_dir):
    nations, regions = _table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0"), _table(spark, sf_dir, "region").where("r_regionkey % 2 = 0")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey, "full").select("n_nationkey", "r_regionkey")


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)")
def lateral_join(spark, sf_dir):
    # a lateral ORDER BY with LIMIT becomes a sort below a window without order, which no shuffle or spill keeps: the window itself must be ordered
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.asc_nulls_last("o_orderkey"))
    first = _table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).where("place = 1")
    return _table(spark, sf_dir, "customer").lateralJoin(first.where(F.col("o_custkey") == F.col("c_custkey").outer()).select("o_orderkey")).select("c_custkey", "o_orderkey")


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_neighbours(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, i""")
def session_windows(spark, sf_dir):
    # a session window ends before its gap is over: an event just at the end still belongs here
    rows = _table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("t", F.lit("30 minutes 0.000001 seconds"))).agg(F.min("ts").alias("session_start"), F.count("*").alias("n"))
    return out.select("user_id", "session_start", "n")


# ------------------------------------------------- ranges, positions and stores


#: Most megabytes of a range.
_RANGE_MB = 64.0


def _split_archive(spark: SparkSession, sf_dir: str) -> tuple[str, float, int]:
    """All pages as archive files, megabytes of a range by which the largest is read in two tasks and all in eight at least, and more tasks than files."""
    path = archive_of_pages(spark, sf_dir)
    sizes = [size for _, size in list_archives(path)] or [0]
    return path, min(_RANGE_MB, max(sizes) / (2 << 20), sum(sizes) / (8 << 20)), max(4, len(sizes))


@query("SELECT url, md5(html) AS content_md5, true AS many_tasks FROM pages")
def arc_split_scan(spark, sf_dir):
    """Files read in several tasks, each from the first member that begins in its range."""
    path, mb, few = _split_archive(spark, sf_dir)
    rows = read_arc(spark, path, records="item", splitMB=mb)
    return rows.select(F.col("uri").alias("url"), F.md5("content").alias("content_md5"), F.lit(rows.rdd.getNumPartitions() > few).alias("many_tasks"))


@query("SELECT url, md5(html) AS content_md5, true AS many_tasks FROM pages")
def arc_index_scan(spark, sf_dir):
    """Files read in several tasks at the places that their member index names."""
    (path, mb, few), index = _split_archive(spark, sf_dir), scratch(spark, "member-index")
    positions.write_member_index(spark, path, index, split_mb=mb)
    rows = read_arc(spark, path, records="item", memberIndex=index)
    return rows.select(F.col("uri").alias("url"), F.md5("content").alias("content_md5"), F.lit(rows.rdd.getNumPartitions() > few).alias("many_tasks"))


@query("SELECT url, md5(html) AS content_md5 FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 50 = 0)")
def arc_index_lookup(spark, sf_dir):
    """All captures of some urls, by the index, reading their bytes alone."""
    path, index = archive_of_pages(spark, sf_dir), scratch(spark, "member-index")
    positions.write_member_index(spark, path, index)
    wanted = _table(spark, sf_dir, "pages").where("page_id % 50 = 0").select("url")
    return positions.lookup(spark, wanted, path, index, item=True).select(F.col("uri").alias("url"), F.md5("content").alias("content_md5"))


@query("SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, '[0, 1, 2, 3, 4, 5]|[2]' AS ran FROM orders GROUP BY 1")
def sharded_totals(spark, sf_dir):
    """Totals by customer in six shards; one shard's result is lost and only that one is computed again."""

    def build(s, shards):
        rows = _table(s, sf_dir, "orders").withColumn("shard", F.pmod("o_custkey", F.lit(6)).cast("int")).where(F.col("shard").isin(list(shards)))
        return rows.groupBy("shard", "o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))

    result = ShardedResult(spark, scratch(spark, "shards"), 6).refresh(build)
    result.drop(2)
    result.refresh(build)
    return result.rows().select("o_custkey", "n", "cents", F.lit("|".join(map(str, result.ran))).alias("ran"))


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_idx FROM lineitem) WHERE row_idx >= 1050 AND row_idx < 1200")
def block_page(spark, sf_dir):
    """A page of a result that is kept in sorted blocks with one index entry each."""
    path = scratch(spark, "blocks")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    blocks.write_blocks(rows, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], path, 1000)
    return blocks.page(spark, path, 7, 150).select("l_orderkey", "l_linenumber", "l_extendedprice", "row_idx")


@query("SELECT o_orderpriority, CAST(count(*) FILTER (o_totalprice < 100000) AS BIGINT) AS position FROM orders GROUP BY 1")
def block_position(spark, sf_dir):
    """Where a price would stand among the orders of each priority, by the index of the blocks."""
    path = scratch(spark, "blocks")
    orders = _table(spark, sf_dir, "orders")
    blocks.write_blocks(orders.select("o_orderpriority", "o_totalprice"), ["o_orderpriority", "o_totalprice"], path, 500)
    begins = [(r[0], blocks.position_of(spark, path, r[0], 100000.0) - blocks.position_of(spark, path, r[0], None)) for r in orders.select("o_orderpriority").distinct().collect()]
    return spark.createDataFrame(begins, "o_orderpriority string, position long")


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS present, count(*) FILTER (o_orderstatus = 'F') AS found, true AS few_false, true AS alike FROM orders")
def bloom_filter_table(spark, sf_dir):
    """A filter as a table of blocks, made of two halves; joined by block and broadcast it answers alike."""
    orders = _table(spark, sf_dir, "orders")
    n, own = orders.count(), orders.where("o_orderstatus = 'F'")
    table = bloom_table.merge(*(bloom_table.bloom_table(own.where(F.col("o_orderkey") % 2 == half), "o_orderkey", n) for half in (0, 1)))
    asked = bloom_table.with_membership(orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", table, n, broadcast_bytes=0)
    asked = bloom_table.with_membership(asked, "o_orderkey", table, n, name="also")
    there = F.col("o_orderstatus") == "F"
    return asked.agg(F.count("*").alias("n"), F.count_if(there).alias("present"), F.count_if(there & F.col("maybe")).alias("found"), (F.count_if(~there & F.col("maybe")) <= 0.02 * F.count("*") + 3).alias("few_false"), F.bool_and(F.col("maybe") == F.col("also")).alias("alike"))


_ORIGINS = "SELECT regexp_extract(url, '^https?://[^/]+/') AS p FROM pages WHERE page_id % 3 = 0 UNION SELECT regexp_extract(url, '^https?://[^/]+/[a-z]+/') FROM pages WHERE page_id % 5 = 0 UNION SELECT 'https://'"


@query(f"""WITH p AS ({_ORIGINS}), e AS (SELECT DISTINCT regexp_extract(url, '[#/.][a-z]*$') AS p FROM pages WHERE page_id % 4 = 0)
SELECT page_id, (SELECT arg_max(p, length(p)) FROM p WHERE starts_with(url, p)) AS longest, (SELECT arg_min(p, length(p)) FROM p WHERE starts_with(url, p)) AS shortest, (SELECT arg_max(p, length(p)) FROM e WHERE suffix(url, p)) AS ending FROM pages""")
def pattern_table(spark, sf_dir):
    """Prefixes and suffixes taken from a table, longest and shortest, by joins."""
    pages = _table(spark, sf_dir, "pages")
    origin = lambda rows, pattern: rows.select(F.regexp_extract("url", pattern, 0).alias("pattern"))
    prefixes = origin(pages.where("page_id % 3 = 0"), "^https?://[^/]+/").unionByName(origin(pages.where("page_id % 5 = 0"), "^https?://[^/]+/[a-z]+/")).unionByName(spark.createDataFrame([("https://",)], "pattern string"))
    found = patterns.match_patterns(pages.select("page_id", "url"), "url", prefixes, name="longest")
    found = patterns.match_patterns(found, "url", prefixes, which="shortest", name="shortest")
    return patterns.match_patterns(found, "url", origin(pages.where("page_id % 4 = 0"), "[#/.][a-z]*$"), suffix=True, name="ending").drop("url")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_ms(ts) // 10000 AS t, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END AS n, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 10000, event_id) AS k FROM events),
r AS (
  SELECT event_id, user_id, k, t AS seen, t AS began, n AS recent, false AS stalled, []::BIGINT[] AS times, []::BIGINT[] AS sums FROM o WHERE k = 1
  UNION ALL
  SELECT o.event_id, o.user_id, o.k, o.t, CASE WHEN shut THEN o.t ELSE began END, CASE WHEN shut OR stall THEN 0 ELSE recent + n END, CASE WHEN shut THEN false ELSE stalled OR stall END,
    CASE WHEN shut THEN list_append(times[greatest(len(times) - 18, 1):], CASE WHEN stalled THEN 1 ELSE o.t - began END) WHEN stall THEN [] ELSE times END,
    CASE WHEN shut THEN list_append(sums[greatest(len(sums) - 18, 1):], recent + n) WHEN stall THEN [] ELSE sums END
  FROM (SELECT r.*, o AS o, o.n AS n, o.t - began >= 150 AND o.n > 0 AS shut, o.t - began >= 5000 AND o.n = 0 AS stall FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)),
s AS (SELECT event_id, stalled, len(times) AS buckets, coalesce(list_sum(sums), 0) + recent AS amount, coalesce(list_sum(times), 0) + CASE WHEN stalled THEN 0 ELSE seen - began END AS took FROM r)
SELECT event_id, stalled, CAST(buckets AS INTEGER) AS buckets, CAST(CASE WHEN amount > 0 AND took > 0 THEN floor(1000.0 * amount / took) ELSE 0 END AS BIGINT) AS rate FROM s""")
def bandwidth_buckets(spark, sf_dir):
    """Users' events as transfers of that many bytes, every third without any, at a fraction of their time."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", F.call_function("div", _millis(F.col("ts")), F.lit(10000)).alias("t"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id")).alias("n"))
    out = aggregates.bandwidth_buckets(rows, "t", "n", ["user_id"], ["event_id"])
    return out.select("event_id", "stalled", "buckets", F.floor("bytes_per_second").cast("long").alias("rate"))


@query("SELECT l_orderkey || '-' || l_linenumber AS key, l_shipdate || ' ' || l_returnflag AS value, true AS many_tasks FROM lineitem")
def sequence_ranges(spark, sf_dir):
    """Sequence files, a file a task, read in ranges between their sync marks."""
    path = scratch(spark, "sequence")
    rows = _table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.concat_ws(" ", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), "l_returnflag").alias("value"))
    write_sequence_files(rows, path, codec="none")
    found = read_sequence_files(spark, path, splitMB=range_mb(path))
    return found.select("key", "value", F.lit(found.rdd.getNumPartitions() > 2).alias("many_tasks"))


# ------------------------------------------------------- URL components and sets


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"


@query(f"""SELECT page_id, strpos(url, {_HOST}) - 1 AS host_begin, length({_HOST}) AS host_len, CASE WHEN contains(url, '?') THEN strpos(url, '?') END AS query_begin,
  CASE WHEN contains(url, '#') THEN length(url) - strpos(url, '#') END AS ref_len, length(regexp_extract(url, '^[a-z]+')) AS scheme_len FROM pages""")
def url_spans(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", url_parts.spans(F.col("url")).alias("s"))
    return rows.select("page_id", F.col("s.host.begin").alias("host_begin"), F.col("s.host.len").alias("host_len"), F.col("s.query.begin").alias("query_begin"), F.col("s.ref.len").alias("ref_len"), F.col("s.scheme.len").alias("scheme_len"))


@query(f"SELECT page_id, 'ftp://mirror.org:21' || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '?from=' || {_HOST} AS moved FROM pages")
def url_replaced(spark, sf_dir):
    """Scheme, host, port and query set, the fragment taken out."""
    u = F.col("url")
    moved = url_parts.replaced(u, scheme="ftp", host="mirror.org", port="21", query=F.concat(F.lit("from="), url_parts.part(u, "host")), ref=None)
    return _table(spark, sf_dir, "pages").select("page_id", moved.alias("moved"))


@query(f"SELECT page_id, {_HOST} LIKE '%.example.com' OR {_HOST} = 'example.com' AS below, false AS cut, page_id % 3 = 0 AS is_ip FROM pages")
def url_domain_is(spark, sf_dir):
    """Hosts below a domain, none where only letters agree, and hosts that are addresses."""
    u = F.col("url")
    other = F.when(F.col("page_id") % 3 == 0, url_parts.replaced(u, host="10.0.0.1")).otherwise(url_parts.replaced(u, host="10.0.0.256"))
    return _table(spark, sf_dir, "pages").select("page_id", url_parts.domain_is(u, "example.com").alias("below"), url_parts.domain_is(u, "ample.com").alias("cut"), url_parts.host_is_ip(other).alias("is_ip"))


@query("SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^?#]*'), '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(url, '^[a-z]+://[^?#]*'), '([^/]*)$', 1) AS bare FROM pages")
def url_file_name(spark, sf_dir):
    """The last name of a path, also where parameters follow it."""
    u = F.col("url")
    with_params = url_parts.replaced(u, path=F.concat(url_parts.part(u, "path"), F.lit(";v=1/x")))
    return _table(spark, sf_dir, "pages").select("page_id", url_parts.file_name(u).alias("name"), url_parts.file_name(with_params).alias("bare"))


@query("""SELECT page_id, CAST(unnest([1, 2, 3]) AS INTEGER) AS nth, unnest(['id', 'flag', 'url']) AS key, unnest([CAST(page_id AS VARCHAR), '', 'a=b']) AS value FROM pages""")
def url_query_pairs(spark, sf_dir):
    """Keys and values of a query in their order; a key alone, and a value with a sign of equality in it."""
    made = url_parts.replaced(F.col("url"), query=F.concat(F.lit("id="), F.col("page_id").cast("string"), F.lit("&flag&url=a=b&")))
    rows = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(url_parts.query_pairs(made)).alias("nth", "pair"))
    return rows.select("page_id", (F.col("nth") + 1).alias("nth"), "pair.key", "pair.value")


@query("""WITH o AS (SELECT o_orderpriority AS p, o_custkey * 1000003 - 50000000 AS v, o_orderkey % 2 AS half FROM orders),
b AS (SELECT p, v FROM o WHERE half = 0 INTERSECT SELECT p, v FROM o WHERE half = 1)
SELECT p AS o_orderpriority, count(DISTINCT v) AS n, (SELECT count(*) FROM b WHERE b.p = o.p) AS n_both, CAST(sum(DISTINCT v) AS BIGINT) AS total FROM o GROUP BY p""")
def long_set_union(spark, sf_dir):
    """Sets built from two halves of a table and joined; what both have; and the numbers taken out again."""
    rows, keys = _table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") * 1000003 - 50000000).alias("v"), (F.col("o_orderkey") % 2).alias("half")), ("o_orderpriority",)
    a, b = (long_sets.long_set(rows.where(F.col("half") == i), "v", keys) for i in (0, 1))
    whole = long_sets.union(a, b, keys=keys)
    sums = long_sets.members(whole, keys).groupBy(*keys).agg(F.sum("value").alias("total"))
    both = long_sets.cardinality(long_sets.intersection(a, b, keys), keys).withColumnRenamed("n", "n_both")
    return long_sets.cardinality(whole, keys).join(sums, "o_orderpriority").join(both, "o_orderpriority", "left").select("o_orderpriority", "n", F.coalesce("n_both", F.lit(0)).alias("n_both"), "total")


@query("SELECT l_orderkey, l_linenumber, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AS there FROM lineitem")
def long_set_contains(spark, sf_dir):
    """Which line items are of small parts, by a set of longs."""
    small = long_sets.long_set(_table(spark, sf_dir, "part").where("p_size < 10"), "p_partkey")
    return long_sets.contains(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", small).drop("l_partkey")


@query("SELECT event_type, true AS near_distinct, true AS near_median FROM events GROUP BY 1")
def merged_sketches(spark, sf_dir):
    """Sketches of each day are stored and merged: different users, and the median, against exact counts."""
    rows = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    stored = materialize(long_sets.distinct_sketches(rows, ["event_type", "day"], "event_id"), "distinct-sketches")
    quantiles = materialize(long_sets.quantile_sketches(rows, ["event_type", "day"], "value"), "quantile-sketches")
    exact = rows.groupBy("event_type").agg(F.count_distinct("event_id").alias("exact"), F.percentile("value", F.array(F.lit(0.45), F.lit(0.55))).alias("around"))
    found = long_sets.merged_distinct(stored, ["event_type"]).join(long_sets.merged_quantiles(quantiles, ["event_type"], [0.5]), "event_type").join(exact, "event_type")
    median = F.get("quantiles", F.lit(0))
    return found.select("event_type", (F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("near_distinct"), median.between(F.get("around", F.lit(0)), F.get("around", F.lit(1))).alias("near_median"))
