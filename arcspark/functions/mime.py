"""MIME types: normalising and the accept/reject decision, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type lists and patterns that decide the outcome.
BINARY_TYPES = ["binary", "octet", "file", "image", "audio", "video", "true-type", "x-epoc"]
EXCLUDED_TYPES = ["chemical", "plugin"]
TEXT_TYPES = ["text", "plain", "message", "multipart"]
INVALID_EXTENSIONS = [
    "gif", "jpg", "jpeg", "bmp", "png", "tif", "tiff", "ico", "ps", "wmf", "fpx", "cur", "ani", "img", "lwf", "pcd", "psp", "tga", "xbm", "xpm",
    "arj", "cab", "lzw", "lha", "lzh", "sit", "rpm", "deb", "pkg", "mid", "midi", "rmi", "mpeg", "mpg", "mpe", "mp3", "mp2", "aac", "mov", "ra",
    "ram", "rm", "rmv", "wma", "wmv", "wav", "wave", "ogg", "avi", "au", "snd", "exe", "com", "lnk", "t3x", "iso", "bin", "dwf", "asf",
]
TEXT_APPLICATIONS = [
    "wap.xhtml+xml", "acrobat", "acroread", "dot", "texinfo", "tex", "text-java", "oasis.opendocument.text", "sun.xml.writer", "groove-vcard",
    "ms-works", "pdf", "word-doc", "httpd-php", "httpd-php-source", "httpd.php", "mscardfile", "server-parsed-html", "xml-dtd",
]
OTHER_APPLICATIONS = [
    "tar", "latex", "wordperfect5.1", "wordperfect", "winhlp", "google-earth.kml", "google-earth.kml+xml", "google-earth.kml+xml kml",
    "google-earth.kmz", "google-earth.kmz kmz", "openxmlformat", "powerpoint", "ms-powerpoint", "mspowerpoint", "keyhole", "kml", "ms-excel",
    "msaccess", "msexcel", "excel", "oasis.opendocument.spreadsheet", "oasis.opendocument.presentation", "openxmlformats", "sun.xml.calc",
    "cardfile", "mspublisher", "shockwave-flash", "lotus", "ms-word", "msword", "ms-htmlhelp", "ms-project", "msword-doc", "xls",
]
TRUNCATION, TYPE_SUBTYPE = r"^([^a-zA-Z0-9]*)([a-zA-Z0-9-/.+]*).*\z", r"^(.+)/(.+)$"
SUBTYPE_PARTS = r"^[-.+]*(?:x-|vnd\.)*([^+]*)\+*([a-z]*)(?:\+.*)*$"
TEXT_SUBTYPES = r"^(txt|text|plain|html|atom|xml|xhtml|css|pdf|postscript|dtd|rss|vcard|rtf|csv|javascript|json|perl|ruby|java|text-javascript|asp|php|doc|py|c|cc|c+|cxx|m|h)$"
HTML_SUBTYPES = r"^(html|xhtml)$"

ACCEPT_TEXT, ACCEPT_HTML, ACCEPT_OTHER, REJECT = "ACCEPT_TEXT", "ACCEPT_HTML", "ACCEPT_OTHER", "REJECT"


def normalize(mime: Column) -> Column:
    """Lower case, without what stands before and after type and subtype; ``no-type`` for null and for what goes on in another line."""
    return F.when(mime.rlike(TRUNCATION), F.lower(F.regexp_extract(mime, TRUNCATION, 2))).otherwise("no-type")


def _begins(x: Column, prefixes: list[str]) -> Column:
    return x.rlike("^(" + "|".join(prefixes) + ")")


def disposition(mime: Column) -> Column:
    m = normalize(mime)
    secondary = F.regexp_extract(m, TYPE_SUBTYPE, 2)
    primary = F.when(secondary == "", m).otherwise(F.regexp_extract(m, TYPE_SUBTYPE, 1))
    # a name alone is judged as a subtype too
    named = F.when(secondary == "", m).otherwise(secondary)
    left, right = F.regexp_extract(named, SUBTYPE_PARTS, 1), F.regexp_extract(named, SUBTYPE_PARTS, 2)
    html = left.rlike(HTML_SUBTYPES) | right.rlike(HTML_SUBTYPES)
    text = left.rlike(TEXT_SUBTYPES) | right.rlike(TEXT_SUBTYPES)
    bare = F.regexp_replace(secondary, r"^(vnd\.|x-)", "")
    return (
        F.when(m == "no-type", ACCEPT_OTHER)
        .when(primary == "", ACCEPT_OTHER)
        .when(_begins(primary, BINARY_TYPES + EXCLUDED_TYPES), REJECT)
        .when(_begins(primary, TEXT_TYPES), F.when(html, ACCEPT_HTML).otherwise(ACCEPT_TEXT))
        .when(secondary.isin(INVALID_EXTENSIONS) | primary.isin(INVALID_EXTENSIONS), REJECT)
        .when(html, ACCEPT_HTML)
        .when(text, ACCEPT_TEXT)
        .when(bare.isin(TEXT_APPLICATIONS), ACCEPT_TEXT)
        .when(bare.isin(OTHER_APPLICATIONS), ACCEPT_OTHER)
        .otherwise(REJECT)
    )


def is_text(mime: Column) -> Column:
    return disposition(mime).isin(ACCEPT_TEXT, ACCEPT_HTML)


def is_html(mime: Column) -> Column:
    return disposition(mime) == ACCEPT_HTML
