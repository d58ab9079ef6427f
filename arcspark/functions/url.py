"""URL parsing, canonical form and fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F

from arcspark import schemas
from arcspark.functions import domain
from arcspark.functions.hashing import rabin_many, string_hash
from arcspark.functions.session_ids import strip_session_id

# Schemes with a host and their default ports; characters a path and a host keep as they are.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "gopher": "70", "file": ""}
_PATH_KEEPS = set(b"!$&'()*+,-./0123456789:;=@ABCDEFGHIJKLMNOPQRSTUVWXYZ[]_abcdefghijklmnopqrstuvwxyz|~")
_PATH_UNESCAPES = set(b"-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~!$'()*,")
_HOST_KEEPS = re.compile(r"[0-9a-z\-._+\[\]:]")
_HOST_ESCAPES = set("!\"$&'()*,;<=>`{|}")


@dataclass
class Parts:
    valid: bool
    scheme: str = ""
    username: str = ""
    password: str = ""
    host: str = ""
    port: str = ""
    path: str = ""
    query: str | None = None
    ref: str | None = None

    @property
    def canonical(self) -> str:
        user = f"{self.username}{':' + self.password if self.password else ''}@" if self.username or self.password else ""
        host = f"//{user}{self.host}{':' + self.port if self.port else ''}" if self.scheme in DEFAULT_PORTS else ""
        return f"{self.scheme}:{host}{self.path}{'' if self.query is None else '?' + self.query}{'' if self.ref is None else '#' + self.ref}"


def _ipv4(host: str) -> tuple[str | None, bool]:
    """(dotted form or None, broken): octal, hexadecimal and short forms count as addresses."""
    parts = host.removesuffix(".").split(".")
    if not 1 <= len(parts) <= 4 or not all(parts):
        return None, False
    values = []
    for p in parts:
        if not re.fullmatch(r"0x[0-9a-f]*|[0-9]+", p):
            return None, False
        try:
            values.append(int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        except ValueError:
            return None, True
    if any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
        return None, True
    number = values[-1]
    for i, v in enumerate(values[:-1]):
        number += v << 8 * (3 - i)
    return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0)), False


def _unescaped(text: str) -> bytes:
    data = text.encode("utf-8", "replace")
    return re.sub(rb"%([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), data)


def canonical_host(host: str) -> tuple[str, bool]:
    """(host, valid). Escapes are undone, names are lower-cased and put in ASCII form; blanks are refused."""
    if host.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(host[1:-1]).compressed}]", host.endswith("]")
        except ValueError:
            return host.lower(), False
    try:
        name = _unescaped(host).decode("utf-8")
    except UnicodeDecodeError:
        return host.lower(), False
    if not name.isascii():
        try:
            name = ".".join(label.encode("idna").decode("ascii") if label and not label.isascii() else label for label in re.split("[.。．｡]", name))
        except UnicodeError:
            return host.lower(), False
    out, valid = [], bool(name)
    for c in name.lower():
        if _HOST_KEEPS.match(c):
            out.append(c)
        else:
            valid = valid and c in _HOST_ESCAPES
            out.append(f"%{ord(c):02X}")
    text = "".join(out)
    address, broken = _ipv4(text)
    return (address, valid) if address else (text, valid and not broken)


def canonical_path(path: str) -> str:
    """Back slashes turn, needless escapes go, other characters are escaped, dot segments are resolved."""
    data, out, i = path.replace("\\", "/").encode("utf-8", "replace"), bytearray(), 0
    while i < len(data):
        b = data[i]
        code = data[i + 1 : i + 3]
        if b == 0x25 and re.fullmatch(rb"[0-9a-fA-F]{2}", code):
            v = int(code, 16)
            out += bytes([v]) if v in _PATH_UNESCAPES else data[i : i + 3]
            i += 3
            continue
        out += bytes([b]) if b in _PATH_KEEPS or b == 0x25 else b"%%%02X" % b
        i += 1
    segments: list[str] = []
    parts = out.decode("ascii").split("/")[1:]
    for n, s in enumerate(parts):
        final = n == len(parts) - 1
        if s == "..":
            if segments:
                segments.pop()
            if final:
                segments.append("")
        elif s == ".":
            if final:
                segments.append("")
        else:
            segments.append(s)
    return "/" + "/".join(segments)


def _escaped(text: str, refuse: set[int]) -> str:
    return "".join(chr(b) if 0x20 < b < 0x7F and b not in refuse else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


def parse(url: str | None) -> Parts:
    text = re.sub(r"[\t\r\n]", "", url or "").strip("".join(map(chr, range(0x21))))
    m = re.match(r"([a-yA-Y][a-zA-Z0-9+.\-]*):(.*)", text, re.S)
    if not m:
        return Parts(False)
    scheme, rest = m[1].lower(), m[2]
    rest, mark, ref = rest.partition("#")
    ref = re.sub(r"[\x00-\x1f]", "", ref) if mark else None
    if scheme not in DEFAULT_PORTS:
        path, mark, query = rest.partition("?")
        return Parts(True, scheme, path=path, query=query if mark else None, ref=ref)
    rest = rest.replace("\\", "/") if "?" not in rest else rest.partition("?")[0].replace("\\", "/") + "?" + rest.partition("?")[2]
    body = re.sub(r"^/*", "", rest) if scheme != "file" else re.sub(r"^//", "", rest)
    m = re.match(r"([^/?]*)([^?]*)(\?.*)?", body, re.S)
    authority, path, query = m[1], m[2], m[3]
    user, at, server = authority.rpartition("@")
    name, _, password = user.partition(":")
    port = ""
    p = re.match(r"(\[[^\]]*\]|[^:]*)(?::(.*))?$", server, re.S)
    host, port = (p[1], p[2] or "") if p else (server, "")
    host, valid = canonical_host(host) if host else ("", scheme == "file")
    if port:
        valid = valid and port.isascii() and port.isdigit() and int(port) <= 65535
        port = str(int(port)) if port.isascii() and port.isdigit() else port
    if port == DEFAULT_PORTS[scheme]:
        port = ""
    quote = lambda x: _escaped(x, set(b"/:;<=>?@[\\]^{|}\"#"))
    return Parts(valid, scheme, quote(name) if at else "", quote(password) if at else "", host, port, canonical_path(path or "/"), _escaped(query[1:], set(b"\"#<>")) if query else None, ref)


def canonicalize(url: str | None, strip_www: bool = False) -> str | None:
    """The URL under which a page is known: no fragment, session id, path parameters or port 80; None if invalid."""
    p = parse(url)
    if not p.valid:
        return None
    if p.scheme not in DEFAULT_PORTS:
        return strip_session_id(f"{p.scheme}:{p.path}" + (f"?{p.query}" if p.query else ""))
    host = p.host.removesuffix(".")
    if strip_www and host.startswith("www.") and domain.root_domain(host) != host:
        host = host[4:]
    user = f"{p.username}{':' + p.password if p.password else ''}@" if p.username else ""
    port = f":{p.port}" if p.port not in ("", "80") else ""
    return strip_session_id(f"{p.scheme}://{user}{host}{port}{p.path.partition(';')[0]}" + (f"?{p.query}" if p.query else ""))


def _names(url: str | None) -> tuple[str, str, str] | None:
    """What the hashes of a URL are taken of: its domain, its canonical form, its root domain; None without one of them."""
    known = canonicalize(url, strip_www=True)
    host = parse(known).host if known else ""
    root = domain.root_domain(host)
    if not host or not root:
        return None
    return host.removeprefix("www.") if host != root else host, known, root


def fingerprints(urls: Iterable[str | None]) -> list[tuple[int, int, int] | None]:
    """(domain, url, root domain) hashes of each canonical URL, each different name hashed once and all together; None without a host or root domain."""
    names = [_names(u) for u in urls]
    each = list(dict.fromkeys(n for x in names if x for n in x))
    hashes = dict(zip(each, rabin_many([n.encode("utf-16-le", "surrogatepass") for n in each]).tolist(), strict=True)) if each else {}
    return [x and (hashes[x[0]], hashes[x[1]], hashes[x[2]]) for x in names]


def fingerprint(url: str | None) -> tuple[int, int, int] | None:
    return fingerprints([url])[0]


@F.pandas_udf(schemas.URL_PARTS)
def parse_url(urls: pd.Series) -> pd.DataFrame:
    found = [parse(u) for u in urls]
    return pd.DataFrame({f: [getattr(p, f) for p in found] for f in schemas.URL_PARTS.fieldNames()})


@F.pandas_udf(schemas.S)
def canonical_url(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: canonicalize(u, True), na_action="ignore")


@F.pandas_udf(schemas.S)
def canonical_url_keep_www(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: canonicalize(u, False), na_action="ignore")


@F.pandas_udf(schemas.S)
def without_session_id(urls: pd.Series) -> pd.Series:
    return urls.map(strip_session_id, na_action="ignore")


@F.pandas_udf(schemas.L)
def url_fp64(urls: pd.Series) -> pd.Series:
    known = urls.notna().to_numpy()
    out = pd.Series(pd.NA, index=urls.index, dtype="Int64")
    if known.any():
        out[known] = rabin_many([u.encode("utf-16-le", "surrogatepass") for u in urls[known]])
    return out


@F.pandas_udf(schemas.I)
def host_fp32(hosts: pd.Series) -> pd.Series:
    return hosts.map(string_hash, na_action="ignore").astype("Int32")


@F.pandas_udf(schemas.URL_FINGERPRINT)
def url_fingerprint(urls: pd.Series) -> pd.DataFrame:
    found = [x or (None, None, None) for x in fingerprints(urls)]
    return pd.DataFrame(found, columns=schemas.URL_FINGERPRINT.fieldNames()).astype("Int64")


@F.pandas_udf(schemas.S)
def resolve(base: pd.Series, relative: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, r) if b is not None and r is not None else None for b, r in zip(base, relative, strict=True)])
