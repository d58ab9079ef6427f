"""Session ids in URLs: ordered rules, the first that finds an id strips it."""

from __future__ import annotations

import re
from collections.abc import Callable

_HEX32 = re.compile(r"[0-9a-f]{32}")
_ALNUM26 = re.compile(r"[0-9a-z]{26}")


def _is_hex32(x: str) -> bool:
    return _HEX32.fullmatch(x) is not None


def _until(low: str, start: int, stops: str) -> int:
    return next((i for i in range(start, len(low)) if low[i] in stops), len(low))


def _php(url: str, low: str) -> str | None:
    at = low.rfind("phpsessid")
    begin = at + 10
    if at < 1 or begin > len(low) or low[begin - 1] not in "=.-+/":
        return None
    end = _until(low, begin, "&.-+/")
    name = low[begin:end]
    return url[: at - 1] + url[end:] if _is_hex32(name) or _ALNUM26.fullmatch(name) else None


def _php_path(url: str, low: str) -> str | None:
    if ".php" not in low:
        return None
    before, slash, last = low.rpartition("/")
    return url[: len(before)] if slash and _is_hex32(last) and before.rpartition("/")[2].startswith("oscsid") else None


def _osc_path(url: str, low: str) -> str | None:
    at = low.rfind("oscsid")
    slash = low.find("/", at) if at > 0 else -1
    return url[: at - 1] if slash >= 0 and _is_hex32(low[slash + 1 :]) else None


def _osc_html(url: str, low: str) -> str | None:
    at, end = low.rfind("-oscsid-"), low.rfind(".html")
    return url[:at] + url[end:] if 0 <= at < end and _is_hex32(low[at + 8 : end]) else None


def _segment(token: str) -> Callable[[str, str], str | None]:
    def rule(url: str, low: str) -> str | None:
        at = low.find(token)
        end = low.find("/", at + len(token)) if at >= 0 else -1
        return url[:at] + url[end:] if end >= 0 and _is_hex32(low[at + len(token) : end]) else None

    return rule


def _dollar(url: str, low: str) -> str | None:
    at = low.find(";$sessionid$")
    rest = low[at + 12 :]
    return url[:at] if at >= 0 and (not rest or rest.isascii() and rest.isalnum()) else None


def _dashes(url: str, low: str) -> str | None:
    at = low.find("--session_id.")
    end = low.find("--", at + 13) if at >= 0 else -1
    digits = low[at + 13 : end]
    return url[:at] + url[end:] if end >= 0 and (not digits or digits.isascii() and digits.isdigit()) else None


def _sid(url: str, low: str) -> str | None:
    for token in ("sid", "oscsid", "mscsid"):
        at = low.rfind(token)
        begin = at + len(token) + 1
        if at >= 1 and low[at - 1] in "/?&+" and begin <= len(low) and low[begin - 1 : begin] in tuple("=.-+/"):
            end = _until(low, begin, "&.+/")
            name = low[begin:end]
            least = 32 if re.fullmatch("[0-9a-f]+", name) else 36 if re.fullmatch("[0-9a-f-]+", name) else 26 if name.isascii() and name.isalnum() else None
            return url[: at - 1] + url[end:] if least and len(name) >= least else None
    return None


def _jsession(url: str, low: str) -> str | None:
    at = low.find(";jsessionid=")
    if at < 0:
        return None
    end = low.find("?", at)
    return url[:at] + (url[end:] if end >= 0 else "")


RULES = (_php, _php_path, _osc_path, _osc_html, _segment("/sessions/"), _dollar, _segment("/session_id/"), _dashes, _sid, _jsession)


def strip_session_id(url: str) -> str:
    low = url.lower()
    return next((out for rule in RULES if (out := rule(url, low)) is not None), url)
