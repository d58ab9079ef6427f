"""``dom_nodes(html)``: a document's nodes in order, as a table function."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql.functions import udtf

from arcspark import schemas

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Walker(HTMLParser):
    def __init__(self, skip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skip, self.rows, self.open, self.quiet = skip, [], [], 0

    def _add(self, kind: str, name: str | None, text: str | None) -> None:
        if not self.quiet:
            self.rows.append((len(self.rows), len(self.open), kind, name, text))

    def handle_starttag(self, tag, attrs):
        self._add("element", tag, " ".join(f'{k}="{v or ""}"' for k, v in attrs) or None)
        if tag not in VOID:
            self.open.append(tag)
            self.quiet += tag in self.skip or bool(self.quiet)

    def handle_endtag(self, tag):
        while tag in self.open:
            last = self.open.pop()
            self.quiet -= bool(self.quiet)
            if last == tag:
                break

    def handle_data(self, data):
        self._add("text", None, data)

    def handle_comment(self, data):
        self._add("comment", None, data)


def walk(html: str | None, skip_children: str = "") -> list[tuple]:
    """(index, depth, kind, name, text) of each node; what lies in ``skip_children`` tags is left out."""
    walker = _Walker(frozenset(skip_children.split()))
    walker.feed(html or "")
    walker.close()
    return walker.rows


@udtf(returnType=schemas.DOM_NODE)
class DomNodes:
    def eval(self, html: str, skip_children: str = ""):
        yield from walk(html, skip_children)
