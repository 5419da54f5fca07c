"""Reader of HTML pages as document IR: headings, paragraphs and blocks of other kinds, with the section each stands in.

A page is read forward once, in time linear in its length, whatever is wrong with it."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = "struct<kind:string,level:int,text:string,region:string,path:array<int>,begin:long>"
ROWS = 256  #: parsed pages held at once

# Elements of HTML that begin and end blocks, and those whose content is not markup.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = set("iframe noembed noframes noscript script style textarea title xmp".split())
REGIONS = ("nav", "aside", "footer")
#: Elements whose end also ends what was left open inside them.
TRACKED = {"article", "aside", "body", "dd", "div", "dl", "dt", "footer", "li", "main", "menu", "nav", "ol", "pre", "section", "table", "ul"}
ITEMS = ("li", "dt", "dd")

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^>])*+)(?:>|\Z)""", re.S)
LANG = re.compile(r"""(?:\A|[\s"'/])lang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ENDS = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I) for name in RAW}
WORDS = re.compile(r"[^ \t\n\f\r]+")
CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([a-zA-Z][a-zA-Z0-9]*));")


def one_line(text: str) -> str:
    return " ".join(WORDS.findall(text))


def closed_only(text: str) -> str:
    """``text`` with the character references decoded that end in a semicolon."""
    return CLOSED.sub(lambda m: m[0] if m[1] and f"{m[1]};" not in html5 else html.unescape(m[0]), text)


class Page:
    """Title, language and blocks of one page."""

    def __init__(self, source: str, regions: bool, unclosed: bool = True) -> None:
        self.decode = html.unescape if unclosed else closed_only
        self.title: str | None = None
        self.language: str | None = None
        self.blocks: list[dict] = []
        self.keep = regions
        self.parts: list[str] = []
        self.open: list[str] = []
        self.count: Counter = Counter()
        self.heading = 0
        self.sections: list[tuple[int, int]] = []  # level and block of the headings that the next block is under
        self.begin: dict[int, int] = {}  # characters so far of each open section
        self.read(source)

    def read(self, source: str) -> None:
        at = 0
        while found := TAG.search(source, at):
            self.say(source[at : found.start()])
            at = found.end()
            name = (found[2] or "").lower()
            if found[1]:
                self.end(name)
            elif name in RAW:
                until = ENDS[name].search(source, at)
                inner = source[at : until.start() if until else len(source)]
                at = until.start() if until else len(source)
                if name == "title" and self.title is None:
                    self.title = one_line(self.decode(inner))
            elif name:
                self.start(name, found[3])
        self.say(source[at:])
        self.flush()

    def say(self, text: str) -> None:
        if text:
            self.parts.append(self.decode(text))

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append("\n")
        if name == "html" and self.language is None and (found := LANG.search(attributes)):
            self.language = self.decode(found[1] or found[2] or found[3] or "") or None
        if name not in BLOCKS or not self.boundary(name):
            return
        if name in ITEMS and self.open and self.open[-1] in ITEMS:
            self.close(self.open[-1])
        if name in TRACKED:
            self.open.append(name)
            self.count[name] += 1
        self.heading = int(name[1]) if len(name) == 2 and name[1] in "123456" else self.heading

    def end(self, name: str) -> None:
        if name not in BLOCKS or not self.boundary(name):
            return
        if self.count[name]:
            self.close(name)
        if len(name) == 2 and name[1] in "123456":
            self.heading = 0

    def boundary(self, name: str) -> bool:
        """Ends the block so far; False inside a table, which is one block with all that is in it."""
        if self.count["table"] and name != "table":
            self.parts.append(" ")
            return False
        self.flush()
        return True

    def close(self, name: str) -> None:
        while True:
            last = self.open.pop()
            self.count[last] -= 1
            if last == name:
                return

    def flush(self) -> None:
        said, self.parts = "".join(self.parts), []
        kind = "table" if self.count["table"] else "heading" if self.heading else "code" if self.count["pre"] else "list_item" if any(self.count[i] for i in ITEMS) else "paragraph"
        text = one_line(said) if kind != "code" else said.strip("\r\n") if said.strip() else ""
        if not text:
            return
        level, self.heading = self.heading if kind == "heading" else None, 0 if kind == "heading" else self.heading
        region = next((r for r in REGIONS if self.count[r]), None)
        if region and not self.keep:
            return
        place = len(self.blocks)
        if level and not region:
            while self.sections and self.sections[-1][0] >= level:
                self.begin.pop(self.sections.pop()[1])
            self.sections.append((level, place))
        here = -2 if region else self.sections[-1][1] if self.sections else -1
        begin = self.begin.get(here, 0)
        self.begin[here] = begin + len(text) + 1
        self.blocks.append({"kind": kind, "level": level, "text": text, "region": region, "path": [] if region else [p for _, p in self.sections], "begin": begin})


def page_ir(pages: DataFrame, key: str = "page_id", regions: bool = False, unclosed: bool = True) -> DataFrame:
    """``key``, title, language and blocks (kind, level, text, region, path, begin) of each row's ``html``.

    Kinds are heading (level 1 to 6), paragraph, list_item, code (``pre``, as it is written) and table (one block with all
    that is in it); other blocks than code are one line of words, entities decoded; without ``unclosed`` only those that
    end in a semicolon, so that a reference that was cut off stays as it is written, however much is left of it. A block ends where any block element
    begins or ends; a heading that isn't closed ends there too. An end tag without a start is passed over, one that skips
    open elements ends them, an unclosed comment, tag or script reaches to the end of the page; scripts and styles are no
    text. ``path`` names the headings that a block stands under, by their places in ``blocks``, itself included if it is
    one (six places at most, so paths stay short however long headings are); ``begin`` counts the characters before it
    in its section. Blocks of nav, aside and footer are left out, or with ``regions`` kept, with the region's name and
    outside all sections. Null html has no block; repeated rows stay; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("region", pa.string()), ("path", pa.list_(pa.int32())), ("begin", pa.int64())])
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("title", pa.string()), ("language", pa.string()), ("blocks", pa.list_(block))])
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                found = [Page(source or "", regions, unclosed) for source in part.column(1).to_pylist()]
                columns = [pa.array([p.title for p in found], pa.string()), pa.array([p.language for p in found], pa.string()), pa.array([p.blocks for p in found], pa.list_(block))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInArrow(run, f"`{key}` {kind}, title string, language string, blocks array<{BLOCK}>")
