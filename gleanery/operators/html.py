"""HTML to text nodes, in document order and without the text of links."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import map_arrow

from gleanery.functions import text as T

# The named references that are resolved without Python; & comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&middot;": "·", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&sect;": "§", "&para;": "¶", "&bull;": "•", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&euro;": "€", "&pound;": "£", "&cent;": "¢", "&yen;": "¥", "&deg;": "°", "&frac12;": "½", "&frac14;": "¼", "&frac34;": "¾", "&times;": "×", "&ensp;": " ", "&emsp;": " ", "&thinsp;": " ", "&amp;": "&"}
# Windows characters that numeric references from 128 to 159 mean in HTML; the five missing ones mean themselves.
WINDOWS = {128: "€", 130: "‚", 131: "ƒ", 132: "„", 133: "…", 134: "†", 135: "‡", 136: "ˆ", 137: "‰", 138: "Š", 139: "‹", 140: "Œ", 142: "Ž", 145: "‘", 146: "’", 147: "“", 148: "”", 149: "•", 150: "–", 151: "—", 152: "˜", 153: "™", 154: "š", 155: "›", 156: "œ", 158: "ž", 159: "Ÿ"}
# Elements that end an open paragraph or link text around them, and elements without an end.
BLOCKS = frozenset("address article aside blockquote body center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style")


def _numeric(text):
    """Numeric references as characters, in the JVM: one piece of the text after each ``&#``."""

    def piece(x):
        digits = F.regexp_extract(x, "^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));?", 0)
        hexadecimal = F.regexp_extract(x, "^[xX]([0-9a-fA-F]{1,6})", 1)
        code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(F.regexp_extract(x, "^([0-9]{1,7})", 1)).try_cast("int")
        # four bytes of UTF-32 hold any character; numbers that name none are replaced
        one = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        known = F.when(code == 38, "&amp;").when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
        for number, char in WINDOWS.items():
            known = known.when(code == number, char)
        return F.when(digits == "", F.concat(F.lit("&#"), x)).otherwise(F.concat(known.otherwise(one), F.substring(x, F.length(digits) + 1, F.length(x))))

    parts = F.split(text, "&#")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(text.contains("&#"), F.concat(parts[0], F.array_join(F.transform(rest, piece), ""))).otherwise(text)


def text_nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``doc``, ``node_idx`` and ``text`` of each run of text between tags, by regular expressions in the JVM.

    Comments, scripts, styles and closed links vanish with their text; other tags only part the text. Numeric references and
    the named ones of ``ENTITIES`` are resolved. Nodes are stripped, with no-break spaces as spaces, and empty ones left
    out. This way is for well-formed pages; see ``parsed_text_nodes`` for any others.
    """
    html = F.col(html_col)
    for pattern in ("(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<a\b[^>]*>.*?</a\s*>"):
        html = F.regexp_replace(html, pattern, "<>")
    parts = F.split(html, "<[^>]*>")
    rows = pages.select(F.col(id_col).alias("doc"), F.posexplode(parts).alias("raw_idx", "text"))
    text = _numeric(F.col("text"))
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    rows = rows.select("doc", F.col("raw_idx").alias("node_idx"), T.trim_ws(F.translate(text, "\u00a0", " ")).alias("text")).where("text <> ''")
    return rows


class _Nodes(HTMLParser):
    """Text outside of links, scripts and styles. Open elements are kept on a stack: an end tag closes all that was opened
    within its element; a link also ends at the next link and with the block it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.places: dict[str, list[int]] = {}  # where each element stands on the stack
        self.blocks: list[int] = []
        self.links = 0
        self.hidden = ""
        self.now: list[str] = []

    def _end_node(self) -> None:
        text = "".join(self.now).replace("\u00a0", " ").strip()
        if text:
            self.out.append(text)
        self.now = []

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.links -= tag == "a"

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag, attrs):
        self._end_node()
        if tag in HIDDEN:
            self.hidden = tag
            return
        if tag in VOID:
            return
        if tag == "a" and self.links:
            self._close(self._last("a"))
        elif tag in BLOCKS:
            # a block ends the paragraph it begins in, and with it the links of that paragraph
            at = self._last("p")
            if at >= 0 and at == self.blocks[-1]:
                self._close(at)
            self.blocks.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self._end_node()  # such as <br/>, or <a name="x"/> which holds no text

    def handle_endtag(self, tag):
        self._end_node()
        if tag in HIDDEN:
            self.hidden = ""
            return
        at = self._last(tag)
        # the end of something inline does not reach out of the block it stands in
        if at >= 0 and (tag in BLOCKS or tag == "a" or not self.blocks or self.blocks[-1] < at):
            self._close(at)

    def handle_data(self, data):
        if not self.links and not self.hidden:
            self.now.append(data)

    def handle_comment(self, data):
        self._end_node()


def nodes_of(page: str) -> list[str]:
    parser = _Nodes()
    parser.feed(page)
    parser.close()
    parser._end_node()
    return parser.out


def parsed_text_nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``text_nodes`` by the parser of the standard library, which takes unclosed and misnested tags.

    A link that is never closed ends with the block it stands in, or at the next link; all references are resolved.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, at, texts = [], [], []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = nodes_of(html) if html is not None else []
                ids += [i] * len(found)
                at += range(len(found))
                texts += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(at, pa.int32()), pa.array(texts, pa.string())], names=["doc", "node_idx", "text"])

    return map_arrow(pages.select(F.col(id_col).alias("doc"), F.col(html_col).alias("html")), run, f"doc {kind}, node_idx int, text string")


def line_nodes(documents: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Nodes of plain text: its lines."""
    rows = documents.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("node_idx", "text"))
    return rows.select("doc", "node_idx", T.trim_ws(F.translate("text", "\u00a0", " ")).alias("text")).where("text <> ''")
