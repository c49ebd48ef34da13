"""Formats of published lists: HTML tables, .docx, and .doc of Word 97 to 2003. Bytes in, rows of cells out."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree


class Unreadable(ValueError):
    """A file that is none of the known formats, or broken."""


def table_rows(content: bytes, kind: str) -> list[list[str]]:
    if kind == "html":
        return html_rows(decode_text(content))
    if kind == "docx":
        return docx_rows(content)
    if kind == "doc":
        return doc_rows(content)
    if kind in ("odt", "rtf", "fodt"):
        raise Unreadable(f"{kind} files need an office program; convert them to docx or html first")
    raise Unreadable("the format is not known")


def decode_text(content: bytes) -> str:
    """UTF-8, else the two Cyrillic code pages, else UTF-8 with replacements."""
    for encoding in ("utf-8", "cp1251", "koi8-r"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return content.decode("utf-8", "replace")


# --- HTML ------------------------------------------------------------------------------------------
class _Cells(HTMLParser):
    """Rows of cells; link targets stand before the linked text, block elements end a line."""

    BREAKS = frozenset("p br div li tr td h1 h2 h3".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.row: list[str] | None = None
        self.text: list[str] | None = None

    def put(self, s: str) -> None:
        if self.text is not None:
            self.text.append(s)

    def handle_starttag(self, tag, attrs):
        match tag:
            case "tr":
                self.row = []
            case "td" | "th":
                self.text = []
            case "a":
                for href in (v for k, v in attrs if k == "href" and v):
                    self.put(f" {href} ")
            case _ if tag in self.BREAKS:
                self.put("\n")

    def handle_endtag(self, tag):
        match tag:
            case "td" | "th" if self.text is not None:
                if self.row is not None:
                    self.row.append("".join(self.text))
                self.text = None
            case "tr" if self.row is not None:
                self.rows.append(self.row)
                self.row = None
            case _ if tag in self.BREAKS:
                self.put("\n")

    def handle_data(self, data):
        self.put(data)


def html_rows(page: str) -> list[list[str]]:
    parser = _Cells()
    parser.feed(page)
    parser.close()
    return parser.rows


# --- .docx -----------------------------------------------------------------------------------------
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def docx_rows(content: bytes) -> list[list[str]]:
    """Rows of all tables, nested ones included (so their text also stands in the outer cell)."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            if "word/document.xml" not in names:
                raise Unreadable("no Word document in the archive")
            body = ElementTree.fromstring(z.read("word/document.xml"))
            links = {}
            if "word/_rels/document.xml.rels" in names:
                links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
    # a damaged or encrypted member shows only when it is read
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, EOFError, KeyError, NotImplementedError, RuntimeError, ValueError) as e:
        raise e if isinstance(e, Unreadable) else Unreadable(f"broken .docx: {e}") from e

    def text(cell: ElementTree.Element) -> Iterator[str]:
        for node in cell.iter():
            name = node.tag.removeprefix(_WORD)
            if name == "hyperlink" and links.get(node.get(_REL)):
                yield f" {links[node.get(_REL)]} "
            elif name == "t":
                yield node.text or ""
            elif name in ("br", "p", "tab"):
                yield "\n"

    return [["".join(text(c)) for c in row.findall(f"{_WORD}tc")] for table in body.iter(f"{_WORD}tbl") for row in table.findall(f"{_WORD}tr")]


# --- .doc: compound file ---------------------------------------------------------------------------
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_LAST_SECTOR = 0xFFFFFFFA
#: fixed values: bytes from 0x82 to 0x9F that stand for their code points
UNUSED = bytes.fromhex("8D8E8F909D9E")


def _u32(data: bytes, at: int, n: int = 1) -> tuple[int, ...]:
    try:
        return struct.unpack_from(f"<{n}I", data, at)
    except struct.error as e:
        raise Unreadable("the file is cut short") from e


def compound_streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name. Chains that loop are cut."""
    if data[:8] != MAGIC:
        raise Unreadable("not a compound file")
    sector_size, mini_size = (1 << v for v in struct.unpack_from("<HH", data, 0x1E))
    cutoff = _u32(data, 0x38)[0]
    entries_a_sector = sector_size // 4

    def sector(i: int) -> bytes:
        s = data[(i + 1) * sector_size : (i + 2) * sector_size]
        if len(s) < sector_size:
            raise Unreadable("the file is cut short")
        return s

    def follow(first: int, links: list[int]) -> list[int]:
        path, at = {}, first
        while at < min(len(links), _LAST_SECTOR) and at not in path:
            path[at] = None
            at = links[at]
        return list(path)

    table_sectors = list(_u32(data, 0x4C, 109))
    more, left = _u32(data, 0x44, 2)
    while left and more < _LAST_SECTOR:
        *part, more = _u32(sector(more), 0, entries_a_sector)
        table_sectors += part
        left -= 1
    used = [s for s in table_sectors[: _u32(data, 0x2C)[0]] if s < _LAST_SECTOR]
    links = [v for s in used for v in _u32(sector(s), 0, entries_a_sector)]
    whole = lambda first: b"".join(map(sector, follow(first, links)))

    first_mini, n_mini = _u32(data, 0x3C, 2)
    mini_links = [v for s in follow(first_mini, links)[:n_mini] for v in _u32(sector(s), 0, entries_a_sector)] if n_mini else []
    directory = whole(_u32(data, 0x30)[0])
    records = [directory[i : i + 128] for i in range(0, len(directory) - 127, 128)]
    found = []
    small = b""
    for r in records:
        length, kind = struct.unpack_from("<HB", r, 0x40)
        first, size = struct.unpack_from("<IQ", r, 0x74)
        if length < 2:
            continue
        if kind == 5:
            small = whole(first)[:size]
        elif kind == 2:
            found.append((r[: length - 2].decode("utf-16-le", "replace"), first, size))

    def content(first: int, size: int) -> bytes:
        if size >= cutoff:
            return whole(first)[:size]
        return b"".join(small[i * mini_size : (i + 1) * mini_size] for i in follow(first, mini_links))[:size]

    return {name: content(first, size) for name, first, size in found}


def one_byte(piece: bytes) -> str:
    """Text of a one-byte piece: code points, but 0x82 to 0x9F in code page 1252, less the few that it has and Word has not."""
    return "".join(chr(b) if b < 0x82 or b > 0x9F or b in UNUSED else bytes([b]).decode("cp1252") for b in piece)


def doc_text(data: bytes) -> str:
    """The main text of a Word 97 to 2003 file, put together by its piece table."""
    streams = compound_streams(data)
    main = streams.get("WordDocument", b"")
    if main[:2] != b"\xec\xa5":
        raise Unreadable("no Word text in the compound file")
    order = ("0Table", "1Table") if not main[0x0B] & 2 else ("1Table", "0Table")
    table = next((streams[n] for n in order if n in streams), b"")
    at, size = _u32(main, 0x1A2, 2)
    formatting = table[at : at + size]
    pos = 0
    while formatting[pos : pos + 1] == b"\x01":  # property blocks before the piece table
        pos += 3 + struct.unpack_from("<h", formatting, pos + 1)[0]
    if formatting[pos : pos + 1] != b"\x02":
        raise Unreadable("no piece table")
    pieces = formatting[pos + 5 : pos + 5 + _u32(formatting, pos + 1)[0]]
    n = (len(pieces) - 4) // 12
    if n < 1:
        raise Unreadable("the piece table is empty")
    ends = _u32(pieces, 0, n + 1)
    out = []
    for i in range(n):
        start, count = _u32(pieces, 4 * (n + 1) + 8 * i + 2)[0], ends[i + 1] - ends[i]
        if start & 0x40000000:
            start = (start ^ 0x40000000) // 2
            out.append(one_byte(main[start : start + count]))
        else:
            out.append(main[start : start + 2 * count].decode("utf-16-le", "replace"))
    length = _u32(main, 0x4C)[0]
    return "".join(out)[: length or None]


def open_fields(text: str) -> str:
    """Link fields become their target and the visible text, other fields the visible text."""
    out = []
    while text:
        before, begin, rest = text.partition("\x13")
        out.append(before)
        inside, end, after = rest.partition("\x15")
        if not begin or not end:
            out.append(rest)
            break
        code, _, shown = inside.partition("\x14")
        quoted = code.split('"')
        if "HYPERLINK" in code.upper() and len(quoted) > 1:
            out.append(f" {quoted[1]} ")
        out.append(shown)
        text = after
    return "".join(out)


def marked_rows(text: str) -> list[list[str]]:
    """Cells end with a mark; a mark right after a cell ends the row."""
    rows, cells = [], []
    *marked, tail = open_fields(text).translate({0x0B: "\n", 0x0D: "\n"}).split("\x07")
    for cell in marked:
        if cell or not cells:
            cells.append(cell)
        else:
            rows.append(cells)
            cells = []
    # what follows the last mark is no cell
    return [*rows, cells] if cells else rows


def doc_rows(data: bytes) -> list[list[str]]:
    try:
        return marked_rows(doc_text(data))
    except struct.error as e:
        raise Unreadable("the file is cut short") from e
