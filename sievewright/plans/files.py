"""Bytes of list and browser files, composed from the driver's tables for the queries of the readers."""

from __future__ import annotations

import io
import sqlite3
import struct
import tempfile
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def docx(rows: list[list[str]], target: str) -> bytes:
    """A table whose cells that begin with "@" are links to ``target``."""
    text = lambda s: f"<w:r><w:t>{escape(s)}</w:t></w:r>"
    cell = lambda s: f"<w:tc><w:p>{f'<w:hyperlink r:id="r7">{text(s[1:])}</w:hyperlink>' if s.startswith('@') else text(s)}</w:p></w:tc>"
    table = "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_MAIN}" xmlns:r="{_RELS}"><w:body><w:tbl>{table}</w:tbl></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships><Relationship Id="r7" Target={quoteattr(target)}/></Relationships>')
    return out.getvalue()


def doc(narrow: str, wide: str) -> bytes:
    """A Word 97 file: a compound file of 512-byte sectors whose text is a piece of code page 1252 and one of UTF-16."""
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    head, a, b = 0x400, narrow.encode("cp1252"), wide.encode("utf-16-le")
    ends = (0, len(narrow), len(narrow) + len(wide))
    pieces = struct.pack("<3I", *ends) + struct.pack("<HIH", 0, head * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, head + len(a), 0)
    formatting = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    main = bytearray(head) + a + b
    main[:2] = b"\xec\xa5"
    struct.pack_into("<H", main, 0x0A, 0x0200)
    struct.pack_into("<I", main, 0x4C, ends[-1])
    struct.pack_into("<II", main, 0x1A2, 0, len(formatting))
    main += bytes(max(4096 - len(main), -len(main) % 512))  # the stream must not be a small one
    small = formatting.ljust(64, b"\0")
    n_main = len(main) // 512
    # sectors: links, directory, links of small sectors, small sectors, then the text's
    links = [0xFFFFFFFD, end, end, end, *range(5, 4 + n_main), end]
    small_links = [end]

    def entry(name: str, kind: int, first: int, size: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return (raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind)).ljust(0x74, b"\0") + struct.pack("<IQ", first, size)

    directory = entry("Root Entry", 5, 3, len(small)) + entry("WordDocument", 2, 4, len(main)) + entry("1Table", 2, 0, len(formatting)) + bytes(128)
    header = bytearray(512)
    header[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<HH", header, 0x1E, 9, 6)
    struct.pack_into("<II", header, 0x2C, 1, 1)
    struct.pack_into("<III", header, 0x38, 4096, 2, 1)
    struct.pack_into("<II", header, 0x44, end, 0)
    struct.pack_into("<109I", header, 0x4C, 0, *[free] * 108)
    table = lambda of: struct.pack("<128I", *of, *[free] * (128 - len(of)))
    return bytes(header) + table(links) + directory + table(small_links) + small.ljust(512, b"\0") + bytes(main)


def history(rows: list[tuple], engine: str, query) -> list[tuple]:
    """What ``query`` (a path and an engine to rows) reads of a browser's database with the rows (url, micros, count)."""
    table, date = ("urls", "last_visit_time") if engine == "chromium" else ("moz_places", "last_visit_date")
    with tempfile.TemporaryDirectory() as folder:
        path = str(Path(folder) / "db")
        with sqlite3.connect(path) as db:
            db.execute(f"CREATE TABLE {table} (url TEXT, {date} INTEGER, visit_count INTEGER)")
            db.executemany(f"INSERT INTO {table} VALUES (?, ?, ?)", rows)
        db.close()
        return query(path, engine)
