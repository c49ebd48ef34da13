"""Readers on files built here."""

import io
import json
import sqlite3
import struct
import zipfile

import pytest

from sievewright.operators import reference_list
from sievewright.sources import browser, containers, documents

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def docx(rows, link):
    cell = lambda s: f'<w:tc><w:p><w:hyperlink r:id="r1"><w:r><w:t>{s}</w:t></w:r></w:hyperlink></w:p></w:tc>' if s == "LINK" else f"<w:tc><w:p><w:r><w:t>{s}</w:t></w:r></w:p></w:tc>"
    body = "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="x"><Relationship Id="r1" Target="{link}"/></Relationships>')
    return out.getvalue()


def doc(text: str) -> bytes:
    """A compound file with a Word text in one one-byte and one two-byte piece, all streams in the mini stream or sectors."""
    half = len(text) // 2
    narrow, wide = text[:half].encode("latin-1"), text[half:].encode("utf-16-le")
    main = bytearray(0x400) + narrow + wide
    main[0:2] = b"\xec\xa5"
    struct.pack_into("<H", main, 0x0A, 1 << 9)
    struct.pack_into("<I", main, 0x4C, len(text))
    plc = struct.pack("<3I", 0, half, len(text)) + struct.pack("<HIH", 0, (0x400 * 2) | 0x40000000, 0) + struct.pack("<HIH", 0, 0x400 + half, 0)
    clx = b"\x01" + struct.pack("<h", 3) + b"abc" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    main += bytes(-len(main) % 512 + (4096 if len(main) < 4096 else 0))
    mini = clx + bytes(-len(clx) % 64)
    n_main = len(main) // 512 + (len(main) % 512 > 0)
    main += bytes(n_main * 512 - len(main))
    # sectors: 0 FAT, 1 directory, 2 mini FAT, 3 mini stream, 4.. main
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    fat = [0xFFFFFFFD, end, end, end] + [5 + i for i in range(n_main - 1)] + [end]
    fat += [free] * (128 - len(fat))
    n_mini = len(mini) // 64
    mini_fat = [i + 1 for i in range(n_mini - 1)] + [end] + [free] * (128 - n_mini)

    def entry(name, kind, first, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + bytes(0x74 - 0x43) + struct.pack("<IQ", first, size)

    directory = entry("Root Entry", 5, 3, len(mini)) + entry("WordDocument", 2, 4, len(main)) + entry("1Table", 2, 0, len(clx)) + bytes(128)
    header = bytearray(512)
    header[:8] = containers.MAGIC
    struct.pack_into("<HH", header, 0x1E, 9, 6)
    struct.pack_into("<I", header, 0x2C, 1)
    struct.pack_into("<I", header, 0x30, 1)
    struct.pack_into("<III", header, 0x38, 4096, 2, 1)
    struct.pack_into("<II", header, 0x44, end, 0)
    struct.pack_into("<109I", header, 0x4C, 0, *[free] * 108)
    return bytes(header) + struct.pack("<128I", *fat) + directory + struct.pack("<128I", *mini_fat) + mini.ljust(512, b"\0") + bytes(main)


def test_doc_text_and_rows():
    text = "kind\x07see \x13 HYPERLINK \"https://t.me/abc\" \x14here\x15\x0bon\x07court\x07\x07second\x07x\x07y\x07\x07"
    assert containers.doc_text(doc(text)) == text
    assert containers.doc_rows(doc(text)) == [["kind", "see  https://t.me/abc here\non", "court"], ["second", "x", "y"]]


def test_fields_and_marks():
    assert containers.open_fields('a\x13 PAGE \x14 7\x15b\x13 HYPERLINK "u"\x15c\x13open') == "a 7b u copen"
    assert containers.marked_rows("a\x07b\x07\x07c\x07tail") == [["a", "b"], ["c"]]


@pytest.mark.parametrize("content", [b"junk", containers.MAGIC + b"short", containers.MAGIC + bytes(600), doc("text")[:1500]])
def test_broken_doc(content):
    with pytest.raises(containers.Unreadable):
        containers.doc_rows(content)


@pytest.mark.parametrize("damage", ["cut", "flip", "encrypted", "no document"])
def test_broken_docx(damage):
    content = bytearray(docx([["k" * 5000, "d", "c"]], "u"))
    if damage == "cut":
        content = content[: len(content) // 2]
    elif damage == "flip":
        content = bytearray(zip_of(zipfile.ZIP_DEFLATED))
        at = content.index(b"document.xml") + 40
        content[at : at + 60] = bytes(60)
    elif damage == "encrypted":
        for mark in (b"PK\x03\x04", b"PK\x01\x02"):
            at = content.index(mark)
            content[at + (6 if mark[2] == 3 else 8)] |= 1
    else:
        content = content.replace(b"document.xml", b"document.txt")
    with pytest.raises(containers.Unreadable):
        containers.docx_rows(bytes(content))


def zip_of(method):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("word/document.xml", "<w>" + "abc" * 3000 + "</w>")
    return out.getvalue()


def test_one_byte_text():
    assert containers.one_byte(bytes([0x41, 0x85, 0x96, 0x9F, 0x8D, 0x8E, 0x9E, 0xE9, 0x80])) == "A…–Ÿ\x8d\x8e\x9eé\x80"


def test_read_list_of_all_formats(spark, tmp_path):
    page = "<table><tr><th>Вид</th></tr><tr><td>k<p>x</p></td><td><a href='https://t.me/one'>one</a>&amp;</td><td>c</td></tr><tr></tr></table>"
    (tmp_path / "a.html").write_text(page, encoding="cp1251")
    (tmp_path / "b.html").write_bytes(docx([["k", "d", "c"]], ""))  # a text suffix wins
    (tmp_path / "c.bin").write_bytes(docx([["k", "LINK", "c"]], "https://vk.com/two"))
    (tmp_path / "d.doc").write_bytes(doc("k\x07d\x07c\x07\x07"))
    (tmp_path / "e.doc").write_bytes(b"\x01\x02junk")
    (tmp_path / "f.dat").write_bytes(b"  \n<table><tr><td>q</td></tr></table>")
    got = {}
    for r in documents.read_list(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.cells if r.error is None else "error")
    assert got["a.html"] == [["Вид"], ["k\nx\n", " https://t.me/one one&", "c"], []]
    assert got["c.bin"] == [["\nk", "\n https://vk.com/two LINK", "\nc"]]
    assert got["d.doc"] == [["k", "d", "c"]]
    assert got["e.doc"] == ["error"] and got["f.dat"] == [["q"]]


def test_snapshot_round_trip(spark, tmp_path):
    cells = [(0, ["Вид экстремистских материалов", "x", "Наименование суда"]), (1, ["k", "https://t.me/one @two_x", "c"]), (2, ["k", "Отменено https://t.me/three", "c"]), (3, []), (4, ["k", "c"]), (5, ["k", "baj.example.by https://instagram.com/baj.example.by", "CD-R диск", "c"])]
    entries = reference_list.entries_of(spark.createDataFrame(cells, "row_index int, cells array<string>"))
    identifiers = reference_list.identifiers_of(entries)
    meta = {r.key: r.value for r in reference_list.write_snapshot(entries, identifiers, str(tmp_path / "s"), "list.html", "00").collect()}
    assert meta["entry_count"] == "4" and meta["identifier_count"] == "3"
    live, index, table = reference_list.read_snapshot(spark, str(tmp_path / "s"))
    assert [(r.row_index, r.is_offline) for r in live.orderBy("id").collect()] == [(1, False), (4, False), (5, True)]
    assert [(r.platform, r.value) for r in index.orderBy("ident_id").collect()] == [("telegram", "one"), ("telegram", "two_x"), ("instagram", "baj.example.by")]
    assert reference_list.describe_snapshot(table).first().age == "today"
    assert "without identifiers: 1" in reference_list.text_summary(entries, identifiers)


def test_browser_files(spark, tmp_path):
    chromium, firefox = str(tmp_path / "History"), str(tmp_path / "places.sqlite")
    with sqlite3.connect(chromium) as c:
        c.execute("CREATE TABLE urls (id INTEGER, url TEXT, visit_count INTEGER, last_visit_time INTEGER)")
        c.executemany("INSERT INTO urls VALUES (?, ?, ?, ?)", [(1, "https://a.example.org/", 47, 13_300_000_000_000_000), (2, "https://a.example.org/x", 0, 0)])
    with sqlite3.connect(firefox) as c:
        c.execute("CREATE TABLE moz_places (id INTEGER, url TEXT, visit_count INTEGER, last_visit_date INTEGER)")
        c.execute("CREATE TABLE moz_bookmarks (id INTEGER, type INTEGER, fk INTEGER)")
        c.executemany("INSERT INTO moz_places VALUES (?, ?, ?, ?)", [(1, "https://b.example.org/", None, 1_700_000_000_000_000), (2, None, 1, 1)])
        c.executemany("INSERT INTO moz_bookmarks VALUES (?, ?, ?)", [(1, 1, 1), (2, 2, 1), (3, 1, 2)])
    (tmp_path / "Bookmarks").write_text(json.dumps({"roots": {"bar": {"type": "folder", "children": [{"type": "url", "url": "https://c.example.org"}, {"type": "folder", "children": [{"type": "url", "url": "https://d.example.org"}]}]}, "other": {"type": "url", "url": "https://e.example.org"}}}))
    (tmp_path / "broken").write_bytes(b"SQLite format 3\0" + b"junk" * 50)
    assert [(r.url, str(r.occurred_at), r.visit_count) for r in browser.read_history(spark, chromium, "chromium").orderBy("seq").collect()] == [("https://a.example.org/", "2022-06-18", 47), ("https://a.example.org/x", "None", 1)]
    assert [(r.url, str(r.occurred_at), r.visit_count) for r in browser.read_history(spark, firefox, "firefox").collect()] == [("https://b.example.org/", "2023-11-14", 1)]
    assert [r.url for r in browser.read_bookmarks(spark, firefox, "firefox").collect()] == ["https://b.example.org/"]
    assert [r.url for r in browser.read_bookmarks(spark, str(tmp_path / "Bookmarks"), "chromium").orderBy("seq").collect()] == [f"https://{x}.example.org" for x in "cde"]
    assert browser.read_history(spark, str(tmp_path / "broken"), "chromium").count() == 0
    assert browser.read_bookmarks(spark, str(tmp_path / "none"), "chromium").count() == 0


def test_private_copies_are_removed(tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    with browser.private_copy(str(tmp_path / "x")) as copy:
        assert copy.read_bytes() == b"1"
    assert not copy.parent.exists()
