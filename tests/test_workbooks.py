"""Binary workbooks made by hand, byte by byte, after the formats' records."""

import io
import struct
import zipfile

import pytest

from sparkloom.sources import loaders, workbooks


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def compound(stream):
    """A compound file of one stream, in sectors of 512 bytes: header, allocation table, directory, stream."""
    stream = stream.ljust(max(4096, -(-len(stream) // 512) * 512), b"\0")
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)

    def entry(name, kind, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", *[0xFFFFFFFF] * 3) + bytes(36) + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream)) + bytes(256)
    return head + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + directory + stream


def xls():
    bof, eof = record(0x809, bytes(16)), record(0x0A)
    sheet = bof
    sheet += record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 2, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 1.5))
    sheet += record(0x27E, struct.pack("<HHHI", 1, 1, 0, 7 << 2 | 2)) + record(0xBD, struct.pack("<HHHIHIH", 3, 0, 0, 250 << 2 | 3, 0, 0xFFFFFFFC | 2, 1))
    sheet += record(0x205, struct.pack("<HHHBB", 4, 0, 0, 1, 0)) + record(0x06, struct.pack("<HHH", 4, 1, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(6)) + record(0x207, struct.pack("<HB", 3, 0) + b"sum") + eof
    long = "é" * 10 + "x" * 20
    strings = struct.pack("<IIHB", 2, 2, 5, 0) + b"hello" + struct.pack("<HB", len(long), 1) + long[:12].encode("utf-16-le")
    rest = b"\0" + long[12:].encode("latin-1")
    name = "S1"
    bound = lambda at: record(0x85, struct.pack("<IBBBB", at, 0, 0, len(name), 0) + name.encode())
    top = lambda at: bof + bound(at) + record(0xFC, strings) + record(0x3C, rest) + eof
    return compound(top(len(top(0))) + sheet), long


def test_xls():
    data, long = xls()
    assert workbooks.xls_sheets(data) == [("S1", [["hello", "", long], ["1.5", "7"], ["2.5", "-1"], ["TRUE", "sum"]])]
    assert loaders.load("a.xls", data) == ("xls", [(f"Sheet: S1\nhello\t\t{long}\n1.5\t7\n2.5\t-1\nTRUE\tsum", None, {"sheet_name": "S1"})])
    with pytest.raises(ValueError):
        workbooks.xls_sheets(b"x" * 600)


def test_xlsb():
    def brt(kind, body=b""):
        head = bytes([kind]) if kind < 128 else bytes([kind & 127 | 128, kind >> 7])
        return head + bytes([len(body)]) + body

    wide = lambda t: struct.pack("<I", len(t)) + t.encode("utf-16-le")
    cell = lambda kind, col, body: brt(kind, struct.pack("<II", col, 0) + body)
    sheet = brt(0, struct.pack("<I", 2)) + cell(7, 0, struct.pack("<I", 0)) + cell(5, 2, struct.pack("<d", 2.25)) + brt(0, struct.pack("<I", 5)) + cell(2, 0, struct.pack("<I", 42 << 2 | 2)) + cell(4, 1, b"\0") + cell(6, 2, wide("é"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.bin", brt(131) + brt(156, struct.pack("<II", 0, 1) + wide("r1") + wide("T")))
        z.writestr("xl/_rels/workbook.bin.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.bin"/></Relationships>')
        z.writestr("xl/sharedStrings.bin", brt(159) + brt(19, b"\0" + wide("word")))
        z.writestr("xl/worksheets/sheet1.bin", sheet)
    assert loaders.load("a.xlsb", out.getvalue()) == ("xlsb", [("Sheet: T\nword\t\t2.25\n42\tFALSE\té", None, {"sheet_name": "T"})])
