"""Binary workbooks: `.xls` (BIFF8 in a compound file) and `.xlsb` (records in a zip), after their published formats. Values only."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

Sheet = tuple[str, list[list[str]]]
END = 0xFFFFFFFE


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.15g}"


def rk(raw: int) -> str:
    """A number in 30 bits: an integer or the upper part of a double, perhaps in hundredths."""
    x = float((raw >> 2) - (1 << 30 if raw >> 31 else 0)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & ~3) << 32))[0]
    return number(x / 100 if raw & 1 else x)


def grid(cells: dict[tuple[int, int], str]) -> list[list[str]]:
    """Rows that have cells, each as wide as its last one; what is missing is empty."""
    rows: dict[int, dict[int, str]] = {}
    for (r, c), v in cells.items():
        rows.setdefault(r, {})[c] = v
    return [[own.get(c, "") for c in range(max(own) + 1)] for _, own in sorted(rows.items())]


# --- xls ---------------------------------------------------------------------------------------------------------------------


def compound_stream(data: bytes, *names: str) -> bytes:
    """A stream of a compound file, by the first of the names that it has."""
    if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("no compound file")
    size, mini_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, cutoff, mini_fat = struct.unpack_from("<I", data, 48)[0], *struct.unpack_from("<II", data, 56)
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    listed, more = list(struct.unpack_from("<109I", data, 76)), struct.unpack_from("<I", data, 68)[0]
    while more < END - 3:
        *part, more = struct.unpack(f"<{size // 4}I", sector(more))
        listed += part
    fat = [x for n in listed if n < END - 3 for x in struct.unpack(f"<{size // 4}I", sector(n))]

    def chain(start: int, table: list[int]) -> Iterator[int]:
        seen = 0
        while start < len(table) and seen <= len(table):
            yield start
            start, seen = table[start], seen + 1

    entries = b"".join(map(sector, chain(directory, fat)))
    found = {}
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        if kind:
            found[entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")] = (kind, *struct.unpack_from("<II", entries, at + 116))
    name = next((n for n in names if n in found), None)
    if name is None:
        raise ValueError(f"no stream named {' or '.join(names)}")
    _, start, length = found[name]
    if length >= cutoff:
        return b"".join(map(sector, chain(start, fat)))[:length]
    small = [x for n in chain(mini_fat, fat) for x in struct.unpack(f"<{size // 4}I", sector(n))]
    _, root, root_length = next(v for v in found.values() if v[0] == 5)
    pool = b"".join(map(sector, chain(root, fat)))[:root_length]
    return b"".join(pool[n * mini_size : (n + 1) * mini_size] for n in chain(start, small))[:length]


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(kind, its bytes in the parts that continuation records make) from a place on to the end of that substream."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == 0x3C and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
        if kind == 0x0A:
            break
    if held:
        yield held


def _text(data: bytes, at: int, n: int, wide: int) -> str:
    return data[at : at + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")


def shared_strings(parts: list[bytes]) -> list[str]:
    """Strings that may go on in the next part, where their characters start with a flag of their own."""
    total, out = struct.unpack_from("<I", parts[0], 4)[0], []
    part, at = 0, 8

    def moved() -> None:
        nonlocal part, at
        while part < len(parts) and at >= len(parts[part]):
            at -= len(parts[part])
            part += 1

    for _ in range(total):
        moved()
        if part >= len(parts):
            break
        n, flags = struct.unpack_from("<HB", parts[part], at)
        at += 3
        runs = struct.unpack_from("<H", parts[part], at)[0] if flags & 8 else 0
        at += 2 if flags & 8 else 0
        extra = struct.unpack_from("<I", parts[part], at)[0] if flags & 4 else 0
        at += 4 if flags & 4 else 0
        text, wide = "", flags & 1
        while n:
            if at >= len(parts[part]):
                part += 1
                if part >= len(parts):
                    break
                wide, at = parts[part][0] & 1, 1
            take = min(n, (len(parts[part]) - at) // (2 if wide else 1))
            text += _text(parts[part], at, take, wide)
            at += take * (2 if wide else 1)
            n -= take
        out.append(text)
        at += 4 * runs + extra
    return out


def xls_sheets(data: bytes) -> list[Sheet]:
    stream = compound_stream(data, "Workbook", "Book")
    strings: list[str] = []
    places: list[tuple[str, int]] = []
    for kind, parts in _records(stream):
        b = parts[0]
        if kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        if kind == 0x85 and b[5] == 0:
            places.append((_text(b, 8, b[6], b[7] & 1), struct.unpack_from("<I", b)[0]))
        elif kind == 0xFC:
            strings = shared_strings(parts)
    out = []
    for name, at in places:
        cells: dict[tuple[int, int], str] = {}
        waiting = None
        for kind, parts in _records(stream, at):
            b = parts[0]
            spot = struct.unpack_from("<HH", b) if len(b) >= 4 else (0, 0)
            if kind == 0xFD:
                cells[spot] = strings[struct.unpack_from("<I", b, 6)[0]]
            elif kind == 0x203:
                cells[spot] = number(struct.unpack_from("<d", b, 6)[0])
            elif kind == 0x27E:
                cells[spot] = rk(struct.unpack_from("<I", b, 6)[0])
            elif kind == 0xBD:
                for k in range((len(b) - 6) // 6):
                    cells[spot[0], spot[1] + k] = rk(struct.unpack_from("<I", b, 6 + 6 * k)[0])
            elif kind == 0x204:
                cells[spot] = _text(b, 9, struct.unpack_from("<H", b, 6)[0], b[8] & 1)
            elif kind == 0x205 and not b[7]:
                cells[spot] = "TRUE" if b[6] else "FALSE"
            elif kind == 0x06:
                if b[12:14] != b"\xff\xff":
                    cells[spot] = number(struct.unpack_from("<d", b, 6)[0])
                elif b[6] == 1:
                    cells[spot] = "TRUE" if b[8] else "FALSE"
                elif b[6] == 0:
                    waiting = spot
            elif kind == 0x207 and waiting is not None:
                cells[waiting], waiting = _text(b, 3, struct.unpack_from("<H", b)[0], b[2] & 1), None
        out.append((name, grid(cells)))
    return out


# --- xlsb --------------------------------------------------------------------------------------------------------------------


def _binary_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    def varint(at: int, most: int) -> tuple[int, int]:
        n = 0
        for k in range(most):
            n |= (data[at + k] & 127) << 7 * k
            if data[at + k] < 128:
                return n, at + k + 1
        return n, at + most

    at = 0
    while at < len(data):
        kind = data[at] | (data[at + 1] << 8 if data[at] & 128 else 0)
        n, at = varint(at + (2 if data[at] & 128 else 1), 4)
        yield kind & 127 | kind >> 8 << 7 if kind > 255 else kind, data[at : at + n]
        at += n


def _wide(b: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", b, at)[0]
    return (b[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n) if n < 0xFFFFFFFF else ("", at + 4)


def xlsb_sheets(data: bytes) -> list[Sheet]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        members = set(z.namelist())
        strings = [_wide(b, 1)[0] for kind, b in _binary_records(z.read("xl/sharedStrings.bin")) if kind == 19] if "xl/sharedStrings.bin" in members else []
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.bin.rels"))}
        out = []
        for kind, b in _binary_records(z.read("xl/workbook.bin")):
            if kind != 156:
                continue
            relation, at = _wide(b, 8)
            name, target = _wide(b, at)[0], targets[relation]
            cells: dict[tuple[int, int], str] = {}
            row = 0
            for k, c in _binary_records(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")):
                if k == 0:
                    row = struct.unpack_from("<I", c)[0]
                elif 2 <= k <= 10 and len(c) >= 8 and k != 3:
                    at = row, struct.unpack_from("<I", c)[0]
                    if k == 2:
                        cells[at] = rk(struct.unpack_from("<I", c, 8)[0])
                    elif k in (4, 10):
                        cells[at] = "TRUE" if c[8] else "FALSE"
                    elif k in (5, 9):
                        cells[at] = number(struct.unpack_from("<d", c, 8)[0])
                    elif k in (6, 8):
                        cells[at] = _wide(c, 8)[0]
                    else:
                        cells[at] = strings[struct.unpack_from("<I", c, 8)[0]]
            out.append((name, grid(cells)))
    return out
