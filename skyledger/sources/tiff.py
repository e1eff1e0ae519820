"""The TIFF format: directories by byte ranges, chunks from bytes to samples and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

# Tags, and bytes per value of each field type.
TAGS = {
    "subfile": 254, "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279, "planar": 284, "software": 305, "predictor": 317,
    "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325, "extra": 338, "sample_format": 339, "scale": 33550, "tiepoint": 33922, "transformation": 34264, "geokeys": 34735, "nodata": 42113,
}
NAMES = {v: k for k, v in TAGS.items()}
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Directories that a chain may have; a longer one is taken for damaged.
MOST = 1000


def directories(read: Callable[[int, int], bytes]) -> list[dict]:
    """Known tags of each directory in the chain, from a function that reads (offset, size). Values out of bounds are absent; ValueError without a TIFF or BigTIFF signature."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43) or magic == 43 and len(head) < 16:
        raise ValueError("signature")
    big = magic == 43
    count, entry, word, inline = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    at, out, seen = struct.unpack_from(order + word, head, 8 if big else 4)[0], [], set()
    while at and at not in seen and len(out) < MOST:
        seen.add(at)
        size = struct.calcsize(order + count)
        raw = read(at, size)
        if len(raw) < size:
            break
        n = struct.unpack(order + count, raw)[0]
        raw = read(at + size, n * entry + inline)
        tags: dict = {"order": order}
        for k in range(min(n, len(raw) // entry)):
            tag, kind, many = struct.unpack_from(order + "HH" + word, raw, k * entry)
            if tag in NAMES and kind in KINDS:
                each = KINDS[kind]
                form = f"{order}{many}s" if each == "s" else f"{order}{many * len(each)}{each[0]}"
                need = struct.calcsize(form)
                where = k * entry + 4 + inline
                data = raw[where : where + need] if need <= inline else read(struct.unpack_from(order + word, raw, where)[0], need)
                if len(data) == need:
                    tags[NAMES[tag]] = struct.unpack(form, data)
        out.append(tags)
        end = n * entry
        at = struct.unpack_from(order + word, raw, end)[0] if len(raw) >= end + inline else 0
    return out


def unpacked(data: bytes, size: int) -> bytes:
    """PackBits."""
    out, k = bytearray(), 0
    while k < len(data) and len(out) < size:
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        else:
            if n > 128:
                out += data[k + 1 : k + 2] * (257 - n)
            k += 2 if n > 128 else 1
    return bytes(out)


def lzw_decoded(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    first = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, last, width = list(first), bytearray(), None, 9
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            table, last, width = list(first), None, 9
            continue
        if code == 257 or len(out) >= size:
            break
        if code < len(table):
            said = table[code]
        elif last is not None and code == len(table):
            said = last + last[:1]
        else:
            raise ValueError("LZW code out of order")
        out += said
        if last is not None and len(table) < 4096:
            table.append(last + said[:1])
        last = said
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def lzw_encoded(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    codes, width, now = [], 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    for k in range(len(data)):
        more = now + data[k : k + 1]
        if len(more) == 1 or more in table:
            now = more
            continue
        put(table[now] if len(now) > 1 else now[0])
        table[more] = 258 + len(table)
        width = max(9, (258 + len(table)).bit_length())
        if len(table) == 4094 - 258:
            put(256)
            table, width = {}, 9
        now = data[k : k + 1]
    if now:
        put(table[now] if len(now) > 1 else now[0])
        # The decoder's table grows by that code too.
        width = max(9, min(12, (259 + len(table)).bit_length()))
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def samples(data: bytes, c: dict) -> np.ndarray:
    """(rows, columns, samples) of a stored chunk with keys compression, rows, columns, samples, bits, predictor and order. ValueError if it is damaged or of a kind that isn't read."""
    size = c["rows"] * c["columns"] * c["samples"] * c["bits"] // 8
    kind = c["compression"]
    try:
        if kind in (DEFLATE, OLD_DEFLATE):
            data = zlib.decompress(data)
        elif kind == LZW:
            data = lzw_decoded(data, size)
        elif kind == PACKBITS:
            data = unpacked(data, size)
        elif kind != NONE:
            raise ValueError(f"compression {kind}")
    except zlib.error as e:
        raise ValueError("damaged chunk") from e
    if len(data) < size:
        raise ValueError("short chunk")
    out = np.frombuffer(data[:size], f"{c['order']}u{c['bits'] // 8}").reshape(c["rows"], c["columns"], c["samples"])
    if c["predictor"] == 2:
        out = np.cumsum(out, axis=1, dtype=f"u{c['bits'] // 8}")
    return out.astype(f"u{c['bits'] // 8}", copy=False)


def stored(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """The reverse of ``samples``, little-endian."""
    if predictor == 2:
        block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1).astype(block.dtype)
    data = block.astype(block.dtype.newbyteorder("<"), copy=False).tobytes()
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data)
    if compression == LZW:
        return lzw_encoded(data)
    if compression == PACKBITS:
        return b"".join(bytes((len(x) - 1,)) + x for x in (data[k : k + 128] for k in range(0, len(data), 128)))
    return data


def written(image: np.ndarray, compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int | None = None, tile: tuple[int, int] | None = None, extra: dict | None = None, photometric: int | None = None) -> bytes:
    """A file with one directory: (rows, columns, samples) of 8 or 16 bits in strips, or in tiles of (width, height), multiples of 16. ``extra`` has values of more tags by name."""
    h, w, n = image.shape
    if tile:
        tw, th = tile
        padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw, n), image.dtype)
        padded[:h, :w] = image
        blocks = [padded[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
    else:
        rows = rows_per_strip or h
        blocks = [image[y : y + rows] for y in range(0, h, rows)]
    chunks = [stored(b, compression, predictor) for b in blocks]
    offsets, at = [], 8
    for c in chunks:
        offsets.append(at)
        at += len(c) + len(c) % 2
    tags = {"width": w, "height": h, "bits": [8 * image.dtype.itemsize] * n, "compression": compression, "photometric": photometric if photometric is not None else 2 if n >= 3 else 1, "samples": n, "planar": 1, "predictor": predictor}
    tags |= {"tile_width": tile[0], "tile_height": tile[1], "tile_offsets": offsets, "tile_counts": [len(c) for c in chunks]} if tile else {"strip_offsets": offsets, "rows_per_strip": rows_per_strip or h, "strip_counts": [len(c) for c in chunks]}
    if n in (2, 4):
        tags["extra"] = 2
    entries, tail = [], bytearray()
    tags = sorted((tags | (extra or {})).items(), key=lambda x: TAGS[x[0]])
    rest = at + 2 + 12 * len(tags) + 4
    for name, value in tags:
        if isinstance(value, str):
            kind, many, data = 2, len(value.encode()) + 1, value.encode() + b"\0"
        else:
            values = list(value) if isinstance(value, (list, tuple)) else [value]
            kind = 12 if any(isinstance(v, float) for v in values) else 3 if name in ("bits", "geokeys", "compression", "photometric", "samples", "planar", "predictor", "extra") else 4
            many, data = len(values), struct.pack(f"<{len(values)}{KINDS[kind]}", *values)
        if len(data) > 4:
            where = rest + len(tail)
            tail += data + b"\0" * (len(data) % 2)
            data = struct.pack("<I", where)
        entries.append(struct.pack("<HHI", TAGS[name], kind, many) + data.ljust(4, b"\0"))
    body = b"".join(c + b"\0" * (len(c) % 2) for c in chunks)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4 + bytes(tail)


def png(image: np.ndarray) -> bytes:
    """A PNG of (rows, columns, 1, 3 or 4 samples) of 8 bits."""
    h, w, n = image.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate((np.zeros((h, 1), np.uint8), image.reshape(h, w * n)), axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
