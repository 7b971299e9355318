"""TIFF media columns: bytes to TIFF files and TIFF files to one row per page.

The reader walks the chain of image directories in either byte order, decodes uncompressed, PackBits, LZW and deflate
strips and tiles, undoes the horizontal (2) and floating-point (3) predictors and returns the samples of each page,
whether of 1, 2, 4, 8, 16, 32 or 64 bits, side by side or in planes. The writer makes baseline grey files of 8-bit samples, one page or more, in any of these forms.

Edge cases: a null text is an empty one; an empty payload is 64 zero bytes; a file that is cut short or has a
compression not named above, a size of zero or a header that promises more than the file can hold gives one row with
``error`` set and no samples, as does null content; extra columns are ignored; equal texts make equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.llm.common import fresh, map_texts, named

#: Fixed values of the format: tag numbers, compression schemes and the bytes in one value of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

ROW = 64


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i
        while j + 1 < n and j - i < 127 and data[j + 1] == data[i]:
            j += 1
        if j > i:
            out += bytes((257 - (j - i + 1), data[i]))
            i = j + 1
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
                i += 1
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, code 256 clears and 257 ends; the width grows one code early."""
    bits, used, out = 0, 0, bytearray()

    def put(code, width):
        nonlocal bits, used
        bits, used = bits << width | code, used + width
        while used >= 8:
            used -= 8
            out.append(bits >> used & 255)
        bits &= (1 << used) - 1

    table, width, word = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, width)
    for b in data:
        longer = word + bytes((b,))
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2
        if len(table) + 2 == 4094:
            put(256, width)
            table, width = {bytes((i,)): i for i in range(256)}, 9
        elif len(table) + 2 > (1 << width) - 1:
            width += 1
        word = bytes((b,))
    if word:
        put(table[word], width)
        if len(table) + 3 > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if used:
        out.append(bits << (8 - used) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last, out = list(first), 9, b"", bytearray()
    bits, have = 0, 0
    for b in data:
        bits, have = bits << 8 | b, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out += word
        last = word
    return bytes(out)


def _decoded(data: bytes, scheme: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if scheme == LZW:
        return lzw_decode(data)
    if scheme == PACKBITS:
        return packbits_decode(data)
    raise ValueError(f"compression {scheme} is not read")


def _encoded(data: bytes, scheme: int, level: int) -> bytes:
    return {NONE: lambda: data, DEFLATE: lambda: zlib.compress(data, level), LZW: lambda: lzw_encode(data), PACKBITS: lambda: packbits_encode(data)}[scheme]()


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: int = 0, level: int = 1) -> bytes:
    """A little-endian file of grey 8-bit pages; ``tile`` (a multiple of 16) stores square tiles instead of strips."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        page = np.ascontiguousarray(page, np.uint8)
        height, width = page.shape
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = page
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            parts = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        at, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
            data = _encoded(np.ascontiguousarray(part).tobytes(), compression, level)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_AT, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, at), (STRIP_ROWS, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                spot = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", spot)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes):
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags, entries = {}, struct.unpack_from(order + "H", data, at)[0]
        for i in range(entries):
            tag, kind, n = struct.unpack_from(order + "HHI", data, spot := at + 2 + 12 * i)
            size = FIELD_BYTES.get(kind, 1) * n
            where = spot + 8 if size <= 4 else struct.unpack_from(order + "I", data, spot + 8)[0]
            if kind in (1, 3, 4):
                tags[tag] = list(struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, where))
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * entries)[0]


def _page(data: bytes, order: str, tags: dict) -> np.ndarray:
    def one(tag, default=None):
        return tags[tag][0] if tags.get(tag) else default

    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    kind, predictor, apart = one(SAMPLE_FORMAT, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
    if bits not in (1, 2, 4, 8, 16, 32, 64) or any(b != bits for b in tags.get(BITS, [])) or bits < 8 and predictor != 1:
        raise ValueError(f"samples of {tags.get(BITS)} bits with predictor {predictor} are not read")
    number = np.dtype(f"{order}{'f' if kind == 3 and bits >= 16 else 'i' if kind == 2 and bits >= 8 else 'u'}{max(bits // 8, 1)}")
    tiled = TILE_AT in tags
    wide, high = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    if min(width, height, samples, wide, high) < 1:
        raise ValueError("a size is zero")
    # No compression read here makes more than 4,096 bytes of one, so a larger page is a broken header.
    if width * height * samples * bits > 8 * 4096 * len(data) or wide * high * samples * bits > 8 * 4096 * max(len(data), 1 << 16):
        raise ValueError("the page is larger than its file can hold")
    out = np.zeros((height, width, samples), number)
    across, down, each = -(-width // wide), -(-height // high), 1 if apart else samples
    places, sizes = tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES]
    if len(places) < across * down * (samples if apart else 1):
        raise ValueError("parts of the page are missing")
    for k, (at, n) in enumerate(zip(places, sizes, strict=True)):
        plane, spot = divmod(k, across * down) if apart else (0, k)
        y, x = spot // across * high, spot % across * wide
        if at + n > len(data) or y >= height or plane >= samples:
            raise ValueError("the file is cut short or has parts beyond the page")
        rows = high if tiled else min(high, height - y)
        raw = _decoded(data[at : at + n], one(COMPRESSION, 1))
        if bits < 8:
            line = -(-wide * each * bits // 8)
            fields = np.unpackbits(np.frombuffer(raw, np.uint8)[: rows * line].reshape(rows, line), axis=1)[:, : wide * each * bits]
            part = np.zeros((rows, wide, each), number)
            for b in range(bits):
                part = part * 2 + fields[:, b::bits].reshape(rows, wide, each)
        elif predictor == 3:
            spread = np.frombuffer(raw, np.uint8)[: rows * wide * each * number.itemsize].reshape(rows, -1).copy()
            for s in range(each):
                np.cumsum(spread[:, s::each], 1, dtype=np.uint8, out=spread[:, s::each])
            part = np.ascontiguousarray(spread.reshape(rows, number.itemsize, wide * each).transpose(0, 2, 1)).view(number.newbyteorder(">"))
            part = part.reshape(rows, wide, each)
        else:
            part = np.frombuffer(raw[: rows * wide * each * number.itemsize], number).reshape(rows, wide, each)
            if predictor == 2:
                part = np.cumsum(part, 1, dtype=number.newbyteorder("="))
        out[y : y + rows, x : x + wide, plane : plane + each] = part[: height - y, : width - x]
    return out


def decode(data: bytes | None) -> list[np.ndarray]:
    """The pages' samples, each height x width x samples."""
    if data is None:
        raise ValueError("no content")
    return [_page(data, order, tags) for order, tags in _directories(data)]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, mean step between neighbours and a 16-bin histogram of the samples, rounded."""
    flat = samples.ravel()
    bins = np.bincount(flat >> 4, minlength=16) / len(flat)
    step = np.abs(np.diff(flat.astype(np.int16))).mean() if len(flat) > 1 else 0.0
    return ",".join(f"{v:.4f}" for v in (flat.mean(), flat.std(), step, *bins))


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes filled up with zeros to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0"), len(raw)


def store_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a one-page TIFF, 64 samples wide."""

    def run(texts):
        made = [payload(t) for t in texts]
        return None, [[n for _, n in made], [encode([np.frombuffer(p, np.uint8).reshape(-1, ROW)], compression, predictor) for p, _ in made]]

    base = docs.select(named(id_col).cast("long").alias("doc_id"), named(text).alias("text"))
    return map_texts(base, "text", ["doc_id"], "n_bytes long, media binary", lambda: run)


def read_pages(media: DataFrame, content: str = "media", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: id, the carried columns, page, width, height, samples (bytes, row by row), feature, media_bytes, media_sha256, error."""
    new = ["page", "width", "height", "samples", "feature", "media_bytes", "media_sha256", "error"]
    kept = [c for c in carry if c not in (*new, "doc_id")]

    def run(_, contents):
        at, rows = [], []
        for i, data in enumerate(contents.to_pylist()):
            size, digest = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
            try:
                pages = decode(data)
            except (ValueError, KeyError, TypeError, ArithmeticError, struct.error, zlib.error, IndexError, MemoryError) as e:
                at.append(i)
                rows.append((0, None, None, None, None, size, digest, f"{type(e).__name__}: {e}"))
                continue
            at += [i] * len(pages)
            rows += [(k, p.shape[1], p.shape[0], p.tobytes(), feature(np.ascontiguousarray(p).view(np.uint8)), size, digest, None) for k, p in enumerate(pages)]
        return at, list(zip(*rows, strict=True)) if rows else [[]] * len(new)

    none, data = fresh(media.columns, "none", "data")
    base = media.select(named(id_col).cast("long").alias("doc_id"), *(named(c) for c in kept), F.lit(None).cast("string").alias(none), named(content).alias(data))
    return map_texts(base, none, ["doc_id", *kept], "page int, width int, height int, samples binary, feature string, media_bytes long, media_sha256 string, error string", lambda: run, (named(data),))
