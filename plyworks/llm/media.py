"""Media columns: byte payloads kept losslessly as baseline JPEG, read back as DC-only luminance thumbnails.

A sample is the DC coefficient of an 8 x 8 block of luminance, quantised by 8, which holds the block's mean exactly; a
row of 192 samples is one restart interval. The reader takes any baseline JPEG (Huffman-coded, 8 bits, interleaved or
not, with or without restarts): it parses the markers and decodes all restart intervals of a batch in lockstep, so
numpy works across documents. AC coefficients are stepped over. Payloads beyond a frame's height go to further frames.

Defined results: null counts as the empty text; the empty text becomes one row of spaces; a text of any length works;
equal texts get equal media, so ties and repeated rows need no order; an empty table stays empty; other columns are not
looked at; what isn't a baseline JPEG raises ValueError in `thumbnails` and gives null in `read_media`.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 192
MAX_ROWS = 8191
#: Bytes of payload that are worked on together.
SLICE = 1 << 19
# The DC code lengths (1 to 8 bits) and categories in order; one AC code, end of block.
DC_COUNTS, DC_SYMBOLS = (0, 3, 1, 1, 1, 1, 1, 1), (7, 5, 4, 3, 2, 1, 6, 0, 8)
AC_COUNTS, AC_SYMBOLS = (1,), (0,)


def _codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 on: the bits of its block (code, extra bits, end of block) and how many."""
    codes, bits, length = _codes(DC_COUNTS, DC_SYMBOLS), [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits.append((code << size | extra) << 1)
        length.append(n + size + 1)
    return np.array(bits, np.int64), np.array(length, np.int64)


_BITS, _LENGTH = _encoder()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    table = lambda kind, counts, symbols: bytes([kind, *counts, *[0] * (16 - len(counts)), *symbols])
    return (
        b"\xff\xd8" + _segment(0xDB, bytes([0, 8] + [1] * 63)) + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, table(0x00, DC_COUNTS, DC_SYMBOLS)) + _segment(0xC4, table(0x10, AC_COUNTS, AC_SYMBOLS))
        + _segment(0xDD, struct.pack(">H", WIDTH)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def pad(raw: bytes) -> bytes:
    """`raw` with spaces up to a positive multiple of WIDTH."""
    return raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of WIDTH bytes) as one JPEG, or several in a row."""
    frames = [(k, p[a : a + MAX_ROWS * WIDTH]) for k, p in enumerate(payloads) for a in range(0, len(p), MAX_ROWS * WIDTH)]
    rows = np.array([len(p) // WIDTH for _, p in frames])
    samples = np.frombuffer(b"".join(p for _, p in frames), np.uint8).reshape(-1, WIDTH).astype(np.int64) - 128
    diff = np.diff(samples, axis=1, prepend=0) + 255
    bits, length = _BITS[diff], _LENGTH[diff]
    row_bits = length.sum(axis=1)
    row_bytes = (row_bits + 7) // 8
    row_start = np.concatenate([[0], np.cumsum(row_bytes)])
    at = ((row_start[:-1] * 8)[:, None] + np.cumsum(length, axis=1) - length).ravel()
    placed = bits.ravel() << (24 - length.ravel() - (at & 7))
    total = int(row_start[-1])
    out = sum(np.bincount((at >> 3) + k, (placed >> (16 - 8 * k)) & 255, total + 3) for k in range(3))[:total].astype(np.uint8)
    out[row_start[1:] - 1] |= ((1 << (row_bytes * 8 - row_bits)) - 1).astype(np.uint8)  # the last byte is filled up with ones
    # A zero follows each 255; a restart marker follows each row but a frame's last.
    first = np.concatenate([[0], np.cumsum(rows)])[:-1]
    nth = np.arange(len(row_bits)) - np.repeat(first, rows)
    marked = nth < np.repeat(rows, rows) - 1
    width = 1 + (out == 255).astype(np.int64)
    width[(row_start[1:] - 1)[marked]] += 2
    end = np.cumsum(width)
    coded = np.zeros(int(end[-1]), np.uint8)
    coded[end - width] = out
    marks = end[(row_start[1:] - 1)[marked]]
    coded[marks - 2], coded[marks - 1] = 255, 0xD0 + nth[marked] % 8
    edge = np.concatenate([[0], end[row_start[np.cumsum(rows)] - 1]])
    whole, media = coded.tobytes(), [b""] * len(payloads)
    for f, (k, _) in enumerate(frames):
        media[k] += _head(int(rows[f])) + whole[edge[f] : edge[f + 1]] + b"\xff\xd9"
    return media


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """One JPEG from `at`: its frame, tables and scan, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG starts here")
    at += 2
    img: dict = {"dc": {}, "ac": {}, "quant": {}, "interval": 0}
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                img["quant"][body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("samples of 8 bits only")
            img |= {"height": h, "width": w, "parts": [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                img["ac" if body[0] >> 4 else "dc"][body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            img["interval"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            img["scan"] = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            break
    if "parts" not in img or len(img["scan"]) != len(img["parts"]):
        raise ValueError("one scan with all components is read")
    coded = np.frombuffer(data, np.uint8, offset=at)
    flags = np.flatnonzero(coded[:-1] == 255)
    after = coded[flags + 1]
    ends = flags[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    if not len(ends):
        raise ValueError("the scan does not end")
    img["coded"] = coded[: ends[0]]
    end = data.find(b"\xff\xd9", at + int(ends[0]))
    if end < 0:
        raise ValueError("the image does not end")
    return img, end + 2


def _lookup(counts, symbols) -> np.ndarray:
    """For each 16 bits: code length * 256 + symbol; 0 where no code starts."""
    table = np.zeros(1 << 16, np.int32)
    for s, (code, n) in _codes(counts, symbols).items():
        table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return table


def _dc(images: list[dict]) -> list[np.ndarray]:
    """Quantised DC values in coded order, images of like tables together; every restart interval is a lane."""
    parts = images[0]["parts"]
    tables = {p: (d, a) for p, d, a in images[0]["scan"]}
    mcu = [k for k, (_, h, v, _) in enumerate(parts) for _ in range(h * v if len(parts) > 1 else 1)]
    dc = [_lookup(*images[0]["dc"][tables[parts[k][0]][0]]) for k in mcu]
    ac = [_lookup(*images[0]["ac"][tables[parts[k][0]][1]]) for k in mcu]
    coded = np.concatenate([x for img in images for x in (img["coded"], np.array([255, 0xD0], np.uint8))])
    follows = np.concatenate([[False], coded[:-1] == 255])
    mark = follows & (coded >= 0xD0) & (coded <= 0xD7)  # also the one put after each image
    keep = ~(follows & (coded == 0)) & ~mark
    keep[np.flatnonzero(mark) - 1] = False
    kept = np.cumsum(keep)
    start = np.concatenate([[0], kept[mark][:-1]])
    stream = np.concatenate([coded[keep], np.full(8, 255, np.uint8)]).astype(np.uint32)
    window = stream[:-3] << 24 | stream[1:-2] << 16 | stream[2:-1] << 8 | stream[3:]
    blocks = []
    for img in images:
        _, _, mx, my = _grid(img)
        left = mx * my
        per = img["interval"] or left
        blocks += [min(per, left - a) * len(mcu) for a in range(0, left, per)]
    blocks = np.array(blocks)
    if len(blocks) != len(start):
        raise ValueError("restart markers are missing")
    order = np.argsort(-blocks, kind="stable")
    pos, sizes = start[order] * 8, blocks[order]
    out = np.zeros((int(sizes[0]), len(order)), np.int32)
    peek = lambda p: (window[np.minimum(p >> 3, len(window) - 1)] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
    for b in range(int(sizes[0])):
        n = int(active[b])
        p = pos[:n]
        code = dc[b % len(mcu)][peek(p)]
        if not code.all():
            raise ValueError("a code is unknown")
        p = p + (code >> 8)
        size = code & 255
        extra = (peek(p) >> (16 - size).astype(np.uint32)).astype(np.int32)
        out[b, :n] = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        p = p + size
        live, k = None, None  # lanes whose block goes on
        while live is None or len(live):
            q = p if live is None else p[live]
            code = ac[b % len(mcu)][peek(q)]
            if not code.all():
                raise ValueError("a code is unknown")
            run, size = (code & 255) >> 4, code & 15
            q = q + (code >> 8) + size
            step = np.where(code & 255, np.where((code & 255) == 0xF0, 16, run + 1), 64)
            if live is None:
                p, k, live = q, 1 + step, np.arange(n)
            else:
                p[live] = q
                k = k + step
            go = k < 64
            live, k = live[go], k[go]
        pos[:n] = p
    for c in set(mcu):  # each is coded as the difference from the last of its component
        own = [b for b in range(len(out)) if mcu[b % len(mcu)] == c]
        out[own] = np.cumsum(out[own], axis=0)
    flat, lane = [None] * len(order), out.T
    for k, o in enumerate(order):
        flat[o] = lane[k, : sizes[k]]
    result, at = [], 0
    for img in images:
        _, _, mx, my = _grid(img)
        n = -(-mx * my // (img["interval"] or mx * my))
        result.append(np.concatenate(flat[at : at + n]))
        at += n
    return result


def _grid(img: dict) -> tuple[int, int, int, int]:
    """Largest sampling factors, and MCUs across and down."""
    one = len(img["parts"]) == 1
    h, v = (1, 1) if one else (max(p[1] for p in img["parts"]), max(p[2] for p in img["parts"]))
    return h, v, -(-img["width"] // (8 * h)), -(-img["height"] // (8 * v))


def thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """The frames of each item as 2-D arrays of block luminance (uint8)."""
    parsed: list[tuple[int, dict]] = []
    for k, data in enumerate(media):
        at = 0
        while at < len(data):
            img, at = _parse(data, at)
            parsed.append((k, img))
        if not data:
            raise ValueError("no JPEG starts here")
    like: dict = {}
    for n, (_, img) in enumerate(parsed):
        like.setdefault(repr((img["parts"], img["scan"], img["dc"], img["ac"])), []).append(n)
    out: list[list] = [[] for _ in media]
    planes: dict[int, np.ndarray] = {}
    for group in like.values():
        for n, dc in zip(group, _dc([parsed[n][1] for n in group])):
            img = parsed[n][1]
            _, _, mx, my = _grid(img)
            ph, pv = (1, 1) if len(img["parts"]) == 1 else img["parts"][0][1:3]
            luma = dc.reshape(my, mx, -1)[:, :, : ph * pv].reshape(my, mx, pv, ph).transpose(0, 2, 1, 3).reshape(my * pv, mx * ph)
            level = np.clip(np.rint(luma * img["quant"][img["parts"][0][3]] / 8) + 128, 0, 255).astype(np.uint8)
            planes[n] = level[: -(-img["height"] // 8), : -(-img["width"] // 8)]
    for n, (k, _) in enumerate(parsed):
        out[k].append(planes[n])
    return out


def thumbnail_hash(plane: np.ndarray) -> int:
    """64 bits: which of 8 x 8 cells are lighter than the mean of the cells."""

    def pooled(x):
        n = len(x)
        low = np.arange(8) * n // 8
        high = np.maximum(low + 1, np.arange(1, 9) * n // 8)
        sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
        return (sums[high] - sums[low]) / (high - low)[:, None]

    cells = pooled(pooled(plane).T).T
    return int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), "big")


def _slices(sizes):
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > SLICE:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


@F.pandas_udf(T.BinaryType())
def store_media(texts: pd.Series) -> pd.Series:
    """Each text's padded UTF-8 as JPEG."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return pd.Series([m for a, b in _slices([len(r) for r in raw]) for m in encode([pad(r) for r in raw[a:b]])], dtype=object)


@F.pandas_udf(T.StructType().add("payload", T.BinaryType()).add("feature", T.StringType()))
def read_media(media: pd.Series) -> pd.DataFrame:
    """Stored bytes: the payload they hold, and per frame the dimensions and the thumbnail's hash."""
    payload, feature = [], []
    items = list(media)
    for a, b in _slices([len(m or b"") for m in items]):
        try:
            found = thumbnails(items[a:b])
        except (ValueError, TypeError, KeyError, IndexError, struct.error):
            found = []
            for m in items[a:b]:
                try:
                    found += thumbnails([m])
                except (ValueError, TypeError, KeyError, IndexError, struct.error):
                    found.append(None)
        for frames in found:
            payload.append(None if frames is None else b"".join(f.tobytes() for f in frames))
            feature.append(None if frames is None else "+".join(f"{f.shape[1] * 8}x{f.shape[0] * 8}:{thumbnail_hash(f):016x}" for f in frames))
    return pd.DataFrame({"payload": pd.Series(payload, dtype=object), "feature": pd.Series(feature, dtype=object)})
