"""Media columns: baseline JPEG stored in a binary column, decoded to DC-only luminance thumbnails.

`encode_bytes` stores a byte payload losslessly as grey baseline JPEGs: one 8x8 block of flat colour per byte, so the
DC coefficient (quantiser 8) is the byte and the DC-only thumbnail is the payload again. The DC Huffman table gives size
s a code of 9-s bits, so that blocks keep their places within bytes and repeated text stays repeated for the column's zstd
compression; the AC table holds end-of-block alone. Frames are 576 blocks wide and at most 8191 high (JPEG's limit of 65535
pixels), with a restart marker after each row of blocks; longer payloads continue in further frames of the same value.

`thumbnails_of` reads any baseline (SOF0) Huffman JPEGs: markers, quantisation and Huffman tables, restart intervals,
subsampled components, interleaved scans. It walks the Huffman codes of all restart intervals of all images that share their tables in
lockstep: each is a lane with a bit position of its own, and a numpy step decodes one block of every lane (a 16-bit window gives the
DC difference and, where it fits, the end of the block; lanes with AC coefficients step through these by code). It reconstructs
the luminance DC plane and keeps one sample a block.

Defined results: a null text is an empty one, whose payload is the 576 bytes of padding; equal texts give equal media and
features; very long texts give several frames; null and repeated ids are rows like others; an empty table gives an empty
result; other columns are ignored. Bytes that are no whole baseline JPEG raise ValueError, and null media gives null columns in
`thumbnails`.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, trimmed

UNIT, WIDE, HIGH = 576, 576, 8191
#: Zigzag is not needed for DC; these are JPEG's markers (fixed values).
SOI, EOI, SOS, DQT, DHT, DRI, SOF0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0


# ---- encoding -----------------------------------------------------------------------------------


@lru_cache(1)
def _codes() -> np.ndarray:
    """The 10 bits of a block for each DC difference -255..255: prefix code, magnitude, end-of-block 0."""
    out = np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code = (1 << (9 - size)) - 2  # canonical: size 8 is '0', 7 is '10', ..., 0 is '111111110'
        bits = diff if diff >= 0 else diff + (1 << size) - 1
        out[diff + 255] = ((code << size) | bits) << 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(1)
def _tables() -> bytes:
    quant = _segment(DQT, b"\0" + bytes([8]) + b"\1" * 63)
    dc = bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = bytes([0x10]) + bytes([1] + [0] * 15) + b"\0"
    return quant + _segment(DHT, dc) + _segment(DHT, ac)


def _frame(samples: np.ndarray) -> bytes:
    """One grey baseline JPEG of WIDE x rows flat blocks, a restart interval for each row."""
    rows = len(samples) // WIDE
    diffs = np.diff(samples.reshape(rows, WIDE).astype(np.int16), prepend=np.int16(128))
    v = _codes()[diffs + 255].reshape(-1, 4)
    word = (v[:, 0] << np.uint64(30)) | (v[:, 1] << np.uint64(20)) | (v[:, 2] << np.uint64(10)) | v[:, 3]
    bits = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    step = WIDE * 10 // 8
    scan = b"".join(x for i in range(rows) for x in (bits[i * step : (i + 1) * step].replace(b"\xff", b"\xff\0"), bytes((0xFF, 0xD0 + i % 8))))[:-2]
    head = _segment(DRI, struct.pack(">H", WIDE)) + _segment(SOF0, struct.pack(">BHHBBBB", 8, rows * 8, WIDE * 8, 1, 1, 0x11, 0))
    start = _segment(SOS, bytes([1, 1, 0, 0, 63, 0]))
    return b"\xff\xd8" + _tables() + head + start + scan + b"\xff\xd9"


def encode_bytes(payload: bytes) -> bytes:
    """JPEG frames that hold `payload`, padded with 255 to a positive multiple of 576 bytes."""
    padded = payload + b"\xff" * (-len(payload) % UNIT if payload else UNIT)
    samples = np.frombuffer(padded, np.uint8)
    return b"".join(_frame(samples[i : i + WIDE * HIGH]) for i in range(0, len(samples), WIDE * HIGH))


# ---- decoding -----------------------------------------------------------------------------------


class Huffman:
    """A Huffman table as arrays over all 16-bit windows: code length (0: no code) and symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
        code = at = 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                lo = code << (16 - n)
                self.length[lo : lo + (1 << (16 - n))], self.symbol[lo : lo + (1 << (16 - n))] = n, symbols[at]
                code, at = code + 1, at + 1
            code <<= 1


Table = tuple[bytes, bytes]


@lru_cache(64)
def _huffman(table: Table) -> Huffman:
    return Huffman(*table)


@lru_cache(64)
def _blocks(dc: Table, ac: Table) -> tuple[np.ndarray, np.ndarray]:
    """By 16-bit window: the bits of a whole block without AC coefficients (0: it has some, or does not fit), and its DC difference."""
    d, a = _huffman(dc), _huffman(ac)
    n, size, window = d.length.astype(np.int64), d.symbol.astype(np.int64), np.arange(65536)
    fits = (n > 0) & (size < 16) & (n + size < 16)
    used = np.where(fits, n + size, 0)
    behind = (window << used) & 0xFFFF
    length = a.length[behind].astype(np.int64)
    fits &= (length > 0) & (a.symbol[behind] == 0) & (used + length <= 16)
    bits = (window >> (16 - used)) & ((1 << np.where(fits, size, 0)) - 1)
    return np.where(fits, used + length, 0), np.where(fits, _signed(bits, size), 0)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The value of `size` magnitude bits."""
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << np.minimum(size, 32)) + 1, bits)


def _window(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 16 bits from each bit position."""
    return (words.take(at >> 3, mode="clip") >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)


def _coded_blocks(words: np.ndarray, at: np.ndarray, dc: Table, ac: Table) -> tuple[np.ndarray, np.ndarray]:
    """The bits of the blocks at these positions, code by code, and their DC differences."""
    d, a = _huffman(dc), _huffman(ac)
    w = _window(words, at)
    n, size = d.length[w].astype(np.int64), d.symbol[w].astype(np.int64)
    if not n.all() or (size > 11).any():
        raise ValueError("bad DC code")
    diff = _signed(_window(words, at + n).astype(np.int64) >> (16 - size), size)
    end, k, live = at + n + size, np.ones(len(at), np.int64), np.arange(len(at))
    while len(live):
        w = _window(words, end[live])
        n, symbol = a.length[w].astype(np.int64), a.symbol[w].astype(np.int64)
        if not n.all():
            raise ValueError("bad AC code")
        run, size = symbol >> 4, symbol & 15
        end[live] += n + size
        k[live] = np.where((size == 0) & (run < 15), 64, k[live] + run + 1)
        live = live[k[live] < 64]
    return end - at, diff


def _walk(pieces: list[bytes], counts: list[int], units: tuple) -> list[np.ndarray]:
    """DC values of the kept component's blocks in each piece of entropy-coded data; units: (DC table, AC table, component, kept) of an MCU."""
    order = sorted(range(len(pieces)), key=lambda i: -counts[i])
    raw = np.frombuffer(b"".join(pieces[i] + b"\xff\xff\xff\xff" for i in order) + b"\xff\xff\xff\xff", np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    sizes = np.array([len(pieces[i]) for i in order], np.int64)
    at = 8 * (np.cumsum(sizes + 4) - sizes - 4)
    limit = at + 8 * sizes
    n = np.array([counts[i] for i in order], np.int64)
    most, kept = int(n[0]), sum(u[3] for u in units)
    out = np.zeros((len(order), most * kept), np.int32)
    pred = {u[2]: np.zeros(len(order), np.int64) for u in units}
    lanes = np.searchsorted(-n, -np.arange(most), side="left").tolist()  # that have more blocks
    for m, live in enumerate(lanes):
        j = m * kept
        for dc, ac, comp, keep in units:
            bits_of, diff_of = _blocks(dc, ac)
            here = at[:live]
            w = _window(words, here)
            bits, diff = bits_of.take(w), diff_of.take(w)
            if not bits.all():
                slow = np.flatnonzero(bits == 0)
                bits[slow], diff[slow] = _coded_blocks(words, here[slow], dc, ac)
            here += bits
            value = pred[comp][:live]
            value += diff
            if keep:
                out[:live, j] = value
                j += 1
    if (at > limit).any():
        raise ValueError("scan ends early")
    done = dict(zip(order, range(len(order)), strict=True))
    return [out[done[i], : counts[i] * kept] for i in range(len(pieces))]


class _Frame:
    """What a frame's thumbnail needs: size, quantiser, and the pieces of its luminance scan with their block grid."""

    __slots__ = ("counts", "grid", "high", "pieces", "quant", "units", "wide")


def _parsed(b: bytes, at: int) -> tuple[_Frame, int]:
    """The frame that begins at an offset, and the offset behind it."""
    quant, tables, frame, restart, scan = {}, {}, None, 0, None
    if b[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at += 2
    while True:
        if at + 2 > len(b) or b[at] != 0xFF:
            raise ValueError("no marker")
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == EOI:
            at += 2
            break
        size = struct.unpack(">H", b[at + 2 : at + 4])[0]
        body, at = b[at + 4 : at + 2 + size], at + 2 + size
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == DRI:
            restart = struct.unpack(">H", body)[0]
        elif marker == SOF0:
            _, high, wide, n = struct.unpack(">BHHB", body[:6])
            frame = (high, wide, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)})
        elif 0xC0 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == SOS:
            stop = at
            while True:  # the scan ends at the first marker that is neither stuffing nor a restart
                stop = b.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(b):
                    raise ValueError("scan has no end")
                if b[stop + 1] == 0 or 0xD0 <= b[stop + 1] <= 0xD7:
                    stop += 2
                    continue
                break
            scan = _scan(b[at:stop], body, frame, tables, restart) or scan
            at = stop
    if frame is None or scan is None:
        raise ValueError("no luminance scan")
    high, wide, parts = frame
    out = _Frame()
    out.high, out.wide, out.quant = high, wide, quant[next(iter(parts.values()))[2]]
    out.pieces, out.counts, out.units, out.grid = scan
    return out, at


def _scan(data: bytes, head: bytes, frame, tables, restart: int):
    """(pieces, their MCUs, units, block grid) of a scan that holds luminance, else None."""
    high, wide, parts = frame
    first = next(iter(parts))
    chosen = [(head[1 + 2 * i], head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(head[0])]
    if first not in [c[0] for c in chosen]:
        return None
    hmax, vmax = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    h, v, _ = parts[first]
    cols, rows = -(-(-(-wide * h // hmax)) // 8), -(-(-(-high * v // vmax)) // 8)
    if len(chosen) == 1:  # one component: blocks in raster order, without padding to whole MCUs
        mcu_cols, mcu_rows, bh, bv = cols, rows, 1, 1
    else:
        mcu_cols, mcu_rows, bh, bv = -(-wide // (8 * hmax)), -(-high // (8 * vmax)), h, v
    n = mcu_cols * mcu_rows
    pieces = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
    counts = [min(restart or n, n - i * restart) for i in range(len(pieces))]
    if not n or min(counts) <= 0 or sum(counts) < n:
        raise ValueError("scan ends early")
    units = tuple((tables[0, d], tables[1, a], c, c == first) for c, d, a in chosen for _ in range(parts[c][0] * parts[c][1] if len(chosen) > 1 else 1))
    return [p.replace(b"\xff\0", b"\xff") for p in pieces], counts, units, (mcu_rows, mcu_cols, bv, bh, rows, cols)


def thumbnails_of(media: list[bytes], together: int = 4 << 20) -> list[tuple[list[np.ndarray], int, int]]:
    """(DC-only luminance planes of the frames, width, total height) of each value; `together` bytes of scans are walked at a time."""
    found: list[list[_Frame]] = []
    for b in media:
        frames, at = [], 0
        try:
            while at < len(b):
                frame, at = _parsed(b, at)
                frames.append(frame)
        except (TypeError, KeyError, IndexError, struct.error) as e:
            raise ValueError("broken JPEG") from e
        if not frames:
            raise ValueError("no JPEG")
        found.append(frames)
    lanes: dict[tuple, list[tuple[_Frame, int]]] = {}
    for frames in found:
        for f in frames:
            lanes.setdefault(f.units, []).extend((f, i) for i in range(len(f.pieces)))
    dc: dict[int, list[np.ndarray]] = {}
    for units, every in lanes.items():
        lo = size = 0
        for hi, (f, i) in enumerate(every, 1):
            size += len(f.pieces[i])
            if size >= together or hi == len(every):
                part = every[lo:hi]
                for (g, _), values in zip(part, _walk([g.pieces[j] for g, j in part], [g.counts[j] for g, j in part], units), strict=True):
                    dc.setdefault(id(g), []).append(values)
                lo, size = hi, 0
    out = []
    for frames in found:
        planes = []
        for f in frames:
            mcu_rows, mcu_cols, bv, bh, rows, cols = f.grid
            plane = np.concatenate(dc[id(f)]).reshape(mcu_rows, mcu_cols, bv, bh).transpose(0, 2, 1, 3).reshape(mcu_rows * bv, mcu_cols * bh)[:rows, :cols]
            planes.append(np.clip((plane * f.quant + 1028) >> 3, 0, 255).astype(np.uint8))
        out.append((planes, max(f.wide for f in frames), sum(f.high for f in frames)))
    return out


def thumbnail(media: bytes) -> tuple[list[np.ndarray], int, int]:
    return thumbnails_of([media])[0]


def average_hash(planes: list[np.ndarray]) -> str:
    """64 bits: whether each of 64 consecutive runs of thumbnail samples is lighter than the whole."""
    flat = planes[0].ravel() if len(planes) == 1 else np.concatenate([p.ravel() for p in planes])
    edges = np.arange(64) * len(flat) // 64
    sums = np.add.reduceat(flat, edges, dtype=np.int64) if len(flat) >= 64 else np.resize(flat, 64).astype(np.int64)
    sizes = np.diff(edges, append=len(flat)) if len(flat) >= 64 else np.ones(64, np.int64)
    return np.packbits(sums * len(flat) > sizes * int(flat.sum(dtype=np.int64))).tobytes().hex()


# ---- columns ------------------------------------------------------------------------------------


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media: every whole text as JPEG bytes."""
    text_batches(docs.sparkSession)

    def run(batches):
        for x in batches:
            media = pa.array([encode_bytes(t) for t in x.column("_b").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([x.column(0), media], [id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_b")).mapInArrow(trimmed(run), f"`{id_col}` {kind}, media binary")


FEATURES = "width int, height long, frames int, payload_bytes long, payload_sha256 string, tail_crc32 long, n_bytes long, media_bytes long, media_sha256 string, feature string"


def thumbnails(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Dimensions and hashes of each media value's DC-only thumbnail, and what its samples hold as a payload."""
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def one(media, planes, width, height):
        payload = b"".join(p.tobytes() for p in planes)
        return width, height, len(planes), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload.rstrip(b"\xff")), len(media), hashlib.sha256(media).hexdigest(), average_hash(planes)

    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for x in batches:
            media = x.column(1).to_pylist()
            rows, at = [(None,) * len(names)] * len(media), []
            size = 0
            for i, m in enumerate(media):
                at += [i] if m is not None else []
                size += len(m or b"")
                if size >= 16 << 20 or i == len(media) - 1:
                    for j, got in zip(at, thumbnails_of([media[j] for j in at]), strict=True):
                        rows[j] = one(media[j], *got)
                    at, size = [], 0
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([x.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, media_col).mapInArrow(trimmed(run), f"`{id_col}` {kind}, {FEATURES}")


def op1_media(spark, sf_dir):
    from .common import stash, table

    return thumbnails(stash(encode_media(table(spark, sf_dir, "documents")), "media", compression="zstd"))
