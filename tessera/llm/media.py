"""Payloads as baseline JPEG, and a baseline decoder for DC-only luminance thumbnails.

A payload byte is the DC coefficient of one 8x8 block of a greyscale baseline JPEG (quantiser 8, so the block's mean is
the byte): the DC-only thumbnail, a pixel per block, is the payload again. Each row of 64 blocks is a restart interval, so that
the decoder reads many intervals at once: one numpy lane per interval, a Huffman symbol of every lane per step.

The decoder takes other baseline files too: several components and sampling factors, AC coefficients (parsed and
skipped), with or without restart markers, and images one after another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import others, read

ROW = 64
#: Rows of one image; a JPEG is at most 65,535 pixels high. Longer payloads are several images, one after another.
IMAGE_ROWS = 8191
#: Rows of blocks encoded or decoded together, whatever documents they are of.
CHUNK_ROWS = 16_384
#: Fixed values of the standard: code lengths of the DC luminance table, for the categories 0 to 11.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: Our AC table has the end of block alone, in one bit.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=1)
def _encoder_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and number of bits of a block by its DC difference plus 255."""
    dc = {s: (c, n) for s, c, n in _codes(DC_COUNTS, DC_SYMBOLS)}
    bits, lengths = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << category) - 1
        code, n = dc[category]
        bits[d + 255] = (code << category | extra) << 1  # and the end of block, 0
        lengths[d + 255] = n + category + 1
    return bits, lengths


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int, n_bytes: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(0xFE, b"n_bytes=%d" % n_bytes) + _segment(0xDB, b"\x00" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS) + _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS)
        + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _encode_rows(rows: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of 64 samples, each followed by its restart marker, and where each row starts."""
    bits_of, length_of = _encoder_tables()
    samples = rows.astype(np.int16) - 128
    samples[:, 1:] -= samples[:, :-1].copy()
    samples += 255
    bits, lengths = bits_of[samples], length_of[samples]
    pad = -lengths.sum(1) % 8
    bits[:, -1] = bits[:, -1] << pad.astype(np.uint64) | ((1 << pad) - 1).astype(np.uint64)
    lengths[:, -1] += pad
    row_bytes = lengths.sum(1) // 8
    bits, lengths = bits.ravel(), lengths.ravel()
    ends = np.cumsum(lengths)
    at = ends - lengths
    word, over = at >> 6, (at & 63) + lengths - 64
    spill = np.flatnonzero(over > 0)
    high = bits << np.maximum(-over, 0).astype(np.uint64)
    high[spill] = bits[spill] >> over[spill].astype(np.uint64)
    words = np.zeros((int(ends[-1]) + 63 >> 6) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    words[word[spill] + 1] |= bits[spill] << (64 - over[spill]).astype(np.uint64)
    coded = words.byteswap().view(np.uint8)[: int(ends[-1]) // 8]
    full = coded == 255
    stuffed = np.cumsum(full)
    row = np.repeat(np.arange(len(rows)), row_bytes)
    out = np.zeros(len(coded) + int(stuffed[-1]) + 2 * len(rows), np.uint8)
    out[np.arange(len(coded)) + stuffed - full + 2 * row] = coded
    row_ends = np.cumsum(row_bytes)
    marks = row_ends + stuffed[row_ends - 1] + 2 * np.arange(len(rows))
    out[marks], out[marks + 1] = 0xFF, 0xD0 + number % 8
    return out, np.concatenate([[0], marks + 2])


def encode_payloads(texts: list[bytes]) -> list[bytes]:
    """A text's JPEG form: its bytes and zeros up to a positive multiple of 64."""
    sizes = [max(1, -(-len(t) // ROW)) for t in texts]
    payload = np.frombuffer(b"".join(t + bytes(n * ROW - len(t)) for t, n in zip(texts, sizes, strict=True)), np.uint8).reshape(-1, ROW)
    number = np.concatenate([np.arange(n) % IMAGE_ROWS for n in sizes]) if sizes else np.zeros(0, int)
    parts, starts, base = [], [], 0
    for a in range(0, len(payload), CHUNK_ROWS):
        coded, at = _encode_rows(payload[a : a + CHUNK_ROWS], number[a : a + CHUNK_ROWS])
        parts.append(coded)
        starts.append(at[:-1] + base)
        base += len(coded)
    scans, starts = (np.concatenate(parts).tobytes(), np.concatenate([*starts, [base]])) if parts else (b"", np.zeros(1, int))
    out, row = [], 0
    for t, n in zip(texts, sizes, strict=True):
        images = []
        for a in range(0, n, IMAGE_ROWS):
            b = min(n, a + IMAGE_ROWS)
            images.append(_header(b - a, len(t)) + scans[starts[row + a] : starts[row + b] - 2] + b"\xff\xd9")
        out.append(b"".join(images))
        row += n
    return out


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    restart: int = 0
    comment: bytes = b""
    quant: dict[int, int] = field(default_factory=dict)  # of DC by table
    huffman: dict[int, bytes] = field(default_factory=dict)  # by class and number
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    scan: list[tuple[int, int]] = field(default_factory=list)  # component, tables
    start: int = 0  # of the entropy-coded data
    end: int = 0

    def layout(self) -> tuple[tuple[int, int, int], ...]:
        """(component, DC table, AC table) of each block of an MCU."""
        if len(self.scan) == 1:
            return ((self.scan[0][0], self.scan[0][1] >> 4, self.scan[0][1] & 15),)
        factors = {c: h * v for c, h, v, _ in self.components}
        return tuple((c, t >> 4, t & 15) for c, t in self.scan for _ in range(factors[c]))

    def mcus(self) -> tuple[int, int]:
        """MCUs across and down."""
        most_h, most_v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.scan) == 1:
            _, h, v, _ = next(c for c in self.components if c[0] == self.scan[0][0])
            return -(-(-(-self.width * h // most_h)) // 8), -(-(-(-self.height * v // most_v)) // 8)
        return -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))


def parse_markers(data: bytes, at: int, frame_end) -> Frame:
    """Marker segments of the image at data[at:]; frame_end(i) finds the marker that ends the scan at i."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    f, at = Frame(), at + 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        while data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            f.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                f.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            f.height, f.width, n = struct.unpack(">xHHB", body[:6])
            f.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC0 < marker < 0xD0 and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                f.huffman[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            f.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            f.scan = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            f.start, f.end = at, frame_end(at)
            return f
        elif marker == 0xD9:
            raise ValueError("no scan")


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol by the next 16 bits; length 0 is no code."""
    lengths, symbols = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    for s, code, n in _codes(table[:16], table[16:]):
        lengths[code << 16 - n : (code + 1) << 16 - n] = n
        symbols[code << 16 - n : (code + 1) << 16 - n] = s
    return lengths, symbols


@lru_cache(maxsize=64)
def _dc_lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bits and value of a DC difference by the next 16 bits, where code and value fit into them; else 0 bits."""
    lengths, symbols = (x.astype(np.int64) for x in _lookup(table))
    total = lengths + symbols
    fits = (lengths > 0) & (total <= 16)
    extra = (np.arange(1 << 16) >> np.where(fits, 16 - total, 0)) & ((1 << np.where(fits, symbols, 0)) - 1)
    value = np.where(extra < (1 << symbols >> 1), extra - (1 << symbols) + 1, extra)
    return np.where(fits, total, 0).astype(np.uint64), np.where(fits & (symbols > 0), value, 0)


def _decode_lanes(window: np.ndarray, start: np.ndarray, mcus: np.ndarray, layout, tables: list[tuple[bytes, bytes]]) -> np.ndarray:
    """DC differences [lane, MCU, block of it] of entropy-coded intervals that begin at the bytes `start`."""
    pos, out = start.astype(np.uint64) << np.uint64(3), np.zeros((int(mcus.max()), len(layout), len(start)), np.int32)
    order = np.argsort(-mcus, kind="stable")  # the lanes still at work are always the first
    pos, left = pos[order], mcus[order]
    u3, u7, u48 = np.uint64(3), np.uint64(7), np.uint64(48)
    n = len(pos)
    for step in range(out.shape[0]):
        while left[n - 1] <= step:
            n -= 1
        for k in range(len(layout)):
            dc, ac = tables[k]
            bits_of, value_of = _dc_lookup(dc)
            ac_length, ac_symbol = _lookup(ac)
            p = pos[:n]
            x = window[p >> u3] << (p & u7)
            look = x >> u48
            bits, value = bits_of[look], value_of[look]
            if not bits.all():
                for i in np.flatnonzero(bits == 0):
                    length, category = (int(t[look[i]]) for t in _lookup(dc))
                    if not length:
                        raise ValueError("no such DC code")
                    extra = int(x[i]) << length & (1 << 64) - 1
                    extra >>= 64 - category
                    bits[i], value[i] = length + category, extra if extra >> category - 1 else extra - (1 << category) + 1
            out[step, k, :n] = value
            look = (x << bits) >> u48
            symbol = ac_symbol[look]
            p += bits + ac_length[look]
            if symbol.any() or not ac_length[look].all():
                at = np.zeros(n, np.int64)
                busy, symbol, length = np.arange(n), symbol.astype(np.int64), ac_length[look]
                while True:
                    if not length.all():
                        raise ValueError("no such AC code")
                    p[busy] += (symbol & 15).astype(np.uint64)
                    at[busy] += (symbol >> 4) + 1
                    more = (symbol != 0) & (at[busy] < 63)
                    busy = busy[more]
                    if not len(busy):
                        break
                    look = window[p[busy] >> u3] << (p[busy] & u7)
                    look >>= u48
                    symbol, length = ac_symbol[look].astype(np.int64), ac_length[look]
                    p[busy] += length
    result = np.empty_like(out)
    result[:, :, order] = out
    return result.transpose(2, 0, 1)


def decode_thumbnails(files: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """Frames and DC-only luminance thumbnails, a sample per block, of the images of each file. Some images are decoded at a time, so
    that what decoding needs besides the files is bounded, however many images a file has."""
    buffer = b"".join(files) + bytes(16)
    data = np.frombuffer(buffer, np.uint8)
    marks = np.flatnonzero(data[:-1] == 0xFF)
    after = data[marks + 1]
    restarts = marks[(after >= 0xD0) & (after < 0xD8)]
    stops = marks[(after > 0) & (after < 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    frames, of_file, at, end = [], [], 0, 0
    for k, x in enumerate(files):
        end += len(x)
        while at < end:
            frame = parse_markers(buffer, at, lambda i: int(stops[np.searchsorted(stops, i)]))
            frames.append(frame)
            of_file.append(k)
            at = frame.end + 2
            if buffer[frame.end + 1] != 0xD9:
                raise ValueError("more than one scan")
    out: list[list[tuple[Frame, np.ndarray]]] = [[] for _ in files]
    for a, b in _in_blocks([f.end - f.start for f in frames], CHUNK_ROWS * ROW):
        some = frames[a:b]
        for f, k, thumb in zip(some, of_file[a:b], _decode_frames(data, some, restarts), strict=True):
            out[k].append((f, thumb))
    return out


def _decode_frames(data: np.ndarray, frames: list[Frame], restarts: np.ndarray) -> list[np.ndarray]:
    """Thumbnails of images that follow each other in data."""
    base, end = frames[0].start, frames[-1].end
    part = data[base : end + 1]
    keep, full = np.ones(len(part), bool), np.flatnonzero(part[:-1] == 0xFF)
    keep[full[part[full + 1] == 0] + 1] = False  # stuffed zeros
    keep[full[part[full + 1] == 0xFF]] = False  # fill bytes
    clean = np.concatenate([part[keep], np.zeros(16, np.uint8)]).astype(np.uint64)
    place = np.cumsum(keep) - 1
    pair = clean[:-1] << np.uint64(8) | clean[1:]
    quad = pair[:-2] << np.uint64(16) | pair[2:]
    window = quad[:-4] << np.uint64(32) | quad[4:]
    kinds: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        layout = f.layout()
        kinds.setdefault((layout, *((f.huffman[dc], f.huffman[16 | ac]) for _, dc, ac in layout)), []).append(i)
    thumbs: dict[int, np.ndarray] = {}
    for (layout, *tables), members in kinds.items():
        starts, counts, lanes_of = [], [], []
        for i in members:
            f = frames[i]
            across, down = f.mcus()
            inside = restarts[np.searchsorted(restarts, f.start) : np.searchsorted(restarts, f.end)] if f.restart else restarts[:0]
            each = f.restart or across * down
            lanes = -(-across * down // each)
            if len(inside) < lanes - 1:
                raise ValueError("restart intervals are missing")
            starts.append(np.concatenate([[f.start], inside[: lanes - 1] + 2]) - base)
            counts.append(np.minimum(each, across * down - each * np.arange(lanes)))
            lanes_of.append(lanes)
        diffs = _decode_lanes(window, place[np.concatenate(starts)], np.concatenate(counts), layout, tables)
        lane = 0
        for i, lanes in zip(members, lanes_of, strict=True):
            thumbs[i] = _thumbnail(frames[i], layout, diffs[lane : lane + lanes])
            lane += lanes
    return [thumbs[i] for i in range(len(frames))]


def _thumbnail(f: Frame, layout, diffs: np.ndarray) -> np.ndarray:
    """Samples of the first component's blocks from DC differences."""
    luma, h, v, q = f.components[0]
    across, down = f.mcus()
    mine = [k for k, (c, _, _) in enumerate(layout) if c == luma]
    lanes, steps = diffs.shape[:2]
    dc = np.cumsum(diffs[:, :, mine].reshape(lanes, -1), axis=1).reshape(-1, len(mine))[: across * down]
    if len(f.scan) == 1:
        h = v = 1
    blocks = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    most_h, most_v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    wide, high = (-(-(-(-n * own // most)) // 8) for n, own, most in ((f.width, f.components[0][1], most_h), (f.height, f.components[0][2], most_v)))
    return np.clip((blocks[:high, :wide] * f.quant[q] + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def difference_hash(thumb: np.ndarray) -> str:
    """16 hex digits: whether neighbours of a 8 x 9 grid of samples rise."""
    y = np.arange(8) * thumb.shape[0] // 8
    x = np.arange(9) * thumb.shape[1] // 9
    grid = thumb[np.ix_(y, x)]
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def _in_blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def store_media(docs: DataFrame, *, text: str = "text", media: str = "media") -> DataFrame:
    """All columns but the text, and `media` binary: the text's UTF-8 payload as baseline JPEG, with its length in a comment.

    Null counts as empty, whose payload is 64 zeros. Rows are independent, so equal texts, repeated rows among them, give equal media; a long
    text is stored whole, as several images, with a few copies of it in memory; an empty table stays empty; a column named as
    `media` is replaced.
    """
    kept = others(docs, text, media)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.binary())
            for a, b in _in_blocks(_sizes(texts), CHUNK_ROWS * ROW):
                column = pa.array(encode_payloads([t or b"" for t in texts.slice(a, b - a).to_pylist()]), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(kept)], column], names=[*kept, media])

    return docs.select(*kept, text).mapInArrow(run, schema)


def _sizes(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def _read(column: pa.Array) -> Iterator[tuple]:
    """(first row, end, files, lengths, payloads, features) of some rows of stored media at a time."""
    for a, b in _in_blocks(_sizes(column), CHUNK_ROWS * ROW):
        files = [x or b"" for x in column.slice(a, b - a).to_pylist()]
        n, payload, feature = [], [], []
        for images in decode_thumbnails(files):
            said = images[0][0].comment if images else b""
            n.append(int(said[8:]) if said.startswith(b"n_bytes=") else None)
            payload.append(b"".join(t.tobytes() for _, t in images) if images else None)
            feature.append(",".join(f"{f.width}x{f.height}:{difference_hash(t)}" for f, t in images) if images else None)
        yield a, b, files, n, payload, feature


FEATURES = "n_bytes long, payload binary, feature string"


def read_media(stored: DataFrame, *, media: str = "media") -> DataFrame:
    """All columns, and what the stored bytes give: n_bytes (from the comment), payload (samples of the DC-only thumbnails) and
    feature: width x height and thumbnail hash of each image. Null media give nulls; a file that isn't baseline JPEG fails."""
    kept = others(stored, "n_bytes", "payload", "feature")
    schema = T.StructType([*stored.select(*kept).schema.fields, *T.StructType.fromDDL(FEATURES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, n, payload, feature in _read(batch.column(kept.index(media))):
                columns = [pa.array(n, pa.int64()), pa.array(payload, pa.binary()), pa.array(feature, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *columns], names=[*kept, "n_bytes", "payload", "feature"])

    return stored.select(*kept).mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_media(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, files, n, payloads, feature in _read(batch.column(1)):
                columns = [
                    batch.column(0).slice(a, b - a), n, [len(x) for x in payloads], [hashlib.sha256(x).hexdigest() for x in payloads], [zlib.crc32(x[-64:]) for x in payloads],
                    [len(x) for x in files], [hashlib.sha256(x).hexdigest() for x in files], feature,
                ]
                yield pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)))

    return stored.select("doc_id", "media").mapInArrow(digest, DIGEST)
