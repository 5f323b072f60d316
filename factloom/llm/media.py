"""Media columns: baseline JPEG parsing, Huffman decoding and DC-only luminance thumbnails in numpy.

``decode`` reads any baseline (sequential, 8-bit, Huffman) JPEG: all marker segments, 8- and 16-bit
quantisation tables, several Huffman tables, chroma subsampling, several scans, restart intervals.  Scans are
decoded in lockstep: every restart segment of every image in a batch is a lane, and one numpy step decodes
one coefficient symbol of all lanes.  ``encode_payload`` is the writer that stores bytes as coefficients.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textbuf as tb

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
#: Bytes of one coded unit: three blocks of 64 coefficients.
UNIT = 192
#: Lanes that are decoded together.
LANES = 1 << 14


class MediaError(ValueError):
    """The bytes are not a baseline JPEG that this reader supports."""


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    blocks_w: int = 0  # padded to whole MCUs
    blocks_h: int = 0
    dc_table: int = 0
    ac_table: int = 0


@dataclass
class Image:
    """A parsed image; ``blocks[c]`` holds the coefficients of component c in zigzag order once decoded."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple[list[Component], dict, int, np.ndarray]] = field(default_factory=list)
    comment: bytes = b""
    blocks: dict[int, np.ndarray] = field(default_factory=dict)


def huffman_lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """A table by the next 16 bits: code length << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            span = 1 << (16 - length)
            out[code << (16 - length) : (code << (16 - length)) + span] = (length << 8) | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


_TABLES: dict[bytes, np.ndarray] = {}


def _lookup(raw: bytes) -> np.ndarray:
    """``huffman_lookup`` of a table definition; the few definitions in use are kept."""
    if raw not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[raw] = huffman_lookup(raw[:16], raw[16:])
    return _TABLES[raw]


def parse(raw: bytes) -> Image:
    """Read the marker segments; scans keep their entropy-coded bytes."""
    if raw[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    image, tables, restart, at = Image(), {}, 0, 2
    while True:
        if at + 2 > len(raw):
            raise MediaError("no end of image")
        if raw[at] != 0xFF:
            raise MediaError(f"no marker at {at}")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise MediaError("cut segment")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                image.quant[ident] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0 or marker == 0xC1:
            if len(body) < 6 or len(body) < 6 + 3 * body[5] or not body[5]:
                raise MediaError("cut frame header")
            if body[0] != 8:
                raise MediaError("only 8-bit samples")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if not image.width or not image.height or not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in image.components):
                raise MediaError("no such size or sampling")
            high, wide = max(c.v for c in image.components), max(c.h for c in image.components)
            for c in image.components:
                c.blocks_w, c.blocks_h = -(-image.width // (8 * wide)) * c.h, -(-image.height // (8 * high)) * c.v
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise MediaError("only baseline images")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = bytes(body)
        elif marker == 0xDA:
            chosen = []
            for k in range(body[0]):
                c = next(c for c in image.components if c.ident == body[1 + 2 * k])
                c.dc_table, c.ac_table = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                chosen.append(c)
            coded = np.frombuffer(raw, np.uint8)[at:]
            ff = np.flatnonzero(coded[:-1] == 0xFF)
            after = coded[ff + 1]
            ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
            if not len(ends):
                raise MediaError("no end of scan")
            image.scans.append((chosen, dict(tables), restart, coded[: ends[0]]))
            at += int(ends[0])
    if not image.scans:
        raise MediaError("no scan")
    # a block takes two bits at least, so memory stays within a fixed multiple of the file's bytes
    if sum(c.blocks_w * c.blocks_h for c in image.components) > 4 * sum(len(coded) + 64 for *_, coded in image.scans):
        raise MediaError("scan data end too early")
    return image


def segments(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and restart markers, and the start of each restart segment."""
    ff = np.flatnonzero(coded[:-1] == 0xFF)
    if not len(ff):
        return coded, np.array([0])
    after = coded[ff + 1]
    keep = np.ones(len(coded), bool)
    keep[ff[after == 0] + 1] = False
    mark = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[mark] = keep[mark + 1] = False
    kept = np.cumsum(keep)
    return coded[keep], np.concatenate(([0], kept[mark + 1]))


def decode(images: list[Image]) -> None:
    """Huffman-decode all scans of all images; scans of one layout and one set of tables share the lockstep."""
    groups: dict[tuple, list[tuple[Image, list[Component], int, np.ndarray]]] = {}
    for image in images:
        for c in image.components:
            image.blocks[c.ident] = np.zeros((c.blocks_w * c.blocks_h, 64), np.int16)
        for chosen, tables, restart, coded in image.scans:
            layout = tuple((1, 1, tables[c.dc_table], tables[16 + c.ac_table]) if len(chosen) == 1 else (c.h, c.v, tables[c.dc_table], tables[16 + c.ac_table]) for c in chosen)
            groups.setdefault(layout, []).append((image, chosen, restart, coded))
    for layout, scans in groups.items():
        _decode_group(layout, scans)


def _mcus(image: Image, chosen: list[Component]) -> tuple[int, int]:
    """MCUs of a scan: across and down.  A scan of one component has just the blocks that hold samples."""
    wide, high = max(c.h for c in image.components), max(c.v for c in image.components)
    if len(chosen) == 1:
        c = chosen[0]
        return -(-(-(-image.width * c.h // wide)) // 8), -(-(-(-image.height * c.v // high)) // 8)
    return -(-image.width // (8 * wide)), -(-image.height // (8 * high))


def _decode_group(layout: tuple, scans: list[tuple[Image, list[Component], int, np.ndarray]]) -> None:
    buffers, starts, counts, limits, base = [], [], [], [], 0
    for image, chosen, restart, coded in scans:
        plain, at = segments(coded)
        across, down = _mcus(image, chosen)
        total = across * down
        step = restart or total
        need = -(-total // step)
        if len(at) != need:
            raise MediaError(f"{len(at)} restart segments, {need} expected")
        starts.append(base + at)
        limits.append(base + np.append(at[1:], len(plain)))
        counts.append(np.minimum(step, total - step * np.arange(need)))
        buffers += [plain, np.zeros(8, np.uint8)]
        base += len(plain) + 8
    data = np.concatenate([*buffers, np.zeros(8, np.uint8)])
    start, limit, count = np.concatenate(starts), np.concatenate(limits), np.concatenate(counts)
    per = sum(h * v for h, v, _, _ in layout)
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros((int(first[-1]) * per, 64), np.int16)
    # lanes of like length run together
    order = np.argsort(count, kind="stable")
    for k in range(0, len(order), LANES):
        some = order[k : k + LANES]
        _lockstep(data, start[some] * 8, limit[some] * 8, count[some], first[some] * per, layout, out)
    done = 0
    for image, chosen, _, _ in scans:
        across, down = _mcus(image, chosen)
        n = across * down * per
        _place(image, chosen, layout, out[done : done + n], across, down)
        done += n


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number."""
    n = len(data) - 7
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _lockstep(data: np.ndarray, bit: np.ndarray, limit: np.ndarray, mcus: np.ndarray, first: np.ndarray, layout: tuple, out: np.ndarray) -> None:
    low, high = int(bit.min()) >> 3, int(limit.max()) // 8 + 8
    words = _words(data[low : high + 8])
    bit = bit - 8 * low
    limit = limit - 8 * low
    flat = out.reshape(-1)
    live = np.arange(len(bit))
    predicted = np.zeros((len(layout), len(bit)), np.int64)
    block = first * 64
    for mcu in range(int(mcus.max(initial=0))):
        live = live[mcus[live] > mcu]
        for c, (h, v, dc_raw, ac_raw) in enumerate(layout):
            dc, ac = _lookup(dc_raw), _lookup(ac_raw)
            for _ in range(h * v):
                at = block[live]
                pos, size, _ = _symbol(words, bit[live], dc)
                value, pos = _amplitude(words, pos, size)
                value = predicted[c][live] + value
                predicted[c][live] = value
                flat[at] = value
                pos = _ac(words, pos, at, ac, flat)
                bit[live] = pos
                block[live] = at + 64
    if (bit > limit).any():
        raise MediaError("scan data end too early")


def _symbol(words: np.ndarray, pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position behind the code, low and high nibble of the symbol."""
    at = np.minimum(pos >> 3, len(words) - 1)
    peek = (words[at] << (pos & 7).astype(np.uint64)) >> np.uint64(48)
    found = table[peek.astype(np.int64)].astype(np.int64)
    if not found.all():
        raise MediaError("no such code")
    return pos + (found >> 8), found & 15, (found >> 4) & 15


def _amplitude(words: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(pos >> 3, len(words) - 1)
    raw = ((words[at] << (pos & 7).astype(np.uint64)) >> np.uint64(32)) >> (32 - size).astype(np.uint64)
    raw = raw.astype(np.int64)
    return np.where(raw < ((1 << size) >> 1), raw - (1 << size) + 1, raw), pos + size


def _ac(words: np.ndarray, pos: np.ndarray, at: np.ndarray, table: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Decode the AC coefficients of one block of every lane."""
    n = len(pos)
    k = np.ones(n, np.int64)
    lane = None  # all lanes, until one ends early
    last = len(words) - 1
    pos = pos.copy()
    while True:
        p = pos if lane is None else pos[lane]
        word = words[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint64)
        found = table[(word >> np.uint64(48)).astype(np.int64)]
        if not found.all():
            raise MediaError("no such code")
        length = (found >> 8).astype(np.uint64)
        size = (found & 15).astype(np.uint64)
        raw = ((word << length) >> np.uint64(32) >> (np.uint64(32) - size)).astype(np.int64)
        bound = np.int64(1) << size.astype(np.int64)
        value = raw - (bound - 1) * (raw < (bound >> 1))
        p = p + (length + size).astype(np.int64)
        kk = k if lane is None else k[lane]
        run = ((found >> 4) & 15).astype(np.int64)
        empty = size == 0
        if empty.any():
            jump = run == 15
            kk = np.where(empty, np.where(jump, kk + 16, 64), kk + run)
            put = ~empty
            if (kk[put] > 63).any():
                raise MediaError("block overrun")
            where = at if lane is None else at[lane]
            flat[where[put] + kk[put]] = value[put]
            kk = kk + put
        else:
            kk = kk + run
            if (kk > 63).any():
                raise MediaError("block overrun")
            flat[(at if lane is None else at[lane]) + kk] = value
            kk = kk + 1
        if lane is None:
            pos, k = p, kk
            if (kk >= 64).all():
                return pos
            if (kk >= 64).any():
                lane = np.flatnonzero(kk < 64)
        else:
            pos[lane], k[lane] = p, kk
            lane = lane[kk < 64]
            if not len(lane):
                return pos


def _place(image: Image, chosen: list[Component], layout: tuple, blocks: np.ndarray, across: int, down: int) -> None:
    per = sum(h * v for h, v, _, _ in layout)
    table = blocks.reshape(down, across, per, 64)
    offset = 0
    for c, (h, v, _, _) in zip(chosen, layout):
        part = table[:, :, offset : offset + h * v].reshape(down, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(down * v, across * h, 64)
        grid = image.blocks[c.ident].reshape(c.blocks_h, c.blocks_w, 64)
        grid[: part.shape[0], : part.shape[1]] = part
        offset += h * v


def thumbnail(image: Image) -> np.ndarray:
    """The DC-only luminance picture: one 8-bit sample per block, the block's mean brightness."""
    c = image.components[0]
    high, wide = max(x.v for x in image.components), max(x.h for x in image.components)
    rows, columns = -(-(-(-image.height * c.v // high)) // 8), -(-(-(-image.width * c.h // wide)) // 8)
    dc = image.blocks[c.ident][:, 0].astype(np.int64).reshape(c.blocks_h, c.blocks_w)[:rows, :columns] * int(image.quant[c.quant][0])
    return np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(picture: np.ndarray) -> str:
    """Average hash of a picture on an 8 x 8 grid of box means, as 16 hex digits."""
    rows, columns = picture.shape
    r = np.minimum(np.arange(9) * rows // 8, rows)
    c = np.minimum(np.arange(9) * columns // 8, columns)
    total = np.zeros((rows + 1, columns + 1), np.int64)
    total[1:, 1:] = picture.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1 = np.minimum(r[:-1], rows - 1), np.maximum(r[1:], np.minimum(r[:-1], rows - 1) + 1)
    c0, c1 = np.minimum(c[:-1], columns - 1), np.maximum(c[1:], np.minimum(c[:-1], columns - 1) + 1)
    sums = total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    bits = sums * int(area.sum()) > int(sums.sum()) * area
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: One code of one bit, for amplitudes of nine bits (category 9, no zero run).
_ONE_CODE = bytes([1] + [0] * 15) + bytes([9])


def encode_payload(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """Store byte strings (multiples of ``UNIT``) losslessly as baseline JPEGs.

    Each byte b is the coefficient 256 + b of a 4:4:4 image whose quantisation steps are 1, so it always
    has category 9: one code bit and nine amplitude bits.  Every MCU (192 bytes) ends with a restart
    marker, which makes it decodable on its own.  The unpadded size stands in a comment.
    """
    out = []
    for payload, size in zip(payloads, sizes):
        units = len(payload) // UNIT
        across = max(1, int(units**0.5) // 2)
        down = -(-units // across)
        cells = np.zeros(across * down * UNIT, np.uint8)
        cells[: len(payload)] = np.frombuffer(payload, np.uint8)
        cells[::UNIT] = cells.reshape(-1, UNIT).sum(axis=1, dtype=np.uint8)
        # ten bits each, 0 1 bbbbbbbb; four of them make five bytes
        v = cells.reshape(-1, 4).astype(np.uint16) | 0x100
        packed = np.empty((len(v), 5), np.uint8)
        packed[:, 0] = v[:, 0] >> 2
        packed[:, 1] = ((v[:, 0] & 3) << 6) | (v[:, 1] >> 4)
        packed[:, 2] = ((v[:, 1] & 15) << 4) | (v[:, 2] >> 6)
        packed[:, 3] = ((v[:, 2] & 63) << 2) | (v[:, 3] >> 8)
        packed[:, 4] = v[:, 3] & 255
        body = packed.reshape(across * down, 240)
        marked = np.empty((len(body), 242), np.uint8)
        marked[:, :240] = body
        marked[:, 240] = 0xFF
        marked[:, 241] = 0xD0 + np.arange(len(body)) % 8
        scan = marked.reshape(-1)[:-2]
        if (body == 0xFF).any():
            scan = _stuffed(body)
        head = b"\xff\xd8" + _segment(0xFE, b"bytes=%d" % size) + _segment(0xDB, b"\x00" + b"\x01" * 64)
        head += _segment(0xC0, b"\x08" + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + b"\x03\x01\x11\x00\x02\x11\x00\x03\x11\x00")
        head += _segment(0xC4, b"\x00" + _ONE_CODE + b"\x10" + _ONE_CODE) + _segment(0xDD, b"\x00\x01")
        head += _segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
        out.append(head + scan.tobytes() + b"\xff\xd9")
    return out


def _stuffed(body: np.ndarray) -> np.ndarray:
    """The scan of units some of whose bytes are 0xFF, which a zero byte must follow."""
    parts = []
    for k, unit in enumerate(body):
        parts += [unit.tobytes().replace(b"\xff", b"\xff\x00"), bytes([0xFF, 0xD0 + k % 8])]
    return np.frombuffer(b"".join(parts[:-1]), np.uint8)


def decode_payload(image: Image) -> tuple[bytes, int]:
    """The bytes that ``encode_payload`` stored, and their unpadded size; ``image`` must be decoded."""
    size = int(image.comment.partition(b"=")[2])
    length = max(UNIT, -(-size // UNIT) * UNIT)
    cells = (np.stack([image.blocks[c.ident] for c in image.components], axis=1).reshape(-1) - 256)[:length].astype(np.uint8)
    cells[::UNIT] -= cells.reshape(-1, UNIT)[:, 1:].sum(axis=1, dtype=np.uint8)
    return cells.tobytes(), size


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def _media(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part, data, bounds in tb.slices(batch, "text", 2 << 20):
        raw = data.tobytes()
        sizes = np.diff(bounds).tolist()
        payloads = [raw[a:b] + b" " * (max(UNIT, -(-(b - a) // UNIT) * UNIT) - (b - a)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        stored = encode_payload(payloads, sizes)
        images = [parse(x) for x in stored]
        decode(images)
        rows = []
        for media, image in zip(stored, images):
            payload, size = decode_payload(image)
            picture = thumbnail(image)
            rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{image.width}x{image.height}:{thumbnail_hash(picture)}", image.width, image.height))
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])


def text_media(docs: DataFrame) -> DataFrame:
    """Store each text as a JPEG, read it back and describe it; one row per input row.

    A null text counts as empty; an empty one is a single unit of spaces.  Equal texts give equal files.
    ``feature`` is ``WxH:`` and the hash of the DC-only luminance thumbnail; a picture of one unit has no contrast
    and the hash 0.  Rows may repeat, ids may be
    null, other columns are ignored, and an empty table gives an empty result.
    """
    from factloom.llm.common import arrow_map

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _media, SCHEMA)


FEATURES = "width long, height long, n_components long, thumbnail binary, thumbnail_hash string, error string"


def image_features(images: DataFrame, content: str = "content") -> DataFrame:
    """Dimensions, DC-only thumbnail and its hash of a binary column of JPEG files, beside all other columns.

    A null, truncated, progressive or otherwise unreadable file keeps its row; ``error`` tells why and the
    features are null.  Columns of the same names as features are replaced.
    """
    names = [f.split()[0] for f in FEATURES.split(", ")]
    kept = images.drop(*[c for c in images.columns if c.lower() in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), FEATURES])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _features([None if x is None else bytes(x) for x in batch.column(batch.schema.get_field_index(content)).to_pylist()])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return kept.mapInArrow(each, schema)


#: Bytes of files that are decoded together.
TOGETHER = 4 << 20
_FAULTS = (MediaError, ArithmeticError, LookupError, MemoryError, StopIteration, ValueError)


def _features(files: list[bytes | None]) -> list[tuple]:
    """Features of each file; files share the lockstep, and only if one of them is at fault each goes alone."""
    out: list[tuple] = [(None,) * 5 + ("no content",)] * len(files)
    group: list[tuple[int, Image]] = []
    size = 0
    for k, raw in enumerate(files):
        if raw is None:
            continue
        try:
            group.append((k, parse(raw)))
            size += len(raw)
        except _FAULTS as e:
            out[k] = (None,) * 5 + (str(e) or type(e).__name__,)
        if size > TOGETHER:
            _describe(group, out)
            group, size = [], 0
    _describe(group, out)
    return out


def _describe(group: list[tuple[int, Image]], out: list[tuple]) -> None:
    try:
        decode([image for _, image in group])
        for k, image in group:
            picture = thumbnail(image)
            out[k] = (image.width, image.height, len(image.components), picture.tobytes(), thumbnail_hash(picture), None)
    except _FAULTS as e:
        if len(group) > 1:
            for one in group:
                _describe([one], out)
        else:
            out[group[0][0]] = (None,) * 5 + (str(e) or type(e).__name__,)
    for _, image in group:
        image.blocks = {}
