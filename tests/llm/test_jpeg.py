"""The JPEG reader on files with subsampling, zero runs, several tables, scans and restarts."""

import numpy as np
import pytest

from factloom.llm.media import MediaError, decode, encode_payload, image_features, parse, thumbnail

SYMBOLS = [*range(12), *(16 * run + size for run in range(16) for size in range(1, 11)), 0xF0]
SYMBOLS = list(dict.fromkeys(SYMBOLS))


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - k)) & 1 for k in range(n)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def code(symbol):
    return SYMBOLS.index(symbol), 8


def amplitude(v):
    n = int(abs(v)).bit_length()
    return (v if v > 0 else v + (1 << n) - 1), n


def put_block(out, block, before):
    v, n = amplitude(int(block[0]) - before)
    out.put(*code(n))
    out.put(v, n)
    run = 0
    last = max(np.flatnonzero(block[1:]), default=-1) + 1
    for k in range(1, last + 1):
        if block[k] == 0:
            run += 1
            continue
        while run > 15:
            out.put(*code(0xF0))
            run -= 16
        v, n = amplitude(int(block[k]))
        out.put(*code(16 * run + n))
        out.put(v, n)
        run = 0
    if last < 63:
        out.put(*code(0))


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def jpeg(width, height, factors, blocks, restart=0, apart=False):
    """``blocks[c]``: rows x columns x 64 in zigzag order, padded to whole MCUs."""
    wide, high = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    table = bytes([0] * 7 + [len(SYMBOLS)] + [0] * 8) + bytes(SYMBOLS)
    out = b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xDB, b"\x00" + b"\x02" * 64)
    out += segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)]) + b"".join(bytes([k + 1, 16 * h + v, 0]) for k, (h, v) in enumerate(factors)))
    out += segment(0xC4, b"\x00" + table) + segment(0xC4, b"\x10" + table)
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))
    for scan in [[c] for c in range(len(factors))] if apart else [list(range(len(factors)))]:
        out += segment(0xDA, bytes([len(scan)]) + b"".join(bytes([c + 1, 0]) for c in scan) + b"\x00\x3f\x00")
        if len(scan) == 1:
            h, v = factors[scan[0]]
            w, d = -(-(-(-width * h // wide)) // 8), -(-(-(-height * v // high)) // 8)
            units = [[(scan[0], y, x)] for y in range(d) for x in range(w)]
        else:
            units = [[(c, my * factors[c][1] + y, mx * factors[c][0] + x) for c in scan for y in range(factors[c][1]) for x in range(factors[c][0])] for my in range(down) for mx in range(across)]
        bits, before = Bits(), [0] * len(factors)
        for k, unit in enumerate(units):
            if restart and k and k % restart == 0:
                out += bits.bytes() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
                bits, before = Bits(), [0] * len(factors)
            for c, y, x in unit:
                put_block(bits, blocks[c][y][x], before[c])
                before[c] = int(blocks[c][y][x][0])
        out += bits.bytes()
    return out + b"\xff\xd9"


def picture(seed, width, height, factors):
    rng = np.random.default_rng(seed)
    wide, high = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    out = []
    for h, v in factors:
        b = rng.integers(-900, 900, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < 0.08)
        b[..., 0] = rng.integers(-200, 200, b.shape[:2])
        out.append(b)
    return out


@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_coefficients(factors, restart):
    want = [(37, 50, picture(1, 37, 50, factors)), (8, 8, picture(2, 8, 8, factors)), (100, 17, picture(3, 100, 17, factors))]
    images = [parse(jpeg(w, h, factors, b, restart)) for w, h, b in want]
    decode(images)
    for image, (w, h, blocks) in zip(images, want):
        assert (image.width, image.height) == (w, h)
        for c, b in zip(image.components, blocks):
            assert (image.blocks[c.ident].reshape(b.shape) == b).all()
        small = thumbnail(image)
        assert small.shape == (-(-h // 8), -(-w // 8))
        assert small[0, 0] == np.clip((int(blocks[0][0, 0, 0]) * 2 + 4 >> 3) + 128, 0, 255)


def test_separate_scans():
    factors = [(2, 2), (1, 1), (1, 1)]
    blocks = picture(4, 40, 24, factors)
    image = parse(jpeg(40, 24, factors, blocks, 2, apart=True))
    decode([image])
    h, w = 3, 5
    assert (image.blocks[1].reshape(blocks[0].shape)[:h, :w] == blocks[0][:h, :w]).all()


def test_features_of_unreadable_files(spark):
    good = encode_payload([b"x" * 384], [384])[0]
    rows = [(1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[:100]), (6, good.replace(b"\xff\xc0", b"\xff\xc2")), (7, good[:-20] + b"\xff\xd9")]
    got = {r.id: r for r in image_features(spark.createDataFrame([(*r, "kept", 9) for r in rows], "id int, content binary, error string, Width int")).collect()}
    assert got[1].error is None and (got[1].width, got[1].height) == (8, 16) and len(got[1].thumbnail) == 2
    assert all(got[k].error and got[k].width is None for k in range(2, 8))


def test_broken_scan():
    with pytest.raises(MediaError):
        parse(b"\xff\xd8\xff\xda")


def test_image_features_survive_any_file(spark):
    """Broken, hostile and sound files in one batch: every row stays, the sound ones have their features."""
    rng = np.random.default_rng(7)
    good = encode_payload([rng.bytes(192 * n) for n in (1, 3, 40)], [192, 500, 7000])
    frame = lambda raw, body: raw[: raw.index(b"\xff\xc0") + 4] + body + raw[raw.index(b"\xff\xc0") + 4 + len(body) :]
    hostile = [
        frame(good[0], b"\x08\x00\x08\x00\x08\x03\x01\x00"),  # no sampling
        frame(good[0], b"\x08\xff\xff\xff\xff"),  # 65535 x 65535
        frame(good[1], b"\x08\x00\x00"),  # no height
        frame(good[1], b"\x08\x00\x08\x00\x08\x00"),  # no component
        frame(good[2], b"\x08\x00\x08\x00\x08\x03\x01\x99"),  # sampling of nine
        good[2][:400], b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", good[1].replace(b"\xff\xc4", b"\xff\xe4", 1), good[0][:-2],
    ]
    for _ in range(150):
        raw = bytearray(good[rng.integers(3)])
        for at in rng.integers(2, len(raw), 3):
            raw[at] = rng.integers(256)
        hostile.append(bytes(raw))
    rows = [(k, raw) for k, raw in enumerate([*good, None, *hostile])]
    got = {r.id: r for r in image_features(spark.createDataFrame(rows, "id int, content binary").repartition(2)).collect()}
    assert len(got) == len(rows)
    for k, raw in enumerate(good):
        image = parse(raw)
        decode([image])
        assert got[k].error is None and got[k].thumbnail == thumbnail(image).tobytes() and got[k].width == image.width
    assert got[3].error == "no content" and all(got[k].error for k in range(4, 15))


def test_thumbnails_see_every_byte():
    """One changed byte anywhere changes the picture of its unit, and payloads come back."""
    from factloom.llm.media import decode_payload

    rng = np.random.default_rng(8)
    base = bytearray(rng.bytes(192 * 6))
    payloads = [bytes(base)]
    for at in range(0, 192 * 6, 37):
        other = bytearray(base)
        other[at] ^= 64
        payloads.append(bytes(other))
    images = [parse(x) for x in encode_payload(payloads, [192 * 6] * len(payloads))]
    decode(images)
    assert [decode_payload(i)[0] for i in images] == payloads
    pictures = [thumbnail(i).tobytes() for i in images]
    assert all(p != pictures[0] for p in pictures[1:])
