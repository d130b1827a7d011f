"""Media columns: payloads kept losslessly in progressive JPEG, coefficients as samples."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vantage.llm.common import chunks, null_ids, ragged, small_batches, tidy, whole_ids

#: Fixed values of the format: the zigzag order of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Payload bytes are padded with blanks to a positive multiple of UNIT; one image holds at
#: most PART of them, a longer text is a row of images.
UNIT, PART, RESTART = 192, 786_432, 16
#: Scans: first and last coefficient, bit position of the step before (0: none) and of this one.
SCANS = ((0, 0, 0, 1), (0, 0, 1, 0), (1, 5, 0, 1), (1, 5, 1, 0), (6, 63, 0, 0))
_NATURAL = np.argsort(np.argsort(ZIGZAG))
_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    """Code counts by length (1 to 16) and symbols in code order."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], symbols


def code_arrays(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, size, value, i = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            code[symbols[i]], size[symbols[i]] = value, n
            value, i = value + 1, i + 1
        value <<= 1
    return code, size


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """16 peeked bits -> code length * 256 + symbol."""
    code, size = code_arrays(counts, symbols)
    out = np.zeros(1 << 16, np.int32)
    for s in symbols:
        n = int(size[s])
        out[int(code[s]) << (16 - n) : (int(code[s]) + 1) << (16 - n)] = n << 8 | s
    return out


DC_TABLE = canonical(dict.fromkeys(range(12), 4))
AC_TABLE = canonical({**{r << 4 | s: 9 for r in range(16) for s in range(1, 9)}, 0xF0: 9, **dict.fromkeys((0x00, 0x01, 0x02, 0x08), 5), **dict.fromkeys(range(0x03, 0x08), 3)})


def bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def geometry(n: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units (six blocks) that hold n payload bytes."""
    units = -(-n // (2 * UNIT))
    columns = int(np.ceil(np.sqrt(units)))
    return columns, -(-units // columns)


class Layout:
    """Where the blocks of a batch of images lie: image after image, Y then Cb then Cr."""

    def __init__(self, shapes: list[tuple[int, int]]):
        self.shapes = shapes
        units = np.array([c * r for c, r in shapes], np.int64)
        self.units, self.first = units, np.append(0, np.cumsum(6 * units))
        runs, comps, mcu = [], [], []
        for (c, r), at in zip(shapes, self.first.tolist(), strict=False):
            n = c * r
            comps += [(at, 4 * n), (at + 4 * n, n), (at + 5 * n, n)]
            y, x = np.divmod(np.arange(n), c)
            corner = at + (2 * y) * (2 * c) + 2 * x
            mcu.append(np.stack([corner, corner + 1, corner + 2 * c, corner + 2 * c + 1, at + 4 * n + np.arange(n), at + 5 * n + np.arange(n)], 1))
        self.components = comps  # by image: Y, Cb, Cr as first block and count
        self.mcu = np.concatenate(mcu)  # blocks of each 16 x 16 unit
        self.blocks = int(self.first[-1])


def pack(value: np.ndarray, size: np.ndarray, segment: np.ndarray, last: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, one after another, and where each ends.  value, size and
    segment are of the entries in order (size up to 57 bits); last tells segments that end
    a scan, restart the number of the marker after the others."""
    some = size > 0
    value, size, segment = value[some], size[some], segment[some]
    n = len(last)
    bits = np.bincount(segment, size, n).astype(np.int64)
    length = (bits + 7) // 8
    room = length + 2 * ~last
    start = np.cumsum(room) - room
    ends = np.cumsum(size)
    before = np.cumsum(bits) - bits
    at = start[segment] * 8 + (ends - size - before[segment])
    out = np.zeros(int(room.sum()) + 8, np.float64)
    word = value << (np.uint64(64) - (at & 7).astype(np.uint64) - size.astype(np.uint64))
    place, reach = at >> 3, (at & 7) + size
    for j in range(8):
        part = reach > 8 * j
        if not part.any():
            break
        if not part.all():
            word, place, reach = word[part], place[part], reach[part]
        out += np.bincount(place + j, (word >> np.uint64(56 - 8 * j)) & np.uint64(255), len(out))
    out = out[:-8].astype(np.uint8)
    pad = (8 * length - bits).astype(np.int64)
    fill = pad > 0
    out[(start + length - 1)[fill]] |= ((1 << pad[fill]) - 1).astype(np.uint8)
    stuff = out == 255
    mark = (start + length)[~last]
    out[mark], out[mark + 1] = 255, 0xD0 + restart[~last]
    stuff[mark] = False
    stuff[mark + 1] = False
    grown = np.repeat(out, 1 + stuff)
    grown[(np.flatnonzero(stuff) + 1 + np.arange(int(stuff.sum())))] = 0
    return grown, np.cumsum(room + np.add.reduceat(np.append(stuff, False).astype(np.int64), start) * (room > 0))


def segments(counts: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For scans of so many units: the segment of each unit, whether a segment ends its
    scan, and the number of its restart marker."""
    n = -(-counts // every)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = ragged(np.zeros(len(counts), np.int64), counts)
    place = ragged(np.zeros(len(n), np.int64), n)
    return (np.cumsum(n) - n)[owner] + inside // every, place == np.repeat(n, n) - 1, place % 8


def encode_scan(coef: np.ndarray, layout: Layout, scan: tuple) -> list[bytes]:
    """Entropy-coded data of one scan: for each image if it has all components, else for
    each component of each image.  coef [blocks, 64] is in zigzag order."""
    low, high, above, al = scan
    if low == 0:
        dc = coef[layout.mcu, 0].astype(np.int64)
        segment, last, restart = segments(layout.units, RESTART)
        scans = layout.units
        if above == 0:
            v = dc >> al
            first = np.append(True, segment[1:] != segment[:-1])
            shifted = np.concatenate([np.zeros((1, 3), np.int64), v[:-1, 3:]])
            shifted[first] = 0
            diff = v - np.stack([shifted[:, 0], v[:, 0], v[:, 1], v[:, 2], shifted[:, 1], shifted[:, 2]], 1)
            size = bit_length(diff)
            code, width = code_arrays(*DC_TABLE)
            extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
            value, bits = code[size] << size.astype(np.uint64) | extra, width[size] + size
        else:
            value, bits = ((dc >> al) & 1).astype(np.uint64), np.ones(dc.shape, np.int64)
        owner = np.repeat(segment, 6)
    else:
        scans = np.array([n for _, n in layout.components], np.int64)
        segment, last, restart = segments(scans, RESTART)
        c = coef[:, low : high + 1].astype(np.int64)
        code, width = code_arrays(*AC_TABLE)
        if above == 0:
            a = np.abs(c) >> al
            there = a > 0
            k = np.arange(c.shape[1])
            seen = np.maximum.accumulate(np.where(there, k, -1), 1)
            previous = np.concatenate([np.full((len(c), 1), -1), seen[:, :-1]], 1)
            run = k - previous - 1
            size = bit_length(a)
            symbol = np.where(there, (run & 15) << 4 | size, 0)
            extra = np.where(c < 0, (1 << size) - 1 - a, a).astype(np.uint64)
            value, bits = code[symbol] << size.astype(np.uint64) | extra, np.where(there, width[symbol] + size, 0)
            for z in (1, 2, 3):  # sixteen zeros each
                far = there & (run >= 16 * z)
                if far.any():
                    value[far] |= code[0xF0] << bits[far].astype(np.uint64)
                    bits[far] += width[0xF0]
            end = seen[:, -1:] < k[-1]
            value = np.concatenate([value, np.full((len(c), 1), code[0])], 1)
            bits = np.concatenate([bits, np.where(end, width[0], 0)], 1)
        else:
            a = np.abs(c) >> al
            value, bits = np.zeros(len(c), np.uint64), np.zeros(len(c), np.int64)
            held, held_n, run = np.zeros(len(c), np.uint64), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            one = np.uint64(1)
            for k in range(c.shape[1]):
                old, new = a[:, k] > 1, a[:, k] == 1
                held = np.where(old, held << one | (a[:, k] & 1).astype(np.uint64), held)
                held_n = held_n + old
                symbol = np.where(new, run << 4 | 1, 0)
                grow = width[symbol] + 1 + held_n
                more = (code[symbol] << one | (c[:, k] > 0).astype(np.uint64)) << held_n.astype(np.uint64) | held
                value = np.where(new, value << grow.astype(np.uint64) | more, value)
                bits = bits + np.where(new, grow, 0)
                run = np.where(new, 0, run + (a[:, k] == 0))
                held, held_n = np.where(new, np.uint64(0), held), np.where(new, 0, held_n)
            tail = (run > 0) | (held_n > 0)
            grow = width[0] + held_n
            value = np.where(tail, value << grow.astype(np.uint64) | code[0] << held_n.astype(np.uint64) | held, value)
            bits = bits + np.where(tail, grow, 0)
            value, bits = value[:, None], bits[:, None]
        owner = np.repeat(segment, value.shape[1])
    data, ends = pack(value.ravel(), bits.ravel(), owner, last, restart)
    cuts = np.append(0, ends[last]).tolist()
    data = data.tobytes()
    return [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def marker(kind: int, body: bytes) -> bytes:
    return bytes([255, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def table(slot: int, counts: list[int], symbols: list[int]) -> bytes:
    return marker(0xC4, bytes([slot, *counts, *symbols]))


_HEAD = bytes([255, 0xD8]) + marker(0xDB, bytes([0] + [1] * 64))
_TABLES = table(0x00, *DC_TABLE) + table(0x10, *AC_TABLE) + marker(0xDD, RESTART.to_bytes(2, "big"))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload: its bytes less 128 are the coefficients of the
    blocks, in zigzag order, Y blocks first; a comment holds the payload's length."""
    layout = Layout([geometry(len(p)) for p in payloads])
    coef = np.zeros((layout.blocks, 64), np.int16)
    flat = coef.reshape(-1)
    for p, at in zip(payloads, layout.first.tolist(), strict=False):
        flat[64 * at : 64 * at + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
    parts = [encode_scan(coef, layout, s) for s in SCANS]
    out = []
    for i, (p, (c, r)) in enumerate(zip(payloads, layout.shapes, strict=True)):
        size = (16 * r).to_bytes(2, "big") + (16 * c).to_bytes(2, "big")
        one = [_HEAD, marker(0xFE, b"payload %d" % len(p)), marker(0xC2, b"\x08" + size + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES]
        for (low, high, above, al), data in zip(SCANS, parts, strict=True):
            tail = bytes([low, high, above << 4 | al])
            if low == 0:
                one += [marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0]) + tail), data[i]]
            else:
                for k in range(3):
                    one += [marker(0xDA, bytes([1, k + 1, 0]) + tail), data[3 * i + k]]
        out.append(b"".join([*one, b"\xff\xd9"]))
    return out


_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def parse(image: bytes) -> dict:
    """Frame, comment and scans (components, band, tables, interval, data) of an image."""
    at, out, tables, every, quant = 2, {"scans": []}, {}, 0, {}
    while image[at + 1] != 0xD9:
        kind, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body, at = image[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xC2:
            out["shape"] = (int.from_bytes(body[3:5], "big") // 16, int.from_bytes(body[1:3], "big") // 16)
        elif kind == 0xDB:
            quant[body[0]] = np.frombuffer(body[1:65], np.uint8)
        elif kind == 0xC4:
            tables[body[0]] = body[1:]
        elif kind == 0xDD:
            every = int.from_bytes(body, "big")
        elif kind == 0xFE and body.startswith(b"payload "):
            out["payload"] = int(body[8:])
        elif kind == 0xDA:
            n = body[0]
            end = _END.search(image, at).start()
            low, high, bits = body[-3:]
            slot = body[2] >> 4 if low == 0 else 0x10 | (body[2] & 15)
            out["scans"].append(([body[1 + 2 * j] - 1 for j in range(n)], (low, high, bits >> 4, bits & 15), tables[slot], every, image[at:end]))
            at = end
    return out | {"quant": quant[0]}


class Bits:
    """Entropy-coded segments of many scans, without stuffed bytes and markers."""

    def __init__(self, scans: list[bytes]):
        raw = np.frombuffer(b"".join(scans), np.uint8)
        length = np.fromiter(map(len, scans), np.int64, len(scans))
        full = np.append(raw, 0)
        after = full[1:]
        high = raw == 255
        mark = high & (after >= 0xD0) & (after <= 0xD7)
        drop = mark.copy()
        drop[1:] |= high[:-1]  # a stuffed zero, or the marker's second byte
        scan_start = np.cumsum(length) - length
        cut = np.sort(np.concatenate([scan_start, np.flatnonzero(mark) + 2]))
        keep = np.append(0, np.cumsum(~drop))
        self.start = keep[cut] * 8  # bit positions of the segments
        self.scan = np.searchsorted(scan_start, cut, "right") - 1
        # with empty scans several start at one place; scans are never empty here
        data = np.concatenate([raw[~drop], np.full(8, 255, np.uint8)]).astype(np.uint32)
        self.word = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (up to 16; 0 gives 0) at each position."""
        w = self.word[at >> 3].astype(np.int64)
        return (w >> (32 - (at & 7) - n)) & ((1 << n) - 1)


def signed(v, s):
    return np.where(v < (1 << s) >> 1, v - (1 << s) + 1, v)


def decode_group(coef: np.ndarray, blocks: list[np.ndarray], comps: int, scan: tuple, lut: np.ndarray, every: int, bits: Bits) -> None:
    """Decode scans of one kind side by side, a symbol of every segment at a time, into
    coef [blocks, 64].  blocks: of each scan its blocks in coding order."""
    low, high, above, al = scan
    order = np.concatenate([b.ravel() for b in blocks]).astype(np.int64)
    count = np.fromiter((b.size for b in blocks), np.int64, len(blocks))
    step = (every or 1 << 40) * comps
    first_seg = np.searchsorted(bits.scan, np.arange(len(blocks)))
    nth = np.arange(len(bits.scan)) - first_seg[bits.scan]
    base = (np.cumsum(count) - count)[bits.scan] + nth * step
    size = np.clip(count[bits.scan] - nth * step, 0, step)
    at = bits.start.copy()
    flat = coef.reshape(-1)
    if low == 0 and above:
        k = ragged(np.zeros(len(size), np.int64), size)
        flat[order[ragged(base, size)] * 64] |= (bits.peek(np.repeat(at, size) + k, 1) << al).astype(coef.dtype)
        return
    t = np.zeros(len(at), np.int64)
    if low == 0:
        pred = np.zeros((len(at), 3), np.int64)
        rows = np.arange(len(at))
        for j in range(int(size.max())):
            go = rows[j < size]
            e = lut[bits.peek(at[go], 16)]
            s = (e & 255).astype(np.int64)
            p = at[go] + (e >> 8)
            c = 0 if comps == 1 else max(0, j % 6 - 3)
            pred[go, c] += signed(bits.peek(p, s), s)
            at[go] = p + s
            flat[order[base[go] + j] * 64] = pred[go, c] << al
        return
    if not above:
        k = np.full(len(at), low, np.int64)
        live = size > 0
        at, t, k, base, size = at[live], t[live], k[live], base[live], size[live]
        while len(at):
            e = lut[bits.peek(at, 16)]
            rs = (e & 255).astype(np.int64)
            p = at + (e >> 8)
            s = rs & 15
            run = rs >> 4
            v = signed(bits.peek(p, s), s)
            at = p + s
            k = k + run
            zero = s == 0
            if zero.any():
                z = np.flatnonzero(zero)
                eob = z[run[z] < 15]
                r = run[eob]
                t[eob] += (1 << r) + bits.peek(p[eob], r)
                at[eob] = p[eob] + r
                k[eob] = low
                far = z[run[z] == 15]
                k[far] += 1
                put = np.flatnonzero(~zero)
                flat[order[base[put] + t[put]] * 64 + k[put]] = v[put] << al
                k[put] += 1
            else:
                flat[order[base + t] * 64 + k] = v << al
                k = k + 1
            over = k > high
            t = t + over
            k[over] = low
            live = t < size
            if not live.all():
                at, t, k, base, size = at[live], t[live], k[live], base[live], size[live]
        return
    k, run, new, eob = np.full(len(at), low, np.int64), np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    live = size > 0
    at, t, k, run, new, eob, base, size = (x[live] for x in (at, t, k, run, new, eob, base, size))
    while len(at):
        ask = np.flatnonzero((run < 0) & (eob == 0))
        if len(ask):
            e = lut[bits.peek(at[ask], 16)]
            rs = (e & 255).astype(np.int64)
            p = at[ask] + (e >> 8)
            r, s = rs >> 4, rs & 15
            end = (s == 0) & (r < 15)
            more = np.where(end, r, s)
            got = bits.peek(p, more)
            at[ask] = p + more
            eob[ask] = np.where(end, (1 << r) + got, 0)
            run[ask] = np.where(end, -1, r)
            new[ask] = np.where(s == 1, np.where(got == 1, 1, -1), 0)
        i = order[base + t] * 64 + k
        c = flat[i].astype(np.int64)
        old = c != 0
        fix = old * bits.peek(at, 1)
        at = at + old
        place = ~old & (eob == 0) & (run == 0)
        flat[i] = c + np.sign(c) * (fix << al) + np.where(place, new << al, 0)
        run = np.where(old | (eob > 0), run, run - 1)
        k = k + 1
        over = k > high
        t = t + over
        k[over] = low
        run[over] = -1
        eob = eob - (over & (eob > 0))
        live = t < size
        if not live.all():
            at, t, k, run, new, eob, base, size = (x[live] for x in (at, t, k, run, new, eob, base, size))


def decode(images: list[bytes]) -> tuple[list[bytes], np.ndarray, Layout, np.ndarray]:
    """Payloads, coefficients (zigzag), layout and quantisation of a batch of images."""
    parsed = [parse(x) for x in images]
    layout = Layout([p["shape"] for p in parsed])
    coef = np.zeros((layout.blocks, 64), np.int16)
    unit_start = np.cumsum(layout.units) - layout.units
    for n in range(max(len(p["scans"]) for p in parsed)):
        groups: dict = {}
        for i, p in enumerate(parsed):
            if n < len(p["scans"]):
                comps, scan, tab, every, data = p["scans"][n]
                if len(comps) > 1:
                    where = layout.mcu[unit_start[i] : unit_start[i] + layout.units[i]]
                else:
                    first, count = layout.components[3 * i + comps[0]]
                    where = np.arange(first, first + count)
                groups.setdefault((len(comps), scan, bytes(tab), every), []).append((where, data))
        for (comps, scan, tab, every), members in groups.items():
            lut = lookup(list(tab[:16]), list(tab[16:]))
            decode_group(coef, [w for w, _ in members], 6 if comps > 1 else 1, scan, lut, every, Bits([d for _, d in members]))
    flat = (coef.reshape(-1) + 128).astype(np.uint8)
    payloads = [flat[64 * at : 64 * at + p["payload"]].tobytes() for p, at in zip(parsed, layout.first.tolist(), strict=False)]
    return payloads, coef, layout, np.stack([p["quant"] for p in parsed])


def pixels(coef: np.ndarray, layout: Layout, quant: np.ndarray) -> np.ndarray:
    """RGB of each 16 x 16 unit, [units, 16, 16, 3]: inverse transform, chroma doubled in
    both directions, colours converted."""
    natural = (coef * quant[np.repeat(np.arange(len(layout.units)), 6 * layout.units)])[:, _NATURAL].astype(np.float32).reshape(-1, 8, 8)
    plane = np.matmul(np.matmul(_COS.T, natural), _COS)
    y = plane[layout.mcu[:, :4]].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    cb, cr = (plane[layout.mcu[:, j]].repeat(2, 1).repeat(2, 2) for j in (4, 5))
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 3)
    return np.clip(np.rint(rgb + 128), 0, 255).astype(np.uint8)


def payload_of(text) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def roundtrip(payloads: list[bytes], tensors: bool) -> list[tuple]:
    """(stored form, payload read back, feature, tensors) of each payload."""
    parts = [[p[i : i + PART] for i in range(0, len(p), PART)] for p in payloads]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    images = encode([x for p in parts for x in p])
    back, coef, layout, quant = decode(images)
    rgb = pixels(coef, layout, quant)
    ends = np.cumsum(layout.units)
    got: list = [[b"", [], [], []] for _ in payloads]
    for i, (image, payload, o) in enumerate(zip(images, back, owner.tolist(), strict=True)):
        c, r = layout.shapes[i]
        full = rgb[ends[i] - c * r : ends[i]].reshape(r, c, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * r, 16 * c, 3)
        got[o][0] += image
        got[o][1].append(payload)
        means = full.reshape(-1, 3).mean(0, dtype=np.float64)
        raw = np.ascontiguousarray(full)
        got[o][2].append(f"{16 * r}x{16 * c}:{means[0]:.3f},{means[1]:.3f},{means[2]:.3f}:{zlib.crc32(raw):08x}")
        if tensors:
            got[o][3].append((16 * r, 16 * c, raw.tobytes()))
    return [(stored, b"".join(payload), "|".join(feature), tensor) for stored, payload, feature, tensor in got]


def media(docs: DataFrame, tensors: bool = False) -> DataFrame:
    """Digests of every text stored as progressive JPEG and read back; with tensors also
    the stored form and the RGB tensors (height, width, bytes).

    A text's UTF-8 bytes, padded with blanks to a positive multiple of UNIT, are the
    coefficients of the image; scans by spectral selection and successive approximation
    hold them losslessly.  Reading accumulates the scans, inverse-transforms, doubles
    chroma and makes full-resolution RGB, from which the feature comes.  Null is empty:
    UNIT blanks.  Equal texts have equal values; doc_id may be null or repeat; an empty
    table gives no rows.  A text over PART bytes is a row of images.
    """
    small_batches(docs.sparkSession, 500)
    schema = "doc_id long, no_id boolean, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if tensors:
        schema += ", stored binary, tensors array<struct<height:int,width:int,rgb:binary>>"

    def run(batches):
        for pdf in batches:
            for a, b in chunks(pdf, size=1 << 20):
                part = pdf.iloc[a:b]
                texts = part["text"].tolist()
                rows = []
                for t, i, (stored, payload, feature, tensor) in zip(texts, part["doc_id"], roundtrip([payload_of(t) for t in texts], tensors), strict=True):
                    size = len((t or "").encode("utf-8", "surrogatepass"))
                    row = (i, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
                    rows.append(row + ((stored, tensor) if tensors else ()))
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stored", "tensors"]
                out = pd.DataFrame(rows, columns=names[: 10 if tensors else 8])
                out.insert(1, "no_id", part["no_id"].to_numpy())
                yield out

    return null_ids(whole_ids(docs.select("doc_id", "text")).mapInPandas(tidy(run), schema))
