"""Copies of images by local descriptors: cropped, scaled, turned, brightened or otherwise edited copies share corners in the same arrangement.

Corners (Harris) are found at scales a factor STEP apart; around each, its orientation is that of the intensity centroid, and 128 comparisons of
smoothed pixels turned by it are its bits. Hamming tables find corners that look alike: each of TABLES tables is keyed by KEY_BITS of the bits, and corners of
a cell that differ in RADIUS bits at most are matched. Matches are collected by pair of images, and a pair is linked if its matches agree on one
similarity transform (turn, scale, shift): AGREE corners at least must lie where it puts them, spread over SPREAD of the smaller image. A patch that
two images share is therefore not enough.

Copies are found twice. First, in LEAD_TABLES of the tables, a corner is matched to the first by row that it is near, so a class of n copies gives some n
matches and not their square; this finds the bulk of the large classes. Then, in all tables, every pair of corners of a cell is held against RADIUS
unless their images are in one class already: so no pair of images is left out because its corners are nearer to those of a third one. Pairs of corners
that share several cells are matched in the first of their tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _common as C
from quire.llm.components import components

#: Factor between scales, half width of a descriptor's patch, pixels between compared points, bits of a corner, turns that are told apart.
STEP, PATCH, SPAN, BITS, TURNS = 1.2, 11, 5, 128, 64
#: A corner's response against the strongest of its image and scale; responses this small are noise; pixels that a corner is the strongest in.
RELATIVE, FLOOR, APART = 0.01, 1e3, 3
#: Tables, bits of a key, bits of 128 that may differ in a match.
TABLES, KEY_BITS, RADIUS = 8, 22, 18
#: Tables of the first search, which only spares the second one the pairs of large classes.
LEAD_TABLES = 2
#: Corners that must agree, part of the smaller image's area that they must span, pixels at a corner's scale that they may be off.
AGREE, SPREAD, OFF = 6, 0.25, 2.5
#: Sides of an image, at most: larger ones are halved until they fit. Bytes of pixels that are decoded, at most.
MOST_SIDE, MOST_BYTES = 8191, 1 << 28
CELL_BLOCK = 4096
#: Pairs of corners that are compared at a time; matches that are dealt out at a time, and parts that they are dealt to, at least.
PAIRS_AT_ONCE, MATCHES_AT_ONCE, BUCKETS = 1 << 19, 1 << 20, 32


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey pixels (0 to 255) of a PGM or PPM (P5, P6; 8 or 16 bits) or a PNG (any depth, palettes and interlacing too); None for anything else.

    Images of more than MOST_BYTES of pixels are not decoded.
    """
    try:
        if raw and raw[:2] in (b"P5", b"P6"):
            return _pnm(raw)
        if raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (ValueError, IndexError, KeyError, zlib.error):
        return None
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    colour = pixels.shape[2]
    grey = pixels[:, :, 0].astype(np.float32) if colour < 3 else (pixels[:, :, :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)).round()
    while max(grey.shape) > MOST_SIDE:
        h, w = (max(2, n // 2 * 2) for n in grey.shape)
        grey = np.resize(grey, (max(2, grey.shape[0]), max(2, grey.shape[1])))[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))
    return grey


def _pnm(raw: bytes) -> np.ndarray | None:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    width, height, most = fields
    colour = 3 if raw[1:2] == b"6" else 1
    kind = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
    n = width * height * colour
    if not 0 < most < 65536 or width < 1 or height < 1 or n > MOST_BYTES or len(raw) < at + 1 + n * kind.itemsize:
        return None
    body = np.frombuffer(raw, kind, n, at + 1).reshape(height, width, colour)
    return _grey(body if most == 255 else body.astype(np.float32) * (255.0 / most))


def _unfilter(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the rows of a PNG from their filtered form; ``step`` bytes are a pixel."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = rows[y]
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            now = line + above
        else:
            bytes_of, up, now = line.tolist(), above.tolist(), bytearray(len(line))
            for x, value in enumerate(bytes_of):
                a, b = (now[x - step], up[x]) if x >= step else (0, up[x])
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                now[x] = (value + guess) & 255
            now = np.frombuffer(bytes(now), np.uint8)
        out[y] = above = now
    return out


#: First pixel and distance of the pixels of each pass of an interlaced PNG, x and y; fixed values of the format.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png(raw: bytes) -> np.ndarray | None:
    at, data, head, palette = 8, [], None, None
    while at + 8 <= len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None:
        return None
    width, height, depth = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8]
    colour = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[9]]
    if width < 1 or height < 1 or width * height * colour * max(1, depth // 8) > MOST_BYTES or depth not in (1, 2, 4, 8, 16):
        return None
    unpack = zlib.decompressobj()
    flat = unpack.decompress(b"".join(data), 2 * MOST_BYTES)
    out, used = np.zeros((height, width, colour), np.uint16), 0
    for x0, y0, dx, dy in _PASSES if head[12] else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w < 1 or h < 1:
            continue
        line = 1 + -(-w * colour * depth // 8)
        rows = np.frombuffer(flat, np.uint8, h * line, used).reshape(h, line)
        used += h * line
        values = _unfilter(np.ascontiguousarray(rows[:, 1:]), rows[:, 0], max(1, colour * depth // 8))
        if depth < 8:
            bits = np.unpackbits(values, axis=1).reshape(h, -1, depth)
            values = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint16)
        elif depth == 16:
            values = values.reshape(h, -1, 2)[:, :, 0]  # the upper byte
        out[y0::dy, x0::dx] = values[:, : w * colour].reshape(h, w, colour)
    if head[9] == 3:
        return _grey(palette[out[:, :, 0]])
    return _grey(out if depth >= 8 else out * (255.0 / (2**depth - 1)))


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1 of a stack of images, edges repeated."""
    padded = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").astype(np.float64)
    s = padded.cumsum(axis=1).cumsum(axis=2)
    k = 2 * r + 1
    return ((s[:, k:, k:] - s[:, :-k, k:] - s[:, k:, :-k] + s[:, :-k, :-k]) / (k * k)).astype(np.float32)


def _resize(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """A stack of images at another size, bilinear."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(at.astype(np.int64), max(0, n - 2))
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    y0, y1, fy = axis(stack.shape[1], height)
    x0, x1, fx = axis(stack.shape[2], width)
    rows = stack[:, y0] * (1 - fy)[None, :, None] + stack[:, y1] * fy[None, :, None]
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def _tests() -> np.ndarray:
    """(turn, bit, 2 points, xy): offsets of the comparisons for each turn, from a fixed seed: two points SPAN apart, anywhere in the patch."""
    r = np.random.default_rng(20)
    far, at, along = np.sqrt(r.random(BITS)) * (PATCH - SPAN / 2), r.uniform(0, 2 * np.pi, BITS), r.uniform(0, 2 * np.pi, BITS)
    centre, half = (np.stack([np.cos(a), np.sin(a)], 1) * length for a, length in ((at, far[:, None]), (along, SPAN / 2)))
    points = np.stack([centre - half, centre + half], 1)  # bit, point, xy
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], -1), np.stack([np.sin(angle), np.cos(angle)], -1)], -2)
    return np.rint(np.einsum("tij,bpj->tbpi", turn, points)).astype(np.int64)


_TESTS = _tests()
_DISC = np.array([(x, y) for y in range(-PATCH, PATCH + 1) for x in range(-PATCH, PATCH + 1) if x * x + y * y <= PATCH * PATCH])
#: The bits that key each table.
_KEYS = [np.sort(np.random.default_rng(30 + k).choice(BITS, KEY_BITS, replace=False)) for k in range(TABLES)]
_KEY_MASKS = np.packbits(np.array([np.isin(np.arange(BITS), chosen) for chosen in _KEYS]), axis=1).view(np.uint64)


def corners(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of images of one size: image, x, y, turn (angle in 64ths) and bits (corners x 128) of each corner at this scale."""
    n, height, width = stack.shape
    if min(height, width) < 2 * PATCH + 3:
        return (*(np.empty(0, np.int64) for _ in range(4)), np.empty((0, BITS), np.uint8))
    smooth = _box(stack, 1)
    gy, gx = np.gradient(smooth, axis=(1, 2))
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    best = response
    for axis in (1, 2):  # the strongest of a square, one direction after the other
        padded = np.pad(best, [(0, 0)] + [(APART, APART) if axis == k else (0, 0) for k in (1, 2)], constant_values=-np.inf)
        size = best.shape[axis]
        best = np.maximum.reduce([np.take(padded, np.arange(d, d + size), axis=axis) for d in range(2 * APART + 1)])
    strong = np.maximum(FLOOR, RELATIVE * response.max(axis=(1, 2)))[:, None, None]
    inner = (slice(None), slice(PATCH, height - PATCH), slice(PATCH, width - PATCH))
    image, y, x = np.nonzero((response[inner] == best[inner]) & (response[inner] > strong))
    y, x = y + PATCH, x + PATCH
    disc = smooth[image[:, None], y[:, None] + _DISC[:, 1], x[:, None] + _DISC[:, 0]]
    angle = np.arctan2((disc * _DISC[:, 1]).sum(axis=1), (disc * _DISC[:, 0]).sum(axis=1))
    turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
    at = _TESTS[turn]  # corner, bit, point, xy
    values = smooth[image[:, None, None], np.clip(y[:, None, None] + at[..., 1], 0, height - 1), np.clip(x[:, None, None] + at[..., 0], 0, width - 1)]
    return image, x, y, turn, (values[:, :, 0] < values[:, :, 1]).astype(np.uint8)


def pack_place(x: np.ndarray, y: np.ndarray, level: np.ndarray, turn: np.ndarray, width: int, height: int) -> np.ndarray:
    """A corner's place in its image, its scale and turn, and the image's size, in one integer."""
    return ((((x * 8192 + y) * 64 + level) * 64 + turn) * 4096 + np.minimum(width >> 1, 4095)) * 4096 + np.minimum(height >> 1, 4095)


def unpack_place(place: np.ndarray) -> np.ndarray:
    """Columns x, y, level, turn, width, height of packed places."""
    parts = []
    for size in (4096, 4096, 64, 64, 8192):
        place, part = np.divmod(place, size)
        parts.append(part)
    height, width, turn, level, y = parts
    return np.stack([place, y, level, turn, 2 * width, 2 * height], 1)


def describe(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """image, packed place and bits (16 bytes) of the corners of images of one size, at all scales that a patch fits in."""
    _, height, width = stack.shape
    out, now, level = [], stack.astype(np.float32), 0
    while min(now.shape[1:]) >= 2 * PATCH + 3 and level < 64:
        image, x, y, turn, bits = corners(now)
        fx, fy = width / now.shape[2], height / now.shape[1]
        px, py = (np.rint((c + 0.5) * f - 0.5).astype(np.int64) for c, f in ((x, fx), (y, fy)))
        out.append((image, pack_place(px, py, np.full(len(x), level), turn, width, height), np.packbits(bits, axis=1)))
        level += 1
        h, w = (int(round(n / STEP**level)) for n in (height, width))
        if min(h, w) < 2 * PATCH + 3:
            break
        now = _resize(_box(now, 1) * 0.4 + now * 0.6, h, w).astype(np.float32)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, BITS // 8), np.uint8)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether matched corners (packed places) of two images lie as one similarity transform puts them.

    Each match with some others in turn gives a transform; it holds for the matches that it puts within OFF pixels at their scale and whose own
    turns and scales it fits. Distinct corners of either image count.
    """
    a, b = np.unique(np.stack([a, b], 1), axis=0).T
    if len(a) < AGREE:
        return False
    p, q = unpack_place(a), unpack_place(b)
    small = p if p[0, 4] * p[0, 5] <= q[0, 4] * q[0, 5] else q
    area = SPREAD * small[0, 4] * small[0, 5]
    z, w = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    ratio = STEP ** (q[:, 2] - p[:, 2]).astype(float)
    turned = np.exp(2j * np.pi * (q[:, 3] - p[:, 3]) / TURNS)
    slack = OFF * np.maximum(STEP ** q[:, 2].astype(float), ratio * STEP ** p[:, 2].astype(float))
    by_distance = np.argsort(np.abs(z[:, None] - z), axis=1, kind="stable")
    m = len(z)
    partners = by_distance[:, sorted({m - 1, m - 1 - m // 8, m - 1 - m // 4, m - 1 - m // 2, max(1, m // 4)})]
    i, j = np.repeat(np.arange(m), partners.shape[1]), partners.reshape(-1)
    apart = np.abs(z[i] - z[j]) >= 4
    i, j = i[apart], j[apart]
    factor = (w[j] - w[i]) / (z[j] - z[i])
    size = np.abs(factor)
    fits = (size > 0) & (np.abs(np.log(np.maximum(size, 1e-9) / ratio[i])) < 0.35) & ((factor / np.maximum(size, 1e-9) * np.conj(turned[i])).real > 0.85)
    for k in np.flatnonzero(fits):
        off = np.abs(w[i[k]] + factor[k] * (z - z[i[k]]) - w)
        good = (off <= slack) & (np.abs(np.log(size[k] / ratio)) < 0.35) & ((factor[k] / size[k] * np.conj(turned)).real > 0.85)
        if min(len(np.unique(z[good])), len(np.unique(w[good]))) < AGREE:
            continue
        x, y = small[good, 0], small[good, 1]
        if (np.ptp(x) + 2 * PATCH) * (np.ptp(y) + 2 * PATCH) >= area and min(np.ptp(x), np.ptp(y)) > 2:
            return True
    return False


POINT_SCHEMA = "row bigint, place bigint, a bigint, b bigint"


def _describe(batches: Iterator[pa.RecordBatch], most_pixels: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, by_size = batch.column(0).to_numpy(), {}

        def settle(group: list) -> pa.RecordBatch:
            image, place, bits = describe(np.stack([p for _, p in group]))
            of = rows[np.array([k for k, _ in group])[image]]
            codes = np.ascontiguousarray(bits).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(of), pa.array(place), pa.array(codes[:, 0]), pa.array(codes[:, 1])], names=["row", "place", "a", "b"])

        for k, raw in enumerate(batch.column(1)):
            if (pixels := decode(raw.as_py())) is not None:
                group = by_size.setdefault(pixels.shape, [])
                group.append((k, pixels))
                if len(group) * pixels.size >= most_pixels:
                    yield settle(by_size.pop(pixels.shape))
        for group in by_size.values():
            yield settle(group)


def _tables(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.stack([batch.column(c).to_numpy() for c in ("a", "b")], 1)
            bits = np.unpackbits(codes.view(np.uint8).reshape(len(codes), -1), axis=1)
            for k, chosen in enumerate(_KEYS[:tables]):
                cell = bits[:, chosen].astype(np.int64) @ (np.int64(1) << np.arange(KEY_BITS, dtype=np.int64)) * TABLES + k
                number = pa.array(np.full(len(cell), k, np.int8))
                yield pa.RecordBatch.from_arrays([pa.array(cell), number, *batch.columns], names=["cell", "k", *batch.schema.names])

    return run


def leaders(row: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each corner of a cell the first by row that differs in RADIUS bits at most, itself where there is none before it."""
    first = np.arange(len(row))
    order = np.argsort(row, kind="stable")
    left = order
    while len(left) > 1:
        lead = left[0]
        near = np.bitwise_count(codes[left] ^ codes[lead]).sum(axis=1) <= RADIUS
        first[left[near]] = lead
        left = left[~near]
    return first


def _whole_cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of rows in order of cell, and their bits, some whole cells at a time; the first name is that of the cell."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([batch.column(c).to_numpy() for c in ("a", "b")], 1).view(np.uint64)
        columns = [*(batch.column(c).to_numpy() for c in names), codes]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        last = int(np.searchsorted(columns[0], columns[0][-1], side="left"))  # the last cell may go on in the next batch
        if last:
            yield [c[:last] for c in columns]
        held = [c[last:] for c in columns]
    if held is not None:
        yield held


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell, row, place, codes in _whole_cells(batches, ["cell", "row", "place"]):
        first = np.arange(len(cell))
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        ends = np.append(starts[1:], len(cell))
        pair = starts[ends - starts == 2]  # most shared cells have two
        if len(pair):
            near = np.bitwise_count(codes[pair] ^ codes[pair + 1]).sum(axis=1) <= RADIUS
            first[pair[near] + 1] = pair[near]
        more = ends - starts > 2
        for lo, hi in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            first[lo:hi] = lo + leaders(row[lo:hi], codes[lo:hi])
        other = np.flatnonzero(row[first] != row)
        u, v = other, first[other]
        flip = row[u] < row[v]
        u, v = np.where(flip, v, u), np.where(flip, u, v)
        yield pa.RecordBatch.from_arrays([pa.array(row[u]), pa.array(row[v]), pa.array(place[u]), pa.array(place[v])], names=["u", "v", "pu", "pv"])


def near_pairs(cell: np.ndarray, k: np.ndarray, group: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of corners of a cell that differ in RADIUS bits at most and are of two groups, if no table before theirs (``k``) has them in one cell.

    Rows are in order of cell. Pairs are counted out some PAIRS_AT_ONCE at a time, those of one group not at all.
    """
    order = np.lexsort((group, cell))
    cell, k, group, codes = cell[order], k[order], group[order], codes[order]
    n = len(cell)
    new_cell = np.concatenate([[True], cell[1:] != cell[:-1]])
    new_run = new_cell | np.concatenate([[True], group[1:] != group[:-1]])
    until = lambda new: np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
    run_end, cell_end = until(new_run), until(new_cell)
    total = np.concatenate([[0], np.cumsum(cell_end - run_end)])
    a = 0
    while a < n and total[a] < total[n]:
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS_AT_ONCE, side="right")) - 1)
        i = np.repeat(np.arange(a, b), np.diff(total[a : b + 1]))
        j = run_end[i] + total[a] + np.arange(len(i)) - total[i]
        a = b
        apart = codes[i] ^ codes[j]
        near = np.bitwise_count(apart).sum(axis=1) <= RADIUS
        i, j, apart = i[near], j[near], apart[near]
        first = np.ones(len(i), bool)
        for table in range(TABLES - 1):
            first &= (k[i] <= table) | ((apart & _KEY_MASKS[table]) != 0).any(axis=1)
        if first.any():
            yield order[i[first]], order[j[first]]


def _match(buckets: int):
    """Matches (u, v, places) of rows in order of cell, dealt to buckets by pair of images and packed: a shuffled row is a blob of many."""

    def settle(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        u, v, pu, pv = np.concatenate(found, axis=1)
        to = ((u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ v.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.lexsort((v, u, to))
        rows, to = np.stack([u, v, pu, pv])[:, order], to[order]
        starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        parts = np.split(rows, starts[1:], axis=1)
        blobs = [pa.compress(np.ascontiguousarray(part).tobytes(), "zstd", asbytes=True) for part in parts]
        sizes = [part.shape[1] for part in parts]
        yield pa.RecordBatch.from_arrays([pa.array(to[starts]), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "n", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for cell, k, row, place, group, codes in _whole_cells(batches, ["cell", "k", "row", "place", "group"]):
            for i, j in near_pairs(cell, k, group, codes):
                i, j = np.where(row[i] > row[j], i, j), np.where(row[i] > row[j], j, i)
                found.append(np.stack([row[i], row[j], place[i], place[j]]))
                held += len(i)
                if held >= MATCHES_AT_ONCE:
                    yield from settle(found)
                    found, held = [], 0
        if found:
            yield from settle(found)

    return run


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of packed matches: rows in order of bucket. Images that a bucket's links have joined already are not held against each other again."""

    def settle(held: list[np.ndarray]) -> pa.RecordBatch:
        u, v, pu, pv = np.concatenate(held, axis=1)
        order = np.lexsort((v, u))
        u, v, pu, pv = u[order], v[order], pu[order], pv[order]
        starts = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
        sizes, stars = np.diff(np.append(starts, len(u))), C.Stars()
        for at, n in zip(starts[sizes >= AGREE].tolist(), sizes[sizes >= AGREE].tolist(), strict=True):
            x, y = int(u[at]), int(v[at])
            if stars.root(x) != stars.root(y) and agree(pu[at : at + n], pv[at : at + n]):
                stars.join(x, y)
        rows = np.array(stars.rows(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["u", "v"])

    bucket, held = None, []
    for batch in batches:
        for to, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if to != bucket:
                if held:
                    yield settle(held)
                bucket, held = to, []
            held.append(np.frombuffer(pa.decompress(blob.as_buffer(), 32 * n, "zstd", asbytes=True), np.int64).reshape(4, n))
    if held:
        yield settle(held)


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [agree(np.array([m["pu"] for m in found], np.int64), np.array([m["pv"] for m in found], np.int64)) for found in batch.column("found").to_pylist()]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def image_copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """One row for each row: image_id, n_corners, class_id (the smallest id among the copies that links reach, itself included).

    Images of equal bytes are described once and are copies of each other. What can't be decoded (null and empty too) has no corners and is
    a copy only of equal bytes; rows without an id name no class (a class of them alone is null). An empty table gives no rows.
    """
    spark = images.sparkSession
    kind = dict(images.dtypes)[id_col]
    rows = images.select(F.col(id_col).alias("image_id"), F.unhex(F.sha2(F.coalesce(F.col(image_col), F.lit(b"")), 256)).alias("digest"), F.col(image_col).alias("image"))
    ids = C.materialize(rows.select("image_id", "digest"), "image_ids")
    own = C.materialize(ids.groupBy("digest").agg(F.min("image_id").alias("least")).withColumn("row", F.monotonically_increasing_id()), "digests")
    # one row of each distinct image is described: partial aggregation drops copies before anything is moved
    distinct = rows.filter("image is not null and octet_length(image) > 0").groupBy("digest").agg(F.first("image").alias("image"))
    described = distinct.join(own.select("digest", "row"), "digest").select("row", "image").mapInArrow(_describe, POINT_SCHEMA)
    points = C.materialize(described, "points")
    n = C.partitions_of(spark)
    # first each corner to one that is near, where corners with equal bits are one point
    merged = points.groupBy("a", "b").agg(F.min(F.struct("row", "place")).alias("first"))
    leading = merged.select("first.row", "first.place", "a", "b").mapInArrow(_tables(LEAD_TABLES), "cell bigint, k tinyint, " + POINT_SCHEMA).drop("k")
    dealt = C.split_large_cells(leading, ["a", "b"], CELL_BLOCK).repartition(n, "cell").sortWithinPartitions("cell")
    matches = dealt.mapInArrow(_lead, "u bigint, v bigint, pu bigint, pv bigint")
    pairs = matches.groupBy("u", "v").agg(F.collect_set(F.struct("pu", "pv")).alias("found")).filter(f"size(found) >= {AGREE}")
    bulk = components(pairs.select("u", "v", "found").mapInArrow(_consensus, "u bigint, v bigint"))
    # then every pair of near corners of two classes
    grouped = points.join(bulk.select(F.col("u").alias("row"), F.col("v").alias("group")), "row", "left").withColumn("group", F.coalesce("group", "row"))
    tables = grouped.mapInArrow(_tables(TABLES), "cell bigint, k tinyint, " + POINT_SCHEMA + ", group bigint")
    dealt = C.split_large_cells(tables, ["a", "b", "row", "place"], CELL_BLOCK).repartition(n, "cell").sortWithinPartitions("cell")
    packed = dealt.mapInArrow(_match(max(n, BUCKETS)), "bucket bigint, n bigint, blob binary")
    agreed = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_agreed, "u bigint, v bigint")
    stars = components(bulk.unionByName(agreed))
    rooted = own.join(stars.select(F.col("u").alias("row"), "v"), "row", "left").withColumn("root", F.coalesce("v", "row"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "root")
    counted = named.join(points.groupBy("row").agg(F.count("*").alias("n_corners")), "row", "left")
    return ids.join(counted.select("digest", "class_id", F.coalesce("n_corners", F.lit(0)).alias("n_corners")), "digest").select(F.col("image_id").cast(kind).alias("image_id"), "n_corners", "class_id")


def _paint(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textures: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for vector in batch.column(1):
                values = np.nan_to_num(np.array([v if v is not None else 0.0 for v in vector.as_py() or []], np.float32))
                n = len(values)
                if n and n not in textures:
                    noise = np.random.default_rng(n).normal(size=(n, side, side)).astype(np.float32)
                    textures[n] = _box(_box(noise, 2), 2).reshape(n, -1)
                if not n:
                    out.append(None)
                    continue
                pixels = values @ textures[n]
                grey = np.clip(np.rint(128 + 48 * (pixels - pixels.mean()) / (pixels.std() or 1.0)), 0, 255).astype(np.uint8)
                out.append(b"P5\n%d %d\n255\n" % (side, side) + grey.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["image_id", "image"])

    return run


def paint(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 64) -> DataFrame:
    """Vectors as images, for tables that have no media column: a mix of fixed textures, one a value, as PGM bytes. Null or empty vectors have none."""
    rows = vectors.select(F.col(id_col).alias("image_id"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(_paint(side), f"image_id {dict(vectors.dtypes)[id_col]}, image binary")
