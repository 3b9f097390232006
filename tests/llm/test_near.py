import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quire.llm import media, near_copies, simhash
from quire.llm.components import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_fingerprints_and_components(docs, corpus):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(r[1]) for r in corpus]
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.fp % 2**64) for r in got) == sorted((r[0] if r[0] is not None else -1, p) for r, p in zip(corpus, prints, strict=True))
    n = len(corpus)
    root = classes(n, [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for r, c in zip(corpus, root, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    expected = sorted((r[0], least[c]) for r, c in zip(corpus, root, strict=True) if r[0] is not None)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == expected
    assert {r.component_id for r in got if r.doc_id in (203, 205)} == {203}


@pytest.mark.parametrize("block", [8192, 20])
def test_no_link_is_lost(spark, block):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:20].tolist():
        for _ in range(12):
            x = b
            for k in r.integers(0, 64, r.integers(1, 7)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    got = components(simhash.links(df, block=block)).collect()
    root = classes(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    group = {}
    for x, c in zip(fps, root, strict=True):
        group.setdefault(c, set()).add(x)
    found = {}
    for row in got:
        found.setdefault(row.v, {row.v % 2**64}).add(row.u % 2**64)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in group.values() if len(g) > 1)


def test_manhattan_is_a_lower_bound():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 3000, dtype=np.uint64), r.integers(0, 2**63, 3000, dtype=np.uint64)
    c = [sum(abs((int(x) >> s & 3).bit_count() - (int(y) >> s & 3).bit_count()) for s in range(0, 64, 2)) for x, y in zip(a, b, strict=True)]
    got = simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b))
    assert got.tolist() == c and (got <= np.bitwise_count(a ^ b)).all()


def test_drop_near_duplicates(docs, empty, corpus):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs).filter("doc_id is not null").collect()
    nulls = sum(r[0] is None for r in corpus)
    assert kept.count() == len({r.component_id for r in found}) + nulls
    assert simhash.drop_near_duplicates(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def jaccard(a, b):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return {" ".join(w[k : k + 5]).lower() for k in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("block", [512, 7])
def test_near_copies_are_all_pairs_of_similarity(spark, block):
    r = np.random.default_rng(8)
    rows = []
    for g in range(30):
        base = [f"w{x}" for x in r.integers(0, 5000, int(r.integers(40, 300)))]
        for _ in range(12):
            w = list(base)
            for k in r.integers(0, len(w), int(r.integers(0, 1 + len(w) // 25))):
                w[k] = f"x{r.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, " "), (1002, "one two"), (1003, "One two"), (1004, "one two three"), (None, rows[0][1] + " end"), (None, "without an id here at all")]
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect() if x.doc_id is not None}
    links = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    root = classes(len(rows), links)
    assert got == {row[0]: rows[c][0] for row, c in zip(rows, root, strict=True) if row[0] is not None}
    direct = sum((brute_fingerprint(rows[a][1]) ^ brute_fingerprint(rows[b][1])).bit_count() <= 4 for a, b in links)
    assert direct < len(links) / 2  # 4 bits of the fingerprint are not the rule of the stage


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    other = [*words[:60], "a", *words[61:130], "b", *words[131:]]
    assert (brute_fingerprint(" ".join(words)) ^ brute_fingerprint(" ".join(other))).bit_count() > 4 and jaccard(" ".join(words), " ".join(other)) >= 0.8
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id bigint, text string")
    assert [x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [1]


def test_components_of_paths_and_hubs(spark):
    links = [(k, k + 1) for k in range(50)] + [(1000, 1001 + k) for k in range(300)] + [(5, 5), (2000, 1999), (1999, 2000)]
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(1, 51)} | {k: 1000 for k in range(1001, 1301)} | {2000: 1999}


def pgm(x):
    return b"P5\n# made here\n%d %d\n255\n" % x.shape[::-1] + x.astype(np.uint8).tobytes()


def png(x):
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    rows, last = b"", np.zeros(x.shape[1], np.int64)
    for k, line in enumerate(x.astype(np.int64)):
        left = np.concatenate([[0], line[:-1]])
        corner = np.concatenate([[0], last[:-1]])
        p = left + last - corner
        d = [np.abs(p - v) for v in (left, last, corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], last, corner))
        guess = [0, left, last, (left + last) // 2, paeth][k % 5]
        rows += bytes([k % 5]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        last = line
    head = x.shape[1].to_bytes(4, "big") + x.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def scene(r, n=160):
    """Rectangles and discs of any grey, softened, with a little noise."""
    image = np.full((n, n), r.uniform(60, 190), np.float32)
    yy, xx = np.ogrid[:n, :n]
    for _ in range(60):
        (x, y), (w, h) = r.integers(0, n, 2), r.integers(6, 50, 2)
        image[y : y + h, x : x + w] = r.uniform(0, 255)
    for _ in range(25):
        x, y, radius = r.integers(0, n), r.integers(0, n), r.integers(4, 20)
        image[(xx - x) ** 2 + (yy - y) ** 2 <= radius * radius] = r.uniform(0, 255)
    return grey(media._box(image[None], 1)[0] + r.normal(0, 2, (n, n)))


def grey(x):
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def turned(image, angle, scale):
    n, m, a = len(image), int(round(len(image) * scale)), np.deg2rad(angle)
    yy, xx = (np.mgrid[:m, :m] - (m - 1) / 2) / scale
    x, y = np.cos(a) * xx + np.sin(a) * yy + (n - 1) / 2, -np.sin(a) * xx + np.cos(a) * yy + (n - 1) / 2
    x0, y0 = (np.clip(np.floor(c).astype(int), 0, n - 2) for c in (x, y))
    fx, fy, image = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1), image.astype(float)
    out = (image[y0, x0] * (1 - fx) + image[y0, x0 + 1] * fx) * (1 - fy) + (image[y0 + 1, x0] * (1 - fx) + image[y0 + 1, x0 + 1] * fx) * fy
    return grey(np.where((x < 0) | (y < 0) | (x > n - 1) | (y > n - 1), 0, out))


EDITS = {
    "crop to half the area": lambda i, r: i[20:132, 30:142],
    "noise": lambda i, r: grey(i + r.normal(0, 8, i.shape)),
    "contrast": lambda i, r: grey(i * 0.6 + 20),
    "blur": lambda i, r: grey(media._box(i[None], 1)[0]),
    "16 greys": lambda i, r: i // 16 * 16,
    "half": lambda i, r: turned(i, 0, 0.5),
    "scale 0.8": lambda i, r: turned(i, 0, 0.8),
    "scale 1.25": lambda i, r: turned(i, 0, 1.25),
    "90 degrees": lambda i, r: np.rot90(i),
    "10 degrees": lambda i, r: turned(i, 10, 1),
    "33 degrees": lambda i, r: turned(i, 33, 1),
    "turned and scaled": lambda i, r: turned(i, 200, 0.9),
}


def image_classes(spark, images):
    rows = [(k, pgm(x)) for k, x in enumerate(images)]
    return {r.image_id: r.class_id for r in media.image_copies(spark.createDataFrame(rows, "image_id bigint, image binary").repartition(4)).collect()}


def test_edited_images_are_copies_and_others_are_not(spark):
    r = np.random.default_rng(7)
    n = 6
    originals = [scene(r) for _ in range(n)]
    images = originals + [edit(i, r) for edit in EDITS.values() for i in originals]
    got = image_classes(spark, images)
    assert len({got[k] for k in range(n)}) == n  # unrelated
    for e, name in enumerate(EDITS, 1):
        assert sum(got[e * n + k] == got[k] for k in range(n)) >= 0.9 * n - 0.5, name
    assert all(got[e * n + k] in (k, e * n + k) for e in range(1, len(EDITS) + 1) for k in range(n))


def test_a_shared_patch_is_no_copy(spark):
    r = np.random.default_rng(8)
    patch, images = scene(r)[:44, :44], [scene(r) for _ in range(12)]
    for image in images:
        x, y = r.integers(0, 110, 2)
        image[y : y + 44, x : x + 44] = patch
    got = image_classes(spark, images)
    assert sum(got[k] == k for k in got) == 12


def test_links_by_brute_force():
    """Consensus on all pairs of near corners, without tables and leaders, finds the same classes."""
    r = np.random.default_rng(9)
    images = [scene(r, 96) for _ in range(5)]
    images += [grey(i + r.normal(0, 5, i.shape)) for i in images[:3]] + [images[0][10:80, 20:90]]
    found = []
    for x in images:
        _, place, bits = media.describe(x[None].astype(np.float32))
        found.append((place, np.ascontiguousarray(bits).view(np.uint64)))
    links = []
    for i, (p, c) in enumerate(found):
        for j, (q, d) in enumerate(found[:i]):
            a, b = np.nonzero(np.bitwise_count(c[:, None] ^ d[None]).sum(-1) <= media.RADIUS)
            if len(a) and media.agree(p[a], q[b]):
                links.append((j, i))
    assert classes(len(images), links) == [0, 1, 2, 3, 4, 0, 1, 2, 0]


def test_leaders_and_hot_corners(spark):
    row, codes = np.array([5, 2, 9, 7]), np.zeros((4, 2), np.uint64)
    codes[2, 0] = 2**40 - 1
    assert media.leaders(row, codes).tolist() == [1, 1, 2, 1]
    # a cell with many corners of one code: as many matches as corners, in cells that hold a block's pairs at most
    points = spark.range(3000).selectExpr("1L as cell", "id as row", "id as place", "0L as a", "id % 50 as b")
    from quire.llm import _common as C

    cells = C.split_large_cells(points, ["a", "b"], 500)
    assert cells.groupBy("cell").count().agg({"count": "max"}).first()[0] < 2500
    twins = [pgm(np.tile(scene(np.random.default_rng(1), 64), (1, 1)))] * 40 + [b"P5\n64 64\n255\n" + bytes(4096)] * 30
    got = media.image_copies(spark.createDataFrame([(k, x) for k, x in enumerate(twins)], "image_id bigint, image binary")).collect()
    assert {r.image_id: r.class_id for r in got} == {k: 0 if k < 40 else 40 for k in range(70)}


def test_places_are_packed_exactly():
    x, y, level, turn = (np.array(v) for v in ([0, 8191, 17], [3, 8191, 0], [0, 63, 5], [63, 0, 7]))
    assert media.unpack_place(media.pack_place(x, y, level, turn, 640, 8190)).tolist() == [[a, b, c, d, 640, 8190] for a, b, c, d in zip(x, y, level, turn, strict=True)]


def chunk(kind, body):
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def any_png(width, height, depth, colour, data, interlace=0, palette=None):
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([depth, colour, 0, 0, interlace])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def test_formats():
    x = scene(np.random.default_rng(3), 40)
    sixteen = b"P5 40 40 65535\n" + (x.astype(">u2") * 257).tobytes()
    assert np.abs(media.decode(sixteen) - x).max() < 0.01
    deep = b"".join(b"\0" + (line.astype(">u2") * 257).tobytes() for line in x)
    assert (media.decode(any_png(40, 40, 16, 0, deep)) == x).all()
    palette = bytes(v for k in range(16) for v in (17 * k,) * 3)
    low = x // 17
    packed = b"".join(b"\0" + ((line[::2] << 4) | line[1::2]).astype(np.uint8).tobytes() for line in low)
    assert (media.decode(any_png(40, 40, 4, 3, packed, palette=palette)) == low * 17.0).all()
    one = b"".join(b"\0" + np.packbits(line > 99).tobytes() for line in x)
    assert (media.decode(any_png(40, 40, 1, 0, one)) == (x > 99) * 255.0).all()
    woven = b"".join(b"\0" + line.tobytes() for x0, y0, dx, dy in media._PASSES for line in x[y0::dy, x0::dx])
    assert (media.decode(any_png(40, 40, 8, 0, woven, interlace=1)) == x).all()
    bomb = any_png(40000, 40000, 8, 0, bytes(10))
    assert [media.decode(v) for v in (None, b"", b"\xff\xd8jpeg", sixteen[:50], bomb, any_png(40, 40, 8, 0, b"\0")) ] == [None] * 6


def test_image_copies(spark):
    r = np.random.default_rng(3)
    soft = media._box(media._box(r.normal(size=(6, 96, 96)).astype(np.float32), 2), 2)
    soft = np.clip(128 + 48 * soft / soft.std(axis=(1, 2), keepdims=True), 0, 255).astype(np.uint8)
    assert (media.decode(png(soft[0])) == soft[0]).all() and (media.decode(pgm(soft[0])) == soft[0]).all()
    base = soft[0]
    rows = [(10, pgm(base)), (11, pgm(base[10:80, 6:90])), (12, png(np.clip(base.astype(int) + 20, 0, 255))), (13, pgm(np.rot90(base))), (9, pgm(base))]
    rows += [(20 + k, pgm(soft[k])) for k in range(1, 6)] + [(30, None), (31, b""), (32, b"junk"), (33, b"junk"), (None, pgm(base)), (34, pgm(np.full((64, 64), 7)))]
    got = {r.image_id: r for r in media.image_copies(spark.createDataFrame(rows, "image_id bigint, image binary")).collect()}
    assert len(got) == len(rows)
    assert {got[k].class_id for k in (9, 10, 11, 12, 13, None)} == {9}
    assert all(got[k].class_id == k for k in range(21, 26)) and got[30].class_id == 30 and got[31].class_id == 30 and got[33].class_id == 32
    assert got[32].n_corners == 0 and got[34].n_corners == 0
    assert media.image_copies(spark.createDataFrame([], "image_id bigint, image binary")).count() == 0


def test_every_pair_of_near_corners_is_matched_once():
    r = np.random.default_rng(8)
    base = r.integers(0, 2**64, (12, 2), dtype=np.uint64)
    codes = np.repeat(base, 20, axis=0)
    for _ in range(6):
        codes[np.arange(240), r.integers(0, 2, 240)] ^= np.uint64(1) << r.integers(0, 64, 240).astype(np.uint64)
    group = r.integers(0, 30, 240)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(240)), pa.array(codes[:, 0].view(np.int64)), pa.array(codes[:, 1].view(np.int64))], names=["row", "a", "b"])
    table = pa.Table.from_batches(list(media._tables(media.TABLES)([batch]))).sort_by("cell")
    row = table["row"].to_numpy()
    cell, k = table["cell"].to_numpy(), table["k"].to_numpy()
    got = [(min(a, b), max(a, b)) for i, j in media.near_pairs(cell, k, group[row], codes[row]) for a, b in zip(row[i].tolist(), row[j].tolist())]
    together = {(a, b) for c in np.unique(cell) for a in row[cell == c].tolist() for b in row[cell == c].tolist() if a < b}
    want = {(a, b) for a, b in together if group[a] != group[b] and np.bitwise_count(codes[a] ^ codes[b]).sum() <= media.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_copies_are_linked_though_their_corners_are_nearer_to_a_third_image(spark, monkeypatch):
    # four pairs of copies; all images have all corners, but each pair has them strewn in its own way
    r = np.random.default_rng(9)
    codes = r.integers(-(2**62), 2**62, (40, 2))
    x, y = r.integers(20, 140, 40), r.integers(20, 140, 40)
    zero = np.zeros(40, np.int64)
    orders = [r.permutation(40) for _ in range(4)]
    place = [media.pack_place(x[orders[k // 2]] + 3 * (k % 2), y[orders[k // 2]], zero, zero, 160, 160) for k in range(8)]

    def describe(batches):
        for batch in batches:
            for row, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([row] * 40), pa.array(place[image[0]]), pa.array(codes[:, 0]), pa.array(codes[:, 1])], names=["row", "place", "a", "b"])

    monkeypatch.setattr(media, "_describe", describe)
    images = [(k, bytes([k])) for k in range(8)]
    got = {r.image_id: r.class_id for r in media.image_copies(spark.createDataFrame(images, "image_id bigint, image binary")).collect()}
    assert got == {k: k // 2 * 2 for k in range(8)}


def test_stage_takes_candidates_by_fingerprints_too(spark):
    fp = [0b1111, 0b1000, 0b1000, 1 << 40, -1]
    table = spark.createDataFrame([(10 + k, f, [k]) for k, f in enumerate(fp)], "point bigint, fp bigint, bands array<bigint>")
    found = {r.u: r.v for r in components(near_copies.candidate_links(table, table)).collect()}
    assert found == {11: 10, 12: 10, 13: 10}  # no cell is shared; 1 << 40 is two bits from 0b1000
