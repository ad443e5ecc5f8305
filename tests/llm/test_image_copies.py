"""Image copies: planted crops and edits, and the linking against all pairs."""

import itertools

import numpy as np
from geolark.llm import imagecopies
from geolark.llm.imagecopies import _zoom, decode, describe, image_classes, linked, linked_pictures, table_words


def pgm(a):
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def texture(rng, n=128):
    out = np.zeros((n, n))
    for k in (6, 12, 24):
        out += _zoom(rng.normal(0, 1, (1, n // k + 2, n // k + 2)), n, n)[0] * k**0.5
    return np.rint(128 + 100 * out / np.abs(out).max())


def turned(a, degrees):
    n = a.shape[0]
    c, t = (n - 1) / 2, np.deg2rad(degrees)
    yy, xx = np.mgrid[0:n, 0:n] - c
    y, x = np.clip(c + yy * np.cos(t) - xx * np.sin(t), 0, n - 1.001), np.clip(c + yy * np.sin(t) + xx * np.cos(t), 0, n - 1.001)
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx = y - y0, x - x0
    rows = a[y0, x0] * (1 - fy) * (1 - fx) + a[y0 + 1, x0] * fy * (1 - fx) + a[y0, x0 + 1] * (1 - fy) * fx + a[y0 + 1, x0 + 1] * fy * fx
    return rows[n // 7 : -n // 7, n // 7 : -n // 7]


def edits(a, rng):
    n = a.shape[0]
    yield a[n // 8 :, : -n // 8]
    yield a[n // 4 : n // 4 * 3, n // 4 : n // 4 * 3]
    yield a * 0.8 + 20
    yield a + rng.normal(0, 4, a.shape)
    yield np.rot90(a)
    yield turned(a, 25)
    yield _zoom(a[None], n * 3 // 4, n * 3 // 4)[0]
    yield _zoom(a[None], n * 3 // 5, n * 3 // 5)[0]
    yield _zoom(a[None], n * 5 // 4, n * 5 // 4)[0]
    covered = a.copy()
    covered[: n // 3, : n // 2] = 0
    yield covered


def test_planted_copies(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(12):
        a = texture(rng)
        for j, e in enumerate([a, *edits(a, rng)]):
            rows.append((k * 100 + j, pgm(e)))
            want[k * 100 + j] = k * 100
    got = {r.id: r.class_id for r in image_classes(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert np.mean([got[i] == want[i] for i in want]) >= 0.95
    assert all(got[i] // 100 == i // 100 for i in got)  # no picture joins another's copies


def test_defined_cases(spark):
    rng = np.random.default_rng(4)
    base = [texture(rng, 96) for _ in range(3)]
    rows = [(k, pgm(g), "x") for k, g in enumerate(base)]
    rows += [(14, pgm(base[1]), "y"), (14, pgm(base[1]), "y"), (None, pgm(base[2]), "z"), (15, None, None), (16, b"junk", "n"), (17, pgm(np.zeros((40, 40))), None), (18, pgm(base[0][:20, :20]), None), (19, pgm(np.zeros((1, 1))), None)]
    frame = spark.createDataFrame(rows, "id long, image binary, class_id string")  # a clashing column
    got = image_classes(frame).collect()
    assert len(got) == len(rows)
    classes = {r.id: (r.class_id, r.readable) for r in got}
    assert classes == {0: (0, True), 1: (1, True), 2: (2, True), 14: (1, True), None: (2, True), 15: (None, None), 16: (16, False), 17: (17, True), 18: (18, True), 19: (19, True)}
    assert {r.n_links for r in got} == {0}
    assert image_classes(frame.limit(0)).count() == 0


def test_links_against_all_pairs(spark):
    """Classes of linked_pictures() are those of every pair that shares words and is linked, with short lists and long ones in blocks."""
    rng = np.random.default_rng(5)
    base = [texture(rng, 80) for _ in range(5)]
    images = base + [base[0] + rng.normal(0, 3, base[0].shape) for _ in range(8)] + [base[1][5:, 5:], base[1][:-9, :-9], np.where(np.arange(80)[:, None] < 40, base[2], base[3]), np.hstack([base[3][:, :50], base[4][:, :50]])]
    corners = [describe(np.clip(np.rint(a), 0, 255)[None])[0] for a in images]
    words = [table_words(c) for c in corners]
    edges = [(i, j) for i, j in itertools.combinations(range(len(images)), 2) if len(np.intersect1d(words[i], words[j])) >= imagecopies.MIN_WORDS and linked(corners[i], corners[j])]

    def classes(pairs):
        low = list(range(len(images)))
        for _ in low:
            for i, j in pairs:
                low[i] = low[j] = min(low[i], low[j])
        return low

    frame = spark.createDataFrame([(i, bytearray(c.tobytes()), w.tolist()) for i, (c, w) in enumerate(zip(corners, words, strict=True))], "id long, corners binary, words array<long>")
    assert len(edges) > 30
    for block in (imagecopies.LIST_BLOCK, 3):
        got = [(r.src, r.dst) for r in linked_pictures(frame, block).collect()]
        assert set(got) <= set(edges) and classes(got) == classes(edges)


def test_list_links_reach_over_a_chain():
    """A word's list links x to the class of m although its first picture shares too little with x."""
    rng = np.random.default_rng(6)
    a = texture(rng, 128)
    parts = [describe(np.rint(x)[None])[0] for x in (a[:, :70], a[:, 20:100], a[:, 58:])]
    words = [table_words(c) for c in parts]
    assert linked(parts[0], parts[1]) and linked(parts[1], parts[2])
    found = set()
    for key in set(np.concatenate(words).tolist()):
        held = [i for i in range(3) if key in words[i]]
        found |= set(imagecopies.list_links(key, held, held, [0] * len(held), [parts[i] for i in held]))
    assert {(0, 1), (1, 2)} <= {tuple(sorted(x)) for x in found}


def test_png_decoding():
    from geolark.operators.tiles import png

    image = decode(png(bytes(range(64)) * 4, 8, 8))
    assert image.shape == (8, 8) and abs(image[0, 1] - (4 * 0.299 + 5 * 0.587 + 6 * 0.114)) < 1e-9
