"""Components over strips against a flood fill, and what cleaning takes away."""

import numpy as np
import pytest

from foliant.operators import scan

KIND = "doc_id long, page_no int, strip int, width int, data binary"


def flood(ink, eight=True):
    """(area, x, y, w, h) of every component, pixel by pixel."""
    left, out = set(zip(*np.nonzero(ink), strict=True)), []
    steps = [(i, k) for i in (-1, 0, 1) for k in (-1, 0, 1) if (i or k) and (eight or not (i and k))]
    while left:
        stack, found = [left.pop()], []
        while stack:
            p = stack.pop()
            found.append(p)
            for i, k in steps:
                q = (p[0] + i, p[1] + k)
                if q in left:
                    left.discard(q)
                    stack.append(q)
        ys, xs = zip(*found, strict=True)
        out.append((len(found), int(min(xs)), int(min(ys)), int(max(xs) - min(xs) + 1), int(max(ys) - min(ys) + 1)))
    return sorted(out)


def strips(spark, pages, rows):
    data = [(i, 0, s, p.shape[1], p[at : at + rows].astype(np.uint8).tobytes()) for i, p in enumerate(pages) for s, at in enumerate(range(0, len(p), rows))]
    return spark.createDataFrame(data, KIND).repartition(5)


@pytest.mark.parametrize(("rows", "eight"), [(3, True), (7, False), (100, True)])
def test_components_by_flood_fill(spark, rows, eight):
    rng = np.random.default_rng(rows)
    pages = [rng.random((30, 40)) < p for p in (0.1, 0.35, 0.5, 0.65, 0.0)]
    snake = np.zeros((31, 31), dtype=bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    pages.append(snake)
    found, _ = scan.components(scan.strip_labels(strips(spark, pages, rows), eight), int(eight))
    got = {i: [] for i in range(len(pages))}
    for r in found.collect():
        got[r.doc_id].append((r.area, r.x, r.y, r.w, r.h))
    for i, p in enumerate(pages):
        assert sorted(got[i]) == flood(p, eight)


def test_cleaning_takes_specks_and_edges_and_keeps_print(spark):
    page = np.zeros((400, 300), dtype=bool)
    want = page.copy()
    want[100:120, 60:200] = want[200:203, 100] = True
    page |= want
    page[30:200, 3:9] = True  # along the left edge
    page[2:6, 100:260] = True  # along the top
    page[300, 150] = page[310, 150:152] = True
    page[395:399, 20:24] = True  # at the bottom, but too short
    want[395:399, 20:24] = True
    for rows in (50, 400):
        got = sorted(scan.cleaned(strips(spark, [page, page * False], rows)).collect(), key=lambda r: (r.doc_id, r.strip))
        whole = np.concatenate([np.frombuffer(r.data, dtype=np.uint8).reshape(-1, 300) for r in got if r.doc_id == 0])
        assert np.array_equal(whole > 0, want) and not any(any(r.data) for r in got if r.doc_id == 1)


def test_coloured_marks_over_strip_borders(spark):
    rng = np.random.default_rng(1)
    page = np.full((40, 30, 3), 250, dtype=np.uint8)
    page[5:35, 10] = (200, 30, 40)
    page[8:30:3, 20] = (30, 30, 200)
    page[:, 3] = 10
    page[rng.random((40, 30)) < 0.03] = (240, 200, 205)
    whole = None
    for rows in (3, 11, 40):
        data = [(0, 0, s, 30, page[at : at + rows].tobytes()) for s, at in enumerate(range(0, 40, rows))]
        got = sorted(scan.without_colour(spark.createDataFrame(data, KIND)).collect(), key=lambda r: r.strip)
        image = np.concatenate([np.frombuffer(r.data, dtype=np.uint8).reshape(-1, 30, 3) for r in got])
        whole = image if whole is None else whole
        assert np.array_equal(image, whole)
    assert (whole[5:35, 9:12] == 255).all() and (whole[8:30, 20] == 255).all() and (whole[0, 3] == 10).all()
    assert scan.coloured(np.array([[[10, 10, 10], [255, 255, 255], [128, 128, 130], [0, 120, 0], [180, 170, 150]]], dtype=np.uint8)).tolist() == [[False, False, False, True, True]]


def test_images_become_pages_or_their_list_is_refused(spark):
    from foliant.operators import images

    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (200).to_bytes(4, "big") + (100).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xff\xe0\0\x04ab\xff\xdb\0\x03x\xff\xc2\0\x11\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\3"
    tiff = b"MM\0*\0\0\0\x08\0\2" + b"\1\0\0\4\0\0\0\1" + (7).to_bytes(4, "big") + b"\1\1\0\3\0\0\0\1" + (9).to_bytes(2, "big") + b"\0\0"
    heads = {"a.png": png, "b.jpg": jpeg, "c.tif": tiff, "cut.png": png[:20], "zero": png[:16] + bytes(8), "null": None, "odd": b"odd"}
    assert [images.image_head_size(h) for h in heads.values()] == [(200, 100), (40, 30), (7, 9), None, None, None, None]
    files = spark.createDataFrame(list(heads.items()), "path string, head binary")
    members = spark.createDataFrame([(1, 5, "b.jpg"), (1, 2, "a.png"), (2, 0, "a.png"), (2, 1, "odd"), (3, 0, "lost"), (4, 0, "b.jpg")], "list_id int, place int, path string")
    pages, refused = images.pages_of_images(members, files, 400.0, 300.0)
    got = sorted(map(tuple, pages.collect()))
    assert got == [(1, 0, "a.png", 0.0, 50.0, 400.0, 200.0), (1, 1, "b.jpg", 0.0, 0.0, 400.0, 300.0), (4, 0, "b.jpg", 0.0, 0.0, 400.0, 300.0)]
    assert sorted(map(tuple, refused.collect())) == [(2, 1), (3, 1)]
    natural = images.pages_of_images(members, files, fit=False, dpi=144.0)[0].filter("list_id = 4").first()
    assert (natural.x, natural.y, natural.w, natural.h) == (0.0, 0.0, 20.0, 15.0)
