import numpy as np
import pytest

from docfields.config import Preprocess, Quality
from docfields.operators import imaging as im

RNG = np.random.default_rng(3)
CHECKER = np.kron(np.indices((100, 100)).sum(0) % 2, np.ones((10, 10))).astype(np.uint8) * 255


@pytest.mark.parametrize("image", [np.zeros((1000, 1000), np.uint8), np.full((1000, 1000), 255, np.uint8), np.zeros((1000, 1000, 3), np.uint8), np.zeros((100, 100), np.uint8), None])
def test_rejected(image):
    got = im.quality(image)
    assert not got["usable"] and not got["document_detected"]


def test_quality():
    noise = RNG.integers(0, 256, (1000, 1000, 3)).astype(np.uint8)
    assert im.quality(noise)["usable"] and not im.quality(noise)["is_blurry"]
    soft = np.stack([im._bytes(im.blurred(noise[..., i], 31, 10.0)) for i in range(3)], 2)
    assert im.quality(soft)["is_blurry"] and im.quality(soft)["usable"]
    assert im.laplacian_variance(CHECKER) > 80 > im.laplacian_variance(im._bytes(im.blurred(CHECKER, 31, 10.0)))
    assert im.quality(RNG.integers(240, 256, (900, 900)).astype(np.uint8))["is_overexposed"]
    assert not im.quality(RNG.integers(50, 200, (900, 900)).astype(np.uint8))["is_overexposed"]
    assert not im.quality(noise, Quality(minimum_width=2000))["usable"]


def test_glare():
    spot = np.full((1000, 1000), 128, np.uint8)
    spot[:300, :300] = 255
    assert im.glare(spot) and not im.glare(RNG.integers(50, 200, (1000, 1000)).astype(np.uint8))


def test_components_by_hand():
    for _ in range(20):
        mask = RNG.random((12, 15)) < 0.45
        left, most = {tuple(p) for p in np.argwhere(mask)}, 0
        while left:
            todo, n = [left.pop()], 0
            while todo:
                y, x = todo.pop()
                n += 1
                for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if q in left:
                        left.remove(q)
                        todo.append(q)
            most = max(most, n)
        assert im.largest_component(mask) == most == max(len(c) for c in im._components(mask))


def test_outline():
    page = np.full((1600, 1200), 60, np.uint8)
    page[80:1520, 80:1120] = 230
    got = im.detect(page, Preprocess(canny_low=5, canny_high=30))
    assert got["found"] and got["page_type"] == "A4"
    assert np.abs(np.array(got["corners"]) - [[80, 80], [1120, 80], [1120, 1520], [80, 1520]]).max() < 12
    assert not im.detect(np.full((1000, 1000), 128, np.uint8))["found"]


def test_geometry():
    image = RNG.integers(0, 256, (60, 80, 3)).astype(np.uint8)
    turned, done = im.upright(image)
    assert done and turned.shape == (80, 60, 3) and (turned[0, -1] == image[0, 0]).all()
    assert im.upright(turned)[1] is False
    same = im.warped(image, np.array([(0, 0), (79, 0), (79, 59), (0, 59)]), 80, 60)
    assert (same == image).all()
    assert im.warped(image, np.array([(0, 0)] * 4), 80, 60) is None
    assert im.warped(image, np.array([(5, 5), (70, 8), (75, 50), (3, 55)]), 60, 80).shape == (80, 60, 3)


def test_process():
    image = RNG.integers(0, 256, (50, 50, 3)).astype(np.uint8)
    off = Preprocess(**{k: False for k in vars(Preprocess()) if k.startswith("enable")})
    done, found = im.process(image, off)
    assert done.shape == (50, 50, 3) and not found["found"] and (done[..., 0] == im.gray(image)).all()
    assert im.enhanced(image).shape == (50, 50, 3) and im.process(None) is None
    flat = np.full((64, 64), 100, np.uint8)
    assert (im.denoised(flat) == 100).all() and im.clahe(image[..., 0]).shape == (50, 50)
    assert set(np.unique(im.adaptive_threshold(image[..., 0]))) <= {0, 255}
