"""Boxes over pictures, pixel by pixel."""

import numpy as np

from larder.functions import overlays as O


def green(on):
    return sorted(map(tuple, np.argwhere((on == O.GREEN).all(axis=2)).tolist()))


def test_outlines():
    image = np.full((12, 14), 100, np.uint8)
    on = O.overlay(image, [(3, 2, 9, 8)])
    want = [(y, x) for y in range(12) for x in range(14) if 2 <= x <= 10 and 1 <= y <= 9 and not (4 <= x <= 8 and 3 <= y <= 7)]
    assert green(on) == want and (image == 100).all() and on.shape == (12, 14, 3)
    assert len(want) == (6 + 3) * (6 + 3) - (6 - 1) * (6 - 1)
    # outside the picture nothing is drawn
    assert green(O.overlay(image, [(-5, -5, 30, 30)])) == [] and green(O.overlay(image, [(50, 50, 60, 60)])) == []
    assert green(O.overlay(image, [(0, 0, 13, 11)])) == [(y, x) for y in range(12) for x in range(14) if x in (0, 13) or y in (0, 11)]
    one = O.canvas(image)
    O.outline(one, (4, 4, 8, 8), width=1)
    assert green(one) == [(y, x) for y in range(4, 9) for x in range(4, 9) if x in (4, 8) or y in (4, 8)]
    three = O.canvas(image)
    O.outline(three, (4, 4, 8, 8), width=3)
    assert green(three) == [(y, x) for y in range(3, 10) for x in range(3, 10) if not (x == 6 and y == 6)]


def test_shades_numbers_and_colours():
    colour = np.zeros((20, 30, 3), np.uint8)
    colour[:] = (10, 20, 30)
    on = O.overlay(colour, [(5, 5, 20, 15)], shade=0.25)
    assert on[10, 12].tolist() == [8, 79, 22] and on[0, 0].tolist() == [10, 20, 30]  # of 10, 20, 30 three quarters, and a quarter of green
    on = O.canvas(np.zeros((9, 30), np.uint8))
    O.number(on, 1, 2, 170)
    text = ["".join("#" if (y, x) in set(green(on)) else "." for x in range(1, 12)) for y in range(2, 7)]
    assert text == [".#..###.###", "##....#.#.#", ".#....#.#.#", ".#....#.#.#", "###...#.###"]
    twice = O.canvas(np.zeros((20, 30), np.uint8))
    O.number(twice, 0, 0, 8, size=2)
    assert len(green(twice)) == 13 * 4
