"""Small graph helpers in numpy."""

import numpy as np


def forest_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of the pairs (a, b) of numbers below n, edges (2 x m) that connect the same: each number with the least of its component.

    Labels fall to the least of each pair's until nothing changes, with shortcuts, so the number of rounds is logarithmic.
    """
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(n))
    return np.stack([label[some], some])
