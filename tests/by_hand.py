"""Plain readings of definitions that several tests use."""

import numpy as np


def filled_by_hand(z, known):
    """Holes of a raster filled by least squares over first and second differences, of weight 1 both, solved as one dense system.

    Pixels with an unknown one in the 5 x 5 around them (the border repeated) are solved for; known ones among these are held
    with weight 9.
    """
    height, width = z.shape
    pad = np.pad(known, 2, mode="edge")
    at = {}
    for r in range(height):
        for c in range(width):
            if pad[r : r + 5, c : c + 5].sum() < 25:
                at[r, c] = len(at)
    rows, right = [], []

    def row(value, *terms):
        line = np.zeros(len(at))
        for k, w in terms:
            line[k] += w
        rows.append(line)
        right.append(value)

    for (r, c), i in at.items():
        if not known[r, c]:
            for dr, dc, gate in ((0, -1, True), (-1, 0, True), (0, 1, False), (1, 0, False)):
                j = at.get((r + dr, c + dc))
                if j is not None and (known[r + dr, c + dc] or not gate):
                    row(0.0, (i, 1.0), (j, -1.0))
        for dr, dc in ((0, 1), (1, 0)):
            a, b = at.get((r - dr, c - dc)), at.get((r + dr, c + dc))
            if a is not None and b is not None and (not known[r - dr, c - dc] or not known[r + dr, c + dc] or known[r, c]):
                row(0.0, (a, -1.0), (b, -1.0), (i, 2.0))
        if known[r, c]:
            row(9.0 * z[r, c], (i, 9.0))
    out = z.astype(float).copy()
    if at:
        solved = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
        for p, i in at.items():
            out[p] = solved[i]
    return out
