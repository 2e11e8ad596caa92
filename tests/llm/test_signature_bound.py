"""The test of signatures against the bands."""

import math

from kinlink.llm import minhash as M


def test_signatures_lose_no_more_pairs_than_bands():
    p = M.THRESHOLD
    bands = (1 - p**M.ROWS) ** (M.SAMPLES // M.ROWS)
    lost = sum(math.comb(M.SAMPLES, k) * p**k * (1 - p) ** (M.SAMPLES - k) for k in range(M.AGREE))
    assert lost <= bands
