"""Alignments that stop early, and the plain form of texts."""

from __future__ import annotations

import re

import numpy as np

from tidalframe.llm import decontaminate


def test_stopped_alignments_decide_as_whole_ones():
    rng = np.random.default_rng(3)
    for _ in range(400):
        item = rng.integers(0, 4, rng.integers(8, 60))
        text = rng.integers(0, 4, rng.integers(10, 90))
        if rng.random() < 0.6:
            at = int(rng.integers(0, 6))
            text[at : at + len(item)] = item[: max(0, len(text) - at)]
            text[rng.integers(0, len(text), rng.integers(0, 4))] = 9
        width, most = int(rng.integers(1, 12)), int(rng.integers(0, 6))
        whole, stopped = decontaminate.banded_distance(item, text, width), decontaminate.banded_distance(item, text, width, most)
        assert stopped == whole if whole <= most else stopped > most
        have = np.zeros(width + 1, dtype=np.int64)  # plain recurrence on the diagonals
        for i, x in enumerate(item):
            new = [have[d] + (i + d >= len(text) or text[i + d] != x) for d in range(width + 1)]
            new = [min(v, have[d + 1] + 1) if d < width else v for d, v in enumerate(new)]
            for d in range(1, width + 1):
                new[d] = min(new[d], new[d - 1] + 1)
            have = np.array(new)
        assert whole == have.min()


def test_plain_is_lower_case_with_single_spaces():
    odd = "".join(map(chr, [*range(0, 0x100), 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF, 0x180E, 0x130]))
    for text in (odd, f" {odd}\t\n x ", "", " ", "\x1c\x1fA\x85B​C"):
        assert decontaminate.plain(text) == re.sub(r"\s+", " ", text.lower()).strip()
    assert decontaminate.plain(None) == ""
