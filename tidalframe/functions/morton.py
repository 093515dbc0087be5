"""Morton codes of 21 bits an axis (x lowest), per-axis levels and refinement masks."""

from __future__ import annotations

BITS = 21
X, Y, Z = 1, 2, 4


def encode(m, *axes, bits: int = BITS):
    """Interleaved bits of one to three non-negative integers, every third place each."""
    out = None
    for k, a in enumerate(axes):
        for i in range(bits):
            part = m.shift_left(m.bit_and(m.shift_right(a, i), 1), 3 * i + k)
            out = part if out is None else m.bit_or(out, part)
    return out


def decode(m, code, axis: int, bits: int = BITS):
    out = None
    for i in range(bits):
        part = m.shift_left(m.bit_and(m.shift_right(code, 3 * i + axis), 1), i)
        out = part if out is None else m.bit_or(out, part)
    return out


def parent(m, code):
    """The isotropic parent."""
    return m.shift_right(code, 3)


def child(m, code, which: int):
    return m.bit_or(m.shift_left(code, 3), m.lit(which))


def mask_to_reach(m, have, want):
    """Axes whose level in ``have`` lies below that in ``want`` (both (x, y, z))."""
    bits = [m.when(a < b, bit, 0) for a, b, bit in zip(have, want, (X, Y, Z), strict=True)]
    return bits[0] + bits[1] + bits[2]


def balanced(m, a, b):
    tests = [m.abs(x - y) <= 1 for x, y in zip(a, b, strict=True)]
    return tests[0] & tests[1] & tests[2]


def children_of_mask(m, mask):
    """2 to the number of refined axes."""
    count = m.bit_and(mask, 1) + m.shift_right(m.bit_and(mask, 2), 1) + m.shift_right(m.bit_and(mask, 4), 2)
    return m.when(count < 1, 1, m.when(count < 2, 2, m.when(count < 3, 4, 8)))
