"""Eigenvalues and eigenvectors of an integer symmetric matrix by its exact characteristic polynomial.

* `residues`: the polynomial modulo a prime, by reduction to Hessenberg form and its recurrence.
* `combined`: the integer coefficients from residues, by Chinese remainders.
* `isolated`: intervals of the largest roots. All roots are real, so Descartes' rule of signs counts the roots above
  a point exactly, with multiplicity.
* `refined` and `null_vectors`: a root by bisection on exact signs, and the vectors of its null space by inverse
  iteration with a matrix of long fixed-point integers.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb, gcd, isqrt

import numpy as np

#: Bits below the trace to which roots are found; roots nearer to one another than that count as one.
DEPTH = 160
#: Bits of the fractions in elimination.
FRACTION = 256


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that settle every n below 2**32."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(matrix: np.ndarray) -> list[int]:
    """Primes below 2**31 whose product exceeds twice every coefficient, for a positive semidefinite matrix.

    The k-th coefficient is an elementary symmetric function of the roots, at most C(d, k) (trace / d)**k.
    """
    d, trace = len(matrix), int(np.trace(matrix))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    found, product, p = [], 1, 2**31 - 1
    while product <= 2 * bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def residues(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo `p`, the constant first."""
    d = len(matrix)
    h = (matrix % p).astype(np.int64)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i > k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        weights, product = np.zeros(k, np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            weights[i - 1] = product * int(h[i - 1, k - 1]) % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def combined(found: dict[int, list[int]]) -> list[int]:
    """The integers, of either sign, of which each prime has the residues."""
    product = 1
    for p in found:
        product *= p
    sums = [0] * len(next(iter(found.values())))
    for p, values in found.items():
        rest = product // p
        unit = rest * pow(rest, -1, p)
        sums = [(s + unit * int(v)) % product for s, v in zip(sums, values)]
    return [s - product if 2 * s > product else s for s in sums]


def stretched(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are those of `poly` times 2**bits."""
    d = len(poly) - 1
    return [c << bits * (d - i) for i, c in enumerate(poly)]


def roots_above(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are above `at`: sign changes of poly(x + at)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolated(poly: list[int], top: int, most: int) -> list[tuple[int, int, int]]:
    """(below, upto, count) of the intervals that hold the `most` largest roots above 0, falling; `top` is above all.

    An interval has one root, or is one unit wide and has several that count as one.
    """
    found: list[tuple[int, int, int]] = []
    open_ = [(0, top, roots_above(poly, 0), 0)]
    while open_ and sum(x[2] for x in found) < most:
        low, high, above_low, above_high = open_.pop()
        count = above_low - above_high
        if not count:
            continue
        if count == 1 or high - low <= 1:
            found.append((low, high, count))
            continue
        middle = (low + high) // 2
        above = roots_above(poly, middle)
        open_ += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


def refined(poly: list[int], low: int, high: int, count: int) -> int:
    """The unit above the root in (low, high]: bisection by the sign of the polynomial."""
    def sign(at: int) -> int:
        value = 0
        for c in reversed(poly):
            value = value * at + c
        return (value > 0) - (value < 0)

    if count > 1:
        return high
    end = sign(high)
    if not end:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        found = sign(middle)
        if not found:
            return middle
        low, high = (low, middle) if found == end else (middle, high)
    return high


def null_vectors(matrix: np.ndarray, root: int, bits: int, count: int) -> np.ndarray:
    """`count` orthonormal vectors (rows) of the space that matrix - root / 2**bits nearly sends to zero.

    One step of inverse iteration from each of `count` fixed starts: the root is known so closely that the step
    leaves nothing else of the start. The largest entry of a vector is positive.
    """
    d = len(matrix)
    a = np.empty((d, d + count), object)
    a[:, :d] = matrix * (1 << bits)
    a[np.arange(d), np.arange(d)] -= root
    start = np.array([[(i + 1) * (2 * k + 3) * 0x9E3779B97F4A7C15 % (1 << 61) - (1 << 60) for k in range(count)] for i in range(d)], object)
    scale = max(abs(int(x)) for x in a[:, :d].flat) or 1
    a[:, d:] = start * scale
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
        pivot = a[k, k] = a[k, k] or 1
        times = (a[k + 1:, k] << FRACTION) // pivot
        a[k + 1:, k:] -= (times[:, None] * a[k, k:]) >> FRACTION
    vectors: list[np.ndarray] = []
    for j in range(count):
        x = np.zeros(d, object)
        for k in range(d - 1, -1, -1):
            x[k] = ((a[k, d + j] << FRACTION) - int((a[k, k + 1:d] * x[k + 1:]).sum() if k + 1 < d else 0)) // a[k, k]
        x = _unit(x)
        for _ in range(2):
            for v in vectors:
                x = x - ((v * int((v * x).sum())) >> 2 * FRACTION)
            x = _unit(x)
        vectors.append(x)
    out = np.array([[float(Fraction(int(c), 1 << FRACTION)) for c in v] for v in vectors])
    return out * np.sign(out[np.arange(count), np.abs(out).argmax(axis=1)])[:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    """`x` at length 2**FRACTION."""
    most = max(abs(int(c)) for c in x) or 1
    x = (x << 2 * FRACTION) // most
    length = isqrt(int((x * x).sum())) or 1
    return (x << FRACTION) // length


def reduced(matrix: np.ndarray) -> tuple[np.ndarray, int]:
    """The matrix without the divisor that all its entries share, and that divisor."""
    divisor = 0
    for x in matrix.flat:
        divisor = gcd(divisor, int(x))
    divisor = divisor or 1
    return matrix // divisor, divisor
