"""Exact characteristic polynomials of integer matrices, their real roots and
null vectors: numpy and Python-integer helpers of the whitening operator.

Everything here is about one D x D matrix, never about the rows of a table.
"""

from __future__ import annotations

import math

import numpy as np

PRIME_BITS = 31
# Bits of a root beside the trace's magnitude, and of fixed-point numbers in null vectors.
ROOT_BITS = 120
FIXED_BITS = 320


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 2^32."""
    if n < 2 or n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        if a % n == 0:
            continue
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bound_bits: int) -> list[int]:
    """The largest primes under 2^31 whose product exceeds 2^bound_bits."""
    found, bits, n = [], 0.0, (1 << PRIME_BITS) - 1
    while bits <= bound_bits:
        if is_prime(n):
            found.append(n)
            bits += math.log2(n)
        n -= 2
    return found


def coefficient_bits(trace: int, dim: int) -> int:
    """Bits of the largest coefficient (with sign) for a positive semidefinite
    matrix: the coefficients of prod (x + root) sum to prod (1 + root), which is
    at most (1 + trace / dim)^dim."""
    return dim * (trace // dim + 2).bit_length() + 2


def polynomial_mod(rows: list[list[int]], p: int) -> np.ndarray:
    """Coefficients (constant first, monic) of det(xI - A) modulo a prime under
    2^31, by reduction to Hessenberg form with similarity steps."""
    n = len(rows)
    h = np.array([[x % p for x in r] for r in rows], dtype=np.int64).reshape(n, n)
    for k in range(1, n - 1):
        pivot = k + np.flatnonzero(h[k:, k - 1])
        if len(pivot) == 0:
            continue
        if pivot[0] != k:
            i = pivot[0]
            h[[k, i]] = h[[i, k]]
            h[:, [k, i]] = h[:, [i, k]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k][None, :] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u[None, :] % p).sum(axis=1)) % p
    # leading minors: minor[k] of the first k rows and columns
    minor = np.zeros((n + 1, n + 1), dtype=np.int64)
    minor[0, 0] = 1
    for k in range(1, n + 1):
        minor[k, 1:] = minor[k - 1, :-1]
        minor[k] = (minor[k] - int(h[k - 1, k - 1]) * minor[k - 1] % p) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if below == 0:
                break
            minor[k] = (minor[k] - int(h[i - 1, k - 1]) * below % p * minor[i - 1] % p) % p
    return minor[n]


def chinese_remainder(residues: list[tuple[int, int]]) -> int:
    """The number of least magnitude with these (prime, residue) pairs."""
    value, modulus = 0, 1
    for p, r in residues:
        value += modulus * ((r - value) * pow(modulus, -1, p) % p)
        modulus *= p
    return value if 2 * value <= modulus else value - modulus


def shifted(poly: list[int], a: int) -> list[int]:
    """Coefficients of poly(x + a)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    return c


def roots_above(poly: list[int], a: int) -> int:
    """Roots greater than ``a``, with multiplicity: the sign changes of
    poly(x + a), which count exactly because every root is real."""
    signs = [c > 0 for c in shifted(poly, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def scaled(poly: list[int], bits: int) -> list[int]:
    """The monic polynomial whose roots are 2^bits as large."""
    n = len(poly) - 1
    return [c << (bits * (n - k)) for k, c in enumerate(poly)]


def isolate(poly: list[int], count: int, top: int) -> list[tuple[int, int, int]]:
    """Intervals (low, high, multiplicity), low < root <= high <= top, falling,
    of the ``count`` largest positive roots of a real-rooted polynomial: one
    root each, or several that a unit does not separate."""
    stack, found, n = [(0, roots_above(poly, 0), top, 0)], [], 0
    while stack and n < count:
        low, above_low, high, above_high = stack.pop()
        inside = above_low - above_high
        if inside == 0:
            continue
        if inside == 1 or high - low == 1:
            found.append((low, high, inside))
            n += inside
            continue
        middle = (low + high) // 2
        above = roots_above(poly, middle)
        stack += [(low, above_low, middle, above), (middle, above, high, above_high)]
    return found


def refine(poly: list[int], low: int, high: int) -> int:
    """Upper end of the unit interval that holds the one root in (low, high]."""
    def sign(a: int) -> int:
        value = 0
        for c in reversed(poly):
            value = value * a + c
        return (value > 0) - (value < 0)

    at_high = sign(high)
    if at_high == 0:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        s = sign(middle)
        if s == 0:
            return middle
        low, high = (low, middle) if s == at_high else (middle, high)
    return high


def null_vectors(rows: list[list[int]], bits: int, root: int, count: int = 1) -> np.ndarray:
    """``count`` orthonormal vectors (rows) that (2^bits A - root I) takes to
    about zero, by inverse iteration in fixed-point numbers: one elimination
    with row exchanges, two solutions for each start."""
    n = len(rows)
    one = 1 << FIXED_BITS
    m = np.empty((n, n), dtype=object)
    for i, r in enumerate(rows):
        m[i] = [int(x) << bits for x in r]
        m[i, i] -= root
    size = max(1, max(abs(x) for x in m.ravel()))
    m = m * one // size
    order, steps = list(range(n)), []
    for k in range(n):
        best = max(range(k, n), key=lambda i: abs(m[i, k]))
        m[[k, best]] = m[[best, k]]
        order[k], order[best] = order[best], order[k]
        for f in steps:
            f[[k, best]] = f[[best, k]]
        if m[k, k] == 0:
            m[k, k] = 1  # a pivot of nothing but rounding
        factor = np.zeros(n, dtype=object)
        for i in range(k + 1, n):
            factor[i] = m[i, k] * one // m[k, k]
            if factor[i]:
                m[i, k:] -= factor[i] * m[k, k:] // one
        steps.append(factor)

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for k in range(n):
            x[k + 1:] -= steps[k][k + 1:] * x[k] // one
        for k in range(n - 1, -1, -1):
            x[k] = (x[k] - (m[k, k + 1:] * x[k + 1:]).sum() // one) * one // m[k, k]
        largest = max(1, max(abs(v) for v in x))
        return x * one // largest

    found: list[np.ndarray] = []
    seed = 1
    while len(found) < count:
        start = np.empty(n, dtype=object)
        for i in range(n):  # a fixed pseudo-random start
            seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            start[i] = ((seed >> 11) - (1 << 52)) * one >> 52
        x = start
        for _ in range(2):
            x = solve(x)
            for v in found:
                x = x - v * ((v * x).sum() // one) // one
        norm = math.isqrt((x * x).sum())
        found.append(x * one // norm)
    return np.array([[int(x) / one for x in v] for v in found], dtype=np.float64).reshape(count, n)
