"""Bounds on the error of compressed scores.

A rotation stage multiplies the length of a vector by a known factor, and rounding each result to single
precision moves the vector by at most u = 2^-24 of that length. So after m roundings a rotated unit vector lies
within gamma(m) of the exact one, and a score differs from the true cosine by at most

    eta_transform + |query| * |row - reconstruction| + eta_serving.

Each sum below is widened by a relative SLACK far above what its own double-precision rounding can be.
"""

from __future__ import annotations

import math

import numpy as np

from quillon.errors import CertificateInvalid
from quillon.spec import ONE, CodecSpec

U = 2.0**-24
SLACK = 2.0**-40


def up(x):
    """The next number above."""
    return np.nextafter(x, np.inf)


def down(x):
    return np.nextafter(x, -np.inf)


def gamma(m: int, u: float = U) -> float:
    return m * u / (1 - m * u)


def transform_error(spec: CodecSpec) -> float:
    """How far, at most, a rotated unit vector is from the exact rotation of the exact direction."""
    return gamma(spec.rounds * (spec.stages + 2) + 2) * (1 + SLACK)


def query_norm_upper(spec: CodecSpec) -> float:
    return (1 + transform_error(spec)) * (1 + SLACK)


def eta_transform(spec: CodecSpec) -> float:
    d = transform_error(spec)
    return (2 * d + d * d) * (1 + SLACK)


def eta_serving(spec: CodecSpec, refined: bool) -> float:
    """Half a unit per table entry, and what rounding in double precision can add to an entry."""
    entries = spec.dim + (spec.subs if refined else 0)
    return entries * (0.5 / ONE + 2.0**-48) * (1 + SLACK)


def query_errors(y: np.ndarray, centers: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per rotated query: how far its integer primary and refined scores, over 2^24, can be from the sums of products
    they stand for. Half a unit per table entry, and what double precision adds to that many terms of at most the
    largest size that this query's tables hold."""
    x = np.abs(y.astype(np.float64))
    dim, (subs, _, sub) = y.shape[1], codebook.shape
    primary = dim * (x * np.abs(centers.astype(np.float64)).max(1)).max(1)
    parts = np.zeros((len(y), subs, codebook.shape[1]))
    for lane in range(sub):
        parts += x.reshape(len(y), subs, sub)[:, :, lane, None] * np.abs(codebook[:, :, lane].astype(np.float64))[None]
    residual = subs * parts.max((1, 2))
    gap = lambda size, terms, entries: (size * gamma(terms, 2.0**-53) + entries * 0.5 / ONE) * (1 + SLACK)
    return gap(primary, dim + 2, dim), gap(primary + residual, 2 * dim + subs + 2, dim + subs)


def epsilon(spec: CodecSpec, reconstruction_error: float, refined: bool) -> float:
    return (eta_transform(spec) + query_norm_upper(spec) * reconstruction_error * (1 + SLACK) + eta_serving(spec, refined)) * (1 + SLACK)


def check_terms(spec: CodecSpec, terms: dict, refined: bool) -> None:
    """Refuse stored terms that the present budget does not give."""
    e = terms["reconstruction_error"]
    if not (math.isfinite(e) and e >= 0 and terms["epsilon"] == epsilon(spec, e, refined)):
        raise CertificateInvalid(f"stored terms {terms}")


def cosine_interval(primary: np.ndarray, refined: np.ndarray, eps_primary: np.ndarray, eps_refined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The common part of both intervals; raw integer scores, not length-corrected ones."""
    low = np.maximum(down(primary / ONE - eps_primary), down(refined / ONE - eps_refined))
    high = np.minimum(up(primary / ONE + eps_primary), up(refined / ONE + eps_refined))
    if (low > high).any():
        raise CertificateInvalid("intervals that do not meet")
    return np.maximum(low, -1.0 - SLACK), np.minimum(high, 1.0 + SLACK)


def length_interval(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths that round to a stored half-precision number."""
    value = bits.astype(np.uint16).view(np.float16).astype(np.float64)
    above = np.minimum(bits + 1, 0x7BFF).astype(np.uint16).view(np.float16).astype(np.float64)
    below = np.maximum(bits - 1, 0).astype(np.uint16).view(np.float16).astype(np.float64)
    high = np.where(above > value, (value + above) / 2, 65_520.0)
    return np.maximum(0.0, (value + below) / 2) * (1 - SLACK), high * (1 + SLACK)


def product_interval(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[low, high] times [a, b], widened outward."""
    products = np.stack([low * a, low * b, high * a, high * b])
    return down(products.min(0)), up(products.max(0))


def dot_interval(low: np.ndarray, high: np.ndarray, bits: np.ndarray, query_length: float) -> tuple[np.ndarray, np.ndarray]:
    a, b = length_interval(bits)
    low, high = product_interval(low, high, a, b)
    low, high = product_interval(low, high, np.full(len(low), query_length * (1 - SLACK)), np.full(len(low), query_length * (1 + SLACK)))
    if not (np.isfinite(low).all() and np.isfinite(high).all()):
        raise CertificateInvalid("a bound that is not finite")
    return low, high
