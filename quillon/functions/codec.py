"""The codec on NumPy blocks: rotation, quantile centers, product quantiser, integer scores.

Everything that ends in a comparison or a sum loops over coordinates and is vectorised over rows, so that results
do not depend on how rows are grouped.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np

from quillon.errors import Corrupt, InvalidTraining
from quillon.spec import LEAST_NORM, LEAST_TRAINING, MAX_TRAINING, ONE, CodecSpec


def norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        v = x[:, c].astype(np.float64)
        total += v * v
    return np.sqrt(total)


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; zero rows where there is no direction."""
    n = norms(x)
    ok = n >= LEAST_NORM
    return np.where(ok[:, None], x.astype(np.float64) / np.where(ok, n, 1.0)[:, None], 0).astype(np.float32)


def hadamard(x: np.ndarray, block: int) -> np.ndarray:
    """Orthonormal Hadamard transform of every block of coordinates, by butterflies in single precision."""
    blocks = x.shape[1] // block
    y = x.astype(np.float32).reshape(len(x), blocks, block)
    step = 1
    while step < block:
        z = y.reshape(len(y), blocks, block // (2 * step), 2, step)
        y = np.stack([z[..., 0, :] + z[..., 1, :], z[..., 0, :] - z[..., 1, :]], axis=-2).reshape(len(y), blocks, block)
        step *= 2
    return (y * (np.float32(1) / np.sqrt(np.float32(block)))).reshape(x.shape)


@dataclass(frozen=True)
class Rotation:
    """Per round random signs, a permutation, and the block transform."""

    spec: CodecSpec
    seed: int
    signs: tuple
    order: tuple

    @classmethod
    def of(cls, spec: CodecSpec, seed: int) -> Rotation:
        rng = np.random.Generator(np.random.PCG64([seed, spec.dim, spec.block, spec.rounds]))
        rounds = [(rng.integers(0, 2, spec.dim) * 2 - 1, rng.permutation(spec.dim)) for _ in range(spec.rounds)]
        return cls(spec, seed, tuple(s.astype(np.float32) for s, _ in rounds), tuple(p for _, p in rounds))

    @property
    def identity(self) -> str:
        h = hashlib.sha256(json.dumps([self.spec.dim, self.spec.block, self.spec.rounds, self.seed]).encode())
        for s, p in zip(self.signs, self.order):
            h.update(s.astype("<f4").tobytes() + p.astype("<i8").tobytes())
        return h.hexdigest()

    def forward(self, x: np.ndarray) -> np.ndarray:
        y = x.astype(np.float32)
        for s, p in zip(self.signs, self.order):
            y = hadamard((y * s)[:, p], self.spec.block)
        return y

    def inverse(self, y: np.ndarray) -> np.ndarray:
        x = y.astype(np.float32)
        for s, p in zip(reversed(self.signs), reversed(self.order)):
            z = np.empty_like(x)
            z[:, p] = hadamard(x, self.spec.block)
            x = z * s
        return x


def quantile_centers(y: np.ndarray, centers: int) -> np.ndarray:
    """Per coordinate the training values of ranks floor(c (n - 1) / (centers - 1)); -0 becomes 0."""
    ranks = np.arange(centers) * (len(y) - 1) // (centers - 1)
    return np.sort(y, axis=0)[ranks].T + np.float32(0)


def encode_centers(y: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each coordinate, the first of equally near ones."""
    codes = np.empty(y.shape, np.uint8)
    for c in range(y.shape[1]):
        codes[:, c] = np.abs(y[:, c, None] - centers[c]).argmin(1)
    return codes


def decode_centers(codes: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return centers[np.arange(len(centers)), codes]


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.max(initial=0) > 15:
        raise ValueError("a code takes 4 bits")
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), 2 * packed.shape[1])


def _square_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(centroids)))
    for lane in range(x.shape[1]):
        diff = x[:, lane, None].astype(np.float64) - centroids[:, lane].astype(np.float64)
        d += diff * diff
    return d


def kmeans(x: np.ndarray, k: int, seed: list[int], rounds: int = 25) -> tuple[np.ndarray, dict]:
    """k-means++ and at most 25 Lloyd rounds; an empty cluster restarts at the row of largest error not yet used."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = min(k, len(x))
    chosen = [int(rng.integers(len(x)))]
    mass = _square_distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        total = mass.sum()
        if total > 0:
            pick = int(np.searchsorted(np.cumsum(mass), rng.random() * total, side="right"))
            pick = min(pick, len(x) - 1)
        else:
            pick = next(i for i in range(len(x)) if i not in set(chosen))
        chosen.append(pick)
        mass = np.minimum(mass, _square_distances(x, x[[pick]])[:, 0])
    centroids, before, moved, reseeds, n = x[chosen].astype(np.float32), None, 0, 0, 0
    for n in range(1, rounds + 1):
        d = _square_distances(x, centroids)
        own = d.argmin(1)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, own, x.astype(np.float64))
        new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], 0).astype(np.float32)
        far = iter(np.argsort(-d[np.arange(len(x)), own], kind="stable"))
        for c in np.flatnonzero(sizes == 0):
            new[c] = x[next(far)]
            reseeds += 1
        moved += int((new != centroids).any(1).sum())
        same = before is not None and (own == before).all() and (new == centroids).all()
        centroids, before = new, own
        if same:
            break
    return centroids, {"iterations": n, "moves": moved, "reseeds": reseeds}


def encode_residual(r: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """The nearest centroid of each sub-vector in double precision, the first of equally near ones."""
    subs, _, sub = codebook.shape
    return np.stack([_square_distances(r[:, s * sub : (s + 1) * sub], codebook[s]).argmin(1) for s in range(subs)], axis=1).astype(np.uint8)


def decode_residual(codes: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    return codebook[np.arange(len(codebook)), codes].reshape(len(codes), len(codebook) * codebook.shape[2])


def q24(v: np.ndarray) -> np.ndarray:
    """Times 2^24, rounded half away from zero."""
    x = v * float(ONE)
    return np.where(x >= 0, np.floor(x + 0.5), np.ceil(x - 0.5)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """What all rows of an index share."""

    spec: CodecSpec
    rotation: Rotation
    centers: np.ndarray
    codebook: np.ndarray
    baseline: dict

    @property
    def identity(self) -> str:
        parts = (self.rotation.identity.encode(), self.centers.astype("<f4").tobytes(), self.codebook.astype("<f4").tobytes())
        return hashlib.sha256(b"".join(parts)).hexdigest()

    def check(self) -> None:
        """Refuse tables that training cannot have made."""
        s = self.spec
        if self.centers.shape != (s.dim, s.centers) or self.codebook.shape[::2] != (s.subs, s.sub) or not 1 <= self.codebook.shape[1] <= s.centroids:
            raise Corrupt("tables of the wrong shape")
        if not np.isfinite(self.centers).all() or not np.isfinite(self.codebook).all():
            raise Corrupt("tables that are not finite")
        if (np.diff(self.centers, axis=1) < 0).any() or (np.signbit(self.centers) & (self.centers == 0)).any():
            raise Corrupt("centers out of order")


def split_training(rows: int, seed: int, validation: int) -> np.ndarray:
    """True for the rows that validate: those of smallest hash of seed and position."""
    keys = [hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(rows)]
    mask = np.zeros(rows, bool)
    mask[sorted(range(rows), key=keys.__getitem__)[:validation]] = True
    return mask


def train_tables(x: np.ndarray, spec: CodecSpec, seed: int, validation: int) -> tuple[Rotation, np.ndarray, np.ndarray, np.ndarray]:
    """Rotation, centers, residuals of the training rows, and the rotated validation rows."""
    if not LEAST_TRAINING <= len(x) - validation or len(x) > MAX_TRAINING or validation < 1:
        raise InvalidTraining(f"{len(x)} rows of which {validation} validate")
    rotation = Rotation.of(spec, seed)
    y = rotation.forward(directions(x))
    held = split_training(len(x), seed, validation)
    centers = quantile_centers(y[~held], spec.centers)
    return rotation, centers, y[~held] - decode_centers(encode_centers(y[~held], centers), centers), y[held]


def encode(y: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, residual codes, and the decoded parts of rotated rows."""
    codes = encode_centers(y, model.centers)
    p = decode_centers(codes, model.centers)
    res = encode_residual(y - p, model.codebook)
    return codes, res, p, decode_residual(res, model.codebook)


def errors(y: np.ndarray, p: np.ndarray, e: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of what the centers leave, of what the residual leaves, and the share of coordinates outside the centers."""
    a, b = np.zeros(len(y)), np.zeros(len(y))
    for c in range(y.shape[1]):
        t, q, r = (v[:, c].astype(np.float64) for v in (y, p, e))
        a += (t - q) ** 2
        b += (t - (q + r)) ** 2
    outside = ((y < centers[:, 0]) | (y > centers[:, -1])).sum(1) / y.shape[1]
    return np.sqrt(a), np.sqrt(b), outside


def query_tables(q: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Integer scores of every center and centroid for rotated queries: (queries, dim, centers), (queries, subs, centroids)."""
    x = q.astype(np.float64)
    left = q24(x[:, :, None] * model.centers.astype(np.float64)[None])
    subs, k, sub = model.codebook.shape
    right = np.zeros((len(q), subs, k))
    for lane in range(sub):
        right += x.reshape(len(q), subs, sub)[:, :, lane, None] * model.codebook[:, :, lane].astype(np.float64)[None]
    return left, q24(right)


def scan(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Primary scores of all rows for one query. 32-bit sums are used where no sum can leave their range."""
    if len(table) * int(np.abs(table).max(initial=0)) < 1 << 31:
        table = table.astype(np.int32)
    total = np.zeros(len(codes), table.dtype)
    for c in range(len(table)):
        total += table[c].take(codes[:, c])
    return total.astype(np.int64)


def float_score(y: np.ndarray, codes: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The primary score of each pair of a rotated query and a code in single precision, summed in coordinate order."""
    total = np.zeros(len(y), np.float32)
    for c in range(y.shape[1]):
        total += y[:, c].astype(np.float32) * centers[c].take(codes[:, c])
    return total


def refine(primary: np.ndarray, res: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = primary.copy()
    for s in range(len(table)):
        total += table[s].take(res[:, s])
    return total


def refine_decoded(primary: np.ndarray, res: np.ndarray, query: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """The same from decoded centroids and one rotated query, without tables."""
    total = primary.copy()
    for s in range(len(codebook)):
        v = np.zeros(len(res))
        for lane in range(codebook.shape[2]):
            v += float(query[s * codebook.shape[2] + lane]) * codebook[s, res[:, s], lane].astype(np.float64)
        total += q24(v)
    return total


def lengths(p: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Length of the reconstruction, which is never rounded to single precision."""
    total = np.zeros(len(p))
    for c in range(p.shape[1]):
        v = p[:, c].astype(np.float64) + e[:, c].astype(np.float64)
        total += v * v
    return np.sqrt(total)


def corrected(refined: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Refined scores over the reconstruction's length, as they are where that is not a normal number."""
    ok = np.isfinite(length) & (length >= np.finfo(np.float64).tiny)
    return refined.astype(np.float64) / np.where(ok, length, 1.0)


def half_bits(norm: np.ndarray) -> np.ndarray:
    return norm.astype(np.float16).view(np.uint16).astype(np.int32)


def units(bits: np.ndarray) -> np.ndarray:
    """Half-precision numbers as multiples of 2^-24."""
    e, f = bits >> 10, (bits & 1023).astype(np.int64)
    return np.where(e == 0, f, (f + 1024) << np.maximum(e - 1, 0).astype(np.int64))
