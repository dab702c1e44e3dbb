import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.errors import Corrupt, InvalidTraining
from quillon.functions import bounds, codec
from quillon.plans.training import train
from quillon.sources.generated import parse, rows
from quillon.spec import ONE, SPEC_64, SPEC_768, CodecSpec

SPECS = [SPEC_64, CodecSpec(768, 128, centroids=8)]
MODEL = train(rows("correlated", 64, np.arange(500), 1), SPEC_64, 3)


def test_the_hadamard_transform_is_its_own_inverse_and_the_defined_matrix():
    x = rows("gaussian", 64, np.arange(5), 0)
    assert np.abs(codec.hadamard(codec.hadamard(x, 32), 32) - x).max() < 1e-5
    h = np.array([[(-1) ** (i & j).bit_count() for j in range(32)] for i in range(32)]) / math.sqrt(32)
    assert np.abs(codec.hadamard(x, 32)[:, :32] - x[:, :32] @ h).max() < 1e-5


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(SPECS))
def test_rotation_keeps_lengths_and_products_and_can_be_undone(seed, spec):
    r = codec.Rotation.of(spec, seed)
    x = codec.directions(rows("gaussian", spec.dim, np.arange(3), seed))
    y = r.forward(x)
    exact = x.astype(float)
    assert np.abs(r.inverse(y) - x).max() < 1e-6
    assert np.abs(y.astype(float) @ y.astype(float).T - exact @ exact.T).max() <= bounds.eta_transform(spec)
    assert r.identity == codec.Rotation.of(spec, seed).identity != codec.Rotation.of(spec, seed + 1).identity


def test_centers_are_values_of_the_stated_ranks_and_zero_has_no_sign():
    y = np.array([[-0.0, 5], [1, 4], [2, 3], [3, 2], [4, 1]], np.float32)
    c = codec.quantile_centers(y, 16)
    assert [list(r) for r in c] == [[np.sort(y[:, i])[k * 4 // 15] for k in range(16)] for i in range(2)]
    assert not np.signbit(c).any()


def test_codes_are_the_first_of_nearest_centers_and_pack_two_to_a_byte():
    centers = np.array([[0, 1, 1, 2], [-1, 0, 0, 5]], np.float32)
    codes = codec.encode_centers(np.array([[1, 0], [0.5, 2.5], [9, -9]], np.float32), centers)
    assert codes.tolist() == [[1, 1], [0, 1], [3, 0]]
    packed = codec.pack(codes)
    assert packed.tolist() == [[17], [16], [3]] and (codec.unpack(packed) == codes).all()
    with pytest.raises(ValueError):
        codec.pack(np.array([[16, 0]], np.uint8))


def test_residual_codes_are_the_nearest_centroids():
    r = rows("gaussian", 64, np.arange(20), 2)
    got = codec.encode_residual(r, MODEL.codebook)
    for s in range(8):
        d = ((r[:, None, s * 8 : s * 8 + 8].astype(float) - MODEL.codebook[s].astype(float)) ** 2).sum(2)
        assert (d[np.arange(20), got[:, s]] <= d.min(1) + 1e-9).all()


def test_kmeans_fills_empty_clusters_and_never_increases_the_error():
    x = np.repeat(np.array([[0.0], [1.0], [50.0]], np.float32), 5, axis=0)
    c, said = codec.kmeans(x, 4, [1])
    assert set(c[:, 0].tolist()) >= {0.0, 1.0, 50.0} and said["iterations"] <= 25
    y = rows("gaussian", 8, np.arange(300), 4)
    error = lambda book: codec._square_distances(y, book).min(1).sum()
    assert error(codec.kmeans(y, 16, [2], 10)[0]) <= error(codec.kmeans(y, 16, [2], 1)[0]) + 1e-6


def test_q24_rounds_halves_away_from_zero():
    assert codec.q24(np.array([0.5, 1.5, -0.5, -1.5, 0.49]) / ONE).tolist() == [1, 2, -1, -2, 0]


def test_the_narrow_and_the_wide_kernel_agree_with_a_plain_sum():
    codes = codec.encode_centers(MODEL.rotation.forward(codec.directions(rows("gaussian", 64, np.arange(40), 5))), MODEL.centers)
    table = codec.query_tables(MODEL.rotation.forward(codec.directions(rows("gaussian", 64, np.arange(1), 6))), MODEL)[0][0]
    plain = [sum(int(table[c][k]) for c, k in enumerate(row)) for row in codes]
    assert codec.scan(codes, table).tolist() == plain
    assert codec.scan(codes, table * 4096).tolist() == [4096 * p for p in plain]  # leaves 32 bits


def test_every_half_precision_length_has_its_units_and_its_cell():
    bits = np.arange(0x7C00)
    values = bits.astype(np.uint16).view(np.float16).astype(np.float64)
    assert (codec.units(bits) == values * 2.0**24).all()
    low, high = bounds.length_interval(bits)
    assert (low <= values).all() and (values <= high).all()
    middle = (values[:-1] + values[1:]) / 2
    assert (high[:-1] >= middle).all() and (low[1:] <= middle).all()
    back = np.nextafter(middle, 0).astype(np.float16).view(np.uint16)
    assert ((low[back] <= np.nextafter(middle, 0)) & (np.nextafter(middle, 0) <= high[back])).all()


@pytest.mark.parametrize("case", ["basis", "alternating", "flat", "gaps", "random"])
def test_true_cosines_lie_in_their_intervals(case):
    d = 64
    x = {
        "basis": np.eye(d, dtype=np.float32), "alternating": np.array([[(-1) ** i for i in range(d)]], np.float32), "flat": np.full((1, d), 0.125, np.float32),
        "gaps": (2.0 ** ((np.arange(d) * 37) % 60 - 30) * (-1.0) ** np.arange(d))[None].astype(np.float32), "random": rows("gaussian", d, np.arange(200), 9),
    }[case]
    q = np.concatenate([x[:1], rows("gaussian", d, np.arange(5), 10)])
    y = MODEL.rotation.forward(codec.directions(x))
    codes, res, p, e = codec.encode(y, MODEL)
    a, b, _ = codec.errors(y, p, e, MODEL.centers)
    left, right = codec.query_tables(MODEL.rotation.forward(codec.directions(q)), MODEL)
    for i in range(len(q)):
        primary = codec.scan(codes, left[i])
        refined = codec.refine(primary, res, right[i])
        assert (refined == codec.refine_decoded(primary, res, MODEL.rotation.forward(codec.directions(q[i : i + 1]))[0], MODEL.codebook)).all()
        eps = [np.array([bounds.epsilon(SPEC_64, v, r) for v in err]) for err, r in ((a, False), (b, True))]
        low, high = bounds.cosine_interval(primary, refined, *eps)
        for j in range(len(x)):
            true = math.sumprod(x[j].astype(float), q[i].astype(float)) / math.hypot(*x[j].astype(float)) / math.hypot(*q[i].astype(float))
            assert low[j] <= true <= high[j]


def test_training_refuses_too_few_rows_and_models_refuse_spoilt_tables():
    with pytest.raises(InvalidTraining):
        train(rows("gaussian", 64, np.arange(255), 0), SPEC_64, 0)
    MODEL.check()
    spoilt = MODEL.centers.copy()
    spoilt[0, :2] = [5, -5]
    with pytest.raises(Corrupt):
        codec.Model(SPEC_64, MODEL.rotation, spoilt, MODEL.codebook, {}).check()


def test_the_length_correction_and_its_guard():
    refined = np.array([100, 200])
    assert codec.corrected(refined, np.array([0.5, 0.0])).tolist() == [200.0, 200.0]


def test_specs_and_corpus_names():
    assert (SPEC_768.subs, SPEC_768.stages) == (96, 7)
    with pytest.raises(ValueError):
        CodecSpec(60, 32)
    assert parse("generated-gaussian-64x10") == ("gaussian", 64, 10)
    with pytest.raises(ValueError):
        parse("generated-other-64x10")
    assert (rows("correlated", 8, np.arange(4), 1)[2:] == rows("correlated", 8, np.arange(2, 4), 1)).all()
