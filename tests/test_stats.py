import math

import numpy as np
import pytest

from foldspark.operators import kernels as K
from foldspark.operators import solver
from foldspark.operators import stats as T
from foldspark.operators.models import candidates
from foldspark.operators.vectorize import DIRECTORIES, GENERAL, SIZES, VERSIONS, WIDTHS
from tests.plain_vectors import hashed, murmur3, vector


def test_p_values_of_known_cases():
    assert T.ttest_p(2.776445105, 5) == pytest.approx(0.05, abs=1e-6)
    assert T.ttest_p(0.0, 5) == pytest.approx(1.0)
    assert T.wilcoxon_p(0, 5) == pytest.approx(0.0625)
    assert T.mcnemar_p(0, 0) == 1.0
    assert T.mcnemar_p(90, 81) == pytest.approx(0.54081, abs=1e-5)
    assert T.ks_p(0.0, 100, 100) == 1.0
    assert T.ks_p(0.5, 100, 100) < 1e-6


def test_signed_ranks_with_ties_against_enumeration():
    rng = np.random.default_rng(3)
    for n in range(1, 13):
        for _ in range(4):
            size = rng.integers(1, rng.integers(2, n + 2), n)
            ranks = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
            sums = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1) @ ranks
            w = float(rng.choice(sums))
            w = min(w, ranks.sum() - w)
            ties = [(int(2 * r), int((ranks == r).sum())) for r in np.unique(ranks)]
            assert T.signed_rank_p(w, ties) == pytest.approx(min(1.0, 2 * (sums <= w + 1e-9).mean()))


def test_tails_of_many_disagreements():
    for n, k in ((9, 1), (171, 81), (500, 200)):
        assert T.mcnemar_p(k, n - k) == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n), rel=1e-9)
    n = 1_000_000_000
    z = 20_000 / math.sqrt(n)
    assert T.mcnemar_p(n // 2 - 10_000, n // 2 + 10_000) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)
    assert T.mcnemar_p(5, 10**9) == 0.0 and T.mcnemar_p(n // 2, n // 2) == 1.0


def test_murmur3_published_values():
    assert murmur3(b"") == 0
    assert murmur3(b"hello") & 0xFFFFFFFF == 0x248BFA47
    assert murmur3(b"hello, world") & 0xFFFFFFFF == 0x149BBB7F
    assert murmur3(b"The quick brown fox jumps over the lazy dog") & 0xFFFFFFFF == 0x2E4FF723


def test_hash_is_signed_and_additive():
    both = hashed([("a", 1.0), ("b", 2.0)], 8)
    assert np.allclose(both, hashed([("a", 1.0)], 8) + hashed([("b", 2.0)], 8))
    assert abs(hashed([("a", 1.0)], 8)).sum() == 1


def record():
    return {
        "histogram": [1] * 256, "byteentropy": [2] * 256,
        "strings": dict(numstrings=3, avlength=5.0, printabledist=[1] * 96, printables=96, entropy=4.0, paths=0, urls=1, registry=0, MZ=1),
        "general": dict.fromkeys(GENERAL, 1),
        "header": {"coff": {"timestamp": 7, "machine": "I386", "characteristics": ["A", "B"]},
                   "optional": {"subsystem": "GUI", "dll_characteristics": [], "magic": "PE32", **dict.fromkeys((*VERSIONS, *SIZES), 2)}},
        "section": {"entry": ".text", "sections": [
            dict(name=".text", size=0, entropy=1.5, vsize=9, props=["MEM_READ", "MEM_EXECUTE"]), dict(name="", size=4, entropy=2.0, vsize=8, props=["MEM_WRITE"])]},
        "imports": {"KERNEL32.dll": ["a", "b"], "kernel32.DLL": ["c"]}, "exports": ["run"],
        "datadirectories": [dict(name="x", size=1, virtual_address=2)] * 3,
    }


def test_vector_blocks():
    v = vector(record())
    assert len(v) == sum(WIDTHS.values()) == 2381 and v.dtype == np.float32
    assert v[:256].sum() == pytest.approx(1)
    at = sum(WIDTHS[b] for b in ("histogram", "byteentropy", "strings", "general", "header"))
    assert list(v[at : at + 5]) == [2, 1, 1, 1, 1]
    assert list(v[-2 * DIRECTORIES : -2 * DIRECTORIES + 8]) == [1, 2, 1, 2, 1, 2, 0, 0]
    assert len(vector(record(), ("general",))) == 10
    with pytest.raises(ValueError):
        vector(record(), version=1)


def gate_by_gate(x, encoding, beta):
    """The feature map by applying each gate to a state vector."""
    n = len(x)
    s = np.zeros((2,) * n, complex)
    s[(0,) * n] = 1

    def one(s, g, q):
        return np.moveaxis(np.tensordot(g, s, (1, q)), 0, q)

    y = beta * np.asarray(x, float)
    rz = lambda t: np.diag([np.exp(-0.5j * t), np.exp(0.5j * t)])
    if encoding == "angle":
        for q in range(n):
            c, d = math.cos(y[q] / 2), math.sin(y[q] / 2)
            s = one(s, np.array([[c, -d], [d, c]]), q)
        for q in range(n - 1):
            t = np.moveaxis(s, (q, q + 1), (0, 1)).copy()
            t[1] = t[1][::-1].copy()
            s = np.moveaxis(t, (0, 1), (q, q + 1))
        for q in range(n):
            s = one(s, rz(y[q]), q)
    else:
        for q in range(n):
            s = one(s, np.array([[1, 1], [1, -1]]) / math.sqrt(2), q)
        for q in range(n):
            s = one(s, rz(y[q]), q)
        for i in range(n):
            for j in range(i + 1, n):
                z = np.indices((2,) * n)
                s = s * np.exp(-0.5j * y[i] * y[j] * (1 - 2 * z[i]) * (1 - 2 * z[j]))
    return s.ravel()


@pytest.mark.parametrize("encoding", ["angle", "iqp"])
@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_states_agree_with_gates(encoding, n):
    x = np.random.default_rng(n).uniform(0, math.pi, (4, n))
    got = K.states(x, encoding, 0.7)
    for row, state in zip(x, got, strict=True):
        assert np.allclose(gate_by_gate(row, encoding, 0.7), state, atol=1e-12)


@pytest.mark.parametrize("encoding", ["angle", "iqp", "amplitude"])
def test_kernel_is_a_kernel(encoding):
    x = np.random.default_rng(0).uniform(0.1, math.pi, (12, 3))
    k = K.fidelity(x, x, encoding)
    assert np.allclose(k, k.T) and np.allclose(np.diag(k), 1)
    assert k.min() > -1e-9 and k.max() < 1 + 1e-9 and np.linalg.eigvalsh(k).min() > -1e-9
    with pytest.raises(ValueError):
        K.states(x, "other")


def test_solver_separates_and_meets_its_constraints():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(4, 1, (30, 2))])
    y = np.repeat([-1, 1], 30)
    k = K.rbf(x, x, 0.5)
    a, b = solver.fit(k, y, 1.0)
    assert (np.sign(solver.decide(k, a, b)) == y).mean() > 0.95
    assert abs(a.sum()) < 1e-9 and (np.abs(a) <= 1 + 1e-9).all()
    assert solver.macro_f1(np.array([0, 0, 1]), np.array([0, 0, 1])) == 1.0


def test_parameter_draws_are_seeded():
    assert candidates("svm", 4) == candidates("svm", 4)
    assert candidates("svm", 4) != candidates("svm", 4, seed=1)
    with pytest.raises(ValueError):
        candidates("other", 1)
