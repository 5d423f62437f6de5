"""Token counts, whitening and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.fixtures import documents, empty, frame

ODD = [" ", "  ", "\n", "\t", "'s", "'ll", "a", "Zb", "12", "é", "漢字", "，", " ", "　", " ", "<|endoftext|>", "<|", "!", "--", "\x1c", "\x85", "ß", "\r\n", "it's", "́", "🙂"]


def test_token_counts(spark):
    from loomfuse.llm.token_counts import token_counts, tokenizer

    r = random.Random(5)
    rows = documents() + [(1000 + i, "".join(r.choice(ODD) for _ in range(r.randint(0, 40))), "en", "s", 1, 0.0, "k") for i in range(300)]
    rows += [(2000, "a1b2." * 20_000, "en", "s", 1, 0.0, "k"), (2001, "x" * 70_000 + " <|endoftext|><|endoftext|> \n\n", "en", "s", 1, 0.0, "k")]
    tok = tokenizer()
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in rows)
    for common in (1 << 17, 50, 1):  # all, some or (nearly) no entries are broadcast
        got = token_counts(frame(spark, rows), common=common).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in got) == want
    assert token_counts(empty(spark)).count() == 0
    clash = frame(spark, rows[:5]).selectExpr("doc_id", "text", "1 as row", "2 as pre", "3 as often", "4 as n_tokens", "5 as n_bytes")
    assert sorted(x.n_tokens for x in token_counts(clash).collect()) == sorted(len(tok.encode(t, add_special_tokens=False).ids) for _, t, *_ in rows[:5])


def whitened_by_numpy(rows, most=4):
    """The contract in plain numpy and Python integers."""
    good = [(i, [int(np.floor(256 * float(c)) + 0) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in good]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    good = [g for g in good if len(g[1]) == d]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[x - s / n for x, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    out = []
    for i, x in good:
        for k in range(min(most, d)):
            e, u = values[-1 - k], vectors[:, -1 - k]
            if e > 1e-9:
                out.append((i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(float(np.dot([a - s / n for a, s in zip(x, sums)], u) / np.sqrt(e))), e / values.sum()))
    return out


VECTORS = "vec_id long, embedding array<double>, label int"


def test_whitening(spark):
    from loomfuse.llm.whitening import whiten

    r = np.random.default_rng(4)
    base = r.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.1, 0.02] @ r.normal(size=(6, 6))
    rows = [(int(i), [*map(float, v)], 1) for i, v in enumerate(base)] + [(500 + i, [*map(float, base[7])], 2) for i in range(40)]
    rows += [(600, None, 1), (601, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (602, [float("nan")] * 6, 1), (603, [float("inf"), *[0.0] * 5], 1), (604, [], 1), (605, [1.0], 1), (None, [0.0] * 6, 1), (3, rows[3][1], 1)]
    got = whiten(spark.createDataFrame(rows, VECTORS).selectExpr("*", "7 as n", "8 as component")).collect()
    want = whitened_by_numpy([(r[0], r[1]) for r in rows])
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    have = sorted(((g.vec_id, g.component, g.n, g.deviation, abs(g.whitened), g.explained) for g in got), key=key)
    assert len(have) == len(want) == (300 + 40 + 2) * 4
    for a, b in zip(have, sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-8) and a[5] == pytest.approx(b[5], rel=1e-10)
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for g in got:  # one sign a component: copies agree
        if g.vec_id == 7 or (g.vec_id or 0) >= 500 and g.vec_id is not None:
            assert signs.setdefault(g.component, g.whitened) == pytest.approx(g.whitened)


def test_whitening_small_and_degenerate(spark):
    from loomfuse.llm.whitening import one_sided_jacobi, pivoted_cholesky, whiten

    make = lambda rows: whiten(spark.createDataFrame(rows, VECTORS))
    assert make([]).count() == 0 and make([(1, None, 1)]).count() == 0 and make([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]).count() == 0
    line = make([(i, [float(i), 2.0 * i, 5.0], 1) for i in range(5)]).collect()  # rank one
    assert {g.component for g in line} == {1} and line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-9
    huge = make([(1, [1e300, 0.0], 1), (2, [-1e300, 1.0], 1), (3, [0.0, 3.0], 1)]).collect()
    assert {g.deviation for g in huge} == {None, 1638401} and len(huge) >= 3
    r = np.random.default_rng(1)
    for d, rank in ((1, 1), (7, 7), (12, 5), (33, 33)):
        a = r.normal(size=(d, rank)) * 10.0 ** -r.integers(0, 6, rank)
        v = a @ a.T
        order, factor = pivoted_cholesky(v)
        assert factor.shape[1] <= rank and np.allclose(np.triu(factor, 1), 0) and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12 * v.max())
        values, unit = one_sided_jacobi(factor)
        assert np.allclose(values[:4], np.sort(np.linalg.eigvalsh(v))[::-1][: min(4, len(values))], rtol=1e-9, atol=1e-12) and np.allclose(unit @ unit.T, np.eye(len(unit)), atol=1e-10)


def runs_by_definition(t, least=24):
    """All maximal stretches with a smallest period, by comparing words at every distance."""
    found = []
    for q in range(1, len(t) // 3 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q) and not any(q % p == 0 and all(t[k] == t[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_transform_is_exact():
    from loomfuse.llm import periodic_runs as R

    r = np.random.default_rng(1)
    for n in (1, 2, 4, 64, 1024):
        a = r.integers(0, R.PRIME, (3, n), dtype=np.uint64)
        assert (R.backward(R.forward(a)) == a).all()
    ids = r.integers(0, 5, 200)
    for s in (1, 2, 8, 32):
        at = np.arange(0, 200 - 3 * s, s)
        want = [[int(((ids[a : a + s] - ids[a + d : a + d + s]) ** 2).sum()) for d in range(2 * s)] for a in at]
        assert (R.mismatches(ids, at, s) == np.array(want, np.uint64)).all()


def some_words(r):
    kind, n = r.randint(0, 6), r.choice((0, 1, 23, 24, 25, 40, 90, 200, 400))
    if kind == 0:
        return [r.choice("ab") for _ in range(n)]
    if kind == 1:
        return [str(r.randint(0, 50)) for _ in range(n)]
    if kind == 2:
        base = [r.choice("abc") for _ in range(r.randint(1, 70))]
        return [base[i % len(base)] for i in range(n)]
    if kind == 3:  # Fibonacci words have many overlapping repeats
        a, b = "a", "ab"
        while len(b) < max(n, 1):
            a, b = b, b + a
        return list(b[:n])
    out = []
    while len(out) < n:
        base = [r.choice("abcd") for _ in range(r.randint(1, 40))]
        out += (base * r.randint(1, 9))[: r.randint(1, 150)] + [r.choice("abxyz") for _ in range(r.randint(0, 9))]
    return out


def test_runs_against_definition():
    from loomfuse.llm.periodic_runs import runs_of

    r = random.Random(2)
    total = 0
    for _ in range(400):
        t = some_words(r)
        want = runs_by_definition(t)
        total += len(want)
        assert runs_of(np.unique(np.array(t, object).astype(str), return_inverse=True)[1] if t else np.zeros(0, np.int64)) == want, t
    assert total > 300


def test_periodic_runs(spark):
    from loomfuse.llm.periodic_runs import find_runs, periodic_runs

    r = random.Random(3)
    rows = documents() + [(1000 + i, r.choice((" ", "\n", " \t ")).join(some_words(r)), "en", "s", 1, 0.0, "k") for i in range(150)]
    rows += [(5001, "same " * 30_000, "en", "s", 1, 0.0, "k"), (5002, " ".join(str(i % 1700) for i in range(9000)), "en", "s", 1, 0.0, "k")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for planted in (False, True):
        got = [tuple(x)[:8] for x in periodic_runs(frame(spark, rows).selectExpr("*", "1 as best", "2 as runs"), planted).collect() if (x.doc_id or 0) < 5000]
        want = []
        for doc, text, *_ in rows:
            if (doc or 0) >= 5000:
                continue
            w = (text or "").split()
            h = zlib.crc32(str(doc).encode())
            if planted and doc is not None and h % 10 == 0 and w:
                a = h // 10 % len(w)
                p = 1 + (len(w) - a) // (3 + h // 10 % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            runs = runs_by_definition(w) if len(w) < 1000 else None
            if runs is None:
                continue
            best = max(runs, key=lambda x: ((x[1] - x[0]) / x[2], -x[0], -x[2]), default=None)
            gone = {i for a, z, q in runs for i in range(a + q, z)}
            four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
            want.append((doc, len(runs), *four, sha("".join(f"{a},{z - a},{q}\n" for a, z, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
        long_ids = {d for d, t, *_ in rows if t and len(t.split()) >= 1000}
        key = lambda t: (t[0] is None, t[0] or 0)
        assert sorted((g for g in got if g[0] not in long_ids), key=key) == sorted(want, key=key)
    big = {x.doc_id: x for x in find_runs(frame(spark, rows)).where("doc_id > 5000").collect()}
    assert [(x.start, x.length, x.period) for x in big[5001].runs] == [(0, 30_000, 1)] and big[5001].collapsed == "same"
    assert [(x.start, x.length, x.period) for x in big[5002].runs] == [(0, 9000, 1700)]
    assert periodic_runs(empty(spark)).count() == 0
