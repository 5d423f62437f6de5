"""Decontamination, substring dedup, line dedup, Jaccard join and quality rules against brute force."""

import hashlib
import re

import pytest

from tests.llm.fixtures import documents, empty, frame

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
NONE = -(2**63)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def unique(rows):
    return {(NONE if r[0] is None else r[0]): r[1] or "" for r in rows}


@pytest.fixture(scope="module")
def rows():
    return documents()


def collected(df):
    return {(NONE if r.doc_id is None else r.doc_id): r for r in df.collect()}


def test_decontaminate(spark, rows):
    from loomfuse.llm.decontaminate import decontaminate, drop_contaminated

    docs = unique(rows)
    some = WORD.findall(docs[6])
    items = [(1, " ".join(some[5:20]).upper().replace("É", "é")), (2, "two WORDS!"), (10, " ".join(some[5:16])), (3, None), (4, "..."), (5, "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pat = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    fold = lambda t: pat.findall((t or "").translate(LOW))
    for most in (1 << 20, 40):
        got = collected(decontaminate(frame(spark, rows), bench, most=most))
        for i, text in docs.items():
            w, hit, ids = fold(text), set(), set()
            for item, t in items:
                v = fold(t)
                for win in {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else ():
                    for at in range(len(w) - len(win) + 1):
                        if tuple(w[at : at + len(win)]) == win:
                            hit.update(range(at, at + len(win)))
                            ids.add(str(item))
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)), i
            for s in r.spans:
                assert len(fold(text[s.start : s.stop])) > 0 and set(fold(text[s.start : s.stop])) <= set(w)
    assert decontaminate(empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate(frame(spark, rows), bench.limit(0)).collect())
    kept = drop_contaminated(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows) - sum(r.contaminated for r in got.values())


def test_decontaminate_rows_and_null_items_at_every_size(spark):
    from loomfuse.llm.decontaminate import decontaminate

    rows = [(i, t, "en", "s", 1, 0.0, None) for i, t in ((1, "a b c d"), (1, "a b c d"), (None, "x a b"), (None, "c d"), (None, None), (2, "c d nobody a b"), (3, "nobody has it"))]
    bench = spark.createDataFrame([(7, "a b"), (None, "nobody"), (None, "c d"), (8, "d")], "item_id long, text string")
    want = sorted((NONE if i is None else i, n, hit, items, sha(ids)) for i, n, hit, items, ids in ((1, 4, 4, 3, "7,8"), (1, 4, 4, 3, "7,8"), (None, 3, 2, 1, "7"), (None, 2, 2, 2, "8"), (None, 0, 0, 0, ""), (2, 5, 5, 3, "7,8"), (3, 3, 1, 1, "")))
    for most in (1 << 20, 1):
        got = decontaminate(frame(spark, rows), bench, most=most).collect()
        assert sorted((NONE if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want


@pytest.mark.parametrize("combine", [40 << 20, 1])
def test_substring_dedup(spark, rows, combine, monkeypatch):
    from loomfuse.llm import substring_dedup as S

    monkeypatch.setattr(S, "COMBINE", combine)
    docs = {i: WORD.findall(t) for i, t in unique(rows).items()}
    first = {}
    for i in sorted(docs, reverse=True):
        for k in range(len(docs[i]) - 49):
            first[tuple(docs[i][k : k + 50])] = i
    got = collected(S.substring_dedup(frame(spark, rows)))
    lost = 0
    for i, w in docs.items():
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        lost += len(gone)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)), i
    assert lost > 500
    assert S.substring_dedup(empty(spark)).count() == 0


def lines_brute(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    owner = {}
    for i in sorted(docs, reverse=True):
        for x in docs[i].split("\n"):
            if len(key(x)) >= 10:
                owner[key(x)] = i
    return {i: [x for x in t.split("\n") if owner.get(key(x), i) == i] for i, t in docs.items()}


def test_line_dedup_and_reversal(spark, rows):
    from pyspark.sql import functions as F

    from loomfuse.llm.line_dedup import LineIndex, dedup_documents, line_dedup

    docs, df = unique(rows), frame(spark, rows)
    want = lines_brute(docs)
    got = collected(line_dedup(df))
    assert {i: r.kept for i, r in got.items()} == {i: "\n".join(x) for i, x in want.items()}
    assert all(r.n_lines - r.n_dropped == len(want[i]) for i, r in got.items() if docs[i])
    odd, even = (df.where((F.coalesce("doc_id", F.lit(0)) % 2) == k) for k in (1, 0))
    one = LineIndex.create(spark, 100).insert(odd)
    both = one.insert(even)
    state = lambda x: sorted(map(tuple, x.refs.select("key", "n", "owner").collect()))
    assert state(both) == state(LineIndex.create(spark, 100).insert(df))
    assert state(both.delete(even.select("doc_id"))) == state(one)
    out = dedup_documents(df)
    assert out.schema.simpleString() == df.schema.simpleString() and out.count() == len(rows)
    assert line_dedup(empty(spark)).count() == 0


def test_line_filter_spares_look_ups(spark):
    from loomfuse.llm.line_dedup import LineIndex, line_key

    lines = [f"line number {k} of them" for k in range(400)]
    rows = lambda first, ids: frame(spark, [(i, "\n".join(lines[first + 10 * k : first + 10 * k + 10]), "en", "s", 1, 0.0, None) for k, i in enumerate(ids)])
    one = LineIndex.create(spark, 100).insert(rows(0, range(20)))  # 200 keys
    both = one.insert(rows(150, range(100, 120)))  # 50 of them again, 150 new ones
    asked = {bytes(r.key) for r in both.looked_up.collect()}
    again = {line_key(x.encode()) for x in lines[150:200]}
    assert again <= asked and len(asked) <= 55  # but for a few that the filter mistakes
    count = {bytes(r.key): (r.n, r.owner) for r in both.refs.collect()}
    assert len(count) == 350 and all(count[k] == (2, 15 + i // 10) for i, k in enumerate(line_key(x.encode()) for x in lines[150:200]))


def test_line_deletion_spares_like_keys(spark):
    """Two keys with one fingerprint and bucket have a cell each: the deletion of one leaves the other known."""
    from loomfuse.llm.line_dedup import CuckooFilter, LineIndex, ShardFilter, line_key

    a, b = "a line with number 9374 in it", "a line with number 10224 in it"
    one = ShardFilter()
    one.insert(line_key(a.encode()))
    assert line_key(b.encode()) in one  # the filter takes one for the other
    rows = lambda *xs: frame(spark, [(i, t, "en", "s", 1, 0.0, None) for i, t in xs])
    for start in (LineIndex.create(spark, 10).insert(rows((1, a), (2, b))), LineIndex.create(spark, 10).insert(rows((1, a))).insert(rows((2, b)))):
        index = start.delete(rows((1, a)).select("doc_id")).insert(rows((3, b), (4, a)))
        state = {bytes(r.key): (r.n, r.owner) for r in index.refs.collect()}
        assert state == {line_key(b.encode()): (2, 2), line_key(a.encode()): (1, 4)} and index.refs.count() == 2
        assert [(r.doc_id, len(r["keys"])) for r in index.drops().collect()] == [(3, 1)]
    # filters of different sizes: a cell that may be another's stays
    keys = [line_key(f"one more line, number {k}".encode()) for k in range(30_000)]
    shard = ShardFilter()
    for k in keys:
        shard.insert(k)
    assert len(shard.filters) > 2
    for k in keys[::2]:
        shard.delete(k)
    assert all(k in shard for k in keys[1::2]) and isinstance(shard.filters[0], CuckooFilter)


def test_line_index_over_generations(spark, monkeypatch):
    """Inserting, deleting and inserting again in any order equals an index of what is left, merged logs included; ids that many rows have."""
    import random

    from loomfuse.llm import line_dedup as L

    monkeypatch.setattr(L, "GENERATIONS", 3)
    r = random.Random(3)
    lines = [f"some line of the number {k}" for k in range(12)]
    index, held = L.LineIndex.create(spark, 10), {}
    for _ in range(5):
        new = {i: "\n".join(r.choice(lines) for _ in range(3)) for i in r.sample(range(12), 4) if i not in held}
        index = index.insert(frame(spark, [(i, t, "en", "s", 1, 0.0, None) for i, t in new.items() for _ in range(1 + i % 2)]))
        held |= new
        gone = r.sample(sorted(held), min(len(held), 2))
        index = index.delete(frame(spark, [(i, None, None, None, None, None, None) for i in gone]))
        held = {i: t for i, t in held.items() if i not in gone}
    want = {}
    for i in sorted(held):
        for key in {L.line_key(x.encode()) for x in held[i].split("\n")}:
            n, owner = want.get(key, (0, i))
            want[key] = (n + 1, owner)
    assert {bytes(x.key): (x.n, x.owner) for x in index.refs.collect()} == want


def test_documents_with_clashing_names(spark):
    from pyspark.sql import functions as F

    from loomfuse.llm.common import without
    from loomfuse.llm.line_dedup import dedup_documents

    df = frame(spark)
    for c in ("_id", "_keys", "keys", "id", "gone", "_gone", "_gone_id"):
        df = df.withColumn(c, F.lit(1))
    out = dedup_documents(df)
    assert out.columns == df.columns and out.count() == df.count() and out.where("id = 1 and keys = 1").count() == df.count()
    assert out.where("doc_id is null").count() == 1
    left = without(df, df.where("doc_id is null or doc_id = 0").select("doc_id"))
    assert left.columns == df.columns and left.count() == df.count() - 2


def test_cuckoo_filter():
    import os

    from loomfuse.llm.line_dedup import CuckooFilter, ShardFilter

    keys = [os.urandom(16) for _ in range(3000)]
    f = CuckooFilter(keys=keys[:2000])
    assert all(k in f for k in keys[:2000]) and sum(k in f for k in keys[2000:]) < 5
    for k in keys[:1000]:
        assert f.delete(k)
    assert all(k in f for k in keys[1000:2000]) and sum(k in f for k in keys[:1000]) < 5
    assert all(k in CuckooFilter.frombytes(f.tobytes()) for k in keys[1000:2000])
    # a filter that is full refuses keys and keeps those it has
    small = CuckooFilter(slots=64)
    held = [k for k in keys if small.insert(k)]
    assert 50 <= len(held) <= 64 and all(k in small for k in held)
    shard = ShardFilter()
    for k in keys:
        shard.insert(k)
    again = ShardFilter(shard.blobs())
    assert len(again.filters) > 1 and all(k in again for k in keys)
    for k in keys[:1500]:
        again.delete(k)
    assert all(k in again for k in keys[1500:]) and sum(k in again for k in keys[:1500]) < 10


def shingle_sets(docs):
    out = {}
    for i, t in docs.items():
        w = WORD.findall(t.translate(LOW))
        out[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    return out


def components_brute(sets):
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label, pairs


@pytest.mark.parametrize("chunk", [2 << 20, 500])
def test_jaccard(spark, rows, chunk, monkeypatch):
    import random

    from loomfuse.llm import jaccard_join as J

    monkeypatch.setattr(J, "COMMON", 50)
    monkeypatch.setattr(J, "SMALL", 256 if chunk > 500 else 3)
    r = random.Random(5)
    base, more = [f"w{k}" for k in range(300)], list(rows)
    for k in range(30):  # a chain and a cloud of near copies, of which only some are linked
        base = [*base]
        for _ in range(r.randint(1, 6)):
            base[r.randrange(300)] = f"c{k}x{r.randrange(9)}"
        more.append((1000 + k, " ".join(base), "en", "s", 1, 0.0, None))
    docs = unique(more)
    sets = shingle_sets(docs)
    want, pairs = components_brute(sets)
    got = collected(J.jaccard_components(frame(spark, more), chunk=chunk))
    assert {i: (x.n_shingles, NONE if x.component_id is None else x.component_id) for i, x in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(pairs) > 20
    if chunk > 500:
        kept = J.one_of_each(frame(spark, more))
        assert {NONE if x.doc_id is None else x.doc_id for x in kept.collect()} == {i for i in want if want[i] == i}
        assert J.jaccard_components(empty(spark)).count() == 0


def test_jaccard_first_blocks_meet():
    """Linked sets share one of the blocks that are joined, whatever shingles count as common."""
    import numpy as np

    from loomfuse.llm import jaccard_join as J

    r = np.random.default_rng(4)
    for percent, n in ((90, 9), (90, 40), (90, 333), (80, 4), (80, 57), (80, 700)):
        for _ in range(20):
            base = r.integers(0, 2**63, n).astype(np.uint64)
            gone = int(r.integers(0, J.most_apart(n, percent) + 1))
            new = int(r.integers(0, J.most_apart(n, percent) + 1 - gone))
            other = np.r_[base[gone:], r.integers(0, 2**63, new).astype(np.uint64)]
            both = len(np.intersect1d(base, other))
            if 100 * both < percent * (len(base) + len(other) - both):
                continue
            drawn = J.Drawn([base, other], percent)
            some = np.unique(np.r_[base, other])
            for common in (some[:0], some[::2], some):
                keys, of = drawn.first_keys(common)
                assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()), (percent, n)
            # a folded sketch differs in no more bits than the sets do
            one, two = sorted((base, other), key=len)
            band = J.own_band(len(two), percent)
            x, y = (J.folded(J.sketch(z, band, percent)) for z in (one, two))
            assert np.bitwise_count(x ^ y).sum() <= len(base) + len(other) - 2 * both


def test_jaccard_settle_finds_a_forest():
    import numpy as np

    from loomfuse.llm import jaccard_join as J

    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.r_[base[: 200 - k], r.integers(0, 2**63, k).astype(np.uint64)] for k in (0, 5, 10, 10, 100, 100)]
    sizes, ids = np.array([len(x) for x in sets]), np.arange(6) * 3
    drawn = J.Drawn(sets).folds()
    none, one = [set() for _ in sets], np.zeros(6, np.int64)
    got = J.settle(ids, ids, sizes, drawn, none, one, 90)
    assert len(got) == 3 and {x for p in got for x in p} == {0, 3, 6, 9}  # the two far ones link with nobody
    assert J.settle(ids, one, sizes, drawn, none, one, 90) == []
    # refuted pairs are not proposed again; of two sides only pairs across are
    assert not set(J.settle(ids, ids, sizes, drawn, [{x for p in got for x in p}] * 6, one, 90))
    side = np.array([0, 0, 1, 1, 1, 1])
    across = J.settle(ids, ids, sizes, drawn, none, side, 90)
    assert all((a < 6) != (b < 6) for a, b in across)
    # small groups at once: the same verdicts for each
    rows = np.r_[np.arange(6), np.arange(6), [0, 4]]
    group = np.repeat([0, 1, 2], [6, 6, 2])
    many = J.settle_small(group, ids[rows], ids[rows], sizes[rows], [[d[i] for i in rows] for d in drawn], [set() for _ in rows], np.r_[one, side, [0, 0]], 90)
    joined = lambda pairs: {frozenset(p) for p in pairs}
    assert len([p for p in many if p[0] == 0]) == 3 and {x for p in many if p[0] == 0 for x in p[1:]} == {0, 3, 6, 9} and not [p for p in many if p[0] == 2]
    assert joined(p[1:] for p in many if p[0] == 1) <= {frozenset((x, y)) for x in (0, 3) for y in (6, 9)} and len([p for p in many if p[0] == 1]) == len(across)
    every = J.settle_small(group[:6], ids, ids, sizes, drawn, none, one, 90, 8)
    assert joined(p[1:] for p in every) == joined(J.settle(ids, ids, sizes, drawn, none, one, 90, 8))


def test_jaccard_merged_takes_roots(spark):
    from loomfuse.llm.jaccard_join import merged

    frame_of = lambda rows, names: spark.createDataFrame(rows, names)
    labels = frame_of([(2, 1), (6, 4), (9, 8)], "u long, label long")
    got = merged(labels, frame_of([(2, 6), (6, 11)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (4, 1), (6, 1), (8, 8), (9, 8), (11, 1)]
    # a third round, again at nodes that are no roots
    again = merged(got, frame_of([(9, 11)], "a long, b long"))
    assert {r.u: r.label for r in again.collect()} == dict.fromkeys((1, 2, 4, 6, 8, 9, 11), 1)


def test_quality_rules(spark):
    from loomfuse.llm.quality_rules import quality_rules

    # a line of every document but in two spellings; a host whose documents hold nothing else
    more = documents(7, 30) + [(500 + k, "Boiler  plate line one\n" * 20 + f"own {k}", "en", "src9", 1, 0.0, None) for k in range(25)] + [(600, "a b c a b c x\n\n \nsame\nsame #$", "en", None, 1, 0.0, None)]
    docs = unique(more)
    hosts = {(NONE if r[0] is None else r[0]): r[3] or "" for r in more}
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    count = {}
    for i, t in docs.items():
        for x in {norm(x) for x in t.split("\n")} - {""}:
            count[hosts[i], x] = count.get((hosts[i], x), 0) + 1
    size = {h: sum(v == h for v in hosts.values()) for h in hosts.values()}
    often = {k for k, n in count.items() if n > 20 and n > 0.02 * size[k[0]]}
    assert often
    got = collected(quality_rules(frame(spark, more)))
    for i, t in docs.items():
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 3)} if len(grams) < 1000 else None
        full = [x for x in t.split("\n") if norm(x)]
        gone = sum(len(x) for x in full if (hosts[i], norm(x)) in often)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.removed_chars) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), gone), i
        if rep is not None:
            assert r.n_repeat_words == len(rep)
            failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
            assert (r.base_failed, r.kept) == (failed, not failed and gone <= 0.5 * (r.word_chars + len(w)))
    assert quality_rules(empty(spark)).count() == 0
