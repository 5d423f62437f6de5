"""N-gram Jaccard join on parity sketches.

A document's set: the distinct three-word shingles of its text, A-Z lower-cased; with one or two words, the
whole sequence. Two documents link when 100 * |A and B| >= 90 * |A or B|.

Such a pair differs in d <= |A| / 9 shingles, |A| <= |B|. A sketch has one bit a shingle hash, XORed; its
Hamming distance is at most d. It is cut into B > d + 1 blocks of 64 bits, of which linked sets share B - d at least
(pigeonhole); so their d + 1 first blocks, in one order for all, have one in common, and only these are joined, by the shingles in
them: blocks of few shingles, or only of such that many documents share (a common passage), come last in that order and are left out without losing a link.
Sizes are banded; sizes within 10/9 of the next band are sketched for both. Equal blocks are joined as stars, never as
pairs of a group. Pairs are compared by the Hamming distance of folded sketches (blocks XORed to an eighth, so that it is a lower
bound as well), and every pair that is left is verified on the sets. A group whose stars leave several components is
settled in numpy, chunk by chunk: only members of different components are compared, by the folded sketches, and a forest of the
pairs that may still link is verified; so no link between different texts is lost.

Null or empty texts, and texts without words, have an empty set and no links. Equal sets always link. Repeated rows are one document.
"""

from __future__ import annotations

from collections import Counter
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfuse.llm.common import NO_ID, buffers, cut, give_back, hash_spans, hash_windows, mix, norm_docs, pieces, ragged, real_id, release, spans, without
from loomfuse.plans.components import connected_components

SHINGLE, PERCENT = 3, 90
#: Rows of blocks that a task combines at once; bytes of folded sketches of a group's members that are compared in one step.
COMBINE, CHUNK = 500_000, 1 << 19
#: Bytes of text whose sketches are drawn at once.
PIECE = 1 << 20
#: Members of a group that is settled along with others.
SMALL = 256
#: Shingles that count as common at most; how often a task must see one at least. Only the speed depends on them.
COMMON, LEAST = 1 << 20, 3
U = np.uint64


@cache
def bands(percent: int = PERCENT) -> np.ndarray:
    """Lowest sizes of the bands; a linked set lies in the same band or the next."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, -(-low[-1] * 6 // 5), -(-low[-1] * 100 // percent)))
    return np.array(low, np.int64)


def most_apart(size: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of a linked pair whose smaller set has ``size`` members."""
    return (100 - percent) * size // percent


def own_band(n: int, percent: int = PERCENT) -> int:
    return int(np.searchsorted(bands(percent), n, "right")) - 1


def layouts(n: int, percent: int = PERCENT) -> list[int]:
    """Bands in which a set of ``n`` members is sketched: its own, and the next if a partner can lie there."""
    own = own_band(n, percent)
    return [own, own + 1] if 100 * n // percent >= bands(percent)[own + 1] else [own]


def n_blocks(band: int, percent: int = PERCENT) -> int:
    least = most_apart(int(bands(percent)[band + 1]) - 1, percent) + 1
    return least + least // 3 + 1


def placed(members: np.ndarray, band: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Block of each member, and its bit there."""
    r = mix(members ^ U(band * 0x9E3779B97F4A7C15 % 2**64))
    return ((r >> U(32)) % U(n_blocks(band, percent))).astype(np.int64), U(1) << (r & U(63))


def sketch(members: np.ndarray, band: int, percent: int = PERCENT) -> np.ndarray:
    """64-bit blocks of the parity sketch of a set of hashes."""
    out = np.zeros(n_blocks(band, percent), U)
    np.bitwise_xor.at(out, *placed(members, band, percent))
    return out


def folded(blocks: np.ndarray) -> np.ndarray:
    """An eighth of the blocks, eight at least: a parity sketch of the same set with fewer bits."""
    width = max(8, -(-len(blocks) // 8))
    if len(blocks) <= width:
        return blocks
    return np.bitwise_xor.reduce(np.r_[blocks, np.zeros(-len(blocks) % width, U)].reshape(-1, width), axis=0)


class Drawn:
    """The sketches of some sets, flat: the set of each, and how many blocks lie before each."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.n = percent, np.array([len(x) for x in sets], np.int64)
        made = [(i, band, sets[i], *placed(sets[i], band, percent)) for i in range(len(sets)) if most_apart(len(sets[i]), percent) for band in layouts(len(sets[i]), percent)]
        self.rows, self.bands = (np.array([m[i] for m in made], np.int64) for i in (0, 1))
        self.upto = np.cumsum([0, *(n_blocks(b, percent) for b in self.bands.tolist())])
        self.members = np.concatenate([*(m[2] for m in made), np.zeros(0, U)])
        self.at = np.concatenate([*(m[3] + a for m, a in zip(made, self.upto.tolist())), np.zeros(0, np.int64)])
        self.blocks = np.zeros(int(self.upto[-1]), U)
        np.bitwise_xor.at(self.blocks, self.at, np.concatenate([*(m[4] for m in made), np.zeros(0, U)]))

    def folds(self) -> list[list[bytes | None]]:
        """Own and next folded sketch of each set, or None."""
        out: list[list] = [[None] * len(self.n), [None] * len(self.n)]
        for i, a, z in zip(self.rows.tolist(), self.upto.tolist(), self.upto[1:].tolist()):
            out[out[0][i] is not None][i] = folded(self.blocks[a:z]).tobytes()
        return out

    def first_keys(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, sets): of each sketch the d + 1 keys that come first in the order of all keys, that of the most shingles which are not ``common``
        (sorted hashes) first, then that of the most shingles. A key names the shingles of a block, so that the order is one for all sets."""
        if not len(self.blocks):
            return self.blocks, self.rows
        rare = np.ones(len(self.members), bool)
        if len(common):
            rare = common[np.minimum(np.searchsorted(common, self.members), len(common) - 1)] != self.members
        own = np.zeros(len(self.blocks), U)
        np.bitwise_xor.at(own, self.at, mix(self.members))
        few, all_ = (63 - np.minimum(np.bincount(self.at, w, len(self.blocks)), 63).astype(np.int64) for w in (rare, None))
        sizes = np.diff(self.upto)
        place = ragged(np.zeros(len(sizes), np.int64), sizes).astype(U) * U(0xD6E8FEB86659FD93) + np.repeat(self.bands, sizes).astype(U) * U(0xA24BAED4963EE407)
        keys = mix(mix(own) ^ mix(place))
        order = np.lexsort((few.astype(U) << U(48) | all_.astype(U) << U(40) | mix(keys) >> U(24), np.repeat(np.arange(len(sizes)), sizes)))
        wanted = (100 - self.percent) * self.n[self.rows] // self.percent + 1
        return keys[order[ragged(self.upto[:-1], wanted)]], np.repeat(self.rows, wanted)


def text_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The set (sorted distinct hashes) of each text."""
    starts, ends, upto = spans(data, offsets)
    h = hash_spans(data, starts, ends, lower=True)
    grams = hash_windows(h, k)
    out = []
    for a, z in zip(upto[:-1].tolist(), upto[1:].tolist()):
        n = z - a
        if n >= k:
            out.append(np.unique(grams[a : z - k + 1]))
        else:
            out.append(mix(hash_windows(h[a:z], n) + U(n)) if n else np.zeros(0, U))
    return out


def signature(members: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(members):
        return 0, 0
    one, two = mix(members + U(0x632BE59BD9B4E019)), mix(members ^ U(0x9E6C63D0876A9A47))
    return tuple(int(np.add.reduce(x).view(np.int64)) for x in (one, two))


def sketched(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, s1, s2 (size and signature of each row's set), own, next (folded sketches in its band and, if a partner can lie there,
    in the next; null where only equal sets link); and, in rows with no n, key and times of shingles that a task saw in ``LEAST`` sets or more."""
    names = ["doc_id", "n", "s1", "s2", "own", "next", "key", "times"]

    def run(batches):
        seen, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(seen), return_counts=True)
            keys, n, none = keys[n >= LEAST], n[n >= LEAST], pa.nulls(int((n >= LEAST).sum()))
            seen.clear()
            return pa.RecordBatch.from_arrays([*(none.cast(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())), pa.array(keys.view(np.int64)), pa.array(n)], names)

        for b in batches:
            for part in pieces(b, "text", PIECE):
                sets = text_sets(*buffers(part.column(1)), k)
                sig, drawn = [signature(s) for s in sets], Drawn(sets, percent)
                seen += sets
                size += int(drawn.n.sum())
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(drawn.n), *(pa.array([x[i] for x in sig], pa.int64()) for i in (0, 1)), *(pa.array(f, pa.binary()) for f in drawn.folds()), none, none], names)
                if size > 4 * COMBINE:
                    yield flush()
                    size = 0
        if size:
            yield flush()
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, own binary, next binary, key long, times long")


def common_shingles(made: DataFrame, most: int) -> np.ndarray:
    """The ``most`` shingles that most documents share, sorted."""
    told = made.where("n is null").groupBy("key").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
    return np.sort(told["key"].to_numpy().astype(np.int64).view(U))


def stars(docs: DataFrame, common: np.ndarray, k: int, percent: int) -> DataFrame:
    """key, a, b: for each block key with two documents or more, edges that connect all of them (a < b). Of equal sets a task takes one."""
    held = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON hashes

    def run(batches):
        kept, size, known = [], 0, set()

        def flush():
            keys, ids = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            head = np.r_[True, keys[1:] != keys[:-1]]
            lead = ids[np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))]
            same = ~head & (ids != lead)
            out = lambda part, key, a, b: pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())], ["part", "key", "a", "b"])
            yield out(keys[head], keys[head], ids[head], None)
            # edges found here need no place beside their key: they are dealt evenly
            yield out(mix((keys[same] + ids[same]).view(U)).view(np.int64), keys[same], lead[same], ids[same])
            kept.clear()

        for b in batches:
            for part in pieces(b, "text", PIECE):
                sets, ids = text_sets(*buffers(part.column(1)), k), part.column(0).to_numpy()
                new = []
                for i, x in enumerate(sets):
                    if (sig := signature(x)) not in known:
                        new.append(i)
                        known.add(sig)
                if len(known) > 50_000:  # forgotten copies come once more
                    known.clear()
                keys, rows = Drawn([sets[i] for i in new], percent).first_keys(held.value)
                kept.append((keys.view(np.int64), ids[np.array(new, np.int64)[rows]]))
                size += len(keys)
                if size > COMBINE:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()
        give_back()

    sent = docs.mapInArrow(run, "part long, key long, a long, b long")
    lead = F.min(F.when(F.col("b").isNull(), F.col("a"))).over(Window.partitionBy("part", "key"))
    return sent.withColumn("lead", lead).select("key", F.when(F.col("b").isNull(), F.col("lead")).otherwise(F.col("a")).alias("a"), F.coalesce("b", "a").alias("b")).where("a <> b")


def near(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and folded sketches allow a link; the Hamming distance never exceeds the true difference."""

    def run(batches):
        for b in batches:
            yes = []
            for n, m, x, x2, y, y2 in zip(*(b.column(i).to_pylist() for i in range(2, 8))):
                if n > m:
                    n, m, x, x2, y, y2 = m, n, y, y2, x, x2
                if 100 * n < percent * m:
                    yes.append(False)
                    continue
                one = own_band(n, percent)
                x = x if (two := own_band(m, percent)) == one else x2 if two == one + 1 else None
                yes.append(x is not None and int(np.bitwise_count(np.frombuffer(x, U) ^ np.frombuffer(y, U)).sum()) <= most_apart(n, percent))
            yield b.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))
        give_back()

    one = held.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("own").alias("xa"), F.col("next").alias("ya"))
    two = held.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("own").alias("xb"), F.col("next").alias("yb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "xa", "ya", "xb", "yb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, named: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, link: whether the sets of each pair link."""

    def run(batches):
        for b in batches:
            for part in pieces(b, "x", PIECE):
                yes = []
                for x, y in zip(text_sets(*buffers(part.column(2)), k), text_sets(*buffers(part.column(3)), k)):
                    both = len(x) + len(y)
                    same = both - len(np.union1d(x, y))
                    yes.append(100 * same >= percent * (both - same))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(yes, pa.bool_())], ["a", "b", "link"])
        give_back()

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = named.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, link boolean")


def unsettled(star: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id of all members of groups with three members or more that lie in several components; groups of the same members once."""
    named = lambda c: labels.select(F.col("u").alias(c), F.col("label").alias(f"label_{c}"))
    both = star.join(named("a"), "a", "left").join(named("b"), "b", "left").select("key", "a", "b", F.coalesce("label_a", "a").alias("la"), F.coalesce("label_b", "b").alias("lb"))
    open_keys = both.groupBy("key").agg(F.max(F.col("la") != F.col("lb")).alias("open"), F.count("*").alias("n")).where("open and n > 1").select("key")
    each = star.join(open_keys, "key", "left_semi")
    each = each.select("key", F.col("a").alias("id")).unionByName(each.select("key", F.col("b").alias("id"))).distinct()
    hashed = lambda seed: F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(38,0)"))
    once = each.groupBy("key").agg(F.count("*").alias("n"), hashed(1).alias("h1"), hashed(2).alias("h2")).groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    return each.join(once, "key", "left_semi")


def with_labels(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, label of the groups that still lie in several components."""
    named = groups.join(labels.withColumnRenamed("u", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    split = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return named.join(split, "key", "left_semi")


def merged(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels (u, label) after links (a, b) between nodes of different components; smallest nodes have rows as well."""
    edges = labels.select("u", F.col("label").alias("v")).unionByName(new.select(F.col("a").alias("u"), F.col("b").alias("v")))
    found = connected_components(edges)
    roots = labels.where("u = label").select("u").join(found, "u", "left_anti").union(found.select(F.col("label").alias("u"))).distinct()
    return found.unionByName(roots.select("u", F.col("u").alias("label")))


def settle(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, drawn: list[list[bytes | None]], no: list[set[int]], side: np.ndarray, percent: int, most: int = 1) -> list[tuple[int, int]]:
    """Pairs (a < b) between members of different labels whose sizes and sketches allow a link and that are not in ``no``: a forest, or
    at most ``most`` > 1 for two labels, the closest of a member first. ``side``: only members of different sides are compared, if there are two."""
    root = np.unique(labels, return_inverse=True)[1].astype(np.int64)
    largest = np.bincount(root).argmax()
    todo = root != largest  # every pair of different labels has a member here
    out, both, told = [], len(set(side.tolist())) > 1, Counter()
    own = np.searchsorted(bands(percent), sizes, "right") - 1
    apart, more = (100 - percent) * sizes // percent, np.array([x is not None for x in drawn[1]])
    for band in np.unique(own).tolist():
        here = np.flatnonzero((own == band) | ((own == band - 1) & more))
        if len(here) < 2:
            continue
        flat = np.array([np.frombuffer(drawn[band - own[i]][i], U) for i in here])
        lead = min(12, flat.shape[1])
        for p in np.flatnonzero(todo[here]).tolist():
            i = here[p]
            small, large = np.minimum(sizes[here], sizes[i]), np.maximum(sizes[here], sizes[i])
            # a pair is compared in the band of its larger set
            able = (root[here] != root[i]) & (100 * small >= percent * large) & (np.maximum(own[here], own[i]) == band)
            if both:
                able &= side[here] != side[i]
            able = np.flatnonzero(able)
            limit = np.minimum(apart[here[able]], apart[i])
            # the first blocks refute most pairs already
            ok = np.bitwise_count(flat[able, :lead] ^ flat[p, :lead]).sum(1) <= limit
            able, limit = able[ok], limit[ok]
            d = np.bitwise_count(flat[able] ^ flat[p]).sum(1)
            ok = np.flatnonzero(d <= limit)
            for q in able[ok[np.argsort(d[ok], kind="stable")]].tolist():
                j = here[q]
                a, b = sorted((int(ids[i]), int(ids[j])))
                ends = (root[i], root[j]) if root[i] < root[j] else (root[j], root[i])
                if ends[0] == ends[1] or told[ends] == most or b in no[i] or b in no[j] or a in no[i] or a in no[j]:
                    continue
                out.append((a, b))
                if most == 1:
                    root[root == root[j]] = root[i]
                else:
                    told[ends] += 1
    return out


def settle_small(group: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, drawn: list[list[bytes | None]], no: list[set[int]], side: np.ndarray, percent: int, most: int = 1) -> list[tuple[int, int, int]]:
    """(group, a, b): what ``settle`` finds in many small groups at once; rows are sorted by group."""
    own = np.searchsorted(bands(percent), sizes, "right") - 1
    apart = (100 - percent) * sizes // percent
    two = np.minimum.reduceat(side, head := np.flatnonzero(np.r_[True, group[1:] != group[:-1]])) != np.maximum.reduceat(side, head)
    two = np.repeat(two, np.diff(np.r_[head, len(group)]))
    # pairs by their distance in the order of rows
    found = [[], []]
    for t in range(1, int(np.diff(np.r_[head, len(group)]).max())):
        i = np.flatnonzero((group[t:] == group[:-t]) & (labels[t:] != labels[:-t]))
        j = i + t
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        ok = (100 * small >= percent * large) & (np.abs(own[i] - own[j]) < 2) & (~two[i] | (side[i] != side[j]))
        found[0].append(i[ok])
        found[1].append(j[ok])
    if not found[0]:
        return []
    i, j = (np.concatenate(x) for x in found)
    band, d = np.maximum(own[i], own[j]), np.full(len(i), 1 << 40)
    for b in np.unique(band).tolist():
        pairs = np.flatnonzero(band == b)
        rows = np.unique(np.r_[i[pairs], j[pairs]])
        flat = [drawn[b - own[r]][r] for r in rows.tolist()]
        width = max(len(x) for x in flat if x is not None) if any(x is not None for x in flat) else 0
        there = np.array([x is not None for x in flat])
        table = np.frombuffer(b"".join(x if x is not None else bytes(width) for x in flat), U).reshape(len(rows), -1)
        for at in range(0, len(pairs), 20_000):
            part = pairs[at : at + 20_000]
            x, y = np.searchsorted(rows, i[part]), np.searchsorted(rows, j[part])
            d[part] = np.where(there[x] & there[y], np.bitwise_count(table[x] ^ table[y]).sum(1), 1 << 40)
    near_ = np.flatnonzero(d <= np.minimum(apart[i], apart[j]))
    out, root, told = [], {}, Counter()

    def find(x):
        while (up := root.get(x, x)) != x:
            x = up
        return x

    for q in near_[np.lexsort((d[near_], group[i[near_]]))].tolist():
        r, s = int(i[q]), int(j[q])
        g = int(group[r])
        a, b = sorted((int(ids[r]), int(ids[s])))
        ends = sorted((find((g, int(labels[r]))), find((g, int(labels[s])))))
        if ends[0] == ends[1] or told[(*ends,)] == most or b in no[r] or b in no[s] or a in no[r] or a in no[s]:
            continue
        out.append((g, a, b))
        if most == 1:
            root[ends[1]] = ends[0]
        else:
            told[(*ends,)] += 1
    return out


def proposals(groups: DataFrame, held: DataFrame, refuted: DataFrame, percent: int, chunk: int = CHUNK, most: int = 1) -> DataFrame:
    """key, a, b: pairs across components that may link, as ``settle`` picks them for each pair of chunks of a group.

    ``groups``: key, id, label. A group up to ``chunk`` bytes of sketches is one chunk; pairs of chunks of one and the same label are left out."""
    known = refuted.select(F.col("a").alias("id"), "b").groupBy("id").agg(F.collect_set("b").alias("no"))
    full = groups.join(held.select(F.col("doc_id").alias("id"), "n", "own", "next"), "id").join(known, "id", "left")
    size = F.octet_length("own")
    large = cut(groups.join(held.select(F.col("doc_id").alias("id"), size.alias("size")), "id").groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > chunk).select("key"), "jaccard-large")
    none = F.lit(0).cast("long")
    every = full.join(large, "key", "left_anti").withColumn("at", none).withColumn("c", none).withColumn("d", none)
    if not large.isEmpty():
        order = Window.partitionBy("key").orderBy("label", "id").rowsBetween(Window.unboundedPreceding, 0)
        cuts = full.join(large, "key", "left_semi").withColumn("at", F.floor((F.sum(size).over(order) - size) / chunk))
        parts = cuts.groupBy("key", "at").agg(F.min("label").alias("x"), F.max("label").alias("y"))
        one, two = (parts.select("key", F.col("at").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")) for c in "cd")
        pairs = one.join(two, "key").where("c <= d and not (xc = yc and xd = yd and xc = xd)").select("key", "c", "d")
        every = every.unionByName(cuts.join(pairs, "key").where("at = c or at = d"))

    def settled(t: pa.Table) -> pa.RecordBatch:
        """Whole groups, one after the other."""
        key, c, d = (t[n].to_numpy() for n in ("key", "c", "d"))
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        size = np.diff(np.r_[head, len(key)])
        group = np.repeat(np.arange(len(head)), size)
        out = []
        cols = lambda t: (t["id"].to_numpy(), t["label"].to_numpy(), t["n"].to_numpy(), [t["own"].to_pylist(), t["next"].to_pylist()], [set(x or ()) for x in t["no"].to_pylist()], t["at"].to_numpy())
        small = np.flatnonzero(size[group] <= SMALL)
        if len(small):
            out += [(int(key[head[g]]), a, b) for g, a, b in settle_small(group[small], *cols(t.take(pa.array(small))), percent, most)]
        for g in np.flatnonzero(size > SMALL).tolist():
            out += [(int(key[head[g]]), a, b) for a, b in settle(*cols(t.slice(int(head[g]), int(size[g]))), percent, most)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["key", "a", "b"])

    def run(batches):
        left = None  # the rows of a group that may go on
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
            key, c, d = (t[n].to_numpy() for n in ("key", "c", "d"))
            last = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])[-1]) if len(key) else 0
            if last:
                yield settled(t.slice(0, last))
            left = t.slice(last)
        if left is not None and left.num_rows:
            yield settled(left)
        give_back()

    return every.select("key", "c", "d", "at", "id", "label", "n", "own", "next", "no").repartition("key", "c", "d").sortWithinPartitions("key", "c", "d").mapInArrow(run, "key long, a long, b long")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK, first: int = 1) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, n_links (verified links kept for it, not all there are).

    ``first``: the round whose number of proposals the first one takes; 0 spares proposals, 1 spares a round. The rows are the same."""
    named = norm_docs(docs)
    made = cut(sketched(named, k, percent), "jaccard-sets")
    rows = made.where("n is not null").select("doc_id", "n", "s1", "s2")
    sets = rows.where("n > 0").distinct()
    heads = sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("head"))
    of = cut(sets.join(heads, ["n", "s1", "s2"]), "jaccard-classes")
    firsts = of.where("doc_id = head").select("doc_id", "n", "s1", "s2")
    held = cut(made.where("own is not null").join(firsts, ["doc_id", "n", "s1", "s2"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "own", "next"), "jaccard-held")
    at = lambda c: of.select(F.col("doc_id").alias(c), F.col("head").alias(f"head_{c}"))
    star = stars(named, common_shingles(made, COMMON), k, percent).join(at("a"), "a").join(at("b"), "b")
    star = cut(star.select("key", F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).where("a <> b").distinct(), "jaccard-stars")
    tell = lambda pairs: cut(verified(cut(near(pairs, held, percent), "jaccard-near"), named, k, percent), "jaccard-told")
    told = tell(star.select("a", "b").distinct())
    links, refuted = (told.where(c).select("a", "b") for c in ("link", "not link"))
    labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    groups = cut(unsettled(star, labels), "jaccard-groups")
    for turn in count():
        now = cut(with_labels(groups, labels), "jaccard-open")
        if now.isEmpty():
            break
        # a forest, then more: pairs that only seem to link are refuted by more and more at once
        found = cut(proposals(now, held, refuted, percent, chunk, 8 ** (turn + first)), "jaccard-more")
        if found.isEmpty():
            break
        told = tell(found.select("a", "b").distinct())
        new, wrong = (told.where(c).select("a", "b") for c in ("link", "not link"))
        # a group without proposals has none later: labels only grow together. The others go on with what was refuted.
        then = cut(now.select("key", "id").join(found.select("key").distinct(), "key", "left_semi"), "jaccard-groups")
        release(now, groups, found)
        groups = then
        refuted = refuted.unionByName(wrong)
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = cut(merged(labels, new), "jaccard-labels")
    degree = links.select(F.col("a").alias("head")).union(links.select(F.col("b").alias("head"))).groupBy("head").agg(F.count("*").alias("n_links"))
    tied = of.join(labels.withColumnRenamed("u", "head"), "head", "left").join(degree, "head", "left").select("doc_id", "n", "s1", "s2", F.coalesce("label", "head").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = rows.join(tied, ["doc_id", "n", "s1", "s2"], "left")
    return out.select(real_id(), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "doc_id"), F.lit(NO_ID)).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, whose document has the smallest id of its component."""
    found = jaccard_components(docs, k, percent, first=0)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    return without(docs, gone)
