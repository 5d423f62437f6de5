"""Co-training of a text-content and a page-metadata classifier.

Target: a document is good if quality is 1 and toxic is 0. View one sees which telling words and word beginnings a text has; view two
sees language, source, length and layout. Both start from the labelled sample. In each round both views score all documents, and
each view's most confident calibrated verdicts become pseudo-labels for the other view. Logits are calibrated (Platt) on one half of
the labelled documents and combined, by a logistic model, on the other half; there they are those of models that had not seen the
document (stratified folds). The combined model scores all documents.

Fitting takes a bounded sample: at most ``max_labelled`` labelled documents, by the hash of their ids, and ``take`` pseudo-labels a round,
view and class. Words are counted on executors; only rows of telling words reach the driver. All texts are read once: what the views see of a
document is written as a small row, which the rounds and the final scores read.

Null or empty text has no words; null labels are not used; a null language or source is a value of its own. With fewer than two
labels of either class, every score is the share of good labels (1.0 if there are none). Repeated rows get the same score and are one
labelled document. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import buffers, cut, hash_spans, mix, norm_docs, pieces, real_id, spans, without
from loomfuse.llm.tokens import release_tools

MAX_LABELLED, ROUNDS, TAKE, FOLDS = 12_000, 3, 400, 4
MIN_DF, CUT, LEAST_G, COVER = 4, 0.5, 20.0, 3
#: How sure a pseudo-label must be, and its weight: a view that one kind of bad document eludes is told, not overruled.
SURE, PSEUDO = 0.97, 0.25
#: Strength of the prior on weights, in observations.
PRIOR = 3.0
#: Bounds of the bins of a layout figure: sixths, and finer ones at both ends where odd documents lie. A figure counts in both.
COARSE = np.linspace(0, 1, 7)[1:-1]
FINE = np.r_[0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.07, np.linspace(0.1, 0.9, 17), 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 0.998]
#: Bytes of the word beginnings that count as features besides words.
STEMS = (4, 5, 6)
SEP = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_CLASS = np.zeros(256, np.int64)  # 0 lower or other, 1 upper, 2 digit, 3 symbol, 4 blank, 5 line end, 6 continuation
_CLASS[65:91], _CLASS[48:58] = 1, 2
for _b in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    _CLASS[_b] = 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[128:192] = 4, 5, 6
META = ("log_chars", "log_words", "chars_a_word", "distinct", "upper", "digits", "symbols", "chars_a_line", "again")


def view_rows(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct hashes of words and word beginnings, layout figures) of each text."""
    data, off = buffers(batch.column("text"))
    starts, ends, upto = spans(data, off, SEP)
    h = hash_spans(data, starts, ends, lower=True)
    stems = []
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        stems.append((mix(hash_spans(data, starts[long], starts[long] + size, lower=True) + np.uint64(size)), np.searchsorted(long, upto)))
    kinds = _CLASS[data]
    out = []
    for i in range(len(off) - 1):
        words = np.unique(h[upto[i] : upto[i + 1]])
        parts = np.concatenate([words, *(np.unique(x[at[i] : at[i + 1]]) for x, at in stems)])
        n = int(upto[i + 1] - upto[i])
        own = h[upto[i] : upto[i + 1]]
        again = float(np.mean(own[1:] == own[:-1])) if n > 1 else 0.0
        c = np.bincount(kinds[off[i] : off[i + 1]], minlength=7)
        chars = int(c.sum() - c[6])
        top = max(chars, 1)
        out.append((parts, np.array([np.log1p(chars), np.log1p(n), chars / max(n, 1), len(words) / max(n, 1), c[1] / top, c[2] / top, c[3] / top, chars / (c[5] + 1), again])))
    return out


class Ragged:
    """Rows of feature indexes, flat."""

    def __init__(self, values: np.ndarray, off: np.ndarray):
        self.values, self.off = np.asarray(values, np.int64), np.asarray(off, np.int64)
        self.of = np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    @staticmethod
    def of_lists(rows: list) -> Ragged:
        return Ragged(np.concatenate(rows) if rows else [], np.cumsum([0, *map(len, rows)]))

    @staticmethod
    def of_matrix(x: np.ndarray) -> Ragged:
        return Ragged(x.ravel(), np.arange(len(x) + 1) * x.shape[1])

    def __len__(self) -> int:
        return len(self.off) - 1

    def pick(self, at: np.ndarray) -> Ragged:
        return Ragged.of_lists([self.values[self.off[i] : self.off[i + 1]] for i in at])

    def only(self, wanted: np.ndarray) -> Ragged:
        """Without the features that ``wanted`` (a mask) lacks."""
        keep = wanted[self.values]
        return Ragged(self.values[keep], np.r_[0, np.cumsum(np.bincount(self.of[keep], minlength=len(self)))])


class Logistic:
    """L2-regularised logistic regression on rows of feature indexes, fitted by full-batch Adam."""

    def __init__(self, n: int):
        self.w, self.b = np.zeros(n), 0.0

    def fit(self, rows: Ragged, y: np.ndarray, weight: np.ndarray, steps: int = 200, rate: float = 0.08) -> Logistic:
        m, v, mb, vb = np.zeros_like(self.w), np.zeros_like(self.w), 0.0, 0.0
        l2 = PRIOR / weight.sum()
        for t in range(1, steps + 1):
            g = (prob(self.logit(rows)) - y) * weight / weight.sum()
            gw, gb = np.bincount(rows.values, g[rows.of], len(self.w)) + l2 * self.w, g.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            self.w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
            self.b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-10)
        return self

    def logit(self, rows: Ragged) -> np.ndarray:
        return np.bincount(rows.of, self.w[rows.values], len(rows)) + self.b


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Weights (the last is the constant) of a small logistic model, by Newton's method with halved steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + l2 / 2 * (w @ w)
    for _ in range(60):
        p = prob(x @ w)
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def prob(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def g_of(here: np.ndarray, df: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of words found ``here`` of ``df`` times, where ``share`` was to be expected; 0 if they are not more frequent here."""
    part = lambda k, s: k * np.log(np.maximum(k, 1e-9) / (np.maximum(df, 1) * s))
    return np.where((df >= MIN_DF) & (here > share * df), 2 * (part(here, share) + part(df - here, 1 - share)), 0.0)


def telling_words(rows: Ragged, n: int, y: np.ndarray, label: int, least: float = LEAST_G) -> np.ndarray:
    """Of the ``n`` words those found in documents with ``label`` too often for chance, chosen by sequential covering.

    The word with the largest log-likelihood ratio is taken, documents of the label that hold ``COVER`` of those taken are set aside, and the
    rest is counted anew, until no ratio reaches ``least``; so words that only come along with a telling one (in copies, say) are left out."""
    mine = y[rows.of] == label
    others = np.bincount(rows.values[~mine], minlength=n).astype(float)
    values, of = rows.values[mine], rows.of[mine]
    here = np.bincount(values, minlength=n).astype(float)
    n_others, n_here, out = float((y != label).sum()), float((y == label).sum()), []
    order = np.argsort(values, kind="stable")
    first, begin = np.searchsorted(values[order], np.arange(n + 1)), np.searchsorted(of, np.arange(len(rows) + 1))
    free, open_ = np.full(len(rows), COVER), np.ones(n, bool)
    while n and n_here >= MIN_DF:
        g = np.where(open_, g_of(here, here + others, n_here / (n_here + n_others)), 0)
        best = int(np.argmax(g))
        if g[best] < least:
            break
        out.append(best)
        open_[best] = False
        for d in of[order[first[best] : first[best + 1]]].tolist():
            if free[d]:
                free[d] -= 1
                if not free[d]:
                    n_here -= 1
                    here[values[begin[d] : begin[d + 1]]] -= 1
    return np.array(sorted(out), np.int64)


class Views:
    """What the two views see of documents: rows of words (indexes into the candidates) and of layout, language and source."""

    def __init__(self, layout: np.ndarray, lang: list, source: list):
        quantiles = lambda q: [np.unique(np.quantile(x, q)) for x in layout.T]
        self.edges = [*quantiles(COARSE), *quantiles(FINE)]
        self.first = np.cumsum([0, *(len(e) + 1 for e in self.edges)])
        self.names = {k: int(self.first[-1]) + i for i, k in enumerate(sorted({("lang", x) for x in lang} | {("source", x) for x in source}, key=repr))}
        self.size = int(self.first[-1]) + len(self.names) + 1  # the last stands for values not seen here

    def meta(self, layout: np.ndarray, lang: list, source: list) -> np.ndarray:
        bins = [at + np.searchsorted(e, x) for at, e, x in zip(self.first, self.edges, [*layout.T, *layout.T])]
        named = [np.array([self.names.get((kind, x), self.size - 1) for x in col], np.int64) for kind, col in (("lang", lang), ("source", source))]
        return np.array([*bins, *named], np.int64).T


class Model:
    """What scoring needs; its size is bounded by the sample."""

    def __init__(self, words: Ragged, n_words: int, views: Views, meta: np.ndarray, y: np.ndarray, folds: int = FOLDS):
        """Labelled rows of both views; y: 1 good, 0 bad."""
        self.views, self.y = views, y
        # a third of the rows go without their source and language, so that values not seen here get a fair score
        blind = meta.copy()
        blind[::3, -2:] = views.size - 1
        self.rows = [words, Ragged.of_matrix(blind)]
        self.sizes, self.n = [n_words, views.size], len(y)
        turn = np.empty(len(y), np.int64)  # stratified folds, by the order of the rows
        for label in (0, 1):
            turn[y == label] = np.arange((y == label).sum())
        self.fold = turn % folds
        self.train = [np.flatnonzero(self.fold != k) for k in range(folds)] + [np.arange(len(y))]
        self.test = [np.flatnonzero(self.fold == k) for k in range(folds)]
        self.told = []  # telling words, by fold and for all
        for at in self.train:
            mask = np.zeros(n_words, bool)
            for label in (0, 1):
                mask[telling_words(words.pick(at), n_words, y[at], label)] = True
            self.told.append(mask)
        self.pseudo = [(Ragged.of_lists([]), np.zeros(0)), (Ragged.of_lists([]), np.zeros(0))]

    def fit(self) -> Model:
        self.models, logits = [], []
        for v in (0, 1):
            extra, labels = self.pseudo[v]
            z = np.zeros(self.n)
            for k, at in enumerate(self.train):
                rows, more = self.rows[v].pick(at), extra
                if v == 0:
                    rows, more = rows.only(self.told[k]), extra.only(self.told[k])
                both = Ragged(np.r_[rows.values, more.values], np.r_[rows.off, rows.off[-1] + more.off[1:]])
                m = Logistic(self.sizes[v]).fit(both, np.r_[self.y[at], labels], np.r_[np.ones(len(at)), np.full(len(labels), PSEUDO)])
                if k < len(self.test):
                    z[self.test[k]] = m.logit(self.rows[v].pick(self.test[k]).only(self.told[k] if v == 0 else np.ones(self.sizes[v], bool)))
            self.models.append(m)
            logits.append(z)
        half = self.fold % 2 == 0
        self.platt = [fit_dense(z[half, None], self.y[half]) for z in logits]
        calibrated = np.array([z * w[0] + w[1] for z, w in zip(logits, self.platt)]).T
        self.joint = fit_dense(calibrated[~half], self.y[~half])
        return self

    def learn(self, view: int, words: Ragged, meta: np.ndarray, labels: np.ndarray) -> None:
        """Pseudo-labels for a view."""
        rows, known = self.pseudo[view]
        new = words if view == 0 else Ragged.of_matrix(meta)
        self.pseudo[view] = Ragged(np.r_[rows.values, new.values], np.r_[rows.off, rows.off[-1] + new.off[1:]]), np.r_[known, labels]

    def scorer(self) -> Scorer:
        return Scorer(self.views, self.models, self.platt, self.joint, self.told[-1])


class Scorer:
    """The fitted weights alone."""

    def __init__(self, views: Views, models: list[Logistic], platt: list[np.ndarray], joint: np.ndarray, told: np.ndarray):
        self.views, self.models, self.platt, self.joint = views, models, platt, joint
        self.models[0].w = np.where(told, self.models[0].w, 0.0)

    def score(self, words: Ragged, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of being good by text, by metadata, by both."""
        z = np.array([m.logit(rows) * w[0] + w[1] for m, rows, w in zip(self.models, (words, Ragged.of_matrix(meta)), self.platt)]).T
        return prob(z[:, 0]), prob(z[:, 1]), prob(np.c_[z, np.ones(len(z))] @ self.joint)


def with_views(docs: DataFrame, *extra: str) -> DataFrame:
    """The columns that the views read; a missing lang or source column counts as null."""
    have = {c.lower() for c in docs.columns}
    return norm_docs(docs, *((F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")), *extra)


def candidate_words(sample: DataFrame, share: float) -> np.ndarray:
    """Hashes of the words and beginnings in ``sample`` (text, y) that could become telling ones, counted by documents on executors."""

    def run(batches):
        release_tools()
        for b in batches:
            for part in pieces(b, "text"):
                rows, y = view_rows(part), part.column("y").to_numpy()
                words, at = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
                good = np.bincount(at, np.repeat(y, [len(r[0]) for r in rows]), len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(good), pa.array(np.bincount(at, minlength=len(words)))], ["h", "good", "df"])

    counted = sample.select("text", "y").mapInArrow(run, "h long, good long, df long").groupBy("h").agg(F.sum("good").alias("good"), F.sum("df").alias("df")).where(F.col("df") >= MIN_DF)
    # covering only lowers a word's own count; a quarter of the limit (half its root) leaves room for the shares to move
    likely = counted.where(F.abs(F.col("good") - share * F.col("df")) >= 0.5 * F.sqrt(LEAST_G * share * (1 - share) * F.col("df")))
    return np.sort(likely.select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))


def seen_by(docs: DataFrame, words: np.ndarray, *extra: str) -> DataFrame:
    """doc_id, words (indexes into ``words``), layout, lang, source of each row: all that the views see."""
    held = docs.sparkSession.sparkContext.broadcast(words)  # words of the labelled sample, bounded by it
    fields = {f.name: f for f in docs.schema}

    def run(batches):
        release_tools()  # what an earlier query has left in the process
        words = held.value
        for b in batches:
            for part in pieces(b, "text"):
                rows = view_rows(part)
                found = []
                for r in rows:
                    at = np.minimum(np.searchsorted(words, r[0]), max(len(words) - 1, 0))
                    found.append(np.sort(at[words[at] == r[0]]).astype(np.int32) if len(words) else at[:0].astype(np.int32))
                off = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(found) if found else [], pa.int32())), pa.array([list(r[1]) for r in rows], pa.list_(pa.float64())), part.column("lang"), part.column("source"), *(part.column(c) for c in extra)],
                    ["doc_id", "words", "layout", "lang", "source", *extra],
                )

    return docs.mapInArrow(run, "doc_id long, words array<int>, layout array<double>, lang string, source string" + "".join(f", {c} {fields[c].dataType.simpleString()}" for c in extra))


def view_arrays(t) -> tuple[Ragged, np.ndarray, list, list]:
    """(rows of words, layout matrix, lang, source) of an Arrow table or batch of ``seen_by``."""
    if isinstance(t, pa.Table):
        t = t.combine_chunks()
    col = lambda n: t.column(n).combine_chunks() if isinstance(t, pa.Table) else t.column(t.schema.get_field_index(n))
    words, layout = col("words"), col("layout")
    sizes = np.diff(words.offsets.to_numpy())
    return Ragged(words.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]), layout.flatten().to_numpy().reshape(-1, len(META)), col("lang").to_pylist(), col("source").to_pylist()


def confident(seen: DataFrame, scorer: Scorer, used: np.ndarray, turn: int, take: int) -> pa.Table:
    """The documents not in ``used`` that a view is most sure of: view, label and what the views see; at most ``take`` of each view and label."""
    held = seen.sparkSession.sparkContext.broadcast((scorer, used))

    def run(batches):
        scorer, used = held.value
        for b in batches:
            words, layout, lang, source = view_arrays(b)
            p = scorer.score(words, scorer.views.meta(layout, lang, source))[:2]
            new = ~np.isin(b.column(0).to_numpy(), used)
            sure = [pa.array(np.where(new & (x >= SURE), x, np.where(new & (x <= 1 - SURE), x, np.nan)), from_pandas=True) for x in p]
            yield pa.RecordBatch.from_arrays([*b.columns, *sure], [*b.schema.names, "p0", "p1"])

    scored = seen.mapInArrow(run, "doc_id long, words array<int>, layout array<double>, lang string, source string, p0 double, p1 double")
    best = []
    for view in (0, 1):
        for label in (1, 0):
            p = F.col(f"p{view}")
            rank = p.desc() if label else p.asc()
            mine = scored.where(p > 0.5 if label else p < 0.5).orderBy(rank, F.xxhash64("doc_id", F.lit(turn)), "doc_id").limit(take)
            best.append(mine.select(F.lit(view).alias("view"), F.lit(label).alias("label"), "doc_id", "words", "layout", "lang", "source"))
    return best[0].unionByName(best[1]).unionByName(best[2]).unionByName(best[3]).toArrow()


def score_rows(seen: DataFrame, scorer: Scorer | None, share: float) -> DataFrame:
    """Per row: doc_id, p_text, p_meta, score (chance of being good), rejected."""
    held = seen.sparkSession.sparkContext.broadcast(scorer)  # bounded by the sample

    def run(batches):
        for b in batches:
            if held.value is None:
                p = (np.full(b.num_rows, share),) * 3
            else:
                words, layout, lang, source = view_arrays(b)
                p = held.value.score(words, held.value.views.meta(layout, lang, source))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p), pa.array(p[2] < CUT)], ["doc_id", "p_text", "p_meta", "score", "rejected"])

    return seen.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, rejected boolean").withColumn("doc_id", real_id())


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, take: int = TAKE) -> DataFrame:
    """Per document row: doc_id, p_text, p_meta, score (chance of being good), rejected."""
    spark, named = docs.sparkSession, with_views(docs)
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0))
    usable = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()  # bounded by max_labelled
    known = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in chosen], "doc_id long, y int"))
    sample = cut(named.join(known, "doc_id").dropDuplicates(["doc_id"]), "quality-sample")
    count = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    total = sum(count.values())
    share = count.get(1, 0) / total if total else 1.0
    if min(count.get(0, 0), count.get(1, 0)) < 2:
        return score_rows(seen_by(named, np.zeros(0, np.uint64)), None, share)
    words = candidate_words(sample, share)
    t = seen_by(sample, words, "y").toArrow().sort_by("doc_id")  # rows of candidates; their number is bounded by max_labelled
    t = t.take(pa.array(np.random.default_rng(5).permutation(t.num_rows)))  # folds do not follow the ids
    rows, layout, lang, source = view_arrays(t)
    views = Views(layout, lang, source)
    model = Model(rows, len(words), views, views.meta(layout, lang, source), t["y"].to_numpy().astype(float), min(FOLDS, count[0], count[1]))
    # from here on only words that tell in some fold are looked for
    tells = np.any(model.told, axis=0)
    new_at = np.cumsum(tells) - 1
    rows = rows.only(tells)
    model.rows[0] = Ragged(new_at[rows.values], rows.off)
    model.told, model.sizes[0] = [m[tells] for m in model.told], int(tells.sum())
    seen = cut(seen_by(named, words[tells]), "quality-views")
    used = t["doc_id"].to_numpy()
    for turn in range(rounds):
        model.fit()
        sure = confident(seen, model.scorer(), used, turn, take)
        if not sure.num_rows:
            break
        rows, layout, lang, source = view_arrays(sure)
        view, label = sure["view"].to_numpy(), sure["label"].to_numpy().astype(float)
        meta = views.meta(layout, lang, source)
        for v in (0, 1):
            at = np.flatnonzero(view == v)
            model.learn(1 - v, rows.pick(at), meta[at], label[at])
        used = np.unique(np.r_[used, sure["doc_id"].to_numpy()])
    return score_rows(seen, model.fit().scorer(), share)


def drop_rejected(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps. A rejected id takes all its rows along."""
    return without(docs, classify(docs, labels, **bounds).where("rejected").select("doc_id"))
