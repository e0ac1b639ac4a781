"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models of letter sequences, of toxic and of ordinary
documents, predict each symbol (a letter of the lower-cased text, or the space
between words) from the three before it. Their highest level is counted by
class, over labelled documents. All levels below it are one shared backoff:
Kneser-Ney continuation counts (in how many different contexts a sequence
occurs) over every document, labelled or not. So an expression that is rare or
unknown in both classes gets the same estimate from both and speaks for neither
side. The discount of each class and each level follows from its counts of
counts, n1 / (n1 + 2 n2).

A document is judged by its most toxic passage: of all stretches of ``WINDOW``
symbols in the whole text, the one with the highest difference of the
length-normalised toxic and ordinary log-likelihoods. A logistic curve, fitted
on labelled rows that the models have not counted, turns it into a score. (The
same difference over the whole text says little: held-out area under the curve
0.79 at sf0.1, against 0.945.)

Counting is one pass: tasks emit each sequence once, with its sums by class for
labelled rows, and these meet by key. Counts are exact and cover all rows; they
grow with the texts' inventory of four-symbol sequences. The model keeps the
sequences whose context a labelled row has (all others have ratio 0), and so is
bounded by the labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_slices

#: Labelled rows that the class models and the curve are fitted on, at most (those with the smallest hash of their id).
LABELLED = 60_000
#: Rows of the fitted model, at most: where there are more, half as many labelled rows are taken.
ROWS = 1 << 23
#: Symbols of the window.
WINDOW = 24
#: Bits of a symbol in a key (a code point has 21), and of the number of slots of what a worker remembers.
_BITS, _SLOT_BITS = 21, 19
#: Bytes of the texts, and characters or symbols of one long text, that are worked on at a time: some hundred bytes each.
_SLICE = _PIECE = 1 << 18
#: Code point -> 0 other, 1 letter, 2 white space, 3 the mark between texts (a surrogate, which no text holds).
_KIND: list = []
_MARK = 0xD800


def symbols(texts: list[str | None]):
    """All texts' symbols, one after the other: each is two zeros, a space, its words parted by single spaces, and a space. Words are what is parted by white space, lower-cased, without what isn't a letter."""
    import numpy as np

    if not _KIND:
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                kind[c] = 1
            elif chr(c).isspace():
                kind[c] = 2
        kind[_MARK] = 3
        _KIND.append(kind)
    mark, parts, after_space = chr(_MARK) * 2, [], False
    text = "".join(f"{mark} {(t or '').lower()} " for t in texts)
    for lo in range(0, len(text), _PIECE):
        code = np.frombuffer(text[lo : lo + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[0][code]
        code, kind = code[kind > 0], kind[kind > 0]
        code[kind == 3], code[kind == 2] = 0, 32
        space = kind == 2
        if len(kind):
            parts.append(code[~(space & np.r_[after_space, space[:-1]])])
            after_space = bool(space[-1])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _contexts(code):
    """The context of every symbol from the fourth on."""
    import numpy as np

    code = code.astype(np.int64)
    return code[:-3] << 2 * _BITS | code[1:-2] << _BITS | code[2:-1]


def sequences(texts: list[str | None]):
    """Context (three symbols), next symbol and text number of every symbol but the leading space of each text."""
    import numpy as np

    code = symbols(texts)
    if len(code) < 4:
        return (np.zeros(0, np.int64),) * 3
    at = 3 + np.flatnonzero((code[3:] != 0) & (code[2:-1] != 0))
    return _contexts(code)[at - 3], code[at].astype(np.int64), (np.cumsum(code == 0) // 2 - 1)[at]


def _long(text: str, overlap: int) -> Iterator:
    """Contexts and next symbols of one long text, by pieces, each with the ``overlap`` symbols before it."""
    import numpy as np

    code = symbols([text])
    for lo in range(3, len(code), _PIECE):
        piece = code[max(3, lo - overlap) - 3 : lo + _PIECE]
        yield _contexts(piece), piece[3:].astype(np.int64)


class _Memory:
    """Sequences that a worker has met, with a number each: a slot holds one, and a later one takes its place."""

    def __init__(self):
        import numpy as np

        n = 1 << _SLOT_BITS
        self.context, self.symbol, self.value = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n)

    def look(self, context, symbol):
        """The slot of each sequence and whether it holds that sequence."""
        import numpy as np

        key = (context ^ symbol << 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot = ((key ^ key >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        return slot, (self.context[slot] == context) & (self.symbol[slot] == symbol)

    def keep(self, slot, context, symbol, value=0.0):
        self.context[slot], self.symbol[slot], self.value[slot] = context, symbol, value


def _distinct(context, symbol):
    """The order that brings equal sequences together, and where each starts in it."""
    import numpy as np

    order = np.lexsort((symbol, context))
    c, s = context[order], symbol[order]
    return order, np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])]) if len(c) else order


def fold(doc_id):
    """crc32 of the id's text modulo 5; rows of remainder 0 are held out and never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _counts(batches: Iterator) -> Iterator:
    """Batches of text, label (null: none) to context, symbol, plain, toxic: every sequence of the task once or more, those of labelled texts with their numbers."""
    import numpy as np
    import pyarrow as pa

    seen, names = _Memory(), ["context", "symbol", "plain", "toxic"]

    def counted(context, symbol, label):
        slot, known = seen.look(context, symbol)
        c, s = context[~known], symbol[~known]
        order, head = _distinct(c, s)
        c, s = c[order][head], s[order][head]
        seen.keep(slot[~known][order][head], c, s)
        none = np.zeros(len(c), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, s, none, none)], names)
        c, s, y = context[label >= 0], symbol[label >= 0], label[label >= 0] > 0
        if len(c):
            order, head = _distinct(c, s)
            toxic = np.add.reduceat(y[order].astype(np.int64), head)
            plain = np.diff(np.r_[head, len(c)]) - toxic
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[order][head], s[order][head], plain, toxic)], names)

    for batch in batches:
        labels = np.array([-1 if y is None else y for y in batch.column(1).to_pylist()], np.int64)
        for lo, hi, texts in text_slices(batch.column(0), _SLICE):
            if hi - lo == 1 and len(texts[0] or "") > _PIECE:
                for context, symbol in _long(texts[0], 0):
                    yield from counted(context, symbol, np.full(len(context), labels[lo]))
            else:
                context, symbol, doc = sequences(texts)
                yield from counted(context, symbol, labels[lo:hi][doc])


def _discount(once: int | None, twice: int | None) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def _place(keys, wanted):
    """Where each wanted key lies in the sorted keys; -1 if it isn't there."""
    import numpy as np

    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class _Shared:
    """A level of the shared backoff: P(symbol | context) from continuation counts n, interpolated with the level below."""

    def __init__(self, context, symbol, n, discount: float):
        import numpy as np

        order = np.lexsort((symbol, context))
        context, symbol, n = context[order], symbol[order], n[order].astype(float)
        self.contexts, where = np.unique(context, return_inverse=True)
        total = np.bincount(where, weights=n, minlength=len(self.contexts))
        self.keys, self.high = context << _BITS | symbol, (n - discount) / total[where]
        self.rest = discount * np.bincount(where, minlength=len(self.contexts)) / np.maximum(total, 1)

    def probability(self, context, symbol, below):
        import numpy as np

        at, here = _place(self.keys, context << _BITS | symbol), _place(self.contexts, context)
        high = np.where(at >= 0, self.high[at] if len(self.high) else 0, 0)
        return high + np.where(here >= 0, self.rest[here] if len(self.rest) else 1, 1) * below


class Model:
    """Numpy arrays of the fitted counts; sent to the executors as one broadcast of bounded size (``ROWS``)."""

    def __init__(self, own, discounts, shared: list[_Shared], size: int):
        """own: context, symbol, plain, toxic of labelled rows; discounts: of the ordinary and the toxic class; shared: levels of two, one and no symbols of context; size: different symbols."""
        import numpy as np

        context, symbol = own["context"].to_numpy(), own["symbol"].to_numpy()
        self.shared, self.base = shared, 1 / (size + 1)
        self.contexts, where = np.unique(context, return_inverse=True)
        order = np.lexsort((symbol, where))
        self.keys = (where.astype(np.int64) << _BITS | symbol)[order]
        self.high, self.rest = [], []
        for side, d in zip(("plain", "toxic"), discounts, strict=True):
            c = own[side].to_numpy().astype(float)
            total = np.bincount(where, weights=c, minlength=len(self.contexts))
            types = np.bincount(where, weights=c > 0, minlength=len(self.contexts))
            self.high.append((np.maximum(c - d, 0) / np.maximum(total, 1)[where])[order])
            self.rest.append(np.where(total > 0, d * types / np.maximum(total, 1), 1))
        self.scale, self.curve = 1.0, np.zeros(2)

    def _ratios(self, context, symbol):
        """log P(symbol | context, toxic) - log P(symbol | context, ordinary); 0 for contexts that no labelled row has, where both are the shared estimate."""
        import numpy as np

        out, here = np.zeros(len(context)), _place(self.contexts, context)
        use = np.flatnonzero(here >= 0)
        here, context, symbol = here[use], context[use], symbol[use]
        p = np.full(len(use), self.base)
        for level, bits in zip(reversed(self.shared), (0, 1, 2), strict=True):
            p = level.probability(context & ((1 << bits * _BITS) - 1), symbol, p)
        at = _place(self.keys, here << _BITS | symbol)
        logs = [np.log(np.where(at >= 0, high[at], 0) + rest[here] * p) for high, rest in zip(self.high, self.rest, strict=True)]
        out[use] = logs[1] - logs[0]
        return out

    def ratios(self, context, symbol, memory: _Memory):
        slot, known = memory.look(context, symbol)
        out = memory.value[slot]
        if not known.all():
            c, s, k = context[~known], symbol[~known], slot[~known]
            order, head = _distinct(c, s)
            fresh = self._ratios(c[order][head], s[order][head])
            value = _repeat(fresh, head, len(c))
            back = out[~known]
            back[order] = value
            out[~known] = back
            memory.keep(k[order][head], c[order][head], s[order][head], fresh)
        return out

    def features(self, column, memory: _Memory):
        """For each text of an Arrow column the mean ratio over the stretch of ``WINDOW`` symbols with the highest one (a shorter text counts as filled up with zeros); 0 for a text without letters."""
        import numpy as np

        out = np.zeros(len(column))
        for lo, hi, texts in text_slices(column, _SLICE):
            if hi - lo == 1 and len(texts[0] or "") > _PIECE:
                peaks, short = [], 0.0
                for context, symbol in _long(texts[0], WINDOW - 1):
                    upto = np.r_[0, np.cumsum(self.ratios(context, symbol, memory))]
                    if len(upto) > WINDOW:
                        peaks.append((upto[WINDOW:] - upto[:-WINDOW]).max())
                    elif not peaks:
                        short = upto[-1]
                out[lo] = max(peaks, default=short) / WINDOW
                continue
            context, symbol, doc = sequences(texts)
            r = self.ratios(context, symbol, memory)
            n = np.bincount(doc, minlength=hi - lo)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            start = (np.cumsum(n) - n)[some]
            upto = np.r_[0, np.cumsum(r)]
            place = np.arange(len(r)) - np.repeat(start, n[some])  # within the text
            back = np.minimum(place + 1, WINDOW)
            window = upto[1:] - upto[np.arange(len(r)) + 1 - back]
            window[(back < WINDOW) & (np.repeat(n[some], n[some]) >= WINDOW)] = -np.inf
            peak = np.maximum.reduceat(window, start)
            whole = upto[start + n[some]] - upto[start]
            out[lo + some] = np.where(n[some] < WINDOW, whole, peak) / WINDOW
        return out

    def fit_curve(self, x, y, rounds: int = 50):
        """Logistic regression by Newton steps, with a small ridge."""
        import numpy as np

        beta = np.zeros(2)
        if not len(y) or y.min() == y.max():
            beta[1] = -3.0 if not len(y) or y.max() == 0 else 3.0
        else:
            self.scale = float(x.std()) or 1.0
            z = np.c_[x / self.scale, np.ones(len(x))]
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * beta)
                beta = beta + np.clip(step, -5, 5)
                if np.abs(step).max() < 1e-9:
                    break
        self.curve = beta

    def scores(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(x / self.scale * self.curve[0] + self.curve[1], -30, 30)))


def _repeat(values, head, n: int):
    """Each value as often as its group, whose starts are head, has members."""
    import numpy as np

    return np.repeat(values, np.diff(np.r_[head, n]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, rows: int = ROWS) -> Model:
    """labels: id and 0/1. Rows of fold 0 and null labels or ids are not learned from; fold 1 fits the curve, folds 2 to 4 the class models."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    known = materialise(known.withColumn("curve", fold(F.col("doc_id")) == 1), "toxicity-labels")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(known), "doc_id", "left")  # at most ``labelled`` rows
    seen = joined.select("text", F.when(~F.col("curve"), F.col("toxic")).alias("label"))
    counts = seen.mapInArrow(_counts, "context long, symbol long, plain long, toxic long")
    counts = materialise(counts.groupBy("context", "symbol").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic")), "toxicity-sequences")
    # Continuation counts of ever shorter sequences: how many different symbols stand before each.
    shorter = lambda df, n: df.groupBy(F.col("context").bitwiseAND((1 << n * _BITS) - 1).alias("context"), "symbol").agg(F.count("*").alias("n"))
    three = materialise(shorter(counts, 2), "toxicity-continuations")
    two = materialise(shorter(three, 1), "toxicity-continuations")
    levels = [three, two, shorter(two, 0)]
    own = counts.where("plain + toxic > 0")
    contexts = own.select(F.col("context").bitwiseAND((1 << 2 * _BITS) - 1).alias("context")).distinct()
    used = [levels[0].join(contexts, "context", "left_semi"), levels[1].join(contexts.select(F.col("context").bitwiseAND((1 << _BITS) - 1).alias("context")).distinct(), "context", "left_semi"), levels[2]]
    if labelled > 1 and sum(df.count() for df in (own, *used)) > rows:
        return fit(docs, labels, id_col, text_col, label_col, labelled // 2, rows)
    times = lambda c, k: F.sum((F.col(c) == k).cast("long"))
    of = own.agg(*[times(c, k) for c in ("plain", "toxic") for k in (1, 2)]).first()
    shared = []
    for level, part in zip(levels, used, strict=True):
        once = level.agg(times("n", 1), times("n", 2)).first()
        got = part.toArrow().to_pandas()
        shared.append(_Shared(got["context"].to_numpy(), got["symbol"].to_numpy(), got["n"].to_numpy(), _discount(*once)))
    model = Model(own.toArrow().to_pandas(), (_discount(of[0], of[1]), _discount(of[2], of[3])), shared, len(shared[2].keys))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        import pyarrow as pa

        memory = _Memory()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value.features(batch.column(0), memory)), batch.column(1)], ["peak", "toxic"])

    got = joined.where("curve").select("text", "toxic").mapInArrow(features, "peak double, toxic int").toArrow().to_pandas().sort_values(["peak", "toxic"])
    model.fit_curve(got["peak"].to_numpy(), got["toxic"].to_numpy() > 0)
    held.unpersist()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of docs and ``score``: 0 to 1, higher is likelier toxic. Null or empty text gets the curve's value at no evidence."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    memory: list[_Memory] = []

    @F.arrow_udf("double")
    def scored(texts):
        import pyarrow as pa

        if not memory:
            memory.append(_Memory())
        return pa.array(held.value.scores(held.value.features(texts, memory[0])))

    return docs.withColumn("score", scored(F.col(text_col).cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    The score depends on the text alone, and a very long text is read whole. Without
    usable labels of both kinds the score is a constant below (or above) one
    half. Null text counts as empty; a null id is in the fold of the empty
    string; rows that repeat an id are scored each; labels that repeat an id
    count as toxic if one of them does. An empty table gives an empty result;
    other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col, label_col, labelled)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = score(rows, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
