"""Packing documents into sequences by cutting-stock column generation.

A document of n tokens fills n // size sequences by itself; the rest, its
remainder, is packed with other documents' remainders. The histogram of the
remainders is a cutting-stock problem: a linear program chooses how often each
pattern (a multiset of lengths that fits one sequence) is used, and an
unbounded knapsack, solved by dynamic programming over the dual prices, finds
new columns and proves the bound. It goes on until no plan of whole sequences
could have fewer, or the bound is met within ``gap``; within one sequence of the
bound ``LAST`` pricings are enough, since rounding costs more than that. The program's size
depends on the sequence length alone (at most size - 1 lengths), never on the
number of documents. It starts from patterns that take the longest lengths
first: these are near the bound already, and starting from one column per
length instead took 17,000 pivots on 173 lengths without getting there. Slightly
uneven counts keep the pivots from being degenerate.

Patterns are used as often as the rounded-down solution says; what rounding
leaves over (less than one sequence per pattern) is packed by the same dynamic
program over the documents left. They are ranked within their length, and a
rank range of a length belongs to a pattern, so a document finds its sequence
and its offset by a join with a table of ranges. Sequences with more padding
than ``padding`` are laid end to end instead and cut at the sequence length, the
last one into powers of two; only their documents are cut inside a remainder.
"""

from __future__ import annotations

import itertools
import json
import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table, text_slices

SIZE = 2048
END = 1
#: The program stops within this fraction of its proven bound; or, once it is within one sequence of it, after so many pricings.
GAP, LAST = 1e-5, 200
#: Share of a sequence that may be padding.
PADDING = 0.01
#: Columns that are taken from one solution of the knapsack, at most.
_BATCH = 64
#: Documents of one length and bucket that are ranked together, about.
_RANKED = 2_000
#: Documents laid end to end that are sent to every executor to find their texts; more meet theirs in a shuffle.
_SENT = 50_000
#: Pieces of one text that are cut in one task, about.
_CUTS = 1_000
#: Bytes that a worker remembers, what an entry takes besides its characters and ids, and stretches of one text that are looked up at a time.
_MEMO, _ENTRY, _AT_ONCE = 64 << 20, 160, 1 << 16
_WORKERS: dict[str, Tokenizer] = {}

# The normaliser and the pre-tokeniser of the vocabulary whose words may be remembered.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokenizer:
    """The library's ids, with a memory of words.

    The vocabulary's model sees each word of the pre-tokenizer alone, and no
    word has white space in it, so ids are concatenated from what is remembered
    of the stretches between white space; only new stretches are encoded. The
    memory is two dicts of half its bound: when the younger is full it takes the
    place of the older, from which what is met again comes back, so frequent
    stretches stay and rare ones go. A worker holds it for all of its tasks, and
    beside those of other stages. In a text without other punctuation a lone full stop or comma is a word of its
    own, so it may stand apart. That is done for texts made of
    plain Latin characters, where lower-casing and cutting into words need no
    Unicode tables that could differ; every other text, and one that holds a
    special token's string, goes to the library whole. So does every text of a
    vocabulary with another normaliser, pre-tokeniser or kind of model.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        spec = json.loads(self.library.to_str())
        model, added = spec["model"], spec["added_tokens"]
        self.known = (spec["normalizer"], spec["pre_tokenizer"], model["type"]) == (_NORMALIZER, _PRE_TOKENIZER, "BPE") and spec["truncation"] is None
        self.known = self.known and not model["dropout"] and all(x["content"].startswith("<|") for x in added)
        self.plain = regex.compile(r"[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u017e]*")
        self.simple = regex.compile(r"[\t\n\r .,0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]*")
        self.words = regex.compile(_WORDS)
        self.stretches: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def ids(self, text: str):
        """The ids as a little-endian unsigned 32-bit numpy array."""
        import numpy as np

        if not self.known:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        if self.simple.fullmatch(text) and not any(x in text for x in ("..", ",,", ".,", ",.")):
            text = text.replace(".", " . ").replace(",", " , ")
        elif not self.plain.fullmatch(text) or "<|" in text:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        parts = text.lower().split()
        return np.frombuffer(b"".join(self._data(parts[lo : lo + _AT_ONCE]) for lo in range(0, len(parts), _AT_ONCE)), "<u4")

    def _data(self, parts: list[str]) -> bytes:
        """The ids of some stretches, end to end."""
        new = set(parts).difference(self.stretches)
        if new and self.size > _MEMO // 2:
            self.older, self.stretches, self.size, new = self.stretches, {}, 0, set(parts)
        if again := [x for x in new if x in self.older]:
            self._keep(again, [self.older[x] for x in again])
            new.difference_update(again)
        if new:
            self._learn(list(new))
        return b"".join(map(self.stretches.__getitem__, parts))

    def _keep(self, stretches: list[str], data: list[bytes]) -> None:
        self.stretches.update(zip(stretches, data, strict=True))
        self.size += sum(map(len, data)) + sum(map(len, stretches)) + _ENTRY * len(stretches)

    def _learn(self, stretches: list[str]) -> None:
        """Encode new stretches in one call: white space keeps them apart, each token names its word, and the pattern tells how many words a stretch has."""
        import numpy as np

        got = self.library.encode(" ".join(stretches), add_special_tokens=False)
        ids, word = np.array(got.ids, "<u4"), np.array(got.word_ids)
        start = np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(ids)]
        first = start[np.cumsum([0, *(1 if x.isalpha() else len(self.words.findall(x)) for x in stretches)])].tolist()
        data = ids.tobytes()
        self._keep(stretches, [data[4 * a : 4 * b] for a, b in zip(first, first[1:], strict=False)])

    @staticmethod
    def of(path: str) -> Tokenizer:
        if path not in _WORKERS:
            _WORKERS[path] = Tokenizer(path)
        return _WORKERS[path]


# ---- the linear program, on the driver: its size is bounded by the sequence length ----


def first_patterns(lengths: list[int], counts: list[int], size: int) -> tuple[list[dict[int, int]], list[float]]:
    """A starting basis: patterns that take the longest remaining lengths first, each used (fractionally) until one of its lengths is used up. The matrix is triangular in the order in which lengths run out."""
    left, alive = [float(c) for c in counts], sorted(range(len(lengths)), key=lambda i: -lengths[i])
    patterns, uses = [], []
    while alive:
        room, pattern = size, {}
        for i in alive:
            if n := room // lengths[i]:
                pattern[i] = n
                room -= n * lengths[i]
                if not room:
                    break
        x = min(left[i] / n for i, n in pattern.items())
        gone = [i for i, n in pattern.items() if left[i] / n <= x * (1 + 1e-12)]
        for i, n in pattern.items():
            left[i] -= n * x
        patterns.append(pattern)
        uses.append(x)
        for i in gone[1:]:  # lengths that run out together need columns of their own
            patterns.append({i: size // lengths[i]})
            uses.append(0.0)
        alive = [i for i in alive if i not in gone]
    return patterns, uses


def knapsack(lengths, prices, size: int):
    """The highest total price of every capacity up to size, by lengths (ascending) taken any number of times, and the length that was added last (-1: the capacity has room to spare)."""
    import numpy as np

    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    fit = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if k := fit[c]:
            x = prices[:k] + best[c - lengths[:k]]
            j = int(x.argmax())
            if x[j] > best[c]:
                best[c], took[c] = x[j], j
    return best, took


def _pattern(took, lengths, capacity: int) -> dict[int, int]:
    pattern: dict[int, int] = {}
    while capacity > 0:
        if (j := int(took[capacity])) < 0:
            capacity -= 1
        else:
            pattern[j] = pattern.get(j, 0) + 1
            capacity -= int(lengths[j])
    return pattern


def solve(lengths: list[int], counts: list[int], size: int, gap: float = GAP, start: tuple | None = None) -> tuple[list[dict[int, int]], list[float], float]:
    """Patterns, their fractional uses, which cover every count, and the proven lower bound of the number of sequences.

    lengths ascend. start: another basis than ``first_patterns``. Each round
    prices by one knapsack: its value proves a bound, and the best patterns
    with each length in them are the columns that may enter.
    """
    import numpy as np

    m, w, b = len(lengths), np.array(lengths), np.array(counts, float)
    if not m:
        return [], [], 0.0
    patterns = [dict(p) for p in (start or first_patterns(lengths, counts, size)[0])]
    basis = np.zeros((m, m))
    for k, p in enumerate(patterns):
        basis[list(p), k] = list(p.values())
    inverse = np.linalg.inv(basis)
    uneven = b * (1 + 1e-6 * np.random.default_rng(0).random(m))
    x, y, bound = np.maximum(inverse @ uneven, 0), inverse.sum(axis=0), float(w @ b) / size
    for round_ in itertools.count():
        use = np.flatnonzero(y > 1e-12)
        best, took = knapsack(w[use], y[use], size)
        # The prices over the best pattern's value are a feasible dual solution.
        bound = max(bound, float(np.maximum(y, 0) @ b) / max(best[size], 1.0))
        z = x.sum()
        if best[size] <= 1 + 1e-9 or z <= bound * (1 + gap) or math.ceil(z * (1 - 2e-6)) <= math.ceil(bound - 1e-9) or (z < bound + 1 and round_ >= LAST):
            break
        value = y[use] + best[size - w[use]]
        entered = 0
        for j in np.argsort(-value)[:_BATCH].tolist():
            if value[j] <= 1 + 1e-9:
                break
            found = _pattern(took, w[use], size - int(w[use[j]]))
            found[j] = found.get(j, 0) + 1
            new = {int(use[k]): n for k, n in found.items()}
            rows, n = list(new), np.array(list(new.values()), float)
            now = float(y[rows] @ n)
            if now <= (1 + 0.2 * (best[size] - 1) if entered else 1 + 1e-9):
                continue
            d = inverse[:, rows] @ n
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            r = int(ratio.argmin())
            step = ratio[r]
            x = np.maximum(x - step * d, 0)
            x[r] = step
            patterns[r] = new
            row = inverse[r] / d[r]
            moved, filled = np.flatnonzero(np.abs(d) > 1e-12), np.flatnonzero(row)
            inverse[np.ix_(moved, filled)] -= np.outer(d[moved], row[filled])
            inverse[r] = row
            y = y + (1 - now) * row
            entered += 1
        if not entered:
            break
    return patterns, np.maximum(inverse @ b, 0).tolist(), bound


def fill_up(lengths: list[int], left: list[int], size: int) -> list[tuple[dict[int, int], int]]:
    """Patterns for the documents that rounding leaves, each with the longest one left and those that fill the sequence best: a knapsack in which every document is taken once, longest first, until a sequence is full."""
    import numpy as np

    left, out = list(left), []
    alive = [i for i in reversed(range(len(lengths))) if left[i]]
    while alive:
        i = alive[0]
        left[i] -= 1
        room = size - lengths[i]
        last, items = np.full(room + 1, -2), []
        last[0] = -1
        for k in alive:
            n = lengths[k]
            for _ in range(min(left[k], room // n)):
                new = (last[n:] == -2) & (last[: room + 1 - n] != -2)
                if not new.any():
                    break
                last[n:][new] = len(items)
                items.append(k)
            if last[room] != -2:
                break
        pattern, c = {i: 1}, int(np.flatnonzero(last != -2)[-1])
        while c:
            k = items[last[c]]
            pattern[k] = pattern.get(k, 0) + 1
            c -= lengths[k]
        left[i] += 1
        n = min(left[k] // c for k, c in pattern.items())
        for k, c in pattern.items():
            left[k] -= c * n
        out.append((pattern, n))
        alive = [k for k in alive if left[k]]
    return out


def plan(histogram: dict[int, int], size: int = SIZE, gap: float = GAP, padding: float = PADDING) -> tuple[list[tuple], int, list[int]]:
    """histogram: remainder (1 to size - 1) -> documents.

    Returns the rank ranges (remainder, first, last + 1, pattern's first
    sequence or null, copies per sequence, offset or position), the number of
    pattern sequences, and the starts of the loose sequences with the end of
    the last one: loose remainders lie end to end at their positions.
    """
    lengths = sorted(k for k, n in histogram.items() if n)
    counts = [histogram[k] for k in lengths]
    patterns, uses, _ = solve(lengths, counts, size, gap)
    left, whole = list(counts), []
    for p, x in zip(patterns, uses, strict=True):
        n = min([int(x + 1e-6), *(left[i] // c for i, c in p.items())])
        if n:
            whole.append((p, n))
            for i, c in p.items():
                left[i] -= c * n
    whole += fill_up(lengths, left, size)
    full = lambda p: sum(lengths[i] * c for i, c in p.items())
    stays = lambda n: n >= size * (1 - padding) or n & (n - 1) == 0
    kept = [(p, n) for p, n in whole if stays(full(p))]
    left = list(counts)
    ranges, at, sequences = [], [0] * len(lengths), 0
    for p, n in kept:
        offset = 0
        for i, c in sorted(p.items(), reverse=True):
            ranges.append((lengths[i], at[i], at[i] + c * n, sequences, c, offset))
            at[i] += c * n
            left[i] -= c * n
            offset += c * lengths[i]
        sequences += n
    position = 0
    for i in reversed(range(len(lengths))):
        if left[i]:
            ranges.append((lengths[i], at[i], at[i] + left[i], None, 1, position))
            position += left[i] * lengths[i]
    # The last one is cut into powers of two.
    ends, rest = [size] * (position // size), position % size
    ends += [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    starts = [0]
    for n in ends:
        starts.append(starts[-1] + n)
    return ranges, sequences, starts


# ---- on the executors ----


def _encode(batches: Iterator, path: str, size: int) -> Iterator:
    """Batches of doc_id, digest, text to doc_id, digest, n, blocks (crc32 of each full block), rest_crc."""
    import numpy as np
    import pyarrow as pa

    coder, end = Tokenizer.of(path), np.array([END], "<u4")
    for batch in batches:
        n, blocks, rest = [], [], []
        for _, _, texts in text_slices(batch.column(2)):
            for ids in map(coder.ids, texts):
                data = memoryview(np.concatenate([ids, end]).tobytes())
                k = (len(ids) + 1) // size
                n.append(len(ids) + 1)
                blocks.append([zlib.crc32(data[4 * size * i : 4 * size * (i + 1)]) for i in range(k)])
                rest.append(zlib.crc32(data[4 * size * k :]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(blocks, pa.list_(pa.int64())), pa.array(rest, pa.int64())], ["doc_id", "digest", "n", "blocks", "rest_crc"])


def _cut(batches: Iterator, path: str, size: int, bounds, first: int) -> Iterator:
    """Batches of doc_id, n, position, text of loose documents to their pieces. bounds: the loose sequences' starts and the last end; first: the first one's id."""
    import numpy as np
    import pyarrow as pa

    coder, end, bounds = Tokenizer.of(path), np.array([END], "<u4"), np.array(bounds)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        out = []
        for doc_id, n, position, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.concatenate([coder.ids(text), end]).tobytes()
            start = n - n % size
            at, stop = position, position + n % size
            while at < stop:
                k = int(np.searchsorted(bounds, at, "right")) - 1
                to = min(stop, int(bounds[k + 1]))
                lo = start + at - position
                out.append((doc_id, lo, to - at, zlib.crc32(data[4 * lo : 4 * (lo + to - at)]), n, first + k, at - int(bounds[k])))
                at = to
        cols = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", gap: float = GAP, padding: float = PADDING) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A document is its text's ids (null text: none) and the id END; a very long
    one fills sequences by itself. Pieces of a sequence lie without gaps from
    offset 0; a sequence that is neither full nor a power of two long counts as
    padded, by a share of ``padding`` at most. Rows that repeat an id are packed
    each; a null id is packed under null. An empty table gives an empty result;
    other columns are ignored. ids must fit a long.
    """
    spark, path = docs.sparkSession, vocabulary or vocabulary_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.sha2("text", 256).alias("digest"), "text")
    coded = materialise(rows.mapInArrow(lambda it: _encode(it, path, size), "doc_id long, digest string, n long, blocks array<long>, rest_crc long"), "packing-tokens")
    coded = coded.withColumn("r", F.col("n") % size)
    sizes = {x["r"]: x["docs"] for x in coded.groupBy("r").agg(F.count("*").alias("docs")).collect()}  # at most ``size`` rows
    longest = coded.agg(F.max(F.floor(F.col("n") / size))).first()[0] or 0
    ranges, sequences, bounds = plan({r: n for r, n in sizes.items() if r}, size, gap, padding)
    before, ordinal = 0, []
    for r in range(size):
        ordinal.append(before)
        before += sizes.get(r, 0)

    # Rank within a length: by bucket, so that one hot length is many small windows.
    buckets = max(1, min(1 << 16, before // _RANKED))
    coded = coded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
    ahead = coded.groupBy("r", "bucket").agg(F.count("*").alias("docs"))
    ahead = materialise(ahead.select("r", "bucket", (F.sum("docs").over(Window.partitionBy("r").orderBy("bucket")) - F.col("docs")).alias("ahead")), "packing-ranks")
    own = F.row_number().over(Window.partitionBy("r", "bucket").orderBy("doc_id", "digest"))
    ranked = coded.withColumn("own", own - 1).join(ahead, ["r", "bucket"]).withColumn("rank", F.col("own") + F.col("ahead"))

    schema = "r long, first long, past long, sequence long, copies long, place long"
    table_ = F.broadcast(spark.createDataFrame(ranges, schema))  # a few rows per basic pattern: bounded by ``size``
    placed = ranked.join(table_.withColumnRenamed("r", "range_r"), (F.col("r") == F.col("range_r")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")), "left").drop("range_r")
    placed = materialise(placed.select("doc_id", "digest", "n", "r", "blocks", "rest_crc", "rank", "first", "sequence", "copies", "place"), "packing-places")

    j = F.col("rank") - F.col("first")
    gid = F.get(F.lit(ordinal).cast("array<bigint>"), F.col("r").cast("int")) + F.col("rank")
    base = sequences + len(bounds) - 1
    full = placed.select("doc_id", "n", gid.alias("gid"), F.posexplode("blocks").alias("k", "crc")).select(
        "doc_id", (F.col("k") * F.lit(size)).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), (F.lit(base) + F.col("gid") * F.lit(longest) + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    rest = placed.where("sequence is not null").select(
        "doc_id", (F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.col("sequence") + F.floor(j / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("place") + (j % F.col("copies")) * F.col("r")).cast("long").alias("offset"),
    )
    open_ = placed.where("sequence is null and r > 0").select("doc_id", "digest", "n", (F.col("place") + j * F.col("r")).alias("position"))
    # Their texts: of equal ones a few copies, so that no task cuts all of a hot text.
    salt = F.pmod(F.xxhash64("position"), F.col("salts")).cast("int")
    times = open_.groupBy("digest").agg(F.ceil(F.count("*") / F.lit(_CUTS)).alias("salts"))
    loose = sum(past - first for _, first, past, sequence, _, _ in ranges if sequence is None)
    texts = rows.select("digest", "text").join(F.broadcast(times) if loose <= _SENT else times, "digest").dropDuplicates(["digest"])
    texts = texts.select("digest", "text", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"))
    cut = open_.join(times, "digest").withColumn("salt", salt).join(texts, ["digest", "salt"]).select("doc_id", "n", "position", "text")
    pieces = cut.mapInArrow(lambda it: _cut(it, path, size, bounds, sequences), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(rest).unionByName(pieces)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
