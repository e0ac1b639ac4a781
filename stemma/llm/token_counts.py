"""Token counts of whole texts, huge documents in overlapping chunks.

A text of up to ``chunk`` characters is encoded as it is. A longer one is cut
into chunks that are encoded in separate tasks, each with ``overlap`` more
characters on both sides, and the token sequences are spliced where they agree:
at the same token on the same bytes in the encodings of both chunks.

Why such a boundary is stable: the vocabulary merges by the rank of the merged
piece, leftmost first, so a sequence of pieces is the encoding of its text
exactly if each two neighbours stay apart when encoded on their own. Every pair
of neighbours of the spliced sequence occurs in one of the two encodings: the
pairs before the shared token and the one that ends in it in the left chunk's,
the one that starts with it and the rest in the right chunk's. Characters cut
at a chunk's edge, or the white space that the encoder puts before a chunk, are
harmless: pieces that they changed have no match on the other side. Where an
overlap holds no shared token, the document is encoded again with the overlap
doubled, at last as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

#: Characters of a chunk and of its overlap on either side.
CHUNK, OVERLAP = 32_768, 256
LIMIT = 4096
_MODELS: dict[str, object] = {}


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def _count_udf(path: str):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def count(texts):
        import pandas as pd

        model = _encoder(path)
        return pd.Series([len(model.encode(t)) for t in texts], dtype="int64", index=texts.index)

    return count


def encode_chunk(model, text: str, base: int, own_from: int, own_to: int, overlap: int) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Encode text, which starts at byte base of its document. Returns the number of tokens and, for each side's overlap, the tokens in it as packed (first byte, length, id) and how many tokens precede each.

    own_from, own_to: the bytes of the document between which the chunk is cut without overlap; the overlaps are the ``overlap`` characters around these.
    """
    pieces = model.encode(text, return_type="proto").pieces
    n = len(pieces)
    left, left_at, right, right_at = [], [], [], []
    low, high = own_from + 4 * overlap, own_to - 4 * overlap
    for i, p in enumerate(pieces):
        begin, end = base + p.begin, base + p.end
        if end <= begin or (i and pieces[i - 1].begin == p.begin):  # a byte of a character, or the encoder's own white space
            continue
        if end - begin > 255 or p.id >> 20:
            continue
        packed = begin << 28 | (end - begin) << 20 | p.id
        if begin <= low:
            left.append(packed)
            left_at.append(i)
        if begin >= high:
            right.append(packed)
            right_at.append(i)
    return n, left, left_at, right, right_at


_CHUNK_SCHEMA = "digest string, chunk long, chunks long, tokens long, left array<long>, left_at array<long>, right array<long>, right_at array<long>"


def _encode_chunks(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    def run(batches):
        import pandas as pd

        model = _encoder(path)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                out.append((r.digest, r.chunk, r.chunks, *encode_chunk(model, r.part, r.base, r.own_from, r.own_to, overlap)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _CHUNK_SCHEMA.split(", ")])

    return chunks.select("digest", "chunk", "chunks", "part", "base", "own_from", "own_to").mapInPandas(run, _CHUNK_SCHEMA)


_PART_SCHEMA = "digest string, chunks long, chunk long, part string, base long, own_from long, own_to long"


def _cut(long_texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """digest, text to one row per chunk, in one pass over each text, dealt out again so that a huge document's chunks go to many tasks."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in _PART_SCHEMA.split(", ")]
        for batch in batches:
            for digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, at, chunks = [], 0, -(-len(text) // chunk)
                for k in range(chunks):
                    start, end = k * chunk, min(len(text), (k + 1) * chunk)
                    first = max(0, start - overlap)
                    to = at + len(text[start:end].encode())
                    rows.append((digest, chunks, k, text[first : end + overlap], at - len(text[first:start].encode()), at, to))
                    at = to
                    if len(rows) == 64 or k == chunks - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows = []

    parts = int(long_texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return long_texts.select("digest", "text").mapInArrow(run, _PART_SCHEMA).repartition(parts, "digest", "chunk")


def _splice(encoded: DataFrame) -> DataFrame:
    """digest, n_tokens (null where some boundary has no shared token)."""
    by = Window.partitionBy("digest").orderBy("chunk")
    rows = encoded.select(
        "digest", "chunk", "chunks", "tokens",
        F.lead("left").over(by).alias("next_left"), F.lead("left_at").over(by).alias("next_left_at"), "right", "right_at",
    )
    shared = F.get(F.array_intersect("right", "next_left"), F.lit(0))
    place = lambda spans, at: F.get(F.col(at), (F.array_position(F.col(spans), F.col("shared")) - 1).cast("int"))
    rows = rows.withColumn("shared", shared).select(
        "digest", "chunk", "chunks", "tokens",
        # tokens of this chunk before the splice, tokens of the next one before it
        F.when(F.col("chunk") < F.col("chunks") - 1, place("right", "right_at")).alias("stop"),
        place("next_left", "next_left_at").alias("next_skip"),
    )
    last = F.col("chunk") == F.col("chunks") - 1
    return rows.groupBy("digest").agg(
        F.sum(F.when(last, F.col("tokens")).otherwise(F.col("stop") - F.col("next_skip"))).alias("sum"),
        F.sum(F.when(~last & F.col("stop").isNull(), 1).otherwise(0)).alias("open"),
    ).select("digest", F.when(F.col("open") == 0, F.col("sum")).alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit: one row per input row.

    vocabulary: a sentencepiece model file that every executor has. Null text
    counts as empty (0 tokens). Rows that repeat an id are counted each; equal
    huge texts are encoded once. An empty table gives an empty result; other
    columns are ignored.
    """
    path = vocabulary or vocabulary_path()
    count = _count_udf(path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bytes_ = F.octet_length("text").cast("long").alias("n_bytes")
    short = rows.where(F.char_length("text") <= chunk).select("doc_id", bytes_, count("text").alias("n_tokens"))
    huge = rows.where(F.char_length("text") > chunk).select("doc_id", "text", bytes_, F.sha2("text", 256).alias("digest"))
    texts = huge.select("digest", "text").dropDuplicates(["digest"])
    done, todo, width = None, texts, overlap
    while True:
        if 2 * width < chunk:
            found = materialise(_splice(_encode_chunks(_cut(todo, chunk, width), path, width)), "token-splices")
        else:
            found = materialise(todo.select("digest", count("text").alias("n_tokens")), "token-splices")
        ok = found.where(F.col("n_tokens").isNotNull())
        done = ok if done is None else done.unionByName(ok)
        missing = found.where(F.col("n_tokens").isNull())
        if missing.isEmpty():
            break
        todo, width = texts.join(missing.select("digest"), "digest", "left_semi"), 2 * width
    long_ = huge.drop("text").join(done, "digest").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long_).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
