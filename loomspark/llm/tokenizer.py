"""Token ids of a whole corpus with a public byte-level BPE vocabulary, through a table of distinct words.

1. Texts are split into words once.  Each stretch of about ``block_chars`` characters of one input partition is a block: its
   documents are kept as word codes (places in the block's list of distinct words), the list as one row.
2. The distinct words of all blocks are encoded, each once.
3. Their ids are joined back to the blocks' word lists, and a document's ids are the ids at its codes, in order: one
   vectorised gather per block, without another shuffle of words.

What is shuffled is the codes and each block's distinct words, never one row per occurrence, so a word that makes up a third of
all text is one row per block.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.session import Scratch, spread

#: Where the vocabulary files lie; every executor must see this folder.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def encoding(vocabulary: str):
    """The encoder of this process; strings that look like special tokens are ordinary text."""
    if vocabulary not in _loaded:
        import tiktoken

        _loaded[vocabulary] = tiktoken.Encoding("loomspark", pat_str=PATTERN, mergeable_ranks=read_ranks(vocabulary), special_tokens={})
    return _loaded[vocabulary]


def unique_by(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with one row per key: the one with the smallest text.  Costs one aggregation of the keys where none repeats."""
    repeated = df.groupBy(key).count().filter("count > 1").select(key)
    if not repeated.limit(1).count():
        return df
    again = df.join(repeated, key, "left_semi").groupBy(key).agg(F.min(text).alias(text))
    return df.join(repeated, key, "left_anti").select(key, text).unionByName(again.select(key, text))


def _lists(values: array, ends: list[int]) -> pa.ListArray:
    offsets = np.zeros(len(ends) + 1, dtype=np.int32)
    offsets[1:] = ends
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(values, dtype=np.int32) if len(values) else np.zeros(0, np.int32)))


_BLOCK_SCHEMA = "block bigint, id bigint, codes array<int>, words array<string>"
_ARROW = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("codes", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))])


def _to_blocks(block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        block, seen = TaskContext.get().partitionId() << 32, 0
        code: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            words = pa.array([list(code)], pa.list_(pa.string()))
            return pa.record_batch([pa.array([block]), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int32())), words], schema=_ARROW)

        for batch in batches:
            ids, codes, ends, blocks = [], array("i"), [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split(text) if text else []
                codes.extend([code.setdefault(w, len(code)) for w in words])
                ids.append(doc)
                ends.append(len(codes))
                blocks.append(block)
                seen += len(text or "")
                if seen >= block_chars:
                    yield flush()
                    code, seen, block = {}, 0, block + 1
            yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(ids, pa.int64()), _lists(codes, ends), pa.nulls(len(ids), pa.list_(pa.string()))], schema=_ARROW)
        if code:
            yield flush()

    return run


def _encode_words(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = encoding(vocabulary)._encode_single_piece
        for batch in batches:
            ids, ends = array("i"), []
            for word in batch.column(0).to_pylist():
                ids.extend(single(word))
                ends.append(len(ids))
            yield pa.record_batch([batch.column(0), _lists(ids, ends)], names=["word", "ids"])

    return run


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the length of each list."""
    one = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    one = one if isinstance(one, pa.ListArray) else pa.concat_arrays(one.chunks)
    return one.flatten().to_numpy(zero_copy_only=False), one.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ids_by_position(key: str):
    """Documents of a block (id, codes) and its words (at, ids) to the documents' ids: a gather, without a loop over words."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])
        if not docs.num_rows:
            return schema.empty_table()
        codes, doc_lengths = _flat(docs["codes"])
        offsets = np.zeros(len(doc_lengths) + 1, dtype=np.int64)
        if len(codes):
            order = np.argsort(words["at"].to_numpy())
            flat, lengths = _flat(words["ids"])
            begins = np.cumsum(lengths) - lengths
            begins, lengths = begins[order], lengths[order]
            ends = np.cumsum(lengths[codes])
            # the place of each output id: the start of its word's ids plus its place in the word
            n = lengths[codes]
            gather = np.repeat(begins[codes] - (ends - n), n) + np.arange(ends[-1])
            ids = flat[gather].astype(np.int32)
            offsets[1:] = np.concatenate([[0], ends])[np.cumsum(doc_lengths)]
        else:
            ids = np.zeros(0, np.int32)
        return pa.table([docs["id"], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], schema=schema)

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block_chars: int = 4_000_000) -> DataFrame:
    """key (bigint), ids (array<int>) of every document, without special tokens; a null or empty text gives an empty list.

    Other columns are not read.  Rows repeated under one key count once (the smallest text, should they differ); rows with a
    null key are left out.  Texts of any length are encoded whole.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "encode")
    rows = unique_by(spread(docs.select(F.col(key).cast("bigint").alias(key), text).filter(F.col(key).isNotNull())), key, text)
    blocks = scratch.keep(rows.mapInArrow(_to_blocks(block_chars), _BLOCK_SCHEMA), "blocks")
    lists = blocks.filter("words IS NOT NULL").select("block", F.posexplode("words").alias("at", "word"))
    words = lists.select("word").distinct()
    words = words.mapInArrow(_encode_words(vocabulary), "word string, ids array<int>")
    ids = lists.join(words, "word").select(F.col("block").alias("of_block"), "at", "ids")
    coded = blocks.filter("words IS NULL").select("block", "id", "codes")
    return coded.groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(_ids_by_position(key), f"{key} bigint, ids array<int>")


def vocabulary_table(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, piece (binary): the vocabulary, about 50,000 rows whatever the corpus."""
    return spark.createDataFrame([(rank, bytearray(piece)) for piece, rank in read_ranks(vocabulary).items()], "id int, piece binary")


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, text: ids back to text through a join with the id-to-piece table (bounded by the vocabulary, so broadcast).

    Inverse of ``encode`` for texts that are valid Unicode; a null or empty list gives the empty text.
    """
    pieces = F.broadcast(vocabulary_table(encoded.sparkSession, vocabulary))
    flat = encoded.select(key, F.posexplode_outer("ids").alias("at", "id")).join(pieces, "id", "left")
    joined = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", F.hex("piece").alias("piece"))))).alias("p"))
    return joined.select(key, F.decode(F.unhex(F.array_join("p.piece", "")), "UTF-8").alias("text"))
