"""Problem 8: encoding a corpus with a public tokenizer through a table of its distinct words."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.tables import cut_lineage, load

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts text into words before merging; (?U) gives \s and \p the Unicode meaning in Java.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most frequent words, so many at most, whose ids are broadcast: some megabytes.
FREQUENT = 1 << 16


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def _word_ids(path: str):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(words: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([enc.encode_ordinary(w) for w in words.to_pylist()], pa.list_(pa.int32()))

    return ids


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for NULL and empty text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("(?U)(" + WORDS + ")"), F.lit(1)), F.array().cast("array<string>"))


def word_table(df: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """(word, n, ids) of every distinct word of the corpus, written once."""
    words = df.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return cut_lineage(words.select("word", "n", _word_ids(vocabulary)("word").alias("ids")))


_PLACED = T.StructType([T.StructField("parts", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("rare", T.ArrayType(T.StringType()))])
_PLACED_PA = pa.struct([("parts", pa.list_(pa.list_(pa.int32()))), ("rare", pa.list_(pa.string()))])


def _placing(spark, words: pa.Table):
    """For the words of a text the ids of those in the table, in parts cut at each word that isn't, and these words."""
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf(_PLACED)
    def place(lists: pa.Array) -> pa.Array:
        table = shared.value
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        flat = lists.flatten()
        known, ids = table.column(0).combine_chunks(), table.column(1).combine_chunks()
        at = pc.index_in(flat, value_set=known)
        found = ids.take(at)
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        # A part begins at each text and behind each missing word; both kinds of cut are in order already.
        cuts = np.sort(np.concatenate([starts[:-1], missing + 1]))
        lost = np.searchsorted(missing, starts)
        inner = pa.ListArray.from_arrays(pa.array(sizes[np.append(cuts, len(flat))], pa.int32()), found.flatten())
        parts = pa.ListArray.from_arrays(pa.array(lost + np.arange(len(starts)), pa.int32()), inner)
        rare = pa.ListArray.from_arrays(pa.array(lost, pa.int32()), flat.take(pa.array(missing, pa.int64())))
        return pa.StructArray.from_arrays([parts, rare], fields=list(_PLACED_PA))

    return place


def encode_corpus(df: DataFrame, *, key: str, text: str, vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """(key, ids): the token ids of every text by a byte-level BPE vocabulary, without special tokens.

    The words are split in Spark and each distinct word is encoded once. The ids of the ``frequent`` most frequent words
    are broadcast, a table of a bounded number of rows, and set in place without moving a text. The other words, none of
    which is hot, are joined by their hash and come back by position; a text travels once, to where its key belongs.

    Defined results: NULL and empty text give an empty list; marker strings in a text are plain text; repeated rows of
    a key give one row; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark = df.sparkSession
    table = word_table(df, text, vocabulary)
    common = table.orderBy(F.desc("n"), "word").limit(frequent).select("word", "ids").toArrow()
    # A key in a struct equals itself even if it is NULL. All that follows keeps the partitioning of the texts by key.
    docs = df.select(F.struct(F.col(key).alias("k")).alias("_key"), F.col(text).alias("_text")).dropDuplicates(["_key"])
    place = _placing(spark, common)
    placed = lambda rows, *also: rows.select("_key", place(words_of(F.col("_text"))).alias("x"), *also).select("_key", "x.*", *also)
    if common.num_rows < frequent:  # the table is whole
        return placed(docs).select(F.col("_key.k").alias(key), F.flatten("parts").alias("ids"))
    seeking = placed(docs).select("_key", F.posexplode("rare").alias("pos", "word")).join(table.select("word", "ids"), "word")
    back = seeking.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("back"))
    none = F.array().cast("array<int>")
    found = F.coalesce(F.col("back.ids"), F.array().cast("array<array<int>>"))
    ids = F.flatten(F.zip_with("parts", found, lambda p, r: F.concat(p, F.coalesce(r, none))))
    return placed(docs.join(back, "_key", "left"), "back").select(F.col("_key.k").alias(key), ids.alias("ids"))


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[tuple[int, bytes]]:
    with open(path, "rb") as f:
        return [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]


def decode_corpus(encoded: DataFrame, *, key: str, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of every list of ids, by a join of the ids with the table of pieces.

    The table has as many rows as the vocabulary, a size fixed by its file. An empty list gives empty text.
    """
    spark = encoded.sparkSession
    pieces = spark.createDataFrame(_pieces(vocabulary), "_id int, piece binary")
    flat = encoded.select(F.col(key).alias("_key"), F.posexplode_outer(ids).alias("pos", "_id"))
    joined = flat.join(F.broadcast(pieces), "_id", "left")
    parts = joined.groupBy("_key").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("piece").alias("h"))))).alias("x"))
    return parts.select(F.col("_key").alias(key), F.decode(F.unhex(F.array_join(F.col("x.h"), "")), "UTF-8").alias("text"))


def p8_ids(spark, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(load(spark, sf_dir, "documents", "doc_id", "text"), key="doc_id", text="text")


def p8_texts(spark, sf_dir: str) -> DataFrame:
    """The text of every document, decoded from its token ids."""
    return decode_corpus(p8_ids(spark, sf_dir), key="doc_id")


TEXTS_SQL = "select distinct doc_id, coalesce(text, '') as text from documents"
