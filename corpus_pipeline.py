"""A corpus pipeline of five stages: toxicity, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import bpe, mixing, pii, simhash, toxicity
from vigilframe.llm.common import checkpoint, ensure_checkpoint_dir, table
from vigilframe.llm.registry import surrogate_key, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: bits that mark rows whose texts must be joined by key; they decide the way, never the result
MARKS = 1 << 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. The classifier is fitted on the labels of rows that aren't held out.

    Null and empty texts are scored as texts without words; repeated rows are decided alike; columns beside those of
    documents are left out. Without rows of both labels every text gets the labels' rate as its score."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model, COLUMNS, "text").where("score < 0.5").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the first by id, null ids
    last. Null and blank texts are one group. Of rows with equal id and text the least by the other columns stays.

    Most rows are alone with their id and text and the first of their group: they are written from where they are. Only the rows that
    a bitmap of the other keys, of fixed size, may mean are shuffled with their texts and joined by key, which decides."""
    keys = checkpoint(simhash.similar_groups(docs).groupBy("row_key").agg(F.max("first").alias("first"), F.count("*").alias("n")))
    spot = F.pmod(F.xxhash64("row_key"), F.lit(MARKS))
    word, bit = F.shiftright("spot", 6).alias("word"), F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bit")
    marks = keys.where("not first or n > 1").select(spot.alias("spot")).select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    keyed = docs.select(COLUMNS).withColumn("row_key", simhash.row_key("doc_id", "text")).withColumn("spot", spot).select(*COLUMNS, "row_key", word, bit)
    told = keyed.join(F.broadcast(marks), "word", "left").withColumn("joined", F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)))
    joined = told.where("joined").join(keys.where("first").select("row_key"), "row_key").groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return told.where("not joined").select(COLUMNS).unionByName(joined)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets in their texts replaced; n_chars counts the new text's code points (null for a
    null text). Repeated rows are changed alike."""
    return pii.replace(docs.select(COLUMNS), surrogate_key()).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, 0 times included. The null source is a source; sources without words
    are left out, since their rate is 0; the draw depends on the id, so repeated rows are drawn alike."""
    return mixing.emit(docs.select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of each row. Null and empty texts have no tokens."""
    return bpe.encode_digests(docs.select(COLUMNS), tokenizer_path(), ["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_each_group),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: none: SQL can't express the classifier, the surrogates or the tokens
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again. A stage's input is removed once its
    output is written; the last output stays for the caller."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
