"""Token counts from a digest cache.

A text's normal form has white space runs as one blank and none at the ends, which changes no token of a tokenizer that drops white
space. Its digest and the digest of the tokenizer file are the cache's key. Counts found in the cache are joined; of the
misses one text per digest is encoded, and the new counts are appended to the cache, which is a Parquet table.

Texts move once: the misses are chosen on narrow rows, and their texts are fetched by ``doc_id``. In a task, words
repeat, so the tokenizer sees each distinct white-space-separated stretch once until a bounded memory is full. No token spans white space
in such a tokenizer (checked when it is loaded), and special strings hold none, so counts add up.

Defined cases: a null text counts as empty; an empty one has no bytes and no tokens; rows that share a ``doc_id`` or lack one are
told apart by digest; repeated rows get equal results; a missing cache is an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from intake_spark.session import publish

REMEMBERED, LONGEST, GROUP = 400_000, 64, 64
LIMIT = 2048
CACHE = "tokenizer string, digest string, n_tokens long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = json.dumps(spec["pre_tokenizer"])
    spaced = r"[^\\\\s\\\\p{L}\\\\p{N}]+" in json.dumps(cut) or r"[^\\s\\p{L}\\p{N}]+" in cut
    if not spaced or '"Removed"' not in cut or any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: tokens may span white space")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer, {}


def count_tokens(texts: list[str], path: str) -> list[int]:
    tokenizer, known = _tokenizer(path)
    out = []
    for k in range(0, len(texts), GROUP):
        pieces = [t.replace("\n", " ").split(" ") for t in texts[k:k + GROUP]]
        fresh = [p for p in {p for ps in pieces for p in ps} if p not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list({p for ps in pieces for p in ps})
        known.update(zip(fresh, (len(e) for e in tokenizer.encode_batch_fast(fresh, add_special_tokens=False))))
        out += [sum(map(known.__getitem__, ps)) for ps in pieces]
        for p in fresh:
            if len(p) > LONGEST:
                del known[p]
    return out


def version(path: str) -> str:
    """The digest of the tokenizer file, which names its version in the cache."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normal_form(text):
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(" "))


def read_cache(spark, folder: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def counts(docs: DataFrame, path: str, cache: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: bytes, tokens, whether over ``limit``; fills the cache in folder ``cache``.

    A run that fails appends nothing or whole files; a count appended twice is read once.
    """
    spark = docs.sparkSession
    tokenizer = version(path)
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"))
    keyed = publish(own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(normal_form(F.col("text")), 256).alias("digest")), "token-digests")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # narrow: one row per missing digest, with the document that lends its text
    miss = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti")
    lent = own.join(miss.withColumnRenamed("doc_id", "lender").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("lender")))
    lent = lent.where(F.sha2(normal_form(F.col("text")), 256) == F.col("digest")).select("digest", "text")

    def run(batches):
        for batch in batches:
            n = count_tokens(batch.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    fresh = lent.mapInArrow(run, "digest string, n_tokens long").dropDuplicates(["digest"]).select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens")
    fresh.write.mode("append").parquet(cache)
    # written out, so that a digest shared by very many documents can be split in the join
    known = publish(read_cache(spark, cache).where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
