"""Operator 8, sharding by a permutation-filled lookup table.

Method: every shard has a preference order of the slots of a prime-sized table, a permutation given by an
offset and a stride from a hash of its name. Shards take turns claiming the next free slot of their order
until the table is full, so that shares differ by one slot at most and a changed shard list moves few slots.
The table (TABLE_SIZE entries, a parameter) is broadcast; a row's slot is a hash of its key, its shard is one
look-up. No shuffle: placement is the same wherever a row is read, and a hot key is one shard's by intent of
nobody, since keys are document ids.

Defined results: a null key hashes as the empty string; repeated rows go to one shard; an empty table gives an
empty result; other columns stay as they are, but for any named _slot or _shard, which are replaced; null texts
weigh 0 bytes.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import table

#: Prime, and over 100 slots a shard for SHARDS, so that shares are even within 1 %.
TABLE_SIZE = 16381
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and stride of a shard's permutation of the slots."""
    h = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:], "big") % (size - 1) + 1


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The shard number of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if size < len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime, and no less than the number of shards")
    orders = [preference(s, size) for s in shards]
    tried, slots, free = [0] * len(shards), [-1] * size, size
    while True:
        for k, (offset, stride) in enumerate(orders):
            while slots[at := (offset + tried[k] * stride) % size] >= 0:
                tried[k] += 1
            slots[at] = k
            free -= 1
            if not free:
                return slots


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size).cast("int")


def placed(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with _slot and _shard, which take the place of columns of these names."""
    spark = df.sparkSession
    rows = [(i, shards[k]) for i, k in enumerate(lookup_table(shards, size))]
    own = uuid.uuid4().hex  # no column of df has these names
    slots = F.broadcast(spark.createDataFrame(rows, f"at_{own} int, shard_{own} string"))
    out = df.withColumn(f"at_{own}", slot(F.col(f"`{key}`"), size)).join(slots, f"at_{own}", "left")
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("_slot", "_shard")]
    return out.select(*others, F.col(f"at_{own}").alias("_slot"), F.col(f"shard_{own}").alias("_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return placed(docs).select("doc_id", "n_bytes", F.col("_slot").cast("long").alias("slot"), F.col("_shard").alias("shard"))


def oracle() -> str:
    """The look-up table as text, two hexadecimal digits a slot."""
    digits = "".join(f"{k:02x}" for k in lookup_table())
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, n_bytes, slot,
       'shard-' || lpad((('0x' || substr('{digits}', (2 * slot + 1)::BIGINT, 2))::BIGINT)::VARCHAR, 3, '0') AS shard
FROM d
"""


ORACLE_SQL = oracle()
