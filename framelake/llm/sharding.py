"""Sharding by a hierarchical weighted hash tree of regions, racks and shards, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import materialize, table

SHARDS_A_RACK, RACKS_A_REGION = 5, 4
#: Rows that number their slots together; the number of such groups grows with the input.
SLOT_GROUP = 5_000


def tree(n_shards: int) -> list[list[list[float]]]:
    """Weights [region][rack][shard]: racks of 5 and regions of 4 racks fill in order; each shard weighs 1."""
    racks = [[1.0] * min(SHARDS_A_RACK, n_shards - at) for at in range(0, n_shards, SHARDS_A_RACK)]
    return [racks[at: at + RACKS_A_REGION] for at in range(0, len(racks), RACKS_A_REGION)]


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """The arrival time of one child: exponential with the child's weight as rate; the earliest child wins, so that a
    larger weight only ever draws rows towards its own child."""
    digits = F.substring(F.md5(F.concat_ws("|", key, path).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(uniform) / weight


def _earliest(key: Column, prefix: Column | str, children: Column) -> Column:
    """Index of the child with the smallest draw among `children`, an array of weights; ties go to the smaller index.
    `prefix` is the path that the children's numbers are appended to."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    timed = F.transform(children, lambda w, i: F.struct(_draw(key, F.concat(prefix, i.cast("string")), w).alias("t"), i.alias("i")))
    return F.array_min(timed)["i"]


def _weights(values: list) -> Column:
    return F.array(*[_weights(v) if isinstance(v, list) else F.lit(float(v)) for v in values])


def with_place(rows: DataFrame, key: str, weights: list[list[list[float]]], name: str) -> DataFrame:
    """`rows` with the shard of `key` as column `name`: a draw among regions by their total weights, then among that
    region's racks, then among that rack's shards. A weight that grows moves rows into its region only, of those inside the region into
    its rack only, and of those inside the rack into its shard only; so a shard that opens a region takes rows into that only."""
    k = F.col(key)
    starts, at = [], 0
    for racks in weights:
        starts.append([at + sum(map(len, racks[:i])) for i in range(len(racks))])
        at += sum(map(len, racks))
    region, rack = F.col("~region"), F.col("~rack")
    rows = rows.withColumn("~region", _earliest(k, "r", _weights([sum(map(sum, racks)) for racks in weights])))
    rows = rows.withColumn("~rack", _earliest(
        k, F.concat(F.lit("r"), region.cast("string"), F.lit("/k")), _weights([[sum(s) for s in racks] for racks in weights])[region]))
    leaf = _earliest(k, F.concat(F.lit("r"), region.cast("string"), F.lit("/k"), rack.cast("string"), F.lit("/s")),
                     _weights(weights)[region][rack])
    return rows.withColumn(name, (_weights(starts)[region][rack].cast("int") + leaf).cast("int")).drop("~region", "~rack")


def shard_documents(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text",
                    weights: list[list[list[float]]] | None = None) -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard), one for each input row, under the `key` law: key
    and shard count alone decide; `grown_shard` is the place with one shard more.

    `weights` [region][rack][shard] may replace the tree of equal shards; `grown_shard` is then as without them.
    Where the further shard opens a rack in a region of its own (as 41 does after 40), rows move into it only; where it joins
    a region, rows also move inside that region, whose weights change. `size` is the text's UTF-8 bytes plus 16 (null
    text: 16, and crc32 of no bytes). `slot` is gapless from 0 within the shard: groups of a shard's rows, cut by a
    hash of (key, crc32, size), number their rows by these after the groups before them; so the rows of one hot id are many groups, unless
    they also share their text. Null keys share one place; repeated rows share a shard and get slots of their own; an empty table gives an empty result; other columns aren't
    read.
    """
    own, more = weights or tree(n_shards), tree(n_shards + 1)
    groups = max(1, math.ceil(docs.count() / (n_shards * SLOT_GROUP)))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), name.alias("~k"))
    mark = F.concat_ws("|", F.lit("slot"), "~k", F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    cut = F.conv(F.substring(F.md5(mark.cast("binary")), 1, 8), 16, 10).cast("long") % groups
    rows = materialize(with_place(with_place(rows.withColumn("cut", cut), "~k", own, "shard"), "~k", more, "grown_shard"))
    counted = rows.groupBy("shard", "cut").count()
    before = Window.partitionBy("shard").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "cut", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "cut").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("rn", F.row_number().over(within))
    return numbered.join(starts, ["shard", "cut"]).select(
        key, "size", "text_crc32", "law", "shard", (F.col("start") + F.col("rn") - 1).cast("long").alias("slot"),
        "grown_shard")


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def _oracle() -> str:
    """DuckDB SQL of the same draws, with the tree as a relation of paths and weights."""
    def relation(n: int) -> str:
        rows, first = [], 0
        for r, racks in enumerate(tree(n)):
            for k, shards in enumerate(racks):
                for s, w in enumerate(shards):
                    rows.append(f"('r{r}', {sum(map(sum, racks))}, 'r{r}/k{k}', {sum(shards)}, 'r{r}/k{k}/s{s}', {w}, {first})")
                    first += 1
        return ", ".join(rows)

    def draw(path: str, weight: str) -> str:
        return (f"-ln((('0x' || substr(md5(d.doc_id::VARCHAR || '|' || {path}), 1, 13))::BIGINT + 0.5)"
                f" / 4503599627370496.0) / {weight}")

    def placed(name: str, n: int) -> str:
        return f"""
{name}_tree(region, wr, rack, wk, leaf, ws, shard) AS (VALUES {relation(n)}),
{name}_region AS (SELECT d.doc_id, arg_min(t.region, {draw('t.region', 't.wr')}) AS region
  FROM documents d, (SELECT DISTINCT region, wr FROM {name}_tree) t GROUP BY d.doc_id),
{name}_rack AS (SELECT d.doc_id, arg_min(t.rack, {draw('t.rack', 't.wk')}) AS rack
  FROM {name}_region d JOIN (SELECT DISTINCT region, rack, wk FROM {name}_tree) t USING (region) GROUP BY d.doc_id),
{name} AS (SELECT d.doc_id, arg_min(t.shard, {draw('t.leaf', 't.ws')}) AS shard
  FROM {name}_rack d JOIN {name}_tree t USING (rack) GROUP BY d.doc_id)"""

    return f"""
WITH {placed('now', 40)}, {placed('grown', 41)},
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
   lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
bytes AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (SELECT doc_id, strlen(text) + 16 AS size, xor(list_reduce(list_prepend(4294967295,
   list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
   lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32 FROM bytes, crc_table),
cuts AS (SELECT doc_id, ('0x' || substr(md5('slot|' || doc_id || '|' || text_crc32 || '|' || size), 1, 8))::BIGINT
   % (SELECT greatest(1, ceil(count(*) / 200000.0)::BIGINT) FROM documents) AS cut FROM crcs)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, now.shard::INT AS shard,
  (row_number() OVER (PARTITION BY now.shard ORDER BY cut, doc_id) - 1)::BIGINT AS slot, grown.shard::INT AS grown_shard
FROM now JOIN grown USING (doc_id) JOIN crcs USING (doc_id) JOIN cuts USING (doc_id)
"""


ORACLE_SQL = _oracle()
