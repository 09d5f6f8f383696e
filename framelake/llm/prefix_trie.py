"""The trie of conversation prefixes: ROLLUP over positional turn columns, long conversations in blocks of columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import join_unique, materialize, table

#: Turns of a block, a column each; a longer conversation goes on in further blocks.
WIDTH = 8
#: Blocks that a digest covers; longer rows of blocks take digests of digests.
FAN = 16
#: Conversation ids that are joined to one piece of text at most.
PIECE = 65_536

TURNS = [f"t{i}" for i in range(WIDTH)]


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def turn_keys(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, id): `id` is a digest of role and text (null as empty), a colon, and the number of words of the text. Rows
    without a conversation id belong to no conversation."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32)
    rows = conversations.where(F.col(conv).isNotNull())
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.concat(digest, F.lit(":"), words.cast("string")).alias("id"))


def number_turns(keys: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, id, total): turns in order, null first and equal ones by `id`, from 1; `total` is their number.
    Rows are dealt out by ranges of (conversation, turn), so a very long conversation lies in many partitions; each
    numbers its own rows, after those of the partitions before."""
    n = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys.rdd.getNumPartitions())
    order = [F.col("turn").asc_nulls_first(), F.col("id")]
    placed = materialize(keys.repartitionByRange(n, "conv_id", *order).withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("conv_id")
    counts = placed.groupBy("conv_id", "part").count().select(
        "conv_id", "part", F.sum("count").over(whole).alias("total"),
        F.coalesce(F.sum("count").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return placed.join(counts, ["conv_id", "part"]).select("conv_id", (F.col("before") + rank).alias("pos"), "id", "total")


def share_heads(numbered: DataFrame) -> DataFrame:
    """Numbered turns of conversations rebuilt by the contract of the registered query: c takes the first h turns of
    conversation c - c % 20 for its own first h, with h = crc32(c) % 4. A rebuilt conversation without turns has one row with pos 0."""
    numbered = materialize(numbered)
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    # The first turn of each conversation stands for it; one with many turns lends only three.
    convs = numbered.where("pos = 1").select("conv_id", "total", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    lent = convs.select(F.col("conv_id").alias("base"), F.least("total", F.lit(3)).alias("there"))
    convs = convs.join(lent, "base", "left").withColumn("there", F.least("h", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("rebuilt", F.col("there") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
    heads = numbered.where("pos <= 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "pos", "id")
    heads = convs.join(heads, "base").where("pos <= there").select("conv_id", "pos", "id", F.col("rebuilt").alias("total"))
    none = convs.where("rebuilt = 0").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("id"), F.col("rebuilt").alias("total"))
    own = numbered.where(F.col("pos") > taken)
    own = join_unique(own, convs.select("conv_id", "h", "there", "rebuilt"), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("there")).alias("pos"), "id", F.col("rebuilt").alias("total"))
    return own.unionByName(heads).unionByName(none)


def _before(spans: DataFrame) -> DataFrame:
    """(conv_id, at, key): a digest of all spans (conv_id, at, id) of the conversation before `at`. FAN spans at a time take
    a digest, then FAN of those, so that no group holds more than FAN rows and the number of levels grows with the logarithm."""
    kids = F.sort_array(F.collect_list(F.struct("at", "id"))).alias("kids")
    groups = materialize(spans.groupBy("conv_id", F.floor(F.col("at") / FAN).alias("group")).agg(kids))
    if groups.where("group > 0").limit(1).count():
        above = _before(groups.select("conv_id", F.col("group").alias("at"), _digest(F.col("kids.id")).alias("id")))
        groups = groups.join(above.select("conv_id", F.col("at").alias("group"), F.col("key").alias("top")), ["conv_id", "group"])
    else:
        groups = groups.withColumn("top", F.lit(""))
    each = groups.select("conv_id", "top", "kids", F.posexplode("kids").alias("i", "kid"))
    return each.select("conv_id", F.col("kid.at").alias("at"), _digest(F.col("top"), F.slice("kids.id", F.lit(1), F.col("i"))).alias("key"))


def _blocks(steps: DataFrame) -> DataFrame:
    """One row a conversation and WIDTH turns: (conv_id, total, b, t0 .. t7, key, after). `key` names the node that the block before ends
    in (empty for the first), `after` the one that this block ends in where a further block follows."""
    at = F.greatest(F.col("pos") - 1, F.lit(0))
    columns = [F.max(F.when((at % WIDTH == i) & (F.col("pos") > 0), F.col("id"))).alias(t) for i, t in enumerate(TURNS)]
    blocks = materialize(steps.groupBy("conv_id", F.floor(at / WIDTH).alias("b")).agg(F.max("total").alias("total"), *columns))
    long = blocks.where(F.col("total") > WIDTH).select("conv_id", F.col("b").alias("at"), _digest(*map(F.col, TURNS)).alias("id"))
    keys = materialize(_before(long).select("conv_id", F.col("at").alias("b"), F.when(F.col("at") > 0, F.col("key")).otherwise("").alias("key")))
    after = keys.where("b > 0").select("conv_id", (F.col("b") - 1).alias("b"), F.col("key").alias("after"))
    keyed = blocks.where(F.col("total") > WIDTH).join(keys, ["conv_id", "b"]).join(after, ["conv_id", "b"], "left")
    short = blocks.where(F.col("total") <= WIDTH).withColumns({"key": F.lit(""), "after": F.lit(None).cast("string")})
    return materialize(short.unionByName(keyed))


def _rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """`aggregates` over every prefix of the turn columns within a block, with `d`, the number of turns kept, from grouping_id. Prefixes
    that go beyond the end of a row's turns are no nodes; the node at a block's start belongs to the block before."""
    turns = ", ".join(TURNS)
    found = rows.sparkSession.sql(
        f"SELECT b, key, {turns}, {WIDTH} - bit_count(grouping_id()) AS d, {aggregates} FROM {{rows}} GROUP BY b, key, ROLLUP({turns})", rows=rows)
    return found.where(F.expr(f"CASE WHEN d = 0 THEN b = 0 ELSE get(array({turns}), d - 1) IS NOT NULL END"))


def _below(nodes: DataFrame) -> DataFrame:
    """(after, leaves_below, saved_below): the sums over all blocks that hang from the node named `after`, the blocks under those
    too. Each round adds the sums of blocks twice as far below, so their number is the logarithm of the longest row of blocks."""
    own = nodes.where("b > 0").groupBy("key").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    above = nodes.where("after IS NOT NULL").select(F.col("after").alias("key"), F.expr("nullif(key, '')").alias("far"))
    sums = materialize(own.join(above, "key"))
    while sums.where("far IS NOT NULL").limit(1).count():
        gained = sums.where("far IS NOT NULL").groupBy(F.col("far").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        farther = join_unique(sums, sums.select(F.col("key").alias("far"), F.col("far").alias("farther")), "far")
        sums = materialize(farther.join(gained, "key", "left").select(
            "key", F.col("farther").alias("far"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    return sums.select(F.col("key").alias("after"), F.col("leaves").alias("leaves_below"), F.col("saved").alias("saved_below"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (node, ends_sha256) for the sorted rows (node, ids) of each node; only the hash so far is held."""
    node, state = None, None
    for batch in batches:
        nodes, shas = [], []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != node:
                if state is not None:
                    nodes.append(node)
                    shas.append(state.hexdigest())
                node, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(shas, pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def _ends(blocks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of each node that conversations end in. Ids are first joined to pieces by ranges of ids, so that a hot
    node's hash, which can only be taken in order, reads few rows."""
    last = blocks.where(F.col("b") == F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / WIDTH))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    pieces = last.select(_digest(F.col("key"), *map(F.col, TURNS)).alias("node"), "conv_id").groupBy(
        "node", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(ids)
    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(_hashes, "node string, ends_sha256 string")


def prefix_trie(steps: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, from `steps` (conv_id, pos, id, total) as `number_turns` makes them: (conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256). A node is a distinct sequence of first turns, named by its smallest
    conversation and its depth; the root has depth 0 and all conversations as members, those with a single step at pos 0 too. Without
    any conversation there is no node.

    A first ROLLUP over the turn columns of all blocks counts the members of all prefixes together, a second one adds leaves and saved
    tokens over subtrees. Two groupings of the same turns are told apart by 128-bit digests. Repeated ids don't occur, as a conversation is
    all rows of its id.
    """
    blocks = _blocks(steps)
    nodes = _rollup(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs, max(after) AS after")
    path = lambda n: F.concat_ws("|", F.slice(F.array("key", *TURNS), F.lit(1), n))
    named = F.substring(F.sha2(path(F.col("d") + 1), 256), 1, 32)
    up = F.when(F.col("d") > 1, F.substring(F.sha2(path(F.greatest(F.col("d"), F.lit(1))), 256), 1, 32)).when(
        (F.col("d") == 1) & (F.col("b") == 0), _digest(F.lit(""))).when(F.col("d") == 1, F.col("key"))
    words = F.when(F.col("d") == 0, 0).otherwise(F.split_part(F.get(F.array(*TURNS), F.greatest(F.col("d") - 1, F.lit(0))), F.lit(":"), F.lit(2)).cast("long"))
    after = F.when(F.col("d") == WIDTH, F.col("after"))
    nodes = materialize(nodes.select(
        "b", "key", *TURNS, "d", "conv_id", "n_convs", after.alias("after"), named.alias("node"), F.coalesce(after, named).alias("at"), up.alias("up"),
        ((F.col("n_convs") - 1) * words).alias("saved")))
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("at")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("at").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    nodes = join_unique(nodes, parents, "up").join(children, "at", "left").fillna(0, "n_children")
    nodes = materialize(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")))
    nodes = nodes.join(_below(nodes), "after", "left").fillna(0, ["leaves_below", "saved_below"])
    whole = _rollup(nodes, "min(struct(d, conv_id, parent_conv_id, n_convs, n_children, node)) AS top, sum(leaf + leaves_below) AS n_leaves,"
                           " sum(saved + saved_below) AS saved_tokens")
    whole = whole.select("top.*", (F.col("b") * WIDTH + F.col("d")).alias("depth"), "n_leaves", "saved_tokens")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.join(_ends(blocks), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(share_heads(number_turns(turn_keys(table(spark, sf_dir, "conversations")))))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
   lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295,
   list_transform(range(strlen(conv_id::VARCHAR)), lambda i: ('0x' || substr(hex(encode(conv_id::VARCHAR)), 2 * i + 1, 2))::BIGINT)),
   lambda c, b: xor(c // 256, crc_table.t[xor(c, b) % 256 + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc_table),
turns AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
rebuilt AS (SELECT c.conv_id, coalesce(list(sha256(strlen(role) || ':' || role || text) || ':' || len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
  ORDER BY own, pos) FILTER (role IS NOT NULL), []) AS path FROM c LEFT JOIN turns USING (conv_id) GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, len(path) AS n, d AS depth, array_to_string(path[1:d], '|') AS node,
  CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], '|') END AS up, CASE WHEN d > 0 THEN split_part(path[d], ':', 2)::BIGINT ELSE 0 END AS words
  FROM rebuilt, LATERAL unnest(range(len(path) + 1)) AS u(d)),
nodes AS (SELECT depth, node, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256 FROM prefixes GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, node)
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.up),
sums AS (SELECT a.depth, a.node, sum((f.n_children = 0)::INT) AS n_leaves, sum(f.saved) AS saved_tokens FROM full_nodes f
  JOIN prefixes a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_nodes JOIN sums USING (depth, node)
"""
