"""Frames in order: references, clips, sampling, splits and placement of sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.shared import ensure_checkpoints


def in_sequence(order: str = "frame_no", seq: str = "seq_id"):
    return Window.partitionBy(seq).orderBy(order)


def frame_refs(frames: DataFrame, order: str = "frame_no") -> DataFrame:
    """(pos, seq_id, frame_no, is_first, prev_pos, global_pos): the previous and the first frame of each frame."""
    w = in_sequence(order)
    return frames.select("pos", "seq_id", (F.row_number().over(w) - 1).alias("frame_no"), (F.row_number().over(w) == 1).alias("is_first"),
                         F.lag("pos").over(w).alias("prev_pos"), F.first("pos").over(w).alias("global_pos"))


def run_boundary(rows: DataFrame, pos: str = "pos", group: str = "dir", block: int = 65_536) -> DataFrame:
    """(pos, dir, is_first): whether the row before in list order has another directory. Blocks of consecutive positions carry
    their last row over to the next block, so no window holds the whole list."""
    cut = rows.select(F.col(pos).alias("pos"), F.col(group).alias("dir"), F.floor(F.col(pos) / block).alias("block"))
    ends = cut.groupBy("block").agg(F.max_by("dir", "pos").alias("carried"), F.max("pos").alias("last"))
    carry = ends.withColumn("carried", F.lag("carried").over(Window.orderBy("block")))  # one row a block
    ends = ends.select("block").join(carry.select("block", "carried"), "block")
    before = F.coalesce(F.lag("dir").over(Window.partitionBy("block").orderBy("pos")), F.col("carried"))
    return cut.join(ends, "block").select("pos", "dir", F.coalesce(before != F.col("dir"), F.lit(True)).alias("is_first"))


def argmax_frame(frames: DataFrame, value: str = "line_count") -> DataFrame:
    """Each sequence's frame of the largest value, the earliest on ties, with its previous frame."""
    before = frames.withColumn("prev_pos", F.lag("pos").over(in_sequence()))
    best = before.groupBy("seq_id").agg(F.max_by(F.struct("pos", "frame_no", value, "prev_pos"), F.struct(F.col(value), -F.col("frame_no"))).alias("b"))
    return best.select("seq_id", "b.pos", "b.frame_no", f"b.{value}", "b.prev_pos")


def sliding_clips(frames: DataFrame, length: int = 16, stride: int = 8) -> DataFrame:
    """(seq_id, clip, start): every full clip of a sequence."""
    n = frames.groupBy("seq_id").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= length)
    return n.select("seq_id", F.posexplode(F.sequence(F.lit(0), F.col("n") - length, F.lit(stride))).alias("clip", "start"))


def chunks(frames: DataFrame, size: int = 16) -> DataFrame:
    """(seq_id, chunk, n, style_pos): consecutive chunks with their first frame; a last chunk of one frame is dropped."""
    cut = frames.withColumn("chunk", F.floor((F.row_number().over(in_sequence()) - 1) / size))
    return cut.groupBy("seq_id", "chunk").agg(F.count("*").alias("n"), F.min_by("pos", "frame_no").alias("style_pos")).where("n > 1")


def consecutive_pairs(frames: DataFrame) -> DataFrame:
    nxt = frames.select("seq_id", F.col("pos").alias("cur_pos"), F.lead("pos").over(in_sequence()).alias("next_pos"))
    return nxt.where("next_pos IS NOT NULL")


def neighbors(frames: DataFrame) -> DataFrame:
    """(pos, left_pos, right_pos, status): the frames on both sides; `edge` at a sequence's ends."""
    w = in_sequence()
    both = frames.select("pos", F.lag("pos").over(w).alias("left_pos"), F.lead("pos").over(w).alias("right_pos"))
    return both.withColumn("status", F.when(F.col("left_pos").isNull() | F.col("right_pos").isNull(), "edge").otherwise("ok"))


def stride_sample(frames: DataFrame, k: int) -> DataFrame:
    n = F.row_number().over(in_sequence()) - 1
    return frames.withColumn("~n", n).where(F.col("~n") % k == 0).drop("~n")


def pick_position(frames: DataFrame, where: str = "middle", index: int = 0) -> DataFrame:
    """The first, middle, last or index-th frame of each sequence, with its previous and first frame."""
    w, all_ = in_sequence(), Window.partitionBy("seq_id")
    rows = frames.select("seq_id", "pos", (F.row_number().over(w) - 1).alias("at"), F.count("*").over(all_).alias("n"),
                         F.lag("pos").over(w).alias("prev_pos"), F.first("pos").over(w).alias("global_pos"))
    want = {"first": F.lit(0), "middle": F.floor(F.col("n") / 2), "last": F.col("n") - 1, "index": F.lit(index)}[where]
    return rows.where(F.col("at") == want).select("seq_id", "pos", "prev_pos", "global_pos")


def even_sample(frames: DataFrame, n: int) -> DataFrame:
    """The frames at n evenly spaced positions of each sequence, truncated; all of it if it has no more."""
    size = F.count("*").over(Window.partitionBy("seq_id"))
    rows = frames.withColumn("~at", F.row_number().over(in_sequence()) - 1).withColumn("~n", size)
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("~n") - 1) / max(1, n - 1)))
    return rows.where((F.col("~n") <= n) | F.array_contains(spots, F.col("~at").cast("long"))).drop("~at", "~n")


def seeded(key: Column, seed: int) -> Column:
    """A rank key that other engines can compute too."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def periodic_or_random(frames: DataFrame, step: int, k: int, seed: int) -> DataFrame:
    """Every step-th position and k more at random."""
    drawn = frames.select("pos").orderBy(seeded(F.col("pos"), seed)).limit(k)
    return frames.where(F.col("pos") % step == 0).select("pos").union(drawn).distinct()


def draw_sequences(frames: DataFrame, k: int, seed: int) -> DataFrame:
    return frames.select("seq_id").distinct().orderBy(seeded(F.col("seq_id"), seed), "seq_id").limit(k)


def sample_sequences(frames: DataFrame, ratio: float, seed: int) -> DataFrame:
    """All frames of max(1, floor(n * ratio)) sequences."""
    k = max(1, int(frames.select("seq_id").distinct().count() * ratio))
    return frames.join(draw_sequences(frames, k, seed), "seq_id", "left_semi")


def fixed_validation(frames: DataFrame, k: int, seed: int) -> DataFrame:
    """k sequences with their first, target (most lines) and the target's previous frame."""
    chosen = frames.join(draw_sequences(frames, k, seed), "seq_id", "left_semi")
    first = chosen.groupBy("seq_id").agg(F.min_by("pos", "frame_no").alias("global_pos"))
    return argmax_frame(chosen).join(first, "seq_id").select("seq_id", "global_pos", F.col("pos").alias("target_pos"), "prev_pos")


def train_val_split(frames: DataFrame, ratio: float, seed: int) -> DataFrame:
    """(seq_id, split): floor(n * ratio) groups train, the others validate."""
    groups = frames.select("seq_id").distinct()
    train = draw_sequences(frames, int(groups.count() * ratio), seed).withColumn("split", F.lit("train"))
    return groups.join(train, "seq_id", "left").select("seq_id", F.coalesce("split", F.lit("val")).alias("split"))


def shard(rows: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Contiguous shards of ceil(L / n) over gapless positions from 0."""
    size = -(-rows.count() // n)
    return rows.withColumn("shard", F.floor(F.col(pos) / max(1, size)))


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """`rows` with `n`, their position from 0 in the order of the columns, which should tell all rows apart. Ranges of rows are sorted
    and numbered where they lie; only one count a range meets in one task."""
    ensure_checkpoints(rows.sparkSession)
    keyed = rows.withColumns({f"~o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    keys = [f"~o{i}" for i in range(len(order))]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("~id", F.monotonically_increasing_id()).drop(*keys)
    placed = placed.withColumns({"~part": F.shiftright("~id", 33), "~at": F.col("~id").bitwiseAND(2**33 - 1)}).drop("~id").checkpoint()
    before = Window.orderBy("~part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = placed.groupBy("~part").count().select("~part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("~start"))
    return placed.join(starts, "~part").withColumn("n", F.col("~start") + F.col("~at")).drop("~part", "~at", "~start")


def balanced_ranks(frames: DataFrame, world: int) -> DataFrame:
    """(rank, slot, seq_id): sorted sequences round-robin to ranks; each rank repeats from its start up to the longest one's length."""
    ids = numbered(frames.select("seq_id").distinct(), "seq_id")
    total = ids.count()
    longest = -(-total // world)
    own = ids.select((F.col("n") % world).cast("int").alias("rank"), F.floor(F.col("n") / world).alias("slot"), "seq_id")
    # ranks from the remainder on are one short and repeat their first sequence
    short = own.where((F.col("slot") == 0) & (F.col("rank") >= total % world)) if total > world and total % world else own.limit(0)
    return own.union(short.select("rank", F.lit(longest - 1).cast("long").alias("slot"), "seq_id"))


def replica_split(rows: DataFrame, world: int, epoch: int, key: str = "seq_id") -> DataFrame:
    """(rank, seq_id): a permutation by epoch, padded from its start to a multiple of the ranks, in contiguous blocks."""
    order = numbered(rows.select(key).distinct(), seeded(F.col(key), epoch), key)
    total = order.count()
    size = -(-total // world)
    padded = order.union(order.where(F.col("n") < size * world - total).withColumn("n", F.col("n") + total))
    return padded.select(F.floor(F.col("n") / max(1, size)).alias("rank"), key)


def weighted_sample(rows: DataFrame, k: int, seed: int, key: str, weight: str) -> DataFrame:
    """k rows without replacement, by weight: the largest log(u) / w."""
    return rows.where(F.col(weight) > 0).withColumn("~k", F.log(uniform(F.col(key), seed)) / F.col(weight)).orderBy(F.col("~k").desc(), key).limit(k).drop("~k")


def uniform(key: Column, seed: int | str) -> Column:
    """A number between 0 and 1 by a hash that other engines can compute too."""
    return (F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("double") + 1) / float(2**32 + 1)


def weighted_draws(rows: DataFrame, k: int, seed: int, key: str, weight: str) -> DataFrame:
    """(draw, key): k draws with replacement, by weight. Every weight gets its stretch of the line of all weights, in order of the key, and
    a draw takes the stretch that it falls into; draws and stretches meet by cells of the line, as many as there are draws."""
    ranged = numbered(rows.where(F.col(weight) > 0).select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w")), "key")
    block = F.floor(F.col("n") / 4096)
    sums = ranged.groupBy(block.alias("block")).agg(F.sum("w").alias("bw"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = sums.select("block", F.coalesce(F.sum("bw").over(before), F.lit(0.0)).alias("base"))
    total = sums.agg(F.sum("bw")).first()[0] or 0.0
    upto = Window.partitionBy("block").orderBy("n")
    line = ranged.withColumn("block", block).join(starts, "block").select("key", (F.col("base") + F.sum("w").over(upto) - F.col("w")).alias("lo"), (F.col("base") + F.sum("w").over(upto)).alias("hi"))
    cell = lambda x: F.floor(x * (k / total if total else 0.0))
    spread = line.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    draws = rows.sparkSession.range(k if total else 0).select(F.col("id").alias("draw"), (uniform(F.col("id"), seed) * total).alias("x")).withColumn("cell", cell(F.col("x")))
    return draws.join(spread, "cell").where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("draw", F.col("key").alias(key))


def permuted(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, n): a random permutation of the rows of distinct keys, or of a subset of them that `rows` is."""
    return numbered(rows.select(key), seeded(F.col(key), seed), key)


def batches(order: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """Rows with a position `n` in batches of `size`; a last batch that isn't full may be dropped."""
    out = order.withColumn("batch", F.floor(F.col("n") / size))
    return out.where(F.col("batch") < order.count() // size) if drop_last else out


def random_split(rows: DataFrame, lengths: list[int], key: str, seed: int) -> DataFrame:
    """(key, part): a random split into parts of exactly these lengths, which must add up to the number of rows."""
    total = rows.count()
    if sum(lengths) != total:
        raise ValueError(f"lengths add up to {sum(lengths)}, not to {total} rows")
    ends = [sum(lengths[: i + 1]) for i in range(len(lengths))]
    part = F.lit(len(lengths) - 1)
    for i in range(len(lengths) - 2, -1, -1):
        part = F.when(F.col("n") < ends[i], i).otherwise(part)
    return permuted(rows, key, seed).select(key, part.alias("part"))


def limit_items(rows: DataFrame, k: int, order: str = "pos") -> DataFrame:
    """The first k rows in list order, as a feature of its own."""
    return rows.orderBy(order).limit(k)


def size_schedule(batches: DataFrame, steps: int = 16, high: int = 512, low: int = 256) -> DataFrame:
    """(batch, size): sizes fall from high to low and rise again, in multiples of 8."""
    fall = F.col("batch") % (2 * steps)
    share = F.when(fall < steps, fall).otherwise(2 * steps - fall) / float(steps)
    return batches.withColumn("size", (F.floor((high - (high - low) * share) / 8) * 8).cast("int"))


def concat_index(rows: DataFrame, dataset: str = "dataset", order: str = "pos") -> DataFrame:
    """(global_index, dataset, local_index): positions in the concatenation of the datasets, in order of their names."""
    placed = numbered(rows.select(dataset, order), dataset, order)
    starts = placed.groupBy(dataset).agg(F.min("n").alias("start"))
    return placed.join(starts, dataset).select(F.col("n").alias("global_index"), dataset, (F.col("n") - F.col("start")).alias("local_index"))


def combine_datasets(tables: list[tuple[str, float | None, DataFrame]], seed: int = 0) -> DataFrame:
    """Enabled datasets under each other, a missing column null; a ratio under 1 takes that share of a dataset's sequences."""
    taken = [(df if ratio is None or ratio >= 1 else sample_sequences(df, ratio, seed)).withColumn("dataset", F.lit(name)) for name, ratio, df in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), taken)
