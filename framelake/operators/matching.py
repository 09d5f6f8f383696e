"""Joins that put manifests, masks, records and candidates together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zip_manifests(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two lists by position; lists of different lengths are an error."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"lists of different lengths: {a} and {b}")
    return left.join(right, "pos")


def _sides(pred: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of equal relative stems, and the rest of both sides."""
    p, g = (d.select(F.col("path").alias(n), F.col("rel").alias(f"rel_{n}"), F.col("stem").alias(f"stem_{n}")) for d, n in ((pred, "pred"), (gt, "gt")))
    first = p.join(g, F.col("rel_pred") == F.col("rel_gt")).select("pred", "gt", F.lit(1).alias("stage"))
    return first, p.join(first, "pred", "left_anti"), g.join(first, "gt", "left_anti")


def match_pairs(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(pred, gt, stage): first equal relative stems, then among the rest equal stems that are unique on both sides. Inputs: (path, rel, stem)."""
    first, p, g = _sides(pred, gt)
    lone_p, lone_g = (d.groupBy(f"stem_{n}").agg(F.min(n).alias(n), F.count("*").alias("m")).where("m = 1").drop("m") for d, n in ((p, "pred"), (g, "gt")))
    second = lone_p.join(lone_g, F.col("stem_pred") == F.col("stem_gt")).select("pred", "gt", F.lit(2).alias("stage"))
    return first.unionByName(second)


def match_ambiguous(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(stem, n_pred, n_gt): the stems that match_pairs skips, as both sides have them after the first stage and one of them more than once."""
    _, p, g = _sides(pred, gt)
    many = [d.groupBy(F.col(f"stem_{n}").alias("stem")).agg(F.count("*").alias(f"n_{n}")) for d, n in ((p, "pred"), (g, "gt"))]
    return many[0].join(many[1], "stem").where("n_pred > 1 OR n_gt > 1").select("stem", "n_pred", "n_gt")


def match_unmatched(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(side, path) of what match_pairs leaves."""
    pairs = match_pairs(pred, gt)
    a = pred.join(pairs.select(F.col("pred").alias("path")), "path", "left_anti").select(F.lit("pred").alias("side"), "path")
    return a.union(gt.join(pairs.select(F.col("gt").alias("path")), "path", "left_anti").select(F.lit("gt").alias("side"), "path"))


def align_by_order(a: DataFrame, b: DataFrame, group: str, order: str) -> DataFrame:
    """Pair the rows of a group by rank in both tables, up to the shorter side."""
    w = Window.partitionBy(group).orderBy(order)
    left = a.select(group, F.col("item").alias("left_item"), F.row_number().over(w).alias("rank"))
    right = b.select(group, F.col("item").alias("right_item"), F.row_number().over(w).alias("rank"))
    return left.join(right, [group, "rank"])


def masks_cyclic(frames: DataFrame, masks: DataFrame, n_masks: int) -> DataFrame:
    """The mask pos modulo n of each frame. masks: (mask_no, mask)."""
    return frames.join(masks, F.expr(f"pmod(pos, {n_masks})") == F.col("mask_no")).select("pos", "seq_id", "mask")


def masks_tiered(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """(seq_id, frame_no, pos, mask, tier) of every frame: its sequence's masks by order. Tier 1 are masks of the sequence's own
    directory, tier 2 those with its name in the path, tier 3 the general ones; a sequence takes the first tier that has any. The n-th
    frame takes the tier's n-th mask: surplus masks are dropped, frames beyond the last mask get null.
    masks: (mask, key, dir_seq, part_seq), null where a tier doesn't hold, in order of `key`."""
    own = masks.where("dir_seq IS NOT NULL").select(F.col("dir_seq").alias("seq_id"), "mask", "key", F.lit(1).alias("tier"))
    part = masks.where("part_seq IS NOT NULL").select(F.col("part_seq").alias("seq_id"), "mask", "key", F.lit(2).alias("tier"))
    named = own.union(part)
    best = named.groupBy("seq_id").agg(F.min("tier").alias("tier"))
    order = Window.partitionBy("seq_id").orderBy("key")
    listed = named.join(best, ["seq_id", "tier"]).select("seq_id", "mask", F.row_number().over(order).alias("rank"))
    longest = frames.groupBy("seq_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    # general masks beyond the longest sequence belong to no frame, so no more are ever numbered
    general = masks.where("dir_seq IS NULL AND part_seq IS NULL").orderBy("key").limit(longest)
    general = general.select(F.col("mask").alias("general"), F.row_number().over(Window.orderBy("key")).alias("rank"))
    rows = frames.select("seq_id", "frame_no", "pos", F.row_number().over(Window.partitionBy("seq_id").orderBy("frame_no")).alias("rank")).join(best, "seq_id", "left")
    met = rows.join(listed, ["seq_id", "rank"], "left").join(general, "rank", "left")
    tier = F.coalesce("tier", F.lit(3))
    return met.select("seq_id", "frame_no", "pos", F.when(tier < 3, F.col("mask")).otherwise(F.col("general")).alias("mask"), tier.alias("tier"))


def seeded_number(col: Column, seed: int | str, below: int | Column) -> Column:
    """A number from 0 to below - 1 by a hash that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat(col.cast("string"), F.lit(f"|{seed}")).cast("binary")), 1, 6), 16, 10).cast("long") % below


def masks_mixed(frames: DataFrame, seed: int = 0) -> DataFrame:
    """(pos, source): 40 % list a, 40 % list b, 20 % both, by a hash of the position."""
    h = seeded_number(F.col("pos"), seed, 10)
    return frames.select("pos", F.when(h < 4, "a").when(h < 8, "b").otherwise("both").alias("source"))


def assign_masks_mixed(frames: DataFrame, a: DataFrame, b: DataFrame, seed: int = 0) -> DataFrame:
    """(pos, source, mask_a, mask_b): the mask of list a, of list b or one of each (see masks_mixed), each drawn by a hash of the
    position; null where the list takes no part. a, b: (mask_no from 0 without gaps, mask)."""
    rows = masks_mixed(frames, seed)
    for name, masks in (("a", a), ("b", b)):
        n = max(1, masks.count())
        drawn = F.when(F.col("source").isin(name, "both"), seeded_number(F.col("pos"), f"{name}|{seed}", n))
        rows = rows.withColumn("mask_no", drawn).join(masks.select(F.col("mask_no").cast("long").alias("mask_no"), F.col("mask").alias(f"mask_{name}")), "mask_no", "left").drop("mask_no")
    return rows.select("pos", "source", "mask_a", "mask_b")


def mixed_mask_pixels(assigned: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(pos, row, col): the pixels of each frame's assigned masks, of two their union. a, b: (mask, row, col)."""
    one, two = (assigned.select("pos", F.col(f"mask_{n}").alias("mask")).join(px, "mask").select("pos", "row", "col") for n, px in (("a", a), ("b", b)))
    return one.union(two).distinct()


def attach_segments(frames: DataFrame, records: DataFrame, mode: str = "by_sequence") -> DataFrame:
    """Frames with their record: by (seq_id, stem), or the first record of the stem (`first_by_stem`)."""
    if mode == "first_by_stem":
        first = records.groupBy("stem").agg(F.min_by("record", "rec_pos").alias("record"))
        return frames.join(first, "stem", "left").select("pos", "record")
    return frames.join(records, ["seq_id", "stem"], "left").select("pos", "record")


def blacklisted(seqs: DataFrame, listed: DataFrame, invert: bool = False) -> DataFrame:
    """Sequences that no list entry names by path or by last component (`invert`: those that one does)."""
    names = listed.select(F.substring_index("path", "/", -1).alias("name"))
    hit = seqs.join(listed.select(F.col("path").alias("seq_path")), "seq_path", "left_semi").select("seq_id").union(
        seqs.join(names, seqs["seq_id"].cast("string") == names["name"], "left_semi").select("seq_id")).distinct()
    return seqs.join(hit, "seq_id", "left_semi" if invert else "left_anti")


def resume(items: DataFrame, done: DataFrame, key: str = "out_path") -> DataFrame:
    return items.join(done, key, "left_anti")


def select_alignment(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(pos, source, score): the homography or flow candidate of the higher score, homography on ties, none at or under the threshold.
    Inputs: (pos, score)."""
    met = a.select("pos", F.col("score").alias("sa")).join(b.select("pos", F.col("score").alias("sb")), "pos", "full_outer")
    sa, sb = F.coalesce("sa", F.lit(-1.0)), F.coalesce("sb", F.lit(-1.0))
    top = F.greatest(sa, sb)
    return met.select("pos", F.when(top <= threshold, "none").when(sa >= sb, "homography").otherwise("flow").alias("source"), F.when(top > threshold, top).otherwise(0.0).alias("score"))


def assemble_refs(frames: DataFrame, payload: str = "payload", local: str = "last") -> DataFrame:
    """Each frame with the payload of its sequence's first and previous frame; `local`: none, last or gt. On fallback 0 and local_used 0."""
    w = Window.partitionBy("seq_id").orderBy("frame_no")
    near = {"none": F.lit(None), "last": F.lag(payload).over(w), "gt": F.col(payload)}[local]
    rows = frames.select("seq_id", "frame_no", F.col(payload).alias("current"), F.first(payload).over(w).alias("global_ref"), near.alias("local"))
    return rows.select("seq_id", "frame_no", "current", "global_ref", F.coalesce("local", F.lit(0)).alias("local_ref"), F.col("local").isNotNull().cast("int").alias("local_used"))


def aligned_refs(frames: DataFrame, alignments: DataFrame, payload: str = "payload", mask: str = "mask") -> DataFrame:
    """(seq_id, frame_no, current, global_ref, local_ref, local_mask, npz_ok, warp_valid, conf, local_used): as assemble_refs, but the previous
    frame counts only where the frame's alignment record (seq_id, frame_no, valid, confidence_iou, warped) is valid with some
    confidence: then `local_ref` is its `warped` payload and `local_mask` the previous frame's mask. Otherwise the payload is 0, the
    mask `hole` (all of it unknown), and local_used 0. A first frame has no record that counts."""
    w = Window.partitionBy("seq_id").orderBy("frame_no")
    rows = frames.select("seq_id", "frame_no", F.col(payload).alias("current"), F.first(payload).over(w).alias("global_ref"), F.lag(mask).over(w).alias("prev_mask"),
                         (F.row_number().over(w) > 1).alias("later"))
    met = rows.join(alignments.withColumn("npz_ok", F.lit(True)), ["seq_id", "frame_no"], "left")
    there = F.col("later") & F.coalesce("npz_ok", F.lit(False))
    conf = F.when(there, F.coalesce("confidence_iou", F.lit(0.0))).otherwise(0.0)
    valid = there & F.coalesce("valid", F.lit(False))
    used = valid & (conf > 0)
    return met.select("seq_id", "frame_no", "current", "global_ref", F.when(used, F.col("warped")).otherwise(0).alias("local_ref"),
                      F.when(used, F.col("prev_mask")).otherwise("hole").alias("local_mask"), there.cast("int").alias("npz_ok"), valid.cast("int").alias("warp_valid"),
                      conf.alias("conf"), used.cast("int").alias("local_used"))
