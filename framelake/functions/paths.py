"""Path functions: Column -> Column, or DataFrame -> DataFrame where a path depends on the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = r"^._(imgs|pkls|npzs|flow)$"


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def seq_id_marker(path: Column) -> Column:
    """The first component longer than 5 after the first marker component; without one, the parent's name."""
    p = parts(path)
    marks = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: F.element_at(p, i).rlike(MARKER))
    after = F.filter(F.slice(p, F.coalesce(F.get(marks, F.lit(0)), F.lit(10_000)) + 1, F.size(p)), lambda x: F.length(x) > 5)
    return F.coalesce(F.get(after, F.lit(0)), basename(dirname(path)))


def seq_id_long15(path: Column, fallback: str = "parent") -> Column:
    """The first directory longer than 15 characters; else the parent's name, or the whole directory (`dirname`)."""
    found = F.get(F.filter(parts(dirname(path)), lambda x: F.length(x) > 15), F.lit(0))
    return F.coalesce(found, dirname(path) if fallback == "dirname" else basename(dirname(path)))


def with_seq_id_child(df: DataFrame, path: str = "path", strict_parity: bool = False) -> DataFrame:
    """`seq_id`: the directory's own name unless several directories (strict parity: files) have it, then its parent's."""
    own = df.withColumn("~dir", dirname(F.col(path))).withColumn("~child", basename(F.col("~dir")))
    counted = F.count("~dir") if strict_parity else F.count_distinct("~dir")
    shared = own.groupBy("~child").agg((counted > 1).alias("~shared"))
    return own.join(shared, "~child").withColumn("seq_id", F.when(F.col("~shared"), basename(dirname(F.col("~dir")))).otherwise(F.col("~child"))).drop("~dir", "~child", "~shared")


def seq_path(path: Column, seq_id: Column) -> Column:
    """The path up to and with the component that is the sequence id."""
    p = parts(path)
    return F.array_join(F.slice(p, 1, F.greatest(F.array_position(p, seq_id).cast("int"), F.lit(1))), "/")


def natural_key(name: Column, width: int = 20) -> Column:
    """A string that sorts lower-cased names with runs of digits as numbers."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, width, "0")).otherwise(r)), "")


def last_number(name: Column) -> Column:
    """The last run of digits; none: infinity."""
    found = F.regexp_extract_all(name, F.lit(r"(\d+)"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("double")).otherwise(F.lit(float("inf")))


def norm_path(path: Column) -> Column:
    """Collapse `//`, `.`, `..` and a trailing slash."""
    kept = F.filter(parts(path), lambda x: (x != "") & (x != "."))
    done = F.aggregate(kept, F.array().cast("array<string>"), lambda acc, x: F.when(
        (x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.array_append(acc, x)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(done, "/"))


def common_root(df: DataFrame, path: str = "path") -> DataFrame:
    """One row `root`: the longest component prefix of all paths, which is that of the least and the greatest path."""
    ends = df.agg(F.min(parts(F.col(path))).alias("a"), F.max(parts(F.col(path))).alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    return ends.select(F.array_join(F.slice("a", 1, F.size(same)), "/").alias("root"))


def derived_path(path: Column, root: str, out_dir: str, ext: str) -> Column:
    return F.concat(F.lit(out_dir), F.regexp_replace(F.substring(path, len(root) + 1, 100_000), r"\.[^./]*$", ""), F.lit(ext))


def staged_name(rel: Column) -> Column:
    return F.concat(F.substring(F.sha1(rel.cast("binary")), 1, 10), F.lit("_"), stem(rel), extension(rel))


def with_collisions(df: DataFrame, name: str = "new_name") -> DataFrame:
    """`collides`: whether another row has the same name."""
    counted = df.groupBy(name).agg((F.count("*") > 1).alias("collides"))
    return df.join(counted, name)


def numbered_names(df: DataFrame, group: str, path: str = "path", new_name: str = "new_name") -> DataFrame:
    """`new_name`: the number of each file in its group, in natural order of the names from 0, with zeros to the width of the
    group's count, and its ending. A group is a folder."""
    w = Window.partitionBy(group)
    n = F.row_number().over(w.orderBy(natural_key(basename(F.col(path))), path)) - 1
    width = F.length(F.count("*").over(w).cast("string"))
    rows = df.withColumns({"~n": n, "~w": width})
    return rows.withColumn(new_name, F.concat(F.lpad(F.col("~n").cast("string"), F.col("~w"), F.lit("0")), extension(F.col(path)))).drop("~n", "~w")


def joined_name(path: Column, form: str = "parent") -> Column:
    """A flat name: `parent` <parent>_<name>, `dirs` <first directory>_<second>_<name> of a relative path, `stem`
    <grandparent>_<parent>_<stem>; directories that a path lacks are left out."""
    p = F.filter(parts(path), lambda x: x != "")
    at = lambda i: F.get(p, F.size(p) - i)
    take = {"parent": [at(2), at(1)], "dirs": [F.when(F.size(p) > i + 1, F.get(p, F.lit(i))) for i in (0, 1)] + [at(1)], "stem": [at(3), at(2), stem(at(1))]}[form]
    return F.concat_ws("_", *take)


def fit_box(w: Column, h: Column, mode: str, target: int) -> list[Column]:
    """(new_w, new_h, left, top) of an image scaled to a square target: `crop` by the short side with a centre crop, `pad` by the long side with
    centre padding (negative offsets), `square` a centre square."""
    if mode == "square":
        side = F.least(w, h)
        return [side.alias("new_w"), side.alias("new_h"), F.floor((w - side) / 2).alias("left"), F.floor((h - side) / 2).alias("top")]
    scale = F.lit(float(target)) / (F.least(w, h) if mode == "crop" else F.greatest(w, h))
    nw, nh = F.floor(w * scale + 0.5), F.floor(h * scale + 0.5)
    return [nw.alias("new_w"), nh.alias("new_h"), F.floor((nw - target) / 2).alias("left"), F.floor((nh - target) / 2).alias("top")]
