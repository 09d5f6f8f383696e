"""Phrase collocations: n-grams counted by merged quotient filters, length after length, and scored by their weakest cut."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm import quotient_filter
from framelake.llm.common import discard, join_unique, materialize, spread, stable, table

#: Words of a phrase at most, its occurrences at least, and phrases of a language that are reported.
LONGEST, MIN_COUNT, TOP = 5, 100, 2_000
#: Characters whose texts share one filter, those that are cut into words at once, and words of the corpus a range of slots.
SHARD_CHARS, SLICE_CHARS, RANGE_WORDS = 8_000_000, 1_000_000, 1 << 21

#: Marks that end a piece, all as one mark; A-Z lower-cased; tab as space.
MARK = b"."
TABLE = bytes(MARK[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Shard:
    """Words of one language in a task: `index` numbers the distinct ones, `codes` has them in order, with 0 for a mark."""

    def __init__(self) -> None:
        self.index, self.codes = {MARK: 0}, []

    def add(self, body: bytes) -> None:
        words = body.split()
        for word in dict.fromkeys(words):
            if word not in self.index:
                self.index[word] = len(self.index)
        self.codes.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))


def _slices(text: bytes) -> Iterator[bytes]:
    """`text` with its marks set apart, ended by one, in slices that end between words."""
    body, at = text.translate(TABLE).replace(MARK, b" . ") + b" .", 0
    while at < len(body):
        end = body.find(b" ", at + SLICE_CHARS)
        end = len(body) if end < 0 else end
        yield body[at:end]
        at = end


def _pack(ids: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte by byte: the high bytes are mostly alike."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(ids).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.uint64)


SHARDS = "shard long, lang string, range int, n long, packed binary, words array<string>, counts binary"
#: Rows of the words' codes or phrases' ids, which go from length to length, and the rows that are merged.
KEPT, PARTS = "range = -1 AND merged = false", "merged = true"


def _shards(batches: Iterator[pa.RecordBatch], shard_chars: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Documents (lang, text) as shards of one language, of `shard_chars` characters of all languages at a time: a row (shard, lang, range -1, n,
    packed) with the number of words and all words' codes, and rows (shard, lang, range, packed, words, counts) of the distinct words, by `parts`
    parts of their hashes, with their codes."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    open_shards: dict[str, _Shard] = {}
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        for lang, shard in open_shards.items():
            codes = np.concatenate(shard.codes)
            counts = np.bincount(codes, minlength=len(shard.index))
            words = pa.array(list(shard.index), pa.binary()).cast(pa.string())
            part = np.fromiter(map(xxhash.xxh3_64_intdigest, shard.index), np.uint64, len(shard.index)) % np.uint64(parts)
            order = np.argsort(part[1:], kind="stable") + 1
            cuts = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
            rows = len(cuts) + 1
            spoken = words.take(pa.array(order)) if len(order) else words.slice(0, 0)
            offsets = pa.array(np.concatenate([[0, 0], np.cumsum([len(c) for c in cuts])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * rows), pa.array([lang] * rows), pa.array([-1, *(int(part[c[0]]) for c in cuts)], pa.int32()),
                pa.array([int(counts[1:].sum())] + [0] * len(cuts)), pa.array([_pack(codes), *(_pack(c) for c in cuts)]),
                pa.ListArray.from_arrays(offsets, spoken), pa.array([b"", *(_pack(counts[c]) for c in cuts)])],
                ["shard", "lang", "range", "n", "packed", "words", "counts"])
            number += 1
        open_shards.clear()
        size = 0

    for batch in batches:
        texts, langs = batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist()
        for i, lang in enumerate(langs):
            text = texts[i].as_py()
            if not text:
                continue
            shard = open_shards.setdefault(lang, _Shard())
            for body in _slices(text):
                shard.add(body)
            size += len(text)
            if size >= shard_chars:
                yield from close()
    yield from close()


MERGED = "shard long, range int, keys binary, ids binary, counts binary, words array<string>, langs array<string>"


def _merged(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = [c.split()[0] for c in MERGED.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _merge_words(parts: int, min_count: int) -> Callable[[pa.Table], pa.Table]:
    """One part's words of all shards: a row (shard -1, range, ids, counts, words, langs) of the frequent ones, and (shard, range, keys, ids) with the codes
    and ids of those that a shard holds. Ids number the words of all parts in turn, so they are dense without knowing the others' number."""
    def run(group: pa.Table) -> pa.Table:
        number, langs = group.column("range")[0].as_py(), group.column("lang").to_pylist()
        lists = group.column("words").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        spoken = pc.binary_join_element_wise(pa.array(np.array(langs, dtype=object).repeat(sizes), pa.string()), pc.list_flatten(lists), " ")
        each = spoken.dictionary_encode()
        codes = each.indices.to_numpy()
        counts = np.bincount(codes, np.concatenate([_unpack(c) for c in group.column("counts").to_pylist()]).astype(float), len(each.dictionary)).astype(np.int64)
        often = counts >= min_count
        ids = np.where(often, np.cumsum(often) * parts + number, 0)
        if ids.max(initial=0) >= 2**32:
            raise ValueError("more than 2**32 frequent words")
        named = [x.rsplit(" ", 1) for x in each.dictionary.filter(pa.array(often)).to_pylist()]
        rows = [(-1, number, None, ids[often].astype("<u4").tobytes(), counts[often].astype("<i8").tobytes(), [w for _, w in named], [x for x, _ in named])]
        ends = np.cumsum(sizes)
        for shard, slots, a, b in zip(group.column("shard").to_pylist(), group.column("packed").to_pylist(), ends - sizes, ends, strict=True):
            mine = ids[codes[a:b]]
            if mine.any():
                rows.append((shard, number, _unpack(slots)[mine > 0].astype("<u4").tobytes(), mine[mine > 0].astype("<u4").tobytes(), None, None, None))
        return _merged(rows)

    return run


def _keys(ids: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, permuted keys) of the pairs of overlapping phrases, two ids of `bits` bits: a phrase one word longer is its first and its
    last part."""
    at = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0)) if len(ids) else np.zeros(0, np.int64)
    return at, quotient_filter.permute((ids[at] << np.uint64(bits)) | ids[at + 1], width)


def _advance(ranges: int, before: tuple[int, int] | None, bits: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (shard, ids, found) to the ids of phrases one word longer, and their successors' filters: rows (shard, range, packed), the
    ids themselves as range -1. `found` says which of the shard's keys, pairs of the bits and width `before` (None: words), are frequent, and
    their ids, of `bits` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, found = batch.column("shard")[i].as_py(), sorted(batch.column("found")[i].as_py(), key=lambda f: f["range"])
                ids = _unpack(batch.column("ids")[i].as_py())
                keys = np.concatenate([np.frombuffer(f["keys"], "<u8" if before else "<u4") for f in found])
                values = np.concatenate([np.frombuffer(f["ids"], "<u4") for f in found]).astype(np.uint64)
                if before is None:
                    known = np.zeros(max(int(ids.max(initial=0)), int(keys.max(initial=0))) + 1, np.uint64)
                    known[keys] = values
                    ids = known[ids]
                else:
                    at, mine = _keys(ids, *before)
                    ids = np.zeros(len(ids), np.uint64)
                    place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    ids[at] = np.where(keys[place] == mine, values[place], np.uint64(0))
                counted = np.unique(_keys(ids, bits, width)[1], return_counts=True)
                rows = [(-1, _pack(ids)), *quotient_filter.split(*counted, ranges, width)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(rows)), pa.array([r for r, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())],
                    ["shard", "range", "packed"])

    return run


def _merge(ranges: int, width: int, min_count: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """One range's filters of all shards, merged: a row (shard -1, range, keys, ids, counts) of the frequent keys, and unless this is the `last`
    length, one (shard, range, keys, ids) a shard of those that it holds. Ids as in `_merge_words`."""
    def run(group: pa.Table) -> pa.Table:
        number = group.column("range")[0].as_py()
        filters = [quotient_filter.unpack(p, number, ranges, width) for p in group.column("packed").to_pylist()]
        keys, counts, place = quotient_filter.merge(filters)
        often = counts >= min_count
        ids = np.where(often, np.cumsum(often) * ranges + number, 0)
        if ids.max(initial=0) >= 2**32:
            raise ValueError("more than 2**32 frequent phrases of one length")
        rows = [(-1, number, keys[often].astype("<u8").tobytes(), ids[often].astype("<u4").tobytes(), counts[often].astype("<i8").tobytes(), None, None)]
        at = 0
        for shard, (own, _) in zip(group.column("shard").to_pylist(), filters, strict=True):
            mine = ids[place[at: at + len(own)]]
            at += len(own)
            if not last and mine.any():
                rows.append((shard, number, own[mine > 0].astype("<u8").tobytes(), mine[mine > 0].astype("<u4").tobytes(), None, None, None))
        return _merged(rows)

    return run


def _phrases(bits: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, left, right, f) of each frequent key: the ids of the phrase's first and last part, and its count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("keys", "ids", "counts")), strict=True):
                pair = quotient_filter.restore(np.frombuffer(keys, "<u8"), width)
                columns = [np.frombuffer(ids, "<u4").astype(np.int64), (pair >> np.uint64(bits)).astype(np.int64),
                           (pair & np.uint64((1 << bits) - 1)).astype(np.int64), np.frombuffer(counts, "<i8")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "left", "right", "f"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, word, f) of the frequent words."""
    for batch in batches:
        for words, langs, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("words", "langs", "ids", "counts")), strict=True):
            columns = [pa.array(np.frombuffer(ids, "<u4").astype(np.int64)), pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(np.frombuffer(counts, "<i8"))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "word", "f"])


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP,
         shard_chars: int = SHARD_CHARS, range_words: int = RANGE_WORDS) -> DataFrame:
    """The `top` phrases of each language: (lang, rank, phrase, a, l, r, n, score), as the contract of the registered query puts it.

    Frequent words get ids; then, length after length, a phrase is the pair of ids of its first and its last part, two frequent phrases that
    overlap. Each shard of documents counts its pairs in a quotient filter; filters are cut by ranges of slots, merged range by range, and
    the frequent keys go back to the shards that hold them. A phrase whose parts aren't frequent can't be, so nothing is lost. Counts are
    exact, cuts are scored in decimals of 38 digits.

    Null or empty texts have no words, a null language counts as `und`, phrases don't cross pieces or documents. Repeated rows count each
    time. An empty table gives an empty result; other columns aren't read.
    """
    rows = stable(docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")))
    parts = spread(rows, 8)
    merging = (F.col("range") >= 0).alias("merged")
    step = materialize(rows.mapInArrow(lambda b: _shards(b, shard_chars, parts), SHARDS).select("*", merging), by="merged")
    totals = materialize(step.where(KEPT).groupBy("lang").agg(F.sum("n").alias("n")))
    words = totals.agg(F.sum("n")).first()[0] or 0
    ranges = 1 << max(4, math.ceil(math.log2(max(1, words / range_words))))
    merged = materialize(step.where(PARTS).drop("merged").groupBy("range").applyInArrow(_merge_words(parts, min_count), MERGED))
    discard(step, part="merged=true")
    known = materialize(merged.where("shard = -1").select("words", "langs", "ids", "counts").mapInArrow(_words, "id long, lang string, word string, f long"))
    known = known.select("id", "lang", F.array("word").alias("words"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    lengths, before = [], None
    for length in range(2, longest + 1):
        bits = int(known.agg(F.max("id")).first()[0] or 1).bit_length()
        width = quotient_filter.key_width(2 * bits, ranges)
        found = merged.where("shard >= 0").groupBy("shard").agg(F.collect_list(F.struct("range", "keys", "ids")).alias("found"))
        now = step.where(KEPT).select("shard", F.col("packed").alias("ids")).join(found, "shard")
        longer = now.mapInArrow(_advance(ranges, before, bits, width), "shard long, range int, packed binary")
        used, step = (step, merged), materialize(longer.select("*", merging), by="merged")
        discard(*used)
        before = bits, width
        merged = materialize(step.where(PARTS).drop("merged").groupBy("range").applyInArrow(_merge(ranges, width, min_count, length == longest), MERGED))
        discard(step, part="merged=true")
        pairs = materialize(merged.where("shard = -1").select("keys", "ids", "counts").mapInArrow(_phrases(bits, width), "id long, left long, right long, f long"))
        first = known.select(F.col("id").alias("left"), "lang", "words", "heads")
        second = known.select(F.col("id").alias("right"), F.element_at("words", -1).alias("word"), "tails")
        both = join_unique(materialize(join_unique(pairs, first, "left")), second, "right")
        known = materialize(both.select(
            "id", "lang", F.array_append("words", F.col("word")).alias("words"), F.array_append("heads", F.col("f")).alias("heads"),
            F.array_append("tails", F.col("f")).alias("tails"), "left", "right", "f"))
        lengths.append(known)
    discard(step, merged)
    kept = []
    for phrases, longer in zip(lengths, [*lengths[1:], None], strict=True):
        if longer is not None:
            part = longer.select(F.col("left").alias("id"), "f").union(longer.select(F.col("right").alias("id"), "f"))
            most = part.groupBy("id").agg(F.max("f").alias("most"))
            phrases = phrases.join(most, "id", "left").where("most IS NULL OR most < f")
        kept.append(phrases.select("lang", "words", "heads", "tails", F.col("f").alias("a")))
    candidates = kept[0]
    for more in kept[1:]:
        candidates = candidates.union(more)
    scored = join_unique(materialize(candidates), totals, "lang").withColumn("cut", F.expr(
        "array_min(transform(sequence(1, size(words) - 1), k -> struct("
        " cast(a AS DECIMAL(38, 0)) * n * 1000 div (cast(heads[k - 1] AS DECIMAL(38, 0)) * tails[size(words) - k - 1]) AS score,"
        " k AS k, heads[k - 1] AS l, tails[size(words) - k - 1] AS r)))"))
    named = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return named.withColumn("rank", rank).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, words[i + 1:i + k] AS w FROM pieces, LATERAL unnest(range(len(words))) AS u(i), (VALUES (1), (2), (3), (4), (5)) AS v(k)
  WHERE i + k <= len(words)),
f AS (SELECT lang, array_to_string(w, ' ') AS phrase, any_value(w) AS w, count(*) AS f FROM grams GROUP BY 1, 2 HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.phrase, c.w, c.f AS a, k, array_to_string(c.w[1:k], ' ') AS head, array_to_string(c.w[k + 1:], ' ') AS tail
  FROM f c, (VALUES (1), (2), (3), (4)) AS v(k) WHERE k < len(c.w)),
scored AS (SELECT lang, phrase, any_value(w) AS w, any_value(a) AS a, any_value(n) AS n,
  min({'score': (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f), 'k': k, 'l': l.f, 'r': r.f}) AS cut
  FROM cuts JOIN (SELECT lang, phrase AS head, f FROM f) l USING (lang, head) JOIN (SELECT lang, phrase AS tail, f FROM f) r USING (lang, tail)
  JOIN totals USING (lang) GROUP BY lang, phrase),
covered AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS most FROM scored, (VALUES (1), (2), (3), (4)) AS u(i),
  (VALUES (2), (3), (4)) AS v(k) WHERE k < len(w) AND i + k - 1 <= len(w) GROUP BY 1, 2),
kept AS (SELECT scored.* FROM scored LEFT JOIN covered USING (lang, phrase) WHERE most IS NULL OR most < a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank, phrase, a, cut.l AS l, cut.r AS r, n,
  cut.score::BIGINT AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""
