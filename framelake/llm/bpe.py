"""Byte-level BPE encoding and decoding over overlapping chunks.

Texts of up to CHUNK characters are one chunk and are encoded where they are read. Longer texts are cut into overlapping
chunks that are pre-tokenised in parallel; per document, neighbouring chunks are stitched at the first pre-token boundary
on which both agree, and the pieces between stitches are then encoded in parallel.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import map_texts, table

CHUNK, OVERLAP = 65_536, 2_048
#: A boundary this close to a chunk's end may move once more text is seen (the pattern looks at most 3 characters on).
MARGIN = 4
#: Pre-tokens that each of a task's two generations remembers, and the longest that are remembered (characters); with what is
#: kept of them some 230 bytes each. Characters of texts that are split before their new pre-tokens are merged together.
REMEMBERED, LONGEST, TOGETHER = 150_000, 48, 500_000
#: Pre-tokens of up to so many bytes are merged many at a time.
SHORT, NONE = 32, np.int32(2**31 - 1)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with lines of base64 bytes and rank; bounded by the vocabulary (50,000 lines)."""
    rows = spark.read.text(path).collect() if "://" in path else open(path).read().splitlines()
    lines = [r if isinstance(r, str) else r.value for r in rows]
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class Merger:
    """Pre-token -> its ids: merges the adjacent pair of lowest rank until none is in the vocabulary. `pairs` has every pair
    of ids, as first * 2^32 + second, whose bytes are in the vocabulary together, in order, and `merged` their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        halves = [(ranks[data[:i]] << 32 | ranks[data[i:]], rank) for data, rank in ranks.items() for i in range(1, len(data))
                  if data[:i] in ranks and data[i:] in ranks]
        table = np.array(sorted(halves) or [(-2, 0)], dtype=np.int64)
        self.pairs, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)

    def __call__(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._long(data) if len(data) > 256 else self._merge(data)

    def many(self, tokens: list[str]) -> list[bytes]:
        """The ids of each of many pre-tokens as packed int32; the short ones, a few thousand of about one length at a time,
        lose their pair of lowest rank all at once, step by step."""
        data = [t.encode("utf-8", "surrogatepass") for t in tokens]
        out = [b"" if len(d) <= SHORT and d not in self.ranks else np.array(self(d), dtype=np.int32).tobytes() for d in data]
        open_ = sorted((i for i, x in enumerate(out) if not x), key=lambda i: len(data[i]))
        for at in range(0, len(open_), 4_000):
            self._many(open_[at: at + 4_000], data, out)
        return out

    def _many(self, which: list[int], data: list[bytes], out: list[bytes]) -> None:
        rows, size = np.array(which), np.array([len(data[i]) for i in which])
        ids = np.full((len(rows), size.max() + 1), -1, dtype=np.int32)
        ids[np.arange(ids.shape[1]) < size[:, None]] = self.byte[np.frombuffer(b"".join(data[i] for i in which), np.uint8)]
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            lowest = rank.argmin(axis=1)
            new = rank[np.arange(len(rows)), lowest]
            done = new == NONE
            if done.any():
                left = ids[done]
                packed, ends = left[left >= 0].tobytes(), np.cumsum(4 * (left >= 0).sum(axis=1)).tolist()
                for i, a, b in zip(rows[done].tolist(), [0, *ends], ends, strict=False):
                    out[i] = packed[a:b]
                rows, ids, rank, lowest, new = (x[~done] for x in (rows, ids, rank, lowest, new))
                if not len(rows):
                    break
            each = np.arange(len(rows))
            # the pair becomes one id, what follows moves up, and the pairs on both sides get new ranks
            gone = np.arange(rank.shape[1]) > lowest[:, None]
            ids[each, lowest] = new
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=gone)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=gone[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NONE
            rank[each, lowest] = self._ranks(new, ids[each, np.minimum(lowest + 1, ids.shape[1] - 1)])
            before = np.flatnonzero(lowest > 0)
            rank[before, lowest[before] - 1] = self._ranks(ids[before, lowest[before] - 1], new[before])

    def _ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        code = first.astype(np.int64) << 32 | second
        code[(first < 0) | (second < 0)] = -1
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.merged[at], NONE)

    def _merge(self, data: bytes) -> list[int]:
        ranks, parts = self.ranks, [data[i: i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == 1 << 40:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        return [ranks[p] for p in parts]

    def _long(self, data: bytes) -> list[int]:
        """The same merges for long pre-tokens, with a heap over a linked list instead of repeated scans."""
        ranks, n = self.ranks, len(data)
        part, right, left = [data[i: i + 1] for i in range(n)], [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i: i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j < 0 or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j], right[i] = b"", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and (b := right[a]) >= 0 and (r := ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
        return [ranks[p] for p in part if p]


class Vocabulary:
    """What each id stands for: its bytes and its decimal name."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.bytes: list = [None] * size
        for data, i in ranks.items():
            self.bytes[i] = data
        self.names = [str(i) for i in range(size)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def digests(self, listed: Iterable[list[int]]) -> list[pa.Array]:
        """The DIGEST columns of lists of ids."""
        found = [(len(ids), hashlib.sha256(" ".join(map(self.names.__getitem__, ids)).encode()).hexdigest(),
                  hashlib.sha256(self.decode(ids)).hexdigest()) for ids in listed]
        return [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]


IDS = "ids array<int>"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def boundaries(pattern: regex.Pattern, text: str, start: int) -> np.ndarray:
    """Document positions where pre-tokens of a chunk at `start` end."""
    return np.array([start + m.end() for m in pattern.finditer(text)], dtype=np.int64)


def stitch(pattern: regex.Pattern, chunks: list[tuple[int, str, np.ndarray]]) -> Iterator[str]:
    """Pieces of one document that start and end at pre-token boundaries of the whole text.

    chunks: (start, text, boundaries) in order. Where a boundary of the scan so far is also one of the next chunk's, the
    two scans are the same from there on; without one in the overlap, the next chunk is scanned again, together with
    what is not settled yet."""
    start, text, ends = chunks[0]
    for nxt_start, nxt_text, nxt_ends in chunks[1:]:
        stop = start + len(text)
        settled = ends[(ends >= nxt_start) & (ends <= stop - MARGIN)]
        # a chunk's own start is no boundary that it has found, so only its later ends count
        common = np.intersect1d(settled, nxt_ends, assume_unique=True)
        if len(common):
            cut = int(common[0])
            yield text[: cut - start]
            start, text, ends = cut, nxt_text[cut - nxt_start:], nxt_ends[nxt_ends > cut]
        else:
            safe = ends[ends <= stop - MARGIN]
            cut = int(safe[-1]) if len(safe) else start
            if cut > start:
                yield text[: cut - start]
            text = text[cut - start:] + nxt_text[stop - nxt_start:]
            start, ends = cut, boundaries(pattern, text, cut)
    yield text


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (key, ids array<int>), one for each input row: the ids of the whole text, pre-token by pre-token, without
    special tokens.

    Null texts count as empty and give no ids; any length is encoded whole; repeated rows give repeated results; an empty
    table gives an empty result; other columns aren't read. `chunk` and `overlap` (characters) change the work's shape,
    never the ids.
    """
    return _encode(df, ranks, pattern, key, text, chunk, overlap, digest=False)


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
               chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: the ids that `encode` gives, hashed as decimals joined by
    spaces, and the bytes that these ids decode to, hashed, in the tasks that have the ids."""
    return _encode(df, ranks, pattern, key, text, chunk, overlap, digest=True)


def _encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, key: str, text: str, chunk: int, overlap: int, digest: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    short, long_ = rows.where(F.length("body") <= chunk), rows.where(F.length("body") > chunk)
    found = map_texts(short, "body", DIGEST, _digester(shared, pattern)) if digest else map_texts(short, "body", IDS, _encoder(shared, pattern))
    whole = _encode_long(long_, shared, pattern, chunk, overlap)
    if digest:
        whole = map_texts(whole, "ids", DIGEST, _id_digester(shared))
    # each distinct long text is encoded once, and its rows meet it by its hash
    met = long_.select("key", F.sha2("body", 256).alias("doc")).join(whole, "doc").select("key", *[c for c in whole.columns if c != "doc"])
    return found.unionByName(met).withColumnRenamed("key", key)


class Known:
    """Texts -> their ids as packed int32. Pre-tokens are remembered in two generations: once the young one is full it becomes
    the old one, and what is met again moves back; so what is common always stays, and what was rare goes."""

    def __init__(self, merger: Merger, pattern: str):
        self.merger, self.split = merger, regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size + len(texts[at]) <= TOGETHER):
                cut.append(self.split.findall(texts[at]))
                size += len(texts[at])
                at += 1
            lacking = set().union(*cut).difference(self.young)
            if len(self.young) > REMEMBERED:
                lacking, self.young, self.old = set().union(*cut), {}, self.young
            self.young.update((t, self.old[t]) for t in lacking & self.old.keys())
            new = list(lacking.difference(self.young))
            self.young.update(zip(new, self.merger.many(new), strict=True))
            for tokens in cut:
                yield b"".join(map(self.young.__getitem__, tokens))
            for t in new:
                if len(t) > LONGEST:
                    del self.young[t]


def _encoder(shared, pattern: str) -> Callable:
    """Texts -> a column of their ids."""
    def start() -> Callable[[list], list[pa.Array]]:
        known = Known(Merger(shared.value), pattern)

        def make(texts: list[str]) -> list[pa.Array]:
            packed = list(known(texts))
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            return [pa.ListArray.from_arrays(pa.array(ends), values)]

        return make

    return start


def _digester(shared, pattern: str) -> Callable:
    """Texts -> the DIGEST columns of their ids."""
    def start() -> Callable[[list], list[pa.Array]]:
        vocabulary, known = Vocabulary(shared.value), Known(Merger(shared.value), pattern)
        return lambda texts: vocabulary.digests(np.frombuffer(p, np.int32).tolist() for p in known(texts))

    return start


def _id_digester(shared) -> Callable:
    def start() -> Callable[[list], list[pa.Array]]:
        return Vocabulary(shared.value).digests

    return start


def _encode_long(rows: DataFrame, shared, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc, ids) of each distinct `body`; `doc` is its SHA-256."""
    bodies = rows.select(F.sha2("body", 256).alias("doc"), "body").dropDuplicates(["doc"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, body in zip(batch["doc"], batch["body"], strict=True):
                at = range(0, len(body), chunk)
                yield pd.DataFrame({"doc": doc, "start": list(at), "part": [body[i: i + chunk + overlap] for i in at]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = regex.compile(pattern)
        for batch in batches:
            ends = [boundaries(split, t, s) for t, s in zip(batch["part"], batch["start"], strict=True)]
            yield batch.assign(ends=pd.Series(ends, index=batch.index, dtype=object))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        parts = list(zip(group["start"], group["part"], [np.asarray(e, dtype=np.int64) for e in group["ends"]], strict=True))
        pieces = list(stitch(regex.compile(pattern), parts))
        return pd.DataFrame({"doc": group["doc"].iloc[0], "piece": range(len(pieces)), "part": pieces})

    chunks = bodies.mapInPandas(cut, "doc string, start long, part string").repartition("doc", "start")
    scanned = chunks.mapInPandas(scan, "doc string, start long, part string, ends array<long>")
    pieces = scanned.groupBy("doc").applyInPandas(join, "doc string, piece long, part string")
    encoded = map_texts(pieces.repartition("doc", "piece"), "part", IDS, _encoder(shared, pattern))
    whole = encoded.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("ps"))
    return whole.select("doc", F.flatten(F.col("ps.ids")).alias("ids"))


def decode(df: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`df` with a column `bytes`: the raw bytes of all ids, one after the other; null ids give no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            yield pd.Series([b"" if x is None else vocabulary.decode(x.tolist()) for x in batch], index=batch.index)

    return df.withColumn("bytes", raw(F.col(ids)))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
