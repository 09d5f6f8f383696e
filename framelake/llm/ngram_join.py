"""N-gram Jaccard join: documents whose sets of word shingles are alike, by rare-first prefix filtering.

Shingle hashes travel packed by bucket to be counted, once a batch of documents with their number there, so a shingle that
all documents have is one entry a batch; a document gets back those that others have too, and keeps the
shortest rare-first prefix that any partner must share. Documents without a shared shingle there have no partner. The
others post their prefix; pairs pass a length, a positional and a suffix filter and are verified once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import materialize, spread, stable, table, without
from framelake.llm.components import components
from framelake.llm.packing import Batch, batches, by_bucket, steps, unroll

SIZE, PERCENT = 5, 75
#: Bytes of a shingle hash that are sent; its bucket has the 8 bits before them, or more.
SENT = 7
#: Of a shingle's documents, how many are paired with how many in one piece of work.
PIECE = 512
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * K2
    return x ^ (x >> np.uint64(29))


def shingles(b: Batch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a batch, in order. A document of fewer words is one shingle."""
    words, counts = mix(b.hashes()), np.diff(b.starts)
    w = words[b.codes] if len(words) else np.zeros(0, np.uint64)
    doc = b.docs()
    n = len(w)
    h = np.full(n, np.uint64(0))
    room = b.starts[1:][doc] - np.arange(n) if n else np.zeros(0, int)
    for k in range(size):
        there = room > k
        nxt = np.zeros(n, np.uint64)
        nxt[: n - k] = w[k:]
        h = np.where(there, mix((h ^ nxt) * K1 + np.uint64(k + 1)), h)
    whole = (room >= size) | ((counts[doc] < size) & (room == counts[doc]))
    doc, h = doc[whole], h[whole]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of n shingles, how many the prefix needs, so that partners of the given similarity share one of them."""
    return n - -(-n * percent // 100) + 1


def pack_hashes(h: np.ndarray) -> bytes:
    """The last SENT bytes of each hash."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - SENT:].tobytes()


def unpack_hashes(data: bytes, bucket: int, bits: int) -> np.ndarray:
    """The hashes again, all 64 bits, from what was sent and the bucket, their first `bits` bits."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, SENT)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 8 - SENT:] = raw
    return (full.view(">u8").ravel().astype(np.uint64) | np.uint64(bucket << (64 - bits))).view(np.int64)


SENT_FIELDS = "bucket long, batch long, keys array<string>, h binary, doc binary, n binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("keys", pa.list_(pa.string())),
                         ("h", pa.binary()), ("doc", pa.binary()), ("n", pa.binary())])


def sent_rows(b: Batch, size: int, bits: int) -> list[dict]:
    """What a batch sends: to itself (bucket below 0) its keys, set sizes and fingerprints, and the places of the shingles that several of its
    documents have; to the buckets every shingle once, with its document if it has one only, else with the number of them."""
    doc, h = shingles(b, size)
    n = np.bincount(doc, minlength=len(b.keys)).astype(np.int64)
    ends = np.cumsum(n)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix(h * K1), mix(h * K2 + K1))]
    prints = [(s[ends] - s[ends - n]).astype(np.int64).tobytes() for s in sums]
    out = [{"bucket": -1 - b.number, "batch": b.number, "keys": b.keys, "h": n.tobytes(), "doc": prints[0], "n": prints[1]}]
    ranks = np.sort(h)
    again = np.unique(ranks[1:][ranks[1:] == ranks[:-1]])
    spot = np.minimum(np.searchsorted(again, h), max(0, len(again) - 1))
    often = again[spot] == h if len(again) else np.zeros(len(h), dtype=bool)
    if len(again):
        times = np.bincount(spot[often]).astype(np.int32)
        out.append({"bucket": -1 - b.number, "batch": b.number, "doc": steps(doc[often]), "n": spot[often].astype(np.int32).tobytes()})
        out += [{"bucket": k, "batch": b.number, "h": pack_hashes(again[at]), "n": times[at].tobytes()} for k, at in by_bucket(again, bits)]
    doc, h = doc[~often], h[~often]
    return out + [{"bucket": k, "batch": b.number, "h": pack_hashes(h[at]), "doc": steps(doc[at])} for k, at in by_bucket(h, bits)]


def count_bucket(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    """The answers to the batches of one bucket: in how many documents each shingle is that more than one has."""
    bucket = int(group["bucket"].iloc[0])
    if bucket < 0:
        return group[["batch", "keys", "h", "doc", "n"]]
    t = [unpack_hashes(x, bucket, bits) for x in group["h"]]
    times = np.concatenate([np.ones(len(x), np.int32) if n is None else np.frombuffer(n, np.int32) for x, n in zip(t, group["n"], strict=True)])
    t = np.concatenate(t)
    order = np.argsort(t, kind="stable")
    first = np.ones(len(t), dtype=bool)
    first[1:] = t[order][1:] != t[order][:-1]
    run = np.cumsum(first) - 1
    df = np.empty(len(t), np.int64)
    df[order] = np.bincount(run, times[order])[run].astype(np.int64)
    df = np.minimum(df, 2**31 - 1)
    out, at = [], 0
    for batch, sent, packed in zip(group["batch"], group["h"], group["doc"], strict=True):
        own, at = slice(at, at + len(sent) // SENT), at + len(sent) // SENT
        many = df[own] > 1
        if many.any():
            out.append({"batch": batch, "keys": None, "h": t[own][many].tobytes(), "n": df[own][many].astype(np.int32).tobytes(),
                        "doc": None if packed is None else steps(unroll(packed)[many])})
    return pd.DataFrame(out, columns=["batch", "keys", "h", "doc", "n"])


def answers(rest: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document, number of documents) of a batch's shingles that several documents have, from its own row and the buckets' answers."""
    places, got = rest[rest["h"].isna()], rest[rest["h"].notna()]
    lone = got["doc"].notna()

    def read(rows: pd.Series, kind: type) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in rows]])

    t, df = read(got["h"][lone], np.int64), read(got["n"][lone], np.int32)
    doc = np.concatenate([np.zeros(0, np.int64), *[unroll(x) for x in got["doc"][lone]]])
    if len(places):
        kinds, counts = read(got["h"][~lone], np.int64), read(got["n"][~lone], np.int32)
        order = np.argsort(kinds.view(np.uint64))
        at = order[np.frombuffer(places["n"].iloc[0], np.int32)]
        t, df = np.concatenate([t, kinds[at]]), np.concatenate([df, counts[at]])
        doc = np.concatenate([doc, unroll(places["doc"].iloc[0])])
    return t, doc, df


def shared_shingles(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Rows (node, id, n, f1, f2, own, common, toks, prefix), one for each row of `docs`: a number of its own, its id as text, its number
    of shingles, a fingerprint of their set, how many of them no other document has, in how many documents they are on average, the others in rare-first order
    (packed 64-bit hashes), and how many of these its prefix has. `toks` is null where the prefix holds none."""
    bits = spread(docs, 256).bit_length() - 1
    rows = stable(docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("body")))

    def local(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "key", "body"):
            yield pa.RecordBatch.from_pylist(sent_rows(b, size, bits), SENT_SCHEMA)

    def prefixes(group: pd.DataFrame) -> pd.DataFrame:
        head, rest = group[group["keys"].notna()].iloc[0], group[group["keys"].isna()]
        n, f1, f2 = (np.frombuffer(head[c], np.int64) for c in ("h", "doc", "n"))
        t, doc, df = answers(rest)
        order = np.lexsort((t, df, doc))
        t, doc, df = t[order], doc[order], df[order]
        have = np.bincount(doc, minlength=len(n))
        ends = np.cumsum(have)
        take = np.clip(prefix_length(n, percent) - (n - have), 0, have)
        toks = [t[e - c: e].tobytes() if k else None for e, c, k in zip(ends, have, take, strict=True)]
        # a batch has fewer than 2^16 documents, and its number leaves 16 bits free
        node = (int(head["batch"]) << 16) + np.arange(len(n))
        return pd.DataFrame({"node": node, "id": pd.Series(list(head["keys"]), dtype=object), "n": n, "f1": f1, "f2": f2,
                             "own": n - have, "common": (np.bincount(doc, df, len(n)) + n - have) / np.maximum(n, 1), "toks": pd.Series(toks, dtype=object), "prefix": take.astype(np.int32)})

    sent = rows.mapInArrow(local, SENT_FIELDS)
    counted = sent.groupBy("bucket").applyInPandas(lambda group: count_bucket(group, bits), "batch long, keys array<string>, h binary, doc binary, n binary")
    return counted.groupBy("batch").applyInPandas(
        prefixes, "node long, id string, n long, f1 long, f2 long, own long, common double, toks binary, prefix int")


def postings(sets: DataFrame) -> DataFrame:
    """(tok, id, n, at, common): the prefix of each set's shared shingles, with their rare-first position among all of its
    shingles, and in how many documents these are on average."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            toks = [np.frombuffer(t, np.int64)[:p] for t, p in zip(f["toks"], f["prefix"], strict=True)]
            size = [len(t) for t in toks]
            if size:
                yield pd.DataFrame({"tok": np.concatenate(toks), "id": np.repeat(f["id"].to_numpy(), size), "n": np.repeat(f["n"].to_numpy(), size),
                                    "at": np.concatenate([own + np.arange(s) for own, s in zip(f["own"], size, strict=True)]),
                                    "common": np.repeat(f["common"].to_numpy(), size)})

    return sets.mapInPandas(unpack, "tok long, id long, n long, at long, common double")


def alike(a: Column, b: Column, percent: int) -> Column:
    """The length filter."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of two sets of these sizes at the similarity."""
    return -(-percent * (na + nb) // (100 + percent))


def overlaps(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether two sorted sets share `least` members. The suffix filter first: split at a few of a's members, both sides
    can share no more than the smaller part of each range."""
    if len(a) > 32:
        marks = a[len(a) // 8:: len(a) // 8]
        pa, pb = (np.diff(np.concatenate([[0], np.searchsorted(x, marks), [len(x)]])) for x in (a, b))
        if np.minimum(pa, pb).sum() < least:
            return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: each pair meets the two sets once."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    met = pairs.join(one, "a").join(two, "b")

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kept, held = [], (None, None)
            least = needed(f["na"].to_numpy(), f["nb"].to_numpy(), percent)
            for a, ta, tb, k in zip(f["a"], f["ta"], f["tb"], least, strict=True):
                if held[0] != a:
                    held = (a, np.sort(np.frombuffer(ta, np.int64)))
                kept.append(overlaps(held[1], np.sort(np.frombuffer(tb, np.int64)), k))
            yield f.loc[kept, ["a", "b"]] if len(f) else f[["a", "b"]]

    return met.mapInPandas(test, "a long, b long")


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) over the distinct sets `sets` (id, n, own, common, toks, prefix; `id` is a node), for those that link with another.

    First every posting list's members of about one length are paired with a hub of the list: the one whose shingles are the
    commonest on average, as those of a text are that many near copies come from; so most groups of copies are joined by few pairs. Then
    all other pairs of a list are made whose members aren't in one component yet, and pass the length and positional filters; so no
    link between components is lost, and within one no pair is needed."""
    stratum = F.floor(F.log(F.col("n")) / np.log(100 / percent)).cast("int")
    listed = materialize(postings(sets).withColumn("stratum", stratum))
    hubs = listed.groupBy("tok", "stratum").agg(F.min(F.struct(-F.col("common"), "id", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    met = listed.join(hubs, ["tok", "stratum"]).where(F.col("id") != F.col("hub.id")).where(alike(F.col("n"), F.col("hub.n"), percent))
    first = materialize(met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct())
    joined = materialize(components(verify(first, sets, percent)))
    known = listed.join(joined, listed["id"] == joined["node"], "left").select("tok", "id", "n", "at", F.coalesce("component", "id").alias("c"))
    open_ = known.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("tok")
    known = materialize(known.join(open_, "tok", "left_semi"))
    # a long list is cut into pieces, and each piece meets each, so that no task has a whole long list
    pieces = known.groupBy("tok").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    known = known.join(pieces, "tok").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    left = known.select("tok", F.col("piece").alias("p1"), each.alias("p2"), *[F.col(x).alias(f"{x}1") for x in ("id", "n", "at", "c")])
    right = known.select("tok", each.alias("p1"), F.col("piece").alias("p2"), *[F.col(x).alias(f"{x}2") for x in ("id", "n", "at", "c")])
    bound = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    enough = bound * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))
    # for the first shingle that both have, no more than what follows on either side can be common; a pair passes by it
    rest = (left.join(right, ["tok", "p1", "p2"]).where(F.col("id1") < F.col("id2")).where(F.col("c1") != F.col("c2"))
            .where(alike(F.col("n1"), F.col("n2"), percent)).where(enough)
            .select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct())
    more = verify(rest.join(first, ["a", "b"], "left_anti"), sets, percent)
    return components(joined.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Rows (key, n_shingles, component_id), one for each row of `docs`: the size of its set of `size`-word shingles, and
    the smallest id reachable by links, where two documents link if their sets' intersection is at least `percent` percent
    of their union.

    Words are runs without ASCII white space, with A-Z lower-cased; a text of fewer words is one shingle as a whole; a null
    text, or one without words, has an empty set and links with nothing, so its component is its own id. Equal sets (copies)
    share their class's links. Rows that share an id are one document with several texts: what links with any of them is
    in its component. Null ids link nothing and get a null component. Ids may be of any type that has a text form and an order.
    Very long texts are read whole; an empty table gives an empty result; other columns aren't read. Each row is a node of its
    own, and so is what is compared, so a table that isn't read from files is written down first.
    """
    kind = docs.schema[key].dataType
    found = materialize(shared_shingles(docs, key, text, size, percent))
    named = found.where("id IS NOT NULL")
    classes = named.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("node").alias("first"), F.count("*").alias("m"))
    sets = named.where("toks IS NOT NULL").join(classes.select(F.col("first").alias("node"), "n", "f1", "f2"), ["node", "n", "f1", "f2"], "left_semi")
    linked = links(materialize(sets.select(F.col("node").alias("id"), "n", "own", "common", "toks", "prefix")), percent)
    copies = classes.where("m > 1").withColumnsRenamed({"n": "n_", "f1": "f1_", "f2": "f2_"})
    rows = named.select("node", "id", "n", "f1", "f2")
    rows = rows.join(copies, (F.col("n") == F.col("n_")) & (F.col("f1") == F.col("f1_")) & (F.col("f2") == F.col("f2_")), "left")
    rows = materialize(rows.select("node", F.col("id").cast(kind).alias("id"), "n", F.coalesce("first", "node").alias("class")))
    # the classes of one id's rows are tied; few ids have several rows
    tied = rows.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a != z").select("id", "a")
    ties = rows.join(tied, "id").where("a != class").select("a", F.col("class").alias("b")).distinct()
    if ties.limit(1).count():
        linked = components(linked.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(ties))
    linked = materialize(linked)
    placed = rows.join(linked.withColumnRenamed("node", "class"), "class", "left").select(
        "id", "n", "class", F.coalesce("component", "class").alias("component"))
    least = placed.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("m"))
    whole = placed.join(least.where("m > 1").select("component", "least"), "component", "left").select(
        "id", "n", F.coalesce("least", "id").alias("c"))
    lone = found.where("id IS NULL").select(F.lit(None).cast(kind).alias("id"), "n", F.lit(None).cast(kind).alias("c"))
    return whole.unionByName(lone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each group of linked ones, that of the smallest id; of rows that share an id one stays.
    Rows without an id stay, null, empty and very long texts count as in `join_documents`, and an empty table stays empty. All
    columns stay as they are."""
    found = materialize(join_documents(docs, key, text, size, percent))
    kept = without(docs, found.where(F.col(key) != F.col("component_id")).select(key).distinct(), key)
    again = found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    if again.limit(1).count() == 0:
        return kept
    return without(kept, again, key).unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]).select(kept.columns))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE ws AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s
  FROM ws, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.node)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(node) AS component_id
FROM reach r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""
