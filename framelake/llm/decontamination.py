"""Benchmark decontamination by a positional inverted index, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import ascii_lower, materialize, table, without

#: What separates words before A-Z are lower-cased: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Benchmark-side tables are broadcast up to so many rows (some 100 bytes a row); beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000
#: Up to so many indexed terms are part of the scan's expression; beyond it they are joined.
INLINE_TERMS = 20_000
#: How many of a window's rarest terms have their lists intersected before a document is looked at.
LISTS = 3


def words(text: Column) -> Column:
    """The words of a text before lower-casing; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(terms, items): each distinct window of consecutive item words with the ids of the items that hold it."""
    listed = items.select(F.col(item_id).cast("string").alias("item"),
                          F.transform(words(F.col(text)), ascii_lower).alias("ws")).where(F.size("ws") > 0)
    cut = listed.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1)),
        lambda i: F.slice(F.col("ws"), i, window))).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set("item").alias("items"))


def index_postings(docs: DataFrame, terms: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The stored positional index (term, doc, body, at) of `terms` (term): a row for each place where one of them stands in a
    document; `body` is a hash of the text, as rows may share an id."""
    listed = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("body"), words(F.col(text)).alias("ws"))
    if terms.count() <= INLINE_TERMS:
        wanted = [r.term for r in terms.collect()]
        # exploding a word array copies the whole row for every word, so the few indexed places are picked first
        places = F.filter(F.transform("ws", lambda w, i: F.struct(ascii_lower(w).alias("term"), i.alias("at"))),
                          lambda p: p["term"].isin(wanted) if wanted else F.lit(False))
        return materialize(listed.select("doc", "body", F.explode(places).alias("p")).select("p.term", "doc", "body", "p.at"))
    at = listed.select("doc", "body", F.posexplode("ws").alias("at", "word")).withColumn("term", ascii_lower(F.col("word")))
    return materialize(at.join(terms, "term", "left_semi").select("term", "doc", "body", "at"))


def rarest_terms(windows: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(window, offset, term, others): for each window whose terms all occur in the corpus, its rarest term with its first offset, and
    the next ones, at most lists - 1, as (term, offset from the rarest one's)."""
    placed = windows.select("window", F.posexplode("terms").alias("offset", "term")).groupBy("window", "term").agg(F.min("offset").alias("offset"))
    counted = placed.join(counts, "term", "left").select("window", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "offset").alias("t"))
    few = counted.groupBy("window").agg(F.slice(F.array_sort(F.collect_list("t")), 1, lists).alias("ts")).where("ts[0].n > 0")
    first = F.col("ts")[0]
    others = F.transform(F.slice("ts", 2, lists), lambda t: F.struct(t["term"].alias("term"), (t["offset"] - first["offset"]).alias("shift")))
    return few.select("window", first["offset"].alias("offset"), first["term"].alias("term"), others.alias("others"))


def intersect_lists(postings: DataFrame, rarest: DataFrame, window: int) -> DataFrame:
    """(doc, body, at, window, offset, aligned): the places of each window's rarest term that the lists of its next terms allow. `aligned` says that
    each of these stands at its own offset from the rarest one, as in a phrase: the lists, less their offsets, intersect there. The other
    places have each of them less than `window` words away, as a match in proximity needs. Lists meet by document, term and stretch of positions,
    so a term that a document repeats very often is no large group."""
    small = rarest.count() <= BROADCAST_ROWS
    spots = postings.join(F.broadcast(rarest) if small else rarest, "term").select("doc", "body", "at", "window", "offset", "others")
    lone, wanting = spots.where(F.size("others") == 0), spots.where(F.size("others") > 0)
    stretch = lambda at: F.floor(at / window).cast("int")
    asked = wanting.select("doc", "body", "at", "window", "offset", F.size("others").alias("need"), F.explode("others").alias("o"))
    asked = asked.select("doc", "body", F.col("at").alias("from"), "window", "offset", "need", F.col("o.term").alias("term"), F.col("o.shift").alias("shift"),
                         F.explode(F.sequence(stretch(F.col("at") - window + 1), stretch(F.col("at") + window - 1))).alias("stretch"))
    given = postings.select(F.col("doc").alias("doc_"), F.col("body").alias("body_"), F.col("term").alias("term_"), "at", stretch(F.col("at")).alias("stretch_"))
    apart = F.col("at") - F.col("from")
    met = asked.join(given, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("body") == F.col("body_")) & (F.col("term") == F.col("term_"))
                     & (F.col("stretch") == F.col("stretch_")) & (F.abs(apart) < window))
    placed = F.count_distinct(F.when(apart == F.col("shift"), F.col("term")))
    all_ = met.groupBy("doc", "body", "from", "window", "offset", "need").agg(F.count_distinct("term").alias("n"), placed.alias("placed")).where("n = need")
    return lone.select("doc", "body", "at", "window", "offset", F.lit(True).alias("aligned")).union(
        all_.select("doc", "body", "from", "window", "offset", F.col("placed") == F.col("need")))


def find_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc, body, start, length, items, near_items): the phrase occurrences of benchmark windows (start, length
    and `items` set) and the proximity matches (`near_items`: all terms of a window within window - 1 words of its
    rarest one, in any order, without the phrase there).

    The corpus counts of all benchmark terms tell each window's rarest ones; their postings are stored, and offset-adjusted lists
    are intersected from the rarest on. What is left, passages where offsets agree and near ones, is checked against the few documents' words. Windows
    go by their number until then; the items that hold them are looked up last.
    """
    windows = materialize(benchmark_windows(items, item_id, item_text, window).withColumn("window", F.md5(F.array_join("terms", " ").cast("binary"))))
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    n_windows = windows.count()
    tokens = docs.select(F.explode(words(F.col(text))).alias("word")).select(ascii_lower(F.col("word")).alias("term"))
    counts = tokens.join(_small(vocabulary, n_windows * window), "term").groupBy("term").count()
    rarest = materialize(rarest_terms(windows, counts))
    indexed = rarest.select("term").union(rarest.select(F.explode("others.term"))).distinct()
    left = intersect_lists(index_postings(docs, materialize(indexed), doc_id, text), rarest, window)
    spots = materialize(left.join(windows, "window").groupBy(F.col("doc").alias("doc_"), F.col("body").alias("body_")).agg(
        F.collect_list(F.struct("at", "offset", "aligned", "terms", "window")).alias("spots")))
    listed = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("body"), words(F.col(text)).alias("ws"))
    # the few documents first, by their keys alone; only these meet their lists of places
    same = F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("body") == F.col("body_"))
    few = listed.join(_small(spots.select("doc_", "body_"), spots.count()), same, "left_semi")
    held = few.join(spots, same).drop("doc_", "body_")

    def phrase(t: Column) -> Column:
        start = t["at"] - t["offset"]
        return t["aligned"] & (start >= 0) & (F.transform(F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.size(t["terms"])), ascii_lower) == t["terms"])

    def nearby(t: Column) -> Column:
        first = F.greatest(F.lit(0), t["at"] - (window - 1))
        return F.size(F.array_except(t["terms"], F.transform(F.slice("ws", first + 1, t["at"] - first + window), ascii_lower))) == 0

    tested = held.select(
        "doc", "body",
        F.transform(F.filter("spots", phrase), lambda t: F.struct(
            (t["at"] - t["offset"]).alias("start"), F.size(t["terms"]).alias("length"), t["window"].alias("window"))).alias("hits"),
        F.array_distinct(F.transform(F.filter("spots", lambda t: ~phrase(t) & nearby(t)), lambda t: t["window"])).alias("near"))
    tested = materialize(tested.where((F.size("hits") > 0) | (F.size("near") > 0)))
    named, none = _small(windows.select("window", "items"), n_windows), F.array().cast("array<string>")
    hits = tested.select("doc", "body", F.explode("hits").alias("hit")).select("doc", "body", "hit.*").join(named, "window")
    near = tested.select("doc", "body", F.explode("near").alias("window")).join(named, "window")
    nowhere = F.lit(None).cast("int")
    return hits.select("doc", "body", "start", "length", "items", none.alias("near_items")).unionByName(
        near.select("doc", "body", nowhere.alias("start"), nowhere.alias("length"), none.alias("items"), F.col("items").alias("near_items")))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near), one for each document row.

    `n_hit` counts document words inside any occurrence of a benchmark window (overlaps once), `n_items` the items
    with an occurring window, `items_sha256` hashes their ids, `n_near` counts items matched in proximity only. Null
    and empty texts have no words; an item without words has no window, one shorter than the window is one window;
    repeated rows (same id and text) each get the same counts; rows that share an id but not the text are kept apart;
    null ids are kept; empty tables give no matches; other columns aren't read, so clashing names don't matter.
    """
    matches = materialize(find_matches(docs, items, doc_id, text, item_id, item_text, window))
    inside = (matches.where(F.col("start").isNotNull())
              .select("doc", "body", F.explode(F.expr("sequence(start, start + length - 1)")).alias("word_at"))
              .distinct().groupBy("doc", "body").agg(F.count("*").alias("n_hit")))
    held = (matches.select("doc", "body", F.explode("items").alias("item")).distinct()
            .groupBy("doc", "body").agg(F.array_sort(F.collect_list("item")).alias("held")))
    near = (matches.where(F.size("near_items") > 0).select("doc", "body", F.explode("near_items").alias("item")).distinct()
            .groupBy("doc", "body").agg(F.collect_list("item").alias("near")))
    parts = (inside.withColumns({"held": F.lit(None).cast("array<string>"), "near": F.lit(None).cast("array<string>")})
             .unionByName(held.withColumns({"n_hit": F.lit(None).cast("long"), "near": F.lit(None).cast("array<string>")}))
             .unionByName(near.withColumns({"n_hit": F.lit(None).cast("long"), "held": F.lit(None).cast("array<string>")})))
    facts = parts.groupBy("doc", "body").agg(F.max("n_hit").alias("n_hit"), F.first("held", True).alias("held"),
                                             F.first("near", True).alias("near"))
    facts = facts.withColumnsRenamed({"doc": "~doc", "body": "~body"})
    rows = docs.select(F.col(doc_id).alias(doc_id), F.xxhash64(F.col(text)).alias("~b"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    held_ids = F.coalesce("held", F.array().cast("array<string>"))
    return rows.join(facts, F.col(doc_id).eqNullSafe(F.col("~doc")) & (F.col("~b") == F.col("~body")), "left").select(
        doc_id, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(held_ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", held_ids).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.size(F.array_except(F.coalesce("near", F.array().cast("array<string>")), held_ids)).cast("long").alias("n_near"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without those that hold a benchmark window; all columns stay as they are, and so do rows without an id. Null and empty
    texts hold none and stay, long ones are read whole, rows that share an id go together, an empty table stays empty."""
    found = find_matches(docs, items, doc_id, text)
    return without(docs, found.where("start IS NOT NULL AND doc IS NOT NULL").select(F.col("doc").alias(doc_id)).distinct(), doc_id)


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_near")


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS win
  FROM bw, LATERAL (SELECT unnest(range(1, greatest(2, len(ws) - 8))) AS i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i) WHERE len(ws) >= n),
hits AS (SELECT s.doc_id, s.i, s.n, w.item_id FROM spots s JOIN wins w USING (n, win)),
inside AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN inside USING (doc_id) LEFT JOIN held USING (doc_id)
"""
