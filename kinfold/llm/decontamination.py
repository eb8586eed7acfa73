"""Benchmark decontamination over a positional inverted index (operator 4). Only DataFrame functions.

1. The benchmark's items become windows (`width` consecutive words; an item of fewer words is one window).
2. Corpus counts of the benchmark's terms, over all documents, rank the terms of each window by how rare they are.
3. The index stores a posting (term, document, position) for each occurrence of a term that is among the LISTS rarest of
   some window; postings of a window's rarest term have the words up to `radius` places around them as payload. One
   posting of the empty term at the document's end holds its length.
4. A window's start is a posting's position less the term's offset in the window. The starts that the rarest term's list
   gives are intersected with the lists of the next rarest terms, adjusted by their offsets, one after another; what is
   left has all LISTS terms in place, and the payload says whether the window's other words are there too: exact phrases,
   which is what `report` and the query count. `near` instead asks that all terms of a window lie within `width + slop`
   consecutive places around its rarest term, in any order: proximity matches. `matches` returns both kinds; the query
   and the pipeline count exact phrases only. The commonest terms of a window have no lists: their postings would be most of the
   corpus, and the payload holds them where they count.

Postings of one common term spread over partitions as the documents do; what is grouped afterwards is grouped
by document. No list is capped. Terms and windows come from the benchmark and are broadcast up to BROADCAST_ROWS
rows, joined by a shuffle beyond.

Defined results: null and empty texts have no words; an empty benchmark hits nothing, and empty documents give an empty
table; texts of any length are read whole; of windows with equally rare terms the first offset is taken, which
changes no result; documents are told apart by doc_id and a hash of their text,
so a repeated row has a result of its own; an item whose text repeats another's counts as an item of its own;
items with a null item_id count in n_items as one item and are written as an empty string; further columns of
either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ascii_lower, fenced_words, fits, small, text_of, words, written

WIDTH, LISTS = 8, 2


def windows_of(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, gram): the windows of each item, distinct."""
    w = items.select(items[id_col].cast("string").alias("item_id"), words(text_of(items, text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, width))).alias("gram")).distinct()


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each word of each document and for the empty term at its end; pos counts from 1.

    Only the words are lower-cased, one by one: most are ASCII, for which that is cheap. A 64-bit hash of the term
    is the join key: Spark has a faster table for such keys, and a collision only adds a posting, which the
    comparison of whole windows rejects. explode_outer() because explode() would make Spark split each text twice."""
    text = text_of(docs, text_col)
    each = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("h"), fenced_words(text).alias("w"))
    each = each.select("doc_id", "h", "w", F.posexplode_outer("w").alias("pos", "term"))
    return each.withColumn("t", F.xxhash64(ascii_lower(F.col("term")))).where("pos > 0")


def anchored(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, t, off, more): each distinct window with its rarest term by counts over all docs, that term's offset, and the
    (t, off) of its next rarest terms: LISTS - 1 of them, the rarest again where a window has too few words."""
    grams = grams.select("gram").distinct()
    at = grams.select("gram", F.posexplode("gram").alias("off", "term")).withColumn("t", F.xxhash64("term"))
    terms, tokens = at.select("t").distinct(), _tokens(docs, id_col, text_col).select("t")
    # terms too many to broadcast meet counts, not occurrences
    counts = tokens.join(F.broadcast(terms), "t").groupBy("t").count() if fits(terms) else tokens.groupBy("t").count().join(terms, "t")
    ranked = F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "off", "t"))).alias("r")  # of a window's words
    by = at.join(counts, "t", "left").groupBy("gram").agg(ranked)
    more = F.array(*(F.coalesce(F.try_element_at("r", F.lit(k + 1)), F.element_at("r", 1)) for k in range(1, LISTS)))
    return by.select("gram", F.col("r")[0]["t"].alias("t"), F.col("r")[0]["off"].alias("off"), F.transform(more, lambda x: F.struct(x["t"].alias("t"), x["off"].alias("off"))).alias("more"))


def build_index(docs: DataFrame, lists: DataFrame, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (t, end, doc_id, h, pos, from, around) of the terms in `lists`, and of the empty term at each
    document's end.

    pos counts from 0 here; t is the term's hash; around holds the words, as written, from place `from` on, where the term
    is the rarest of a window, and is null elsewhere."""
    end = docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("t"), F.lit(True).alias("end"), F.lit(False).alias("rarest"))
    terms = lists.select("t", F.lit(True).alias("rarest")).union(lists.select(F.explode("more.t"), F.lit(False)))
    listed = terms.groupBy("t").agg(F.max("rarest").alias("rarest")).select("t", F.lit(False).alias("end"), "rarest").union(end)
    first = F.greatest(F.lit(1), F.col("pos") - radius)
    around = F.slice(F.col("w"), first + 1, F.least(F.col("pos") + radius, F.size("w") - 2) - first + 1)
    tokens = _tokens(docs, id_col, text_col)
    if fits(listed):
        postings = tokens.join(F.broadcast(listed), "t")
    else:  # what is shuffled has its neighbours beside it, not its whole document
        postings = tokens.select("t", "doc_id", "h", "pos", first.alias("_first"), around.alias("_around")).join(listed, "t")
        first, around = F.col("_first"), F.col("_around")
    postings = postings.select(
        "t", "end", "doc_id", "h", (F.col("pos") - 1).alias("pos"), F.when(F.col("rarest"), first - 1).alias("from"),
        F.when(F.col("rarest"), around).alias("around"),
    )
    return written(postings, "postings")


def _placed(index: DataFrame, lists: DataFrame) -> DataFrame:
    lower = index.where("around IS NOT NULL").withColumn("around", F.transform("around", ascii_lower))
    return lower.join(small(lists), "t")


def exact(index: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, h, gram, start, m): every occurrence of a window."""
    start = F.col("pos") - F.col("off")
    at = _placed(index, lists).withColumn("start", start).where((F.col("start") >= F.col("from")))
    postings = index.where("NOT end").select(F.col("t").alias("p_t"), F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), F.col("pos").alias("p_pos"))
    for k in range(LISTS - 1):
        term = F.col("more")[k]
        there = (term["t"] == F.col("p_t")) & F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")) & (F.col("start") + term["off"] == F.col("p_pos"))
        at = at.join(postings, there, "left_semi")
    hit = F.slice(F.col("around"), F.col("start") - F.col("from") + 1, F.size("gram")) == F.col("gram")
    return at.where(hit).select("doc_id", "h", "gram", "start", F.size("gram").alias("m"))


def near(index: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """(doc_id, h, gram, start): windows all of whose terms lie within len(gram) + slop places from start, around the rarest term.

    The index needs a radius of at least len(gram) - 1 + slop."""
    at = _placed(index, lists).where(F.size(F.array_except("gram", "around")) == 0)
    span = F.size("gram") + slop
    rel = F.col("pos") - F.col("from")
    firsts = F.sequence(F.greatest(F.lit(0), rel - span + 1), rel)
    fits = F.filter(firsts, lambda s: F.size(F.array_except(F.col("gram"), F.slice(F.col("around"), s + 1, span))) == 0)
    return at.withColumn("fits", fits).where(F.size("fits") > 0).select("doc_id", "h", "gram", (F.col("from") + F.element_at("fits", 1)).alias("start"))


def _report(docs: DataFrame, items: DataFrame, width: int, min_items: int) -> DataFrame:
    """What `report` returns, and h, the hash of the text."""
    grams = written(windows_of(items, width), "windows")
    lists = written(anchored(docs, grams), "anchors")
    index = build_index(docs, lists, width - 1)
    hits = exact(index, lists)
    key = ["doc_id", "h"]
    end = F.col("start") + F.col("m")
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy(*key, "start").agg(F.max("m").alias("m"))
    n_hit = (
        spans.select(*key, F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))).alias("new"))
        .groupBy(*key)
        .agg(F.sum("new").alias("n_hit"))
    )
    found = hits.select(*key, "gram").distinct().join(small(grams), "gram").select(*key, F.coalesce("item_id", F.lit("")).alias("item_id"))
    n_items = found.groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    hit = n_hit.join(n_items, [n_hit[k].eqNullSafe(n_items[k]) for k in key]).select(n_hit["doc_id"].alias("k_id"), n_hit["h"].alias("k_h"), "n_hit", "ids")
    rows = index.where("end").select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(hit, rows["doc_id"].eqNullSafe(hit["k_id"]) & (rows["h"] == hit["k_h"]), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", rows["h"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (F.size(ids) >= min_items).alias("contaminated"),
    )


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, min_items: int = 2) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs."""
    return _report(docs, items, width, min_items).drop("h")


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 2) -> DataFrame:
    """(doc_id, item_id, gram, start, kind): where windows occur. kind `exact`: as a phrase, from word `start` on; `near`:
    around one of their rarest terms, all of the window's terms lie within len(gram) + slop words from `start` on."""
    grams = written(windows_of(items, width), "windows")
    lists = written(anchored(docs, grams), "anchors")
    index = build_index(docs, lists, width - 1 + slop)
    kinds = [df.select("doc_id", "gram", "start", F.lit(kind).alias("kind")) for kind, df in (("exact", exact(index, lists)), ("near", near(index, lists, slop)))]
    return kinds[0].unionAll(kinds[1]).distinct().join(small(grams), "gram").select("doc_id", "item_id", "gram", "start", "kind")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", width: int = WIDTH, min_items: int = 2) -> DataFrame:
    """The rows of docs in which windows of fewer than min_items items occur, with all their columns.

    Rows are found again by a 64-bit hash of doc_id and text, so a clean row stays whatever other rows share its doc_id."""
    of = docs.select(docs[id_col].alias("doc_id"), docs["text"])
    bad = _report(of, items, width, min_items).where("contaminated").select(F.xxhash64("doc_id", "h").alias("key")).distinct()
    return docs.join(bad, F.xxhash64(docs[id_col], F.xxhash64(text_of(docs))) == bad["key"], "left_anti")


#: For DuckDB, over documents and benchmark.
SQL = r"""
WITH i AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 7], ' ') AS gram, least(8, len(w)) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 6))) AS s FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS gram
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM g))
), h AS (SELECT p.doc_id, p.s, p.m, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.m = g.m),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
