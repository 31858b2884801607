"""Benchmark decontamination with a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.storage import key_bitmap, keep_possible, without_keys, written
from attestra.llm.text import NOT_WORD, ascii_lower, or_empty

#: Words of a window.
WINDOW = 13
#: Rows of the n-gram set that may be broadcast (some 60 MB); a larger set meets the documents in a shuffled join.
BROADCAST_ROWS = 400_000


def words(c: Column) -> Column:
    """Lower-case words of letters, digits and non-ASCII characters, in order."""
    return F.filter(F.split(ascii_lower(or_empty(c)), NOT_WORD), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(or_empty(c), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")


def _grams(words_col: str, sizes: list[int]) -> Column:
    """Array of (start, size, gram) of the windows of each size, start from 0."""
    one = [
        f"""IF(size({words_col}) >= {m}, transform(sequence(0, greatest(size({words_col}), {m}) - {m}),
            i -> struct(i AS start, {m} AS size, array_join(slice({words_col}, i + 1, {m}), ' ') AS gram)),
            cast(array() AS array<struct<start:int,size:int,gram:string>>))"""
        for m in sizes
    ]
    return F.expr(f"concat({', '.join(one)})" if len(one) > 1 else one[0])


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (gram, size, item_id): an item's windows, or the whole item where it is shorter than a window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    long = items.filter(F.size("w") >= window).select("item_id", F.explode(_grams("w", [window])).alias("g"))
    short = items.filter(F.size("w") < window).select(
        "item_id", F.struct(F.lit(0).alias("start"), F.size("w").alias("size"), F.array_join("w", " ").alias("gram")).alias("g")
    )
    return long.unionByName(short).select("g.gram", "g.size", "item_id").distinct()


def _anchored(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Rows (doc_id, text_hash, text) of docs that may hold a window: all that do, and few others.

    Of the words of a window of m, each run of g = (m + 1) // 2 is an anchor. Wherever a window stands in a text, an
    anchor of it starts at a multiple of m - g + 1, so texts are looked up at those places alone.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    marked = texts.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    looked, known = [], []
    for m in sizes:
        g = (m + 1) // 2
        step = m - g + 1
        looked.append(
            f"IF(size(w) >= {m}, transform(sequence(0, greatest(size(w) - {g}, 0) div {step}), "
            f"i -> concat('{g} ', array_join(slice(w, i * {step} + 1, {g}), ' '))), cast(array() AS array<string>))"
        )
        own = grams.filter(F.col("size") == m).select(F.split("gram", " ").alias("w"))
        known.append(own.select(F.explode(F.expr(f"transform(sequence(0, {m - g}), i -> concat('{g} ', array_join(slice(w, i + 1, {g}), ' ')))")).alias("anchor")))
    anchors = known[0]
    for k in known[1:]:
        anchors = anchors.unionByName(k)
    anchors = written(anchors.distinct(), "bench-anchors")
    at = F.expr(f"concat({', '.join(looked)})" if len(looked) > 1 else looked[0])
    hint = "broadcast" if anchors.count() <= BROADCAST_ROWS else "merge"
    hit = marked.select("doc_id", "text_hash", F.explode(at).alias("anchor")).join(anchors.hint(hint), "anchor", "left_semi")
    keys = hit.select(F.xxhash64("doc_id", "text_hash").alias("h"))
    bitmap = written(key_bitmap(keys, "h"), "bench-bitmap")
    return keep_possible(texts.withColumn("h", F.xxhash64("doc_id", "text_hash")), "h", bitmap).drop("h")


def contamination_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, spans, items) of the documents in which a benchmark window occurs.

    spans: (start, size) in words, distinct; items: item ids, distinct, as sorted strings. A first pass looks texts up in a broadcast hash
    set of anchors, at a few places each; a second one scans all windows of those that passed and compares the grams
    themselves, so every hit is verified. Only hits are shuffled, never windows. Both sets are broadcast after their
    rows are counted; over BROADCAST_ROWS they are joined by a shuffle instead.
    """
    grams = written(benchmark_grams(benchmark, window), "bench-grams")
    by_gram = written(grams.select("gram").distinct(), "bench-set")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most `window` values
    n = by_gram.count()
    passed = _anchored(docs, grams, sizes or [window])
    texts = passed.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    windows = texts.select("doc_id", "text_hash", F.explode(_grams("w", sizes or [window])).alias("g"))
    windows = windows.select("doc_id", "text_hash", "g.start", "g.size", "g.gram")
    hits = windows.join(by_gram.hint("broadcast" if n <= BROADCAST_ROWS else "merge"), "gram")
    hits = written(hits, "bench-hits")
    spans = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    items = hits.select("doc_id", "text_hash", "gram").distinct().join(grams.select("gram", "item_id").distinct().hint("merge"), "gram")
    items = items.select("doc_id", "text_hash", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("item")).alias("items")).toDF("item_doc", "item_hash", "items")
    same = (F.col("text_hash") == F.col("item_hash")) & F.col("doc_id").eqNullSafe(F.col("item_doc"))
    return spans.join(items.hint("merge"), same).select("doc_id", "text_hash", "spans", "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and text_hash).

    A document word inside any occurrence of a benchmark window is hit; a document is contaminated when a twentieth of
    its words or more is hit. Null and empty texts have no words and no hits; items without words have no window. Rows
    that repeat a doc_id with another text are judged apart, equal rows get equal results. An empty benchmark
    contaminates nothing; an empty table gives an empty result.
    """
    hits = contamination_hits(docs, benchmark, window)
    positions = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    hits = hits.select(
        "doc_id",
        "text_hash",
        F.size(F.array_distinct(positions)).cast("long").alias("hit"),
        F.col("items").alias("ids"),
    )
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("n_words"))
    same = (base["text_hash"] == hits["text_hash"]) & base["doc_id"].eqNullSafe(hits["doc_id"])
    out = base.join(hits.hint("merge"), same, "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select(
        base["doc_id"],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        base["text_hash"],
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones, all columns."""
    bad = contamination_report(docs, benchmark, window).filter("contaminated").select("doc_id", "text_hash").distinct()
    return without_keys(docs, [F.col("doc_id"), F.xxhash64("text")], bad)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, clean_words): the words of each text without those that are hit, joined by a space."""
    hits = contamination_hits(docs, benchmark, window)
    positions = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), positions.alias("at"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    out = keyed.join(hits.hint("merge"), (F.col("text_hash") == F.col("hit_hash")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    kept = F.expr(
        "CASE WHEN size(w) = 0 THEN w WHEN at IS NULL THEN w "
        "ELSE transform(array_except(sequence(0, greatest(size(w), 1) - 1), at), i -> w[i]) END"
    )
    return out.select("doc_id", F.array_join(kept, " ").alias("clean_words"))


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bg),
dg AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
h AS (SELECT doc_id, dg.m, i, item_id FROM dg JOIN bg ON dg.gram = bg.gram AND dg.m = bg.m),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS s FROM h) GROUP BY doc_id)
SELECT dw.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
