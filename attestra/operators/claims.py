"""Text claims: wording features, scores, search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scores import clamp, clamp_score

# Patterns and phrases, all in lower case; a word pattern is bounded by characters that are no word's.
SOURCE_PATTERNS = ["https?://", r"(?:^|[^\p{L}\p{N}_])source:[\p{L}\p{N}_]"]
SOURCE_WORDS = ["according to", "reported by", "reuters", "associated press", "ap news", "bbc", "npr", "university", "policy group", "official"]
URGENCY = ["share now", "breaking", "they don't want you to know", "they dont want you to know", "before it gets deleted", "wake up", "urgent", "click this link now", "act now"]
FEAR = ["secretly", "cover-up", "cover up", "destroyed", "collapse", "invasion", "takeover", "deleted", "permanent suspension", "exposed"]
CONSPIRACY = ["the government does not want you to know", "mainstream media won't report", "hidden truth", "secret plan", "they are hiding"]
BALANCED = ["may", "could", "according", "reported", "study", "researchers", "evidence", "over time"]
PUBLIC = ["president", "government", "election", "war", "hospitals", "new york", "white house", "congress", "supreme court"]
EXTREME = ["secretly taken over", "guaranteed", "everyone is lying", "will be deleted", "permanent suspension", "100%", "proof", "exposed"]
STOP_WORDS = ["image", "photo", "picture", "upload", "uploaded", "screenshot", "chatgpt", "generated", "copy", "scan"]
DATES = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|20[0-9]{2}|19[0-9]{2}|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
PLACES = r"New York|California|Texas|Florida|United States|U\.S\.|UK|London|Washington|Europe|Asia"
NAMES = r"[A-Z][a-z]+(?:[ \t\n\r\f\x0b][A-Z][a-z]+)+"
WORD = r"[\p{L}\p{N}_]"


def bounded(pattern: str) -> str:
    """The pattern between characters that are no word's, in a form that all engines read alike."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{pattern})(?:$|[^\p{{L}}\p{{N}}_])"


def _any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def _hits(text: Column, phrases: list[str]) -> Column:
    return sum((F.contains(text, F.lit(p)).cast("int") for p in phrases[1:]), F.contains(text, F.lit(phrases[0])).cast("int"))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\r\f\x0b"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t\n\r\f\x0b]+")))


def claim_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and the features of each text; a null text is an empty one."""
    t = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    low = F.lower(t)
    # Each pattern is tried once over a text, and only where a first character fits. Words are split once, and only where two
    # capitals stand together: elsewhere no word is in capitals.
    sources = rf"(?:^|[^\p{{L}}\p{{N}}_])(?=[{''.join(sorted({w[0] for w in [*SOURCE_WORDS, 'source']}))}])(?:source:{WORD}|(?:{'|'.join(SOURCE_WORDS)})(?:$|[^\p{{L}}\p{{N}}_]))"
    details = rf"(?:^|[^\p{{L}}\p{{N}}_])(?=[0-9A-Z])(?:{DATES}|{PLACES}|{NAMES})(?:$|[^\p{{L}}\p{{N}}_])"
    words = F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Za-z]{2,}$"))
    caps = F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: w.rlike("^[A-Z]+$"))) / F.size(ws)).otherwise(F.lit(0.0))), 1)
    return docs.select(
        "doc_id",
        (F.contains(low, F.lit("http://")) | F.contains(low, F.lit("https://")) | low.rlike(sources)).alias("has_source"),
        _any(low, URGENCY).alias("has_urgency"), _hits(low, FEAR).alias("fear_hits"), _hits(low, CONSPIRACY).alias("conspiracy_hits"),
        _any(low, BALANCED).alias("has_balanced"), _any(low, PUBLIC).alias("has_public"), _any(low, EXTREME).alias("has_extreme"),
        (F.char_length(t) - F.char_length(F.replace(t, F.lit("!"), F.lit("")))).alias("exclamations"),
        F.when(t.rlike("[A-Z][A-Z]"), caps).otherwise(F.lit(0.0)).alias("caps_ratio"),
        t.rlike(details).alias("has_details"),
        word_count(t).alias("word_count"),
    )


def claim_score(features: DataFrame) -> DataFrame:
    """(doc_id, score, risk_level, language_risk, claim_risk, manipulation_risk)."""
    f = {c: F.col(c) for c in features.columns}
    plus = lambda c, v: F.when(c, v).otherwise(0)
    fear = (f["fear_hits"] > 0) | (f["conspiracy_hits"] > 0)
    score = (
        F.lit(75) + F.when(f["has_source"], 5).otherwise(-10) + plus(f["has_balanced"], 5) + plus(f["has_details"], 5)
        + plus(~f["has_urgency"] & (f["fear_hits"] == 0) & (f["exclamations"] <= 1), 5) + plus(f["caps_ratio"] > 0.18, -8) + plus(f["has_urgency"], -8)
        + plus(~f["has_source"] & f["has_extreme"], -12) + plus(fear, -10) + plus(f["exclamations"] >= 3, -5) + plus(f["has_public"] & ~f["has_source"], -8) + plus(f["word_count"] < 10, -5)
    )
    language = 15.0 + F.least(F.lit(30.0), f["caps_ratio"] * 100) + F.least(F.lit(20.0), f["exclamations"] * 4.0) + plus(f["has_urgency"], 18.0) + F.least(F.lit(18.0), f["fear_hits"] * 6.0) + F.least(F.lit(18.0), f["conspiracy_hits"] * 9.0)
    claim = 25.0 + plus(f["word_count"] < 10, 15.0) + plus(~f["has_source"], 22.0) + plus(f["has_public"], 16.0)
    moved = 12.0 + plus(f["has_urgency"], 24.0) + F.least(F.lit(24.0), f["fear_hits"] * 8.0) + F.least(F.lit(24.0), f["conspiracy_hits"] * 12.0) + F.least(F.lit(16.0), f["exclamations"] * 3.0)
    whole = clamp_score(score)
    return features.select(
        "doc_id", whole.alias("score"), risk_level(whole).alias("risk_level"),
        F.round(clamp(language, 0, 100), 6).alias("language_risk"), clamp(claim, 0, 100).alias("claim_risk"), clamp(moved, 0, 100).alias("manipulation_risk"),
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "High Trust").when(score >= 60, "Medium Trust").when(score >= 40, "Low Trust").otherwise("High Risk")


def risk_verdict(score: Column) -> Column:
    return F.when(score >= 80, "Likely trustworthy").when(score >= 60, "Needs light verification").when(score >= 40, "Suspicious / verify before sharing").otherwise("Do not share until verified")


def web_blend(base: Column, web: Column, status: Column) -> Column:
    """The score with what a search found, where it ended; else the score."""
    return F.when(status.isin("completed", "no_results") & web.isNotNull(), clamp_score(0.62 * base + 0.38 * web)).otherwise(base)


def clean_text(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def claim_queries(text: Column, limit: int = 3, length: int = 180) -> Column:
    """The first sentences of four words or more, cut; the whole text if there is none."""
    t = F.coalesce(text, F.lit(""))
    sentences = F.filter(F.split(F.btrim(t, F.lit(" \t\n\r\f\x0b")), r"(?<=[.!?])[ \t\n\r\f\x0b]+"), lambda s: word_count(s) >= 4)
    chosen = F.when(F.size(sentences) > 0, F.slice(sentences, 1, limit)).otherwise(F.array(t))
    return F.filter(F.transform(chosen, lambda s: F.substring(clean_text(s), 1, length)), lambda s: s != "")


def search_tokens(text: Column, n: int = 8) -> Column:
    """Up to n distinct tokens of three characters or more, in order, without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9][A-Za-z0-9_-]{2,}"), F.lit(0)), lambda w: F.lower(w))
    return F.array_join(F.slice(F.array_except(F.array_distinct(found), F.array(*[F.lit(s) for s in STOP_WORDS])), 1, n), " ")


def url_domain(url: Column) -> Column:
    """The authority of a URL without a leading www.; null for what is no URL."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), r"^www\.", "")


def unique_in_order(messages: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(messages, lambda m: F.trim(m)), lambda m: m != ""))


def unique_messages(rows: DataFrame, key: str, at: str, message: str) -> DataFrame:
    """(key, messages) of each key: its distinct trimmed non-empty messages in the order of their first place, over all rows.

    Rows are added up by message before anything is gathered, so a list is as long as there are distinct messages.
    """
    text = F.regexp_replace(message, r"(?U)^\s+|\s+$", "")
    first = rows.select(key, F.col(at).alias("at"), text.alias("m")).groupBy(key, "m").agg(F.min("at").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("m") != "", F.struct("at", "m")))), lambda x: x["m"])
    return first.groupBy(key).agg(listed.alias("messages"))


def source_match_tier(full: Column, partial: Column, pages: Column, similar: Column) -> Column:
    """(status, confidence, score, matched) by the best kind of match."""
    out = lambda status, confidence, score, n: F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(score).alias("score"), n.cast("long").alias("matched"))
    return (
        F.when(full > 0, out("exact_visual_match", 0.9, 88.0, full + pages))
        .when((partial > 0) | (pages > 0), out("partial_visual_match", 0.72, 78.0, partial + pages))
        .when(similar > 0, out("visually_similar_match", 0.42, 62.0, similar))
        .otherwise(out("not_found", 0.0, 40.0, F.lit(0)))
    )


def citation_dedup(citations: DataFrame) -> DataFrame:
    """One citation for each (page_id, url): full before partial before page before similar, then by position; of the
    similar ones the first three of a page."""
    rank = F.when(F.col("kind") == "full", 0).when(F.col("kind") == "partial", 1).when(F.col("kind") == "page", 2).otherwise(3)
    few = Window.partitionBy("page_id", "kind").orderBy("pos", "url")
    rows = citations.withColumn("_k", F.row_number().over(few)).filter("kind <> 'similar' OR _k <= 3").withColumn("_rank", rank)
    w = Window.partitionBy("page_id", "url").orderBy("_rank", "pos")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("page_id", "url", "kind", "pos")


def hash_citation_match(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(id, sha256) where a text holds a fingerprint of 64 hex digits: digits are taken out of the text and joined."""
    runs = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-f]{64,}"), F.lit(0))).alias("run"))
    tokens = runs.select("id", F.explode(F.expr("transform(sequence(0, length(run) - 64), i -> substring(run, i + 1, 64))")).alias("sha256"))
    return tokens.distinct().join(prints.select("sha256").distinct().hint("merge"), "sha256").select("id", "sha256")


def monthly_quota(requests: DataFrame, limit: int) -> DataFrame:
    """requests with month (UTC) and allowed: the first `limit` of a month by time and id; none if limit is 0 or less. Ids are unique.

    The last allowed request of each month is found with a group limit, so that a month's task gets a few times `limit`
    rows; every request is then compared with it."""
    rows = requests.withColumn("month", F.date_format("ts", "yyyy-MM"))
    if limit <= 0:
        return rows.withColumn("allowed", F.lit(False))
    first = rows.select("month", "ts", "request_id").withColumn("_r", F.row_number().over(Window.partitionBy("month").orderBy("ts", "request_id"))).filter(F.col("_r") <= limit)
    last = first.groupBy(F.col("month").alias("_month")).agg(F.max(F.struct("ts", "request_id")).alias("_last"))
    out = rows.join(last.hint("merge"), F.col("month").eqNullSafe(F.col("_month")), "left")
    return out.withColumn("allowed", F.struct("ts", "request_id") <= F.col("_last")).drop("_month", "_last")


WEB_DETECTION = """struct<responses:array<struct<webDetection:struct<fullMatchingImages:array<struct<url:string>>,partialMatchingImages:array<struct<url:string>>,
 visuallySimilarImages:array<struct<url:string>>,pagesWithMatchingImages:array<struct<url:string,pageTitle:string,fullMatchingImages:array<struct<url:string>>,partialMatchingImages:array<struct<url:string>>>>,
 bestGuessLabels:array<struct<label:string>>,webEntities:array<struct<description:string,score:double>>>>>>"""


def web_detection_parse(responses: DataFrame, column: str = "body") -> DataFrame:
    """id, counts of each kind of match, labels (5 at most), entities (8 at most), the best match and its citations.

    What is no JSON, or has no such part, gives counts of 0."""
    r = responses.select("id", F.from_json(column, WEB_DETECTION).alias("j")).select("id", F.get("j.responses", F.lit(0))["webDetection"].alias("w"))
    none = F.array().cast("array<string>")
    urls = lambda c: F.coalesce(F.filter(F.transform(c, lambda x: x["url"]), lambda u: F.coalesce(u, F.lit("")) != ""), none)
    pages = F.filter(F.col("w.pagesWithMatchingImages"), lambda p: F.coalesce(p["url"], F.lit("")) != "")
    total = lambda f: F.coalesce(F.aggregate(pages, F.lit(0), lambda a, p: a + F.size(urls(p[f]))), F.lit(0))
    out = r.select(
        "id", urls(F.col("w.fullMatchingImages")).alias("full"), urls(F.col("w.partialMatchingImages")).alias("partial"), urls(F.col("w.visuallySimilarImages")).alias("similar"),
        F.coalesce(F.transform(pages, lambda p: p["url"]), none).alias("pages"), total("fullMatchingImages").alias("page_full"), total("partialMatchingImages").alias("page_partial"),
        F.slice(F.coalesce(F.filter(F.transform("w.bestGuessLabels", lambda x: x["label"]), lambda x: F.coalesce(x, F.lit("")) != ""), none), 1, 5).alias("labels"),
        F.slice(F.coalesce(F.filter(F.transform("w.webEntities", lambda x: x["description"]), lambda x: F.coalesce(x, F.lit("")) != ""), none), 1, 8).alias("entities"),
    )
    tier = source_match_tier(F.size("full") + F.col("page_full"), F.size("partial") + F.col("page_partial"), F.size("pages"), F.size("similar"))
    cited = F.array_distinct(F.concat("full", "partial", "pages", F.slice("similar", 1, 3)))
    return out.withColumns({"match": tier, "citations": cited})


def search_parse(responses: DataFrame, kind: str, column: str = "body") -> DataFrame:
    """(id, pos, title, url, source, snippet) of a search response's results: `results` of an image search, else `web.results`."""
    item = "array<struct<url:string,title:string,page_title:string,description:string,page_fetched:string,properties:struct<url:string>>>"
    schema = f"struct<results:{item},web:struct<results:{item}>>"
    j = responses.select("id", F.from_json(column, schema).alias("j"))
    rows = j.select("id", F.posexplode(F.col("j.results") if kind == "image" else F.col("j.web.results")).alias("pos", "x"))
    url = F.coalesce(F.nullif("x.url", F.lit("")), F.col("x.properties.url"))
    rows = rows.withColumn("url", url).filter(F.coalesce("url", F.lit("")) != "")
    title = F.coalesce(F.nullif("x.title", F.lit("")), F.nullif("x.page_title", F.lit("")), F.lit("Search result"))
    snippet = F.coalesce(F.nullif("x.description", F.lit("")), F.col("x.page_fetched"), F.lit(""))
    return rows.select(
        "id", "pos", F.substring(clean_text(title), 1, 140).alias("title"), "url", url_domain(F.col("url")).alias("source"), F.nullif(F.substring(clean_text(snippet), 1, 260), F.lit("")).alias("snippet")
    )


def research_outcome(status: Column, citations: Column, exact: Column) -> Column:
    """The score of a search by how it ended; exact: whether a citation holds the medium's own hash."""
    return (
        F.when(status.isin("not_configured", "quota", "error"), 50.0).when(status == "no_query", 48.0)
        .when((status == "completed") & (citations > 0), F.when(exact, 82.0).otherwise(68.0)).otherwise(38.0)
    )


#: A JSON string from its first quote to its last, escapes within, and the colon that makes it a key; without backtracking.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+'


def json_keys(body: Column) -> Column:
    """The keys of a JSON text at any depth, in order, repeated ones too; empty for null and for what is no JSON.

    Strings are taken one after the other from the left, so quotes, colons and escapes inside a string value are part of
    that value; outside of strings JSON has no quotes. A key with a backslash is decoded. An object that repeats a key is
    no JSON here.
    """
    found = F.filter(F.regexp_extract_all(body, F.lit(JSON_STRING), F.lit(0)), lambda x: x.endswith(":"))
    quoted = F.transform(found, lambda x: F.rtrim(F.substring(x, F.lit(1), F.length(x) - 1), F.lit(" \t\r\n")))
    plain = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    keys = F.transform(quoted, lambda x: F.when(F.contains(x, F.lit("\\")), F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0]).otherwise(plain(x)))
    return F.when(F.try_parse_json(body).isNotNull(), keys).otherwise(F.array().cast("array<string>"))


def manifest_key_count(body: Column) -> Column:
    """How many keys of a JSON text name a manifest or a claim, at any depth."""
    named = F.filter(json_keys(body), lambda k: F.lower(k).contains("manifest") | F.lower(k).contains("claim"))
    return F.size(named)
