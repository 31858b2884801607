"""Queries on texts, searches and pixel statistics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from attestra.operators import claims, forensics
from attestra.plans.registry import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, {_q(p)})" for p in phrases) + ")"


def _hits(phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains(low, {_q(p)})::int" for p in phrases) + ")"


_SPACE = r"[ \t\n\r\f\x0b]+"
FEATURES = rf""", t AS (SELECT doc_id, trim(coalesce(text, '')) AS t, lower(trim(coalesce(text, ''))) AS low FROM claims),
w AS (SELECT *, list_filter(string_split_regex(t, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Za-z]{{2,}}$')) AS words FROM t),
f AS (SELECT doc_id, regexp_matches(low, {_q("|".join(claims.SOURCE_PATTERNS))}) OR regexp_matches(low, {_q(claims.bounded("|".join(claims.SOURCE_WORDS)))}) AS has_source, {_any(claims.URGENCY)} AS has_urgency, {_hits(claims.FEAR)} AS fear_hits,
 {_hits(claims.CONSPIRACY)} AS conspiracy_hits, {_any(claims.BALANCED)} AS has_balanced, {_any(claims.PUBLIC)} AS has_public, {_any(claims.EXTREME)} AS has_extreme, (length(t) - length(replace(t, '!', '')))::int AS exclamations,
 CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z]+$'))) / len(words) ELSE 0 END::double AS caps_ratio,
 regexp_matches(t, {_q(claims.bounded(claims.DATES))}) OR regexp_matches(t, {_q(claims.bounded(claims.PLACES))}) OR regexp_matches(t, {_q(claims.bounded(claims.NAMES))}) AS has_details,
 len(list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> ''))::int AS word_count FROM w)
"""


@query("claims", FEATURES + "SELECT * FROM f")
def claim_features(claims_view):
    return claims.claim_features(claims_view)


@query(
    "claims",
    FEATURES
    + """, s AS (SELECT *, least(100, greatest(0, 75 + CASE WHEN has_source THEN 5 ELSE -10 END + CASE WHEN has_balanced THEN 5 ELSE 0 END + CASE WHEN has_details THEN 5 ELSE 0 END + CASE WHEN NOT has_urgency AND fear_hits = 0 AND exclamations <= 1 THEN 5 ELSE 0 END
 - CASE WHEN caps_ratio > 0.18 THEN 8 ELSE 0 END - CASE WHEN has_urgency THEN 8 ELSE 0 END - CASE WHEN NOT has_source AND has_extreme THEN 12 ELSE 0 END - CASE WHEN fear_hits > 0 OR conspiracy_hits > 0 THEN 10 ELSE 0 END - CASE WHEN exclamations >= 3 THEN 5 ELSE 0 END
 - CASE WHEN has_public AND NOT has_source THEN 8 ELSE 0 END - CASE WHEN word_count < 10 THEN 5 ELSE 0 END)) AS score FROM f)
SELECT doc_id, score, CASE WHEN score >= 80 THEN 'High Trust' WHEN score >= 60 THEN 'Medium Trust' WHEN score >= 40 THEN 'Low Trust' ELSE 'High Risk' END AS risk_level,
 round(least(100, greatest(0, 15 + least(30, caps_ratio * 100) + least(20, exclamations * 4) + CASE WHEN has_urgency THEN 18 ELSE 0 END + least(18, fear_hits * 6) + least(18, conspiracy_hits * 9)))::double, 6) AS language_risk,
 least(100, 25 + CASE WHEN word_count < 10 THEN 15 ELSE 0 END + CASE WHEN NOT has_source THEN 22 ELSE 0 END + CASE WHEN has_public THEN 16 ELSE 0 END)::double AS claim_risk,
 least(100, 12 + CASE WHEN has_urgency THEN 24 ELSE 0 END + least(24, fear_hits * 8) + least(24, conspiracy_hits * 12) + least(16, exclamations * 3))::double AS manipulation_risk FROM s""",
)
def claim_score(claims_view):
    return claims.claim_score(claims.claim_features(claims_view))


_CLEAN = rf"trim(regexp_replace({{}}, '{_SPACE}', ' ', 'g'))"


@query(
    "claims",
    rf""", t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(regexp_replace(trim(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '([.!?]){_SPACE}', concat('\1', chr(1)), 'g'), chr(1)),
 lambda s: len(list_filter(string_split_regex(s, '{_SPACE}'), lambda w: w <> '')) >= 4) AS s FROM claims)
SELECT doc_id, list_filter(list_transform(CASE WHEN len(s) > 0 THEN s[1:3] ELSE [t] END, lambda x: substr({_CLEAN.format("x")}, 1, 180)), lambda x: x <> '') AS queries FROM t""",
)
def claim_queries(claims_view):
    return claims_view.select("doc_id", claims.claim_queries(F.col("text")).alias("queries"))


@query(
    "claims",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i AND w[i] NOT IN ({", ".join(map(_q, claims.STOP_WORDS))}) THEN w[i] END), lambda x: x IS NOT NULL)[1:8], ' ') AS tokens
FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_-]{{2,}}'), lambda x: lower(x)) AS w FROM claims)""",
)
def search_tokens(claims_view):
    return claims_view.select("doc_id", claims.search_tokens(F.col("text")).alias("tokens"))


@query("pages", r"SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\.', '') AS domain FROM pages")
def url_domain(pages):
    return pages.select("page_id", claims.url_domain(F.col("url")).alias("domain"))


@query("claims", """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN least(100, greatest(0, round_even(0.62 * (doc_id % 101) + 0.38 * (doc_id % 89), 0)))::int ELSE (doc_id % 101)::int END AS score FROM claims""")
def claim_web_blend(claims_view):
    status = F.when(F.col("doc_id") % 3 == 0, "completed").when(F.col("doc_id") % 3 == 1, "no_results").otherwise("error")
    return claims_view.select("doc_id", claims.web_blend((F.col("doc_id") % 101).cast("int"), F.col("doc_id") % 89, status).cast("int").alias("score"))


@query("requests", "SELECT request_id, month, r <= 150 AS allowed FROM (SELECT request_id, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, request_id) AS r FROM requests)")
def monthly_quota(requests):
    return claims.monthly_quota(requests, 150).select("request_id", "month", "allowed")


_COUNTS = "page_id % 3 AS f, page_id % 4 AS p, page_id % 5 AS g, page_id % 2 AS s"


@query(
    "pages",
    f"""SELECT page_id, CASE WHEN f > 0 THEN 'exact_visual_match' WHEN p > 0 OR g > 0 THEN 'partial_visual_match' WHEN s > 0 THEN 'visually_similar_match' ELSE 'not_found' END AS status,
 CASE WHEN f > 0 THEN 0.9 WHEN p > 0 OR g > 0 THEN 0.72 WHEN s > 0 THEN 0.42 ELSE 0 END::double AS confidence, CASE WHEN f > 0 THEN 88 WHEN p > 0 OR g > 0 THEN 78 WHEN s > 0 THEN 62 ELSE 40 END::double AS score,
 CASE WHEN f > 0 THEN f + g WHEN p > 0 OR g > 0 THEN p + g WHEN s > 0 THEN s ELSE 0 END AS matched FROM (SELECT page_id, {_COUNTS} FROM pages)""",
)
def source_match_tier(pages):
    f, p, g, s = (F.col("page_id") % k for k in (3, 4, 5, 2))
    return pages.select("page_id", claims.source_match_tier(f, p, g, s).alias("m")).select("page_id", "m.*")


_KINDS = "['full', 'partial', 'page', 'similar']"


@query(
    "pages",
    f""", c AS (SELECT page_id % 40 AS page_id, 'u' || (page_id % 13) AS url, {_KINDS}[(page_id % 4 + 1)::int] AS kind, page_id AS pos FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY pos, url) AS k FROM c)
SELECT page_id, url, kind, pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY list_position({_KINDS}, kind), pos) AS r FROM k WHERE kind <> 'similar' OR k <= 3) WHERE r = 1""",
)
def citation_dedup(pages):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("full", "partial", "page", "similar")]), (F.col("page_id") % 4 + 1).cast("int"))
    c = pages.select((F.col("page_id") % 40).alias("page_id"), F.concat(F.lit("u"), F.col("page_id") % 13).alias("url"), kind.alias("kind"), F.col("page_id").alias("pos"))
    return claims.citation_dedup(c)


@query("manifest", "SELECT a.path AS id, b.sha256 FROM manifest a JOIN (SELECT DISTINCT sha256 FROM manifest) b ON contains('seen as ' || a.sha256 || ' today', b.sha256)")
def hash_citation_match(manifest):
    texts = manifest.select(F.col("path").alias("id"), F.concat(F.lit("seen as "), "sha256", F.lit(" today")).alias("text"))
    return claims.hash_citation_match(texts, manifest)


@query("frames", "SELECT video_id, list(m ORDER BY f, m) AS messages FROM (SELECT video_id, trim(warning) AS m, min(frame_index) AS f FROM frames GROUP BY ALL) WHERE m <> '' GROUP BY video_id")
def messages_unique(frames):
    first = frames.groupBy("video_id", F.trim("warning").alias("m")).agg(F.min("frame_index").alias("f")).filter("m <> ''")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda x: x["m"])
    return first.groupBy("video_id").agg(listed.alias("m")).select("video_id", claims.unique_in_order("m").alias("messages"))


@query("frames", "SELECT video_id, list(m ORDER BY f, m) AS messages FROM (SELECT video_id, trim(warning) AS m, min(frame_index) AS f FROM frames WHERE trim(warning) <> '' GROUP BY ALL) GROUP BY video_id")
def messages_unique_all(frames):
    return claims.unique_messages(frames, "video_id", "frame_index", "warning")


@query("image_stats", "SELECT media_id, CASE WHEN s >= 80 THEN 'Likely trustworthy' WHEN s >= 60 THEN 'Needs light verification' WHEN s >= 40 THEN 'Suspicious / verify before sharing' ELSE 'Do not share until verified' END AS verdict FROM (SELECT media_id, blur AS s FROM image_stats)")
def risk_band(image_stats):
    return image_stats.select("media_id", claims.risk_verdict(F.col("blur")).alias("verdict"))


FORENSIC = """, f AS (SELECT *, least(0.92, greatest(0.03, 0.16 + CASE WHEN mean_residual_noise < 1.2 THEN 0.16 WHEN mean_residual_noise > 2.5 THEN -0.04 ELSE 0 END + CASE WHEN block_noise_cv < 0.16 AND mean_residual_noise < 2.4 THEN 0.08 ELSE 0 END
 + CASE WHEN edge_to_flat_noise_ratio > 5.5 AND NOT caption_likely THEN 0.08 ELSE 0 END + CASE WHEN high_frequency_ratio < 0.06 THEN 0.08 WHEN high_frequency_ratio > 0.11 THEN -0.04 ELSE 0 END + CASE WHEN spectral_spike_ratio > 7.5 AND NOT caption_likely THEN 0.09 ELSE 0 END
 + CASE WHEN blockiness_ratio > 1.42 THEN 0.04 ELSE 0 END + CASE WHEN localized_hot_area_ratio > 0.12 AND NOT caption_likely THEN 0.06 ELSE 0 END + CASE WHEN duplicate_patch_ratio > 0.08 THEN 0.12 ELSE 0 END + CASE WHEN near_white_pixel_ratio > 0.08 AND NOT caption_likely THEN 0.03 ELSE 0 END
 - CASE WHEN caption_likely THEN 0.07 ELSE 0 END))::double AS s, least(0.9, greatest(0.03, 0.12 + CASE WHEN caption_likely THEN 0.3 ELSE 0 END + CASE WHEN localized_hot_area_ratio > 0.12 THEN 0.14 ELSE 0 END + CASE WHEN blockiness_ratio > 1.45 THEN 0.05 ELSE 0 END
 + CASE WHEN duplicate_patch_ratio > 0.08 THEN 0.18 ELSE 0 END))::double AS m FROM image_stats)
"""

#: The same in doubles, for limits that a sum can meet exactly.
FORENSIC_DOUBLE = re.sub(r"(\d+\.\d+)", r"\1e0", FORENSIC)


@query(
    "image_stats",
    FORENSIC + "SELECT media_id, round(s, 9) AS synthetic, round(m, 9) AS manipulation, round(least(98, greatest(5, 100 - (72 * s + 28 * m))), 6) AS score, round(least(95, greatest(20, 95 - 85 * block_noise_cv)), 6) AS compression FROM f",
)
def forensic_rules(image_stats):
    s, m = forensics.synthetic_probability(), forensics.manipulation_probability()
    return image_stats.select(
        "media_id", F.round(s, 9).alias("synthetic"), F.round(m, 9).alias("manipulation"), F.round(forensics.forensic_score(s, m), 6).alias("score"), F.round(forensics.compression_score(F.col("block_noise_cv")), 6).alias("compression")
    )


@query(
    "image_stats",
    FORENSIC_DOUBLE
    + """SELECT media_id, round_even(least(0.98e0, greatest(0.02e0, 0.14e0 + CASE WHEN entropy < 3.5e0 OR entropy > 7.8e0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN blur < 35 THEN 0.12e0 ELSE 0e0 END
 + CASE WHEN block_noise_cv > 0.7e0 THEN CASE WHEN caption_likely THEN 0.02e0 ELSE 0.08e0 END ELSE 0e0 END + CASE WHEN s >= 0.6e0 THEN least(0.26e0, (s - 0.5e0) * 0.7e0) WHEN s <= 0.28e0 THEN -0.07e0 ELSE 0e0 END
 + CASE WHEN m >= 0.58e0 AND NOT caption_likely THEN 0.06e0 ELSE 0e0 END + CASE WHEN caption_likely THEN -0.04e0 ELSE 0e0 END)), 3) AS probability FROM f""",
)
def heuristic_fallback(image_stats):
    return image_stats.select("media_id", forensics.heuristic_fallback().alias("probability"))


@query(
    "image_stats",
    FORENSIC
    + """, g AS (SELECT *, least(98, greatest(5, 100 - (72 * s + 28 * m))) AS fs FROM f)
SELECT media_id, least(100, greatest(0, 70 + CASE WHEN media_id % 3 = 0 THEN 8 + CASE WHEN media_id % 2 = 0 THEN 8 ELSE 0 END ELSE 0 END - CASE WHEN media_id % 10 = 0 THEN 10 ELSE 0 END
 + CASE WHEN least(width, height) >= 300 AND greatest(width, height) <= 12000 AND greatest(width, height) / least(width, height) <= 4.5 THEN 4 ELSE -5 END + CASE WHEN entropy BETWEEN 3.5 AND 7.8 THEN 5 ELSE -8 END - CASE WHEN blur < 35 THEN 8 ELSE 0 END
 + CASE WHEN block_noise_cv > 0.7 THEN CASE WHEN caption_likely THEN -2 ELSE -7 END ELSE 5 END + CASE WHEN s >= 0.62 THEN -12 WHEN s <= 0.28 THEN 6 ELSE 0 END + CASE WHEN fs >= 75 THEN 5 WHEN fs < 45 THEN -8 ELSE 0 END))::int AS score FROM g""",
)
def image_context_score(image_stats):
    m = F.col("media_id")
    return image_stats.select("media_id", forensics.image_context_score(m % 3 == 0, m % 2 == 0, m % 10 == 0).alias("score"))


@query(
    "pages",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'metadata_absent' WHEN page_id % 5 = 1 THEN 'explicit_ai_software_tag' WHEN page_id % 5 = 2 THEN 'camera_metadata_present' ELSE 'metadata_present' END AS status,
 CASE WHEN page_id % 5 = 1 THEN 'Midjourney' END AS ai_marker, CASE WHEN page_id % 5 = 3 THEN 'GIMP' END AS editing_marker, page_id % 5 = 2 AS camera, CASE WHEN page_id % 5 = 2 THEN ['FNumber', 'Make'] ELSE [] END AS capture_fields,
 CASE WHEN page_id % 5 = 0 THEN 0 WHEN page_id % 5 = 2 THEN 2 ELSE 1 END AS field_count FROM pages""",
)
def metadata_evidence(pages):
    k = F.col("page_id") % 5
    tags = F.when(k == 1, F.create_map(F.lit("Software"), F.lit("MidJourney 6"))).when(k == 2, F.create_map(F.lit("Make"), F.lit("X"), F.lit("FNumber"), F.lit("2.8")))
    tags = tags.when(k == 3, F.create_map(F.lit("Software"), F.lit("gimp 2"))).when(k == 4, F.create_map(F.lit("Artist"), F.lit("n")))
    return pages.select("page_id", forensics.metadata_evidence(tags).alias("m")).select("page_id", "m.*")


_RESPONSE = """concat('{"responses":[{"webDetection":{"fullMatchingImages":[', IF(page_id % 3 = 0, concat('{"url":"', url, '"},{"url":""}'), ''), '],"pagesWithMatchingImages":[{"url":"p', page_id, '","partialMatchingImages":[{"url":"q"}]},{"url":""}],"bestGuessLabels":[{"label":"L', page_id % 7, '"}],"webEntities":[{"description":"E","score":0.5},{"score":1}]}}]}')"""


@query(
    "pages",
    """SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS n_full, 1 AS n_pages, 1 AS page_partial, ['L' || (page_id % 7)] AS labels, ['E'] AS entities, CASE WHEN page_id % 3 = 0 THEN 'exact_visual_match' ELSE 'partial_visual_match' END AS status,
 CASE WHEN page_id % 3 = 0 THEN [url, 'p' || page_id] ELSE ['p' || page_id] END AS citations FROM pages""",
)
def web_detection_parse(pages):
    parsed = claims.web_detection_parse(pages.select(F.col("page_id").alias("id"), F.expr(_RESPONSE).alias("body")))
    return parsed.select("id", F.size("full").alias("n_full"), F.size("pages").alias("n_pages"), "page_partial", "labels", "entities", F.col("match.status").alias("status"), "citations")


@query("pages", r"SELECT page_id AS id, 0 AS pos, 'A b' AS title, url, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\.', '') AS source, 's' AS snippet FROM pages")
def search_parse(pages):
    body = F.expr("""concat('{"web":{"results":[{"url":"', url, '","title":" A   b ","description":"s"},{"title":"none"}]}}')""")
    return claims.search_parse(pages.select(F.col("page_id").alias("id"), body.alias("body")), "web")


@query("pages", "SELECT page_id, CASE WHEN page_id % 5 IN (0, 1, 3) THEN 50 WHEN page_id % 5 = 2 THEN 48 WHEN page_id % 7 > 0 THEN CASE WHEN page_id % 2 = 0 THEN 82 ELSE 68 END ELSE 38 END::double AS score FROM pages")
def research_outcome(pages):
    k = F.col("page_id") % 5
    status = F.when(k == 0, "not_configured").when(k == 1, "quota").when(k == 2, "no_query").when(k == 3, "error").otherwise("completed")
    return pages.select("page_id", claims.research_outcome(status, F.col("page_id") % 7, F.col("page_id") % 2 == 0).alias("score"))


@query(
    "conversations",
    """SELECT conv_id, turn, count(t.key) FILTER (lower(t.key) LIKE '%manifest%' OR lower(t.key) LIKE '%claim%') AS n
FROM (SELECT conv_id, turn, to_json({'active_manifest': {'label': text || ' "manifest": {', 'Claim "a"': turn}, 'turns': [{'role': role, 'text': 'said "claim": ' || text, 'claims': CASE WHEN turn % 2 = 0 THEN [{'manifest\\x': turn}] ELSE [] END}]})::json AS body
 FROM conversations), json_tree(body) AS t GROUP BY conv_id, turn""",
)
def manifest_key_count(conversations):
    claims_of = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.col("turn").alias("manifest\\x")))).otherwise(F.array())
    said = F.struct("role", F.concat(F.lit('said "claim": '), "text").alias("text"), claims_of.alias("claims"))
    active = F.struct(F.concat("text", F.lit(' "manifest": {')).alias("label"), F.col("turn").alias('Claim "a"'))
    body = F.to_json(F.struct(active.alias("active_manifest"), F.array(said).alias("turns")))
    return conversations.select("conv_id", "turn", claims.manifest_key_count(body).cast("long").alias("n"))
