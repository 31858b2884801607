"""URL filters: fixed rules by host and path, then association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.storage import written
from attestra.llm.text import ascii_lower, or_empty

#: Rules (host and path, verdict); one fits its host and all subdomains if the path starts with its own. Fixed values.
FIXED = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Of mined rules: the least share of labelled URLs that hold antecedent and label, the least share of the antecedent's URLs
#: that are bad, how many times the overall share that has to be, and the most tokens of an antecedent.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MAX_TOKENS = 0.002, 0.5, 1.5, 3
#: Mined rules that are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 50_000
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z in lower case; empty without :// and for null."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return or_empty(F.when(at > 0, F.substring(url, at + 3, F.length(url))))


def fixed_rule(host: Column, path: Column, rules: tuple = FIXED) -> Column:
    """The longest rule (a struct of rule and verdict) that fits; null if none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL: scheme, host labels, path segments, file endings, names and values of the query, the
    fragment. Segments and values without a letter (numbers, ids) say which page it is and are left out."""

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x.rlike("[^0-9]") & x.rlike("[\\p{L}]")), lambda x: F.concat(F.lit(mark), F.lower(x)))

    path, rest = path_of(url), _rest(url)
    query, fragment = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(rest, r"^[^#]*#(.*)", 1)
    segments = F.split(path, "/")
    every = F.concat(
        marked("scheme=", F.array(F.regexp_extract(or_empty(url), r"^([^:/?#]*)://", 1))),
        marked("host=", F.split(host_of(url), r"\.")),
        marked("path=", F.transform(segments, lambda x: F.regexp_replace(x, r"\.[A-Za-z0-9]{1,5}$", ""))),
        marked("ending=", F.transform(segments, lambda x: F.regexp_extract(x, r"\.([A-Za-z0-9]{1,5})$", 1))),
        marked("query=", F.split(query, "&")),
        marked("name=", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        marked("fragment=", F.array(fragment)),
    )
    return F.array_sort(F.array_distinct(every))


@dataclass(frozen=True)
class UrlRules:
    """Mined rules: id, antecedent (sorted tokens), key_token (its rarest), n_tokens, confidence, support; count is their number."""

    rules: DataFrame
    count: int


def mine_rules(
    labelled: DataFrame,
    url_col: str = "url",
    bad_col: str = "bad",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    max_tokens: int = MAX_TOKENS,
) -> UrlRules:
    """Rules "these tokens, so bad" from URLs with a boolean label. Rows without a URL or a label teach nothing.

    FP-growth finds the frequent combinations of tokens and label over all rows; it aggregates prefix trees before it
    shuffles, so a frequent host costs a path in each tree and not its rows. Only combinations with at least
    min_support of the rows exist, at most 1 / min_support times the tokens of a URL single ones. A rule stays if its
    confidence, its lift and its length are within the limits and no rule with fewer of its tokens is as sure. An empty
    table gives no rules.
    """
    rows = labelled.select(url_tokens(F.col(f"`{url_col}`")).alias("tokens"), F.col(f"`{bad_col}`").cast("boolean").alias("bad")).filter("bad IS NOT NULL AND size(tokens) > 0")
    rows = written(rows.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")), "url-items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    mined = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.size("antecedent") <= max_tokens) & (F.col("lift") >= min_lift))
    mined = written(mined.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "url-mined")
    subsets = mined.select("antecedent", "confidence", F.explode(_proper_subsets(F.col("antecedent"), max_tokens)).alias("part"))
    smaller = mined.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    needless = subsets.join(smaller.hint("merge"), "part").filter("part_confidence >= confidence").select("antecedent").distinct()
    kept = mined.join(needless.hint("merge"), "antecedent", "left_anti")
    rarest = kept.select("antecedent", F.explode("antecedent").alias("token")).join(single.hint("merge"), "token")
    rarest = rarest.groupBy("antecedent").agg(F.min(F.struct("freq", "token"))["token"].alias("key_token"))
    out = kept.join(rarest.hint("merge"), "antecedent").withColumn("n_tokens", F.size("antecedent"))
    rules = written(out.withColumn("rule_id", F.concat_ws(" & ", "antecedent")), "url-rules")
    return UrlRules(rules, rules.count())


def _proper_subsets(tokens: Column, most: int) -> Column:
    """Non-empty proper subsets of a sorted array of at most so many tokens, each sorted."""
    masks = F.sequence(F.lit(1), F.greatest(F.lit(1), F.shiftleft(F.lit(1), most) - 1))
    every = F.transform(masks, lambda m: F.filter(tokens, lambda x, i: F.expr("1").bitwiseAND(F.call_function("shiftright", m, i)) == 1))
    return F.filter(F.array_distinct(every), lambda x: (F.size(x) > 0) & (F.size(x) < F.size(tokens)))


def match_rules(token_sets: DataFrame, mined: UrlRules) -> DataFrame:
    """(tokens, mined_rule, confidence) of the distinct token sets that a rule fits; of several the surest, then the best
    supported, then the first by name.

    An inverted index holds each rule once, under its rarest token, so a common token calls up few rules; the rule is
    then compared with the whole set.
    """
    index = mined.rules.select(F.col("key_token").alias("token"), "rule_id", "antecedent", "confidence", "support")
    index = F.broadcast(index) if mined.count <= BROADCAST_RULES else index.hint("shuffle_hash")
    called = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = called.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.col("rule_id").alias("mined_rule")))
    return fits.groupBy("tokens").agg(best.alias("b")).select("tokens", "b.mined_rule", (-F.col("b.c")).alias("confidence"))


def judge_urls(pages: DataFrame, mined: UrlRules, url_col: str = "url", fixed: tuple = FIXED) -> DataFrame:
    """pages with host, path, rule, verdict, mined_rule and confidence; columns of these names are replaced.

    A fixed rule decides where one fits. Elsewhere a mined rule that fits blocks, and what no rule knows is allowed. URLs are
    first reduced to their distinct token sets, which a partial aggregation does before the shuffle; the sets that a rule
    fits meet the pages in an outer join, which Spark splits where one set is that of many pages. A null or odd URL has
    an empty host and path and is allowed. Repeated rows are judged alike; an empty table gives an empty result.
    """
    new = ("host", "path", "rule", "verdict", "mined_rule", "confidence")
    url = F.col(f"row.`{url_col}`")
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    d = d.withColumns({"host": host_of(url), "path": path_of(url), "tokens": url_tokens(url)})
    d = d.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    sets = d.filter("fixed IS NULL").select("tokens").distinct()
    found = written(match_rules(sets, mined), "url-found")
    known = d.withColumn("tokens", F.when(F.col("fixed").isNull(), F.col("tokens")))
    out = known.join(found.hint("merge"), "tokens", "left")
    verdict = F.coalesce("fixed.verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    keep = [F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in new]
    return out.select(*keep, "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule", "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose document has a label: a page's URL names its document by the first path segment that starts with
    a number. A document is bad if any of its labels says poor quality or toxic."""
    bad = F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad")
    known = labels.filter("quality IS NOT NULL OR toxic IS NOT NULL").groupBy("doc_id").agg(bad)
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1).try_cast("long")
    return pages.select("url", number.alias("doc_id")).filter("doc_id IS NOT NULL").join(known.hint("merge"), "doc_id").select("url", "bad")


def url_report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, mined_rule, confidence."""
    p = pages.select("page_id", "url")
    return judge_urls(p, mine_rules(labelled_urls(p, labels))).drop("url")
