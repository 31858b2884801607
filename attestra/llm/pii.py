"""Personal data: rules, and candidates of wider generators that boosted trees select. Column expressions throughout."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.storage import written
from attestra.llm.text import or_empty

KINDS = ("email", "ip", "card", "phone")
#: Matches whose places are added up together.
BLOCK = 256
_LOCAL = "[A-Za-z0-9._%+-]"

# The rules' patterns. Each finds what its plain form finds, leftmost and without overlap, in linear time:
# a run of characters is only tried at its start (\G: or right after the last match) and is not tried again in part.
RULES = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text must pass before its pattern is tried.
HINTS = {
    "email": "contains({t}, '@')",
    "ip": r"{t} rlike r'[0-9]\.[0-9]+\.[0-9]+\.[0-9]'",
    "card": r"{t} rlike r'[0-9](?:[\x20-]?[0-9]){15}'",
    "phone": "contains({t}, '+')",
}
#: What a match m must satisfy to be a span.
CHECKS = {
    "email": "true",
    "ip": r"m rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$'",
    "card": "luhn_check(translate(m, ' -', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 8 AND 15",
}
# Signs that stand for @ and for a dot, and what separates groups of digits.
AT = r"(?:\x20?[(\[{<]\x20?(?:[aA][tT]|@)\x20?[)\]}>]\x20?|\x20?[@＠]\x20?)"
DOT = r"(?:\x20?[(\[{<]\x20?(?:[dD][oO][tT]|\.)\x20?[)\]}>]\x20?|[.,．])"
WORD_AT, WORD_DOT = r"\x20(?:[aA][tT])\x20", r"\x20(?:[dD][oO][tT])\x20"
GAP = r"[\x20\t ._/,‐-―-]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_OCTET_GAP = r"(?:\x20?[(\[{<]\x20?(?:\.|[dD][oO][tT])\x20?[)\]}>]\x20?|\x20?[.。．]\x20?|[,-])"
_NAME = r"[\p{L}\p{N}._%+-]"

# The generators' patterns, wider than the rules: written-out signs, other separators, letters of any script.
GENERATORS = {
    "email": rf"(?<!{_NAME}){_NAME}{{1,64}}+(?:{AT}[\p{{L}}\p{{N}}-]++(?:{DOT}[\p{{L}}\p{{N}}-]++)++|{WORD_AT}[\p{{L}}\p{{N}}-]++(?:{WORD_DOT}[\p{{L}}\p{{N}}-]++)++)",
    "ip": rf"(?<![0-9.,-]){_OCTET}(?:{_OCTET_GAP}{_OCTET}){{3}}(?![0-9.,-]?[0-9])",
    "card": rf"(?<![0-9])[0-9](?:{GAP}{{0,2}}[0-9]){{12,18}}+(?![0-9])",
    "phone": r"(?<![\p{L}0-9+.])(?:\+|00\x20?)?\(?[0-9]{1,5}\)?(?:(?:[\x20 ./‐-―-]{1,3}|(?=\()|(?<=\)))\(?[0-9]{1,8}\)?){1,6}(?![\p{L}0-9])",
}
GENERATOR_HINTS = {
    "email": r"{t} rlike r'[@＠]|[(\[{<]\x20?[aA][tT]|\x20[dD][oO][tT]\x20'",
    "ip": "{t} rlike '[0-9]'",
    "card": rf"{{t}} rlike r'[0-9](?:{GAP}{{0,2}}[0-9]){{12}}'",
    "phone": "{t} rlike '[0-9]'",
}
NEAR = r"(?i)(?:e-?mail|phone|tel|call|fax|mobile|cell|dial|whatsapp|my\x20number|card|visa|pay|addr|contact|reach|host|server|\bip\b)"
# Common last parts of host names.
TLDS = "com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|pl|se|no|dk|fi|pt|cz|ie|au|jp|cn|in|br|mx|ru"
#: SQL of a candidate c in the plain form of its kind: signs written as signs, one way to separate.
PLAIN = {
    "email": rf"regexp_replace(regexp_replace(c.m, r'{DOT}|{WORD_DOT}', '.'), r'{AT}|{WORD_AT}', '@')",
    "ip": rf"regexp_replace(c.m, r'{_OCTET_GAP}', '.')",
    "card": "regexp_replace(c.m, '[^0-9]', '')",
    "phone": "regexp_replace(c.m, '[^0-9]', '')",
}
#: Whether a plain form p of a candidate c is what its kind means.
PLAIN_FORM = {
    "email": r"(p rlike r'^[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.[\p{L}]{2,24}$')",
    "ip": r"(p rlike r'^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$')",
    "card": "(p rlike '^[3-6]' AND luhn_check(p))",
    "phone": "(length(p) BETWEEN 8 AND 15)",
}
#: A date, or a list of short numbers of one length, written like a telephone number.
_DATED = r"^(?:19|20)?[0-9]{2}([./-])[0-9]{1,2}\1(?:[0-9]{2}){1,2}$|^(?:(?:19|20)[0-9]{2}[ -]?)+$"
#: What says, apart from the rules, that a candidate c may well be what its kind means: such candidates are no negatives.
WELL_FORMED = {
    "email": r"c.m rlike r'[\p{L}]{2,24}$'",
    "ip": r"NOT (c.before rlike r'[\p{L}\p{N}]$' OR c.after rlike r'^[\p{L}\p{N}]' OR c.m rlike '^[0-9]+[,-]')",
    "card": "luhn_check(regexp_replace(c.m, '[^0-9]', ''))",
    "phone": rf"length(regexp_replace(c.m, '[^0-9]', '')) BETWEEN 8 AND 15 AND (c.m rlike r'^(?:\+|00)' OR c.before rlike r'{NEAR}') AND NOT c.m rlike r'{_DATED}'",
}
#: Confirmed matches rewritten in forms that no rule finds, one of these for each match; positives of the fit beside the
#: matches themselves. Other forms of the generators are kept out of the fit, so that tests can say what it makes of them.
HIDDEN = {
    "email": ["replace(replace(c.m, '@', ' [at] '), '.', ' [dot] ')", "replace(c.m, '@', '(at)')", "replace(replace(replace(c.m, '.', ' dot '), '@', ' at '), '_', '')"],
    "ip": ["replace(c.m, '.', '[.]')", "replace(c.m, '.', ' . ')", "replace(c.m, '.', '-')"],
    "card": [f"regexp_replace(regexp_replace(c.m, '[ -]', ''), '([0-9]{{4}})(?=[0-9])', '$1{gap}')" for gap in (".", "/", "  ")],
    "phone": [
        "regexp_replace(replace(replace(c.m, '+', '00'), '-', ' '), '[()]', '')", "regexp_replace(replace(c.m, '+', ''), '[^0-9]+', element_at(array('.', '-', ' '), cast(floor(c.s / 4) % 3 + 1 AS int)))",
        "concat('(', regexp_extract(regexp_replace(c.m, '[^0-9]', ''), '^([0-9]{3})', 1), ') ', substring(regexp_replace(c.m, '[^0-9]', ''), 4, 3), '-', right(regexp_replace(c.m, '[^0-9]', ''), 4))",
        "concat('0', right(regexp_replace(c.m, '[^0-9]', ''), 3), '/', right(regexp_replace(c.m, '[^0-9]', ''), 7))",
    ],
}
#: The text before a hidden form: a number without a sign of its own needs a word that says what it is.
HIDDEN_BEFORE = {
    "phone": ["c.before", "' call '", "element_at(array(' tel ', ' call ', ' fax '), cast(c.s % 3 + 1 AS int))", "element_at(array(' phone: ', ' mobile '), cast(c.s % 2 + 1 AS int))"],
    "ip": ["c.before", "c.before", "' host '"],
}
#: (match, text before) of confirmed matches spoilt, so that they are no personal data: negatives of the fit, one for each.
SPOILT = {
    "email": [("regexp_replace(c.m, '[A-Za-z]+$', '1')", "c.before"), ("concat(regexp_extract(c.m, '^[^@]+', 0), '@', 'x.1')", "c.before"), ("concat('met at ', left(c.m, 3), ' dot the')", "c.before")],
    "ip": [("c.m", "'version v'"), ("replace(c.m, '.', ',')", "' so '"), ("replace(c.m, '.', '-')", "' so '")],
    "card": [("translate(c.m, '0123456789', '1234567890')", "c.before"), (f"regexp_replace(translate(regexp_replace(c.m, '[ -]', ''), '0123456789', '3456789012'), '([0-9]{{4}})(?=[0-9])', '$1.')", "' so '")],
    "phone": [("regexp_replace(replace(c.m, '+', ''), '[^0-9]+', element_at(array('.', '-', ' '), cast(floor(c.s / 4) % 3 + 1 AS int)))", "' so '"), ("right(replace(c.m, '+', ''), 7)", "' so '"), ("'2019-03-1' || right(c.m, 1)", "' call '"), ("'19 20 2' || right(c.m, 1)", "' phone '")],
}
#: Key-like secrets: candidates are long runs of letters, digits and their signs. Public formats and the words before.
KEY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
KEY_FORMS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[bp]-[A-Za-z0-9-]{10,}|(?i:password|passwd|pwd|token|secret|api[_-]?key)=[^=]{8,})$"
KEY_WORDS = r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|credential)[\x22\x27]?\s*[:=]\s*[\x22\x27]?$"

#: Trees, their depth, and the precision that a kind's threshold has on candidates that the fit did not use.
TREES, DEPTH, PRECISION = 12, 3, 0.98


def _found(text: str, pattern: str, hint: str) -> str:
    """SQL: array of (s, e, m, before, after) of a pattern's matches: code points, end exclusive, the text beside each.

    Split pieces and matches alternate, so lengths add up to places; nothing is searched twice. Places are added up within
    blocks of BLOCK matches and over the blocks, so no list grows with the text but by whole blocks.
    """
    none = "cast(array() AS array<struct<s:int,e:int,m:string,before:string,after:string>>)"
    parts, matches = f"split({text}, r'{pattern}')", f"regexp_extract_all({text}, r'{pattern}', 0)"
    step = """struct(acc.at + length(x.p) + length(x.m) AS at, concat(acc.found, array(struct(
        acc.at + length(x.p) AS s, acc.at + length(x.p) + length(x.m) AS e, x.m AS m, right(x.p, 24) AS before, left(x.a, 2) AS after))) AS found)"""

    zipped = f"filter(transform(arrays_zip({parts}, {matches}, slice({parts}, 2, 2147483647)), x -> struct(x.`0` AS p, x.`1` AS m, x.`2` AS a)), x -> x.m IS NOT NULL)"
    blocks = f"transform(sequence(0, cast((size(z) - 1) div {BLOCK} AS int)), b -> slice(z, b * {BLOCK} + 1, {BLOCK}))"
    length = "aggregate(k, 0, (n, x) -> n + length(x.p) + length(x.m))"
    starts = f"aggregate(transform(blocks, k -> {length}), struct(0 AS at, cast(array() AS array<int>) AS starts), (acc, n) -> struct(acc.at + n AS at, concat(acc.starts, array(acc.at)) AS starts), acc -> acc.starts)"
    placed = f"transform(arrays_zip(blocks, {starts}), k -> aggregate(k.blocks, struct(k.`1` AS at, {none} AS found), (acc, x) -> {step}, acc -> acc.found))"
    found = f"transform(array({zipped}), z -> flatten(transform(array({blocks}), blocks -> {placed})[0]))[0]"
    return f"CASE WHEN {hint} THEN {found} ELSE {none} END"


def _features(kind: str, c: str) -> str:
    """SQL: the features of a candidate c: its kind, its plain form, how it is written, its context.

    They say whether signs are written out and how many separators there are, not which: a form that the fit has not seen
    looks like those that it has.
    """
    digits = f"regexp_replace({c}.m, '[^0-9]', '')"
    plain = PLAIN[kind].replace("c.m", f"{c}.m")
    form = PLAIN_FORM[kind].replace("(p ", f"({plain} ").replace("(p)", f"({plain})")
    gaps = f"size(array_distinct(filter(split({c}.m, r'[\\p{{L}}\\p{{N}}]+'), x -> x <> '')))"
    as_double = lambda x: f"coalesce(cast({x} AS double), 0D)"
    return "array(" + ", ".join(
        as_double(x)
        for x in (
            KINDS.index(kind),
            form,
            f"CASE WHEN length({digits}) < 8 THEN 0 WHEN length({digits}) <= 15 THEN 1 WHEN length({digits}) <= 19 THEN 2 ELSE 3 END",
            f"(length({digits}) > 0 AND luhn_check({digits}))",
            f"({c}.m rlike '^(\\\\+|00)')",
            f"({c}.m rlike r'^\\(?[0-9]{{2,5}}\\)?[ /.-]' AND {c}.m rlike r'^[(0]')",
            f"({c}.m rlike r'[@\\uFF20]')",
            f"({c}.m rlike r'(?i)[(\\[{{<]\\x20?(at|dot|\\.|@)|\\x20at\\x20')",
            f"least({gaps}, 3)",
            f"({c}.m rlike r'^[0-9]+[,-]')",
            f"({c}.m rlike r'{_DATED}')",
            f"length(regexp_extract({c}.m, r'([\\p{{L}}]+)$', 1)) BETWEEN 2 AND 24",
            f"({c}.m rlike r'(?i)(?:{TLDS})$')",
            f"({c}.before rlike r'{NEAR}')",
            f"({c}.before rlike r'[\\p{{L}}\\p{{N}}]$')",
            f"({c}.after rlike r'^[\\p{{L}}@]')",
        )
    ) + ")"


def with_rule_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with an array base_<kind> of (s, e) for each kind."""
    out = docs.withColumn("pii_text", or_empty(F.col(text_col)))
    for kind in KINDS:
        found = _found("pii_text", RULES[kind], HINTS[kind].replace("{t}", "pii_text"))
        check = CHECKS[kind].replace("m ", "x.m ", 1) if kind == "ip" else CHECKS[kind].replace("(m,", "(x.m,")
        out = out.withColumn(f"base_{kind}", F.expr(f"transform(filter({found}, x -> {check}), x -> struct(x.s AS s, x.e AS e))"))
    return out


def _rewritten(kind: str, forms: list[tuple[str, str]]) -> str:
    """SQL: the features of a match in one of some forms (match, text before), by its place."""
    one = " ".join(f"WHEN {i} THEN struct(cast({m} AS string) AS m, cast({before} AS string) AS before, c.after AS after)" for i, (m, before) in enumerate(forms))
    return f"transform(array(CASE c.s % {len(forms)} {one} END), q -> {_features(kind, 'q')})[0]"


def with_candidates(docs: DataFrame, fit: bool = False) -> DataFrame:
    """Adds cand_<kind>: (s, e, f, same): features, and whether a rule's span of the kind overlaps. For the fit also ok,
    whether it is well formed apart from the rules, and g and b, the features of the match in a hidden form and spoilt.

    A candidate inside one rule span of its kind adds nothing and is left out once the trees are fitted."""
    out = docs
    for kind in KINDS:
        hint = GENERATOR_HINTS[kind].replace("{t}", "pii_text")
        found = _found("pii_text", GENERATORS[kind], hint)
        hidden = _rewritten(kind, list(zip(HIDDEN[kind], HIDDEN_BEFORE.get(kind, ["c.before"] * len(HIDDEN[kind])), strict=True)))
        spoilt = _rewritten(kind, SPOILT[kind])
        more = f", {spoilt} AS b, coalesce({WELL_FORMED[kind]}, false) AS ok, {hidden} AS g" if fit else ""
        out = out.withColumn(
            f"cand_{kind}",
            F.expr(
                f"transform({found}, c -> struct(c.s AS s, c.e AS e, {_features(kind, 'c')} AS f, "
                f"exists(base_{kind}, b -> b.s < c.e AND c.s < b.e) AS same{more}))"
            ),
        )
    return out


def _key_features(c: str) -> str:
    """SQL: the features of a key-like candidate: its length, its signs and how they alternate, the words before."""
    kinds = "length(regexp_replace({0}.m, '[^{1}]', ''))"
    parts = [
        f"length({c}.m)",
        *[kinds.format(c, x) + f" / length({c}.m)" for x in ("0-9", "A-Z", "a-z", "0-9a-f")],
        f"size(array_distinct(split({c}.m, ''))) / length({c}.m)",
        f"length(regexp_replace({c}.m, '[0-9]+|[A-Za-z]+', '.')) / length({c}.m)",
        f"length(regexp_extract({c}.m, '[A-Za-z]*', 0)) / length({c}.m)",
        f"({c}.before rlike r'{KEY_WORDS}')",
    ]
    return "array(" + ", ".join(f"coalesce(cast({x} AS double), 0D)" for x in parts) + ")"


def with_key_candidates(docs: DataFrame) -> DataFrame:
    """Adds cand_key: (s, e, f, g, same, ok): same: of a public format or after a word for secrets; ok: letters and digits mixed;
    g: the features without the words before and without a format's opening letters, b: those with letters for digits."""
    found = _found("pii_text", KEY, r"pii_text rlike r'[A-Za-z0-9+/_=-]{16}'")
    bare = r"regexp_replace(c.m, r'^(?:AKIA|gh[pousr]_|sk-|[A-Za-z_-]+=)', '')"
    hidden = f"transform(array(struct({bare} AS m, '' AS before)), p -> {_key_features('p')})[0]"
    spoilt = f"transform(array(struct(translate(c.m, '0123456789', 'etaoinshrd') AS m, '' AS before)), p -> {_key_features('p')})[0]"
    same = f"(c.m rlike r'{KEY_FORMS}' OR c.before rlike r'{KEY_WORDS}')"
    ok = "(c.m rlike '[0-9].*[A-Za-z].*[0-9]' AND c.m rlike '[A-Za-z].*[0-9].*[A-Za-z]')"
    return docs.withColumn(
        "cand_key",
        F.expr(f"transform({found}, c -> struct(c.s AS s, c.e AS e, {_key_features('c')} AS f, {hidden} AS g, {spoilt} AS b, {same} AS same, {ok} AS ok))"),
    )


def _tree_sql(node, f: str) -> str:
    """A fitted tree as nested IFs over the feature array."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"IF({f}[{split.featureIndex()}] <= {split.threshold()!r}D, {_tree_sql(node.leftChild(), f)}, {_tree_sql(node.rightChild(), f)})"


class Selector:
    """margin: SQL of the trees' sum for a candidate's features; thresholds: kind -> least probability, or None. keys: the
    same for key-like secrets, if trees could be fitted for them."""

    def __init__(self, trees: list[str] | None, thresholds: dict[str, float | None], keys: Selector | None = None):
        self.trees, self.thresholds, self.keys = trees, thresholds, keys

    def probability(self, f: str) -> str:
        margin = " + ".join(t.replace("%f%", f) for t in self.trees)
        return f"1 / (1 + exp(-2 * ({margin})))"


def _examples(cands: DataFrame, id_col: str, kinds: tuple[str, ...], label: str) -> DataFrame:
    """(kind, f, label, fold, n), n of them: what rules confirm, as found and in its hidden form, are positives; its spoilt form, and what is not
    well formed, are negatives; well-formed candidates that nothing confirms are left out, so the trees are not taught to reject them."""
    every = F.concat(*[F.expr(f"transform(cand_{k}, c -> struct('{k}' AS kind, c.f AS f, c.g AS g, c.b AS b, c.same AS same, c.ok AS ok))") for k in kinds])
    rows = cands.select(id_col, F.posexplode(every).alias("pos", "c")).filter("c.same OR NOT c.ok")
    forms = F.expr("IF(c.same, array(c.f, c.g, c.b), array(c.f))")
    rows = rows.select("c.kind", F.posexplode(forms).alias("form", "f"), "c.same", id_col, "pos")
    fold = F.pmod(F.xxhash64(id_col, "pos"), F.lit(5)).alias("fold")
    rows = rows.select("kind", "f", F.expr("cast(same AND form < 2 AS double)").alias("label"), fold)
    return written(rows.groupBy("kind", "f", "label", "fold").agg(F.count("*").cast("double").alias("n")), label)


def _boosted(rows: DataFrame, kinds: tuple[str, ...]) -> Selector:
    """Trees fitted on four fifths of the examples; on the rest each kind gets the lowest threshold with PRECISION (0.5 at
    least), or none."""
    train = rows.filter("fold > 0")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < 20:
        return Selector(None, dict.fromkeys(kinds))
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, labelCol="label", featuresCol="v", weightCol="n")
    model = gbt.fit(train.select("label", "n", array_to_vector("f").alias("v")))
    weights = list(model.treeWeights)
    trees = [f"{w!r}D * {_tree_sql(t.rootNode(), '%f%')}" for w, t in zip(weights, model._call_java("trees"), strict=True)]
    selector = Selector(trees, {})
    scored = rows.filter("fold = 0").select("kind", "label", "n", F.expr(f"floor(1000 * ({selector.probability('f')}))").alias("p"))
    table = scored.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()  # at most 1001 rows a kind
    for kind in kinds:
        good = n = 0
        best = None
        seen = sorted((r for r in table if r["kind"] == kind), key=lambda r: -r["p"])
        for r, lower in zip(seen, [*(r["p"] for r in seen[1:]), 0]):
            good, n = good + r["good"], n + r["n"]
            if good >= PRECISION * n and r["p"] >= 500:
                best = max(500, (r["p"] + lower) / 2) / 1000  # nothing was seen between: the middle
        selector.thresholds[kind] = best
    return selector


def fit_selector(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Selector:
    """Boosted trees that tell personal data from other candidates, by format and context.

    Positives are what rules confirm, each also rewritten in a form that rules cannot find; negatives are candidates that
    fail checks apart from the rules. All texts are read whole and all their examples used; equal ones are one row with
    their number as its weight, so the fit grows with the different examples only. Too few of either class: no trees, and
    only rules find spans.
    """
    texts = docs.select(F.col(id_col).alias("pii_id"), F.col(text_col).alias("pii_source"))
    cands = with_key_candidates(with_candidates(with_rule_spans(texts, "pii_source"), fit=True))
    selector = _boosted(_examples(cands, "pii_id", KINDS, "pii-candidates"), KINDS)
    selector.keys = _boosted(_examples(cands, "pii_id", ("key",), "pii-keys"), ("key",))
    return selector


def find_personal_data(docs: DataFrame, selector: Selector, text_col: str = "text") -> DataFrame:
    """docs with base_<kind> and all_<kind> arrays of (s, e), by start: code points of the text, end exclusive; all_key:
    key-like secrets alike. Columns of docs with these names are replaced; all others stay, whatever their names.

    base: what the rules find. all: base, and each candidate at or over its kind's threshold that covers a character
    which no base span of its kind covers alone and that overlaps no base span of another kind. A null or empty text
    has no spans. A text with very many spans takes longer (each candidate is compared with the base spans), but its rows
    never leave their task; equal rows get equal results.
    """
    new = [f"{x}_{k}" for x in ("base", "all") for k in KINDS] + ["all_key"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    out = with_rule_spans(docs.select(F.struct(*own).alias("pii_row"), F.col(f"`{text_col}`").alias("pii_source")), "pii_source")
    if selector.trees is not None:
        out = with_candidates(out)
    for kind in KINDS:
        least = selector.thresholds.get(kind)
        added = "cast(array() AS array<struct<s:int,e:int>>)"
        if least is not None:
            clear = " AND ".join(f"NOT exists(base_{k}, b -> b.s < c.e AND c.s < b.e)" for k in KINDS if k != kind)
            added = (
                f"transform(filter(cand_{kind}, c -> NOT exists(base_{kind}, b -> b.s <= c.s AND c.e <= b.e) AND {clear} "
                f"AND {selector.probability('c.f')} >= {least!r}D), c -> struct(c.s AS s, c.e AS e))"
            )
        out = out.withColumn(f"all_{kind}", F.expr(f"array_sort(array_union(base_{kind}, {added}))"))
    keys = "cast(array() AS array<struct<s:int,e:int>>)"
    if selector.keys is not None and selector.keys.thresholds.get("key") is not None:
        out = with_key_candidates(out)
        sure = f"c.same OR c.ok AND {selector.keys.probability('c.f')} >= {selector.keys.thresholds['key']!r}D"
        keys = f"transform(filter(cand_key, c -> {sure}), c -> struct(c.s AS s, c.e AS e))"
    return out.withColumn("all_key", F.expr(keys)).select("pii_row.*", *new)


def redact(docs: DataFrame, selector: Selector, text_col: str = "text") -> DataFrame:
    """docs with each span of all kinds replaced by [kind]; where spans overlap, the first one's mark stands for all."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("pii_docs"), or_empty(F.col(f"`{text_col}`")).alias("pii_text"))
    out = find_personal_data(rows, selector, "pii_text")
    every = F.array_sort(F.concat(*[F.expr(f"transform(all_{k}, x -> struct(x.s AS s, x.e AS e, '{k}' AS k))") for k in (*KINDS, "key")]))
    out = out.withColumn("pii_spans", every)
    done = F.expr(
        "aggregate(pii_spans, struct(0 AS at, '' AS out), (acc, x) -> IF(x.s < acc.at, struct(greatest(acc.at, x.e) AS at, acc.out AS out), "
        "struct(x.e AS at, concat(acc.out, substring(pii_text, acc.at + 1, x.s - acc.at), '[', x.k, ']') AS out)), "
        "acc -> concat(acc.out, substring(pii_text, acc.at + 1)))"
    )
    return out.select(*[done.alias(c) if c == text_col else F.col(f"pii_docs.`{c}`").alias(c) for c in docs.columns])


def _listed(prefix: str) -> Column:
    parts = [F.expr(f"transform({prefix}_{k}, x -> concat('{k}:', x.s, ':', x.e))") for k in KINDS]
    return F.array_join(F.concat(*parts), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of these kinds),
    n_key and key_spans (key-like secrets), n_found (all spans of all kinds)."""
    found = find_personal_data(docs.select("doc_id", "text"), fit_selector(docs))
    return found.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"),
        F.size("all_key").cast("long").alias("n_key"),
        F.array_join(F.expr("transform(all_key, x -> concat('key:', x.s, ':', x.e))"), ",").alias("key_spans"),
        sum((F.size(f"all_{k}") for k in KINDS), F.size("all_key")).cast("long").alias("n_found"),
    )
