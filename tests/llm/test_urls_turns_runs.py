"""URL rules, conversation repair and periodic runs: hand-made cases, odd rows, brute force where SQL cannot say it."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import periodic_runs, turn_repair, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(6, 4 * q) and not any(all(w[s + k] == w[s + k + p] for k in range(n - p)) for p in range(1, q)):
                found.append((s, n, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def periodic_words(r):
    w = [str(r.randint(0, r.choice([1, 2, 6]))) for _ in range(r.randint(0, 60))]
    if w and r.random() < 0.6:
        s, p = r.randrange(len(w)), r.randint(1, 7)
        for i in range(s + p, len(w)):
            w[i] = w[i - p]
    return w


def test_runs_of_random_words():
    r, some = random.Random(3), 0
    for _ in range(1500):
        w = periodic_words(r)
        want = brute_runs(w)
        ids = np.unique(w, return_inverse=True)[1] if w else np.empty(0, dtype=np.int64)
        assert (periodic_runs.runs_of(ids) if w else []) == want
        if want:
            some += 1
            assert periodic_runs.suspects(np.concatenate([ids, ids]), np.array([len(w), 2 * len(w)])).tolist() == [0, 1]
    assert some > 300


def expected_report(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = sorted(runs, key=lambda x: (-x[1], x[0], x[2]))[0] if runs else None
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        **dict(zip(("start", "length", "period", "exponent_milli"), (*best, 1000 * best[1] // best[2]) if best else [None] * 4)),
        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    }


def test_periodic_report(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a a", "ab\u00a0ab " * 9, "é ü\x0bé\x0cü é ü é ü é ü", "x " * 3000 + "y"]
    texts += [" ".join(periodic_words(r)) for _ in range(150)] + [texts[-1]] * 3
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(4, "b b b b b b", "en", "s", 0)] * 2
    frame = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("own")).withColumn("runs_sha256", F.lit(1))
    got = [x.asDict() for x in periodic_runs.periodic_report(frame).collect()]
    key = lambda x: (x["doc_id"], x["runs_sha256"], x["collapsed_sha256"])
    assert sorted(got, key=key) == sorted((expected_report(i, t) for i, t, *_ in rows), key=key)
    assert sum(x["n_runs"] > 0 for x in got) > 20
    assert periodic_runs.periodic_report(frame.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "q q q q q q q", "en", "s", 0)], DOCS)
    assert periodic_runs.periodic_report(null_id).first()["length"] == 7


def test_runs_and_collapsed_texts(spark):
    frame = spark.createDataFrame([(1, "a b a b a b a b  c"), (2, None), (3, "x y z")], "k long, body string")
    got = {x["k"]: x for x in periodic_runs.periodic_runs(frame, "k", "body").collect()}
    assert got[1]["n_words"] == 9 and [tuple(x) for x in got[1]["runs"]] == [(0, 8, 2)] and got[2]["runs"] == []
    text = {x["k"]: (x["body"], x["n_dropped"]) for x in periodic_runs.collapse_runs(frame, "k", "body").collect()}
    assert text == {1: ("a b c", 6), 2: ("", 0), 3: ("x y z", 0)}


def best_edits(rows):
    """Cheapest and ASCII-least edits of (role, text, fault) rows, by trying all of them."""
    best = None

    def walk(i, roles, audit, cost, out, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and (not roles or roles.lstrip("s") == "ua" * (len(roles.lstrip("s")) // 2) and roles.count("s") <= 1 and len(roles.lstrip("s"))):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
        want = "a" if roles.endswith("u") else "u"
        name = "assistant" if want == "a" else "user"
        if inserted < 2:
            walk(i, roles + want, audit + "I", cost + 3, [*out, f"{name}:"], inserted + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        walk(i + 1, roles, audit + "D", cost + 4, out, 0)
        if fault in ("blank", "duplicate"):
            return
        extra = 3 * (fault == "truncated")
        if role[:1] == want or (role[:1] == "s" and not roles):
            walk(i + 1, roles + role[:1], audit + "K", cost + extra, [*out, f"{role}:{text}"], 0)
        walk(i + 1, roles + want, audit + "R", cost + 3 + extra, [*out, f"{name}:{text}"], 0)

    walk(0, "", "", 0, [], 0)
    return best


def test_repair_of_random_conversations():
    r = random.Random(7)
    for _ in range(400):
        rows = [(r.choice(["user", "assistant", "system", "", "uu", "tool"]), f"t{i}", r.choice([None, None, "blank", "truncated", "duplicate"])) for i in range(r.randint(0, 6))]
        c = turn_repair.Conversation(1)
        for i, (role, text, fault) in enumerate(rows):
            c.add(i, role, text, fault)
        done = c.finish()
        cost, audit, out = best_edits(rows)
        assert (done[6], done[7], done[8]) == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), rows


def test_long_conversation_holds_few_edits():
    for period in (["user", "assistant"], ["user"], ["assistant", "user", "user"], ["system"]):
        held, c = 0, turn_repair.Conversation(1)
        for i in range(20_000):
            c.add(i, period[i % len(period)], f"t{i}", (None, "truncated", None, "blank", "duplicate")[i % 5] if len(period) > 1 else "truncated")
            held = max(held, len(c.repair.rows))
        assert held <= 2 * turn_repair.LOOK and len(c.finish()[7]) >= 20_000


def test_repair_report(spark):
    r = random.Random(11)
    rows = []
    for conv in range(60):
        for t in range(r.randint(1, 9)):
            text = r.choice([None, "", " \t", "Yes.", "Yes.", "No", f"text {t}!", "é?\n"])
            rows.append((None if conv == 59 else conv, None if r.random() < 0.05 else t, r.choice([None, "", "user", "assistant", "system"]), text))
    rows += rows[:9]
    frame = spark.createDataFrame(rows, TURNS)
    c = duckdb.connect()
    c.register("conversations", frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    key = lambda x: str(x)
    want = sorted(c.execute(f"SELECT {', '.join(names)} FROM ({turn_repair.SQL})").fetchall(), key=key)
    wide = frame.withColumn("fault", F.lit("own")).withColumn("dropped", F.lit(3)).withColumn("cost", F.lit(None))
    assert sorted((tuple(x) for x in turn_repair.repair_report(wide).select(*names).collect()), key=key) == want
    assert turn_repair.repair_report(frame.limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", False), (1, 1, "user", "Hi.", False), (1, 2, "system", "So.", False), (2, 0, "", "", True)], TURNS + ", dropped boolean")
    got = sorted(tuple(x) for x in turn_repair.repaired_turns(rows).collect())
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "D", "user", "Hi."), (1, 2, "R", "assistant", "So.")]
    summary = {x["conv_id"]: x for x in turn_repair.repair_summary(rows).collect()}
    assert summary[1]["cost"] == 7 and summary[2]["audit"] == "" and summary[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


URLS = [
    (None, "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("http://A.Example.NET/en/1?x=2#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://a.example.net/de/1", "a.example.net", "/de/1", "net/", "block"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("https://example.com/de", "example.com", "/de", None, "allow"),
    ("https://x.org/fr/a/b#c", "x.org", "/fr/a/b", "org/fr/", "allow"),
    ("https://net?q=/", "net", "", None, "allow"),
    ("://net/", "net", "/", "net/", "block"),
    ("a://b://net/", "b:", "//net/", None, "allow"),
    ("http://É.COM/de/\nx", "É.com", "/de/\nx", None, "allow"),
]


def test_fixed_rules(spark):
    labelled = spark.createDataFrame([], "url string, bad boolean")
    pages = spark.createDataFrame([(i, u[0], "own") for i, u in enumerate(URLS)], "page_id long, url string, tokens string")
    mined = url_rules.mine_rules(labelled)
    got = {x["page_id"]: x for x in url_rules.judge_urls(pages, mined).collect()}
    assert mined.count == 0 and len(got) == len(URLS) and got[0]["tokens"] == "own"
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), i
    assert url_rules.judge_urls(pages.limit(0), mined).count() == 0


@pytest.fixture(scope="module")
def labelled_rows():
    r = random.Random(13)
    rows = []
    for i in range(600):
        host, lang = r.choice(["spam.example.com", "good.example.com", "mixed.example.org"]), r.choice(["en", "de"])
        bad = r.random() < (0.9 if host.startswith("spam") else 0.7 if host.startswith("mixed") and lang == "de" else 0.1)
        rows.append((f"https://{host}/{lang}/{i}?ref=x", bad))
    return rows + [(None, True), ("https://good.example.com/en/1", None)]


def test_mined_rules_equal_counts_of_all_combinations(spark, labelled_rows):
    mined = url_rules.mine_rules(spark.createDataFrame(labelled_rows, "url string, bad boolean"), min_support=0.05)
    known = [(u, b) for u, b in labelled_rows if u and b is not None]
    frame = spark.createDataFrame(known, "url string, bad boolean").select(url_rules.url_tokens(F.col("url")).alias("t"), "bad")
    sets = [(frozenset(x["t"]), x["bad"]) for x in frame.collect()]
    overall, want = sum(b for _, b in sets) / len(sets), {}
    for n in range(1, url_rules.MAX_TOKENS + 1):
        for combo in itertools.combinations(sorted(set().union(*(s for s, _ in sets))), n):
            held = [b for s, b in sets if s.issuperset(combo)]
            if held and sum(held) >= 0.05 * len(sets) and sum(held) / len(held) >= max(url_rules.MIN_CONFIDENCE, url_rules.MIN_LIFT * overall):
                want[combo] = sum(held) / len(held)
    least = {c: p for c, p in want.items() if not any(set(o) < set(c) and want[o] >= p for o in want)}
    got = {tuple(x["antecedent"]): x["confidence"] for x in mined.rules.collect()}
    assert got == pytest.approx(least) and ("host=spam",) in got and mined.count == len(got)
    assert all(x["key_token"] in x["antecedent"] and x["n_tokens"] == len(x["antecedent"]) for x in mined.rules.collect())


def test_urls_judged_by_mined_rules(spark, labelled_rows):
    mined = url_rules.mine_rules(spark.createDataFrame(labelled_rows, "url string, bad boolean"), min_support=0.05)
    rules = mined.rules.collect()
    urls = ["https://spam.example.com/fr/7", "http://m.good.example.com/en/1?ref=x", "https://mixed.example.org/de/9?ref=x", "https://mixed.example.org/en/9", "https://spam.example.net/de/1", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    tokens = {x["page_id"]: set(x["t"]) for x in pages.select("page_id", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    for broadcast in (True, False):
        got = url_rules.judge_urls(pages, mined if broadcast else url_rules.UrlRules(mined.rules, url_rules.BROADCAST_RULES + 1)).collect()
        assert len(got) == 7
        for x in got:
            fits = sorted((-c["confidence"], -c["support"], c["rule_id"]) for c in rules if set(c["antecedent"]) <= tokens[x["page_id"]])
            if x["page_id"] == 4:
                assert (x["rule"], x["verdict"], x["mined_rule"]) == ("net/", "block", None)
            else:
                assert (x["verdict"], x["mined_rule"]) == (("block", fits[0][2]) if fits else ("allow", None)), x
    assert {x["page_id"] for x in got if x["verdict"] == "block"} >= {0, 2, 4}


def test_labels_of_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/12.html"), (2, "http://a.b/12/"), (3, "http://a.b/x"), (4, None), (5, "http://a.b/99999999999999999999")], "page_id long, url string")
    labels = spark.createDataFrame([(12, 1, 0), (12, None, 1), (7, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(x) for x in url_rules.labelled_urls(pages, labels).collect())
    assert got == [("http://a.b/12/", True), ("http://a.b/en/12.html", True)]
