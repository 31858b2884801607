"""Hand-made cases with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions import scores
from attestra.operators import audit, calibration, claims, decision, evaluation, importance, measures, models, reports, series, splits
from attestra.sources import policies, readers

POLICY = "SELECT 0.15e0 AS generation_lower, 0.95e0 AS generation_upper, 0.15e0 AS manipulation_lower, 0.95e0 AS manipulation_upper, 0.18e0 AS max_view_range, 0.30e0 AS max_window_range, 224 AS minimum_short_side, 8 AS minimum_frames, true AS generation_enabled, true AS manipulation_enabled"


def verdict(spark, generation=None, manipulation=None, region=False, instability=None, marker=None, width=640):
    rows = []
    if generation is not None:
        rows.append((1, 1, "a", "completed", "generation", generation, None, False))
    if manipulation is not None:
        rows.append((1, 2, "b", "completed", "manipulation", None, manipulation, region))
    d = spark.createDataFrame(rows, "media_id long, pos int, name string, status string, task string, synthetic_probability double, manipulation_probability double, has_region boolean")
    c = spark.createDataFrame(
        [(1, "image", width, 640, None, instability, marker, False, False)],
        "media_id long, media_type string, width int, height int, frames int, instability double, ai_marker string, camera_marker boolean, provenance_verified boolean",
    )
    return decision.media_verdict(d, c, spark.sql(POLICY)).first()["verdict"]


def test_verdict_cases(spark):
    assert verdict(spark, 0.95) == "likely_ai_generated"
    assert verdict(spark, 0.05, 0.04) == "likely_authentic"
    assert verdict(spark, 0.03) == "inconclusive"
    assert verdict(spark, 0.10, 0.98, region=True) == "likely_ai_manipulated"
    assert verdict(spark, 0.10, 0.98) == "inconclusive"
    assert verdict(spark, 0.98, instability=0.40) == "inconclusive"
    assert verdict(spark, 0.98, width=100) == "inconclusive"
    assert verdict(spark, 0.50, marker="tool") == "inconclusive"
    assert verdict(spark) == "inconclusive"


def test_three_way_counts(spark):
    s = spark.createDataFrame([(0.96, True), (0.55, True), (0.92, False), (0.40, False), (0.04, False)], "s double, y boolean")
    r = evaluation.three_way_metrics(s, 0.15, 0.90).first()
    assert (r["true_ai"], r["false_ai"], r["inconclusive"], r["true_authentic"]) == (1, 1, 2, 1)


def test_published_cells():
    assert (253 + 862) / (260 + 876) == pytest.approx(0.981514, abs=1e-6)


def test_safe_threshold(spark):
    rows = [(0.99, "manipulated"), (0.97, "manipulated"), (0.60, "authentic"), (0.50, "generated"), (0.20, "authentic"), (0.10, "generated")]
    r = calibration.safe_threshold(spark.createDataFrame(rows, "manipulation_score double, label string")).first()
    assert (r["threshold"], r["precision"], r["recall"]) == (0.97, 1.0, 1.0)


def test_limit_that_cannot_be_met_disables(spark):
    rows = [(0.9, "authentic"), (0.8, "generated")]
    r = calibration.upper_threshold(spark.createDataFrame(rows, "s double, label string"), "s", "generated", 0.95, 0.01).first()
    assert r["threshold"] is None


def test_empty_classes(spark):
    rows = spark.createDataFrame([], "s double, label string")
    assert evaluation.roc_auc(rows, "s", scores.GENERATED).first()["auc"] is None
    assert evaluation.calibration_error(rows, "s", scores.GENERATED).first()["ece"] is None


def test_positions(spark):
    df = spark.createDataFrame([(101, 5), (3, 8), (0, 4)], "n int, k int")
    got = {r["n"]: r["p"] for r in df.select("n", series.uniform_positions(F.col("n"), F.col("k")).alias("p")).collect()}
    assert got == {101: [0, 25, 50, 75, 100], 3: [0, 1, 2], 0: []}


def test_priority(spark):
    rows = spark.createDataFrame([("g", "train", "a"), ("g", "test", "b")], "source_group string, split string, path string")
    assert [r["split"] for r in splits.dedup_by_priority(rows, ["source_group"]).collect()] == ["test"]


def test_probability(spark):
    df = spark.createDataFrame([("0.5",), ("nan",), ("7",), ("-1",), ("x",), (None,), ("inf",)], "t string")
    assert [r[0] for r in df.select(scores.probability("t")).collect()] == [0.5, None, 1.0, 0.0, None, None, None]


def test_adaptive_positions_keep_required(spark):
    rows = [(1, i, float(i % 3) / 10, 1.0, 0.1, 0.9) for i in range(60)]
    f = spark.createDataFrame(rows, "video_id int, frame_index int, luma double, noise double, edge_density double, hist_correlation double")
    got = sorted(r["frame_index"] for r in series.adaptive_positions(f, 20).collect())
    assert len(got) == 20 and got[0] == 0 and got[-1] == 59


def random_predictions(spark, n=700, seed=3):
    import numpy as np

    r = np.random.default_rng(seed)
    label = r.choice(["authentic", "generated", "manipulated"], n)
    g, m = r.random(n) * 0.6 + 0.4 * (label == "generated"), r.random(n) * 0.6 + 0.4 * (label == "manipulated")
    area = np.where(label == "manipulated", 0.2 + 0.8 * r.random(n), r.random(n) ** 3)
    cols = [label, g, m, area, r.random(n) * 0.2, r.random(n) < 0.8]
    rows = [(str(a), float(b), None if i % 11 == 0 else float(c), float(d), float(e), bool(f), False) for i, (a, b, c, d, e, f) in enumerate(zip(*cols))]
    schema = "label string, generation_score double, manipulation_score double, predicted_region_area_ratio double, view_score_range double, localized_or_persistent_support boolean, force_inconclusive boolean"
    return rows, spark.createDataFrame(rows, schema)


def test_lower_thresholds_are_exact_above_any_size(spark):
    import numpy as np

    rows, preds = random_predictions(spark)
    both = [r for r in rows if r[2] is not None]
    g, m, syn = np.array([r[1] for r in both]), np.array([r[2] for r in both]), np.array([r[0] != "authentic" for r in both])
    limit = 0.02 * sum(r[0] != "authentic" for r in rows)
    want = min((-int(c.sum()), a, b) for a in g for b in m if (c := (g <= a) & (m <= b)).any() and (c & syn).sum() <= limit)
    for grid in (7, 256):
        r = calibration.lower_thresholds(preds, 0.02, grid=grid).first()
        assert (-r["coverage"], r["generation_lower"], r["manipulation_lower"], r["exact"]) == (*want, True)


def test_localized_rule_is_exact_above_any_number_of_areas(spark):
    import numpy as np

    rows, preds = random_predictions(spark, 1300, 5)
    scored = [r for r in rows if r[2] is not None]
    total = {k: sum(r[0] == k for r in scored) for k in ("authentic", "generated", "manipulated")}
    e = sorted((r for r in scored if r[5] and r[4] <= 0.18), key=lambda r: -r[2])
    area, score = np.array([r[3] for r in e]), np.array([r[2] for r in e])
    is_kind = {k: np.array([r[0] == k for r in e]) for k in total}
    best = None
    for a in {0.0, *[r[3] for r in scored]}:
        c = {k: (v & (area >= a)).cumsum() for k, v in is_kind.items()}
        for i in np.flatnonzero(area >= a):
            auth, gen, man = (int(c[k][i]) for k in ("authentic", "generated", "manipulated"))
            n = auth + gen + man
            if man / n >= 0.9 and auth / total["authentic"] <= 0.02 and gen / total["generated"] <= 0.05:
                key = (man, man / n, -(auth + gen), -a, score[i])
                best = max(best, key) if best else key
    for grid in (7, 256):
        r = calibration.localized_rule(preds, 0.9, 0.02, 0.05, 0.18, grid=grid).first()
        assert (r["true_manipulated"], r["precision"], -r["warnings"], -r["area"], r["score"]) == best


def test_large_leaking_group_is_excluded_whole(spark):
    from attestra.plans import audit_queries

    rows = [(f"doc/{i:03}", "h", "train" if i < 40 else "locked_test", "x") for i in range(60)]
    rows += [("doc/own", "k", "locked_test", "x"), ("DOC\\001", "m", "locked_test", "x"), ("doc/none", None, "locked_test", "x"), ("doc/none2", None, "train", "x")]
    manifest = spark.createDataFrame(rows, "path string, sha256 string, split string, class_label string")
    assert sorted(r["path"] for r in audit_queries.leakage_excluded(manifest).collect()) == ["doc/none", "doc/own"]
    groups = {r["sha256"]: r for r in audit.duplicate_groups(manifest, "sha256").collect()}
    assert groups["h"]["paths"] == [f"doc/{i:03}" for i in range(20)] and groups["h"]["count"] == 60 and set(groups) == {"h", None}


def test_messages_of_late_frames_are_kept(spark):
    from attestra.plans import claims_queries

    rows = [(1, i, " a " if i % 2 else "b\t") for i in range(12)] + [(1, 12, "late"), (1, 13, " "), (1, 14, None), (2, 0, "")]
    frames = spark.createDataFrame(rows, "video_id long, frame_index int, warning string")
    got = {r["video_id"]: r["messages"] for r in claims_queries.messages_unique_all(frames).collect()}
    assert got == {1: ["b", "a", "late"], 2: []}


def test_permutation_importance(spark):
    import random

    r = random.Random(1)
    rows = [(i, r.random(), r.random(), r.random() < 0.5) for i in range(400)]
    rows = [(i, a if y else -a, b, y) for i, a, b, y in rows]
    frame = spark.createDataFrame(rows, "id long, a double, b double, y boolean")
    got = importance.permutation_importance(frame, "id", ["a", "b"], lambda d: d.withColumn("s", 0.5 + F.col("a") / 2), repeats=4).collect()
    assert [x["feature"] for x in got] == ["a", "b"] and got[0]["importance"] > 0.4 and got[1]["importance"] == 0.0
    dealt = importance.permutations(frame, "id", ["a"], repeats=2, seed=3)
    for k in (1, 2):
        assert sorted(x["a"] for x in dealt.filter(F.col("repeat") == k).select("other.a").collect()) == sorted(a for _, a, _, _ in rows)
    assert importance.permutation_importance(frame.limit(0), "id", ["a"], lambda d: d.withColumn("s", F.col("a"))).count() == 0


def test_feature_bundles(spark):
    rows = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {"b": 5.0}), (3, None)], "id long, features map<string,double>")
    bundle = models.FeatureBundle(("a", "b"), total_predict, classes=("real", "FAKE"), threshold=3.0)
    got = {x["id"]: x for x in models.feature_model(rows, bundle, "id").collect()}
    assert [(got[i]["score"], got[i]["label"]) for i in (1, 2, 3)] == [(3.0, "likely_generated"), (5.0, "likely_generated"), (0.0, "lower_signal")]
    wrong = models.FeatureBundle(("a", "b"), total_predict, model_names=("b", "a"))
    assert {(x["status"], x["score"]) for x in models.feature_model(rows, wrong, "id").collect()} == {("unavailable", None)}
    broken = models.FeatureBundle(("a",), total_predict, classes=("x", "y", "z"))
    assert all(x["status"] == "unavailable" and "shape" in x["reason"] for x in models.feature_model(rows, broken, "id").collect())


def total_predict(x):
    return np.column_stack([np.zeros(len(x)), x.sum(axis=1)])


def test_bootstrap_is_a_multinomial_resample(spark):
    cells = [("authentic", "likely_authentic", 60), ("authentic", "inconclusive", 30), ("authentic", "likely_ai_generated", 10), ("generated", "likely_ai_generated", 40), ("generated", "inconclusive", 20)]
    frame = spark.createDataFrame([(a, v) for a, v, n in cells for _ in range(n)], "normalized_label string, verdict string")
    got = {x["metric"]: (x["low"], x["high"]) for x in evaluation.bootstrap_intervals(frame, samples=2000).collect()}
    rng = np.random.default_rng(0)
    draws = rng.choice(5, size=(2000, 160), p=[n / 160 for *_, n in cells])
    decided = np.isin(draws, [0, 2, 3]).mean(axis=1)
    false = (draws == 2).sum(axis=1) / np.maximum(1, (draws < 3).sum(axis=1))
    for name, values in (("decisive_coverage", decided), ("authentic_false_ai_rate", false)):
        assert got[name] == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])), abs=0.012)
    assert evaluation.bootstrap_intervals(frame.limit(0)).count() == 0


def test_json_keys(spark):
    cases = [
        (r'{"x": "he said \"manifest\": no", "manifest_a": 1}', 1), (r'{"a": [{"Claim": {"manifests": []}}], "b\\\\": "claim:"}', 2), (r'{"m\u0061nifest" : {}}', 1), ("[1, 2]", 0), ('{"claim": ', 0), ("", 0), (None, 0),
        ('{"long": "' + "x" * 100_000 + '", "claim" \n: 1}', 1),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {x["i"]: x["n"] for x in frame.select("i", claims.manifest_key_count(F.col("t")).alias("n")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases)}


def test_policies(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"generation": {"upper_threshold": 0.8, "more": {"b": 1, "a": 2}}, "quality": null, "calibration_id": "mine"}')
    r = policies.load_policy(spark, str(tmp_path / "p.json")).first()
    assert (r["generation_upper"], r["generation_lower"], r["minimum_short_side"], r["manipulation_upper"]) == (0.8, 0.15, None, 0.95)
    assert json.loads(r["policy"])["generation"]["more"] == {"a": 2, "b": 1} and list(json.loads(r["policy"])) == sorted(json.loads(r["policy"]))
    (tmp_path / "bad.json").write_text("{nothing")
    for path in (None, str(tmp_path / "none.json"), str(tmp_path / "bad.json")):
        assert json.loads(policies.load_policy(spark, path).first()["policy"]) == policies.DEFAULT_POLICY
    assert policies.configured_models(" b, a ,b,", ["p"], keep_packaged=True) == ["p", "b", "a"] and policies.configured_models(" ", ["p"]) == ["p"]


def test_audit_files_and_registries(spark, tmp_path):
    report = {"cross_split_exact_duplicates": [{"paths": ["train/A.png", "test\\b.png"]}, {"paths": ["train/c.png", "train/d.png"]}, {"paths": []}], "other": 1}
    (tmp_path / "audit.json").write_text(json.dumps(report))
    groups = readers.load_audit_groups(spark, str(tmp_path / "audit.json"))
    assert sorted((x["group"], x["place"], x["split"], x["cross_split"]) for x in groups.collect()) == [(0, 0, "train", True), (0, 1, "test", True), (1, 0, "train", False), (1, 1, "train", False)]
    samples = spark.createDataFrame([("test/B.PNG", "test"), ("test/x.png", "test"), ("train/a.png", "train")], "path string, split string")
    assert [x["path"] for x in readers.without_audited(samples, groups, "test").collect()] == ["test/x.png"]
    (tmp_path / "registry.json").write_text(json.dumps({"registry_version": "1", "models": [{"id": "m", "task": "generation", "enabled_by_default": True}, {"task": "x"}]}))
    assert [(x["id"], x["enabled_by_default"]) for x in readers.load_registry(spark, str(tmp_path / "registry.json")).collect()] == [("m", True)]
    (tmp_path / "rows.csv").write_text("path,manipulation_score,predicted_region_area_ratio,view_score_range,localized_or_persistent_support,stable_across_views\na,0.5,0.1,0.2,TRUE,no\nb,x,0.1,0.2,1,1\n")
    assert [(x["path"], x["localized_or_persistent_support"], x["stable_across_views"]) for x in readers.read_localizer_rows(spark, str(tmp_path / "rows.csv")).collect()] == [("a", True, False)]
    readers.write_predictions_csv(samples, str(tmp_path / "out"), ["path", "split"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_hot_keys_are_thinned(spark):
    rows = spark.createDataFrame([("k" if i % 10 else None, i % 7, i) for i in range(500)], "key string, a int, b int")
    got = {(x["key"], x["rank"]): (x["a"], x["b"], x["total"], x["beyond"]) for x in reports.capped(rows, ["key"], [F.desc("a"), F.asc("b")], 3).collect()}
    assert got == {(None, 1): (6, 20, 50, 47), (None, 2): (6, 90, 50, 47), (None, 3): (6, 160, 50, 47), ("k", 1): (6, 6, 450, 447), ("k", 2): (6, 13, 450, 447), ("k", 3): (6, 27, 450, 447)}
    names = [f"{s}/{i:04d}" for s in "ab" for i in range(700)]
    ring = {x["path"]: x["donor"] for x in splits.donor_ring(spark.createDataFrame([(n, n[0]) for n in names] + [("z", "z")], "path string, split string")).collect()}
    for s in "ab":
        own = [n for n in names if n[0] == s]
        assert [ring[n] for n in own] == own[1:] + own[:1]
    assert ring["z"] == "z"
    near = audit.hamming_near_prints(spark.createDataFrame([(0,), (15,), (31,), (-1,), (None,)], "fp long"), 4).collect()
    assert sorted((x["fa"], x["fb"], x["distance"]) for x in near) == [(-1, -1, 0), (0, 0, 0), (0, 15, 4), (15, 15, 0), (15, 31, 1), (31, 31, 0)]
    assert measures_box(spark) == [0, 5, 40, 30]


def measures_box(spark):
    return spark.range(1).select(measures.expand_box(F.array(*[F.lit(x) for x in (5, 15, 30, 28)]), F.lit(10), F.lit(200), F.lit(30)).alias("b")).first()["b"]


def test_windows_of_each_series(spark):
    frames = spark.createDataFrame([(v, i, i / 10, i / 20, 10.0) for v in (1, 2) for i in range(10)], "video_id long, frame_index int, ai_probability double, manipulation_probability double, fps double")
    own = spark.createDataFrame([(1, 0, 1), (2, 8, 9)], "video_id long, start_frame int, end_frame int")
    got = sorted((x["video_id"], x["start_frame"], round(x["generation"], 6), x["n"]) for x in series.window_scores(own, frames).collect())
    assert got == [(1, 0, 0.05, 2), (2, 8, 0.85, 2)]
    every = series.window_scores(own.select("start_frame", "end_frame"), frames)
    assert every.count() == 4
    last = series.per_series(frames.select("video_id", "frame_index"), "video_id", "frame_index", lambda p: p.tail(1), "video_id long, frame_index int")
    assert sorted(tuple(x) for x in last.collect()) == [(1, 9), (2, 9)]


def test_video_context_takes_losses_off_one_by_one(spark):
    frames = spark.createDataFrame([(1, t, 0.1, 0.1) for t in (56.0, 56.0, 56.0, 56.0, 57.0, 0.0)], "video_id long, truth_score double, ai_probability double, manipulation_probability double").coalesce(1)
    assert series.video_context_score(frames, 320, 480).first()["score"] == 30  # 30.5 to the even one; 46.8333 - (3.3333 + 5 + 8) is 30.500000000000004


def test_threshold_sweep_equals_plain_counts(spark):
    from attestra.operators.evaluation import binary_metrics, threshold_sweep

    steps = [0.5, 0.05, 0.1, 0.3, 0.5]
    values = [0.0, 0.05, 0.1 - 1e-17, 0.1, 0.3, 0.29999999999999999, 0.1 + 0.2, 0.5, 1.0, None, float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(v, y) for v in values for y in (True, False, True, None)], "s double, y boolean")
    got = {r["threshold"]: r.asDict() for r in threshold_sweep(rows, steps).collect()}
    want = {t: binary_metrics(rows, F.lit(t)).first().asDict() | {"threshold": t} for t in set(steps)}
    assert got == want


def test_candidates_are_fitted_on_all_cores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "PART_ROWS", 10, raising=False)
    monkeypatch.setattr(models, "_scored_models", lambda rows, estimators: seen.append((rows.rdd.getNumPartitions(), rows.count(), len(estimators))), raising=False)
    rows = spark.range(200).selectExpr("cast(id % 7 AS double) AS a", "cast(id % 2 AS int) AS y", "if(id % 3 = 0, 'validation', 'train') AS split").coalesce(1)
    models.fit_candidates(rows, ["a"])
    assert seen == [(spark.sparkContext.defaultParallelism, 200, 4)]


def test_claim_features_of_odd_texts(spark):
    texts = [
        "source:x", "xsource:y", "a source: b", "An official.", "unofficial", "𝐀official official", "bbc", "abbc bbcs", "https:/ http//", "(http://a)", "AP News", "by Jan", "Janet", "on 1/2/34\n", "1/2/3456x", "U.S.", "U.S.A",
        "in New York", "Foo\x0bBar", "foo Bar", "Foo Bar2", "AB", "ABc AB cd", "A1 BC_D", "aB Cd", "É AB", "", " \t\x0b\n", None, "\n x  y z\t", "1999", "x2019", "UK?", "𝐔UK",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = F.trim(F.coalesce(F.col("text"), F.lit("")))
    words = F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Za-z]{2,}$"))
    caps = F.filter(words, lambda w: w.rlike("^[A-Z]+$"))
    want = docs.select(
        "doc_id", (F.lower(t).rlike("|".join(claims.SOURCE_PATTERNS)) | F.lower(t).rlike(claims.bounded("|".join(claims.SOURCE_WORDS)))).alias("has_source"),
        F.when(F.size(words) > 0, F.size(caps) / F.size(words)).otherwise(F.lit(0.0)).alias("caps_ratio"),
        (t.rlike(claims.bounded(claims.DATES)) | t.rlike(claims.bounded(claims.PLACES)) | t.rlike(claims.bounded(claims.NAMES))).alias("has_details"),
        F.size(F.filter(F.split(t, r"[ \t\n\r\f\x0b]+"), lambda w: w != "")).alias("word_count"),
    )
    got = claims.claim_features(docs)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 5 and plan.count("split(") <= 2  # each text is searched and split once for each purpose
