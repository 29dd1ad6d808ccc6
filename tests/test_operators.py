import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import cleaning, features, ingest, labels, metrics, model, regress, scoring, search

NUMBERS = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(float("nan"))), max_size=30)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, values, schema):
    return spark.createDataFrame(values, schema)


@FEW
@given(NUMBERS)
def test_no_outlier_is_left(spark, values):
    df = cleaning.nan_to_null(frame(spark, [(float(v) if v is not None else None,) for v in values], "x double"))
    there = [v for v in values if v is not None and not math.isnan(v)]
    mean = sum(there) / len(there) if there else 0
    sd = math.sqrt(sum((v - mean) ** 2 for v in there) / len(there)) if there else 0
    kept = [r.x for r in cleaning.outlier_cut(df, "x").collect()]
    assert all(abs(v - mean) <= 3.001 * sd for v in kept)
    assert len(kept) + cleaning.outliers(df, "x").count() == (len(there) if sd > 1e-9 * max(1, abs(mean)) else len(kept) + cleaning.outliers(df, "x").count())


def test_constant_column_is_dropped(spark):
    assert cleaning.outlier_cut(frame(spark, [(1.0,)] * 3, "x double"), "x").count() == 0


def test_clean_listings(spark):
    schema = "source_id string, price_man_yen int, layout string, floor_number int, floors_total int, image_count int"
    rows = [(str(i), 1000 + i, "2LDK", 3, 10, 6) for i in range(30)] + [("f", 1010, "1SLDK", 9, 4, 5), ("few", 1000, "1K", 1, 2, 4), ("null", None, "1K", 1, 2, 9), ("rich", 10**6, "1K", 1, 2, 9)]
    images = frame(spark, [("f", "a"), ("f", "b"), ("few", "c"), ("gone", "d")], "source_id string, image_name string")
    kept, left = cleaning.clean_listings(frame(spark, rows, schema), images)
    by = {r.source_id: r for r in kept.collect()}
    assert len(by) == 31 and (by["f"].floors_total, by["f"].rooms_num, by["f"].base_layout) == (18, 1, "LDK")
    assert all(r.floor_number <= r.floors_total for r in by.values()) and left.count() == 2


def test_listing_scores_and_pivot(spark):
    images = frame(spark, [("a", "kitchen", 0.2), ("a", "kitchen", 0.4), ("a", "floor plan", None), ("a", "toilet", 1.0), ("a", "kitchen", None), ("b", "kitchen", 0.1), (None, "kitchen", 0.1)], "source_id string, room string, luxury double")
    listings = frame(spark, [("a", 1), ("b", 2)], "source_id string, price int")
    wide = scoring.listing_scores(listings, images, "source_id", "room", ["luxury"]).collect()
    assert len(wide) == 1 and wide[0].luxury_kitchen == pytest.approx(0.3) and wide[0].luxury_living_room is None
    piv = scoring.pivot_rooms(scoring.room_means(images, "source_id", "room", ["luxury"]), "source_id", "room", ["luxury"])
    assert piv.columns == ["source_id"] + [f"luxury_{r}" for r in ("bathroom", "bedroom", "kitchen", "living_room", "toilet")]


def test_scoring_skips_floor_plans_and_resumes(spark):
    images = frame(spark, [("a", "kitchen", True), ("b", "floor plan", True), ("c", "toilet", False)], "path string, room_type string, there boolean")
    done = scoring.score_images(images, scoring.stub_scorer("path"), "path string, room_type string, there boolean, scores string", exists="there", keys=scoring.ATTRIBUTES)
    by = {r.path: r.scores for r in done.collect()}
    assert "-1000.0" in by["b"] and "-996.0" in by["c"] and "-9" not in by["a"][:12]
    left = scoring.to_score(images, done, "path", scoring.ATTRIBUTES)
    assert {r.path for r in left.collect()} == {"b", "c"}


def test_quartiles_and_scaling(spark):
    df = frame(spark, [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, y double")
    fit = features.fit_robust(df, ["x", "y"])
    assert fit.first().x == [1.75, 2.5, 4.75]
    assert [r.y for r in features.robust_scale(df, fit, ["x", "y"]).collect()] == [0.0] * 4


@FEW
@given(st.integers(0, 60), st.integers(2, 7))
def test_splits_folds_and_batches(spark, n, folds):
    df = spark.range(n)
    assert sum(r.is_test for r in features.split_by_hash(df, "id").collect()) == math.ceil(0.3 * n)
    got = [r.fold for r in sorted(features.fold_ids(df, "id", folds).collect())]
    want = [f for f in range(folds) for _ in range(n // folds + (f < n % folds))]
    assert got == want
    batches = [r.batch for r in sorted(features.batch_numbers(df, [F.col("id")], 5, 10).collect())]
    assert batches == [0 if i < 5 else 1 + (i - 5) // 10 for i in range(n)]


def test_batch_cuts():
    assert features.batch_cuts(10, 4) == [2, 5, 7, 10] and features.batch_cuts(7, 4) == [1, 3, 5, 7]


def test_confusion_of_the_label_register(spark):
    rows = [(False, False)] * 19 + [(False, True)] * 11 + [(True, False)] * 8 + [(True, True)] * 21
    got = metrics.classification_metrics(frame(spark, rows, "y boolean, p boolean"), F.col("y"), F.col("p")).first()
    assert (got.tn, got.fp, got.fn, got.tp) == (19, 11, 8, 21)
    assert (got.accuracy, got.precision, got.recall) == pytest.approx((40 / 59, 21 / 32, 21 / 29))
    none = metrics.classification_metrics(frame(spark, [(False, False)], "y boolean, p boolean"), F.col("y"), F.col("p")).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)


def test_ties_of_the_nearest(spark):
    df = frame(spark, [(0, 0.1), (1, 0.5), (2, 0.5), (3, 0.4)], "seq int, similarity double")
    assert [r.seq for r in search.top_k(df, 2, "seq").collect()] == [1, 2]


def test_search_takes_images_before_bounds(spark):
    images = frame(spark, [("a", 0, [1.0, 0.0]), ("b", 1, [0.9, 0.1]), ("c", 2, [])], "source_id string, seq int, embedding array<double>")
    listings = frame(spark, [("a", 9, "Fair"), ("b", 1, "Good Deal"), ("c", 1, "Fair")], "source_id string, price int, deal string")
    q = F.array(F.lit(1.0), F.lit(0.0))
    ids = lambda **k: sorted(r.source_id for r in search.search(images, listings, key="source_id", tie="seq", **k).collect())
    assert ids(query=q, k=1, most={"price": 5}) == [] and ids(query=q, k=2, most={"price": 5}) == ["b"]
    assert ids(query=None, most={"price": 5}) == ["b", "c"] and ids(query=None, good_deals=True) == ["b"]


def test_ingest_state(spark):
    log = frame(spark, [("a", 1, "e", "x"), ("a", 2, "e", "y" * 300), ("b", 1, "e", "x"), ("b", 2, "ok", None), ("c", 1, "ok", None), ("c", 2, "e", "z")], "k string, t int, kind string, why string")
    got = {r.k: r for r in ingest.failures(log, "k", F.col("kind") == "e", F.col("kind") == "ok", "t", "why").collect()}
    assert set(got) == {"a", "c"} and (got["a"].attempts, got["a"].last_at, len(got["a"].last_reason)) == (2, 2, 240)
    assert ingest.next_delay(1.0, True) == 1.5 and ingest.next_delay(4.9, True) == 5.0 and ingest.next_delay(1.05, False) == 1.0
    state = spark.range(3).select(ingest.listing_status(F.col("id"), F.when(F.col("id") == 2, F.lit("x"))).alias("s"))
    assert [r.s for r in state.collect()] == ["low_quality", "low_quality", "failed"]


def test_labels(spark):
    rows = frame(spark, [(0, "u0", "q"), (1, "", "q"), (2, "u2", None)], "i int, url string, Luxury string")
    known = frame(spark, [("u0", "yes", 1), ("u0", "no", 2), ("", "bad", 3)], "url string, Luxury string, seq int")
    over = labels.overlay(rows, known, "url", ["Luxury", "Room"], [F.desc("seq")]) if "Room" in known.columns else labels.overlay(rows, known, "url", ["Luxury"], [F.desc("seq")])
    assert [r.Luxury for r in over.orderBy("i").collect()] == ["no", "q", ""]
    assert labels.first_unlabelled(over, F.col("Luxury"), "i", 1).first().i == 2
    assert labels.first_unlabelled(over.filter("i <> 2"), F.col("Luxury"), "i").count() == 0
    assert labels.upsert(frame(spark, [("a", 1)], "url string, x int"), frame(spark, [("a", "n")], "url string, y string"), "url").first().y == "n"


def test_regressions(spark):
    rows = [(float(i), float(i % 7), 3.0 + 2 * i - 0.5 * (i % 7)) for i in range(50)]
    df = frame(spark, rows, "x double, z double, y double")
    fit = regress.ols(df, "y", ["x", "z"])
    assert fit == pytest.approx({"const": 3.0, "x": 2.0, "z": -0.5, "r2": 1.0}, abs=1e-6)
    assert regress.partial_slope(df, "y", "x", ["z"]).first().slope == pytest.approx(2.0)
    odd = df.unionByName(frame(spark, [(60.0, 0.0, 500.0)], "x double, z double, y double"))
    worst = regress.influence(odd, "y", ["x", "z"]).orderBy(F.desc("cooks_d")).first()
    assert worst.x == 60.0
    assert regress.influence(odd, "y", ["x", "z"]).agg(F.sum("leverage")).first()[0] == pytest.approx(3.0)


def test_models(spark):
    rows = [(i, float(i % 10), float(i % 3), math.log1p(100 + 50 * (i % 10) + 5 * (i % 3)), i % 5) for i in range(120)]
    df = frame(spark, rows, "id int, a double, b double, y double, fold int").cache()
    fitted = model.train(df, ["a", "b"], "y", model.forest("y", numTrees=10, maxDepth=6))
    assert model.evaluate(fitted, df, "y").first().r2 > 0.9 and model.evaluate(None, df, "y") is None
    assert all(p.predicted_price == round(p.predicted_price) for p in model.predict(fitted, df).collect())
    assert max(model.grid_search(df, ["a", "b"], "y", "fold").values()) > 0.8
    ridge = model.train(df, ["a", "b"], "y", model.polynomial_ridge("y", 1e-6), expand=3)
    assert model.evaluate(ridge, df, "y").first().r2 > 0.99
    near = {r.id: r.prediction for r in model.knn_predict(df, df, ["a", "b"], "y", "id", k=3).collect()}
    assert all(near[i] == pytest.approx(y) for i, _, _, y, _ in rows)


def test_repeated_changes_and_places_count_once(spark):
    from tessera.operators import cleaning, labels

    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, labels.upsert(table, changes, "k").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    places = spark.createDataFrame([("p", 2.0, 3.0), ("p", 1.0, 4.0), ("p", None, 0.0)], "address string, latitude double, longitude double")
    listings = spark.createDataFrame([("p", None, None), ("q", None, 1.0)], "address string, latitude double, longitude double")
    assert sorted(map(tuple, cleaning.fill_coordinates(listings, places).collect())) == [("p", 1.0, 4.0), ("q", None, None)]  # both come from the table where either is missing


def test_mode_fills_and_needs_no_value(spark):
    rows = [(1, "b"), (2, "a"), (3, None), (4, "a"), (5, "b")]
    df = frame(spark, rows, "id int, v string")
    assert {r.id: r.v for r in features.impute_mode(df, "v").collect()}[3] == "a"
    assert features.impute_mode(df.filter("v is null"), "v").collect()[0].v is None


def test_keys_are_dropped_and_nulls_stay(spark):
    df = frame(spark, [("a",), ("b",), (None,)], "k string")
    assert {r.k for r in cleaning.drop_keys(df, "k", ["a"]).collect()} == {"b", None}
    assert cleaning.drop_keys(df, "k", []).count() == 3


def test_failing_rows_are_null_and_parts_resume(spark, tmp_path):
    def score(rows):
        if (rows["path"] == "bad").any():
            raise ValueError("not an image")
        return rows["path"] + "!"

    df = frame(spark, [(p,) for p in ("a", "bad", "c", "d")], "path string")
    scorer = scoring.tolerant(score, attempts=2, wait=0.0)
    assert cleaning.drop_keys(df, "path", df.filter("path = 'bad'")).count() == 3
    run = lambda part: scoring.infer(part, scorer, "path string, scores string")
    want = {"a": "a!", "bad": None, "c": "c!", "d": "d!"}
    assert {r.path: r.scores for r in scoring.score_in_parts(df, str(tmp_path / "s"), "path", run, 3).collect()} == want

    def never(part):
        raise AssertionError("a whole part is scored again")

    assert {r.path: r.scores for r in scoring.score_in_parts(df, str(tmp_path / "s"), "path", never, 3).collect()} == want


def test_saved_models_predict_alike(spark, tmp_path):
    df = frame(spark, [(float(i), math.log1p(10.0 + i)) for i in range(40)], "a double, y double")
    fitted = model.train(df, ["a"], "y", model.forest("y", numTrees=3, maxDepth=3))
    model.save(fitted, str(tmp_path / "m"), {"quartiles": features.fit_robust(df, ["a"])})
    again, state = model.load(spark, str(tmp_path / "m"), ("quartiles",))
    assert [r.predicted_price for r in model.predict(again, df).collect()] == [r.predicted_price for r in model.predict(fitted, df).collect()]
    assert state["quartiles"].first().a[1] == 19.5


def test_stored_attempts_are_one_at_least(spark):
    df = frame(spark, [("3",), (" 2 ",), ("0",), ("-4",), ("x",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(ingest.stored_attempts(F.col("n"))).collect()] == [3, 2, 1, 1, 1, 1, 1]


def test_failing_rows_are_tried_again_and_good_ones_are_not(spark):
    import pandas as pd

    calls, waits = [], []

    def score(rows):
        calls.append(list(rows["path"]))
        if "bad" in set(rows["path"]) or ("late" in set(rows["path"]) and sum("late" in c for c in calls) < 4):
            raise ValueError("no answer")
        return rows["path"] + "!"

    paths = ["a", "b", "bad", "c", "late", "d", "e"]
    (got,) = scoring.tolerant(score, attempts=4, wait=1.0, rows=3, sleep=waits.append)(iter([pd.DataFrame({"path": paths})]))
    assert list(got["scores"]) == ["a!", "b!", None, "c!", "late!", "d!", "e!"]
    asked = lambda p: sum(p in c for c in calls)
    assert [asked(p) for p in ("a", "b", "c", "d")] == [2, 2, 2, 2] and asked("e") == 1 and asked("bad") == 5 and waits[:3] == [1.0, 2.0, 4.0]


def test_adaptors_of_models(spark):
    import pandas as pd

    batch = pd.DataFrame({"path": ["a", "bad", "zero", "none"]})

    def fails(answers):
        def run(rows):
            if "bad" in set(rows["path"]):
                raise OSError("unreadable")
            return [answers[p] for p in rows["path"]]

        return run

    one = lambda scorer, out: list(next(iter(scorer(iter([batch]))))[out])
    assert one(scoring.labelling_scorer(fails({"a": {"kitchen": 0.4, "bedroom": 0.6}, "zero": {"toilet": 0.5, "bedroom": 0.5}, "none": {}})), "room_type") == ["bedroom", None, "toilet", None]
    assert one(scoring.default_image_scorer(fails({"a": 1, "zero": 0, "none": 7})), "default_image") == [1, 2, 0, 2]
    vectors = one(scoring.embedding_scorer(fails({"a": [3.0, 4.0], "zero": [0.0, 0.0], "none": None})), "embedding")
    assert vectors[0] == pytest.approx([0.6, 0.8]) and vectors[1:] == [[], [], []]


def test_parts_keep_a_column_named_part_and_read_their_own_rows(spark, tmp_path):
    df = frame(spark, [(str(i), i) for i in range(40)], "path string, part int")
    seen = []

    def score(rows):
        seen.append(rows.count())
        return rows.withColumn("scores", F.lit("s"))

    got = scoring.score_in_parts(df, str(tmp_path / "s"), "path", score, 4)
    assert sorted((r.path, r.part, r.scores) for r in got.collect()) == sorted((str(i), i, "s") for i in range(40)) and sum(seen) == 40


def test_search_and_ablation(spark):
    rows = [(i, float(i % 10), float(i % 3), 2.0 * (i % 10) + i % 3, i % 3) for i in range(90)]
    df = frame(spark, rows, "id int, a double, b double, y double, fold int").cache()
    small = {name: (e, g[:2]) for name, (e, g) in model.searched("y").items() if name != "forest"}
    found = model.search(df, ["a", "b"], "y", "id", "fold", 3, small, most_neighbours=4)
    assert [r["mse"] for r in found] == sorted(r["mse"] for r in found) and {r["model"] for r in found} == {"linear", "tree", "neighbours"} and len(found) == 1 + 2 + 4
    told = model.ablation(df, ["a", "b"], ["a"], "y", small["linear"][0], "fold", 3)
    assert told["all"] < 0.01 < told["rest"] and len(model.searched("y")["forest"][1]) == 108


def test_prompts_name_scores_of_rooms(spark):
    from tessera.operators import search

    assert search.wished("Bright bedroom") == [("brightness_bedroom", True)]
    assert search.wished("a cheap, dark KITCHEN and spacious living room; new") == [("luxury_kitchen", False), ("brightness_kitchen", False), ("spaciousness_living_room", True)]
    assert search.wished("bedroom bright") == [] and search.wished("") == []
    df = frame(spark, [(1, 0.6, 0.5), (2, 0.5, 0.6), (3, None, 0.1), (4, 0.9, 0.9)], "id int, brightness_bedroom double, condition_toilet double")
    ids = lambda p: sorted(r.id for r in search.by_prompt(df, p).collect())
    assert (ids("bright bedroom"), ids("dark bedroom"), ids("Bright bedroom, used toilet"), ids("anything")) == ([1, 4], [2], [1], [1, 2, 3, 4])


def test_even_batches_end_where_the_cuts_are(spark):
    df = spark.range(10).withColumn("nth", F.lit("kept"))
    rows = features.even_batches(df, [F.col("id")], 4).collect()
    assert [sum(r.batch == b for r in rows) for b in range(4)] == [2, 3, 2, 3] and {r.nth for r in rows} == {"kept"}
    assert features.batch_cuts(10, 4) == [2, 5, 7, 10]
