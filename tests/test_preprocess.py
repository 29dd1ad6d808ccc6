"""The fitted preprocessor: its 14 features, what it learns from training rows alone, and saving within a pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from tessera.operators import preprocess as P

ROOM_COLUMNS = [c for _, _, columns in P.MEANS for c in columns]
SCHEMA = "id int, price_man_yen double, rooms_num int, latitude double, longitude double, nearest_station string, area_sqm double, year_built int, floor_number int, floors_total int, walk_minutes int, base_layout string, building_period string, " + ", ".join(f"{c} double" for c in ROOM_COLUMNS)


def made(rnd, n, stations="abcd"):
    some = lambda x, p=0.1: None if rnd.random() < p else x
    return [
        (i, rnd.uniform(1000, 9000), some(rnd.randint(1, 4)), 35 + rnd.random(), 139 + rnd.random(), some(rnd.choice(stations)), some(rnd.uniform(10, 90)), some(rnd.randint(1970, 2020)), some(rnd.randint(1, 9)), 10, some(rnd.randint(1, 20)),
         some(rnd.choice(["R", "K", "LDK", "LDK", "UNKNOWN"])), some(rnd.choice(P.features.PERIODS)), *(some(rnd.random(), 0.5) for _ in ROOM_COLUMNS))
        for i in range(n)
    ]


def dense(train, rows):
    """The features by hand."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    col = lambda data, c: [r[names.index(c)] for r in data]
    price, mean = np.array(col(train, "price_man_yen")), np.mean(col(train, "price_man_yen"))
    encoding = {}
    for s in set(col(train, "nearest_station")) - {None}:
        own = price[[x == s for x in col(train, "nearest_station")]]
        share = len(own) * price.var() / (len(own) * price.var() + own.var())
        encoding[s] = share * own.mean() + (1 - share) * mean
    station = lambda data: [encoding.get(s, mean) for s in col(data, "nearest_station")]

    def scaled(values, fitted):
        q1, q2, q3 = np.percentile([v for v in fitted if v is not None], [25, 50, 75])
        return [None if v is None else (v - q2) / ((q3 - q1) or 1) for v in values]

    def coded(c, categories):
        known = [v for v in col(train, c) if v is not None]
        mode = min(set(known), key=lambda v: (-known.count(v), v))
        return [float(categories.index(v if v is not None else mode)) if (v or mode) in categories else -1.0 for v in col(rows, c)]

    out = {f"keep_rooms__{c}": col(rows, c) for c in P.PASSED[1]}
    out["station_transformer__nearest_station"] = scaled(station(rows), station(train))
    out |= {f"num_transformer__{c}": scaled(col(rows, c), col(train, c)) for c in P.NUMBERS[1]}
    out |= {f"{b}__{c}": coded(c, k) for b, c, k in P.ORDINALS}
    for b, name, columns in P.MEANS:
        at = [names.index(c) for c in columns]
        out[f"{b}__{name}"] = [None if all(r[i] is None for i in at) else float(np.mean([r[i] for i in at if r[i] is not None])) for r in rows]
    return out


def test_features_equal_those_by_hand_and_come_from_training_alone(spark):
    rnd = random.Random(1)
    train, rows = made(rnd, 200), made(rnd, 60, stations="abcxyz")
    model = P.ListingPreprocessor().fit(spark.createDataFrame(train, SCHEMA))
    got = P.matrix(model, spark.createDataFrame(rows, SCHEMA), ("id",))
    assert got.columns == ["id", *P.FEATURES] and len(P.FEATURES) == 14
    want = dense(train, rows)
    for r in got.collect():
        for name in P.FEATURES:
            w = want[name][r.id]
            assert r[name] is None if w is None else r[name] == pytest.approx(w, rel=1e-9, abs=1e-9), (name, r.id)


def test_a_saved_pipeline_predicts_alike(spark, tmp_path):
    rnd = random.Random(2)
    df = spark.createDataFrame(made(rnd, 150), SCHEMA).na.fill({"rooms_num": 1})
    stages = [P.ListingPreprocessor(target="price_man_yen"), VectorAssembler(inputCols=P.FEATURES, outputCol="features", handleInvalid="skip"), LinearRegression(labelCol="price_man_yen", regParam=0.1)]
    Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "plan"))
    fitted = Pipeline.load(str(tmp_path / "plan")).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    told = lambda m: {r.id: r.prediction for r in m.transform(df).collect()}
    before, after = told(fitted), told(again)
    assert before == after and len(before) > 20


def test_empty_columns_clashes_and_no_rows(spark):
    rnd = random.Random(3)
    rows = [(*r[:6], None, *r[7:11], None, None, *r[13:]) for r in made(rnd, 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = P.ListingPreprocessor().fit(df)
    r = P.matrix(model, df).first()
    assert r.num_transformer__area_sqm is None and r.ordinal_transformer__base_layout == -1.0
    with pytest.raises(ValueError):
        model.transform(model.transform(df))
    assert P.matrix(model, df.limit(0)).count() == 0
    nothing = P.ListingPreprocessor().fit(df.limit(0))
    assert P.matrix(nothing, df).first()["station_transformer__nearest_station"] is None and math.isnan(nothing.getOrDefault("mean"))
