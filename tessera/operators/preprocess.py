"""The price model's preprocessor as an estimator of one's own.

``ListingPreprocessor.fit`` learns quartiles, modes and station encodings from
training rows alone; its model adds the feature columns, named
``branch__feature``, to any rows, and stands in a ``Pipeline`` before the
assembler and the regressor, so that a saved pipeline holds all that a
prediction needs. Numbers and modes are a few parameters; encodings have a row
for each station and stay a table, saved beside them as Parquet.

Branches: passed columns as they are; the station by its encoding, then scaled
by the encodings of the training rows; numbers scaled by their quartiles;
ordinals filled by the mode and numbered; means over the columns of a group.

Defined results: NULL and NaN numbers stay NULL; a station not seen in training,
or NULL, has the mean target of training; an ordinal without a category is -1; a mean
without values is NULL; rows whose target is NULL count for quartiles and modes,
not for encodings; columns of the input stay, and one that has a feature's name
raises.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from . import features
from .quantiles import quantiles

# The columns of the price model and the names of its branches.
PASSED = ("keep_rooms", ["rooms_num", "latitude", "longitude"])
STATION = ("station_transformer", "nearest_station")
NUMBERS = ("num_transformer", ["area_sqm", "year_built", "floor_number", "floors_total", "walk_minutes"])
ORDINALS = (("ordinal_transformer", "base_layout", features.LAYOUTS), ("building_period_transformer", "building_period", features.PERIODS))
ROOMS = ("bathroom", "bedroom", "kitchen", "living_room", "toilet")
MEANS = tuple((f"mean_{a}_transformer", f"mean_{a}", [f"{a}_{r}" for r in ROOMS]) for a in ("luxury", "brightness", "condition"))

FEATURES = [
    *(f"{PASSED[0]}__{c}" for c in PASSED[1]), f"{STATION[0]}__{STATION[1]}", *(f"{NUMBERS[0]}__{c}" for c in NUMBERS[1]),
    *(f"{branch}__{c}" for branch, c, _ in ORDINALS), *(f"{branch}__{name}" for branch, name, _ in MEANS),
]
SCORES = [name for name in FEATURES if name.startswith("mean_")]


class _Fitted(Params):
    target = Param(Params._dummy(), "target", "column that stations are encoded by", TypeConverters.toString)
    quartiles = Param(Params._dummy(), "quartiles", "three quartiles of each scaled number, then of the station's encoding", TypeConverters.toListFloat)
    modes = Param(Params._dummy(), "modes", "most frequent category of each ordinal", TypeConverters.toListString)
    mean = Param(Params._dummy(), "mean", "mean target of training", TypeConverters.toFloat)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(target="price_man_yen")


class ListingPreprocessor(Estimator, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, target: str = "price_man_yen"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ListingPreprocessorModel:
        target = self.getOrDefault("target")
        encoding = features.fit_target_encoding(df, STATION[1], target).select(F.col(STATION[1]).alias("station"), "encoding").persist()
        mean = df.agg(F.avg(target)).first()[0]
        encoded = df.select(F.col(STATION[1]).alias("station"), *NUMBERS[1]).join(encoding, "station", "left").withColumn("encoding", F.coalesce("encoding", F.lit(mean).cast("double")))
        found = quantiles(encoded, [*NUMBERS[1], "encoding"], [0.25, 0.5, 0.75])
        modes = []
        for _, column, _ in ORDINALS:
            counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
            modes.append(counts.agg(F.min_by("value", F.struct(-F.col("n"), "value"))).first()[0] or "")
        # a column without values isn't changed by scaling
        flat = [q if q is not None else (0.0, 0.0, 1.0)[i] for c in [*NUMBERS[1], "encoding"] for i, q in enumerate(found[c])]
        model = ListingPreprocessorModel(encoding)
        return self._copyValues(model._set(quartiles=flat, modes=modes, mean=float("nan") if mean is None else float(mean)))


class ListingPreprocessorModel(Model, _Fitted, MLReadable, MLWritable):
    def __init__(self, encoding: DataFrame | None = None):
        super().__init__()
        self.encoding = encoding

    def _scaled(self, x: Column, nth: int) -> Column:
        low, middle, high = self.getOrDefault("quartiles")[3 * nth : 3 * nth + 3]
        value = x.cast("double")
        return (F.when(~F.isnan(value), value) - middle) / ((high - low) or 1.0)

    def columns(self) -> dict[str, Column]:
        """Each feature over rows that have their station's encoding as ``__encoding``."""
        number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        out = {f"{PASSED[0]}__{c}": number(c) for c in PASSED[1]}
        mean = self.getOrDefault("mean")
        known = F.coalesce(F.col("__encoding"), F.lit(None if mean != mean else mean).cast("double"))
        out[f"{STATION[0]}__{STATION[1]}"] = self._scaled(known, len(NUMBERS[1]))
        out |= {f"{NUMBERS[0]}__{c}": self._scaled(F.col(c), i) for i, c in enumerate(NUMBERS[1])}
        for (branch, c, categories), mode in zip(ORDINALS, self.getOrDefault("modes")):
            out[f"{branch}__{c}"] = features.ordinal(F.coalesce(F.col(c), F.lit(mode)), categories).cast("double")
        return out | {f"{branch}__{name}": numeric.row_mean(*map(number, columns)) for branch, name, columns in MEANS}

    def _transform(self, df: DataFrame) -> DataFrame:
        clash = set(map(str.lower, df.columns)) & {*map(str.lower, FEATURES), "__station", "__encoding"}
        if clash:
            raise ValueError(f"the rows have columns named as features: {sorted(clash)}")
        encoding = self.encoding.select(F.col("station").alias("__station"), F.col("encoding").alias("__encoding"))
        joined = df.join(encoding, F.col(STATION[1]) == F.col("__station"), "left")
        return joined.withColumns(self.columns()).drop("__station", "__encoding")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ListingPreprocessorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.encoding.write.parquet(f"{path}/encoding")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ListingPreprocessorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/encoding"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def matrix(model: ListingPreprocessorModel, df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The keys and the 14 features."""
    return model.transform(df).select(*keys, *FEATURES)
