"""Vector assembly and standard scaling of continuous features.

The scaler is fit on the training split only and applied to every split, as
in the reference. ``StandardScaler`` computes mean and *sample* standard
deviation with one distributed tree aggregation; a zero deviation scales to 0.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembler(cols, out: str = "features", handle_invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid)


def assemble(df: DataFrame, cols, out: str = "features", drop_input: bool = False,
             handle_invalid: str = "error") -> DataFrame:
    """Assemble ``cols`` into one vector column (NULL raises unless ``handle_invalid``)."""
    res = assembler(cols, out, handle_invalid).transform(df)
    return res.drop(*cols) if drop_input else res


def fit_scaler(train: DataFrame, cols, out: str = "scaledFeatures",
               handle_invalid: str = "error") -> PipelineModel:
    """Assemble + ``StandardScaler(withMean, withStd)`` fitted on ``train``."""
    return Pipeline(stages=[
        assembler(cols, "_features", handle_invalid),
        StandardScaler(inputCol="_features", outputCol=out, withMean=True, withStd=True),
    ]).fit(train)


def scaler_coefficients(model: PipelineModel) -> tuple[list[float], list[float]]:
    """(shift, scale) per feature of a fitted scaler: x -> (x - shift) * scale.

    As in ``StandardScalerModel``: shift = mean, scale = 1 / std, and 0 where
    the standard deviation is 0. One value per feature: driver-sized.
    """
    fitted = model.stages[-1]
    mean = [float(v) for v in fitted.mean.toArray()]
    std = [float(v) for v in fitted.std.toArray()]
    return mean, [1.0 / s if s != 0.0 else 0.0 for s in std]


def apply_scaler(model: PipelineModel, df: DataFrame, cols, out: str = "scaledFeatures",
                 as_array: str | None = "float32", drop_input: bool = True) -> DataFrame:
    """Scale ``df`` with a fitted model; optionally as an array instead of a vector.

    For array output the model's own arithmetic, ``(x - mean) * (1 / std)``
    in double precision, is written as column expressions: a projection
    inside whole-stage codegen, with no vector serialisation. A NULL input
    raises, as the assembler does. ``as_array=None`` keeps the ML vector path.
    """
    if as_array is None:
        res = model.transform(df).drop("_features")
        return res.drop(*cols) if drop_input else res
    shift, scale_ = scaler_coefficients(model)
    dtype = "float" if as_array == "float32" else "double"
    items = []
    for c, m, k in zip(cols, shift, scale_):
        x = F.col(c).cast("double")
        value = (x - F.lit(m)) * F.lit(k)
        checked = F.when(x.isNull(), F.raise_error(F.lit(f"NULL in feature column {c}"))) \
                   .otherwise(value)
        items.append(checked.cast(dtype))
    res = df.withColumn(out, F.array(*items))
    return res.drop(*cols) if drop_input else res
