"""Dimension reduction (DR-1): principal components of centred features."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import assemble


def pca_scores(df: DataFrame, features, k: int | None = None, key: str = "id", keep=("target",),
               fit_on: DataFrame | None = None) -> DataFrame:
    """Scores on the first k components (3 if at least 3 features, else 2), features centred first
    (Spark's PCA does not centre); each component's sign makes its largest loading positive.
    ``fit_on``: the rows that centres and components are fitted on (all rows unless given)."""
    k = k or (3 if len(features) >= 3 else 2)
    v = assemble(df, features, "_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_c", withMean=True, withStd=False)
    scaler = scaler.fit(v if fit_on is None else assemble(fit_on, features, "_raw"))
    c = scaler.transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_pc").fit(
        c if fit_on is None else scaler.transform(assemble(fit_on, features, "_raw")))
    pcs = model.pc.toArray()  # p × k loadings, small
    signs = [1.0 if pcs[abs(pcs[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array("_pc")
    extra = [x for x in keep if x in df.columns]
    return model.transform(c).select(key, *extra, *[(arr[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])
