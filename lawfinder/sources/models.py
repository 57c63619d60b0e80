"""Model files: JSON (readable, checked when read) or pickle, by extension; and tables of results."""

from __future__ import annotations

import json
import math
import pickle
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

VERSION = "1.2"


class SerializationError(ValueError):
    """A model file that cannot be written or read."""


def file_format(path: str) -> str:
    kind = {".json": "json", ".pkl": "pickle", ".pickle": "pickle"}.get(Path(path).suffix.lower())
    if not kind:
        raise SerializationError(f"cannot tell the format of {path!r}: use .json, .pkl or .pickle")
    return kind


def _plain(x):
    if isinstance(x, np.ndarray):
        return _plain(x.tolist())
    if isinstance(x, np.generic):
        return _plain(x.item())
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return {"float": repr(x)}
    return x


def _lively(x):
    if isinstance(x, dict):
        return float(x["float"]) if set(x) == {"float"} else {k: _lively(v) for k, v in x.items()}
    return [_lively(v) for v in x] if isinstance(x, list) else x


def to_dict(model) -> dict:
    from lawfinder.operators.multivariate import GaussianCopula, GaussianMixture, MultivariateNormal
    from lawfinder.operators.results import FitResult

    for kind in (FitResult, GaussianCopula, MultivariateNormal, GaussianMixture):
        if isinstance(model, kind):
            body = {k: getattr(model, k) for k in model.__dataclass_fields__ if k != "sample"}
            return {"schema_version": VERSION, "type": kind.__name__} | _plain(body)
    raise SerializationError(f"cannot write a {type(model).__name__}")


def from_dict(found: dict):
    from lawfinder.functions import registry
    from lawfinder.operators.multivariate import GaussianCopula, GaussianMixture, MultivariateNormal
    from lawfinder.operators.results import FitResult

    found = _lively(dict(found))
    kind = found.pop("type", "FitResult")
    found.pop("schema_version", None)
    if kind == "FitResult":
        found |= {k: v for k, v in (found.pop("metrics", None) or {}).items()}
        if not isinstance(found.get("distribution"), str) or not isinstance(found.get("parameters"), list):
            raise SerializationError("a distribution and a list of parameters are needed")
        try:
            law = registry.get_law(found["distribution"])
        except KeyError as e:
            raise SerializationError(str(e)) from e
        if len(law.names) != len(found["parameters"]):
            raise SerializationError(f"{found['distribution']} takes {len(law.names)} parameters")
        return FitResult(**{k: v for k, v in found.items() if k in FitResult.__dataclass_fields__})
    kinds = {k.__name__: k for k in (GaussianCopula, MultivariateNormal, GaussianMixture)}
    if kind not in kinds:
        raise SerializationError(f"unknown model type {kind!r}")
    try:
        for k in ("mean", "covariance", "correlation", "weights", "means", "covariances"):
            if k in found:
                found[k] = np.array(found[k], float)
        if kind == "GaussianCopula":
            found["marginals"] = {c: (n, list(p)) for c, (n, p) in found["marginals"].items()}
            found["bounds"] = {c: tuple(b) for c, b in found.get("bounds", {}).items()}
        return kinds[kind](**found)
    except (KeyError, TypeError, ValueError) as e:
        raise SerializationError(f"not a {kind}: {e}") from e


def save(model, path: str) -> None:
    if file_format(path) == "json":
        Path(path).write_text(json.dumps(to_dict(model), indent=2))
    else:
        Path(path).write_bytes(pickle.dumps(to_dict(model)))


def load(path: str):
    kind = file_format(path)
    try:
        found = json.loads(Path(path).read_text()) if kind == "json" else pickle.loads(Path(path).read_bytes())
    except FileNotFoundError:
        raise
    except Exception as e:
        raise SerializationError(f"cannot read {path!r}: {e}") from e
    if not isinstance(found, dict):
        raise SerializationError(f"{path!r} holds no model")
    return from_dict(found)


def write_results(results, path: str, format: str = "parquet") -> None:
    """The table of a fit, by Spark's own writers."""
    results.df.write.mode("overwrite").format(format).save(path)


def read_results(spark, path: str, format: str = "parquet") -> DataFrame:
    from lawfinder.operators.fitting import RESULT_SCHEMA

    return spark.read.schema(RESULT_SCHEMA).format(format).load(path)
