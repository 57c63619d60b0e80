"""lawfinder: which probability law describes a column, at the scale of a Spark cluster."""

from lawfinder.config import FitterConfig, FitterConfigBuilder
from lawfinder.functions.registry import get_law
from lawfinder.operators.fitting import DiscreteDistributionFitter, DistributionFitter
from lawfinder.operators.multivariate import GaussianCopula, GaussianMixture, MultivariateNormal
from lawfinder.operators.results import FitResult, FitResults
from lawfinder.operators.sampling import sample_distributed
from lawfinder.sources.models import SerializationError, load, save

__all__ = [
    "DiscreteDistributionFitter",
    "DistributionFitter",
    "FitResult",
    "FitResults",
    "FitterConfig",
    "FitterConfigBuilder",
    "GaussianCopula",
    "GaussianMixture",
    "MultivariateNormal",
    "SerializationError",
    "get_law",
    "load",
    "sample_distributed",
    "save",
]
