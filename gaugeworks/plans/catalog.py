"""All queries of the engine."""

from gaugeworks.plans import experiments, harmonics, items, kernels, measures, modes, physical, production, profiles, recordings, reports, signals, spectra, streams  # noqa: F401
from gaugeworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
