"""Semantic data cleaning on Spark: DataFrame in, DataFrame out."""

from .operators.clean import clean
from .operators.entities import resolve_entities
from .operators.extract import extract, extract_compiled
from .operators.features import discover_features
from .operators.optimize import optimize_instruction
from .operators.oversample import oversample
from .operators.profile import audit_leakage, prune_traps, recognize_missingness
from .operators.quality import validate_quality
from .operators.scrub import scrub
from .operators.shred import shred_to_relations
from .session import SemClean, get_provider

__all__ = ["SemClean", "audit_leakage", "clean", "discover_features", "extract", "extract_compiled", "get_provider", "optimize_instruction", "oversample", "prune_traps", "recognize_missingness", "resolve_entities", "scrub", "shred_to_relations", "validate_quality"]
