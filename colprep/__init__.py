"""Column profiling, cleaning and survey statistics on Spark DataFrames."""

from colprep.operators.cleaning import METHODS, clean, fit_method
from colprep.operators.profile import TableProfile
from colprep.plans.analyze import analyze_all
from colprep.plans.recipe import FittedRecipe, Recipe, operation_log
from colprep.session import get_session
from colprep.sources.files import read_csv, read_table

__all__ = [
    "METHODS", "FittedRecipe", "Recipe", "TableProfile", "analyze_all", "clean", "fit_method", "get_session",
    "operation_log", "read_csv", "read_table",
]
