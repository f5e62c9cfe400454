"""plumbline: statistical process control on Spark DataFrames."""

from plumbline.operators.series import Roles, Sequence, sequence
from plumbline.plans.recipe import Analysis, Recipe, analyze, draw
from plumbline.session import local_session

__all__ = ["Analysis", "Recipe", "Roles", "Sequence", "analyze", "draw", "local_session", "sequence"]
