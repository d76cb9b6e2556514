"""A Spark-native engine for discrete-choice analytics."""

from .functions.stats import naturalize_nest_params
from .operators.distance import distance_bands, distance_matrix, euclidean_distance_matrix, great_circle_distance_matrix, nearest_neighbors, pairwise_distance
from .operators.sampling import compute_inclusion_probs, sample_alternatives
from .plans.diagnostics import HausmanTest, LikelihoodRatioTest, WaldTest, hausman_test, iia_test, lm_error_test, lm_lag_test, lr_test, wald_test
from .plans.model import ChoiceModel, NestingTree, NestSpec, ParamDistribution
from .plans.packing import ChoiceArrays
from .plans.results import FitResult, format_coefficient_table, format_fit_statistics, format_side_by_side
from .plans.solvers import get_solver, list_solvers, register_solver
from .plans.spec import InteractionTerm, ModelSpec, ScopedTerm, interaction
from .sources import dgp
from .sources.choice_table import ChoiceTable

__all__ = [n for n in dir() if not n.startswith("_")]
