"""Per-feature generalised linear models and training-data operators on Spark DataFrames."""

from tessera.functions.families import BETA, FAMILIES, NB, NORM, POISSON, Family, NoScaleError, family, register
from tessera.operators.covariates import bin_continuous_covariate
from tessera.operators.diagnostics import coef_vs_ref, deviation_summary
from tessera.operators.fit import Strategy, fit, fit_nb, fit_norm, fit_poisson, history, init_par, progress
from tessera.operators.kernels import fisher_information, hessian, irls_step, jacobian, log_likelihood
from tessera.operators.model import Model
from tessera.operators.simulate import generate_artificial_data, generate_params, sample_description
from tessera.plans.constraints import constraint_matrix, constraint_system
from tessera.plans.formula import design_matrix, preview_coef_names, view_coef_names
from tessera.plans.settings import setup_logging, unconfigure_logging
from tessera.sources.input import GlmInput

__version__ = "0.2.0"

__all__ = [
    "BETA", "FAMILIES", "NB", "NORM", "POISSON", "Family", "GlmInput", "Model", "NoScaleError", "Strategy", "bin_continuous_covariate", "coef_vs_ref",
    "constraint_matrix", "constraint_system", "design_matrix", "deviation_summary", "family", "fisher_information", "fit", "fit_nb", "fit_norm", "fit_poisson",
    "generate_artificial_data", "generate_params", "hessian", "history", "init_par", "irls_step", "jacobian", "log_likelihood", "preview_coef_names", "progress",
    "register", "sample_description", "setup_logging", "unconfigure_logging", "view_coef_names",
]
