"""silvagrid: vector-label forests, affinity graphs and segmentation on Spark DataFrames."""

from silvagrid.config import BoostConfig, RunSettings, TreeConfig
from silvagrid.plans.boost import fit_boosted
from silvagrid.plans.forest import ForestModel, fit_forest

__all__ = ["BoostConfig", "ForestModel", "RunSettings", "TreeConfig", "fit_boosted", "fit_forest"]
