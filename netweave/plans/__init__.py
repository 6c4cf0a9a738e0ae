from netweave.plans.mapping import MappingSpec, Target, conform
from netweave.plans.registry import SPECS

__all__ = ["MappingSpec", "SPECS", "Target", "conform"]
