"""Relations: one definition of a dataflow, run as a batch job or as a stream."""

from ebbflow.plans.relation import Options, Relation

__all__ = ["Options", "Relation"]
