"""Match a music catalog to the scenes of a screenplay, as Spark plans."""

from cuematch.config import MatchConfig, ScoringWeights

__all__ = ["MatchConfig", "ScoringWeights"]
