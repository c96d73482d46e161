"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing; each stage calls one training-data operator.

Language ID drops documents without a language, one document of each class of near copies (five-word shingles,
similarity 0.8 or more) stays, personal data is masked, sources are mixed to their weights (documents may
repeat), and what is left is packed to windows. The stages are in `groundwave.llm.pipeline`.
"""

from groundwave.llm.pipeline import STAGES, run

#: Language models, fingerprints, bootstrapping and retrieval are not expressible in SQL; tests hold every stage against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
