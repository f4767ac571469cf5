"""All registered queries of this subpackage."""

import corpus_pipeline
from corpuscope.llm import (  # noqa: F401
    bpe,
    embeddings,
    fingerprints,
    jaccard,
    langid,
    mixing,
    quality,
    repair,
    search,
    sharding,
    suffix_dedup,
    token_files,
    wrappers,
)
from corpuscope.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
