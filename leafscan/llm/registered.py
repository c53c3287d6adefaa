"""All registered queries of the subpackage, the pipeline's included."""

from __future__ import annotations

import corpus_pipeline

from leafscan.llm import queries as base
from leafscan.llm.queries import QueryFn


def queries() -> dict[str, QueryFn]:
    return base.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return base.ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
