import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle

from larkspur.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLE_SQL:
        n = oracle.compare(spark, sf, QUERIES[name], ORACLE_SQL[name])
    else:
        n = QUERIES[name](spark, sf).count()
    assert n or name in ("phrase_match", "bm25_all_terms")
