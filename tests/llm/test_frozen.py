import json
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from freeze import digest  # noqa: E402

from gleanline.llm.queries import ORACLES, QUERIES  # noqa: E402

FROZEN = json.load(open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "frozen.json")))


def test_every_query_is_checked():
    assert set(QUERIES) - set(ORACLES) == set(FROZEN)


@pytest.mark.parametrize("name", sorted(FROZEN))
def test_query_keeps_its_rows(spark, small, name):
    frame = QUERIES[name](spark, small)
    assert digest(frame) == FROZEN[name] and len(set(frame.columns)) == len(frame.columns)
