"""Tables that grow with the texts are not passed through the driver."""

import pytest

from sedimenta.llm import near_copies, simhash
from sedimenta.operators import components
from sedimenta.session import settle


@pytest.mark.parametrize("operator", [simhash.near_duplicates, near_copies.near_copies])
def test_no_broadcast(spark, docs, monkeypatch, operator):
    plans = []

    def told(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, *args)

    for module in (components, simhash, near_copies):
        monkeypatch.setattr(module, "settle", told)
    out = operator(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
