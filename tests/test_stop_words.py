"""Stop words are broadcast: a join by words would sort all rows of the commonest word in one task."""

from __future__ import annotations

from ebbflow.operators.relational import size_bound
from ebbflow.plans import Relation
from ebbflow.queries import STOP, _stop, words
from ebbflow.signed import SIGN
from ebbflow.streaming.run import replay


def test_stop_words_are_broadcast(spark):
    stop = _stop(spark)
    assert size_bound(stop.df) <= 64 << 20 and {tuple(r) for r in stop.df.collect()} == {(w, 1) for w in STOP}
    live = words(Relation.load(replay(spark.createDataFrame([("the and",)], "text string"), 1), "d")).join("hits", stop, ["word"], replicated=True)
    assert "ResolvedHint (strategy=broadcast)" in live.df._jdf.queryExecution().analyzed().toString() and SIGN in live.df.columns
