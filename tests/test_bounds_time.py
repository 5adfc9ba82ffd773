"""Workers of time expressions and trips for state."""

import pandas as pd
from pyspark.sql import functions as F

from marlstone.functions import timeexpr as TE
from marlstone.streaming.state import _Fold


def test_time_functions_share_a_worker(spark):
    """three Python workers a core before."""
    q = spark.createDataFrame([(1, "2020年")], "i long, q string").select("i", TE.times(F.col("q")).alias("t"), TE.year_list(F.col("q")).alias("y"), TE.month_matrix(F.col("q")).alias("m"))
    assert q._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_new_key_asks_for_its_state_once():
    """a key without state has no timers to list and nothing to clear."""
    asked = []

    class Handle:
        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            return lambda *a: asked.append(name)

    fold = _Fold((0,), lambda s, us: ((s[0] + 1,), s[0]), lambda s: 5, "n long", ["us"], "n", ["us"])
    fold.init(Handle())
    out = list(fold.handleInputRows(("k",), iter([pd.DataFrame({"us": [2, 1], "event_id": [1, 2]})]), None))
    assert out[0].values.tolist() == [[1, 0], [2, 1]] and asked == ["get", "update", "registerTimer"]
