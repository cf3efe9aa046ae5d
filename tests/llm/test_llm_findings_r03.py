"""op12: what the driver holds of the model."""

import pickle

import numpy as np

from assayer.llm import toxicity


def test_model_is_sent_without_slots():
    keys, ratios = np.arange(0, 300_000, 3, dtype=np.int64), np.linspace(-1, 1, 100_000).astype(np.float32)
    sent = pickle.dumps(toxicity._Packed(keys, ratios))
    assert len(sent) < 13 * len(keys)
    model = pickle.loads(sent).lookup()
    found, hit = model.find(np.array([3, 4, 299_997], np.int64))
    assert hit.tolist() == [True, False, True] and found.tolist() == [ratios[1], 0, ratios[-1]]


def test_levels_are_written(spark):
    grams = spark.range(5000).selectExpr("(id * 7919) % 1000003 AS gram")
    plan = toxicity._shared(grams, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
