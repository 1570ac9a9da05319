"""What near-duplicate suppression shuffles, against the size of its texts."""

import random

from tessera.operators import dedup as D


def _shuffled(spark, since):
    """(bytes of shuffle written by the stages from ``since`` on, the next stage)."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    found = [stages.apply(k) for k in range(stages.size())]
    return sum(x.shuffleWriteBytes() for x in found if x.stageId() >= since), max((x.stageId() for x in found), default=-1) + 1


def test_shuffles_about_its_sets(spark):
    pick = random.Random(5)
    texts = [" ".join(f"{pick.randrange(1 << 40):x}" if pick.random() < 0.2 else f"word{pick.randrange(5000)}" for _ in range(600)) for _ in range(800)]
    df = spark.createDataFrame([(k // 40, k, texts[k] if k % 5 or not k % 40 else texts[k - 1] + " tail", k) for k in range(800)], "q long, id long, text string, place long")
    _, since = _shuffled(spark, 1 << 40)
    assert D.suppress(df, "q", "id", "text", "place").count() == 800 - 20 * 7  # seven of each forty nearly repeat the one before
    bytes_, _ = _shuffled(spark, since)
    assert 0 < bytes_ < sum(map(len, texts))
