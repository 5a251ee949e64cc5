from corpusloom.llm import sharding


def test_rounds_of_equal_texts_take_few_stages(spark):
    members = [(g * 6 + i, f"g{g}", 6, 1, (g + i) % 4) for g in range(10) for i in range(6)]
    df = spark.createDataFrame(members, "v long, group string, c long, groups long, shard int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-round", "")
    moved = sharding.propagate(df, 4, 16, rounds=1)
    spark.sparkContext.setJobGroup("", "")
    stages = {s for j in tracker.getJobIdsForGroup("one-round") for s in tracker.getJobInfo(j).stageIds}
    assert moved.count() == len(members)
    assert len(stages) <= 22, len(stages)
