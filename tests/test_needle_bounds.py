from corpusloom.operators import needles


def test_bounds_are_computed_once(spark):
    a = spark.createDataFrame([(0, 1, "one two three four"), (0, 2, "five six")], "corpus long, item_id long, text string")
    n = spark.createDataFrame([(0, 1, "a", "one two three"), (0, 2, "b", "six five")], "corpus long, place long, name string, text string")
    pairs = needles.possible_pairs(a, n, ["corpus"])
    assert {(r.item_id, r.name) for r in pairs.collect()} == {(1, "a"), (2, "b")}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "split(" not in plan
