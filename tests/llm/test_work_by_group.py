from corpusloom.llm import setsketch
from tests.llm.test_setsketch import brute, crowd


def test_a_near_copy_is_in_one_group_and_its_set_is_made_once(spark, monkeypatch):
    real, first, names = setsketch.materialize, [], []

    def counted(df, name, *a, **k):
        out = real(df, name, *a, **k)
        names.append(name)
        if name == "live" and not first:
            first.append((out.count(), out.select("key").distinct().count()))
        return out

    monkeypatch.setattr(setsketch, "materialize", counted)
    rows = crowd(60, 60, [3, 4], 1)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 80))
    assert first[0][0] == first[0][1] > 3
    assert names.count("sets") == 1 and "members" in names
