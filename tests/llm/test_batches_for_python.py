import pyarrow as pa

from corpusloom.llm.common import BATCH, materialize


def test_tables_are_written_with_small_batches_for_python(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    before = spark.conf.get(BATCH[0])
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('some text ', 1000) as text")
    sizes = [r.n for r in materialize(rows.mapInArrow(run, "n long"), "sizes").collect()]
    assert sum(sizes) > 40_000_000 and max(sizes) < 6_000_000
    assert spark.conf.get(BATCH[0]) == before
