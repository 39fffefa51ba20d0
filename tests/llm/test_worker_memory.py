"""What the pipeline's tasks leave in the Python workers that Spark keeps for its later stages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import encoding, language_id, packing, sketches

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture
def one_worker(spark, monkeypatch):
    """Tasks of one partition meet in one worker, which no other test uses; its number of encoders and MB of Arrow's and others' memory."""
    monkeypatch.setitem(spark.sparkContext.environment, "TRACELAKE_TEST_WORKER", "its own")

    def state():
        def probe(batches):
            for batch in batches:
                with open("/proc/self/smaps_rollup") as f:
                    kb = sum(int(line.split()[1]) for line in f if line.startswith("Private_Dirty:"))
                yield pa.RecordBatch.from_pydict({"encoders": [len(encoding._encoders)], "mb": [kb // 1024]})

        (row,) = spark.range(1).coalesce(1).mapInArrow(probe, "encoders long, mb long").collect()
        return row.encoders, row.mb

    return state


def run(df):
    df.write.format("noop").mode("overwrite").save()


def test_encoders_stay_for_their_own_tasks_alone(spark, one_worker):
    docs = spark.range(50).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"))
    for _ in range(2):
        run(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))
        assert one_worker()[0] == 1
    run(language_id.predictions(docs, None))
    assert one_worker()[0] == 0
    assert [r.length for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()] == [6] * 50


def test_batches_of_whole_texts_are_given_back(spark, one_worker):
    docs = spark.range(30_000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 300).alias("text"))
    small = docs.where("doc_id < 10")
    model = language_id.fit([(np.array([1, 2]), np.array([3, 4]))] * 4, ["a", "b"] * 2)
    run(language_id.predictions(small, model))
    before = one_worker()[1]
    run(language_id.predictions(docs, model))
    run(language_id.predictions(small, model))
    assert one_worker()[1] - before < 15


def test_count_table_takes_texts_in_small_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    def hashes(batches):
        for batch in batches:
            if batch.num_rows > 1000:
                sizes.add(1)
            yield np.arange(batch.num_rows, dtype=np.uint64)

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    table = sketches.count_table(hashes, spark.range(2500).coalesce(1).select(F.lit("x").alias("text")))
    assert sizes.value == 0 and spark.conf.get(setting) == before
    assert table.value[0] == round(16 * np.log2(1 + 2500))
