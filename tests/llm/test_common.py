"""What a worker keeps between tasks."""

from fleetlens.llm import common


def test_a_worker_keeps_for_its_operator_alone():
    made = []

    def run(batches):
        common.keep(("own",), lambda: made.append(1))
        yield from batches

    task = common.tidy(run, ("own",))
    assert list(task([1, 2])) == [1, 2] and list(task([3])) == [3]
    assert made == [1] and ("own",) in common._KEPT
    assert list(common.tidy(iter)([4])) == [4]
    assert not common._KEPT
    assert list(task([])) == [] and made == [1, 1]


def test_a_tokenizer_goes_when_another_operator_begins(spark):
    from pyspark.sql import functions as F
    import public_tokenizers

    from fleetlens.llm import decontaminate, packing

    docs = spark.createDataFrame([(1, "some words of text")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("a", "other words")], "item_id string, text string")

    def tokenizers(batches):
        import gc

        import pyarrow as pa

        from fleetlens.llm.packing import ChunkTokenizer

        list(batches)
        gc.collect()
        yield pa.RecordBatch.from_pydict({"n": [sum(isinstance(x, ChunkTokenizer) for x in gc.get_objects())]})

    packing._tokenize(docs.withColumn("hash", F.lit(1).cast("long")).select("hash", "doc_id", "text"),
                      public_tokenizers.path("word_bpe_49k.json"), 2, 1).collect()
    decontaminate.find_contamination(docs, items).collect()
    assert docs.select("doc_id").mapInArrow(tokenizers, "n long").first().n == 0
