import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from fleetlens.llm import kneser_ney, ngram_join
from fleetlens.llm.common import read
from tests.llm.helpers import docs_of
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_line_dedup import brute as repeated_lines
from tests.llm.test_ngram_join import brute as near_copies
from tests.llm.test_packing import PATH, check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of every stage, as rows."""
    docs, out = read(spark, SF, "documents"), []
    for _, stage in pipeline.STAGES:
        done = pipeline.land(stage(spark, docs, SF))
        out.append((docs, done))
        docs = done
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
        assert len(rows(after)) == after.count() <= before.count()


def test_classifier_stage(spark, stages):
    before, after = stages[0]
    judged, _, _ = kneser_ney.classify(before, read(spark, SF, "labels"))
    assert set(rows(after)) == {r.doc_id for r in judged.collect() if r.kept}
    assert all(rows(before)[i] == r for i, r in rows(after).items())


def test_line_stage(stages):
    before, after = map(rows, stages[1])
    gone = repeated_lines([(i, r.text) for i, r in sorted(before.items())])
    for i, r in before.items():
        lines = (r.text or "").split("\n")
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone.get(i, ()))
        if i in gone and not left.strip():
            assert i not in after
        else:
            assert after[i].text == left and (i not in gone or after[i].n_chars == len(left))


def test_near_copy_stage(stages):
    before, after = map(rows, stages[2])
    assert set(after) == {c for _, _, c in near_copies([(i, r.text) for i, r in sorted(before.items())])}
    assert all(before[i] == r for i, r in after.items())


def test_repeated_ids_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "a b c d e f", 2), (None, "x", 3), (None, "x", 3)],
                                 "doc_id long, text string, rep long")
    kept = pipeline.near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.rep) for r in kept.collect()) == [(0, 3), (0, 3), (1, 1)]
    assert kept.columns == docs.columns and ngram_join.link_documents(docs).count() == 5


def test_texts_of_one_id_are_documents(spark):
    texts = [(1, "a b c d e f"), (1, "g h i j k l"), (1, "g h i j k l"), (2, "a b c d e f"), (3, "m n o p q r"), (3, None),
             (0, "s t u v w x"), (9, "s t u v w x"), (9, "only here in all")]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(texts, "doc_id long, text string"), SF)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [
        (0, "s t u v w x"), (1, "a b c d e f"), (1, "g h i j k l"), (3, ""), (3, "m n o p q r"), (9, "only here in all")]


def test_decontamination_stage(spark, stages):
    before, after = map(rows, stages[3])
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    assert set(after) == {i for i, r in before.items() if not contamination(r.text, items)[3]}


def test_packing_stage(stages):
    before, after = stages[4]
    check(after.collect(), [(r.doc_id, r.text) for r in before.collect()], Tokenizer.from_file(PATH), 4096)


def test_empty_documents(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert np.all([n in names for n in entry.oracle_sql()])


def test_line_stage_keeps_columns_of_clashing_names(spark):
    docs = docs_of(spark, [(1, "a line that is repeated below\nmore"), (2, "a line that is repeated below\nand others")]).withColumns(
        {"n_lines": F.lit("mine"), "kept_text": F.lit(5), "N_Removed": F.lit(True)})
    out = pipeline.dedup_lines(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_lines, r.kept_text, r.N_Removed) for r in out.collect()) == [
        (1, "a line that is repeated below\nmore", "mine", 5, True), (2, "and others", "mine", 5, True)]
