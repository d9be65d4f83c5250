"""The registered queries, their SQL, and the pipeline."""

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from awkward_rows import awkward, empty  # noqa: F401
from pyspark.sql import functions as F
from raterscope.llm import decontamination, near_duplicates, queries, stages

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_result_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if n not in queries.oracle_sql() and n != "pipeline"))
def test_one_row_for_each_of_the_table(spark, name):
    table = "pages" if name.startswith(("op3_", "op12_")) else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    rows = queries.queries()[name](spark, DATA)
    ids = {r[key] for r in rows.collect()}
    assert ids == {r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}


@pytest.fixture(scope="module")
def tables(spark, awkward, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    more = [(100 + i, f"civil words number {i} and so on " * 3, "en", "x", 1, 2, "y", 3, "z", "blob", 4, "dot") for i in range(60)]
    more += [(200 + i, f"civil words number {i} and so on scoundrel " * 3, "en", "x", 1, 2, "y", 3, "z", "blob", 4, "dot") for i in range(60)]
    docs = awkward.unionByName(spark.createDataFrame(more, awkward.schema)).withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(100 + i, 0) for i in range(60)] + [(200 + i, 1) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "a row without an id that has enough words to be compared")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, tables)
        kept[name] = after.collect()
        if name != "packing":
            assert after.columns == docs.columns
            docs = spark.createDataFrame(kept[name], docs.schema)
    ids = {name: Counter(r["doc_id"] for r in rows) for name, rows in kept.items()}
    assert not [i for i in ids["toxicity"] if i and i >= 200] and len([i for i in ids["toxicity"] if i and i >= 100]) == 60
    assert ids["near_duplicates"][5] == 0 and ids["near_duplicates"][4] == 1
    gone = ids["near_duplicates"] - ids["decontamination"]
    assert gone == Counter({None: 1})
    assert ids["secrets"] == ids["decontamination"]
    masked, = [r for r in kept["secrets"] if r["doc_id"] == 1]
    assert (masked["__blob"], masked["__findings"], masked["a.b"]) == ("blob", 4, "dot")
    assert "[secret]" in masked["text"] and masked["n_chars"] == len(masked["text"])
    assert set(ids["packing"]) == set(ids["secrets"])


def test_run_on_nothing(spark, awkward, tmp_path):
    folder = str(tmp_path)
    awkward.filter("false").withColumn("n_chars", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = near_duplicates.components(docs)
    wanted = {r["component_id"] for r in found.collect()}
    assert {r["doc_id"] for r in stages.drop_near_duplicates(spark, docs, DATA).collect()} == wanted
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    bad = decontamination.judge(decontamination.find_matches(docs, benchmark)).filter("contaminated").count()
    assert stages.drop_contaminated(spark, docs, DATA).count() == docs.count() - bad
