import os
from datetime import date, datetime
from types import SimpleNamespace

import pytest

from raterscope.errors import MissingColumnsError
from raterscope.functions.labels import encode_id, label_name
from raterscope.operators import cleaning
from raterscope.schemas import STATISTICS, SYNTHETIC_RATINGS, USER_STATISTICS
from raterscope.plans import jobs
from raterscope.session import cut_lineage, get_session, intermediate_tables, shared_folder, shuffle_partitions_for
from raterscope.sources import models, readers, writers


def test_ratings_csv_round_trip(spark, ratings, tmp_path):
    table = ratings({1: [1, 2.5], 2: [None]})
    path = str(tmp_path / "ratings")
    writers.write_csv(table, path)
    writers.write_csv(table, path, single_file=True)
    back = readers.read_ratings_csv(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)
    assert len(list((tmp_path / "ratings").glob("*.csv"))) == 1
    inferred = readers.read_ratings_csv(spark, path, schema=None)
    assert inferred.columns == table.columns


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text('rating,extra,movie,user_id,movie_id\n3.5,z,"a ""b"", c",1,2\n')
    back = readers.read_ratings_csv(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in back.collect()] == [(1, 'a "b", c', 2, 3.5)]
    with pytest.raises(MissingColumnsError):
        readers.read_ratings_csv(spark, str(tmp_path / "r.csv"), SYNTHETIC_RATINGS)


def test_titles_with_quotes_and_line_breaks(spark, tmp_path):
    rows = [(1, 'Amélie "x", \\ y', 2, 3.0), (1, "two\nlines", 3, 4.0)]
    table = spark.createDataFrame(rows, "user_id long, movie string, movie_id long, rating double")
    writers.write_csv(table, str(tmp_path / "t"))
    back = readers.read_ratings_csv(spark, str(tmp_path / "t"), multi_line=True)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[2]) == rows


def test_corrupt_csv_lines_are_kept_on_request(spark, tmp_path):
    (tmp_path / "r.csv").write_text("user_id,movie,movie_id,rating\n1,a,2,3.5\nx,b,3,4\n")
    rows = readers.read_ratings_csv(spark, str(tmp_path / "r.csv"), keep_corrupt=True).cache().collect()
    assert [r["_corrupt_record"] for r in rows] == [None, "x,b,3,4"]
    assert rows[1]["user_id"] is None and rows[1]["rating"] == 4.0


def test_stats_csv_is_read_by_name(spark, tmp_path):
    stats = spark.createDataFrame([(1, *map(float, range(10)))], USER_STATISTICS)
    writers.write_csv(stats.select(*reversed(STATISTICS), "user_id"), str(tmp_path / "s"))
    back = readers.read_stats_csv(spark, str(tmp_path / "s"))
    assert back.schema == USER_STATISTICS and back.collect() == stats.collect()
    writers.write_csv(stats.drop("mode_rating"), str(tmp_path / "short"))
    with pytest.raises(MissingColumnsError):
        readers.read_stats_csv(spark, str(tmp_path / "short"))


@pytest.mark.parametrize("codec", ["uncompressed", "zstd", "snappy"])
def test_parquet_round_trip(spark, ratings, tmp_path, codec):
    table = ratings({1: [1, 2]})
    writers.write_parquet(table, str(tmp_path / codec), codec)
    assert sorted(readers.read_dataset(spark, str(tmp_path / codec)).collect()) == sorted(table.collect())


def test_ndjson_of_all_files_below_a_prefix(spark, tmp_path):
    for name, text in (("a/1.jsonl", '{"a":1}\n{"a"\n'), ("a/b/2.jsonl", '{"a":2}\n')):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = readers.read_ndjson(spark, str(tmp_path / "a")).collect()
    assert sorted(r["value"] for r in rows) == ['{"a"', '{"a":1}', '{"a":2}']
    assert {r["file_path"].rsplit("/", 1)[1] for r in rows} == {"1.jsonl", "2.jsonl"}
    (tmp_path / "none").mkdir()
    assert readers.read_ndjson(spark, str(tmp_path / "none")).count() == 0


def test_names_carry_the_time():
    assert writers.run_id(datetime(2024, 5, 6, 7, 8, 9, 10)) == "20240506_070809_000010"
    assert models.model_name(day=date(2024, 5, 6)) == "rater_model_2024-05-06"


def test_session_is_shared_and_lineage_is_cut(spark, ratings):
    assert get_session("other") is spark or get_session("other")._jsparkSession is not None
    table = ratings({1: [1, 2]})
    written = cut_lineage(table)
    assert written.schema == table.schema and sorted(written.collect()) == sorted(table.collect())
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in written.inputFiles())
    assert shuffle_partitions_for(10**14, 0.5) == 238_419 and shuffle_partitions_for(1) == 8


def test_shared_folder_where_none_is_named(spark):
    def session(**named):
        conf = SimpleNamespace(get=lambda key, default=None: named.get(key.split(".")[-2], default))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: named.get("context")))

    assert shared_folder(session(checkpoint="hdfs://c/", warehouse="hdfs://w")) == "hdfs://c"
    assert shared_folder(session(context="hdfs://x", warehouse="hdfs://w")) == "hdfs://x"
    assert shared_folder(session(warehouse="hdfs://w/")) == "hdfs://w/_intermediate"


def test_a_stage_leaves_nothing_behind(spark, ratings):
    table = ratings({1: [1, 2, 3]})
    with intermediate_tables(spark):
        inside = cut_lineage(table)
        path = inside.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    assert cut_lineage(table).count() == 3


def test_no_line_is_lost_silently(spark, tmp_path):
    (tmp_path / "r.csv").write_text('user_id,movie,movie_id,rating\n1,"a\nb",2,3\n1,c,3,4\nx,d,4,5\n,e,5,1\n2,f,6,2\n')
    out = jobs.qualify(spark, str(tmp_path / "r.csv"), str(tmp_path / "o"), k=5, min_count=1, rejects=str(tmp_path / "bad"), multi_line=True)
    assert tuple(out.first()) == (3, 2)
    assert [r["line"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["x,d,4,5"]
    back = readers.read_ratings_csv(spark, str(tmp_path / "o"))
    assert sorted(r["movie"] for r in back.collect()) == ["a b", "c", "f"]


def test_rejected_raters_are_kept(spark, tmp_path):
    values = ",".join(STATISTICS)
    for name, ids in (("h", ("1", "12.0")), ("m", ("2", "9" * 19))):
        lines = [f"{i},{','.join(['1'] * len(STATISTICS))}" for i in ids]
        (tmp_path / name).write_text("\n".join([f"user_id,{values}", *lines]) + "\n")
    counts = jobs.labelled_table(spark, str(tmp_path / "h"), str(tmp_path / "m"), str(tmp_path / "o"), None, rejects=str(tmp_path / "bad"))
    assert {tuple(r) for r in counts.collect()} == {(0, 1), (1, 1)}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_column_checks(ratings):
    table = ratings({1: [1]})
    with pytest.raises(MissingColumnsError) as error:
        cleaning.require_columns(table, ["user_id", "stars"])
    assert error.value.missing == ["stars"]
    assert cleaning.default_columns(table) == ("user_id", "movie")
    assert cleaning.conform(table, ["rating", "user_id"]).columns == ["rating", "user_id"]


def test_null_filters(spark):
    rows = [(1, "a", 1.0), (2, None, 2.0), (3, "c", None), (4, "d", float("nan"))]
    df = spark.createDataFrame(rows, "i int, t string, d double")
    assert [r["i"] for r in cleaning.drop_incomplete(df).collect()] == [1]
    assert [r["i"] for r in cleaning.drop_incomplete(df, ["t"]).collect()] == [1, 3, 4]
    assert [r["i"] for r in cleaning.drop_missing(df, "d").collect()] == [1, 2]
    assert [r["i"] for r in cleaning.only_user(df, "i", "3").collect()] == [3]


def test_labels_and_ids(spark):
    df = spark.createDataFrame([(0, 12), (1, None), (5, 10**18), (None, -3)], "label int, id long")
    rows = df.select(label_name("label").alias("n"), encode_id("id", 1).alias("e")).collect()
    assert [r["n"] for r in rows] == ["Human", "AI", "Unknown", "Unknown"]
    assert [r["e"] for r in rows] == [121, None, None, -31]


def test_no_cell_of_statistics_is_lost_silently(spark, tmp_path, caplog):
    names = ["user_id", *STATISTICS]
    for side, cells in {"human": ["1", "2", "3"], "machine": ["4", "5", str(10**18 * 9)]}.items():
        lines = [",".join([i, *["1.5"] * 10]) for i in cells]
        (tmp_path / f"{side}.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    broken = (tmp_path / "human.csv").read_text().replace("2,1.5", "2,oops").replace("3,1.5", "3,")
    (tmp_path / "human.csv").write_text(broken + "x" + ",1" * 10 + "\n")
    at = {n: str(tmp_path / n) for n in ("human.csv", "machine.csv", "out", "rejects")}
    jobs.labelled_table(spark, at["human.csv"], at["machine.csv"], at["out"], n_human=None, rejects=at["rejects"])
    kept = {r["user_id"]: r["mean_rating"] for r in spark.read.parquet(at["out"]).collect()}
    assert kept == {10: 1.5, 30: None, 41: 1.5, 51: 1.5}
    lost = {(r["user_id"], r["mean_rating"], r["reason"], r["ai_label"]) for r in spark.read.parquet(at["rejects"]).collect()}
    assert lost == {("2", "oops", "no_number", 0), ("x", "1", "no_number", 0), (str(10**18 * 9), "1.5", "id_too_long", 1)}
    assert "2 raters left out: no_number" in caplog.text and "1 raters left out: id_too_long" in caplog.text


def test_requests_report_bad_lines(spark, tmp_path, caplog):
    lines = [f"{u},film,{m},3.5" for u in range(3) for m in range(4)] + ["x,film,1,3"]
    (tmp_path / "r.csv").write_text("\n".join(["user_id,movie,movie_id,rating", *lines]) + "\n")
    made = jobs.request_file(spark, str(tmp_path / "r.csv"), str(tmp_path / "out"), 3, rejects=str(tmp_path / "bad"))
    assert made.count() == 12 and "1 lines of" in caplog.text
    assert [r["line"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["x,film,1,3"]
