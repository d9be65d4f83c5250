import json

import pytest

from raterscope.functions.text import clean_text, strict_double
from raterscope.operators import answers, prompts, sampling
from raterscope.streaming.ingest import ingest_answers, ingest_ratings


def envelope(text, **extra):
    record = {"response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}}
    record |= {"user_id": 7, "movie": "a \"b\" é", "movie_id": 8, "temperature": 0.25} | extra
    return json.dumps(record)


SHAPES = {
    envelope("4"): "ok",
    envelope(" 4\n"): "ok",
    envelope("4.5e0"): "ok",
    envelope("9"): "out_of_range",
    envelope("4/5"): "non_numeric",
    envelope("nan"): "non_numeric",
    envelope("inf"): "non_numeric",
    envelope("4d"): "non_numeric",
    envelope("1_0"): "non_numeric",
    envelope(""): "non_numeric",
    envelope("Rating: 4"): "non_numeric",
    envelope(4): "malformed",
    json.dumps({"user_id": 7}): "no_response",
    json.dumps({"response": None}): "no_response",
    json.dumps({"response": {}}): "no_response",
    json.dumps({"response": {"candidates": []}}): "no_response",
    json.dumps({"response": {"candidates": {"a": 1}}}): "no_response",
    json.dumps({"response": {"candidates": [{}]}}): "no_response",
    json.dumps({"response": {"candidates": [{"content": {"parts": []}}]}}): "no_response",
    json.dumps({"response": {"candidates": [{"content": {"parts": [{}]}}]}}): "non_numeric",
    envelope("4")[:40]: "malformed",
    envelope("4") + " x": "malformed",
    envelope("4") + envelope("5"): "malformed",
    "": "malformed",
    "null": "malformed",
    "[1]": "malformed",
    '"text"': "malformed",
    "not json": "malformed",
}


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(line,) for line in SHAPES], "value string").cache()


@pytest.mark.parametrize("line, status", SHAPES.items())
def test_status_of_each_shape(spark, line, status):
    lines = spark.createDataFrame([(line,)], "value string")
    row = answers.audit_answers(lines, min_rating=1, max_rating=5).first()
    assert row["status"] == status
    assert (row["rating"] is not None) == (status == "ok")


def test_counts_cover_every_line(lines):
    audited = answers.audit_answers(lines, min_rating=1, max_rating=5)
    counts = {r["status"]: r["n"] for r in answers.audit_counts(audited).collect()}
    assert counts == {s: list(SHAPES.values()).count(s) for s in set(SHAPES.values())}
    assert answers.parse_answers(lines, min_rating=1, max_rating=5).count() == counts["ok"]
    assert answers.parse_answers(lines).count() == counts["ok"] + counts["out_of_range"]


def test_echoed_fields(spark):
    rows = answers.parse_answers(spark.createDataFrame([(envelope(" 4\n"),)], "value string")).collect()
    assert [tuple(r) for r in rows] == [('a "b" é', 7, 8, 0.25, 4.0)]
    missing = spark.createDataFrame([(json.dumps({"response": {"candidates": [{"content": {"parts": [{"text": "3"}]}}]}}),)], "value string")
    assert [tuple(r) for r in answers.parse_answers(missing).collect()] == [("", None, None, None, 3.0)]


def test_split(lines):
    valid, rejected = answers.split_valid_json(lines)
    assert valid.count() + rejected.count() == len(SHAPES)
    for row in valid.collect():
        assert isinstance(json.loads(row["value"]), dict)


def test_clean_text_is_python_strip(spark):
    texts = ["  a b\t\n", " x　", "\x1fy\x85", "", " \n ", "z​"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(clean_text("t")).collect()]
    assert got == [t.strip() for t in texts]


def test_strict_double(spark):
    cases = {"4": 4.0, "-1.5": -1.5, "+.5": 0.5, "1e3": 1000.0, "5.": 5.0, "1f": None, ".": None, "0x1": None, "--1": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", strict_double("t").alias("d")).collect()} == cases


def test_requests_round_trip(spark):
    title = 'Amélie "x"\nII'
    rows = [(u, f" {title} ", m, 3.0) for u in range(5) for m in range(u + 1)]
    ratings = spark.createDataFrame(rows, "user_id long, movie string, movie_id long, rating double")
    chosen = prompts.sample_requests(ratings, 3)
    lines = [json.loads(r["value"]) for r in prompts.request_lines(prompts.build_requests(chosen)).collect()]
    users = {line["user_id"] for line in lines}
    assert len(users) == 3 and len(lines) == sum(u + 1 for u in users)
    for line in lines:
        content = line["request"]["contents"][0]
        text = content["parts"][0]["text"]
        assert content["role"] == "user" and line["movie"] == title
        assert text.split("\n")[0].endswith("on a scale of 1 to 5.") and f"Movie: {title}\n" in text
        settings = line["request"]["generationConfig"]
        assert settings["max_output_tokens"] == 64
        assert settings["temperature"] == line["temperature"] in sampling.TEMPERATURES
    by_user = {u: {line["temperature"] for line in lines if line["user_id"] == u} for u in users}
    assert all(len(t) == 1 for t in by_user.values())


def test_absent_title_is_written_as_null(spark):
    ratings = spark.createDataFrame([(1, None, 2, 0.5)], "user_id long, movie string, movie_id long, temperature double")
    line = json.loads(prompts.request_lines(prompts.build_requests(ratings)).first()["value"])
    assert line["movie"] is None


def test_streaming_ingest_reads_only_new_files(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame([(line,) for line in SHAPES], "value string").coalesce(2).write.text(source)
    ingest_answers(spark, source, out, progress, 1, 5).awaitTermination(120)
    first = spark.read.parquet(out)
    assert first.count() == len(SHAPES)
    spark.createDataFrame([(envelope("2"),)], "value string").write.mode("append").text(source)
    ingest_answers(spark, source, out, progress, 1, 5).awaitTermination(120)
    assert spark.read.parquet(out).count() == len(SHAPES) + 1


def test_an_answer_that_comes_twice_is_one_rating(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def deliver(*texts):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(source)

    def line(user, movie, text):
        return json.dumps({"user_id": user, "movie_id": movie, "response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}})

    first = [line(1, 1, "4"), line(1, 2, "5"), line(2, 1, "no"), line(1, 1, "4"), "{broken"]
    deliver(*first)
    ingest_ratings(spark, source, out, progress, 1, 5).awaitTermination(120)
    # The same file once more, a retried request with another answer, and one that had given none.
    deliver(*first)
    deliver(line(1, 2, "1"), line(2, 1, "3"))
    ingest_ratings(spark, source, out, progress, 1, 5).awaitTermination(120)
    ingest_ratings(spark, source, out, progress, 1, 5).awaitTermination(120)
    found = spark.read.parquet(out).select("user_id", "movie_id", "rating").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 4.0), (1, 2, 5.0), (2, 1, 3.0)]
