import random
import zlib

import numpy as np
import pytest
from awkward_rows import awkward, empty  # noqa: F401
from pyspark.sql import functions as F
from raterscope.llm import toxicity


def corpus(n=1500):
    random.seed(9)
    vocabulary = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [random.choice(vocabulary) for _ in range(random.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            words[random.randrange(len(words))] = random.choice(["vilest", "vileness", "scoundrel"])
        if random.random() < (0.5 if bad else 0.05):
            words.append("muslims")
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held"]} == set(held)
    assert np.mean([got[i]["predicted"] == dict(labels)[i] for i in held]) > 0.98
    civil = toxicity.keep_civil(d, y)
    assert civil.columns == d.columns and civil.count() == sum(1 - r["predicted"] for r in got.values())


def test_group_names_do_not_count():
    docs, labels = corpus()
    texts, toxic = [t.encode() for _, t in docs], [y for _, y in labels]
    plain, fair = toxicity.fit(texts, toxic, counterfactual=0), toxicity.fit(texts, toxic, counterfactual=50)
    named, other = b"word1 word2 muslims", b"word1 word2 christians"
    gap = lambda m: abs(m.score(named) - m.score(other))
    assert gap(fair) < 0.3 * gap(plain)
    assert fair.score(named) < 0.5


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(600)
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one, other = (toxicity.train(d, spark.createDataFrame(y, "doc_id long, toxic int").repartition(3)) for y in (labels, wrong))
    assert one.bias == other.bias and one.keys.tolist() == other.keys.tolist()


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (2, 7), (None, 1)], [(1, 0), (3, 1), (3, 0), (4, 1)]])
def test_awkward_scores(spark, awkward, empty, labels):
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(awkward, y)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.keep_civil(awkward, y).columns == awkward.columns
    assert toxicity.score(empty, toxicity.train(empty, y)).count() == 0


def test_long_texts_add_no_noise():
    docs, labels = corpus()
    model = toxicity.fit([t.encode() for _, t in docs], [y for _, y in labels])
    clean = [t for (_, t), (_, y) in zip(docs, labels, strict=True) if not y]
    assert model.score(" ".join(clean[:200]).replace("muslims", "").encode()) < 0.5


def test_up_to_twelve_thousand_rows_are_learned_from(spark):
    docs = spark.range(16_000).selectExpr("id AS doc_id", "concat('w', id, ' ', if(id % 2 = 0, 'vile', 'kind')) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2 = 0) AS toxic")
    learned = docs.filter(~toxicity.held_out(docs["doc_id"])).count()
    drawn = toxicity.training_rows(docs, labels, toxicity.MAX_ROWS, "doc_id", "text", "toxic").count()
    assert drawn == min(learned, 12_000) > 8_000


def test_rows_hashed_in_slices_give_the_same_model(spark, monkeypatch):
    rows = [(i, f"w{i % 7} {'vile women' if i % 2 else 'kind men'} w{i % 5}", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    drawn = toxicity.training_rows(df.select("doc_id", "text"), df.select("doc_id", "toxic"), 12_000, "doc_id", "text", "toxic").collect()
    whole = toxicity.fit([r["text"].encode() for r in drawn], [r["label"] for r in drawn])
    for r in rows[:40]:
        assert abs(model.score(r[1].encode()) - whole.score(r[1].encode())) < 1e-6
