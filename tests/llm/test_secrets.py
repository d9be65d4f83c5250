import random
from collections import Counter

import brute
from awkward_rows import awkward, empty  # noqa: F401
from raterscope.llm import secrets
from raterscope.session import new_folder


def found(df):
    return Counter((r["doc_id"], r["spans"]) for r in df.select("doc_id", secrets.spans_text("findings").alias("spans")).collect())


def test_against_a_plain_search(spark, awkward):
    random.seed(3)
    parts = ["password", "api_key", "APIKEY", "token", "=", ": ", " = ", '"', "'", "abcdef123456", "deadbeef" * 3, "AKIA", "ABCD1234EFGH5678", "é", "😀", " ", "secret", "x"]
    rows = [(100 + i, "".join(random.choice(parts) for _ in range(random.randint(1, 40)))) for i in range(1500)]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = Counter((r["doc_id"], brute.secrets(r["text"])) for r in docs.collect())
    assert found(secrets.scan(docs)) == expected


def test_only_unseen_pairs_are_scanned(spark):
    ledger = secrets.BlobLedger(spark, new_folder(spark))
    assert ledger.is_empty()
    old = spark.createDataFrame([(1, "token=abcdefabcdef"), (2, "nothing"), (3, "nothing")], "doc_id long, text string")
    secrets.scan(old, ledger)
    assert ledger.rows().count() == 2
    new = old.unionByName(spark.createDataFrame([(4, "nothing"), (5, "AKIA" + "A" * 20)], "doc_id long, text string"))
    result = found(secrets.scan(new, ledger))
    assert ledger.rows().count() == 3
    assert result[(5, "access:0:24")] == 1 and result[(1, "assign:0:18")] == 1 and result[(4, "")] == 1
    later = (*secrets.RULES[:2], secrets.Rule("hex", 2, r"[0-9a-f]+", 0, 8))
    result = found(secrets.scan(new, ledger, rules=later))
    # Only the new version is scanned, over all three blobs.
    assert ledger.rows().filter("size(rules) = 1").count() == 3
    assert result[(1, "assign:0:18,hex:6:18")] == 1


def test_masking_keeps_rows_and_columns(spark, awkward, empty):
    masked = secrets.mask(awkward)
    assert masked.columns == awkward.columns and masked.count() == awkward.count()
    text = masked.filter("doc_id = 1").first()["text"]
    assert text == "All rights reserved. [secret]' and more words here to read"
    assert masked.filter("text is null").count() == 2
    overlap = spark.createDataFrame([(1, "x token=0123456789abcdef0123 y")], "doc_id long, text string")
    assert secrets.mask(overlap).first()["text"] == "x [secret] y"
    assert secrets.mask(empty).count() == 0 and secrets.scan(empty).count() == 0


def test_no_python_in_the_plan(awkward):
    plan = secrets.scan(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
