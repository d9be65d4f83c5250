"""Secret scans over an incremental ledger of blobs.

Every text is addressed by its SHA-256. The ledger, a Parquet table that only grows, holds for each
blob the rules (name and version) that have scanned it and what they found. A scan takes the distinct
blobs of the given table, scans only the (blob, rule version) pairs that the ledger lacks, appends the
outcome, and joins the findings back to every row that has the blob. Only DataFrame functions are used.

Defined results: a null text is an empty blob; null and repeated ids keep their rows, each with the
findings of its blob; an empty table gives an empty result; columns other than the id and the text are
not read. A rule's hits are leftmost and do not overlap; those that fail its length test are dropped
after matching, so that a short hit still uses up its characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, new_folder


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java expression; ``group`` must have ``min_chars`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    min_chars: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds, expressions and lengths of the base rules, in report order. Letters of the
# keywords are listed in both cases, so that no engine folds letters outside ASCII.
RULES = (
    Rule(
        "assign",
        1,
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)

FINDING = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("rule", T.StringType())]
)
LEDGER = T.StructType(
    [
        T.StructField("blob", T.BinaryType()),
        T.StructField("rules", T.ArrayType(T.StringType())),
        T.StructField("findings", T.ArrayType(FINDING)),
    ]
)


def _no_findings() -> Column:
    return F.array().cast(T.ArrayType(FINDING))


def _searched(rule: Rule) -> str:
    """The rule's expression, made longer only where that cannot change what passes.

    A rule without a group whose expression ends in a run (``+``) takes the whole run, so demanding
    the length at once finds the same hits and visits no short ones.
    """
    if rule.group == 0 and rule.pattern.endswith("+"):
        literal = len(rule.pattern.split("[")[0])
        return f"{rule.pattern[:-1]}{{{rule.min_chars - literal},}}"
    return rule.pattern


def _pieces(text: Column, rule: Rule) -> Column:
    """The hits of one rule, the text between them, and the tested group of each hit."""
    pattern = F.lit(_searched(rule))
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = hits if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, _searched(rule), -1)
    return F.when(text.rlike(_searched(rule)), F.struct(hits.alias("hits"), between.alias("between"), tested.alias("tested")))


def _spans(pieces: Column, rule: Rule) -> Column:
    """Code-point spans: each hit begins where the pieces before it end."""
    empty = F.array().cast(T.ArrayType(FINDING))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    rows = F.arrays_zip(pieces["between"], pieces["hits"], pieces["tested"])

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + F.length(row["between"])
        end = begin + F.coalesce(F.length(row["hits"]), F.lit(0))
        finding = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.key).alias("rule"))
        passes = F.coalesce(F.length(row["tested"]) >= rule.min_chars, F.lit(False))
        return F.struct(
            end.alias("at"), F.when(passes, F.array_append(state["found"], finding)).otherwise(state["found"]).alias("found")
        )

    return F.when(pieces.isNotNull(), F.aggregate(rows, start, step)["found"]).otherwise(empty)


class BlobLedger:
    """The table of scanned blobs in one folder; every commit adds a subfolder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _commits(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = (status.getPath() for status in files.listStatus(folder))
        return [str(p) for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]

    def rows(self) -> DataFrame:
        """All finished commits; one that broke off is not read."""
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*commits)

    def is_empty(self) -> bool:
        return not self._commits()

    def commit(self, scanned: DataFrame) -> None:
        name = new_folder(self.spark, "commit").rsplit("/", 1)[-1]
        scanned.select("blob", "rules", "findings").write.parquet(f"{self.path}/{name}")


def _addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("path"), row.alias("row"), text.alias("content"), F.unhex(F.sha2(text, 256)).alias("blob")
    )


def update_ledger(paths: DataFrame, docs: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger lacks and commit it. ``paths`` has path, row and blob; ``docs`` the content too.

    Which blobs are new is settled on narrow rows, counted before they are shuffled, so that a text
    that has many copies is one row. Its content is then fetched once, by a join on one row's id.
    """
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    blobs = paths.groupBy("blob").agg(F.min("row").alias("row"))
    if ledger.is_empty():
        unseen = blobs.withColumn("rules", wanted)
    else:
        seen = ledger.rows().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        lacking = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = blobs.join(seen, "blob", "left").select("blob", "row", lacking.alias("rules"))
        unseen = unseen.filter(F.size("rules") > 0)
    fetched = docs.join(cut_lineage(unseen), ["blob", "row"]).select("blob", "rules", "content")
    pieces = fetched.select(
        "blob",
        "rules",
        *[F.when(F.array_contains("rules", r.key), _pieces(F.col("content"), r)).alias(r.kind) for r in rules],
    )
    found = F.concat(*[_spans(F.col(r.kind), r) for r in rules])
    ledger.commit(pieces.select("blob", "rules", found.alias("findings")))


def scan(
    docs: DataFrame,
    ledger: BlobLedger | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Findings of every row: ``id_col`` and ``findings``, an array of (start, end, rule) by start and rule order.

    Positions are code points from 0, the end exclusive. Without a ledger a new one is begun in the
    shared folder. Runs jobs: the blob addresses and the ledger's commit are written.
    """
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark, new_folder(spark, "secret-ledger"))
    addressed = _addressed(docs, id_col, text_col)
    paths = cut_lineage(addressed.select("path", "row", "blob"))
    update_ledger(paths, addressed, ledger, rules)
    found = findings_by_blob(ledger, rules)
    joined = paths.join(found, "blob", "left")
    return joined.select(F.col("path").alias(id_col), F.coalesce("findings", _no_findings()).alias("findings"))


def findings_by_blob(ledger: BlobLedger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob in which the given rule versions found something. Runs a job.

    Written as a table of its own, so that the join to the paths reads plain scans on both sides and
    adaptive execution can split a blob that very many paths share.
    """
    order = {rule.key: i for i, rule in enumerate(rules)}
    current = ledger.rows().select("blob", F.explode("findings").alias("f")).filter(F.col("f.rule").isin(list(order)))
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("f.rule"))
    keyed = F.struct(F.col("f.start"), rank.alias("rank"), F.col("f.end"), F.col("f.rule"))
    sets = current.groupBy("blob").agg(F.array_sort(F.collect_set(keyed)).alias("all"))
    plain = F.transform("all", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["rule"].alias("rule")))
    return cut_lineage(sets.select("blob", plain.alias("findings")))


def spans_text(findings: Column | str) -> Column:
    """``kind:start:end`` of all findings, comma-joined."""

    def one(f: Column) -> Column:
        return F.concat_ws(":", F.substring_index(f["rule"], "@", 1), f["start"].cast("string"), f["end"].cast("string"))

    return F.array_join(F.transform(findings, one), ",")


def count_kind(findings: Column | str, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: F.substring_index(f["rule"], "@", 1) == kind)).cast("long")


def mask(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ledger: BlobLedger | None = None,
    rules: tuple[Rule, ...] = RULES,
    replacement: str = "[secret]",
) -> DataFrame:
    """The given table with every finding in ``text_col`` replaced; all other columns and rows stay.

    Overlapping findings are replaced once, from the start of the first to the end of the last. Rows
    without findings keep their text, null included.
    """
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark, new_folder(spark, "secret-ledger"))
    addressed = _addressed(docs, id_col, text_col)
    update_ledger(cut_lineage(addressed.select("path", "row", "blob")), addressed, ledger, rules)
    found = findings_by_blob(ledger, rules)
    # The columns go by their places, so that none of them can have a name that is used here.
    place = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(f"c{place}").cast("string"), F.lit(""))
    joined = plain.withColumn("blob", F.unhex(F.sha2(text, 256))).join(found, "blob", "left")

    def step(state: Column, f: Column) -> Column:
        fresh = f["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, f["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], f["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(replacement))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("findings", begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    shown = F.when(F.col("findings").isNotNull(), masked).otherwise(F.col(f"c{place}")).alias(f"c{place}")
    return joined.select(*[shown if i == place else F.col(c) for i, c in enumerate(plain.columns)]).toDF(*docs.columns)
