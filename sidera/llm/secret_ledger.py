"""Operator 4: secret scans with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger says which rule versions each
blob has been scanned with; a run scans the text of a blob once, whatever the number of paths and rows that hold it, and
only with the rules whose present version the ledger lacks for that blob. Findings are kept by blob and joined back to
all paths. A secret is reported by its own SHA-256 and count, never in clear.

The scan is a projection of JVM expressions: a literal keyword that every match has to hold guards each pattern. A text
without any of the keywords has no finding and never travels; it is in the ledger all the same.

scan_stored() and stage() keep both tables in a folder, as files that are only added to: findings first, then the ledger,
so a run that breaks off between the two is made good by the next, and findings that are there twice are read once. Each
run adds a part of its own (run=...), so runs at one time don't meet in their files. The two tables belong together: a
ledger without its findings would hide them.

Cases: a null text has no blob and no finding; an empty text is a blob without findings; rows that repeat a path and
text count once; a null path is a path of its own; an empty table gives no rows. Ledger rows of other versions of a
rule neither hide nor show anything: their findings are out of date and are left out. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidera.llm.common import numbered, shared_folder

#: scanned: rule ids and versions as version_of() spells them; a blob may have several rows.
LEDGER = "blob string, scanned array<string>"
FINDINGS = "blob string, rule_id string, rule_version int, secret_sha string, n bigint"


@dataclass(frozen=True)
class Rule:
    """A pattern in the common subset of Java's and RE2's syntax; words: lower-case literals of which a match holds one."""

    rule_id: str
    version: int
    pattern: str
    words: tuple[str, ...]


RULES = (
    Rule("aws_access_key", 1, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("akia", "asia")),
    Rule("github_token", 1, r"\bgh[pousr]_[0-9A-Za-z]{36}\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 1, r"\bxox[abprs]-[0-9A-Za-z-]{10,}", ("xox",)),
    Rule("google_api_key", 1, r"\bAIza[0-9A-Za-z_-]{35}", ("aiza",)),
    Rule("stripe_live_key", 1, r"\b[rs]k_live_[0-9A-Za-z]{16,}", ("k_live_",)),
    Rule("json_web_token", 1, r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", ("eyj",)),
    # up to its END line, or to the end of the text where that is missing
    Rule("private_key", 2, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\z)", ("private key",)),
    # the keyword may stand anywhere in a name, and any run of noise signs on either side of the assignment sign; the
    # name's part before the keyword is not of the match, as a run of word characters would be tried from each of them
    Rule("assigned_secret", 3, r"(?i)(?:api[_-]?key|secret|token|passwd|password|pwd)[0-9A-Za-z_.-]*[\"'\s!#$%&*@^~?|]*[:=][:=>\"'\s!#$%&*@^~?|]*[0-9A-Za-z+/_-]{12,}", ("api", "secret", "token", "passwd", "password", "pwd")),
)


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def version_of(rule: Rule) -> str:
    return f"{rule.rule_id}@{rule.version}"


def _has(lower: Column, *rules: Rule) -> Column:
    guard = F.lit(False)
    for w in dict.fromkeys(w for r in rules for w in r.words):
        guard = guard | lower.contains(w)
    return guard


def _at_paths(docs: DataFrame, findings: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Findings by blob at all paths that hold it. Only hashes travel, and rows are made distinct when few are left."""
    paths = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), blob_of(F.col(text_col)).alias("blob"))
    return paths.join(findings, "blob").select(id_col, "blob", "rule_id", "rule_version", "secret_sha", "n").distinct()


def _unseen(text: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, findings): what is new for both tables of the texts in the one column __text."""
    now = F.broadcast(text.sparkSession.createDataFrame([(r.rule_id, r.version, k) for k, r in enumerate(rules)], "rule_id string, rule_version int, k int"))  # as long as the rule list
    versions = text.where("__text is not null").select(blob_of(F.col("__text")).alias("blob"), F.when(_has(F.lower("__text"), *rules), F.col("__text")).alias("__text"))
    present = F.array(*(F.lit(version_of(r)) for r in rules))
    seen = ledger.groupBy("blob").agg(F.array_intersect(F.flatten(F.collect_list("scanned")), present).alias("seen"))
    blobs = versions.groupBy("blob").agg(F.first("__text").alias("__text"))  # equal texts, of which one is kept
    todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).where(F.size("seen") < len(rules))
    lower, none = F.lower("__text"), F.array().cast("array<struct<k:int,secret_sha:string>>")

    def hits(k: int, r: Rule) -> Column:
        found = F.transform(F.regexp_extract_all("__text", F.lit(r.pattern), F.lit(0)), lambda m: F.struct(F.lit(k).alias("k"), F.sha2(m, 256).alias("secret_sha")))
        return F.when(~F.array_contains("seen", version_of(r)) & _has(lower, r), found).otherwise(none)

    rows = todo.where("__text is not null").select("blob", F.explode(F.flatten(F.array(*(hits(k, r) for k, r in enumerate(rules))))).alias("hit")).select("blob", "hit.*")
    new = rows.groupBy("blob", "k", "secret_sha").agg(F.count("*").alias("n")).join(now, "k").select("blob", "rule_id", "rule_version", "secret_sha", "n")
    return todo.select("blob", F.array_except(present, "seen").alias("scanned")), new


def _present(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The findings of the rules' present versions, each once."""
    now = F.broadcast(findings.sparkSession.createDataFrame([(r.rule_id, r.version) for r in rules], "rule_id string, rule_version int"))
    return findings.join(now, ["rule_id", "rule_version"], "left_semi").select("blob", "rule_id", "rule_version", "secret_sha", "n").distinct()


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, ledger, findings): (id, blob, rule_id, rule_version, secret_sha, n) of all paths, and what is new for both tables."""
    spark = docs.sparkSession
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    findings = spark.createDataFrame([], FINDINGS) if findings is None else findings
    after, new = _unseen(docs.select(F.col(text_col).alias("__text")), rules, ledger)
    return _at_paths(docs, _present(findings, rules).unionByName(new), id_col, text_col), after, new


def _stored(text: DataFrame, folder: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Scans what the folder's ledger lacks of the texts in the one column __text, adds it there, and gives all its findings."""
    spark, run = text.sparkSession, f"run={uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(f"{folder}/ledger/{run}")
    ledger, new = _unseen(text, rules, spark.read.schema(LEDGER).parquet(f"{folder}/ledger"))
    new.write.mode("append").parquet(f"{folder}/findings/{run}")
    ledger.write.mode("append").parquet(f"{folder}/ledger/{run}")
    return _present(spark.read.schema(FINDINGS).parquet(f"{folder}/findings"), rules)


def scan_stored(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of scan() with the ledger and findings of a shared folder, to which those of this run are added."""
    # all is seen then, so these rows are the stored findings joined to their paths
    return _at_paths(docs, _stored(docs.select(F.col(text_col).alias("__text")), folder, rules), id_col, text_col)


def redact(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text of a blob that has findings, with every match of every rule replaced by [rule redacted]; a rule is tried where the text as it came has its keyword."""
    lower, out = F.lower(text), text
    for r in rules:
        out = F.when(_has(lower, r), F.regexp_replace(out, F.lit(r.pattern), F.lit(f"[{r.rule_id} redacted]"))).otherwise(out)
    return out


def stage(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: tuple[Rule, ...] = RULES, folder: str | None = None) -> DataFrame:
    """All rows, with the secrets in their texts redacted and the character count of such texts made anew.

    The texts are scanned with a stored ledger, that of `folder` or else secret-ledger in the shared folder, which later
    runs go on with; so a blob is searched once by each version of a rule, in whatever run. What the findings name is
    redacted, and nothing else is searched. Of the rows only those that hold a keyword meet the findings.
    """
    plain = numbered(docs)
    name = dict(zip(docs.columns, plain.columns))
    text = F.col(name[text_col])
    found = _stored(plain.select(text.alias("__text")), folder or f"{shared_folder(docs.sparkSession)}/secret-ledger", rules)
    found = found.select(F.col("blob").alias("__blob"), F.lit(True).alias("__found")).distinct()
    has = F.coalesce(_has(F.lower(text), *rules), F.lit(False))
    held = plain.where(has).withColumn("__blob", blob_of(text)).join(found, "__blob", "left")
    clean = held.withColumn("__clean", F.when(F.col("__found"), redact(text, rules)).otherwise(text))
    made = {text_col: F.col("__clean")}
    if chars_col in docs.columns:
        made[chars_col] = F.when(F.col("__clean") != text, F.length("__clean").cast(docs.schema[chars_col].dataType)).otherwise(F.col(name[chars_col]))
    rest = plain.where(~has).select(*(F.col(p).alias(c) for c, p in name.items()))
    return rest.union(clean.select(*(made.get(c, F.col(p)).alias(c) for c, p in name.items())))


def oracle(rules: tuple[Rule, ...] = RULES, table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The rows of scan() in DuckDB's SQL."""
    parts = []
    for r in rules:
        pattern = r.pattern.replace("'", "''")
        parts.append(f"list_transform(regexp_extract_all({text_col}, '{pattern}', 0), lambda m: {{'rule_id': '{r.rule_id}', 'rule_version': {r.version}::int, 'secret_sha': sha256(m)}})")
    hits = "[" + ", ".join(parts) + "]"
    return f"select {id_col}, blob, hit.rule_id as rule_id, hit.rule_version as rule_version, hit.secret_sha as secret_sha, count(*) as n from (select {id_col}, sha256({text_col}) as blob, unnest(flatten({hits})) as hit from (select distinct {id_col}, {text_col} from {table})) group by all"
