"""Secret scans over an incremental blob ledger, with DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, for each pair of a blob and a
rule's version that was ever scanned, the spans that were found, none included. A scan first finds the pairs it has
not seen, by hash alone; only the texts of blobs with such pairs are brought together, one a blob, and scanned by the
rules they lack. The findings then join back to all paths that hold the blob. Copies cost one scan, a new version of a
rule rescans all blobs for that rule only, and an old text costs nothing. A history is scanned version by version, each against the ledger
of those before; a ledger may be kept in a folder of the shared store between runs.

Positions come from lengths: of the pieces between a rule's matches, and of the matches. They are summed in a
window over the few rows that matches make, so a text may hold any number of them.

Defined results: null and empty texts are one blob without findings; a null path is a path; versions that repeat are found alike; a very
long text may hold any number of spans; spans that start together are listed in the order of the rules; an empty
table gives an empty one; other columns of the versions are kept, but for those named blob and found, which are the operator's own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed


@dataclass(frozen=True)
class Rule:
    """Matches of a pattern, leftmost and not overlapping; those whose `group` is shorter than `least` are no findings."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: In the order in which findings at one place are listed. For the last two, a run that is too short can't hold a longer one,
#: so the least length stands in the pattern; for the first it can't, since what a short value uses up is not scanned again.
RULES = (
    Rule("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
LEDGER = "blob string, rule string, version int, spans array<struct<start:long,end:long>>"


def addressed(versions: DataFrame) -> DataFrame:
    """versions with the column blob, the address of their text."""
    return versions.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """LEDGER rows for texts (blob, text, todo): one a blob and rule named in todo."""

    def lengths(strings):
        return F.transform(strings, F.length)

    looked = []
    for k, rule in enumerate(rules):
        wanted = F.array_contains("todo", F.lit(k)) & F.rlike("text", F.lit(rule.pattern))
        parts = F.struct(
            F.lit(k).alias("nth"),
            lengths(F.split("text", rule.pattern, -1)).alias("gaps"),
            lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).alias("found"),
            lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))).alias("values"),
        )
        looked.append(F.when(wanted, parts))
    # what is kept of a text are lengths; from here on the texts are gone
    seen = checkpointed(texts.select("blob", "todo", F.filter(F.array(*looked), lambda x: x.isNotNull()).alias("looked")))
    each = seen.select("blob", F.explode("looked").alias("x")).select("blob", "x.nth", F.posexplode(F.arrays_zip("x.gaps", "x.found", "x.values")).alias("at", "z"))
    upto = Window.partitionBy("blob", "nth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    gap, found = F.coalesce("z.gaps", F.lit(0)), F.coalesce("z.found", F.lit(0))
    end = F.sum(gap + found).over(upto)
    spans = each.select("blob", "nth", (end - found).alias("start"), end.alias("end"), F.col("z.found").alias("n"), F.col("z.values").alias("value"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("nth") + 1)
    spans = spans.filter(F.col("n").isNotNull() & (F.col("value") >= least))
    spans = spans.groupBy("blob", "nth").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    pairs = seen.select("blob", F.explode("todo").alias("nth"))
    names, numbers = (F.element_at(F.array(*[F.lit(getattr(r, x)) for r in rules]), F.col("nth") + 1) for x in ("name", "version"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return pairs.join(spans, ["blob", "nth"], "left").select("blob", names.alias("rule"), numbers.alias("version"), F.coalesce("spans", none).alias("spans"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, text, todo (places of rules) of the blobs of addressed versions that lack a scan."""
    everything = F.array(*[F.lit(k) for k in range(len(rules))])
    texts = versions.select("blob", F.coalesce("text", F.lit("")).alias("text"))
    if ledger is None:
        return texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", everything)
    now = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
    todo = F.filter(everything, lambda k: F.col("done").isNull() | ~F.array_contains("done", F.element_at(now, k + 1)))
    lacking = versions.select("blob").distinct().join(done, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)
    return texts.join(lacking, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of all versions (a column text, any others), and the ledger's new rows.

    The findings have the versions' other columns, blob, and found: an array of (start, nth, rule, end) in order of place,
    then of rule; code points from 0, end exclusive.
    """
    held = addressed(versions)
    new = checkpointed(scanned(unseen(held, ledger, rules), rules))
    known = new if ledger is None else ledger.select(new.columns).unionByName(new)
    now = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    nth = F.array_position(now, F.struct("rule", "version"))
    spans = known.withColumn("nth", nth).filter(F.col("nth").between(1, len(rules)) & (F.size("spans") > 0)).dropDuplicates(["blob", "nth"])
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("nth").cast("int").alias("nth"), F.col("rule").alias("rule"), s["end"].alias("end")))
    of_blob = spans.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("found"))
    none = F.array().cast("array<struct<start:long,nth:int,rule:string,end:long>>")
    paths = held.drop("text", "found")
    return paths.join(of_blob, "blob", "left").withColumn("found", F.coalesce("found", none)), new


def scan_history(versions: DataFrame, age: Column, ages: int, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all versions, and the ledger's new rows, scanned age by age (age: 0 to ages - 1, null is 0), each against the ledger of those before."""
    age, findings, added = F.coalesce(age.cast("int"), F.lit(0)), [], []
    for k in range(ages):
        found, new = scan(versions.filter(age == k), ledger, rules)
        ledger = new if ledger is None else ledger.unionByName(new)
        findings.append(found)
        added.append(new)
    return reduce(DataFrame.unionByName, findings), reduce(DataFrame.unionByName, added)


def scan_stored(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of all versions against the ledger in a folder, to which the new rows are added. A pair that two runs add at once counts as one."""
    spark = versions.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    found, new = scan(versions, ledger, rules)
    found = checkpointed(found)
    new.write.mode("append").parquet(folder)
    return found


def digest(findings: DataFrame) -> DataFrame:
    """doc_id, a count a rule, base_sha256 and spans of findings."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(rule):
        return F.size(F.filter("found", lambda x: x["rule"] == rule)).cast("long").alias(f"n_{rule}")

    counts = [count(r.name) for r in RULES]
    base = F.filter("found", lambda x: x["rule"].isin([r.name for r in RULES]))
    return findings.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    looks = " UNION ALL ".join(
        f"SELECT row_no, {k} AS nth, '{r.name}' AS rule, {r.least} AS least, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', {r.group}) AS vals FROM docs WHERE regexp_matches(text, '{p}')"
        for k, r in enumerate(RULES)
        for p in [r.pattern.replace("'", "''")]
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
looked AS ({looks}),
each AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM looked),
placed AS (
  SELECT row_no, nth, rule, length(vals[i]) >= least AS counts, length(found[i]) AS n,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS start FROM each
),
joined AS (
  SELECT row_no, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access, count(*) FILTER (rule = 'hex') AS n_hex,
    string_agg(rule || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + n AS BIGINT) AS VARCHAR), ',' ORDER BY start, nth) AS spans
  FROM placed WHERE counts GROUP BY row_no
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row_no)
"""


ORACLE_SQL = _oracle()
