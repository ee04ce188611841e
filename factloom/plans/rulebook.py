"""Rules as rows: a fact type and a Spark SQL condition, other patterns that must hold at the same values of shared columns, a severity.

    Rule("uncovered weakness", "Vulnerability", "severity = 'Critical'", others=(("UncoveredLine", "true"),), on=("file", "start_line"))

All rules are evaluated together, however many there are: one pass over the facts finds those that meet a rule's own condition, and
rules with other patterns share one more pass and one semi join on (rule, values of the shared columns). Rules that are held in a table
are checked there, with columns only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.severity import FROM_RULES
from factloom.functions.text import FIELDS, pieces
from factloom.operators.rules import MOST_FINDINGS, capped, rule_results

#: Fact types, functions and limits that rules are checked against. Fixed values.
TYPES = (
    "TaintSource", "TaintSink", "Sanitization", "UnsafeCall", "CryptographicOperation", "Vulnerability", "Function", "Variable", "CodeSmell",
    "ComplexityViolation", "Dependency", "DependencyVulnerability", "License", "UncoveredLine", "LowTestCoverage", "CoverageStats", "Custom",
)
FUNCTIONS = ("contains", "matches", "regexp_like", "startswith", "endswith", "exists", "length", "lower", "coalesce", "count", "not", "and", "or", "in")
MOST_RULES, MOST_NAME, MOST_TEXT, MOST_ARGUMENTS = 1000, 100, 1000, 10
#: Facts that the complexity estimate assumes for each pattern. Fixed value.
FACTS_A_PATTERN = 10_000

SCHEMA = "name string, kind string, condition string, others array<struct<kind: string, condition: string>>, shared array<string>, severity string, message string, confidence double"


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    condition: str = "true"
    others: tuple[tuple[str, str], ...] = ()
    on: tuple[str, ...] = ()
    severity: str = "Medium"
    message: str = "{fact.type} at {location.file}:{location.start_line}"
    confidence: float | None = None


def table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.kind, r.condition, list(r.others), list(r.on), r.severity, r.message, r.confidence) for r in rules], SCHEMA)


def rules_of(rows: DataFrame) -> list[Rule]:
    """Rules of a table, MOST_RULES of them at most; those with problems are an error."""
    found = checked(rows).limit(MOST_RULES + 1).collect()
    wrong = [f"{r.name}: {p}" for r in found for p in r.problems]
    if wrong or not 0 < len(found) <= MOST_RULES:
        raise ValueError("; ".join(wrong) or f"between 1 and {MOST_RULES} rules are wanted")
    return [Rule(r.name, r.kind, r.condition, tuple((o.kind, o.condition) for o in r.others), tuple(r.shared), r.severity, r.message, r.confidence) for r in found]


def _meets(condition: str) -> Column:
    """A missing value meets no condition."""
    return F.coalesce(F.expr(condition), F.lit(False))


def _place(rule: Rule) -> Column:
    return F.array(*[F.col(c).cast("string") for c in rule.on])


def _picked(facts: DataFrame, hits: list[tuple[str, Column]], name: str, none: int | None = None) -> DataFrame:
    """facts with `name`, a row for each hit (fact type, value or `none`) of a fact. A fact is compared with the conditions of its own type
    alone. explode would add a filter on its array and so compute all conditions twice; explode_outer does not. Numbers should have a
    `none` of their own: array_remove can be compiled with the conditions in it (a hundred are; a thousand are too much code, and Spark interprets them)."""
    by_type: dict[str, list[Column]] = {}
    for kind, hit in hits:
        by_type.setdefault(kind, []).append(hit)
    found = None
    for kind, own in by_type.items():
        met = F.array_compact(F.array(*own)) if none is None else F.array_remove(F.array(*own), none)
        found = F.when(F.col("fact_type") == kind, met) if found is None else found.when(F.col("fact_type") == kind, met)
    rows = facts.where(F.col("fact_type").isin(*by_type))
    return rows.select("*", F.explode_outer(found).alias(name)).where(F.col(name).isNotNull())


def matched(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """facts with `rule`, the number of a rule that they meet."""
    alone = [(r.kind, F.when(_meets(r.condition), F.lit(k)).otherwise(-1)) for k, r in enumerate(rules) if not r.others]
    joined = [(k, r) for k, r in enumerate(rules) if r.others]
    parts = [_picked(facts, alone, "rule", -1)] if alone else []
    if joined:
        hit = [(r.kind, F.when(_meets(r.condition), F.struct(F.lit(k).alias("rule"), _place(r).alias("place")))) for k, r in joined]
        firsts = _picked(facts, hit, "hit").select(*facts.columns, "hit.*")
        other = [(o[0], F.when(_meets(o[1]), F.struct(F.lit(k).alias("rule"), F.lit(n).alias("pattern"), F.lit(len(r.others)).alias("wanted"), _place(r).alias("place")))) for k, r in joined for n, o in enumerate(r.others)]
        held = _picked(facts, other, "o").select("o.*")
        held = held.groupBy("rule", "place").agg(F.count_distinct("pattern").alias("n"), F.first("wanted").alias("wanted")).where("n = wanted")
        parts.append(firsts.join(held, ["rule", "place"], "left_semi").select(*facts.columns, "rule"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _numbered(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table: their number, what findings take from them, and their messages in pieces. At most MOST_RULES rows."""
    rows = [(k, r.name, FROM_RULES[r.severity], r.confidence, [(a, list(FIELDS).index(f) if f in FIELDS else None, m) for a, f, m in pieces(r.message)]) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, rule_name string, rule_severity string, rule_confidence double, pieces array<struct<text: string, field: int, key: string>>")


def evaluate(rules: list[Rule], facts: DataFrame, most: int | None = None) -> DataFrame:
    """Findings of all rules. A rule with more than `most` of them fails as a whole; see results(). Rules with problems are an error: what is
    evaluated has been checked. What differs between rules is joined from their table (which has at most MOST_RULES rows, so it is sent to
    all tasks); only the conditions are part of the plan."""
    spark = facts.sparkSession
    rules_of(table(spark, rules))
    rows = matched(facts.withColumn("metadata", F.create_map().cast("map<string,string>")), rules).join(F.broadcast(_numbered(spark, rules)), "rule")
    values = F.array(*[f() for f in FIELDS.values()])
    filled = lambda p: F.when(p["field"].isNotNull(), F.coalesce(F.get(values, p["field"]), F.lit(""))).when(p["key"].isNotNull(), F.coalesce(F.try_element_at("metadata", p["key"]), F.lit("unknown"))).otherwise("")
    found = rows.select(
        F.sha2(F.concat_ws("|", "rule_name", "fact_id"), 256).alias("finding_id"), "rule_name", F.array_join(F.transform("pieces", lambda p: F.concat(p["text"], filled(p))), "").alias("message"), "file", "start_line", "end_line",
        F.coalesce("rule_confidence", "confidence").alias("confidence"), F.col("rule_severity").alias("severity"), "metadata", F.array("fact_id").alias("fact_ids"),
    )
    return found if most is None else capped(found, most)


def results(rules: list[Rule], facts: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """rule_name, n_findings, failed of the rules evaluated together."""
    return rule_results(evaluate(rules, facts), [r.name for r in rules], most)


# Without backslashes and double quotes, which are refused, a text runs from a quote to the next one whatever Spark's settings are (two in a row
# are two texts), so what is left when texts are cut out is all that can call a function.


def _texts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("'([^']*)'"), F.lit(1))


def checked(rules: DataFrame) -> DataFrame:
    """The rules with `problems`, in this order: name, severity, types, shared variables, functions, literals."""
    repeated = rules.groupBy(F.col("name").alias("same_name")).agg(F.count("*").alias("same"))
    rows = rules.join(repeated, F.col("name").eqNullSafe(F.col("same_name")), "left").drop("same_name")
    conditions = F.concat(F.array("condition"), F.transform("others", lambda o: o["condition"]))
    kinds = F.concat(F.array("kind"), F.transform("others", lambda o: o["kind"]))
    bare = F.transform(conditions, lambda c: F.regexp_replace(c, "'[^']*'", "''"))
    called = F.array_distinct(F.flatten(F.transform(bare, lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([a-z_]\w*)\s*\("), F.lit(1)))))
    texts = F.flatten(F.transform(conditions, _texts))
    some = lambda xs, test: F.exists(xs, test)
    told = lambda xs, text, known: F.transform(F.filter(xs, lambda x: ~x.isin(*known)), lambda x: F.concat(F.lit(text), x))
    when = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    name = F.coalesce("name", F.lit(""))
    problems = F.concat(
        when(name == "", "the name is empty"),
        when(F.length(name) > MOST_NAME, "the name is too long"),
        when(name.contains("..") | name.contains("/"), "the name has a path in it"),
        when(F.col("same") > 1, "the name is used twice"),
        told(F.array(F.coalesce("severity", F.lit("none"))), "unknown severity ", FROM_RULES),
        told(kinds, "unknown fact type ", TYPES),
        when((F.size("others") > 0) & (F.size("shared") == 0), "several patterns share no variable"),
        told(called, "unknown function ", FUNCTIONS),
        when(some(conditions, lambda c: c.rlike(r'[\\"`]')), "a condition has an escape, a double quote or a backquote in it"),
        when(some(bare, lambda c: (F.length(c) - F.length(F.replace(c, F.lit("'")))) % 2 == 1), "a text has no end"),
        when(some(texts, lambda t: F.length(t) > MOST_TEXT), "a text is too long"),
        when(some(texts, lambda t: t.contains("{{") | t.contains("}}")), "a text has a template in it"),
        when(some(texts, lambda t: t.contains("$") & t.contains("(")), "a text has a command in it"),
        when(some(bare, lambda c: c.rlike("(;|--|/[*]|`|(?i)\\b(select|drop|delete|insert)\\b)")), "a condition has a statement in it"),
        when(some(bare, lambda c: c.rlike(r"\([^()]*(,[^()]*){%d,}\)" % MOST_ARGUMENTS)), "a function has too many arguments"),
    )
    return rows.withColumn("problems", problems).drop("same")


def complexity(patterns: Column, conditional: Column) -> Column:
    """0 to 100: ten points for each factor of ten in the rows that the patterns may pair, a tenth of them where there is a condition."""
    digits = patterns * len(str(FACTS_A_PATTERN - 1)) - F.when(conditional, 1).otherwise(0)
    return F.least(F.lit(100.0), F.greatest(digits, F.lit(0)) * 10.0)


#: The catalogue of ten web risks: id, name, category, severity, CWE numbers. Fixed values.
CATALOGUE = (
    ("OWASP-A01-001", "Direct Object Reference Without Authorization", "A01-BrokenAccessControl", "critical", (639, 862)),
    ("OWASP-A02-001", "Use of Weak Cryptographic Hash", "A02-CryptoFailures", "major", (327,)),
    ("OWASP-A03-001", "SQL Injection via String Concatenation", "A03-Injection", "critical", (89,)),
    ("OWASP-A04-001", "Missing Rate Limiting", "A04-InsecureDesign", "major", (307,)),
    ("OWASP-A05-001", "Debug Mode Enabled in Production", "A05-SecurityMisconfiguration", "major", (489,)),
    ("OWASP-A06-001", "Use of Outdated Package Version", "A06-VulnerableComponents", "critical", (1104,)),
    ("OWASP-A07-001", "Default or Weak Credentials", "A07-AuthenticationFailures", "critical", (521,)),
    ("OWASP-A08-001", "Unsigned/Unverified Data Deserialization", "A08-IntegrityFailures", "critical", (502,)),
    ("OWASP-A09-001", "Missing Security Event Logging", "A09-LoggingFailures", "minor", (778,)),
    ("OWASP-A10-001", "Unvalidated URL Request", "A10-SSRF", "major", (918,)),
)


def catalogue(spark: SparkSession, category: str | None = None, severity: str | None = None) -> DataFrame:
    """id, name, category, severity, cwe (array) of the catalogue's rules, all or those of one category or severity."""
    rows = spark.createDataFrame([(*r[:4], list(r[4])) for r in CATALOGUE], "id string, name string, category string, severity string, cwe array<int>")
    for column, value in (("category", category), ("severity", severity)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def catalogued(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """facts with the rule_id and category of each catalogue rule that names their CWE; the catalogue has ten rows and is broadcast."""
    named = rules.select(F.col("id").alias("rule_id"), "category", F.explode("cwe").alias("number"))
    number = F.regexp_extract("cwe_id", r"^CWE-(\d+)$", 1).try_cast("int")
    return facts.withColumn("number", number).join(F.broadcast(named), "number").drop("number")
