"""Scanner output: lines are classified by the first rule that matches, grouped and rendered as a brief.

All of it is one narrow projection: for each of the fixed rules the lines of its class are filtered
from the row's array, so a document with very many findings needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pithy.functions import patterns as P
from pithy.functions import text as X

TITLE = "【Security Scan Summary】"


def label_of(line: Column) -> Column:
    """The class of a line, or null."""
    out = F
    for label, _, pattern in P.RISKS:
        out = out.when(line.rlike(P.java(pattern, True)), label)
    return out


def example_of(line: Column) -> Column:
    """The first URL, else the first address, else the stripped line; 100 characters at most."""
    url = F.regexp_extract(line, P.java(P.URL), 0)
    host = F.regexp_extract(line, P.java(P.HOST), 2)
    return F.left(F.when(url != "", url).when(host != "", host).otherwise(X.strip(line)), F.lit(100))


def cves_of(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(P.java(P.CVE, True)), 0), F.upper)


def _of_label(label: str) -> Column:
    return F.filter("__hits", lambda h: h["label"] == label)


def with_findings(df: DataFrame, text: str, out: str = "findings", examples: int = 3) -> DataFrame:
    """``df`` with an array of findings (severity, minus count, first line, label, examples, CVEs) in the order of the brief."""
    step = df.withColumn("__lines", X.lines(F.col(text)))
    step = step.withColumn("__hits", F.filter(F.transform("__lines", lambda x, i: F.struct(label_of(x).alias("label"), i.alias("pos"), x.alias("line"))), lambda h: h["label"].isNotNull()))
    groups = F.array(*[F.struct(F.lit(sev).alias("severity"), F.lit(label).alias("label"), _of_label(label).alias("hits")) for label, sev, _ in P.RISKS])

    def finding(g):
        some = F.filter(F.array_distinct(F.transform(g["hits"], lambda h: example_of(h["line"]))), lambda x: x != "")
        cves = F.array_sort(F.array_distinct(F.flatten(F.transform(g["hits"], lambda h: cves_of(h["line"])))))
        n = F.size(g["hits"]).cast("long")
        return F.struct(g["severity"].alias("severity"), (-n).alias("minus_count"), F.get(g["hits"], F.lit(0))["pos"].alias("first_pos"), g["label"].alias("label"), n.alias("count"), F.slice(some, 1, examples).alias("examples"), cves.alias("cves"))

    step = step.withColumn("__groups", F.filter(groups, lambda g: F.size(g["hits"]) > 0))
    return step.withColumn(out, F.when(F.col(text).isNotNull(), F.sort_array(F.transform("__groups", finding)))).drop("__lines", "__hits", "__groups")


def classify(df: DataFrame, id_col: str, text: str, examples: int = 3) -> DataFrame:
    """One row for each document and class: label, severity, count, first_pos, examples, cves."""
    each = with_findings(df.select(id_col, text), text, "f", examples).select(id_col, F.explode_outer("f").alias("f"))
    return each.where("f is not null").select(id_col, *[F.col(f"f.{c}").alias(c) for c in ("label", "severity", "count", "first_pos", "examples", "cves")])


def brief(df: DataFrame, text: str, examples: int = 5) -> DataFrame:
    """``text`` replaced by the severity-ranked brief."""
    step = with_findings(df, text, "__f", examples)
    name = F.create_map(*[F.lit(x) for k, (n, _) in P.SEVERITY.items() for x in (k, n)])
    icon = F.create_map(*[F.lit(x) for k, (_, i) in P.SEVERITY.items() for x in (k, i)])

    def section(f):
        cves = F.when(F.size(f["cves"]) > 0, F.concat(F.lit("  ("), F.array_join(F.slice(f["cves"], 1, 5), ", "), F.lit(")"))).otherwise("")
        head = F.concat(F.element_at(icon, f["severity"]), F.lit(" "), f["label"], F.lit(" ["), F.element_at(name, f["severity"]), F.lit("]: "), f["count"].cast("string"), cves)
        rows = F.transform(f["examples"], lambda x, i: F.concat(F.lit("    "), (i + 1).cast("string"), F.lit(". "), x))
        left = f["count"] - F.size(f["examples"])
        more = F.when(left > 0, F.array(F.concat(F.lit("    … and "), left.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.array(head), rows, more), "\n")

    total = F.aggregate("__f", F.lit(0).cast("long"), lambda a, f: a + f["count"])
    head = F.concat(F.lit(f"{TITLE}\n\nDetected "), total.cast("string"), F.lit(" findings across "), F.size("__f").cast("string"), F.lit(" categories.\n\n"))
    body = F.concat(head, F.array_join(F.transform("__f", section), "\n\n"))
    done = F.concat(F.regexp_replace(body, rf"{P.WS}+\z", ""), F.lit("\n"))
    none = F.lit(f"{TITLE}\nNo recognizable findings detected.")
    return step.withColumn(text, F.when(F.col(text).isNotNull(), F.when(F.size("__f") > 0, done).otherwise(none))).drop("__f")
