"""Transmission-contract auctions: round labels, result reports, curated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: report column -> curated column
REPORT_COLUMNS = {"period_duration": "period_months", "start_date": "period_start", "end_date": "period_end",
                  "ptid_name": "poi_name", "ptid": "poi", "zone": "poi_zone"}
INTEGER_COLUMNS = ("period_id", "period_months", "poi", "pow", "tccs_awarded")
PRICE_FIELDS = ("nodal_price", "mcp")
LABEL = r"^(\d{4}) (Winter|Spring|Summer|Autumn) (.+?) \(Ver (\d+) - (\w+)\)$"
TERM_MONTHS = {"One Year": 12, "Six Month": 6, "Two Year": 24}


def decode_rounds(labels: DataFrame, strict: bool = True) -> DataFrame:
    """(round_id, label) -> what the label encodes.  An unknown label is an error, or a row with NULLs when not strict."""
    text = F.trim(F.replace("label", F.lit("&amp;"), F.lit("&")))
    part = lambda i: F.regexp_extract(text, LABEL, i)                              # noqa: E731
    what = part(3)
    kind = (F.when(what.startswith("Centralized TCC Auction"), "centralized").when(what.startswith("Monthly Reconfiguration"), "monthly")
            .when(what.startswith("Balance-of-Period"), "bop").otherwise("fixed_price"))
    term: Column = F.lit(None).cast("int")
    for name, months in reversed(TERM_MONTHS.items()):
        term = F.when(what.contains(name), months).otherwise(term)
    known = F.regexp_like(text, F.lit(LABEL))
    out = labels.withColumn("_ok", known)
    if strict:
        out = out.withColumn("label", F.when(F.col("_ok"), F.col("label")).otherwise(
            F.raise_error(F.concat(F.lit("unrecognised round label: "), F.col("label")))))
    round_no = F.when(kind == "centralized", F.regexp_extract(what, r"Round (\d+)", 1).try_cast("int"))
    return out.select(F.col("round_id").cast("bigint"), F.trim("label").alias("label"), part(1).try_cast("int").alias("season_year"),
                      F.nullif(part(2), F.lit("")).alias("season"), F.when(F.col("_ok"), kind).alias("kind"), round_no.alias("round_no"),
                      term.alias("term_months"), part(4).try_cast("int").alias("version"),
                      F.nullif(part(5), F.lit("")).alias("status"))


def _tidy(name: str) -> str:
    import re

    base = re.sub(r"\s*\(.*\)", "", name).strip().lower().replace(" ", "_")
    return REPORT_COLUMNS.get(base, base)


def parse_reports(texts: DataFrame, header: str) -> DataFrame:
    """(round_id, text): whole report files -> data rows with posted_date and status.

    Title block and footer are dropped: data rows are the lines after the header whose first field is a number.
    `header` is the table's header line, so the columns are known when the plan is built.
    """
    names = [_tidy(c) for c in header.strip().split(",")]
    schema = ", ".join(f"`{n}` string" for n in names)
    lines = F.split(F.replace(F.ltrim(F.col("text"), F.lit("﻿")), F.lit("\r"), F.lit("")), "\n")
    rows = texts.select(
        "round_id", F.to_date(F.regexp_extract("text", r"Posted: ([A-Za-z]+ \d+, \d{4})", 1), "MMMM d, yyyy").alias("posted_date"),
        F.regexp_extract("text", r"Current Status - (\w+)", 1).alias("status"), F.explode(lines).alias("_line"))
    rows = rows.filter(F.regexp_like("_line", F.lit(r'^"?\d+"?,')))
    rows = rows.withColumn("_r", F.from_csv("_line", schema, {"mode": "PERMISSIVE"}))
    fields = []
    for n in names:
        v = F.trim(F.col(f"_r.{n}"))
        if n in INTEGER_COLUMNS:
            v = v.try_cast("double").try_cast("bigint")
        elif n in PRICE_FIELDS:
            v = v.try_cast("double")
        elif n in ("period_start", "period_end"):
            v = F.try_to_date(v, "MM/dd/yyyy")
        fields.append(v.alias(n))
    return rows.select("round_id", "posted_date", "status", *fields)


def build_tables(rounds: DataFrame, nodal: DataFrame, awards: DataFrame) -> dict[str, DataFrame]:
    """Keep the rounds that have both reports; posted date and status come from the awards report."""
    posted = awards.groupBy("round_id").agg(F.max("posted_date").alias("posted_date"), F.max("status").alias("status"))
    both = posted.join(nodal.select("round_id").distinct(), "round_id", "left_semi")
    return {"tcc_rounds": rounds.drop("status").join(both, "round_id"),
            "tcc_nodal_prices": nodal.drop("status").join(both.select("round_id"), "round_id", "left_semi"),
            "tcc_awards": awards.drop("status").join(both.select("round_id"), "round_id", "left_semi")}


def read_reports(spark: SparkSession, paths: str | list[str], header: str) -> DataFrame:
    """Report files named <round_id>_*.csv."""
    texts = spark.read.text(paths, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("bigint").alias("round_id"), F.col("value").alias("text"))
    return parse_reports(texts, header)
