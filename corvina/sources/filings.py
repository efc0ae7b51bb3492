"""Company filings: which of a submissions table an import takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARCHIVE = "https://www.sec.gov/Archives/edgar/data"


def cik(value: Column) -> Column:
    """Ten digits."""
    return F.substring(F.lpad(F.regexp_replace(value.cast("string"), "[^0-9]", ""), 10, "0"), -10, 10)


def companies(asked: DataFrame, tickers: DataFrame) -> DataFrame:
    """asked(pos, ticker, cik) to pos, ticker, cik, name: a ticker is looked up, a number stands for itself; unknown ones go.

    tickers(ticker, cik_str, title). Of a ticker or number asked for twice the first place counts.
    """
    upper = F.upper(F.trim("ticker"))
    known = tickers.groupBy(upper.alias("t")).agg(F.min_by(F.struct("cik_str", "title"), "cik_str").alias("k"))
    found = asked.withColumn("t", F.nullif(upper, F.lit(""))).join(known, "t", "left")
    number = F.coalesce(F.nullif(F.regexp_replace(F.col("cik").cast("string"), "[^0-9]", ""), F.lit("")), F.col("k.cik_str").cast("string"))
    rows = found.filter(number.isNotNull()).select("pos", F.col("t").alias("ticker"), cik(number).alias("cik"), F.col("k.title").alias("name"))
    return rows.groupBy("cik").agg(F.min(F.struct("pos", "ticker", "name")).alias("r")).select("r.pos", "r.ticker", "cik", "r.name")


def select_filings(filings: DataFrame, wanted: DataFrame, forms: list[str], days: int | None, now: Column, per_form: int, most: int | None = None) -> DataFrame:
    """The filings to import: of the wanted companies' given forms, not older than ``days``, the first ``per_form`` of each form, ``most`` in all.

    filings(cik, pos, form, filing_date, accession, primary_document): pos is the place in the company's list, newest first.
    Companies come in their order, so those asked for first fill an overall limit. Each row has its address and a file name.
    """
    named = filings.withColumn("cik", cik(F.col("cik"))).withColumn("form", F.trim("form"))
    given = (F.coalesce(F.trim("accession"), F.lit("")) != "") & (F.coalesce(F.trim("primary_document"), F.lit("")) != "")
    rows = named.filter(F.col("form").isin(forms) & given)
    if days is not None and days > 0:
        rows = rows.filter(F.try_to_timestamp(F.col("filing_date").cast("string"), F.lit("yyyy-MM-dd")) >= now - F.make_interval(days=F.lit(days)))
    rows = rows.join(wanted.select("cik", F.col("pos").alias("company"), "ticker", "name"), "cik")
    kept = rows.withColumn("r", F.row_number().over(Window.partitionBy("cik", "form").orderBy("pos"))).filter(F.col("r") <= per_form).drop("r")
    flat = F.replace("accession", F.lit("-"), F.lit(""))
    number = F.regexp_replace("cik", "^0+(?=.)", "")
    out = kept.select(
        "company", "pos", "ticker", "cik", "name", "form", "filing_date", F.concat_ws("/", F.lit(ARCHIVE), number, flat, "primary_document").alias("url"),
        F.regexp_replace(F.concat_ws("_", F.coalesce("ticker", "cik"), "form", F.col("filing_date").cast("string"), flat, "primary_document"), "[^A-Za-z0-9_.-]+", "_").alias("filename"),
    )
    return out if most is None else out.orderBy("company", "pos").limit(most)
