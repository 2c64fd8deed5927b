"""Voter files: extraction from the wide tab-separated source, and people from the extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import blank_to_null, with_row_number

#: Source columns and their names in the extract (fixed values).
EXTRACT = {
    "voter_reg_num": "voter_reg_num",
    "first_name": "first_name",
    "last_name": "last_name",
    "birth_year": "birth_year",
    "res_street_address": "street_address",
    "res_city_desc": "city",
    "state_cd": "state",
    "zip_code": "zip_code",
}


def read_voter_tsv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").option("quote", '"').option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)


def check_header(df: DataFrame) -> None:
    """ValueError if the file has no header or lacks an expected column."""
    if not df.columns:
        raise ValueError("the source file is empty")
    if absent := sorted(set(EXTRACT) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(absent)}")


def stripped(c: Column) -> Column:
    """Without white space and quotes at both ends; null counts as empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(' \t\r\n"'))


def extract(df: DataFrame) -> DataFrame:
    """Known columns in the source's order under their new names, of rows with a first and a last name."""
    check_header(df)
    out = df.select([stripped(F.col(c)).alias(EXTRACT[c]) for c in df.columns if c in EXTRACT])
    return out.where((F.col("first_name") != "") & (F.col("last_name") != ""))


def extract_counts(df: DataFrame) -> DataFrame:
    """Rows seen and kept."""
    kept = (stripped(F.col("first_name")) != "") & (stripped(F.col("last_name")) != "")
    return df.agg(F.count("*").alias("seen"), F.count_if(kept).alias("kept"))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(", ", *parts)


def person_columns() -> dict[str, Column]:
    street = blank_to_null(F.col("street_address"))
    address = F.when(street.isNotNull() & (F.upper(street) != "REMOVED"), _joined(street, *[blank_to_null(F.col(c)) for c in ("city", "state", "zip_code")]))
    return {
        "first_name": F.trim("first_name"),
        "last_name": F.trim("last_name"),
        "date_of_birth": F.concat(F.trim("birth_year"), F.lit("-01-01")),
        "address": address,
        "email": F.lit(None).cast("string"),
    }


def people(df: DataFrame) -> DataFrame:
    """People from extract rows with both names and a birth year: born on January 1st, without email, with an address if there is a street that was not removed."""
    whole = [blank_to_null(F.col(c)).isNotNull() for c in ("first_name", "last_name", "birth_year")]
    extra = [c for c in ("row_no", "voter_reg_num") if c in df.columns]
    return df.where(whole[0] & whole[1] & whole[2]).select(*[c.alias(n) for n, c in person_columns().items()], *extra)


def load_people(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """People from an extract CSV; the limit counts rows of the file, before invalid ones go."""
    rows = with_row_number(spark.read.option("header", True).csv(path))
    return people(rows if limit is None else rows.where(F.col("row_no") < limit))


def fallback_address() -> Column:
    """Residential parts; without a street the mail street, and then mail city, state and zip code where the residential ones are empty."""
    street = blank_to_null(F.col("res_street_address"))
    pairs = [("res_city_desc", "mail_city"), ("state_cd", "mail_state"), ("zip_code", "mail_zipcode")]
    home = [blank_to_null(F.col(a)) for a, _ in pairs]
    mail = [F.coalesce(blank_to_null(F.col(a)), blank_to_null(F.col(b))) for a, b in pairs]
    return F.when(street.isNotNull(), _joined(street, *home)).otherwise(_joined(blank_to_null(F.col("mail_addr1")), *mail))


def subset(df: DataFrame) -> DataFrame:
    """The short layout: names, birth year as ``dob``, one address, empty email; every row."""
    name = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return df.select(name("first_name").alias("first_name"), name("last_name").alias("last_name"), name("birth_year").alias("dob"), fallback_address().alias("address"), F.lit("").alias("email"))
