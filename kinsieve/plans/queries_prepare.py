"""Queries on preparing records: text, string measures, candidates, stores, samples, voter files, noise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions import strings as S
from kinsieve.functions.text import person_text
from kinsieve.operators import blocking, blocks, comparison, sampling, synth
from kinsieve.operators.embedding import LetterCountEmbedder
from kinsieve.sources import store, voter

from . import fixture as X

SAMPLE = 200
#: Fixed value: the share of people who have a twin.
MATCH_RATE = 0.03


def _text(strategy: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.person(spark, sf_dir).select("position", person_text(strategy).alias("text"))

    return q


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.query_candidates(X.query(spark, sf_dir), X.person(spark, sf_dir), X.RULES)


def _sides(spark: SparkSession, sf_dir: str) -> tuple:
    return X.query(spark, sf_dir), X.person(spark, sf_dir), X.RULES


def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"jw_first": "first_name", "jw_last": "last_name", "jw_email": "email", "jw_address": "address"}
    got = blocks.measured_pairs(*_sides(spark, sf_dir), {n: (f, S.jaro_winkler_cross, np.nan, float) for n, f in fields.items()}, "double")
    return got.select("query_id", "position", *[F.round(F.nanvl(n, F.lit(None).cast("double")), 6).alias(n) for n in fields])


def damerau_le1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = blocks.measured_pairs(*_sides(spark, sf_dir), {f: (f, blocks.within_one_edit, -1, np.int8) for f in ("first_name", "date_of_birth")}, "int")
    return got.select("query_id", "position", *[F.when(F.col(f) >= 0, F.col(f) == 1).alias(f) for f in ("first_name", "date_of_birth")])


def _gammas(*names: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = [c for c in comparison.default_comparisons() if c.name in names]
        return blocks.compared_pairs(*_sides(spark, sf_dir), chosen).select("query_id", "position", *[f"gamma_{n}" for n in names])

    return q


def block_query_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("query_id", "position", "match_rule")


def block_equi_rule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.rule_pairs(X.person(spark, sf_dir), [("date_of_birth",)]).select("position_l", "position_r")


def block_multi_rule_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.rule_pairs(X.person(spark, sf_dir), blocking.RESOLVER_RULES).select("position_l", "position_r", "match_rule")


def ablation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.ablation_variants(X.person(spark, sf_dir))


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.person(spark, sf_dir)
    return synth.labelled_cases(p, X.close_person(p), X.unrelated_person(spark, sf_dir)).withColumn("true_position", F.coalesce("true_position", F.lit(-1)))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.person(spark, sf_dir)
    return synth.labelled_pairs(p, X.close_person(p), X.unrelated_person(spark, sf_dir)).drop("position")


def duplicate_bearing_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twins of a sample of the people, after all of them."""
    p = X.person(spark, sf_dir)
    twins = X.close_person(sampling.rate_sample(p, MATCH_RATE, "position"))
    return synth.duplicate_bearing(p, twins, p.count())


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform_sample(X.read(spark, sf_dir, "orders"), SAMPLE, "o_orderkey").select("o_orderkey", "o_totalprice")


def store_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unrelated people added to a store of the others, in the order of their positions."""
    added = store.ParquetStore.build(X.person(spark, sf_dir), LetterCountEmbedder()).add(X.unrelated_person(spark, sf_dir))
    return added.rows().select("position", *X.FIELDS)


def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh person replaced."""
    p = X.person(spark, sf_dir)
    return store.replace_rows(p, X.close_person(p).where("position % 7 = 0"))


def store_delete_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.person(spark, sf_dir)
    return store.delete_rows(p, p.where("position % 5 = 2").select("position"))


def voter_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a voter file, derived from customers: some without names, streets or years, some streets removed, mail parts for others."""
    i, blank = F.col("c_custkey"), F.lit("")
    p = X.person_columns(i)
    return X.read(spark, sf_dir, "customer").select(
        F.concat(F.lit(" V"), i.cast("string")).alias("voter_reg_num"),
        F.when(i % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(' "'), F.upper(p["first_name"]), F.lit('" '))).alias("first_name"),
        F.when(i % 13 == 0, blank).otherwise(F.concat(F.upper(p["last_name"]), F.lit(" "))).alias("last_name"),
        F.when(i % 17 == 0, blank).otherwise((1930 + i % 70).cast("string")).alias("birth_year"),
        F.when(i % 3 == 0, blank).when(i % 7 == 0, F.lit("Removed")).otherwise(F.concat((1 + i % 500).cast("string"), F.lit(" MAIN ST "))).alias("res_street_address"),
        F.when(i % 4 == 0, blank).otherwise(F.lit(" RALEIGH ")).alias("res_city_desc"),
        F.when(i % 5 == 0, blank).otherwise(F.lit("NC")).alias("state_cd"),
        F.when(i % 9 == 0, blank).otherwise((27000 + i % 900).cast("string")).alias("zip_code"),
        F.when(i % 2 == 0, F.lit("PO BOX 7")).otherwise(blank).alias("mail_addr1"),
        F.lit("DURHAM").alias("mail_city"),
        F.lit("VA").alias("mail_state"),
        F.lit("28000").alias("mail_zipcode"),
    )


def voter_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voter.extract(voter_source(spark, sf_dir))


def voter_extract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voter.extract_counts(voter_source(spark, sf_dir))


def voter_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voter.people(voter.extract(voter_source(spark, sf_dir)))


def voter_address_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voter_source(spark, sf_dir).select(F.trim("voter_reg_num").alias("voter_reg_num"), voter.fallback_address().alias("address"))


def generate_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many people as there are customers."""
    return synth.generate_people(spark, X.read(spark, sf_dir, "customer").count())


def mutate_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.mutate_voters(voter_people(spark, sf_dir))


def voter_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = voter_person(spark, sf_dir)
    return p.withColumn("position", F.substring("voter_reg_num", 2, 20).cast("bigint")).drop("voter_reg_num")


def vary_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.introduce_variations(X.person(spark, sf_dir), require_change=True)


QUERIES = {
    "text_default": _text("default"),
    "text_identity_first": _text("identity_first"),
    "text_compact": _text("compact"),
    "gamma_jaro_levels": _gammas("first_name", "last_name", "address"),
    "gamma_dob_levels": _gammas("date_of_birth"),
    "gamma_email_levels": _gammas("email"),
} | {
    f.__name__: f
    for f in (
        jaro_winkler_pairs, damerau_le1, block_query_candidates, block_equi_rule_pairs, block_multi_rule_dedup, ablation_variants, labelled_cases, labelled_pairs, duplicate_bearing_reference,
        uniform_sample, store_add, store_update, store_delete_compact, voter_extract, voter_extract_counts, voter_person, voter_address_fallback, generate_people, mutate_persons, vary_persons,
    )
}

_F = ", ".join(X.FIELDS)
_OPTIONAL = {"address": "Address", "email": "Email"}


def _line_sql(order: list[str]) -> str:
    rest = " || ".join(f"case when {f} <> '' then chr(10) || '{_OPTIONAL[f]}: ' || {f} else '' end" for f in order)
    return f"{X.BASE_SQL} select position, 'First Name: ' || first_name || chr(10) || 'Last Name: ' || last_name || chr(10) || 'Date of Birth: ' || date_of_birth || {rest.replace('case when', 'coalesce(case when').replace(chr(39) + chr(39) + ' end', chr(39) + chr(39) + ' end, ' + chr(39) + chr(39) + ')')} as text from person"


_ABLATE = {
    "baseline": {},
    "missing_email": {"email": "null"},
    "missing_address": {"address": "null"},
    "missing_both": {"address": "null", "email": "null"},
    "address_change": {
        "address": "case when replace(replace(address, ' Street', ' St'), ' Avenue', ' Ave') <> address then replace(replace(address, ' Street', ' St'), ' Avenue', ' Ave') else regexp_replace(address, ' ', '  ') end"
    },
    "name_perturbation": {"first_name": "case when length(first_name) < 2 then first_name || 'a' else substr(first_name, 1, length(first_name) - 1) || case when lower(right(first_name, 1)) = 'a' then 'e' else 'a' end end"},
}
_ABLATE_SQL = " union all ".join(f"select position as true_position, '{n}' as category, " + ", ".join(f"{new.get(f, f)} as {f}" for f in X.FIELDS) + " from person" for n, new in _ABLATE.items())
_CLOSE = f"twin as (select position, first_name, {X.SWAP_SQL('last_name')} as last_name, date_of_birth, address, email from person)"
_PAIRED = ", ".join(f"a.{f} as {f}_l, b.{f} as {f}_r" for f in X.FIELDS)
_VOTER = """with p as (select c_custkey as i, {first} as first_name, {last} as last_name from customer),
  src as (select 'V' || i as voter_reg_num, case when i % 11 = 0 then '' else upper(first_name) end as first_name, case when i % 13 = 0 then '' else upper(last_name) end as last_name,
    case when i % 17 = 0 then '' else cast(1930 + i % 70 as varchar) end as birth_year,
    case when i % 3 = 0 then '' when i % 7 = 0 then 'Removed' else cast(1 + i % 500 as varchar) || ' MAIN ST' end as street_address,
    case when i % 4 = 0 then '' else 'RALEIGH' end as city, case when i % 5 = 0 then '' else 'NC' end as state, case when i % 9 = 0 then '' else cast(27000 + i % 900 as varchar) end as zip_code,
    case when i % 2 = 0 then 'PO BOX 7' else '' end as mail from p)""".format(first=X.person_sql("c_custkey")["first_name"], last=X.person_sql("c_custkey")["last_name"])

_VOTER_PERSON = """select first_name, last_name, birth_year || '-01-01' as date_of_birth,
      case when street_address <> '' and upper(street_address) <> 'REMOVED' then concat_ws(', ', street_address, nullif(city, ''), nullif(state, ''), nullif(zip_code, '')) end as address,
      cast(null as varchar) as email, voter_reg_num from src where first_name <> '' and last_name <> '' and birth_year <> ''"""

ORACLE_SQL = {
    "text_default": _line_sql(["address", "email"]),
    "text_identity_first": _line_sql(["email", "address"]),
    "text_compact": f"{X.BASE_SQL} select position, " + " || '|' || ".join(f"coalesce({f}, '')" for f in X.FIELDS) + " as text from person",
    "jaro_winkler_pairs": f"{X.PAIRS_SQL} select query_id, position, "
    + ", ".join(f"round(jaro_winkler_similarity({f}_l, {f}_r), 6) as {n}" for f, n in (("first_name", "jw_first"), ("last_name", "jw_last"), ("email", "jw_email"), ("address", "jw_address")))
    + " from cand",
    "damerau_le1": f"{X.PAIRS_SQL} select query_id, position, damerau_levenshtein(first_name_l, first_name_r) <= 1 as first_name, damerau_levenshtein(date_of_birth_l, date_of_birth_r) <= 1 as date_of_birth from cand",
    "gamma_jaro_levels": f"{X.COMPARED_SQL} select query_id, position, gamma_first_name, gamma_last_name, gamma_address from gam",
    "gamma_dob_levels": f"{X.COMPARED_SQL} select query_id, position, gamma_date_of_birth from gam",
    "gamma_email_levels": f"{X.COMPARED_SQL} select query_id, position, gamma_email from gam",
    "block_query_candidates": f"{X.PAIRS_SQL} select query_id, position, match_rule from cand",
    "block_equi_rule_pairs": f"{X.BASE_SQL} select a.position as position_l, b.position as position_r from person a join person b on a.date_of_birth = b.date_of_birth and a.position < b.position",
    "block_multi_rule_dedup": f"""{X.BASE_SQL} select a.position as position_l, b.position as position_r, case when a.first_name = b.first_name and a.last_name = b.last_name then 0 else 1 end as match_rule
      from person a join person b on a.position < b.position and (a.date_of_birth = b.date_of_birth or (a.first_name = b.first_name and a.last_name = b.last_name))""",
    "ablation_variants": f"{X.BASE_SQL} {_ABLATE_SQL}",
    "labelled_cases": f"{X.BASE_SQL}, {_CLOSE} select 'Q_' || position || '_identical' as query_id, 'identical' as category, true as expected_match, position as true_position, {_F} from person"
    f" union all select 'Q_' || position || '_close_same_entity', 'close_same_entity', true, position, {_F} from twin union all select 'Q_' || position || '_unrelated', 'unrelated', false, -1, {_F} from stranger",
    "labelled_pairs": f"{X.BASE_SQL}, {_CLOSE} " + " union all ".join(f"select {_PAIRED}, {m} as is_match from person a join {t} b using (position)" for t, m in (("person", 1), ("twin", 1), ("stranger", 0))),
    "duplicate_bearing_reference": f"{X.BASE_SQL}, {_CLOSE}, s as (select position from person order by md5('42:' || position), position limit (select cast(round_even(count(*) * {MATCH_RATE}::double, 0) as bigint) from person)) "
    f"select position, {_F}, position as origin from person union all select position + (select count(*) from person), {_F}, position from twin where position in (select position from s)",
    "uniform_sample": f"select o_orderkey, o_totalprice from orders order by md5('42:' || o_orderkey), o_orderkey limit {SAMPLE}",
    "store_add": f"{X.BASE_SQL} select * from person union all select position + (select count(*) from person), {_F} from stranger",
    "store_update": f"{X.BASE_SQL}, {_CLOSE} select * from person where position % 7 <> 0 union all select * from twin where position % 7 = 0",
    "store_delete_compact": f"{X.BASE_SQL} select row_number() over (order by position) - 1 as position, {_F} from person where position % 5 <> 2",
    "voter_extract": f"{_VOTER} select voter_reg_num, first_name, last_name, birth_year, street_address, city, state, zip_code from src where first_name <> '' and last_name <> ''",
    "voter_extract_counts": f"{_VOTER} select count(*) as seen, count(*) filter (where first_name <> '' and last_name <> '') as kept from src",
    "voter_person": f"{_VOTER} {_VOTER_PERSON}",
    "voter_address_fallback": f"""{_VOTER} select voter_reg_num, case when street_address <> '' then concat_ws(', ', street_address, nullif(city, ''), nullif(state, ''), nullif(zip_code, ''))
      else concat_ws(', ', nullif(mail, ''), coalesce(nullif(city, ''), 'DURHAM'), coalesce(nullif(state, ''), 'VA'), coalesce(nullif(zip_code, ''), '28000')) end as address from src""",
}
