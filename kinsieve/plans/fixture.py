"""People derived from ``customer`` by arithmetic on its key, in Spark and as SQL.

``person`` is the reference (position = key order, which is dense), ``query`` holds a case
for each person (a variant by the key) and an unrelated person for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.operators.synth import CITIES, DOMAINS, FIRST, LAST, STREETS
from kinsieve.sources.records import spread

FIELDS = ["first_name", "last_name", "date_of_birth", "address", "email"]
UNRELATED = 1_000_003
#: Last names in use, so that full names and birth dates recur.
LAST_USED = 24
UNRELATED_ID = 10_000_000
CATEGORIES = ["identical", "name_swap", "address_change", "missing_email", "missing_address", "missing_both"]
RULES = (("date_of_birth",), ("first_name", "last_name"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "customer").select("c_custkey"))


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + at).cast("int"))


def _div(i: Column, n: int) -> Column:
    return F.floor(i / F.lit(n)).cast("bigint")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def person_columns(i: Column) -> dict[str, Column]:
    first = _pick(FIRST, i % len(FIRST))
    last = _pick(LAST, (i * 7 + _div(i, len(FIRST))) % LAST_USED)
    born = F.concat_ws("-", (1930 + (i * 13) % 40).cast("string"), _two(1 + (i * 5) % 12), _two(1 + (i * 11) % 28))
    kind = F.when(i % 2 == 0, " Street, ").otherwise(" Avenue, ")
    address = F.concat((1 + (i * 17) % 900).cast("string"), F.lit(" "), _pick(STREETS, i % len(STREETS)), kind, _pick(CITIES, i % len(CITIES)))
    email = F.concat(F.lower(first), F.lit("."), F.lower(last), (1 + i % 999).cast("string"), F.lit("@"), _pick(DOMAINS, i % len(DOMAINS)))
    return {"first_name": first, "last_name": last, "date_of_birth": born, "address": F.when(i % 10 >= 3, address), "email": F.when(_div(i, 10) % 10 >= 3, email)}


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_keys(spark, sf_dir).select(F.col("c_custkey").alias("position")).select("position", *[c.alias(n) for n, c in person_columns(F.col("position")).items()])


def _swap(c: Column) -> Column:
    n = F.length(c)
    return F.concat(F.substring(c, F.lit(1), n - 2), F.substring(c, n, F.lit(1)), F.substring(c, n - 1, F.lit(1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, null = person(spark, sf_dir), F.col("position") % 6, F.lit(None).cast("string")
    short = F.replace(F.replace(F.col("address"), F.lit(" Street"), F.lit(" St")), F.lit(" Avenue"), F.lit(" Ave"))
    own = p.select(
        F.col("position").alias("query_id"),
        _pick(CATEGORIES, k).alias("category"),
        F.lit(True).alias("expected_match"),
        F.col("position").alias("true_position"),
        F.when(k == 1, _swap(F.col("first_name"))).otherwise(F.col("first_name")).alias("first_name"),
        "last_name",
        "date_of_birth",
        F.when(k == 2, short).when(k >= 4, null).otherwise(F.col("address")).alias("address"),
        F.when((k == 3) | (k == 5), null).otherwise(F.col("email")).alias("email"),
    )
    other = {n: c.alias(n) for n, c in person_columns(F.col("c_custkey") + UNRELATED).items()}
    unrelated = customer_keys(spark, sf_dir).select((F.col("c_custkey") + UNRELATED_ID).alias("query_id"), F.lit("unrelated").alias("category"), F.lit(False).alias("expected_match"), F.lit(None).cast("bigint").alias("true_position"), *other.values())
    return own.unionByName(unrelated)


def close_person(people: DataFrame) -> DataFrame:
    """A variation of each person that both engines can make: the last name's last two characters swapped."""
    return people.withColumn("last_name", _swap(F.col("last_name")))


def unrelated_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_keys(spark, sf_dir).select(F.col("c_custkey").alias("position"), *[c.alias(n) for n, c in person_columns(F.col("c_custkey") + UNRELATED).items()])


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def person_sql(i: str) -> dict[str, str]:
    first = f"list_extract({_list(FIRST)}, cast(1 + ({i}) % {len(FIRST)} as int))"
    last = f"list_extract({_list(LAST)}, cast(1 + (({i}) * 7 + ({i}) // {len(FIRST)}) % {LAST_USED} as int))"
    two = lambda x: f"lpad(cast({x} as varchar), 2, '0')"
    born = f"cast(1930 + (({i}) * 13) % 40 as varchar) || '-' || {two(f'1 + (({i}) * 5) % 12')} || '-' || {two(f'1 + (({i}) * 11) % 28')}"
    address = f"cast(1 + (({i}) * 17) % 900 as varchar) || ' ' || list_extract({_list(STREETS)}, cast(1 + ({i}) % {len(STREETS)} as int)) || case when ({i}) % 2 = 0 then ' Street, ' else ' Avenue, ' end || list_extract({_list(CITIES)}, cast(1 + ({i}) % {len(CITIES)} as int))"
    email = f"lower({first}) || '.' || lower({last}) || cast(1 + ({i}) % 999 as varchar) || '@' || list_extract({_list(DOMAINS)}, cast(1 + ({i}) % {len(DOMAINS)} as int))"
    return {"first_name": first, "last_name": last, "date_of_birth": born, "address": f"case when ({i}) % 10 >= 3 then {address} end", "email": f"case when (({i}) // 10) % 10 >= 3 then {email} end"}


def _columns(i: str) -> str:
    return ", ".join(f"{c} as {n}" for n, c in person_sql(i).items())


def _swap_sql(c: str) -> str:
    return f"substr({c}, 1, length({c}) - 2) || substr({c}, length({c}), 1) || substr({c}, length({c}) - 1, 1)"


SWAP_SQL = _swap_sql
PERSON_SQL = f"person as (select c_custkey as position, {_columns('c_custkey')} from customer)"
UNRELATED_SQL = f"stranger as (select c_custkey as position, {_columns(f'c_custkey + {UNRELATED}')} from customer)"
QUERY_SQL = f"""query as (
  select position as query_id, list_extract({_list(CATEGORIES)}, cast(1 + position % 6 as int)) as category, true as expected_match, position as true_position,
    case when position % 6 = 1 then {_swap_sql('first_name')} else first_name end as first_name, last_name, date_of_birth,
    case when position % 6 = 2 then replace(replace(address, ' Street', ' St'), ' Avenue', ' Ave') when position % 6 >= 4 then null else address end as address,
    case when position % 6 in (3, 5) then null else email end as email
  from person
  union all select position + {UNRELATED_ID}, 'unrelated', false, null, first_name, last_name, date_of_birth, address, email from stranger)"""
PAIR_FIELDS_SQL = ", ".join(f"q.{f} as {f}_l, p.{f} as {f}_r" for f in FIELDS)
CANDIDATE_SQL = f"""cand as (
  select q.query_id, p.position, 0 as match_rule, {PAIR_FIELDS_SQL} from query q join person p on q.date_of_birth = p.date_of_birth
  union all select q.query_id, p.position, 1, {PAIR_FIELDS_SQL} from query q join person p on q.first_name = p.first_name and q.last_name = p.last_name
  where q.date_of_birth <> p.date_of_birth)"""


def jw_gamma_sql(f: str, thresholds: tuple[float, ...]) -> str:
    jw = f"jaro_winkler_similarity({f}_l, {f}_r)"
    n = len(thresholds) + 1
    rest = " ".join(f"when {jw} >= {t} then {n - 1 - k}" for k, t in enumerate(thresholds))
    return f"case when {f}_l is null or {f}_r is null then -1 when {f}_l = {f}_r then {n} {rest} else 0 end"


def birth_gamma_sql(f: str = "date_of_birth") -> str:
    days = f"abs(date_diff('day', try_cast({f}_l as date), try_cast({f}_r as date)))"
    return (
        f"case when try_cast({f}_l as date) is null or try_cast({f}_r as date) is null then -1 when {f}_l = {f}_r then 5 "
        f"when damerau_levenshtein({f}_l, {f}_r) <= 1 then 4 when {days} <= 30.4375 then 3 when {days} <= 365.25 then 2 when {days} <= 3652.5 then 1 else 0 end"
    )


def email_gamma_sql(f: str = "email") -> str:
    user = lambda s: f"split_part({f}_{s}, '@', 1)"
    return (
        f"case when {f}_l is null or {f}_r is null then -1 when {f}_l = {f}_r then 4 when {user('l')} = {user('r')} then 3 "
        f"when jaro_winkler_similarity({f}_l, {f}_r) >= 0.88 then 2 when jaro_winkler_similarity({user('l')}, {user('r')}) >= 0.88 then 1 else 0 end"
    )


GAMMA_EXPRESSIONS = {
    "first_name": jw_gamma_sql("first_name", (0.9, 0.8, 0.7)),
    "last_name": jw_gamma_sql("last_name", (0.9, 0.8, 0.7)),
    "date_of_birth": birth_gamma_sql(),
    "email": email_gamma_sql(),
    "address": jw_gamma_sql("address", (0.85, 0.75, 0.65)),
}
GAMMAS_SQL = ", ".join(f"{sql} as gamma_{f}" for f, sql in GAMMA_EXPRESSIONS.items())
GAMMA_SQL = f"gam as (select query_id, position, {GAMMAS_SQL} from cand)"


def default_weights_sql(levels: int) -> dict[int, float]:
    """Untrained weights by level, worked out here again from their rule: weights of -5, then 3 to 10 in even steps, and u scaled to 1."""
    import math

    raw = [-5.0] + [3.0 + 7.0 * k / (levels - 2) for k in range(levels - 1)]
    m = [0.05 / (levels - 1)] * (levels - 1) + [0.95]
    total = sum(a / 2**w for a, w in zip(m, raw, strict=True))
    return {k: w + math.log2(total) for k, w in enumerate(raw)}


LEVELS = {"first_name": 5, "last_name": 5, "date_of_birth": 6, "email": 5, "address": 5}


def weight_case(f: str, weights: dict[int, float]) -> str:
    return f"case gamma_{f} " + " ".join(f"when {k} then {w!r}" for k, w in weights.items()) + " else 0.0 end"


def score_sql(prior: float = 0.0001, weights: dict[str, dict[int, float]] | None = None, source: str = "gam", name: str = "scored") -> str:
    import math

    weights = weights or {f: default_weights_sql(n) for f, n in LEVELS.items()}
    w = " + ".join([repr(math.log2(prior / (1 - prior))), *(weight_case(f, weights[f]) for f in LEVELS)])
    return f"{name} as (select *, 1 / (1 + power(2.0::double, -match_weight)) as match_probability from (select *, cast({w} as double) as match_weight from {source}))"


BASE_SQL = f"with {PERSON_SQL}, {UNRELATED_SQL}, {QUERY_SQL}"
PAIRS_SQL = f"{BASE_SQL}, {CANDIDATE_SQL}"
COMPARED_SQL = f"{PAIRS_SQL}, {GAMMA_SQL}"
SCORED_SQL = f"{COMPARED_SQL}, {score_sql()}"
CASES_SQL = f"{SCORED_SQL}, cases as (select q.query_id, q.category, q.expected_match, coalesce(max(s.match_probability), 0.0) as probability from query q left join scored s using (query_id) group by all)"
TEXT_SQL = "'First Name: ' || first_name || chr(10) || 'Last Name: ' || last_name || chr(10) || 'Date of Birth: ' || date_of_birth || case when coalesce(address, '') <> '' then chr(10) || 'Address: ' || address else '' end || case when coalesce(email, '') <> '' then chr(10) || 'Email: ' || email else '' end"
