"""Seeded people and noise. Every value is a hash of the row's id, the seed and a tag, so a row is the same however the table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions.strings import swap_last

#: Names and places to draw from (our own lists).
FIRST = "Ada Boris Clara Dmitri Elena Farid Greta Hugo Ines Jonas Kira Lars Mona Nils Olga Pavel Quinn Rosa Sven Tara Ulla Viktor Wanda Xenia Yusuf Zora Aron Bella Cyrus Dora Emil Frida Gino Hanna Igor Julia Karl Lena Milo Nora".split()
LAST = "Abrams Becker Castro Dalton Ekberg Fischer Garner Holm Ivers Jensen Keller Lindt Moreau Norris Olsen Palmer Quist Rossi Strand Turner Ullman Varga Weber Xander Young Zimmer Arndt Bloom Corbin Dunne Ellis Frost Grant Hayes Ingram Joyce Knight Lowell Mercer Nash".split()
STREETS = "Alder Birch Cedar Dogwood Elm Forest Garden Harbour Island Juniper King Lake Maple North Oak Pine Queen River Spruce Willow".split()
KINDS = "Street Avenue Road Boulevard".split()
CITIES = "Aurora Brandon Calgary Dover Eston Fergus Guelph Halton Ingleside Jasper Kelowna Laval".split()
PROVINCES = "AB BC MB NB NS ON PE QC SK".split()
DOMAINS = "example.com example.org example.net mail.example.com".split()
#: Rates of missing optional fields and of variations; rates and year bounds of the voter mutations.
MISSING_RATE, VARIATION_RATE = 0.3, 0.15
MUTATION_RATES = {"name_permute": 0.55, "address_change": 0.55, "address_drop": 0.20, "dob_year": 0.10}
YEARS = (1900, 2009)
#: Abbreviations of street kinds and their long forms.
LONG_FORMS = [("St ", "Street "), ("St.", "Street"), ("Ave ", "Avenue "), ("Ave.", "Avenue"), ("Rd ", "Road "), ("Rd.", "Road"), ("Blvd ", "Boulevard "), ("Blvd.", "Boulevard")]


def _hash(seed: int, tag: str, key: str = "position") -> Column:
    return F.xxhash64(F.col(key), F.lit(seed), F.lit(tag))


def uniform(seed: int, tag: str, key: str = "position") -> Column:
    """A number from 0 to below 1."""
    return F.shiftrightunsigned(_hash(seed, tag, key), 11) / F.lit(float(1 << 53))


def pick(values: list[str], seed: int, tag: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.pmod(_hash(seed, tag), F.lit(len(values)))).cast("int"))


def number(low: int, high: int, seed: int, tag: str) -> Column:
    return F.lit(low) + F.pmod(_hash(seed, tag), F.lit(high - low + 1))


def generate_people(spark: SparkSession, count: int, missing_rate: float = MISSING_RATE, seed: int = 42) -> DataFrame:
    """``count`` people of 14 to 94 years (on 2024-12-31) with ``position``; address and email are each missing at the rate."""
    base = spark.range(count).withColumnRenamed("id", "position")
    first, last = pick(FIRST, seed, "first"), pick(LAST, seed, "last")
    born = F.date_sub(F.lit("2024-12-31").cast("date"), number(14 * 365, 94 * 365, seed, "born").cast("int"))
    letter = lambda tag: F.chr(number(65, 90, seed, tag))
    digit = lambda tag: number(0, 9, seed, tag).cast("string")
    postal = F.concat(letter("z1"), digit("z2"), letter("z3"), F.lit(" "), digit("z4"), letter("z5"), digit("z6"))
    street = F.concat_ws(" ", number(1, 9999, seed, "house").cast("string"), pick(STREETS, seed, "street"), pick(KINDS, seed, "kind"))
    address = F.concat(street, F.lit(", "), pick(CITIES, seed, "city"), F.lit(", "), pick(PROVINCES, seed, "province"), F.lit(" "), postal)
    email = F.concat(F.lower(first), F.lit("."), F.lower(last), number(1, 999, seed, "mail").cast("string"), F.lit("@"), pick(DOMAINS, seed, "domain"))
    return base.select(
        "position",
        first.alias("first_name"),
        last.alias("last_name"),
        F.date_format(born, "yyyy-MM-dd").alias("date_of_birth"),
        F.when(uniform(seed, "no address") >= missing_rate, address).alias("address"),
        F.when(uniform(seed, "no email") >= missing_rate, email).alias("email"),
    )


def typo(text: Column, seed: int, tag: str) -> Column:
    """One character replaced by a letter a-z; it may be the same letter. Empty stays empty."""
    at = (1 + F.pmod(_hash(seed, f"{tag} place"), F.greatest(F.length(text), F.lit(1)))).cast("int")
    changed = F.concat(F.substring(text, F.lit(1), at - 1), F.chr(number(97, 122, seed, f"{tag} letter")), F.substring(text, at + 1, F.length(text)))
    return F.when(F.length(text) > 0, changed).otherwise(text)


def introduce_variations(people: DataFrame, rate: float = VARIATION_RATE, seed: int = 42, require_change: bool = False) -> DataFrame:
    """Each field varies at the rate: a typo in names of three characters or more, long forms in addresses, digits in emails.

    ``require_change``: where nothing changed the last two characters of the last name are swapped, or, if they are equal, an ``x`` follows.
    """
    on = lambda tag: uniform(seed, tag) < rate
    name = lambda c: F.when(on(c) & (F.length(c) > 2), typo(F.col(c), seed, c)).otherwise(F.col(c))
    address = F.col("address")
    for k, (short, long) in enumerate(LONG_FORMS):
        # the address stands in the expression once: twice a step would double it at each
        address = F.replace(address, F.lit(short), F.when(uniform(seed, f"form {k}") < 0.5, F.lit(long)).otherwise(F.lit(short)))
    email = F.concat(F.substring_index("email", "@", 1), number(1, 99, seed, "mail digits").cast("string"), F.lit("@"), F.substring_index("email", "@", -1))
    new = {
        "first_name": name("first_name"),
        "last_name": name("last_name"),
        "address": F.when(on("address"), address).otherwise(F.col("address")),
        "email": F.when(on("email") & (uniform(seed, "mail half") < 0.5), email).otherwise(F.col("email")),
    }
    if not require_change:
        return people.withColumns(new)
    return _ensure_change(people, new)


def _ensure_change(people: DataFrame, new: dict[str, Column]) -> DataFrame:
    out = people.withColumns({f"_{c}": x for c, x in new.items()})
    same = F.lit(True)
    for c in new:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    swapped = swap_last(F.col("last_name"))
    forced = F.when(swapped == F.col("last_name"), F.concat("last_name", F.lit("x"))).otherwise(swapped)
    out = out.withColumn("_last_name", F.when(same, forced).otherwise(F.col("_last_name")))
    return out.withColumns({c: F.col(f"_{c}") for c in new}).drop(*[f"_{c}" for c in new])


def perturb_voter_address(seed: int) -> Column:
    """The first number one up or down (not below 0) at 0.6, the part after the last comma dropped at 0.4; null if nothing is left."""
    a = F.col("address")
    head, digits, tail = (F.regexp_extract(a, r"^(\D*)(\d+)(.*)$", k) for k in (1, 2, 3))
    moved = F.greatest(digits.cast("bigint") + F.when(uniform(seed, "up") < 0.5, 1).otherwise(-1), F.lit(0)).cast("string")
    a = F.when((digits != "") & (uniform(seed, "house change") < 0.6), F.concat(head, moved, tail)).otherwise(a)
    parts = F.transform(F.split(a, ","), lambda x: F.trim(x))
    a = F.when((uniform(seed, "city drop") < 0.4) & (F.size(parts) >= 2), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", ")).otherwise(a)
    return F.when(F.trim(a) != "", F.trim(a))


def mutate_voters(people: DataFrame, seed: int = 7, rates: dict[str, float] | None = None) -> DataFrame:
    """Noisy duplicates: typos in names, the birth year one off (as January 1st, between the year bounds), the address dropped or changed. Never equal to the original."""
    rates = MUTATION_RATES | (rates or {})
    name = lambda c: F.when(uniform(seed, f"{c} typo") < rates["name_permute"], typo(F.col(c), seed, c)).otherwise(F.col(c))
    year = F.least(F.greatest(F.substring("date_of_birth", 1, 4).cast("int") + F.when(uniform(seed, "year up") < 0.5, 1).otherwise(-1), F.lit(YEARS[0])), F.lit(YEARS[1]))
    roll = uniform(seed, "drop")
    new = {
        "first_name": name("first_name"),
        "last_name": name("last_name"),
        "date_of_birth": F.when(uniform(seed, "year") < rates["dob_year"], F.concat(year.cast("string"), F.lit("-01-01"))).otherwise(F.col("date_of_birth")),
        "address": F.when(roll < rates["address_drop"], F.lit(None)).when(uniform(seed, "change") < rates["address_change"], perturb_voter_address(seed)).otherwise(F.col("address")),
    }
    return _ensure_change(people, new)


def perturb_name() -> Column:
    """The last letter of the first name becomes a, or e if it is an a; a name of one letter gets an a."""
    n, name = F.length("first_name"), F.col("first_name")
    last = F.lower(F.substring(name, n, F.lit(1)))
    return F.when(n < 2, F.concat(name, F.lit("a"))).otherwise(F.concat(F.substring(name, F.lit(1), n - 1), F.when(last == "a", "e").otherwise("a")))


def perturb_address() -> Column:
    """Street and Avenue abbreviated, or else the first blank doubled; null and empty stay."""
    a = F.col("address")
    short = F.replace(F.replace(a, F.lit(" Street"), F.lit(" St")), F.lit(" Avenue"), F.lit(" Ave"))
    at = F.instr(a, " ")
    doubled = F.when(at > 0, F.concat(F.substring(a, F.lit(1), at), F.lit(" "), F.substring(a, at + 1, F.length(a)))).otherwise(a)
    return F.when(short != a, short).otherwise(doubled)


#: The ablations: which fields change, and how.
def ablations() -> dict[str, dict[str, Column]]:
    null = F.lit(None).cast("string")
    return {
        "baseline": {},
        "missing_email": {"email": null},
        "missing_address": {"address": null},
        "missing_both": {"address": null, "email": null},
        "address_change": {"address": perturb_address()},
        "name_perturbation": {"first_name": perturb_name()},
    }


def ablation_variants(people: DataFrame) -> DataFrame:
    """Every person in every variant, with ``category`` and the person's position as ``true_position``; one pass over the people."""
    fields = ["first_name", "last_name", "date_of_birth", "address", "email"]
    rows = [F.struct(F.lit(name).alias("category"), *[new.get(c, F.col(c)).alias(c) for c in fields]) for name, new in ablations().items()]
    return people.select(F.col("position").alias("true_position"), F.inline(F.array(*rows)))


def labelled_cases(people: DataFrame, close: DataFrame, unrelated: DataFrame) -> DataFrame:
    """Three queries for each person: itself, its variation and someone else; ``(query_id, category, expected_match, true_position, fields)``."""
    fields = ["first_name", "last_name", "date_of_birth", "address", "email"]

    def part(df: DataFrame, category: str, match: bool) -> DataFrame:
        true = F.col("position") if match else F.lit(None).cast("bigint")
        return df.select(F.concat_ws("_", F.lit("Q"), "position", F.lit(category)).alias("query_id"), F.lit(category).alias("category"), F.lit(match).alias("expected_match"), true.alias("true_position"), *fields)

    return part(people, "identical", True).unionByName(part(close, "close_same_entity", True)).unionByName(part(unrelated, "unrelated", False))


def labelled_pairs(people: DataFrame, close: DataFrame, unrelated: DataFrame) -> DataFrame:
    """Each person with itself (1), its variation (1) and someone else (0), side by side; joined by position."""
    fields = ["first_name", "last_name", "date_of_birth", "address", "email"]
    left = people.select("position", *[F.col(c).alias(f"{c}_l") for c in fields])

    def part(df: DataFrame, match: int) -> DataFrame:
        right = df.select("position", *[F.col(c).alias(f"{c}_r") for c in fields])
        return left.join(right, "position").withColumn("is_match", F.lit(match))

    return part(people, 1).unionByName(part(close, 1)).unionByName(part(unrelated, 0))


def duplicate_bearing(people: DataFrame, twin_of: DataFrame, n: int) -> DataFrame:
    """The reference with twins: all people, and variations of some (``twin_of``: position and fields) at positions from n on, with ``origin``."""
    twins = twin_of.withColumn("origin", F.col("position")).withColumn("position", F.col("position") + n)
    return people.withColumn("origin", F.col("position")).unionByName(twins)
