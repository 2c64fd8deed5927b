import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.operators import blocking, blocks, comparison as C, evaluation as ev, knn, sampling, scoring, training
from kinsieve.operators.model import LinkModel
from kinsieve.plans import fixture

FIELDS = ["first_name", "last_name", "date_of_birth", "address", "email"]
PEOPLE = [
    (0, "Ada", "Stone", "1990-01-02", "1 Elm Street, Dover", "ada.stone@example.com"),
    (1, "Ada", "Stone", "1990-01-02", "1 Elm St, Dover", None),
    (2, "Boris", "Lake", "1971-05-06", None, "b.lake@example.org"),
    (3, "Boris", "Lakes", "1971-05-07", None, "b.lake@example.net"),
    (4, "Cyrus", "Field", None, "9 Oak Road", None),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "position bigint, first_name string, last_name string, date_of_birth string, address string, email string")


def pair(spark, left, right):
    row = tuple(x for lr in zip(left, right, strict=True) for x in lr)
    return spark.createDataFrame([row], ", ".join(f"{f}_l string, {f}_r string" for f in FIELDS))


def gammas(spark, left, right):
    got = C.compare(pair(spark, left, right), C.default_comparisons()).first()
    return [got[f"gamma_{f}"] for f in ("first_name", "last_name", "date_of_birth", "email", "address")]


def test_levels(spark):
    a = ("Ada", "Stone", "1990-01-02", "1 Elm Street", "ada@example.com")
    assert gammas(spark, a, a) == [4, 4, 5, 4, 4]
    assert gammas(spark, a, ("Ada", None, "no date", None, "ada@other.org")) == [4, -1, -1, 3, -1]
    assert gammas(spark, a, ("Zed", "Stine", "1990-01-25", "x", "zzz@q.r")) == [0, 2, 3, 0, 0]
    assert [gammas(spark, a, (*a[:2], d, *a[3:]))[2] for d in ("1990-01-03", "1990-10-20", "1995-12-31", "1940-12-31")] == [4, 2, 1, 0]


def test_default_weights():
    weight = lambda n: [math.log2(m / u) for m, u in C.default_m_u(n)]
    assert weight(5) == pytest.approx([8.688, 6.355, 4.022, 1.688, -6.312], abs=1e-3)
    assert weight(6) == pytest.approx([8.368, 6.618, 4.868, 3.118, 1.368, -6.632], abs=1e-3)
    assert sum(u for _, u in C.default_m_u(5)) == pytest.approx(1)


def test_blocks_equal_pairs_compared_one_by_one(spark, monkeypatch):
    """Nulls, dates that are none, odd addresses, keys of one and of many tiles: levels, weights and best weights are those of the pairs as rows, and pairs never are rows of a measure."""
    import random

    rng = random.Random(3)
    dates, mails = ["1990-01-02", "1990-10-20", "1990-01-20", "1990-02-30", "no date", None, "1990-01-2"], ["a@x", "ab@x", "@x", "", None, "abcd@y", "abdc@y", "a"]
    rows = [(k, rng.choice(["Ada", "Aad", "Bo", "", None]), rng.choice(["Stone", "Stnoe", "Lake"]), rng.choice(dates), rng.choice(["1 Elm Street", "1 Elm St", None, "9 Oak"]), rng.choice(mails)) for k in range(70)]
    people = spark.createDataFrame(rows, "position bigint, first_name string, last_name string, date_of_birth string, address string, email string")
    asked = people.withColumnRenamed("position", "query_id")
    rules, model = [("date_of_birth",), ("first_name", "last_name")], LinkModel.untrained()
    want = {(r.query_id, r.position): r for r in scoring.score(blocking.query_candidates(asked, people, rules), model).collect()}
    names = [f"gamma_{c.name}" for c in model.comparisons]
    for most in (8, 1 << 22):
        monkeypatch.setattr(blocks, "GROUP_PAIRS", most)
        monkeypatch.setattr(blocks, "SUMMED_PAIRS", most)
        found = blocks.compared_pairs(asked, people, rules, model.comparisons)
        got = found.collect()
        assert len(got) == len(want) and all(tuple(r[n] for n in names) == tuple(want[r.query_id, r.position][n] for n in names) for r in got)
        best = {r.query_id: r.w0 for r in blocks.best_weights(asked, people, rules, [model]).collect()}
        assert best == pytest.approx({q: max(r.match_weight for (x, _), r in want.items() if x == q) for q, _ in want})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ArrowEvalPython" not in plan


def test_weaken():
    c = C.jaro_winkler_at("address", (0.85, 0.75, 0.65))
    weak = C.weaken_comparison(c, 0.5)
    assert sum(x.m for x in weak.levels if not x.is_null) == pytest.approx(1)
    assert all(w.m == pytest.approx(x.m / 2) and w.u == x.u for w, x in zip(weak.levels[1:-1], c.levels[1:-1], strict=True))
    same = C.weaken_comparison(c, 1)
    assert [x.m for x in same.levels if not x.is_null] == pytest.approx([x.m for x in c.levels if not x.is_null])
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            C.weaken_comparison(c, bad)


def test_model_json_and_settings():
    m = LinkModel.untrained(prior=0.01).weakened("address", 0.5)
    assert LinkModel.from_json(m.to_json()) == m
    assert m.with_(tau=0.5).tau == 0.5 and m.weakened("address", 1.0) is m


def test_score_is_the_formula_and_monotone(spark):
    m = LinkModel.untrained()
    a = ("Ada", "Stone", "1990-01-02", None, None)
    r = scoring.score(pair(spark, a, a), m).first()
    want = m.prior_weight + 2 * 8.68836 + 8.36837
    assert r.match_weight == pytest.approx(want, abs=1e-3) and r.match_probability == pytest.approx(1 / (1 + 2**-want), abs=1e-6)
    observed = scoring.score(pair(spark, a, a), m.with_(null_mode="observed")).first()
    assert observed.match_weight > r.match_weight
    lower = scoring.score(pair(spark, a, ("Adx", *a[1:])), m).first()
    assert lower.match_weight < r.match_weight


def test_priors_shift_without_scoring_again(spark):
    m = LinkModel.untrained()
    a = ("Ada", "Stone", "1990-01-02", None, None)
    pairs = pair(spark, a, a)
    got = {r.prior: r.match_probability for r in scoring.with_priors(scoring.score(pairs, m), m, [1e-4, 1e-2]).collect()}
    assert got[1e-2] == pytest.approx(scoring.score(pairs, m.with_(prior=1e-2)).first().match_probability)
    assert got[1e-4] == pytest.approx(scoring.score(pairs, m).first().match_probability)


def test_rules(people):
    got = {(r.position_l, r.position_r): r.match_rule for r in blocking.rule_pairs(people, [("first_name",), ("date_of_birth",), ("first_name", "last_name")]).collect()}
    assert got == {(0, 1): 0, (2, 3): 0}
    assert blocking.without_implied(blocking.RESOLVER_RULES) == [("first_name", "last_name"), ("date_of_birth",)]
    q = people.withColumnRenamed("position", "query_id")
    assert blocking.query_candidates(q, people, [("date_of_birth",)]).count() == 6  # a null agrees with nothing


def test_best_and_report(spark):
    rows = [("a", 1, 0.9, 0.5), ("a", 2, 0.9, 0.7), ("a", 3, 0.2, 0.9), ("b", 1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "query_id string, position bigint, match_probability double, blocking_score double")
    assert [(r.query_id, r.position) for r in scoring.best_match(df.where("match_probability >= 0.5")).collect()] == [("a", 2)]
    report = scoring.candidate_report(df.drop("match_probability"), df.where("match_probability >= 0.5"))
    assert sorted((r.position, r.match_probability) for r in report.where("query_id = 'a'").collect() if r.match_probability) == [(1, 0.9), (2, 0.9)] and report.count() == 4
    queries = spark.createDataFrame([("a",), ("c",)], "query_id string")
    assert {r.query_id: r.max_probability for r in scoring.max_probability(queries, df).collect()} == {"a": 0.9, "c": 0.0}


def test_knn_blocks_equal_expressions(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=5)]) for k in range(60)] + [(60, [0.0] * 5), (61, None)]
    ref = spark.createDataFrame(rows, "position bigint, vector array<double>").repartition(5)
    q = spark.createDataFrame(rows[:7] + rows[60:], "query_id bigint, vector array<double>")
    for normalize in (True, False):
        got, want = ([tuple(r) for r in f(q, ref, 4, normalize).orderBy("query_id", "rank").collect()] for f in (knn.knn_join_blocks, knn.knn_join))
        assert got == want and len(got) == 8 * 4
    assert knn.knn_join_blocks(q, ref, 1000).count() == 8 * 61
    assert knn.knn_join_blocks(q, ref, 0).count() == 0 and knn.knn_join(q, ref, 0).count() == 0


def test_knn_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(40)]
    ref, q = spark.createDataFrame(rows, "position bigint, vector array<double>"), spark.createDataFrame(rows, "query_id bigint, vector array<double>")
    want = sorted(map(tuple, knn.knn_join_blocks(q, ref, 3).collect()))
    monkeypatch.setattr(knn, "MOST_QUERY_BYTES", 200)
    assert sorted(map(tuple, knn.knn_join_blocks(q, ref, 3).collect())) == want


def test_knn_holds_few_scores_at_once(monkeypatch):
    """Queries are taken in parts, so that scores held at once do not grow with them; ties and results stay."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows, asked = rng.integers(-2, 3, size=(500, 4)).astype(float), rng.integers(-2, 3, size=(70, 4)).astype(float)
    places, vectors = pa.array(np.arange(500)), pa.array(rows.tolist())
    seen = []
    monkeypatch.setattr(knn, "MOST_ROWS", 64)
    monkeypatch.setattr(knn, "MOST_SCORES", 64 * 8)
    product = knn._Best._with
    monkeypatch.setattr(knn._Best, "_with", lambda self, found, part, rows, places: seen.append((part.stop - part.start) * rows.shape[1]) or product(self, found, part, rows, places))
    best = knn._Best(list(range(70)), asked, 6, False)
    best.see(places, vectors)
    got = list(zip(*(c.to_pylist() for c in best.columns(pa.int64())), strict=True))
    s = asked @ rows.T
    assert got == [(q, p, s[q, p]) for q in range(70) for p in np.lexsort((np.arange(500), -s[q]))[:6]] and max(seen) <= 64 * 8


def test_knn_in_tiles(spark, monkeypatch):
    """Tiles give what one broadcast block gives: ties, zero and null vectors, ids of other types, an empty reference."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, size=4)]) for k in range(90)] + [(90, [0.0] * 4), (91, None)]
    ref = spark.createDataFrame(rows, "position bigint, vector array<double>").repartition(4)
    for kind in ("string", "int"):
        q = spark.createDataFrame([((f"q{k}" if kind == "string" else k), v) for k, v in rows], f"query_id {kind}, vector array<double>")
        for normalize in (True, False):
            monkeypatch.setattr(knn, "MOST_QUERY_BYTES", 64 << 20)
            want = [sorted(map(tuple, knn.knn_join_blocks(q, ref, k, normalize).collect())) for k in (3, 1000)]
            monkeypatch.setattr(knn, "MOST_QUERY_BYTES", 600)
            assert [sorted(map(tuple, knn.knn_join_blocks(q, ref, k, normalize).collect())) for k in (3, 1000)] == want
    plan = knn.knn_join_blocks(q, ref, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Cartesian" not in plan
    assert knn.knn_join_blocks(q, ref.where("position < 0"), 3).count() == 0


def test_large_samples_equal_small_ones(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2000).alias("key"), "id")
    want = [sorted(r.key for r in sampling.uniform_sample(df, n, "key").collect()) for n in (0, 1, 700, 2999, 3000, 4000)]
    monkeypatch.setattr(sampling, "MOST_SORTED", 0)
    got = [sorted(r.key for r in sampling.uniform_sample(df, n, "key").collect()) for n in (0, 1, 700, 2999, 3000, 4000)]
    assert got == want and [len(x) for x in got] == [0, 1, 700, 2999, 3000, 3000]


def test_recall(spark):
    found = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("b", 9, 1), ("b", 7, 3)], "query_id string, position bigint, rank int")
    cases = spark.createDataFrame([("a", 6), ("b", 7), ("c", 1), ("d", None)], "query_id string, true_position bigint")
    got = {r.k: r.recall for r in knn.recall_at_k(knn.hit_rank(found, cases), [1, 2, 3]).collect()}
    assert got == pytest.approx({1: 0, 2: 1 / 3, 3: 2 / 3})


def test_metrics_and_bins(spark):
    rows = [(True, True, 0.95), (True, False, 0.2), (False, True, 1.0), (False, False, 0.0), (False, False, 0.05)]
    df = spark.createDataFrame(rows, "expected_match boolean, predicted boolean, probability double")
    r = ev.confusion_matrix(df).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (1, 1, 1, 2) and r.f1 == pytest.approx(0.5) and r.false_match_rate == pytest.approx(1 / 3)
    empty = ev.confusion_matrix(df.where("false")).first()
    assert empty.accuracy == empty.f1 == empty.precision == 0
    bins = ev.calibration_bins(df).orderBy("bin").collect()
    assert [b.n for b in bins] == [2, 0, 1, 0, 0, 0, 0, 0, 0, 2] and bins[9].match_rate == pytest.approx(0.5) and bins[1].mean_probability == 0
    grid = ev.threshold_grid(df, [0.1, 0.99])
    assert {g.tau: g.tp + g.fp for g in grid.collect()} == {0.1: 3, 0.99: 1}
    assert ev.best_point(grid, "tau_order").first().tau == 0.1
    p = ev.latency_percentiles(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double"), "v").first()
    assert (p.p50, p.p95, p["mean"]) == pytest.approx((2.5, 3.85, 2.5))


def test_em_on_a_known_table():
    cs = [C.jaro_winkler_at(f, (0.9,)) for f in ("a", "b")]
    from dataclasses import replace

    u = {2: 0.01, 1: 0.04, 0: 0.95}
    cs = [replace(c, levels=tuple(x if x.is_null else replace(x, u=u[v]) for x, v in zip(c.levels, c.values, strict=True))) for c in cs]
    m, lam = {2: 0.8, 1: 0.15, 0: 0.05}, 0.2
    table = [(i, j, 1e6 * (lam * m[i] * m[j] + (1 - lam) * u[i] * u[j])) for i in u for j in u] + [(-1, -1, 1000.0)]
    got, share, history = training.em_session(table, cs, [], 0.05, 200, 1e-7)
    assert [got["a", k] for k in (2, 1, 0)] == pytest.approx([0.8, 0.15, 0.05], abs=0.01) and share == pytest.approx(0.2, abs=0.01)
    assert history[-1] < 1e-7
    fixed, _, _ = training.em_session(table, cs, ["a"], 0.05)
    assert all(name == "b" for name, _ in fixed)


def labelled(spark, people):
    pairs = people.crossJoin(people.select([F.col(c).alias(f"{c}_2") for c in people.columns]))
    sided = pairs.select(*[F.col(c).alias(f"{c}_l") for c in FIELDS], *[F.col(f"{c}_2").alias(f"{c}_r") for c in FIELDS], F.expr("int(position div 2 = position_2 div 2)").alias("is_match"))
    return sided


def test_calibration(spark, people):
    pairs = labelled(spark, people)
    fitted = training.calibrate(pairs, LinkModel.untrained())
    first = fitted.comparisons[0]
    n1, n0 = pairs.where("is_match = 1").count(), pairs.where("is_match = 0").count()
    assert fitted.trained and first.levels[1].m == pytest.approx((n1 + 0.5) / (n1 + 0.5 * 6)) and first.levels[1].u == pytest.approx(0.5 / (n0 + 0.5 * 6))
    with pytest.raises(ValueError):
        training.calibrate(pairs.where("is_match = 1"), LinkModel.untrained())


def test_training_skips_empty_rules(spark, people):
    with pytest.warns(UserWarning, match="no pairs"):
        fitted = training.train(people, LinkModel.untrained(), rules=(("first_name",), ("address",)), max_pairs=100)
    assert fitted.trained and 0 < fitted.prior < 1
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(RuntimeError):
            training.train(people, LinkModel.untrained(), rules=(("address",),), max_pairs=100)


def test_prior_counts_each_pair_once(people):
    r = training.prior_table(people, training.TRAINING_RULES, 0.5).first()
    assert (r.n_pairs, r.n_total) == (2, 10) and r.prior == pytest.approx(2 / 0.5 / 10)


@pytest.mark.parametrize("rule", [("first_name",), ("date_of_birth", "last_name")])
def test_patterns_of_a_rule_are_counted_without_rows_of_pairs(spark, monkeypatch, rule):
    people = fixture.person(spark, "/root/testdata/sf0.01").where("position < 500").cache()
    people = people.unionByName(people.where("position < 90").withColumn("position", F.col("position") + 1000)).cache()
    cs, rules = C.default_comparisons(), [("first_name",), ("email",), ("last_name", "date_of_birth")]
    want = sorted(map(tuple, training.pattern_counts(blocking.rule_pairs(people, [rule]), cs).collect()))
    n = blocking.rule_pairs(people, rules).count()

    def refuse(*_):
        raise AssertionError("rows of pairs")

    monkeypatch.setattr(training, "rule_pairs", refuse)
    assert sorted(map(tuple, training.rule_patterns(people, rule, cs).collect())) == want and want
    assert sorted(map(tuple, blocks.pattern_counts(people, rule, cs, 50).collect())) == want  # keys in tiles
    assert training.prior_table(people, rules).first().n_pairs == n
    assert not blocks.in_blocks_too(C.Comparison("first_name", ("first_name",), (C.Level("same", "first_name_l = first_name_r"), C.Level("else", "ELSE"))))


def test_u_counts_all_pairs(spark, people, monkeypatch):
    monkeypatch.setattr(training, "TILE", 2)
    cs = C.default_comparisons()
    more = people.unionByName(people.withColumn("position", F.col("position") + 5)).unionByName(spark.createDataFrame([(10, "Z" * 80, "", "1990-01-30", "x" * 70, "@x.y"), (11, "Zé", "Lake", "no date", "", "é@x.y")], people.schema))
    sides = [more.select(*[F.col(c).alias(f"{c}_{s}") for c in more.columns]) for s in "lr"]
    pairs = sides[0].join(sides[1], F.col("position_l") < F.col("position_r"))
    plain = lambda df: {(r.comparison, r.level): round(r.u, 9) for r in df.collect()}
    assert plain(training.u_all_pairs(more, cs)) == plain(training.u_frequencies(C.compare(pairs, cs), cs))
    assert training.u_all_pairs(more.where("false"), cs).count() == 0


def test_u_of_all_pairs_has_the_exact_levels(spark):
    """The person table is periodic: rows at fixed steps never share a first name or a birth date."""
    from kinsieve.plans.catalogue import QUERIES

    got = {(r.comparison, r.level): r.u for r in QUERIES["estimate_u_all_pairs"](spark, "/root/testdata/sf0.01").collect()}
    assert 0.019 < got["first_name", 4] < 0.026 and got["date_of_birth", 5] > 0


def test_jaro_winkler_of_each_with_each():
    import pandas as pd

    from kinsieve.functions import strings as S

    rng = np.random.default_rng(0)
    words = ["", "a", "é日", "x" * 64, "ab" * 40] + ["".join(rng.choice(list("abcd"), rng.integers(1, 66))) for _ in range(60)]
    want = S.jaro_winkler_values(pd.Series([a for a in words for _ in words]), pd.Series(words * len(words))).to_numpy(float)
    assert (S.jaro_winkler_cross(words, words).ravel() == want).all()


def test_similarity_lies_between_the_bounds_of_templates():
    from kinsieve.functions import strings as S

    rng = np.random.default_rng(1)
    part = lambda letters, most: "".join(rng.choice(list(letters), rng.integers(0, most)))
    words = ["", "12", "a" * 70, "7" * 12] + [part("ab12", 14) for _ in range(80)] + [part("abc", 9) + part("0123", 5) + part("abc", 9) for _ in range(160)]
    templates = [w.translate(S.TEMPLATE) for w in words]
    got, spans = S.jaro_winkler_cross(words, words), S.jaro_winkler_bounds(templates, templates)
    assert (spans.least <= got).all() and (got <= spans.most).all()
    i, j = np.nonzero(spans.by_digits)
    pairs, places = S.DigitPairs(spans, templates, templates, i, j), np.zeros((len(words), 11), np.uint8)
    for p, digit in enumerate(S.digits_of(words)):
        places[np.arange(len(words)), digit] |= np.uint8(1 << p)
    places[:, 10] = 0
    x, y = pairs.matches(np.arange(len(i)), S.digits_of(words)[:, i], lambda digit: places[j, digit])
    assert len(i) > 1000 and (pairs.similarity[np.arange(len(i)), x, y] == got[i, j]).all()


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("numbers", [40, 2])
def test_outcomes_of_templates_equal_those_of_pairs(monkeypatch, same, numbers):
    """With many values of a template, and with few."""
    from collections import Counter

    from kinsieve.functions import strings as S
    from kinsieve.operators import outcomes

    monkeypatch.setattr(outcomes, "MOST_PAIRS", 500)
    monkeypatch.setattr(outcomes, "STEP_PAIRS", 90)
    rng, cuts = np.random.default_rng(2), [[0.7, 0.88], [0.88]]
    values = [f"{name}{k * 23}{end}" for name in ("ann.lee", "bob.le1x", "", "annlee") for k in range(numbers) for end in ("@x.com", "@mail.x.com", "", "@" + "z" * 62)]
    values = rng.permutation(sorted(set(values))).tolist()
    user = lambda v: v.split("@")[0] or None
    n = rng.integers(1, 4, len(values))
    half = len(values) // 2
    sides = [(values[:half], n[:half]), (values[:half], n[:half]) if same else (values[half:], n[half:])]
    jw = [[S.jaro_winkler_cross([f(v) or "" for v in sides[0][0]], [f(v) or "" for v in sides[1][0]]) for f in (str, user)]][0]

    def kind(i, j):
        x, y = sides[0][0][i], sides[1][0][j]
        pairs = [(x, y, jw[0][i, j], cuts[0]), (user(x), user(y), jw[1][i, j], cuts[1])]
        return (x == y, *["null" if a is None or b is None else "equal" if a == b else sum(s >= t for t in cut) for a, b, s, cut in pairs])

    want = Counter()
    for i in range(half):
        for j in range(i if same else 0, len(sides[1][0])):
            want[kind(i, j)] += int(n[i] * (n[i] - 1) // 2 if same and i == j else sides[0][1][i] * sides[1][1][j])
    got = outcomes.count_pairs(*[x for v, m in sides for x in ([v, v, [user(a) for a in v]], m)], cuts, same)
    assert {kind(i, j): total for i, j, total in got} == {k: v for k, v in want.items() if v} and len(got) == len({kind(i, j) for i, j, _ in got})


def test_u_of_all_pairs_does_not_measure_each_pair_of_values(spark):
    """6,000 e-mail addresses of 20 templates: the similarity of a few pairs of them is measured."""
    from kinsieve.functions import strings as S
    from kinsieve.operators import outcomes, training

    people = spark.range(6000).selectExpr("id as position", "concat(element_at(array('ada','boris','clara','dmitri','elena'), cast(1 + id % 5 as int)), '.', element_at(array('holm','quist'), cast(1 + id div 5 % 2 as int)), 100 + id div 10, '@x.com') as email")
    (c,) = [c for c in C.default_comparisons() if c.name == "email"]
    emails = [r.email for r in people.collect()]
    measured, plain = [0], S.jaro_winkler_cross

    def counting(left, right):
        out = plain(left, right)
        measured[0] += out.size
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(S, "jaro_winkler_cross", counting)
        got = outcomes.count_pairs([emails, emails, [e.split("@")[0] for e in emails]], np.ones(6000, np.int64), [emails, emails, [e.split("@")[0] for e in emails]], np.ones(6000, np.int64), [[0.88], [0.88]], True)
    assert sum(n for _, _, n in got) == 6000 * 5999 // 2 and measured[0] < 6000 * 100
    assert sum(r.u for r in training.u_all_pairs(people, [c]).collect()) == pytest.approx(1)
