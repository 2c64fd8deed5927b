"""Scoring, records, mixing, packing, URLs and the pipeline."""

import datetime
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import texts
from kinsieve.llm import language, mixing, packing, quality, queries, records, textstats, toxicity, urls
from kinsieve.llm.common import py_fold, shared_dir

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def small_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (10, 1, 0), (100, 1, 1), (101, 0, 0), (None, 1, 1), (102, None, None), (103, 1, 0), (103, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_toxicity_tells_held_out_texts_apart():
    rng = np.random.default_rng(0)
    bad = ["grobnik", "vilefex"]

    def text(toxic):
        words = rng.choice(texts.WORDS, 60).tolist()
        if toxic:
            for k in range(3):
                words[rng.integers(60)] = bad[k % 2]
        return " ".join(words).encode()

    y = np.arange(400) % 4 == 0
    model = toxicity.fit([text(t) for t in y], y.astype(int))
    new = model.scores([text(t) for t in y])
    assert ((new >= 0.7) == y).mean() > 0.95
    clean = text(False).decode()
    misspelled = clean.replace(clean.split()[5], "grobnikk", 1).encode()
    assert model.scores([misspelled])[0] > model.scores([clean.encode()])[0]


def bad_texts(n):
    """Texts of which every fourth has one of two bad words three times."""
    rng, bad = np.random.default_rng(n), ["grobnik", "vilefex"]
    out = []
    for k in range(n):
        words = rng.choice(texts.WORDS, 60).tolist()
        if k % 4 == 0:
            for j in range(3):
                words[rng.integers(60)] = bad[j % 2]
        out.append(" ".join(words).encode())
    return out, (np.arange(n) % 4 == 0).astype(int)


@pytest.mark.parametrize("n", [20, 40, 200])
def test_toxicity_learns_from_few_labels(n):
    model = toxicity.fit(*bad_texts(n))
    new, y = bad_texts(241)
    got = model.scores(new) >= 0.7
    assert got[y == 1].mean() > 0.85 and not got[y == 0].any()


def test_misspellings_never_seen_are_toxic():
    model = toxicity.fit(*bad_texts(400))
    clean = texts.prose(70, 57)
    for word in ("grobnikk", "grobniks", "xgrobnik", "vilefexx", "vvilefex"):
        assert model.scores([f"{clean} {word} {word} {word}".encode()])[0] >= 0.7 > model.scores([f"{clean} omicron omicron omicron".encode()])[0]


def plain_toxicity(given, labels, p):
    """The model text by text and number by number; returns a function of a text."""
    import math

    def bag(t):
        out, words = {}, t.lower().split()
        for w in words:
            rows = toxicity.word_rows(w, p)
            for r in rows:
                out[r] = out.get(r, 0) + 1 / len(rows) / len(words)
        return out

    bags, share = [bag(t) for t in given], (sum(labels) + 0.5) / (len(labels) + 1)
    shrink = {}
    for r in range(p.buckets):
        n, n1 = sum(r in b for b in bags), sum(r in b and y for b, y in zip(bags, labels, strict=True))
        z = abs(n1 - n * share) / math.sqrt(max(n * share * (1 - share), 1))
        if z > p.chance_z:
            shrink[r] = 1 - (p.chance_z / z) ** 2
    rows = sorted(shrink)
    rng = np.random.default_rng(p.seed)
    emb = dict(zip(rows, (rng.uniform(-1, 1, (len(rows), p.dim)) / p.dim).tolist(), strict=True))
    soft, bias = rng.normal(0, 1 / p.dim, (p.dim, 2)).tolist(), [0.0, math.log(share / (1 - share))]
    mean, square, step = {}, {}, 0

    def odds(b):
        vec = [sum(p.scale * shrink[r] * w * emb[r][d] for r, w in b.items() if r in shrink) for d in range(p.dim)]
        z = [sum(vec[d] * soft[d][c] for d in range(p.dim)) + bias[c] for c in (0, 1)]
        e = [math.exp(x - max(z)) for x in z]
        return vec, [x / sum(e) for x in e]

    for epoch in range(p.epochs):
        rate, order = p.rate * (1 - epoch / p.epochs), rng.permutation(len(given)).tolist()
        for lo in range(0, len(order), p.batch):
            pick = order[lo : lo + p.batch]
            grad = {("e", r, d): p.ridge * emb[r][d] for r in rows for d in range(p.dim)} | {("s", d, c): p.ridge * soft[d][c] for d in range(p.dim) for c in (0, 1)} | {("b", c): 0.0 for c in (0, 1)}
            for k in pick:
                vec, got = odds(bags[k])
                for c in (0, 1):
                    g = (got[c] - (labels[k] == c)) / len(pick)
                    grad["b", c] += g
                    for d in range(p.dim):
                        grad["s", d, c] += g * vec[d]
                        for r, w in bags[k].items():
                            if r in shrink:
                                grad["e", r, d] += g * soft[d][c] * p.scale * shrink[r] * w
            step += 1
            for key, g in grad.items():
                mean[key] = mean.get(key, 0) + 0.1 * (g - mean.get(key, 0))
                square[key] = square.get(key, 0) + 0.001 * (g * g - square.get(key, 0))
                change = rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step) * mean[key] / (math.sqrt(square[key]) + 1e-9)
                kind, *at = key
                if kind == "e":
                    emb[at[0]][at[1]] -= change
                elif kind == "s":
                    soft[at[0]][at[1]] -= change
                else:
                    bias[at[0]] -= change
    return lambda t: odds(bag(t))[1][1]


def test_toxicity_matches_a_plain_version(spark):
    p = toxicity.ToxicityParams(dim=3, buckets=128, epochs=8, batch=8, rate=0.1, chance_z=2.0, least_steps=0)
    given, y = bad_texts(30)
    ids = [k for k in range(200) if py_fold(k, 3) != 1][:30]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in zip(ids, given, strict=True)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in zip(ids, y, strict=True)], "doc_id bigint, toxic int")
    model, plain = toxicity.fit_on(docs, labels, p), plain_toxicity(given, y.tolist(), p)
    new = [t for t, _ in zip(bad_texts(20)[0], range(8), strict=False)] + [b"", b"grobnikk is here"]
    scored = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(t.decode() for t in new)), "doc_id bigint, text string"), model)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert np.allclose([got[k] for k in range(len(new))], [plain(t) for t in new], atol=1e-9) and np.ptp(list(got.values())) > 0.01


def test_rows_of_an_id_that_repeat_count_once(spark):
    ids = [k for k in range(60) if py_fold(k, 3) != 1 and py_fold(k, 4) != 2]
    docs = spark.createDataFrame([(i, texts.prose(i, 20), "en" if i % 2 else "de") for i in ids for _ in range(3)] + [(ids[0], "aaa", "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in ids for _ in range(2)], "doc_id bigint, toxic int, quality int")
    assert toxicity.training_rows(docs, labels, toxicity.ToxicityParams(most_texts=5)).count() == 5
    assert len(toxicity.training_rows(docs, labels).collect()) == len(ids)
    one = docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min_by("lang", F.xxhash64("text")).alias("lang"))
    assert np.allclose(language.learn_from(docs).proto, language.learn_from(one).proto)
    assert (toxicity.fit_on(docs, labels).row == toxicity.fit_on(one, labels).row).all()


def plain_languages(given, langs, p, letters):
    """Profiles trigram by trigram; returns a function of a text."""
    import math

    vector = language.Encoder(letters, p).vector.tolist()

    def kind(c):
        return 0 if not c.isalpha() else 1 + (letters.index(c) if c in letters else len(letters) + ord(c) % p.shared)

    def bundle(t):
        out, word = [0] * p.dim, []
        for c in t.lower() + "\n":
            if k := kind(c):
                word.append(k)
                continue
            s = [0, *word, 0]
            for a, b, e in zip(s, s[1:], s[2:], strict=False):
                for d in range(p.dim):
                    out[d] += vector[a][(d - 2) % p.dim] * vector[b][(d - 1) % p.dim] * vector[e][d]
            word = []
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out

    total = {}
    for t, lang in zip(given, langs, strict=True):
        total[lang] = [x + y for x, y in zip(total.get(lang, [0] * p.dim), bundle(t), strict=True)]
    proto = {k: [x / math.sqrt(sum(y * y for y in v)) for x in v] for k, v in total.items()}

    def of(t):
        if not any(kind(c) for c in t.lower()):
            return "und", 0.0
        v = bundle(t)
        cos = {k: sum(x * y for x, y in zip(v, w, strict=True)) for k, w in proto.items()}
        best = min(cos, key=lambda k: (-cos[k], k))
        return best, max(0.0, cos[best])

    return of


def test_language_matches_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(language, "BLOCK_TRIGRAMS", 7)
    monkeypatch.setattr(language, "MOST_BOUND", 20)
    p = language.LanguageParams(dim=32, letters=20, shared=3)
    ids = [k for k in range(60) if py_fold(k, 4) != 2][:20]
    given = [texts.prose(k, 12) if k % 2 else "der Hund läuft über die Straße " * (k % 3) + texts.prose(k, 3).upper() for k in ids]
    langs = ["en" if k % 2 else "de" for k in ids]
    docs = spark.createDataFrame([(i, t, x) for i, t, x in zip(ids, given, langs, strict=True)], "doc_id bigint, text string, lang string")
    prof = language.learn_from(docs, p)
    assert sorted(prof.letters) == sorted(language.learn(given, langs, p).letters)
    plain = plain_languages(given, langs, p, prof.letters)
    new = [*given[:6], "", "1 2", "Äpfel, apples", "x", "日本語 тест"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(list(enumerate(new)), "doc_id bigint, text string"), prof).collect()}
    assert [got[k][0] for k in range(len(new))] == [plain(t)[0] for t in new] and np.allclose([got[k][1] for k in range(len(new))], [plain(t)[1] for t in new], atol=1e-5)


def test_bundles_of_many_short_texts_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    given = ["".join(chr(97 + c) for c in rng.integers(0, 26, 100)) for _ in range(9000)]
    enc = language.Encoder([chr(97 + k) for k in range(26)] + [chr(0x3B1 + k) for k in range(174)], language.LanguageParams())
    tracemalloc.start()
    enc.bundle(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_toxicity_on_awkward_rows(spark):
    docs = texts.clashing(texts.edge_docs(spark))
    model = toxicity.fit_on(docs, small_labels(spark))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(texts.edge_rows()) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (5, 6, 7)}
    assert len(empty) == 1
    assert toxicity.score_toxicity(texts.empty_docs(spark), model).count() == 0
    none = toxicity.fit_on(docs, small_labels(spark).where("false"))
    assert toxicity.drop_toxic(docs, none).count() == len(texts.edge_rows())
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_toxicity_learns_from_its_folds_only(spark):
    got = toxicity.training_rows(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id").collect()
    assert got and all(py_fold(r.doc_id, 3) != 1 for r in got)


def test_op2_held_out_accuracy(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "toxic = 1 and predicted = 1"), ("p", "toxic = 1"), ("fp", "toxic = 0 and predicted = 1"), ("n", "toxic = 0"))]).first()
    assert r.tp / r.p > 0.85 and r.fp / r.n < 0.01


def test_op10_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = queries.op10_language_id(spark, SF).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.a > 0.98 and r.low >= 0 and r.high <= 1


def test_language_on_awkward_rows(spark):
    docs = texts.clashing(texts.edge_docs(spark))
    prof = language.learn_from(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, prof).collect()}
    assert all(got[i] == ("und", 0.0) for i in (5, 6, 7, 14)) and set(prof.langs) == {"de", "en"}
    assert got[9][0] in prof.langs and got[13][0] in prof.langs
    none = language.learn([], [])
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(texts.empty_docs(spark), prof).count() == 0


def test_bundles_bind_and_permute_letters():
    enc = language.Encoder(["a", "b", "c"], language.LanguageParams(dim=64))
    got, has = enc.bundle(["abc", "ABC", "1"])
    v = enc.vector
    end, a, b, c = v[0], v[1], v[2], v[3]
    bound = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    assert (got[0] == bound(end, a, b) + bound(a, b, c) + bound(b, c, end)).all() and (got[0] == got[1]).all() and has.tolist() == [True, True, False]


def plain_counts(text):
    import collections
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at, covered = collections.defaultdict(list), set()
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    for places in at.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_match_plain_counts(spark):
    extra = [(500, "a b c d e\n" * 4, None, None, 0), (501, "a " * 11, None, None, 0), (502, "x\n\nx\n \n x\nx", None, None, 0), (503, "#*$%&|<> é\x0b\x0cü", None, None, 0)]
    docs = texts.clashing(spark.createDataFrame(texts.edge_rows() + extra, texts.SCHEMA))
    got = textstats.text_statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted(((r[0], *plain_counts(r[1] or "")) for r in texts.edge_rows() + extra), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_trees_are_monotone_and_tell_apart():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.2 * np.sin(20 * x[:, 0]) + 0.1 * rng.normal(size=2000)) < 0.5).astype(int)
    trees = quality.fit(x, y, monotone={0: -1})
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5), np.full(200, 0.5)], axis=1)
    assert (np.diff(trees.scores(grid)) <= 1e-12).all()
    assert ((trees.scores(x) >= 0.5) == y).mean() > 0.9


def test_quality_on_awkward_rows(spark):
    got = quality.quality_rules(texts.clashing(texts.edge_docs(spark)), small_labels(spark))
    by_id = {r.doc_id: r for r in got.collect()}
    assert all(by_id[i].base_failed and not by_id[i].kept for i in (5, 6, 7, 8)) and got.count() == len(texts.edge_rows())
    assert quality.quality_rules(texts.empty_docs(spark), small_labels(spark)).count() == 0
    unlabelled = quality.quality_rules(texts.edge_docs(spark), small_labels(spark).where("false"))
    assert unlabelled.where("kept = base_failed").count() == 0


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids + [1]


def test_records_are_the_whole_texts_ids(spark):
    folder = f"{shared_dir(spark)}/records-test"
    docs = texts.clashing(texts.edge_docs(spark))
    shards = records.write_token_records(docs, folder, TOKENIZER)
    got = sorted((tuple(r) for r in records.read_token_records(shards, folder).collect()), key=lambda r: r[1])
    rows, start, want = sorted(texts.edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0)), 0, []
    for r in rows:
        ids = np.array(whole_ids(r[1]), "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    first = shards.orderBy("shard").first()
    some = list(records.read_at(folder, first["name"], [2, 0]))
    assert [len(ids) for _, ids in some] == [want[2][2], want[0][2]]
    assert records.write_token_records(texts.empty_docs(spark), folder + "-none", TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["a <|endoftext|>b", "<|startoftext|>. <|ENDOFTEXT|>", "it's we'll DON'T.", "Σας ΣΑΣ. Ǆ İ", "é x ́y", " x y", "a\x1cb\x85c", "' s . , ., ,. 1. 2,", "日本語. ｱ ﬁne.", ""])
def test_words_one_by_one_have_the_ids_of_the_text(text):
    ids, at = records.WordEncoder(TOKENIZER).encode([text.encode(), b"more"], 1)
    assert ids[: at[1]].tolist() == whole_ids(text)


def test_random_texts_of_any_script_have_the_librarys_ids():
    rng = np.random.default_rng(12)
    nukta, hebrew = [chr(c) for c in range(0x958, 0x960)], [chr(c) for c in range(0xFB1D, 0xFB4F)]
    pool = nukta + hebrew + list("abzAZé ß İ ſ ŉ ́ ̣ ़ ּ 한 ᄀ ᅡ ᆨ ﬁ Ω Å ‍ 　 ٣ ½ \u0345 \u212a".replace(" ", "")) + ["'s", "'LL", "<|endoftext|>", "<", "̸"] + [chr(c) for c in (0x85, 0xA0, 0x1C, 0x2028, 0x378, 0x1C89, 0x10D4A, 0x1E4D0)]
    ends = [".", ",", " ", " ", "\n", "., ", ",. ", "\t"]
    some = [0x300, 0x900, 0x590, 0x1100, 0x3040, 0x4E00, 0x1F600, 0x600, 0xE00, 0x1E00, 0x100, 0x400]

    def text():
        out = []
        for _ in range(rng.integers(1, 14)):
            out += [pool[rng.integers(len(pool))] if rng.random() < 0.6 else chr(some[rng.integers(len(some))] + int(rng.integers(200))) for _ in range(rng.integers(1, 5))]
            out.append(ends[rng.integers(len(ends))])
        return "".join(out)

    sample = [text() for _ in range(10_000)] + [c + m for c in nukta + hebrew + [chr(c) for c in range(0x250)] for m in (".", ",", "")]
    plain = records.WordEncoder(TOKENIZER)
    from tokenizers import Tokenizer

    want = [[*e.ids, 1] for e in Tokenizer.from_file(TOKENIZER).encode_batch_fast(sample, add_special_tokens=False)]
    ids, at = plain.encode([t.encode() for t in sample], 1)
    wrong = [t for t, w, x, y in zip(sample, want, at[:-1].tolist(), at[1:].tolist(), strict=True) if ids[x:y].tolist() != w]
    assert plain.by_word and {"é", "ß", "z"} <= plain.plain and not wrong


def test_op7_has_the_librarys_ids_of_every_document(spark):
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, []
    for r, e in zip(rows, Tokenizer.from_file(TOKENIZER).encode_batch_fast([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op7_token_records(spark, SF).collect()) == want


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    config = json.load(open(TOKENIZER))
    assert records.word_by_word(config)
    for change in ({"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}, {"pre_tokenizer": {"type": "Metaspace", "replacement": "_", "prepend_scheme": "always", "split": False}}):
        assert not records.word_by_word(config | change)
    path = f"{tmp_path}/other.json"
    json.dump(config | {"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}, open(path, "w"))
    enc, given = records.WordEncoder(path), ["Two  words. here", "", "ñandú"]
    ids, at = enc.encode([t.encode() for t in given], 1)
    assert not enc.by_word and [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in given]


def test_word_cache_bounds_change_nothing():
    enc = records.WordEncoder(TOKENIZER, most_words=5, most_units=7)
    for k in range(6):
        text = texts.prose(k % 3, 40)
        ids, _ = enc.encode([text.encode()], 1)
        assert ids.tolist() == whole_ids(text)


def test_damaged_records_are_told():
    data = records.frame(b"some data")
    assert list(records.read_frames(io.BytesIO(data * 2))) == [b"some data"] * 2
    for k in (0, 9, 14, len(data) - 1):
        with pytest.raises(ValueError):
            list(records.read_frames(io.BytesIO(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])))


def lags(slots, weights):
    """The most that a source is away from its target weight at any time, of (source, slot) of all its blocks; weights as they are given."""
    from fractions import Fraction

    share = {s: Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for s, w in weights.items()}
    done, worst = dict.fromkeys(weights, 0), 0
    for t, s in enumerate(slots, 1):
        done[s] += 1
        worst = max(worst, *(abs(done[x] - share[x] * t) for x in weights))
    return worst


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 100, "b": 1}, {f"s{k}": k + 1 for k in range(12)}, {"a": 0.1, "b": 0.25, "c": 1.3}, queries.WEIGHTS], ids=str)
def test_cycles_keep_every_source_within_a_block_of_its_weight(weights):
    share = mixing.shares(weights)
    one = [s for s, _ in mixing.cycle(share)]
    assert len(one) == sum(share.values()) and lags(one * 1000 if len(one) < 40 else one * 20, weights) < 1
    count = dict.fromkeys(share, 0)
    for s, j in mixing.cycle(share):
        assert j == count[s]
        count[s] += 1


def test_the_mix_is_within_a_block_of_the_weights_in_every_phase():
    weights = {"a": 4.0, "b": 3.0, "c": 0.5, "d": 2.0}
    runs, left = mixing.phases({"a": 3000, "b": 40, "c": 900, "d": 1500}, weights), dict(weights)
    while runs:
        now = [r for r in runs if set(r["sources"]) == set(left)]
        slots = {}
        for r in now:
            for s, (first, took, share, table) in r["sources"].items():
                for j in range(took):
                    slots[r["slot"] + j // share * r["size"] + table[j % share]] = s
        seen = sorted(slots)
        full = seen[: next((k for k, t in enumerate(seen) if t != seen[0] + k), len(seen))]  # a source that ends leaves its slots of the last cycle empty
        assert len(full) >= 30 and lags([slots[t] for t in full], left) < 1
        runs = [r for r in runs if r not in now]
        if runs:
            left = {s: weights[s] for s in runs[0]["sources"]}


def test_weights_with_too_long_a_cycle_are_refused():
    with pytest.raises(ValueError):
        mixing.shares({"a": 0.123456789, "b": 1})


def plain_mix(rows, weights, block):
    """Slots by running the schedule one slot at a time over blocks counted text by text."""
    import hashlib
    from fractions import Fraction

    weights = {s: Fraction(str(w)) for s, w in weights.items()}
    weights = {"other": sum(weights.values()) / len(weights)} | weights
    by = {}
    for i, source, size in rows:
        by.setdefault(source if source in weights else "other", []).append((hashlib.md5(str(i if i is not None else "").encode()).hexdigest(), size, i))
    blocks, place = {}, {}
    for s, items in by.items():
        at = 0
        for _, size, i in sorted(items, key=lambda x: x[:2]):
            place.setdefault((s, i), []).append((at // block, at))
            at += size
        blocks[s] = max(1, -(-at // block)) + (at > 0 and at % block == 0)
    left, first, slot, out = dict(blocks), dict.fromkeys(blocks, 0), 0, {}
    while any(left.values()):
        active = {s: weights[s] for s in left if left[s]}
        total = sum(active.values())
        size = next(n for n in range(1, 10_000) if all((w * n / total).denominator == 1 for w in active.values()))
        share = {s: int(w * size / total) for s, w in active.items()}
        whole_cycle = True
        while whole_cycle and all(left[s] for s in active):  # a source that ends with a cycle leaves the next
            whole_cycle = all(left[s] >= share[s] for s in active)
            done = dict.fromkeys(active, 0)
            for t in range(size):
                ready = [(-(-(done[s] + 1) * size // n), s) for s, n in share.items() if done[s] < n and done[s] * size // n <= t]
                s = min(ready)[1]
                if done[s] < left[s]:
                    out[s, first[s] + done[s]] = slot + t
                done[s] += 1
            for s in active:
                took = min(left[s], share[s])
                first[s] += took
                left[s] -= took
            slot += size
    return sorted(((i, s, b, out[s, b], at) for (s, i), places in place.items() for b, at in places), key=repr)


@pytest.mark.parametrize("rows_a_range", [1 << 16, 2])
def test_mix_matches_a_slot_by_slot_schedule(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_a_range)
    monkeypatch.setattr(mixing, "RANGE_DIGITS", 1 if rows_a_range == 2 else 3)
    weights = {"a": 3.0, "b": 1.0, "c": 2.0}
    more = [(None, "x" * k, "en", "a", k) for k in range(40)]
    docs = texts.clashing(texts.edge_docs(spark).unionByName(spark.createDataFrame(more, texts.SCHEMA)))
    got = mixing.mix(docs, weights, 200)
    want = plain_mix([(r[0], r[3], len(r[1] or "")) for r in texts.edge_rows() + more], weights, 200)
    assert sorted((tuple(r) for r in got.select("doc_id", "mix_source", "mix_block", "mix_slot", "mix_start").collect()), key=repr) == want
    assert mixing.mix(texts.empty_docs(spark), weights, 200).count() == 0


def test_op6_matches_a_slot_by_slot_schedule(spark):
    rows = [(r.doc_id, r.source, len(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op6_mixing(spark, SF).select("doc_id", "mix_source", "mix_block", "mix_slot", "mix_start")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_mix(rows, queries.WEIGHTS, queries.BLOCK_CHARS)


def plain_best_fit(pieces, capacity, per_source):
    bins = []
    for length, source, cluster in pieces:
        fits = [b for b in bins if capacity - b["used"] >= length and (not cluster or cluster not in b["clusters"]) and (not source or b["sources"].count(source) < per_source)]
        best = min(fits, key=lambda b: (capacity - b["used"], b["no"]), default=None)
        if best is None:
            best = {"no": len(bins), "used": 0, "clusters": [], "sources": [], "at": []}
            bins.append(best)
        yield best["no"], best["used"]
        best["used"] += length
        best["clusters"].append(cluster)
        best["sources"].append(source)


def test_best_fit_matches_a_search_of_all_bins():
    rng = np.random.default_rng(0)
    for per_source in (1, 2, 3):
        pieces = sorted(((int(rng.integers(1, 100)), 1 << int(rng.integers(4)) if rng.random() < 0.8 else 0, 1 << int(rng.integers(9)) if rng.random() < 0.5 else 0) for _ in range(400)), reverse=True)
        assert packing.best_fit(pieces, 120, per_source) == list(plain_best_fit(pieces, 120, per_source))


def check_pack(got, rows, capacity, per_source):
    import collections

    bins, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        bins[r.bin_id].append(r)
        sizes[r.doc_id] += r.n_tokens
    for inside in bins.values():
        spans = sorted((r.bin_offset, r.bin_offset + r.n_tokens) for r in inside)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= capacity
        assert max(collections.Counter(r.source for r in inside if r.source is not None).values(), default=0) <= per_source
    want = collections.Counter()
    for i, text in rows:
        want[i] += len((text or "").split()) + 1
    assert sizes == want


def test_pack_keeps_every_token_and_conflict(spark):
    docs = texts.clashing(texts.edge_docs(spark))
    rows = [(r[0], r[1]) for r in texts.edge_rows()]
    check_pack(packing.pack(docs, 64).collect(), rows, 64, 2)
    again = docs.unionByName(docs.where("doc_id = 10")).unionByName(docs.where("doc_id = 10"))  # long rows that repeat
    check_pack(packing.pack(again, 64).collect(), rows + [r for r in rows if r[0] == 10] * 2, 64, 2)
    assert packing.pack(texts.empty_docs(spark), 64).count() == 0


def test_op8_matches_plain_best_fit(spark):
    got = queries.op8_best_fit_packing(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    check_pack(got, [(r.doc_id, r.text) for r in rows], queries.WINDOW_TOKENS, 2)
    import collections
    import hashlib

    digest = {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() for r in rows}
    rest = [r for r in got if r.bin_id.startswith("s-0-")]
    rest.sort(key=lambda r: (-r.n_tokens, r.doc_id, digest[r.doc_id]))
    n = collections.Counter(digest[r.doc_id] for r in rest)
    pieces = [(r.n_tokens, r.source, digest[r.doc_id] if n[digest[r.doc_id]] > 1 else None) for r in rest]
    assert [(f"s-0-{b}", at) for b, at in plain_best_fit(pieces, queries.WINDOW_TOKENS, 2)] == [(r.bin_id, r.bin_offset) for r in rest]


def test_bins_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 10)
    docs = texts.edge_docs(spark)
    again = docs.unionByName(docs.where("doc_id in (10, 101, 102)"))
    seen = [sorted((repr(tuple(r)) for r in packing.pack(x, 64).collect())) for x in (again.coalesce(1), again.repartition(3), again.orderBy(F.desc("doc_id")))]
    assert seen[0] == seen[1] == seen[2] and any("'s-1-" in r for r in seen[0])


def test_list_entries_of_any_case_and_of_one_label_match(spark):
    d = datetime.date(2024, 1, 1)
    events = [("domain", "zip", "a", "add", d), ("domain", "Example.COM.", "b", "add", d), ("host", "WWW.Org", "c", "add", d), ("path", "B.Net/En", "d", "add", d), ("domain", "...", "e", "add", d), ("host", "", "f", "add", d)]
    hosts = ["http://x.y.zip/", "http://zip/", "http://a.example.com", "http://www.org/q", "http://org/", "http://b.net/En/x", "http://b.net/en", "http://notexample.com/", "http://one.two/"]
    table = spark.createDataFrame([(k, u, d) for k, u in enumerate(hosts)], "id int, url string, fetched date")
    got = {r.id: r.category for r in urls.filter_captures(table, spark.createDataFrame(events, "kind string, pattern string, category string, action string, dated date")).collect()}
    assert [got[k] for k in range(len(hosts))] == ["a", "a", "b", "c", None, "d", None, None, None]


def test_urls_are_read_whatever_their_form(spark):
    forms = {"HTTP://User@WWW.Example.COM:80/en/x?y#z": ("www.example.com", "en"), "https://a.b.": ("a.b", ""), "ftp://x.y/z": (None, "z"), "": (None, ""), "http:///path": (None, "path"), "http://h?x=/y": ("h", "")}
    rows = spark.createDataFrame([(u,) for u in forms], "url string").select("url", urls.host_of(F.col("url")).alias("h"), urls.first_segment(F.col("url")).alias("s")).collect()
    assert {r.url: (r.h, r.s) for r in rows} == forms


def test_lists_hold_at_the_fetch_time(spark):
    d = datetime.date
    events = [
        ("host", "a.example.com", "spam", "add", d(2024, 1, 10)), ("host", "a.example.com", "spam", "add", d(2024, 1, 12)), ("host", "a.example.com", "spam", "remove", d(2024, 1, 20)),
        ("host", "a.example.com", "spam", "add", d(2024, 2, 1)), ("domain", "example.com", "adult", "add", d(2024, 1, 15)), ("domain", "example.com", "adult", "remove", d(2024, 1, 15)),
        ("domain", "example.com", "adult", "add", d(2024, 3, 1)), ("path", "b.org/en", "malware", "add", d(2024, 1, 1)), ("path", None, "malware", "add", d(2024, 1, 1)), ("odd", "b.org", "x", "add", d(2024, 1, 1)),
    ]
    captures = [
        (1, "http://a.example.com/x", d(2024, 1, 9)), (2, "http://a.example.com/x", d(2024, 1, 10)), (3, "http://a.example.com/x", d(2024, 1, 20)), (4, "http://a.example.com/x", d(2024, 2, 1)),
        (5, "http://a.example.com/x", d(2024, 3, 2)), (6, "http://c.example.com", d(2024, 3, 2)), (7, "http://b.org/en/y", d(2024, 5, 1)), (8, "http://b.org/fr/y", d(2024, 5, 1)), (9, None, d(2024, 5, 1)),
        (10, "http://b.org/en", None), (11, "http://notexample.com", d(2024, 3, 2)), (7, "http://b.org/en/y", d(2024, 5, 1)),
    ]
    table = spark.createDataFrame(captures, "id int, url string, fetched date").withColumn("category", F.lit("own")).withColumn("segment", F.lit("own"))
    lists = spark.createDataFrame(events, "kind string, pattern string, category string, action string, dated date")
    got = sorted((r.id, r.n_active, r.category) for r in urls.filter_captures(table, lists).collect() if r.blocked)
    assert got == [(2, 1, "spam"), (4, 1, "spam"), (5, 2, "spam"), (6, 1, "adult"), (7, 1, "malware"), (7, 1, "malware")]
    assert urls.filter_captures(table, lists).count() == len(captures)
    assert urls.filter_captures(table, lists.where("false")).where("blocked or n_active > 0").count() == 0
    assert urls.filter_captures(table.where("false"), lists).count() == 0


def test_registered_queries_have_the_contracts_columns(spark):
    want = {
        "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op4_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
        "op5_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
        "op7_token_records": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op9_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns[: len(columns)] == columns
    assert sorted(queries.QUERIES) == sorted([*want, "op1_url_filters", "op6_mixing", "op8_best_fit_packing"])


def test_pipeline_stages_take_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    small_labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (texts.clashing(texts.edge_docs(spark)), texts.empty_docs(spark)):
        now, columns = docs, docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(path := f"{tmp_path}/{docs.columns[-1]}-{k}-{name}")
            now = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == columns, name
        assert now.count() > 0 or docs.isEmpty()


def test_suffix_stage_cuts_shared_passages_and_keeps_documents(spark):
    import corpus_pipeline

    passage = texts.prose(9, 55)
    rows = [(1, "Début. " + passage, None, None, 5), (2, texts.prose(11, 40) + " — " + passage + " ñ", "en", "s", 7), (3, None, None, None, None), (4, texts.prose(12, 30), "en", None, 9)]
    docs = spark.createDataFrame(rows, texts.SCHEMA)
    got = {r.doc_id: r for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    assert len(got) == 4 and got[3].text is None and got[3].n_chars is None and got[1].text == rows[0][1] and got[4].n_chars == 9
    assert passage not in got[2].text and got[2].n_chars == len(got[2].text) and got[2].text.endswith(" ñ")


def test_stages_may_be_chained_and_read_in_part(spark, tmp_path):
    import corpus_pipeline

    passage = texts.prose(9, 55)
    docs = spark.createDataFrame([(k, texts.prose(k, 40) + " " + passage, "en", "a", None) for k in range(1, 4)] + [(4, texts.prose(1, 40) + " " + passage, "en", "b", None)], texts.SCHEMA)
    cut = corpus_pipeline.suffix_array_dedup(spark, docs, "").select("doc_id", "text")
    assert cut.count() == 4
    few = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    chained = corpus_pipeline.suffix_array_dedup(spark, few, "").select("text")
    assert sorted(passage in r.text for r in chained.collect()) == [False, False, True] and few.count() == 3
    made = list(corpus_pipeline._WRITTEN)
    corpus_pipeline.mixing(spark, docs, "")
    assert made and not any(spark._jvm.java.io.File(p.removeprefix("file://")).exists() for p in made)


def test_pipeline_matches_a_plain_version(spark):
    """Every stage on the rows that the one before it kept: toxic texts by the model's own score, groups and passages by brute force, mix and bins by plain schedules."""
    import corpus_pipeline
    from test_pairs import jaccard_groups

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_on(docs, labels)
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r, score in zip(rows, model.scores([(t or "").encode() for _, t, _ in rows]), strict=True) if score < model.params.threshold]
    group = jaccard_groups([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if group[r[0]] == r[0]]
    least, kept = {}, []
    raw = [(i, t.encode(), s) for i, t, s in rows]
    n = corpus_pipeline.PASSAGE_BYTES
    for i, t, _ in raw:
        for p in range(len(t) - n + 1):
            least[t[p : p + n]] = min(least.get(t[p : p + n], i), i)
    for i, t, s in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if least[t[p : p + n]] < i:
                gone[p : p + n] = True
        at, out = 0, []
        for c in t.decode():  # a character goes if all its bytes do
            size = len(c.encode())
            out += [] if gone[at : at + size].all() else [c]
            at += size
        kept.append((i, "".join(out), s))
    sizes = {i: len(whole_ids(t)) for i, t, _ in kept}
    mixed = plain_mix([(i, s, len(t)) for i, t, s in kept], queries.WEIGHTS, queries.BLOCK_CHARS)
    order = [i for i, *_ in sorted(mixed, key=lambda r: (r[3], r[4], r[0]))]
    source, text = {i: s for i, _, s in kept}, {i: t for i, t, _ in kept}
    want = []
    for lo in range(0, len(order), packing.ORDERED_ROWS):
        run = order[lo : lo + packing.ORDERED_ROWS]
        pieces = sorted(((-(sizes[i] % queries.WINDOW_TOKENS), lo + k, i) for k, i in enumerate(run) if sizes[i] % queries.WINDOW_TOKENS))
        want += [(i, -size, at) for (size, _, i), (_, at) in zip(pieces, plain_best_fit([(-size, source[i], text[i] if list(text.values()).count(text[i]) > 1 else None) for size, _, i in pieces], queries.WINDOW_TOKENS, 2), strict=True)]
        want += [(i, queries.WINDOW_TOKENS, 0) for i in run for _ in range(sizes[i] // queries.WINDOW_TOKENS)]
    got = [(r.doc_id, r.n_tokens, r.bin_offset) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_runs(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).where(f"n > {queries.WINDOW_TOKENS}").count() == 0


def test_packing_keeps_the_mix(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(packing, "ORDERED_ROWS", 64, raising=False)
    rows = [(k, texts.prose(k, 30 + k % 50), "en", "src0" if k % 3 == 0 else f"src{1 + k % 4}", 0) for k in range(900)]  # src0 has a third of all rows
    docs = spark.createDataFrame(rows, texts.SCHEMA).repartition(7)
    seen = {}
    for hot in (1.0, 20.0):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {"src0": hot, "src1": 3.0, "src2": 3.0, "src3": 3.0, "src4": 3.0, "other": 1.0})
        monkeypatch.setattr(corpus_pipeline, "BLOCK_CHARS", 500)
        got = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
        assert sorted(r.doc_id for r in got) == list(range(900))
        front = sorted(got, key=lambda r: r.bin_id)[:300]
        seen[hot] = sum(r.n_tokens for r in front if r.source == "src0") / sum(r.n_tokens for r in front)
    assert seen[1.0] < 0.15 and seen[20.0] > 0.55  # targets 1/13 and 20/32; the raw share is a third


def test_packing_keeps_the_order_that_the_mixing_wrote(spark, tmp_path, monkeypatch):
    """Windows follow the rows as they were written, in any order, so what the mixing does is not done again."""
    import corpus_pipeline

    monkeypatch.setattr(packing, "ORDERED_ROWS", 20, raising=False)
    rows = [(k, texts.prose(k, 30), "en", f"src{k % 3}", 0) for k in range(200)]
    for name, by in (("up", F.col("doc_id")), ("down", -F.col("doc_id"))):
        spark.createDataFrame(rows, texts.SCHEMA).repartitionByRange(5, by).sortWithinPartitions(by).write.parquet(f"{tmp_path}/{name}")
        got = corpus_pipeline.best_fit_packing(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect()
        runs = [r.doc_id // 20 for r in sorted(got, key=lambda r: r.bin_id)]
        assert len(got) == 200 and runs == sorted(runs, reverse=name == "down")


def test_pipeline_packs_token_ids(spark):
    import collections

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, bins = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.best_fit_packing(spark, texts.edge_docs(spark), "").collect():
        got[r.doc_id] += r.n_tokens
        bins[r.bin_id] += r.n_tokens
    want = collections.Counter()
    for r in texts.edge_rows():
        want[r[0]] += len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert got == want and max(bins.values()) == queries.WINDOW_TOKENS
