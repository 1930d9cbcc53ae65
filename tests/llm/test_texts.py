"""Operators 2, 4, 6, 7 and 8."""

import copy
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_data import ROWS, documents, empty
from oracle import assert_same, connect
from strandworks.llm import common, language, quality, queries, secrets, toxicity, winnow

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    words = SPACES.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACES.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_features(spark):
    more = [(100 + k, t, "en", "s", 0) for k, t in enumerate(["a b a b a b a", "x\nx\n\n x\nx", "a b c a b c d a b", "#$ *\n<>", "a\x0bb\x0cc", "a b c"])]
    got = quality.judge_documents(documents(spark, ROWS + more)).collect()
    want = sorted((str(d), *features(t)) for d, t, *_ in ROWS + more)
    assert sorted((str(r[0]), *r[1:6]) for r in map(tuple, got)) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_oracle(spark, small):
    assert_same(queries.QUERIES["op2_quality"](spark, small), connect(small), queries.ORACLE_SQL["op2_quality"])


def test_cascade_order_and_verdict(spark):
    a, b, c = (quality.Rule(n, F.col("x") > k) for n, k in (("a", 5), ("b", 3), ("c", 8)))
    # b rejects all that c does, so c has nothing left to reject, though by itself it comes before a
    order = quality.Measured([a, b, c], [1.0, 0.1, 0.1], {0: 40, 0b001: 20, 0b010: 10, 0b110: 30}).ordered()
    assert [r.name for r in order] == ["b", "a", "c"]
    df = spark.range(10).withColumnRenamed("id", "x")
    assert [r[0] for r in df.select(quality.cascade(order)).collect()] == [None] * 4 + ["b"] * 6
    # a rule that is never asked never runs
    fails = quality.Rule("fails", F.raise_error(F.lit("asked")).cast("boolean"))
    assert df.where("x > 3").select(quality.cascade([b, fails])).count() == 6


def test_filter_keeps_columns_and_agrees(spark):
    docs = documents(spark)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    verdict = {(r["doc_id"], r["kept"]) for r in quality.judge_documents(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, k in verdict if k}
    assert quality.filter_documents(empty(spark)).count() == 0


M = (1 << 64) - 1


def picks(text):
    import xxhash

    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    turn = lambda x, r: ((x << r) | (x >> (64 - r))) & M
    units = [u for w in SPACES.findall(text) for u in ([w] if len(w) <= 16 else w)]
    if not units:
        return []
    v = [h(u) for u in units]
    grams = [h(" ".join(units))] if len(units) < 4 else [turn(v[i], 3) ^ turn(v[i + 1], 2) ^ turn(v[i + 2], 1) ^ v[i + 3] for i in range(len(v) - 3)]
    grams, out = [g >> 32 for g in grams], []
    for i in range(max(1, len(grams) - 15)):
        window = grams[i : i + 16]
        place = max(k for k, g in enumerate(window) if g == min(window)) + i
        if not out or out[-1] != (grams[place], place):
            out.append((grams[place], place))
    return out


def alike(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_winnow(rows):
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1]] + [1]))
    out = []
    for k, (d, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        e = t[: len(t) - third] + n[:third]
        said = lambda p: ",".join(f"{g:x}:{i}" for g, i in p)
        out.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), said(picks(t)), said(picks(e)), alike(picks(t), picks(e)), alike(picks(t), picks(n))))
    return sorted(out)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [r for r in ROWS if r[0] is None], []])
def test_winnowing(spark, rows):
    got = winnow.compare_edited(documents(spark, rows)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, got)) == brute_winnow(rows)


def test_shared_runs_share_a_pick():
    rng = np.random.default_rng(5)
    run = " ".join(f"shared{i}" for i in rng.integers(0, 1000, 19))
    for _ in range(50):
        a, b = (" ".join([*(f"{s}{i}" for i in rng.integers(0, 99, rng.integers(0, 30))), run, *(f"{s}{i}" for i in rng.integers(0, 99, rng.integers(0, 30)))]) for s in "ab")
        assert {g for g, _ in picks(a)} & {g for g, _ in picks(b)}


def test_texts_without_spaces_share_picks_around_an_edit(spark):
    rng = np.random.default_rng(9)
    a = "".join(chr(0x4E00 + k) for k in rng.integers(0, 3000, 2000))
    b = a[:1000] + "x" + a[1000:]
    assert alike(picks(a), picks(b)) > 0.95
    got = spark.createDataFrame([(a, b)], "a string, b string").select(winnow.likeness(winnow.picks(F.col("a")), winnow.picks(F.col("b")))).first()[0]
    assert got == alike(picks(a), picks(b))


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = common.table(spark, d, "documents")
    got = language.op6_language(spark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right > 0.97 and n > 150


def test_many_languages_keep_the_most_frequent(spark):
    rows = [(k, f"word{k % 7} more{k % 3} text", f"x{k % 40:02d}" if k % 2 else "main") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="values of lang with"):
        model = language.train(docs, most=5)
    counts = docs.where(~language.held_out(F.col("doc_id"))).groupBy("lang").count().collect()
    assert model.languages == sorted(r["lang"] for r in sorted(counts, key=lambda r: (-r["count"], r["lang"]))[:5])
    assert {r["lang_pred"] for r in language.identify(docs, model).collect()} <= set(model.languages)


def test_language_mixture():
    rng = np.random.default_rng(6)
    a, b = rng.normal(-3, 0.5, (60, 2)), rng.normal(-3, 0.5, (40, 2))
    a[:, 1] -= 9
    b[:, 0] -= 9
    share = language.select(np.vstack([a, b, a]), np.array([100, 60]))
    assert abs(share[0, 0] - 0.6) < 0.02 and share[1].tolist() == [1, 0]
    # more rounds never make a mixture less likely
    likes = [language.proportions(np.vstack([a, b]).T, np.array([100]), np.ones((2, 1), bool), r)[1][0] for r in range(1, 6)]
    assert all(y >= x - 1e-3 for x, y in zip(likes, likes[1:]))


def test_language_cases(spark):
    docs = documents(spark)
    model = language.train(docs)
    got = {str(r["doc_id"]): r for r in language.identify(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {k for k, r in got.items() if r["lang_pred"] == "und"} == {"3", "5", "11"}
    assert language.filter_documents(docs, model).columns == docs.columns
    nothing = language.train(empty(spark))
    assert nothing.languages == [] and {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.filter_documents(docs, nothing).count() == len(ROWS)
    assert language.identify(empty(spark), model).count() == 0


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    for k in range(60):
        n = int(rng.integers(1, 8))
        field = secrets.Field([rng.normal(0, 2, (s, 3)) for s in secrets.SIZES], rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
        if k % 2:
            field.tables[0][:, 0] += 6  # so that most tokens can only be outside
        entries = np.stack([rng.integers(0, s, n) for s in secrets.SIZES])
        opens = rng.random(n) < 0.25
        opens[0] = True
        e = field.emissions(entries)
        score = lambda y: sum(e[i, y[i]] + (field.first[y[i]] if opens[i] else field.transitions[y[i - 1], y[i]]) for i in range(n))
        assert abs(score(field.decode(entries, opens)) - max(map(score, itertools.product(range(3), repeat=n)))) < 1e-9


def test_base_spans():
    text = 'x PassWord = "abcdefghijkl" AKIA0123456789ABCD AKIAX 0123456789abcdef0 token=short paſſword=abcdefghijklm'
    assert [(secrets.KINDS[k], text[a:b]) for a, k, b, _ in secrets.base_spans(text)] == [("assign", 'PassWord = "abcdefghijkl'), ("access", "AKIA0123456789ABCD"), ("hex", "0123456789abcdef0")]


def test_secrets_of_documents(spark):
    docs = documents(spark)
    field = secrets.train(docs)
    got = {str(r["doc_id"]): r for r in secrets.scan(docs, field).collect()}
    none = got["None"]
    assert (none["n_assign"], none["n_access"], none["n_hex"]) == (2, 0, 1)
    for d, t, *_ in ROWS:
        spans = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in secrets.base_spans(t or ""))
        assert got[str(d)]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(got[str(d)]["spans"].split(","))
    masked = secrets.mask_documents(docs, field)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    row = masked.where("doc_id is null").first()
    assert row["text"].count(secrets.MASK) == 2 and "abcDEF" not in row["text"] and row["n_chars"] == len(row["text"])
    assert secrets.scan(empty(spark), secrets.train(empty(spark))).count() == 0


def test_likelihood_falls_and_its_gradient_is_right():
    rng = np.random.default_rng(3)
    entries = np.stack([rng.integers(0, s, (6, 4)) for s in secrets.SIZES], axis=1)
    tags = rng.integers(0, 3, (6, 4))

    def loss(field):
        total = 0.0
        for x, y in zip(entries, tags):
            e = field.emissions(x)
            score = lambda z: field.first[z[0]] + sum(e[k, z[k]] for k in range(4)) + sum(field.transitions[a, b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            total += np.log(sum(np.exp(score(z)) for z in itertools.product(range(3), repeat=4))) - score(y)
        return total / len(tags)

    # one step of the trainer moves each weight by RATE * g / sqrt(g * g + 1e-4) with g its gradient, which differences of the likelihood give as well
    epochs, secrets.EPOCHS = secrets.EPOCHS, 1
    try:
        field = secrets.fit(entries, tags)
    finally:
        secrets.EPOCHS = epochs
    zero = secrets.Field([np.zeros((s, 3)) for s in secrets.SIZES], np.zeros((3, 3)), np.zeros(3))
    assert loss(field) < loss(zero)
    places = [(zero.transitions, field.transitions, (i, j)) for i in range(3) for j in range(3)] + [(zero.first, field.first, (i,)) for i in range(3)]
    places += [(zero.tables[k], field.tables[k], (int(entries[w, k, t]), tag)) for k in range(7) for w in range(2) for t in range(4) for tag in range(3)]
    for flat, moved, at in places:
        flat[at] = 1e-5
        g = loss(zero)
        flat[at] = -1e-5
        g = (g - loss(zero)) / 2e-5
        flat[at] = 0
        assert abs(moved[at] + secrets.RATE * g / np.sqrt(g * g + 1e-4)) < 1e-4


def test_the_field_finds_secrets_that_no_pattern_matches(spark):
    texts = [r["text"] for r in common.table(spark, "/root/testdata/sf0.01", "documents").where("text is not null").orderBy("doc_id").select("text").collect()]
    field = secrets.train(spark.createDataFrame([(k, t) for k, t in enumerate(texts[::2])], "doc_id long, text string"))
    rng = np.random.default_rng(8)
    code = lambda n: "".join(rng.choice(list("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"), n))
    ways = ['the "key" is {}', "opens with '{}'", "{}", "session {} expires", "the token is {}", "credential = {}", "deploy --key {} now"]
    found = planted = added = 0
    for k, text in enumerate(texts[1::2]):
        words = text.split(" ")
        at = int(rng.integers(len(words)))
        before, after = " ".join(words[:at]), " ".join(words[at:])
        head, _, tail = ways[k % len(ways)].partition("{}")
        secret = code(int(rng.integers(14, 40)))
        whole = f"{before} {head}{secret}{tail} {after}"
        start = len(before) + 1 + len(head)
        assert not any(a < start + len(secret) and start < b for a, _, b, _ in secrets.base_spans(whole)), "a pattern knows it"
        own = [s for s in secrets.find(field, [whole])[0] if secrets.KINDS[s[1]] == "crf"]
        planted, added, found = planted + 1, added + len(own), found + ((start, 3, start + len(secret)) in own)
    assert planted > 300 and found >= 0.9 * planted and found >= 0.9 * added
    plain = secrets.find(field, texts[1::2])
    assert sum(s[1] == 3 for x in plain for s in x) <= 0.01 * len(plain)


def test_added_spans_stay_clear_of_base_spans():
    field = secrets.Field([np.zeros((s, 3)) for s in secrets.SIZES], np.zeros((3, 3)), np.array([0.0, 9.0, 0.0]))  # every line's first token is a secret
    text = "éa b\n0123456789abcdef0 c\n\U0001f600 zz y\nq 0123456789abcdef0"
    got = secrets.find(field, [text, "", "ü w"])
    assert [[(secrets.KINDS[k], t[a:b]) for a, k, b in x] for x, t in zip(got, (text, "", "ü w"))] == [[("crf", "éa"), ("hex", "0123456789abcdef0"), ("crf", "\U0001f600"), ("crf", "q"), ("hex", "0123456789abcdef0")], [], [("crf", "ü")]]


def test_samples_do_not_vanish():
    assert all(common.sample_bound(4000 / n) / 2**62 == pytest.approx(4000 / n, rel=1e-3) for n in (10**5, 10**9, 10**11, 10**13))
    assert common.sample_bound(5.0) == 1 << 62 and common.sample_bound(0.0) == 1


def plain_likelihoods(model, text):
    """Log-likelihoods of each word, byte by byte."""
    said = "".join(chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in text.lower().encode())
    data, out = [32, 32, 32, 32], []
    for word in said.split():
        like = np.zeros(len(model.languages))
        for b in [*map(ord, word), 32]:
            data.append(b)
            four = data[-4:]
            keys = [four[3], four[2] << 8 | four[3], ((four[1] << 16 | four[2] << 8 | four[3]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16, ((four[0] << 24 | four[1] << 16 | four[2] << 8 | four[3]) * 0x85EBCA6B & 0xFFFFFFFF) >> 16]
            counts = [t[k].astype(float) for t, k in zip(model.tables, keys)]
            p = language.UNSEEN + language.WEIGHTS[3] * counts[0] / model.tables[0].sum(0)
            for n in (1, 2, 3):
                p = p + language.WEIGHTS[3 - n] * np.minimum(counts[n] / np.maximum(counts[n - 1], 1), 1)
            like += np.log(p)
        out.append(like)
    return np.array(out)


def plain_choice(words):
    """The likeliest language of the best set, by mixtures worked out one text at a time."""
    n, k = words.shape
    cost = language.PENALTY * np.log(n + 1)
    best, score = np.eye(k)[words.sum(0).argmax()], words.sum(0).max()
    active = np.ones(k, bool)
    for size in range(k, 1, -1):
        share = active / active.sum()
        for _ in range(language.ROUNDS):
            weight = np.exp(words - words[:, active].max(1, keepdims=True)) * share
            share = (weight / weight.sum(1, keepdims=True)).mean(0)
        like = np.log((np.exp(words - words[:, active].max(1, keepdims=True)) * share).sum(1)).sum() + words[:, active].max(1).sum()
        if like - cost * (size - 1) > score:
            best, score = share, like - cost * (size - 1)
        active[np.where(active, share, np.inf).argmin()] = False
    return best


def test_languages_are_those_of_a_plain_version(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    model = language.train(docs)
    texts = [r["text"] for r in docs.where("text is not null").orderBy("doc_id").limit(40).collect()]
    texts += [a[:200] + " " + b[:400] for a, b in zip(texts, texts[7:20])]
    names, shares = language.predict(model, pa.array(texts))
    for text, name, share in zip(texts, names, shares):
        words = plain_likelihoods(model, text)
        if len(words):
            want = plain_choice(words)
            assert share == pytest.approx(want.max(), abs=2e-3) and (name == model.languages[want.argmax()] or np.sort(want)[-1] - np.sort(want)[-2] < 4e-3)


def test_toxicity_of_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = common.table(spark, d, "labels")
    got = toxicity.op8_toxicity(spark, d).where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in got)
    # one in twenty of the toxic rows has none of the words that mark the others
    assert hit >= 0.88 * sum(r["toxic"] for r in got) and hit >= 0.85 * sum(r["predicted"] for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    toxic, clean = (np.array([r["score"] for r in got if r["toxic"] == k]) for k in (1, 0))
    assert (toxic[:, None] > clean).mean() >= 0.9  # the area under the curve


def test_word_pairs_are_told_by_wide_filters():
    """Both words are in every text; only in toxic ones the second follows the first."""
    rng = np.random.default_rng(2)
    fill = [f"w{k}" for k in range(60)]

    def text(pair):
        words = list(rng.choice(fill, 12))
        at = sorted(rng.choice(np.arange(1, 11), 2, replace=False))
        if pair:
            words[at[0] : at[0]] = ["rotten", "fish"]
        else:
            words.insert(at[1], "rotten")
            words.insert(at[0], "fish")
        return " ".join(words)

    said = [(k % 2, text(k % 2)) for k in range(1600)]
    rows = [toxicity.word_rows([t.encode()])[0] for _, t in said]
    y = np.array([float(k) for k, _ in said])
    net = toxicity.fit(rows[:1200], y[:1200], ["a"] * 1200, np.ones(1200))
    right = lambda: np.mean((net.scores(net.tables(), [t.encode() for _, t in said[1200:]]) >= 0.7) == y[1200:])
    assert right() > 0.9
    at = 0
    for k, f in toxicity.FILTERS.items():
        if k > 1:
            net.weights[at : at + f] = 0
        at += f
    assert right() < 0.65


def test_scores_are_those_of_a_plain_network():
    rng = np.random.default_rng(4)
    words = ["good", "bad", "day", "night", "tree", "vile", "blue"]
    said = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(200)]
    rows = [toxicity.word_rows([t.encode()])[0] for t in said]
    net = toxicity.fit(rows, np.array([float("vile" in t) for t in said]), ["a", "b"] * 100, np.ones(200))
    got = net.scores(net.tables(), [t.encode() for t in said[:40]])
    for text, own, score in zip(said, rows, got):
        pad = np.zeros((max(toxicity.FILTERS), 2), int)
        x = net.embedding[np.concatenate([own, pad])].sum(1)  # a word is the sum of two rows
        pooled = []
        for k, taps in net.filters.items():
            places = range(len(own) + 1)  # windows may hang over the end
            pooled.append(np.max([np.maximum(sum(x[i + j] @ taps[j] for j in range(k)) + net.bias[k], 0) for i in places], axis=0))
        logit = np.concatenate(pooled) @ net.weights + net.offset
        spoken = net.languages[own[:, 0]].sum(0).argmax()
        want = 1 / (1 + np.exp(-(logit - net.thresholds[spoken] + np.log(0.7 / 0.3))))
        assert score == pytest.approx(want, abs=1e-4)


def test_long_and_repeated_texts_take_part_in_training(spark):
    long = " ".join(["tree"] * 9000)
    docs = spark.createDataFrame([(k, f"{long} {'vile' if k % 2 else 'good'}", "a") for k in range(40)] + [(1, "good", "a")] * 50, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    few = toxicity.train(docs, labels, train_chars=20 * len(long))
    assert few.embedding.any()
    got = toxicity.score(docs.where("doc_id > 1"), toxicity.train(docs, labels)).collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in got) >= 0.9 * len(got)


def test_toxicity_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(7, 1, 1), (2, 1, 0), (2, 0, 0), (13, 1, 0), (None, 0, 1), (12, 0, None)], "doc_id long, quality int, toxic int")
    for chosen in (labels, labels.where("toxic = 0"), labels.limit(0)):
        got = toxicity.score(docs, toxicity.train(docs, chosen)).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), labels)).count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Word shares are those of every labelled row outside the held-out third, not of a sample; parts that moved a row of the embedding move it by their mean."""
    monkeypatch.setattr(toxicity, "MET_ROWS", 1)
    said = [(k, f"w{k % 7} day{' vile' if k % 10 == 0 else ''}", "ab"[k % 2]) for k in range(9000)]
    docs = spark.createDataFrame(said, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 = 0) AS toxic")
    net = toxicity.train(docs, labels, part_rows=1500)
    used = [r for r in said if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    for k, lang in enumerate("ab"):
        own = toxicity.word_rows([t.encode() for _, t, x in used if x == lang])[0]
        assert np.allclose(net.languages[:, k], toxicity.shares_of(np.bincount(own[:, 0], minlength=toxicity.ROWS)), atol=1e-5)
    got = toxicity.score(docs, net).collect()
    assert all(r["predicted"] == (r["doc_id"] % 10 == 0) for r in got)


def test_networks_of_parts_are_averaged():
    rng = np.random.default_rng(5)
    rows = [toxicity.word_rows([f"{w} day".encode()])[0] for w in ("good", "vile", "bad", "nice")]
    start = toxicity.Trainer(toxicity.untrained(["a"], rng))
    parts = []
    for at in (0, 2):
        part = copy.deepcopy(start)
        part.learn(rows[at : at + 2], np.array([0.0, 1.0]), [np.array([0]), np.array([1])], 0.05, rng)
        parts.append(part)
    moved = copy.deepcopy(start)
    moved.move([np.sum(x, 0, dtype=float) for x in zip(*(p.sums(start) for p in parts))])
    assert np.allclose(moved.net.weights, (parts[0].net.weights + parts[1].net.weights) / 2, atol=1e-6)
    for k, part in enumerate(parts):
        alone = part.met & ~parts[1 - k].met
        assert alone.any() and np.allclose(moved.net.embedding[alone], part.net.embedding[alone], atol=1e-6)
    both = parts[0].met & parts[1].met
    assert both.any() and np.allclose(moved.net.embedding[both], (parts[0].net.embedding[both] + parts[1].net.embedding[both]) / 2, atol=1e-6)
