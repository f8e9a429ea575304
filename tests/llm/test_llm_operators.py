"""Edge cases of the corpus operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecinity.llm import decontaminate, edit_fingerprint, html_extract, jaccard_join, language, language_model, line_dedup, packing, toxicity, warc
from vecinity.llm.common import ALNUM, SPACED, text_bytes, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 997}x{k}" for k in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows, equal ids."""
    rows = [(1, "Alpha beta gamma delta epsilon zeta", "en", "a", 5), (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", None, 4), (None, "null id text here now", "en", "b", 3), (5, LONG, "en", "b", 1), (6, "Ünï cödé 💡 text\u0000with nul", "de", "b", 1), (2, "another text of id two", "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@given(st.lists(st.text(alphabet="abAZ09 \n\t.é\x00\x0b", max_size=30), max_size=8))
@settings(max_examples=100, deadline=None)
def test_words_are_those_of_the_patterns(texts):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for table, pattern in ((SPACED, "[^\x20\x09-\x0d]+"), (ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        hashes, first, last, at = words(data, offsets, table)
        got = [[data[first[k] : last[k]].tobytes().decode().translate(low) for k in range(at[i], at[i + 1])] for i in range(len(texts))]
        want = [re.findall(pattern, t.translate(low)) for t in texts]
        assert got == want
        flat = [w for ws in want for w in ws]
        assert len(set(flat)) == len(set(hashes.tolist())) and len(flat) == len(hashes)


def test_line_dedup_cases(spark, odd, none):
    assert line_dedup.drop_boilerplate(none, counts=True).count() == 0
    out = line_dedup.drop_boilerplate(odd.withColumn("lines", F.lit(1)).withColumn("pages", F.lit(2)))
    assert out.columns == [*odd.columns, "lines", "pages"]
    assert sorted(map(repr, out.select(odd.columns).collect())) == sorted(map(repr, odd.collect()))
    rows = [(k, f"Menu here\nown line {k}\n  Menu here ", "h") for k in range(12)] + [(20, "Menu here", "small"), (21, "Menu here\nx", None), (22, "Menu here\ny", None), (23, "Menu here\nz", None)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), ratio=0.2).collect()}
    assert got == {**{k: f"own line {k}" for k in range(12)}, 20: "Menu here", 21: "x", 22: "y", 23: "z"}


def test_line_dedup_keeps_columns_of_any_name(spark):
    """Helper names that are there already; lists too large for a broadcast, dealt by salt."""
    names = ["host_key", "salt", "lines", "ALL_LINES", "kept_lines", "_lines", "__host", "__salt", "n_dropped", "pages"]
    rows = [(k, f"Menu here\nown line {k}", "h", *[f"{n}{k}" for n in names]) for k in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    want = sorted((r[0], f"own line {r[0]}", *r[2:]) for r in rows)
    for options in ({}, {"broadcast_bytes": 0, "pages": 2}):
        got = line_dedup.drop_boilerplate(docs, ratio=0.2, **options)
        assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == want


def test_decontaminate_cases(spark, odd, none):
    bench = spark.createDataFrame([(7, "alpha BETA gamma"), (8, "one two three four five six seven eight nine ten eleven"), (9, None), (None, "!!"), (10, "Alpha, beta; gamma.")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.hits(odd, bench, keep=["doc_id"]).collect()}
    assert got[1, 6]["n_hit"] == 3 and got[1, 6]["items"] == ["10", "7"] and got[1, 6]["contaminated"] and not got[2, 0]["contaminated"]
    assert decontaminate.hits(none, bench).count() == 0
    assert decontaminate.hits(odd, bench.where("false"), keep=["doc_id"]).where("contaminated").count() == 0
    text = "x One two, three four five six seven eight nine ten eleven y. Alpha beta; gamma z"
    docs = spark.createDataFrame([(1, text, 3)], "doc_id long, text string, n_hit int")
    for most in (100, 2):
        row = decontaminate.hits(docs, bench, clean=True, most=most).first()
        assert (row["text"], row["n_words"], row["n_hit"], row["items"]) == ("x  y.  z", 17, 14, ["10", "7", "8"])
        assert decontaminate.hits(odd, bench, keep=["doc_id"], most=most).count() == odd.count() and decontaminate.hits(none, bench, most=most).count() == 0


@pytest.mark.parametrize("most", [decontaminate.MAX_BYTES, 400_000])
def test_decontaminate_keeps_columns_of_any_name_and_many_windows(spark, most):
    """Some 60,000 windows, in one block or several; names that helpers would take."""
    names = ["__text", "whole_text", "ROW", "places", "of", "__row"]
    bench = spark.createDataFrame([(k, " ".join(f"b{k}w{j % 400}x{j // 400}" for j in range(2000))) for k in range(30)], "item_id long, text string")
    passage = " ".join(f"B7w{j % 400}x{j // 400}" for j in range(395, 409))
    docs = spark.createDataFrame([(k, f"own {k} words {passage if k % 3 == 0 else ''} end", *[f"{n}{k}" for n in names]) for k in range(9)], ["doc_id", "text", *names])
    assert (len(decontaminate.blocks(bench, "item_id", "text", 10, most)) > 3) == (most == 400_000)
    got = decontaminate.hits(docs, bench, most=most, clean=True)
    assert got.columns == [*docs.columns, "n_words", "n_hit", "items", "contaminated"]
    for r in got.collect():
        k = r["doc_id"]
        assert tuple(r)[2:8] == tuple(f"{n}{k}" for n in names)
        assert (r["n_hit"], r["items"], r["text"]) == ((14, ["7"], f"own {k} words  end") if k % 3 == 0 else (0, [], f"own {k} words  end"))


def test_language_cases(spark, odd, none):
    model = language.fit(odd, "text", "lang", "doc_id")
    assert model[0] == ["de", "en"]
    got = language.predict(odd, model).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["text"] in (None, "", " \n\t ")} == {"und"}
    assert language.predict(none, model).count() == 0
    nothing = language.fit(none, "text", "lang", "doc_id")
    assert {(r["lang_pred"], r["score"]) for r in language.predict(odd, nothing).collect()} == {("und", 0.0)}
    assert language.predict(odd.withColumn("score", F.lit(1)).withColumn("whole_text", F.lit(1)), model).columns == [*odd.columns, "whole_text", "lang_pred", "score"]


@given(st.lists(st.text(alphabet="aBÉé 1İßЖ\u0301中", max_size=12), max_size=5))
@settings(max_examples=100, deadline=None)
def test_language_features_are_code_point_grams(texts):
    import unicodedata

    want = set()
    for k, t in enumerate(texts):
        low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower())
        low = (" " if low[:1] == " " else "") + " ".join(low.split()) + (" " if low[-1:] == " " and low.strip() else "")
        want |= {(k, low[i : i + n]) for n in language.ORDERS for i in range(len(low) - n + 1) if n > 1 or low[i] != " "}
    bucket, row = language.buckets(texts)
    assert len({(b, r) for b, r in zip(bucket.tolist(), row.tolist())}) == len(want)


def plain_language_model(rows):
    """Naive Bayes with a dictionary of counts per language and bucket, priors left out."""
    counts = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(language.buckets([text])[0].tolist())
    total = {x: sum(c.values()) for x, c in counts.items()}
    logs = lambda t, x: sum(np.log((counts[x][b] + language.ALPHA) / (total[x] + language.ALPHA * language.DIMENSIONS)) for b in language.buckets([t])[0].tolist())
    return lambda t: {x: logs(t, x) / max(1, len(language.buckets([t])[0])) for x in sorted(counts)}


def test_language_equals_plain_naive_bayes(spark):
    rng = random.Random(8)
    kinds = {"xx": "abcde é", "yy": "cdefg ж", "zz": "afghi ß"}
    rows = [(k, "".join(rng.choice(kinds[x]) for _ in range(60)), x) for k, x in enumerate(sorted(kinds) * 12)]
    ask = [(100 + k, "".join(rng.choice(kinds[x]) for _ in range(n))) for k, (x, n) in enumerate((x, n) for x in kinds for n in (3, 9, 40))] + [(200, "Привет мир"), (201, "qwjk vtpl")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame, "text", "lang", "doc_id")
    plain = plain_language_model([(t, x) for _, t, x in rows])
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(ask, "doc_id long, text string"), model).collect()}
    for k, t in ask:
        means = plain(t)
        shares = np.exp(model[2] * (np.array([*means.values(), model[3]]) - max(means.values())))
        assert got[k]["lang_pred"] == max(means, key=lambda x: means[x]) and got[k]["score"] == pytest.approx(1 / shares.sum(), abs=1e-4)


def test_first_stage_rejects_what_is_no_known_language(spark, none):
    import pandas as pd

    from vecinity.llm import stages

    sf = "/root/testdata/sf0.001"
    odd = {-1: "Утренний поезд ушёл из долины поздно", -2: "早上的火车很晚才离开山谷", -3: "1234 5678 !!!", -4: "xqzv kjwqx pzvtk bqxjw zzkqv wxqjk vqzxp", -5: ""}
    own = spark.read.parquet(f"{sf}/documents.parquet")
    added = spark.createDataFrame([(k, t, None, "h", 1) for k, t in odd.items()], own.schema)
    kept = {r["doc_id"] for r in stages.language_id(spark, own.unionAll(added), sf).select("doc_id").collect()}
    texts = pd.read_parquet(f"{sf}/documents.parquet")
    assert not kept & set(odd) and set(texts.doc_id) <= kept


def test_language_model_cases(spark, odd, none):
    got = language_model.score(odd, "doc_id <> 3").collect()
    assert len(got) == odd.count()
    empty = [r for r in got if r["n_tokens"] == 1]
    assert len(empty) == 3 and all(r["score"] < 0 for r in got)
    same = [r for r in got if r["doc_id"] == 1]
    assert same[0]["score"] == pytest.approx(same[1]["score"])
    assert language_model.score(none, "true").count() == 0
    untrained = language_model.score(odd, "false").collect()
    assert {r["train_tokens"] for r in untrained} == {0} and all(r["n_known"] == 0 for r in untrained)


def test_model_probabilities_add_to_one(spark):
    """Over all words, the end and the unknown word's share, after each of several contexts."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcde") for _ in range(rng.randrange(8)))) for k in range(40)]
    contexts = ["", "a", "b c", "e e d", "a b c d"]
    asked = [(100 + 10 * k + j, f"{h} {w}") for k, h in enumerate(contexts) for j, w in enumerate(["a", "b", "c", "d", "e", "zz", ""])]
    frame = spark.createDataFrame(rows + asked, "doc_id long, text string")
    tail = spark.createDataFrame([(1000 + n, f"{asked[n][1]} zz zz") for n in range(len(asked))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score(frame.unionAll(tail), "doc_id < 100").collect()}
    # `h w zz zz` without what follows w: zz after w, zz after zz and the end after zz are all read at the root, by a known failure weight.
    train = [[*t.split(), "$"] for _, t in rows]
    c = Counter(w for t in train for w in t)
    two, three = Counter(p for t in train for p in zip(["^", *t], t)), Counter(p for t in train for p in zip(["^", *t], t, t[1:]))
    n, v, (k1, k2) = sum(c.values()), len(c), language_model.PRIOR
    c["^"] = len(train)

    def prob(g, h, w):
        p = (two[h, w] + k1 * (c[w] + 1) / (n + v + 1)) / (c[h] + k1)
        return (three[g, h, w] + k2 * p) / (two[g, h] + k2) if g else p

    for k, h in enumerate(contexts):
        seen = [None, "^", *h.split()]
        total = 0.0
        for j, w in enumerate(["a", "b", "c", "d", "e", "zz"]):
            path = [*seen[1:], w, "$"]
            whole = sum(np.log10(prob(x, y, z)) for x, y, z in zip([None, *path], path, path[1:]))
            assert got[100 + 10 * k + j] == pytest.approx(whole)
            total += prob(seen[-2], seen[-1], w)
        assert total + prob(seen[-2], seen[-1], "$") == pytest.approx(1.0)


@given(st.sets(st.integers(0, (1 << 44) - 1), max_size=300), st.integers(1, 9))
@settings(max_examples=50, deadline=None)
def test_requests_keep_all_keys(keys, parts):
    keys, bounds = np.array(sorted(keys), np.uint64), language_model.edges(3, parts)
    cuts = np.searchsorted(keys, bounds)
    back = [language_model.unpack_keys(language_model.pack_keys(keys[cuts[p] : cuts[p + 1]], 3, bounds[p]), 3, bounds[p]) for p in range(parts)]
    assert np.concatenate(back).tolist() == keys.tolist()


def test_totals_beyond_32_bits():
    """Two blocks with counts of billions each; their sum, the totals of the corpus and the answers hold 64 bits."""
    text = pa.array(["big word word"])
    row = list(next(language_model.requests(text, np.array([True]), 0, 1, 3)))
    sizes = [int.from_bytes(x[:4], "little") for x in row[2:5]]
    counts = language_model.unpack_counts(row[5], sum(sizes))
    row[5] = language_model.pack_counts(counts * 3_000_000_000)
    answers = list(language_model.totals([tuple(row), (0, 1, *row[2:])], 1, 3))
    assert [a[0] for a in answers] == [0, 1] and answers[0][3:] == (4 * 6_000_000_000, 3)
    assert (language_model.unpack_counts(answers[1][2], sum(sizes)) == counts * 6_000_000_000).all()


def test_blocks_of_any_size_give_the_same_scores(spark, odd):
    want = sorted((repr(r["doc_id"]), round(r["score"], 9), r["n_known"]) for r in language_model.score(odd, "doc_id <> 3").collect())
    assert sorted((repr(r["doc_id"]), round(r["score"], 9), r["n_known"]) for r in language_model.score(odd, "doc_id <> 3", block_bytes=40).collect()) == want


def test_toxicity_cases(spark, odd, none):
    rng = random.Random(2)
    neutral = ["calm", "river", "stone", "table", "green", "paper"]
    rows, labels = [], []
    for k in range(300):
        bad = k % 3 == 0
        extra = ["nasty"] if bad else []
        group = [rng.choice(["women", "muslims"])] if bad and k % 2 == 0 or k % 10 == 1 else []
        w = [rng.choice(neutral) for _ in range(8)] + extra + group
        rng.shuffle(w)
        rows.append((k, " ".join(w) + "."))
        labels.append((k, int(bad)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, told)
    ask = spark.createDataFrame([(1, "women and muslims by the green river"), (2, "nasty stone"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(ask, model).collect()}
    assert got[1]["predicted"] == 0 and got[2]["predicted"] == 1 and got[3]["score"] == got[4]["score"]
    assert len(toxicity.score(odd, model).collect()) == odd.count() and toxicity.score(none, model).count() == 0
    lone = toxicity.fit(docs, told.where("toxic = 0"))
    assert {round(r["score"], 6) for r in toxicity.score(ask, lone).collect()} == {round(0.5 / 201, 6)}


def biased_rows():
    """Groups are named in toxic sentences far more often than in neutral ones."""
    rng = random.Random(12)
    plain = "river stone table green paper calm bridge lamp harbour bread winter train".split()
    texts, labels = [], []
    for k in range(900):
        bad = k % 3 == 0
        words = [rng.choice(plain) for _ in range(7)]
        if bad:
            words += [rng.choice(["vile", "rotten", "stupid"])] * (rng.random() < 0.8)
        if rng.random() < (0.7 if bad else 0.02):
            words.append(rng.choice(["women", "muslims", "immigrants", "gay"]))
        rng.shuffle(words)
        texts.append(" ".join(words) + ".")
        labels.append(int(bad))
    return texts, np.array(labels)


def test_penalty_lowers_false_positives_on_neutral_mentions():
    """The promise of the method: neutral sentences about groups, with terms that stand in toxic ones, are no longer called toxic, and toxic ones still are."""
    texts, labels = biased_rows()
    rows, pairs = [toxicity.of_text(t) for t in texts], [p for t in texts for p in toxicity.swaps(t)]
    neutral = pa.array([f"the {g} walked over the {w}" for g in ("women", "muslims", "immigrants", "gay") for w in ("bridge", "river", "harbour", "table", "stone")])
    toxic = pa.array([f"the {b} {w} of winter" for b in ("vile", "rotten", "stupid") for w in ("bridge", "river")])
    without, penalised = toxicity.learn(rows, labels, []), toxicity.learn(rows, labels, pairs)
    wrong = [(m.score(*text_bytes(neutral)) >= 0.5).mean() for m in (without, penalised)]
    assert wrong[0] > 0.9 and wrong[1] < 0.05
    assert (penalised.score(*text_bytes(toxic)) >= 0.5).all()


def test_learning_equals_plain_gradient_descent():
    """The same loss, written out row by row over a dense matrix, led to its minimum by plain steps."""
    texts, labels = biased_rows()
    texts, labels = texts[:240], labels[:240]
    rows, pairs = [toxicity.of_text(t) for t in texts], [p for t in texts for p in toxicity.swaps(t)]
    model = toxicity.learn(rows, labels, pairs, rounds=3000)
    picked = np.flatnonzero(model.slot < len(model.weights) - 1)
    place = {int(f): k for k, f in enumerate(picked)}

    def vector(found):
        out = np.zeros(len(picked))
        out[[place[int(f)] for f in found if int(f) in place]] = 1
        return out

    x, d = np.array([vector(r) for r in rows]), np.array([vector(b) - vector(a) for a, b in pairs])
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    weight = np.where(labels == 1, max(1.0, (n0 / n1) ** 0.25), 1.0)
    weight = weight / weight.sum()

    def loss(w, b):
        z = x @ w + b
        return float((weight * (np.logaddexp(0, z) - labels * z)).sum() + toxicity.RIDGE / 2 * w @ w + toxicity.PENALTY / 2 * ((d @ w) ** 2).mean())

    w, b = np.zeros(len(picked)), 0.0
    for _ in range(20_000):
        error = (1 / (1 + np.exp(-(x @ w + b))) - labels) * weight
        w = w - 0.3 * (x.T @ error + toxicity.RIDGE * w + toxicity.PENALTY * d.T @ (d @ w) / len(d))
        b -= 0.3 * error.sum()
    assert loss(model.weights[model.slot[picked]], model.bias) <= loss(w, b) + 1e-3


def test_counterfactuals_lower_identity_weights():
    rows = [toxicity.of_text(t) for t in ["vile women"] * 30 + ["vile stone"] * 10 + ["calm river"] * 40]
    y = np.array([1] * 40 + [0] * 40)
    pairs = [p for t in ["vile women"] * 30 for p in toxicity.swaps(t)]
    one, two = toxicity.learn(rows, y, []), toxicity.learn(rows, y, pairs)
    ask = text_bytes(pa.array(["women", "calm women"]))
    assert (two.score(*ask) <= one.score(*ask)).all() and two.score(*ask)[0] < one.score(*ask)[0]


def test_fingerprint_cases(spark, odd, none):
    assert edit_fingerprint.compare_with_next(none).count() == 0
    assert edit_fingerprint.compare_with_next(odd).count() == odd.count()
    lone = edit_fingerprint.compare_with_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    import hashlib

    assert lone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and lone["near_next"] == 1.0
    assert edit_fingerprint.likeness("0:", "0:") == 1.0 and edit_fingerprint.likeness("0:", "0:ab") == 0.0


def test_fingerprints_see_edits():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij klmno pqrst") for _ in range(5000))
    other = "".join(rng.choice("abcdefghij klmno pqrst") for _ in range(5000))
    moved = "zz" + text[:2000] + text[2003:]
    a, b, c = edit_fingerprint.fingerprints([text, moved, other])
    assert edit_fingerprint.likeness(a, b) > 0.7 > 0.2 > edit_fingerprint.likeness(a, c)
    assert edit_fingerprint.fingerprints([other, text])[1] == a


def test_fingerprint_classes(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij klmno pqrst") for _ in range(1500)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)] + [(10 + k, t[:-40] + "q" * 40) for k, t in enumerate(base[:3])] + [(20, base[0]), (30, None), (31, "")]
    got = {r["doc_id"]: r["class_id"] for r in edit_fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{k: k for k in range(6)}, 10: 0, 11: 1, 12: 2, 20: 0, 30: 30, 31: 30}


def test_fingerprint_classes_of_a_shared_opening(spark, monkeypatch):
    """Two near copies share bands in an opening alone, whose buckets have unlike smallest and largest ids; blocks of any size give the same."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij klmno pqrst") for _ in range(n))
    opening, rest = word(700), word(500)
    others = [opening + word(500) for _ in range(8)]
    copies = [opening + "".join(rng.choice("uvwxyz") if rng.random() < rate else c for c in rest) for rate in (0.06, 0.08, 0.1, 0.12) for _ in range(100)]
    keys = [set(edit_fingerprint.bands(f)) for f in edit_fingerprint.fingerprints([opening + rest, *others, *copies])]
    hot = set.intersection(*keys[:9])
    whole = edit_fingerprint.fingerprints([opening + rest, *copies], whole=True)
    near = [c for c, k, w in zip(copies, keys[9:], whole[1:]) if k & keys[0] <= hot and edit_fingerprint.likeness(whole[0], w) > 0.66]
    rows = [(k, t) for k, t in enumerate(others[:4])] + [(10, opening + rest), (11, near[0])] + [(20 + k, t) for k, t in enumerate(others[4:])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 4):
        monkeypatch.setattr(edit_fingerprint, "BLOCK", block, raising=False)
        assert {r["doc_id"]: r["class_id"] for r in edit_fingerprint.near_duplicates(frame, 0.65).collect()} == {k: 10 if k == 11 else k for k, _ in rows}


def test_swaps_take_all_sentences_and_all_terms():
    sentences = [f"{toxicity.IDENTITIES[k % 38]} of town {k} met" for k in range(600)]
    assert len(toxicity.swaps(". ".join(sentences))) == 1200
    seen = {x.tobytes() for s in sentences for _, x in toxicity.swaps(s)[1:]}
    terms = [set(toxicity.of_text(t).tolist()) for t in toxicity.IDENTITIES]
    assert len(seen) > 500 and all(any(t <= set(np.frombuffer(x, np.int64).tolist()) for x in seen) for t in terms)


def test_fingerprint_is_part_of_the_whole_walk():
    texts = ["", "a", "some words " * 40, "longer text, other words " * 300]
    assert [edit_fingerprint.sampled(w, len(t)) for w, t in zip(edit_fingerprint.fingerprints(texts, whole=True), texts)] == edit_fingerprint.fingerprints(texts)


def html(spark, *pages):
    frame = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract_pages(frame).orderBy("page_id").collect()]


def test_html_cases(spark):
    body = "The river rose over night and by morning the road was under water for miles"
    page = f"<html><body><nav><a href='/'>Home</a></nav><div id='main'><h1>Flood &amp; rain</h1><p>{body}<br>again</p><div class='ad'>Buy now cheap things here today</div><p>{body}&nbsp;&#233;</p></div><section class='comments'><p>I never saw such a flood in my life I say</p></section><footer>Imprint and rights</footer></body>"
    got = html(spark, page, None, "", "plain words only, no tags at all", "<p>unclosed <b>bold <i>text runs on for a while here", "<script>var a = '<p>no</p>'</script>", "<!-- open comment")
    assert got[0] == f"Flood & rain\n{body} again\n{body} é"
    assert got[1:3] == ["", ""] and got[3] == "plain words only, no tags at all" and got[4] == "unclosed bold text runs on for a while here" and got[5:] == ["", ""]
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, html string, text string")).count() == 0


B = "The river rose over night and by morning the road was under water for miles around the old town near the harbour."
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Story number {k} from the region</a></li>" for k in range(5)) + "</ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><section><p>{B} {B}</p></section></article>", [f"{B} {B}"]),
        (f"<div class='topnavigation'><ul><li><a>Home page of the site</a></li><li><a>All the news</a></li></ul></div><article><p>{B}</p><p>{B}</p></article>", [B, B]),
        (f"<article><p>{B}</p><p>{B}</p></article><div class='more-stories'><h3>More</h3>{LINKS}</div>", [B, B]),
        (f"<div><p>{B}</p><p>{B}</p></div><div class='rail'><p>Read our guide to the best shoes</p></div>", [B, B]),
        (f"<article><script src='a'/>var leaked=1;</script><p>{B}</p></article>", [B]),
        (f'<article><p title="abc>{B}</p><p>{B}</p></article>', [B, B]),
        (f"<body><p>{B}</p><p>Yes.</p><p>{B}</p></body>", [B, "Yes.", B]),
        (f"<div id='c'><p>{B}</p><p>{B}</p></div><div class='comments'><div><p>{B}</p></div></div><div id='footer'>Copyright all rights reserved by us</div>", [B, B]),
        (f"<table><tr><td><a href=x>Home</a><br><a href=y>About</a></td><td><h1>Flood</h1>{B}<br><br>{B}</td></tr></table>", ["Flood", f"{B} {B}"]),
        (f"<main><h1>Flood in town</h1><p>{B}</p><form><p>Subscribe to our letter now</p></form><p>{B}</p></main>", ["Flood in town", B, B]),
        (f"<div class='x1a'><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><div class='y2'><h1>Flood in the town</h1><div class='z9'><p>{B}</p><p>Short one.</p><p>{B}</p></div></div><div class='q'>&copy; 2020 Someone</div>", ["Flood in the town", B, "Short one.", B]),
    ],
)
def test_html_of_several_layouts(page, want):
    assert html_extract.extract(page) == "\n".join(want)


def test_html_on_layouts_not_learned():
    """Words of main text found, and words found that are main text, over labelled pages of other seeds."""
    from vecinity.llm import html_layouts

    right = found = wanted = 0
    for seed in range(5000, 5060):
        page = html_layouts.Page(seed).html()
        want = Counter(w for b in html_extract.blocks(page) if b.main for w in b.text.split())
        got = Counter(html_extract.extract(page).split())
        right, found, wanted = right + (want & got).total(), found + got.total(), wanted + want.total()
    assert right / found > 0.95 and right / wanted > 0.95


@pytest.mark.parametrize("piece", ['<a " ', "<p 'x\"><b ", "<div>", "</section><div>", "<select>", "<ul><div><li>", "<!--", "<script", "&amp", '<x y="', "<svg>", "</"])
def test_html_takes_time_in_proportion(piece):
    import time

    def seconds(n):
        began = time.perf_counter()
        html_extract.extract((piece * (n // len(piece) + 1))[:n])
        return time.perf_counter() - began

    html_extract.learned()
    assert seconds(1_000_000) < 5 and seconds(400_000) < 20 * max(seconds(100_000), 0.02)


def test_html_weights_from_other_labels():
    good, bad = "<div class='x' data-main><p>good words here</p></div>", "<div class='y'><p>bad words here</p></div>"
    weights = html_extract.fit([good + bad, bad + good] * 3)
    assert html_extract.extract("<div class='y'><p>aa bb cc</p></div><div class='x'><p>dd ee</p></div>", weights) == "dd ee"


@given(st.lists(st.tuples(st.text(max_size=20), st.booleans()), max_size=6))
@settings(max_examples=30, deadline=None)
def test_warc_records_come_back(rows):
    import io

    raw = [warc.record(k, f"http://h/{k}", t.encode(), "D" * 32, "revisit" if r else "response", 99) for k, (t, r) in enumerate(rows)]
    whole = warc.member(b"".join(raw))
    assert list(warc.records(io.BytesIO(whole))) == raw
    assert list(warc.records(io.BytesIO(b"".join(map(warc.member, raw))))) == raw
    for (t, r), x in zip(rows, raw):
        fields, block = warc.parse(x)
        assert block.partition(b"\r\n\r\n")[2] == (b"" if r else t.encode()) and (fields["WARC-Type"] == "revisit") == r


def test_warc_cases(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "a\r\nb", ""), (5, "u", "ünï"), (None, "u", "same"), (2, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"], r["intact"]) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == sorted([(1, 4, "revisit", 2, True), (2, 4, "response", None, True), (2, 4, "response", None, True), (3, 0, "revisit", 4, True), (4, 0, "response", None, True), (5, 5, "response", None, True), (-1, 4, "revisit", 2, True)], key=repr)
    assert warc.round_trip(pages, least=5).where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_revisits_are_held_against_their_response(spark):
    rows = [(1, 4, "A", "revisit", 3, True), (2, 4, "B", "revisit", 3, True), (3, 4, "A", "response", None, True), (4, 5, "C", "response", None, False), (5, 5, "C", "revisit", 4, True), (6, 1, "D", "revisit", 9, True)]
    frame = spark.createDataFrame(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")
    assert {r["page_id"]: r["intact"] for r in warc.verified(frame).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}


def plain_components(rows):
    sets, label = {}, {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        label[i] = i
    for _ in label:
        for a in sets:
            for b in sets:
                if any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 60])
def test_jaccard_equals_brute_force(spark, block):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for f in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 90))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(200, "one two"), (201, "One  two"), (202, ""), (203, None), (204, "a b c d e"), (205, rows[0][1]), (205, rows[30][1])]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    assert got.count() == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == plain_components(rows)


def test_jaccard_cases(spark, odd, none):
    got = jaccard_join.components(odd.withColumn("n", F.lit(1)).withColumn("rep", F.lit(2))).collect()
    assert len(got) == odd.count() and {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is None} == {(None, None)}
    assert jaccard_join.components(none).count() == 0
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] in (2, 3, 4)) == [0, 0, 0, 1]


class Functions:
    """Takes the place of a table and keeps the functions that it is mapped by."""

    def __init__(self):
        self.found = []

    def mapInArrow(self, fn, schema):
        self.found.append(fn)
        return self

    def repartitionById(self, *_):
        return self


def test_shingles_are_counted_in_bounded_memory(spark):
    import tracemalloc

    taken = Functions()
    jaccard_join.counted(taken, 5, 51)
    send, receive, add = taken.found
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, x)) for x in rng.integers(1000, 10000, (8000, 900))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8001)), pa.array([*texts, texts[0]])], ["doc_id", "text"])
    tracemalloc.start()
    try:
        peak, sent = 0, []
        for out in send(iter([batch])):  # what is sent leaves the worker
            peak, sent = max(peak, tracemalloc.get_traced_memory()[1]), [*sent, out]
    finally:
        tracemalloc.stop()
    assert peak < 240e6
    back = receive(iter(sent))
    rows = {r["doc_id"]: r for b in add(back) for r in b.to_pylist()}
    assert len(rows) == 8001 and {k for k, r in rows.items() if r["shared"] * 2 > r["n_shingles"]} == {0, 8000}
    assert rows[0]["shared"] == rows[0]["n_shingles"] == 896


def test_language_id_sends_a_kept_text_once(odd, monkeypatch):
    model = language.fit(odd, "text", "lang", "doc_id")
    sent, whole = [], type(odd).mapInArrow
    monkeypatch.setattr(type(odd), "mapInArrow", lambda self, *x: sent.append(self.columns) or whole(self, *x))
    alone, kept = language.predict(odd, model, keep=["doc_id"]), language.predict(odd, model)
    assert sent == [["doc_id", "whole_text"], odd.columns]
    assert kept.columns == [*odd.columns, "lang_pred", "score"]
    plain = lambda df: sorted(map(str, df.select("doc_id", "lang_pred", "score").collect()))
    assert plain(kept) == plain(alone) and kept.select(*odd.columns).exceptAll(odd).count() == 0


def test_every_link_is_returned_on_demand(spark):
    base = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:59], f"u{k}"])) for k in range(6)]
    got = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), every=True)["links"]
    assert got.count() == 15


def test_packing_cases(spark, odd, none, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack(none, path).count() == 0
    got = packing.pack(odd, path, size=64).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 1
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 1)
    long = [r for r in got if r["doc_id"] == 5]
    assert sum(r["length"] for r in long) == long[0]["doc_tokens"] > 64


@given(st.lists(st.sampled_from(["ab", " ", "é", "\n", "\t", ".", "'", "1", "💡", "<|endoftext|>", "<|", "\u00a0"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_encoder_gives_the_library_ids(parts):
    """Against a plain encoder of the file, special tokens' strings included, both ways."""
    import public_tokenizers
    from tokenizers import Tokenizer

    global ENCODERS
    path, text = public_tokenizers.path("byte_bpe_50k.json"), "".join(parts)
    try:
        ENCODERS
    except NameError:
        ENCODERS = [(packing.Encoder(path, as_text), Tokenizer.from_file(path)) for as_text in (False, True)]
        ENCODERS[1][1].encode_special_tokens = True
        assert all(e.ranked is not None for e, _ in ENCODERS)
    for encoder, plain in ENCODERS:
        assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_encoder_asks_the_ranks_once_a_text():
    """Invented words, of which few come back, are not encoded word by word."""
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abdeilnorst", k=rng.randrange(4, 10))) for _ in range(200)) for _ in range(5)]
    asked, ranked = [], encoder.ranked

    class Asked:
        def __getattr__(self, name):
            return lambda text: asked.append(text) or getattr(ranked, name)(text)

    encoder.ranked = Asked()
    assert [encoder.encode(t).tolist() for t in texts] == [ranked.encode_ordinary(t) for t in texts]
    assert asked == texts


def test_every_kind_of_character_is_encoded_alike():
    """The two encoders' patterns know the same letters, numbers and spaces: one in 97 code points, and all below U+3100."""
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    points = [c for c in [*range(0x3100), *range(0x3100, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} {c}{c}1{c}\n{c} \n {c}  {c}x'{c}'s " for c in map(chr, points)]
    assert [encoder.encode(t).tolist() for t in texts] == [x.ids for x in encoder.whole.encode_batch(texts, add_special_tokens=False)]


def test_special_token_in_a_text():
    import public_tokenizers

    assert packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode("hello <|endoftext|> there").tolist() == [31373, 220, 50256, 612]


def test_full_pieces_leave_open_windows_alone():
    windows = packing.Windows(64, 2)
    assert windows.add("a", 50) == [] and windows.add("b", 40) == [] and windows.add("full", 64) == [["full"]] and windows.n == 2


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_windows_hold_every_piece_once(sizes, opened):
    windows = packing.Windows(64, opened)
    out = []
    for k, n in enumerate(sizes):
        out += windows.add((k, n), n)
        assert windows.n <= opened
    out += list(windows.rest())
    assert sorted(k for w in out for k, _ in w) == list(range(len(sizes))) and all(sum(n for _, n in w) <= 64 for w in out)
