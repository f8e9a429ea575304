"""The corpus queries against SQL, brute force, round trips or held-out labels on the small tables."""

import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from html import unescape
from math import log10
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same

from vecinity.llm import edit_fingerprint, language_model, line_dedup, queries
from vecinity.llm.common import U, mix

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
Q = queries.queries()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, SF, Q[name], queries.oracle_sql()[name])


def test_op1_finds_the_article(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html
    got = Q["op1_html_extraction"](spark, SF).toPandas()
    assert len(got) == len(pages)
    for r in got.itertuples():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_op2_held_out_accuracy(spark, docs):
    got = Q["op2_language_id"](spark, SF).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(got) == len(docs) and (got.held_out == [crc(i, 3) == 1 for i in got.doc_id]).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_op4_against_plain_edits(spark, docs):
    import hashlib

    got = Q["op4_fingerprints"](spark, SF).toPandas().set_index("doc_id")
    texts = docs.text.fillna("").tolist()
    assert len(got) == len(texts)
    for k, i in enumerate(docs.doc_id):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        m = len(t) // 4
        assert got.n_chars[i] == len(t) and got.edited_sha256[i] == hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest()
    by = got.assign(t=dict(zip(docs.doc_id, texts))).groupby("t").fingerprint.nunique()
    assert by.max() == 1 and (got.near_edited > got.near_next).mean() > 0.95


def plain_walk(text, level):
    """The digits that a walk leaves at the steps of a level and above, one character after the other."""
    out, at, step = [], 0, 0
    while at < len(text):
        if step % 4096 == 0:
            bits, depth = edit_fingerprint.bits(step, 4096), edit_fingerprint.levels(step, 4096)
        if depth[step % 4096] >= level:
            h = mix(np.array([ord(text[at])], U) * U(0x9E3779B97F4A7C15) + mix(np.array([step + 77], U)))
            out.append("0123456789abcdef"[int(h[0]) & 15])
        at += int(bits[step % 4096][(ord(text[at]) * 0x9E3779B1 & 0xFFFFFFFF) >> 26])
        step += 1
    return "".join(out)


def plain_likeness(a, b, whole):
    """Share of equal digits at the steps that both fingerprints know, from walks of all steps."""
    if a == b:
        return 1.0
    level = max(int(f.partition(":")[0]) for f in (a, b))
    x, y = (plain_walk(t, level) for t in whole)
    if not x or not y:
        return 0.0
    equal = sum(p == q for p, q in zip(x, y)) / max(len(x), len(y))
    return max(0.0, min(1.0, (equal - 0.125) / 0.875))


def test_op4_equals_plain_walks(spark, docs):
    got = Q["op4_fingerprints"](spark, SF).toPandas().set_index("doc_id")
    texts = docs.text.fillna("").tolist()
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k]))[:60]:
        t, n = texts[k], texts[(k + 1) % len(texts)]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        r = got.loc[docs.doc_id[k]]
        for x, f in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            level = max(0, int(np.floor(np.log2(max(2 * len(x), 1) / 100))))
            assert f == f"{level}:{plain_walk(x, level)}"
        assert r.near_edited == pytest.approx(plain_likeness(r.fingerprint, r.edited_fingerprint, (t, e)))
        if len(n) < 4000:
            assert r.near_next == pytest.approx(plain_likeness(r.fingerprint, got.fingerprint[docs.doc_id[(k + 1) % len(texts)]], (t, n)))


def classes_of_all_pairs(texts, least=0.8):
    """Class of each text by the likeness of whole walks over all pairs; and the pairs of different texts."""
    import itertools

    walks = [np.frombuffer(w[2:].encode(), np.uint8) for w in edit_fingerprint.fingerprints(texts, whole=True)]
    pairs = []
    for i, j in itertools.combinations(range(len(texts)), 2):
        m, n = sorted((len(walks[i]), len(walks[j])))
        if texts[i] != texts[j] and m >= least * n * 0.9 and (np.count_nonzero(walks[i][:m] == walks[j][:m]) / max(n, 1) - 0.125) / 0.875 >= least:
            pairs.append((i, j))
    return pairs


def test_near_duplicates_find_what_all_pairs_give(spark, docs):
    """Recall on documents, and on texts of shared segments with one near copy each."""
    rng = np.random.default_rng(6)
    segments = [["".join(rng.choice(list("abcdefghij klmno pqrst"), 200)) for _ in range(4)] for _ in range(8)]
    base = ["".join(s[rng.integers(4)] for s in segments) for _ in range(150)]
    near = []
    for t in base:
        c = list(t)
        for k in rng.integers(0, len(c), 10):
            c[k] = "z"
        near.append("".join(c))
    for texts in (docs.text.fillna("").tolist(), [*base, *near]):
        pairs = classes_of_all_pairs(texts)
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        of = {r["doc_id"]: r["class_id"] for r in edit_fingerprint.near_duplicates(frame).collect()}
        assert len(of) == len(texts) and pairs
        assert sum(of[i] == of[j] for i, j in pairs) >= 0.95 * len(pairs)


def test_op5_equals_brute_force(spark, docs):
    words = {i: WORD.findall((t or "").translate(LOW)) + ["\0end"] for i, t in zip(docs.doc_id, docs.text)}
    train = [words[i] for i in words if crc(i, 7) != 2]
    c, two, three = Counter(w for t in train for w in t), Counter(), Counter()
    for t in train:
        two.update(zip(["\0start", *t], t))
        three.update(zip(["\0start", *t], t, t[1:]))
    n, v = sum(c.values()), len(c)
    one, start = Counter(c), len(train)
    one["\0start"] = start
    (k1, k2) = language_model.PRIOR
    got = Q["op5_lm_scoring"](spark, SF).toPandas()
    assert len(got) == len(docs)
    for r in got.itertuples():
        t, base, score = words[r.doc_id], 0.0, 0.0
        for g, h, w in zip([None, "\0start", *t], ["\0start", *t], t):
            p = (c[w] + 1) / (n + v + 1)
            base += log10(p)
            p = (two[h, w] + k1 * p) / (one[h] + k1)
            score += log10((three[g, h, w] + k2 * p) / (two[g, h] + k2) if g else p)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 7) == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no larger tables")
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    got = Q["op8_toxicity"](spark, sf).toPandas()
    assert (got.held_out == [crc(i, 5) == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got.merge(labels, on="doc_id")
    held = held[held.held_out]
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2 > 0.85
    assert held[held.predicted == 1].toxic.mean() > 0.8 and held[held.toxic == 1].predicted.mean() > 0.8


def check_packing(rows, texts):
    """Every token once, gapless sequences within the size."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts}
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(of) == set(ids)
    for i, pieces in of.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(len(x) for x in ids.values()) / (2048 * len(sequences))


def test_op10_round_trip(spark, docs):
    full = check_packing(list(Q["op10_packing"](spark, SF).toPandas().itertuples()), list(zip(docs.doc_id, docs.text)))
    assert full > 0.98


def test_op10_fills_as_well_as_a_plain_packer(spark, docs):
    """Best-fit decreasing over the same pieces, with all windows open, is the plain packer; bounded space costs at most 2 % more sequences."""
    from tokenizers import Tokenizer

    got = Q["op10_packing"](spark, SF).toPandas()
    t = Tokenizer.from_file(queries.tokenizer_path())
    pieces = sorted((min(2048, n - k) for x in docs.text for n in [len(t.encode(x or "", add_special_tokens=False).ids) + 1] for k in range(0, n, 2048)), reverse=True)
    rooms = []
    for n in pieces:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(2048 - n)
    assert got.sequence_id.nunique() <= 1.02 * len(rooms) + 1


def test_pipeline_equals_plain_version(spark, docs):
    """Language ID from the operator, all else by plain Python."""
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    lang = Q["op2_language_id"](spark, SF).toPandas().set_index("doc_id")
    rows = [r for r in docs.itertuples() if lang.lang_pred[r.doc_id] != "und" and lang.score[r.doc_id] >= 0.3]
    pages, seen = Counter(r.source for r in rows), Counter()
    for r in rows:
        seen.update({(r.source, x.strip()) for x in r.text.split("\n") if x.strip()})
    drop = {k for k, n in seen.items() if n >= 3 and n > line_dedup.RATIO * pages[k[0]]}
    texts = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip()) not in drop) for r in rows}
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in texts}
    ids = sorted(texts)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    texts = {i: t for i, t in texts.items() if label[i] == i}
    own = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for t in pd.read_parquet(f"{SF}/benchmark.parquet").text:
        w = own.findall(t.translate(LOW))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    for i, t in texts.items():
        found = list(own.finditer(t.translate(LOW)))
        w, hit = [m[0] for m in found], set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        out, at = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out.append(t[at : found[k].start()])
            if k + 1 not in hit:
                at = found[k].end()
        texts[i] = "".join(out) + t[at:]
    check_packing(list(corpus_pipeline.run(spark, SF).toPandas().itertuples()), list(texts.items()))
