"""Operators on texts against brute force, exact round trips and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.llm import jaccard, lm, media, mixing, pieces, secret_scan, toxicity
from vantage.llm.common import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t", "a", "a b", "A  b\n", "日本語 🎉", "▁x▁ ", "x" * 3000, "\x00 \x01", "ab " * 50 + "q" * 70]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.integers(vocabulary))}" for _ in range(n))


def components(n, links):
    at = list(range(n))
    for _ in range(n):
        new = at[:]
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == at:
            return at
        at = new
    return at


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, size, percent):
    rng = np.random.default_rng(1)
    base = [prose(rng, 60, 4000) for _ in range(6)]
    texts = list(ODD) + base + ["A B", "b a", base[0].upper()]
    for b in base:  # dense groups whose members are near, and nearly near
        w = b.split()
        for _ in range(14):
            x = w[:]
            for _ in range(int(rng.integers(0, 6))):
                x[int(rng.integers(len(x)))] = f"n{int(rng.integers(10**6))}"
            texts.append(" ".join(x))
    passage = prose(rng, 50, 9000)
    texts += [prose(rng, 30, 9000) + " " + passage for _ in range(15)]
    sets = [shingles(t, size) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts), size, percent)[0].collect()}
    want = components(len(texts), links)
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_jaccard_links_members_of_one_group_that_miss_its_leader(spark):
    run = lambda name, n: [f"{name}{i}" for i in range(n)]
    head, middle = run("p", 8), run("c", 20)
    far, near, nearer = run("l", 9), run("x", 8) + ["y0"], run("x", 8) + ["y1"]
    texts = [" ".join(head + middle + tail) for tail in (far, near, nearer)]
    for i in range(6):  # make all but the head's shingles frequent: the three have one prefix, which no others have
        texts.append(" ".join(w for j, tail in enumerate((far, near, nearer)) for w in run(f"u{i}_{j}_", 80) + head[-2:] + middle + tail))
    sets = [shingles(t, 3) for t in texts]
    alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])
    assert alike(1, 2) and not alike(0, 1) and not alike(0, 2) and not any(alike(i, j) for i in range(3, 9) for j in range(i))
    table = docs(spark, texts)
    prefixes = {r.doc_id: (r.n, tuple(r.prefix)) for r in jaccard.signatures(table, 3, 90, jaccard.counts(table, 3)).collect()}
    assert prefixes[0] == prefixes[1] == prefixes[2]
    got = {r.doc_id: r.component_id for r in jaccard.join(table)[0].collect()}
    assert got == {i: 1 if i == 2 else i for i in range(9)}


def test_texts_of_one_template_do_not_meet(spark):
    """Texts that share all but a few words, just below the threshold, give no pairs to verify;
    above it they link."""
    words_ = [f"w{i}" for i in range(102)]
    def text(i, places):
        w = words_[:]
        for p in places:
            w[p] = f"n{i}_{p}"
        return " ".join(w)
    apart, alike = [text(i, (30, 60)) for i in range(400)], [text(i, (0, 101)) for i in range(400, 420)]
    got = {r.doc_id: r.component_id for r in jaccard.join(docs(spark, apart + alike))[0].collect()}
    assert all(got[i] == i for i in range(400)) and {got[i] for i in range(400, 420)} == {400}


def test_jaccard_of_no_rows_and_null_ids(spark):
    assert jaccard.join(docs(spark, []))[0].count() == 0
    got = jaccard.join(docs(spark, ["a b c d"] * 3, [None, 5, 5]))[0].collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (5, 5), (5, 5)]


def test_pieces_are_lossless_and_equal_the_library_without_dropout(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = ODD + ["The quick brown fox; the slow one.", "Ünïcödé straße"]
    df = docs(spark, texts)
    plain = {r.doc_id: r for r in pieces.encode(df, dropout=0.0).collect()}
    assert all(r.lossless for r in plain.values())
    assert all(plain[i].ids == m.encode(t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))
    some = {r.doc_id: r for r in pieces.encode(df, dropout=0.5).collect()}
    again = {r.doc_id: r for r in pieces.encode(df.repartition(3), dropout=0.5).collect()}
    assert all(r.lossless and r.ids == again[i].ids for i, r in some.items())
    assert some[12].ids != plain[12].ids and pieces.encode(docs(spark, [])).count() == 0


def test_agenda_and_side_by_side_agree():
    t = pieces.Tables(pieces.default_model())
    rng = random.Random(3)
    units = ["".join(rng.choice(" aehinorst") for _ in range(rng.randrange(1, 22))) for _ in range(300)]
    data, lengths = t.symbols(units)
    first = np.cumsum(lengths) - lengths
    keys = jaccard.mix(np.arange(300, dtype=np.uint64))
    for key, dropout in ((None, 0.0), (keys, 0.3), (keys, 0.99)):
        flat, size, places, made = t.merge(data, first, lengths, key, dropout)
        one = [t.merge_long(data[f : f + n], None if key is None else int(keys[i]), dropout) for i, (f, n) in enumerate(zip(first, lengths))]
        assert flat.tolist() == [i for x, _ in one for i in t.bytes_of(x)] and size.sum() == len(flat)
        if key is None:
            assert made.tolist() == [len(p) for _, p in one] and sorted(places.tolist()) == sorted(w for _, p in one for w in p)


def test_every_occurrence_is_merged_by_its_own_key():
    t = pieces.Tables(pieces.default_model())
    texts = ["information " * 2000, "informational " * 500 + "x" * 100_000, ""]
    keys = np.array([5, 6, 7], np.uint64)
    ids, count = pieces.Encoder(t, 0.1).encode(texts, keys)
    ends = np.cumsum(count)
    assert [t.decode(ids[e - n : e].tolist()) for e, n in zip(ends, count)] == texts
    brute = []
    for text, key in zip(texts, keys):
        for i, u in enumerate(pieces._UNIT.findall(" " + text) if text else []):
            own = jaccard.mix(key + np.array([i], np.uint64) * pieces._C2)[0]
            brute += t.bytes_of(t.merge_long(t.symbols([u])[0], int(own), 0.1)[0]) if i < 400 or len(u) > 50 else []
        if text.startswith("information "):
            assert ids[: len(brute)].tolist() == brute
            forms = {tuple(x) for x in (t.bytes_of(t.merge_long(t.symbols([" information"])[0], int(jaccard.mix(key + np.array([i], np.uint64) * pieces._C2)[0]), 0.1)[0]) for i in range(400))}
            assert len(forms) > 10


def labelled(n, rng):
    texts, marks = [], []
    for i in range(n):
        w = prose(rng, int(rng.integers(5, 120))).split()
        bad = i % 4 == 0
        for _ in range(2 if bad else 0):
            w[int(rng.integers(len(w)))] = ("horrid", "vile", "nastyx", "nastyy")[int(rng.integers(4))]
        texts.append(" ".join(w))
        marks.append(int(bad))
    return texts, marks


def test_toxicity_finds_held_out_documents(spark):
    texts, marks = labelled(600, np.random.default_rng(4))
    df = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, m, m) for i, m in enumerate(marks)] + [(999, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.rate(df, labels).collect()}
    held = [i for i in range(600) if got[i].tox_held_out]
    assert 60 < len(held) < 180
    assert np.mean([got[i].tox_predicted == marks[i] for i in held]) > 0.97
    assert all(0 <= r.tox_score <= 1 for r in got.values()) and got[600].tox_score == got[601].tox_score
    one = toxicity.rate(df, labels.filter("toxic = 0"))
    assert {r.tox_predicted for r in one.collect()} == {0}
    assert toxicity.rate(df.limit(0), labels).count() == 0


def test_toxicity_score_equals_brute_force():
    texts, marks = labelled(200, np.random.default_rng(1))
    model = toxicity.train(texts, np.array(marks), rounds=1, epochs=1)
    some = [*texts[:20], None, "", "one", " ".join(texts[:40]), "x" * 200_000]
    got = toxicity.scorer(model)(some)
    net, h = {k: v.astype(np.float64) for k, v in model.net.items()}, toxicity.HIDDEN
    for t, value in zip(some, got):
        w = (t or "").encode().split()
        best = -np.inf
        for s in range(0, max(1, len(w) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            part = w[s : s + toxicity.WINDOW]
            x, b = model.inputs([toxicity.clean(p) for p in part])
            seq = np.zeros((len(part), 2 * h))
            for d, order in enumerate((range(len(part)), range(len(part) - 1, -1, -1))):
                state = np.zeros(h)
                for i in order:
                    inp, u = np.append(x[i], net["E"][b[i]]) @ net["W"][d] + net["b"][d][0], state @ net["U"][d]
                    z, r = toxicity.sigmoid(inp[:h] + u[:h]), toxicity.sigmoid(inp[h : 2 * h] + u[h : 2 * h])
                    state = state + z * (np.tanh(inp[2 * h :] + r * u[2 * h :]) - state)
                    seq[i, d * h : (d + 1) * h] = state
            a = np.exp(seq @ net["a"]) if len(part) else np.zeros(0)
            best = max(best, float((a / a.sum() @ seq if len(part) else np.zeros(2 * h)) @ net["o"] + net["c"][0]))
        assert abs(toxicity.sigmoid(model.scale[0] * best + model.scale[1]) - value) < 1e-4


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.start_net(rng).items()}
    n, w = 5, toxicity.WINDOW
    x, b, y = rng.normal(size=(n, w, 3)), rng.integers(0, toxicity.BUCKETS, (n, w)), np.array([0, 1, 1, 0, 1])
    mask = (np.arange(w) < np.array([[3], [24], [10], [1], [17]])).astype(np.float64)
    grad, _ = toxicity.gradients(net, x, b, mask, y, np.ones(n))

    def loss():
        full = np.concatenate([x, net["E"][b]], 2)
        parts = np.einsum("nwd,kde->wkne", full, net["W"]) + net["b"]
        both = np.stack([parts[:, 0], parts[::-1, 1]], 1)
        p = toxicity.sigmoid(toxicity.forward(net, lambda t: both[t], mask))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k in net:
        i = tuple(int(rng.integers(s)) for s in net[k].shape) if k != "E" else (int(b[1, 2]), 1)
        old = net[k][i]
        net[k][i] = old + 1e-3
        up = loss()
        net[k][i] = old - 1e-3
        down = loss()
        net[k][i] = old
        assert abs((up - down) / 2e-3 - grad[k][i]) < 2e-4, k


def test_secrets_are_masked_and_clean_texts_kept(spark):
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = []
    for i in range(300):
        p = " ".join(rng.choice(["the", "thing", "runs", "over", "hills", "and", "ships"]) for _ in range(30))
        mid = [f'token = "{hexes(40)}"', f"password={hexes(18)}", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)), str(rng.randrange(10**15, 10**16)), "MENTQUEAIQUEVICHONE", "plain"][i % 6]
        texts.append(f"{p} {mid} {p}")
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, texts + ODD)).collect()}
    assert all((got[i].sec_secrets == 1) == (i % 6 < 3) for i in range(300))
    assert all(got[i].sec_text == t for i, t in enumerate(texts + ODD) if i >= 300 or i % 6 > 2)
    assert all(secret_scan.MASK in got[i].sec_text and len(got[i].sec_findings) >= 1 for i in range(300) if i % 6 < 3)
    assert secret_scan.scan(docs(spark, [])).count() == 0


def test_secrets_learn_from_labelled_findings_without_a_rule(spark):
    """Held-out precision and recall on findings that no rule labels."""
    rng = random.Random(4)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    base62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts, found = [], []
    for i in range(900):
        p = " ".join(rng.choice(["the", "thing", "runs", "over", "hills", "and", "ships"]) for _ in range(12))
        mid, label = [("use " + draw(base62, 32), 1), ("commit " + draw("0123456789abcdef", 40), 0), ("build thing-runs-2024-" + draw("0123456789", 4), 0), ("key " + draw(base62, 24) + "9", 1)][i % 4]
        texts.append(f"{p} {mid} {p}")
        for c in secret_scan.candidates(texts[-1]):
            assert secret_scan.rule_label(c[2], c[3], c[4]) is None
            found.append((i, c[0], label))
    given = spark.createDataFrame([f for f in found if f[0] % 3], "doc_id long, start long, label int")
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, texts), findings=given).collect()}
    flagged = {(i, f.start) for i in got if i % 3 == 0 for f in got[i].sec_findings if f.probability >= 0.5}
    true = {(i, s) for i, s, y in found if y and i % 3 == 0}
    assert len(true) > 100 and len(flagged & true) >= 0.95 * len(true) and len(flagged & true) >= 0.95 * len(flagged)


def test_long_texts_are_scanned_in_linear_time_and_whole():
    import time

    know = secret_scan.Knowledge({"abc"}, np.ones((128, 128)))
    scanner = secret_scan.Scanner(know, secret_scan.Forest(np.zeros((0, 14)), np.zeros(0)))
    took = []
    for n in (1 << 20, 5 << 20):
        began = time.time()
        found = scanner.scan(["ab1234567890cd;" * (n // 4 // 15) + " " + "a1" * (n // 8)], ["p"])[0]
        took.append(time.time() - began)
        assert len(found) == n // 4 // 15 + 1 and found[-1][1] - found[-1][0] == n // 4
    assert took[1] < 12 * took[0] + 5
    value = "aB1" * 5000
    row = know.features((0, 0, value, "", False, False, "", ""))
    assert row[0] == 15_000 and abs(row[1] - 14_999 / 15_000) < 1e-12


def test_media_round_trip(spark):
    import hashlib
    import zlib

    texts = ODD + ["é" * 500, "abc " * 400]
    got = {r.doc_id: r for r in media.media(docs(spark, texts), tensors=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes == len(r.stored) and all(len(x.rgb) == x.height * x.width * 3 for x in r.tensors)
    assert got[0].feature == got[1].feature and media.media(docs(spark, [])).count() == 0




def test_media_holds_any_bytes_and_several_scans():
    rng = np.random.default_rng(2)
    payloads = [bytes(rng.integers(0, 256, 192 * n, dtype=np.uint8)) for n in (1, 2, 5, 40)] + [bytes(rng.choice([127, 128, 129, 0, 255], 192 * 30).astype(np.uint8)), b"\x80" * 1920]
    images = media.encode(payloads)
    assert media.decode(images)[0] == payloads
    scans = [s[1] for s in media.parse(images[3])["scans"]]
    assert len(scans) == 11 and {(s[0], s[1]) for s in scans} == {(0, 0), (1, 5), (6, 63)} and any(s[2] for s in scans)


def test_media_inverse_transform():
    layout = media.Layout([(1, 1)])
    coef = np.zeros((6, 64), np.int16)
    coef[:, 0] = [80, 80, 80, 80, 0, 0]
    assert (media.pixels(coef, layout, np.ones((1, 64))) == 138).all()  # 128 + 80 / 8


def test_jaccard_near_copies_meet_once(spark, monkeypatch):
    """Members of a large group share dozens of shingles but make about one row a pair."""
    r = random.Random(3)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(150):
        w = list(base)
        for j in r.sample(range(150), 2):
            w[j] = f"x{i}y{j}"
        texts.append(" ".join(w))
    made, meetings = [], jaccard.meetings

    def noted(*a):
        rows = meetings(*a)
        made.append((rows.count(), rows.distinct().count()))
        return rows

    monkeypatch.setattr(jaccard, "meetings", noted)
    member, _ = jaccard.join(docs(spark, texts), 5, 80)
    got = {x.doc_id: x.component_id for x in member.collect()}
    assert made[0][1] > 1000 and made[0][0] <= 1.5 * made[0][1]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(146)} for t in texts]
    least = list(range(150))
    for _ in range(150):
        new = [min(least[j] for j in range(150) if 100 * len(a & sets[j]) >= 80 * len(a | sets[j])) for a in sets]
        if new == least:
            break
        least = new
    assert got == dict(enumerate(least))


def test_jaccard_pairs_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Members that most others link with are put together by few pairs, not by all pairs."""
    r = random.Random(8)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(500):
        w = list(base)
        for j in r.sample(range(150), 2 + i % 2):
            w[j] = f"x{i}y{j}"
        texts.append(" ".join(w))
    kept, prune = [], jaccard.prune

    def noted(pairs, *a):
        kept.append((pairs.count(), (out := prune(pairs, *a)).count()))
        return out

    monkeypatch.setattr(jaccard, "prune", noted)
    got = {x.doc_id: x.component_id for x in jaccard.join(docs(spark, texts), 5, 80)[0].collect()}
    assert sum(k for k, _ in kept) <= 40 * len(texts) and sum(k for _, k in kept) <= 20 * len(texts)
    sets = [{tuple(t.split()[j : j + 5]) for j in range(146)} for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j in range(i) if 100 * len(a & sets[j]) >= 80 * len(a | sets[j])]
    assert len(links) > 3000 and got == dict(enumerate(components(500, links)))


def test_lm_probabilities_and_counts(spark):
    rng = np.random.default_rng(6)
    texts = [prose(rng, int(rng.integers(1, 80)), 60) for _ in range(120)] + ODD
    rows = {r.doc_id: r for r in lm.rate(docs(spark, texts)).collect()}
    import zlib
    from collections import Counter

    c = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words(t), b""])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = [*words(t), b""]
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c for x in w), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r.base_score - sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-9
        assert np.isfinite(r.score) and r.score < 0
    assert lm.rate(docs(spark, [])).count() == 0


def toy(rng, pieces_in=60, total=400):
    counts = np.zeros(total, np.int64)
    counts[3 : 3 + pieces_in] = rng.integers(1, 90, pieces_in)
    counts[[1, 2]] = 7
    m = lm.Model(counts)
    m.w["d"] = rng.normal(size=lm.WINDOW).astype(np.float32)
    m.table()
    return m


def test_lm_score_equals_brute_force():
    rng = np.random.default_rng(3)
    m, w = toy(rng), None
    w = {k: v.astype(np.float64) for k, v in m.w.items()}
    lengths = np.array([3, 39, 0, 8, 7, 300])
    ids = rng.integers(3, 90, lengths.sum())  # some never occur in training
    got, want = lm.score(m, ids, lengths, blocks=5), []
    for e, n in zip(np.cumsum(lengths), lengths):
        x = [*ids[e - n : e].tolist(), lm.END]
        before, total = [lm.START, *x[:-1]], 0.0
        every = np.zeros(len(x))
        for i in range(len(x)):
            first = max(0, i // lm.SCORED * lm.SCORED - (lm.WINDOW - lm.SCORED))  # the window's first input
            assert i - first + 1 >= min(i + 1, 9)  # nine inputs at least, or all before it
            emb = w["E"][m.index[before[first : i + 1]]]
            a = (emb @ w["k"]) @ (emb[-1] @ w["q"]) + w["d"][np.arange(i - first, -1, -1)]
            a = np.exp(a) / np.exp(a).sum()
            g = np.exp(np.tanh(a @ (emb @ w["v"]) + emb[-1] @ w["r"]) @ w["A"] + w["B"][m.index[before[i]]])
            probability = m.full.astype(np.float64) @ (g / g.sum())
            every[i] = probability.sum()
            total += np.log10(probability[x[i]])
        assert np.allclose(every, 1, atol=1e-4)
        want.append(total)
    assert np.allclose(got, want, rtol=1e-5)


def test_lm_samples_every_window_once_over_all_offsets():
    x, before, lengths = lm.stream(np.arange(3, 303), np.array([100, 0, 200]))
    parts = [lm.sample(x, before, lengths, np.full(3, o)) for o in range(lm.SHARE)]
    targets = np.concatenate([p[:, lm.WINDOW :].ravel() for p in parts])
    assert sorted(targets[targets >= 0].tolist()) == sorted(x.tolist())
    assert lm.sample(x[:0], before[:0], lengths[:0], np.zeros(0, int)).shape == (0, lm.WINDOW + lm.SCORED)
    one = next(p for p in parts if (p[:, lm.WINDOW] == 3 + 8).any())
    row = one[one[:, lm.WINDOW] == 11][0]
    assert row[: lm.WINDOW].tolist() == [lm.START, *range(3, 18)] and row[lm.WINDOW :].tolist() == list(range(11, 19))


def test_lm_weights_learn_from_every_window(spark, monkeypatch):
    """More windows than STEPS steps take: each token is learned from once."""
    lengths = [0, 37, 1000] + [300_000] * 4
    ids = [np.arange(n) % 40 + 3 for n in lengths]
    x = lm.stream(np.concatenate(ids), np.array(lengths))[0]
    counts = np.bincount(x, minlength=400)
    counts[lm.START] = counts[lm.END]
    rows = spark.createDataFrame([(i, bytearray(p.astype(np.uint16).tobytes())) for i, p in enumerate(ids)], "row long, pieces binary")
    met, a, add_up = [], int((counts > 0).sum()) + 1, lm.add_up

    def noted(parts, size):
        got = add_up(parts, size)
        met.append(got[-1 - a * (lm.MIXTURES + 1) : -1 - a * lm.MIXTURES].sum())  # scored positions of a round
        return got

    monkeypatch.setattr(lm, "add_up", noted)
    lm.learn_windows(lm.Model(counts), rows, len(x), np.uint16)
    assert sum(met) == len(x)


def test_lm_gradients():
    rng = np.random.default_rng(1)
    m = toy(rng)
    x, before, lengths = lm.stream(rng.integers(3, 63, 40), np.array([40]))
    batch = lm.indexed(m, np.concatenate([lm.sample(x, before, lengths, np.array([o])) for o in range(lm.SHARE)]))
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    grad, some, times, explained, _ = m.gradient(batch[:, : lm.WINDOW], batch[:, lm.WINDOW :])
    assert times.sum() == 41 and np.allclose(explained.sum((0, 1, 2)), 41)
    for k in m.w:
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        j = (some[i[0]], *i[1:]) if k in "EB" else i
        old, out = m.w[k][j], []
        for d in (1e-3, -1e-3):
            m.w[k][j] = old + d
            out.append(m.gradient(batch[:, : lm.WINDOW], batch[:, lm.WINDOW :])[-1])
        m.w[k][j] = old
        assert abs((out[0] - out[1]) / 2e-3 - grad[k][i]) < 0.02 * abs(grad[k][i]) + 1e-5, k


def test_lm_learns_order_that_pairs_do_not_show(spark):
    """Held-out bits a token: below those without attention, and below those of counts."""
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(400):  # the word after "and" is the one two before it
        w = []
        for _ in range(40):
            w += [f"{'bcdfghklmn'[int(rng.integers(10))]}o", "and"]
            w.append(w[-2])
        texts.append(" ".join(w))
    with open(pieces.default_model(), "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    size = pieces.Tables(pieces.default_model()).size
    table = docs(spark, texts)
    model = lm.train(lm.stage(lm.gather(table, proto, size), "lm-test"), size)
    model.table()
    held = [t for i, t in enumerate(texts) if __import__("zlib").crc32(str(i).encode()) % 10 == 0]
    ids, per_doc, *_ = lm.Pieces(proto.value).documents([words(t) for t in held])
    bits = lambda: -lm.score(model, ids, per_doc).sum() * np.log2(10) / (len(ids) + len(held))
    x = lm.stream(ids, per_doc)[0]
    single, whole = -np.log2(model.unigram[x]).mean(), bits()
    model.w["v"] = model.w["v"] * 0
    model.table()
    assert whole < 0.8 * bits() and whole < 0.6 * single


def test_coverage_takes_words_of_any_length():
    know = secret_scan.Knowledge({"internationalization", "inter", "nation", "abc", "abcdefghijklmnop"}, np.ones((128, 128)))
    assert know.coverage("internationalization") == 1.0 and know.coverage("Internationxxx") == 11 / 14
    assert know.coverage("abcdefghijklmnoxabc") == 6 / 19 and know.coverage("abcdefghijklmnopabc") == 1.0 and know.coverage("") == 0.0

    def plain(value):
        low, i, covered = value.lower(), 0, 0
        while i < len(low):
            hits = [n for n in range(3, len(low) - i + 1) if low[i : i + n] in know.dictionary]
            covered, i = covered + max(hits, default=0), i + max(hits, default=1)
        return covered / len(low)

    r = random.Random(4)
    for _ in range(300):
        value = "".join(r.choice(["inter", "nation", "abc", "abcdefg", "hijklmnop", "alization", "x", "7"]) for _ in range(r.randint(1, 9)))
        assert know.coverage(value) == plain(value)


def test_rows_without_ids_are_drawn_by_text(spark):
    rows = [(None, f"word{i} " * 50, "a", "y", 1) for i in range(400)] + [(i, "other " * 5, "a", "x", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    done = mixing.mix(docs).filter("doc_id is null").agg(F.count_if("m_kept").alias("kept"), F.avg("m_prob").alias("prob")).first()
    assert 0.2 < done.prob < 0.9 and abs(done.kept / 400 - done.prob) < 0.1
