"""License scans, periodic runs and hard negatives against brute force and on odd rows."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from vantage.llm import licenses, negatives, periodic, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(words, least=24, periods=3):
    out, n = set(), len(words)
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, periods * p) and not any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.add((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(r):
    words, kinds = [], r.choice([1, 2, 3, 6, 40])
    while len(words) < r.randint(0, 160):
        part = [r.randrange(kinds) for _ in range(r.randint(1, 12))]
        words += part * r.choice([1, 1, 2, 4, 9])
        words += [r.randrange(100, 200) for _ in range(r.randint(0, 3))]
    return words


def test_squares_find_all_runs():
    r = random.Random(5)
    for n in range(400):
        words = random_words(r)
        assert sorted(periodic.squares(words), key=lambda x: (x[0], x[2])) == brute_runs(words), n
        assert sorted(periodic.squares(words, 4, 2)) == sorted(brute_runs(words, 4, 2)), n


def test_stretches_hold_all_runs():
    r = random.Random(6)
    for least, periods in ((24, 3), (6, 2), (12, 4)):
        for _ in range(100):
            docs = [random_words(r) for _ in range(4)]
            ids = np.array([w for d in docs for w in d], np.int64)
            owner = np.repeat(np.arange(4), [len(d) for d in docs])
            first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
            got = [sorted((b - first[d] + s, n, p) for b, e in periodic.stretches(ids, owner, least, periods) if owner[b] == d for s, n, p in periodic.squares(ids[b:e].tolist(), least, periods)) for d in range(4)]
            assert got == [sorted(brute_runs(d, least, periods)) for d in docs]


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return len(runs), *top, "".join(f"{s},{n},{p}\n" for s, n, p in runs), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_runs_query_against_brute_force(spark, tmp_path):
    r = random.Random(7)
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, " ".join(f"w{r.randrange(30)}é" for _ in range(r.randint(0, 120)))) for i in ids]
    rows += [(5000 + i, "\n".join(" ".join(f"W{w}" for w in random_words(r)).split("|")) + "\x1f\x85 end") for i in range(40)]
    rows += [(1, None), (2, ""), (3, "\t \n"), (None, "a b " * 30), (4, "x " * 200_000), (5, "ab cd\x0bef " * 9), (5, "ab cd\x0bef " * 9)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    from hashlib import sha256

    want = []
    for i, t in rows:
        if t and len(t) > 100_000:
            n, s, length, p, lines, body = 1, 0, 200_000, 1, "0,200000,1\n", "x"
        else:
            n, s, length, p, lines, body = expected_runs(i, t)
        want.append((i, n, s, length, p, 1000 * length // p if p else None, sha256(lines.encode()).hexdigest(), sha256(body.encode()).hexdigest()))
    got = [tuple(x) for x in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(x[1] for x in want[:40]) and want[-3][1] == 1


def test_runs_keep_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10, "mine", None)], "doc_id long, text string, REP_RUNS string, x int")
    got = periodic.find_runs(docs).collect()[0]
    assert (got["REP_RUNS"], got[3]) == ("mine", None) and [tuple(r) for r in got[5]] == [(0, 30, 3)] and got[6] == "a b c" and got[4] == 30
    assert periodic.find_runs(docs.limit(0)).collect() == []


def brute_licenses(texts):
    known = [licenses.Template.of(*t) for t in licenses.TEMPLATES]
    import re

    words = [[w for w in re.split(licenses.SEPARATOR, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] for t in texts]
    df = {w: sum(w in set(d) for d in words) for t in known for w in t.words}
    idf = {w: math.log1p(len(words) / (1 + n)) for w, n in df.items()}
    out = []
    for d in words:
        base = sorted((label, i) for p, label in licenses.PHRASES.items() for i in range(len(d)) if d[i : i + len(p.split())] == p.split())
        found, score = set(), 0.5 if base else 0.0
        for t in known:
            if not {w for _, w in t.must} <= set(d):
                continue
            anchors = sorted(set(t.words) & set(d), key=lambda w: (df[w], w))[: licenses.RAREST]
            places = {}
            for i, w in enumerate(d):
                for j in t.places.get(w, []) if w in anchors else []:
                    places.setdefault(i - j, set()).add(w)
            at = lambda o, k, d=d: d[o + k] if 0 <= o + k < len(d) else None
            for o in [o for o, ws in places.items() if len(ws) > 1]:
                share = sum(idf[w] for j, w in enumerate(t.words) if at(o, j) == w) / sum(idf[w] for w in t.words)
                stands = all(at(o, j) == w for j, w in t.must)
                found |= {t.label} if stands else set()
                score = max(score, share if stands else share / 2)
        starts = [i for _, i in base]
        labels = {x for x, _ in base}
        out.append((len(d), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), round(score, 6)))
    return out


def license_texts():
    r = random.Random(9)
    texts = [None, "", "...", "MIT License", "the mitK license", "gnu gnu general public license", "CC BY-NC 4.0", "cc\x7fby", "ccéby cc-by CC  BY", "filler " * 50_000 + "Released under the MIT License."]
    for label, body, _ in licenses.TEMPLATES:
        texts += [body.upper(), "word " * r.randint(0, 9) + body + " tail " + body, " ".join(body.split()[1:]), " ".join(w for w in body.split() if r.random() < 0.8) + f" {label}"]
    vocabulary = [w for _, b, _ in licenses.TEMPLATES for w in b.split()]
    return texts + [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 300))) for _ in range(60)] + ["This work is licensed under the GNU General Public License, version 3."] * 5


def test_licenses_against_brute_force_and_sql(spark, tmp_path):
    texts = license_texts()
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(x)[1:] for x in queries.op11_license_scans(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == brute_licenses(texts)
    assert {"mit", "gpl-3.0,gpl", "apache,apache-2.0"} - {x[5] for x in got} == {"gpl-3.0,gpl"}
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert [x[1:] for x in sorted(db.sql(queries.ORACLE["op11_license_scans"]).fetchall())] == got


def test_licenses_run_no_python_and_keep_columns(spark):
    docs = spark.createDataFrame([(None, "mit license", 1), (None, "mit license", None), (3, None, 2)], "doc_id long, text string, lic_score int")
    done = licenses.scan(docs)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    rows = done.collect()
    assert sorted((r[2] or 0) for r in rows) == [0, 1, 2] and [r[3] for r in rows] == [2, 2, 0] and [len(r[4]) for r in rows] == [1, 1, 0]
    assert licenses.scan(docs.limit(0)).collect() == []


def brute_negatives(rows, anchors):
    known = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    known = [r for r in known if sum(x * x for x in r[2]) < 1 << 62]
    out = []
    for k, (i, lab, v) in enumerate(known):
        if not anchors(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m == lab) for n, (j, m, w) in enumerate(known) if n != k and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2])[:5]:
            hard = sorted(x for x in scored if not x[2] and -50 * s <= -100 * x[0] <= -95 * s)[:3]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["small", "wide", "one label", "odd"])
def test_negatives_against_brute_force(spark, kind, monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(negatives, "ROW_TILE", 32)
    monkeypatch.setattr(negatives.tiles, "__defaults__", (32,))
    monkeypatch.setattr(negatives.asking, "__defaults__", (8,))
    scale = {"small": 0.05, "wide": 3e4, "one label": 0.02, "odd": 1}[kind]
    rows = [(i, 0 if kind == "one label" and i % 3 else int(r.integers(4)), (r.normal(size=6) * scale).tolist()) for i in range(300)]
    if kind == "odd":
        rows += [(None, 1, [0.1] * 6), (400, None, [0.1] * 6), (401, 1, None), (402, 1, [0.1] * 5 + [None]), (403, 1, [math.nan] * 6), (404, 1, [math.inf] * 6), (405, 1, [1e300] * 6), (406, 2, [2e9] * 6)]
        rows += [(420, 1, [0.5, 0.25]), (421, 1, [0.5, 0.2]), (422, 2, [0.4, 0.1]), (423, 2, []), (430, 2, []), (440, 3, [])]
        rows += [(450, 1, [0.5] * 6)] * 3 + [(451, 2, [0.4] * 6)] * 4
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    got = sorted(tuple(x) for x in negatives.mine(df, df.vec_id % 10 == 0).collect())
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and got
    assert negatives.mine(df.limit(0), df.vec_id % 10 == 0).collect() == []


def test_residues_give_exact_products():
    r = np.random.default_rng(1)
    for top, dim in ((1, 1), (200, 64), (1 << 20, 700), (1 << 25, 2500), (1 << 30, 3)):
        a, b = (r.integers(-top, top, (9, dim)).astype(np.float64) for _ in range(2))
        exact = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        bound = max((m * m).sum(1).max() for m in (a, b))
        assert negatives.residue_product(a, b, bound).tolist() == exact


def test_queries_match_sql(spark):
    for name in ("op11_license_scans", "op13_hard_negatives"):
        db = duckdb.connect()
        for t in ("documents", "embeddings"):
            db.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = db.sql(queries.ORACLE[name])
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda x: tuple((v is not None, v) for v in x)
        assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
