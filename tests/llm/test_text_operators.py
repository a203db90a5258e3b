"""Quality rules, URL filter, personal data, classifier, fingerprints, near-duplicates, pipeline."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle import connect, difference
from tablepact.llm import chosen_path, pii, quality_classifier, quality_rules, registry, url_filter, weighted_sampling

from llm_samples import ODD_ROWS, odd_documents, sf_dir, whole_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality rules -------------------------------------------------------------------

def bucket(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return (seed - (1 << 64) if seed >> 63 else seed) % quality_rules.BUCKETS


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False))
               if windows[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def grams(words):
    return [bucket(w) for w in words] + [bucket(a, b) for a, b in itertools.pairwise(words)]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_op10_matches_brute_force(spark):
    docs = whole_table("documents", "doc_id")
    good = defaultdict(set)
    for label in whole_table("labels", "doc_id"):
        if label["quality"] is not None:
            good[label["doc_id"]].add(label["quality"])
    raw, target = Counter(), Counter()
    for d in docs:
        g = grams(WORD.findall(d["text"] or ""))
        raw.update(g)
        if good.get(d["doc_id"]) == {1}:
            target.update(g)
    a, share = quality_rules.SMOOTHING, target.total() / raw.total()

    def ratio(k):
        return round(1e6 * math.log((target[k] + a * share) / (raw[k] + a) / share))
    rows = {r["doc_id"]: r for r in quality_rules.op10_quality_rules(spark, sf_dir()).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        row, counts, g = rows[d["doc_id"]], brute_counts(d["text"]), grams(WORD.findall(d["text"] or ""))
        assert tuple(row[c] for c in COUNTS) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        score = sum(map(ratio, g)) / max(len(g), 1) / 1e6
        assert row["score"] == pytest.approx(score, abs=2e-6)
        assert row["base_failed"] == failed
        assert row["kept"] == (not failed and row["score"] >= quality_rules.THRESHOLD)


def test_counts_of_any_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab \n\t#|", k=rng.randrange(60))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = quality_rules.judged(df, [0] * quality_rules.BUCKETS).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COUNTS) for r in rows] == [brute_counts(t) for t in texts]


def test_quality_rules_separate_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in whole_table("labels", "doc_id")}
    rows = quality_rules.op10_quality_rules(spark, sf_dir()).collect()
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0 and not r["base_failed"]]
    assert all(good) and sum(bad) < 0.5 * len(bad)  # the smallest table has few of them
    docs = spark.read.parquet(f"{sf_dir()}/documents.parquet")
    kept = quality_rules.passed(docs, spark.read.parquet(f"{sf_dir()}/labels.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])


def test_quality_rules_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (1, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality_rules.judged(docs, quality_rules.fit(docs, labels)).collect()
    assert len(rows) == len(ODD_ROWS)
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in rows if not (r["text"] or "").strip())
    kept = quality_rules.passed(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} <= {7}  # the others are short or repeat themselves
    without = quality_rules.passed(docs, labels.limit(0))  # no labels: the plain rules alone
    assert [r["doc_id"] for r in without.collect()] == [7]
    assert quality_rules.judged(docs.limit(0), quality_rules.fit(docs.limit(0), labels)).count() == 0


# --- URL filter --------------------------------------------------------------------

def test_op2_agrees_with_sql(spark):
    assert difference(registry.QUERIES["op2_url_filter"](spark, sf_dir()), connect(sf_dir()), url_filter.SQL) is None


URLS = ["http://A.Example.NET/en/x?q#f", "http://example.net/en", "http://net/", "https://xnet/fr/", "no scheme/net",
        None, "", "ftp://u.example.com/de/1", "http://w.org/fr/?a", "http://w.org?x/fr/", "a://b://c.net/d", "://", "http://ÄÖ.ORG/fr/é",
        "http://w.org/fr/?a"]


def test_host_path_and_longest_rule(spark):
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS)],
                               "page_id long, url string, host string, score int")
    rows = url_filter.judged(df).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in rows] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/en", "net/"), ("net", "/", "net/"),
        ("xnet", "/fr/", None), ("", "", None), ("", "", None), ("", "", None),
        ("u.example.com", "/de/1", "example.com/de/"), ("w.org", "/fr/", "org/fr/"), ("w.org", "", None),
        ("b:", "//c.net/d", None), ("", "", None), ("ÄÖ.org", "/fr/é", "org/fr/"), ("w.org", "/fr/", "org/fr/")]
    assert rows[5]["verdict"] == "allow" and {r["verdict"] for r in rows} <= {"allow", "block"}
    assert url_filter.judged(df.limit(0)).count() == 0


def test_model_learns_given_labels(spark):
    random.seed(3)
    rows = [(i, f"http://{random.choice(['cheap-pills', 'casino-win'] if i % 3 else ['library', 'museum'])}"
                f"{random.randrange(50)}.test/{random.randrange(999)}") for i in range(400)]
    rows = [(i, u, ("block" if i % 3 else "allow") if i < 200 else None) for i, u in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, said string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(df, (), "said").collect()}
    assert np.mean([got[i] == ("block" if i % 3 else "allow") for i in range(200, 400)]) > 0.95


def test_addresses_and_their_grams_are_not_broadcast(spark, monkeypatch):
    """Long addresses compress to little, but their n-grams are far more than the driver should hold."""
    plans, write = [], url_filter.written

    def written(df, label):
        plans.append(df)
        return write(df, label)
    monkeypatch.setattr(url_filter, "written", written)
    rows = [(i, f"http://{'ab' * 60}.example.{'com/de' if i % 2 else 'org/fr'}/{i}") for i in range(1500)]
    df = spark.createDataFrame([*rows, *rows[:9], (-1, None)], "page_id long, url string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "24m")
    try:
        judged = url_filter.judged(df)
        got = [(r["page_id"], r["verdict"]) for r in judged.collect()]
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(got) == sorted([(-1, "allow"), *((i, "block" if i % 2 else "allow") for i, _ in [*rows, *rows[:9]])])
    for df in [*plans, judged]:  # but the one row for each character, and their one sum
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("BroadcastExchange") == (2 if "ctx0" in text else 0)


# --- personal data -------------------------------------------------------------------

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= sum(c in "0123456789" for c in t) <= 19 and brute_luhn(t)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= sum(c in "0123456789" for c in t) <= 15),
}


def brute_luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def brute_plain(text):
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in BASE.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab@.-+ 0125(),%\n_")), max_size=50))
def test_plain_spans_match_the_patterns(text):
    assert pii.find_plain(text) == brute_plain(text)


def test_op3_matches_brute_force(spark):
    rows = {r["doc_id"]: r for r in registry.QUERIES["op3_pii"](spark, sf_dir()).collect()}
    for d in whole_table("documents", "doc_id"):
        plain, row = brute_plain(d["text"] or ""), rows[d["doc_id"]]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [len(plain[k]) for k in pii.KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in plain[k])
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(row["spans"].split(","))


@pytest.mark.parametrize("text, kind, part", [
    ("write to jane.doe [at] mail [dot] example [dot] org today", "email", "jane.doe [at] mail [dot] example [dot] org"),
    ("write to jane (at) example.org today", "email", "jane (at) example.org"),
    ("ask jane dot doe at example dot org now", "email", "jane dot doe at example dot org"),
    ("ask j\u0430ne\uff20ex\u0430mple.org now", "email", "j\u0430ne\uff20ex\u0430mple.org"),
    ("ask ja\u200bne@exam\u200bple.org now", "email", "ja\u200bne@exam\u200bple.org"),
    ("host 192 dot 168 dot 1 dot 20 is down", "ip", "192 dot 168 dot 1 dot 20"),
    ("host \uff11\uff19\uff12.168.1.20 is down", "ip", "\uff11\uff19\uff12.168.1.20"),
    ("call plus four nine three zero one two three four five six seven please", "phone",
     "plus four nine three zero one two three four five six seven"),
    ("pay four five three nine one four eight eight zero three four three six four six seven now", "card",
     "four five three nine one four eight eight zero three four three six four six seven"),
    ("\u00e9\u00e9 carte quatre cinq trois neuf un quatre huit huit zéro trois quatre trois six quatre six sept fin", "card",
     "quatre cinq trois neuf un quatre huit huit zéro trois quatre trois six quatre six sept"),
])
def test_disguises_are_found_where_they_stand(text, kind, part):
    plain, full = pii.find_all(text)
    start = text.index(part)
    assert (start, start + len(part)) in full[kind]
    assert all(set(plain[k]) <= set(full[k]) for k in pii.KINDS)
    assert part not in pii.redact(text) and f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize("text", [
    "look at the dot at the end", "one two three, testing at noon", "meet me at home", "the cat sat (at last) here",
    "version 1 dot 2", "naïve café déjà-vu", "five or six of the seven"])
def test_prose_is_left_alone(text):
    assert not any(pii.find_all(text)[1].values()) and pii.redact(text) == text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000, "1." * 150_000, "+1" + "(" * 300_000, "one " * 50_000):
        pii.find_all(text)


def test_pii_odd_rows(spark):
    docs = odd_documents(spark)
    rows = docs.select("doc_id", pii.found(docs.text).alias("f")).collect()
    assert len(rows) == len(ODD_ROWS) and all(r["f"]["spans"] == "" for r in rows if r["doc_id"] in (2, 3, 5))
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and clean.where("text is null").count() == 1
    assert pii.redacted(docs.limit(0)).count() == 0


# --- classifier --------------------------------------------------------------------

def test_op5_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in whole_table("labels", "doc_id") if r["quality"] is not None}
    rows = quality_classifier.op5_quality_classifier(spark, sf_dir()).collect()
    assert len(rows) == len(whole_table("documents", "doc_id"))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == q for p, q in judged]) > 0.8


def test_features_do_not_depend_on_neighbours(monkeypatch):
    texts = [b"", b"a", b"Zwei Worte!", b"x" * 5000, "é\n".encode() * 10]
    together = quality_classifier.features(texts)
    for i, t in enumerate(texts):
        assert np.allclose(quality_classifier.features([t])[0], together[i])
    monkeypatch.setattr(quality_classifier, "BLOCK_BYTES", 64)
    assert np.allclose(quality_classifier.features([b"abcdefgh" * 100]), quality_classifier.features([b"abcdefgh" * 100]))


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (6000, 1)), rng.normal(-1.5, 1, (4000, 1))
    everything = np.vstack([good, bad])
    def design(x):
        return np.hstack([x, np.tanh(2 * x), x ** 2 / 10, np.ones_like(x)])
    u, p = design(everything), design(rng.normal(1.5, 1, (2000, 1)))
    r = u @ quality_classifier.ratio_weights(u.T @ u, p.T @ p)
    rp = p @ quality_classifier.ratio_weights(u.T @ u, p.T @ p)
    edges = np.linspace(0, 4, quality_classifier.BINS + 1)
    prior = quality_classifier.prior_of(np.histogram(np.clip(r, 0, 3.999), edges)[0],
                                        np.histogram(np.clip(rp, 0, 3.999), edges)[0])
    assert abs(prior - 0.6) < 0.08
    w = quality_classifier.minimise(u.T @ u, p.T @ p, prior)
    assert np.mean(design(good) @ w > 0) > 0.9 and np.mean(design(bad) @ w < 0) > 0.9


def test_classifier_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_classifier.scored(docs.drop("score"), quality_classifier.fit(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (7, 1, None), (None, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    kept = quality_classifier.passed(docs, labels)
    assert kept.columns == docs.columns
    assert quality_classifier.scored(docs, quality_classifier.fit(docs, labels)).where("score between 0 and 1").count() == len(ODD_ROWS)
    assert quality_classifier.passed(docs.limit(0), labels).count() == 0


# --- fingerprints --------------------------------------------------------------------

def test_samples_collide_as_often_as_the_similarity():
    rng = random.Random(5)
    sampler = weighted_sampling.Sampler(samples=1024, cache=2000)
    for _ in range(6):
        a = Counter({f"w{i}": rng.randint(1, 9) for i in range(40)})
        b = Counter({w: rng.randint(1, 9) if rng.random() < 0.4 else n for w, n in a.items()})
        b["new"] = 5
        texts = [" ".join(w for w, n in c.items() for _ in range(n)).encode() for c in (a, b)]
        expected = sum((a & b).values()) / sum((a | b).values())
        got = weighted_sampling.likeness(*map(sampler.signature, texts))
        assert abs(got - expected) < 4.5 * math.sqrt(expected * (1 - expected) / 1024)


def test_blocks_and_cache_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 300}" for i in range(1000)).encode()
    whole = weighted_sampling.Sampler().signature(text)
    small = weighted_sampling.Sampler(cache=128)
    monkeypatch.setattr(weighted_sampling, "BLOCK_TERMS", 64)
    assert (small.signature(text) == whole).all() and (small.signature(text) == whole).all()


def test_op6_matches_brute_force(spark):
    docs = whole_table("documents", "doc_id")
    rows = sorted(weighted_sampling.op6_weighted_sampling(spark, sf_dir()).collect(), key=lambda r: r["doc_id"])
    sampler = weighted_sampling.Sampler()
    prints = [sampler.signature((d["text"] or "").encode()) for d in docs]
    assert len(rows) == len(docs)
    for i, (r, d) in enumerate(zip(rows, docs, strict=True)):
        text, following = d["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        other = sampler.signature(changed.encode())
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert bytes.fromhex(r["fingerprint"]) == prints[i].tobytes()
        assert bytes.fromhex(r["edited_fingerprint"]) == other.tobytes()
        assert r["near_edited"] == pytest.approx((prints[i] == other).mean())
        assert r["near_next"] == pytest.approx((prints[i] == prints[(i + 1) % len(docs)]).mean())


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_fingerprints_odd_rows(spark, ranges):
    rows = weighted_sampling.fingerprints(odd_documents(spark), n=ranges).collect()
    assert len(rows) == len(ODD_ROWS)
    assert Counter(r["n_chars"] for r in rows) == Counter(len(t or "") for _, t, *_ in ODD_ROWS)
    assert all(r["near_next"] <= 1 for r in rows)
    assert weighted_sampling.fingerprints(odd_documents(spark).limit(0)).count() == 0
    single = weighted_sampling.fingerprints(odd_documents(spark).where("doc_id = 1")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


# --- near-duplicates -----------------------------------------------------------------

def brute_classes(docs):
    """Class, links and copies by comparing all pairs of different texts."""
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[tuple(WORD.findall(text or ""))].append(doc_id)
    texts.pop((), None)
    names = list(texts)
    sets = [{t[i:i + 5] for i in range(max(1, len(t) - 4))} for t in names]
    links, up = Counter(), list(range(len(names)))
    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    pairs = {p for w in where.values() if len(w) < 200 for p in itertools.combinations(w, 2)}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links.update((a, b))
            up[top(a)] = top(b)
    ids = defaultdict(list)
    for i, t in enumerate(names):
        ids[top(i)] += [d for d in texts[t] if d is not None]
    return {d: (min(ids[top(i)], default=None), links[i], len(texts[t]))
            for i, t in enumerate(names) for d in texts[t]}


def got_classes(rows):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in rows}


def test_op9_matches_brute_force(spark):
    docs = [(d["doc_id"], d["text"]) for d in whole_table("documents", "doc_id")]
    rows = chosen_path.op9_chosen_path(spark, sf_dir()).collect()
    assert len(rows) == len(docs)
    got, expected = got_classes(rows), brute_classes(docs)
    assert {d: got[d] for d in expected} == expected


def planted(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    docs, number = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        if rng.random() < 0.7:
            base[10:10] = passage
        for _ in range(rng.choice([1, 1, 2, 3, 30])):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append((number, " ".join(text)))
            number += 1
    docs += [(number + i, docs[i * 3][1]) for i in range(20)]
    return docs


def test_planted_groups_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LIMIT", 8)
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    docs = planted()
    rows = chosen_path.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert got_classes(rows) == brute_classes(docs)


def test_runs_reach_the_recall():
    assert chosen_path.runs(miss=1e-2) < chosen_path.runs(miss=1e-4)


@pytest.mark.parametrize("few", [0, 250_000])
def test_components_of_a_chain(spark, monkeypatch, few):
    monkeypatch.setattr(chosen_path, "FEW_EDGES", few)
    chain = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"\xf0", b"\xf1")],
                                  "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["least"]) for r in chosen_path.components(chain).collect()}
    assert got == {bytes([i]): b"\0" for i in range(61)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def test_near_duplicates_odd_rows(spark):
    docs = odd_documents(spark)
    rows = chosen_path.classes(docs).collect()
    assert len(rows) == len(ODD_ROWS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 9)}
    assert by_id[6]["class_id"] == 1 and by_id[1]["n_copies"] == 3
    assert all(by_id[i]["class_id"] == i and by_id[i]["n_links"] == 0 for i in (2, 3, 5))
    kept = chosen_path.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[6] == 0 and ids[9] == 2 and ids[2] == ids[3] == ids[5] == 1
    assert chosen_path.one_of_each(docs.limit(0)).count() == 0
    twice = chosen_path.one_of_each(docs.where("doc_id = 6"))
    assert twice.count() == 1


# --- pipeline ----------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf_dir()}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in whole_table("labels", "doc_id")}
    names, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, sf_dir()), name)
        assert after.columns == names
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    kept = {r["doc_id"]: r for r in before.collect()}
    assert not any(labels.get(d) == 0 for d in kept) or np.mean([labels.get(d) == 0 for d in kept]) < 0.02
    left = brute_classes([(d, r["text"]) for d, r in kept.items()])
    assert all(len(r["text"]) == r["n_chars"] and not any(pii.find_plain(r["text"]).values()) for r in kept.values())
    assert len(left) == len(kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir())
    assert {r["doc_id"] for r in pieces.collect()} == set(kept)


def test_registry_is_complete():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in registry.QUERIES and set(registry.SQL) <= set(registry.QUERIES)
    assert duckdb.__version__


def test_a_large_node_gives_as_many_pairs_as_tags(spark, monkeypatch):
    """Near copies that all meet in the deepest node are connected through its leader, not pair by pair."""
    import numpy as np
    monkeypatch.setattr(chosen_path, "DEPTH", 1)
    monkeypatch.setattr(chosen_path, "LIMIT", 16)
    rng = np.random.default_rng(2)

    def name(i):
        return hashlib.blake2b(str(i).encode(), digest_size=16).digest()

    base = [rng.integers(0, 1 << 32, chosen_path.COORDINATES, dtype=np.uint32) for _ in range(3)]
    rows = []
    for i in range(300):
        own = base[i % 3].copy()
        own[rng.integers(1, len(own), 2)] = rng.integers(0, 1 << 32, 2)
        rows.append((bytearray(name(i)), bytearray(own.tobytes())))
    texts = spark.createDataFrame(rows, "digest binary, sketch binary").withColumn("tag", F.col("digest"))
    pairs = chosen_path.follow(texts, chosen_path.roots(4)).collect()
    forest, number = chosen_path.Forest(), {name(i): i for i in range(300)}
    for r in pairs:
        forest.join(number[bytes(r["a"])], number[bytes(r["b"])])
    assert {forest.top(i) for i in range(300)} == {0, 1, 2}
    calls = []
    real = chosen_path.similar_pairs
    monkeypatch.setattr(chosen_path, "similar_pairs", lambda rows: calls.append(real(rows)) or calls[-1])
    chosen_path.follow(texts, chosen_path.roots(4))
    assert sum(c.count() for c in calls) < 300 * 8


def test_few_against_many(spark, monkeypatch):
    """A node that is connected but for a few texts: the few are compared with all, part by part."""
    monkeypatch.setattr(chosen_path, "PART", 16)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, (2, chosen_path.COORDINATES), dtype=np.uint32)
    rows = []
    for i in range(120):
        own = base[int(i % 40 == 39)].copy()
        own[rng.integers(0, len(own), 2)] = rng.integers(0, 1 << 32, 2)
        tag = b"m" * 16 if i % 40 != 39 and i % 10 else b"%016d" % i
        rows.append((7, 120, bytearray(b"%016d" % i), bytearray(tag), bytearray(own.tobytes()), bytearray(b"m" * 16)))
    found = chosen_path.few_against_many(spark.createDataFrame(
        rows, "path long, n long, digest binary, tag binary, sketch binary, main binary")).collect()
    forest, tops = chosen_path.Forest(), {}
    for i, r in enumerate(rows):
        forest.join(tops.setdefault(bytes(r[3]), i), i)
    for r in found:
        forest.join(int(bytes(r["a"])), int(bytes(r["b"])))
    groups = {forest.top(i) for i in range(120)}
    assert groups == {forest.top(0), forest.top(39)} and len(groups) == 2 and len(found) < 120


def test_main_tags_of_nodes_take_no_join(spark, monkeypatch):
    """A large group of near copies is joined with its nodes once for each level, and with their leaders."""
    monkeypatch.setattr(chosen_path, "LIMIT", 8)
    labels, real = [], chosen_path.written
    monkeypatch.setattr(chosen_path, "written", lambda df, label: labels.append(label) or real(df, label))
    base = np.random.default_rng(7).integers(0, 1 << 32, chosen_path.COORDINATES, np.uint32)
    rows = []
    for i in range(60):
        near = base.copy()
        near[i % chosen_path.COORDINATES] ^= np.uint32(i + 1)
        rows.append((bytes([i]) * 16, bytes([i // 2]) * 16, near.tobytes()))
    texts = spark.createDataFrame(rows, "digest binary, tag binary, sketch binary")
    pairs = [(bytes(r["a"]), bytes(r["b"])) for r in chosen_path.follow(texts, chosen_path.roots(4)).collect()]
    forest = chosen_path.Forest()
    for i in range(0, 60, 2):
        forest.join(i, i + 1)
    for a, b in pairs:
        forest.join(a[0], b[0])
    assert len({forest.top(i) for i in range(60)}) == 1
    assert "paths1" in labels and not [label for label in labels if label.startswith("tags")]
