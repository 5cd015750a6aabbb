import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import decontaminate as D
from arborlake.llm import language_id as L
from arborlake.llm import quality as Q
from arborlake.llm import secrets as X
from arborlake.llm import url_filter as U
from verify import rows_of

from . import brute


# --- decontamination ---
def test_alignment_against_plain_smith_waterman():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        score, (i, j), (p, q) = D.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert round(score * 2 * len(a)) == brute.smith_waterman(a, b)
        if score:
            assert brute.smith_waterman(a[i:j], b[p:q]) == brute.smith_waterman(a, b)


def test_op1_finds_whole_items(spark, sf):
    words = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    docs = [(r["doc_id"], words(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.op1_decontamination(spark, sf).collect()}
    assert {k for k, v in got.items() if v == 1.0} == {(d, i) for d, t in docs for i, x in items if x in t} == set(got)


def test_edited_and_odd_copies(spark, odd, none):
    rng = random.Random(8)
    item = [f"tok{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "a b"), (3, None), (4, "")], "item_id long, text string")
    filler = [f"fill{i}" for i in range(300)]
    edits = [[w if rng.random() > 0.15 else "zzz" for w in item] for _ in range(10)]
    rows = [(k, " ".join(filler[:100] + e + filler[100:])) for k, e in enumerate(edits)] + [(50, " ".join(filler)), (51, " ".join(item[:5] + filler))]
    rows += [(k, " ".join(item)) for k in range(60, 90)]  # common seeds stay: the rarest half of each item's
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4_000_000, 1):
        got = D.find_contamination(docs, bench, rare_share=0.0, block_words=block)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, 1) for k in [*range(10), *range(60, 90)]}
    spans = D.find_contamination(docs.filter("doc_id = 60"), bench).first()
    assert (spans["doc_start"], spans["doc_end"], spans["item_start"], spans["item_end"], spans["score"]) == (0, 40, 0, 40, 1.0)
    own = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in D.find_contamination(odd, own).collect()) == [0, 1, 2, 3]
    assert D.drop_contaminated(odd, own).columns == odd.columns and D.find_contamination(none, own).count() == 0 and D.find_contamination(odd, own.limit(0)).count() == 0


def test_short_items_and_scripts_without_blanks(spark):
    texts = {1: "光合作用将光能转化为化学能", 2: "東京は日本の首都です", 3: "กรุงเทพเป็นเมืองหลวงของประเทศไทย", 4: "Habeas corpus", 5: "Zugzwang", 6: "北京", 7: "!"}
    bench = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    around = {1: "我们知道%s这是事实", 2: "実は%sと言われる", 3: "เราทราบว่า%sจริง", 4: "a writ of %s, so called", 5: "in %s again", 6: "我住在%s已经三年", 7: "no%s"}
    rows = [(k, around[k] % t) for k, t in texts.items()] + [(10, "habeas some corpus"), (11, "corpus habeas zugzwangs"), (12, "北方的京城"), (13, None), (14, "光")]
    got = D.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in got} == {(k, k, 1.0) for k in range(1, 7)}
    assert {r["doc_id"]: (r["doc_start"], r["doc_end"]) for r in got}[4] == (3, 5)


# --- language ID ---
def test_viterbi_is_optimal():
    rng = np.random.default_rng(4)
    m = L.LanguageModel(["a", "b", "c"], np.ones((3, L.BUCKETS)), np.ones((3, L.SCRIPTS)), switch_penalty=1.5)
    m.scores = rng.normal(0, 1, (50, 3)).astype(np.float32)
    rows = [rng.integers(0, 50, n).astype(np.int32) for n in (1, 2, 7, 30, 31, 200, 0)]
    for r, path in zip(rows, m.label(rows), strict=True):
        assert len(path) == len(r)
        if len(r):
            got = sum(float(m.scores[w, s]) for w, s in zip(r, path, strict=True)) - 1.5 * int((np.diff(path) != 0).sum())
            assert got == pytest.approx(brute.viterbi(m.scores[r].tolist(), 1.5), abs=1e-3)


def test_op8_accuracy(spark, sf):
    got = L.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_spans_scripts_and_odd_rows(spark, odd, none):
    rng = random.Random(1)
    words = {"en": "the and that with from this have been".split(), "de": "der und das mit nicht auch eine wird".split(), "ru": "это что как для они был она его".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(list(words) * 15)]
    model = L.train(spark.createDataFrame([*rows, (99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string"))
    mixed = " ".join(words["en"] * 3 + words["ru"] * 3 + words["de"] * 2)
    r = L.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, spans=True).first()
    assert [(s["lang"], s["start"], s["end"]) for s in r["spans"]] == [("en", 0, 24), ("ru", 24, 48), ("de", 48, 64)]
    assert L.scripts_of(np.array([ord(c) for c in "aяΩ漢"])).tolist() == [1, 3, 2, 12]
    got = {(x["carried"], x["lang_pred"] == "und", x["score"] > 0) for x in L.identify(odd, model).collect()}
    assert {(4, True, False), (5, True, False), (8, True, False), (10, True, False), (None, True, False), (1, False, True)} <= got
    assert L.identify(none, model).count() == 0 and L.drop_unidentified(odd, model).columns == odd.columns
    assert L.identify(spark.createDataFrame([(1, "한국어")], "doc_id long, text string"), model).first()["score"] == 0.0
    assert L.identify(spark.createDataFrame([(1, "½ ² Ⅷ 12")], "doc_id long, text string"), model).first()["lang_pred"] == "und"
    assert {r["lang_pred"] for r in L.identify(odd, L.train(none), spans=True).collect()} == {"und"}
    shared = spark.createDataFrame([(1, " ".join(words["en"] * 3 + words["ru"] * 3 + words["de"] * 3)), (2, "한국어 만"), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in L.drop_unidentified(shared, model).collect()] == [1]


# --- quality ---
def test_gradients():
    rng = np.random.default_rng(0)
    m = Q.AttentionModel(width=5, gate=3)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    counts, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.random((8, Q.FEATURES))
    loss = lambda: float(-np.mean(y * np.log(m.score(x, counts)) + (1 - y) * np.log(1 - m.score(x, counts))))
    grads = m.gradients(x, counts, y)
    for k, g in grads.items():
        at = tuple(0 for _ in g.shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up = loss()
        m.p[k][at] = old - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(float(g[at]), abs=1e-6), k
        m.p[k][at] = old


def test_op5_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right = got.filter("predicted = quality").count()
    assert right >= 0.93 * got.count() > 0


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 1), (4, 0), (10, 0), (10, None), (None, 1)], "doc_id long, quality int")
    model = Q.train(odd, labels)
    got = Q.score(odd, model)
    assert got.count() == odd.count() and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert Q.score(none, model).count() == 0 and Q.score(odd, Q.train(odd, labels.limit(0))).count() == odd.count()
    x, counts = Q.features(["", "a b", "w " * 130])
    assert counts.tolist() == [1, 1, 3] and not x[0].any() and x[1, -1] == 1


# --- URLs ---
def test_op6_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rel, df = con.sql(U.OP6_SQL), U.op6_url_filter(spark, sf)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/x?y#z", "https://sub.example.org/en/12", "http://example.org/en/2", "http://x.org", "http://badexample.org/es/1", "ftp://h.com/fr/a", "no scheme", None, "", "://", "a://b://c/d", "http://h.net?q=/es/", "http://h.com/de/1", "http://h.com/it/1/2/3/4"]
    pages = spark.createDataFrame([(i, u, "h", None) for i, u in enumerate(urls)] + [(None, urls[0], "h", "x")], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(pages, U.RULES).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow") and got[3][:3] == ("x.org", "", None)
    assert got[4][2:] == ("org/", "allow") and got[5][2:] == ("com/fr/", "allow") and got[6][:3] == got[7][:3] == got[8][:3] == got[9][:3] == ("", "", None) and got[10][:2] == ("b:", "//c/d") and got[11][:3] == ("h.net", "", None)
    assert got[12][2:] == ("com/de/", "block") and got[None] == got[0] and len(got) == len(urls) + 1
    assert U.judge_urls(pages.limit(0), U.RULES).count() == 0


def test_template_tree(spark):
    rows = [(i, f"http://h.com/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/p") for i in range(100)] + [(200 + i, f"http://h.com/spam/buy{i}") for i in range(40)] + [(300 + i, f"http://h.com/ok/page{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(200 + i, 0) for i in range(20)] + [(300 + i, 1) for i in range(20)], "page_id long, allowed int")
    got = {r["page_id"]: r for r in U.judge_urls(pages, (), labels).collect()}
    assert {got[i]["template"] for i in range(100)} == {"/user/*/p"}  # many values, but no labels to merge by
    assert got[239]["verdict"] == "block" and got[339]["verdict"] == "allow"


def test_deep_paths(spark):
    kinds = {"en/2024/05/casino/win": 0, "en/2024/05/article/x": 1, "a/b/c/d/e/bad/p": 0, "a/b/c/d/e/good/p": 1}
    rows = [(100 * k + i, f"http://h.com/{p}{chr(97 + i)}") for k, p in enumerate(kinds) for i in range(20)]
    rows += [(900, "http://h.com/" + "/".join("abcdefghijklmnopqrstuvwxyz")), (901, "http://h.com"), (None, None)]
    labels = [(100 * k + i, v) for k, v in enumerate(kinds.values()) for i in range(10)]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, allowed int")
    got = {r["page_id"]: r for r in U.judge_urls(pages, (), labels).collect()}
    for k, v in enumerate(kinds.values()):
        assert {got[100 * k + i]["verdict"] for i in range(20)} == {"allow" if v else "block"}
    assert len({got[k]["template"] for k in (19, 119, 219, 319)}) == 4 and got[19]["template"].count("/") == 5 and got[219]["template"].count("/") == 7
    assert len(got) == len(rows) and got[900]["template"].count("/") == 26 and got[901]["template"] == "/"


def plain_urls(rows, labels, min_values=12, min_repeats=4.0, min_labels=5, z=1.96, weight=8.0):
    """(host, path) -> template, purity, by dictionaries over single pages."""
    pages = [(h, tuple(re.sub("[0-9]+", "#", x) for x in p.split("/") if x), labels.get(i)) for i, h, p in rows]
    t = {(h, s): () for h, s, _ in pages}
    for k in range(max(len(s) for _, s, _ in pages)):
        values = defaultdict(Counter)
        for h, s, _ in pages:
            if len(s) > k:
                values[h, t[h, s]][s[k]] += 1
        wild = {key for key, c in values.items() if len(c) > min_values and sum(c.values()) < min_repeats * len(c)}
        t = {(h, s): p + (("*" if (h, p) in wild else s[k],) if len(s) > k else ()) for (h, s), p in t.items()}
    count = defaultdict(lambda: [0, 0, 0])
    for h, s, y in pages:
        c = count[h, t[h, s]]
        c[0], c[1], c[2] = c[0] + 1, c[1] + (y is not None), c[2] + (y or 0)
    m = {key: key[1] for key in count}
    for k in range(max(len(x) for _, x in count) - 1, -1, -1):
        branch = defaultdict(lambda: [0, 0])
        for key, c in count.items():
            if c[1] >= min_labels and len(m[key]) > k:
                b = branch[key[0], m[key]]
                b[0], b[1] = b[0] + c[1], b[1] + c[2]
        put = lambda x, v, k=k: x[:k] + (v,) + x[k + 1 :]
        siblings = defaultdict(list)
        for h, x in branch:
            siblings[h, put(x, "")].append((h, x))
        for group in siblings.values():
            share = (sum(branch[b][1] for b in group) + 1) / (sum(branch[b][0] for b in group) + 2)
            alike = {b for b in group if abs(branch[b][1] / branch[b][0] - share) <= z * (share * (1 - share) / branch[b][0]) ** 0.5}
            if len(group) > 1 and len(alike) > 1:
                m |= {key: put(x, "*") for key, x in m.items() if count[key][1] >= min_labels and (key[0], x) in alike}
    g = (sum(c[2] for c in count.values()) + 1) / (sum(c[1] for c in count.values()) + 2)
    across, own = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0.0, 0, 0, 0])
    for (_, x), c in count.items():
        across[x] = [across[x][0] + c[1], across[x][1] + c[2]]
    for key, c in count.items():
        a, o = across[key[1]], own[key[0], m[key]]
        prior = (a[1] + weight / 2 * g) / (a[0] + weight / 2)
        own[key[0], m[key]] = [o[0] + c[0] * prior, o[1] + c[0], o[2] + c[1], o[3] + c[2]]
    out = {}
    for h, s, _ in pages:
        o = own[h, m[h, t[h, s]]]
        out[h, s] = ("/" + "/".join(m[h, t[h, s]]), (o[3] + weight * o[0] / o[1]) / (o[2] + weight))
    return out


@pytest.mark.parametrize("most", [200_000, -1])
def test_tree_against_plain_version(spark, monkeypatch, most):
    """Also that one host and template have one verdict, whatever their paths say elsewhere."""
    monkeypatch.setattr(U, "BROADCAST_TEMPLATES", most)
    rng, rows, labels = random.Random(9), [], {}
    parts = [["en", "de", "fr", "es"], ["news", "shop", "blog", "casino"], ["2024", "x", "y"], [chr(97 + i) + chr(97 + j) for i in range(6) for j in range(6)], ["p", "q"]]
    for i in range(1500):
        h, p = f"h{rng.randrange(4) ** 2}.net", [rng.choice(c) for c in parts[: rng.randrange(6)]]
        rows.append((i, h, "/" + "/".join(p) + rng.choice(["", "/"])))
        if rng.random() < 0.6:
            labels[i] = int(rng.random() < (0.05 if "casino" in p else 0.6 if "shop" in p else 0.97))
    got = U.judge_urls(spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p in rows], "page_id long, url string"), (), spark.createDataFrame(list(labels.items()), "page_id long, allowed int")).collect()
    want = plain_urls(rows, labels)
    seg = lambda p: tuple(re.sub("[0-9]+", "#", x) for x in p.split("/") if x)
    assert len(got) == len(rows) and all((r["template"], r["purity"]) == (want[r["host"], seg(r["path"])][0], pytest.approx(want[r["host"], seg(r["path"])][1], abs=1e-8)) for r in got)
    assert len({(r["host"], r["template"]) for r in got}) == len({(r["host"], r["template"], r["purity"], r["verdict"]) for r in got}) and {r["verdict"] for r in got} == {"allow", "block"}
    assert any("*" in t for t, _ in want.values()) and any("casino" in t for t, _ in want.values())


def test_op6_one_verdict_for_a_template(spark):
    got = U.op6_url_filter(spark, "/root/testdata/sf0.01").filter("rule IS NULL").select("host", "template", "verdict").distinct().collect()
    assert len(got) == len({(r["host"], r["template"]) for r in got}) and {r["verdict"] for r in got} == {"allow", "block"}


def test_long_urls(spark):
    rows = [(1, "http://h.net/" + "a/" * 3000 + "1"), (2, "http://h.net/" + "b" * 200_000), (3, "http://h.net/" + "a/" * 3000 + "2")]
    got = {r["page_id"]: r for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, `url` string"), U.RULES).collect()}
    assert got[1]["template"] == got[3]["template"] and got[1]["template"].count("/") == 3001 and len(got[2]["path"]) == 200_001


# --- secrets ---
def test_op2_against_planted_tokens(spark):
    sf = "/root/testdata/sf0.01"
    want = {(r["doc_id"], m) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for m in re.findall(r'(?i)token = "([0-9a-f]{40})"', r["text"])}
    got = X.op2_secret_scan(spark, sf).filter("kept")
    import hashlib

    assert {(r["doc_id"], r["finding_sha256"]) for r in got.collect()} == {(d, hashlib.sha256(m.encode()).hexdigest()) for d, m in want} and want


def test_forest_and_odd_rows(spark, odd, none):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'start api_key="{hexes(32)}" rest', "src/a.py") for i in range(60)] + [(100 + i, f"commit {hexes(40)} by me", "docs/test.md") for i in range(60)] + [(300, None, None), (301, "", "x"), (302, f"{hexes(20)}/{hexes(20)};{hexes(16)}", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = X.candidates(docs)
    forest = X.fit(X.label_by_context(found), ["start", "rest", "commit"])
    got = {r["doc_id"]: r["kept"] for r in X.scan(docs, forest).filter("doc_id < 300").collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(60))
    assert found.filter("doc_id = 302").count() == 2
    only = X.fit(X.label_by_context(found).filter("label = 1"), [])
    assert only.trees == [] and X.scan(docs, only).filter("NOT kept").count() == 0
    assert X.scan(none, forest).count() == 0 and X.scan(odd, forest).filter("doc_id IN (4, 5)").count() == 0
    assert X.common_words(docs.select(F.lit("alpha alpha beta xy").alias("text")).limit(1)) == ["alpha", "beta"]


def test_short_and_digit_free_secrets(spark):
    lines = {
        1: ('password = "hunter2x9"', "hunter2x9"), 2: ("export DB_PASSWORD=Tr0ub4dor&3!.x", "Tr0ub4dor&3!.x"), 3: ("secret: swordfish;", "swordfish"), 4: ('{"apiKey":"zq"}', "zq"),
        5: ("passwd = 'correct horse battery staple' end", "correct horse battery staple"), 6: ("bare QWErtyuIOPasdfGHJKL here", "QWErtyuIOPasdfGHJKL"), 7: ("dbPassword :=x\u00e9!", "x\u00e9!"), 8: ('pwd ="a,b"', "a,b"),
        9: ("monkey: banana", None), 10: ("the token was lost", None),
    }
    docs = spark.createDataFrame([(k, t, None) for k, (t, _) in lines.items()], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["finding"] for r in X.candidates(docs).collect()}
    assert got == {k: v for k, (_, v) in lines.items() if v}
    words = ["hunter", "Sword!fish", "pa$$", "zebra", "Kilo&Mega"]
    rows = [(i, f'start password = "{words[i % 5]}{chr(97 + i)}" rest', "src/a.py") for i in range(26)] + [(100 + i, f"some incomprehensibilities{chr(97 + i)} follow", "a.md") for i in range(26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in X.scan(docs, X.fit(X.label_by_context(X.candidates(docs)), ["start", "rest"])).collect()}
    assert kept == {i: i < 100 for i, _, _ in rows}


def plain_features(r, dictionary):
    f, n = r["finding"], len(r["finding"])
    classes = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "other": "[^a-zA-Z0-9]"}
    out = {"length": n} | {f"step_{a}_{b}": len(re.findall(f"{x}(?={y})", f)) / max(n - 1, 1) for a, x in classes.items() for b, y in classes.items()}
    low, at, kept = f.lower(), 0, 0
    while at < len(low):  # the longest word at each place
        w = max((len(w) for w in dictionary if len(w) > 2 and low.startswith(w, at)), default=0)
        kept, at = kept + (not w), at + (w or 1)
    out["covered"] = 1 - kept / n
    parts = re.split("[^a-z0-9]+", r["path"].lower())
    suffix = re.search(r"\.([a-z0-9]+)$", r["path"].lower())
    out |= {"path_example": not X.EXAMPLES or any(p in X.EXAMPLES for p in parts), "path_depth": r["path"].count("/"), "path_suffix": zlib.crc32((suffix[1] if suffix else "").encode()) % 16}
    for side in X.NEIGHBOURS:
        bare = re.split("[^a-z0-9]+", r[side].lower())
        out |= {f"{side}_for": any(w in X.FOR for w in bare), f"{side}_against": any(w in X.AGAINST for w in bare), f"{side}_length": len(r[side])}
    out["assigned"] = bool(re.search(r"[:=]['\"\s]*$", r["before"] + " " + r["prefix"]))
    out["quoted"] = bool(re.search(r"['\"]$", r["prefix"]))
    return {f"f_{k}": float(v) for k, v in out.items()}


def walk(node, row):
    while not isinstance(node, float):
        name, threshold, left, right = node
        node = left if row[name] <= threshold else right
    return node


def test_forest_against_plain_evaluation(spark):
    """Features, both halves' votes and the verdict of every candidate, in Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = X.common_words(docs, most=300)
    found = X.candidates(docs).withColumns({"by_context": X.by_context(), "by_evidence": X.by_evidence()})
    rows = found.collect()
    forest = X.fit_halves(found, words)
    got = {(r["doc_id"], r["word_no"], r["part_no"]): r for r in X.judged(found, forest).collect()}
    assert len(got) == len(rows) > 100 and len(forest.trees) == 20
    for r in rows:
        row = plain_features(r.asDict(), words)
        mine = min(sum(walk(t, row) for t in p) / 10 for p in forest.parts)
        theirs = got[r["doc_id"], r["word_no"], r["part_no"]]
        assert theirs["score"] == pytest.approx(mine) and theirs["kept"] == (theirs["score"] >= 0.5)
    assert not {r["score"] for r in got.values()} <= {0.0, 1.0}
    assert all(re.match("f_(length|step_|covered)", n) for t in forest.trees[:10] for n in names_in(t)) and not any(re.match("f_(length|step_|covered)", n) for t in forest.trees[10:] for n in names_in(t))
    assert any(r["by_context"] is not None and r["by_context"] != got[r["doc_id"], r["word_no"], r["part_no"]]["kept"] for r in rows) or any(r["by_context"] is None for r in rows)


def names_in(node):
    return [] if isinstance(node, float) else [node[0], *names_in(node[2]), *names_in(node[3])]


def test_halves_against_their_labels(spark):
    """Commit hashes behind a name, placeholders behind an assignment, and bare keys: what one view alone would get wrong."""
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + rng.choice("abcdef")
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kinds = {
        1000: lambda: f'so token = "{hexes(40)}" goes', 2000: lambda: f"a card {digits(16)} was lost", 3000: lambda: f"this commit {hexes(40)} broke", 4000: lambda: 'then token = "changeme" stays',
        5000: lambda: f"{'word' * 5} in a row", 6000: lambda: f"password: {hexes(32)} there",
    }
    rows = [(base + i, make(), "a.py") for base, make in kinds.items() for i in range(60)]
    found = X.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumns({"by_context": X.by_context(), "by_evidence": X.by_evidence()})
    halves = X.fit_halves(found, ["changeme", "word"])
    got = defaultdict(list)
    for r in X.judged(found, halves).collect():
        got[r["doc_id"] // 1000].append(r["kept"])
    assert all(got[1]) and all(got[6]) and not any(got[2]) and not any(got[3]) and not any(got[4]) and not any(got[5])
    assert found.filter("doc_id BETWEEN 4000 AND 4999 AND by_context = 1").count() == 60 and found.filter("doc_id BETWEEN 3000 AND 3999 AND by_evidence = 1").count() == 60


def test_long_words_and_repeated_findings(spark):
    """The work on 2 MB without blanks grows with its length, whatever its signs; a finding that repeats in a word has the neighbours of each place."""
    long = {1: "a" * 2_000_000, 2: "=" * 2_000_000, 3: "key" * 700_000, 4: "key=" * 500_000, 5: "key_" * 500_000 + "=x", 6: 'key="' + "w " * 500_000, 7: "0123456789abcdef;" * 100_000, 8: 'token="x ' * 20_000, 9: "[" * 1_000_000 + "key" + "]" * 1_000_000}
    docs = spark.createDataFrame([(k, t, None) for k, t in long.items()], "doc_id long, text string, source string").repartition(4)
    got = X.described(X.candidates(docs), ["alpha"]).groupBy("doc_id").count()
    counts = {r["doc_id"]: r["count"] for r in got.collect()}
    assert counts[1] == counts[2] == counts[3] == 1 and counts[7] == 100_000 and counts[8] == 20_000
    same = "abcdefgh01234567"
    rows = X.candidates(spark.createDataFrame([(1, f'commit:{same};token="{same}"', None)], "doc_id long, text string, source string")).orderBy("part_no").collect()
    assert [(r["finding"], r["prefix"], r["suffix"]) for r in rows] == [(same, "commit:", ';token="'), (same, ';token="', '"')]
    assert re.fullmatch(X._any_of(["ab", "abc", "b.d", "x"]), "b.d") and [m[0] for m in re.finditer(X._any_of(["ab", "abc", "b.d", "x"]), "abcab xb.dbxd")] == ["abc", "ab", "x", "b.d", "x"]
