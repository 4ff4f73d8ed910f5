import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from strandline.llm import decontaminate as D, html_text as H, langid as L, line_dedup as N, quality as Q

from .conftest import ODD


def naive_lines(rows):
    """(n_lines, n_dropped, kept) of each row."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    docs, last, seen = Counter(), {}, set()
    for i, t in rows:
        if i is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                docs[k] += (k, i) not in seen
                seen.add((k, i))
                last[k] = max(last.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < 20 or docs[key(x)] < 3 or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_lines(make, sample):
    rows = [(i, t) for i, t in sample] + [(9000 + i, t.upper()) for i, t in sample[:20]] + [(9500 + i, "  " + t) for i, t in sample[:20]] + [(1_000_000 + k, t) for k, (_, t) in enumerate(ODD)]
    want = naive_lines(rows)
    assert sum(x[2] for x in want) > 20
    for options in ({}, {"keys_a_shard": 5, "probes_a_stream": 7}):
        got = N.dedup_lines(make(rows), into="r", **options).select("doc_id", "r.n_lines", "r.n_dropped", "r.kept").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_lines_of_odd_rows(make, odd):
    got = N.dedup_lines(odd, into="r").select("doc_id", "r.*").collect()
    assert sorted(map(tuple, got), key=repr) == naive_lines(ODD)
    assert N.dedup_lines(make([]), into="r").collect() == []
    kept = N.keep_lines(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    replaced = N.dedup_lines(odd, into="Score")
    assert [c.lower() for c in replaced.columns].count("score") == 1 and replaced.count() == len(ODD)


def test_rows_of_one_document_count_once(make):
    line = "the very same line of words here"
    rows = [(1, line), (1, line), (1, line), (2, line), (3, "other"), (3, None)]
    got = N.dedup_lines(make(rows), into="r").select("doc_id", "r.*").collect()
    assert sorted(map(tuple, got), key=repr) == naive_lines(rows) and not any(r["n_dropped"] for r in got)
    rows += [(9, line), (9, line)]
    got = N.dedup_lines(make(rows), into="r").select("doc_id", "r.*").collect()
    assert sorted(map(tuple, got), key=repr) == naive_lines(rows)
    assert {r["doc_id"] for r in got if r["n_dropped"]} == {1, 2}


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    h = N.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(5000))
    again = N.PerfectHash.load(*h.dump())
    assert (again.slots(keys) == h.slots(keys)).all() and again.slots(keys + np.uint64(1)).max() < 5000


def naive_repeats(words):
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})


def test_repeat_words():
    rng = random.Random(0)
    for _ in range(300):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert Q.repeat_words(w) == naive_repeats(w)


def test_ledger(odd, make):
    rows = Q.verdicts(Q.ledger(odd)).collect()
    assert len(rows) == len(ODD) and {"component_id", "score"} <= set(odd.columns)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_words"] == 0 and by[1]["fail_bits"] & Q.FEW_WORDS and not by[1]["kept_base"]
    assert by[4]["n_words"] == 30_000 and by[4]["fail_bits"] & Q.REPEATED_WINDOWS
    assert by[7]["word_chars"] == 8 and by[7]["n_lines"] == 2
    assert Q.ledger(make([])).count() == 0 and Q.keep_good(make([])).columns == odd.columns


def test_rules_and_ablations(make):
    good = " ".join(f"word{i} and text" for i in range(30))
    rows = [(1, good), (2, good.upper()), (3, " ".join(f"w{i}###" for i in range(40))), (4, " ".join(f"w{i}!!" for i in range(40))), (5, "\n".join(["same line of words here"] * 3) + " " + good), (6, "same " * 40)]
    led = Q.ledger(make(rows))
    bits = {r["doc_id"]: r["fail_bits"] for r in led.collect()}
    name = {n: 1 << i for i, n in enumerate(Q.RULES)}
    assert bits[1] == 0 and bits[2] == name["upper_case"] and bits[3] & name["symbols"] and bits[4] & name["exclamations"] and bits[6] & name["repeated_windows"]
    a = {(r["policy"], r["rule"]): r for r in Q.ablations(led).collect()}
    mask = Q.POLICIES["v1"]
    for n, bit in name.items():
        r = a["v1", n]
        assert (r["n_failed"], r["n_failed_alone"], r["n_kept"]) == (sum(b & bit > 0 for b in bits.values()), sum(b & mask == bit for b in bits.values()), sum(b & mask == 0 for b in bits.values()))


def test_wand_retrieves_all(spark):
    rng = random.Random(2)
    vocab = [f"w{i}".encode() for i in range(300)]
    items = [(i, b" ".join(rng.choices(vocab, [1 / (k + 1) for k in range(300)], k=rng.randint(5, 60)))) for i in range(150)]
    for index in D.build(items).indexes:
        for _ in range(200):
            terms = set(rng.sample(range(len(index.term)), min(len(index.term), rng.randint(1, 60)))) | {index.term[w] for w in rng.choice(index.items)[1]}
            score = Counter()
            for t in terms:
                for i, x in zip(index.posting_items[t], index.posting_scores[t]):
                    score[i] += x
            assert set(index.retrieve(terms)) == {i for i, x in score.items() if x >= D.THRESHOLD - 1e-9}


def test_no_passage_above_the_threshold_is_passed_over(monkeypatch):
    """candidates() and retrieve() against the scores of every item in every passage."""
    rng = random.Random(4)
    vocab = [f"w{i}".encode() for i in range(400)]
    weight = [1 / (k + 1) ** 0.7 for k in range(400)]
    items = [(i, b" ".join(rng.choices(vocab, weight, k=rng.randint(4, 90)))) for i in range(300)]
    bench = D.build(items)
    hits = 0
    for gathered in (D.GATHERED, 50):
        monkeypatch.setattr(D, "GATHERED", gathered)
        for _ in range(8):
            docs = [rng.choices(vocab, weight, k=rng.choice([0, 3, 40, rng.randint(0, 1500)])) for _ in range(4)]
            for words in docs:
                for _ in range(rng.randint(0, 4)):
                    at = rng.randint(0, len(words))
                    words[at:at] = rng.choice(items)[1].split()[: rng.randint(3, 90)]
            bounds = np.cumsum([0, *map(len, docs)])
            for index in bench.indexes:
                terms = np.array([index.term.get(w, -1) for words in docs for w in words], np.int32)
                got, want = set(), set()
                for d, start in index.candidates(terms, bounds):
                    part = terms[bounds[d] : bounds[d + 1]][start : start + 2 * index.stride]
                    got |= {(d, start, i) for i in index.retrieve(set(part[part >= 0].tolist()))}
                for d, words in enumerate(docs):
                    for start in range(0, max(1, len(words) - index.stride), index.stride):
                        score = Counter()
                        for t in set(terms[bounds[d] : bounds[d + 1]][start : start + 2 * index.stride].tolist()) - {-1}:
                            for i, x in zip(index.posting_items[t], index.posting_scores[t]):
                                score[i] += x
                        want |= {(d, start, i) for i, x in score.items() if x >= D.THRESHOLD - 1e-9}
                assert got == want
                hits += len(want)
    assert hits > 100


def test_leaks(spark, make, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    clean = [(i, t) for i, t in sample if not any(b in t for b in items.values())]
    planted = [(70_000 + k, f"{clean[k][1]} {b} {clean[k + 1][1]}") for k, b in enumerate(items.values())]
    edited = [(80_000 + k, f"{clean[k][1]} " + " ".join(w.upper() for w in b.split()) + "!") for k, b in enumerate(items.values())]
    got = {(r["doc_id"], r["leak"]["item_id"]) for r in D.find_leaks(make(clean + planted + edited), bench).selectExpr("doc_id", "explode(leaks) AS leak").collect()}
    assert got == {(base + k, i) for base in (70_000, 80_000) for k, i in enumerate(items)}
    split = {(r["doc_id"], r["leak"]["item_id"]) for r in D.find_leaks(make(planted), bench, broadcast_bytes=600).selectExpr("doc_id", "explode(leaks) AS leak").collect()}
    assert split == {(70_000 + k, i) for k, i in enumerate(items)}


def test_leaks_of_odd_rows(spark, odd, make):
    bench = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, ""), (4, "x y"), (4, "a b c d e")], "item_id long, text string")
    found = D.find_leaks(odd, bench).collect()
    assert len(found) == len(ODD)
    assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in found if r["leaks"]} == {5: [1, 4], 6: [1, 4], None: [1, 4]}
    assert D.find_leaks(make([]), bench).count() == 0
    none = spark.createDataFrame([], bench.schema)
    assert D.keep_unleaked(odd, none).count() == len(ODD) and D.keep_unleaked(odd, bench).columns == odd.columns
    for size in (D.BROADCAST_BYTES, 8):
        replaced = D.find_leaks(odd, bench, into="SCORE", broadcast_bytes=size)
        assert sorted(c.lower() for c in replaced.columns) == sorted(odd.columns) and replaced.where("size(score) = 2").count() == 4


def test_scores_do_not_depend_on_groups(spark, make):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = make([(r["item_id"], " ".join(r["text"].split()[1:]) + " and some more") for r in bench.collect()])
    found = [sorted((r["doc_id"], x["item_id"], round(x["score"], 9)) for r in D.find_leaks(docs, bench, broadcast_bytes=size).collect() for x in r["leaks"]) for size in (D.BROADCAST_BYTES, 600)]
    assert found[0] and found[0] == found[1]


def test_leaks_with_words_between_halves(spark, make):
    bench = spark.createDataFrame([(1, "Which city on the river Seine became the capital of France under Clovis? Paris"), (2, "Who wrote it? The quiet author of seven long books about the sea and its birds"), (3, "Is Rome or Oslo the city where the old council met in winter? Oslo"), (4, "Who won the cup? Ajax did")], "item_id long, text string")
    q = "which city on the river Seine became the capital of France under Clovis?"
    texts = {
        1: f"Question: {q} Answer: Paris. And so on.",
        2: f"Question: {q} Answer: Lyon. " + "other words come here " * 6 + "Paris",
        3: "Q: who wrote it? A: the quiet author of seven long books about the sea and its birds",
        4: "Is Rome or Oslo the city where the old council met in winter? Answer: no one knows",
        5: "Is Rome or Oslo the city where the old council met in winter? Answer: Oslo",
        6: "Q: Who won the cup? A: Ajax did",
        7: "Who won the cup? Nobody here did",
    }
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in D.find_leaks(make(list(texts.items())), bench).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [], 5: [3], 6: [4], 7: []}


def test_languages(spark, odd, make):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", L.held_out(__import__("pyspark").sql.functions.col("doc_id")))
    learned = L.learn(docs.where("NOT held"))
    held = L.identify(docs.where("held"), learned, into="x").select("lang", "x.*").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)
    by = {r["doc_id"]: r["x"] for r in L.identify(odd, learned, into="x").collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[5]["lang_pred"] in learned[0]
    nothing = L.learn(make([]))
    assert {r["x"]["lang_pred"] for r in L.identify(odd, nothing, into="x").collect()} == {"und"}
    for n in (1, 2, 3, 7, 8, 9, 40):
        code = L.code_matrix(n)
        assert len({tuple(r) for r in code}) == n


def naive_languages(train, texts):
    """(language, share, ambiguous) of each text, by dictionaries and plain loops."""
    import math

    def grams(t):
        low = b" " + t.lower().encode() + b" "
        for o in L.ORDERS:
            for i in range(len(low) - o + 1):
                code = int.from_bytes(low[i : i + o], "big") % 2**32
                yield o, (code * 0x9E3779B1) % 2**32 >> (32 - L.BUCKET_BITS)

    langs = sorted({x for _, x in train})
    count = {x: Counter() for x in langs}
    for t, x in train:
        count[x].update(grams(t))
    n = 1 << L.BUCKET_BITS
    total = {(x, o): sum(c for (k, _), c in count[x].items() if k == o) + L.PRIOR * n for x in langs for o in L.ORDERS}
    p = lambda x, g: (count[x][g] + L.PRIOR) / total[x, g[0]]
    splits = range(1, 1 << (len(langs) - 1))
    sides = [([x for i, x in enumerate(langs) if s >> i & 1], [x for i, x in enumerate(langs) if not s >> i & 1]) for s in splits]

    def weight(b, g):
        yes, no = (sum(p(x, g) for x in side) / len(side) for side in sides[b])
        return yes, no, math.log(yes / no)

    apart = []
    for b in range(len(sides)):
        w = [weight(b, (o, k)) for o in L.ORDERS for k in range(n)]
        apart.append(sum((y - z) * v for y, z, v in w) / len(L.ORDERS))
    apart = [a / sum(apart) for a in apart]
    out = []
    for t in texts:
        gs = list(grams(t))
        margin = [L.SHARPNESS * sum(weight(b, g)[2] for g in gs) / max(1, len(gs)) for b in range(len(sides))]
        loss = [len(sides) * sum(apart[b] * math.log1p(math.exp(-(1 if x in sides[b][0] else -1) * margin[b])) for b in range(len(sides))) for x in langs]
        e = [math.exp(min(loss) - v) for v in loss]
        share = [v / sum(e) for v in e]
        best = loss.index(min(loss))
        out.append((langs[best], share[best], share[best] - sorted(share)[-2] < L.AMBIGUOUS))
    return out


def test_languages_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_BITS", 8)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL AND text rlike '[a-z]'").select("doc_id", "text", "lang").orderBy("doc_id").limit(60).collect()
    rows = [(r[0], r[1][:400], r[2]) for r in rows]
    train, texts = [(t, x) for i, t, x in rows if i % 3], [t for i, t, _ in rows if not i % 3] + ["a", "É b", "mixed the und der les"]
    df = spark.createDataFrame(train, "text string, lang string")
    langs, table = L.learn(df)
    coder = L.Coder(langs, table)
    for got, want in zip([coder.decide(t.encode()) for t in texts], naive_languages(train, texts)):
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-4 and (got[2] == want[2] or abs(got[1] - L.AMBIGUOUS) < 1e-3)


def test_languages_of_odd_tables(spark, odd, make):
    learned = L.learn(odd)
    assert L.identify(make([]), learned).collect() == []
    replaced = L.identify(odd, learned, into="Lang")
    assert sorted(c.lower() for c in replaced.columns) == sorted(odd.columns)
    got = {r["doc_id"]: r["Lang"] for r in replaced.collect()}
    assert got[4]["lang_pred"] == "en" and got[9]["score"] == 1.0 and got[1]["lang_pred"] == "und"
    # languages of equal counts tie: the first by name is the answer, and it is ambiguous
    two = spark.createDataFrame([("same text", "b"), ("same text", "a")], "text string, lang string")
    tied = L.identify(two, L.learn(two)).first()["language"]
    assert (tied["lang_pred"], tied["ambiguous"]) == ("a", True) and abs(tied["score"] - 0.5) < 1e-9


def test_html_layout():
    page = """<!DOCTYPE html><title>x</title><h1>Head  &amp; more</h1><p>one<p>two <b>bold</b>er<br>next
<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><div style="display: none">no</div><div>d1<div>d2</div></div>
<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>both<tr><td rowspan=2>r<td>1<tr><td>2</table>
<pre>  keep
   this</pre><blockquote>quoted</blockquote><p hidden>gone</p>end <script>var t="</p>"</script>tail"""
    assert H.to_text(page) == "Head & more\n\none\n\ntwo bolder\nnext\n\n- a\n- b\n\n  3. x\n  4. y\n- c\n\nd1\nd2\n\nName       Qty\napple pie  3\nboth\nr          1\n           2\n\n  keep\n   this\n\n  quoted\n\nend tail"


def test_html_never_raises(spark):
    for bad in ("", "<", "<a href='x", "</p>", "<table><td>x", "<p<p>", "<div>" * 3000 + "deep", "a<!-- x", "<li>x<li>y", "<!---->ok", '<a b="c>d', "<ul>" * 2000 + "<li>x", "<table><tr><td>" * 600 + "q", "</table></td></tr>x", "<td>lone", "<textarea>a<b", "&#x110000;&bogus;"):
        assert isinstance(H.to_text(bad), str)
    assert H.to_text("<div>" * 3000 + "deep").strip() == "deep" and H.to_text("<p>x</p></table>y") == "x\n\ny"
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<p>a", "u"), (3, "<p>a", "u")], "page_id long, html string, text string")
    got = sorted(((r["page_id"], r["rendered"]["text"], r["rendered"]["n_chars"]) for r in H.extract(pages).collect()), key=repr)
    assert got == [(1, None, None), (2, "", 0), (3, "a", 1), (3, "a", 1)]


def test_html_keeps_all_words(spark):
    import html as lib
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.sub(r"(?s)<(title|style|script)\b.*?</\1>|<!--.*?-->", " ", r["html"])
        words = lib.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = [w for w in H.to_text(r["html"]).split() if w != "-"]
        assert got == [w for w in words if w != "-"]


def test_html_optional_tags_lose_nothing():
    assert H.to_text("<head><title>t</title><p>text") == "text"
    assert H.to_text("<html><head><meta charset=x>plain") == "plain"
    for start in ("<colgroup><col>", "<caption></caption>", "<colgroup>", "<form>", "<tbody><form>"):
        assert H.to_text(f"<table>{start}<tr><td>x<td>y</table>") == "x  y", start
    assert H.to_text("<table><colgroup><col><td>x</table>") == "x"
    assert H.to_text("<table><caption>c<tr><td>x</table>") == "c\nx"
    assert H.to_text("<table><tr><form><td>x</td></form><td>y</table>z") == "x  y\n\nz"
    assert H.to_text("<table><tr><td>a<tbody><tr><td>b</table>") == "a\nb"
    assert H.to_text("a<table>stray<tr>more<td>x</td><div>div</div><td>y</table>b").split() == ["astraymore", "div", "x", "y", "b"]
    assert H.to_text("<table><table><tr><td>x</table>y").split() == ["x", "y"]


def test_html_drawings_and_formulas():
    assert H.to_text("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> b") == "a x=1 b"
    svg = "<svg viewBox='0 0 1 1'><title>no</title><defs><text>no</text></defs> no <path d='M0'/><text>one</text><text>two<tspan>!</tspan></text><foreignObject><p>in</p></foreignObject></svg>"
    assert H.to_text(f"<p>a {svg} b").split() == ["a", "one", "two!", "in", "b"]
    assert H.to_text("<svg/>after") == "after" and H.to_text("<svg><path><p>out") == "out"
    assert H.to_text("<svg><text><![CDATA[a<b]]></text></svg>") == "a<b"


def test_html_visibility_and_selects():
    assert H.to_text("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>") == "yes"
    assert H.to_text("<div style='display:none'>no<b style='visibility: visible'>no</b></div>") == ""
    assert H.to_text("a<select><option>one<option selected>two<option>three</select>b") == "a two b"
    assert H.to_text("a<select><option disabled>one<option>two</select>b") == "a two b"
    assert H.to_text("<select multiple><optgroup label=x><option>one<option>two</optgroup><option hidden>no</select>").split() == ["one", "two"]
    assert H.to_text("a<select></select>b") == "a b"


def test_html_deep_lists_stay_small():
    page = "".join(f"<ul><li>x{i}" for i in range(2000))
    out = H.to_text(page)
    assert [w for w in out.split() if w != "-"] == [f"x{i}" for i in range(2000)] and len(out) < 40 * len(page)
    quotes = H.to_text("<blockquote>q " * 1500 + "end")
    assert quotes.split() == ["q"] * 1500 + ["end"] and len(quotes) < 200_000


def _random_page(rng, depth=0):
    """(markup, the words it shows) of a well-formed random page."""
    out, words = [], []
    for _ in range(rng.randint(1, 4)):
        word = f"w{rng.randrange(10**6)}"
        kind = rng.choice(["text", "div", "p", "ul", "table", "hide", "veil", "select", "bold", "pre", "quote", "script"]) if depth < 5 else "text"
        if kind == "text":
            out.append(f" {word} ")
            words.append(word)
        elif kind in ("div", "quote", "bold"):
            name = {"div": "div", "quote": "blockquote", "bold": "b"}[kind]
            inner, shown = _random_page(rng, depth + 1) if kind != "bold" else (word, [word])
            out.append(f" <{name}>{inner}</{name}> ")
            words += shown
        elif kind in ("p", "pre"):
            out.append(f"<{kind}>{word} <i>x</i></{kind}>")
            words += [word, "x"]
        elif kind == "ul":
            out.append("<ul>")
            for _ in range(rng.randint(1, 3)):
                inner, shown = _random_page(rng, depth + 1)
                out.append(f"<li>{inner}" + rng.choice(["</li>", ""]))
                words += shown
            out.append("</ul>")
        elif kind == "table":
            rows = [[f"c{rng.randrange(10**6)}" for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
            out.append("<table>" + rng.choice(["", "<tbody>"]) + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>")
            words += [c for r in rows for c in r]
        elif kind == "hide":
            out.append(f"<div hidden>{_random_page(rng, depth + 1)[0]}</div>")
        elif kind == "veil":
            out.append(f'<div style="visibility:hidden">no <b style="visibility:visible">{word}</b> no</div>')
            words.append(word)
        elif kind == "select":
            out.append(f"<select><option>no</option><option selected>{word}</option></select>")
            words.append(word)
        else:
            out.append("<script>no()</script><style>no</style><!-- no -->")
    return "".join(out), words


def test_html_shows_what_random_pages_show():
    rng = random.Random(5)
    for _ in range(300):
        page, words = _random_page(rng)
        assert [w for w in H.to_text(page).split() if w != "-"] == words, page


def test_html_tables_stay_small():
    """Wide cells, sparse rows and huge spans give text of the page's order."""
    wide = lambda n: f"<table><tr><td>{'w' * n}<td>e" + "<tr><td>a<td>b" * n
    pages = [wide(1000), wide(20_000), "<table><tr>" + "<td>" + "<td>".join(["x" * 79] * 300) + "<tr><td colspan=299>y<td>z" * 3000, "<table>" + "<tr><td rowspan=1000 colspan=1000>q<td>r" * 2000, "<table><tr>" + "<td colspan=1000>s" * 20_000 + "<tr><td>t<td>u" * 10, "<table><tr><td rowspan=900>a<td>b" + "<tr><td>c" * 3000]
    for page in pages:
        text = H.to_text(page)
        assert len(text) < 4 * len(page) + 10_000, page[:60]
        assert len(text.split()) == len(H.to_text(page.replace("<td", "<p").replace("<tr", "<p")).split())
    assert H.to_text(f"<table><tr><td>{'w' * 90}<td>e<tr><td>ab<td>c</table>") == f"{'w' * 90}  e\nab  c"
    assert H.to_text("<table><tr><td>name<td>n<tr><td>a<td>1<tr><td colspan=2>a longer line<td>z</table>") == "name  n\na     1\na longer line  z"
    assert H.to_text("<ol reversed><li>a<li>b<li>c</ol>") == "3. a\n2. b\n1. c" and H.to_text("<ol reversed start=9><li>a<li value=4>b<li>c</ol>") == "9. a\n4. b\n3. c"
    assert H.to_text("<input type=submit value=Go>") == "Go"


def test_html_table_of_pages(spark):
    long = spark.createDataFrame([(1, "<p>word " * 60_000, 5)], "page_id long, html string, Rendered int")
    got = H.extract(long)
    assert [c.lower() for c in got.columns] == ["page_id", "html", "rendered"] and got.first()["rendered"]["text"].split() == ["word"] * 60_000
    assert H.extract(long.limit(0)).collect() == []


def test_digest_of_lines():
    assert N.sha256_hex([b"a", None])[0] == [hashlib.sha256(b"a").hexdigest(), hashlib.sha256(b"").hexdigest()]
