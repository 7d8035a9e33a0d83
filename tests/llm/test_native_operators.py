"""License scan, URL filter, PII, fixity and preference formatting against plain Python, with edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tailspark.llm import fixity, licenses, pii, preference, url_filter

DOCS = "doc_id long, text string, Lang string, source string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)


# -- licenses -------------------------------------------------------------------------------


def brute_licenses(text):
    """Names of the templates of which some window of the operator's geometry holds enough, by exact containment alone."""
    ws, out = licenses._plain_words(text or ""), set()
    for name, t in licenses.TEMPLATES.items():
        tw = licenses._plain_words(t)
        want = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
        if want:
            size = licenses.window_size(len(want))
            for first in range(0, max(1, len(ws) - 4), size // 2):
                held = {tuple(ws[i : i + 5]) for i in range(first, min(first + size, len(ws) - 4))}
                if len(want & held) >= 0.8 * len(want):
                    out.add(name)
    return out


def test_bands_retrieve_what_exact_containment_finds(spark):
    rng = random.Random(3)
    names = sorted(licenses.TEMPLATES)
    texts = []
    for k in range(300):
        ws = licenses.TEMPLATES[names[k % len(names)]].split()
        for _ in range(k // len(names) % 3 if len(ws) > 30 else 0):
            ws[rng.randrange(len(ws))] = "other"
        lead = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(300))] + ["software", "license"] * (k % 2)
        texts.append(" ".join([*lead, *ws, *(f"w{rng.randrange(500)}" for _ in range(rng.randrange(100)))]))
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in licenses.scan(docs(spark, texts)).collect()}
    want = {i: brute_licenses(t) for i, t in enumerate(texts)}
    total, met = sum(map(len, want.values())), sum(len(got[i] & want[i]) for i in want)
    assert total > 250 and met >= 0.99 * total and all(got[i] <= want[i] for i in want)
    assert all(names[i % len(names)] in want[i] for i in range(len(names)))


def test_templates_do_not_match_each_other():
    family = {"Apache-2.0-notice": {"Apache-2.0"}}
    for name, text in licenses.TEMPLATES.items():
        assert brute_licenses("some words first " + text + " and more after it") <= {name} | family.get(name, set()), name


def test_license_scan_of_repeated_and_very_long_texts(spark):
    long = "w x y z " * 100_000 + licenses.TEMPLATES["MIT"] + " software" * 50_000
    d = spark.createDataFrame([(1, long, "a", "b"), (1, long, "a", "b"), (None, licenses.TEMPLATES["MPL-2.0"], "a", "b")], DOCS).withColumn("w", F.lit(1)).withColumn("evidence", F.lit(2))
    assert sorted((str(r["doc_id"]), r["licenses"]) for r in licenses.scan(d).collect()) == [("1", "MIT"), ("1", "MIT"), ("None", "MPL-2.0")]
    assert licenses.scan(d.limit(0)).count() == 0 and licenses.scan(d, {}).first()["n_licenses"] == 0


def test_license_scan_finds_whole_and_near_notices(spark):
    mit = licenses.TEMPLATES["MIT-notice"]
    ws = mit.split()
    near = " ".join(w if i not in (12, 50) else "other" for i, w in enumerate(ws))
    texts = [None, "", "short text", "x " * 300 + "Licensed under CC BY-NC 4.0. " + "y " * 300, "a b c " * 40 + mit + " d e f" * 40, "lead " * 77 + near, " ".join(ws[:40]), "the software is under the license of nobody at all"]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i]["licenses"] for i in range(8)] == ["", "", "", "CC-BY-NC-4.0", "MIT-notice", "MIT-notice", "", ""]
    assert got[5]["evidence"][0]["containment"] >= 0.8 and got[3]["n_licenses"] == 1


def test_license_windows_hold_every_placement(spark):
    line = licenses.TEMPLATES["GPL-3.0"]
    texts = ["w " * k + line + " z" * 7 for k in range(40)]
    assert {r["licenses"] for r in licenses.scan(docs(spark, texts)).collect()} == {"GPL-3.0"}


def test_license_scan_of_nothing(spark):
    assert licenses.scan(docs(spark, [])).count() == 0
    assert licenses.scan(docs(spark, ["a b"]), templates={}).first()["licenses"] == ""


def test_what_verifies_holds_an_anchor():
    words = set(licenses.anchors(licenses.TEMPLATES))
    for text in licenses.TEMPLATES.values():
        ws = licenses._plain_words(text)
        shingles = {tuple(ws[i : i + licenses.SHINGLE]) for i in range(len(ws) - licenses.SHINGLE + 1)}
        # what is left without anchors is too little to verify
        assert sum(not words & set(x) for x in shingles) < licenses.CONTAINMENT * len(shingles)
    assert len(words) < len(licenses.TEMPLATES)


# -- urls -----------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "page_id long, url string, html string, HOST_ string")


def test_rules(spark):
    urls = ["http://A.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://www.org/", "http://x.org", "https://b.com/fr/x", "http://b.com/de/", "//no", None, "http://", "x://h.com/de?u=http://y.org/", "http://notorg/"]
    got = {r["page_id"]: r for r in url_filter.judge(pages(spark, [(u, None) for u in urls])).collect()}
    want = [("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("www.org", "/", "org/"), ("x.org", "", None), ("b.com", "/fr/x", "com/fr/"), ("b.com", "/de/", "com/de/"), ("", "", None), ("", "", None), ("", "", None), ("h.com", "/de", None), ("notorg", "/", None)]
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == want
    assert [got[i]["verdict"] for i in (0, 1, 2, 4, 5)] == ["block", "block", "allow", "allow", "block"]
    assert url_filter.judge(pages(spark, [])).count() == 0


def brute_ranks(edges, seeds, rounds, damping=0.85):
    out, into = {}, {}
    for (s, d), w in edges.items():
        out[s] = out.get(s, 0) + w
        into[d] = into.get(d, 0) + w
    trust, bad = dict(seeds[0]), dict(seeds[1])
    for _ in range(rounds):
        t2 = {h: (1 - damping) * seeds[0].get(h, 0) for h in seeds[0] | seeds[1]}
        b2 = {h: (1 - damping) * seeds[1].get(h, 0) for h in seeds[0] | seeds[1]}
        for (s, d), w in edges.items():
            t2[d] = t2.get(d, 0) + damping * trust.get(s, 0) * w / out[s]
            b2[s] = b2.get(s, 0) + damping * bad.get(d, 0) * w / into[d]
        trust, bad = t2, b2
    return trust, bad


def test_propagation_equals_brute_force(spark):
    edges = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "a"): 3.0, ("d", "c"): 1.0, ("e", "d"): 1.0}
    seeds = ({"a": 0.75, "b": 0.25}, {"c": 1.0})
    e = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double")
    s = spark.createDataFrame([(h, 3 * seeds[0].get(h, 0.0), 2 * seeds[1].get(h, 0.0)) for h in "abc"], "host string, trust double, distrust double")
    got = {r["host"]: r for r in url_filter.propagate(e, s).collect()}
    trust, bad = brute_ranks(edges, seeds, url_filter.ROUNDS)
    for h in got:
        assert got[h]["trust"] == pytest.approx(trust.get(h, 0)) and got[h]["distrust"] == pytest.approx(bad.get(h, 0))


def test_links_carry_distrust_back(spark):
    rows = [("http://bad.com/de/1", None), ("http://liker.net/x", '<a href="http://bad.com/q">b</a>'), ("http://good.com/fr/1", '<A HREF=//fine.net/>f</A>'), ("http://fine.net/x", None)]
    got = {r["host"]: r["verdict"] for r in url_filter.judge(pages(spark, rows)).collect()}
    assert got == {"bad.com": "block", "liker.net": "block", "good.com": "allow", "fine.net": "allow"}


# -- personal data --------------------------------------------------------------------------

RULES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def brute_pii(text):
    out = []
    for k, (name, pattern) in enumerate(RULES):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0 if d else False
            if (name == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (name == "card" and not (14 <= len(d) <= 19 and luhn)) or (name == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


TEXTS = [
    "a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1..2.3.4.5", "4111 1111 1111 1111-", "é 4111-1111-1111-1111 ñ +1 (988) 555-2485.", "+12345678901234567 ++1 555 123 4567",
    "9" * 30_000, "a." * 4_000 + "@x.y" + ".z" * 4_000, None, "", "🙂 bob@x.org 🙂 1.1.1.1", "4" + "1" * 15 + " 4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "bob@x.org bob@x.org", "0000000000000.1.1.1", "+1-2", "@@@", "a@b..c",
]


def test_base_spans_equal_brute_force(spark):
    found = pii.find(docs(spark, TEXTS)).select("row.doc_id", pii._listed(F.col("base")).alias("b"), pii._listed(F.col("spans")).alias("s")).collect()
    for r in found:
        want = brute_pii(TEXTS[r["doc_id"]] or "")
        assert r["b"] == want
        assert set(filter(None, want.split(","))) <= set(r["s"].split(","))


def test_candidates_and_clean_texts(spark):
    texts = ["call 555-123-4567 now", "mail bob at example dot com today", "on 2020-10-12 we met", "version 12.34.56 is out", "order 1234-5678-9012 came", "time 12:30:45:10", "plain words only"]
    got = {r["doc_id"]: r["s"] for r in pii.find(docs(spark, texts)).select("row.doc_id", pii._listed(F.col("spans")).alias("s")).collect()}
    assert got[0] == "phone:5:17" and got[1].startswith("email:5:")
    assert [got[i] for i in range(2, 7)] == [""] * 5


def test_trees_add_what_the_rules_miss(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = {
        f'anha token = "{key}" thhan': [("secret", key)],
        "erti card 4111111111111111 4111111111111111 on": [("card", "4111111111111111")] * 2,
        "iban DE89 3704 0044 0532 0130 00 stand": [("iban", "DE89 3704 0044 0532 0130 00")],
        "her ssn 123-45-6789 was": [("id", "123-45-6789")],
        "call 0170 1234567 now": [("phone", "0170 1234567")],
        "write to bob [AT] example DOT com, er": [("email", "bob [AT] example DOT com")],
        "Des +1 (826) 555-4081 190.137.2.9 un": [("ip", "190.137.2.9"), ("phone", "+1 (826) 555-4081")],
    }
    clean = [
        f"commit {key} landed", "uuid 123e4567-e89b-12d3-a456-426614174000 here", "see https://site.org/a-long-path-name/2023/another-part of", "erti order 4111111111111112 came",
        "years 1998-2004 and 12.50 or 3/4", "DE89 3704 0044 0532 0130 01 code", "the token is lovely", "Thorsti HonathEnerErin on 10-20",
    ]
    every = [*texts, *clean]
    for r in pii.find(docs(spark, every)).collect():
        text = every[r["row"]["doc_id"]]
        got = sorted((pii.KINDS[s["kind"]], text[s["start"] : s["end"]]) for s in r["spans"])
        assert got == sorted(texts.get(text, [])), text


def test_quality_on_unseen_rows(spark):
    for kind, (proposed, good, selected, right) in pii.quality(spark).items():
        assert proposed > good > 50 and right >= 0.95 * selected and right >= 0.8 * good, kind


def test_names_that_clash_and_long_texts(spark):
    d = docs(spark, ["a@b.cd", "x" * 200_000 + " 4111111111111111 " + "7 " * 50_000, ""]).select("*", F.lit(1).alias("base"), F.lit(2).alias("spans"), F.lit(3).alias("row"), F.lit(4).alias("__base"), F.lit(5).alias("proposed"))
    d = d.unionByName(d)
    assert sorted(len(r["spans"]) for r in pii.find(d).collect()) == [0, 0, 1, 1, 1, 1]
    out = pii.redact(d)
    assert out.columns == d.columns and sorted({r["text"][-7:] for r in out.filter("doc_id = 0").collect()}) == ["[EMAIL]"]
    assert {(r["base"], r["spans"], r["row"]) for r in out.collect()} == {(1, 2, 3)}


def test_redaction_merges_and_keeps_columns(spark):
    d = docs(spark, ["é bob@x.org and 1.2.3.4!", None, "clean"]).withColumn("n_chars", F.length("text").cast("long"))
    out = {r["doc_id"]: r for r in pii.redact(d).collect()}
    assert out[0]["text"] == "é [EMAIL] and [IP]!" and out[0]["n_chars"] == len(out[0]["text"]) and out[1]["text"] is None and out[2]["text"] == "clean"
    assert pii.redact(d).columns == d.columns
    assert pii.redact(d.limit(0)).count() == 0


# -- fixity ---------------------------------------------------------------------------------


PAGES = "page_id long, url string, html string"


def test_audit_finds_exactly_the_damage(spark):
    p = spark.createDataFrame([(i, f"http://x/{i}", f"body {i} é") for i in range(2_500)] + [(None, None, None), (7, "http://x/7", "again")], PAGES)
    bad = F.coalesce(F.col("page_id").isin(3, 1024, 2499) & (F.col("html") != "again"), F.lit(False))
    got = fixity.audit(p, p.withColumn("html", F.when(bad, F.concat(F.substring("html", 1, 3), F.lit("#"), F.substring("html", 5, 99))).otherwise(F.col("html"))))
    assert got.count() == 2_501  # the two records of id 7 share a place
    assert sorted((r["page_id"], r["status"]) for r in got.filter("not intact").collect()) == [(3, "changed"), (1024, "changed"), (2499, "changed")]
    assert [r["n_records"] for r in got.filter("page_id = 7").collect()] == [2]
    assert fixity.audit(p, p).filter("not intact").count() == 0
    assert fixity.audit(p.limit(0), p.limit(0)).count() == 0


def test_records_and_roots(spark):
    p = spark.createDataFrame([(5, "u", "ü"), (6, "v", None)], PAGES)
    rows = sorted(fixity.places(fixity.leaves(p)).collect(), key=lambda r: r["position"])
    text = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Target-URI: u\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\nü\r\n\r\n".encode()
    assert rows[0]["digest"] == hashlib.sha256(text).hexdigest() and rows[0]["length"] == len(text) == rows[1]["offset"]
    up = "".join(r["digest"] for r in rows)
    for _ in range(fixity.LEVELS):
        up = hashlib.sha256(up.encode()).hexdigest()
    root = fixity.tree(fixity.leaves(p))[-1].collect()
    assert len(root) == 1 and root[0]["digest"] == up


def brute_audit(first, second):
    """Status by id, or by content where there is no id."""

    def held(rows):
        out = {}
        for i, u, h in rows:
            out.setdefault((0, i) if i is not None else (1, u or "", h or ""), []).append((u or "", h or ""))
        return {k: sorted(v) for k, v in out.items()}

    a, b = held(first), held(second)
    return sorted(("extra" if k not in a else "missing" if k not in b else "same" if a[k] == b[k] else "changed", str(k[1]) if not k[0] else "None") for k in a.keys() | b.keys())


def test_audit_equals_brute_force(spark):
    long = "x" * 300_000
    first = [(i, "u", f"body {i}") for i in range(0, 3_000, 3)] + [(-5, "u", "low"), (None, "a", "one"), (None, "a", "one"), (None, "b", None), (9, "u", "twice"), (12, None, long), (15, "u", "p"), (15, "u", "q"), (15, "u", "p")]
    second = [r for r in first if r not in ((30, "u", "body 30"), (2_070, "u", "body 2070"), (None, "b", None))]  # lost ones
    second = [(i, u, "other") if i in (1_500, -5) else (i, u, h) for i, u, h in second]
    second += [(1, "u", "new"), (9_999, "u", "a whole new file"), (None, "c", "new"), (9, "u", "third")]
    second.reverse()
    got = fixity.audit(spark.createDataFrame(first, PAGES).withColumn("file", F.lit("clash")).withColumn("digest", F.lit(1)), spark.createDataFrame(second, PAGES)).collect()
    assert sorted((r["status"], str(r["page_id"])) for r in got) == brute_audit(first, second)
    assert all(r["intact"] == (r["status"] == "same") for r in got)
    for r in got:
        assert (r["offset"] is None) == (r["status"] == "extra")
    by_file = {}
    for r in got:
        if r["offset"] is not None:
            by_file.setdefault(r["file"], []).append((r["position"], r["offset"], r["length"]))
    for rows in by_file.values():
        at = 0
        for k, (position, offset, length) in enumerate(sorted(rows)):
            assert position == k and offset == at
            at += length


def test_records_that_only_the_replica_holds_are_damage(spark):
    p = spark.createDataFrame([(i, "u", str(i)) for i in range(40)], PAGES)
    more = spark.createDataFrame([(40, "u", "40"), (5_000, "u", "a whole file")], p.schema)
    got = fixity.audit(p, p.unionByName(more)).collect()
    assert len(got) == 42
    assert sorted((r["page_id"], r["digest"]) for r in got if not r["intact"]) == [(40, None), (5_000, None)]


def test_missing_records_are_damage_and_condemn_no_other(spark):
    p = spark.createDataFrame([(i, "u", str(i)) for i in range(40)], PAGES)
    got = fixity.audit(p, p.filter("page_id < 30 AND page_id <> 5"))
    assert sorted(r["page_id"] for r in got.filter("not intact").collect()) == [5, *range(30, 40)]


# -- preferences ----------------------------------------------------------------------------

TURNS = "pair_id long, turn long, role string, text string, extra int"


def test_pairs(spark):
    c = [(1, 0, "user", "q", 0), (1, 1, "assistant", "good", 0), (2, 0, "user", "same", 0), (3, 0, None, None, 0), (3, 0, None, None, 0), (None, 0, "user", "lost", 0), (4, 1, "assistant", "b", 0), (4, 0, "user", "a", 0), (4, 2, "user", "c", 0)]
    r = [(1, 0, "user", "q", 0), (1, 1, "assistant", "bad!", 0), (2, 0, "user", "same", 0), (5, 0, "assistant", "only", 0), (4, 0, "user", "a", 0)]
    got = {x["pair_id"]: x for x in preference.format_pairs(spark.createDataFrame(c, TURNS), spark.createDataFrame(r, TURNS)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    one = got[1]
    assert one["n_prompt_turns"] == 1 and one["prompt"] == "<|im_start|>user\nq<|im_end|>\n"
    for side, text in (("chosen", "good"), ("rejected", "bad!")):
        s, e = map(int, one[f"{side}_mask"].split(":"))
        assert one[side][s:e] == text
    assert got[2]["n_prompt_turns"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[4]["n_prompt_turns"] == 1 and got[4]["rejected"] == "" and got[4]["chosen"].count("<|im_start|>") == 2
    assert got[5]["n_prompt_turns"] == 0 and got[5]["chosen"] == "" and got[5]["rejected_mask"] == "22:26"


def test_stale_answers_differ_only_in_the_last_answer(spark):
    t = spark.createDataFrame([(1, 0, "user", "q", 0), (1, 1, "assistant", "first", 0), (1, 2, "user", "r", 0), (1, 3, "assistant", "last", 0), (2, 0, "assistant", "one", 0), (3, 0, "user", "u", 0)], TURNS)
    got = {(r["pair_id"], r["turn"]): r["text"] for r in preference.stale_answers(t).collect()}
    assert got == {(1, 0): "q", (1, 1): "first", (1, 2): "r", (1, 3): "first", (2, 0): "", (3, 0): "u"}
    assert preference.format_pairs(t.limit(0), preference.stale_answers(t.limit(0))).count() == 0


@pytest.mark.parametrize("build", ["find", "scan", "judge"])
def test_native_paths_have_no_python(spark, build):
    d = docs(spark, ["a@b.cd"])
    df = {"find": lambda: pii.find(d), "scan": lambda: licenses.scan(d), "judge": lambda: url_filter.judge(pages(spark, [("http://a.b/", None)]))}[build]()
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().optimizedPlan().toString())
