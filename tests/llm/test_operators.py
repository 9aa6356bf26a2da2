"""Small cases of each operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns; brute force."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm import chat, html, lines, minhash, mixing, pieces, quality, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, True, 1.0) for i, t, lang, s in rows], DOCS)


LONG = " ".join(f"word{i % 977} and then" for i in range(8000))
HARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, LONG, "en", "b"), (4, LONG, "en", "b"),
    (None, "some text without an id here", "xx", None), (5, "Ünï cödé 🙂 text", "de", "c"), (6, "one", "en", "c"),
]


# ---- quality


def counts_by_hand(t):
    import re

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    full = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(covered)


def test_quality_counts_and_hard_rows(spark):
    rows = [*HARD, (7, "a b c d e f a b c d e x", "en", "a"), (8, "x|y\nx|y\n\n x|y", "fr", "a"), (9, "a " * 40, "en", "a")]
    docs = docs_of(spark, rows).withColumn("n_words", F.lit("clash"))
    for keep_text in (True, False):
        got = quality.quality_rules(docs, keep_text=keep_text).collect()
        assert len(got) == len(rows)
        by = {r["doc_id"]: r for r in got}
        for i, t, *_ in rows:
            r = by[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts_by_hand(t)
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_quality_empty_table(spark):
    assert quality.quality_rules(docs_of(spark, [])).count() == 0


def test_quality_tells_symbols_from_prose(spark):
    prose = "The history of the town is told in the books of the library, and it is a long one with many turns. "
    rows = [(i, prose + f"Chapter {i} of the story was written  by the hand of a monk. " + " ".join(f"w{i}{k}" for k in range(40)), "en", "a") for i in range(30)]
    rows.append((99, " ".join(f"#{k}$% |*" for k in range(60)), "en", "a"))
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs_of(spark, rows)).collect()}
    assert not kept.pop(99) and all(kept.values())


# ---- URLs


def test_url_rules_and_hard_urls(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    rows = [
        (1, "https://A.Example.ORG/es/1?q=/x"), (2, "http://x.org/"), (3, None), (4, ""), (5, "no scheme/here"), (6, "http://notexample.org/es/1"),
        (7, "http://example.org/en/19#f"), (8, "ftp://shop.com/de/1"), (9, "http://shop.com/fr/1"), (10, "http://shop.com?x=1"), (10, "http://shop.com?x=1"),
        (11, "http://borg/es"), (12, "http://" + "a" * 3000 + ".net/" + "b/" * 2000), (13, "http://é.org/es/"),
    ]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)), rules).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[2]["rule"] == "org/" and by[6]["rule"] == "org/" and by[7]["verdict"] == "block"
    assert (by[3]["host"], by[3]["path"], by[3]["rule"]) == ("", "", None) and by[5]["host"] == ""
    assert by[8]["verdict"] == "block" and by[9]["verdict"] == "allow" and (by[10]["host"], by[10]["path"]) == ("shop.com", "")
    assert by[11]["rule"] is None and all(r["verdict"] in ("allow", "block") for r in got)


def test_url_models_learn_from_rules(spark):
    rows = [(i, f"http://h{i % 5}.org/en/good-{i}") for i in range(40)] + [(100 + i, f"http://s{i % 5}.bad/casino/win{i}") for i in range(40)]
    rows += [(200, "http://z.net/en/good-7"), (201, "http://z.net/casino/win9")]
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), {"org/": "allow", "bad/": "block"}).collect()}
    assert got[200] == "allow" and got[201] == "block"


def test_url_parts_end_at_the_first_mark(spark):
    want = {
        "http://a.org?u=http://b.com/x": ("a.org", ""), "http://www.b.com?next=https://c.org/de/1": ("www.b.com", ""), "http://c.com/de/1?x=http://y.org/": ("c.com", "/de/1"),
        "http://d.org#s://e/f": ("d.org", ""), "http://://x": ("://x"[:1], "//x"), "://H.I/j\nk": ("h.i", "/j\nk"), "http:/x.org/": ("", ""), "": ("", ""), None: ("", ""),
        "http://f.org/a#b?c": ("f.org", "/a"), "http://É.org": ("É.org", ""),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    got = {r["url"]: (r["host"], r["path"]) for r in urls.url_filter(df, {"org/": "allow"}).collect()}
    assert got == want


def models_by_hand(rows, rules, order=4, mass=2.0):
    """Scores, threshold and verdicts by plain loops."""
    import math

    def rule(u):
        rest = (u or "").partition("://")[2].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        hits = [r for r in rules for name, _, p in [r.partition("/")] if (host == name or host.endswith("." + name)) and (slash + path).startswith("/" + p)]
        return max(hits, key=lambda r: (len(r), r), default=None)

    said = {u: rules.get(rule(u)) for _, u in rows}
    held = {u: hashlib.md5((u or "").encode()).hexdigest()[0] < "4" for _, u in rows}
    times = Counter(u for _, u in rows)
    pad = lambda u: "\x02" * order + (u or "")
    n = {"allow": Counter(), "block": Counter()}
    for u, c in times.items():
        for i in range(order, len(pad(u))):
            for k in range(order + 1):
                if said[u] and not held[u]:
                    n[said[u]][pad(u)[i - k : i + 1]] += c
                    n[said[u]]["ctx" + str(k) + pad(u)[i - k : i]] += c

    def p(side, t):
        if not t:
            return 1 / 256
        return (n[side][t] + mass * p(side, t[1:])) / (n[side]["ctx" + str(len(t) - 1) + t[:-1]] + mass)

    def score(u):
        parts = [math.log(p("allow", pad(u)[i - order : i + 1])) - math.log(p("block", pad(u)[i - order : i + 1])) for i in range(order, len(pad(u)))]
        return sum(parts) / len(parts) if parts else 0.0

    scores = {u: round(score(u), 6) for u in times}
    judged = [u for u in times if said[u] and held[u]]
    count = lambda us, v: sum(times[u] for u in us if said[u] == v)
    if not count(judged, "allow") or not count(judged, "block"):
        judged = [u for u in times if said[u]]
    good, bad = count(judged, "allow"), count(judged, "block")
    if not good or not bad:
        return scores, {u: said[u] or "allow" for u in times}
    cuts = sorted({math.floor(scores[u] * 100) for u in judged})
    gain = lambda t: sum((good if said[u] == "block" else -bad) * times[u] for u in judged if scores[u] < t / 100)
    best = max(cuts, key=lambda t: (gain(t), -t))
    limit = (best + max((t + 1 for t in cuts if t < best), default=best)) / 200
    return scores, {u: said[u] or ("block" if scores[u] < limit else "allow") for u in times}


def test_url_models_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda a: "".join(rng.choice(list(a), 5))
    rows = [(i, f"http://{word('abcde')}.org/en/{word('efghi')}") for i in range(60)] + [(100 + i, f"http://{word('vwxyz')}.bad/win/{word('stuvw')}") for i in range(50)]
    rows += [(200 + i, f"http://{word('abcdevwxyz')}.net/{word('efgstu')}") for i in range(40)] + [(300, None), (301, ""), (302, rows[0][1]), (303, "xé🙂")]
    rules = {"org/": "allow", "bad/": "block"}
    scores, verdicts = models_by_hand(rows, rules)
    for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules).collect():
        assert abs(r["score"] - scores[r["url"]]) < 2e-6 and r["verdict"] == verdicts[r["url"]], r


def test_url_empty_table(spark):
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string"), {"org/": "allow"}).count() == 0


# ---- chats


def test_layouts_by_fingerprint(spark):
    rows = [
        (1, [("user", "a"), ("assistant", None)], None, None, None, None, None, None), (2, None, "p", "r", "be kind", None, None, None),
        (3, None, None, None, None, "do", "with", "done"), (4, None, None, None, None, "do", None, "done"), (5, None, "only", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, messages array<struct<role string, content string>>, prompt string, response string, system string, instruction string, input string, output string")
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_chats(df, turn=None)).collect()}
    assert back[1] == [("user", "a"), ("assistant", "")]
    assert back[2] == [("system", "be kind"), ("user", "p"), ("assistant", "r")]
    assert back[3] == [("user", "do\n\nwith"), ("assistant", "done")] and back[4] == [("user", "do"), ("assistant", "done")]
    assert back[5] == [("user", "only"), ("assistant", "")] and chat.unmapped(df).count() == 0


def test_columns_of_other_layouts_and_nulls_lose_no_turn(spark):
    read = lambda df, turn=None: {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_chats(df, turn=turn)).collect()}
    rows = [(1, 0, "user", "a", "x", "s"), (1, 1, "assistant", None, None, None), (2, 0, None, None, "x", None)]
    got = read(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, input string, system string"), "turn")
    assert got == {1: [("user", "a"), ("assistant", "")], 2: [("", "")]}
    rows = [(1, None, "r"), (2, "p", None), (3, None, None)]
    got = read(spark.createDataFrame(rows, "conv_id long, prompt string, response string"))
    assert got == {1: [("user", ""), ("assistant", "r")], 2: [("user", "p"), ("assistant", "")], 3: [("user", ""), ("assistant", "")]}
    rows = [(1, "user", "t", None, None), (2, None, None, "q", "a"), (3, None, None, None, "a"), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, role string, text string, question string, answer string")
    assert read(df) == {1: [("user", "t")], 2: [("user", "q"), ("assistant", "a")], 3: [("user", ""), ("assistant", "a")], 4: []}
    assert [r["conv_id"] for r in chat.unmapped(df).collect()] == [4]
    df = spark.createDataFrame([(1, None), (2, []), (3, [("user", "x"), None])], "conv_id long, messages array<struct<role string, content string>>")
    assert read(df) == {1: [], 2: [], 3: [("user", "x"), ("", "")]}
    assert read(spark.createDataFrame([(1, "x")], "conv_id long, other string")) == {1: []}


def test_from_value_layout(spark):
    df = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from` string, value string>>")
    got = chat.read_back(chat.format_chats(df, turn=None)).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("user", "q"), ("assistant", "a")] and got["loss_texts"] == ["a"]


TRICKY = st.text(alphabet=st.sampled_from("\\l<n>/turn \n\r\t🙂é"), max_size=25)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\n<", ""]), TRICKY), min_size=1, max_size=6))
def test_chat_round_trip(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == turns
    assert got["loss_texts"] == [t for r, t in turns if r == "assistant"]


def test_chat_hard_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "first"), (None, 0, "assistant", "x"), (2, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert len(got) == 3 and len(got[1]["turns"]) == 3 and got[1]["turns"][0]["text"] == "first" and got[2]["loss_texts"] == [LONG]
    assert chat.format_chats(df.limit(0)).count() == 0
    assert chat.fingerprint(["b", "a"]) == hashlib.sha256(b"a\nb").hexdigest()


# ---- vectors


def test_vectors_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 12))
    x[100:160] = x[0] + 0.1 * rng.standard_normal((60, 12))
    x[160:200] = x[1]
    chain = [np.cos(a) * x[2] / np.linalg.norm(x[2]) + np.sin(a) * np.eye(12)[3] for a in np.linspace(0, 1.5, 9)]
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate([*x, *chain])]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 12, 0), (903, [1.0] * 11 + [None], 0), (904, [float("nan")] * 12, 0), (905, [float("inf")] + [0.0] * 11, 0), (None, x[1].tolist(), 0), (906, [1.0, 0.0], 0), (907, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in vectors.similar_vectors(df, block_rows=64).collect()}
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and i < 900]
    m = np.array([v / np.linalg.norm(v) for _, v in good])
    g = m @ m.T >= 0.9
    np.fill_diagonal(g, False)
    ids = [i for i, _ in good]
    assert [got[i]["n_links"] for i in ids] == g.sum(1).tolist()
    label = np.array(ids)
    while True:
        new = np.array([min(label[k], label[g[k]].min()) if g[k].any() else label[k] for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    assert [got[i]["component_id"] for i in ids] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 906))
    assert got[907]["component_id"] == 906 and got[906]["n_links"] == 1 and got[None]["component_id"] is None
    assert vectors.similar_vectors(df.limit(0)).count() == 0


# ---- mixing


@pytest.mark.parametrize("weights", [[1, 1], [1, 1, 1], [5, 3, 1, 1], [1 / (k + 1) for k in range(25)], [0.0001, 1, 2.5], [0.1, 0.2, 0.3], [1e-9, 1e9]])
def test_pfair_deviation_from_the_exact_weights(weights):
    exact = [Fraction(w) for w in weights]
    total, had = sum(exact), [0] * len(exact)
    many = [4000] * len(exact)
    run = list(mixing.pfair_slots(mixing.exact_weights(weights), many))
    for slot, (k, j) in enumerate(run[:4000], 1):
        assert j == had[k]
        had[k] += 1
        assert all(abs(had[i] - slot * w / total) < 1 for i, w in enumerate(exact))


def test_pfair_is_earliest_deadline_first_among_released():
    weights = [Fraction(3, 10), Fraction(1, 2), Fraction(1, 5)]
    had = [0, 0, 0]
    for slot, (k, _) in enumerate(mixing.pfair_slots(mixing.exact_weights(map(float, [3, 5, 2])), [50] * 3)):
        ready = [(-(-(had[i] + 1) // w), i) for i, w in enumerate(weights) if had[i] // w <= slot]
        assert k == min(ready)[1]
        had[k] += 1


def test_schedule_runs_every_block_once_and_zero_weights_last():
    weights, blocks = [3.0, 1.0, 0.0, float("nan"), -2.0], [7, 40, 5, 3, 0]
    out = mixing.schedule(weights, blocks)
    assert Counter(k for k, _ in out) == {0: 7, 1: 40, 2: 5, 3: 3}
    for k in range(4):
        assert [j for i, j in out if i == k] == list(range(blocks[k]))
    assert {k for k, _ in out[:47]} == {0, 1} and mixing.schedule([], []) == []
    first = [k for k, _ in out[:8]]  # until the first source has run out: 3 to 1
    assert all(abs(first[:t].count(0) - Fraction(3 * t, 4)) < 1 for t in range(1, 9))


def test_mixing_brute_force(spark):
    rows = [(i, "x", "en", ("a", "b", "c", None)[int(i**0.5) % 4]) for i in range(400)]
    clash = {c: F.lit(f"mine{c}") for c in ("_h", "_b", "_r", "_s", "_of", "_off", "_at", "_k", "_j", "MIX_slot2", "_slot")}
    docs = docs_of(spark, [*rows, (7, "x", "en", "a"), (7, "x", "en", "a"), (None, "x", "en", "b"), (None, "y", "en", "b")]).withColumn("mix_slot", F.lit("clash")).withColumns(clash)
    weights = {"a": 3.0, "b": 1.0, "c": 1 / 3}
    got = mixing.mix_sources(docs, weights, block_rows=4, bucket_rows=5).collect()
    assert len(got) == 404 and all(r[c] == f"mine{c}" for r in got for c in clash)
    per = defaultdict(list)
    for r in got:
        per[r["source"]].append((r["mix_block"], r["mix_row"], r["mix_slot"]))
    names = sorted(per, key=lambda s: (s is None, str(s)))
    order = mixing.schedule([weights.get(s, 0.0) for s in names], [-(-len(per[s]) // 4) for s in names])
    for k, s in enumerate(names):
        xs = sorted(per[s])
        assert [(b, r) for b, r, _ in xs] == [(i // 4, i % 4) for i in range(len(xs))]
        mine = [slot for slot, (i, _) in enumerate(order) if i == k]
        assert all(slot == mine[b] for b, _, slot in xs)
    assert sorted({r["mix_slot"] for r in got}) == list(range(len(order)))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_sources(docs, max_sources=2)


def test_mixing_bounds_the_schedule_and_ranks_do_not_depend_on_partitions(spark):
    docs = docs_of(spark, [(i % 50 if i % 3 else None, f"t{i}", "en", "ab"[i % 2]) for i in range(600)])
    runs = [mixing.mix_sources(d, {"a": 1, "b": 2}, block_rows=1, max_slots=30, bucket_rows=10) for d in (docs, docs.repartition(7, "text"))]
    a, b = ({r["text"]: (r["mix_slot"], r["mix_row"]) for r in x.collect()} for x in runs)
    assert a == b and len(set(a.values())) == 600 and max(s for s, _ in a.values()) < 32


# ---- lines


def test_line_dedup_passages(spark):
    p = ["The first line of a passage that is repeated in many documents here", "goes on with a second line of some more words than usual", "and it has a third one with yet other words to make it long", "ending in a fourth line that closes the passage for good and all"]
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    line = lambda: " ".join(word() for _ in range(9))
    rows = [(i, "\n".join([line() for _ in range(3)] + (p if i % 2 else []) + [line() for _ in range(3)]), "en", "a") for i in range(20)]
    one = " ".join(word() for _ in range(60))
    rows += [(100, one, "en", "a"), (101, line() + "\n" + one + "\n" + line(), "en", "a"), *[(200 + k, t, "en", "a") for k, t in enumerate([None, "", "short", "short"])]]
    docs = docs_of(spark, rows).withColumn("n_removed_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert len(got) == len(rows)
    text = dict((i, t) for i, t, *_ in rows)
    for i in range(20):
        if i % 2 == 0 or i == 1:
            assert got[i]["text"] == text[i] and got[i]["n_removed_lines"] == 0
        else:
            left = sum(x in got[i]["text"].split("\n") for x in p)
            assert left == 0, (i, left)
            assert [x for x in text[i].split("\n") if x not in p] == got[i]["text"].split("\n")
    assert got[100]["text"] == one and one not in got[101]["text"]
    assert got[200]["text"] is None and got[201]["text"] == "" and got[203]["text"] == "short"


def test_line_dedup_copies_and_hard_rows(spark):
    t = "\n".join(f"line {k} of the copied text with enough words to count" for k in range(6))
    docs = docs_of(spark, [*HARD, (50, t, "en", "a"), (51, t, "en", "a"), (52, t, "en", "a"), (52, t, "en", "a"), (None, t, "en", "a")])
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(HARD) + 5
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["text"])
    assert by[50] == [t] and by[51] == [""] and by[52] == ["", ""] and t in by[None] and by[4] == [LONG, LONG]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def _lines_of_sizes(seed):
    """Makes lines of so many words that no other line has."""
    rng = np.random.default_rng(seed)
    return lambda *sizes: [" ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)) for n in sizes]


def runs_by_hand(rows, min_words=8, long_line=50):
    """Lines that a run equal to an earlier one covers, by comparing all pairs of places byte by byte."""
    lines_of = {i: t.split("\n") for i, t in rows}
    places = [(i, k) for i, ls in sorted(lines_of.items()) for k in range(len(ls))]
    gone = defaultdict(set)
    for n, (i, k) in enumerate(places):
        for j, m in places[n + 1 :]:
            a, b = lines_of[i], lines_of[j]
            if a[k] != b[m] or (k and m and (i, k - 1) != (j, m) and a[k - 1] == b[m - 1]):
                continue
            size = 0
            while k + size < len(a) and m + size < len(b) and a[k + size] == b[m + size]:
                size += 1
            sizes = [len(x.split()) for x in a[k : k + size]]
            if sum(x > 0 for x in sizes) >= 2 and sum(sizes) >= min_words or max(sizes) >= long_line:
                gone[j] |= set(range(m, m + size))
    return gone


def test_line_dedup_against_all_pairs_of_runs(spark):
    rng = np.random.default_rng(12)
    made = _lines_of_sizes(13)
    planted = [made(*[9] * n) for n in (2, 3, 4, 6, 10) for _ in range(6)] + [made(6, 6) for _ in range(4)] + [made(2, 3) for _ in range(3)] + [made(55)]
    rows, at = [], 0
    for k in range(60):
        p = planted[k % len(planted)] if k < 2 * len(planted) else []
        at += 1
        rows.append((at, "\n".join([*made(*rng.integers(1, 12, 3)), *p, *made(*rng.integers(1, 12, 3))])))
    rows += [(1000 + k, "\n".join([*made(7), *p, *made(5)])) for k, p in enumerate(planted)]
    gone = runs_by_hand(rows)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    for i, t in rows:
        assert got[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), i
    whole = [not set(p) & set(got[1000 + k].split("\n")) for k, p in enumerate(planted)]
    assert whole == [sum(len(x.split()) for x in p) >= 8 for p in planted]


def test_line_dedup_clashing_columns(spark):
    t = "\n".join(_lines_of_sizes(3)(9, 9, 9))
    docs = docs_of(spark, [(1, t, "en", "a"), (2, t, "en", "a")]).withColumns({c: F.lit(c) for c in ("_gone", "_of", "_id", "_text", "hash", "first", "line")})
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[2]["text"] == "" and got[1]["text"] == t and all(got[2][c] == c for c in ("_gone", "_of", "_id", "_text", "hash", "first", "line"))


def test_line_dedup_copies_with_mixed_line_lengths(spark):
    made = _lines_of_sizes(5)
    copied = ["\n".join(made(*sizes)) for sizes in ((4, 47, 75, 43, 95, 11, 49, 130), (60, 1, 70, 20, 80), (30, 60, 14), (90, 12), (3, 52, 3))]
    copied += ["\n" + "\n\n".join(made(60, 2, 70, 55, 55)) + "\n\n", "\n".join(made(*[1] * 14, 51, *[1] * 14))]
    kept = "\n".join(made(5, 60, 7))
    rows = [(k, t, "en", "a") for k, t in enumerate(copied)] + [(100 + k, t, "en", "a") for k, t in enumerate(copied)] + [(200, kept, "en", "a")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(spark, rows)).collect()}
    for k, t in enumerate(copied):
        assert got[k]["text"] == t
        assert got[100 + k]["text"] == "" and got[100 + k]["n_removed_lines"] == t.count("\n") + 1, (k, got[100 + k]["text"])
    assert got[200]["text"] == kept


def test_line_dedup_short_passages_in_other_surroundings(spark):
    made = _lines_of_sizes(6)
    passages = [made(*sizes) for sizes in [(30, 25)] * 12 + [(8, 7)] * 6 + [(20, 20, 15)] * 6]
    around = lambda k, p: "\n".join([*made(9, 12), *p, *made(11, 8)])
    rows = [(100 * n + k, around(k, p), "en", "a") for n in (0, 1) for k, p in enumerate(passages)]
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.dedup_lines(docs_of(spark, rows)).collect()}
    for k, p in enumerate(passages):
        assert got[k] == rows[k][1].split("\n")
        assert got[100 + k] == [x for x in rows[len(passages) + k][1].split("\n") if x not in p], k


# ---- MinHash


def brute_components(rows, n, percent=80):
    sets, first, par = {}, {}, {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        w = (t or "").encode().translate(minhash._TO_SPACE).split()
        par[i] = i
        if w:
            sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if len(w) >= n else {tuple(w)}
    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    par[max(x, y)] = min(x, y)
    del first
    return {i: find(i) for i in par}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n", [4, 5])
def test_minhash_brute_force(spark, n):
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(3000)]
    base = [list(rng.choice(vocab, 120)) for _ in range(4)]
    rows = []
    for i in range(160):
        w = list(base[i % 4])
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(vocab))
        rows.append((i, " ".join(w)))
    rows += [(300, " ".join(base[0]).upper()), (301, "a b"), (302, "A  b\n"), (303, "a b c"), (304, None), (305, ""), (306, LONG), (307, LONG + " tail"), (307, LONG + " tail")]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in [*rows, (None, "a b")]]).withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, n=n).collect()}
    comp, size = brute_components(rows, n)
    assert {i: got[i]["component_id"] for i in comp} == comp
    assert {i: got[i]["n_shingles"] for i in size} == size and got[304]["n_shingles"] == 0
    assert all(got[i]["kept"] == (comp[i] == i) for i in comp) and got[None]["kept"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_min_max_values_estimate_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3200], rng.integers(0, 2**63, 800).astype(np.uint64)])
    m, f = minhash._permutations(300)
    same = (minhash.min_max_signature(a, m, f) == minhash.min_max_signature(b, m, f)).mean()
    assert abs(same - 3200 / 4800) < 0.06


# ---- tokens


def test_tokens_round_trip_and_parity(spark):
    import sentencepiece

    data = open(MODEL, "rb").read()
    truth = sentencepiece.SentencePieceProcessor(model_proto=data)
    docs = docs_of(spark, HARD + [(20, "  spaces   and\ttabs\r\n", "en", "a"), (21, "x" * 5000, "en", "a")]).withColumn("n_tokens", F.lit("clash"))
    got = pieces.encode_decode(docs, data).collect()
    assert len(got) == len(HARD) + 2
    for r in got:
        if r["text"] is None:
            assert r["token_ids"] is None and r["n_tokens"] is None and r["decoded_ok"] is None
        else:
            assert r["token_ids"] == truth.encode(r["text"]) and r["n_tokens"] == len(r["token_ids"]) and r["decoded_ok"]
    assert pieces.encode_decode(docs.limit(0), data).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_codec_parity(text):
    import sentencepiece

    data = open(MODEL, "rb").read()
    global _TRUTH
    _TRUTH = globals().get("_TRUTH") or sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = pieces.load(data)
    text = text.encode("utf-8", "ignore").decode()
    packed = codec.encode([text])[0]
    assert np.frombuffer(packed, np.int32).tolist() == _TRUTH.encode(text)


def model_of(vocab, kind, remove_extra, unknown=None):
    """A model file by hand."""
    import struct

    def field(n, wire, payload):
        head = bytes([n << 3 | wire]) if n < 16 else bytes([(n << 3 | wire) & 127 | 128, n >> 4])
        return head + (bytes([len(payload)]) + payload if wire == 2 else payload)

    piece = lambda text, score, kind=1: field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    trainer = field(3, 0, bytes([kind])) + (field(44, 2, unknown.encode()) if unknown else b"")
    return b"".join(piece(*p) for p in vocab) + field(2, 2, trainer) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, bytes([remove_extra])))


VOCAB = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁a", -1.0, 1), ("b", -1.5, 1), ("▁ab", -2.0, 1), ("▁", -3.0, 1), ("a", -3.5, 1), ("<", -4.0, 1), ("s", -4.5, 1), (">", -5.0, 1)]
USER = [("<u>", 0.0, 4), ("ba", 0.0, 4), ("baa", 0.0, 4), ("sss", -1.0, 5)]


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("vocab", [VOCAB, VOCAB + USER])
@pytest.mark.parametrize("remove_extra", [0, 1])
def test_models_by_hand_have_parity(kind, vocab, remove_extra):
    import sentencepiece

    data = model_of(vocab, kind, remove_extra)
    m = pieces.parse_model(data)
    assert (m.model_type, m.remove_extra, len(m.pieces)) == (kind, bool(remove_extra), len(vocab))
    codec, truth = pieces.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in ("ab", "a b", "  ab   ba ", "abab", "a<s>b", "zab qq b", "q", "q a", "<unk>", "</s>", "a<u>b baab", "<u>", "<u>a ba <u><u>", "ssss", "", " "):
        packed = codec.encode([t])[0]
        ids = np.frombuffer(packed, np.int32).tolist()
        assert ids == truth.encode(t), t
        assert codec.decode([packed])[0] == truth.decode(ids), t


def test_unknown_text_of_the_model():
    import sentencepiece

    data = model_of(VOCAB, pieces.UNIGRAM, 0, "[?]")
    packed = pieces.Codec(data).encode(["azb"])
    assert pieces.Codec(data).decode(packed) == [sentencepiece.SentencePieceProcessor(model_proto=data).decode(np.frombuffer(packed[0], np.int32).tolist())] == ["a[?]b"]


# ---- HTML


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div id="cookie-notice">We use cookies. <button>OK</button></div><div class="content"><h1>Title &amp; more</h1><p>First <b>para</b>&nbsp;with <a href=x>a link</a>.
<p>Second   para\n is &lt;long&gt; enough to be main text, with several words in it.<br>Break<ul><li>one<li>two</ul></div>
<aside><p>Side story that is of no interest.</p></aside><section class="comments"><p>Reader: this is a long comment with very many words in it, more than the article has itself, so it is dense.</p></section>
<form><p>Sign up</p></form><footer>(c) 2020</footer><script>var x = "<p>no</p>";</script></body>"""


def test_html_main_text():
    assert html.extract(PAGE) == "Title & more First para with a link. Second para is <long> enough to be main text, with several words in it. Break one two"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("just &amp; text", "just & text"), ("<p>cut <b>off", "cut off"), ("<", "<"), ("<div><nav><a>x</a></nav></div>", ""), ("<!-- x --><p>a<!-- b -->c</p>", "ac")])
def test_html_hard_pages(page, text):
    assert html.extract(page) == text


ARTICLE = "<h1>Head line</h1>" + "".join(f"<p>Paragraph {i} of the article has a number of words, so that it is long enough to be the main text.</p>" for i in range(12))
ARTICLE_TEXT = "Head line " + " ".join(f"Paragraph {i} of the article has a number of words, so that it is long enough to be the main text." for i in range(12))
NAMES = (
    "content has-sidebar", "post no-comments", "layout-sidebar-right", "share-price-story", "legal-news", "search-result-article", "content-form", "main-with-ads",
    "sidebar", "ad", "comments", "form", "notice",
)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("around", ["div", "section", "form", "aside"])
def test_no_name_loses_the_article(name, around):
    page = f'<html><body><nav><a href=/>Home</a></nav><{around} class="{name}">{ARTICLE}</{around}><div class=ad>Buy now</div><footer>(c) me</footer></body></html>'
    assert html.extract(page) == ARTICLE_TEXT


@pytest.mark.parametrize("name", ["comment-list", "comments", "user-replies"])
def test_long_reader_comments_are_left_out(name):
    readers = "".join(f"<p>Reader {i}: a long comment with very many words in it, denser than the article is itself, and so on and on.</p>" for i in range(40))
    assert html.extract(f"<body><div>{ARTICLE}</div><div class='{name}'>{readers}</div></body>") == ARTICLE_TEXT


def test_half_named_short_and_linked_parts_go():
    page = f'<body><div class="wrap">{ARTICLE}<div class="post-share-box">Share this</div><div class="left-sidebar">' + "<a href=/x>Some other story of the day</a> " * 20 + "</div></div></body>"
    assert html.extract(page) == ARTICLE_TEXT


def density_by_hand(page):
    """The element of the largest density sum, by recursion over a tree of another parser."""
    import math
    import xml.etree.ElementTree as ET

    body = ET.fromstring(page).find("body")
    size = lambda e: len("".join("".join(e.itertext()).split()))
    linked = lambda e: [a for a in e.iter("a")]
    total, links = size(body), sum(size(a) for a in linked(body))

    def density(e):
        c, t = size(e), sum(1 for _ in e.iter()) - 1
        if not c:
            return 0.0
        lc, lt = (c, len(linked(e))) if e.tag == "a" else (sum(size(a) for a in linked(e)), len(linked(e)))
        base = math.log(c / max(c - lc, 1) * lc + links / max(total, 1) * c + math.e)
        ratio = (c / max(lc, 1)) * (max(t, 1) / max(lt, 1))
        return c / max(t, 1) * max(math.log(max(ratio, 1.0)) / math.log(max(base, math.e)), 0.0)

    def best(e):
        own = len("".join(((e.text or "") + "".join(c.tail or "" for c in e)).split()))
        value = sum(density(c) for c in e)
        if own and e.tag in html.BLOCK:
            value = max(value, density(e) * own / size(e))
        return max([(value, e)] + [best(c) for c in e], key=lambda x: x[0])

    return best(body)


def test_density_sums_brute_force():
    rng = np.random.default_rng(9)

    def tree(depth):
        words = lambda: " ".join("w" * int(k) for k in rng.integers(1, 9, rng.integers(1, 25)))
        out = []
        for _ in range(rng.integers(1, 5)):
            out.append(f"<a>{words()}</a>" if rng.random() < 0.25 else f"<p>{words()} <b>{words()}</b></p>" if depth > 2 or rng.random() < 0.4 else f"<div>{tree(depth + 1)}</div>")
        return "".join(out)

    for _ in range(60):
        page = f"<html><body>{tree(0)}</body></html>"
        root = html.parse(page)
        html.select(root)
        body = next(x for x in html._order(root) if x.tag == "body")
        nodes, found = html._best(body)
        value, _ = density_by_hand(page)
        assert abs(found.sum - value) < 1e-9 * max(1, value) and abs(max(x.sum for x in nodes) - value) < 1e-9 * max(1, value)


def test_html_is_read_in_linear_time():
    import time

    def seconds(n):
        start = time.process_time()
        html.extract("<div>" * n + "x" + "</b>" * n)
        html.extract("<table><tr><td><b><td>" + "<i>" * n + "x" + "</b>" * n)
        html.extract("<p><span><li>" * n + "y" * n)
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 14 * seconds(2000) + 0.5


def test_html_deep_and_frame(spark):
    deep = "<div>" * 20000 + "deep text" + "</div>" * 20000
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", deep), (3, "u", deep)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5))
    got = html.extract_main_text(df).collect()
    assert len(got) == 4 and {r["text"] for r in got if r["page_id"] == 3} == {"deep text"}
    assert all(r["n_chars"] == len(r["text"]) for r in got) and html.extract_main_text(df.limit(0)).count() == 0


# ---- toxicity


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioutrnsl"), 5))
    rows, labels = [], []
    for i in range(700):
        bad = i % 5 == 1
        w = [word() for _ in range(int(rng.integers(5, 60)))]
        if bad:
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["grobnik", "vixtard"])))
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, 1, None), (9999, 1, 1)]
    docs = docs_of(spark, [*rows, (5000, None, None, None), (5001, "", "en", "a"), (None, "x", "en", "a"), (5002, LONG, "en", "a")])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, lab, min_share=0.02)).collect()}
    assert len(got) == 704
    import zlib

    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(700))
    right = np.mean([got[i]["predicted"] == int(i % 5 == 1) for i in held])
    assert right > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    only = toxicity.train(docs, lab.where("toxic = 0"))
    assert toxicity.score(docs.limit(3), only).count() == 3 and toxicity.score(docs.limit(0), only).count() == 0




def test_minhash_documents_with_several_texts(spark):
    rng = np.random.default_rng(21)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    a, b, c = words(80), words(80), words(80)
    near = lambda w: " ".join([*w[:40], "changed", *w[41:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, near(a)), (8, near(b)), (3, " ".join(c)), (3, None), (2, near(c)), (2, " ".join(c)), (7, None), (7, "")]
    got = minhash.near_duplicates(docs_of(spark, [(i, t, "en", "s") for i, t in rows]), n=4).collect()
    assert len(got) == len(rows)
    comp = {i: {r["component_id"] for r in got if r["doc_id"] == i} for i, _ in rows}
    assert all(len(x) == 1 for x in comp.values()), comp
    # 5's own text is that of the smaller key: exactly one of 8 and 9 is near it
    own = min((" ".join(a), 9), (" ".join(b), 8), key=lambda x: minhash.xxhash.xxh3_128_digest(minhash.word_hashes(x[0])[1]))[1]
    assert comp[own] == {5} and comp[17 - own] == {17 - own} and comp[7] == {7}
    assert comp[2] == comp[3] == {2}


def test_minhash_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(22)
    base = [f"w{k}" for k in rng.integers(0, 3000, 60)]
    rows = []
    for i in range(250):
        w = list(base)
        for k in rng.choice(60, int(rng.integers(1, 5)), replace=False):
            w[int(k)] = f"x{rng.integers(0, 9000)}"
        rows.append((i, " ".join(w)))
    comp, _ = brute_components(rows, 4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, [(i, t, "en", "s") for i, t in rows]), n=4).collect()}
    assert got == comp


def test_blocks_follow_tasks_and_bytes():
    assert vectors.rows_of_block(51_282, 64, 6) == 7326 and vectors.rows_of_block(100, 64, 6) == 64
    assert vectors.rows_of_block(10**9, 768, 4000) == vectors.BLOCK_BYTES // (8 * 768)


def test_toxicity_brute_force(spark):
    """Features, ratios and scores by plain loops; the weights by another optimiser."""
    import math
    import zlib

    rng = np.random.default_rng(31)
    word = lambda a: "".join(rng.choice(list(a), 4))
    rows = [(i, " ".join([word("aeioutrn") for _ in range(12)] + (["grobnik"] if i % 4 == 0 and rng.random() < 0.9 else []))) for i in range(160)]
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), min_share=0.05, penalty=0.01, rounds=4000)
    train = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]

    def bucket(gram):  # the published fold: polynomial over code points, order mixed in, top bits of a multiply-xorshift
        m = 2**64 - 1
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 0x100000001B3 + ord(c)) & m
        x = ((h ^ len(gram)) * 0x9E3779B97F4A7C15) & m
        return (((x ^ (x >> 32)) * 0x9E3779B97F4A7C15) & m) >> (64 - toxicity.BITS)

    def held(t):
        s = f" {t.lower()} "
        return {bucket(s[k : k + n]) for n in (3, 4, 5, 6) for k in range(len(s) - n + 1)}

    sets = [held(t) for t, _ in train]
    y = np.array([y for _, y in train], float)
    pos, neg = int(y.sum()), int((1 - y).sum())
    p, n = Counter(b for s, v in zip(sets, y, strict=True) if v for b in s), Counter(b for s, v in zip(sets, y, strict=True) if not v for b in s)
    wanted = sorted(b for b, c in p.items() if c >= max(3, math.ceil(0.05 * pos)))
    assert model.buckets.tolist() == wanted
    ratio = np.array([math.log((p[b] + 1) / (pos + 2)) - math.log((n[b] + 1) / (neg + 2)) for b in wanted])
    x = np.array([[float(b in s) for b in wanted] for s in sets]) * ratio
    w, bias = np.zeros(len(wanted)), 0.0
    for _ in range(60):  # Newton's method
        q = 1 / (1 + np.exp(-(x @ w + bias)))
        z = np.column_stack([x, np.ones(len(x))])
        g = np.append(x.T @ (q - y) / len(y) + 0.01 * w, (q - y).mean())
        hess = (z * (q * (1 - q))[:, None]).T @ z / len(y) + np.diag([0.01] * len(w) + [1e-12])
        step = np.linalg.solve(hess, g)
        w, bias = w - step[:-1], bias - step[-1]
    for r in toxicity.score(docs, model).collect():
        s = held(rows[r["doc_id"]][1])
        want = 1 / (1 + math.exp(-(bias + sum(a * b for a, b, c in zip(w, ratio, wanted, strict=True) if c in s))))
        assert abs(r["score"] - want) < 2e-3 and r["predicted"] == int(r["score"] >= 0.5)
