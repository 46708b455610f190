"""Spans of revealing terms against plain code, and odd texts of the personal-data operator."""

from __future__ import annotations

import random
import re
import time
from math import log2

import pytest
from pyspark.sql import functions as F

from quillforge.llm import private
from tests.llm.test_operators import brute_spans

RULE = private.Disclosure()
DENSE = re.compile("[々぀-ヿ㐀-䶿一-鿿]{2,}")


def masked(text, spans):
    out = list(text)
    for start, _, _, end in spans:
        out[start:end] = " " * (end - start)
    return "".join(out)


def terms_at(text):
    """(term, start, end) of runs of two or more letters and digits, and of pairs of dense scripts."""
    out = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]{2,}", text)]
    for m in DENSE.finditer(text):
        out += [(text[i : i + 2], i, i + 2) for i in range(m.start(), m.end() - 1)]
    return out


def brute(texts):
    """Text -> all spans, by the formula in the module's head; near contexts (support 3) aren't modelled."""
    texts = sorted(set(texts))
    base = {t: brute_spans(t) for t in texts}
    terms = {t: {x for x, _, _ in terms_at(masked(t, base[t]))} for t in texts}
    near = lambda t, s: (t[max(0, s[0] - 64) : s[0]], t[s[3] : s[3] + 64])
    sights = {}
    for t in texts:
        for s in base[t]:
            sights.setdefault((s[2], t[s[0] : s[3]].lower()), {}).setdefault(t, set()).add(near(t, s))
    flagged = {t: {} for t in texts}
    for entity, held in sights.items():
        of = {t: min(v) for t, v in held.items()}
        n_e, d_e = len(set(of.values())), len(of)
        n = len(texts) - d_e + n_e
        if n <= n_e:
            continue
        for term in set().union(*(terms[t] for t in held)):
            with_ = [t for t in held if term in terms[t]]
            n_te, d_te = len({of[t] for t in with_}), len(with_)
            n_t = sum(term in terms[t] for t in texts) - d_te + n_te
            code = len(term) >= RULE.code_chars and re.search(r"\d", term)
            share = log2(n_te * n / (n_t * n_e)) / log2(n / n_e)
            words = share * n_te / (n_te + RULE.discount) if n_te > 1 and n_e > 1 else 0
            if max(words, share if code else 0) >= RULE.generalise:
                for t in with_:
                    flagged[t][term] = max(flagged[t].get(term, 0), words, share if code else 0)
    out = {}
    for t in texts:
        extra = {}
        for term, a, b in terms_at(masked(t, base[t])):
            if term in flagged[t]:
                extra.setdefault("term" if flagged[t][term] >= RULE.remove else "name", set()).add((a, b))
        spans = [(a, n, k, b) for a, n, k, b in base[t]]
        for kind, places in extra.items():
            merged = []
            for a, b in sorted(places):
                if merged and a < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            spans += [(a, 4 if kind == "term" else 5, kind, b) for a, b in merged]
        out[t] = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_spans_equal_plain_counts(spark, seed):
    rng = random.Random(seed)
    people = [(f"p{i}@x.org", f"name{'abcdefgh'[i]}", f"key{i:02d}abcdef9012") for i in range(6)]
    common = ["the", "of", "mail", "and", "house", "é", "日本語", "x9"]
    texts = ["", None, "no value here", "12 34"]
    for _ in range(60):
        mail, name, key = rng.choice(people)
        words = [rng.choice(common) for _ in range(rng.randint(3, 9))] + [mail] * rng.randint(0, 2)
        words += [name] * (rng.random() < 0.7) + [key] * (rng.random() < 0.3) + ["10.0.0.%d" % rng.randint(1, 40)] * (rng.random() < 0.5) + ["張偉明"] * (mail[1] == "3")
        rng.shuffle(words)
        texts.append(" ".join(words) + rng.choice((".", " https://a/b", " " + str(rng.randint(0, 3)))))
    texts += [f"plain words {i} name{'abcdefgh'[i % 8]}" for i in range(3)] + rng.choices(texts, k=10)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__base", F.lit(1)).withColumn("digest", F.lit("d")).repartition(3)
    # Near contexts only tell removed from generalised; with an unreachable support they stay out of it.
    rule = private.Disclosure(support=10**6)
    got = {r.doc_id: r.spans for r in private.find_personal_data(df, rule).collect()}
    want = brute([t or "" for t in texts])
    for i, t in rows:
        assert got[i] == want[t or ""], (t, got[i], want[t or ""])
    assert any("term:" in s for s in want.values()) and any("name:" in s for s in want.values())


def test_a_code_seen_once_goes_and_one_that_is_common_stays(spark):
    rows = [(1, "token abcdef0123456789 of u1@x.org"), (2, "token 1234567890ab of u2@x.org")] + [(10 + i, f"release 1234567890ab number {i}") for i in range(30)] + [(50, "secret ffffeeee00001111 without a value")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).withColumn("__parts", F.lit(1)).withColumn("__null", F.lit(2))
    out = private.sanitise(df)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == df.columns
    assert got[1] == "token [TERM] of [EMAIL]" and got[2] == "token 1234567890ab of [EMAIL]" and got[50] == "secret ffffeeee00001111 without a value"


def test_empty_tables_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert private.sanitise(empty).collect() == [] and private.find_personal_data(empty).collect() == []
    rows = [(1, "call u@x.org 1.2.3.4", 0)] * 3 + [(None, "call u@x.org 1.2.3.4", 0), (None, None, 0), (2, "", 0)]
    got = sorted((str(r.doc_id), str(r.text), str(r.n_chars)) for r in private.sanitise(spark.createDataFrame(rows, empty.schema)).collect())
    assert got == sorted([("1", "call [EMAIL] [IP]", "17")] * 3 + [("None", "call [EMAIL] [IP]", "17"), ("None", "None", "None"), ("2", "", "0")])


def test_many_places_in_a_long_text(spark):
    """Prefix sums in chunks: positions are right, and a text with very many places takes no quadratic time."""
    text = "".join(f"ü{i % 256}.1.2.3;" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, "a@b.c")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in private.find_personal_data(df).collect()}
    first = [s for s in got[1].spans.split(",") if s.startswith("ip")]
    assert got[1].n_ip == 60_000 and first == [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+\.1\.2\.3", text)]
    out = {r.doc_id: r.text for r in private.sanitise(df).collect()}
    assert out[1] == "ü[IP];" * 60_000 and out[2] == "[EMAIL]"
    assert time.time() - began < 120
