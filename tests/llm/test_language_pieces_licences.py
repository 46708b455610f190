"""Out-of-place distance, shipped piece scores and suppression of licence detections against plain code; long texts."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.llm import language, licenses, pieces, queries
from quillforge.llm.license_rules import RULES

# 2. licences


def plain_detections(norm, found):
    """Every rule whose gate is there, in order of priority, length, start and order; one inside a taken span goes."""
    hits = [(m.start(), m.end(), r) for r in RULES if r.gate <= found for m in r.regex.finditer(norm)]
    kept = []
    for a, b, r in sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].order)):
        if not any(c <= a and b <= d for c, d, _ in kept):
            kept.append((a, b, r))
    return sorted(kept, key=lambda h: (h[0], h[1], h[2].order))


def test_suppression_equals_plain_code():
    rng = random.Random(1)
    bits = ["mit license", "the mit license", "apache license version 2 0", "licensed under the apache license version 2 0", "gnu lesser general public license", "version 2 1", "or later", "gpl", "v3", "cc by", "nc", "sa", "4 0",
            "spdx license identifier mit", "http www apache org licenses license 2 0", "bsd 3 clause license", "new bsd license", "released under mit licence", "public domain", "word", "x"]
    more = 0
    for _ in range(400):
        words = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 25))).encode().split()
        norm, found = b" " + b" ".join(words) + b" ", set(words)
        want = plain_detections(norm, found)
        assert licenses.detections(norm, licenses._WORDS & found) == want
        got = licenses.scan(b" ".join(words))
        assert got[7] == [(r.label, norm.count(b" ", 0, a) - 1, norm.count(b" ", 0, b)) for a, b, r in want]
        assert got[5] == ",".join(sorted({r.label for _, _, r in want} | set(filter(None, got[4].split(",")))))
        assert got[6] == max([r.relevance / 100 for _, _, r in want] + [0.8] * bool(got[4]), default=0.0)
        more += len(want)
    assert more > 1000


def test_a_text_full_of_mentions_is_linear():
    text = ("MIT License, Apache License 2.0 and GNU General Public License v3; " * 16_000).encode()[: 1 << 20]
    began = time.time()
    words, places, first, last, *_ = licenses.scan(text)
    assert time.time() - began < 6 and places > 40_000 and first == 0 and words - 12 < last < words


def test_licences_of_nothing_and_repeated_rows(spark):
    rows = [(1, "MIT License")] * 2 + [(None, "MIT License"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))
    got = sorted((str(r.doc_id), r.labels, r.first_word) for r in licenses.scan_licenses(df).collect())
    assert [x[:2] for x in got] == [("1", "mit"), ("1", "mit"), ("2", ""), ("None", "mit")] and licenses.scan_licenses(df.where("false")).collect() == []


# 5. languages


def plain_grams(text):
    out, low = {}, "_" + "".join(c if c.isalpha() else "_" for c in text.lower()) + "_"
    while "__" in low:
        low = low.replace("__", "_")
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            g = low[i : i + n]
            if g != "_" and "_" not in g[1:-1]:
                out[g] = out.get(g, 0) + 1
    return out


def code(g):
    return sum((ord(c) + 1 if c != "_" else 1) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))


def plain_rank(counts, most):
    return [g for g in sorted(counts, key=lambda g: (-counts[g], code(g)))][:most]


@pytest.mark.parametrize("most", [1, 2, 3, 7, 250_000])
def test_grams_run_by_run_are_those_of_the_whole(most):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abÉ日 .1-'x") for _ in range(rng.randint(0, 25)))
        codes, n = language.counted(language.gram_runs(text, most))
        want = plain_grams(text)
        assert dict(zip(codes.tolist(), n.tolist())) == ({code(g): k for g, k in want.items()} if any(c.isalpha() for c in text) else {})


def test_predictions_equal_the_plain_distance(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(9001, "12 !", "en"), (9002, None, "fr"), (9003, "zz", None), (9003, "zz", None), (None, "der die das und", "de")], df.schema)
    df = df.unionByName(extra)
    rows = df.collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0
    counts = {}
    for r in rows:
        if not held(r.doc_id) and r.text and r.lang:
            own = counts.setdefault(r.lang, {})
            for g, n in plain_grams(r.text).items():
                own[g] = own.get(g, 0) + n
    profiles = {x: {g: i for i, g in enumerate(plain_rank(c, language.PROFILE))} for x, c in counts.items()}
    want = []
    for r in rows:
        own = plain_rank(plain_grams(r.text), language.DOC_PROFILE) if r.text and any(c.isalpha() for c in r.text) else []
        best = ("und", 0.0)
        if own:
            far = {x: sum(min(language.PROFILE, abs(p[g] - i)) if g in p else language.PROFILE for i, g in enumerate(own)) for x, p in profiles.items()}
            lang = min(sorted(far), key=far.get)
            best = (lang, 1 - far[lang] / (language.PROFILE * len(own)))
        want.append((str(r.doc_id), held(r.doc_id), best[0], round(best[1], 12)))
    got = language.identify(df.withColumn("score", F.lit("x")).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 12)) for r in got) == sorted(want)


def test_many_languages_pass_in_groups(spark, monkeypatch):
    words = ["alpha beta", "gamma delta", "epsilon zeta", "omega psi", "kappa tau"]
    df = spark.createDataFrame([(i * 10 + k, w, f"l{i}") for i, w in enumerate(words) for k in range(6)], "doc_id long, text string, lang string")
    whole = sorted(map(tuple, language.identify(df).collect()))
    groups = language.train_groups(df.where(~language.held_out()), group=2)
    assert [len(g.languages) for g in groups] == [2, 2, 1]
    monkeypatch.setattr(language, "GROUP", 2)
    monkeypatch.setattr(language, "AT_ONCE", 1)
    assert sorted(map(tuple, language.predict(df, groups).join(df.select("doc_id"), "doc_id").select("doc_id", language.held_out(), "lang_pred", "score").collect())) == whole
    kept = language.keep_identified(df.withColumn("__score", F.lit(1)).unionByName(spark.createDataFrame([(None, "12", None, 1)], "doc_id long, text string, lang string, `__score` int")))
    assert kept.count() == 30 and kept.columns == ["doc_id", "text", "lang", "__score"]


# 7. pieces


def plain_best(text, coder, scores):
    """The best score of a segmentation, and the segmentations that have it, by trying all pieces at all places."""
    n = len(text)
    best = [0.0] + [None] * n
    for e in range(1, n + 1):
        for s in range(max(0, e - 40), e):
            piece = text[s:e]
            step = scores.get(piece, coder.unknown if e - s == 1 and piece not in coder.singles else None)
            if step is not None and best[s] is not None and (best[e] is None or best[s] + step > best[e]):
                best[e] = best[s] + step
    return best[n]


def test_the_shipped_scores_decide():
    coder = pieces.piece_coder(queries.tokenizer_path("piece_bpe_32k.model"))
    scores = {p: s for p, s in zip(coder.pieces, coder.scores) if not (p.startswith("<") and p.endswith(">"))}
    rng = random.Random(7)
    bits = ["the ", "ing", "house", " of", "é", "tion", "x", "Q", "日本", "ab", "er", "\n", "1", ", "]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert coder.decode(coder.encode(text)) == text
        own, i = 0.0, 0
        while i < len(ids):
            if ids[i] in coder.high or coder.pieces[ids[i]].startswith("<0x"):
                size = next(k for k in (1, 2, 3, 4) if _is_utf8(bytes(int(coder.pieces[j][3:5], 16) for j in ids[i : i + k])))
                own, i = own + coder.unknown, i + size
            else:
                own, i = own + coder.scores[ids[i]], i + 1
        assert own == pytest.approx(plain_best((" " + text).replace(" ", pieces.SPACE), coder, scores), rel=1e-12)


def _is_utf8(raw):
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_long_runs_without_a_space_are_not_kept():
    coder = pieces.PieceCoder(queries.tokenizer_path("piece_bpe_32k.model"))
    text = "abcdefghij" * 20_000 + " end"
    began = time.time()
    assert coder.decode(coder.encode(text)) == text and coder.encode(text) == coder.encode(text)
    assert time.time() - began < 20 and all(len(c) <= pieces.CACHE_CHARS for c in coder.known)


def test_pieces_of_nothing_and_repeated_rows(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").withColumn("ids", F.lit(1))
    encoded = pieces.encode_pieces(df, path)
    assert sorted((str(r.doc_id), r.text) for r in pieces.decode_pieces(encoded, path).collect()) == [("1", "a b"), ("1", "a b"), ("None", "")]
    assert pieces.encode_pieces(df.where("false"), path).collect() == []
