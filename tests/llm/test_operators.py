"""Each operator against brute force, an exact round trip, and the awkward cases: nulls, empty and very
long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.llm import audio, chat, components, dedup, language, license_rules, licenses, packing, pieces, private, queries, shingles, topk, warc
from quillforge.llm.common import Scratch
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 40_000


def docs(spark, texts, **extra):
    """doc_id and text, with columns whose names operators use inside."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("x").alias("n"), F.lit(1).alias("node"), F.lit(2).alias("base"), F.lit(3).alias("spans"), F.lit(4).alias("key"), F.lit(5).alias("score"), F.lit(6).alias("digest"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


# 1. near-duplicates


def shingle_set(text, k=4):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset({tuple(words)} if words else ())


def brute_components(rows):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    shared = [word() for _ in range(30)]
    texts = [None, "", " \n\t", "One", "one", "a b", "A  B", "a b c d", LONG, LONG + " x", "\xa0", "é b c d e"]
    for _ in range(6):
        base = [word() for _ in range(rng.choice((8, 20, 60, 150)))]
        for _ in range(rng.randint(2, 7)):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(shared + [word() for _ in range(rng.randint(2, 12))]) for _ in range(25)]  # a passage that makes no copy
    texts += rng.choices(texts, k=8)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = list(enumerate(near_copies(seed)))
    got = dedup.near_duplicates(docs(spark, [t for _, t in rows]).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_components(rows)


def test_near_duplicates_of_nothing_repeated_rows_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.near_duplicates(empty).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "q r s t"), (2, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True)]
    assert [r.doc_id for r in dedup.drop_near_duplicates(df.where("doc_id is not null")).orderBy("doc_id").collect()] == [1, 2]


def test_star_misses_are_found(spark):
    """A chain whose ends aren't linked, and a prefix token that links across components."""
    base = [f"w{i}" for i in range(103)]
    texts = [" ".join(base[:i] + [f"x{i}_{j}" for j in range(2)] + base[i:]) for i in range(5, 100, 6)]
    got = dedup.near_duplicates(docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_components(list(enumerate(texts)))


def test_bands_are_those_of_equal_sets_and_similar_sets_meet():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 10, 40, 300, 3000):
        missed = 0
        for _ in range(30):
            extra = n // 10
            shared = rng.integers(0, 2**63, n - extra, dtype=np.uint64)
            a, b = (np.unique(np.concatenate((shared, rng.integers(0, 2**63, extra, dtype=np.uint64)))) for _ in range(2))
            assert (shingles.bands(a) == shingles.bands(a.copy())).all()
            missed += not set(shingles.bands(a)) & set(shingles.bands(b))
        assert missed == 0


def test_components_of_chains_and_stars(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("900", f"9{i:02d}") for i in range(1, 30)] + [("800", "800")]
    got = components.components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark)).collect()
    want = {f"{i:03d}": "000" for i in range(1, 41)} | {f"9{i:02d}": "900" for i in range(1, 30)}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


# 2. licences


def test_licences_base_phrases(spark):
    rng = random.Random(4)
    bits = ["GNU", "general", "public", "license", "Apache", "cc", "BY", "mit", "x", "é", "\n", "-", ", ", " ", "licensecc"]
    texts = [None, "", LONG + " MIT License", "mit license mit license"] + ["".join(rng.choice(bits) + rng.choice((" ", "", "_")) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        found = [(k, label) for k in range(len(words)) for p, label in licenses.BASE.items() if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and 0 <= r.score <= 1
        assert {x for _, x in found} <= set(r.labels.split(","))


def test_licence_rules_priority_and_containment():
    assert len(license_rules.RULES) >= 200 and all(r.gate for r in license_rules.RULES)
    labels = lambda t: licenses.scan(t.encode())[5]
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc-4.0"
    assert labels("SPDX-License-Identifier: Apache-2.0") == "apache-2.0"
    assert labels("GNU Lesser General Public License, version 2.1") == "lgpl-2.1"
    assert labels("the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("nothing here") == ""
    spans = [(a, b) for _, a, b in licenses.scan(b"MIT License and the MIT License, Apache License 2.0")[7]]
    assert not any(a <= c and d <= b for (a, b), (c, d) in combinations(spans, 2))


# 3. audio


def test_audio_round_trip(spark):
    texts = [None, "", "x" * 63, "x" * 64, "é" * 5000, LONG[:100_000], "same", "same"]
    got = {r.doc_id: r for r in audio.media_features(docs(spark, texts)).collect()}
    media = {r.doc_id: bytes(r.media) for r in audio.to_media(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i]
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
    assert got[6].feature == got[7].feature and got[6].media_sha256 == got[7].media_sha256


def test_audio_reader_resynchronises():
    payload = random.Random(1).randbytes(5000)
    media = audio.encode(payload)
    clean = audio.parse(media)
    assert clean.vbr["frames"] == len(clean.offsets) and clean.vbr["kind"] == "Xing" and clean.bad_checksums == clean.skipped_bytes == 0
    assert clean.samples == 1152 * len(clean.offsets) and clean.seek(1152) == clean.offsets[1] and clean.seek(10**9) is None
    body = media[clean.offsets[0] :]
    noisy = audio.parse(b"\xff\xfa junk \xff" * 9 + body[:1920] + b"noise" + body[1920:] + b"TAG" + bytes(125))
    assert len(noisy.offsets) == len(clean.offsets) and noisy.skipped_bytes == 9 * 9 + 5 and "ID3v1" in noisy.tags
    broken = bytearray(media)
    broken[clean.offsets[0] + 10] ^= 1
    assert audio.parse(bytes(broken)).bad_checksums == 1
    for bad in (bytes(broken), media[:-1000], b""):
        with pytest.raises(ValueError):
            audio.decode(bad)
    for size in (0, 1, 31, 32, 936, 937, 938, 2000):
        assert audio.decode(audio.encode(b"\xff\xfb" * size))[0] == b"\xff\xfb" * size


# 4. top-k


def brute_top(rows, queries_, k):
    out = []
    for q, v in rows:
        if q in queries_:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 120])
def test_top_k_equals_brute_force(spark, n):
    rng = random.Random(n)
    floats = [(i, [rng.choice((-0.5, 0.25, rng.gauss(0, 1))) for _ in range(6)]) for i in range(n)] + [(1000 + i, [0.5] * 6) for i in range(4 if n > 3 else 0)]
    bad = [(5000, None), (5001, [None] * 6), (5002, [float("nan")] * 6), (5003, [float("inf")] * 6)]
    df = spark.createDataFrame(floats + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("s"))
    v = topk.quantised(df)
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 5 = 0"), 5, block=16).collect())
    rows = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in floats]
    assert got == brute_top(rows, {i for i, _ in rows if i % 5 == 0}, 5)


def test_top_k_of_nothing_and_pruning(spark):
    v = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).collect() == []
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 300, (8, 16))
    block = np.floor(np.repeat(centre, 200, axis=0) + rng.normal(0, 5, (1600, 16))).astype(np.int64)
    p = topk.Pivots(np.empty((0, 0)), 16, int((block**2).sum(axis=1).max()))
    p.points = topk._spread(p.lifted(block, query=False), 16)
    q, ids = block[:5], np.arange(1600)
    *_, tried = topk.best_of_block(q, ids[:5], p.distances(p.lifted(q, query=True)), block, ids, p.distances(p.lifted(block, query=False)), float(p.norm), 5)
    assert tried < 5 * 1600


# 5. languages


def test_language_accuracy_and_odd_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (None, "the and", "en"), (5, LONG, "la"), (6, "the and", None), (6, "the and", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    found = {(r.doc_id, r.lang_pred) for r in language.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= found
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {None, 5, 6}
    assert language.identify(odd.where("false")).collect() == []
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_profile_equals_plain_counts(spark):
    rows = [(1, "Ab ab. Éa", "x"), (2, "ba", "x"), (3, "zz", "y")]
    p = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5)
    code = lambda g: sum((ord(c) + 1 if c != "_" else 1) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    count = {}
    for text in ("_ab_ab_éa_", "_ba_"):
        for n in (1, 2, 3):
            for i in range(len(text) - n + 1):
                g = text[i : i + n]
                if g != "_" and "_" not in g[1:-1]:
                    count[g] = count.get(g, 0) + 1
    best = sorted(count, key=lambda g: (-count[g], code(g)))[:5]
    ranks = {int(c): int(r) for c, r in zip(p.codes, p.ranks[:, p.languages.index("x")]) if r >= 0}
    assert ranks == {code(g): i for i, g in enumerate(best)}


# 6. chats


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    rng = random.Random(6)
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", "be kind"), (2, 0, None, None), (3, 0, "assistant", ""), (None, 1, "user", "x"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, None, "ro: le\n", "t")]
    rows += [(9, i, ("system" if i == 0 else rng.choice(("user", "assistant"))), "word " * rng.choice((1, 30, 200)) + rng.choice(("", "\n#", "\\", " </turn>\n"))) for i in range(120)]
    rows += [(10, 0, "system", "s"), (10, 1, "assistant", LONG[:60_000]), (10, 2, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(5)
    windows = chat.format_conversations(df, queries.tokenizer_path("byte_bpe_50k.json"), budget=400, history=100)
    got = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    want: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nine = sorted((r for r in windows.collect() if r.conv_id == 9), key=lambda r: r.window)
    assert len(nine) > 5 and sum(w.n_turns for w in nine) == 120 and [w.first_turn for w in nine] == list(np.cumsum([0] + [w.n_turns for w in nine[:-1]]))
    for w in nine:
        turns = chat.parse(w.formatted)
        assert turns[0][0] == "system" and len(turns) == w.n_repeated + w.n_turns
        assert w.n_tokens <= 400 or w.n_turns == 1
    assert chat.conversation_digests(chat.format_conversations(df.where("false"), queries.tokenizer_path("byte_bpe_50k.json"))).collect() == []


# 7. pieces


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public model read as a unigram one; the scores of runs of spaces are beyond what float32 adds exactly."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40_000.0)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path), SentencePieceProcessor(model_file=str(path))


def test_pieces_equal_the_library(unigram):
    path, library = unigram
    coder, rng = pieces.PieceCoder(path), random.Random(7)
    bits = ["a", "th", "the ", "  ", " ", "\n", "é", "日", "🙂", "▁", "#", "1", "ing", "Ñ", "\x00x", "\t", "<s>", "<0x41>"]
    for t in ["", " ", "▁▁", *["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]]:
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t)
        assert coder.decode(ids) == t.replace("▁", " ")


def test_piece_queries(spark):
    texts = [None, "", "a b", "a b", LONG[:50_000], "日本\n\n x"]
    path = queries.tokenizer_path("piece_bpe_32k.model")
    df = docs(spark, texts)
    assert all(r.round_trip for r in pieces.piece_digest(df, path).collect())
    encoded = pieces.encode_pieces(df, path)
    assert {r.doc_id: r.text for r in pieces.decode_pieces(encoded, path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.piece_digest(df.where("false"), path).collect() == []


# 8. WARC


@pytest.mark.parametrize("segment", [300, 16 << 10])
def test_warc_round_trip(spark, segment):
    big, rng = "é" * 700, random.Random(8)
    rows = [(1, "http://a", big), (2, None, big), (3, "u\r\nx", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (10, "u", "y" * 1000), (10, "u", "y" * 1000), (None, "u", big), (11, "u", rng.choice("ab") * 70_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit("d")).repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(df, segment).collect())
    best: dict = {}
    for page, _, h in rows:
        if len((h or "").encode()) >= 1000 and page is not None:
            best[h] = max(best.get(h, page), page)
    want = []
    for page, _, h in rows:
        raw = (h or "").encode()
        top = best.get(h) if len(raw) >= 1000 else None
        again = top is not None and top != page
        want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want)
    assert warc.warc_round_trip(df.where("false")).collect() == []


def test_warc_reader_checks():
    assert warc.unchunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000 and warc.unchunked(b"0\r\n\r\n") == b""
    for bad in (b"3\r\nabc", b"2\r\nabc\r\n0\r\n\r\n", b"0\r\n\r\nx", b"x"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    writer = warc.Writer(0, segment_bytes=100, archive_bytes=150)
    archives = [*writer.page(1, "u", b"z" * 400, hashlib.sha1(b"z" * 400).hexdigest(), None, False), *writer.close()]
    parts = [(h, b) for a in archives for h, b in warc.records(a) if h["warc-type"] != "warcinfo"]
    assert len(archives) > 2 and [h["warc-type"] for h, _ in parts[:2]] == ["response", "continuation"]
    assert warc.body_of(b"".join(b for _, b in parts)) == b"z" * 400 and int(parts[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in parts)
    with pytest.raises(ValueError):
        list(warc.records(archives[0][:-1] + b"x"))


def test_warc_reader_fails_on_a_missing_segment(spark):
    writer = warc.Writer(0, segment_bytes=100, archive_bytes=100)
    archives = list(writer.page(1, "u", b"z" * 400, hashlib.sha1(b"z" * 400).hexdigest(), None, False))
    df = spark.createDataFrame([(bytearray(a),) for a in archives[:2] + archives[3:]], "content binary")
    with pytest.raises(Exception, match="segment is missing"):
        warc.read_archives(df).collect()


# 9. packing


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    texts = [None, "", "a", "a", "It's <|endoftext|> É! \x1c.", LONG[:60_000], *["some words here " * random.Random(i).randint(1, 400) for i in range(60)]]
    got = packing.pack_documents(docs(spark, texts).repartition(2), queries.tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        mine = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in mine) == ids and {r.doc_tokens for r in mine} == {len(ids) // 4}
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine[:-1]]]).tolist()
    for pieces_ in by_sequence.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack_documents(docs(spark, texts).where("false"), queries.tokenizer_path("word_bpe_49k.json")).collect() == []


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path("word_bpe_49k.json"), random.Random(9)
    tokenizer, coder = Tokenizer.from_file(path), packing.WordIds(path, most=50)
    bits = ["a", "'s", "!", "\x1c", " ", "\n", "\t", "é", "́", "İ", "Σ", "1", "<|endoftext|>", "<|endof", "text|>", "\x00", "\x85", "日", "🙂", "LL", "|", "ß"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(coder(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_differencing_is_balanced_and_windows_grow():
    rng = random.Random(10)
    sizes = [rng.randint(1, 512) for _ in range(900)]
    parts = packing.windows(sizes, 4096)
    assert sorted(i for p in parts for i in p) == list(range(900))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) <= 4096 and sum(sums) / len(sums) > 0.97 * 4096
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]  # the textbook example
    assert len(packing.windows([3000, 3000, 2000], 4096)) == 3 and packing.windows([], 4096) == []


# 10. personal data


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if not i % 2 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def holds(kind, match):
    d = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in match.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute_spans(text):
    return sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if holds(k, m.group()))


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(11)
    card = lambda n: next(x for x in (str(rng.randrange(10 ** (n - 1), 10**n)) for _ in iter(int, 1)) if luhn(x))
    bits = ["a@b.c", "x.y@z-1.co.uk", "@", "1.2.3.4", "256.1.1.1", "001.2.3.255", "+1 (386) 555-3733", "+12", "-", " ", "  ", ".", "_", "é", "🙂", "a", "7", "%"]
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "9" * 3000, "1 " * 3000, "a" * 50_000 + "@", "+1" + " " * 500, LONG[:200_000] + " a@b.c"]
    texts += ["".join(rng.choice(bits) if rng.random() < 0.85 else rng.choice((card(16), " ".join(re.findall(".{4}", card(16))), card(12))) for _ in range(rng.randint(1, 20))) for _ in range(800)]
    df = docs(spark, texts).withColumn("removed", F.lit(1))
    got = {r.doc_id: r for r in private.find_personal_data(df).collect()}
    for i, t in enumerate(texts):
        want, r = brute_spans(t), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[2] == k for w in want) for k in PATTERNS]
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(filter(None, r.spans.split(",")))
    assert private.find_personal_data(df.where("false")).collect() == []


def test_revealing_terms_are_removed_where_the_entity_is(spark):
    rows = [(1, "see kari nordvik mail kari.n@x.org today", 5), (2, "also Nordvik uses kari.n@x.org often", 5), (3, "from nordvik: kari.n@x.org bye", 6), (4, "nordvik here again kari.n@x.org yes", 6), (5, "nordvik alone", 3), (6, None, 0), (7, "7" * 20, 9)]
    rows += [(10 + i, f"other word{i} text mail u{i}@x.org today", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("base", F.lit("b")).withColumn("spans", F.lit("s"))
    got = {r.doc_id: r for r in private.sanitise(df).collect()}
    assert {(r.base, r.spans) for r in got.values()} == {("b", "s")}
    assert got[1].text == "see kari [TERM] mail [EMAIL] today" and got[1].n_chars == len(got[1].text)
    assert got[3].text == "from [TERM]: [EMAIL] bye" and got[5].text == "nordvik alone" and got[6].text is None and got[7].text == "7" * 20
    assert got[10].text == "other word0 text mail [EMAIL] today"
    copies = spark.createDataFrame([(i, "call Nordvik at kari.n@x.org now", 1) for i in range(50)] + rows[7:], "doc_id long, text string, n_chars long")
    assert "[TERM]" not in private.sanitise(copies).where("doc_id = 1").first().text  # copies of one context prove nothing


def test_revealing_shares_equal_the_formula(spark):
    from math import log2

    rng = random.Random(12)
    rows = [("email:a", f"{rng.choice(('kari', 'ola', 'per'))} x{i}x word", "") for i in range(30)] + [("ip:1", f"kari y{i} word", "") for i in range(4)] + [(f"e{i}", f"word z{i}", "") for i in range(30)]
    places = spark.createDataFrame([("d", *r) for r in rows], "digest string, entity string, before string, after string")
    contexts = [(e, {w for w in re.findall(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])", re.sub(r"^[^\W_]+", "", b))}) for e, b, _ in set(rows)]
    want, n = {}, len(contexts)
    for e in {c[0] for c in contexts}:
        n_e = sum(c[0] == e for c in contexts)
        for t in set().union(*(c[1] for c in contexts)):
            n_te, n_t = sum(c[0] == e and t in c[1] for c in contexts), sum(t in c[1] for c in contexts)
            if n_te >= private.SUPPORT and n > n_e and (share := log2(n_te * n / (n_t * n_e)) / log2(n / n_e)) >= private.GENERALISE:
                want[e, t] = round(share, 9)
    assert {(r.entity, r.term): round(r.share, 9) for r in private.revealing_terms(places).collect()} == want


def test_terms_far_from_the_value_short_ones_and_codes_are_assessed(spark):
    far = " ".join(["filler"] * 40)
    rows = [(i, f"{w} Li owns QX7 and 張偉明, {far} {i} mail kari.n@x.org {w}") for i, w in enumerate(("see", "also"))] + [(10 + i, f"filler word{i} see also owns and mail u{i}@x.org") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r.doc_id: r.text for r in private.sanitise(df).collect()}
    for i, w in enumerate(("see", "also")):
        assert got[i] == f"{w} [NAME] owns [NAME] and [NAME], {far} {i} mail [EMAIL] {w}"
    assert got[10] == "filler word0 see also owns and mail [EMAIL]"


def test_words_that_are_common_without_personal_data_reveal_nothing(spark):
    rows = [(i, f"{w} newsletter nordvik list@x.org {w}") for i, w in enumerate(("one", "two", "three", "four"))]
    rows += [(10 + i, f"the newsletter of place{i}") for i in range(60)] + [(100 + i, "the nordvik copies") for i in range(60)] + [(200, "mail u@x.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in private.sanitise(df).collect()}
    # newsletter stands in 60 other texts, nordvik in one (copies count once).
    assert got[0] == "one newsletter [TERM] [EMAIL] one"
    assert got[10] == "the newsletter of place0" and got[100] == "the nordvik copies"


def test_dropping_decides_by_row_under_null_and_repeated_ids(spark):
    copy, other, third = "a b c d e f g", "q r s t u v w", "k l m n o p i"
    rows = [(1, copy), (7, copy), (7, other), (8, copy), (8, ""), (9, third), (9, third), (None, copy), (None, "one two three four five"), (None, "one two three four five"), (None, "six seven eight nine ten"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))
    out = dedup.drop_near_duplicates(df)
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert out.columns == df.columns
    assert got == sorted((str(d), str(t)) for d, t in [(1, copy), (7, other), (8, ""), (9, third), (None, "one two three four five"), (None, "six seven eight nine ten"), (None, None), (3, "")])


def samples(parsed):
    """Texts that a regex matches: every branch and option once, repeats at their least and one more."""
    out = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "IN":
            more = [chr(x) for o, x in value if str(o) == "LITERAL"]
        elif name == "ANY":
            more = ["x"]
        elif name == "SUBPATTERN":
            more = samples(value[-1])
        elif name == "BRANCH":
            more = [x for b in value[1] for x in samples(b)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            more = [x * n for n in {low, min(high, low + 1)} for x in samples(inner)]
        elif name in ("ASSERT", "ASSERT_NOT"):
            more = [""]
        else:
            raise AssertionError(name)
        out = [a + b for a in out for b in more]
    return out


def test_what_a_licence_rule_matches_passes_its_gate():
    for rule in license_rules.RULES:
        for text in samples(re._parser.parse(rule.regex.pattern.decode())):
            words = licenses.fold(text.encode())
            assert rule.regex.search(b" " + b" ".join(words) + b" "), (rule.label, text)
            assert rule.gate <= set(words), (rule.label, rule.gate, text)


def test_licences_that_gates_or_bounds_hid():
    labels = lambda t: licenses.scan(t.encode())[5]
    assert labels("http://www.boost.org/LICENSE_1_0.txt") == "boost-1.0"
    assert labels('"THE BEER-WARE LICENSE" (Revision 42)') == labels("Beerware License") == "beerware"
    assert labels("BigScience Open RAIL-M") == labels("OpenRAIL-M") == "bigscience-openrail"
    holder = "the University of a Very Long Name " * 5 + "nor the names of its contributors"
    assert labels(f"Neither the name of {holder} may be used to endorse or promote products derived from this software") == "bsd-3-clause"
    licenses.scan(("neither the name of " * 50_000 + "endorse promote products").encode())  # linear
