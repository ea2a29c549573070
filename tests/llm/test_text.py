"""Token counts, encoding, near-duplicates, repetition and licences against libraries and plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from assayer.llm import bpe, components, license_scan, queries, repetition, simhash, token_count
from assayer.llm.base import load
from assayer.llm.vocabulary import read_vocabulary

WEIRD = [
    "", " ", "a<|endoftext|>b <|startoftext|> x", "ΑΣ ΟΔΟΣ Σ", "İstanbul ﬁ Å é", "x\x1cy\x85z q w　", "don't I'LL we'Ve 123 4५६ ½", "日本語テキスト" * 40,
    "😀👩‍👩‍👧 é ́", "\n\n  a \t\t b   ", "a" * 3000, "ab" * 500 + "!?" * 300, "  <|endoftext|>  ", "'s's'S''t ſ K ẞ ǅ", "​zero﻿",
]


def scrambled(n=800):
    rnd = random.Random(5)
    return ["".join(rnd.choice(" \n\tabcdetshénΣ'.,1२🙂\x1f 日ßıİ<|>") for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(queries.tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_token_counts_match_the_library(spark, sf_dir, library):
    plain = library["word_bpe_49k.json"]
    vocabulary = read_vocabulary(queries.tokenizer_path("word_bpe_49k.json"))
    counter = token_count.Counter(vocabulary, token_count.whole_tokens(vocabulary))
    for text in WEIRD + scrambled():
        assert counter.count(text) == len(plain.encode(text, add_special_tokens=False).ids), text
    texts = {r["doc_id"]: r["text"] for r in load(spark, sf_dir, "documents").collect()}
    for r in queries.op2_token_count(spark, sf_dir).collect():
        n = len(plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048)


def every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return ["\n".join(f"a{chr(c)}b {chr(c)}1" for c in points[k : k + 40]) for k in range(0, len(points), 40)]


def test_token_counts_match_over_all_code_points(library):
    vocabulary = read_vocabulary(queries.tokenizer_path("word_bpe_49k.json"))
    counter = token_count.Counter(vocabulary, token_count.whole_tokens(vocabulary))
    texts = every_code_point()
    for text, found in zip(texts, library["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False), strict=True):
        assert counter.count(text) == len(found.ids), hex(ord(text[1]))


def test_encoding_matches_over_all_code_points(library):
    codec = bpe.Codec(read_vocabulary(queries.tokenizer_path("byte_bpe_50k.json")))
    texts = every_code_point()
    for text, found in zip(texts, library["byte_bpe_50k.json"].encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text) == found.ids and codec.decode(found.ids) == text, hex(ord(text[1]))


def test_whole_tokens_are_proven(library):
    vocabulary = read_vocabulary(queries.tokenizer_path("word_bpe_49k.json"))
    whole = token_count.whole_tokens(vocabulary)
    assert len(whole) > 30_000 and "hello" in whole
    merger = token_count.Merger(vocabulary)
    for word in random.Random(2).sample(sorted(whole), 300):
        assert merger.count(word) == 1
    word = "incomprehensibilities" * 9
    assert merger.count(word) == merger._count_long(merger.symbols(word))


def test_counter_forgets_but_stays_right(monkeypatch):
    monkeypatch.setattr(token_count, "MEMORY", 3)
    vocabulary = read_vocabulary(queries.tokenizer_path("word_bpe_49k.json"))
    counter = token_count.Counter(vocabulary, {"the"})
    text = "abcdx efghx ijklx mnopx the abcdx"
    assert counter.count(text) == counter.count(text)
    assert len(counter) <= 5


def test_encoding_matches_the_library_and_comes_back(spark, sf_dir, library):
    plain = library["byte_bpe_50k.json"]
    codec = bpe.Codec(read_vocabulary(queries.tokenizer_path("byte_bpe_50k.json")))
    for text in WEIRD + scrambled():
        ids = plain.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == plain.decode(ids, skip_special_tokens=False)
    rnd = random.Random(3)
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(6)]
        assert codec.decode(ids) == plain.decode(ids, skip_special_tokens=False)
    texts = {r["doc_id"]: r["text"] for r in load(spark, sf_dir, "documents").collect()}
    for r in queries.op3_bpe(spark, sf_dir).collect():
        ids = plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_every_token_encodes_alone():
    codec = bpe.Codec(read_vocabulary(queries.tokenizer_path("byte_bpe_50k.json")))
    assert all(codec.stands_alone(k) for k in range(len(codec.parts)))
    with pytest.raises(ValueError):
        codec.decode([60_000])


def test_encode_then_decode_as_tables(odd_docs, no_docs):
    vocabulary = read_vocabulary(queries.tokenizer_path("byte_bpe_50k.json"))
    ids = bpe.encode(odd_docs, vocabulary)
    back = bpe.decode(ids, vocabulary)
    from assayer.llm.base import pick

    want = Counter((r["doc_id"], r["text"] or "") for r in pick(odd_docs, "doc_id", "text").collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in back.collect()) == want
    assert bpe.round_trip(odd_docs, vocabulary).count() == 12
    assert bpe.round_trip(no_docs, vocabulary).count() == 0
    counted = token_count.count_tokens(odd_docs, read_vocabulary(queries.tokenizer_path("word_bpe_49k.json")), 10)
    assert counted.count() == 12 and counted.where("over_limit").count() >= 2


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest id that each document reaches over fingerprints at most four bits apart."""
    distinct = sorted(set(prints.values()))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for doc, f in prints.items():
        least[find(f)].append(doc)
    return {doc: min(least[find(f)]) for doc, f in prints.items()}


def test_fingerprints_and_components_match_brute_force(spark, sf_dir):
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in load(spark, sf_dir, "documents").collect()}
    expect = classes(prints)
    rows = queries.op6_simhash(spark, sf_dir).collect()
    assert len(rows) == len(prints)
    for r in rows:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == expect[r["doc_id"]]
    assert len(set(expect.values())) < len(expect)


@pytest.mark.parametrize("sampled, full, together", [(64, 32, 2048), (1, 2, 3)])
def test_links_are_complete_and_single(spark, monkeypatch, sampled, full, together):
    for name, value in (("SAMPLED", sampled), ("FULL", full), ("TOGETHER", together)):
        monkeypatch.setattr(simhash, name, value)
    rnd = random.Random(9)
    values = set()
    for _ in range(60):
        f = rnd.getrandbits(64)
        values |= {f} | {f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 7))) for _ in range(6)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    rows = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert Counter(map(tuple, rows)) == Counter(want)


def test_components_of_chains_stars_and_rings(spark):
    pairs = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(20, 60)] + [(1, 2), (2, 3), (3, 1), (5, 5), (2, 1)]
    rows = components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    found = dict(map(tuple, rows))
    assert len(found) == len(rows)
    assert all(found[k] == 100 for k in range(100, 141)) and all(found[k] == 7 for k in range(20, 60)) and found[3] == 1
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_common_fingerprints_meet_their_class_as_others_do(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "FEWEST_COMMON", 2)
    base = " ".join(f"w{k}" for k in range(200))
    docs = make_docs([(k, base) for k in range(10, 40)] + [(5, base + " tail"), (6, "other"), (7, "other"), (None, base), (8, None)])
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter([*((k, 5) for k in range(10, 40)), (5, 5), (6, 6), (7, 6), (None, 5), (8, 8)])
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in simhash.keep_one(docs).collect()) == [(False, 5), (False, 6), (False, 8)]


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    blank = [r for r in rows if r["doc_id"] in (2, 3, 4)]
    assert all(r["fingerprint"] == "0" * 16 and r["component_id"] == 2 for r in blank)
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({(r["fingerprint"]) for r in rows})
    assert simhash.near_duplicates(no_docs).count() == simhash.keep_one(no_docs).count() == 0


def test_one_of_each_group_stays(make_docs):
    base = " ".join(f"w{k}" for k in range(300))
    docs = make_docs([(5, base), (3, base), (3, base), (9, base + " tail"), (8, "other words here"), (None, None), (None, None)])
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect())
    assert kept[(3, base)] == 1 and kept[(8, "other words here")] == 1 and kept[(None, None)] == 1
    assert (5, base) not in kept


def slow_repetition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)

    def covered(size):
        at = defaultdict(list)
        for k in range(n - size + 1):
            at[tuple(words[k : k + size])].append(k)
        return len({p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + size)})

    longest = 0
    while longest + 1 < n and len({tuple(words[k : k + longest + 1]) for k in range(n - longest)}) < n - longest:
        longest += 1
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, covered(5), covered(repetition.LEAST), longest


REPEATS = [
    "a b c d e f a b c d e f", "a a a a a a a a", "one two three four five six seven eight nine\n" * 3, "", None, "a b c d e x a b c d e",
    " ".join(f"w{k % 40}" for k in range(200)), "x\n\n x\nx\r\nx \nx ", "é é é é é é ü | # é é é é é é", "a b c d",
]


def test_repetition_matches_brute_force(spark, sf_dir):
    rnd = random.Random(4)
    texts = REPEATS + [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(200)]
    texts += [r["text"] for r in load(spark, sf_dir, "documents").limit(60).collect()]
    found = repetition.measure(texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words")
    for k, text in enumerate(texts):
        *figures, longest = slow_repetition(text)
        assert [found[c][k] for c in names] == figures, text
        assert found["longest_repeat"][k] == longest
        assert found["covered_words"][k] == sum(e - s for s, e in found["spans"][k])
        failed = figures[0] < 10 or 100 * figures[4] > 20 * figures[0]
        assert found["base_failed"][k] == failed
        assert found["kept"][k] == (not failed and figures[5] <= 0.15 * figures[0] and found["longest_repeat"][k] <= 60)


def test_maximal_repeats_match_brute_force():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(70))) for _ in range(80)] + REPEATS
    texts += [" ".join(rnd.choice([a, a, b]) for _ in range(9)) for a, b in (("a b c d e f g h i", "x"), ("q r s t u v w x y z", "q r s t u v w x a"))]
    found = repetition.measure(texts)["n_maximal"]
    for text, n_found in zip(texts, found, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, want = len(words), 0
        for size in range(repetition.LEAST, n):
            at = defaultdict(list)
            for k in range(n - size + 1):
                at[tuple(words[k : k + size])].append(k)
            for places in at.values():
                before = {words[k - 1] if k else None for k in places}
                after = {words[k + size] if k + size < n else None for k in places}
                want += len(places) > 1 and len(before) > 1 and len(after) > 1
        assert n_found == want, text


def test_repetition_tables(spark, sf_dir, odd_docs, no_docs):
    assert queries.op9_repetition(spark, sf_dir).count() == load(spark, sf_dir, "documents").count()
    rows = repetition.repetition_rules(odd_docs).collect()
    assert len(rows) == 12 and not any(r["kept"] for r in rows if r["doc_id"] in (2, 3, 4, 7))
    assert repetition.repetition_rules(no_docs).count() == 0
    assert repetition.repeated_spans(odd_docs).count() == 12


def test_batches_are_cut_by_bytes_and_rows():
    import pyarrow as pa
    from assayer.llm.base import slices

    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 100, "c", "é" * 4, *["d"] * 9], pa.string())})
    parts = [p.column("text").to_pylist() for p in slices(batch.slice(1), rows=4, size=20)]
    assert parts == [[None], ["b" * 100], ["c", "éééé", "d", "d"], ["d"] * 4, ["d"] * 3]
    lists = pa.record_batch({"text": pa.array([[1] * 9, None, [2]], pa.list_(pa.int64()))})
    assert [p.num_rows for p in slices(lists, size=5)] == [1, 2] and not list(slices(lists.slice(3)))


LICENSED = [
    "Licensed under the MIT License.", "under the mit licensee", "Apache License, Version 2.0 and CC BY-NC 4.0", "xunder the mit license",
    "cc by nc cc by nc", None, "", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0", "spdx-license-identifier: MIT OR",
    "cc\nby--NC under the MIT license under the mit license é", "CC BY ÑC", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
]


def test_license_base_matches_brute_force():
    scanner = license_scan.Scanner()
    for text in LICENSED:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        starts, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            parts = phrase.split()
            here = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            starts += here
            labels |= {label} if here else set()
        got = scanner.scan(text)
        assert got["n_words"] == len(words) and got["n_base"] == len(starts)
        assert (got["first_word"], got["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert got["base_labels"] == ",".join(sorted(labels)) and labels <= set(got["labels"].split(",")) | {""}
        assert 0 <= got["score"] <= 1


def test_license_places_among_many():
    text = "cc by nc under the mit license x apache license version 2 " * 20_000
    got = license_scan.Scanner().scan(text)
    assert (got["n_base"], got["first_word"], got["last_word"]) == (60_000, 0, 12 * 20_000 - 4) and got["n_words"] == 12 * 20_000


def test_license_expressions():
    parse, evaluate = license_scan.parse_expression, license_scan.evaluate
    assert parse("MIT OR GPL-3.0-only AND Apache-2.0") == ["mit", "gpl-3.0-only", "apache-2.0", "and", "or"]
    assert evaluate(parse("MIT OR GPL-3.0-only AND Apache-2.0")) == (True, {"mit", "gpl-3", "apache-2"})
    assert evaluate(parse("(MIT OR GPL-3.0-only) AND GPL-2.0-only WITH Classpath-exception-2.0")) == (False, {"mit", "gpl-3", "gpl-2"})
    for bad in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT Apache-2.0", "()", "MIT (ISC)"):
        assert parse(bad) is None
    scanner = license_scan.Scanner()
    assert scanner.scan(LICENSED[7])["labels"] == "apache-2,gpl-3,mit" and scanner.scan(LICENSED[7])["score"] == 1.0
    assert scanner.scan(LICENSED[8])["labels"] == "" and scanner.scan(LICENSED[11])["score"] == 0.0


@pytest.mark.parametrize("text, labels", [
    ("<!-- SPDX-License-Identifier: MIT -->", "mit"), ("<!-- SPDX-License-Identifier: MIT-->", "mit"), ("(SPDX-License-Identifier: MIT)", "mit"),
    ("SPDX-License-Identifier: Apache-2.0 (see LICENSE)", "apache-2"), ("SPDX-License-Identifier: MIT. And other words", "mit"),
    ("/* SPDX-License-Identifier: (MIT OR ISC) */ var a=1;" + "f(x);" * 400, "isc,mit"), ("SPDX-License-Identifier: MIT " + "x" * 500, "mit"),
    ("SPDX-License-Identifier: " + " OR ".join(["MIT", "ISC"] * 60), "isc,mit"), ("License-Expression: MIT\nor ISC", "mit"),
    ("SPDX-LicENSE-Identifier: MIT", "mit"), ("sPDX-lICENSE-iDENTIFIER: ISC", "isc"), ("SPDX-License-Identifier: " + " OR ".join(["MIT"] * 2000), "mit"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later AND BSD-3-Clause-Clear", "bsd,lgpl"), ("SPDX-License-Identifier: LicenseRef-Own-1.0+", "licenseref-own-1.0"),
    ("SPDX-License-Identifier: MIT, or as noted elsewhere", "mit"), ("/* SPDX-License-Identifier: MIT */ or else foo", "mit"), ("SPDX-License-Identifier: MIT; and keep this", "mit"),
    ("SPDX-License-Identifier: MIT\" or ISC", "mit"), ("SPDX-License-Identifier: , MIT", ""), ("SPDX-License-Identifier:\tMIT \t OR\tISC", "isc,mit"), ("SPDX-License-Identifier:\nMIT", ""),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by-nc"), ("SPDX-License-Identifier: MIT OR (see LICENSE", "mit"), ("SPDX-License-Identifier: MIT OR -->", ""), ("SPDX-License-Identifier: (MIT", ""),
])
def test_license_tags_before_other_text(text, labels):
    found = license_scan.Scanner().scan(text)
    assert found["labels"] == labels and (labels != "mit" or found["score"] == 1.0)


def test_license_tables(spark, sf_dir, odd_docs, no_docs):
    assert queries.op10_licenses(spark, sf_dir).where("n_base > 0").count() > 0
    rows = license_scan.scan_licenses(odd_docs).collect()
    assert len(rows) == 12 and all(r["labels"] == "" and r["first_word"] is None for r in rows)
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_pieces_met_again_outlive_those_met_once(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 100)
    codec = bpe.Codec(read_vocabulary(queries.tokenizer_path("byte_bpe_50k.json")))
    asked, plain = Counter(), codec.pieces
    codec.pieces = lambda piece: (asked.update([piece]), plain(piece))[1]
    for k in range(1_000):
        codec.encode(f" water z{k}q")
    assert asked[b" water"] == 1
    assert len(codec) + len(codec.older) <= 100


def test_early_pattern_cuts_as_the_plain_one():
    import regex
    from assayer.llm import vocabulary

    rnd = random.Random(4)
    for pattern in (bpe.PRE_TOKEN, token_count.PRE_TOKEN):
        early, plain = vocabulary._early(pattern), regex.compile(pattern).findall
        every = "".join(chr(k) for k in range(0x250)) + "‐—’…‰⁞"
        for text in (every, *("".join(rnd.choice("ab'strevdlA12 \t\n é½ \u0085.,-—’_\x1c") for _ in range(30)) for _ in range(500))):
            assert early(text) == plain(text)


def test_batches_for_python_are_bounded(spark, make_docs):
    from assayer.llm.base import BATCH_BYTES, pick

    docs = pick(make_docs([(k, "x" * 100_000) for k in range(200)]).coalesce(1), "doc_id", "text")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column("text").nbytes])], names=["n"])

    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) <= 1.1 * BATCH_BYTES
