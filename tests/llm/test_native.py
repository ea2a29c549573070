"""Decontamination, personal data and sharding against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from assayer.llm import decontaminate, personal_data, queries, sharding
from assayer.llm.base import load

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return WORD.findall(ascii_lower(text or ""))


def contamination(docs, items):
    windows = defaultdict(set)
    for item_id, text in items:
        words = words_of(text)
        size = min(13, len(words))
        if size and item_id is not None:
            for k in range(len(words) - size + 1):
                windows[tuple(words[k : k + size])].add(str(item_id))
    sizes = sorted({len(w) for w in windows})
    found = []
    for doc_id, text in docs:
        words, hit, met = words_of(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                ids = windows.get(tuple(words[k : k + size]))
                if ids:
                    hit |= set(range(k, k + size))
                    met |= ids
        listed = ",".join(sorted(met))
        found.append((doc_id, len(words), len(hit), len(met), listed, bool(hit) and 20 * len(hit) >= len(words)))
    return found


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
JUDGE_DOCS = [
    (1, ITEM), (2, "before it " + ITEM.upper() + " and after"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (4, "one Two"), (5, "two one two one two"), (6, None), (7, ""), (8, ITEM + " . " + ITEM), (9, "x " * 900 + ITEM), (9, "other text"),
    (10, "solo"), (None, ITEM), (11, "É é " + ITEM + " ÀB"), (1, ITEM), (12, "the the the the the the the the the the the the the the the"),
    (13, "gamma " * 40 + ITEM),
]
ITEMS = [(5, ITEM), (50, ITEM), (7, "one two"), (8, "solo"), (9, None), (10, ""), (None, "before it"), (11, "the " * 14), (12, "É é alpha")]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_matches_brute_force(spark, make_docs, limit):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.judge(make_docs(JUDGE_DOCS), bench, limit).drop("mark").collect()
    assert Counter(map(tuple, rows)) == Counter(contamination(JUDGE_DOCS, ITEMS))


def test_contamination_of_the_data(spark, sf_dir):
    docs, bench = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    expect = {
        (d, n, h, i, hashlib.sha256(listed.encode()).hexdigest(), c)
        for d, n, h, i, listed, c in contamination(docs.select("doc_id", "text").collect(), bench.collect())
    }
    assert {tuple(r) for r in queries.op4_decontaminate(spark, sf_dir).collect()} == expect
    assert any(x[-1] for x in expect)


def test_contamination_of_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "same row", 2), (None, None, None)], "item_id long, text string, Text int")
    rows = decontaminate.judge(odd_docs, bench).collect()
    assert len(rows) == 12 and sum(r["contaminated"] for r in rows) == 2
    assert decontaminate.decontaminate(odd_docs, bench).count() == 10
    assert decontaminate.judge(no_docs, bench).count() == 0
    assert decontaminate.judge(odd_docs, bench.limit(0)).where("contaminated").count() == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_of(text):
    found = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda m, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 8 <= len(d) <= 15,
            }[kind]
            if fits(m, digits):
                found.append((kind, m.start(), m.end()))
    return found


PRIVATE = [
    "mail a@b.c@d.e now", "a@b.c_x@d.e.f", "x" * 3000 + "@", "-+%@a-.b..c", "née ü@x.y é@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.000.00000255.0",
    "999999999999999999999.1.1.1", "1.2.3.", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111111111111111", "41111111 11111111 9",
    "+1 (269) 555-3296", "+1234567", "+1 2", "+12345678 (((", "++49 30 1234567.", "😀 a@b.co 😀 +4930123456", "+4111 1111 1111 1111",
    "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "a@b.c a@b.c", None, "", "0" * 16, "10.0.0.1 at foo@bar.org.", "9" * 5000, "1.1.1.1" * 200,
]


def test_base_spans_match_python(spark, make_docs):
    docs = make_docs(list(enumerate(PRIVATE)))
    got = {r["doc_id"]: r for r in personal_data.find_spans(docs).collect()}
    for k, text in enumerate(PRIVATE):
        spans = [(kind, s["start"], s["end"]) for kind in BASE for s in got[k][kind]]
        assert spans == base_of(text), text


def test_base_spans_of_the_data(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op5_personal_data(spark, sf_dir).collect()}
    for r in load(spark, sf_dir, "documents").collect():
        base = base_of(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert got[r["doc_id"]]["n_email"] == sum(k == "email" for k, _, _ in base)


def test_terms_that_reveal_an_entity(spark, make_docs):
    fill = ["north", "south", "east", "west", "upper", "lower", "inner", "outer"]
    rows = [(k, f"{w} desk of Quimby the {w}s, write to q@x.org or {w} call") for k, w in enumerate(fill)]
    rows += [(100 + k, f"the {w} desk of the house, or a call") for k, w in enumerate(fill * 5)]
    docs = make_docs(rows)
    got = {r["doc_id"]: r for r in personal_data.find_spans(docs).collect()}
    text = rows[0][1]
    terms = {text[s["start"] : s["end"]] for s in got[0]["term"]}
    assert "Quimby" in terms and "write" in terms and not terms & {"desk", "the", "call", "north"}
    assert not any(got[100 + k]["term"] for k in range(40))
    clean = {r["doc_id"]: r for r in personal_data.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0]["text"] and "Quimby" not in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[100]["text"] == rows[8][1]


def test_short_terms_and_repeated_rows(make_docs):
    fill = ["north", "south", "east", "west", "upper", "lower", "inner", "outer"]
    rows = [(k, f"{w} desk of Bo, write to q@x.org or {w} call, 李 {w}") for k, w in enumerate(fill)]
    rows += [(100 + k, f"the {w} desk of the house, or a call") for k, w in enumerate(fill * 5)]
    once, twice = ({(r["doc_id"], tuple(map(tuple, r["term"]))) for r in personal_data.find_spans(make_docs(held)).collect()} for held in (rows, rows * 2))
    terms = {rows[k][1][s:e] for k, held in once if k < 8 for s, e in held}
    assert {"Bo", "李", "write", "to"} <= terms and not terms & {"of", "a", "or"}
    assert once == twice and personal_data.find_spans(make_docs(rows * 2)).count() == 2 * len(rows)


def test_copies_of_one_passage_are_no_evidence(make_docs):
    rows = [(k, "desk of Quimby, write to q@x.org or call") for k in range(30)] + [(100 + k, f"other {k}") for k in range(30)]
    assert not any(r["term"] for r in personal_data.find_spans(make_docs(rows)).collect())


def test_sanitised_texts(make_docs, odd_docs, no_docs):
    docs = make_docs([(1, "a@b.co é 10.0.0.1x"), (2, "no data"), (3, None), (4, "+4111 1111 1111 1111"), (1, "other a@b.co")])
    got = Counter((r["doc_id"], r["text"]) for r in personal_data.sanitise(docs).collect())
    assert got == Counter([(1, "[EMAIL] é [IP]x"), (2, "no data"), (3, None), (4, "+[CARD]"), (1, "other [EMAIL]")])
    assert personal_data.sanitise(odd_docs).columns == odd_docs.columns and personal_data.sanitise(odd_docs).count() == 12
    assert personal_data.find_spans(no_docs).count() == 0


@pytest.mark.parametrize("n, found", [(2, set()), (3, {"Quimby", "author", "email"})])
@pytest.mark.parametrize("together", [True, False])
def test_fixed_words_of_low_hash_do_not_merge_contexts(make_docs, n, found, together):
    low = {w: hashlib.md5(w.encode()).hexdigest() for w in ("author", "email", "quimby", "wall", "gate", "tower")}
    assert min(low, key=low.get) == "author"
    parts = [f"author Quimby {w} email q@x.org {w} " for w in ("wall", "gate", "tower")[:n]]
    apart = " 1 2 3 " * 20
    texts = [apart.join(parts)] if together else parts
    rows = list(enumerate(texts)) + [(100 + k, f"other wall gate tower {k}") for k in range(30)]
    got = {r["doc_id"]: r["term"] for r in personal_data.find_spans(make_docs(rows)).collect()}
    for k, text in enumerate(texts):
        assert {text[s["start"] : s["end"]] for s in got[k]} == found


def test_terms_far_from_their_entity_go_wherever_they_stand(make_docs):
    body = [f"{a} {b}" for a in ("north", "south", "east", "west", "upper") for b in ("wall", "gate", "tower", "yard")]
    rows = [(k, f"Quimby\n{w} {'of the house ' * 9}\nmail: q@x.org") for k, w in enumerate(body)]
    rows += [(50, f"née Quimby-q@x.org {'of the house ' * 9} QUIMBY, Quimby's \u1dff Quimby q@x.org")]
    rows += [(100 + k, f"mail of the house {body[k % 20]} {k}") for k in range(200)] + [(400, None), (0, rows[0][1])]
    rows += [(500, "quimby says quimby")]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["term"]] for r in personal_data.find_spans(make_docs(rows)).collect()}
    texts = dict(rows)
    assert all([texts[k][s:e] for s, e in got[k]] == ["Quimby"] for k in range(20))
    assert [texts[50][s:e] for s, e in got[50]] == ["QUIMBY", "Quimby"] and [texts[500][s:e] for s, e in got[500]] == ["quimby", "quimby"]
    assert not any(got[k] for k in texts if k >= 100 and k != 500)
    clean = {r["doc_id"]: r["text"] for r in personal_data.sanitise(make_docs(rows)).collect()}
    assert clean[500] == " says " and not any("Quimby" in clean[k] for k in range(20))


def test_texts_of_many_mentions(make_docs):
    """Parts of a text are cut at code points, wherever blocks of it end, and cost no count from its start."""
    gaps = ["\U0001f600 to ", "é " * 700, " ", "x " * 511, "\U0001f600" * 1024 + " "]
    texts = ["".join(f"u{k}@ex{k % 7}.org {gaps[k % 5]}" for k in range(300)), "a@b.c \U0001f600 " * 20_000, "a@b.c", "\U0001f600" * 1023 + " a@b.c", " " * 1024 + "a@b.c"]
    docs = make_docs(list(enumerate(texts)))
    clean = {r.doc_id: r.text for r in personal_data.sanitise(docs.where("doc_id < 2")).collect()}
    assert clean == {k: re.sub(r"\S+@\S+", "[EMAIL]", t) for k, t in enumerate(texts[:2])}
    for row in personal_data.base_table(docs).where("doc_id != 1").collect():
        text = texts[row.doc_id]
        assert len(row.windows) == text.count("@")
        for w in row.windows:
            assert (w.entity, w.before, w.after) == (text[w.start : w.end], text[max(0, w.start - 60) : w.start], text[w.end : w.end + 60])


def test_overlapping_spans_leave_no_character(make_docs):
    texts = [
        "call +15551234567@mail.com now", "4111111111111111.jane.doe@corp.com", "+1 555 123 4567.jane@corp.com", "é +1 10.0.0.1 555 1234@x.org ü",
        "a@b.c 10.0.0.1", *filter(None, PRIVATE[:-1]),
    ]
    got = {r["doc_id"]: r["text"] for r in personal_data.sanitise(make_docs(list(enumerate(texts)))).collect()}
    assert got[0] == "call [EMAIL] now" and got[1] == "[EMAIL]" and got[4] == "[EMAIL] [IP]"
    for k, text in enumerate(texts):
        held = {p for _, s, e in base_of(text) for p in range(s, e)}
        rest = "".join(c if p not in held else "\0" for p, c in enumerate(text))
        assert re.sub(r"(\[(EMAIL|IP|CARD|PHONE)\])+", "\0", got[k]) == re.sub("\0+", "\0", rest), text


def test_shards_hold_their_law(spark, make_docs):
    docs = make_docs([(k, f"text {k % 7}") for k in range(4000)] + [(None, None), (None, None), (5, "text 5")])
    rows = sharding.shards(docs, sharding.balanced()).collect()
    assert len(rows) == 4003
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert set(slots) == set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(180 < len(v) < 330 for v in slots.values())
    assert 150 < sum(r["grown_shard"] == 16 for r in rows) < 330
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 5:
            text = f"text {r['doc_id'] % 7}".encode()
            assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "key")
    assert [(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is None] == [(1, 0), (1, 0)]


def test_slots_follow_a_rule_of_the_row_alone(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 4)
    rows = [(k, f"text {k % 7}") for k in range(600)] + [(7, "hot")] * 300 + [(None, None)] * 9
    got = sharding.shards(make_docs(rows), sharding.balanced()).collect()
    seen, keyed = Counter(), defaultdict(list)
    for r in sorted(got, key=lambda r: r["slot"]):
        who = (r["doc_id"], r["text_crc32"], r["size"])
        keyed[r["shard"]].append(who)
        seen[who] += 1
    assert sum(seen.values()) == len(rows) and seen[(7, zlib.crc32(b"hot"), 4)] == 300
    for shard, held in keyed.items():
        order, nth = [], Counter()
        for who in held:
            piece = nth[who] // 4
            nth[who] += 1
            order.append((who, piece))
        want = sorted(Counter(held).elements(), key=str)
        pieces = [(w, k // 4) for w, n in Counter(want).items() for k in range(n)]
        rule = lambda x: (hashlib.md5(f"{'' if x[0][0] is None else x[0][0]}|{x[0][1]}|{x[1]}".encode()).hexdigest()[:3], x[0][0] is not None, x[0][0] or 0, *x[0][1:], x[1])
        assert [w for w, _ in sorted(pieces, key=rule)] == held, shard
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1


def test_changed_weight_moves_rows_of_its_subtree_only(make_docs):
    docs = make_docs([(k, "") for k in range(3000)])
    tree = sharding.balanced()
    heavy = sharding.Tree(tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree.leaves))
    both = sharding.assign(sharding.assign(docs, "doc_id", tree, "a"), "doc_id", heavy, "b").select("a", "b").collect()
    place = {x.shard: (x.region, x.rack) for x in tree.leaves}
    for a, b in both:
        if a != b:
            assert place[b][0] == 0
            if place[a][0] == 0:
                assert place[b] == (0, 1)
            if place[a] == place[b]:
                assert b == 5
    assert sum(b == 5 for _, b in both) > sum(a == 5 for a, _ in both)


def test_shards_of_odd_tables(odd_docs, no_docs, tmp_path):
    assert sharding.shards(odd_docs, sharding.balanced()).count() == 12
    assert sharding.shards(no_docs, sharding.balanced()).count() == 0
    sharding.write_shards(odd_docs, sharding.balanced(), str(tmp_path / "out"))
    assert odd_docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == 12
    with pytest.raises(ValueError):
        sharding.Tree((sharding.Leaf(0, 0, 0, 0.0),))
