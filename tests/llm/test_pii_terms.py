"""Disclosing terms against counts by plain Python over the given table and over made ones."""

import re
from collections import defaultdict
from math import log2

import pyarrow as pa
import pytest

from lingmill.llm import pii
from lingmill.llm.common import stage, table

WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_units(text):
    """Lists of word spans: sentences, 64 words at most."""
    out, last = [], None
    for m in WORD.finditer(text):
        if last is None or re.search("\n|[.!?][ \t\n\v\f\r]", text[last : m.start()]) or len(out[-1]) == pii.UNIT_WORDS:
            out.append([])
        out[-1].append((m.start(), m.end()))
        last = m.end()
    return out


def by_hand(texts):
    """{term: ratio} of the disclosing terms, from counts over all units."""
    n, holders, holding, both = 0, defaultdict(int), defaultdict(int), defaultdict(int)
    sources = defaultdict(lambda: defaultdict(int))
    name = lambda w: w.translate(FOLD)
    code, known = {}, set()  # units with a value that have been counted

    def hashed(w):
        if w not in code:
            part = pii._Slice(*map_one(w))
            code[w] = int(part.terms()[1][0])
        return code[w]

    for text in texts:
        spans, units = pii._own(text), plain_units(text)
        first = {a: min(x for u in units for x, y in u if y > a) for a, _, _ in spans}
        for unit in units:
            inside = [s for s in spans if first[s[0]] in {x for x, _ in unit}]
            said = tuple(name(text[a:b]) for a, b in unit)
            if inside and said in known:
                continue
            known.add(said)
            n += 1
            for w in {name(text[a:b]) for a, b in unit}:
                holders[w] += 1
            free = {name(text[a:b]) for a, b in unit if all(b <= x or a >= z for x, _, z in spans)}
            met = set()
            for a, kind, b in inside:
                for entity, own in pii.entities(kind, text[a:b]):
                    fresh = entity not in met
                    met.add(entity)
                    holding[entity] += fresh
                    for w in free:
                        both[entity, own, w] += fresh
                        others = [hashed(o) for o in free if o != w]
                        sources[entity, own, w][min(others, default=0) if own else text[a:b].lower()] += fresh
    tried = [k for k, s in sources.items() if len(s) >= 3]
    out = {}
    for entity, own, w in tried:
        k = entity, own, w
        if holding[entity] == n:
            continue
        pmi = log2(n * both[k] / (holding[entity] * (holders[w] + 1)))
        ic = log2(n / holding[entity])
        if pmi >= pii.GENERALISE * ic and len(sources[k]) * pmi >= log2(len(tried) / pii.CHANCE):
            out[w] = max(out.get(w, 0), pmi / ic)
    return out


def map_one(w):
    from lingmill.llm.bytesets import utf8

    return utf8(pa.array([w]))


def check(spark, df, monkeypatch):
    """Terms and their spans by both ways of marking, against plain counts; gives terms and rows."""
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    want = by_hand([t for _, t in rows])
    got = []
    for bound in (pii.BROADCAST_TERMS, 0):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
        got.append({r.doc_id: r for r in pii.spans(df).collect()})
    for doc_id, text in rows:
        own = pii._own(text)
        free = [(m.start(), m.end(), m[0].translate(FOLD)) for m in WORD.finditer(text) if all(m.end() <= a or m.start() >= b for a, _, b in own)]
        marked = [(a, pii.TERM, b) for a, b, w in free if w in want]
        for by in got:
            assert [tuple(s) for s in by[doc_id]["all"]] == sorted(own + marked)
            assert by[doc_id].remove == [a for a, b, w in free if want.get(w, 0) >= pii.REMOVE]
            assert by[doc_id].sanitised == pii.sanitise(text, sorted(own + marked), set(by[doc_id].remove))
    return want, got[0]


def test_units_are_sentences():
    text = "One two. Three v1.5 four!\nfive? six " + "w " * 150 + "end.no break é"
    from lingmill.llm.bytesets import utf8

    part = pii._Slice(*utf8(pa.array([text, "", "x. y"])))
    unit = part.units().tolist()
    sizes = [unit.count(u) for u in dict.fromkeys(unit)]
    assert sizes == [len(u) for t in (text, "x. y") for u in plain_units(t)] and max(sizes) == 64


def test_terms_of_given_table(spark, monkeypatch):
    """Terms are found by corpus counts alone, every one equal to the counts by hand, and no clean document is marked."""
    df = table(spark, "/root/testdata/sf0.01", "documents")
    want, got = check(spark, df, monkeypatch)
    assert want and sum(s.kind == pii.TERM for r in got.values() for s in r["all"]) > 10
    assert all(any(s.kind != pii.TERM for s in r["all"]) for r in got.values() if r["all"])


@pytest.mark.parametrize("said", ["host", "value", "copies", "one origin", "common"])
def test_what_discloses(spark, monkeypatch, said):
    plain = [f"plain words {i} of nobody. Other {i % 7} things" for i in range(120)]
    about = {
        "host": [f"w{i}a Zorblax u{i}@zorb.example.com w{i}b" for i in range(6)],
        "value": [f"w{i}a Zorblax same@x.example.com w{i}b" for i in range(6)],
        "copies": ["w0a Zorblax same@x.example.com w0b"] * 6,
        "one origin": [f"a b c d e f g h Zorblax same@x.example.com i j k l m n o p{i}" for i in range(6)],
        "common": [f"w{i}a Zorblax u{i}@zorb.example.com w{i}b" for i in range(6)] + ["Zorblax alone"] * 6,
    }[said]
    df = stage(spark.createDataFrame(list(enumerate([*about, *plain, None, "", "zorblax again"])), "doc_id long, text string"), "made")
    want, got = check(spark, df, monkeypatch)
    assert ("zorblax" in want) == (said in ("host", "value"))
    if want:  # also where it stands alone
        assert [s.kind for s in got[len(about) + len(plain) + 2]["all"]] == [pii.TERM]
