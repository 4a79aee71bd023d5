"""The pipeline operators against brute force, on small tables with nulls, ties and repeats."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill.llm import chat, exact_dedup, html_extract, jaccard_join, licenses, mixing, packing, pii, quality_classifier, quality_rules
from lingmill.llm.common import stage

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long"


def words(text):
    return (text or "").encode().translate(LOWER).split()


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdeé", k=draw.randint(1, 7))) for _ in range(400)]
    base = [" ".join(draw.choices(vocabulary, k=60)) for _ in range(12)]
    out = []
    for i in range(60):
        w = base[i % 12].split(" ")
        if i % 5:
            w[draw.randrange(60)] = draw.choice(vocabulary)
        out.append(" ".join(w) if i % 7 else " ".join(w).upper())
    out += [None, "", " \n\t ", "one two", "One TWO", "a b c d e", "x" * 9000 + " y", base[0], base[0].replace(" ", "\n"), "mail me@a-b.example.com or +1 (017) 555-7713 at 10.0.0.255 is 4111111111111111"]
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), 1) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stage(spark.createDataFrame(rows, SCHEMA), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, rows, empty):
    norm = {i: (t or "").translate({c: c + 32 for c in range(65, 91)}) for i, t, *_ in rows}
    for size, bits in ((4096, 64), (16, 3)):
        for r in exact_dedup.exact_groups(docs, size, bits).collect():
            same = [i for i in norm if norm[i] == norm[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
            assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0
    twice = docs.unionByName(docs)
    assert exact_dedup.keep_one(stage(twice, "twice")).count() == len(set(norm.values()))


def components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_groups(docs, rows, empty):
    want = components(rows)
    for pivots in (1, 3):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(docs, pivots).collect()} == want
    assert jaccard_join.near_groups(empty).count() == 0


def test_near_groups_of_a_template_make_no_pairs(spark, monkeypatch):
    made = {}
    plain = jaccard_join.stage

    def spy(df, name):
        out = plain(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", spy)
    base = " ".join(f"t{i}" for i in range(104))
    for n in (100, 1000):
        made.clear()
        rows = [(i, base + " " + " ".join(f"o{i}x{k}" for k in range(13))) for i in range(n)]
        got = jaccard_join.near_groups(plain(spark.createDataFrame(rows, "doc_id long, text string"), "template")).collect()
        assert all(r.component_id == r.doc_id for r in got) and len(got) == n
        assert made["pairs"][1:] == [0, 0] and made["pairs"][0] <= 3 * n and max(made["crossings"], default=0) <= 15 * n


def test_near_groups_of_a_chain(spark):
    draw = random.Random(21)
    text = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(150):
        text[draw.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(text[: draw.randint(70, 80)])))
    want = components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(stage(spark.createDataFrame(rows, "doc_id long, text string"), "chain")).collect()} == want


def test_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, 128).collect()
    ids = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    at = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(at[s] == 128 for s in at if s != max(at))
    assert packing.pack(empty, path).count() == 0


def test_caches_go_with_their_module():
    from lingmill.llm import common

    packing.word_ids(packing.default_tokenizer())
    common.let_go("lingmill.llm.packing")
    assert packing._IDS
    common.let_go("lingmill.llm.pii")
    assert not packing._IDS and not common._CACHES


@pytest.mark.parametrize("word", ["don't", "ÀÉ!!", "İx", "ß,", "x<|endoftext|>y", "é", "日本", "ªb.", "12.5", "a b", "--", "it's,"])
def test_word_ids_are_the_tokenizers(word):
    ids = packing.word_ids(packing.default_tokenizer())
    assert np.frombuffer(packing.encode(ids, word.encode()), "<u4").tolist() == ids.tokenizer.encode(word, add_special_tokens=False).ids


def test_packing_takes_no_column_for_a_section(spark):
    """A table may have a column of the name that the pipeline's sections go by; offsets stay gapless."""
    df = spark.createDataFrame([(i, "some words here", "xyx"[i % 3]) for i in range(8)], "doc_id long, text string, __section string").coalesce(1)
    rows = sorted(packing.pack(df, packing.default_tokenizer()).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(8)] and [r.doc_id for r in rows] == [*range(8)]


def test_chat_reads_back(spark):
    turns = [(1, 0, "user", "a\\1<|turn|>[INST]"), (1, 1, "assistant", "b\n</s>"), (1, 2, "user", None), (1, 3, "assistant", "d"), (2, 0, "us\ner", "x"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 1, "assistant", "n")]
    placed = chat.placed(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.streams(placed).select("conv_id", "stream", chat.read_back(F.col("stream")).alias("turns")).collect()}
    shown = lambda text: text.replace("\\2", "[").replace("\\1", "<").replace("\\0", "\\")
    every = chat.examples(placed).collect()
    for conv in (1, 2, 3, None):
        own = [(r, t or "") for c, _, r, t in turns if c == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        got = sorted((x for x in every if x.conv_id == conv), key=lambda x: x.example)
        assert [x.example for x in got] == [k for k, (r, _) in enumerate(own) if r == "assistant"]
        pieces = back[conv].stream.split(chat.OPEN)[1:]
        for x in got:
            assert shown(back[conv].stream[x.target_start : x.target_end]) == shown(x.target) == own[x.example][1]
            head = f"{chat.OPEN}assistant\n"
            assert back[conv].stream[: x.context_chars] == "".join(chat.OPEN + p for p in pieces[: x.example]) + head and x.context_turns == x.example
    inline = {(r.conv_id, r.example): r for r in chat.inline(placed).collect()}
    assert set(inline) == {(x.conv_id, x.example) for x in every}
    one = inline[1, 1]
    assert chat.OPEN in one.text and "[INST]" not in one.text and one.text.endswith(chat.CLOSE) and one.text[one.loss_start : one.loss_end] == "b\n\\1/s>"


def test_chat_expands_to_whole_examples(spark, tmp_path, monkeypatch):
    said = {1: ["user", "assistant", "user", "assistant", "user"], 2: ["user", "system"], 3: ["assistant", "user"], 4: ["user", "assistant"] * 150, None: ["user", "assistant"]}
    turns = [(c, k, r, f"{c}<{k}\\[é" if k else "") for c, roles in said.items() for k, r in enumerate(roles)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    turns += [(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(["user", "assistant"])]
    hide = lambda t: t.replace("\\", "\\0").replace("<", "\\1").replace("[", "\\2")
    own = {c: [(r, t) for d, _, r, t in turns if d == c] for c in [*said, -1]}
    shown = {c: [f"{chat.OPEN}{r}\n{hide(t)}{chat.CLOSE}" for r, t in ts] for c, ts in own.items()}
    placed = chat.placed(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    want = {(c, k): ("".join(shown[c][:k]) + f"{chat.OPEN}assistant\n", hide(t)) for c, ts in own.items() for k, (r, t) in enumerate(ts) if r == "assistant"}
    every = chat.examples(placed).collect()
    assert {(x.conv_id, x.example): (x.context, x.target) for x in every} == want
    assert all((x.target_start, x.target_end) == (len(x.context), len(x.context + x.target)) and x.context_chars == x.target_start for x in every)
    assert all((x.mask_start, x.mask_end) == (len(x.context.encode()), len((x.context + x.target).encode())) for x in every)
    rows = chat.expanded(placed).collect()
    assert {(x.conv_id, x.context) for x in rows if x.closing} == {(c, "".join(shown[c])) for c in (1, 2, 3)} and sorted(str(x.conv_id) for x in rows if x.last) == sorted(map(str, own))
    got = {x.conv_id: x for x in chat.op2_chat(spark, str(tmp_path)).collect()}
    for c, ts in own.items():
        loss, at = "".join(t for r, t in ts if r == "assistant"), [len(x) for (d, _), (x, _) in want.items() if d == c]
        told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert tuple(got[c]) == (c, len(ts), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len("".join(shown[c])), len(at), sum(at))
    # a compiled generator would hold all contexts of a conversation at once
    plan = chat.op2_chat(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert [line.split("Generate")[0].strip(" :+-") for line in plan.splitlines() if "Generate explode" in line] == [""]
    # the query's rows are those of the expansion: text and mask of an example decide what is read
    whole = chat.expanded
    monkeypatch.setattr(chat, "expanded", lambda turns: whole(turns).withColumn("mask_end", F.col("mask_end") - 1).filter("last"))
    cut = {x.conv_id: x for x in chat.op2_chat(spark, str(tmp_path)).collect()}
    assert cut[1].n_examples == cut[1].loss_chars == 0 and cut[1].turns_sha256 == got[1].turns_sha256 and cut[4].n_examples == 1
    assert cut[-1].loss_sha256 == hashlib.sha256("</s>[INST] ok [/INST".encode()).hexdigest()


def test_pii_spans(docs, rows):
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    last = rows[-1][0]
    assert [s.kind for s in got[last].base] == [0, 3, 1, 2]
    assert all(not got[i].base for i in got if i != last)
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choice("a1 2.3@-+4(5)é6_7") for _ in range(draw.randint(0, 50)))
        want = sorted((m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text))
        assert [s for s in pii.base_spans(text) if s[1] == 0] == want


def test_pii_terms_that_name_a_value(spark):
    def about(i):
        return f"w{i}a w{i}b Zorblax me@x.example.com w{i}c w{i}d"

    plain = [(100 + i, f"nothing here {i}") for i in range(40)]
    table = spark.createDataFrame([(i, about(i)) for i in range(5)] + plain, "doc_id long, text string")
    got = {r.doc_id: r["all"] for r in pii.spans(stage(table, "pii")).collect()}
    assert all([s.kind for s in got[i]] == [4, 0] for i in range(5))
    copies = spark.createDataFrame([(i, about(0)) for i in range(5)] + plain, "doc_id long, text string")
    assert all(len(r["all"]) == 1 for r in pii.spans(stage(copies, "pii")).filter("doc_id < 5").collect())
    assert pii.sanitise("call me@x.example.com Zorblax", [(5, 0, 21), (22, pii.TERM, 29)], {22}) == "call [EMAIL] "
    clean = {r.doc_id: r.sanitised for r in pii.spans(stage(table, "pii")).collect()}
    assert clean[2] == "w2a w2b [TERM] [EMAIL] w2c w2d" and clean[105] == "nothing here 5"


def plain_spans(text):
    """The contract's patterns as they stand, one by one."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_patterns_by_brute_force():
    draw = random.Random(9)
    for alphabet in ("a1 2.3@-+4(5)é6_7", "0123456789 -", "+0123456789 ().-", "1.25 0a"):
        for _ in range(2500):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_pii_secrets():
    text = 'say token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" to aaaaaaaaaaaaaaaaaaaa1234 or 12345678901234567890123 or a_name_with_nothing_in_it'
    assert [text[a:b] for a, _, b in pii.secrets(text, [])] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert pii.secrets(text, [(13, 0, 20)]) == []


def test_rules_by_brute_force(docs, rows):
    for r in quality_rules.repetition(docs).collect():
        text = rows[r.doc_id][1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        repeated = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        live = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
        assert (r.n_lines, r.n_dup_lines) == (len(live), len(live) - len(set(live)))
        covered = {k + j for k in range(len(w) - 4) if tuple(w[k : k + 5]) in {tuple(w[i : i + 5]) for i in range(k)} for j in range(5)}
        assert r.dup5_chars == sum(len(w[k]) for k in covered)


def test_mixing_reaches_targets(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
    order = [*sorted(s for s in size if s), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in size if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else weight[s] * rest / free for s in size}
        above = {s for s in size if target[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    for s in size:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(target[s])
        assert sum(r.taken for r in own) == round(target[s])
        assert all(r.taken <= 3 * r.size for r in own)
    assert mixing.mix(empty).count() == 0


def test_classifier_learns_and_scores(spark):
    draw = random.Random(1)
    good = [" ".join(draw.choices(["the", "river", "was", "wide", "and", "slow", "today", "again", "people"], k=40)) + "." for _ in range(80)]
    bad = ["### $$$ %%% " * draw.randint(5, 9) + "BUY NOW!!!" for _ in range(80)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)] + [(5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(stage(table, "q"), labels).collect()}
    assert len(got) == 162 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(got[i].predicted == (i < 80) for i in range(160))
    none = quality_classifier.classify(table, labels.filter("quality = 1")).first()
    assert none.score == 0.5
    assert quality_classifier.accept(stage(table, "q"), labels).filter("doc_id between 80 and 159").count() == 0


def test_html_blocks_and_differencing(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><header><h1>Top</h1></header><p>One &amp; <b>two</b><p>three<div class='comments'>no</div></article><footer>f</footer>"
    assert [t for t, k in html_extract.blocks(page) if k == 2] == ["Top", "One & two", "three"]
    assert html_extract.common_lines([1, 2, 3, 4], [0, 2, 4, 9]) == [False, True, False, True]
    frame = "<div><p>Welcome to the site</p><p>{}</p><p>Contact the office</p></div>"
    pages = [(1, "http://h.example/a/1", frame.format("first story of many words")), (2, "http://h.example/a/2", frame.format("second story told at length")), (3, "http://o.example/", None), (4, None, page)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "first story of many words", 2: "second story told at length", 3: "", 4: "Top\nOne & two\nthree"}


def test_licences(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    text = f"plain words here\nReleased under the MIT License.\nthe driver lost his license\nLicensed under CC BY-NC 4.0.\n\n{wrapped}\n\nThis software is distributed under the Boost Software License, Version 1.0.\nZlib License"
    got = licenses.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(f.family, text[f.start : f.end], f.confirmed) for f in got[0].findings] == [
        ("mit", "Released under the MIT License.", True), ("cc-by-nc", "Licensed under CC BY-NC 4.0.", True), ("mit", wrapped, True),
        ("unknown", "This software is distributed under the Boost Software License, Version 1.0.", False), ("unknown", "Zlib License", False),
    ]
    assert not got[1].findings


def test_licence_model_is_calibrated():
    model = licenses.train()
    assert min(licenses.TEMPERATURES) < model.temperature < max(licenses.TEMPERATURES)
    assert min(model.recall.values()) > 0.9 and model.family_min >= licenses.FAMILY_MIN
    learnt = {p for _, p in licenses._samples(random.Random(11))[0]}
    assert not any(name in p for name in licenses.CALIBRATING for p in learnt)


def test_licence_scores_by_brute_force():
    from lingmill.llm.bytesets import ngram_hashes, span_hashes

    model = licenses.train()
    lines = ["Licensed under the Apache License, Version 2.0.", "", "é nothing", "see the GNU GPL v3 for\tdetails", "Redistributions of source code must retain"]
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    starts, ends, _, sums = licenses._scores(data, np.array([0, len(data)]), model)
    at = {h: i for i, h in enumerate(model.known.tolist())}
    want = {}
    for line in lines:
        own = np.frombuffer(line.encode(), np.uint8)
        found = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", line.encode())]
        word = span_hashes(own, np.array([a for a, _ in found], int), np.array([b for _, b in found], int), True)
        hit = {at[h] for n in licenses.LENGTHS for h in ngram_hashes(word, n).tolist() if h in at}
        if hit:
            want[line] = sum(model.weights[i].astype(float) for i in hit) + model.weights[-1]
    got = {data[a:b].tobytes().decode(): s for a, b, s in zip(starts, ends, sums, strict=True)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_paragraphs_join_wrapped_lines():
    texts = ["a long line of words that goes on and on in\nthe next one\nshort\nother", "", "x\n\ny", "a long line of words that ends in a full stop.\nnext"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    starts, ends, row = licenses.paragraphs(data, off)
    got = [(int(r), data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, row, strict=True)]
    first = texts[0].split("\nshort")[0]
    assert got == [(0, first), (0, "short"), (0, "other"), (1, ""), (2, "x"), (2, ""), (2, "y"), *[(3, x) for x in texts[3].split("\n")]]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    at = docs
    for name, step in corpus_pipeline.STAGES[:3]:
        after = stage(step(spark, at, folder), name)
        assert after.columns == docs.columns
        at = after
    kept = [r.asDict() for r in at.collect()]
    left = components([(r["doc_id"], r["text"]) for r in kept])
    assert all(i == top for i, (_, top) in left.items())
    assert at.filter(F.col("text").isNull()).count() == 0

    # mix: laps of every document by hand, from sizes, targets and the order of draws
    mixed = stage(corpus_pipeline.STAGES[3][1](spark, at, folder), "mixed")
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in kept}
    by_source = {}
    for r in kept:
        by_source.setdefault(r["source"], []).append(r["doc_id"])
    target = {r.source: r.target for r in mixing.mix(at).select("source", "target").distinct().collect()}
    want = {}
    for source, ids in by_source.items():
        goal, total, start = round(target[source]), sum(size[i] for i in ids), 0
        for i in sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            rest = min(size[i], max(0, goal % total - start)) if total else 0
            want[i] = (goal // total if total else 0) + (2 * rest >= size[i]) if size[i] else 0
            start += size[i]
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and got == {i: n for i, n in want.items() if n}

    # pack: the stream is the mix's texts in training order
    from tokenizers import Tokenizer

    tokenizer, text = Tokenizer.from_file(packing.default_tokenizer()), {r["doc_id"]: r["text"] for r in kept}
    order = [r.doc_id for r in sorted(mixing.mix(at).select("doc_id", "tie", F.explode("positions").alias("p")).collect(), key=lambda r: (r.p, r.doc_id, r.tie))]
    stream = np.array([t for i in order for t in [*tokenizer.encode(text[i], add_special_tokens=False).ids, 2]], "<u4")
    at_token = 0
    for r in sorted(corpus_pipeline.STAGES[4][1](spark, mixed, folder).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert (r.sequence_id * 4096 + r.offset, r.ids_crc32) == (at_token, zlib.crc32(stream[at_token : at_token + r.length].tobytes()))
        at_token += r.length
    assert at_token == len(stream)


def test_html_odd_markup():
    text = lambda page: [t for t, k in html_extract.blocks(page) if k == 2]
    assert text("""<article><p title="5" monitor">Hello world</p><p class="x">Bye</p></article>""") == ["Hello world", "Bye"]
    assert text("<article><p data-x=it's>one</p><p title='a>b'>two</p><p a=\"open>three</p></article>") == ["one", "two", "three"]
    assert text('<article><p class="share price">sold <math>x</math></p><p class="alert hidden-gem">kept</p><div class="comments">no</div><form>no</form><nav>no</nav></article>') == ["sold x", "kept"]
    assert [k for _, k in html_extract.blocks("<p class='alert'>gone</p><p>here</p>")] == [0, 1]


def test_common_lines_by_brute_force():
    draw = random.Random(6)
    for _ in range(300):
        a, b = ([draw.randint(0, 5) for _ in range(draw.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, k in zip(a, html_extract.common_lines(a, b), strict=True) if k]
        rest = iter(b)
        assert len(kept) == best[-1][-1] and all(any(y == x for y in rest) for x in kept)
        assert sum(html_extract.shared_lines(a, b)) == len(kept)


def test_html_sites_by_brute_force(spark):
    """A site of pages in one template: what all pages share goes, what each has alone stays."""
    draw = random.Random(14)
    frame = [f"menu item {k}" for k in range(6)]
    pages, want = [], {}
    for i in range(12):
        own = [f"sentence {i} {k} " + " ".join(draw.choices(["of", "many", "words", "here"], k=12)) for k in range(draw.randint(2, 5))]
        lines = frame[:3] + own + frame[3:]
        pages.append((i, f"http://site.example/{i:02d}", "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"))
        want[i] = "\n".join(own)
    table = stage(spark.createDataFrame(pages, "page_id long, url string, html string"), "site")
    assert {r.page_id: r.text for r in html_extract.extract(table).collect()} == want
    rows = [(k, "h", [k]) for k in range(12)]
    assert [[d for d, _ in o] for o in html_extract.pairings(rows)] == [[d for d in range(-4, 5) if d and 0 <= k + d < 12] for k in range(12)]


def test_html_furniture_goes_by_alignment(spark, monkeypatch):
    """Menus and footers that pages share go by alignment, adverts of one page by tags; without any names the shared ones go all the same."""
    monkeypatch.setattr(html_extract, "PAGES", 5)
    menu, foot = "<li>Start</li><li>News</li><li>About us</li>", "<p>All rights reserved</p>"
    named = "<body><nav><ul>{menu}</ul></nav><div class='ad'>{ad}</div><article><h1>{head}</h1><p>{body}</p></article><footer>{foot}</footer></body>"
    bare = "<body><div><ul>{menu}</ul></div><div><h1>{head}</h1><p>{body}</p></div><div>{foot}</div></body>"
    pages, want = [], {}
    for i in range(17):
        parts = {"menu": menu, "foot": foot, "ad": f"buy {i}", "head": f"head {i}", "body": f"story {i} " + f"w{i} " * 20}
        pages += [(i, f"http://n.example/{i:02d}", named.format(**parts)), (100 + i, f"http://b.example/{i:02d}", bare.format(**parts))]
        want[i] = want[100 + i] = f"head {i}\n" + parts["body"].strip()
    got = html_extract.extract(stage(spark.createDataFrame(pages, "page_id long, url string, html string"), "site")).collect()
    assert {r.page_id: r.text for r in got} == want
    assert {(r.n_aligned, r.n_tagged) for r in got if r.page_id < 100} == {(4, 1)} and {(r.n_aligned, r.n_tagged) for r in got if r.page_id >= 100} == {(0, 0)}


def test_html_holders_of_the_article():
    text = lambda page: [t for t, k in html_extract.blocks(page) if k == 2]
    article = "<article><p>one</p><form>no</form></article>"
    assert text(f"<form id=f><nav>menu</nav>{article}</form>") == ["one"]
    assert text(f"<div class='content social'><div class=sidebar>{article}</div></div>") == ["one"]
    assert text(f"<div class='related'>{article}</div>{article.replace('one', 'two')}") == ["two"]
    assert text(f"<div class='modal' hidden>{article}</div>") == [] == text(f"<aside>{article}</aside>")


def test_html_stray_tags_in_linear_time():
    def took(n):
        began = time.perf_counter()
        page = "<article>" + "<b>" * n + "<table>" + "x</i><p>y" * n + "</b></u>" * n + "</article>"
        assert len(html_extract.blocks(page)) == n + 1
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 12 * took(8000) + 1


def test_html_articles_are_differenced(spark):
    marked = "<div><p>Site name</p></div><article><p>{0}</p><p>{1}</p><p>Share this story</p></article><div><p>{2}</p></div>"
    bodies = [(f"story {i} " * 9, "quoted by two" if i in (2, 3) else f"more of {i}", f"dateline {i}") for i in range(6)]
    pages = [(i, f"http://h.example/a/{i}", marked.format(*b)) for i, b in enumerate(bodies)] + [(9, "http://alone.example/", marked.format("a", "b", "c"))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([a.strip(), b, c]) for i, (a, b, c) in enumerate(bodies)} | {9: "a\nb\nShare this story"}


def test_html_copies_and_long_frames(spark):
    def pages(host, items, frame):
        return [(f"http://{host}/{path}", f"<div><p>{frame} menu</p><p>{text}</p><p>{frame} foot</p></div>", text) for path, text in items]

    every = pages("long.example", [(f"a/{i}", f"short {i}") for i in range(4)], "words of a long frame " * 20)
    every += pages("copies.example", [(f"a/1{q}", "one story in many words of its own") for q in ("", "?utm_source=a", "?utm_source=b", "?utm_source=c")] + [("a/2", "another story told at its own length")], "site")
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(every)], "page_id long, url string, html string")).collect()}
    assert got == {i: text for i, (_, _, text) in enumerate(every)}


def test_pii_copies_do_not_hide_a_term(spark):
    rows = [f"w{i}a w{i}b Zorblax me@x.example.com w{i}c w{i}d" for i in range(3)] + ["w0a w0b Zorblax me@x.example.com w0c w0d"] * 200 + [f"nothing here {i}" for i in range(300)]
    got = pii.spans(stage(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "pii")).collect()
    assert all([s.kind for s in r["all"]] == [4, 0] for r in got if r.doc_id < 203)


def test_pii_terms_are_marked_everywhere(spark):
    near = [f"w{i}a w{i}b Zorblax me@x.example.com w{i}c w{i}d é{i} a{i} b{i} c{i} d{i} e{i} f{i} zorblax." for i in range(4)]
    rows = [*near, "Zorblax alone, at 10.0.0.1"] + [f"nothing here {i}" for i in range(300)]
    got = {r.doc_id: r for r in pii.spans(stage(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "pii")).collect()}
    for i, text in enumerate(rows):
        terms = [(s.start, s.end) for s in got[i]["all"] if s.kind == 4]
        assert terms == ([m.span() for m in re.finditer("zorblax", text, re.I)])
        assert [tuple(s) for s in got[i].base] == pii.base_spans(text) and set(got[i].remove) <= {a for a, _ in terms}


def test_packed_order_is_the_training_order(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    taken = sorted((p, r.doc_id) for r in mixing.mix(docs).collect() for p in r.positions)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            mixed = stage(mixing.repeated(docs), "mixed")
            pieces = packing.pack(packing.in_file_order(mixed), packing.default_tokenizer(), section=packing.SECTION).filter("start = 0").collect()
            assert [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))] == [i for _, i in taken]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_mixing_with_clashing_names_and_one_id(spark):
    rows = [(None if i % 3 else 7, "w " * (i % 11), "en", "s", i, "p", "t") for i in range(300)]
    table = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, position long, taken_id string, row string"), "clash")
    got = mixing.mix(table).collect()
    assert sum(r.taken for r in got) == sum(r.size for r in got) == round(got[0].target)
    assert mixing.repeated(table).columns == table.columns


def test_targets_of_many_sources(spark):
    draw = random.Random(4)
    sizes = {f"s{i:03d}": draw.choice([0, 1, 3, 10, 400, 90_000]) for i in range(60)}
    got = {r.source: r for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()] + [(None, 5)], "source string, source_size long")).collect()}
    order = [*sorted(sizes), None]
    sizes[None] = 5
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        rest, free = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * rest > 3 * sizes[s] * free}
        if not more:
            break
        capped |= more
    assert {s: got[s].target for s in order} == pytest.approx({s: 3 * sizes[s] if s in capped else weight[s] * rest / free for s in order})
    assert [got[s].place for s in order] == list(range(61))


def test_block_names_do_not_depend_on_partitions(spark, docs):
    names = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            names.append(sorted((r.doc_id, r.rounds, r.name) for r in exact_dedup.name_documents(docs, 16).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert names[0] == names[1]


def test_long_spans_hash_alike(monkeypatch):
    from lingmill.llm import bytesets

    data = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    start, end = np.array([0, 100, 100, 4000]), np.array([90, 100, 3000, 5000])
    whole = bytesets.span_hashes(data, start, end, True)
    monkeypatch.setattr(bytesets, "PIECE", 64)
    assert (bytesets.span_hashes(data, start, end, True) == whole).all()
    assert bytesets.counted(np.arange(256) > 99, data, np.array([0, 2500, 5000])).tolist() == [int((d > 99).sum()) for d in (data[:2500], data[2500:])]


def test_discriminant_is_a_difference_of_log_densities(spark):
    draw = np.random.default_rng(8)
    x = [draw.normal(k, 1 + k, (40, len(quality_classifier.FEATURES))) for k in (0, 1)]
    rows = [(v.tolist(), k) for k in (0, 1) for v in x[k]]
    model = quality_classifier.fit(quality_classifier.moments(spark.createDataFrame(rows, "x array<double>, label int")), 0.5, 0.1)
    every = np.vstack(x)
    shift, scale = every.mean(0), every.std(0) + 1e-6
    z = [(v - shift) / scale for v in x]
    cov = [np.cov(v.T, bias=True) for v in z]
    pooled, want = sum(cov) / 2, 0
    for k, sign in ((0, -1), (1, 1)):
        c = 0.5 * cov[k] + 0.5 * pooled
        c = 0.9 * c + 0.1 * np.trace(c) / len(c) * np.eye(len(c))
        d = (every - shift) / scale - z[k].mean(0)
        want = want + sign * (np.log(0.5) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert model.difference(every) == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_mixing_comes_in_training_order(spark):
    folder = "/root/testdata/sf0.001"
    got = [r.doc_id for r in mixing.op4_mixing(spark, folder).collect()]
    at = {r.doc_id: r.positions[0] if r.positions else 2.0 for r in mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert got == sorted(at, key=lambda i: (at[i], i))
