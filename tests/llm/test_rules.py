"""Operators 1, 3, 4 and 6 against brute force, on the given documents and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
import xxhash
from conftest import SMALL, plan_text
from oracle_check import compare, duck

from mentionlake.llm import decontamination as D
from mentionlake.llm import factorisation as M
from mentionlake.llm import pii
from mentionlake.llm import quality_rules as Q
from mentionlake.llm.common import table

ODD = [
    None, "", " \n ", "one two", "a b c a b c a b c " * 30, "x\n\nx\n x\nx", "é ü 🙂 #$% <b>|</b>", "word " * 40_000, "9" * 30_000, "a" * 50_000, "1 2 " * 4_000,
    "mail a@b.co_c@d.ef and x.y@@z..w@q-r.s", "1.2.3.4 1.2.3.256 01.002.0003.4.5 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4041894974608795", "+1 (988) 555-2485 +12 +49 30 1234567890123456",
    "+4111111111111111 4041894974608795@x.com", "call me (at) a dot b or joe(at)mail.example.com",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*ODD, ODD[4], ODD[4]])] + [(None, "no id here", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


def base_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    hit = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    return words, (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def slots(words, buckets):
    low = [w.lower().encode() for w in words]
    hashed = lambda *parts: [h := 42, *[h := xxhash.xxh64_intdigest(p, h) for p in parts]][-1]
    signed = lambda h: (h - (1 << 64) if h >> 63 else h) % buckets
    return [signed(hashed(w)) for w in low] + [signed(hashed(a, b)) for a, b in zip(low, low[1:], strict=False)]


def test_quality_rules(spark, docs, odd):
    for data, buckets in ((docs.select("doc_id", "text"), Q.BUCKETS), (odd, 64)):
        rows = data.collect()
        good = {r.doc_id for r in table(spark, SMALL, "labels").filter("quality = 1").collect()}
        raw, fine = Counter(), Counter()
        for r in rows:
            found = Counter(slots(base_figures(r.text)[0], buckets))
            raw.update(found)
            if r.doc_id in good:
                fine.update(found)
        n, m = sum(raw.values()), sum(fine.values())
        weight = [math.log((fine[s] + 1) / (m + buckets) / ((raw[s] + 1) / (n + buckets))) * 1e6 for s in range(buckets)]
        got = Q.apply_rules(data, table(spark, SMALL, "labels").filter("quality = 1"), buckets=buckets)
        assert plan_text(got).count("Python") == 0 and plan_text(got).count("Arrow") == 0
        texts = defaultdict(list)
        for r in got.collect():
            texts[r.doc_id, r.text].append(r)
        assert sum(map(len, texts.values())) == len(rows)
        for (_, text), same in texts.items():
            words, figures = base_figures(text)
            for r in same:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures
                assert r.base_failed == (figures[0] < 50 or 100 * figures[4] > 50 * figures[0])
                if words:
                    want = sum(round(weight[s]) for s in slots(words, buckets)) / (2 * len(words) - 1) / 1e6
                    assert r.score == pytest.approx(want, abs=2e-6)
                    assert r.kept == (not r.base_failed and r.score >= Q.THRESHOLD)
                else:
                    assert r.score is None and r.kept is False


def test_quality_rules_shuffle_join_gives_the_same(spark, docs):
    good = table(spark, SMALL, "labels").filter("quality = 1")
    assert Q.slot_weights(docs, good, broadcast_ids=1) == Q.slot_weights(docs, good)


def test_quality_verdicts_follow_the_labels(spark):
    kept = {r.doc_id: r.kept for r in Q.op1_quality_rules(spark, SMALL).collect()}
    assert all(r.doc_id in kept for r in table(spark, SMALL, "labels").collect())


def scan(text, items):
    words = lambda t: re.findall(D.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(10, len(w))
        for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(doc) - n + 1):
                if tuple(doc[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


def test_decontamination(spark, odd):
    bench = [(1, "word word word"), (2, "no id"), (10, None), (3, ""), (2, "A b c a B c a b c a b"), (7, "é ü"), (8, "one two three")]
    frame = spark.createDataFrame(bench, "item_id long, text string")
    for limit in (100_000, 2):  # one block, and several
        for r in D.find_contamination(odd, frame, max_windows=limit).collect():
            if len(r.text or "") < 3_000:
                assert (r.found.n_words, r.found.n_hit, r.found["items"]) == scan(r.text, bench)
    clean = D.decontaminate(odd, frame).collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r in odd.collect() if not scan((r.text or "")[:400], bench)[1]}
    cut = {r.doc_id: r.text for r in D.decontaminate(odd, frame, "spans").collect()}
    assert cut[None].strip() == "here" and cut[6] == " 🙂 #$% <b>|</b>" and cut[3] == "one two"
    nothing = D.find_contamination(odd, frame.limit(0)).collect()
    assert len(nothing) == odd.count() and not any(r.found.n_hit for r in nothing)


def test_decontamination_equals_sql(spark):
    status, _, _, diff = compare(spark, duck(SMALL), D.op3_decontamination, D.OP3_SQL, SMALL)
    assert status == "ok", diff


def test_machine_identity():
    """The linear-time score equals the sum over all pairs."""
    import numpy as np

    random = np.random.default_rng(1)
    model = M.Machine(0.3, random.normal(size=M.SLOTS).astype("f4"), random.normal(size=(M.SLOTS, M.RANK)).astype("f4"))
    slots_, values = random.choice(M.SLOTS, 9, replace=False), random.random(9).astype("f4")
    pairs = sum(model.vectors[slots_[i]] @ model.vectors[slots_[j]] * values[i] * values[j] for i in range(9) for j in range(i))
    want = 0.3 + model.weights[slots_] @ values + pairs
    assert model.margins(slots_, values, np.array([0]))[0] == pytest.approx(want, rel=1e-4)


def test_classifier_learns_from_allowed_rows_only(spark, odd):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = M.op4_quality_classifier(spark, sf).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    test = [(quality[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in quality]
    for label, least in ((1, 0.99), (0, 0.85)):
        right = [p == label for y, p in test if y == label]
        assert sum(right) >= least * len(right), (label, sum(right), len(right))
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")
    flipped = labels.withColumn("quality", M.F.when(M.held_out(), 1 - M.F.col("quality")).otherwise(M.F.col("quality")))
    one, two = M.train(docs, labels, max_rows=300), M.train(docs, flipped, max_rows=300)
    assert one.bias == two.bias and (one.weights == two.weights).all()
    scored = M.score_documents(odd, one)
    assert scored.count() == odd.count() and scored.filter("score is null").count() == 0
    assert M.train(docs.limit(0), labels).bias == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_base(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "phone": lambda d=digits: 9 <= len(d) <= 15,
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d),
            }[kind]()
            if good:
                out.append((m.start(), n, m.end()))
    return ",".join(f"{pii.KINDS[n]}:{a}:{b}" for a, n, b in sorted(out))


def test_metadata_that_are_no_numbers_and_repeated_ids(spark):
    odd = [float("nan"), float("inf"), float("-inf"), None, -3.0, 0.0, 1e300]
    docs = spark.createDataFrame([(i % 20, f"some text {i % 30} here", odd[i % len(odd)]) for i in range(140)], "doc_id long, text string, n_chars double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, 0)], "doc_id long, quality int")
    models = [M.train(d, labels, max_rows=15) for d in (docs, docs.repartition(7))]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
    scored = M.score_documents(docs, models[0]).collect()
    assert len(scored) == 140 and all(0 <= r.score <= 1 for r in scored)
    # What is not a finite number is scored as missing.
    by_text = defaultdict(set)
    for r in scored:
        if r.n_chars is None or math.isnan(r.n_chars) or math.isinf(r.n_chars):
            by_text[r.text].add(round(r.score, 9))
    assert all(len(scores) == 1 for scores in by_text.values())


def test_base_spans_equal_the_plain_patterns(spark, docs, odd):
    for data in (odd, docs.select("doc_id", "text"), table(spark, "/root/testdata/sf0.01", "documents")):
        for r in pii.with_spans(data, pii.Trees()).select("text", "base", "spans").collect():
            got = ",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base)
            if len(r.text or "") < 20_000 or "@" in r.text:
                assert got == plain_base(r.text), r.text[:200]
            assert r.base == r.spans


def test_trees_add_spans_and_keep_base_ones(spark):
    mails = [(i, f"so write to jo{i}@mail{i % 7}.example.com, please {i}") for i in range(900)]
    loose = [(900 + i, f"so write to jo{i} (at) mail{i}.example.com, please") for i in range(9)] + [(950, "nothing 12-34 at all"), (951, None), (952, "")]
    data = spark.createDataFrame(mails + loose, "doc_id long, text string")
    model = pii.train(data)
    found = {r.doc_id: r for r in pii.with_spans(data, model).collect()}
    assert all(found[i].base == found[i].spans and len(found[i].base) == 1 for i in range(900))
    assert all(not found[i].base and [(s.kind, r.text[s.start : s.end]) for s in found[i].spans] == [(0, r.text[12 : r.text.index(",")])] for i in range(900, 909) for r in [found[i]])
    masked = {r.doc_id: r.text for r in pii.redact(data, model).collect()}
    assert masked[3] == "so write to [EMAIL], please 3" and masked[900] == "so write to [EMAIL], please" and masked[951] is None and masked[952] == ""
    x = {f: 0 for f in pii.FEATURES}
    frame = spark.range(1).select(pii.F.struct(*[pii.F.lit(0).alias(f) for f in pii.FEATURES]).alias("x"))
    assert frame.select(model.expression(pii.F.col("x"))).first()[0] == pytest.approx(model.margin(x))


def checked(digits):
    """The digits with the check digit that makes them pass."""
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def planted(i):
    """(kind, what no base rule reads, a decoy that looks like it), in forms of their own."""
    card = checked(f"45{i * 7919 + 10**12:013d}")
    wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
    cut = lambda digits, mark: mark.join(digits[k : k + 4] for k in range(0, 16, 4))
    return [
        ("email", f"ann{i}{{at}}web{i}.example.org", f"talk at site{i}.example.org"), ("email", f"bo.{i} AT post DOT example DOT net", f"stay at home{i} . then go"),
        ("email", f"cy-{i} <at> mail <dot> org", f"{i} (at) night"), ("ip", f"10(.){i % 250}(.)7(.)9", f"{300 + i}(.){i % 250}(.)7(.)9"),
        ("ip", f"192 DOT 168 DOT {i % 250} DOT 4", f"release 192 . 168 . {i % 250} . 4"), ("ip", f"fe80:{i:04x}:1a2b:3c4d:5e6f:7081:92a3:b4c5", f"0a:1b:2c:3d:4e:{i % 100:02d}"),
        ("card", cut(card, "/"), cut(wrong, "/")), ("card", cut(card, "."), cut(wrong, ".")),
        ("phone", f"(0{200 + i}) 555 {1000 + i}", f"ref (0{200 + i}) 555 {1000 + i}"), ("phone", f"0044 20 7946 {1000 + i}", f"order no. 442079461{1000 + i}"),
    ]


def planted_figures(spark, sf_dir):
    """Per kind (planted, found, decoys taken) of 200 planted strings and 200 decoys put into the given documents, and other added spans."""
    texts = [r.text or "" for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    wanted = [p for i in range(20) for p in planted(i)]
    rows = []
    for i, text in enumerate(texts):
        kind, good, decoy = wanted[i % 200] if i < 400 else (None, "", "")
        put, words = (good if i < 200 else decoy), text.split(" ")
        half = " ".join(words[: len(words) // 2]) + " so "
        rows.append((i, kind, i < 200, len(half), len(half) + len(put), half + put + " and " + " ".join(words[len(words) // 2 :])))
    data = spark.createDataFrame(rows, "doc_id long, kind string, good boolean, start int, end int, text string").repartition(8)
    figures, other = defaultdict(lambda: [0, 0, 0]), 0
    for r in pii.with_spans(data, pii.train(data)).collect():
        assert ",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base) == plain_base(r.text)
        own = [s for s in r.spans if s not in r.base]
        assert all(s.start < s.end <= len(r.text) for s in own) and all(a.end <= b.start for a, b in zip(own, own[1:], strict=False))
        assert not any(a.start < b.end and b.start < a.end for a in own for b in r.base)
        hits = [s for s in own if s.start < r.end and s.end > r.start] if r.kind else []
        other += len(own) - len(hits)
        if r.kind and r.good:
            figures[r.kind][0] += 1
            figures[r.kind][1] += any(pii.KINDS[s.kind] == r.kind and (s.start, s.end) == (r.start, r.end) for s in hits)
        elif r.kind:
            figures[r.kind][2] += bool(hits)
    return dict(figures), other


def test_planted_forms_are_found_and_decoys_left(spark):
    figures, other = planted_figures(spark, "/root/testdata/sf0.1")
    print(figures, other)
    found, taken = (sum(f[k] for f in figures.values()) for k in (1, 2))
    assert sum(f[0] for f in figures.values()) == 200
    assert found >= 180 and taken <= 20 and other <= 10, (figures, other)


def test_personal_data_of_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    frame = pii.op6_pii(spark, SMALL)
    assert "Python" not in plan_text(frame) and "Arrow" not in plan_text(frame)
    for r in frame.collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(k + ":") for k in pii.KINDS]


def test_repeat_words_compares_few_windows_as_words(spark):
    """Before, every window of three words was put together and sorted as a string."""
    r = random.Random(5)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 60))) for _ in range(200)] + ["x y z " * 500, "a b", None]
    once = [f"w{i}" for i in range(300)]
    texts += [" ".join(once), " ".join(once + once[:5]), " ".join(once + once[:100] + ["w1", "w2", "w3", "w4"])]  # no, few and many repeated windows
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = Q.with_base_rules(rows)
    assert plan_text(found.select("n_repeat_words")).count("xxhash64") >= 1
    for x in found.collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base_figures(x.text)[1]
