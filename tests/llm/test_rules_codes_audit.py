"""Quality rules, vector codes and the filter audit, each against a plain computation."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from colprep.llm import filter_audit, quality_rules, vector_codes

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


def repeated(ws):
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def texts():
    rng = random.Random(5)
    prose = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(80)) for _ in range(4)]
    return [
        None, "", " \t\n\x0b\x0c\r ", "one two", "a a a a", "x y z w \U0001f600 é", "#*$%&|<>" * 3, *prose, prose[0], prose[0],
        "the same old words " * 60, "\n".join([prose[1], prose[1], " ", "", "\t", prose[2], prose[1]]), " | ".join(prose[3].split()), prose[2].upper(),
        " ".join("1234567" for _ in range(30)) + " " + prose[1], "- a b c\n" * 40 + "* " + prose[2].replace(" ", "\n- "), " ".join(["a", "b", "c", "d"] * 3000 + prose), "q" * 200_000 + " " + prose[3],
    ]


def test_base_measures(docs):
    rows = texts()
    out = {r["doc_id"]: r for r in quality_rules.audit(docs(rows)).collect()}
    assert len(out) == len(rows)
    for k, text in enumerate(rows):
        ws = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        found = (sum(map(len, ws)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)))
        r = out[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(ws), *found), text
        if len(ws) <= 12_000:  # the plain count is quadratic
            assert r["n_repeat_words"] == repeated(ws), text
        assert r["base_failed"] == (len(ws) < 50 or 100 * r["n_repeat_words"] > 50 * len(ws))
        assert not (r["kept"] and r["base_failed"])
    assert {k for k, r in out.items() if r["kept"]} == {7, 8, 9, 10, 11, 12}


def test_cascade_order_and_effect(docs, spark):
    frame = docs(texts())
    steps = quality_rules.plan(frame)
    assert {s.rule.name for s in steps} == {r.name for r in quality_rules.RULES}
    left = steps[:]
    while left:  # no later rule would have rejected more per second at any place
        head = left.pop(0)
        assert head.newly_rejected <= head.rejected
        assert all(head.newly_rejected / head.seconds >= s.newly_rejected / s.seconds for s in left)
    measure = quality_rules.measures_of(frame["text"])
    kept = []
    for order in (steps, steps[::-1]):
        kept.append({r["doc_id"] for r in frame.where(quality_rules.first_failed(order, measure).isNull()).collect()})
    whole = quality_rules.drop_failing(frame)
    assert whole.columns == frame.columns and kept[0] == kept[1] == {r["doc_id"] for r in whole.collect()}
    assert quality_rules.audit(frame.limit(0)).count() == 0 and quality_rules.drop_failing(frame.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [(r["doc_id"], r["n_words"], r["kept"]) for r in quality_rules.audit(nulls).collect()] == [(None, 0, False)] * 3


def test_short_circuit_skips_later_rules(docs):
    """A rule behind one that every text fails is never evaluated."""
    never = quality_rules.Rule("never", lambda m: (m("n_words") / 0).isNotNull())
    always = quality_rules.Rule("always", lambda m: m("n_words") >= 0)
    steps = [quality_rules.Step(always, 1.0, 1, 1), quality_rules.Step(never, 1.0, 0, 0)]
    frame = docs(["a b", None])
    assert [r[0] for r in frame.select(quality_rules.first_failed(steps, quality_rules.measures_of(frame["text"]))).collect()] == ["always"] * 2


def plain_codes(rows):
    """Codes, errors and codebooks by trying every entry."""
    kept = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // 16
    x = np.array([v for _, v in kept]).reshape(len(kept), 16, width)
    books = [[x[n, p].tolist() for n in range(min(64, len(kept)))] for p in range(16)]

    def assigned():
        found = [[min((sum((a - b) ** 2 for a, b in zip(x[n, p].tolist(), e)), k) for k, e in enumerate(books[p])) for p in range(16)] for n in range(len(kept))]
        return found

    for _ in range(2):
        found = assigned()
        for p in range(16):
            for k in range(len(books[p])):
                mine = [x[n, p].tolist() for n in range(len(kept)) if found[n][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assigned()
    text = ",".join(str(c) for part in books for entry in part for c in entry)
    return [(k, "".join(f"{b[1]:02x}" for b in f), sum(b[0] for b in f)) for (k, _), f in zip(kept, found)], hashlib.sha256(text.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, error string, code int, vector string"


@pytest.mark.parametrize("count", [40, 300])
def test_codes_equal_plain_ones(spark, count):
    rng = np.random.default_rng(count)
    base = rng.normal(0, 0.12, (count, 32)).astype("float32")
    base[5:20] = base[4]  # equal vectors
    base[30:35] = np.round(base[30:35], 1)  # ties
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(count) * 3 - 50, base)]
    bad = [(1000, None), (1001, [None] * 32), (1002, [float("nan")] + [0.0] * 31), (1003, [0.0] * 31 + [float("inf")])]
    labels = [None if k % 5 == 0 else k % 3 for k in range(count + 4)]
    frame = spark.createDataFrame([(k, v, label, "x", 1, "y") for (k, v), label in zip(rows + bad, labels)], VECTORS).repartition(5)
    expected, digest = plain_codes(rows)
    out = vector_codes.compress(frame).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in out) == sorted(expected)
    assert {r["codebooks_sha256"] for r in out} == {digest}
    by_label = {}
    label_of = {k: label for (k, _), label in zip(rows, labels)}
    for k, _, e in expected:
        by_label[label_of[k]] = by_label.get(label_of[k], 0) + e
    assert all(r["label_error"] == by_label[label_of[r["vec_id"]]] for r in out)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "", 1, "")], VECTORS)).count() == 0
    rows = [(None, [0.5] * 16), (None, [0.25] * 16), (7, []), (7, [0.1] * 5), (8, [0.1] * 40), (9, [3.0e38] * 16), (9, [-3.0e38] * 16)]
    out = vector_codes.compress(spark.createDataFrame([(k, v, None, "", 1, "") for k, v in rows], VECTORS)).collect()
    assert sorted(str(r["vec_id"]) for r in out) == sorted(str(k) for k, _ in rows) and all(len(r["code"]) == 32 and r["error"] == 0 for r in out)
    empty = vector_codes.compress(spark.createDataFrame([(1, [], 3, "", 1, ""), (2, [], 3, "", 1, "")], VECTORS)).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in empty} == {("00" * 16, 0, 0)}


def test_memo_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    entries = rng.integers(-90, 90, (64, 4))
    points = rng.integers(-120, 120, (5000, 4))
    distance = ((points[:, None] - entries[None]) ** 2).sum(2)
    for bits, room in ((0, 10), (3, 100), (4, 1 << 20), (9, 5)):
        memo = vector_codes.CellMemo(entries, bits, room)
        for _ in range(2):
            index, best = memo.nearest(points)
            assert (index == distance.argmin(1)).all() and (best == distance.min(1)).all()
        assert len(memo.keys) <= room
    memo = vector_codes.CellMemo(entries, 4, 1 << 20)
    memo.nearest(points)
    assert memo.evaluated < 0.3 * 64 * len(points)
    same = vector_codes.CellMemo(entries, 4, 1 << 20)
    clash = np.zeros(3, np.int64)  # three boxes of one hash: told apart by their coordinates
    boxes = np.array([[0, 0, 0, 0], [3, 0, 0, 0], [-5, 1, 2, 0]])
    for _ in range(2):
        assert (same.candidates(boxes, clash) == same.undominated(boxes)).all()


def plain_audit(rows, labels):
    texts = [(k, part or "", text or "") for k, part, text in rows]
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}

    def failed(k, text):
        ws = words(text)
        return {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": k is not None and any(j is not None and j < k and other == text for j, _, other in texts),
        }

    fails = [(k, part, failed(k, text)) for k, part, text in texts]
    out = {}
    for part in {p for _, p, _ in texts}:
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = [(k, f) for k, p, f in fails if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [(k, f) for k, f in alive if f[x]]
                redundant = sum(f[x] for _, f in gone)
                alive = [(k, f) for k, f in alive if not f[x]]
                gone += removed
                unique = sum(f[x] and sum(f.values()) == 1 for k, p, f in fails if p == part)
                out[part, order, step] = [len(alive), len(removed), redundant, unique, sum(k in good for k, _ in removed if k is not None), sum(k in toxic for k, _ in removed if k is not None)]
        for x in "ABCDE":
            total = sum(out[part, "".join(o), o.index(x) + 1][1] for o in itertools.permutations("ABCDE"))
            for o in itertools.permutations("ABCDE"):
                out[part, "".join(o), o.index(x) + 1].append(total)
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_plain_one(spark):
    rng = random.Random(3)
    long = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(210)) for _ in range(3)]
    pool = [None, "", "Short $ text", "UP", *long, long[0] + " |", "few words " * 150, "few words " * 150 + "#", long[1].upper(), "x " * 60_000]
    rows = [(rng.choice([None, *range(60)]), rng.choice(["en", "de", None, ""]), rng.choice(pool)) for _ in range(300)]
    rows += rows[:20] + [(90, "fr", long[2])]  # repeated rows; a part of one document
    labels = [(rng.choice([None, *range(70)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    docs = spark.createDataFrame([(*r, "x", 1, b"d") for r in rows], "doc_id long, lang string, text string, part string, mask int, digest binary")
    marks = spark.createDataFrame([(*r, "en", "x") for r in labels], "doc_id long, quality int, toxic int, lang string, good string")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    out = filter_audit.audit(docs.repartition(5), marks).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in out}
    assert len(out) == len(found) == 4 * 600 and found == plain_audit(rows, labels)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}
