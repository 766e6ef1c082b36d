import random

import numpy as np
import pytest

from lamina.llm import leakage as L
from lamina.llm.texwords import words

VOCABULARY = [f"w{k}" for k in range(400)]


def text(rnd, n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def test_words_through_markup():
    t = "\\newcommand{\\Vx}{Rina}\nThe \\textbf{quick} {\\bf Brown}~\\cite{a1}fox\\index{b} jum-\n% ped near \\Vx{}, o\\-ver Losoko’s\xa0second-hand\\footnote{One.} dog \\emph{once}\\label{x} caf\\'e"
    assert words(t) == "newcommand vx rina the quick brown fox jumped near rina over losokos secondhand dog once cafe".split() or words(t)[-14:] == "rina the quick brown fox jumped near rina over losokos secondhand dog once cafe".split()
    assert words(None) == words("") == [] and words("\\alpha") == []


@pytest.mark.parametrize("depth", [1, 2, 3, 7, 40])
def test_suffixes_are_in_order(depth):
    rnd = random.Random(depth)
    text = np.array([rnd.choice([0, 1, 1, 1, 2, 3]) for _ in range(700)] + [2, 2, 2, 2] * 9, np.int64)
    rank = L.suffix_ranks(text, depth)

    def suffix(p):
        out = []
        for w in text[p : p + depth].tolist():
            if w == 0:
                break
            out.append(w)
        return out

    order = np.argsort(rank, kind="stable").tolist()
    keys = [suffix(p) for p in order]
    assert keys == sorted(keys)
    assert len(L.suffix_ranks(np.zeros(0, np.int64), 5)) == 0


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_matches_against_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(L, "PLACES_AT_ONCE", at_once)
    rnd = random.Random(2)
    rows = [(k, " ".join(text(rnd, rnd.randint(5, 40)))) for k in range(12)]
    items = L.Items.of(rows)
    doc = []
    for _ in range(60):
        w = rnd.choice(rows)[1].split()
        a = rnd.randrange(len(w))
        doc += w[a : a + rnd.randint(1, 12)] + text(rnd, rnd.randint(0, 3))
    place = np.array([items.vocabulary.get(w, 0) for w in doc], np.int64)
    got = sorted(m for chunk in L.matches(items, place) for m in zip(*(x.tolist() for x in chunk)))
    want = []
    it = items.text
    for p in range(len(place)):
        for j in range(len(it)):
            if it[j] and place[p] == it[j] and not (p and j and place[p - 1] == it[j - 1] and it[j - 1]):
                n = 0
                while p + n < len(place) and j + n < len(it) and place[p + n] == it[j + n] and it[j + n]:
                    n += 1
                if n >= L.MIN_WORDS:
                    want.append((p, j, n))
    assert got == sorted(want) and got


def test_longest_match_of_every_suffix():
    rnd = random.Random(4)
    rows = [(k, " ".join(text(rnd, 30))) for k in range(8)]
    items = L.Items.of(rows)
    doc = np.array([items.vocabulary.get(w, 0) for _ in range(40) for w in rnd.choice(rows)[1].split()[rnd.randrange(20) :]], np.int64)
    array, (j, low, high, n) = L.intervals(items, doc)
    got = {}
    for a, lo, hi, d in zip(j.tolist(), low.tolist(), high.tolist(), n.tolist()):
        got.setdefault(a, {}).update({int(p): d for p in array[lo:hi]})
    for a in items.suffix.tolist():
        want = {}
        for p in range(len(doc)):
            d = 0
            while p + d < len(doc) and doc[p + d] == items.text[a + d] and items.text[a + d]:
                d += 1
            if d >= L.MIN_WORDS:
                want[p] = d
        assert got.get(a, {}) == want


def test_longest_plain_matches(spark):
    df = spark.createDataFrame([(1, "A b, c-d e f. x a b c d"), (2, "q r s"), (3, None), (4, "")], "doc_id long, text string")
    ev = spark.createDataFrame([(7, "a b c d e f g"), (8, "z"), (9, None)], "item_id long, item_text string")
    assert [tuple(r) for r in L.longest_matches(df, ev, 4).collect()] == [(1, 7, 6)]


def case(rnd, item, share, altered=0.0):
    n = max(1, round(share * len(item)))
    a = rnd.randint(0, len(item) - n)
    out = []
    for k, w in enumerate(item[a : a + n]):
        w = "zz" if rnd.random() < altered else w
        out.append(rnd.choice([w, w.upper(), f"\\emph{{{w}}}", w + "\\cite{k}", w + "\n% ", w + "~"]))
    return " ".join(text(rnd, 30) + ["\n"] + out + ["\n"] + text(rnd, 30))


def test_passages_and_shorter_quotations(spark):
    rnd = random.Random(7)
    # Words of their own, so that documents hold nothing of an item by chance.
    items = [(k, " ".join(f"i{k}x{j}" for j in range(rnd.randint(16, 120)))) for k in range(10)]
    docs, want = [], set()
    for d in range(120):
        k = rnd.randrange(10)
        item = items[k][1].split()
        share = rnd.choice([0.1, 0.25, 0.6, 1.0])
        docs.append((d, case(rnd, item, share, 0.05), "x"))
        if share > 0.4:
            want.add((d, k))
    docs += [(500, None, "x"), (501, "", "x"), (502, " ".join(sorted(items[0][1].split(), key=lambda w: hash(w) % 97)), "x"), (503, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, share string")
    ev = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, item_text string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(df, ev).collect()}
    want |= {(503, k) for d, k in want if d == 0}
    assert got == want
    assert L.without_leaks(df, ev).count() == len(docs) - len({d for d, _ in want})


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rnd = random.Random(8)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(30))) for k in range(6)]
    df = spark.createDataFrame([(d, case(rnd, items[d % 6][1].split(), 0.8)) for d in range(30)], "doc_id long, text string")
    ev = spark.createDataFrame(items, "item_id long, item_text string")
    whole = sorted(tuple(r) for r in L.leaks(df, ev).collect())
    monkeypatch.setattr(L, "BLOCK_CHARS", 300)
    assert sorted(tuple(r) for r in L.leaks(df, ev).collect()) == whole and len(whole) == 30


def test_very_long_text_and_many_repetitions(spark):
    item = " ".join(f"q{j}" for j in range(40))
    df = spark.createDataFrame([(1, (item + " and ") * 2000), (2, "a " * 300_000)], "doc_id long, text string")
    ev = spark.createDataFrame([(1, item), (2, item)], "item_id long, item_text string")
    assert sorted((r["doc_id"], r["item_id"], r["share"]) for r in L.leaks(df, ev).collect()) == [(1, 1, 1.0), (1, 2, 1.0)]


@pytest.mark.parametrize("empty", ["documents", "items"])
def test_empty_tables(spark, empty):
    df = spark.createDataFrame([] if empty == "documents" else [(1, "a b c d")], "doc_id long, text string")
    ev = spark.createDataFrame([] if empty == "items" else [(1, "a b c d")], "item_id long, item_text string")
    assert L.leaks(df, ev).count() == 0


def found(item, doc):
    items = L.Items.of([(1, " ".join(item))])
    return L.shard_leaks(items, [1], [" ".join(doc)])


def altered(item, runs):
    """The item from its first word on, of which runs of so many words are kept, split by one altered word each."""
    out, at = [], 0
    for k, n in enumerate(runs):
        out += ["zz"] * (k > 0) + item[at + (k > 0) : at + (k > 0) + n]
        at += n + (k > 0)
    return ["yy"] * 50 + out + ["yy"] * 50


def test_short_runs_inside_a_passage_match_too():
    item = [f"i{k}" for k in range(30)]
    assert [r[3:4] + r[5:] for r in found(item, altered(item, [3, 2, 3, 2, 3]))] == [(13, 0, 17)]
    assert [r[3:4] + r[5:] for r in found(item[:16], altered(item, [4, 2]))] == [(6, 0, 7)]
    assert not found(item, altered(item, [3, 2, 3]))  # ten of thirty words


def test_dense_part_of_a_sparse_chain_is_found():
    item = [f"i{k}" for k in range(40)]
    # 17 words verbatim, then twice three after eight altered ones: 23 of 39 words are too few, 20 of the first 28 are enough.
    doc = ["yy"] * 30 + item[:17] + ["zz"] * 8 + item[25:28] + ["zz"] * 8 + item[36:39] + ["yy"] * 30
    assert [r[3:4] + r[5:] for r in found(item, doc)] == [(20, 0, 28)]
    assert not found(item, item[:9] + ["zz"] * 8 + item[17:20])


def test_passages_end_with_their_document():
    item = [f"i{k}" for k in range(30)]
    items = L.Items.of([(1, " ".join(item))])
    assert not L.shard_leaks(items, [1, 2], [" ".join(["yy", *item[:10]]), " ".join([*item[10:15], "yy"])])
